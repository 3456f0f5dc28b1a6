"""The cooldown upsert fold against a plain-Python model (randomised) and edge fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from model import fold
from territory_engine.operators import claims as C
from territory_engine.schema import CLAIM

SCHEMA = "ip string, name string, asn bigint, colo string, country string, region string, metro string, city string, time_ms bigint, seq bigint"


def rows_df(spark, rows):
    full = [(r["ip"], r["name"], 1, "C00", "AX", None, None, None, r["time_ms"], r["seq"]) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def as_dict(df):
    return {r["ip"]: (r["name"], r["time_ms"]) for r in df.collect()}


def model_dict(state):
    return {ip: (r["name"], r["time_ms"]) for ip, r in state.items()}


def gen_rows(rng, n, ips=6, names=3, ties=True, seq0=0):
    out = []
    t = 1_000_000_000_000
    for i in range(n):
        step = rng.choice([0, 1, 899_999, 900_000, 900_001, 60_000, 3_000_000]) if ties else rng.randint(1, 2_000_000)
        t += step
        out.append({"ip": f"ip{rng.randrange(ips)}", "name": f"n{rng.randrange(names)}", "time_ms": t, "seq": seq0 + i})
    rng.shuffle(out)
    return out


def test_edges(spark):
    base = 1_700_000_000_000
    rows = [
        {"ip": "a", "name": "x", "time_ms": base, "seq": 0},
        {"ip": "a", "name": "x", "time_ms": base + 899_999, "seq": 1},   # within cooldown
        {"ip": "a", "name": "x", "time_ms": base + 900_000, "seq": 2},   # equal: rejected (strict)
        {"ip": "b", "name": "x", "time_ms": base, "seq": 3},
        {"ip": "b", "name": "x", "time_ms": base + 900_001, "seq": 4},   # passes
        {"ip": "c", "name": "x", "time_ms": base, "seq": 5},
        {"ip": "c", "name": "y", "time_ms": base + 1, "seq": 6},         # name change, newer
        {"ip": "d", "name": "x", "time_ms": base, "seq": 7},
        {"ip": "d", "name": "y", "time_ms": base, "seq": 8},             # name change at equal time: rejected
        {"ip": "e", "name": "x", "time_ms": base, "seq": 9},
        {"ip": "e", "name": "y", "time_ms": base + 5, "seq": 10},
        {"ip": "e", "name": "x", "time_ms": base + 10, "seq": 11},       # A-B-A: accepted (different from stored)
    ]
    got = as_dict(C.fold_claims(rows_df(spark, rows)))
    assert got == {
        "a": ("x", base), "b": ("x", base + 900_001), "c": ("y", base + 1),
        "d": ("x", base), "e": ("x", base + 10),
    }
    assert got == model_dict(fold(rows))


@pytest.mark.parametrize("seed", range(6))
def test_random_full_fold(spark, seed):
    rng = random.Random(seed)
    rows = gen_rows(rng, 300)
    assert as_dict(C.fold_claims(rows_df(spark, rows))) == model_dict(fold(rows))


@pytest.mark.parametrize("seed", range(4))
def test_incremental_with_late_rows(spark, seed):
    rng = random.Random(100 + seed)
    first = gen_rows(rng, 150)
    second = gen_rows(rng, 150, seq0=1000)
    # late rows: the second batch also carries times from before the first batch's end
    state = C.apply_claims(None, rows_df(spark, first))
    state = C.apply_claims(state.select(*CLAIM.fieldNames()), rows_df(spark, second))
    expected = fold(second, stored=fold(first))
    assert as_dict(state) == model_dict(expected)


def test_replay_latest_batch_is_noop(spark):
    rng = random.Random(7)
    first, second = gen_rows(rng, 120), gen_rows(rng, 120, seq0=500)
    s1 = C.apply_claims(None, rows_df(spark, first))
    s2 = C.apply_claims(s1, rows_df(spark, second))
    s3 = C.apply_claims(s2, rows_df(spark, second))
    assert as_dict(s3) == as_dict(s2)


def test_null_rows_are_dropped(spark):
    df = spark.createDataFrame(
        [("a", None, 1, None, None, None, None, None, 5, 0), (None, "x", 1, None, None, None, None, None, 5, 1),
         ("a", "x", 1, None, None, None, None, None, 7, 2)], SCHEMA)
    assert as_dict(C.fold_claims(df)) == {"a": ("x", 7)}


@pytest.mark.parametrize("seed", range(3))
def test_last_run_fold_equals_full_fold(spark, seed):
    rng = random.Random(200 + seed)
    rows = gen_rows(rng, 300, ties=False)
    df = rows_df(spark, rows)
    assert as_dict(C.fold_claims(C.last_run(df))) == as_dict(C.fold_claims(df))


def test_newest_wins_merge(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "ip string, name string, time_ms bigint")
    new = spark.createDataFrame([("b", "z", 5), ("c", "w", 6)], "ip string, name string, time_ms bigint")
    got = {r["ip"]: r["name"] for r in C.newest_wins_merge(old, new).collect()}
    assert got == {"a": "x", "b": "z", "c": "w"}


def test_fold_plan_single_shuffle(spark):
    df = rows_df(spark, gen_rows(random.Random(1), 50))
    plan = C.fold_claims(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_hot_path_equals_model(spark, seed):
    """Force every address onto the hot-key path (threshold 0) and compare with the model."""
    rng = random.Random(300 + seed)
    rows = gen_rows(rng, 250, ips=3, names=3)
    got = as_dict(C.fold_claims(rows_df(spark, rows), hot_threshold=0))
    assert got == model_dict(fold(rows))


@pytest.mark.parametrize("seed", range(3))
def test_hot_path_with_stored_rows(spark, seed):
    rng = random.Random(400 + seed)
    first, second = gen_rows(rng, 120, ips=4), gen_rows(rng, 160, ips=4, seq0=1000)
    stored = C.fold_claims(rows_df(spark, first), hot_threshold=None)
    touched = C.fold_claims(rows_df(spark, second), stored, hot_threshold=0)
    kept = stored.join(rows_df(spark, second).select("ip"), "ip", "left_anti")
    got = as_dict(touched.unionByName(kept))
    assert got == model_dict(fold(second, stored=fold(first)))


def test_hot_path_sparse_and_long_runs(spark):
    """Long same-name runs across many empty buckets, and stored rows in empty buckets."""
    rows, t, seq = [], 1_000_000_000_000, 0
    for gap in [10, 500_000, 3_000_000, 899_999, 1, 7_200_000, 900_001, 0, 0, 30_000_000, 5]:
        t += gap
        rows.append({"ip": "h", "name": "x" if seq % 5 else "y", "time_ms": t, "seq": seq})
        seq += 1
    assert as_dict(C.fold_claims(rows_df(spark, rows), hot_threshold=0)) == model_dict(fold(rows))


def test_hot_path_multi_column_order_and_long_history(spark):
    """One hot address with a long history, ties broken by two columns (file, offset)."""
    rng = random.Random(77)
    rows, t = [], 1_000_000_000_000
    for i in range(1500):
        t += rng.choice([0, 0, 1, 450_000, 899_999, 900_001, 2_000_000])
        rows.append({"ip": "hot", "name": rng.choice(["a", "b"]), "time_ms": t, "seq": i})
    full = [(r["ip"], r["name"], 1, "C00", "AX", None, None, None, r["time_ms"], f"f{r['seq'] % 3}", r["seq"] // 3)
            for r in rows]
    df = spark.createDataFrame(full, SCHEMA.replace("seq bigint", "_file string, _offset bigint"))
    order = ("time_ms", "_file", "_offset")
    got = as_dict(C.fold_claims(df, hot_threshold=100, order=order))
    small = as_dict(C.fold_claims(df, hot_threshold=None, order=order))
    keyed = [dict(r, seq=(f"f{r['seq'] % 3}", r["seq"] // 3)) for r in rows]
    assert got == small == model_dict(fold(keyed))


@pytest.mark.parametrize("seed", range(3))
def test_hot_path_with_repeated_claims(spark, seed):
    """Claims delivered more than once, ties included: one row per address, as in the plain fold."""
    rng = random.Random(500 + seed)
    rows = gen_rows(rng, 120, ips=3, names=3)
    rows += [dict(r) for r in rng.sample(rows, 60)] + [dict(r, name="other") for r in rng.sample(rows, 20)]
    df = rows_df(spark, rows)
    hot, plain = C.fold_claims(df, hot_threshold=0), C.fold_claims(df, hot_threshold=None)
    assert hot.count() == hot.select("ip").distinct().count()
    assert as_dict(hot) == as_dict(plain)


def test_upsert_with_hot_addresses(spark):
    rng = random.Random(9)
    first, second = gen_rows(rng, 80, ips=4), gen_rows(rng, 120, ips=4, seq0=1000)
    second += [dict(r, ip="ip0", seq=r["seq"] + 5000) for r in second[:60]]
    state = C.fold_claims(rows_df(spark, first), hot_threshold=None)
    got = C.apply_claims(state, rows_df(spark, second), hot_threshold=50)
    assert as_dict(got) == model_dict(fold(second, stored=fold(first)))


def test_hot_path_with_ties_and_stored_rows_around_the_last_change(spark):
    """Few times, two or three names: what is stored at the last change of name depends on what came before."""
    rng = random.Random(600)
    start = 1_000_000_000_000

    def some(n, seq0):
        return [{"ip": f"ip{rng.randrange(60)}", "name": f"n{rng.choice([0, 0, 1, 2])}", "seq": seq0 + i,
                 "time_ms": start + rng.choice([0, 1, 450_000, 900_000, 900_001]) + 700_000 * rng.randrange(6)} for i in range(n)]

    first, second = some(90, 0), some(600, 1000)
    stored = C.fold_claims(rows_df(spark, first), hot_threshold=None)
    fresh = C.fold_claims(rows_df(spark, second), hot_threshold=0)
    assert as_dict(fresh) == model_dict(fold(second))
    touched = C.fold_claims(rows_df(spark, second), stored, hot_threshold=0)
    want = model_dict(fold(second, stored=fold(first)))
    assert as_dict(touched) == {r["ip"]: want[r["ip"]] for r in second}


def test_hot_path_writes_little(spark, tmpdir_path):
    """Claims that can't show in the final row any more are not linked: little is written for a long history."""
    import os
    rows = spark.range(12_000).selectExpr(
        "concat('ip', id % 4) AS ip", "concat('n', id DIV 4 % 3) AS name", "1L AS asn", "'C00' AS colo", "'AX' AS country",
        "CAST(NULL AS STRING) AS region", "CAST(NULL AS STRING) AS metro", "CAST(NULL AS STRING) AS city",
        "1700000000000 + id DIV 4 * 60000 AS time_ms", "id AS seq")
    sc = spark.sparkContext
    was = sc.getCheckpointDir()
    sc.setCheckpointDir(tmpdir_path)
    try:
        got = as_dict(C.fold_claims(rows, hot_threshold=100))
    finally:
        sc._jsc.setCheckpointDir(was)
    assert got == {f"ip{k}": ("n2", 1_700_000_000_000 + 2999 * 60_000) for k in range(4)}
    assert sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmpdir_path) for f in names) < 200_000


def test_hot_path_leaves_out_most_claims_before_shuffles(spark):
    """With more hot addresses than Spark broadcasts, the claims that can't show any more are not shuffled for the joins."""
    rows = spark.range(40_000).selectExpr(
        "concat('ip', id % 400) AS ip", "concat('n', id DIV 400 % 3) AS name", "1L AS asn", "'C00' AS colo", "'AX' AS country",
        "CAST(NULL AS STRING) AS region", "CAST(NULL AS STRING) AS metro", "sha2(CAST(id AS STRING), 512) AS city",
        "1700000000000 + id DIV 400 * 60000 AS time_ms", "id AS seq").unionByName(spark.range(2).selectExpr(
            "'few' AS ip", "'n0' AS name", "1L AS asn", "'C00' AS colo", "'AX' AS country", "CAST(NULL AS STRING) AS region",
            "CAST(NULL AS STRING) AS metro", "CAST(NULL AS STRING) AS city", "id AS time_ms", "id AS seq"))

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = (files.apply(k) for k in range(files.size()))
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = as_dict(C.fold_claims(rows, hot_threshold=50))
        written = sum(size for name, size in shuffled().items() if name not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"ip{k}": ("n0", 1_700_000_000_000 + 99 * 60_000) for k in range(400)} | {"few": ("n0", 0)}
    assert 0 < written < 3_000_000
