"""Streaming forms equal the batch forms: poll job, keyed cooldown state, admission counters."""

import os
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from territory_engine.operators import admission as A
from territory_engine.operators import claims as C
from territory_engine.plans.observe import PollCounts
from territory_engine.sinks import publish as P
from territory_engine.sources import state as ST
from territory_engine.sources import testdata as TD
from territory_engine.streaming import ingest, stateful


def _time_parts(claims, n=3):
    lo, hi = claims.agg(F.min("time_ms"), F.max("time_ms")).first()
    step = (hi - lo) // n + 1
    return [claims.where((F.col("time_ms") >= lo + i * step) & (F.col("time_ms") < lo + (i + 1) * step)) for i in range(n)]


def as_dict(df):
    return {r["ip"]: (r["name"], r["time_ms"]) for r in df.collect()}


def test_poll_job_equals_batch_fold(spark, tmpdir_path):
    claims = TD.load_claims(spark, SF_SMALL)
    inbox = os.path.join(tmpdir_path, "inbox")
    for i, part in enumerate(_time_parts(claims)):
        P.write_text(P.claim_envelopes(part.coalesce(1), 100), "value", os.path.join(inbox, f"p{i}"))
    # move the part files up into one folder the stream watches (one file per part)
    flat = os.path.join(tmpdir_path, "flat")
    os.makedirs(flat)
    for i in range(3):
        d = os.path.join(inbox, f"p{i}")
        for f in sorted(os.listdir(d)):
            if f.startswith("part-"):
                os.link(os.path.join(d, f), os.path.join(flat, f"{i}-{f}"))
    state_dir, out_dir = os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "out")
    q = ingest.run_stream(spark, flat, state_dir, out_dir, os.path.join(tmpdir_path, "ckpt"),
                          available_now=True, max_files_per_trigger=1, clock="data", compact_every=2)
    q.awaitTermination()
    assert ST.versions(spark, state_dir) == [0, 2]                 # full snapshots
    assert ST.versions(spark, state_dir + "/_delta") == [1]        # touched addresses only
    delta = spark.read.parquet(state_dir + "/_delta/v=1").count()
    assert 0 < delta < spark.read.parquet(state_dir + "/v=2").count()
    assert as_dict(ST.read_state(spark, state_dir, before=2)) == as_dict(
        C.fold_claims(_time_parts(claims)[0].unionByName(_time_parts(claims)[1])))
    got = as_dict(ST.read_state(spark, state_dir))
    assert got == as_dict(C.fold_claims(claims))
    boards = spark.read.json(os.path.join(out_dir, "batch=2", "leaderboards"))
    assert boards.count() > 0
    assert spark.read.json(os.path.join(out_dir, "batch=2", "claims")).count() == len(got)


def test_stateful_processor_equals_fold(spark, tmpdir_path):
    claims = TD.load_claims(spark, SF_SMALL)
    src = os.path.join(tmpdir_path, "src")
    for i, part in enumerate(_time_parts(claims)):
        part.coalesce(1).write.parquet(os.path.join(src, f"p={i}"))
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "p=*"))
    out = stateful.stateful_fold(stream)
    q = (out.writeStream.format("memory").queryName("folded").outputMode("update")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck2")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM folded")
    latest = rows.groupBy("ip").agg(F.max_by(F.struct("name", "time_ms"), "time_ms").alias("s")).select(
        "ip", "s.name", "s.time_ms")
    assert as_dict(latest) == as_dict(C.fold_claims(claims))


def test_stream_admission_equals_batch(spark, tmpdir_path):
    raw = TD.per_user_raw_claims(TD.read_table(spark, SF_SMALL, "events"))
    base = A.normalise(raw).where(F.col("_static").isNull()).select("ip", "name", "time_ms", "seq")
    src = os.path.join(tmpdir_path, "adm")
    base.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(base.schema).parquet(src)
    out = stateful.stream_admission(stream, 1, 2, 86400)
    q = (out.writeStream.format("memory").queryName("adm").outputMode("append")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck3")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["seq"]: r["verdict"] for r in spark.sql("SELECT * FROM adm").collect()}
    batch = A.admit(raw, name_limit=1, ip_limit=2, period_secs=86400).where(
        F.col("verdict").isin("accepted", "name_rate_limited", "ip_rate_limited"))
    assert got == {r["seq"]: r["verdict"] for r in batch.collect()}


def test_admit_stream_equals_batch(spark, tmpdir_path):
    raw = TD.raw_claims_from_events(TD.read_table(spark, SF_SMALL, "events"))
    src = os.path.join(tmpdir_path, "raw")
    raw.coalesce(1).write.parquet(src)
    out = stateful.admit_stream(spark.readStream.schema(raw.schema).parquet(src), 1, 2, 86400)
    q = (out.writeStream.format("memory").queryName("adm_all").outputMode("append")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck4")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["seq"]: r["verdict"] for r in spark.sql("SELECT * FROM adm_all").collect()}
    batch = {r["seq"]: r["verdict"] for r in A.admit(raw, name_limit=1, ip_limit=2, period_secs=86400).collect()}
    assert got == batch


def test_poll_job_replay_is_idempotent(spark, tmpdir_path):
    """Re-running a micro-batch id (as after a failure) recomputes the same state version."""
    claims = TD.load_claims(spark, SF_SMALL)
    parts = _time_parts(claims)
    objs = [P.claim_envelopes(p.coalesce(1), 100).selectExpr("value") for p in parts]
    batches = [spark.createDataFrame([(r["value"], f"file{i}") for r in o.collect()], "value string, f string")
               for i, o in enumerate(objs)]
    from territory_engine.sources.batches import BATCH_FILE

    def as_objects(df):
        return df.select(F.from_json("value", BATCH_FILE).alias("o"), F.col("f").alias("_file"),
                         F.xxhash64("value").alias("_obj")).select("o.*", "_file", "_obj")

    job = ingest.PollJob(os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "out"), clock="data",
                         compact_every=5)
    for i, b in enumerate(batches):
        job.process(as_objects(b), i)
    first = as_dict(ST.read_state(spark, job.state_dir))
    job.process(as_objects(batches[2]), 2)   # replay the last batch
    job.process(as_objects(batches[1]), 1)   # replay an earlier one: rewrites only version 1
    assert as_dict(ST.read_state(spark, job.state_dir)) == first == as_dict(C.fold_claims(claims))


def test_end_to_end_admission_to_rankings(spark, tmpdir_path):
    """Raw requests -> admission -> accepted claims in envelopes -> poll job -> state and rankings."""
    raw = TD.raw_claims_from_events(TD.read_table(spark, SF_SMALL, "events"))
    accepted = A.to_claims(A.admit(raw))
    inbox = os.path.join(tmpdir_path, "inbox")
    P.write_text(P.claim_envelopes(accepted.repartition(3), 100), "value", inbox)
    state_dir, out_dir = os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "out")
    q = ingest.run_stream(spark, inbox, state_dir, out_dir, os.path.join(tmpdir_path, "ck"),
                          available_now=True, clock="data")
    q.awaitTermination()
    got = as_dict(ST.read_state(spark, state_dir))
    expected = as_dict(C.fold_claims(accepted.withColumn("seq", F.lit(0).cast("long")), hot_threshold=None))
    assert got == expected and len(got) > 0
    assert spark.read.json(os.path.join(out_dir, "batch=0", "leaderboards")).count() > 0


def test_batcher_and_poll_with_defaults_lose_nothing(spark, tmpdir_path):
    """The engine's own two jobs joined with defaults: claims in = claims out; what cannot be used
    is set aside, and consumed files are removed only after that."""
    claims = TD.load_claims(spark, SF_SMALL).drop("seq")
    src, inbox = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "inbox")
    claims.coalesce(2).write.parquet(src)
    stream = spark.readStream.schema(claims.schema).parquet(src)
    q = ingest.run_batcher(stream, inbox, os.path.join(tmpdir_path, "ckb"), interval="0 seconds")
    q.processAllAvailable()
    q.stop()
    with open(os.path.join(inbox, "broken.json"), "w") as f:
        f.write('{"batch": [{"ip": "1.2.3.4"')
    with open(os.path.join(inbox, "nameless.json"), "w") as f:
        f.write('{"ip": "1.2.3.4", "time_ms": 5}')
    state_dir, out_dir = os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "out")
    from territory_engine.sources.batches import quarantine, read_batch_files, unwrap
    read = unwrap(quarantine(read_batch_files(spark, [inbox + "/batch=*", inbox + "/nameless.json"]))[0])
    assert read.count() == claims.count() + 1
    run = lambda ck, **kw: ingest.run_stream(spark, inbox + "/*", state_dir, out_dir, os.path.join(tmpdir_path, ck),
                                             available_now=True, clock="data", **kw)
    run("ck", archive_dir=os.path.join(tmpdir_path, "done"), clean_source="archive").awaitTermination()
    expected = C.fold_claims(claims.withColumn("seq", F.lit(0).cast("long")), hot_threshold=None)
    assert as_dict(ST.read_state(spark, state_dir)).keys() == as_dict(expected).keys()
    aside = spark.read.json(out_dir + "/quarantine/batch=0/objects").collect()
    assert len(aside) == 1 and aside[0]["text"].startswith('{"batch"')
    assert spark.read.json(out_dir + "/quarantine/batch=0/claims").count() == 1
    import pytest
    with pytest.raises(Exception, match="unusable objects"):
        run("ck-strict", fail_fast=True).awaitTermination()


def test_limiter_counts_every_period_apart(spark, tmpdir_path):
    """A late claim of an older period neither resets the newer one nor escapes its own limit; periods
    that arrive out of order give the batch verdicts."""
    rows = [(0, 25_000), (1, 26_000), (2, 5_000), (3, 27_000), (4, 28_000), (5, 6_000), (6, 7_000)]
    src = os.path.join(tmpdir_path, "late")
    for i, (seq, t) in enumerate(rows):
        df = spark.createDataFrame([("1.1.1.1", f"n{seq}", t, seq)], "ip string, name string, time_ms long, seq long")
        df.coalesce(1).write.parquet(os.path.join(src, f"p={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "p=*"))
    q = (stateful.stream_admission(stream, 10, 2, 10).writeStream.format("memory").queryName("late").outputMode("append")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ckl")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["seq"]: r["verdict"] for r in spark.sql("SELECT * FROM late").collect()}
    assert got == {0: "accepted", 1: "accepted", 2: "accepted", 3: "ip_rate_limited", 4: "ip_rate_limited", 5: "accepted",
                   6: "ip_rate_limited"}


def test_stream_from_a_given_state_equals_apply_claims(spark, tmpdir_path):
    """A stream seeded with a state version goes on as the batch upsert would, late claims and names without
    places included; addresses without new claims keep their row."""
    claims = TD.load_claims(spark, SF_SMALL)
    first, second, third = _time_parts(claims)
    state_dir = os.path.join(tmpdir_path, "state")
    ST.write_state(C.fold_claims(second), state_dir, 0)
    state = ST.read_state(spark, state_dir)
    src = os.path.join(tmpdir_path, "src")
    for i, part in enumerate([first, third]):  # the first part is late
        part.coalesce(1).write.parquet(os.path.join(src, f"p={i}"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in claims.schema.fields)
    got = stateful.fold_stream_from(spark, state, os.path.join(src, "p=*"), schema, os.path.join(tmpdir_path, "ck"),
                                    os.path.join(tmpdir_path, "out"), max_files_per_trigger=1)
    want = C.apply_claims(C.apply_claims(state, first), third)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(*C.CLAIM_COLUMNS).collect())))
    assert rows(got) == rows(want)
    changed = spark.read.parquet(os.path.join(tmpdir_path, "out")).count()
    assert 0 < changed <= first.count() + third.count()


def test_stored_claim_holds_back_a_repeat(spark, tmpdir_path):
    """The cooldown runs from the stored claim of the given state."""
    ddl = "ip string, name string, asn long, colo string, country string, region string, metro string, city string, time_ms long"
    row = lambda ip, name, t: (ip, name, None, None, "c", None, None, None, t)
    state = spark.createDataFrame([row("a", "x", 1_000_000), row("b", "x", 1_000_000), row("c", "x", 1_000_000), row("d", "x", 1_000_000)], ddl)
    new = [("a", "x", 1_000_000 + 900_000), ("b", "x", 1_000_001 + 900_000), ("c", "y", 1_000_000), ("d", "y", 1_000_001), ("e", "z", 5)]
    src = os.path.join(tmpdir_path, "src")
    spark.createDataFrame([(*row(*n), i) for i, n in enumerate(new)], ddl + ", seq long").coalesce(1).write.parquet(src)
    got = stateful.fold_stream_from(spark, state, src, ddl + ", seq long", os.path.join(tmpdir_path, "ck"), os.path.join(tmpdir_path, "out"))
    assert as_dict(got) == {"a": ("x", 1_000_000), "b": ("x", 1_900_001), "c": ("x", 1_000_000), "d": ("y", 1_000_001), "e": ("z", 5)}


def test_objects_are_flushed_by_size_or_time(spark, tmpdir_path):
    """Objects of exactly 100 under load; what is left goes out once it has waited; a restart neither loses nor
    doubles the claims that wait."""
    import json
    import time

    ddl = "ip string, name string, asn long, colo string, country string, region string, metro string, city string, time_ms long"
    src, out, ck = (os.path.join(tmpdir_path, d) for d in ("src", "out", "ck"))
    seen = [0]

    def arrive(n):
        rows = [(f"10.0.0.{i}", "n", None if i % 2 else 1 << 40, "c", None, "r", None, None, 1000 + i) for i in range(seen[0], seen[0] + n)]
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(src)
        seen[0] += n

    def objects():
        if not os.path.exists(out):
            return []
        return [json.loads(r["value"]) for r in spark.read.schema("value string").text(out).collect()]

    def wait(condition, seconds=40):
        end = time.time() + seconds
        while not condition() and time.time() < end:
            time.sleep(0.3)
        assert condition()

    def start(interval_ms):
        return ingest.run_size_or_time_batcher(spark.readStream.schema(ddl).parquet(src), out, ck, 100, interval_ms, shards=1,
                                               trigger="200 milliseconds")

    was = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        arrive(250)
        q = start(interval_ms=3_600_000)
        wait(lambda: sum(len(o["batch"]) for o in objects()) >= 200)
        arrive(30)  # micro-batches without data go on, so the query is never idle: count what it has read
        wait(lambda: sum(p["numInputRows"] for p in q.recentProgress) == 280)
        assert [len(o["batch"]) for o in objects()] == [100, 100]  # 80 wait
        q.stop()
        arrive(45)
        q = start(interval_ms=1500)
        wait(lambda: len(objects()) == 3)
        first_seen = time.time()
        wait(lambda: len(objects()) == 4)  # the 25 that are left, by the timer
        assert time.time() - first_seen < 20
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", was)
    assert sorted(len(o["batch"]) for o in objects()) == [25, 100, 100, 100]
    claims = [c for o in objects() for c in o["batch"]]
    assert sorted(c["time_ms"] for c in claims) == [1000 + i for i in range(325)]
    assert {c.get("asn") for c in claims} == {None, 1 << 40}


def test_poll_counts_of_each_batch(spark, tmpdir_path):
    """Objects and claims read, accepted and set aside, per micro-batch, from the pass that reads the input."""
    inbox = os.path.join(tmpdir_path, "inbox")
    os.makedirs(inbox)
    claim = '{"ip": "1.2.3.4", "name": "a", "time_ms": %d}'
    files = ['{"batch": [' + ", ".join(claim % i for i in range(3)) + ', {"ip": "1.1.1.1"}]}\n{"batch": [',
             claim % 7 + "\n" + '{"name": "b"}' + "\n" + '{"batch": []}']
    for i, text in enumerate(files):
        with open(os.path.join(inbox, f"{i}.json"), "w") as f:
            f.write(text)
        os.utime(os.path.join(inbox, f"{i}.json"), (1_700_000_000 + i, 1_700_000_000 + i))
    counts = PollCounts()
    spark.streams.addListener(counts)
    try:
        q = ingest.run_stream(spark, inbox, os.path.join(tmpdir_path, "state"), os.path.join(tmpdir_path, "out"),
                              os.path.join(tmpdir_path, "ckpt"), available_now=True, max_files_per_trigger=1, clock="data")
        q.awaitTermination()
        seen = [p.observedMetrics["poll"].asDict() for p in q.recentProgress if p.numInputRows]
        deadline = time.monotonic() + 20
        while str(q.runId) not in counts.totals or counts.totals[str(q.runId)]["objects"] < 5:
            assert time.monotonic() < deadline
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    assert seen == [{"objects": 2, "unreadable": 1, "claims": 4, "accepted": 3, "quarantined": 1},
                    {"objects": 3, "unreadable": 0, "claims": 2, "accepted": 1, "quarantined": 1}]
    assert counts.totals[str(q.runId)] == {k: seen[0][k] + seen[1][k] for k in seen[0]}
