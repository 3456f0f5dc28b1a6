"""Rankings kept up poll by poll equal the full recompute; what a poll reads follows the batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from territory_engine.operators import claims as C
from territory_engine.operators.rankings import leaderboards
from territory_engine.streaming.windows import SLOT_MS, WindowedRankings

DDL = "ip string, name string, asn long, colo string, country string, region string, metro string, city string, time_ms long, seq long"
DAY = 86_400_000
T0 = 40 * DAY


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def batch(rng, n, clock, seq):
    """Claims around the clock; some are days or weeks late, some lie exactly a window before the clock."""
    out = []
    for i in range(n):
        t = clock - rng.choice([0, rng.randrange(600_000), rng.randrange(3 * DAY), rng.randrange(35 * DAY), 3_600_000, DAY, 7 * DAY, 30 * DAY])
        out.append((f"10.0.{rng.randrange(3)}.{rng.randrange(40)}", rng.choice("abcde"), None, rng.choice(["X", "Y", "Z", None]),
                    rng.choice(["U", "V", None]), rng.choice(["R1", "R2", "R3"]), None, None, t, seq + i))
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Small tables, many small jobs."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_twenty_polls_equal_the_full_recompute(spark, tmpdir_path):
    rng = random.Random(11)
    job = WindowedRankings(spark, os.path.join(tmpdir_path, "w"), buckets=4, slot_ms=2 * DAY)
    state, clock, seq = None, T0, 0
    for version in range(20):
        clock += rng.choice([60_000, 3_600_000, 3 * 3_600_000, DAY, 2 * DAY, 8 * DAY])
        made = batch(rng, rng.choice([0, 3, 25]) if version else 150, clock, seq)
        seq += len(made)
        claims = spark.createDataFrame(made, DDL)
        got = job.poll(claims, version, clock)
        state = C.apply_claims(state, claims)
        path = os.path.join(tmpdir_path, f"s{version}")
        state.write.parquet(path)
        state = spark.read.parquet(path)
        if version % 5 in (1, 4):
            assert rows(got) == rows(leaderboards(state, clock)), version
    assert rows(job.state.read()) == rows(state)
    # a repeated poll, and a poll below it, give what they gave; old versions can go
    again = rows(job.poll(spark.createDataFrame(made, DDL), 19, clock))
    assert again == rows(leaderboards(state, clock))
    job.expire(19)
    assert rows(job.leaderboards()) == again


def test_a_poll_reads_what_the_batch_touches(spark, tmpdir_path):
    """One claim among many: a few of the buckets are read, and few rows of the large tables."""
    many = [(f"10.{i % 200}.{i // 200}.1", f"n{i % 50}", None, f"c{i % 400}", f"k{i % 90}", f"r{i % 300}", None, None, T0 - (i * 977) % (20 * DAY), i)
            for i in range(6000)]
    job = WindowedRankings(spark, os.path.join(tmpdir_path, "w"), buckets=64, slot_ms=DAY)
    claims = spark.createDataFrame(many, DDL)
    job.poll(claims, 0, T0)
    one = spark.createDataFrame([(many[7][0], "new", None, "c1", "k1", "r1", None, None, T0 + 2_000_000, 9000)], DDL)
    got = job.poll(one, 1, T0 + 5000)
    folded = C.apply_claims(C.fold_claims(claims), one)
    assert rows(got) == rows(leaderboards(folded, T0 + 5000))
    assert len(job.read["state"]) == 1 and len(job.read["queue"]) <= 6
    for name, table, most in (("state", job.state, 0.05), ("holds", job.holds, 0.3), ("counts", job.counts, 0.3)):
        read, whole = table.read(1, job.read[name]).count(), table.read(1).count()
        assert 0 < read < most * whole, (name, read, whole)


def test_an_empty_start_and_the_clock_alone(spark, tmpdir_path):
    job = WindowedRankings(spark, os.path.join(tmpdir_path, "w"), buckets=4, slot_ms=DAY)
    none = spark.createDataFrame([], DDL)
    assert job.poll(none, 0, T0).count() == 0
    one = [("1.1.1.1", "a", None, "X", None, "R", None, None, T0, 0), (None, "a", None, "X", None, None, None, None, T0, 1),
           ("2.2.2.2", None, None, "X", None, None, None, None, T0, 2), ("3.3.3.3", "a", None, None, None, None, None, None, T0, 3)]
    assert job.poll(spark.createDataFrame(one, DDL), 1, T0).where("time_window = 'hourly'").count() == 2
    assert job.poll(none, 2, T0 + SLOT_MS - 1).where("time_window = 'hourly'").count() == 2
    assert job.poll(none, 3, T0 + SLOT_MS).where("time_window = 'hourly'").count() == 0  # the cut is strict
    assert job.poll(none, 4, T0).where("time_window = 'daily'").count() == 2  # the clock does not go back
    assert job.poll(none, 5, T0 + 40 * DAY).select(F.collect_set("time_window")).first()[0] == ["all-time"]


def test_poll_job_with_kept_up_rankings(spark, tmpdir_path):
    """The streamed poll job gives the same leaderboards, recents and dump either way."""
    from territory_engine.sinks import publish as P
    from territory_engine.streaming import ingest
    rng = random.Random(3)
    for i in range(3):
        made = spark.createDataFrame(batch(rng, 60, T0 + i * DAY, i * 100), DDL)
        P.write_text(P.claim_envelopes(made.coalesce(1), 100), "value", os.path.join(tmpdir_path, f"in/p{i}"))
    out = {}
    for name, buckets in (("full", None), ("kept", 2)):
        ingest.run_stream(spark, os.path.join(tmpdir_path, "in/p*"), os.path.join(tmpdir_path, name, "state"), os.path.join(tmpdir_path, name),
                          os.path.join(tmpdir_path, name, "ck"), available_now=True, max_files_per_trigger=1, clock="data",
                          windowed_buckets=buckets, keep_versions=1).awaitTermination()
        out[name] = {k: sorted(map(repr, (r.asDict() for r in spark.read.json(os.path.join(tmpdir_path, name, "batch=2", k)).collect())))
                     for k in ("leaderboards", "recents")}
    assert out["full"] == out["kept"] and out["full"]["leaderboards"]
