"""Plan-shape checks: the scale properties the README claims, asserted on physical plans."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from territory_engine.functions.clock import as_of_latest
from territory_engine.operators import admission as A
from territory_engine.operators import claims as C
from territory_engine.operators import rankings as R
from territory_engine.operators import views as V
from territory_engine.sources import testdata as TD


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_reads_state_and_batch_once(spark, tmpdir_path):
    claims = TD.load_claims(spark, SF_SMALL)
    paths = [f"{tmpdir_path}/{n}" for n in ("state", "batch")]
    C.fold_claims(claims).write.parquet(paths[0])
    claims.where(F.col("seq") % 3 == 2).write.parquet(paths[1])
    state, batch = [spark.read.parquet(x) for x in paths]
    p = plan(C.apply_claims(state, batch))
    assert p.count("FileScan") == 2  # one pass: neither side is scanned or computed a second time
    assert p.count("Exchange hashpartitioning") <= 2 and "SinglePartition" not in p


def test_small_keys_filter_the_state_map_side(spark, tmpdir_path):
    """What the poll job does for a delta: the measured key set is broadcast by Spark itself."""
    from territory_engine.plans.broadcast import measured
    claims = TD.load_claims(spark, SF_SMALL)
    C.fold_claims(claims).write.parquet(f"{tmpdir_path}/state")
    keys = measured(claims.where(F.col("seq") % 3 == 2).select("ip").distinct())
    p = plan(spark.read.parquet(f"{tmpdir_path}/state").join(keys, "ip", "left_semi"))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_hot_path_has_no_window_over_an_addresss_claims(spark):
    """Windows of the hot path are keyed by (address, bucket) or hold bucket rows only."""
    import inspect

    from territory_engine.operators import hotkeys
    source = inspect.getsource(hotkeys.hot_fold)
    assert 'asof_next(bucket_first, buckets, ["ip"]' in source and 'asof_next(ns_data, name_buckets, ["ip", "name"]' in source


def test_limiters_use_group_limits(spark):
    raw = TD.raw_claims_from_events(TD.read_table(spark, SF_SMALL, "events"))
    p = plan(A.admit(raw))
    assert "WindowGroupLimit" in p


def test_as_of_subquery_planned_once(spark):
    claims = TD.load_claims(spark, SF_SMALL)
    state = C.fold_small(claims)
    as_of = as_of_latest(claims)
    for df in (R.leaderboards(state, as_of), V.contenders(state, "weekly", as_of, spread=False)):
        df.write.format("noop").mode("overwrite").save()
        assert len(set(re.findall(r"Subquery subquery#(\d+)", plan(df)))) <= 2


def test_one_territory_page_filters_in_the_scan(spark, tmpdir_path):
    """The id filter reaches the scan, below the first exchange, and building the plan runs no job."""
    C.fold_claims(TD.load_claims(spark, SF_SMALL)).write.parquet(f"{tmpdir_path}/state")
    state = spark.read.parquet(f"{tmpdir_path}/state")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("page", "page")
    page = V.territory_view(state, "C05", "weekly", 1_800_000_000_000)
    user = V.user_view(state, "click-3", "weekly", 1_800_000_000_000)
    assert not tracker.getJobIdsForGroup("page")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert "EqualTo(colo,C05)" in plan(page) and "EqualTo(name,click-3)" in plan(user)
    everything = V.contenders(state, "weekly", 1_800_000_000_000, spread=False)
    want = everything.where("territory = 'C05' and territory_type = 'colo'").collect()
    assert sorted(map(str, page.collect())) == sorted(map(str, want))
    assert V.territory_view(state, "nowhere", "weekly", 1).count() == 0
    assert sorted(map(str, user.collect())) == sorted(map(str, V.user_ranks(everything).where("name = 'click-3'").collect()))


def test_ranks_of_few_rows_are_counted_not_sorted(spark, tmpdir_path):
    """One name's ranks and one page of a territory equal the ranks of the whole table; no window over a territory."""
    C.fold_claims(TD.load_claims(spark, SF_SMALL)).write.parquet(f"{tmpdir_path}/state")
    state = spark.read.parquet(f"{tmpdir_path}/state")
    as_of = 1_800_000_000_000
    everything = V.contenders(state, "all-time", as_of, spread=False).where("territory = 'C05' and territory_type = 'colo'")
    want = sorted(everything.collect(), key=lambda r: r["rank"])
    assert "Window" not in plan(V.user_view(state, "click-3", "all-time", as_of))
    names = [r["name"] for r in want]
    assert len(names) > 4
    for after, size in [(None, 3), (names[0], 2), (names[2], 1000), (names[-1], 5), ("nobody", 5), (None, 1000)]:
        page = V.territory_slice(state, "C05", "all-time", as_of, size, after)
        start = 0 if after is None else names.index(after) + 1 if after in names else len(names)
        assert list(map(str, page.collect())) == list(map(str, want[start:start + size])), after
        assert "TakeOrderedAndProject" in plan(page)
    assert V.territory_slice(state, "nowhere", "all-time", as_of, 5).count() == 0
