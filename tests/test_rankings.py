"""Rankings: windows, ties, null territories, and one pass = fifteen separate rankings."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from territory_engine.functions.clock import as_of_latest
from territory_engine.operators import claims as C
from territory_engine.operators import rankings as R
from territory_engine.operators import views as V
from territory_engine.sources import testdata as TD

STATE = "ip string, name string, asn bigint, colo string, country string, region string, metro string, city string, time_ms bigint"
NOW = 1_000_000_000_000


def state_df(spark, rows):
    return spark.createDataFrame([(ip, n, 1, colo, "AX", None, None, None, t) for ip, n, colo, t in rows], STATE)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_strict_window_edges(spark):
    cut = NOW - 3_600_000
    st = state_df(spark, [("a", "x", "LAX", cut - 1), ("b", "y", "LAX", cut), ("c", "z", "SFO", cut + 1)])
    board = R.leaderboard(st, "colo", "hourly", NOW)
    assert rows_of(board, "name", "territories") == [("z", "SFO")]
    contenders = V.contenders(st, "hourly", NOW).where(F.col("territory_type") == "colo")
    assert rows_of(contenders, "name", "territory") == [("y", "LAX"), ("z", "SFO")]


def test_ties_and_zero_winners(spark):
    st = state_df(spark, [
        ("a", "p", "LAX", NOW - 10), ("b", "q", "LAX", NOW - 10),    # equal count and latest: name breaks tie
        ("c", "r", "SFO", NOW - 5), ("d", "s", "SFO", NOW - 1),      # equal count: later latest wins
        ("e", "t", None, NOW - 1),                                  # null territory dropped
    ])
    board = R.leaderboard(st, "colo", "all-time", NOW)
    assert rows_of(board, "name", "territories", "ip_count", "score") == [("p", "LAX", 1, 1), ("s", "SFO", 1, 1)]
    assert rows_of(board, "rank", "name") == [(1, "s"), (2, "p")]


def test_one_pass_equals_fifteen(spark):
    claims = TD.load_claims(spark, SF_SMALL)
    state = C.fold_claims(claims)
    as_of = as_of_latest(claims)
    a = R.leaderboards(state, as_of)
    b = R.leaderboards_separate(state, as_of)
    cols = ["territory_type", "time_window", "name", "territories", "ip_count", "latest", "score", "rank"]
    assert rows_of(a, *cols) == rows_of(b, *cols)
    assert a.count() > 0


def test_min_winner_equals_row_number_winner(spark):
    claims = TD.load_claims(spark, SF_SMALL)
    state = C.fold_claims(claims)
    counts = R.window_counts(state, as_of_latest(claims))
    part = ["territory_type", "time_window"]
    cols = part + ["territory", "name", "count", "latest"]
    assert rows_of(R.winners_by_min(counts, part), *cols) == rows_of(R.winners_by_rank(counts, part), *cols)


def test_recents_top_k_plan(spark):
    claims = TD.load_claims(spark, SF_SMALL)
    state = C.fold_claims(claims)
    df = R.recents(state, as_of_latest(claims), 5)
    assert df.count() == 5
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_spread_rank_equals_window_rank(spark):
    import random
    rng = random.Random(5)
    rows = [("colo", "T" + str(rng.randrange(3)), f"n{i}", rng.randrange(5), rng.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "territory_type string, territory string, name string, count bigint, latest bigint")
    a = R.rank_contenders(df, ["territory_type"], spread=True)
    b = R.rank_contenders(df, ["territory_type"], spread=False)
    cols = ["territory_type", "territory", "name", "rank"]
    assert rows_of(a, *cols) == rows_of(b, *cols)
