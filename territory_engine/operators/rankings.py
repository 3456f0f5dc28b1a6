"""Territory-control rankings over the claims state (Q3, Q4, Q5).

For one territory type and time window: count claims and latest time per (territory, name)
(A1), keep one winner per territory — most claims, then latest, then name (W1), and sum each
name's won territories into a leaderboard row (A2), ordered by score, ip_count, latest (O1).
``leaderboards`` computes all 3 types x 5 windows in one pass over the state (A3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RECENTS_LIMIT, RECENTS_WINDOW_MS, TERRITORY_TYPES, TIME_WINDOWS
from ..functions.addresses import mask_ip
from ..functions.clock import _c, in_window



def leaderboard_order() -> list[Column]:
    return [F.desc("score"), F.desc("ip_count"), F.desc("latest"), F.asc("name")]


def territory_counts(state: DataFrame, territory_type: str, window: str, as_of_ms: Column | int,
                     inclusive: bool = False) -> DataFrame:
    """A1 / A4: (territory, name, count, latest) over claims in the window, null territories dropped.

    ``inclusive=False`` is the published ranking's strict cut (P7); ``True`` the drill-down's (P8).
    """
    return (
        state.where(F.col(territory_type).isNotNull() & in_window("time_ms", as_of_ms, window, inclusive))
        .groupBy(F.col(territory_type).alias("territory"), "name")
        .agg(F.count(F.lit(1)).alias("count"), F.max("time_ms").alias("latest"))
    )


def rank_contenders(counts: DataFrame, partition: list[str] | None = None, spread: bool = False) -> DataFrame:
    """Position of every contender within its territory (count desc, latest desc, name).

    ``spread=True`` numbers large territories across many tasks (``plans.ranking``) instead of
    sorting each territory's contenders in one task.
    """
    keys = (partition or []) + ["territory"]
    order = [F.desc("count"), F.desc("latest"), F.asc("name")]
    if spread:
        from ..plans.ranking import row_number_spread
        return row_number_spread(counts, keys, order)
    w = Window.partitionBy(*keys).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))


def winners_by_rank(counts: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """W1 as written in the reference: ``row_number() = 1`` (Spark plans it with a group limit)."""
    return rank_contenders(counts, partition).where(F.col("rank") == 1).drop("rank")


def winners_by_min(counts: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """W1 as one aggregate: ``min(struct(-count, -latest, name))`` per territory.

    Same winner as the ranking form, but it combines map-side, so a territory with a huge
    number of contenders never lands whole in one task.
    """
    keys = (partition or []) + ["territory"]
    best = F.min(F.struct((-F.col("count")).alias("nc"), (-F.col("latest")).alias("nl"), F.col("name").alias("name")))
    return counts.groupBy(*keys).agg(best.alias("_b")).select(
        *keys,
        F.col("_b.name").alias("name"),
        (-F.col("_b.nc")).alias("count"),
        (-F.col("_b.nl")).alias("latest"),
    )


def holdings(winners: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """A2: per name — sorted comma list of won territories, ip_count, latest, score."""
    keys = (partition or []) + ["name"]
    return winners.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("territory")), ",").alias("territories"),
        F.sum("count").cast("long").alias("ip_count"),
        F.max("latest").cast("long").alias("latest"),
        F.count(F.lit(1)).alias("score"),
    )


def with_leaderboard_rank(board: DataFrame, partition: list[str]) -> DataFrame:
    """Position on the leaderboard (score, ip_count, latest desc; name breaks ties)."""
    w = Window.partitionBy(*partition).orderBy(*leaderboard_order())
    return board.withColumn("rank", F.row_number().over(w).cast("long"))


def leaderboard(state: DataFrame, territory_type: str, window: str, as_of_ms: Column | int) -> DataFrame:
    """Q3 for one (territory type, window), in the reference's own shape (rank = 1 filter)."""
    counts = territory_counts(state, territory_type, window, as_of_ms)
    board = holdings(winners_by_rank(counts))
    board = board.select(
        F.lit(territory_type).alias("territory_type"), F.lit(window).alias("time_window"), "*"
    )
    return with_leaderboard_rank(board, ["territory_type", "time_window"])


def leaderboards_separate(state: DataFrame, as_of_ms: Column | int) -> DataFrame:
    """All fifteen rankings as fifteen separate plans (the reference's shape), unioned."""
    out = None
    for t in TERRITORY_TYPES:
        for label, _ in TIME_WINDOWS:
            one = leaderboard(state, t, label, as_of_ms)
            out = one if out is None else out.unionByName(one)
    return out


def window_counts(state: DataFrame, as_of_ms: Column | int, inclusive: bool = False,
                  keep_null_territory: bool = False, windows: Sequence[str] | None = None) -> DataFrame:
    """A3 core: one scan -> (territory_type, time_window, territory, name, count, latest).

    Territory columns are unpivoted with ``inline``; each window is a conditional count and
    max in the same aggregate (it combines map-side), then windows are unpivoted and zero
    counts dropped. ``keep_null_territory`` keeps null territories (the older scorer, A8);
    ``windows`` computes some windows only. A filter on the territory columns of ``state`` reaches
    its scan.
    """
    labels = [label for label, _ in TIME_WINDOWS if windows is None or label in windows]
    unpivot = F.inline(F.array(*[
        F.struct(F.lit(t).alias("territory_type"), F.col(t).alias("territory")) for t in TERRITORY_TYPES
    ]))
    # the as-of time is projected once, so a scalar subquery is planned (and run) once
    rows = state.select("name", "time_ms", unpivot, _c(as_of_ms).alias("_now"))
    if not keep_null_territory:
        rows = rows.where(F.col("territory").isNotNull())
    aggs = []
    for i, label in enumerate(labels):
        hit = in_window("time_ms", F.col("_now"), label, inclusive)
        aggs.append(F.count_if(hit).alias(f"c{i}"))
        aggs.append(F.max(F.when(hit, F.col("time_ms"))).alias(f"l{i}"))
    per_key = rows.groupBy("territory_type", "territory", "name").agg(*aggs)
    unpivoted = F.inline(F.array(*[
        F.struct(F.lit(label).alias("time_window"), F.col(f"c{i}").alias("count"), F.col(f"l{i}").alias("latest"))
        for i, label in enumerate(labels)
    ]))
    return per_key.select("territory_type", "territory", "name", unpivoted).where(F.col("count") > 0)


def leaderboards(state: DataFrame, as_of_ms: Column | int) -> DataFrame:
    """A3: all 3 territory types x 5 windows in one pass, in the LEADERBOARD schema."""
    part = ["territory_type", "time_window"]
    counts = window_counts(state, as_of_ms)
    board = holdings(winners_by_min(counts, part), part)
    return with_leaderboard_rank(board, part).select(
        "territory_type", "time_window", "name", "territories", "ip_count", "latest", "score", "rank"
    )


def top_rows(board: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of each leaderboard by its rank."""
    return board.where(F.col("rank") <= n)


def recents(state: DataFrame, as_of_ms: Column | int, n: int = RECENTS_LIMIT) -> DataFrame:
    """Q4: claims of the last 24 h (strict), newest first, top ``n``, IPv4 masked (P10, O2, F1).

    ``orderBy().limit()`` plans as a top-k (TakeOrderedAndProject): each task keeps ``n`` rows.
    """
    cut = _c(as_of_ms) - F.lit(RECENTS_WINDOW_MS)
    return (
        state.where(F.col("time_ms") > cut)
        .orderBy(F.desc("time_ms"), F.asc("ip"))
        .limit(n)
        .select("name", "country", "region", "colo", "time_ms", mask_ip("ip").alias("ip"))
    )


def public_claims(state: DataFrame) -> DataFrame:
    """Q5: every stored claim, newest first (O3), in the public dump's columns."""
    return state.select("name", "country", "region", "colo", "time_ms").orderBy(F.desc("time_ms"))
