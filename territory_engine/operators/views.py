"""Drill-down views (Q6 territory page, Q7 user page) over the claims state.

Both pages count claims per (territory, name) inside an *inclusive* window (P8), rank every
contender of a territory (W2) and show the latest claim as a relative age (F4, F5). The
contender table for all territories is the materialised form; a single page is a filter on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TERRITORY_TYPES
from ..functions.clock import relative_age
from ..functions.labels import territory_type_of_text
from ..plans.broadcast import measured
from .rankings import rank_contenders, window_counts


def contenders(state: DataFrame, window: str, as_of_ms: Column | int, spread: bool = True) -> DataFrame:
    """A4 + W2 for every territory of every type, one window: the materialised contender table.

    (territory_type, territory, name, count, latest, rank, latest_unit, latest_value)
    The counts combine map-side; ranks are numbered across tasks (``spread``), so a territory
    with a very large number of contenders is not sorted in one task. For the page of one
    territory or one name use ``territory_view`` and ``user_view``, which read only its part.
    """
    return _ranked(window_counts(state, as_of_ms, inclusive=True, windows=[window]), as_of_ms, spread)


def _ranked(counts: DataFrame, as_of_ms: Column | int, spread: bool) -> DataFrame:
    return _aged(rank_contenders(counts.drop("time_window"), ["territory_type"], spread=spread), as_of_ms)


def _aged(ranked: DataFrame, as_of_ms: Column | int) -> DataFrame:
    # the as-of time is projected once, so a scalar subquery is planned (and run) once
    ranked = ranked.withColumn("_now", as_of_ms if isinstance(as_of_ms, Column) else F.lit(int(as_of_ms)))
    unit, value = relative_age("latest", F.col("_now"))
    return ranked.select(
        "territory_type", "territory", "name", "count", "latest", "rank",
        unit.alias("latest_unit"), value.alias("latest_value"),
    )


def territory_view(state: DataFrame, territory_id: str, window: str, as_of_ms: Column | int) -> DataFrame:
    """Q6: the contenders of one territory; its type comes from the id's length.

    The id is compared with one column of the state, so the filter reaches the scan, and no job runs
    while the plan is built. An unknown territory gives an empty result (P19).
    """
    kind = territory_type_of_text(territory_id)
    own = state.where(F.col(kind) == F.lit(territory_id)).withColumns(
        {t: F.lit(None).cast("string") for t in TERRITORY_TYPES if t != kind})
    return _ranked(window_counts(own, as_of_ms, inclusive=True, windows=[window]), as_of_ms, spread=False).orderBy(
        F.desc("count"), F.desc("latest"), F.asc("name"))


def territory_totals(contender_table: DataFrame) -> DataFrame:
    """Total claims (IPs) per territory."""
    return contender_table.groupBy("territory_type", "territory").agg(F.sum("count").cast("long").alias("total_ips"))


def user_ranks(contender_table: DataFrame) -> DataFrame:
    """Q7 for every name: one row per territory the name contends in (rank, ips, latest age)."""
    return contender_table.select(
        "name", "territory_type", "territory", "rank", F.col("count").alias("ips"),
        "latest_unit", "latest_value",
    )


def user_view(state: DataFrame, name: str | Column, window: str, as_of_ms: Column | int) -> DataFrame:
    """Q7: one name's ranks, worst rank first, then more IPs, then territory.

    The name's own counts (its filter reaches the scan) are one threshold a territory; its rank there is
    one more than the number of contenders that precede the threshold (W2), counted map-side: no
    territory's contenders are sorted, however many they are.
    """
    n = F.lit(name) if isinstance(name, str) else name
    mine = window_counts(state.where(F.col("name") == n), as_of_ms, inclusive=True, windows=[window])
    counts = window_counts(state, as_of_ms, inclusive=True, windows=[window])
    ranked = _thresholds(counts, mine).groupBy("territory_type", "territory", "mark").agg(
        (F.count_if(_precedes("mark")) + 1).alias("rank")).select("territory_type", "territory", "mark.*", "rank")
    return user_ranks(_aged(ranked, as_of_ms)).orderBy(F.desc("rank"), F.desc("ips"), F.asc("territory"))


def _thresholds(counts: DataFrame, marks: DataFrame) -> DataFrame:
    """``counts`` of the territories that ``marks`` has a contender of, with that contender as struct ``mark``."""
    return counts.join(marks.select("territory_type", "territory", F.struct("count", "latest", "name").alias("mark")), ["territory_type", "territory"])


def _precedes(mark: str) -> Column:
    """Whether a contender comes before the marked one: count desc, latest desc, name."""
    def order(prefix: str = "") -> Column:
        return F.struct((-F.col(f"{prefix}count")).alias("c"), (-F.col(f"{prefix}latest")).alias("l"), F.col(f"{prefix}name").alias("n"))
    return order() < order(f"{mark}.")


def territory_slice(state: DataFrame, territory_id: str, window: str, as_of_ms: Column | int, size: int,
                    after: str | Column | None = None) -> DataFrame:
    """Q6 page by page: the next ``size`` contenders of a territory after the name ``after`` (from the top if None).

    Columns and ranks are those of ``territory_view``. The rows of the page come from a top-k, their
    ranks from the number of contenders up to ``after``, so the territory is never sorted as a whole. A name that
    does not contend there gives an empty page, as does an unknown territory (P19).
    """
    kind = territory_type_of_text(territory_id)
    own = state.where(F.col(kind) == F.lit(territory_id)).withColumns(
        {t: F.lit(None).cast("string") for t in TERRITORY_TYPES if t != kind})
    counts = window_counts(own, as_of_ms, inclusive=True, windows=[window]).drop("time_window")
    best = [F.desc("count"), F.desc("latest"), F.asc("name")]
    keys = ["territory_type", "territory"]
    if after is None:
        rest, ahead = counts.withColumn("ahead", F.lit(0)), None
    else:
        n = F.lit(after) if isinstance(after, str) else after
        mark = window_counts(own.where(F.col("name") == n), as_of_ms, inclusive=True, windows=[window])
        marked = _thresholds(counts, mark)
        later = ~_precedes("mark") & (F.col("name") != F.col("mark.name"))
        ahead = marked.groupBy(*keys).agg(F.count_if(~later).alias("ahead"))
        rest = marked.where(later).drop("mark")
    page = rest.orderBy(*best).limit(size)
    page = page.join(ahead, keys) if ahead is not None else page
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))  # over one page
    ranked = page.withColumn("rank", (F.col("ahead") + local).cast("long")).drop("ahead")
    return _aged(ranked, as_of_ms).orderBy("rank")


def user_total_ips(contender_table: DataFrame) -> DataFrame:
    """A5: a name's total IPs = sum over its facility ranks (claims with null colo not counted)."""
    return (
        contender_table.where(F.col("territory_type") == "colo")
        .groupBy("name")
        .agg(F.sum("count").cast("long").alias("total_ips"))
    )


def territory_view_with_total(contender_table: DataFrame) -> DataFrame:
    """Q6 for all territories at once: contenders plus the territory's total.

    The totals have one row per territory, so Spark joins them by broadcast if they are small.
    """
    totals = measured(territory_totals(contender_table))
    return contender_table.join(totals, ["territory_type", "territory"])
