"""The older incremental scorer (Q11): refresh a snapshot with rows newer than its watermark,
then count per (name, territory) for every type and window.

Its source counted every claim as its own entry (map keys were fresh arrays, compared by
identity); this builds the evident intent, one aggregate per (name, territory), and keeps
null territories, which that scorer did not drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.publish import score_lists
from .claims import newest_wins_merge
from .rankings import window_counts


def newer_than(rows: DataFrame, latest: Column, col: str = "time_ms") -> DataFrame:
    """Rows strictly newer than the snapshot's watermark (no watermark: all rows)."""
    return rows.where(latest.isNull() | (F.col(col) > latest))


def refresh_snapshot(snapshot: DataFrame, source: DataFrame, key: str = "ip") -> DataFrame:
    """P11 + J6 + U3 — new rows, then the snapshot rows whose key they do not replace."""
    latest = snapshot.select(F.max("time_ms")).scalar()
    return newest_wins_merge(snapshot, newer_than(source, latest), key)


def newest_first(snapshot: DataFrame) -> DataFrame:
    """The snapshot ordered newest first (range-partitioned sort)."""
    return snapshot.orderBy(F.desc("time_ms"))


def incremental_counts(snapshot: DataFrame, as_of_ms: Column | int) -> DataFrame:
    """(territory_type, time_window, territory, name, count, latest), null territories kept."""
    return window_counts(snapshot, as_of_ms, inclusive=False, keep_null_territory=True)


def incremental_scores(snapshot: DataFrame, source: DataFrame, as_of_ms: Column | int) -> DataFrame:
    """Q11: refreshed snapshot -> per (type, window, name) the list of [territory, count, latest]."""
    merged = refresh_snapshot(snapshot, source)
    return score_lists(incremental_counts(merged, as_of_ms))
