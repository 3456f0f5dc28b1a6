"""Claims state: the cooldown upsert fold (J8), newest-wins merge (J6) and the last-run cut.

The upsert rule, per address, claims applied in time order: the first claim inserts; a later
claim replaces the stored row iff (different name and strictly newer) or (same name and
``time - cooldown > stored time``). A rejected claim changes nothing, so the cooldown runs
from the last *accepted* claim. This is not last-write-wins and it is not mergeable, so the
fold keeps each address's claims in order and runs a native ``aggregate`` over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLAIM_COLUMNS, COOLDOWN_MS
from ..plans.broadcast import measured

PAYLOAD = [c for c in CLAIM_COLUMNS if c not in ("ip", "time_ms")]


def _element(order: Sequence[str]) -> Column:
    """Fold element: the order key first (so ``array_sort`` sorts by it), then the claim."""
    fields = [F.col("time_ms").alias("time_ms")]
    fields += [F.col(c).alias(f"_o{i}") for i, c in enumerate(order) if c != "time_ms"]
    fields += [F.col(c).alias(c) for c in PAYLOAD]
    return F.struct(*fields)


def _seed(claims: DataFrame, order: Sequence[str]) -> Column:
    """A stored row in the element layout (its order fields other than time are null)."""
    types = {f.name: f.dataType for f in claims.schema.fields}
    fields = [F.col("time_ms").alias("time_ms")]
    fields += [F.lit(None).cast(types[c]).alias(f"_o{i}") for i, c in enumerate(order) if c != "time_ms"]
    fields += [F.col(c).alias(c) for c in PAYLOAD]
    return F.struct(*fields)


def accepts(acc: Column, x: Column, cooldown_ms: int = COOLDOWN_MS) -> Column:
    """The upsert predicate: does claim ``x`` replace the stored row ``acc``?"""
    different = (x["name"] != acc["name"]) & (x["time_ms"] > acc["time_ms"])
    same = (x["name"] == acc["name"]) & ((x["time_ms"] - F.lit(cooldown_ms)) > acc["time_ms"])
    return F.coalesce(different | same, F.lit(False))


def valid_claims(claims: DataFrame) -> DataFrame:
    """Rows the state table can hold: ``ip``, ``name`` and ``time_ms`` are required."""
    return claims.where(F.col("ip").isNotNull() & F.col("name").isNotNull() & F.col("time_ms").isNotNull())


def unusable_claims(claims: DataFrame) -> DataFrame:
    """S3: the rows ``valid_claims`` leaves out."""
    return claims.where(F.col("ip").isNull() | F.col("name").isNull() | F.col("time_ms").isNull())


DEFAULT_HOT_THRESHOLD = 200_000


def fold_claims(
    claims: DataFrame,
    state: DataFrame | None = None,
    cooldown_ms: int = COOLDOWN_MS,
    order: Sequence[str] = ("time_ms", "seq"),
    hot_threshold: int | None = DEFAULT_HOT_THRESHOLD,
) -> DataFrame:
    """Fold new claims per address into one row each (see ``fold_small``), skew-aware.

    Addresses with more than ``hot_threshold`` claims are folded by ``hotkeys.hot_fold``,
    which never gathers an address's history; every other address's list is bounded by the
    threshold. The per-address counts combine map-side; the hot set (at most rows / threshold
    addresses) is measured, so Spark broadcasts it only below its own threshold.
    """
    if hot_threshold is None:
        return fold_small(claims, state, cooldown_ms, order)
    claims = valid_claims(claims)
    counts = claims.groupBy("ip").count()
    hot_keys = measured(counts.where(F.col("count") > hot_threshold).select("ip"))
    if hot_keys.isEmpty():
        hot_keys.unpersist()
        return fold_small(claims, state, cooldown_ms, order)
    from .hotkeys import hot_fold, in_slots

    others = in_slots(claims, counts.where(F.col("count") <= hot_threshold))
    normal = fold_small(others.join(hot_keys, "ip", "left_anti"),
                        None if state is None else state.join(hot_keys, "ip", "left_anti"), cooldown_ms, order)
    hot_order = tuple(order)
    if len(order) > 2:  # several tie columns: one struct column orders the same way
        claims = claims.withColumn("_tie", F.struct(*[F.col(c) for c in order[1:]]))
        hot_order = (order[0], "_tie")
    heavy = hot_fold(claims, None if state is None else state.join(hot_keys, "ip", "left_semi"),
                     cooldown_ms, hot_order, addresses=hot_keys)
    return normal.unionByName(heavy)


def fold_small(
    claims: DataFrame,
    state: DataFrame | None = None,
    cooldown_ms: int = COOLDOWN_MS,
    order: Sequence[str] = ("time_ms", "seq"),
) -> DataFrame:
    """Fold new claims per address into one row each, seeded by the stored row when given.

    ``order`` fixes the order of claims with equal times (earlier wins, since the test is
    strict). The stored row is the fold's initial value and never sorted in with the new
    claims: a late claim cannot push it out. Returns CLAIM rows for the addresses in
    ``claims`` only; ``apply_claims`` merges them into the full state.

    Plan: one hash shuffle on ``ip``; the fold itself is a native higher-order ``aggregate``.
    """
    claims = valid_claims(claims)
    grouped = claims.groupBy("ip").agg(F.array_sort(F.collect_list(_element(order))).alias("_rows"))
    seed = _seed(claims, order).alias("_seed")
    if state is None:
        grouped = grouped.withColumn("_seed", F.lit(None).cast(claims.select(seed).schema["_seed"].dataType))
    else:
        grouped = grouped.join(state.select("ip", seed), "ip", "left")
    return _folded(grouped, cooldown_ms)


def apply_claims(
    state: DataFrame | None,
    batch: DataFrame,
    cooldown_ms: int = COOLDOWN_MS,
    order: Sequence[str] = ("time_ms", "seq"),
    hot_threshold: int | None = DEFAULT_HOT_THRESHOLD,
) -> DataFrame:
    """Upsert a batch into the state table and return the whole new state.

    One pass: the batch's claims, grouped by address, meet the state in a full outer join;
    addresses without new claims keep their row. State and batch are each read once, so upserts can
    follow each other in one plan. Addresses with more than ``hot_threshold`` claims in the batch
    take the hot path.
    """
    if state is None:
        return fold_claims(batch, None, cooldown_ms, order, hot_threshold)
    batch = valid_claims(batch)
    hot = None if hot_threshold is None else batch.groupBy("ip").count().where(F.col("count") > hot_threshold).select("ip")
    if hot is None or hot.isEmpty():
        return _upsert(state, batch, cooldown_ms, order)
    keys = measured(hot)
    heavy = fold_claims(batch.join(keys, "ip", "left_semi"), state.join(keys, "ip", "left_semi"), cooldown_ms, order, hot_threshold)
    rest = _upsert(state.join(keys, "ip", "left_anti"), batch.join(keys, "ip", "left_anti"), cooldown_ms, order)
    return rest.unionByName(heavy)


def _upsert(state: DataFrame, batch: DataFrame, cooldown_ms: int, order: Sequence[str]) -> DataFrame:
    grouped = batch.groupBy("ip").agg(F.array_sort(F.collect_list(_element(order))).alias("_rows"))
    return _folded(state.select("ip", _seed(batch, order).alias("_seed")).join(grouped, "ip", "full_outer"), cooldown_ms)


def _folded(grouped: DataFrame, cooldown_ms: int) -> DataFrame:
    """CLAIM rows from (ip, _seed, _rows): the ordered claims applied to the stored row, if any."""
    rows = F.coalesce(F.col("_rows"), F.array().cast(grouped.schema["_rows"].dataType))
    init = F.coalesce(F.col("_seed"), F.get(rows, F.lit(0)))
    rest = F.when(F.col("_seed").isNull(), F.slice(rows, 2, F.size(rows))).otherwise(rows)
    folded = F.aggregate(rest, init, lambda acc, x: F.when(accepts(acc, x, cooldown_ms), x).otherwise(acc))
    return grouped.select("ip", folded.alias("_s")).select(
        "ip", *[F.col(f"_s.{c}").alias(c) for c in PAYLOAD], F.col("_s.time_ms").alias("time_ms")
    ).select(*CLAIM_COLUMNS)


def newest_wins_merge(old: DataFrame, new: DataFrame, key: str = "ip") -> DataFrame:
    """Every new row, then the old rows whose key is not among the new ones."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def last_run(claims: DataFrame, order: Sequence[str] = ("time_ms", "seq")) -> DataFrame:
    """Per address, the claims of its last same-name run (after the last name change).

    Built from aggregates that combine map-side (latest claim per address, then the latest
    claim with a different name), joined back on ``ip`` — no per-address window or list.
    """
    key = F.struct(*[F.col(c) for c in order])
    last = claims.groupBy("ip").agg(F.max_by("name", key).alias("_last_name"))
    tagged = claims.join(last, "ip")
    boundary = tagged.where(F.col("name") != F.col("_last_name")).groupBy("ip").agg(F.max(key).alias("_cut"))
    return (
        tagged.join(boundary, "ip", "left")
        .where(F.col("_cut").isNull() | (key > F.col("_cut")))
        .drop("_last_name", "_cut")
    )
