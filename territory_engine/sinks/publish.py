"""Publication sinks.

Partitioned files are the scalable outputs. The single nested documents the reference
uploads are built only from bounded inputs: a leaderboard has at most one row per territory
per (type, window), and the recents list is a top-100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BATCH_MAX_CLAIMS, CLAIM_COLUMNS, TERRITORY_TYPES


def write_leaderboards(board: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per (territory_type, time_window)."""
    board.write.mode("overwrite").partitionBy("territory_type", "time_window").format(fmt).save(path)


def leaderboard_document(board: DataFrame, recents: DataFrame) -> DataFrame:
    """``{type: {window: [row, ...]}, "recents": [...]}`` as one JSON string (one row).

    The inputs are bounded (one row per won territory per ranking, plus a top-k), so the
    two-level grouping below stays small.
    """
    row = F.struct("name", "territories", "ip_count", "latest", "score")
    per_window = board.groupBy("territory_type", "time_window").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank"), row.alias("r")))).alias("rows")
    ).select("territory_type", "time_window", F.transform("rows", lambda x: x["r"]).alias("rows"))
    per_type = per_window.groupBy("territory_type").agg(
        F.map_from_entries(F.collect_list(F.struct("time_window", "rows"))).alias("windows")
    )
    scores = per_type.agg(F.map_from_entries(F.collect_list(F.struct("territory_type", "windows"))).alias("scores"))
    recents_rows = recents.select(F.collect_list(F.struct(*recents.columns))).scalar()
    return scores.select(F.to_json(F.struct(
        *[F.coalesce(F.col("scores")[t], F.create_map().cast("map<string,array<struct<name:string,territories:string,"
                                                                "ip_count:bigint,latest:bigint,score:bigint>>>")).alias(t)
          for t in TERRITORY_TYPES],
        recents_rows.alias("recents"),
    )).alias("document"))


def read_leaderboard_document(documents: DataFrame) -> DataFrame:
    """S8 read back: one row per ranking row of documents in column ``document``; its rank is its place in its list."""
    rows = "array<struct<name:string,territories:string,ip_count:bigint,latest:bigint,score:bigint>>"
    schema = ", ".join(f"{t} map<string,{rows}>" for t in TERRITORY_TYPES)
    doc = documents.select(F.from_json("document", schema).alias("d"))
    kinds = doc.select(F.inline(F.array(*[F.struct(F.lit(t).alias("territory_type"), F.col(f"d.{t}").alias("windows")) for t in TERRITORY_TYPES])))
    lists = kinds.select("territory_type", F.explode("windows").alias("time_window", "rows"))
    return lists.select("territory_type", "time_window", F.posexplode("rows").alias("at", "r")).select(
        "territory_type", "time_window", "r.*", (F.col("at") + 1).cast("long").alias("rank"))


def _json_value(c: Column) -> Column:
    """JSON text of one scalar (``null`` for null), via ``to_json`` of a one-element array."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1), F.lit("null"))


def public_claim_rows(dump: DataFrame) -> DataFrame:
    """Positional rows ``[name, country, region, colo, time_ms]`` as JSON text, with ``time_ms``."""
    parts = [_json_value(F.col(c)) for c in ("name", "country", "region", "colo", "time_ms")]
    return dump.select(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("row"), "time_ms")


def write_public_claims(dump: DataFrame, path: str, query_ts_secs: int | Column) -> None:
    """Newest-first JSON lines plus the query time; range-partitioned so the files concatenate
    in order. Written only when there is something to publish."""
    if dump.isEmpty():
        return
    ts = query_ts_secs if isinstance(query_ts_secs, Column) else F.lit(int(query_ts_secs))
    (
        dump.withColumn("query_timestamp", ts.cast("long"))
        .repartitionByRange(F.desc("time_ms"))
        .sortWithinPartitions(F.desc("time_ms"))
        .write.mode("overwrite").json(path)
    )


def score_lists(counts: DataFrame) -> DataFrame:
    """Per (type, window, name) the list of ``[territory, count, latest]``.

    A name's list has at most one entry per territory, so it is bounded by the territory count.
    """
    entry = F.struct(F.col("territory"), F.col("count"), F.col("latest"))
    return counts.groupBy("territory_type", "time_window", "name").agg(
        F.array_sort(F.collect_list(entry)).alias("scores")
    )


def claim_envelopes(claims: DataFrame, max_claims: int = BATCH_MAX_CLAIMS, worker_id: str | Column = "spark") -> DataFrame:
    """Accepted claims packed into ``{batch, workerTimestamp, workerId}`` objects of at most
    ``max_claims`` claims, one JSON string per object.

    Claims are numbered inside their partition (``monotonically_increasing_id`` counts up
    within a partition), so packing needs no global order and each group holds at most
    ``max_claims`` rows.
    """
    wid = worker_id if isinstance(worker_id, Column) else F.lit(worker_id)
    mid = F.monotonically_increasing_id()
    numbered = claims.select(*CLAIM_COLUMNS, F.spark_partition_id().alias("_p"), mid.alias("_id"))
    offset = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    packed = numbered.groupBy("_p", F.floor(offset / max_claims).alias("_n")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_id"), F.struct(*CLAIM_COLUMNS).alias("c")))).alias("items"),
        F.min("time_ms").alias("_t"),
    )
    return packed.select(
        F.to_json(F.struct(
            F.transform("items", lambda x: x["c"]).alias("batch"),
            F.col("_t").alias("workerTimestamp"),
            wid.alias("workerId"),
        )).alias("value")
    )


def object_envelopes(rows: DataFrame, worker_id: str = "spark") -> DataFrame:
    """Rows of ``streaming.stateful.batched_claims`` as one JSON envelope an object (of bounded size)."""
    packed = rows.groupBy("shard", "object").agg(
        F.sort_array(F.collect_list(F.struct("position", F.struct(*CLAIM_COLUMNS).alias("c")))).alias("items"), F.min("time_ms").alias("_t"))
    return packed.select(F.to_json(F.struct(
        F.transform("items", lambda x: x["c"]).alias("batch"),
        F.col("_t").alias("workerTimestamp"),
        F.concat(F.lit(f"{worker_id}-"), F.col("shard")).alias("workerId"),
    )).alias("value"))


def geojson_features(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature per row; ``geometry`` is an array of parts, each an outer ring and its
    holes (``array<array<array<struct<lon,lat>>>>``). One part is a Polygon, any other number a
    MultiPolygon, a null geometry stays null."""
    coords = F.transform(F.col(geometry), lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.array(p["lon"], p["lat"]))))

    def feature(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*[F.col(c) for c in properties]).alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        ))

    none = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[F.col(c) for c in properties]).alias("properties")))
    return df.select(F.when(F.col(geometry).isNull(), none)
                     .when(F.size(geometry) == 1, feature("Polygon", F.get(coords, F.lit(0))))
                     .otherwise(feature("MultiPolygon", coords)).alias("feature"))


def write_score_lists(counts: DataFrame, path: str, now_ms: Column | int) -> None:
    """Score lists as JSON files in one folder per (type, window), each row with ``now``."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(int(now_ms))
    (score_lists(counts).withColumn("now", now.cast("long"))
     .write.mode("overwrite").partitionBy("territory_type", "time_window").json(path))


def write_text(df: DataFrame, col: str, path: str) -> None:
    df.select(col).write.mode("overwrite").text(path)
