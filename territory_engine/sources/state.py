"""Claims state table (S7, S11): versioned Parquet folders, newest wins.

* ``<base>/v=<n>``: a full snapshot written at version ``n``;
* ``<base>/_delta/v=<n>``: only the rows of the addresses version ``n`` touched.

A poll writes a delta (its size is the batch's, not the state's) and every few polls a full
snapshot; reading version ``n`` takes the newest full snapshot below it and lays the later
deltas over it, newest first, with anti-joins on the deltas' addresses (broadcast by Spark when
their files are below its threshold, so the large snapshot is then not shuffled). Versions are never overwritten by another
version's data, so a failed write leaves older versions readable and a replayed micro-batch
rewrites only its own version. Rows are hash-partitioned on ``ip`` and time-sorted inside files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLAIM_COLUMNS
from ..schema import CLAIM


def _fs(spark: SparkSession, base: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, base: str) -> list[int]:
    """Committed versions under ``base`` (folders holding a ``_SUCCESS`` marker), ascending.
    For full snapshots pass the state folder, for deltas ``<state>/_delta``."""
    fs, path = _fs(spark, base)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def read_state(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The state as of the newest committed version (below ``before`` when given).

    The newest full snapshot below ``before`` plus every later delta below ``before``; empty
    CLAIM rows if there is nothing yet.
    """
    from ..operators.claims import newest_wins_merge

    fulls = [v for v in versions(spark, base) if before is None or v < before]
    start = fulls[-1] if fulls else None
    deltas = [v for v in versions(spark, f"{base}/_delta")
              if (before is None or v < before) and (start is None or v > start)]
    state = spark.read.schema(CLAIM).parquet(f"{base}/v={start}") if start is not None else spark.createDataFrame([], CLAIM)
    for v in deltas:
        state = newest_wins_merge(state, spark.read.schema(CLAIM).parquet(f"{base}/_delta/v={v}"))
    return state


def write_delta(touched: DataFrame, base: str, version: int, partitions: int | None = None) -> str:
    """Write the rows of the addresses one version touched."""
    return write_state(touched, f"{base}/_delta", version, partitions)


def write_state(state: DataFrame, base: str, version: int, partitions: int | None = None) -> str:
    """Write one version, hash-partitioned on ``ip`` and time-sorted inside each file."""
    out = f"{base}/v={version}"
    df = state.select(*CLAIM_COLUMNS)
    df = df.repartition(partitions, "ip") if partitions else df.repartition("ip")
    df.sortWithinPartitions("time_ms").write.mode("overwrite").parquet(out)
    return out


def expire_versions(spark: SparkSession, base: str, keep: int) -> list[int]:
    """S7 retention: remove full snapshots older than the newest ``keep`` and the deltas below the
    oldest snapshot that stays (they lie under it already). Returns the versions removed.

    The snapshot a reader starts from and every delta over it always stay.
    """
    if keep < 1:
        raise ValueError("at least one snapshot must stay")
    fulls = versions(spark, base)
    if len(fulls) <= keep:
        return []
    oldest = fulls[-keep]
    fs, _ = _fs(spark, base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    removed = []
    for v in [x for x in fulls if x < oldest]:
        fs.delete(path(f"{base}/v={v}"), True)
        removed.append(v)
    for v in [x for x in versions(spark, f"{base}/_delta") if x < oldest]:
        fs.delete(path(f"{base}/_delta/v={v}"), True)
        removed.append(v)
    return sorted(removed)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder."""
    fs, folder = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(folder)) if fs.exists(folder) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it."""
    fs, folder = _fs(spark, path)
    fs.delete(folder, True)


def latest_claim(state: DataFrame) -> DataFrame:
    """The watermark of a snapshot, one row ``latest_claim``."""
    return state.agg(F.max("time_ms").alias("latest_claim"))


def legacy_to_claims(rows: DataFrame) -> DataFrame:
    """Rows of the retired schema (``timestamp`` in seconds, a real number) as claim rows."""
    return rows.select(
        "ip", "name", F.lit(None).cast("long").alias("asn"), "colo", "country", "region",
        F.lit(None).cast("string").alias("metro"), F.lit(None).cast("string").alias("city"),
        F.round(F.col("timestamp") * F.lit(1000.0)).cast("long").alias("time_ms"),
    )


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot document ``{latestClaim, values: [...]}`` -> (claim rows, watermark row in ms).

    The document may be of any size: it is read in splits (``sources.documents``), its ``values`` are cut into
    rows by many tasks, and no task or row holds the document.
    """
    from ..schema import SNAPSHOT_ROW
    from .documents import array_elements
    elements, around = array_elements(spark, path)
    rows = legacy_to_claims(elements.select(F.from_json("element", SNAPSHOT_ROW).alias("v")).where("v is not null").select("v.*"))
    number = F.regexp_extract("text", r'"latestClaim"\s*:\s*([-+0-9.eE]+)', 1)
    mark = around.agg(F.max(F.when(number != "", number.cast("double"))).alias("t")).select(
        F.round(F.col("t") * F.lit(1000.0)).cast("long").alias("latest_claim"))
    return rows, mark


def read_snapshot_whole(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S11 for small documents: each is one row, parsed as a whole and exploded."""
    from ..schema import SNAPSHOT
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", SNAPSHOT).alias("d"))
    rows = legacy_to_claims(doc.select(F.explode("d.values").alias("v")).select("v.*"))
    mark = doc.select(F.round(F.col("d.latestClaim") * F.lit(1000.0)).cast("long").alias("latest_claim"))
    return rows, mark
