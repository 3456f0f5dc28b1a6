"""Tables of which a poll reads and rewrites a few buckets only.

A ``BucketStore`` holds some tables. ``<base>/<table>/v=<n>/b=<bucket>`` holds the rows of the buckets that
version ``n`` wrote; ``<base>/_manifest/v=<n>`` lists the folders that make up every table as of version
``n`` (one row a bucket, so its size does not follow the data) and a mark, written last: a version is complete, for
all tables at once, when its manifest is. Readers name the buckets they need and open those folders alone. A
repeated version starts from the newest one below it and rewrites its own folders and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import folder_names, remove_folder, versions

MANIFEST = "table string, bucket long, version int"
_MARK = "_mark"


class BucketStore:
    """Tables by name, each with its columns and the bucket of a row (a column of long integers)."""

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, tuple[str, Column]]):
        self.spark, self.base = spark, base
        self._read: dict[int, list[tuple[str, int, int]]] = {}  # manifests that this object has read or written
        self.open: list[tuple[str, int, int]] = []  # of the version that is being written
        self.tables = {name: BucketTable(self, name, schema, bucket) for name, (schema, bucket) in tables.items()}

    def versions(self, before: int | None = None) -> list[int]:
        return [v for v in versions(self.spark, f"{self.base}/_manifest") if before is None or v < before]

    def manifest(self, before: int | None = None) -> list[tuple[str, int, int]]:
        """(table, bucket, version) of the newest version (below ``before`` when given)."""
        known = self.versions(before)
        if not known:
            return []
        if known[-1] not in self._read:
            listed = self.spark.read.schema(MANIFEST).parquet(f"{self.base}/_manifest/v={known[-1]}")
            self._read[known[-1]] = sorted(tuple(r) for r in listed.collect())  # one row a bucket
        return self._read[known[-1]]

    def mark(self, before: int | None = None) -> int | None:
        """The number that the newest version (below ``before``) was committed with."""
        return next((b for t, b, _ in self.manifest(before) if t == _MARK), None)

    def begin(self, version: int) -> None:
        """Start to write ``version`` from the newest one below it."""
        self.open = [x for x in self.manifest(version) if x[0] != _MARK]

    def commit(self, version: int, mark: int) -> None:
        rows = sorted([*self.open, (_MARK, mark, version)])
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/_manifest/v={version}")
        self._read[version] = rows

    def expire(self, keep_from: int) -> None:
        """Remove manifests below ``keep_from`` and the folders that no other lists."""
        known = self.versions()
        used = {(t, v) for m in known if m >= keep_from for t, _, v in self.manifest(m + 1)}
        for name in self.tables:
            for folder in folder_names(self.spark, f"{self.base}/{name}"):
                v = int(folder[2:])
                if v < keep_from and (name, v) not in used:
                    remove_folder(self.spark, f"{self.base}/{name}/{folder}")
        for m in known:
            if m < keep_from:
                remove_folder(self.spark, f"{self.base}/_manifest/v={m}")


class BucketTable:
    """One table of a store."""

    def __init__(self, store: BucketStore, name: str, schema: str, bucket: Column):
        self.store, self.name, self.schema, self.bucket = store, name, schema, bucket.cast("long")

    def folders(self, before: int | None = None, fresh: bool = False) -> list[tuple[int, int]]:
        """(bucket, version) of the newest committed version (below ``before``), or with ``fresh`` of the one being written."""
        listed = self.store.open if fresh else self.store.manifest(before)
        return [(b, v) for t, b, v in listed if t == self.name]

    def read(self, before: int | None = None, only: set[int] | None = None, fresh: bool = False) -> DataFrame:
        """The table's rows, or those of the buckets ``only``."""
        paths = [f"{self.store.base}/{self.name}/v={v}/b={b}" for b, v in self.folders(before, fresh) if only is None or b in only]
        spark = self.store.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def buckets_of(self, rows: DataFrame) -> set[int]:
        """The buckets in which ``rows`` (with the columns that decide on it) lie: at most all buckets there are."""
        return {r[0] for r in rows.select(self.bucket.alias("b")).distinct().collect()}

    def replace(self, rows: DataFrame, buckets: set[int], version: int, append: bool = False) -> None:
        """Write ``rows`` instead of what ``buckets`` held, or with ``append`` beside it."""
        out = f"{self.store.base}/{self.name}/v={version}"
        # rebalanced, so a bucket that holds much is written by several tasks
        rows.withColumn("b", self.bucket).hint("rebalance", "b").write.mode("overwrite").partitionBy("b").parquet(out)
        self.forget(lambda b: b in buckets and not append)
        self.store.open += [(self.name, int(f[2:]), version) for f in folder_names(self.store.spark, out) if f.startswith("b=")]

    def forget(self, gone) -> None:
        """Take the buckets for which ``gone`` is true out of the version being written."""
        self.store.open = [x for x in self.store.open if x[0] != self.name or not gone(x[1])]
