"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territory_engine.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive the loss of executors and nothing above them is computed again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids: null)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def nullable_longs(values: Iterable[int | None]) -> pd.arrays.IntegerArray:
    """Long integers and nulls as a pandas array, without the detour through doubles."""
    values = list(values)
    return pd.arrays.IntegerArray(np.array([0 if v is None else v for v in values], dtype=np.int64), np.array([v is None for v in values], dtype=bool))


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of the connected component of each of ``n`` nodes, given links a-b.

    ``root`` continues an earlier result, so links can be added in bounded portions.
    """
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
