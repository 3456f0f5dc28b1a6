"""Small join sides: let Spark decide on a broadcast from measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark import StorageLevel

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def measured(df: DataFrame) -> DataFrame:
    """Cache ``df`` on the executors and count it (a partial count per task, nothing gathered).

    The cached relation has exact sizes in bytes, so Spark itself broadcasts it in a later join if,
    and only if, it is below ``spark.sql.autoBroadcastJoinThreshold``, and the rows are not
    computed a second time.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept
