"""Row counts for progress and checks without an extra pass (``DataFrame.observe``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: Name of the poll job's counts in a micro-batch's progress.
POLL = "poll"


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` instrumented with a row count; read ``obs.get["rows"]`` after an action on it."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs


def with_poll_counts(objects: DataFrame) -> DataFrame:
    """Batch objects (batch or stream), observed: objects read and unreadable, claims read, accepted (with address,
    name and time) and quarantined. The counts ride on the pass that reads the objects; no job is added."""
    def usable(c: Column) -> Column:
        return c["ip"].isNotNull() & c["name"].isNotNull() & c["time_ms"].isNotNull()

    unread = F.col("_corrupt_record").isNotNull()
    bare = F.array(F.struct("ip", "name", "time_ms"))
    claims = F.when(unread, F.array().cast("array<struct<ip:string,name:string,time_ms:bigint>>")).when(
        F.col("batch").isNotNull(), F.transform("batch", lambda c: F.struct(c["ip"], c["name"], c["time_ms"]))).otherwise(bare)
    n, good = F.size(claims), F.size(F.filter(claims, usable))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return objects.observe(POLL, F.count(F.lit(1)).alias("objects"), F.count_if(unread).alias("unreadable"), total(n).alias("claims"),
                           total(good).alias("accepted"), total(n - good).alias("quarantined"))


class PollCounts(StreamingQueryListener):
    """Counts of the poll job's micro-batches: register with ``spark.streams.addListener``; ``latest`` is by query run."""

    def __init__(self) -> None:
        self.latest: dict[str, dict[str, int]] = {}
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        counts = event.progress.observedMetrics.get(POLL)
        if counts is None:
            return
        run, found = str(event.progress.runId), counts.asDict()
        self.latest[run] = {"batch": event.progress.batchId, **found}
        sums = self.totals.setdefault(run, dict.fromkeys(found, 0))
        for k, v in found.items():
            sums[k] += v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass
