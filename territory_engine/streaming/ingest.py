"""The poll cycle as a Structured Streaming job (Q12: T1–T4, T8).

Claim batch files stream in; each micro-batch is unwrapped and upserted into the versioned
state table (a delta of the touched addresses, a full snapshot every ``compact_every``
batches), and the rankings, recents and public dump are computed from the new state and
written under the micro-batch id. Trailing windows move with the clock, not with the data (no event-time
``window()``, no watermark: late claims are settled by the upsert rule against the stored row): by default
the rankings are recomputed from the state every batch, with ``windowed_buckets`` they are kept up by the
keys that changed (``streaming.windows``).

Replays are safe: micro-batch ``n`` always starts from the newest state version *below* ``n``
and rewrites version ``n`` and its outputs, so re-running a batch after a failure gives the
same files. Consumed input files can be archived or deleted by the file source once their
batch commits (``clean_source``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import BATCH_INTERVAL_MS, BATCH_MAX_CLAIMS, COOLDOWN_MS
from ..functions.clock import now_ms
from ..operators.claims import apply_claims, fold_claims, unusable_claims, valid_claims
from ..plans.broadcast import measured
from ..plans.observe import with_poll_counts
from ..operators.rankings import leaderboards, public_claims, recents
from ..sinks.publish import write_leaderboards, write_public_claims
from ..sources.batches import BATCH_ORDER, quarantine, stream_batch_files, unwrap
from ..sources.state import expire_versions, read_state, write_delta, write_state
from .windows import WindowedRankings


@dataclass
class PollJob:
    state_dir: str
    out_dir: str
    cooldown_ms: int = COOLDOWN_MS
    clock: str = "wall"  # "wall": rankings relative to now; "data": relative to the latest stored claim
    state_partitions: int | None = None
    compact_every: int = 10  # a full snapshot every this many batches; deltas in between
    keep_versions: int | None = None  # full snapshots (and the deltas over them) that stay; None: all

    windowed_buckets: int | None = None  # keep the rankings up by changed keys, in tables of so many buckets (T4)
    fail_fast: bool = False  # stop on input that cannot be used instead of setting it aside

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()  # read once; every action below starts from it
        try:
            self._set_aside(batch, batch_id)
            claims = valid_claims(unwrap(batch))
            if self.windowed_buckets:
                self._windowed(claims, batch_id)
                return
            previous = read_state(spark, self.state_dir, before=batch_id)
            if batch_id % self.compact_every == 0 or previous.isEmpty():
                state = apply_claims(None if previous.isEmpty() else previous, claims, self.cooldown_ms, order=BATCH_ORDER)
                write_state(state, self.state_dir, batch_id, self.state_partitions)
            else:
                keys = measured(claims.select("ip").distinct())  # small: the state is filtered map-side
                stored = previous.join(keys, "ip", "left_semi")
                touched = fold_claims(claims, stored, self.cooldown_ms, order=BATCH_ORDER)
                write_delta(touched, self.state_dir, batch_id, self.state_partitions)
                keys.unpersist()
            stored = read_state(spark, self.state_dir, before=batch_id + 1)
            as_of = stored.select(F.max("time_ms")).scalar() if self.clock == "data" else now_ms()
            self._publish(stored, leaderboards(stored, as_of), as_of, claims, batch_id)
            if self.keep_versions:
                expire_versions(spark, self.state_dir, self.keep_versions)
        finally:
            batch.unpersist()

    def _windowed(self, claims: DataFrame, batch_id: int) -> None:
        """The poll with rankings that follow the batch and the clock instead of rereading the state."""
        job = WindowedRankings(claims.sparkSession, self.state_dir, self.windowed_buckets, self.cooldown_ms, BATCH_ORDER)
        newest = claims.agg(F.max("time_ms")) if self.clock == "data" else claims.sparkSession.range(1).select(now_ms())
        as_of = newest.first()[0]
        board = job.poll(claims, batch_id, as_of if as_of is not None else job.clock(batch_id) or 0)
        self._publish(job.state.read(batch_id + 1), board, F.lit(job.clock(batch_id + 1)), claims, batch_id)
        if self.keep_versions:
            job.expire(batch_id + 1 - self.keep_versions)

    def _publish(self, stored: DataFrame, board: DataFrame, as_of, claims: DataFrame, batch_id: int) -> None:
        out = f"{self.out_dir}/batch={batch_id}"
        write_leaderboards(board, f"{out}/leaderboards")
        recents(stored, as_of).write.mode("overwrite").json(f"{out}/recents")
        if not claims.isEmpty():  # the dump is published only when new claims arrived
            write_public_claims(public_claims(stored), f"{out}/claims",
                                F.floor(F.unix_millis(F.current_timestamp()) / 1000))

    def _set_aside(self, batch: DataFrame, batch_id: int) -> None:
        """S3: what the fold cannot use goes to ``<out>/quarantine/batch=<n>``: objects that cannot
        be read, and claims without an address, a name or a time."""
        unread = quarantine(batch)[1].withColumnsRenamed({"_file": "file", "_corrupt_record": "text"})
        found = {"objects": unread, "claims": unusable_claims(unwrap(batch))}
        for kind, rows in found.items():
            if rows.isEmpty():
                continue
            if self.fail_fast:
                raise ValueError(f"micro-batch {batch_id} has unusable {kind}")
            rows.write.mode("overwrite").json(f"{self.out_dir}/quarantine/batch={batch_id}/{kind}")


def run_stream(spark: SparkSession, input_dir: str, state_dir: str, out_dir: str, checkpoint_dir: str,
               interval: str | None = "60 seconds", available_now: bool = False, clean_source: str | None = None,
               archive_dir: str | None = None, max_files_per_trigger: int | None = None, clock: str = "wall",
               cooldown_ms: int = COOLDOWN_MS, lines: bool = False, compact_every: int = 10, fail_fast: bool = False,
               keep_versions: int | None = None, windowed_buckets: int | None = None) -> StreamingQuery:
    """Q12: start the poll job. ``available_now`` processes what is there and stops (one pass).

    With ``windowed_buckets`` the state under ``state_dir`` is the tables of ``WindowedRankings``: what a poll reads
    for the rankings follows the batch and the claims that leave a window. Each micro-batch's progress carries its
    counts (A14, ``plans.observe.PollCounts``).
    """
    job = PollJob(state_dir, out_dir, cooldown_ms, clock, compact_every=compact_every, fail_fast=fail_fast,
                  keep_versions=keep_versions, windowed_buckets=windowed_buckets)
    stream = with_poll_counts(stream_batch_files(spark, input_dir, max_files_per_trigger, clean_source, archive_dir, lines))
    writer = stream.writeStream.foreachBatch(job.process).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif interval:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def run_batcher(claims_stream: DataFrame, out_dir: str, checkpoint_dir: str, interval: str = "2 seconds",
                max_claims: int = 100, worker_id: str = "spark") -> StreamingQuery:
    """Accepted claims written as envelope objects of at most ``max_claims`` claims,
    flushed on every trigger (``interval``), one folder per micro-batch (idempotent on replay)."""
    from ..sinks.publish import claim_envelopes

    def flush(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        claim_envelopes(batch, max_claims, worker_id).write.mode("overwrite").text(f"{out_dir}/batch={batch_id}")

    return (claims_stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint_dir)
            .trigger(processingTime=interval).start())


def run_size_or_time_batcher(claims_stream: DataFrame, out_dir: str, checkpoint_dir: str, max_claims: int = BATCH_MAX_CLAIMS,
                             interval_ms: int = BATCH_INTERVAL_MS, shards: int = 8, trigger: str = "500 milliseconds",
                             worker_id: str = "spark") -> StreamingQuery:
    """Accepted claims written as envelope objects of exactly ``max_claims`` claims as soon as a shard has
    that many, and of fewer once the oldest of them has waited ``interval_ms`` (noticed at the next trigger).

    Claims that wait live in the state store, so none is lost or doubled by a restart; each micro-batch writes one
    folder, the same files when it is repeated.
    """
    from ..sinks.publish import object_envelopes
    from .stateful import batched_claims

    def flush(batch: DataFrame, batch_id: int) -> None:
        object_envelopes(batch, worker_id).write.mode("overwrite").text(f"{out_dir}/batch={batch_id}")

    return (batched_claims(claims_stream, max_claims, interval_ms, shards).writeStream.foreachBatch(flush).outputMode("append")
            .option("checkpointLocation", checkpoint_dir).trigger(processingTime=trigger).start())
