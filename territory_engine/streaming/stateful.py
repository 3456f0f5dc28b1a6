"""Keyed streaming state with ``transformWithStateInPandas``.

``CooldownProcessor`` keeps one stored claim per address in a value state that never
expires and applies each micro-batch's claims to it in order: the same rule as the batch
fold, one key at a time, with the state in the (RocksDB) state store. It emits the address's
row whenever the stored claim changed.

``ClaimBatcher`` keeps the claims of an object that is not full yet in a list state, with a timer that
flushes them.

``AdmissionCounter`` keeps the two rate-limit counters per address (per name, and in total) for
each period in a map state that expires.

A processor sorts the rows of one key in one micro-batch, so what a task holds is bounded by the
micro-batch (``maxFilesPerTrigger``), never by an address's history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..constants import BATCH_INTERVAL_MS, BATCH_MAX_CLAIMS, CLAIM_COLUMNS, COOLDOWN_MS, IP_RATE_LIMIT, NAME_RATE_LIMIT, RATE_PERIOD_SECS

STATE_DDL = "name string, asn bigint, colo string, country string, region string, metro string, city string, time_ms bigint"
OUTPUT_DDL = "ip string, " + STATE_DDL
LIMITER_TTL_MS = 3_600_000  # processing time that a limiter period's counters outlive their last change
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class CooldownProcessor(StatefulProcessor):
    """The upsert rule against the stored claim of one address."""

    def __init__(self, cooldown_ms: int = COOLDOWN_MS, order: tuple[str, ...] = ("time_ms", "seq")):
        self.cooldown_ms = cooldown_ms
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", STATE_DDL)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """The stored claim of an address before the stream starts (of several rows the latest)."""
        known = initialState.dropna(subset=["name", "time_ms"]).sort_values("time_ms", kind="stable")
        if len(known):
            rec = known[CLAIM_COLUMNS[1:]].astype(object).iloc[-1]
            self.stored.update(tuple(None if pd.isna(v) else v for v in rec))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        cur = self.stored.get() if self.stored.exists() else None
        fields = CLAIM_COLUMNS[1:]
        changed = False
        for rec in batch[fields].itertuples(index=False, name=None):
            name, t = rec[0], rec[-1]
            if name is None or t is None:
                continue
            if cur is None or (name != cur[0] and t > cur[-1]) or (name == cur[0] and t - self.cooldown_ms > cur[-1]):
                cur = tuple(None if pd.isna(v) else v for v in rec)
                changed = True
        if changed:
            self.stored.update(cur)
            yield pd.DataFrame([(key[0], *cur)], columns=CLAIM_COLUMNS)

    def close(self) -> None:
        pass


def stateful_fold(stream: DataFrame, cooldown_ms: int = COOLDOWN_MS, order: tuple[str, ...] = ("time_ms", "seq"),
                  state: DataFrame | None = None) -> DataFrame:
    """Updated (ip, stored claim) rows per micro-batch; ``outputMode("update")`` sinks keep the latest.

    ``state`` holds the stored claims before the stream (``read_state`` of a version): they are loaded
    into the state store by the first micro-batch and are not emitted. Late claims are settled against them
    as ``apply_claims`` would. A restart from a checkpoint uses the state in there instead.
    """
    seeded = None if state is None else state.select(*CLAIM_COLUMNS).groupBy("ip")
    return stream.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=CooldownProcessor(cooldown_ms, order),
        outputStructType=OUTPUT_DDL,
        outputMode="Update",
        timeMode="None",
        initialState=seeded,
    )


def fold_stream_from(spark: SparkSession, state: DataFrame, path: str, schema: str, checkpoint_dir: str, out_dir: str,
                     cooldown_ms: int = COOLDOWN_MS, order: tuple[str, ...] = ("time_ms", "seq"),
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """T2 as a job: stream the claim files under ``path`` into ``state`` until there are no more; the whole new state.

    Changed rows are written under ``out_dir``, one folder a micro-batch, so a repeated micro-batch writes
    the same files again.
    """
    from pyspark.sql import functions as F

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    (stateful_fold(reader.parquet(path), cooldown_ms, order, state).writeStream.foreachBatch(keep).outputMode("update")
     .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination())
    changed = spark.read.schema(f"{OUTPUT_DDL}, batch int").parquet(out_dir)
    newest = changed.groupBy("ip").agg(F.max_by(F.struct(*CLAIM_COLUMNS[1:]), "batch").alias("row")).select("ip", "row.*")
    from ..operators.claims import newest_wins_merge

    return newest_wins_merge(state.select(*CLAIM_COLUMNS), newest.select(*CLAIM_COLUMNS))


BATCHED_DDL = "shard int, object bigint, position int, " + OUTPUT_DDL


class ClaimBatcher(StatefulProcessor):
    """Claims of one shard gathered into objects of exactly ``max_claims``; what does not fill one is
    held over triggers until it does, or until its first claim has waited ``interval_ms``.

    State of a shard: less than ``max_claims`` claims and the number of its next object, so an object's
    name is the same when a micro-batch is repeated.
    """

    def __init__(self, max_claims: int = BATCH_MAX_CLAIMS, interval_ms: int = BATCH_INTERVAL_MS):
        self.max_claims, self.interval_ms = max_claims, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", OUTPUT_DDL)
        self.next = handle.getValueState("next", "object bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        claims = list(self.held.get()) if self.held.exists() else []
        waiting = len(claims)
        for r in rows:
            r = r[CLAIM_COLUMNS].astype(object)
            claims += list(r.where(r.notna(), None).itertuples(index=False, name=None))
        full = len(claims) // self.max_claims * self.max_claims
        if full:
            yield self._objects(key, claims[:full])
        if full or not waiting:  # the oldest claim that waits is a new one
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if len(claims) > full:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.interval_ms)
        if len(claims) > full:
            self.held.put([tuple(c) for c in claims[full:]])
        elif self.held.exists():
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield self._objects(key, list(self.held.get()))
            self.held.clear()

    def _objects(self, key, claims: list[tuple]) -> pd.DataFrame:
        first = self.next.get()[0] if self.next.exists() else 0
        self.next.update((first + -(-len(claims) // self.max_claims),))
        columns = dict(zip(CLAIM_COLUMNS, map(list, zip(*claims, strict=True)), strict=True))
        for c in ("asn", "time_ms"):
            columns[c] = pd.array(columns[c], dtype="Int64")
        n = range(len(claims))
        return pd.DataFrame({"shard": [key[0]] * len(claims), "object": [first + i // self.max_claims for i in n],
                             "position": [i % self.max_claims for i in n], **columns})

    def close(self) -> None:
        pass


def batched_claims(stream: DataFrame, max_claims: int = BATCH_MAX_CLAIMS, interval_ms: int = BATCH_INTERVAL_MS, shards: int = 8) -> DataFrame:
    """The claims of a stream with the object and the position in it that each belongs to.

    Claims are dealt to shards by a hash of the whole claim, so a busy address fills no shard alone.
    As the timers run on processing time, Spark goes on with empty micro-batches while claims wait
    (``spark.sql.streaming.noDataMicroBatches.enabled``, on by default).
    """
    from pyspark.sql import functions as F

    dealt = stream.select(F.pmod(F.xxhash64(*CLAIM_COLUMNS), F.lit(shards)).cast("int").alias("shard"), *CLAIM_COLUMNS)
    return dealt.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=ClaimBatcher(max_claims, interval_ms),
        outputStructType=BATCHED_DDL,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


class AdmissionCounter(StatefulProcessor):
    """T5: per address and period, claims admitted — by name (first limit) and in total (second
    limit, only over claims the first one let through).

    Every period has counters of its own in a map state, so a late claim counts in its period and
    leaves newer ones alone. Counters expire ``ttl_ms`` of processing time after their last change:
    an address that stops claiming leaves no state behind, and a claim later than that starts its
    period afresh. A claim delivered more than once in a micro-batch counts once.
    """

    def __init__(self, name_limit: int = NAME_RATE_LIMIT, ip_limit: int = IP_RATE_LIMIT,
                 period_secs: int = RATE_PERIOD_SECS, order: tuple[str, ...] = ("time_ms", "seq"), ttl_ms: int = LIMITER_TTL_MS):
        self.name_limit, self.ip_limit = name_limit, ip_limit
        self.period_ms = period_secs * 1000
        self.order = list(order)
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getMapState("counters", "slot bigint", "total int, by_name map<string, int>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")  # one address's micro-batch
        slots: dict[int, list] = {}
        out, last, verdict = [], None, ""
        for seq, name, t in batch[["seq", "name", "time_ms"]].itertuples(index=False, name=None):
            slot = int(t) // self.period_ms
            if slot not in slots:
                total, by_name = self.counters.getValue((slot,)) if self.counters.containsKey((slot,)) else (0, {})
                slots[slot] = [total, dict(by_name or {})]
            if (seq, name, t) != last:
                counts = slots[slot]
                if counts[1].get(name, 0) >= self.name_limit:
                    verdict = "name_rate_limited"
                else:
                    counts[1][name] = counts[1].get(name, 0) + 1
                    verdict = "ip_rate_limited" if counts[0] >= self.ip_limit else "accepted"
                    counts[0] += verdict == "accepted"
                last = (seq, name, t)
            out.append((seq, verdict))
        for slot, (total, by_name) in slots.items():
            self.counters.updateValue((slot,), (total, by_name))
        yield pd.DataFrame(out, columns=["seq", "verdict"])

    def close(self) -> None:
        pass


def stream_admission(stream: DataFrame, name_limit: int = NAME_RATE_LIMIT, ip_limit: int = IP_RATE_LIMIT,
                     period_secs: int = RATE_PERIOD_SECS, ttl_ms: int = LIMITER_TTL_MS) -> DataFrame:
    """T5: limiter verdicts for a stream of claims that passed the static checks (``ip``, ``name``,
    ``time_ms``, ``seq``); rows are (seq, verdict).

    As its state expires by processing time, Spark goes on with empty micro-batches: with an
    ``availableNow`` trigger set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
    """
    return stream.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=AdmissionCounter(name_limit, ip_limit, period_secs, ttl_ms=ttl_ms),
        outputStructType="seq bigint, verdict string",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def admit_stream(raw: DataFrame, name_limit: int = NAME_RATE_LIMIT, ip_limit: int = IP_RATE_LIMIT,
                 period_secs: int = RATE_PERIOD_SECS) -> DataFrame:
    """Q1 on a stream: static checks as expressions, then the keyed limiter counters; (seq, verdict)."""
    from pyspark.sql import functions as F

    from ..operators.admission import normalise

    base = normalise(raw)
    static = base.where(F.col("_static").isNotNull()).select("seq", F.col("_static").alias("verdict"))
    counted = stream_admission(base.where(F.col("_static").isNull()).select("ip", "name", "time_ms", "seq"),
                               name_limit, ip_limit, period_secs)
    return static.unionByName(counted)
