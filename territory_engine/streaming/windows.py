"""Rankings over trailing windows kept up poll by poll (T4).

The fifteen rankings follow from counts per (territory type, territory, name) and window. They change for
two reasons: a poll replaces the stored claims of some addresses, and the clock takes claims out of
windows. ``WindowedRankings`` keeps, as tables of buckets,

* ``state``: the stored claims, by address;
* ``holds``: for each territory type the place, name and time of every stored claim, by (type, territory, name);
* ``queue``: the same rows in slots of time, the order in which the clock reaches them;
* ``counts``: the claims of each (type, territory, name) in every window and the latest, by (type, territory);
* ``winners``: the winner of each territory in every window, by (type, territory).

A poll finds the keys that changed: those of replaced and new claims, and those of queued claims with a time
that left a window since the last poll. It counts these keys again from their buckets of ``holds``, finds the
winners of their territories again from their buckets of ``counts``, and sums up the leaderboards from
``winners``, which has one row a territory and window. Queued claims that were replaced meanwhile only
cause a key to be counted again. What a poll reads and writes follows the batch and the claims that
leave a window, not the state.

All tables are committed together under the poll's version, so a poll that fails or is repeated starts from the
newest complete version below its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLAIM_COLUMNS, COOLDOWN_MS, HOUR_SECS, TERRITORY_TYPES, TIME_WINDOWS
from ..operators.claims import fold_claims, newest_wins_merge, valid_claims
from ..operators.rankings import holdings, with_leaderboard_rank, winners_by_min
from ..sources.buckets import BucketStore

SLOT_MS = HOUR_SECS * 1000
KEY = ["territory_type", "territory", "name"]
PLACE = ["territory_type", "territory"]
STATE = "ip string, name string, asn long, colo string, country string, region string, metro string, city string, time_ms long"
HOLDS = "territory_type string, territory string, name string, ip string, time_ms long"
WINNERS = "territory_type string, territory string, time_window string, name string, count long, latest long"
FINITE = {label: secs * 1000 for label, secs in TIME_WINDOWS if secs is not None}
COUNTED = [f"in_{label.replace('-', '_')}" for label, _ in TIME_WINDOWS]


def held(claims: DataFrame) -> DataFrame:
    """One row per territory type of each claim that has a territory of it."""
    places = F.inline(F.array(*[F.struct(F.lit(t).alias("territory_type"), F.col(t).alias("territory")) for t in TERRITORY_TYPES]))
    return claims.select(places, "name", "ip", "time_ms").where(F.col("territory").isNotNull())


class WindowedRankings:
    """Poll-by-poll rankings under ``base``; ``buckets`` per table and ``slot_ms``, the time that a slot of the queue
    spans, are chosen once (more buckets for larger states, shorter slots for frequent polls)."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 256, cooldown_ms: int = COOLDOWN_MS,
                 order: tuple[str, ...] = ("time_ms", "seq"), slot_ms: int = SLOT_MS):
        self.spark, self.base, self.cooldown_ms, self.order, self.slot_ms = spark, base, cooldown_ms, order, slot_ms

        def dealt(*columns: str) -> Column:
            return F.pmod(F.xxhash64(*columns), F.lit(buckets))

        counts = ", ".join(["territory_type string", "territory string", "name string", *[f"{c} long" for c in COUNTED], "latest long"])
        self.store = BucketStore(spark, base, {
            "state": (STATE, dealt("ip")),
            "holds": (HOLDS, dealt(*KEY)),
            "queue": (HOLDS, F.floor(F.col("time_ms") / slot_ms)),
            "counts": (counts, dealt(*PLACE)),
            "winners": (WINNERS, dealt(*PLACE)),
        })
        self.state, self.holds, self.queue, self.counts, self.winners = self.store.tables.values()
        self.read: dict[str, set[int]] = {}  # the buckets that the last poll read

    def clock(self, before: int | None = None) -> int | None:
        """The time of the newest poll (below ``before``)."""
        return self.store.mark(before)

    def _kept(self, rows: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.base}/work/v={version}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def left_windows(self, since: int | None, as_of_ms: int, version: int) -> DataFrame:
        """Queued rows that were in a window at ``since`` and are not at ``as_of_ms``."""
        if since is None:
            return self.spark.createDataFrame([], HOLDS)
        gone = [(since - w, as_of_ms - w) for w in FINITE.values()]
        slots = {s for low, high in gone for s in range(low // self.slot_ms, high // self.slot_ms + 1)}
        self.read["queue"] = slots & {b for b, _ in self.queue.folders(version)}
        out = F.lit(False)
        for low, high in gone:
            out = out | (F.col("time_ms") > low) & (F.col("time_ms") <= high)
        return self.queue.read(version, slots).where(out)

    def poll(self, claims: DataFrame, version: int, as_of_ms: int) -> DataFrame:
        """Take in a batch and move the clock to ``as_of_ms``; the leaderboards as of then.

        The clock does not go back: an earlier ``as_of_ms`` counts as the last poll's. Claims without
        address, name or time are left out; late claims are settled by the upsert rule and counted
        in the windows they still lie in.
        """
        self.store.begin(version)
        since = self.clock(version)
        as_of_ms = as_of_ms if since is None else max(since, as_of_ms)
        claims = self._kept(valid_claims(claims), "claims", version)
        mine = self.read["state"] = self.state.buckets_of(claims)
        old = self.state.read(version, mine)
        new = self._kept(fold_claims(claims, old, self.cooldown_ms, self.order), "folded", version)
        before, after = F.struct(*CLAIM_COLUMNS[1:]), F.struct(*CLAIM_COLUMNS[1:])
        met = new.select("ip", after.alias("after")).join(old.select("ip", before.alias("before")), "ip", "left")
        changed = self._kept(met.where(~F.col("after").eqNullSafe(F.col("before"))), "changed", version)
        self.state.replace(newest_wins_merge(old, new), mine, version)

        added = held(changed.select("ip", "after.*"))
        removed = held(changed.where("before is not null").select("ip", "before.*"))
        oldest = as_of_ms - max(FINITE.values())  # what is older lies in no window that it could leave
        self.queue.replace(added.where(F.col("time_ms") > oldest), set(), version, append=True)
        self.queue.forget(lambda slot: slot < oldest // self.slot_ms)

        moved = self.holds.buckets_of(added.unionByName(removed))
        rest = self.holds.read(version, moved).join(changed.select("ip"), "ip", "left_anti")
        self.holds.replace(rest.select(added.columns).unionByName(added), moved, version)

        expired = self.left_windows(since, as_of_ms, version)
        keys = self._kept(added.unionByName(removed).unionByName(expired).select(KEY).distinct(), "keys", version)
        near = self.read["holds"] = self.holds.buckets_of(keys)
        hits = [F.count_if(F.col("time_ms") > as_of_ms - FINITE[label]) if label in FINITE else F.count(F.lit(1)) for label, _ in TIME_WINDOWS]
        fresh = self.holds.read(only=near, fresh=True).join(keys, KEY, "left_semi").groupBy(*KEY).agg(
            *[h.alias(c) for h, c in zip(hits, COUNTED, strict=True)], F.max("time_ms").alias("latest"))
        places = keys.select(PLACE).distinct()
        around = self.read["counts"] = self.counts.buckets_of(places)
        others = self.counts.read(version, around).join(keys, KEY, "left_anti")
        self.counts.replace(others.select(fresh.columns).unionByName(fresh), around, version)

        # the latest claim of a key lies in every window in which the key has a claim
        windows = F.inline(F.array(*[F.struct(F.lit(label).alias("time_window"), F.col(c).alias("count"))
                                     for (label, _), c in zip(TIME_WINDOWS, COUNTED, strict=True)]))
        contenders = self.counts.read(only=around, fresh=True).join(places, PLACE, "left_semi").select(*KEY, "latest", windows).where("count > 0")
        won = winners_by_min(contenders, ["territory_type", "time_window"])
        unchanged = self.winners.read(version, around).join(places, PLACE, "left_anti")
        self.winners.replace(unchanged.select(won.columns).unionByName(won), around, version)
        self.store.commit(version, as_of_ms)
        return self.leaderboards(version)

    def leaderboards(self, version: int | None = None) -> DataFrame:
        """The fifteen rankings as of a poll (the newest one by default), from one row a territory and window."""
        part = ["territory_type", "time_window"]
        won = self.winners.read(None if version is None else version + 1)
        return with_leaderboard_rank(holdings(won, part), part).select(
            "territory_type", "time_window", "name", "territories", "ip_count", "latest", "score", "rank")

    def expire(self, keep_from: int) -> None:
        """Remove what no version from ``keep_from`` on needs."""
        self.store.expire(keep_from)
