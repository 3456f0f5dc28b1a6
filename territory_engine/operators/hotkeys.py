"""The cooldown fold for hot addresses, without gathering an address's history in one place.

The fold is sequential, but its step has a closed form. Once claim ``i`` is the stored row,
the next claim that replaces it is the earlier (in (time, tie) order) of

* ``A(i)``: the first claim with a different name and a strictly later time, and
* ``B(i)``: the first claim with the same name and ``time > t_i + cooldown``,

so ``next(i)`` depends only on (address, ``t_i``, name). The final row is the end of the
chain start -> next -> next ..., found by pointer jumping (each round doubles the distance a
pointer covers, so the rounds grow with log2 of the chain length).

Only claims that the final row can still depend on are linked: those from the last claim on that
is accepted whatever came before it (``last_changes`` and ``last_gaps``), and of the claims of one
time the first and the first with another name. A claim's position is (time, 0 or 1), so that
the links carry no payload.

Every lookup is bounded: claims are grouped in cooldown-wide time buckets per address
(bounded by the claim rate, not the history), and crossing buckets uses one summary row per
(address, bucket) or (address, name, bucket) (bounded by the time span). No window, list or
group ever holds an address's whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLAIM_COLUMNS, COOLDOWN_MS
from ..plans.broadcast import measured
from ..session import ensure_checkpoint_dir

PAYLOAD = [c for c in CLAIM_COLUMNS if c not in ("ip", "time_ms")]

#: Slots that addresses are hashed to: a table with one row per slot is small whatever the input.
SLOTS = 65_536


def _slot() -> Column:
    return F.pmod(F.hash("ip"), F.lit(SLOTS))


def in_slots(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """``claims`` without those whose slot holds none of the addresses in ``keys``.

    All claims of these addresses stay, with few others: what a join with ``keys`` would drop is
    mostly left out before that join shuffles.
    """
    slots = keys.select(_slot().alias("_slot")).distinct()
    return claims.join(F.broadcast(slots), _slot() == F.col("_slot"), "left_semi")


def since_changes(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """The claims of the addresses in ``changes`` from their ``z`` on, all claims where ``z`` is null.

    The earliest ``z`` of a slot leaves out most claims before the join by address shuffles the others.
    """
    cuts = changes.groupBy(_slot().alias("_slot")).agg(F.min("z").alias("_cut"), F.bool_or(F.col("z").isNull()).alias("_whole"))
    near = claims.join(F.broadcast(cuts), _slot() == F.col("_slot")).where(
        F.col("_whole") | (F.col("time_ms") >= F.col("_cut"))).drop("_slot", "_cut", "_whole")
    return near.join(changes.select("ip", "z"), "ip").where(F.col("z").isNull() | (F.col("time_ms") >= F.col("z"))).drop("z")


def _pos(t: str = "t", o: str = "o") -> Column:
    return F.struct(F.col(t).alias("t"), F.col(o).alias("o"))


def asof_next(data: DataFrame, probes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """For each probe ``(keys, _pt, _pid)``: ``value`` of the first data row ``(keys, _t, _o, value)``
    with ``_t > _pt`` (earliest ``(_t, _o)``) -> (_pid, value).

    Sort-based: probes and data share one ordering per key (time descending, a probe before
    data of equal time) and a running "last value seen" gives each probe its successor. The
    running frame is incremental (unbounded preceding), so it is linear in the group size.
    """
    vtype = data.schema[value].dataType
    otype = data.schema["_o"].dataType
    ptype = probes.schema["_pid"].dataType
    d = data.select(*keys, "_t", F.lit(1).alias("_k"), "_o", F.col(value).alias("_v"), F.lit(None).cast(ptype).alias("_pid"))
    p = probes.select(*keys, F.col("_pt").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(otype).alias("_o"),
                      F.lit(None).cast(vtype).alias("_v"), "_pid")
    w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.asc("_k"), F.desc("_o")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return d.unionByName(p).select("_k", "_pid", F.last("_v", ignorenulls=True).over(w).alias(value)).where(
        F.col("_k") == 0).select("_pid", value)


def last_changes(claims: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Per address the last time ``z`` at which a claim or stored row has another name than its latest
    one, ``latest`` -> (ip, latest, z, claimed); ``z`` is null if there is one name only.

    All claims after ``z`` have one name. The first of them is accepted whatever came before, as a
    different name, unless a claim at ``z`` has that name too.
    """
    marks = claims.select("ip", "name", "time_ms", F.lit(True).alias("claimed"))
    if seeds is not None:
        marks = marks.unionByName(seeds.select("ip", "name", "time_ms", F.lit(False).alias("claimed")))
    names = marks.groupBy("ip", "name").agg(F.max("time_ms").alias("last"), F.max("claimed").alias("claimed"))
    rank = F.row_number().over(Window.partitionBy("ip").orderBy(F.desc("last"), F.desc("name")))
    return names.withColumn("_r", rank).groupBy("ip").agg(
        F.max(F.when(F.col("_r") == 1, F.col("name"))).alias("latest"), F.max(F.when(F.col("_r") == 2, F.col("last"))).alias("z"),
        F.max("claimed").alias("claimed"))


def last_gaps(buckets: DataFrame) -> DataFrame:
    """Per address its last bucket after an empty one, or its first -> (ip, b0).

    Buckets are a cooldown wide, so the first claim of that bucket is accepted whatever came before.
    """
    buckets = buckets.distinct()
    return buckets.join(buckets.select("ip", (F.col("b") + 1).alias("b")), ["ip", "b"], "left_anti").groupBy("ip").agg(F.max("b").alias("b0"))


def first_two_names(claims: DataFrame) -> DataFrame:
    """Of each address's claims of one time the first (``o`` 0) and the first with another name (``o`` 1).

    No other can be accepted: whatever is stored, one of the two is, or none of that time.
    """
    w = Window.partitionBy("ip", "time_ms").orderBy("_o")
    other = F.col("name") != F.first("name").over(w)
    marked = claims.withColumn("_n", F.row_number().over(w)).withColumn("_other", other).withColumn(
        "_others", F.sum(F.col("_other").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.where((F.col("_n") == 1) | (F.col("_other") & (F.col("_others") == 1))).withColumn(
        "o", F.col("_other").cast("int")).drop("_n", "_other", "_others", "_o")


def hot_fold(claims: DataFrame, seeds: DataFrame | None = None, cooldown_ms: int = COOLDOWN_MS,
             order: Sequence[str] = ("time_ms", "seq"), max_rounds: int = 64,
             addresses: DataFrame | None = None) -> DataFrame:
    """The fold for the addresses in ``claims`` (and their stored rows ``seeds``) -> CLAIM rows.

    ``order`` is ``(time_ms, tie)`` with one tie column. Addresses whose stored row no claim
    replaces are returned unchanged. With ``addresses`` (ip) only these are folded; they meet the
    claims where these are few, so ``claims`` should not be joined with them before.
    """
    spark = claims.sparkSession
    ensure_checkpoint_dir(spark)
    tie = order[1]
    C = cooldown_ms
    bucket = F.floor(F.col("time_ms") / F.lit(C)).cast("long")
    if addresses is None:
        changes = measured(last_changes(claims, seeds))
    else:
        changes = measured(last_changes(in_slots(claims, addresses), seeds).join(addresses, "ip", "left_semi"))

    def told_apart(some: DataFrame) -> DataFrame:
        # claims of one time and tie are ordered by what they say, as in the plain fold, and repeats
        # are one node: (ip, t, o) then identifies a claim
        one = some.select("ip", "time_ms", *PAYLOAD, F.col(tie).alias("_t")).distinct()
        return first_two_names(one.withColumn("_o", F.struct("_t", *PAYLOAD)).drop("_t")).withColumn("b", bucket)

    late = since_changes(claims, changes)
    # as many partitions as the claims kept fill, not as the input has
    kept = told_apart(late).join(changes.select("ip", "latest", "z"), "ip").hint("rebalance").checkpoint()
    at_z = F.coalesce(F.col("time_ms") == F.col("z"), F.lit(False))
    open_z = measured(kept.where(at_z & (F.col("name") == F.col("latest"))).select("ip").distinct())
    kept = kept.where(~at_z)
    if not open_z.isEmpty():  # who holds it at z depends on what came before: all claims count
        kept = kept.join(open_z, "ip", "left_anti").unionByName(
            told_apart(in_slots(claims, open_z).join(open_z, "ip", "left_semi")).withColumns(
                {"latest": F.lit(None).cast("string"), "z": F.lit(None).cast("long")})).checkpoint()
        changes = changes.join(open_z.withColumn("_open", F.lit(True)), "ip", "left").withColumn(
            "z", F.when(F.col("_open").isNull(), F.col("z"))).drop("_open")
    buckets = kept.select("ip", "b")
    if seeds is not None:
        buckets = buckets.unionByName(seeds.join(changes.where("claimed"), "ip", "left_semi").select("ip", bucket.alias("b")))
    gaps = measured(last_gaps(buckets))
    # read by all that follows: few partitions, so that its shuffles write few small blocks
    rows = kept.join(gaps, "ip").where(F.col("b") >= F.col("b0")).select(
        "ip", F.col("time_ms").alias("t"), "o", "name", "b").hint("rebalance").checkpoint()
    pos = _pos()

    # ---- within-bucket run structure: next row with a different name (ND_in) ---------------
    wb = Window.partitionBy("ip", "b").orderBy("t", "o")
    runs = rows.withColumn("_chg", F.coalesce((F.col("name") != F.lag("name").over(wb)).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("_chg").over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run_first = runs.groupBy("ip", "b", "run").agg(F.min(pos).alias("run_first"))
    nd_in = runs.join(run_first.withColumn("run", F.col("run") - 1), ["ip", "b", "run"], "left").select(
        "ip", "t", "o", "name", "b", F.col("run_first").alias("nd_in"))

    # ---- bucket summaries (one row per address and bucket) ---------------------------------
    first_row = rows.groupBy("ip", "b").agg(F.min(F.struct(F.col("t"), F.col("o"), F.col("name"))).alias("r1"))
    second = rows.join(first_row, ["ip", "b"]).where(F.col("name") != F.col("r1.name")).groupBy("ip", "b").agg(
        F.min(pos).alias("r2"))
    bs = first_row.join(second, ["ip", "b"], "left").select(
        "ip", "b", F.struct(F.col("r1.t").alias("t"), F.col("r1.o").alias("o")).alias("r1"),
        F.col("r1.name").alias("r1_name"), "r2",
        F.when(F.col("r2").isNull(), F.col("r1.name")).alias("uni"))
    wsum = Window.partitionBy("ip").orderBy("b")
    bs = bs.withColumn("_sc", F.coalesce((~F.col("uni").eqNullSafe(F.lag("uni").over(wsum))).cast("int"), F.lit(1)))
    bs = bs.withColumn("streak", F.sum("_sc").over(wsum.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    streak_first = bs.groupBy("ip", "streak").agg(F.min("b").alias("sb"))
    bs = bs.join(streak_first.withColumn("streak", F.col("streak") - 1).withColumnRenamed("sb", "after_streak"),
                 ["ip", "streak"], "left")
    bs = bs.withColumn("next_b", F.lead("b").over(wsum)).select(
        "ip", "b", "r1", "r1_name", "r2", "uni", "after_streak", "next_b")
    bsum = bs.select("ip", "b", "r1", "r1_name", "r2", "uni", "after_streak")

    def first_diff(df: DataFrame, b_col: str, name_col: str, out: str) -> DataFrame:
        """First row in buckets after ``b_col`` whose name differs from ``name_col``."""
        nb = bs.select("ip", F.col("b").alias(b_col), F.col("next_b").alias("_b1"))
        x = df.join(nb, ["ip", b_col], "left")
        b1 = bsum.select("ip", F.col("b").alias("_b1"), F.col("r1").alias("_r1a"), F.col("r1_name").alias("_n1a"),
                         F.col("r2").alias("_r2a"), F.col("uni").alias("_ua"), F.col("after_streak").alias("_b2"))
        x = x.join(b1, ["ip", "_b1"], "left")
        b2 = bsum.select("ip", F.col("b").alias("_b2"), F.col("r1").alias("_r1b"), F.col("r1_name").alias("_n1b"),
                         F.col("r2").alias("_r2b"))
        x = x.join(b2, ["ip", "_b2"], "left")
        n = F.col(name_col)
        pick = (
            F.when(F.col("_b1").isNull(), F.lit(None))
            .when(F.col("_n1a") != n, F.col("_r1a"))
            .when(F.col("_r2a").isNotNull(), F.col("_r2a"))
            .when(F.col("_b2").isNull(), F.lit(None))
            .when(F.col("_n1b") != n, F.col("_r1b"))
            .otherwise(F.col("_r2b"))
        )
        return x.withColumn(out, pick).drop("_b1", "_r1a", "_n1a", "_r2a", "_ua", "_b2", "_r1b", "_n1b", "_r2b")

    # ---- sources: every claim, plus the stored rows --------------------------------------
    src = rows.select("ip", "t", "o", "name", "b", F.lit(False).alias("is_seed"))
    if seeds is not None:
        s = seeds.join(rows.select("ip").distinct(), "ip", "left_semi").select(
            "ip", F.col("time_ms").alias("t"), F.lit(None).cast(rows.schema["o"].dataType).alias("o"), "name",
            F.floor(F.col("time_ms") / F.lit(C)).cast("long").alias("b"), F.lit(True).alias("is_seed"))
        src = src.unionByName(s)
    src = src.withColumn("_pid", F.monotonically_increasing_id()).checkpoint()

    # A: g = first row with time > t (same bucket, else the next bucket's first row)
    data_b = rows.select("ip", "b", F.col("t").alias("_t"), "o", pos.alias("g")).withColumnRenamed("o", "_o")
    g_in = asof_next(data_b, src.select("ip", "b", F.col("t").alias("_pt"), "_pid"), ["ip", "b"], "g")
    a = src.join(g_in, "_pid", "left")
    bucket_first = bsum.select("ip", F.col("b").alias("_t"), F.lit(0).cast("long").alias("_o"), F.col("r1").alias("_nr1"))
    # probed once per (ip, bucket): the window per address holds bucket rows, never claims
    buckets = src.select("ip", "b").distinct().select("ip", F.col("b").alias("_pt"), F.struct("ip", "b").alias("_pid"))
    nb_first = asof_next(bucket_first, buckets, ["ip"], "_nr1").select("_pid.ip", "_pid.b", "_nr1")
    a = a.join(nb_first, ["ip", "b"], "left").withColumn("g", F.coalesce(F.col("g"), F.col("_nr1"))).drop("_nr1")
    g_info = nd_in.select("ip", F.struct(F.col("t"), F.col("o")).alias("g"), F.col("name").alias("g_name"),
                          F.col("b").alias("g_b"), "nd_in")
    a = a.join(g_info, ["ip", "g"], "left")
    a = first_diff(a, "g_b", "name", "nd_cross")
    a_ptr = F.when(F.col("g").isNull(), F.lit(None)).when(F.col("g_name") != F.col("name"), F.col("g")).otherwise(
        F.coalesce(F.col("nd_in"), F.col("nd_cross")))
    a = a.select("_pid", a_ptr.alias("diff_next"))

    # B: first same-name row with time > t + cooldown (bucket b + 1, else a later bucket)
    data_n = rows.select("ip", "name", "b", F.col("t").alias("_t"), F.col("o").alias("_o"), pos.alias("same_next"))
    pb = src.select("ip", "name", (F.col("b") + 1).alias("b"), (F.col("t") + F.lit(C)).alias("_pt"), "_pid")
    b_in = asof_next(data_n, pb, ["ip", "name", "b"], "same_next")
    ns = rows.groupBy("ip", "name", "b").agg(F.min(pos).alias("same_next"))
    ns_data = ns.select("ip", "name", F.col("b").alias("_t"), F.lit(0).cast("long").alias("_o"), "same_next")
    name_buckets = src.select("ip", "name", "b").distinct().select(
        "ip", "name", (F.col("b") + 1).alias("_pt"), F.struct("ip", "name", "b").alias("_pid"))
    b_cross = asof_next(ns_data, name_buckets, ["ip", "name"], "same_next").select(
        "_pid.ip", "_pid.name", "_pid.b", F.col("same_next").alias("same_later"))
    same = src.select("_pid", "ip", "name", "b").join(b_in, "_pid", "left").join(b_cross, ["ip", "name", "b"], "left").select(
        "_pid", F.coalesce("same_next", "same_later").alias("same_next"))

    nxt = src.join(a, "_pid", "left").join(same, "_pid", "left").select(
        "ip", "t", "o", "is_seed", F.least(F.col("diff_next"), F.col("same_next")).alias("nxt")).checkpoint()

    # ---- start node per address: next(stored row), or the first claim ---------------------
    # (a stored row from before the claims kept is replaced by the first of these)
    starts = rows.groupBy("ip").agg(F.min(pos).alias("start"))
    since = changes.select("ip", "z").join(gaps, "ip")
    stale = F.coalesce(F.col("t") < F.col("z"), F.lit(False)) | (F.floor(F.col("t") / F.lit(C)).cast("long") < F.col("b0"))
    seeded = nxt.where("is_seed").join(since, "ip").select("ip", F.col("nxt").alias("seed_next"), (~stale).alias("has_seed"))
    starts = starts.join(seeded, "ip", "left").select(
        "ip", F.when(F.col("has_seed"), F.col("seed_next")).otherwise(F.col("start")).alias("start"))

    # ---- pointer jumping over claim nodes ------------------------------------------------
    nodes = nxt.where(~F.col("is_seed")).select(
        "ip", pos.alias("id"), F.col("nxt").alias("ptr"),
        F.when(F.col("nxt").isNull(), pos).alias("end")).checkpoint()
    for _ in range(max_rounds):
        if nodes.where(F.col("end").isNull()).isEmpty():
            break
        look = nodes.select("ip", F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("end").alias("e2"))
        nodes = nodes.join(look, ["ip", "ptr"], "left").select(
            "ip", "id",
            F.when(F.col("end").isNull() & F.col("e2").isNull(), F.col("p2")).otherwise(F.col("ptr")).alias("ptr"),
            F.coalesce(F.col("end"), F.col("e2")).alias("end"),
        ).checkpoint()
    else:
        raise RuntimeError("pointer jumping did not converge")

    ends = starts.where(F.col("start").isNotNull()).join(
        nodes.select("ip", F.col("id").alias("start"), "end"), ["ip", "start"])
    full = kept.select("ip", *PAYLOAD, "time_ms", F.struct(F.col("time_ms").alias("t"), F.col("o")).alias("end"))
    out = ends.join(full, ["ip", "end"]).select(*CLAIM_COLUMNS)
    if seeds is not None:
        unchanged = seeds.join(changes.where("claimed").select("ip"), "ip", "left_semi").join(
            starts.where(F.col("start").isNotNull()).select("ip"), "ip", "left_anti")
        out = out.unionByName(unchanged.select(*CLAIM_COLUMNS))
    return out
