"""Claim admission (Q1): validate, normalise and throttle raw claims.

Checks run in order and the first failing one decides the verdict: bad name (400), missing
address (500), bad address (500), missing time (500: the limiters need one), (address, name)
rate (429), address rate (429), else accepted (200). IPv4 addresses are kept, IPv6 addresses are cut to their /48 network, and the
limiters key on that recorded address. The (address, name) limiter is asked first; the address
limiter only sees the claims the first one let through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import IP_RATE_LIMIT, NAME_MAX_LEN, NAME_RATE_LIMIT, RATE_PERIOD_SECS
from ..functions.addresses import ipv6_prefix48, is_ipv4, is_ipv6
from ..functions.names import valid_name

# fixed values: verdicts (code, HTTP status, message)
VERDICTS = {
    "invalid_name": (400, "invalid name provided"),
    "missing_address": (500, "could not get IP address"),
    "bad_address": (500, "could not get IP address"),
    "missing_time": (500, "could not get time"),
    "name_rate_limited": (429, "name rate limit exceeded"),
    "ip_rate_limited": (429, "IP rate limit exceeded"),
    "accepted": (200, None),
}


def empty_to_null(c: Column | str) -> Column:
    """Empty text becomes null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(col, F.lit(""))


def region_code(country: Column | str, code: Column | str) -> Column:
    """``country-code`` only when both parts are non-empty (``concat_ws`` would skip nulls)."""
    a = F.col(country) if isinstance(country, str) else country
    b = F.col(code) if isinstance(code, str) else code
    both = F.coalesce((F.length(a) > 0) & (F.length(b) > 0), F.lit(False))
    return F.when(both, F.concat(a, F.lit("-"), b))


def recorded_ip(original_ip: Column | str) -> Column:
    """P5: IPv4 kept as is, IPv6 cut to its /48 network, anything else null."""
    ip = F.col(original_ip) if isinstance(original_ip, str) else original_ip
    return F.when(is_ipv4(ip), ip).when(is_ipv6(ip), ipv6_prefix48(ip))


def normalise(raw: DataFrame, name_max_len: int = NAME_MAX_LEN) -> DataFrame:
    """Static checks and normalisation: adds ``ip`` (recorded address), the normalised geo
    columns and ``_static``, the verdict of the static checks (null when they pass)."""
    staged = raw.withColumn("_orig", F.coalesce(F.col("original_ip"), F.lit(""))).withColumn(
        "ip", recorded_ip("_orig")
    )
    static = (
        F.when(~valid_name("name", name_max_len), F.lit("invalid_name"))
        .when(F.col("_orig") == "", F.lit("missing_address"))
        .when(F.col("ip").isNull(), F.lit("bad_address"))
        .when(F.col("time_ms").isNull(), F.lit("missing_time"))
    )
    return staged.withColumns({
        "country_n": empty_to_null("country"),
        "city_n": empty_to_null("city"),
        "metro_n": empty_to_null("metro"),
        "region_name_n": empty_to_null("region_name"),
        "region": region_code("country", "region_code"),
        "_static": static,
    }).drop("_orig")


def slot_of(period_secs: int) -> Column:
    """Number of the tumbling window a claim falls in."""
    return F.floor(F.col("time_ms") / F.lit(period_secs * 1000))


def within_limit(df: DataFrame, keys: Sequence[str], limit: int, period_secs: int, order: Sequence[str]) -> DataFrame:
    """The first ``limit`` claims per key in each tumbling ``period_secs`` window.

    Rows with the same key and order are one claim delivered more than once: they pass or fail
    together and count once. The rank is planned with a window group limit: every map task
    keeps at most ``limit`` claims per (key, window) before the shuffle, so a hot key stays small.
    """
    w = Window.partitionBy(*[F.col(k) for k in keys], slot_of(period_secs)).orderBy(*[F.col(c) for c in order])
    return df.withColumn("_rn", F.dense_rank().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def admit(
    raw: DataFrame,
    name_limit: int = NAME_RATE_LIMIT,
    ip_limit: int = IP_RATE_LIMIT,
    period_secs: int = RATE_PERIOD_SECS,
    order: Sequence[str] = ("time_ms", "seq"),
    name_max_len: int = NAME_MAX_LEN,
) -> DataFrame:
    """Q1: every raw claim with ``verdict``, ``status``, ``error`` and its CLAIM projection.

    ``order`` orders the claims inside a limiter window (its other columns may be null, which sorts
    first). Each limiter leaves one small row per key and window, the order of its last admitted
    claim; a claim passed if it comes no later, so rows are never joined with rows.
    """
    base = normalise(raw, name_max_len).withColumns({
        "_slot": slot_of(period_secs), "_order": F.struct(*[F.col(c) for c in order])})
    ok = base.where(F.col("_static").isNull()).select("ip", "name", "_slot", "_order", *order)
    passed1 = within_limit(ok, ["ip", "name"], name_limit, period_secs, order)
    cut1 = passed1.groupBy("ip", "name", "_slot").agg(F.max("_order").alias("_cut1"))
    cut2 = within_limit(passed1, ["ip"], ip_limit, period_secs, order).groupBy("ip", "_slot").agg(F.max("_order").alias("_cut2"))
    flags = base.join(cut1, ["ip", "name", "_slot"], "left").join(cut2, ["ip", "_slot"], "left")
    verdict = (
        F.when(F.col("_static").isNotNull(), F.col("_static"))
        .when(F.col("_cut1").isNull() | (F.col("_order") > F.col("_cut1")), F.lit("name_rate_limited"))
        .when(F.col("_cut2").isNull() | (F.col("_order") > F.col("_cut2")), F.lit("ip_rate_limited"))
        .otherwise(F.lit("accepted"))
    )
    out = flags.withColumn("_verdict", verdict)
    http = None
    msg = None
    for code, (h, m) in VERDICTS.items():
        cond = F.col("_verdict") == code
        http = F.when(cond, F.lit(h)) if http is None else http.when(cond, F.lit(h))
        msg = F.when(cond, F.lit(m)) if msg is None else msg.when(cond, F.lit(m))
    return out.select(
        *[F.col(c) for c in raw.columns],
        F.when(F.col("_static").isNull(), F.col("ip")).alias("ip"),
        F.col("region").alias("region"),
        F.col("country_n").alias("country_norm"),
        F.col("city_n").alias("city_norm"),
        F.col("metro_n").alias("metro_norm"),
        F.col("region_name_n").alias("region_name_norm"),
        F.col("_verdict").alias("verdict"),
        http.cast("int").alias("status"),
        msg.alias("error"),
        (F.col("_verdict") == "accepted").alias("accepted"),
    )


def to_claims(admitted: DataFrame) -> DataFrame:
    """Accepted claims projected to the nine CLAIM columns (``recordedIp`` becomes ``ip``)."""
    return admitted.where(F.col("accepted")).select(
        "ip", "name", F.col("asn").cast("long").alias("asn"), "colo",
        F.col("country_norm").alias("country"), "region",
        F.col("metro_norm").alias("metro"), F.col("city_norm").alias("city"), "time_ms",
    )
