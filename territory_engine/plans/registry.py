"""Registered queries over the shared test tables, each with its DuckDB oracle SQL.

Every query reads whole tables (no id subsets, no row caps other than a top-k that is the
feature itself) and runs the library's own operators on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import COOLDOWN_MS
from ..functions.clock import as_of_latest
from ..operators import claims as C
from ..operators import rankings as R
from ..sources import testdata as TD
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _state(spark: SparkSession, sf_dir: str, coarse: bool = False, cooldown_ms: int = COOLDOWN_MS):
    claims = TD.load_coarse_claims(spark, sf_dir) if coarse else TD.load_claims(spark, sf_dir)
    return claims, C.fold_claims(claims, cooldown_ms=cooldown_ms)


# ---------------------------------------------------------------- claims state -----------
@register("claims_fold", O.base() + "SELECT * FROM state")
def claims_fold(spark, sf_dir):
    """Full fold of all claims into one row per address (15 min cooldown)."""
    return _state(spark, sf_dir)[1]


@register("claims_fold_coarse", O.with_ctes(O.claims_cte(coarse=True), O.fold_cte()) + "SELECT * FROM state")
def claims_fold_coarse(spark, sf_dir):
    """J8 on long per-key histories: key ``user_id``, name ``event_type``, 15 min cooldown."""
    return _state(spark, sf_dir, coarse=True)[1]


@register("claims_fold_hot_path", O.with_ctes(O.claims_cte(coarse=True), O.fold_cte()) + "SELECT * FROM state")
def claims_fold_hot_path(spark, sf_dir):
    """J8 with every key above 50 claims folded by the hot-key path (buckets + pointer jumping)."""
    claims = TD.load_coarse_claims(spark, sf_dir)
    return C.fold_claims(claims, hot_threshold=50)


@register("claims_fold_hot_path_repeats", O.with_ctes(O.claims_cte(coarse=True), O.fold_cte()) + "SELECT * FROM state")
def claims_fold_hot_path_repeats(spark, sf_dir):
    """J8 by the hot-key path with every claim delivered twice: the same state as once."""
    claims = TD.load_coarse_claims(spark, sf_dir)
    return C.fold_claims(claims.unionAll(claims), hot_threshold=50)


@register("batch_files_round_trip", O.base() + "SELECT * FROM state")
def batch_files_round_trip(spark, sf_dir):
    """S6 + S1 + S2 + J8: all events packed into envelope files, read back with the defaults (many
    objects a file) and folded in time order."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sinks.publish import claim_envelopes, write_text
    from ..sources.batches import BATCH_ORDER, quarantine, read_batch_files, staged, unwrap
    path = f"{ensure_checkpoint_dir(spark)}/envelopes-{uuid.uuid4().hex}"
    write_text(claim_envelopes(TD.load_claims(spark, sf_dir)), "value", path)
    claims = staged(unwrap(quarantine(read_batch_files(spark, path))[0]), f"{path}-claims")
    return C.fold_claims(claims, order=BATCH_ORDER)


@register("batch_files_deep_keys", O.base() + "SELECT * FROM state")
def batch_files_deep_keys(spark, sf_dir):
    """S1 + S3: the same files, each object with unknown keys nested a hundred levels deep and brackets in a
    string, and an unfinished copy of each object beside it: the copies are set aside, every claim is read."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sinks.publish import claim_envelopes, write_text
    from ..sources.batches import BATCH_ORDER, quarantine, read_batch_files, staged, unwrap
    path = f"{ensure_checkpoint_dir(spark)}/envelopes-{uuid.uuid4().hex}"
    deep = F.lit('{"note": "]}{[ \\\\" \\\\\\\\", "deep": ' + '[{"a": ' * 50 + "0" + "}]" * 50 + ", ")
    objects = claim_envelopes(TD.load_claims(spark, sf_dir)).select(F.regexp_replace("value", r"^\{", deep).alias("value"))
    torn = objects.select(F.expr("substring(value, 1, length(value) - 2)").alias("value"))
    write_text(objects, "value", f"{path}/whole")
    write_text(torn, "value", f"{path}/torn")
    good, bad = quarantine(read_batch_files(spark, f"{path}/*"))
    return C.fold_claims(staged(unwrap(good), f"{path}-claims"), order=BATCH_ORDER)


@register("stream_fold_from_state", O.base() + "SELECT * FROM state")
def stream_fold_from_state(spark, sf_dir):
    """T2 + S7: the earlier half of the claims as a stored state version, the later half streamed into the keyed
    state store that starts from it."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.state import read_state, write_state
    from ..streaming.stateful import fold_stream_from, use_rocksdb
    use_rocksdb(spark)
    path = f"{ensure_checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}"
    claims = TD.load_claims(spark, sf_dir)
    middle = claims.select(F.percentile_approx("time_ms", 0.5)).scalar()
    write_state(C.fold_claims(claims.where(F.col("time_ms") < middle)), f"{path}/state", 0)
    claims.where(F.col("time_ms") >= middle).write.parquet(f"{path}/claims")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in claims.schema.fields)
    return fold_stream_from(spark, read_state(spark, f"{path}/state"), f"{path}/claims", schema, f"{path}/checkpoint", f"{path}/out")


@register("snapshot_in_splits", O.base() + """
  SELECT ip, name, NULL::BIGINT AS asn, colo, country, region, NULL::VARCHAR AS metro, NULL::VARCHAR AS city, time_ms FROM state""")
def snapshot_in_splits(spark, sf_dir):
    """The folded state written as one-line snapshot documents of about ten thousand rows and read back in splits."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sinks.publish import write_text
    from ..sources.state import read_snapshot
    _, state = _state(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    row = F.struct("ip", "name", "colo", "country", "region", (F.col("time_ms") / F.lit(1000.0)).alias("timestamp"))
    documents = F.greatest(F.ceil(state.select(F.count("*") / 10_000).scalar()), F.lit(1))
    document = F.to_json(F.struct(F.max(F.col("time_ms") / F.lit(1000.0)).alias("latestClaim"), F.collect_list(row).alias("values")))
    write_text(state.groupBy(F.pmod(F.xxhash64("ip"), documents).alias("d")).agg(document.alias("value")), "value", path)
    return read_snapshot(spark, path)[0]


@register("claims_fold_long_cooldown",
          O.with_ctes(O.claims_cte(coarse=True), O.fold_cte(cooldown_ms=12 * 3600 * 1000)) + "SELECT * FROM state")
def claims_fold_long_cooldown(spark, sf_dir):
    """J8 with a 12 h cooldown on the coarse key (differs from last-write-wins on many keys)."""
    return _state(spark, sf_dir, coarse=True, cooldown_ms=12 * 3600 * 1000)[1]


# ---------------------------------------------------------------- rankings ---------------
@register("leaderboard_colo_weekly", O.base() + O.leaderboard_sql("colo", "weekly"))
def leaderboard_colo_weekly(spark, sf_dir):
    """Q3 for one ranking: facilities, last 7 days (strict cut), reference shape."""
    claims, state = _state(spark, sf_dir)
    return R.leaderboard(state, "colo", "weekly", as_of_latest(claims))


@register("leaderboards_all", O.base() + O.all_leaderboards_sql())
def leaderboards_all(spark, sf_dir):
    """A3: all fifteen rankings in one pass over the state."""
    claims, state = _state(spark, sf_dir)
    return R.leaderboards(state, as_of_latest(claims))


# ---------------------------------------------------------------- more rankings ----------
@register("leaderboards_windowed", O.base() + O.all_leaderboards_sql())
def leaderboards_windowed(spark, sf_dir):
    """T4: the same fifteen rankings kept up over four polls in time order, the second part late; the last poll moves the
    clock on to the latest claim, so claims leave their windows on the way."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.windows import WindowedRankings
    path = f"{ensure_checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    claims = TD.load_claims(spark, sf_dir)
    cuts = claims.select(F.percentile_approx("time_ms", [0.25, 0.5, 0.9, 1.0])).scalar()
    low, early, late, last = claims.select(cuts).first()[0]
    job = WindowedRankings(spark, path, buckets=8, slot_ms=5 * 86_400_000)
    t = F.col("time_ms")
    for version, (part, as_of) in enumerate([(t <= low, low), ((t > early) & (t <= late), late), ((t > low) & (t <= early), late), (t > late, last)]):
        board = job.poll(claims.where(part), version, as_of)
    return board


@register("leaderboards_fifteen_pass", O.base() + O.all_leaderboards_sql())
def leaderboards_fifteen_pass(spark, sf_dir):
    """The fifteen rankings as fifteen separate plans (reference shape) for the one-pass check."""
    claims, state = _state(spark, sf_dir)
    return R.leaderboards_separate(state, as_of_latest(claims))


@register("leaderboard_top10", O.base() + "SELECT * FROM (" + O.all_leaderboards_sql() + ") WHERE rank <= 10")
def leaderboard_top10(spark, sf_dir):
    """The first ten rows of every ranking."""
    claims, state = _state(spark, sf_dir)
    return R.top_rows(R.leaderboards(state, as_of_latest(claims)), 10)


_WINNERS_SQL = "\nUNION ALL\n".join(
    f"""SELECT territory_type, time_window, territory, name, count, latest FROM (
      SELECT *, row_number() OVER (PARTITION BY territory_type, time_window, territory
                                   ORDER BY count DESC, latest DESC, name) AS rn
      FROM (SELECT '{t}' AS territory_type, '{w}' AS time_window, {t} AS territory, name,
                   count(*) AS count, max(time_ms) AS latest
            FROM state WHERE {t} IS NOT NULL AND {O.window_pred('time_ms', w)} GROUP BY 1, 2, 3, 4))
    WHERE rn = 1"""
    for t in ("colo", "region", "country") for w in ("hourly", "daily", "weekly", "monthly", "all-time")
)


@register("territory_winners", O.base() + _WINNERS_SQL)
def territory_winners(spark, sf_dir):
    """One winner per territory for every type and window (aggregate form, skew-safe)."""
    claims, state = _state(spark, sf_dir)
    part = ["territory_type", "time_window"]
    return R.winners_by_min(R.window_counts(state, as_of_latest(claims)), part).select(
        "territory_type", "time_window", "territory", "name", "count", "latest")


@register("recents_masked", O.base() + """
  SELECT name, country, region, colo, time_ms,
         CASE WHEN regexp_full_match(ip, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')
              THEN string_split(ip, '.')[1] || '.x.x.x' ELSE ip END AS ip
  FROM (SELECT * FROM state WHERE time_ms > (SELECT now_ms FROM clock) - 86400000
        ORDER BY time_ms DESC, ip LIMIT 100)""")
def recents_masked(spark, sf_dir):
    """Q4: last 24 h, newest 100, IPv4 masked to its first octet."""
    claims, state = _state(spark, sf_dir)
    return R.recents(state, as_of_latest(claims))


@register("public_claims", O.base() + "SELECT name, country, region, colo, time_ms FROM state ORDER BY time_ms DESC")
def public_claims(spark, sf_dir):
    """Q5: the public dump of all stored claims, newest first."""
    return R.public_claims(_state(spark, sf_dir)[1])


# ---------------------------------------------------------------- drill-down views -------
from ..operators import views as V  # noqa: E402

_UNIT, _VALUE = O.relative_age_sql("latest")
_CONTENDERS_SQL = f"""
  SELECT territory_type, territory, name, count, latest,
         CAST(row_number() OVER (PARTITION BY territory_type, territory ORDER BY count DESC, latest DESC, name) AS BIGINT) AS rank,
         {_UNIT} AS latest_unit, {_VALUE} AS latest_value
  FROM ({O.contenders_sql('weekly', inclusive=True)})"""


@register("territory_contenders", O.base() + _CONTENDERS_SQL)
def territory_contenders(spark, sf_dir):
    """A4 + W2 + F4/F5: every territory's contenders (weekly, inclusive), ranked, with ages."""
    claims, state = _state(spark, sf_dir)
    return V.contenders(state, "weekly", as_of_latest(claims))


@register("territory_view", O.base() + f"""
  SELECT c.*, t.total_ips FROM ({_CONTENDERS_SQL}) c
  JOIN (SELECT territory_type, territory, CAST(sum(count) AS BIGINT) AS total_ips
        FROM ({O.contenders_sql('weekly', inclusive=True)}) GROUP BY 1, 2) t
  USING (territory_type, territory)""")
def territory_view(spark, sf_dir):
    """Q6 for every territory at once: ranked contenders plus the territory's total IPs."""
    claims, state = _state(spark, sf_dir)
    return V.territory_view_with_total(V.contenders(state, "weekly", as_of_latest(claims)))


@register("user_view", O.base() + f"""
  SELECT name, territory_type, territory, rank, count AS ips, latest_unit, latest_value
  FROM ({_CONTENDERS_SQL.replace("'weekly'", "'monthly'")})""".replace(
    O.window_pred('time_ms', 'weekly', True), O.window_pred('time_ms', 'monthly', True)))
def user_view(spark, sf_dir):
    """Q7 for every name at once: its rank, IPs and latest age in each territory (monthly)."""
    claims, state = _state(spark, sf_dir)
    return V.user_ranks(V.contenders(state, "monthly", as_of_latest(claims)))


@register("territory_page", O.base() + f"""
  SELECT * FROM ({_CONTENDERS_SQL}) WHERE territory_type = 'colo' AND territory = 'C05'""")
def territory_page(spark, sf_dir):
    """Q6 for one territory: its filter reaches the scan, its rank is the explicit position."""
    claims, state = _state(spark, sf_dir)
    return V.territory_view(state, "C05", "weekly", as_of_latest(claims))


@register("territory_slice", O.base() + f"""
  SELECT c.* FROM ({_CONTENDERS_SQL}) c JOIN ({_CONTENDERS_SQL}) m USING (territory_type, territory)
  WHERE territory_type = 'colo' AND territory = 'C05' AND m.name = 'click-3' AND c.rank > m.rank AND c.rank <= m.rank + 10""")
def territory_slice(spark, sf_dir):
    """Q6 page by page: the ten contenders of one territory that follow a name, ranks counted."""
    claims, state = _state(spark, sf_dir)
    return V.territory_slice(state, "C05", "weekly", as_of_latest(claims), 10, "click-3")


@register("user_page", O.base() + f"""
  SELECT name, territory_type, territory, rank, count AS ips, latest_unit, latest_value,
         CAST(row_number() OVER (ORDER BY rank DESC, count DESC, territory, territory_type) AS BIGINT) AS position
  FROM ({_CONTENDERS_SQL.replace("'weekly'", "'monthly'")}) WHERE name = 'click-3'""".replace(
    O.window_pred('time_ms', 'weekly', True), O.window_pred('time_ms', 'monthly', True)))
def user_page(spark, sf_dir):
    """Q7 + O5 for one name: its ranks, worst first, with their position in that order."""
    claims, state = _state(spark, sf_dir)
    page = V.user_view(state, "click-3", "monthly", as_of_latest(claims))
    order = Window.partitionBy("name").orderBy(F.desc("rank"), F.desc("ips"), F.asc("territory"), F.asc("territory_type"))
    return page.withColumn("position", F.row_number().over(order).cast("long"))


@register("dump_positions", O.base() + """
  SELECT name, country, region, colo, time_ms, CAST(rank() OVER (ORDER BY time_ms DESC) AS BIGINT) AS position FROM state""")
def dump_positions(spark, sf_dir):
    """O3 + O9: each row's position in the public dump, newest first, numbered in the written order."""
    from ..operators.incremental import newest_first
    from ..plans.ranking import position_spread
    dump = R.public_claims(newest_first(_state(spark, sf_dir)[1]))
    return position_spread(dump, "time_ms").select("name", "country", "region", "colo", "time_ms", "position")


@register("user_total_ips", O.base() + f"""
  SELECT name, CAST(sum(count) AS BIGINT) AS total_ips
  FROM ({O.contenders_sql('all-time', inclusive=True)}) WHERE territory_type = 'colo' GROUP BY name""")
def user_total_ips(spark, sf_dir):
    """A5: a name's total IPs over its facility ranks (all-time)."""
    claims, state = _state(spark, sf_dir)
    return V.user_total_ips(V.contenders(state, "all-time", as_of_latest(claims)))


@register("relative_age", O.base() + "SELECT ip, time_ms, {u} AS unit, {v} AS value FROM state".format(
    u=O.relative_age_sql("time_ms")[0], v=O.relative_age_sql("time_ms")[1]))
def relative_age(spark, sf_dir):
    """F4 + F5: relative age unit and signed count of every stored claim."""
    from ..functions.clock import relative_age as rel
    claims, state = _state(spark, sf_dir)
    state = state.withColumn("_now", as_of_latest(claims))
    unit, value = rel("time_ms", F.col("_now"))
    return state.select("ip", "time_ms", unit.alias("unit"), value.alias("value"))


@register("recent_age", O.base() + """
  SELECT ip, time_ms,
    CASE WHEN age < 120000 THEN 'second' WHEN age < 3600000 THEN 'minute' ELSE 'hour' END AS unit,
    CAST(-(CASE WHEN age < 120000 THEN floor(age / 1000.0 + 0.5)
              WHEN age < 3600000 THEN floor(age / 1000.0 / 60.0 + 0.5)
              ELSE floor(age / 1000.0 / 60.0 / 60.0 + 0.5) END) AS BIGINT) AS value
  FROM (SELECT *, CAST((SELECT now_ms FROM clock) - time_ms AS DOUBLE) AS age FROM state)""")
def recent_age(spark, sf_dir):
    """recents age in seconds, minutes or hours."""
    from ..functions.clock import recent_age as rec
    claims, state = _state(spark, sf_dir)
    state = state.withColumn("_now", as_of_latest(claims))
    unit, value = rec("time_ms", F.col("_now"))
    return state.select("ip", "time_ms", unit.alias("unit"), value.alias("value"))


@register("territory_type_of_id", O.base() + """
  SELECT territory, CASE WHEN length(territory) = 2 THEN 'country' WHEN length(territory) = 3 THEN 'colo'
                         ELSE 'region' END AS territory_type
  FROM (SELECT colo AS territory FROM state UNION SELECT region FROM state UNION SELECT country FROM state)
  WHERE territory IS NOT NULL""")
def territory_type_of_id(spark, sf_dir):
    """Territory type of every territory id present in the state."""
    from ..functions.labels import territory_type_of_id as ttype
    state = _state(spark, sf_dir)[1]
    ids = (state.select(F.col("colo").alias("territory")).union(state.select("region")).union(state.select("country"))
           .where(F.col("territory").isNotNull()).distinct())
    return ids.select("territory", ttype("territory").alias("territory_type"))


@register("name_colour", O.base() + """
  SELECT name,
    '#' || lpad(upper(hex(list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)),
                                      lambda h, c: (h * 31 + c) % 16777216, CAST(0 AS BIGINT)))), 6, '0') AS fill,
    '#' || lpad(upper(hex(list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)),
                                      lambda h, c: (h * 255 + c) % 16777216, CAST(0 AS BIGINT)))), 6, '0') AS stroke
  FROM (SELECT DISTINCT name FROM state)""")
def name_colour(spark, sf_dir):
    """fill and stroke colour of every claimant name."""
    from ..functions.names import name_colour as colour
    names = _state(spark, sf_dir)[1].select("name").distinct()
    return names.select("name", colour("name", 5).alias("fill"), colour("name", 8).alias("stroke"))


# ---------------------------------------------------------------- admission --------------
from ..operators import admission as A  # noqa: E402

_ADMIT_COLS = ["seq", "ip", "name", "region", "country_norm", "city_norm", "verdict", "status"]


@register("admission_verdict", O.admission_sql(10, 20, 10))
def admission_verdict(spark, sf_dir):
    """Q1: verdict of every raw claim (names, address forms, default limits 10 / 20 per 10 s)."""
    raw = TD.raw_claims_from_events(TD.read_table(spark, sf_dir, "events"))
    return A.admit(raw).select(*_ADMIT_COLS)


_REPEATED = """repeated AS (
  SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE seq % 5 = 0
  UNION ALL SELECT * REPLACE (CAST(NULL AS BIGINT) AS time_ms) FROM raw WHERE seq % 7 = 0)"""


@register("admission_repeats", O.admission_sql(10, 20, 10, source="repeated", extra=(_REPEATED,)))
def admission_repeats(spark, sf_dir):
    """Q1 with some claims delivered twice and some without a time."""
    raw = TD.raw_claims_from_events(TD.read_table(spark, sf_dir, "events"))
    untimed = raw.where(F.col("seq") % 7 == 0).withColumn("time_ms", F.lit(None).cast("long"))
    return A.admit(raw.unionAll(raw.where(F.col("seq") % 5 == 0)).unionAll(untimed)).select(*_ADMIT_COLS)


@register("admitted_claims", "SELECT ip, name, asn, colo, country_norm AS country, region, metro_norm AS metro, city_norm AS city, time_ms FROM ("
          + O.admission_sql(10, 20, 10).replace("SELECT b.seq,", "SELECT b.seq, b.asn, b.colo, b.time_ms, nullif(b.metro, '') AS metro_norm,")
          + ") WHERE verdict = 'accepted'")
def admitted_claims(spark, sf_dir):
    """The accepted claims as the nine columns of the state."""
    return A.to_claims(A.admit(TD.raw_claims_from_events(TD.read_table(spark, sf_dir, "events"))))


@register("rate_limited", O.admission_sql(1, 2, 86400, per_user=True))
def rate_limited(spark, sf_dir):
    """(address, name) limit 1 then address limit 2 per one-day window, one address per user."""
    raw = TD.per_user_raw_claims(TD.read_table(spark, sf_dir, "events"))
    return A.admit(raw, name_limit=1, ip_limit=2, period_secs=86400).select(*_ADMIT_COLS)


@register("name_validity", f"SELECT page_id, url, {O.name_valid_sql('url')} AS valid FROM pages")
def name_validity(spark, sf_dir):
    """Name check over every page URL (length 1..40, allowed characters only)."""
    from ..functions.names import valid_name
    pages = TD.read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", valid_name("url").alias("valid"))


@register("ipv6_prefix48", O.with_ctes(O.raw_claims_cte()) + f"""
  SELECT seq, original_ip, {O.ipv6_prefix_sql('original_ip')} AS prefix48
  FROM raw WHERE {O.ipv6_valid_sql('original_ip')}""")
def ipv6_prefix48(spark, sf_dir):
    """/48 network of every IPv6 address text among the raw claims."""
    from ..functions.addresses import ipv6_prefix48 as p48, is_ipv6
    raw = TD.raw_claims_from_events(TD.read_table(spark, sf_dir, "events"))
    return raw.where(is_ipv6("original_ip")).select("seq", "original_ip", p48("original_ip").alias("prefix48"))


@register("ipv6_mixed_notation", O.with_ctes(O.raw_claims_cte()) + f"""
  SELECT seq, true AS valid, {O.ipv6_prefix_sql('original_ip')} AS prefix48
  FROM raw WHERE {O.ipv6_valid_sql('original_ip')}""")
def ipv6_mixed_notation(spark, sf_dir):
    """F2 + P5: the same addresses with their last two groups written as a dotted quad give the same networks."""
    from ..functions.addresses import ipv6_groups, is_ipv6
    from ..functions.addresses import ipv6_prefix48 as p48
    raw = TD.raw_claims_from_events(TD.read_table(spark, sf_dir, "events")).where(is_ipv6("original_ip"))
    groups = ipv6_groups("original_ip")
    quad = F.transform(F.slice(groups, 7, 2), lambda g: F.concat_ws(".", F.floor(F.conv(g, 16, 10).cast("int") / 256), F.conv(g, 16, 10).cast("int") % 256))
    mixed = raw.select("seq", F.concat(F.array_join(F.slice(groups, 1, 6), ":"), F.lit(":"), F.array_join(quad, ".")).alias("ip"))
    return mixed.select("seq", is_ipv6("ip").alias("valid"), p48("ip").alias("prefix48"))


@register("empty_to_null_region", O.with_ctes(O.raw_claims_cte()) + """
  SELECT seq, nullif(country, '') AS country, nullif(city, '') AS city, nullif(metro, '') AS metro,
         nullif(region_name, '') AS region_name,
         CASE WHEN length(country) > 0 AND length(region_code) > 0 THEN country || '-' || region_code END AS region
  FROM raw""")
def empty_to_null_region(spark, sf_dir):
    """P3 + P4: empty geo fields become null; region code only when country and code are set."""
    raw = TD.raw_claims_from_events(TD.read_table(spark, sf_dir, "events"))
    return raw.select(
        "seq", A.empty_to_null("country").alias("country"), A.empty_to_null("city").alias("city"),
        A.empty_to_null("metro").alias("metro"), A.empty_to_null("region_name").alias("region_name"),
        A.region_code("country", "region_code").alias("region"),
    )


# ---------------------------------------------------------------- cells and facilities ---
from ..operators import geo as G  # noqa: E402

_GEO_CTES = O.with_ctes(
    "land AS (SELECT c_custkey AS land_id, (c_custkey // 90 % 180) * 90 + c_custkey % 90 AS cell FROM customer)",
    "seeds AS (SELECT s_suppkey AS seed_id, ((s_suppkey * 17) % 45) * 90 + (s_suppkey * 37) % 90 AS cell FROM supplier)",
    """pairs AS (SELECT l.cell, s.seed_id,
         greatest(least(abs(l.cell % 90 - s.cell % 90), 90 - abs(l.cell % 90 - s.cell % 90)),
                  abs(l.cell // 90 - s.cell // 90)) AS distance
       FROM (SELECT DISTINCT cell FROM land) l CROSS JOIN seeds s)""",
    """nearest AS (SELECT cell, seed_id, distance FROM (
         SELECT *, row_number() OVER (PARTITION BY cell ORDER BY distance, seed_id) AS rn FROM pairs) WHERE rn = 1)""",
)


def _geo(spark, sf_dir):
    land = TD.land_cells(TD.read_table(spark, sf_dir, "customer"))
    seeds = TD.facility_seeds(TD.read_table(spark, sf_dir, "supplier"))
    return land, seeds, TD.test_grid()


@register("nearest_seed", _GEO_CTES + "SELECT * FROM nearest")
def nearest_seed(spark, sf_dir):
    """Every land cell's facility by smallest (hop distance, id), by row decomposition."""
    land, seeds, grid = _geo(spark, sf_dir)
    return G.nearest_seed(land, seeds, grid)


@register("frontier_assign", _GEO_CTES + "SELECT * FROM nearest")
def frontier_assign(spark, sf_dir):
    """The flood fill ring by ring from every facility, then cut to land."""
    land, seeds, grid = _geo(spark, sf_dir)
    return G.keep_land(G.frontier_assign(seeds, grid, land=land), land)


@register("catalogue_gate", _GEO_CTES + """
  SELECT s.seed_id, s.cell, CAST(coalesce(m.n, 0) AS BIGINT) AS land_matches
  FROM seeds s LEFT JOIN (SELECT cell, count(*) AS n FROM land GROUP BY cell) m USING (cell)
  WHERE coalesce(m.n, 0) <> 1""")
def catalogue_gate(spark, sf_dir):
    """Facilities whose cell is not exactly one land cell (empty = the gate passes)."""
    land, seeds, _ = _geo(spark, sf_dir)
    return G.facility_gate(land, seeds)


@register("land_semi", _GEO_CTES + "SELECT seed_id, cell FROM seeds WHERE cell IN (SELECT cell FROM land)")
def land_semi(spark, sf_dir):
    """Facilities that sit on a land cell."""
    land, seeds, _ = _geo(spark, sf_dir)
    return seeds.join(land.select("cell"), "cell", "left_semi").select("seed_id", "cell")


@register("cell_neighbours", _GEO_CTES + """
  SELECT cell, neighbour FROM (
    SELECT l.cell, (l.cell // 90 + o.dr) * 90 + ((l.cell % 90 + o.dc + 90) % 90) AS neighbour, l.cell // 90 + o.dr AS r
    FROM (SELECT DISTINCT cell FROM land) l,
         (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dr, dc)) o)
  WHERE r >= 0 AND r < 180""")
def cell_neighbours(spark, sf_dir):
    """ring-1 neighbours of every land cell (longitude wraps, rows clipped)."""
    land, _, grid = _geo(spark, sf_dir)
    return land.select("cell").distinct().select("cell", F.explode(grid.neighbours("cell")).alias("neighbour"))


@register("cell_of_point", """
  SELECT c_custkey, lat, lon,
         CAST(least(greatest(floor((lat + 90.0) / 1.0), 0), 179) * 90
              + ((CAST(floor((lon + 180.0) / 4.0) AS BIGINT) % 90) + 90) % 90 AS BIGINT) AS cell
  FROM (SELECT c_custkey, ((CAST(c_custkey AS DOUBLE) * CAST(0.0123 AS DOUBLE)) % CAST(180 AS DOUBLE)) - CAST(90 AS DOUBLE) AS lat,
               ((c_acctbal * CAST(37 AS DOUBLE)) % CAST(360 AS DOUBLE)) - CAST(180 AS DOUBLE) AS lon FROM customer)""")
def cell_of_point(spark, sf_dir):
    """cell of a latitude/longitude point on the test grid."""
    _, _, grid = _geo(spark, sf_dir)
    cust = TD.read_table(spark, sf_dir, "customer")
    pts = cust.select(
        "c_custkey",
        ((F.col("c_custkey").cast("double") * F.lit(0.0123)) % F.lit(180.0) - F.lit(90.0)).alias("lat"),
        ((F.col("c_acctbal") * F.lit(37.0)) % F.lit(360.0) - F.lit(180.0)).alias("lon"),
    )
    return pts.select("c_custkey", "lat", "lon", grid.cell_of_point("lat", "lon").alias("cell"))


_TERRITORY_BOUNDS = """
  territory_bounds AS (
    SELECT seed_id, min(-180.0::DOUBLE + (cell % 90) * 4.0::DOUBLE) AS minx,
           min(-90.0::DOUBLE + (cell // 90) * 1.0::DOUBLE) AS miny,
           max(-180.0::DOUBLE + (cell % 90) * 4.0::DOUBLE + 4.0::DOUBLE) AS maxx,
           max(-90.0::DOUBLE + (cell // 90) * 1.0::DOUBLE + 1.0::DOUBLE) AS maxy
    FROM nearest GROUP BY seed_id)"""


@register("bbox_center", _GEO_CTES.rstrip() + "," + _TERRITORY_BOUNDS + """
  SELECT seed_id, minx, miny, maxx, maxy, (minx + maxx) / 2.0::DOUBLE AS center_x, (miny + maxy) / 2.0::DOUBLE AS center_y
  FROM territory_bounds""")
def bbox_center(spark, sf_dir):
    """A12 + A13 + F14: bounding box and box centre of every facility's land territory."""
    land, seeds, grid = _geo(spark, sf_dir)
    assigned = G.nearest_seed(land, seeds, grid)
    polys = assigned.select("seed_id", grid.polygon("cell").alias("ring"))
    return G.bounding_box(polys, "ring", ["seed_id"])


@register("antimeridian_filter", _GEO_CTES.rstrip() + "," + _TERRITORY_BOUNDS + """
  SELECT seed_id FROM territory_bounds WHERE NOT (minx <= -179.0::DOUBLE AND maxx >= 179.0::DOUBLE)""")
def antimeridian_filter(spark, sf_dir):
    """Facility territories whose bounds do not reach within 1 degree of both -180 and 180."""
    from ..functions.cells import crosses_antimeridian
    land, seeds, grid = _geo(spark, sf_dir)
    assigned = G.nearest_seed(land, seeds, grid)
    crossing = (G.outline_parts(G.dissolve(assigned, grid, "seed_id"))
                .where(crosses_antimeridian(F.flatten(F.flatten("parts")))).select(F.col("key").cast("long").alias("seed_id")))
    return assigned.select("seed_id").distinct().join(crossing, "seed_id", "left_anti")


@register("dissolve_rings", _GEO_CTES.rstrip() + """,
  own AS (SELECT seed_id, cell, cell % 90 AS x, cell // 90 AS y FROM nearest),
  right_of AS (SELECT a.seed_id, a.x, a.y FROM own a JOIN own b ON a.seed_id = b.seed_id AND b.x = a.x + 1 AND b.y = a.y),
  above AS (SELECT a.seed_id, a.x, a.y FROM own a JOIN own b ON a.seed_id = b.seed_id AND b.x = a.x AND b.y = a.y + 1),
  squares AS (SELECT r.seed_id FROM right_of r JOIN right_of t ON r.seed_id = t.seed_id AND t.x = r.x AND t.y = r.y + 1
              JOIN above u ON r.seed_id = u.seed_id AND u.x = r.x AND u.y = r.y
              JOIN above v ON r.seed_id = v.seed_id AND v.x = r.x + 1 AND v.y = r.y)
  SELECT CAST(seed_id AS VARCHAR) AS key, count(*) * 4.0::DOUBLE AS area,
         CAST(4 * count(*) - 2 * coalesce(any_value(pairs), 0) AS BIGINT) AS edges,
         CAST(count(*) - coalesce(any_value(pairs), 0) + coalesce(any_value(n4), 0) AS BIGINT) AS parts_less_holes
  FROM own
  LEFT JOIN (SELECT seed_id, count(*) AS pairs FROM (SELECT seed_id FROM right_of UNION ALL SELECT seed_id FROM above)
             GROUP BY 1) USING (seed_id)
  LEFT JOIN (SELECT seed_id, count(*) AS n4 FROM squares GROUP BY 1) USING (seed_id)
  GROUP BY seed_id""")
def dissolve_rings(spark, sf_dir):
    """The outline of every facility's land territory, summed up by its shape: signed area,
    number of unit edges, and outer rings less holes (the Euler number of the cell set)."""
    land, seeds, grid = _geo(spark, sf_dir)
    rings = G.dissolve(G.nearest_seed(land, seeds, grid), grid, "seed_id")
    return rings.groupBy("key").agg(
        F.sum(G.ring_area("ring")).alias("area"), F.sum(F.size("ring") - 1).cast("long").alias("edges"),
        F.sum(F.when(F.col("is_hole"), -1).otherwise(1)).cast("long").alias("parts_less_holes"))


# ---------------------------------------------------------------- batches and snapshots --
def _split_claims(spark, sf_dir):
    claims = TD.load_claims(spark, sf_dir)
    return claims, [claims.where(F.col("seq") % 3 == i) for i in range(3)]


_SPLIT_CTES = [O.claims_cte(), *[O.claims_cte(name=f"c{i}", where=f"seq % 3 = {i}") for i in range(3)]]


@register("claims_merge_batches", O.with_ctes(
    *_SPLIT_CTES,
    O.fold_cte(source="c0", name="s0"),
    O.fold_cte(source="c1", name="f1", seed="s0"),
    "s1 AS (SELECT * FROM f1 UNION ALL SELECT * FROM s0 WHERE ip NOT IN (SELECT ip FROM c1))",
    O.fold_cte(source="c2", name="f2", seed="s1"),
    "s2 AS (SELECT * FROM f2 UNION ALL SELECT * FROM s1 WHERE ip NOT IN (SELECT ip FROM c2))",
) + "SELECT * FROM s2")
def claims_merge_batches(spark, sf_dir):
    """U4 + J8: all events as three batches upserted one after another into the state.

    Every event lands in exactly one batch (event id mod 3); their times interleave, so the
    later batches carry late claims that the stored rows must settle.
    """
    _, parts = _split_claims(spark, sf_dir)
    state = C.apply_claims(None, parts[0])
    for p in parts[1:]:
        state = C.apply_claims(state, p)
    return state


@register("newest_wins_merge", O.with_ctes(
    *_SPLIT_CTES,
    O.fold_cte(source="(SELECT * FROM claims WHERE seq % 3 <> 2)", name="old"),
    O.fold_cte(source="c2", name="new"),
) + "SELECT * FROM new UNION ALL SELECT * FROM old WHERE ip NOT IN (SELECT ip FROM new)")
def newest_wins_merge(spark, sf_dir):
    """J6 + U3: new rows, then old rows whose address they do not replace (all events: the new
    side folds one of three id-mod-3 batches, the old side the other two)."""
    claims, parts = _split_claims(spark, sf_dir)
    old = C.fold_claims(claims.where(F.col("seq") % 3 != 2))
    new = C.fold_claims(parts[2])
    return C.newest_wins_merge(old, new)


@register("last_run", O.with_ctes(
    O.claims_cte(),
    "lastname AS (SELECT ip, arg_max(name, (time_ms, seq)) AS last_name FROM claims GROUP BY ip)",
    """cut AS (SELECT c.ip, max((c.time_ms, c.seq)) AS k FROM claims c JOIN lastname l USING (ip)
               WHERE c.name <> l.last_name GROUP BY c.ip)""",
) + """SELECT c.* FROM claims c LEFT JOIN cut USING (ip) WHERE cut.k IS NULL OR (c.time_ms, c.seq) > cut.k""")
def last_run(spark, sf_dir):
    """Every address's claims after its last name change."""
    return C.last_run(TD.load_claims(spark, sf_dir))


_INCR_CTES = [
    *_SPLIT_CTES,
    O.fold_cte(source="(SELECT * FROM claims WHERE seq % 3 <> 2)", name="snap"),
    O.fold_cte(),
    O.ASOF_CTE,
    "newrows AS (SELECT * FROM state WHERE time_ms > (SELECT max(time_ms) FROM snap))",
    "merged AS (SELECT * FROM newrows UNION ALL SELECT * FROM snap WHERE ip NOT IN (SELECT ip FROM newrows))",
]
_INCR_COUNTS = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS territory_type, '{w}' AS time_window, {t} AS territory, name, count(*) AS count, "
    f"max(time_ms) AS latest FROM merged WHERE {O.window_pred('time_ms', w)} GROUP BY 1, 2, 3, 4"
    for t in ("colo", "region", "country") for w in ("hourly", "daily", "weekly", "monthly", "all-time")
)


def _incremental(spark, sf_dir):
    from ..operators import incremental as I
    claims = TD.load_claims(spark, sf_dir)
    snap = C.fold_claims(claims.where(F.col("seq") % 3 != 2))
    state = C.fold_claims(claims)
    merged = I.refresh_snapshot(snap, state)
    return I, merged, as_of_latest(claims)


@register("incremental_since", O.with_ctes(*_INCR_CTES) + "SELECT * FROM merged")
def incremental_since(spark, sf_dir):
    """T7 / P11 + J6: a snapshot refreshed with the state rows newer than its watermark (the
    snapshot folds two of three id-mod-3 batches of all events; the source is the full fold)."""
    _, merged, _ = _incremental(spark, sf_dir)
    return merged


@register("incremental_counts", O.with_ctes(*_INCR_CTES) + _INCR_COUNTS)
def incremental_counts(spark, sf_dir):
    """Per (type, window, territory, name) counts on the refreshed snapshot, null territory kept."""
    I, merged, as_of = _incremental(spark, sf_dir)
    return I.incremental_counts(merged, as_of)


@register("scores_by_name_list", O.with_ctes(*_INCR_CTES) + f"""
  SELECT territory_type, time_window, name,
         string_agg(coalesce(territory, 'null') || ':' || CAST(count AS VARCHAR) || ':' || CAST(latest AS VARCHAR), ','
                    ORDER BY territory NULLS FIRST, count, latest) AS scores
  FROM ({_INCR_COUNTS}) GROUP BY 1, 2, 3""")
def scores_by_name_list(spark, sf_dir):
    """Per (type, window, name) the list of [territory, count, latest] (as text)."""
    from ..sinks.publish import score_lists
    I, merged, as_of = _incremental(spark, sf_dir)
    lists = score_lists(I.incremental_counts(merged, as_of))
    text = F.array_join(F.transform("scores", lambda x: F.concat_ws(
        ":", F.coalesce(x["territory"], F.lit("null")), x["count"].cast("string"), x["latest"].cast("string"))), ",")
    return lists.select("territory_type", "time_window", "name", text.alias("scores"))


# ---------------------------------------------------------------- catalogue and boundaries
from ..sources import catalogue as CAT  # noqa: E402


def _extras_sql() -> str:
    rows = ", ".join(f"('{c}', '{city}', {lat}::DOUBLE, {lon}::DOUBLE)" for c, city, lat, lon in CAT.EXTRA_FACILITIES)
    return (f"extras AS (SELECT 'CN' AS country, city, lat, lon, city || ', China' AS name, 'Mainland China' AS region, colo "
            f"FROM (VALUES {rows}) t(colo, city, lat, lon))")


@register("catalogue_override", O.with_ctes(
    """cat AS (
      SELECT substr(n_name, 1, 2) AS country, s_name AS city,
             -90.0::DOUBLE + (((s_suppkey * 17) % 45) + 0.5::DOUBLE) * 1.0::DOUBLE AS lat,
             -180.0::DOUBLE + (((s_suppkey * 37) % 90) + 0.5::DOUBLE) * 4.0::DOUBLE AS lon,
             s_name AS name, n_name AS region, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS colo
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    _extras_sql(),
) + """SELECT *, CAST(least(greatest(floor((lat + 90.0::DOUBLE) / 1.0::DOUBLE), 0), 179) * 90
                  + ((CAST(floor((lon + 180.0::DOUBLE) / 4.0::DOUBLE) AS BIGINT) % 90) + 90) % 90 AS BIGINT) AS cell
       FROM (SELECT * FROM cat WHERE name NOT IN (SELECT name FROM extras) UNION ALL SELECT * FROM extras)""")
def catalogue_override(spark, sf_dir):
    """S13 + S14 + J3 + U1 + F12: catalogue parsed from code-keyed JSON, overridden by the extras."""
    text = TD.catalogue_text(TD.read_table(spark, sf_dir, "supplier"), TD.read_table(spark, sf_dir, "nation"))
    cat = CAT.override_catalogue(CAT.parse_catalogue(text), CAT.extra_facilities(spark))
    return CAT.facility_cells(cat, TD.test_grid()).drop("distance")


def _boundaries(spark, sf_dir, subtype, with_region):
    from ..operators.boundaries import divisions_with_areas
    out = divisions_with_areas(TD.divisions_view(spark, sf_dir), subtype, with_region)
    pts = F.flatten(F.flatten("parts"))
    return out.drop("geometry").withColumns({
        "minx": F.array_min(F.transform(pts, lambda p: p["lon"])),
        "miny": F.array_min(F.transform(pts, lambda p: p["lat"])),
        "maxx": F.array_max(F.transform(pts, lambda p: p["lon"])),
        "maxy": F.array_max(F.transform(pts, lambda p: p["lat"])),
    }).drop("parts")


@register("division_areas", O.with_ctes(*O.DIVISIONS_CTES) + f"""
  SELECT d.id, d.subtype, d.country, d.wikidata, d.names.primary AS primary_name,
         d.sources[1].dataset AS primary_source, a.area_id, {O.AREA_BOUNDS}
  FROM div d JOIN areas a ON a.division_id = d.id WHERE d.subtype = 'country'""")
def division_areas(spark, sf_dir):
    """Q9 (countries): P12 + J1 + F11 + F16 — divisions joined to their areas, WKB decoded."""
    return _boundaries(spark, sf_dir, "country", False)


@register("region_areas", O.with_ctes(*O.DIVISIONS_CTES) + f"""
  SELECT d.id, d.subtype, d.country, d.region, d.wikidata, d.names.primary AS primary_name,
         d.sources[1].dataset AS primary_source, d.hierarchies[1][1].name AS country_primary_name,
         a.area_id, {O.AREA_BOUNDS}
  FROM div d JOIN areas a ON a.division_id = d.id WHERE d.subtype = 'region'""")
def region_areas(spark, sf_dir):
    """Q9 (regions): as countries plus region code and the first hierarchy entry's name."""
    return _boundaries(spark, sf_dir, "region", True)


@register("territory_claimant_map", O.with_ctes(
    O.claims_cte(), O.fold_cte(), O.ASOF_CTE,
    _GEO_CTES[len("WITH "):].rstrip(),
    "board AS (" + O.leaderboard_sql("colo", "weekly") + ")",
    "winners AS (SELECT unnest(string_split(territories, ',')) AS territory, name AS claimant FROM board)",
) + f"""SELECT n.cell, n.seed_id, 'C' || lpad(CAST(n.seed_id % 37 AS VARCHAR), 2, '0') AS colo, w.claimant,
           {O.colour_sql('w.claimant', 31)} AS fill, {O.colour_sql('w.claimant', 255)} AS stroke
    FROM nearest n JOIN winners w ON w.territory = 'C' || lpad(CAST(n.seed_id % 37 AS VARCHAR), 2, '0')""")
def territory_claimant_map(spark, sf_dir):
    """Q8 + J7 + F3: facility-territory features coloured by the weekly facility winner."""
    from ..operators.maps import territory_map
    claims, state = _state(spark, sf_dir)
    board = R.leaderboards(state, as_of_latest(claims))
    land, seeds, grid = _geo(spark, sf_dir)
    features = TD.facility_features(G.nearest_seed(land, seeds, grid))
    return territory_map(features, board, "colo", "weekly").select("cell", "seed_id", "colo", "claimant", "fill", "stroke")


@register("area_cells", O.with_ctes(*O.DIVISIONS_CTES) + O.AREA_CELLS)
def area_cells(spark, sf_dir):
    """Cells whose centre lies inside each division area (WKB with several parts, holes and
    slanted edges decoded, scanline cover)."""
    from ..sources.geojson import decode_wkb
    view = TD.divisions_view(spark, sf_dir)
    areas = decode_wkb(view.where(F.col("type") == "division_area").select(F.col("id").alias("area_id"), "geometry"),
                       "geometry")
    return G.cover_cells(areas, TD.test_grid(), key="area_id")


@register("exclude_pairs", O.with_ctes(
    *[c for c in [_GEO_CTES[len("WITH "):].rstrip()]],
    "listed AS (SELECT cell, seed_id % 3 AS group_no FROM seeds)",
) + "SELECT land_id, cell, group_no FROM (SELECT land_id, cell, land_id % 3 AS group_no FROM land) l "
    "WHERE NOT EXISTS (SELECT 1 FROM listed x WHERE x.cell = l.cell AND x.group_no = l.group_no)")
def exclude_pairs(spark, sf_dir):
    """Land cells without the listed (cell, group) pairs."""
    land, seeds, _ = _geo(spark, sf_dir)
    listed = seeds.select("cell", (F.col("seed_id") % 3).alias("group_no"))
    return G.exclude_pairs(land.withColumn("group_no", F.col("land_id") % 3), listed, ["cell", "group_no"]).select(
        "land_id", "cell", "group_no")


@register("features_of_territory", _GEO_CTES + """
  SELECT cell, seed_id, 'C' || lpad(CAST(seed_id % 37 AS VARCHAR), 2, '0') AS colo FROM nearest WHERE seed_id % 37 = 3""")
def features_of_territory(spark, sf_dir):
    """P16 + P15: the boundary features of one territory, found by its id."""
    from ..operators.maps import features_for
    land, seeds, grid = _geo(spark, sf_dir)
    return features_for(TD.facility_features(G.nearest_seed(land, seeds, grid)), "C03").select("cell", "seed_id", "colo")


@register("display_labels", """
  SELECT n_nationkey, kind AS territory_type,
         CASE kind WHEN 'country' THEN n_name WHEN 'region' THEN n_name || ', ' || r_name ELSE lower(n_name) END AS label,
         CASE WHEN n_nationkey % 3 <> 0 THEN 'https://www.wikidata.org/wiki/Q' || n_nationkey END AS link
  FROM (SELECT *, CASE n_nationkey % 3 WHEN 0 THEN 'country' WHEN 1 THEN 'region' ELSE 'colo' END AS kind
        FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def display_labels(spark, sf_dir):
    """label and knowledge-base link of every territory, by its type."""
    from ..functions.labels import display_label, wikidata_link
    nation, region = TD.read_table(spark, sf_dir, "nation"), TD.read_table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    kind = F.when(key % 3 == 0, "country").when(key % 3 == 1, "region").otherwise("colo")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", kind.alias("territory_type"), "n_name", "r_name",
        F.when(key % 3 != 0, F.concat(F.lit("Q"), key.cast("string"))).alias("wikidata"))
    return rows.select("n_nationkey", "territory_type",
                       display_label("territory_type", "n_name", "r_name", F.lower("n_name")).alias("label"),
                       wikidata_link("wikidata").alias("link"))


@register("dissolve_area", _GEO_CTES + """
  SELECT CAST(seed_id AS VARCHAR) AS key, count(*) * 4.0::DOUBLE AS area FROM nearest GROUP BY seed_id""")
def dissolve_area(spark, sf_dir):
    """A11 check: the signed ring areas of each facility outline sum to its cells' area."""
    land, seeds, grid = _geo(spark, sf_dir)
    rings = G.dissolve(G.nearest_seed(land, seeds, grid), grid, "seed_id")
    return rings.groupBy("key").agg(F.sum(G.ring_area("ring")).alias("area"))


@register("public_claim_rows", O.base() + """
  SELECT '[' || concat_ws(',', coalesce('"' || name || '"', 'null'), coalesce('"' || country || '"', 'null'),
                          coalesce('"' || region || '"', 'null'), coalesce('"' || colo || '"', 'null'),
                          CAST(time_ms AS VARCHAR)) || ']' AS row, time_ms
  FROM state""")
def public_claim_rows(spark, sf_dir):
    """The public dump as positional JSON rows (names are validated, so no escaping differs)."""
    from ..sinks.publish import public_claim_rows as rows
    return rows(R.public_claims(_state(spark, sf_dir)[1]))


@register("leaderboard_document")
def leaderboard_document(spark, sf_dir):
    """The nested document of all fifteen rankings plus recents (one row; bounded inputs)."""
    from ..sinks.publish import leaderboard_document as doc
    claims, state = _state(spark, sf_dir)
    as_of = as_of_latest(claims)
    return doc(R.leaderboards(state, as_of), R.recents(state, as_of))


@register("leaderboard_document_read_back", O.base() + O.all_leaderboards_sql())
def leaderboard_document_read_back(spark, sf_dir):
    """The nested document taken apart again: its rows and their places are the fifteen rankings."""
    from ..sinks.publish import read_leaderboard_document
    return read_leaderboard_document(leaderboard_document(spark, sf_dir))


@register("state_versions_round_trip", O.base() + "SELECT * FROM state")
def state_versions_round_trip(spark, sf_dir):
    """The claims in four spans of time, stored as a full version, a delta, a full version and a delta; read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.state import read_state, write_delta, write_state
    path = f"{ensure_checkpoint_dir(spark)}/versions-{uuid.uuid4().hex}"
    claims = TD.load_claims(spark, sf_dir)
    cuts = claims.select(F.percentile_approx("time_ms", [0.25, 0.5, 0.75])).first()[0]
    columns = None
    for version, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = claims.where((F.lit(True) if low is None else F.col("time_ms") >= low) & (F.lit(True) if high is None else F.col("time_ms") < high))
        stored = read_state(spark, path) if version else None
        if version % 2:
            touched = C.fold_claims(part, stored.join(part.select("ip").distinct(), "ip", "left_semi"))
            write_delta(touched, path, version)
        else:
            folded = C.fold_claims(part, stored) if version == 0 else C.apply_claims(stored, part)
            columns = folded.columns if columns is None else columns
            write_state(folded, path, version)
    return read_state(spark, path).select(*columns)


@register("area_cells_geojson", O.with_ctes(*O.DIVISIONS_CTES) + O.AREA_CELLS)
def area_cells_geojson(spark, sf_dir):
    """S16 + S15 + J9: the division areas written as GeoJSON features, read back and covered."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sinks.publish import geojson_features, write_text
    from ..sources.geojson import decode_wkb, read_feature_lines
    path = f"{ensure_checkpoint_dir(spark)}/areas-{uuid.uuid4().hex}"
    view = TD.divisions_view(spark, sf_dir)
    areas = decode_wkb(view.where(F.col("type") == "division_area").select(F.col("id").alias("area_id"), "geometry"), "geometry")
    write_text(geojson_features(areas, "parts", ["area_id"]), "feature", path)
    read = read_feature_lines(spark, path).select(F.col("properties")["area_id"].cast(view.schema["id"].dataType).alias("area_id"), "parts")
    return G.cover_cells(read, TD.test_grid(), key="area_id")


@register("territory_labels", O.base() + """
  SELECT *, 'https://www.wikidata.org/wiki/Q' || nullif(regexp_extract(territory, '[0-9]+'), '') AS link
  FROM (SELECT DISTINCT 'country' AS territory_type, country AS territory, country AS label FROM state WHERE country IS NOT NULL
        UNION ALL SELECT DISTINCT 'region', region, concat_ws(', ', region, country) FROM state WHERE region IS NOT NULL
        UNION ALL SELECT DISTINCT 'colo', colo, lower(colo) FROM state WHERE colo IS NOT NULL)""")
def territory_labels(spark, sf_dir):
    """label and knowledge-base link of every territory that holds a claim."""
    from ..functions.labels import display_label, wikidata_link
    kinds = F.array(*[F.struct(F.lit(t).alias("territory_type"), F.col(t).alias("territory"),
                               (F.col("country") if t == "region" else F.lit(None).cast("string")).alias("country"))
                      for t in ("country", "region", "colo")])
    held = _state(spark, sf_dir)[1].select(F.inline(kinds)).where("territory is not null").distinct()
    digits = F.nullif(F.regexp_extract("territory", "[0-9]+", 0), F.lit(""))
    return held.select("territory_type", "territory",
                       display_label("territory_type", "territory", "country", F.lower("territory")).alias("label"),
                       wikidata_link(F.concat(F.lit("Q"), digits)).alias("link"))
