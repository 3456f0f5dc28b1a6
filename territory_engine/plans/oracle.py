"""DuckDB SQL for the correctness oracle: the same queries written independently as SQL.

The CTEs shape the shared test tables exactly as ``sources.testdata`` does, fold claims with
``list_reduce`` (a sequential fold, the plain definition of the upsert rule) and take the
as-of time as the latest claim time.
"""

from __future__ import annotations

from ..constants import COOLDOWN_MS, TERRITORY_TYPES, TIME_WINDOWS

CLAIM_SELECT = """
  SELECT {ip} AS ip,
         {name} AS name,
         64512 + k AS asn,
         'C' || lpad(CAST(k % 37 AS VARCHAR), 2, '0') AS colo,
         chr(CAST(65 + k % 25 AS INT)) || 'X' AS country,
         CASE WHEN k % 10 = 0 THEN NULL ELSE chr(CAST(65 + k % 25 AS INT)) || 'X-' || CAST(k % 4 AS VARCHAR) END AS region,
         CAST(NULL AS VARCHAR) AS metro,
         CAST(NULL AS VARCHAR) AS city,
         time_ms, seq
  FROM (SELECT event_id AS seq, CAST(props->>'$.k' AS BIGINT) AS k, user_id, event_type,
               epoch_us(ts) // 1000 AS time_ms
        FROM events)"""

FINE_IP = "'10.' || CAST(k AS VARCHAR) || '.' || CAST(user_id % 50 AS VARCHAR) || '.1'"
FINE_NAME = "event_type || '-' || CAST(user_id % 7 AS VARCHAR)"


def claims_cte(coarse: bool = False, name: str = "claims", where: str | None = None) -> str:
    ip, nm = ("CAST(user_id AS VARCHAR)", "event_type") if coarse else (FINE_IP, FINE_NAME)
    body = CLAIM_SELECT.format(ip=ip, name=nm)
    if where:
        body = f"SELECT * FROM ({body}) WHERE {where}"
    return f"{name} AS ({body})"


def fold_cte(source: str = "claims", name: str = "state", cooldown_ms: int = COOLDOWN_MS, seed: str | None = None) -> str:
    """Sequential fold per ip. With ``seed`` (a table of stored rows) the stored row is the start."""
    elem = ("{'time_ms': time_ms, 'name': name, 'asn': asn, 'colo': colo, 'country': country, "
            "'region': region, 'metro': metro, 'city': city}")
    step = (f"lambda acc, x: CASE WHEN (x.name <> acc.name AND x.time_ms > acc.time_ms) "
            f"OR (x.name = acc.name AND x.time_ms - {cooldown_ms} > acc.time_ms) THEN x ELSE acc END")
    if seed is None:
        inner = f"SELECT ip, list_reduce(list({elem} ORDER BY time_ms, seq), {step}) AS s FROM {source} GROUP BY ip"
    else:
        seed_elem = ("{'time_ms': sd.time_ms, 'name': sd.name, 'asn': sd.asn, 'colo': sd.colo, "
                     "'country': sd.country, 'region': sd.region, 'metro': sd.metro, 'city': sd.city}")
        inner = (
            f"SELECT g.ip, CASE WHEN sd.ip IS NULL THEN list_reduce(g.l, {step}) "
            f"ELSE list_reduce(list_prepend({seed_elem}, g.l), {step}) END AS s "
            f"FROM (SELECT ip, list({elem} ORDER BY time_ms, seq) AS l FROM {source} GROUP BY ip) g "
            f"LEFT JOIN {seed} sd ON sd.ip = g.ip"
        )
    return (f"{name} AS (SELECT ip, s.name AS name, s.asn AS asn, s.colo AS colo, s.country AS country, "
            f"s.region AS region, s.metro AS metro, s.city AS city, s.time_ms AS time_ms FROM ({inner}))")


ASOF_CTE = "clock AS (SELECT max(time_ms) AS now_ms FROM claims)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def base(coarse: bool = False, cooldown_ms: int = COOLDOWN_MS) -> str:
    return with_ctes(claims_cte(coarse), fold_cte(cooldown_ms=cooldown_ms), ASOF_CTE)


def window_pred(col: str, label: str, inclusive: bool = False) -> str:
    secs = dict(TIME_WINDOWS)[label]
    if secs is None:
        return "TRUE"
    op = ">=" if inclusive else ">"
    return f"{col} {op} (SELECT now_ms FROM clock) - {secs * 1000}"


def leaderboard_sql(territory_type: str, label: str, source: str = "state") -> str:
    """The published ranking for one (type, window), as the reference writes it plus ties by name."""
    return f"""
  SELECT '{territory_type}' AS territory_type, '{label}' AS time_window, name, territories, ip_count, latest, score,
         CAST(row_number() OVER (ORDER BY score DESC, ip_count DESC, latest DESC, name) AS BIGINT) AS rank
  FROM (
    SELECT name, string_agg(territory, ',' ORDER BY territory) AS territories,
           CAST(sum(count) AS BIGINT) AS ip_count, max(latest) AS latest, count(*) AS score
    FROM (
      SELECT *, row_number() OVER (PARTITION BY territory ORDER BY count DESC, latest DESC, name) AS rn
      FROM (SELECT {territory_type} AS territory, name, count(*) AS count, max(time_ms) AS latest
            FROM {source}
            WHERE {territory_type} IS NOT NULL AND {window_pred('time_ms', label)}
            GROUP BY 1, 2))
    WHERE rn = 1
    GROUP BY name)"""


def all_leaderboards_sql(source: str = "state") -> str:
    return "\nUNION ALL\n".join(leaderboard_sql(t, w, source) for t in TERRITORY_TYPES for w, _ in TIME_WINDOWS)


def contenders_sql(label: str, inclusive: bool = True, source: str = "state", keep_null: bool = False) -> str:
    """(territory_type, territory, name, count, latest) for all three types."""
    parts = []
    for t in TERRITORY_TYPES:
        null_pred = "TRUE" if keep_null else f"{t} IS NOT NULL"
        parts.append(
            f"SELECT '{t}' AS territory_type, {t} AS territory, name, count(*) AS count, max(time_ms) AS latest "
            f"FROM {source} WHERE {null_pred} AND {window_pred('time_ms', label, inclusive)} GROUP BY 1, 2, 3"
        )
    return "\nUNION ALL\n".join(parts)


def relative_age_sql(t: str, now: str = "(SELECT now_ms FROM clock)") -> tuple[str, str]:
    """(unit, value) with Math.round semantics: floor(x + 0.5)."""
    age = f"({now} - {t})"
    unit = (f"CASE WHEN {age} < 120000 THEN 'second' WHEN {age} < 3600000 THEN 'minute' "
            f"WHEN {age} < 86400000 THEN 'hour' WHEN {age} < 604800000 THEN 'day' "
            f"WHEN {age} < 5184000000 THEN 'week' ELSE 'month' END")
    factor = (f"CASE WHEN {age} < 120000 THEN 1000 WHEN {age} < 3600000 THEN 60000 "
              f"WHEN {age} < 86400000 THEN 3600000 WHEN {age} < 604800000 THEN 86400000 "
              f"WHEN {age} < 5184000000 THEN 604800000 ELSE 2592000000 END")
    value = f"CAST(floor(CAST({t} - {now} AS DOUBLE) / CAST({factor} AS DOUBLE) + 0.5) AS BIGINT)"
    return unit, value


def raw_claims_cte(per_user: bool = False, name: str = "raw") -> str:
    """RAW_CLAIM rows shaped as ``sources.testdata.raw_claims_from_events`` / ``per_user_raw_claims``."""
    if per_user:
        ip = "'10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR)"
        nm = "event_type"
    else:
        ip = ("CASE WHEN user_id % 13 = 0 THEN '' "
              "WHEN user_id % 17 = 0 THEN 'junk-' || CAST(k AS VARCHAR) "
              "WHEN k % 2 = 0 THEN '10.' || CAST(k AS VARCHAR) || '.' || CAST(user_id % 50 AS VARCHAR) || '.1' "
              "WHEN event_id % 4 = 0 THEN printf('2001:db8:%x::%x', k, event_id) "
              "WHEN event_id % 4 = 1 THEN upper(printf('2001:db8:%x::%x', k, event_id)) "
              "WHEN event_id % 4 = 2 THEN printf('2001:0db8:%04x::%04x', k, user_id) "
              "ELSE printf('2001:db8:%x:0:0:0:0:%x', k % 3, event_id) END")
        nm = ("CASE WHEN user_id % 11 = 0 THEN event_type || ' ' || CAST(user_id % 7 AS VARCHAR) "
              "ELSE event_type || '-' || CAST(user_id % 7 AS VARCHAR) END")
    letter = "chr(CAST(65 + k % 25 AS INT))"
    return f"""{name} AS (
  SELECT {nm} AS name, {ip} AS original_ip, 64512 + k AS asn,
         'C' || lpad(CAST(k % 37 AS VARCHAR), 2, '0') AS colo,
         CASE WHEN k % 9 = 0 THEN '' ELSE {letter} || 'X' END AS country,
         CASE WHEN k % 3 = 0 THEN '' ELSE 'City' || CAST(k AS VARCHAR) END AS city,
         '' AS metro,
         CASE WHEN k % 5 = 0 THEN '' ELSE 'Region' || CAST(k % 4 AS VARCHAR) END AS region_name,
         CASE WHEN k % 10 = 0 THEN '' ELSE CAST(k % 4 AS VARCHAR) END AS region_code,
         epoch_us(ts) // 1000 AS time_ms, event_id AS seq
  FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))"""


OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
HEX = "[0-9a-fA-F]{1,4}"


def ipv4_valid_sql(a: str) -> str:
    return f"regexp_full_match({a}, '{OCTET}(\\.{OCTET}){{3}}')"


def ipv6_valid_sql(a: str) -> str:
    halves = f"string_split({a}, '::')"
    left = f"(CASE WHEN {halves}[1] = '' THEN 0 ELSE len(string_split({halves}[1], ':')) END)"
    right = f"(CASE WHEN len({halves}) < 2 OR {halves}[2] = '' THEN 0 ELSE len(string_split({halves}[2], ':')) END)"
    full = f"regexp_full_match({a}, '{HEX}(:{HEX}){{7}}')"
    comp = f"(regexp_full_match({a}, '({HEX}(:{HEX})*)?::({HEX}(:{HEX})*)?') AND len({halves}) = 2 AND {left} + {right} <= 7)"
    return f"({full} OR {comp})"


def ipv6_prefix_sql(a: str) -> str:
    """/48 network text: group i of the expanded address, leading zeros stripped, lower-case."""
    halves = f"string_split({a}, '::')"
    lg = f"(CASE WHEN {halves}[1] = '' THEN [] ELSE string_split({halves}[1], ':') END)"
    rg = f"(CASE WHEN len({halves}) < 2 OR {halves}[2] = '' THEN [] ELSE string_split({halves}[2], ':') END)"

    def group(i: int) -> str:
        raw = (f"(CASE WHEN {i} <= len({lg}) THEN {lg}[{i}] "
               f"WHEN len({halves}) = 2 AND {i} > 8 - len({rg}) THEN {rg}[{i} - (8 - len({rg}))] ELSE '0' END)")
        return f"coalesce(nullif(lower(ltrim({raw}, '0')), ''), '0')"

    g1, g2, g3 = group(1), group(2), group(3)
    return (f"(CASE WHEN {g3} <> '0' THEN {g1} || ':' || {g2} || ':' || {g3} || '::' "
            f"WHEN {g2} <> '0' THEN {g1} || ':' || {g2} || '::' "
            f"WHEN {g1} <> '0' THEN {g1} || '::' ELSE '::' END)")


def name_valid_sql(n: str, max_len: int = 40) -> str:
    return (f"coalesce(length({n}) BETWEEN 1 AND {max_len} "
            f"AND regexp_full_match({n}, '[a-zA-Z0-9@:.^+!/\\-_\\*]+'), false)")


def admission_sql(name_limit: int, ip_limit: int, period_secs: int, per_user: bool = False, source: str = "raw",
                  extra: tuple[str, ...] = ()) -> str:
    p = period_secs * 1000
    rip = (f"CASE WHEN {ipv4_valid_sql('original_ip')} THEN original_ip "
           f"WHEN {ipv6_valid_sql('original_ip')} THEN {ipv6_prefix_sql('original_ip')} END")
    return with_ctes(
        raw_claims_cte(per_user),
        *extra,
        f"""base AS (SELECT *, {rip} AS rip,
            CASE WHEN NOT {name_valid_sql('name')} THEN 'invalid_name'
                 WHEN coalesce(original_ip, '') = '' THEN 'missing_address'
                 WHEN {rip} IS NULL THEN 'bad_address'
                 WHEN time_ms IS NULL THEN 'missing_time' END AS static FROM {source})""",
        f"""s1 AS (SELECT *, dense_rank() OVER (PARTITION BY rip, name, time_ms // {p} ORDER BY time_ms, seq) AS rn1
            FROM base WHERE static IS NULL)""",
        f"""s2 AS (SELECT *, dense_rank() OVER (PARTITION BY rip, time_ms // {p} ORDER BY time_ms, seq) AS rn2
            FROM s1 WHERE rn1 <= {name_limit})""",
        """verdicts AS (
            SELECT DISTINCT seq, time_ms, static AS verdict FROM base WHERE static IS NOT NULL
            UNION SELECT seq, time_ms, 'name_rate_limited' FROM s1 WHERE rn1 > """ + str(name_limit) + """
            UNION SELECT seq, time_ms, CASE WHEN rn2 <= """ + str(ip_limit) + """ THEN 'accepted' ELSE 'ip_rate_limited' END FROM s2)""",
    ) + """SELECT b.seq, CASE WHEN b.static IS NULL THEN b.rip END AS ip, b.name,
        CASE WHEN length(b.country) > 0 AND length(b.region_code) > 0 THEN b.country || '-' || b.region_code END AS region,
        nullif(b.country, '') AS country_norm, nullif(b.city, '') AS city_norm, v.verdict,
        CAST(CASE v.verdict WHEN 'invalid_name' THEN 400 WHEN 'missing_address' THEN 500 WHEN 'bad_address' THEN 500
             WHEN 'missing_time' THEN 500 WHEN 'accepted' THEN 200 ELSE 429 END AS INTEGER) AS status
      FROM base b JOIN verdicts v ON v.seq = b.seq AND v.time_ms IS NOT DISTINCT FROM b.time_ms"""


def colour_sql(col: str, mult: int) -> str:
    return ("'#' || lpad(upper(hex(list_reduce(list_transform(string_split(" + col + ", ''), lambda c: ascii(c)), "
            f"lambda h, c: (h * {mult} + c) % 16777216, CAST(0 AS BIGINT)))), 6, '0')")


DIVISIONS_CTES = [
    """div AS (
  SELECT 'div-' || CAST(n_nationkey AS VARCHAR) AS id,
         CASE WHEN n_nationkey % 2 = 0 THEN 'country' ELSE 'region' END AS subtype,
         substr(n_name, 1, 2) AS country,
         substr(n_name, 1, 2) || '-' || CAST(n_regionkey AS VARCHAR) AS region,
         CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'Q' || CAST(n_nationkey AS VARCHAR) END AS wikidata,
         {'primary': n_name, 'common': lower(n_name)} AS names,
         [{'dataset': 'tpch', 'record_id': CAST(n_nationkey AS VARCHAR)}, {'dataset': 'other', 'record_id': NULL}] AS sources,
         [[{'division_id': 'reg-' || CAST(r_regionkey AS VARCHAR), 'name': r_name},
           {'division_id': 'div-' || CAST(n_nationkey AS VARCHAR), 'name': n_name}]] AS hierarchies
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    """areas AS (
  SELECT 'area-' || CAST(s_suppkey AS VARCHAR) AS area_id, 'div-' || CAST(s_nationkey AS VARCHAR) AS division_id,
         s_suppkey % 4 AS kind, least((s_suppkey * 37) % 90, 86) AS c, (s_suppkey * 17) % 45 AS r
  FROM supplier)""",
]

_WIDE = "CASE a.kind WHEN 0 THEN 1.0::DOUBLE WHEN 3 THEN 3.7::DOUBLE ELSE 3.0::DOUBLE END"
_HIGH = "CASE a.kind WHEN 2 THEN 3.0::DOUBLE WHEN 3 THEN 3.7::DOUBLE ELSE 1.0::DOUBLE END"
AREA_BOUNDS = (f"-180.0::DOUBLE + a.c * 4.0::DOUBLE AS minx, -90.0::DOUBLE + a.r * 1.0::DOUBLE AS miny, "
               f"-180.0::DOUBLE + a.c * 4.0::DOUBLE + ({_WIDE}) * 4.0::DOUBLE AS maxx, "
               f"-90.0::DOUBLE + a.r * 1.0::DOUBLE + ({_HIGH}) * 1.0::DOUBLE AS maxy")

# the cells of each shape, told by a test of every cell near it
AREA_CELLS = """SELECT a.area_id, CAST((a.r + j) * 90 + a.c + i AS BIGINT) AS cell
  FROM areas a, (SELECT i, j FROM range(4) t(i), range(4) u(j))
  WHERE CASE a.kind WHEN 0 THEN i = 0 AND j = 0
                    WHEN 1 THEN j = 0 AND i IN (0, 2)
                    WHEN 2 THEN i < 3 AND j < 3 AND NOT (i = 1 AND j = 1)
                    ELSE (i + 0.5) / 3.7 + (j + 0.5) / 3.7 < 1 END"""
