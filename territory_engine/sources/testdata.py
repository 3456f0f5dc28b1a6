"""Stand-in inputs built from the shared test tables.

These functions only shape rows of the test tables into the schemas the jobs read; they do no
job work. The same shaping is written once more as DuckDB SQL for the oracle in
``territory_engine.plans.oracle``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def epoch_ms_floor(ts_ntz: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ, floored, independent of the session time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts_ntz)
    return F.floor(micros / F.lit(1000)).cast("long")


_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
_LETTER = f"char(65 + {_K} % 25)"
_CLAIM_EXPRS = [
    f"64512 + {_K} AS asn",
    f"concat('C', lpad(CAST({_K} % 37 AS STRING), 2, '0')) AS colo",
    f"concat({_LETTER}, 'X') AS country",
    f"CASE WHEN {_K} % 10 = 0 THEN CAST(NULL AS STRING) ELSE concat({_LETTER}, 'X-', CAST({_K} % 4 AS STRING)) END AS region",
    "CAST(NULL AS STRING) AS metro",
    "CAST(NULL AS STRING) AS city",
    # epoch milliseconds of a TIMESTAMP_NTZ, floored, independent of the session time zone
    "CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000) AS BIGINT) AS time_ms",
    "CAST(event_id AS BIGINT) AS seq",
]


def _claims(events: DataFrame, ip: str, name: str) -> DataFrame:
    """The CLAIM columns from ``events`` (one projection, written as SQL like the adapter spec)."""
    return events.selectExpr(f"{ip} AS ip", f"{name} AS name", *_CLAIM_EXPRS)


def claims_from_events(events: DataFrame) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value, props) -> CLAIM rows plus ``seq``."""
    ip = f"concat('10.', CAST({_K} AS STRING), '.', CAST(user_id % 50 AS STRING), '.1')"
    name = "concat(event_type, '-', CAST(user_id % 7 AS STRING))"
    return _claims(events, ip, name)


def coarse_claims_from_events(events: DataFrame) -> DataFrame:
    """Claims keyed by ``user_id`` with ``event_type`` as the name: few keys, long histories."""
    return _claims(events, "CAST(user_id AS STRING)", "event_type")


def load_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_from_events(read_table(spark, sf_dir, "events"))


def load_coarse_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarse_claims_from_events(read_table(spark, sf_dir, "events"))


def raw_claims_from_events(events: DataFrame, per_user: bool = False) -> DataFrame:
    """RAW_CLAIM rows with a mix of valid and invalid names and address forms.

    Address text: IPv4, IPv6 in four spellings (compressed, upper-case, leading zeros, full),
    empty, or junk; names: valid, or with a space. Empty geo fields where the code says so.
    With ``per_user``: one IPv4 address per user and the event type as the name.
    """
    if per_user:
        ip = "concat('10.0.', CAST(floor(user_id / 256) AS STRING), '.', CAST(user_id % 256 AS STRING))"
        name = "event_type"
    else:
        ip = f"""CASE WHEN user_id % 13 = 0 THEN ''
            WHEN user_id % 17 = 0 THEN concat('junk-', CAST({_K} AS STRING))
            WHEN {_K} % 2 = 0 THEN concat('10.', CAST({_K} AS STRING), '.', CAST(user_id % 50 AS STRING), '.1')
            WHEN event_id % 4 = 0 THEN format_string('2001:db8:%x::%x', {_K}, event_id)
            WHEN event_id % 4 = 1 THEN upper(format_string('2001:db8:%x::%x', {_K}, event_id))
            WHEN event_id % 4 = 2 THEN format_string('2001:0db8:%04x::%04x', {_K}, user_id)
            ELSE format_string('2001:db8:%x:0:0:0:0:%x', {_K} % 3, event_id) END"""
        name = ("CASE WHEN user_id % 11 = 0 THEN concat(event_type, ' ', CAST(user_id % 7 AS STRING)) "
                "ELSE concat(event_type, '-', CAST(user_id % 7 AS STRING)) END")
    return events.selectExpr(
        f"{name} AS name",
        f"{ip} AS original_ip",
        f"64512 + {_K} AS asn",
        "CAST(NULL AS STRING) AS as_org",
        f"concat('C', lpad(CAST({_K} % 37 AS STRING), 2, '0')) AS colo",
        f"CASE WHEN {_K} % 9 = 0 THEN '' ELSE concat({_LETTER}, 'X') END AS country",
        f"CASE WHEN {_K} % 3 = 0 THEN '' ELSE concat('City', CAST({_K} AS STRING)) END AS city",
        "'' AS metro",
        f"CASE WHEN {_K} % 5 = 0 THEN '' ELSE concat('Region', CAST({_K} % 4 AS STRING)) END AS region_name",
        f"CASE WHEN {_K} % 10 = 0 THEN '' ELSE CAST({_K} % 4 AS STRING) END AS region_code",
        "CAST(NULL AS STRING) AS postal_code",
        "CAST(NULL AS STRING) AS continent",
        "CAST(NULL AS STRING) AS header_country",
        "CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000) AS BIGINT) AS time_ms",
        "CAST(event_id AS BIGINT) AS seq",
    )


def per_user_raw_claims(events: DataFrame) -> DataFrame:
    """RAW_CLAIM rows with one IPv4 address per user and the event type as the name."""
    return raw_claims_from_events(events, per_user=True)


# --------------------------------------------------------------------------- cells ----------
# The test grid: 90 columns of 4 degrees (wrapping in longitude) by 180 rows of 1 degree.
GRID_WIDTH = 90
GRID_HEIGHT = 180


def test_grid():
    from ..functions.cells import Grid
    return Grid(width=GRID_WIDTH, height=GRID_HEIGHT, size=4.0, lat_size=1.0)


def land_cells(customer: DataFrame) -> DataFrame:
    """Land cells from customers: column ``c_custkey % 90``, row ``c_custkey // 90``, folded onto the
    grid's rows (beyond 16,200 customers several share a cell)."""
    key = F.col("c_custkey").cast("long")
    row = F.floor(key / GRID_WIDTH) % GRID_HEIGHT
    return customer.select(key.alias("land_id"), (row * GRID_WIDTH + key % GRID_WIDTH).cast("long").alias("cell"))


def facility_seeds(supplier: DataFrame) -> DataFrame:
    """Facility cells from suppliers: column ``s_suppkey * 37 % 90``, row ``s_suppkey * 17 % 45``."""
    key = F.col("s_suppkey").cast("long")
    return supplier.select(
        key.alias("seed_id"),
        (((key * 17) % 45) * GRID_WIDTH + (key * 37) % GRID_WIDTH).cast("long").alias("cell"),
    )


def divisions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division rows from ``nation`` (nested names/sources/hierarchies) and area rows from
    ``supplier``, in one table with ``type``. An area lies at the supplier's facility cell and is,
    by key mod 4: the cell, two separate cells, a square with a hole, or a triangle (WKB)."""
    from .geojson import multipolygon_wkb, polygon_wkb

    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    supplier = read_table(spark, sf_dir, "supplier")
    nk = F.col("n_nationkey")
    divisions = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.lit("division").alias("type"),
        F.concat(F.lit("div-"), nk.cast("string")).alias("id"),
        F.when(nk % 2 == 0, F.lit("country")).otherwise(F.lit("region")).alias("subtype"),
        F.substring("n_name", 1, 2).alias("country"),
        F.concat(F.substring("n_name", 1, 2), F.lit("-"), F.col("n_regionkey").cast("string")).alias("region"),
        F.when(nk % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Q"), nk.cast("string"))).alias("wikidata"),
        F.struct(F.col("n_name").alias("primary"), F.lower("n_name").alias("common")).alias("names"),
        F.array(
            F.struct(F.lit("tpch").alias("dataset"), nk.cast("string").alias("record_id")),
            F.struct(F.lit("other").alias("dataset"), F.lit(None).cast("string").alias("record_id")),
        ).alias("sources"),
        F.array(F.array(
            F.struct(F.concat(F.lit("reg-"), F.col("r_regionkey").cast("string")).alias("division_id"),
                     F.col("r_name").alias("name")),
            F.struct(F.concat(F.lit("div-"), nk.cast("string")).alias("division_id"), F.col("n_name").alias("name")),
        )).alias("hierarchies"),
        F.lit(None).cast("string").alias("division_id"),
        F.lit(None).cast("binary").alias("geometry"),
    )
    grid = test_grid()

    @F.pandas_udf("binary")
    def wkb(x0: pd.Series, y0: pd.Series, kind: pd.Series) -> pd.Series:
        w, h = grid.size, grid.dlat

        def box(a: float, b: float, n: int) -> list[tuple[float, float]]:
            return [(a, b), (a + n * w, b), (a + n * w, b + n * h), (a, b + n * h), (a, b)]

        def geometry(a: float, b: float, k: int) -> bytes:
            if k == 1:  # two parts
                return multipolygon_wkb([[box(a, b, 1)], [box(a + 2 * w, b, 1)]])
            if k == 2:  # a hole
                return polygon_wkb([box(a, b, 3), box(a + w, b + h, 1)[::-1]])
            if k == 3:  # a triangle
                return polygon_wkb([[(a, b), (a + 3.7 * w, b), (a, b + 3.7 * h), (a, b)]])
            return polygon_wkb([box(a, b, 1)])

        return pd.Series([geometry(a, b, k) for a, b, k in zip(x0, y0, kind)])

    seeds = facility_seeds(supplier).join(supplier.select(F.col("s_suppkey").cast("long").alias("seed_id"), "s_nationkey"), "seed_id")
    # the widest shapes take four columns
    x0 = F.lit(grid.lon0) + F.least(grid.col_of("cell"), F.lit(GRID_WIDTH - 4)).cast("double") * F.lit(grid.size)
    y0 = F.lit(grid.lat0) + grid.row_of("cell").cast("double") * F.lit(grid.dlat)
    areas = seeds.select(
        F.lit("division_area").alias("type"),
        F.concat(F.lit("area-"), F.col("seed_id").cast("string")).alias("id"),
        F.lit(None).cast("string").alias("subtype"),
        F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("region"),
        F.lit(None).cast("string").alias("wikidata"),
        F.lit(None).cast(divisions.schema["names"].dataType).alias("names"),
        F.lit(None).cast(divisions.schema["sources"].dataType).alias("sources"),
        F.lit(None).cast(divisions.schema["hierarchies"].dataType).alias("hierarchies"),
        F.concat(F.lit("div-"), F.col("s_nationkey").cast("string")).alias("division_id"),
        wkb(x0, y0, F.col("seed_id") % 4).alias("geometry"),
    )
    return divisions.unionByName(areas)


def catalogue_text(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Facility catalogue objects keyed by code, one object per supplier line (``value``)."""
    grid = test_grid()
    seeds = facility_seeds(supplier)
    s = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").cast("long").alias("seed_id"), "s_name", "n_name")
    s = s.join(seeds, "seed_id")
    lon = F.lit(grid.lon0) + (grid.col_of("cell").cast("double") + F.lit(0.5)) * F.lit(grid.size)
    lat = F.lit(grid.lat0) + (grid.row_of("cell").cast("double") + F.lit(0.5)) * F.lit(grid.dlat)
    code = F.concat(F.lit("S"), F.lpad(F.col("seed_id").cast("string"), 5, "0"))
    entry = F.struct(
        F.col("s_name").alias("city"), lat.alias("lat"), lon.alias("lon"), F.col("s_name").alias("name"),
        F.col("n_name").alias("region"), F.substring("n_name", 1, 2).alias("cca2"),
    )
    return s.select(F.to_json(F.create_map(code, entry)).alias("value"))


def facility_features(assigned: DataFrame) -> DataFrame:
    """Map features: each land cell of a facility territory, labelled with a claim facility code."""
    grid = test_grid()
    return assigned.select(
        "cell", "seed_id",
        F.concat(F.lit("C"), F.lpad((F.col("seed_id") % 37).cast("string"), 2, "0")).alias("colo"),
        grid.polygon("cell").alias("ring"),
    )
