"""Explicit schemas for every input and output shape (JSON and streams need them)."""

from pyspark.sql import types as T

# A claim as submitted and as stored in the state table: one row per address when stored.
CLAIM = T.StructType(
    [
        T.StructField("ip", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        # 4-byte AS numbers pass 2**31 - 1, so the column is 64-bit.
        T.StructField("asn", T.LongType(), True),
        T.StructField("colo", T.StringType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("metro", T.StringType(), True),
        T.StructField("city", T.StringType(), True),
        T.StructField("time_ms", T.LongType(), False),
    ]
)

CLAIM_NULLABLE = T.StructType([T.StructField(f.name, f.dataType, True) for f in CLAIM.fields])

# A raw request with the edge metadata the admission step reads.
RAW_CLAIM = T.StructType(
    [
        T.StructField("name", T.StringType(), True),
        T.StructField("original_ip", T.StringType(), True),
        T.StructField("asn", T.LongType(), True),
        T.StructField("as_org", T.StringType(), True),
        T.StructField("colo", T.StringType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("city", T.StringType(), True),
        T.StructField("metro", T.StringType(), True),
        T.StructField("region_name", T.StringType(), True),
        T.StructField("region_code", T.StringType(), True),
        T.StructField("postal_code", T.StringType(), True),
        T.StructField("continent", T.StringType(), True),
        T.StructField("header_country", T.StringType(), True),
        T.StructField("time_ms", T.LongType(), True),
    ]
)

# One JSON object per batch file: an envelope, or a bare claim at top level.
BATCH_FILE = T.StructType(
    [
        T.StructField("batch", T.ArrayType(CLAIM_NULLABLE), True),
        T.StructField("workerTimestamp", T.LongType(), True),
        T.StructField("workerId", T.StringType(), True),
    ]
    + list(CLAIM_NULLABLE.fields)
    + [T.StructField("_corrupt_record", T.StringType(), True)]
)

# Retired edge-database row: time in seconds as a real number.
SNAPSHOT_ROW = T.StructType(
    [
        T.StructField("ip", T.StringType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("colo", T.StringType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("timestamp", T.DoubleType(), True),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("latestClaim", T.DoubleType(), True),
        T.StructField("values", T.ArrayType(SNAPSHOT_ROW), True),
    ]
)

LEADERBOARD = T.StructType(
    [
        T.StructField("territory_type", T.StringType(), False),
        T.StructField("time_window", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("territories", T.StringType(), True),
        T.StructField("ip_count", T.LongType(), True),
        T.StructField("latest", T.LongType(), True),
        T.StructField("score", T.LongType(), True),
        T.StructField("rank", T.LongType(), True),
    ]
)

FACILITY = T.StructType(
    [
        T.StructField("city", T.StringType(), True),
        T.StructField("lat", T.DoubleType(), True),
        T.StructField("lon", T.DoubleType(), True),
        T.StructField("name", T.StringType(), True),
        T.StructField("region", T.StringType(), True),
        T.StructField("cca2", T.StringType(), True),
    ]
)

POINT = T.StructType([T.StructField("lon", T.DoubleType(), False), T.StructField("lat", T.DoubleType(), False)])
RING = T.ArrayType(POINT)
POLYGON = T.ArrayType(RING)  # outer ring first, then holes
MULTIPOLYGON = T.ArrayType(POLYGON)  # parts of a geometry; a plain polygon has one
