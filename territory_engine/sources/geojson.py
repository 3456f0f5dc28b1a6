"""GeoJSON source (S15) and WKB geometry decoding.

A geometry is an array of parts, each an outer ring followed by its holes; a Polygon has one part, a
MultiPolygon any number. A FeatureCollection file is read whole and its features exploded; a
file of one Feature per line (what the sink writes) reads line by line. WKB is decoded in an
Arrow-batched ``mapInArrow`` step over the partitioned table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MULTIPOLYGON

_POLYGON = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
# the depth of the coordinates depends on the type, so they are read as text first
_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", _GEOMETRY),
])
_COLLECTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(_FEATURE))])


def _parts(geometry: Column) -> Column:
    """Parts of a Polygon or MultiPolygon; null for other types."""
    kind, text = geometry["type"], geometry["coordinates"]
    coords = (F.when(kind == "Polygon", F.array(F.from_json(text, _POLYGON)))
              .when(kind == "MultiPolygon", F.from_json(text, T.ArrayType(_POLYGON))))
    return F.transform(coords, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(
        F.element_at(p, 1).alias("lon"), F.element_at(p, 2).alias("lat")))))


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """(properties map, parts) per feature of FeatureCollection files."""
    text = spark.read.text(path, wholetext=True)
    fc = text.select(F.from_json("value", _COLLECTION).alias("fc"))
    return fc.select(F.explode("fc.features").alias("f")).select(
        F.col("f.properties").alias("properties"), _parts(F.col("f.geometry")).alias("parts")
    )


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """S15 for one Feature per line."""
    f = spark.read.text(path).select(F.from_json("value", _FEATURE).alias("f"))
    return f.select(F.col("f.properties").alias("properties"), _parts(F.col("f.geometry")).alias("parts"))


# --------------------------------------------------------------------------- WKB ------------
# fixed values: geometry kinds and the flags of the extended form
_WKB_POLYGON, _WKB_MULTIPOLYGON = 3, 6
_EWKB_Z, _EWKB_M, _EWKB_SRID = 0x80000000, 0x40000000, 0x20000000


def _wkb_head(buf: bytes, pos: int) -> tuple[str, int, int, int]:
    """(byte order, kind, coordinates per point, position after the head) of one geometry.

    Extra dimensions are told by thousands (ISO) or by flags (extended form), which may also
    announce a reference system id.
    """
    order = "<" if buf[pos] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", buf, pos + 1)
    iso, kind = divmod(code & 0x0FFFFFFF, 1000)
    dims = 2 + (iso in (1, 3) or bool(code & _EWKB_Z)) + (iso in (2, 3) or bool(code & _EWKB_M))
    return order, kind, dims, pos + 5 + (4 if code & _EWKB_SRID else 0)


def _wkb_rings(buf: bytes, pos: int, order: str, dims: int) -> tuple[list[np.ndarray], int]:
    (n,) = struct.unpack_from(order + "I", buf, pos)
    pos += 4
    rings = []
    for _ in range(n):
        (points,) = struct.unpack_from(order + "I", buf, pos)
        rings.append(np.frombuffer(buf, dtype=order + "f8", count=points * dims, offset=pos + 4).reshape(points, dims)[:, :2])
        pos += 4 + 8 * points * dims
    return rings, pos


def wkb_parts(buf: bytes | None) -> list[list[np.ndarray]] | None:
    """Parts of a WKB or EWKB Polygon or MultiPolygon, rings as (points, 2) arrays."""
    if buf is None:
        return None
    order, kind, dims, pos = _wkb_head(buf, 0)
    if kind == _WKB_POLYGON:
        return [_wkb_rings(buf, pos, order, dims)[0]]
    if kind != _WKB_MULTIPOLYGON:
        raise ValueError(f"unsupported WKB geometry type {kind}")
    (n,) = struct.unpack_from(order + "I", buf, pos)
    pos, parts = pos + 4, []
    for _ in range(n):
        own, _, own_dims, pos = _wkb_head(buf, pos)
        rings, pos = _wkb_rings(buf, pos, own, own_dims)
        parts.append(rings)
    return parts


def _offsets(lengths: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32))


def _parts_array(geometries: list[list[list[np.ndarray]] | None]) -> pa.Array:
    """Arrow array of parts, built from offsets and flat coordinates."""
    known = [g or [] for g in geometries]
    parts = [p for g in known for p in g]
    rings = [r for p in parts for r in p]
    points = np.concatenate(rings).astype("f8") if rings else np.zeros((0, 2))
    values = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["lon", "lat"])
    by_ring = pa.ListArray.from_arrays(_offsets([len(r) for r in rings]), values)
    by_part = pa.ListArray.from_arrays(_offsets([len(p) for p in parts]), by_ring)
    missing = pa.array([g is None for g in geometries], type=pa.bool_())
    return pa.ListArray.from_arrays(_offsets([len(g) for g in known]), by_part, mask=missing)


def decode_wkb(df: DataFrame, col: str, out: str = "parts") -> DataFrame:
    """Add ``out`` (parts of rings of ``struct<lon,lat>``) decoded from WKB column ``col``.

    Runs per Arrow batch inside the tasks that hold the rows; no shuffle, nothing gathered.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, MULTIPOLYGON, True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wkb = b.column(b.schema.get_field_index(col)).to_pylist()
            parts = _parts_array([wkb_parts(w) for w in wkb])
            yield pa.RecordBatch.from_arrays(list(b.columns) + [parts], names=list(b.schema.names) + [out])

    return df.mapInArrow(run, schema)


def polygon_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """WKB (little-endian Polygon) for a list of rings of (lon, lat) points."""
    parts = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        parts.append(struct.pack("<I", len(ring)))
        parts.append(struct.pack("<%dd" % (2 * len(ring)), *[v for p in ring for v in p]))
    return b"".join(parts)


def multipolygon_wkb(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """WKB (little-endian MultiPolygon) for parts of rings of (lon, lat) points."""
    return struct.pack("<BII", 1, _WKB_MULTIPOLYGON, len(parts)) + b"".join(polygon_wkb(p) for p in parts)


def read_divisions(spark: SparkSession, base: str) -> DataFrame:
    """Boundary Parquet under hive ``theme=.../type=...`` folders, with each row's file.

    Partition discovery turns the folder names into ``theme`` / ``type`` columns, so filters on
    them prune folders; nested columns are read as structs and arrays.
    """
    return spark.read.option("basePath", base).parquet(base).withColumn("filename", F.col("_metadata.file_path"))
