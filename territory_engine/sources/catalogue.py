"""Facility catalogue (S13, S14) and its override.

The catalogue arrives as JSON objects keyed by facility code,
``{"CODE": {"city", "lat", "lon", "name", "region", "cca2"}, ...}``. Each object is parsed as
a ``map<string, struct>`` and exploded, so a catalogue spread over many lines or files reads
in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MAINLAND_CHINA_REGION
from ..functions.labels import china_facility_name
from ..schema import FACILITY

# fixed values: the extra facilities added by hand (code, city, latitude, longitude)
EXTRA_FACILITIES: list[tuple[str, str, float, float]] = [
    ("HYN", "Taizhou", 28.562222, 121.428611),
    ("TAO", "Qingdao", 36.266111, 120.374444),
    ("CZX", "Changzhou", 31.912778, 119.782222),
    ("FOC", "Fuzhou", 25.935, 119.663333),
    ("XNN", "Xining", 36.5275, 102.042778),
    ("CSX", "Changsha", 28.196667, 113.220833),
    ("LHW", "Lanzhou", 36.515, 103.62),
    ("CGD", "Changde", 28.918889, 111.64),
    ("SZX", "Shenzhen", 22.639444, 113.810833),
    ("FUO", "Foshan", 23.0825, 113.070833),
    ("CAN", "Guangzhou", 23.3925, 113.298889),
    ("KWE", "Guiyang", 26.538611, 106.800833),
    ("SHA", "Shanghai", 31.198056, 121.336389),
    ("WHU", "Wuhu", 31.390556, 118.409444),
    ("JXG", "Jiaxing", 30.706667, 120.680556),
    ("KHN", "Xinyu", 28.865, 115.9),
    ("TNA", "Jinan", 36.857222, 117.216111),
    ("CKG", "Chongqing", 29.719167, 106.641667),
    ("CGO", "Zhengzhou", 34.519722, 113.840833),
    ("KMG", "Kunming", 25.101944, 102.929167),
    ("SJW", "Hengshui", 38.280833, 114.696667),
    ("BHY", "Beihai", 21.539444, 109.293889),
    ("HFE", "Huainan", 31.986667, 116.975),
    ("TSN", "Tianjin", 39.124444, 117.346111),
    ("PKX", "Langfang", 39.509167, 116.410556),
    ("TYN", "Yangquan", 37.746944, 112.628333),
    ("HGH", "Shaoxing", 30.237111, 120.431944),
    ("HAK", "Haikou", 19.934722, 110.458889),
    ("ZGN", "Zhongshan", 22.5686, 113.479),
    ("XFN", "Xiangyang", 32.15, 112.290556),
    ("DLC", "Dalian", 38.965556, 121.538333),
]
EXTRA_COUNTRY = "CN"

CATALOGUE_COLUMNS = ["country", "city", "lat", "lon", "name", "region", "colo"]


def parse_catalogue(text: DataFrame, col: str = "value") -> DataFrame:
    """JSON objects keyed by code -> one row per facility (``cca2`` renamed ``country``)."""
    m = F.from_json(F.col(col), T.MapType(T.StringType(), FACILITY))
    return text.select(F.explode(m).alias("colo", "f")).select(
        F.col("f.cca2").alias("country"), "f.city", "f.lat", "f.lon", "f.name", "f.region", "colo"
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """S13 from files: whole files as text (a catalogue is one object per file or per line)."""
    return parse_catalogue(spark.read.text(path, wholetext=True))


def extra_facilities(spark: SparkSession) -> DataFrame:
    """S14 + F15 + F18: the hand-added facilities with constant country/region and built name."""
    rows = [(code, city, [lat, lon]) for code, city, lat, lon in EXTRA_FACILITIES]
    df = spark.createDataFrame(rows, "colo string, city string, coords array<double>")
    return df.select(
        F.lit(EXTRA_COUNTRY).alias("country"), "city",
        F.element_at("coords", 1).alias("lat"), F.element_at("coords", -1).alias("lon"),
        china_facility_name("city").alias("name"), F.lit(MAINLAND_CHINA_REGION).alias("region"), "colo",
    )


def override_catalogue(catalogue: DataFrame, extra: DataFrame) -> DataFrame:
    """J3 + U1: drop catalogue rows whose name an extra row carries, then append the extras.

    Rows with a null name are kept (an anti join never matches null). The extra side comes from the
    caller, so whether it is broadcast is left to Spark.
    """
    names = extra.select("name").where(F.col("name").isNotNull())
    return catalogue.select(*CATALOGUE_COLUMNS).join(names, "name", "left_anti").select(*CATALOGUE_COLUMNS).unionByName(
        extra.select(*CATALOGUE_COLUMNS)
    )


def facility_cells(catalogue: DataFrame, grid) -> DataFrame:
    """F12 + P18: each facility's cell and ``distance = 0`` (the flood fill's seeds)."""
    return catalogue.withColumns({
        "cell": grid.cell_of_point("lat", "lon"),
        "distance": F.lit(0).cast("long"),
    })
