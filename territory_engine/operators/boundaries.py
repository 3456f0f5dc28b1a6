"""Boundary extraction (Q9): divisions joined to their areas, nested fields picked, WKB decoded.

The input is one table of division rows and division-area rows (a hive ``type=`` partition
column when read from files). The two sides of the self-join filter on different ``type``
values, so each reads only its own folders (partition pruning), and the subtype filter is
pushed into the division side's scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.geojson import decode_wkb


def divisions_with_areas(view: DataFrame, subtype: str, with_region: bool = False, decode: bool = True) -> DataFrame:
    """P12 + J1 + F11 (+ F16): one row per (division, area) for divisions of ``subtype``.

    Columns: id, subtype, country[, region], wikidata, primary_name, primary_source
    [, country_primary_name], area_id, geometry (WKB) and, with ``decode``, ``parts``.
    """
    has_type = "type" in view.columns
    div = view.where(F.col("type") == "division") if has_type else view
    div = div.where(F.col("subtype") == subtype)
    areas = view.where(F.col("type") == "division_area") if has_type else view
    areas = areas.where(F.col("division_id").isNotNull()).select(
        F.col("id").alias("area_id"), F.col("division_id").alias("_div"), F.col("geometry").alias("geometry")
    )
    cols = [F.col("id"), F.col("subtype"), F.col("country")]
    if with_region:
        cols.append(F.col("region"))
    cols += [
        F.col("wikidata"),
        F.col("names.primary").alias("primary_name"),
        F.element_at("sources", 1).getField("dataset").alias("primary_source"),
    ]
    if with_region:
        cols.append(F.element_at(F.element_at("hierarchies", 1), 1).getField("name").alias("country_primary_name"))
    div = div.select(*cols)
    joined = div.join(areas, div["id"] == areas["_div"]).select(*div.columns, "area_id", "geometry")
    return decode_wkb(joined, "geometry") if decode else joined
