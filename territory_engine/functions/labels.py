"""Territory ids, display labels and facility names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHINA_SUFFIX


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def territory_type_of_id(territory_id: Column | str) -> Column:
    """Two characters is a country, three a facility, anything else a region."""
    n = F.length(_c(territory_id))
    return F.when(n == 2, F.lit("country")).when(n == 3, F.lit("colo")).otherwise(F.lit("region"))


def territory_type_of_text(territory_id: str) -> str:
    """P15 for a literal id (same rule as ``territory_type_of_id``)."""
    return "country" if len(territory_id) == 2 else "colo" if len(territory_id) == 3 else "region"


def display_label(territory_type: Column | str, primary_name: Column | str, country_primary_name: Column | str,
                  facility_name: Column | str) -> Column:
    """country ``primary_name``; region ``primary_name, country_primary_name``; facility ``name``."""
    t = _c(territory_type)
    return (
        F.when(t == "country", _c(primary_name))
        .when(t == "region", F.concat_ws(", ", _c(primary_name), _c(country_primary_name)))
        .when(t == "colo", _c(facility_name))
    )


def wikidata_link(wikidata: Column | str) -> Column:
    """link to the knowledge-base page when an id is present."""
    w = _c(wikidata)
    return F.when(w.isNotNull(), F.concat(F.lit("https://www.wikidata.org/wiki/"), w))


def china_facility_name(city: Column | str) -> Column:
    """``city + ', China'``."""
    return F.concat(_c(city), F.lit(CHINA_SUFFIX))


def split_part(s: Column | str, sep_regex: str, index: int) -> Column:
    """element ``index`` (1-based) of a split string."""
    return F.element_at(F.split(_c(s), sep_regex), index)
