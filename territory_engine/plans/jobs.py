"""The composed jobs as one public API."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.cells import Grid
from ..operators.admission import admit, to_claims
from ..operators.boundaries import divisions_with_areas
from ..operators.claims import apply_claims, fold_claims
from ..operators.geo import dissolve, exclude_pairs, facility_gate, keep_land, nearest_seed
from ..operators.incremental import incremental_scores
from ..operators.maps import territory_map
from ..operators.rankings import leaderboard, leaderboards, public_claims, recents
from ..operators.views import territory_view, user_view
from ..streaming.ingest import run_stream

__all__ = [
    "admit", "to_claims", "apply_claims", "fold_claims", "leaderboards", "leaderboard", "recents",
    "public_claims", "territory_view", "user_view", "territory_map", "boundaries", "assign_cells",
    "incremental_scores", "run_stream",
]


def boundaries(view: DataFrame, subtype: str) -> DataFrame:
    """Q9: countries (``subtype='country'``) or regions with their area polygons."""
    return divisions_with_areas(view, subtype, with_region=(subtype == "region"))


def assign_cells(land: DataFrame, facilities: DataFrame, grid: Grid, exclusions: DataFrame | None = None,
                 exclusion_keys: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q10: (land cells labelled with their nearest facility, facility outlines, gate offenders).

    ``facilities`` has ``cell`` and ``seed_id``; ``exclusions`` lists (cell, ...) pairs to drop
    from the land cells first (P14).
    """
    if exclusions is not None:
        land = exclude_pairs(land, exclusions, exclusion_keys or ["cell"])
    offenders = facility_gate(land, facilities)
    assigned = keep_land(nearest_seed(land, facilities, grid), land)
    return assigned, dissolve(assigned, grid, "seed_id"), offenders
