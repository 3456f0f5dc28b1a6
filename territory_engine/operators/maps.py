"""Territory map (Q8): attach each ranking's winner to the boundary features of its territories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COLOUR_SHIFT_FILL, COLOUR_SHIFT_STROKE
from ..functions.names import name_colour
from ..plans.broadcast import measured


def winners_by_territory(board: DataFrame, territory_type: str, window: str) -> DataFrame:
    """(territory, claimant) from one ranking's comma-joined territory lists."""
    return board.where((F.col("territory_type") == territory_type) & (F.col("time_window") == window)).select(
        F.explode(F.split("territories", ",")).alias("territory"), F.col("name").alias("claimant")
    )


def territory_map(features: DataFrame, board: DataFrame, territory_type: str, window: str,
                  key: str | None = None) -> DataFrame:
    """J7 + F3: features whose territory has a winner, with the claimant and its two colours.

    Features without a winner are dropped (inner join). The winners side has one row per won
    territory; it is broadcast when within the checked bound.
    """
    k = key or territory_type
    winners = measured(winners_by_territory(board, territory_type, window))
    return features.join(winners, features[k] == winners["territory"]).drop("territory").withColumns({
        "fill": name_colour("claimant", COLOUR_SHIFT_FILL),
        "stroke": name_colour("claimant", COLOUR_SHIFT_STROKE),
    })


def features_for(features: DataFrame, territory_id: str, key_by_type: dict[str, str] | None = None) -> DataFrame:
    """P16 + P15: the boundary features of one territory id (its type from the id's length)."""
    from ..functions.labels import territory_type_of_text
    keys = key_by_type or {"country": "country", "colo": "colo", "region": "region"}
    return features.where(F.col(keys[territory_type_of_text(territory_id)]) == F.lit(territory_id))
