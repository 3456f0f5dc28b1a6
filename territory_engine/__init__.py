"""territory_engine: territory analytics as Spark DataFrame and Structured Streaming jobs."""

from .plans.jobs import (  # noqa: F401
    admit, apply_claims, assign_cells, boundaries, fold_claims, incremental_scores, leaderboard, leaderboards,
    public_claims, recents, run_stream, territory_map, territory_view, to_claims, user_view,
)
from .session import get_spark  # noqa: F401
