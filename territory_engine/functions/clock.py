"""Clock-relative expressions: window cut-offs, relative ages, deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_UNITS, WINDOW_SECS


def _c(c: Column | str | int) -> Column:
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(int(c)).cast("long")


def now_ms() -> Column:
    """F8: the current time in epoch milliseconds (used only when no ``as_of_ms`` is given)."""
    return F.unix_millis(F.current_timestamp())


def as_of_latest(df: DataFrame, col: str = "time_ms") -> Column:
    """The latest time in ``df`` as a lazily evaluated scalar subquery."""
    return df.select(F.max(col)).scalar()


def window_cut(as_of_ms: Column | int, label: str) -> Column | None:
    """the cut-off for a window label; None for all-time or an unknown label (no limit)."""
    secs = WINDOW_SECS.get(label)
    if secs is None:
        return None
    return _c(as_of_ms) - F.lit(secs * 1000)


def in_window(time_ms: Column | str, as_of_ms: Column | int, label: str, inclusive: bool = False) -> Column:
    """P7 (strict ``>``, rankings) or P8 (inclusive ``>=``, drill-downs); all-time is always true."""
    cut = window_cut(as_of_ms, label)
    if cut is None:
        return F.lit(True)
    t = _c(time_ms)
    return t >= cut if inclusive else t > cut


def age_unit(time_ms: Column | str, as_of_ms: Column | int) -> tuple[Column, Column]:
    """(unit name, ms per unit) for the age ``now - t``."""
    age = _c(as_of_ms) - _c(time_ms)
    unit = None
    factor = None
    for label, bound, ms in AGE_UNITS:
        if bound is None:
            unit = unit.otherwise(F.lit(label)) if unit is not None else F.lit(label)
            factor = factor.otherwise(F.lit(ms)) if factor is not None else F.lit(ms)
        else:
            cond = age < F.lit(bound)
            unit = F.when(cond, F.lit(label)) if unit is None else unit.when(cond, F.lit(label))
            factor = F.when(cond, F.lit(ms)) if factor is None else factor.when(cond, F.lit(ms))
    return unit, factor.cast("long")


def round_half_up(x: Column) -> Column:
    """Rounding with halves toward +infinity (``Math.round``), not away from zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def relative_age(time_ms: Column | str, as_of_ms: Column | int) -> tuple[Column, Column]:
    """F4 + F5: (unit, signed count) with the count ``round((t - now) / factor)``.

    ``as_of_ms`` is read several times; pass a column (project a subquery once) or a literal.
    """
    unit, factor = age_unit(time_ms, as_of_ms)
    value = round_half_up((_c(time_ms) - _c(as_of_ms)).cast("double") / factor.cast("double"))
    return unit, value


def recent_age(time_ms: Column | str, as_of_ms: Column | int) -> tuple[Column, Column]:
    """recents show seconds under 2 min, minutes under 1 h, else hours: ``-round(age / f)``."""
    age = (_c(as_of_ms) - _c(time_ms)).cast("double")
    secs = age / F.lit(1000.0)
    mins = secs / F.lit(60.0)
    hours = mins / F.lit(60.0)
    unit = F.when(age < 120 * 1000, "second").when(age < 60 * 1000 * 60, "minute").otherwise("hour")
    value = -F.when(age < 120 * 1000, round_half_up(secs)).when(age < 60 * 1000 * 60, round_half_up(mins)).otherwise(
        round_half_up(hours)
    )
    return unit, value.cast("long")
