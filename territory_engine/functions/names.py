"""Name checks and the name colour hash, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import COLOUR_SHIFT_FILL, NAME_MAX_LEN, NAME_PATTERN

# Java's ``$`` also matches before a trailing newline; ``\z`` keeps the meaning of the
# fixed pattern (end of text only).
_NAME_REGEX = NAME_PATTERN[:-1] + r"\z"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_name(name: Column | str, max_len: int = NAME_MAX_LEN) -> Column:
    """Length 1..max_len and only allowed characters; a null name is invalid."""
    n = _c(name)
    return F.coalesce(F.length(n).between(1, max_len) & n.rlike(_NAME_REGEX), F.lit(False))


def name_hash24(name: Column | str, shift: int = COLOUR_SHIFT_FILL) -> Column:
    """Low 24 bits of the string hash ``h = c + (h << shift) - h`` over UTF-16 code units.

    ``(h << s) - h`` is ``h * (2**s - 1)`` modulo 2**32 and only the low 24 bits are kept,
    so the fold runs modulo 2**24 in a long without overflow.
    """
    n = _c(name)
    mult = (1 << shift) - 1
    codes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(1))),
        lambda i: F.ascii(F.substring(n, i, 1)).cast("long"),
    )
    codes = F.when(F.length(n) > 0, codes).otherwise(F.array().cast("array<long>"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * mult + c) % F.lit(1 << 24))


def name_colour(name: Column | str, shift: int = COLOUR_SHIFT_FILL) -> Column:
    """``#RRGGBB`` colour of a name (upper-case hex, zero-padded to six digits)."""
    return F.concat(F.lit("#"), F.lpad(F.hex(name_hash24(name, shift)), 6, "0"))
