"""Distributed radix sort: ranks of all rows by a composite key, least significant digit first.

A key is a list of unsigned integer columns of known bit widths; its digits may span two columns.
Each pass is one stable counting sort. Rows lie in blocks of at most BLOCK rows and have a slot there.
The pass counts the rows of every (block, digit), turns the counts into global starts (rows of lower
digits, then rows of the same digit in earlier blocks) and gives each row its destination: the start of
its block and digit plus its place among the block's rows of that digit. Destinations divided by BLOCK are
the next pass's blocks. After the last pass the destination is the rank.

A task holds one block and at most one start per digit of that block, whatever the size of the table
or the number of equal digits. Every pass is written to the shared folder, so a lost executor
repeats a part of one pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from territory_engine.llm.common import written

#: Rows of a block and bits of a digit at most.
BLOCK, DIGIT_BITS = 1 << 17, 16


def digit(parts: list[tuple[str, int]], low: int, bits: int) -> Column:
    """Bits ``low`` to ``low + bits`` of the key whose columns and widths are ``parts``, most significant first."""
    found, base = F.lit(0).cast("long"), 0
    for name, width in reversed(parts):
        if base < low + bits and base + width > low:
            part = F.shiftrightunsigned(name, low - base) if low > base else F.shiftleft(name, base - low)
            found = found.bitwiseOR(part)
        base += width
    return found.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def starts_of(rows: DataFrame, digits: Column) -> DataFrame:
    """The global start of every (block, digit): a prefix sum over digits, then blocks."""
    counts = rows.groupBy("block", digits.alias("digit")).agg(F.count("*").alias("n"))
    lower = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # one row per digit
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("lower"))
    return counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        totals, "digit").select(F.col("block").alias("of_block"), "digit", (F.col("lower") + F.col("earlier")).alias("start"))


def destinations(rows: pd.DataFrame, starts: pd.DataFrame) -> np.ndarray:
    """Stable counting sort of one block's rows (in slot order) by ``digit``, at the given starts."""
    digits = rows["digit"].to_numpy()
    order = np.argsort(digits, kind="stable")
    ordered = digits[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    starts = starts.sort_values("digit")
    run = np.diff(np.append(first, len(ordered)))
    at = starts["start"].to_numpy()[np.searchsorted(starts["digit"].to_numpy(), ordered[first])]
    out = np.empty(len(digits), dtype=np.int64)
    out[order] = np.repeat(at - first, run) + np.arange(len(ordered))
    return out


def radix_ranks(rows: DataFrame, parts: list[tuple[str, int]], block: int = BLOCK, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """(row, rank) of all rows, rank 1 for the smallest key.

    ``rows`` has a unique non-negative ``row`` and the columns of ``parts`` (name, bits), most
    significant first, none null: unsigned integers of that many bits. Rows with equal keys
    follow each other in the order of ``row``; an empty table gives no rows.
    """
    width = sum(w for _, w in parts)
    passes = max(1, -(-width // digit_bits))
    names = [n for n, _ in parts]
    layout = ", ".join(["row long", *[f"{n} long" for n in names], "block long", "slot int"])
    state = rows.select("row", *names, F.floor(F.col("row") / block).cast("long").alias("block"),
                        F.pmod("row", F.lit(block)).cast("int").alias("slot"))

    def place(group: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("slot")
        at = destinations(group, starts)
        return group[["row", *names]].assign(block=at // block, slot=(at % block).astype("int32"))

    for i in range(passes):
        low, high = width * i // passes, width * (i + 1) // passes
        digits = digit(parts, low, high - low)
        placed = state.withColumn("digit", digits).groupBy("block").cogroup(
            starts_of(state, digits).groupBy("of_block")).applyInPandas(place, layout)
        state = written(placed, "radix")
    return state.select("row", (F.col("block") * block + F.col("slot") + 1).alias("rank"))
