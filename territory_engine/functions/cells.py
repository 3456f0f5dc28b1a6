"""Grid cells on a longitude/latitude grid that wraps in longitude and is clipped in latitude.

Cells take the place of a hexagonal index: a cell id packs ``row * width + col`` in a long.
Every function returns a column expression, so cell work stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ANTIMERIDIAN_THRESHOLD


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Grid:
    """``width`` columns spanning 360 degrees of longitude, ``height`` rows from ``lat0`` up."""

    width: int = 360
    height: int = 180
    size: float = 1.0  # degrees of longitude per cell
    lon0: float = -180.0
    lat0: float = -90.0
    lat_size: float | None = None  # degrees of latitude per cell (default: ``size``)

    @property
    def dlat(self) -> float:
        return self.size if self.lat_size is None else self.lat_size

    # --- ids -------------------------------------------------------------------------------
    def cell(self, col: Column | str, row: Column | str) -> Column:
        c = F.pmod(_c(col).cast("long"), F.lit(self.width))
        return (_c(row).cast("long") * F.lit(self.width) + c).cast("long")

    def col_of(self, cell: Column | str) -> Column:
        return F.pmod(_c(cell), F.lit(self.width)).cast("long")

    def row_of(self, cell: Column | str) -> Column:
        return F.floor(_c(cell) / F.lit(self.width)).cast("long")

    # --- F12: point -> cell ----------------------------------------------------------------
    def cell_of_point(self, lat: Column | str, lon: Column | str) -> Column:
        col = F.floor((_c(lon) - F.lit(self.lon0)) / F.lit(self.size))
        row = F.least(F.greatest(F.floor((_c(lat) - F.lit(self.lat0)) / F.lit(self.dlat)), F.lit(0)), F.lit(self.height - 1))
        return self.cell(col, row)

    # --- F13: ring-1 neighbours, centre removed --------------------------------------------
    def neighbours(self, cell: Column | str) -> Column:
        """Array of the up to eight neighbours; longitude wraps, rows past the poles are dropped."""
        col, row = self.col_of(cell), self.row_of(cell)
        out = []
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                if dr == 0 and dc == 0:
                    continue
                r = row + F.lit(dr)
                out.append(F.when((r >= 0) & (r < self.height), self.cell(col + F.lit(dc), r)))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    def square(self, cell: Column | str, reach: int) -> Column:
        """Array of (cell, hops): the cells up to ``reach`` hops away, itself left out; wraps and ends as ``neighbours`` does."""
        col, row = self.col_of(cell), self.row_of(cell)
        side = F.sequence(F.lit(-reach), F.lit(reach))
        rows = F.filter(side, lambda dr: (row + dr >= 0) & (row + dr < self.height))
        steps = F.flatten(F.transform(rows, lambda dr: F.transform(side, lambda dc: F.struct(
            self.cell(col + dc, row + dr).alias("cell"), F.greatest(F.abs(dr), F.abs(dc)).cast("long").alias("hops")))))
        return F.filter(steps, lambda x: x["hops"] > 0)

    # --- hop distance (what a ring-by-ring flood fill counts) ------------------------------
    def distance(self, a: Column | str, b: Column | str) -> Column:
        dc = F.abs(self.col_of(a) - self.col_of(b))
        dc = F.least(dc, F.lit(self.width) - dc)
        dr = F.abs(self.row_of(a) - self.row_of(b))
        return F.greatest(dc, dr).cast("long")

    # --- F14: cell -> closed ring ----------------------------------------------------------
    def polygon(self, cell: Column | str) -> Column:
        x0 = F.lit(self.lon0) + self.col_of(cell).cast("double") * F.lit(self.size)
        y0 = F.lit(self.lat0) + self.row_of(cell).cast("double") * F.lit(self.dlat)
        x1, y1 = x0 + F.lit(self.size), y0 + F.lit(self.dlat)
        pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
        return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))


def ring_bounds(ring: Column | str) -> Column:
    """Bounding box of a ring of ``struct<lon, lat>`` points."""
    r = _c(ring)
    lons = F.transform(r, lambda p: p["lon"])
    lats = F.transform(r, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("minx"), F.array_min(lats).alias("miny"),
        F.array_max(lons).alias("maxx"), F.array_max(lats).alias("maxy"),
    )


def crosses_antimeridian(ring: Column | str, threshold: float = ANTIMERIDIAN_THRESHOLD) -> Column:
    """The bounds come within ``threshold`` degrees of both -180 and +180."""
    b = ring_bounds(ring)
    return (b["minx"] <= F.lit(-180.0 + threshold)) & (b["maxx"] >= F.lit(180.0 - threshold))
