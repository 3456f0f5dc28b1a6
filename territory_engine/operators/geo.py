"""Facility territories on the cell grid (Q10): nearest-facility assignment, the ring-by-ring
flood fill, the data-quality gate and the dissolve of cells into facility outlines.

Nearest facility = smallest (hop distance, facility id). Two exact ways to compute it:

* ``nearest_seed`` — a distance transform along rows and columns, then the smallest id on the
  border of the square around each cell from a table of power-of-two runs. No cross join, no iteration.
* ``frontier_assign`` — the reference's flood fill, one ring of neighbours per round, each new
  cell taken by the smallest facility id among the cells that reach it. On an unobstructed
  grid both give the same labels.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import Grid
from ..plans.broadcast import DEFAULT_MAX_BROADCAST_ROWS
from ..session import ensure_checkpoint_dir


def row_distances(seeds: DataFrame, grid: Grid, seed_cell: str = "cell") -> DataFrame:
    """(r, x, f): for every facility row and column, the circular distance to the row's nearest facility.

    One group per facility row, which holds at most the grid's columns; the table is at most the grid.
    """
    width = grid.width

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(rows["x"].to_numpy())
        around = np.concatenate([[at[-1] - width], at, [at[0] + width]])
        x = np.arange(width)
        after = np.searchsorted(around, x)
        f = np.minimum(around[after] - x, x - around[after - 1])
        return pd.DataFrame({"r": rows["r"].iloc[0], "x": x, "f": f})

    return seeds.select(grid.row_of(seed_cell).alias("r"), grid.col_of(seed_cell).alias("x")).distinct().groupBy("r").applyInPandas(
        sweep, "r long, x long, f long")


def _column_distances(cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Nearest-facility distance of one column's cells from the rows' distances in that column.

    The distance of row ``y`` is the smallest ``k`` with a facility row within ``k`` whose distance
    is at most ``k``; it is found by bisection over minima of windows of rows (a sparse table).
    """
    if not len(cells) or not len(rows):
        return pd.DataFrame({"cell": [], "d": []})
    y = cells["y"].to_numpy()
    low, high = int(min(y.min(), rows["r"].min())), int(max(y.max(), rows["r"].max()))
    far = 1 << 40
    f = np.full(high - low + 1, far, dtype=np.int64)
    f[rows["r"].to_numpy() - low] = rows["f"].to_numpy()
    table = [f]
    while 2 * (1 << (len(table) - 1)) <= len(f):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    at = y - low
    lo, hi = np.zeros(len(y), dtype=np.int64), np.full(len(y), len(f) + int(rows["f"].max()), dtype=np.int64)
    while (lo < hi).any():
        k = (lo + hi) // 2
        first, last = np.maximum(at - k, 0), np.minimum(at + k, len(f) - 1)
        level = np.floor(np.log2(last - first + 1)).astype(np.int64)
        best = np.empty(len(y), dtype=np.int64)
        for p in np.unique(level):
            own = level == p
            best[own] = np.minimum(table[p][first[own]], table[p][last[own] - (1 << int(p)) + 1])
        found = best <= k
        hi, lo = np.where(found, k, hi), np.where(found, lo, k + 1)
    return pd.DataFrame({"cell": cells["cell"].to_numpy(), "d": lo})


def line_minima(seeds: DataFrame, grid: Grid, seed_cell: str = "cell", seed_id: str = "seed_id") -> DataFrame:
    """(axis, line, p, at, id): the smallest facility id in the 2^p cells from ``at`` on of a grid row
    (axis ``r``, wrapping) or column (axis ``c``, which may start below the grid).

    One group per line, which holds at most its cells; a level is the minimum of two shifted copies of
    the level before. The table has at most twice the grid's cells for each of log2(grid) levels.
    """
    col, row = grid.col_of(seed_cell), grid.row_of(seed_cell)
    lines = F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), line.alias("line"), at.alias("at"))
                                for axis, line, at in (("r", row, col), ("c", col, row))]))
    width, longest = grid.width, max(grid.width, grid.height)

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        wraps = rows["axis"].iloc[0] == "r"
        ids, code = np.unique(rows["id"].to_numpy(), return_inverse=True)
        at = rows["at"].to_numpy()
        pad = 0 if wraps else 2 * longest
        low = np.full(width if wraps else pad + int(at.max()) + 1, len(ids), dtype=np.int64)
        np.minimum.at(low, at + pad, code)
        out, span, p = [], 1, 0
        while True:
            some = np.flatnonzero(low < len(ids))
            out.append(pd.DataFrame({"p": p, "at": some - pad, "id": ids[low[some]]}))
            if span > longest:
                break
            ahead = np.roll(low, -span) if wraps else np.append(low[span:], np.full(min(span, len(low)), len(ids)))
            low, span, p = np.minimum(low, ahead), 2 * span, p + 1
        return pd.concat(out).assign(axis=rows["axis"].iloc[0], line=rows["line"].iloc[0])[["axis", "line", "p", "at", "id"]]

    kind = seeds.schema[seed_id].dataType.simpleString()
    return seeds.select(lines.alias("l"), F.col(seed_id).alias("id")).select("l.*", "id").distinct().groupBy("axis", "line").applyInPandas(
        runs, f"axis string, line long, p int, at long, id {kind}")


def nearest_seed(cells: DataFrame, seeds: DataFrame, grid: Grid, cell: str = "cell", seed_cell: str = "cell",
                 seed_id: str = "seed_id") -> DataFrame:
    """For each cell, the facility with the smallest (distance, id) -> (cell, seed_id, distance).

    Hop distance on the grid is Chebyshev distance (columns wrap). A distance transform first
    along rows, then along columns gives every cell's distance ``d``; no facility is nearer, so
    those at ``d`` lie on the border of the square around the cell, and the smallest id on each of its
    four sides is the smaller of two overlapping runs of a power-of-two length. All tables are at
    most the grid times its logarithm; no cell meets the facilities one by one.
    """
    c = cells.select(F.col(cell).alias("cell")).distinct().select("cell", grid.col_of("cell").alias("x"), grid.row_of("cell").alias("y"))
    distance = c.groupBy("x").cogroup(row_distances(seeds, grid, seed_cell).groupBy("x")).applyInPandas(
        _column_distances, "cell long, d long")
    p = F.floor(F.log2((2 * F.col("d") + 1).cast("double"))).cast("int")
    placed = distance.select("cell", "d", p.alias("p"), grid.col_of("cell").alias("x"), grid.row_of("cell").alias("y"))
    d, x, y = F.col("d"), F.col("x"), F.col("y")
    back = d - F.pow(F.lit(2.0), F.col("p")).cast("long") + 1  # from the middle to where the second run starts
    wrap = lambda q: F.pmod(q, F.lit(grid.width))
    runs = [F.struct(F.lit("r").alias("axis"), (y + side).alias("line"), wrap(x + start).alias("at")) for side in (-d, d) for start in (-d, back)]
    runs += [F.struct(F.lit("c").alias("axis"), wrap(x + side).alias("line"), (y + start).alias("at")) for side in (-d, d) for start in (-d, back)]
    asked = placed.select("cell", "d", "p", F.explode(F.array(*runs)).alias("q")).select("cell", "d", "p", "q.axis", "q.line", "q.at")
    return asked.join(line_minima(seeds, grid, seed_cell, seed_id), ["axis", "line", "at", "p"]).groupBy("cell").agg(
        F.min("id").alias("seed_id"), F.min("d").cast("long").alias("distance"))


def frontier_assign(seeds: DataFrame, grid: Grid, land: DataFrame | None = None, seed_cell: str = "cell",
                    seed_id: str = "seed_id", tie: str = "id", salt: int = 42, rings_per_job: int = 8) -> DataFrame:
    """The flood fill: grow every facility by some rings per round until no cell is left.

    Each round starts from the last ring alone. A cell ``r`` rings further on has cells of that ring ``r`` hops
    away and none nearer, and by the smallest-id rule it gets the smallest of their labels, so a
    round explodes each ring cell's square of ``rings_per_job`` hops (F13), drops the cells of the last two
    rounds (a breadth-first fill reaches no further back, so this equals "not yet visited", J4), takes the
    smallest (hops, facility) per new cell (A10) and appends the rings (U2). With ``tie="hash"`` (a
    repeatable hash of (salt, cell, facility)) a label depends on the labels of the ring before, so a round is
    one ring. Every round is checkpointed to the session's checkpoint folder, so lineage stays one round
    deep and a lost executor recomputes one round at most. With ``land`` the fill stops after the round in which
    every land cell is labelled (the labels of land cells are final by then).
    Returns (cell, seed_id, distance) for every cell reached; land that no facility reaches (cells off
    the grid, or no facility at all) is returned with a null facility and distance.
    """
    spark = seeds.sparkSession
    ensure_checkpoint_dir(spark)
    ring = (
        seeds.select(F.col(seed_cell).alias("cell"), F.col(seed_id).alias("seed_id"))
        .groupBy("cell").agg(F.min("seed_id").alias("seed_id"))
        .withColumn("distance", F.lit(0).cast("long"))
        .checkpoint()
    )
    rings = [ring]
    prev = ring.limit(0)
    land_cells = land.select("cell").distinct().withColumn("_land", F.lit(True)).checkpoint() if land is not None else None

    # rings and the visited set are bounded by the grid's cell count, a size known up front
    grid_small = grid.width * grid.height <= DEFAULT_MAX_BROADCAST_ROWS

    def bounded(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if grid_small else df

    serial = itertools.count()

    def materialise(r: DataFrame) -> tuple[DataFrame, int, int]:
        """Checkpoint a ring and count its cells and its land cells in the same job (observed)."""
        obs = Observation(f"ring-{uuid.uuid4().hex}-{next(serial)}")
        flagged = r.join(bounded(land_cells), "cell", "left") if land_cells is not None else r.withColumn(
            "_land", F.lit(None).cast("boolean"))
        ck = flagged.observe(obs, F.count(F.lit(1)).alias("n"), F.count("_land").alias("l")).select(
            "cell", "seed_id", "distance").checkpoint()
        return ck, obs.get["n"], obs.get["l"]

    land_left = land_cells.count() - materialise(ring)[2] if land_cells is not None else None
    edge, done = ring, 0
    while land_left is None or land_left > 0:
        reach = 1 if tie == "hash" or done == 0 else rings_per_job  # facilities off the grid enter it in the first ring only
        cand = edge.select(F.explode(grid.square("cell", reach)).alias("q"), "seed_id").select(
            "q.cell", "seed_id", (F.lit(done) + F.col("q.hops")).alias("distance"))
        seen = prev.select("cell").unionByName(ring.select("cell"))
        cand = cand.join(bounded(seen), "cell", "left_anti")
        if tie == "hash":
            key = F.xxhash64(F.lit(salt), F.col("cell"), F.col("seed_id"))
            pick = F.min_by(F.struct("distance", "seed_id"), F.struct(key, F.col("seed_id")))
        else:
            pick = F.min(F.struct("distance", "seed_id"))
        new, n_new, n_land = materialise(cand.groupBy("cell").agg(pick.alias("_p")).select(
            "cell", F.col("_p.seed_id").alias("seed_id"), F.col("_p.distance").alias("distance")))
        if n_new == 0:
            break  # nothing left to reach (land out of reach of every facility, or the grid is full)
        rings.append(new)
        prev, ring, done = ring, new, done + reach
        edge = new.where(F.col("distance") == done)
        if land_left is not None:
            land_left -= n_land
    out = rings[0]
    for r in rings[1:]:
        out = out.unionByName(r)
    if land_left:
        missed = land_cells.select("cell").join(out.select("cell"), "cell", "left_anti")
        out = out.unionByName(missed.select("cell", F.lit(None).cast(out.schema["seed_id"].dataType).alias("seed_id"),
                                            F.lit(None).cast("long").alias("distance")))
    return out


def keep_land(assigned: DataFrame, land: DataFrame) -> DataFrame:
    """Keep assigned cells that are land."""
    return assigned.join(land.select("cell").distinct(), "cell", "left_semi")


def facility_gate(land: DataFrame, seeds: DataFrame, seed_cell: str = "cell", seed_id: str = "seed_id") -> DataFrame:
    """Facilities whose cell is not exactly one land cell -> (seed_id, cell, land_matches).

    The reference asserts that joining facilities to land cells keeps one row per facility;
    here the offenders are reported instead (an empty result means the gate passes).
    """
    matches = land.groupBy("cell").agg(F.count(F.lit(1)).alias("land_matches"))
    s = seeds.select(F.col(seed_id).alias("seed_id"), F.col(seed_cell).alias("cell"))
    return (
        s.join(matches, "cell", "left")
        .select("seed_id", "cell", F.coalesce(F.col("land_matches"), F.lit(0)).cast("long").alias("land_matches"))
        .where(F.col("land_matches") != 1)
    )


# --------------------------------------------------------------------------- dissolve -------
_EDGE = T.StructType([
    T.StructField("x0", T.LongType()), T.StructField("y0", T.LongType()),
    T.StructField("x1", T.LongType()), T.StructField("y1", T.LongType()),
])

RING_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("ring_no", T.IntegerType()),
    T.StructField("is_hole", T.BooleanType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("xs", T.ArrayType(T.LongType())),
    T.StructField("ys", T.ArrayType(T.LongType())),
])


def boundary_edges(cells: DataFrame, grid: Grid, key: str) -> DataFrame:
    """Directed outline edges of each key's cell set, in integer grid corners.

    Each cell emits its four edges counter-clockwise; an edge shared by two cells of the same
    key appears once in each direction and cancels, so ``count == 1`` keeps the outline
    (two aggregations, both combined map-side). Column ``x`` runs 0..width, so a key that
    wraps around the grid keeps its seam as an outline edge, as separate polygons would.
    """
    x, y = grid.col_of("cell"), grid.row_of("cell")
    corners = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    edges = F.array(*[
        F.struct((x + a).alias("x0"), (y + b).alias("y0"), (x + c).alias("x1"), (y + d).alias("y1"))
        for a, b, c, d in corners
    ])
    e = cells.select(F.col(key).cast("string").alias("key"), F.inline(edges))
    a = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))
    b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return (
        e.groupBy("key", lo.alias("lo"), hi.alias("hi"))
        .agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("x0", "y0", "x1", "y1")).alias("e"))
        .where(F.col("n") == 1)
        .select("key", "e.*")
    )


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain one key's directed outline edges into closed rings.

    At a corner where two outlines touch, the walk takes the leftmost turn, so touching
    corners split into separate rings. Clockwise rings (negative signed area) are holes.
    """
    key = pdf["key"].iloc[0]
    out: dict[tuple[int, int], list[int]] = {}
    starts = list(zip(pdf["x0"].tolist(), pdf["y0"].tolist()))
    ends = list(zip(pdf["x1"].tolist(), pdf["y1"].tolist()))
    for i, s in enumerate(starts):
        out.setdefault(s, []).append(i)
    used = [False] * len(starts)
    rows = []
    ring_no = 0
    for first in sorted(range(len(starts)), key=lambda i: (starts[i][1], starts[i][0], ends[i])):
        if used[first]:
            continue
        xs, ys = [starts[first][0]], [starts[first][1]]
        cur = first
        while True:
            used[cur] = True
            (ax, ay), (bx, by) = starts[cur], ends[cur]
            xs.append(bx)
            ys.append(by)
            if (bx, by) == starts[first]:
                break
            dx, dy = bx - ax, by - ay
            options = [j for j in out.get((bx, by), []) if not used[j]]
            if not options:
                break

            def turn(j: int) -> int:
                ex, ey = ends[j][0] - bx, ends[j][1] - by
                cross = dx * ey - dy * ex
                dot = dx * ex + dy * ey
                return 0 if cross > 0 else (1 if dot > 0 else 2)  # left, straight, right

            cur = min(options, key=turn)
        area2 = sum(xs[i] * ys[i + 1] - xs[i + 1] * ys[i] for i in range(len(xs) - 1))
        rows.append((key, ring_no, area2 < 0, xs, ys))
        ring_no += 1
    return pd.DataFrame([(k, no, hole, _part_of(rows, no), xs, ys) for k, no, hole, xs, ys in rows],
                        columns=["key", "ring_no", "is_hole", "part", "xs", "ys"])


def _part_of(rows: list[tuple], no: int) -> int:
    """Number of the outer ring a ring belongs to: itself, or the smallest one around the hole."""
    _, _, hole, xs, ys = rows[no]
    if not hole:
        return no
    low = min(range(len(xs) - 1), key=lambda i: (ys[i], xs[i]))
    px, py = xs[low] + 0.5, ys[low] + 0.5  # inside the hole: its lowest, leftmost corner
    around = []
    for _, other, is_hole, ox, oy in rows:
        if is_hole:
            continue
        # rays to the left meet vertical unit edges only
        crossed = sum(1 for i in range(len(ox) - 1) if ox[i] == ox[i + 1] and ox[i] < px and min(oy[i], oy[i + 1]) < py < max(oy[i], oy[i + 1]))
        if crossed % 2:
            around.append((abs(sum(ox[i] * oy[i + 1] - ox[i + 1] * oy[i] for i in range(len(ox) - 1))), other))
    return min(around)[1]


def outline_parts(rings: DataFrame) -> DataFrame:
    """(key, parts): each key's outline as parts, an outer ring followed by its holes."""
    by_part = rings.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("is_hole", "ring_no", "ring"))).alias("rs"))
    return by_part.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "rs"))).alias("ps")).select(
        "key", F.transform("ps", lambda p: F.transform(p["rs"], lambda r: r["ring"])).alias("parts"))


def dissolve(cells: DataFrame, grid: Grid, key: str = "seed_id") -> DataFrame:
    """Outline rings of each key's cells -> (key, ring_no, is_hole, part, ring array<struct<lon,lat>>).

    ``part`` is the number of the outer ring a hole lies in (an outer ring's own number).

    Only the outline edges reach the grouped pandas step, one group per key; interior edges
    are cancelled by the aggregation before it.
    """
    rings = boundary_edges(cells, grid, key).groupBy("key").applyInPandas(_chain, RING_SCHEMA)
    lat_size = grid.dlat
    pts = F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y"))
    ring = F.transform(pts, lambda p: F.struct(
        (F.lit(grid.lon0) + p["x"].cast("double") * F.lit(grid.size)).alias("lon"),
        (F.lit(grid.lat0) + p["y"].cast("double") * F.lit(lat_size)).alias("lat"),
    ))
    return rings.select("key", "ring_no", "is_hole", "part", ring.alias("ring"))


def ring_area(ring: Column | str) -> Column:
    """Signed area of a closed ring (shoelace), positive when counter-clockwise."""
    r = F.col(ring) if isinstance(ring, str) else ring
    n = F.size(r)
    idx = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    terms = F.transform(idx, lambda i: F.element_at(r, i)["lon"] * F.element_at(r, i + 1)["lat"]
                        - F.element_at(r, i + 1)["lon"] * F.element_at(r, i)["lat"])
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / F.lit(2.0)


# --------------------------------------------------------------------------- extent ---------
def bounding_box(features: DataFrame, ring: str = "ring", group: list[str] | None = None) -> DataFrame:
    """A12 + A13: (minx, miny, maxx, maxy) and the box centre of each group's rings."""
    pts = features.select(*(group or []), F.explode(ring).alias("p"))
    keys = group or []
    agg = pts.groupBy(*keys).agg(
        F.min("p.lon").alias("minx"), F.min("p.lat").alias("miny"),
        F.max("p.lon").alias("maxx"), F.max("p.lat").alias("maxy"),
    )
    return agg.withColumns({
        "center_x": (F.col("minx") + F.col("maxx")) / 2.0,
        "center_y": (F.col("miny") + F.col("maxy")) / 2.0,
    })


def seeded_shuffle(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """A repeatable full shuffle, ordered by a salted hash of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), *[F.col(k) for k in key])


def cell_area(grid: Grid) -> float:
    return grid.size * grid.dlat


# --------------------------------------------------------------------------- cover ----------
def cover_cells(polygons: DataFrame, grid: Grid, key: str = "id", parts: str = "parts") -> DataFrame:
    """Cells whose centre lies inside a geometry of any number of parts (even-odd rule over all
    its rings, so holes are out) -> (key, cell).

    A scanline rasteriser instead of testing every cell against every edge: each ring edge
    yields its crossing longitude on every row of cell centres it spans; the crossings of one
    (polygon, row) are sorted and paired (inside between the 1st and 2nd, 3rd and 4th, ...),
    and each pair becomes a run of columns. Work grows with edges x rows spanned plus covered
    cells. Longitudes are taken as given (no wrap across the antimeridian).
    """
    dlat = grid.dlat
    edges = polygons.select(F.col(key).alias("key"), F.explode(F.flatten(parts)).alias("ring")).select(
        "key", F.explode(F.arrays_zip(
            F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring")).alias("b"),
        )).alias("e")
    ).select("key", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"),
             F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2")).where(F.col("y1") != F.col("y2"))
    # rows whose centre y = lat0 + (r + 0.5) * dlat satisfies min(y1, y2) <= y < max(y1, y2)
    lo = F.least("y1", "y2")
    hi = F.greatest("y1", "y2")
    r0 = F.ceil((lo - F.lit(grid.lat0)) / F.lit(dlat) - F.lit(0.5)).cast("long")
    r1 = (F.ceil((hi - F.lit(grid.lat0)) / F.lit(dlat) - F.lit(0.5)) - F.lit(1)).cast("long")
    r0c = F.greatest(r0, F.lit(0))
    r1c = F.least(r1, F.lit(grid.height - 1))
    spans = edges.where(r1c >= r0c).select("key", "x1", "y1", "x2", "y2", F.explode(F.sequence(r0c, r1c)).alias("row"))
    yc = F.lit(grid.lat0) + (F.col("row").cast("double") + F.lit(0.5)) * F.lit(dlat)
    xc = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = spans.select("key", "row", xc.alias("x")).groupBy("key", "row").agg(
        F.array_sort(F.collect_list("x")).alias("xs"))
    n_pairs = F.floor(F.size("xs") / 2).cast("int")
    pairs = crossings.select("key", "row", F.explode(F.transform(
        F.sequence(F.lit(0), n_pairs - 1), lambda i: F.struct(
            F.element_at("xs", i * 2 + 1).alias("xa"), F.element_at("xs", i * 2 + 2).alias("xb"))
    )).alias("p")).where(n_pairs > 0)
    # columns whose centre x = lon0 + (c + 0.5) * size satisfies xa <= x < xb
    c0 = F.ceil((F.col("p.xa") - F.lit(grid.lon0)) / F.lit(grid.size) - F.lit(0.5)).cast("long")
    c1 = (F.ceil((F.col("p.xb") - F.lit(grid.lon0)) / F.lit(grid.size) - F.lit(0.5)) - F.lit(1)).cast("long")
    c0c = F.greatest(c0, F.lit(0))
    c1c = F.least(c1, F.lit(grid.width - 1))
    cols = pairs.where(c1c >= c0c).select("key", "row", F.explode(F.sequence(c0c, c1c)).alias("col"))
    return cols.select(F.col("key").alias(key), grid.cell("col", "row").alias("cell")).distinct()


def exclude_pairs(cells: DataFrame, exclusions: DataFrame, keys: list[str]) -> DataFrame:
    """Drop listed (cell, country)-style pairs; Spark broadcasts the list if it is small."""
    return cells.join(exclusions.select(*keys), keys, "left_anti")
