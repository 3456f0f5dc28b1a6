"""Cells: flood fill = nearest by (distance, id); dissolve area and ring invariants."""

import random

from pyspark.sql import functions as F

from territory_engine.functions.cells import Grid, crosses_antimeridian
from territory_engine.operators import geo as G

GRID = Grid(width=24, height=12, size=15.0)


def brute(cells, seeds, grid):
    out = {}
    for c in cells:
        cc, cr = c % grid.width, c // grid.width
        best = None
        for sid, s in seeds:
            sc, sr = s % grid.width, s // grid.width
            dc = abs(cc - sc)
            d = max(min(dc, grid.width - dc), abs(cr - sr))
            if best is None or (d, sid) < best:
                best = (d, sid)
        out[c] = (best[1], best[0])
    return out


def test_nearest_and_frontier_match_brute_force(spark):
    rng = random.Random(3)
    all_cells = list(range(GRID.width * GRID.height))
    land = rng.sample(all_cells, 150)
    seeds = [(i + 1, rng.choice(all_cells)) for i in range(7)]
    land_df = spark.createDataFrame([(c,) for c in land], "cell bigint")
    seed_df = spark.createDataFrame(seeds, "seed_id bigint, cell bigint")
    expected = brute(land, seeds, GRID)
    got = {r["cell"]: (r["seed_id"], r["distance"]) for r in G.nearest_seed(land_df, seed_df, GRID).collect()}
    assert got == expected
    fill = G.keep_land(G.frontier_assign(seed_df, GRID), land_df)
    got2 = {r["cell"]: (r["seed_id"], r["distance"]) for r in fill.collect()}
    assert got2 == expected
    fill_land = G.keep_land(G.frontier_assign(seed_df, GRID, land=land_df), land_df)
    assert {r["cell"]: (r["seed_id"], r["distance"]) for r in fill_land.collect()} == expected


def test_nearest_on_a_fine_grid(spark):
    """0.25 degrees: few facilities far apart, many in one row, ties, repeated cells, cells off the grid."""
    grid = Grid(width=1440, height=720, size=0.25)
    rng = random.Random(11)
    cells = [rng.randrange(grid.width * grid.height) for _ in range(400)] + [0, grid.width - 1, 725 * grid.width + 3]
    for seeds in ([(9, 5)], [(i, rng.randrange(grid.width * grid.height)) for i in range(40)],
                  [(50 - i, 300 * grid.width + 36 * i) for i in range(40)] + [(3, 300 * grid.width + 36)]):
        got = {r["cell"]: (r["seed_id"], r["distance"]) for r in G.nearest_seed(
            spark.createDataFrame([(c,) for c in cells + cells[:9]], "cell bigint"), spark.createDataFrame(seeds, "seed_id bigint, cell bigint"), grid).collect()}
        assert got == brute(cells, seeds, grid)
    none = spark.createDataFrame([], "seed_id bigint, cell bigint")
    assert G.nearest_seed(spark.createDataFrame([(1,)], "cell bigint"), none, grid).count() == 0


def test_dissolve_area_and_closed_rings(spark):
    cells = [(0, 1), (1, 1), (2, 1), (24, 1), (26, 1), (48, 1), (49, 1), (50, 1),  # a ring with a hole at 25
             (100, 2), (125, 2)]  # two cells touching at a corner
    df = spark.createDataFrame(cells, "cell bigint, seed_id bigint")
    rings = G.dissolve(df, GRID, "seed_id").withColumn("area", G.ring_area("ring"))
    by_key = {}
    for r in rings.collect():
        pts = r["ring"]
        assert (pts[0]["lon"], pts[0]["lat"]) == (pts[-1]["lon"], pts[-1]["lat"])
        assert (r["area"] < 0) == r["is_hole"]
        by_key.setdefault(r["key"], []).append(r)
    cell_area = G.cell_area(GRID)
    assert abs(sum(r["area"] for r in by_key["1"]) - 8 * cell_area) < 1e-6
    assert sum(1 for r in by_key["1"] if r["is_hole"]) == 1
    assert len(by_key["2"]) == 2  # touching corners split into separate rings
    assert abs(sum(r["area"] for r in by_key["2"]) - 2 * cell_area) < 1e-6


def test_antimeridian(spark):
    df = spark.createDataFrame([(0,), (23,)], "cell bigint").select(GRID.polygon("cell").alias("ring"))
    flags = [r["x"] for r in df.select(crosses_antimeridian("ring").alias("x")).collect()]
    assert flags == [False, False]
    both = df.agg(F.flatten(F.collect_list("ring")).alias("ring"))
    assert both.select(crosses_antimeridian("ring").alias("x")).first()["x"] is True


def test_gate_reports_offenders(spark):
    land = spark.createDataFrame([(1, 10), (2, 11), (3, 11)], "land_id bigint, cell bigint")
    seeds = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "seed_id bigint, cell bigint")
    got = sorted((r["seed_id"], r["land_matches"]) for r in G.facility_gate(land, seeds).collect())
    assert got == [(2, 2), (3, 0)]


def _inside(px, py, rings):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > py) != (y2 > py):
                x = x1 + (py - y1) * (x2 - x1) / (y2 - y1)
                if px < x:
                    inside = not inside
    return inside


def test_cover_cells_matches_ray_casting(spark):
    grid = Grid(width=36, height=18, size=10.0)
    outer = [(-100.0, -35.0), (60.0, -50.0), (85.0, 40.0), (-20.0, 75.0), (-120.0, 10.0), (-100.0, -35.0)]
    hole = [(-30.0, -5.0), (10.0, -5.0), (10.0, 25.0), (-30.0, 25.0), (-30.0, -5.0)]
    tri = [(100.0, 0.0), (170.0, 0.0), (130.0, 60.0), (100.0, 0.0)]
    far = [(100.0, -60.0), (170.0, -60.0), (170.0, -20.0), (100.0, -20.0), (100.0, -60.0)]
    far_hole = [(120.0, -50.0), (150.0, -50.0), (150.0, -30.0), (120.0, -30.0), (120.0, -50.0)]
    polys = {"a": [[outer, hole]], "b": [[tri]], "two parts": [[tri], [far, far_hole]]}
    rows = [(k, [[[{"lon": x, "lat": y} for x, y in r] for r in part] for part in parts]) for k, parts in polys.items()]
    df = spark.createDataFrame(rows, "id string, parts array<array<array<struct<lon:double,lat:double>>>>")
    got = {(r["id"], r["cell"]) for r in G.cover_cells(df, grid).collect()}
    expected = set()
    for k, parts in polys.items():
        for row in range(grid.height):
            for col in range(grid.width):
                cx, cy = -180 + (col + 0.5) * 10, -90 + (row + 0.5) * 10
                if any(_inside(cx, cy, rings) for rings in parts):
                    expected.add((k, row * grid.width + col))
    assert got == expected and len(expected) > 20


def test_hash_tie_break_and_seeded_shuffle(spark):
    rng = random.Random(9)
    all_cells = list(range(GRID.width * GRID.height))
    seeds = [(i + 1, c) for i, c in enumerate(rng.sample(all_cells, 6))]
    seed_df = spark.createDataFrame(seeds, "seed_id bigint, cell bigint")
    exact = brute(all_cells, seeds, GRID)
    hashed = {r["cell"]: (r["seed_id"], r["distance"]) for r in G.frontier_assign(seed_df, GRID, tie="hash").collect()}
    assert {c: d for c, (_, d) in hashed.items()} == {c: d for c, (_, d) in exact.items()}
    sdict = dict((sid, c) for sid, c in seeds)
    for c, (sid, d) in hashed.items():  # every pick is at the nearest distance
        sc, sr, cc, cr = sdict[sid] % GRID.width, sdict[sid] // GRID.width, c % GRID.width, c // GRID.width
        dc = abs(cc - sc)
        assert max(min(dc, GRID.width - dc), abs(cr - sr)) == d
    df = spark.range(50).withColumnRenamed("id", "k")
    a = [r["k"] for r in G.seeded_shuffle(df, ["k"], 42).collect()]
    b = [r["k"] for r in G.seeded_shuffle(df, ["k"], 42).collect()]
    assert a == b and sorted(a) == list(range(50)) and a != list(range(50))


def test_rounds_of_many_rings_equal_single_rings(spark):
    """The rings per job change neither labels nor distances; facilities and land off the grid too."""
    rng = random.Random(21)
    cells = range(GRID.width * GRID.height)
    far = GRID.width * (GRID.height + 3) + 2
    for seeds in ([(5, 0)], [(i + 1, rng.choice(cells)) for i in range(5)] + [(0, far), (9, GRID.width * GRID.height + 4)], [(1, far)]):
        seed_df = spark.createDataFrame(seeds, "seed_id bigint, cell bigint")
        land = spark.createDataFrame([(c,) for c in rng.sample(cells, 60)] + [(far,)], "cell bigint")
        one, many = ({r["cell"]: (r["seed_id"], r["distance"]) for r in G.frontier_assign(seed_df, GRID, rings_per_job=n).collect()} for n in (1, 3))
        assert one == many
        one, many = (sorted(map(str, G.keep_land(G.frontier_assign(seed_df, GRID, land=land, rings_per_job=n), land).collect())) for n in (1, 8))
        assert one == many
