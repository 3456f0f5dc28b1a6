"""Public API compositions and the remaining inventory items."""

import json
import os
import time

from pyspark.sql import functions as F

import territory_engine as TE
from conftest import SF_SMALL
from territory_engine.functions.cells import Grid
from territory_engine.operators.maps import features_for
from territory_engine.plans.observe import observed
from territory_engine.sources import testdata as TD
from territory_engine.sources.geojson import read_divisions
from territory_engine.streaming.ingest import run_batcher


def test_read_divisions_hive_layout(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "release")
    view = TD.divisions_view(spark, SF_SMALL)
    view.withColumn("theme", F.lit("divisions")).write.partitionBy("theme", "type").parquet(base)
    df = read_divisions(spark, base)
    assert {"theme", "type", "filename"} <= set(df.columns)
    out = TE.boundaries(df, "country")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert out.count() == TE.boundaries(view, "country").count() > 0


def test_observed_counts(spark):
    df, obs = observed(spark.range(37), "rows")
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 37


def test_features_for(spark):
    f = spark.createDataFrame([("US", None, None), (None, "US-CA", None), (None, None, "LAX")],
                              "country string, region string, colo string")
    assert features_for(f, "LAX").count() == 1
    assert features_for(f, "US-CA").count() == 1
    assert features_for(f, "ZZ").count() == 0


def test_assign_cells_with_exclusions(spark):
    grid = Grid(width=24, height=12, size=15.0)
    land = spark.createDataFrame([(c, "AA") for c in range(40, 80)], "cell bigint, country string")
    seeds = spark.createDataFrame([(1, 45), (2, 70), (3, 500)], "seed_id bigint, cell bigint")
    excl = spark.createDataFrame([(50, "AA")], "cell bigint, country string")
    assigned, outlines, offenders = TE.assign_cells(land, seeds, grid, excl, ["cell", "country"])
    cells = {r["cell"] for r in assigned.collect()}
    assert 50 not in cells and len(cells) == 39
    assert [r["seed_id"] for r in offenders.collect()] == [3]
    assert outlines.count() >= 2


def test_batcher_stream(spark, tmpdir_path):
    claims = TD.load_claims(spark, SF_SMALL).drop("seq")
    src = os.path.join(tmpdir_path, "accepted")
    claims.coalesce(2).write.parquet(src)
    stream = spark.readStream.schema(claims.schema).parquet(src)
    out = os.path.join(tmpdir_path, "batches")
    q = run_batcher(stream, out, os.path.join(tmpdir_path, "ck"), interval="1 second", max_claims=100)
    deadline = time.time() + 120
    while time.time() < deadline and not q.recentProgress:
        time.sleep(1)
    q.processAllAvailable()
    q.stop()
    objs = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert all(len(o["batch"]) <= 100 for o in objs)
    assert sum(len(o["batch"]) for o in objs) == claims.count()


def test_cli_assign_and_rank(spark, tmpdir_path):
    from territory_engine.__main__ import main
    from territory_engine.operators import claims as C
    from territory_engine.sources import state as ST
    land = TD.land_cells(TD.read_table(spark, SF_SMALL, "customer"))
    seeds = TD.facility_seeds(TD.read_table(spark, SF_SMALL, "supplier"))
    land.write.parquet(os.path.join(tmpdir_path, "land"))
    seeds.write.parquet(os.path.join(tmpdir_path, "fac"))
    out = os.path.join(tmpdir_path, "assign")
    main(["assign", "--land", os.path.join(tmpdir_path, "land"), "--facilities", os.path.join(tmpdir_path, "fac"),
          "--grid", "90,180,4,1", "--out", out])
    assert spark.read.parquet(out + "/cells").count() == land.select("cell").distinct().count()
    assert spark.read.text(out + "/outlines").count() > 0
    state_dir = os.path.join(tmpdir_path, "state")
    ST.write_state(C.fold_claims(TD.load_claims(spark, SF_SMALL)), state_dir, 0, 2)
    main(["rank", "--state", state_dir, "--out", os.path.join(tmpdir_path, "ranks"), "--as-of-ms", "1706659200000"])
    assert spark.read.json(os.path.join(tmpdir_path, "ranks", "leaderboards")).count() > 0


def test_cli_boundaries(spark, tmpdir_path):
    from territory_engine.__main__ import main
    base = os.path.join(tmpdir_path, "divisions")
    TD.divisions_view(spark, SF_SMALL).write.partitionBy("type").parquet(base)
    out = os.path.join(tmpdir_path, "regions")
    main(["boundaries", "--divisions", base, "--subtype", "region", "--out", out])
    feats = [json.loads(r["value"]) for r in spark.read.text(out).collect()]
    assert all(f["type"] == "Feature" for f in feats)
    assert {f["geometry"]["type"] for f in feats} == {"Polygon", "MultiPolygon"}
    assert "country_primary_name" in feats[0]["properties"]
