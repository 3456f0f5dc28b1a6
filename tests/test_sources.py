"""Sources and sinks: batch files, catalogue, GeoJSON round trip, WKB, versioned state."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from territory_engine.sinks import publish as P
from territory_engine.sources import batches as B
from territory_engine.sources import catalogue as CAT
from territory_engine.sources import geojson as GJ
from territory_engine.sources import state as ST


def claim(ip, name, t):
    return {"ip": ip, "name": name, "asn": 1, "colo": "LAX", "country": "US", "region": None, "metro": None,
            "city": None, "time_ms": t}


def test_batch_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "in")
    os.makedirs(d)
    files = {
        "a.json": {"batch": [claim("1.1.1.1", "x", 1), claim("2.2.2.2", "y", 2)], "workerTimestamp": 5, "workerId": "w"},
        "b.json": dict(claim("3.3.3.3", "z", 3), extra="ignored"),
        "c.json": {"batch": [], "workerId": "w"},
        "d.json": {"ip": "4.4.4.4", "name": "q", "time_ms": 4},
    }
    for n, obj in files.items():
        with open(os.path.join(d, n), "w") as f:
            json.dump(obj, f, indent=2)
    with open(os.path.join(d, "e.json"), "w") as f:
        f.write("{not json")
    objs = B.read_batch_files(spark, d)
    good, bad = B.quarantine(objs)
    assert bad.count() == 1
    rows = B.unwrap(good).collect()
    assert sorted((r["ip"], r["_offset"]) for r in rows) == [("1.1.1.1", 0), ("2.2.2.2", 1), ("3.3.3.3", 0), ("4.4.4.4", 0)]
    assert next(r for r in rows if r["ip"] == "4.4.4.4")["asn"] is None


def test_catalogue_parse_and_override(spark):
    text = spark.createDataFrame([(json.dumps({
        "AAA": {"city": "A", "lat": 1.0, "lon": 2.0, "name": "Shanghai, China", "region": "R", "cca2": "CN"},
        "BBB": {"city": "B", "lat": 3.0, "lon": 4.0, "name": "Bee", "region": "R", "cca2": "BE"},
    }),)], "value string")
    cat = CAT.parse_catalogue(text)
    assert sorted(r["colo"] for r in cat.collect()) == ["AAA", "BBB"]
    out = CAT.override_catalogue(cat, CAT.extra_facilities(spark))
    codes = {r["colo"] for r in out.collect()}
    assert "AAA" not in codes and "BBB" in codes and "SHA" in codes
    assert out.count() == 1 + len(CAT.EXTRA_FACILITIES)


def test_batch_files_with_many_objects(spark, tmpdir_path):
    """Any number of objects in a file; whatever is not exactly one value is set aside whole."""
    d = os.path.join(tmpdir_path, "many")
    os.makedirs(d)
    env = lambda *t: {"batch": [claim(f"9.9.9.{x}", "n", x) for x in t], "workerId": "w"}
    with open(os.path.join(d, "lines.json"), "w") as f:
        f.write("\n".join(json.dumps(env(x, x + 1)) for x in (1, 3, 5)) + "\n")
    with open(os.path.join(d, "pretty.json"), "w") as f:
        f.write("\n\n".join(json.dumps(env(x), indent=1) for x in (7, 8)))
    with open(os.path.join(d, "tricky.json"), "w") as f:  # braces and quotes inside strings
        f.write(json.dumps(claim("9.9.9.9", 'a}{"\\', 9)))
    with open(os.path.join(d, "trailing.json"), "w") as f:
        f.write(json.dumps(env(100)) + " and more")
    with open(os.path.join(d, "same_line.json"), "w") as f:
        f.write(json.dumps(env(101)) + json.dumps(env(102)))
    with open(os.path.join(d, "cut.json"), "w") as f:
        f.write(json.dumps(env(10)) + "\n" + json.dumps(env(103))[:-5])
    open(os.path.join(d, "empty.json"), "w").close()
    good, bad = B.quarantine(B.read_batch_files(spark, d))
    assert sorted(r["time_ms"] for r in B.unwrap(good).collect()) == list(range(1, 11))
    assert sorted(os.path.basename(r["_file"]) for r in bad.collect()) == ["cut.json", "same_line.json", "trailing.json"]
    import pytest
    with pytest.raises(Exception, match="unreadable object"):
        B.read_batch_files(spark, d, mode="FAILFAST").collect()


def test_wkb_parts_dimensions_and_flags(spark):
    import struct
    outer = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]
    far = [(9.0, 9.0), (9.5, 9.0), (9.5, 9.5), (9.0, 9.0)]

    def dims(code, extra, order="<"):  # one polygon with extra coordinates per point
        body = struct.pack(order + "BII" if order == "<" else ">BII", 1 if order == "<" else 0, code, 1)
        return body + struct.pack(order + "I", len(outer)) + b"".join(struct.pack(order + f"{2 + extra}d", *p, *[7.0] * extra) for p in outer)

    srid = struct.pack("<BIII", 1, 0x20000003, 4326, 1) + struct.pack("<I", 5) + b"".join(struct.pack("<2d", *p) for p in outer)
    cases = {1: GJ.polygon_wkb([outer, hole]), 2: GJ.multipolygon_wkb([[outer, hole], [far]]), 3: dims(1003, 1), 4: dims(0x80000003, 1),
             5: dims(3003, 2), 6: srid, 7: dims(3, 0, ">"), 8: None}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in cases.items()], "id int, g binary")
    got = {r["id"]: r["parts"] for r in GJ.decode_wkb(df, "g").collect()}
    shape = lambda parts: [[len(r) for r in p] for p in parts]
    assert shape(got[1]) == [[5, 5]] and shape(got[2]) == [[5, 5], [4]] and got[8] is None
    assert (got[1][0][1][1]["lon"], got[1][0][1][1]["lat"]) == (1.0, 2.0) and got[2][1][0][1]["lon"] == 9.5
    for k in (3, 4, 5, 6, 7):
        assert [(p["lon"], p["lat"]) for p in got[k][0][0]] == outer
    import pytest
    with pytest.raises(ValueError):
        GJ.wkb_parts(struct.pack("<BI", 1, 1) + struct.pack("<2d", 0, 0))


def test_multipolygon_round_trip_keeps_parts_and_holes(spark, tmpdir_path):
    sq = lambda x, n: [{"lon": x + a * n, "lat": b * n} for a, b in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]
    parts = [[sq(0.0, 3.0), list(reversed(sq(1.0, 1.0)))], [sq(10.0, 1.0)]]
    df = spark.createDataFrame([("two", parts), ("one", parts[1:]), ("none", None)],
                               "k string, parts array<array<array<struct<lon:double,lat:double>>>>")
    out = os.path.join(tmpdir_path, "multi")
    P.write_text(P.geojson_features(df, "parts", ["k"]), "feature", out)
    text = {json.loads(r["value"])["properties"]["k"]: json.loads(r["value"]) for r in spark.read.text(out).collect()}
    assert text["two"]["geometry"]["type"] == "MultiPolygon" and text["one"]["geometry"]["type"] == "Polygon"
    assert "geometry" not in text["none"]
    back = {r["properties"]["k"]: r["parts"] for r in GJ.read_feature_lines(spark, out).collect()}
    assert [[len(r) for r in p] for p in back["two"]] == [[5, 5], [5]] and len(back["one"]) == 1 and back["none"] is None


def test_outline_parts_put_holes_under_their_outer_ring(spark):
    from territory_engine.functions.cells import Grid
    from territory_engine.operators import geo as G
    grid = Grid(width=20, height=20, size=1.0)
    ring = [(x, y) for x in range(5) for y in range(5) if not (1 <= x <= 3 and 1 <= y <= 3)]  # an island inside a hole
    cells = [(1, y * 20 + x) for x, y in ring + [(2, 2)] + [(10, 10)]]
    df = spark.createDataFrame(cells, "seed_id long, cell long")
    parts = G.outline_parts(G.dissolve(df, grid)).first()["parts"]
    assert sorted(len(p) for p in parts) == [1, 1, 2]
    holed = next(p for p in parts if len(p) == 2)
    assert {(q["lon"], q["lat"]) for q in holed[0]} >= {(-180.0, -90.0), (-175.0, -85.0)}


def test_score_lists_are_written_by_type_and_window(spark, tmpdir_path):
    counts = spark.createDataFrame([("colo", "weekly", "LAX", "a", 2, 5), ("colo", "weekly", None, "a", 1, 3), ("country", "daily", "US", "b", 1, 9)],
                                   "territory_type string, time_window string, territory string, name string, count long, latest long")
    out = os.path.join(tmpdir_path, "scores")
    P.write_score_lists(counts, out, 77)
    assert sorted(os.listdir(out))[-2:] == ["territory_type=colo", "territory_type=country"]
    rows = spark.read.json(out).collect()
    assert {(r["territory_type"], r["time_window"], r["name"], len(r["scores"]), r["now"]) for r in rows} == {
        ("colo", "weekly", "a", 2, 77), ("country", "daily", "b", 1, 77)}


def test_old_state_versions_expire(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "st")
    rows = spark.createDataFrame([("1.1.1.1", "x", 1, None, None, None, None, None, 5)],
                                 "ip string, name string, asn long, colo string, country string, region string, metro string, city string, time_ms long")
    for v in (0, 3, 6):
        ST.write_state(rows, base, v)
    for v in (1, 2, 4, 5, 7):
        ST.write_delta(rows, base, v)
    before = {r["ip"] for r in ST.read_state(spark, base).collect()}
    assert ST.expire_versions(spark, base, 2) == [0, 1, 2]
    assert ST.versions(spark, base) == [3, 6] and ST.versions(spark, base + "/_delta") == [4, 5, 7]
    assert {r["ip"] for r in ST.read_state(spark, base).collect()} == before
    assert ST.expire_versions(spark, base, 2) == []


def test_geojson_round_trip(spark, tmpdir_path):
    ring = [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}, {"lon": 0.0, "lat": 0.0}]
    df = spark.createDataFrame([("LAX", [[ring]])], "colo string, parts array<array<array<struct<lon:double,lat:double>>>>")
    out = os.path.join(tmpdir_path, "geo")
    P.write_text(P.geojson_features(df, "parts", ["colo"]), "feature", out)
    back = GJ.read_feature_lines(spark, out).first()
    assert back["properties"]["colo"] == "LAX" and back["parts"][0][0][2]["lat"] == 1.0
    fc = {"type": "FeatureCollection", "features": [json.loads(spark.read.text(out).first()["value"])]}
    p = os.path.join(tmpdir_path, "fc.geojson")
    with open(p, "w") as f:
        json.dump(fc, f)
    assert GJ.read_feature_collection(spark, p).count() == 1


def test_versioned_state(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "state")
    s1 = spark.createDataFrame([claim("1.1.1.1", "x", 1)], ST.CLAIM)
    ST.write_state(s1, base, 0, 2)
    ST.write_state(s1.withColumn("name", F.lit("y")), base, 1, 2)
    assert ST.versions(spark, base) == [0, 1]
    assert ST.read_state(spark, base).first()["name"] == "y"
    assert ST.read_state(spark, base, before=1).first()["name"] == "x"
    assert ST.read_state(spark, base, before=0).count() == 0
    ST.write_delta(spark.createDataFrame([claim("2.2.2.2", "z", 3), claim("1.1.1.1", "q", 4)], ST.CLAIM), base, 2, 2)
    ST.write_delta(spark.createDataFrame([claim("2.2.2.2", "w", 5)], ST.CLAIM), base, 3, 2)
    got = {r["ip"]: r["name"] for r in ST.read_state(spark, base).collect()}
    assert got == {"1.1.1.1": "q", "2.2.2.2": "w"}
    assert {r["ip"]: r["name"] for r in ST.read_state(spark, base, before=3).collect()} == {"1.1.1.1": "q", "2.2.2.2": "z"}


def test_claim_envelopes(spark):
    rows = [claim(f"10.0.0.{i}", "n", i) for i in range(250)]
    df = spark.createDataFrame(rows, ST.CLAIM).repartition(2)
    env = [json.loads(r["value"]) for r in P.claim_envelopes(df, 100).collect()]
    assert all(len(e["batch"]) <= 100 for e in env)
    assert sum(len(e["batch"]) for e in env) == 250


def test_leaderboard_document(spark):
    board = spark.createDataFrame(
        [("colo", "hourly", "a", "LAX", 2, 10, 1, 1), ("colo", "hourly", "b", "SFO", 1, 9, 1, 2)],
        "territory_type string, time_window string, name string, territories string, ip_count bigint, latest bigint, score bigint, rank bigint")
    rec = spark.createDataFrame([("a", "US", None, "LAX", 10, "1.x.x.x")],
                                "name string, country string, region string, colo string, time_ms bigint, ip string")
    doc = json.loads(P.leaderboard_document(board, rec).first()["document"])
    assert [r["name"] for r in doc["colo"]["hourly"]] == ["a", "b"]
    assert doc["region"] == {} and doc["country"] == {}
    assert doc["recents"][0]["ip"] == "1.x.x.x"


def test_legacy_snapshot(spark, tmpdir_path):
    doc = {"latestClaim": 1700000000.5, "values": [
        {"ip": "1.1.1.1", "name": "x", "colo": "LAX", "country": "US", "region": None, "timestamp": 1700000000.5},
        {"ip": "2.2.2.2", "name": "y", "colo": "SFO", "country": "US", "region": "US-CA", "timestamp": 1699999999.25},
    ]}
    p = os.path.join(tmpdir_path, "snap.json")
    with open(p, "w") as f:
        json.dump(doc, f)
    rows, mark = ST.read_snapshot(spark, p)
    assert sorted((r["ip"], r["time_ms"]) for r in rows.collect()) == [("1.1.1.1", 1700000000500), ("2.2.2.2", 1699999999250)]
    assert mark.first()["latest_claim"] == 1700000000500


def test_objects_of_any_depth_are_read(spark, tmpdir_path):
    """Unknown keys may nest as deep as they like; what is not exactly one value stays unreadable."""
    claim = '{"ip": "1.2.3.4", "name": "n", "time_ms": 5, "x": %s}'
    deep = "[{\"k}\": " * 60 + "1" + "}]" * 60
    good = [claim % deep, claim % ("[" * 300 + "]" * 300), claim % '{"a": "}{ \\\\ \\" ]["}', "{}"]
    bad = [claim % deep + " x", claim % deep[:-1], claim % ("[" * 40 + "}" * 40), (claim % deep)[:-1], "x" + claim % deep, claim % deep + ", 1"]
    for i, text in enumerate(good + bad):
        with open(os.path.join(tmpdir_path, f"{i:02}.json"), "w") as f:
            f.write(text)
    ok, aside = B.quarantine(B.read_batch_files(spark, tmpdir_path))
    assert sorted(r["_file"][-7:-5] for r in ok.collect()) == ["00", "01", "02", "03"]
    assert B.unwrap(ok).where("ip is not null").count() == 3
    assert sorted(r["_corrupt_record"] for r in aside.collect()) == sorted(bad)


@pytest.mark.parametrize("split_bytes", [64, 333, 1 << 20])
def test_large_snapshots_are_read_in_splits(spark, tmpdir_path, split_bytes):
    """A one-line document cut into many small splits gives the rows of the document read whole."""
    import json
    rng = random.Random(split_bytes)
    texts = ["plain", "br{ace", "cl}ose", 'quo"te', "back\\\\", "[", "]}", "é", "", None, '\\"}', "a},{b"]
    values = [{"ip": f"1.1.{i // 250}.{i % 250}", "name": rng.choice(texts), "colo": rng.choice(texts), "country": "c", "region": None,
               "timestamp": i + 0.25, **({"extra": {"deep": [{"x": "}"}, []]}} if i % 7 == 0 else {})} for i in range(400)]
    docs = {"a.json": json.dumps({"latestClaim": 12.5, "values": values}), "b.json": json.dumps({"values": values[:1], "latestClaim": 3.0}, indent=2),
            "c.json": json.dumps({"latestClaim": 1.5, "values": []}) + "\n", "d.json": json.dumps({"meta": {"a": 1}, "values": values[5:9], "z": 1}),
            "e.json": ""}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, text in docs.items():
        path = os.path.join(tmpdir_path, name)
        with open(path, "w") as f:
            f.write(text)
        want, want_mark = ST.read_snapshot_whole(spark, path)
        want, want_mark = sorted(map(repr, want.collect())), [r for r in want_mark.collect() if r[0] is not None]
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        try:
            rows, mark = ST.read_snapshot(spark, path)
            assert sorted(map(repr, rows.collect())) == want
            assert [r for r in mark.collect() if r[0] is not None] == want_mark
            if name == "a.json" and split_bytes < 1000:
                assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_unfinished_objects_are_found_in_one_pass(spark):
    """Whether a text is one value takes steps that don't grow with its depth or its brackets, and is asked once an object."""
    import time
    deep = '{"a": [' * 1500
    texts = [deep + "0" + "]}" * 1500, deep + "0" + "]}" * 1499 + "]", deep + "0" + "]}" * 1500 + "}", "(" + deep + "0" + "]}" * 1500, "{(}", "{}", "{}{}", "[[]{}]", "[]]["]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "id int, t string").coalesce(1)
    began = time.time()
    got = df.select("id", B._one_value(F.col("t")).alias("w")).collect()
    assert {r["id"] % len(texts) for r in got if r["w"]} == {0, 4, 5, 7} and time.time() - began < 15


def test_objects_are_checked_once(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "a.json"), "w") as f:
        json.dump(claim("1.1.1.1", "x", 1), f)
    rows = B.unwrap(B.quarantine(B.read_batch_files(spark, tmpdir_path))[0])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and rows.count() == 1
