"""Readers, text columns, routes and spatial edges on literal rows."""

import json
import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import delivery, linking, networks, spatial
from siftline.sources import readers


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_text_columns(spark):
    assert one(spark, T.norm_key, "Ёлка​-Парк,  «Дом»") == ["елка -парк дом"]
    assert one(spark, T.strip_unit, "North District") == ["north"]
    assert one(spark, T.expand_units, "distr. Alpha") == ["district Alpha"]
    assert one(spark, T.slug, "Жёлтый Щит 7") == ["zheltyy_shchit_7"]
    assert one(spark, T.stem_key, "running waters as") == ["runn wat as"]
    assert one(spark, T.direction, "moving north-east", "still") == [45, None]
    assert one(spark, T.count_of, "7 drones, then 12 targets and 900 units") == [12]
    assert one(spark, T.signal, "explosion near the bridge", "nothing") == ["impact", "unknown"]
    assert one(spark, T.strip_footer, "drone seen\nSubscribe to us\n@channel") == ["drone seen"]


def test_parse(spark):
    rows = spark.createDataFrame([(1, "drone detected near Alpha, massive\nfollow us")], "message_id long, text string")
    got = T.parsed(rows).first()
    assert (got.signal, got.threat, got.severity, got.massive) == ("detection", "uav", 9, True)
    assert got.phrases == ["drone detected near Alpha", "massive"]


def test_jsonl_and_time(spark, tmp_path):
    lines = [{"message_id": 1, "date": "2026-07-27T10:00:00Z", "text": "a"}, {"message_id": 2, "date": "2026-07-27T13:00:00", "text": "b", "source": "own"}, {"message_id": 3, "text": "c"}, {"message_id": 4, "date": "2026-07-27T10:00:00Z", "text": ""}]
    (tmp_path / "alpha.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    got = readers.messages_jsonl(spark, str(tmp_path)).orderBy("message_id").collect()
    assert [(r.source_key, r.posted_at) for r in got] == [("alpha", datetime(2026, 7, 27, 10)), ("own", datetime(2026, 7, 27, 10))]


def test_feeds(spark, tmp_path):
    (tmp_path / "h.csv").write_text("latitude,longitude,frp\n50.12345,30.1,7.26\nbad,30,9\n10,30,9\n50,30,1\n")
    assert [tuple(r) for r in readers.hotspots(spark, f"{tmp_path}/h.csv").collect()] == [(50.123, 30.1, 7.3)]
    shape = {"type": "Feature", "properties": {"name": "sq"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}}
    (tmp_path / "g.json").write_text(json.dumps({"features": [shape, {"properties": {"name": ""}, "geometry": shape["geometry"]}]}))
    v = readers.geojson(spark, f"{tmp_path}/g.json")
    points = spark.createDataFrame([("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("out", 5.0, 1.0)], "point_id string, lon double, lat double")
    assert [r.point_id for r in spatial.contains(points, v).collect()] == ["in"]
    assert spatial.feature_area(v).first().area == 15.0


def test_rings(spark):
    rows = [("f", 0, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (0.0001, 0), (4, 0), (4, 4), (0, 0)])] + [("g", 0, 0, i, 0.0001 * i, 0.0) for i in range(4)]
    v = spark.createDataFrame([(*r[:4], float(r[4]), float(r[5])) for r in rows], "feature_id string, part int, ring int, seq int, lon double, lat double")
    assert {(r.feature_id, r.seq) for r in spatial.rounded(v).collect()} == {("f", 0), ("f", 2), ("f", 3), ("f", 4)}


def test_routes(spark):
    points = lambda *p: [(float(a), float(b), n) for a, b, n in p]
    straight, still = points((44.89, 37.32, "a"), (44.83, 37.56, "b"), (44.72, 37.77, "c")), points((44.0, 37.0, "a"), (44.001, 37.0, "b"))
    rows = spark.createDataFrame([(1, straight), (2, still), (3, points((44, 37, "a"), (48, 37, "b"))), (4, [])], "k int, p array<struct<lat:double,lon:double,name:string>>")
    got = {r.k: r.r for r in rows.select("k", delivery.route(F.col("p")).alias("r")).collect()}
    assert [p.name for p in got[1]] == ["a", "b", "c"] and got[2] is None and got[3] is None and got[4] is None


def test_provenance(spark):
    rows = [("e", i, s, role, datetime(2026, 1, 1, 10, i), t) for i, (s, role, t) in enumerate([("a", "first", "x" * 130), ("b", "confirm", "x" * 130), ("a", "repeat", ""), ("c", "confirm", "short"), ("d", "confirm", "short")])]
    table = spark.createDataFrame(rows, "event_id string, raw_message_id long, source_key string, role string, contributed_at timestamp, text string")
    nets = spark.createDataFrame([("c", "n1"), ("d", "n1")], "source_key string, network string")
    got = {r.source_key: r for r in networks.walk(table, nets).collect()}
    assert got["a"].counted and got["b"].repost and not got["b"].counted and got["c"].counted and got["d"].clone
    assert networks.independent(networks.walk(table, nets)).first().voices == 2


def test_context_decides(spark):
    zones = spark.createDataFrame(
        [("r1", None, "region", "Alpha", 0.0, 0.0, None), ("r2", None, "region", "Bravo", 0.0, 0.0, None), ("p1", "r1", "place", "Springfield", 0.0, 0.0, 10), ("p2", "r2", "place", "Springfield", 0.0, 0.0, 90_000)],
        "zone_id string, parent_id string, level string, name string, lat double, lon double, population long",
    )
    phrases = spark.createDataFrame([(1, 0, "Springfield in Alpha"), (2, 0, "near Springfield")], "message_id long, pos int, phrase string")
    got = linking.link(phrases, zones, linking.name_index(zones))
    assert {(r.message_id, r.zone_id) for r in got.collect()} == {(1, "p1"), (1, "r1"), (2, "p2")}
    assert {(r.message_id, r.zone_id) for r in linking.drop_covered(got, zones).collect()} == {(1, "p1"), (2, "p2")}


def test_raster_is_as_large_as_the_polygon(spark):
    """Cells of a grid against exact areas: boxes, a triangle and a ring with a hole, under one per cent apart."""
    rng = random.Random(3)
    shapes = {}
    for n in range(20):
        x, y, w, h = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0.3, 1.0), rng.uniform(0.3, 1.0)
        shapes[f"b{n}"] = ([[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]], w * h)
    shapes["t"] = ([[(0.01, 0.02), (1.31, 0.43), (0.37, 1.2)]], abs(1.3 * 1.18 - 0.36 * 0.41) / 2)
    shapes["o"] = ([[(3.0, 3.0), (4.0, 3.0), (4.0, 4.0), (3.0, 4.0)], [(3.25, 3.25), (3.75, 3.25), (3.75, 3.75), (3.25, 3.75)]], 0.75)
    rows = [(name, 0, r, i, *p) for name, (rings, _) in shapes.items() for r, ring in enumerate(rings) for i, p in enumerate([*ring, ring[0]])]
    vertices = spark.createDataFrame(rows, "feature_id string, part int, ring int, seq int, lon double, lat double")
    cells = {r.feature_id: r.n for r in spatial.raster(vertices, 0.002).groupBy("feature_id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).collect()}
    assert set(cells) == set(shapes) and all(abs(cells[k] * 0.002**2 / area - 1) < 0.01 for k, (_, area) in shapes.items())
    assert spatial.overlap_cells(vertices, vertices, 0.002).where("unit_id = feature_id").count() == len(shapes)


def test_containment_by_cells(spark):
    """P1 against even-odd over all edges: stars with holes, in cells of any size, points on the lines of the grid among them."""
    rng = random.Random(8)
    rows, rings = [], {}
    for n in range(6):
        x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
        for r, size in enumerate((2.0, 0.7)):
            ring = [(x + size * rng.uniform(0.6, 1) * math.cos(2 * math.pi * k / 17), y + size * rng.uniform(0.6, 1) * math.sin(2 * math.pi * k / 17)) for k in range(17)]
            rings.setdefault(f"f{n}", []).append([*ring, ring[0]])
            rows += [(f"f{n}", 0, r, i, *p) for i, p in enumerate([*ring, ring[0]])]
    square = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]
    rings["sq"] = [square]
    rows += [("sq", 0, 0, i, *p) for i, p in enumerate(square)]
    vertices = spark.createDataFrame(rows, "feature_id string, part int, ring int, seq int, lon double, lat double")
    points = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(400)] + [(1000 + i, (i % 11 - 5) / 4 + 0.0001, (i // 11 - 5) / 4) for i in range(121)]

    def holds(feature, lon, lat):
        n = 0
        for ring in rings[feature]:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
                n += (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
        return n % 2 == 1

    want = {(i, f) for i, lon, lat in points for f in rings if holds(f, lon, lat)}
    at = spark.createDataFrame(points, "point_id long, lon double, lat double")
    for band in (0.3, 0.5, 2.0):
        found = [tuple(r) for r in spatial.contains(at, vertices, band).collect()]
        assert set(found) == want and len(found) == len(want) > 100
