"""From messages to incidents: gates of the parse, guards of the linker, and the stream against the batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.functions import parsing
from siftline.operators import delivery, ingest, linking, observe
from siftline.operators.fusion import fuse
from siftline.streaming import fuse as stream

T0 = datetime(2026, 7, 27, 10, 0)

GATES = [
    ("drone detected near Alpha", (None, "detection", "uav", 8)),
    ("3 drones, Alpha", (None, "detection", "uav", 8)),  # T14: a telegram with a threat
    ("a drone heading for Alpha", (None, "danger", "uav", 5)),  # T14: on its way
    ("drone " + "x" * 250, ("unnamed", "unknown", "uav", 1)),  # T14: too long for a telegram
    ("fire at the market", ("unnamed", "unknown", "unknown", 1)),  # T9: weak without a threat
    ("fire after the drone", (None, "impact", "uav", 9)),
    ("unconfirmed explosion in Alpha", (None, "alarm", "unknown", 7)),  # T13
    ("expect detections of a drone in Alpha", (None, "danger", "uav", 5)),
    ("prepare for interceptions, siren later", (None, "alarm", "unknown", 7)),
    ("airport restrictions introduced in Alpha", (None, "infra", "airport", 2)),  # T15
    ("airport restrictions are lifted", (None, "allclear", "airport", 0)),
    ("debris found, a drone had been detected", ("aftermath", "detection", "uav", 8)),
    ("debris found after an explosion of a drone", (None, "impact", "uav", 9)),
    ("drone alarm, join our channel", ("promotion", "alarm", "uav", 7)),
    ("over the past night 3 drones shot down", ("recap", "intercept", "uav", 8)),
    ("over the past night alarm after alarm", (None, "alarm", "unknown", 7)),
    ("situation is calm, no threats", ("quiet", "danger", "unknown", 5)),
    ("explosion overseas", ("foreign", "impact", "unknown", 9)),
    ("explosion overseas and in our region", (None, "impact", "unknown", 9)),
    ("explosion, reported earlier " + "y" * 330, ("article", "impact", "unknown", 9)),
    ("be careful", ("caution", "caution", "unknown", 3)),
    ("", ("empty", "unknown", "unknown", 1)),
    (None, ("empty", "unknown", "unknown", 1)),
]


def test_gates(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GATES)], "message_id int, text string")
    got = {r.message_id: (r.drop_reason, r.signal, r.threat, r.severity) for r in parsing.parsed(rows).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, want) in enumerate(GATES)}


def test_phrases(spark):
    text = "Level: red, Gamma\nAlpha, Beta: drone. Over Delta - north"
    rows = spark.createDataFrame([(text,)], "text string")
    assert parsing.parsed(rows).first().phrases == ["Alpha", "Beta", "drone", "Over Delta", "north"]


ZONES = [
    ("r1", None, "region", "Northland", 1.0, 1.0, None),
    ("r2", None, "region", "Southland", 9.0, 9.0, None),
    ("d1", "r1", "district", "Alphan", 1.1, 1.1, None),
    ("p1", "d1", "place", "Gamma", 1.2, 1.2, 50_000),
    ("p2", "r2", "place", "Gamma", 9.2, 9.2, 90_000),
    ("p3", "r1", "place", "Light", 1.3, 1.3, 30_000),
    ("p4", "r1", "place", "Alphansky", 1.4, 1.4, 30_000),
    ("p5", "r2", "place", "Tiny", 9.5, 9.5, 200),
    ("p6", "r1", "place", "Spit", 1.5, 1.5, 40_000),
    ("p7", "r1", "place", "Georgian", 1.6, 1.6, 40_000),
]
ZONE = "zone_id string, parent_id string, level string, name string, lat double, lon double, population long"
LINKS = [
    ("Gamma", {"p2"}),  # the more populous of two, without evidence
    ("Gamma, Northland", {"p1", "r1"}),  # G8: another name decides
    ("Gamma Gamma", {"p2"}),  # G8: a repeated name is no witness
    ("The light was seen in Northland", {"r1"}),  # G7: a lower-case word in a text with capitals
    ("the city light in Northland", {"r1", "p3"}),  # G7: a marker in front
    ("LIGHT", {"p3"}),
    ("Alphansky bridge", set()),  # G5: an adjective before a feature
    ("Alphansky spit", set()),  # G5: a feature with a name in front
    ("over Spit Chushka, Northland", {"r1"}),  # G7: a feature with its name behind
    ("Georgian region", set()),  # G5: a region that is not among the zones
    ("Tiny", set()),  # G10: too small for one word
    ("Tiny, Southland", {"p5", "r2"}),
    ("alarm", set()),
]


def test_links(spark):
    zones = spark.createDataFrame(ZONES, ZONE)
    phrases = spark.createDataFrame([(i, n, p.strip()) for i, (t, _) in enumerate(LINKS) for n, p in enumerate(t.split(","))], "message_id int, pos int, phrase string")
    got = linking.link(phrases, zones, linking.name_index(zones))
    found = {}
    for r in got.collect():
        found.setdefault(r.message_id, set()).add(r.zone_id)
    assert {i: found.get(i, set()) for i in range(len(LINKS))} == {i: want for i, (_, want) in enumerate(LINKS)}


def test_aliases_by_kind(spark):
    """Aliases of regions, of landmarks and inside a region; a key that a zone has stays with that zone."""
    zones = spark.createDataFrame(ZONES, ZONE)
    rows = [("NL", "Northland", "region", None), ("Gam", "Gamma", "region", None), ("old gamma", "Gamma", None, None), ("north gamma", "Gamma", None, "Northland"), ("small one", "Tiny", "landmark", None), ("big one", "Gamma", "landmark", None), ("Light", "Gamma", None, None)]
    aliases = spark.createDataFrame(rows, "alias string, target string, kind string, within string")
    found = {}
    for r in linking.name_index(zones, aliases).collect():
        found.setdefault(r.norm, set()).add(r.zone_id)
    assert found["nl"] == {"r1"} and "gam" not in found and found["old gamma"] == {"p1", "p2"} and found["north gamma"] == {"p1"}
    assert "small one" not in found and found["big one"] == {"p1", "p2"} and found["light"] == {"p3"}
    assert {r.zone_id for r in linking.name_index(zones, aliases.select("alias", "target")).where("norm = 'gam'").collect()} == {"p1", "p2"}


def test_groups(spark):
    """A group's name stands for its members in the first region of the message, or in the source's home; without either for none."""
    zones = spark.createDataFrame([*ZONES, ("d2", "r1", "district", "Betan", 1.7, 1.7, None), ("d3", "r2", "district", "Gamman", 9.7, 9.7, None)], ZONE)
    groups = spark.createDataFrame([("the lowlands", "r1", "d1"), ("the lowlands", "r1", "d2"), ("the lowlands", "r1", "p3"), ("the lowlands", "r2", "d3"), ("the lowlands", "r2", "d1")], "group string, region_id string, zone_id string")
    texts = ["alarm in the lowlands,Northland", "alarm in the lowlands,Southland,Northland", "alarm in the lowlands", "alarm in the lowlands", "Alphan,the lowlands"]
    phrases = spark.createDataFrame([(i, n, p) for i, t in enumerate(texts) for n, p in enumerate(t.split(","))], "message_id int, pos int, phrase string")
    home = spark.createDataFrame([(1, "r1"), (3, "r2")], "message_id int, home_zone string")
    linked = linking.link(phrases, zones, linking.name_index(zones), home)
    found = {}
    for r in linking.with_groups(linked, phrases, groups, zones, home).collect():
        found.setdefault(r.message_id, []).append(r.zone_id)
    assert {k: sorted(v) for k, v in found.items()} == {0: ["d1", "d2", "r1"], 1: ["d3", "r1", "r2"], 3: ["d3"], 4: ["d1", "d2"]}


SOURCES = [("a", "federal", None, None), ("b", "federal", None, None), ("c", "regional", None, "Northland"), ("d", "regional", "net:x", None), ("e", "regional", "net:x", None)]
TEXTS = [
    (0, "a", "Drone detected, Light"),
    (2, "b", "A drone detected near Light"),
    (3, "c", "rocket alarm"),
    (4, "a", "join our channel, drone alarm in Light"),
    (5, "b", "Drone detected, Light, heading for Southland"),
    (6, "d", "Drones detected, Light"),
    (7, "e", "Drones detected, Light"),
    (9, "a", "All clear, drones, Light"),
    (12, "b", "Drone danger, Light"),
    (40, "b", "Drone danger, Light"),
    (41, "a", "rocket alarm"),
]


def messages(spark):
    rows = [(i + 1, s, T0 + timedelta(minutes=m), t) for i, (m, s, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "message_id long, source_key string, posted_at timestamp, text string")


@pytest.fixture
def gazetteer(spark):
    zones = spark.createDataFrame(ZONES, ZONE)
    return zones, linking.name_index(zones), spark.createDataFrame(SOURCES, "source_key string, tier string, network string, region string")


def test_messages_to_incidents(spark, gazetteer):
    seen = observe.observe(messages(spark), *gazetteer)
    rows = {(r.raw_id, r.zone_id): (r.signal, r.threat, r.severity) for r in seen.observations.collect()}
    assert rows[1, "p3"] == ("detection", "uav", 8) and rows[3, "r1"] == ("alarm", "rocket", 7) and 4 not in {k[0] for k in rows}
    assert rows[5, "p3"] == ("detection", "uav", 8) and rows[5, "r2"] == ("danger", "uav", 5)
    counted = observe.counters(seen).first().asDict()
    assert observe.counters(seen, messages(spark).limit(3)).first().held == 3
    assert counted == {"scanned": 11, "irrelevant": 1, "unplaced": 1, "by_source": 1, "observations": len(rows)}
    events = {(r.zone_id, r.first_seen): r for r in fuse(seen.observations).collect()}
    first = events["p3", T0]
    # two networked sources are one voice; the danger after the clear is its echo
    assert (first.voices, first.source_count, first.resolved_at) == (3, 4, T0 + timedelta(minutes=9))
    assert [c.role for c in first.contributions] == ["first", "confirm", "repeat", "confirm", "confirm", "resolve", "late"]
    assert ("p3", T0 + timedelta(minutes=40)) in events


def test_stream_of_messages_equals_batch(spark, gazetteer, tmp_path):
    rows = messages(spark)
    for i, (low, high) in enumerate(((1, 5), (6, 11))):
        rows.where(F.col("message_id").between(low, high)).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    sink = stream.FusionSink(f"{tmp_path}/out", 90, observe.preparation(*gazetteer), key="message_id", at="posted_at")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream.run(source, f"{tmp_path}/out", sink=sink)
    query.awaitTermination(300)
    assert query.exception() is None
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "changed").iterdir())
    columns = ["id", "zone_id", "signal", "severity", "threat", "first_seen", "last_seen", "resolved_at", "source_count", "voices", "confidence"]
    got = sink.finish(spark, last).select(columns).orderBy("id").collect()
    assert got == fuse(observe.observe(rows, *gazetteer).observations).select(columns).orderBy("id").collect()
    counts = spark.read.parquet(f"{tmp_path}/out/summary")
    assert counts.agg(F.sum("scanned")).first()[0] == rows.count() and counts.where("batch = 0").first().held > 0 and counts.where(f"batch = {last + 1}").first().held == 0
    marks = [spark.read.parquet(str(p)).first().mark for p in sorted((tmp_path / "out" / "mark").iterdir(), key=lambda p: int(p.name.split("=")[1]))]
    assert marks == sorted(marks) and marks[-1] == 11


def test_hold_back_is_a_prefix(spark):
    rows = spark.createDataFrame([(1, T0), (2, T0 + timedelta(minutes=10)), (3, T0 + timedelta(minutes=1)), (4, T0 + timedelta(minutes=9))], "raw_id long, moment timestamp")
    go, wait = stream.ready(rows, 300)
    assert {r.raw_id for r in go.collect()} == {1} and {r.raw_id for r in wait.collect()} == {2, 3, 4}
    go, wait = stream.ready(rows, 300, T0 + timedelta(hours=1))
    assert go.count() == 4 and wait.count() == 0


def test_reset_and_purge(spark, tmp_path):
    for name in ("incidents", "messages"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    ingest.reset_derived(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/incidents").count() == 0 and spark.read.parquet(f"{tmp_path}/messages").count() == 3
    rows = messages(spark)
    provenance = rows.select(F.col("message_id").alias("raw_message_id"))
    kept, of, routes = delivery.purge(rows, F.lit(T0 + timedelta(minutes=5)), 7, provenance, provenance)
    assert kept.count() == of.count() == routes.count() == 7
