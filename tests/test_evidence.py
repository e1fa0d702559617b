"""Operators without SQL: routes of messages and their backfill (A7, A8), united incidents (F15), the change marker."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siftline.operators import delivery
from siftline.operators.fusion import assign, incidents, merged
from siftline.streaming import fuse as stream

T0 = datetime(2026, 7, 27, 10, 0)
SPOTS = [(0, 0, "one", "district", 44.89, 37.32), (1, 0, "two", "place", 44.83, 37.56), (2, 0, "three", "district", 44.72, 37.77), (3, 0, "far", "region", 45.6, 39.0)]


def routes(spark, rows):
    """``rows``: message, text, signal, reason to drop, days before T0."""
    parsed = spark.createDataFrame([(i, "s", T0 - timedelta(days=d), "uav", 8, reason, signal, text) for i, text, signal, reason, d in rows], "message_id long, source_key string, posted_at timestamp, threat string, severity int, drop_reason string, signal string, text string")
    zones = spark.createDataFrame([(i, *s) for i, *_ in rows for s in SPOTS], "message_id long, pos int, start int, name string, level string, lat double, lon double")
    return delivery.message_routes(parsed, zones)


def marked():
    """A text in which the default marker is found."""
    return "drone from one over two towards three, heading for far, route via two"


def test_routes_of_messages(spark):
    got = {r.raw_message_id: r.points for r in routes(spark, [(1, marked(), "detection", None, 0), (2, "drone seen", "detection", None, 0), (3, marked(), "allclear", None, 0), (4, marked(), "detection", "recap", 0)]).collect()}
    assert set(got) == {1} and [p.name for p in got[1]] == ["one", "two", "three"]  # a region is a direction, not a point


def test_backfill_keeps_what_is_old(spark):
    made = routes(spark, [(1, marked(), "detection", None, 0), (2, marked(), "detection", None, 100), (3, marked(), "detection", None, 3)])
    point = made.schema["points"].dataType
    stored = made.where("raw_message_id IN (1, 2)").withColumn("severity", F.lit(1))
    got = {r.raw_message_id: r.severity for r in delivery.backfill_routes(stored, made, F.lit(T0)).collect()}
    assert got == {1: 8, 2: 1, 3: 8}
    gone = delivery.upsert_routes(stored, made.where("raw_message_id = 1").withColumn("points", F.lit(None).cast(point)))
    assert {r.raw_message_id for r in gone.collect()} == {2}


def test_merged_incidents(spark):
    """What two overlapping runs made of one feed is one row an incident, like a run over all of it."""
    schema = "raw_id long, source_key string, tier string, moment timestamp, signal string, threat string, severity int, zone_id string, zone_path array<string>, level string"
    rows = [(i, f"s{i % 3}", "federal", T0 + timedelta(minutes=4 * i), "danger", "uav", 1 + i % 7, "d1", ["d1", "r1"], "district") for i in range(4)]
    table = spark.createDataFrame(rows, schema)
    first, second = incidents(assign(table.where("raw_id < 3"))), incidents(assign(table))
    got, want = merged(first, second).collect(), second.collect()
    assert len(got) == len(want) == 1
    assert [c.raw_id for c in got[0].contributions] == [0, 1, 2, 3] and got[0].source_count == 3
    assert (got[0].id, got[0].severity, got[0].first_seen, got[0].last_seen) == (want[0].id, want[0].severity, want[0].first_seen, want[0].last_seen)
    alone = merged(first, second.limit(0)).collect()
    assert len(alone) == 1 and len(alone[0].contributions) == 3 and alone[0].source_count == 3


def test_change_marker(spark):
    marker = spark.createDataFrame([(7, 3)], "newest long, active long")
    assert stream.changed(marker, None) and not stream.changed(marker, marker)
    assert stream.changed(marker, marker.withColumn("active", F.lit(2).cast("long"))) and not stream.changed(marker.limit(0), marker)
