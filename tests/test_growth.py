"""What must not grow faster than the input, on literal rows."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline.functions import parsing
from siftline.operators import delivery, fusion, linking, observe
from siftline.plans import exchange, views
from siftline.sources import scratch

DATA = "/root/testdata/sf0.001"

T0 = datetime(2026, 7, 27, 10, 0)
OBSERVED = "raw_id long, source_key string, tier string, moment timestamp, signal string, threat string, severity int, zone_id string, zone_path array<string>"


def observed(spark, rows):
    made = [(i, f"s{i % 5}", "federal", T0 + timedelta(minutes=m), signal, threat, 0 if signal == "allclear" else 1 + i % 9, path[0], path) for i, (m, signal, threat, path) in enumerate(rows)]
    return spark.createDataFrame(made, OBSERVED)


def test_clears_by_full_fan_out(spark):
    """clears of three levels and several threats against the walk that gets every clear of every zone above."""
    rng = random.Random(5)
    paths = [[f"p{p}", f"d{p % 3}", "r"] for p in range(7)]
    rows = [(rng.randrange(0, 1500), rng.choice(["danger", "danger", "allclear"]), rng.choice(["uav", "rocket", "unknown", "airport"]), rng.choice(paths)[rng.choice((0, 0, 0, 1, 2)):]) for _ in range(500)]
    table = observed(spark, rows)
    empty = spark.createDataFrame([], f"zone_id string, zone_path array<string>, open struct<{fusion._as_struct(fusion.OPEN)}>")
    columns = [c for c in fusion.fuse(table).columns if c != "contributions"]
    want = fusion.incidents(fusion.assign(table, empty)).select(columns).orderBy("zone_id", "id").collect()
    got = fusion.fuse(table).select(columns).orderBy("zone_id", "id").collect()
    assert got == want and sum(r.resolved_at is not None for r in got) > 30


def test_clears_only_go_where_something_is_open(spark):
    """60 zones with one report each and 40 clears above them: a clear goes to the zones that it ends something in."""
    rows = [(z, "danger", "uav", [f"p{z}", "r"]) for z in range(60)] + [(100 + 10 * k, "allclear", "uav", ["r"]) for k in range(40)]
    assert fusion.timelines(observed(spark, rows)).where("clear").count() <= 60
    assert fusion.fuse(observed(spark, rows)).where("resolved_at IS NOT NULL").count() == 60


def test_equal_lists_are_linked_once(spark):
    """Messages with the same phrases share one run of the linker, and each gets its zones."""
    zones = spark.createDataFrame([("r1", None, "region", "Alpha", 0.0, 0.0, None), ("p1", "r1", "place", "Springfield", 0.0, 0.0, 50_000)], "zone_id string, parent_id string, level string, name string, lat double, lon double, population long")
    lists = spark.range(200).select(F.col("id").alias("message_id"), F.array(F.struct(F.lit(0).alias("pos"), F.when(F.col("id") % 2 == 0, "Springfield in Alpha").otherwise("over Alpha").alias("phrase"))).alias("phrases"), F.lit(None).cast("string").alias("home_zone"))
    linked = linking.link_lists(lists, zones, linking.name_index(zones))
    assert linked.rows.count() == 3
    got = {(r.message_id, r.zone_id) for r in linked.expand(linked.rows).collect()}
    assert got == {(i, "r1") for i in range(200)} | {(i, "p1") for i in range(0, 200, 2)}


def shuffled(frame):
    """Fields of the rows that each shuffle of a plan carries."""
    plan = frame._jdf.queryExecution().sparkPlan().toString() + frame._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "recipient#" in line and "alert#" in line]


def test_alerts_are_not_shuffled(spark, monkeypatch):
    """pairs against brute force, with recipients in many parts; no shuffle by recipient and alert."""
    monkeypatch.setattr(delivery, "BLOCK", 3)
    rng = random.Random(2)
    people = {f"u{n}": sorted(rng.sample(["a", "b", "c", "r"], rng.choice((1, 1, 2, 3)))) for n in range(40)}
    events = {f"e{n}": ([rng.choice("abcd"), "r"], n % 3 == 0) for n in range(30)}
    subs = spark.createDataFrame([(u, z) for u, zones in people.items() for z in (zones, zones[:1])], "recipient string, zones array<string>")
    incidents = spark.createDataFrame([(i, path, T0 if done else None) for i, (path, done) in events.items()], "id string, zone_path array<string>, resolved_at timestamp")
    pairs = {(u, i) for u, zones in people.items() for i, (path, _) in events.items() if set(zones) & set(path)}
    met = [tuple(r) for r in delivery.watching(incidents, subs).select("recipient", "id").collect()]
    assert len(met) == len(set(met)) and set(met) == pairs
    named = {(u, i + (":clear" if events[i][1] else "")) for u, i in pairs}
    gone = set(rng.sample(sorted(named), len(named) // 3))
    ledger = spark.createDataFrame([(*g, T0) for g in gone] + [("u0", "other", T0)], "recipient string, alert string, at timestamp")
    out = delivery.alerts(incidents, subs, ledger)
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == named - gone
    assert not shuffled(out)


def test_incidents_meet_recipients_in_cells(spark, monkeypatch):
    """what is shuffled to make pairs does not grow with the number of recipients; every cell gives its pairs once."""
    monkeypatch.setattr(delivery, "BLOCK", 2)
    seen = []
    monkeypatch.setattr(delivery, "dealt", lambda rows, *by: seen.append(rows.count()) or scratch.dealt(rows, *by))
    incidents = spark.createDataFrame([(f"e{n}", ["abcd"[n % 4], "r"]) for n in range(200)], "id string, zone_path array<string>")
    for people, cells, strip in ((10, 1, 999), (80, 1, 999), (80, 40, 999), (80, 1, 5), (0, 40, 5)):
        monkeypatch.setattr(delivery, "CELLS", cells, raising=False)
        monkeypatch.setattr(delivery, "STRIP", strip, raising=False)
        lists = {f"u{n}": (["a"], ["a", "b"], ["r"], ["c", "r"])[n % 4] for n in range(people)}
        subs = spark.createDataFrame(list(lists.items()), "recipient string, zones array<string>")
        assert delivery.watching(incidents.limit(0), subs).count() == 0
        met = [tuple(x) for x in delivery.watching(incidents, subs).select("recipient", "id").collect()]
        assert len(met) == len(set(met)) and set(met) == {(u, f"e{n}") for u, zones in lists.items() for n in range(200) if {"abcd"[n % 4], "r"} & set(zones)}
    # a row for each zone that is watched: a, b, c and, of all incidents, r
    assert seen[1:4:2] == [350, 350] and seen[5] < 4 * 350 < seen[7]


@pytest.mark.parametrize("kinds", ["zone", "recipient", "zone recipient"])
def test_ledger_by_zone(spark, monkeypatch, kinds):
    """alerts that were published to a zone, sent to one recipient, or both, against brute force; some too long ago."""
    monkeypatch.setattr(delivery, "BLOCK", 3)
    rng = random.Random(3)
    people = {f"u{n}": sorted(rng.sample(["a", "b", "c", "r"], rng.choice((1, 1, 2, 3)))) for n in range(30)}
    events = {f"e{n}": ([rng.choice("abcd"), "r"], n % 3 == 0) for n in range(30)}
    names = {i: i + (":clear" if done else "") for i, (_, done) in events.items()}
    entries = [(rng.choice(sorted(people)) if kind == "recipient" else None, rng.choice("abcdr") if kind == "zone" else None, rng.choice(sorted(names.values())), T0 - timedelta(hours=rng.choice((1, 30)))) for kind in kinds.split() for _ in range(60)]
    recent = [(u, z, alert) for u, z, alert, at in entries if at > T0 - timedelta(hours=24)]
    gone = {(u, alert) for u, _, alert in recent} | {(u, alert) for _, z, alert in recent for u, zones in people.items() if z in zones}
    want = {(u, names[i]) for u, zones in people.items() for i, (path, _) in events.items() if set(zones) & set(path)} - gone
    subs = spark.createDataFrame([*people.items(), ("u30", ["a", None])], "recipient string, zones array<string>")
    want |= {("u30", names[i]) for i, (path, _) in events.items() if "a" in path} - {("u30", alert) for _, z, alert in recent if z == "a"}
    incidents = spark.createDataFrame([(i, path, T0 if done else None) for i, (path, done) in events.items()], "id string, zone_path array<string>, resolved_at timestamp")
    ledger = spark.createDataFrame(entries, "recipient string, zone string, alert string, at timestamp").select(*kinds.split(), "alert", "at")
    rows = [tuple(r) for r in delivery.alerts(incidents, subs, ledger, F.lit(T0)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_ledger_grows_like_the_incidents(spark, monkeypatch):
    """the ledger of the query has no more entries than there are incidents with their zones, however many watch them."""
    seen, alerts = [], delivery.alerts
    monkeypatch.setattr(delivery, "alerts", lambda incidents, subs, ledger, now: seen.append((incidents.count(), ledger.count())) or alerts(incidents, subs, ledger, now))
    out = exchange.QUERIES["a34_alerts"](spark, DATA)
    assert seen[0][0] * 1.2 > seen[0][1] > 0 and not shuffled(out)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are not here")
def test_incidents_in_tasks_of_equal_size(spark, monkeypatch):
    """tasks grow in number with the events, and no row is copied for a distinct count."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 10)
    tasks = -(-spark.read.parquet(f"{DATA}/events.parquet").count() // 10)
    plan = plan_of(views.incidents(spark, DATA))
    assert tasks > 4 and f", {tasks}), REPARTITION_BY_NUM" in plan and "Expand" not in plan


def test_equal_texts_are_parsed_once(spark, monkeypatch):
    """texts that come often, seldom and not at all against the parse of every message; the parse sees each text once."""
    texts = ["Drone detected, Alpha", "Rocket danger: Beta", "12", "", None]
    rows = spark.createDataFrame([(i, f"s{i % 3}", T0, t) for i, t in enumerate(texts[:1] * 40 + texts[1:] * 3)], "message_id long, source_key string, posted_at timestamp, text string")
    want = parsing.parsed(rows)
    seen, parse = [], parsing.parsed
    monkeypatch.setattr(observe, "OFTEN", 10, raising=False)
    monkeypatch.setattr(parsing, "parsed", lambda table, book=None: seen.append(table.count()) or parse(table, book))
    zones = spark.createDataFrame([("r1", None, "region", "Alpha", 0.0, 0.0, None)], "zone_id string, parent_id string, level string, name string, lat double, lon double, population long")
    sources = spark.createDataFrame([("s0", "federal", None, "Alpha"), ("s1", "federal", None, None)], "source_key string, tier string, network string, region string")
    got = observe.observe(rows, zones, linking.name_index(zones), sources)
    assert seen == [4]
    assert got.parsed.select(want.columns).orderBy("message_id").collect() == want.orderBy("message_id").collect()
    # of the three that name nothing known, one has a source with a home
    assert got.observations.count() == 40 + 1


def test_phrases_without_doubt_are_read_once(spark):
    """F8: a phrase that reads alike in messages of either case has its candidates once, others by case."""
    zones = spark.createDataFrame([("r1", None, "region", "Alpha", 0.0, 0.0, None), ("p1", "r1", "place", "Light", 0.0, 0.0, 50_000)], "zone_id string, parent_id string, level string, name string, lat double, lon double, population long")
    phrases = spark.createDataFrame([(1, 0, "over Alpha"), (2, 0, "the light")], "message_id int, pos int, phrase string")
    names = {r.phrase: [(c.zone_id, c.alternative, c.cased) for c in r.found] for r in linking.names_of(phrases, zones, linking.name_index(zones)).collect()}
    assert sorted(names["over Alpha"]) == [("r1", False, None), ("r1", True, None)]
    assert sorted(names["the light"]) == [("p1", False, False), ("p1", True, False)]
