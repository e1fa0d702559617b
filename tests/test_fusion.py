"""The fold on literal timelines, in batch and in micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.operators.fusion import fuse
from siftline.streaming import fuse as stream

T0 = datetime(2026, 7, 27, 10, 0)
SCHEMA = "raw_id long, source_key string, tier string, moment timestamp, signal string, threat string, severity int, body string, zone_id string, zone_path array<string>, level string"


def table(spark, *rows):
    made = []
    for i, r in enumerate(rows):
        row = {"minute": 0, "source": f"s{i}", "tier": "federal", "signal": "danger", "threat": "uav", "severity": 5, "body": "", "path": ["d1", "r1"]} | r
        made.append((i, row["source"], row["tier"], T0 + timedelta(minutes=row["minute"]), row["signal"], row["threat"], row["severity"], row["body"], row["path"][0], row["path"], "district"))
    return spark.createDataFrame(made, SCHEMA)


def fused(spark, *rows):
    return fuse(table(spark, *rows)).orderBy("first_seen", "id").collect()


LONG = "x" * 130
CASES = [
    ([{"minute": 0}, {"minute": 3}], lambda e: len(e) == 1 and e[0].source_count == 2),
    ([{"signal": "detection", "severity": 8}, {"minute": 1, "signal": "intercept", "severity": 8}], lambda e: e[0].signal == "intercept"),
    ([{"signal": "intercept", "severity": 8}, {"minute": 1, "signal": "detection", "severity": 8}], lambda e: e[0].signal == "intercept"),
    ([{"minute": 0}, {"minute": 40}], lambda e: len(e) == 2),
    ([{"source": "a"}, {"minute": 1, "source": "a"}], lambda e: e[0].confidence == 0.55 and e[0].source_count == 1),
    ([{}, {"minute": 1}, {"minute": 2}], lambda e: e[0].confidence == 0.909),
    ([{}, {"minute": 5, "signal": "allclear", "threat": "rocket"}], lambda e: e[0].resolved_at is None),
    ([{}, {"minute": 5, "signal": "allclear"}], lambda e: e[0].resolved_at == T0 + timedelta(minutes=5)),
    ([{}, {"minute": 5, "signal": "allclear", "threat": "unknown"}], lambda e: e[0].resolved_at is not None),
    ([{"threat": "unknown"}, {"minute": 5, "signal": "allclear", "threat": "uav"}], lambda e: e[0].resolved_at is not None),
    ([{"threat": "airport"}, {"minute": 5, "signal": "allclear", "threat": "unknown"}], lambda e: e[0].resolved_at is None),
    ([{}, {"path": ["r1"]}], lambda e: len(e) == 2),
    ([{}, {"minute": 5, "signal": "allclear", "path": ["r1"]}], lambda e: e[0].resolved_at is not None),
    ([{"body": LONG, "source": "a"}, {"minute": 1, "body": LONG, "source": "b"}], lambda e: e[0].voices == 1 and e[0].source_count == 2),
    ([{"body": "short", "source": "a"}, {"minute": 1, "body": "short", "source": "b"}], lambda e: e[0].voices == 2),
    ([{}, {"minute": 2, "signal": "allclear"}, {"minute": 6, "severity": 4}], lambda e: len(e) == 1 and e[0].contributions[-1].role == "late"),
    ([{}, {"minute": 2, "signal": "allclear"}, {"minute": 6, "severity": 8}], lambda e: len(e) == 2),
    ([{"minute": 20}, {"minute": 10, "signal": "allclear"}], lambda e: e[0].resolved_at is None),
    ([{"threat": "uav"}, {"minute": 1, "threat": "unknown", "severity": 9}], lambda e: len(e) == 1 and e[0].threat == "uav" and e[0].severity == 9),
]


@pytest.mark.parametrize("rows, holds", CASES, ids=range(len(CASES)))
def test_case(spark, rows, holds):
    events = fused(spark, *rows)
    assert holds(events), events


def test_empty_and_repeatable(spark):
    assert fused(spark) == []
    rows = [{"minute": m, "source": f"s{m % 3}"} for m in range(0, 200, 7)]
    assert fused(spark, *rows) == fused(spark, *rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"minute": m, "source": f"s{m % 4}", "severity": 1 + m % 9, "path": [f"d{m % 2}", "r1"]} for m in range(0, 120, 5)]
    rows += [{"minute": 33, "signal": "allclear", "path": ["r1"]}]
    whole = table(spark, *sorted(rows, key=lambda r: r["minute"]))
    for i, (low, high) in enumerate(((0, 6), (6, 13), (13, 99))):
        whole.where(F.col("raw_id").between(low, high - 1)).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = stream.run(source, f"{tmp_path}/out")
    query.awaitTermination(120)
    assert query.exception() is None
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "changed").iterdir())
    got = stream.FusionSink(f"{tmp_path}/out").finish(spark, last)
    columns = ["id", "signal", "severity", "first_seen", "last_seen", "resolved_at", "source_count", "confidence"]
    assert got.select(columns).orderBy("id").collect() == fuse(whole).select(columns).orderBy("id").collect()
