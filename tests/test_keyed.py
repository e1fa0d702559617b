"""Keyed streams: the same rows as the batch form, and nothing left behind by silent zones."""

import random
from datetime import timedelta

from pyspark.sql import functions as F
from test_fusion import CASES, SCHEMA, T0

from siftline.operators.fusion import fuse, incidents
from siftline.streaming import keyed

ZONE = "zone_id string, parent_id string"
COLUMNS = ["id", "zone_id", "signal", "severity", "threat", "first_seen", "last_seen", "resolved_at", "source_count", "voices", "confidence"]


def observed(spark, rows):
    """``rows``: minute, zone path and what differs from a plain report."""
    made = []
    for i, r in enumerate(rows):
        row = {"source": f"s{i}", "tier": "federal", "signal": "danger", "threat": "uav", "severity": 5, "body": ""} | r
        made.append((i, row["source"], row["tier"], T0 + timedelta(minutes=row["minute"]), row["signal"], row["threat"], row["severity"], row["body"], row["path"][0], row["path"], "district"))
    return spark.createDataFrame(made, SCHEMA)


def streamed(spark, make, files, tmp_path, schema):
    """Run ``make`` over one file a batch, in order."""
    for i, rows in enumerate(files):
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(600)
    assert query.exception() is None
    return spark.read.parquet(f"{tmp_path}/out")


def left_behind(spark, tmp_path, *names):
    """Keys that still have state."""
    out = set()
    for name in names:
        rows = spark.read.format("statestore").option("path", f"{tmp_path}/check").option("operatorId", 0).option("stateVarName", name).load()
        out |= {r[0] for r in rows.select(F.element_at(F.array("key.*"), 1)).distinct().collect()}
    return out


def test_zone_fusion_equals_batch(spark, tmp_path):
    """All cases of the batch form, each in zones of its own, out of order within the hold-back; afterwards no state is left."""
    rows = []
    for n, (case, _) in enumerate(CASES):
        for k, r in enumerate(case):
            path = [f"{p}-{n}" for p in r.get("path", ["d1", "r1"])]
            rows.append({"minute": 0, "source": f"s{k}"} | r | {"path": path})
    rng = random.Random(4)
    for k in range(120):
        rows.append({"minute": rng.randrange(240), "source": f"s{rng.randrange(6)}", "signal": rng.choice(("danger", "detection", "impact", "allclear")), "threat": rng.choice(("uav", "rocket", "unknown", "airport")),
                     "severity": rng.randrange(1, 9), "path": rng.choice((["d1-x", "r1-x"], ["d2-x", "r1-x"], ["r1-x"]))})
    rows.sort(key=lambda r: r["minute"])
    whole = observed(spark, rows)
    zones = sorted({(p[0], p[1] if len(p) > 1 else None) for p in (r["path"] for r in rows)} | {(p[-1], None) for p in (r["path"] for r in rows)}) + [("far", None)]
    gazetteer = spark.createDataFrame(zones, ZONE)
    # each file reaches ten minutes back into the one before it
    slot = F.floor((F.unix_seconds("moment") - int(T0.timestamp())) / 3600 + F.when(F.col("raw_id") % 3 == 0, F.lit(10 / 60)).otherwise(0.0))
    files = [whole.where(slot == k) for k in range(5)]
    files += [observed(spark, [{"minute": m, "path": ["far"]}]).withColumn("raw_id", F.lit(10_000 + m).cast("long")) for m in (600, 601)]
    log = streamed(spark, lambda s: keyed.fused_stream(s, gazetteer, "15 minutes"), files, tmp_path, SCHEMA)
    got = incidents(keyed.assigned_rows(log, gazetteer)).where("zone_id <> 'far'").select(COLUMNS).orderBy("id").collect()
    want = fuse(whole).select(COLUMNS).orderBy("id").collect()
    assert got == want and len(want) > 30
    closed = {r.id: r.closed_at for r in keyed.closings(log).collect()}
    assert closed == {r.id: r.last_seen + timedelta(hours=3) for r in want if r.resolved_at is None}
    assert left_behind(spark, tmp_path, "held", "open", "next") == {"far"}


def test_late_rows_are_placed(spark, tmp_path):
    """A row far behind the watermark is no loss: it joins what is open around its time, or stands alone."""
    files = [observed(spark, [{"minute": m, "path": ["d1"], "source": s}]).withColumn("raw_id", F.lit(i).cast("long")) for i, (m, s) in enumerate(((0, "a"), (20, "b"), (22, "c"), (14, "late"), (90, "d"), (40, "lone"), (600, "e"), (601, "f")))]
    gazetteer = spark.createDataFrame([("d1", None)], ZONE)
    log = streamed(spark, lambda s: keyed.fused_stream(s, gazetteer, "30 seconds"), files, tmp_path, SCHEMA)
    events = {r.first_seen: r.source_count for r in incidents(keyed.assigned_rows(log, gazetteer)).collect()}
    minute = lambda m: T0 + timedelta(minutes=m)
    # minute 14 came behind minute 20, which still waited
    assert events == {minute(0): 4, minute(40): 1, minute(90): 1, minute(600): 1}


def chained(lines, quiet, life):
    out, began = set(), {}
    for who, line, at in sorted(lines, key=lambda r: r[2]):
        if (who, line) not in began or at - began[who, line] >= life:
            began[who, line] = at
            out.add((who, line, at, True))
        else:
            out.add((who, line, at, at - began[who, line] >= quiet))
    return out


def test_ledger(spark, tmp_path):
    rng = random.Random(9)
    lines = sorted({(f"u{rng.randrange(3)}", f"line {rng.randrange(3)}", T0 + timedelta(minutes=rng.randrange(4000))) for _ in range(300)}, key=lambda r: r[2])
    schema = "recipient string, line string, moment timestamp"
    files = [spark.createDataFrame(lines[k : k + 80] + lines[k : k + 3], schema) for k in range(0, len(lines), 80)]  # some rows come twice
    files += [spark.createDataFrame([("far", "x", T0 + timedelta(days=d))], schema) for d in (9, 12)]
    log = streamed(spark, keyed.sent_lines, files, tmp_path, schema)
    rows = [(r.recipient, r.line, r.moment, r.sent) for r in log.withColumn("moment", F.timestamp_micros("at")).where("recipient <> 'far'").collect()]
    assert len(rows) == len(lines) and set(rows) == chained(lines, timedelta(minutes=30), timedelta(hours=24))
    assert 9 < sum(r[3] for r in rows) < len(rows)
