"""Registered queries of readers and writers (S1, S5-S8) over files that Spark writes from the driver's tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans import views as V
from siftline.sources import readers
from siftline.sources.scratch import shared_dir


def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/siftline/feed-{name}-{uuid.uuid4().hex}"


def _scanned(s, d) -> DataFrame:
    """Messages as JSON lines; every tenth has no text and every tenth no time, and both are skipped."""
    path, k = _folder(s, "jsonl"), F.col("message_id") % 10
    date = F.when(k != 3, F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    V.messages(s, d).select("message_id", date.alias("date"), F.when(k != 7, F.col("text")).alias("text"), F.col("source_key").alias("source")).write.json(path)
    return readers.messages_jsonl(s, path).select("source_key", "message_id", "posted_at", F.md5("text").alias("text_md5"))


def _exported(s, d) -> DataFrame:
    path = _folder(s, "export")
    readers.export_messages(V.messages(s, d), path)
    return s.read.json(path).groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _hotspots(s, d) -> DataFrame:
    """Suppliers as hotspots: every ninth has no number for a power, some lie outside the box."""
    path, k = _folder(s, "hotspots"), F.col("s_suppkey")
    power = F.when(k % 9 != 4, ((k * 17 % 200) / F.lit(10.0)).cast("string")).otherwise("n/a")
    rows = V.read(s, d, "supplier").select(((k * 37 % 4500) / F.lit(100.0) + 35.0).alias("latitude"), ((k * 91 % 6000) / F.lit(100.0) + 10.0).alias("longitude"), power.alias("frp"))
    rows.write.option("header", True).csv(path)
    return readers.hotspots(s, path)


def _registry(s, d) -> DataFrame:
    """Parts as members of units of eight, each unit and each group of members with a head row."""
    path, k = _folder(s, "registry"), F.floor(F.col("p_partkey") / 8)
    part = V.read(s, d, "part").select((k % 7).cast("string").alias("region"), F.lpad((k + 1).cast("string"), 6, "0").alias("unit"), F.col("p_partkey"), F.col("p_name"))
    member = part.select("region", "unit", F.lpad((F.col("p_partkey") % 8 + 1).cast("string"), 3, "0").alias("code"), F.lit("2").alias("section"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"))
    head = part.select("region", "unit").distinct().select("region", "unit", F.lit("000").alias("code"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("section"), F.concat(F.lit("unit "), "unit").alias("name"))
    member.unionByName(head).write.option("sep", ";").csv(path)
    units, members = readers.registry(s, path)
    return units.join(members, ["region", "unit"]).select("region", "unit", "name", F.size("members").alias("n"), F.array_join("members", "|").alias("members"))


def _places(s, d) -> DataFrame:
    """Customers as rows of a dump of 19 columns; every fifth is no place, every eleventh has a better name."""
    path, k = _folder(s, "places"), F.col("c_custkey")
    lat, lon = (k * 37 % 1000) / F.lit(100.0) + 40.0, (k * 91 % 3000) / F.lit(100.0) + 20.0
    given = {0: k, 1: F.col("c_name"), 4: lat, 5: lon, 6: F.when(k % 5 != 2, "P").otherwise("H"), 14: k * 7919 % 600000 - 1000}
    customer = V.read(s, d, "customer")
    customer.select(*[given.get(i, F.lit("x")).cast("string").alias(f"c{i}") for i in range(19)]).write.option("sep", "\t").csv(path)
    better = customer.where(k % 11 == 0).groupBy(lat.alias("lat"), lon.alias("lon")).agg(F.max(F.concat(F.lit("better "), k)).alias("name"))
    return readers.places_tsv(s, path, better)


QUERIES = {"s01_scanned_messages": _scanned, "s05_exported_messages": _exported, "s06_hotspots": _hotspots, "s07_registry": _registry, "s08_places": _places}
ORACLE = {
    "s01_scanned_messages": f"WITH {V.MESSAGES} SELECT source_key, message_id, posted_at, md5(text) AS text_md5 FROM messages WHERE message_id % 10 NOT IN (3, 7) AND text <> ''",
    "s05_exported_messages": f"WITH {V.MESSAGES} SELECT source_key, count(*) AS n, sum(length(text))::BIGINT AS chars FROM messages WHERE text <> '' GROUP BY 1",
    "s06_hotspots": """SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, round(frp, 1) AS frp FROM (SELECT (s_suppkey * 37 % 4500) / 100.0::DOUBLE + 35.0 AS lat, (s_suppkey * 91 % 6000) / 100.0::DOUBLE + 10.0 AS lon, (s_suppkey * 17 % 200) / 10.0::DOUBLE AS frp FROM supplier WHERE s_suppkey % 9 <> 4)
WHERE lon BETWEEN 19 AND 65 AND lat BETWEEN 40 AND 72 AND frp >= 5""",
    "s07_registry": """WITH m AS (SELECT (p_partkey // 8 % 7)::VARCHAR AS region, lpad((p_partkey // 8 + 1)::VARCHAR, 6, '0') AS unit, p_name || ' ' || p_partkey AS name FROM part)
SELECT region, unit, 'unit ' || unit AS name, count(DISTINCT name)::INT AS n, array_to_string(list_sort(list(DISTINCT name)), '|') AS members FROM m GROUP BY region, unit""",
    "s08_places": """WITH p AS (SELECT c_custkey AS k, c_name AS name, (c_custkey * 37 % 1000) / 100.0::DOUBLE + 40.0 AS lat, (c_custkey * 91 % 3000) / 100.0::DOUBLE + 20.0 AS lon, c_custkey * 7919 % 600000 - 1000 AS people FROM customer),
better AS (SELECT lat, lon, max('better ' || k) AS better FROM p WHERE k % 11 = 0 GROUP BY 1, 2)
SELECT k AS place_id, coalesce(better, name) AS name, p.lat, p.lon, CASE WHEN people > 0 THEN people END AS population FROM p LEFT JOIN better b ON round(p.lat, 5) = round(b.lat, 5) AND round(p.lon, 5) = round(b.lon, 5) WHERE k % 5 <> 2""",
}
