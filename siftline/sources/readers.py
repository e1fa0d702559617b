"""Readers and writers of the message log, registries and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators.ingest import utc

MESSAGE = "source string, message_id long, chat_id long, date string, text string, views int"


def messages_jsonl(spark: SparkSession, path: str, names: DataFrame | None = None, stream: bool = False) -> DataFrame:
    """One JSON object a line, one file a source; rows without text or date go.

    A row without ``source`` takes the stem of its file, mapped through ``names``
    (``username, key``) where that knows it.
    """
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(MESSAGE).json(path).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    rows = rows.where("text IS NOT NULL AND text <> '' AND date IS NOT NULL")
    if names is not None:
        rows = rows.join(names.select(F.col("username").alias("stem"), "key"), "stem", "left")
    key = F.coalesce("source", F.col("key") if names is not None else F.lit(None), F.col("stem"))
    return rows.select(key.alias("source_key"), "message_id", "chat_id", utc(F.col("date")).alias("posted_at"), "text", "views")


def export_messages(messages: DataFrame, path: str) -> None:
    """Messages with text as JSON lines, a folder for each source."""
    messages.where("text IS NOT NULL AND text <> ''").write.mode("overwrite").partitionBy("source_key").json(path)


def hotspots(spark: SparkSession, *paths: str) -> DataFrame:
    """Points of several feeds: bad rows go, a box and a least power hold, coordinates are rounded."""
    rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(list(paths))
    value = {c: F.expr(f"try_cast({c} AS double)") for c in ("latitude", "longitude", "frp")}
    rows = rows.select(value["latitude"].alias("lat"), value["longitude"].alias("lon"), value["frp"].alias("frp"))
    kept = rows.where(F.col("lon").between(19, 65) & F.col("lat").between(40, 72) & (F.col("frp") >= 5))
    return kept.select(F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.round("frp", 1).alias("frp"))


def registry(spark: SparkSession, path: str, columns: tuple[int, ...] = (0, 1, 2, 3, 4)) -> tuple[DataFrame, DataFrame]:
    """Units and members of a ``;``-separated registry: columns by place are region, unit, code, section and name.

    Section 1 rows are units, section 2 rows members; rows with code 000 head a group.
    """
    raw = spark.read.option("sep", ";").csv(path)
    rows = raw.select(*[F.trim(F.col(raw.columns[i])).alias(n) for n, i in zip(("region", "unit", "code", "section", "name"), columns, strict=True)])
    units = rows.where("section = '1' AND unit <> '000' AND code = '000'").select("region", "unit", "name")
    members = rows.where("section = '2' AND code <> '000'").groupBy("region", "unit").agg(F.sort_array(F.collect_set("name")).alias("members"))
    return units, members


def places_tsv(spark: SparkSession, path: str, preferred: DataFrame | None = None) -> DataFrame:
    """Populated places of a 19-column tab-separated dump; names can be overridden by rounded coordinates."""
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path)
    c = [F.col(n) for n in raw.columns]
    number = lambda i: F.expr(f"try_cast({raw.columns[i]} AS double)")
    people = F.expr(f"try_cast({raw.columns[14]} AS bigint)")
    rows = raw.where(c[6] == "P").select(c[0].cast("long").alias("place_id"), c[1].alias("name"), number(4).alias("lat"), number(5).alias("lon"), F.when(people > 0, people).alias("population"))
    rows = rows.where("lat IS NOT NULL AND lon IS NOT NULL")
    if preferred is None:
        return rows
    over = preferred.select(F.round("lat", 5).alias("rlat"), F.round("lon", 5).alias("rlon"), F.col("name").alias("better"))
    met = rows.join(over, (F.round(rows.lat, 5) == F.col("rlat")) & (F.round(rows.lon, 5) == F.col("rlon")), "left")
    return met.withColumn("name", F.coalesce("better", "name")).drop("rlat", "rlon", "better")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Polygons as a vertex table with the name of their feature; features without name or coordinates go."""
    ring = "array<array<array<double>>>"
    schema = f"features array<struct<properties:struct<name:string>,geometry:struct<type:string,coordinates:string>>>"
    feature = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    shape = F.col("f.geometry.coordinates")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(shape, f"array<{ring}>")).otherwise(F.array(F.from_json(shape, ring)))
    rows = feature.where("f.properties.name IS NOT NULL AND f.properties.name <> ''").select(F.col("f.properties.name").alias("feature_id"), F.posexplode(parts).alias("part", "rings"))
    rows = rows.select("feature_id", "part", F.posexplode("rings").alias("ring", "points"))
    rows = rows.select("feature_id", "part", "ring", F.posexplode("points").alias("seq", "xy"))
    return rows.select("feature_id", "part", "ring", "seq", F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"))


def unique_slugs(rows: DataFrame, slug: str = "slug", order: str = "place") -> DataFrame:
    """T4: the second and later rows of a slug get ``_2``, ``_3`` in their order."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return rows.withColumn(slug, F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("_"), n)))
