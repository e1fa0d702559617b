"""Message log, cursors and layer upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def utc(text: Column) -> Column:
    """A timestamp from ISO text; without an offset it is read as UTC+3."""
    offset = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})\s*$")
    return F.when(offset, F.try_to_timestamp(text)).otherwise(F.try_to_timestamp(text) - F.expr("INTERVAL 3 HOURS"))


def append_new(target: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that the target does not have, each key once."""
    return rows.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def cursor(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """S3: last id of each source, from the table or the stored cursor, whichever is further."""
    seen = messages.groupBy("source_key").agg(F.max("message_id").alias("seen"))
    return seen.join(stored, "source_key", "full").select("source_key", F.greatest("seen", "last_id").alias("last_id"))


def gap(fetched: DataFrame, present: DataFrame, since: str, until: str) -> DataFrame:
    """Per source, messages of a closed time window that were fetched but are not in the table."""
    window = fetched.where(F.col("posted_at").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    lost = window.join(present.select("source_key", "message_id"), ["source_key", "message_id"], "left_anti")
    return lost.groupBy("source_key").agg(F.count(F.lit(1)).alias("missing"))


def keep_facts(layer: DataFrame, previous: DataFrame, key: str, facts: tuple[str, ...]) -> DataFrame:
    """A rewritten layer keeps what the previous snapshot knew where the new value is null."""
    old = previous.select(key, *[F.col(c).alias(f"__old_{c}") for c in facts])
    out = layer.join(old, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"__old_{c}")) for c in facts}).select(*layer.columns)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def window_read(messages: DataFrame, mark: int, key: str = "message_id", at: str = "posted_at") -> DataFrame:
    """The messages behind a mark, in the order in which they are folded."""
    return messages.where(F.col(key) > mark).orderBy(at, key)


#: Tables that are made of others and can be made again.
DERIVED = ("incidents", "provenance", "routes")


def reset_derived(spark: SparkSession, folder: str, tables: tuple[str, ...] = DERIVED) -> None:
    """Empty the derived tables under ``folder``, keeping their columns; messages and zones are not touched."""
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")  # any file system that Spark has
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            schema = spark.read.parquet(f"{folder}/{name}").schema
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")
