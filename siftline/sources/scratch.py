"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts, where a count of them is at hand.
TASK_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/siftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str, rows: int = 0) -> DataFrame:
    """Rows dealt by ``by`` over as many tasks as the session shuffles into, and over more if there are more than TASK_ROWS ``rows`` for each.

    A number of its own keeps Spark from joining small partitions: for rows that are
    few in bytes but dear to work on, or whose sorts have to stay small.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *by)
