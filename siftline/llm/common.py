"""What the operators of this subpackage share: scratch tables, keys and text helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space; Java's and Python's form of the same class.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    This cuts lineage: a lost executor costs its own tasks, not what lies before
    the table. Tables stay until the folder is cleared, like checkpoints do.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run of an operator, in a folder of their own that goes with :meth:`clear`.

    Clear it only once everything that reads the tables has been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.written = spark, f"{scratch_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`materialize`."""
        self.written += 1
        path = f"{self.path}/{self.written}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)  # any file system that Spark has
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def dealt_join(large: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "inner", parts: int = 16) -> DataFrame:
    """Join on ``keys`` with the rows of one key dealt over ``parts`` tasks by a hash of ``by``; ``small`` is repeated that often.

    For sides with one row a key, so that a key with a third of all rows of the large side is no single task.
    """
    dealt = large.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    return dealt.join(small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [*keys, "__part"], how).drop("__part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; ``bytes`` knows only the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
