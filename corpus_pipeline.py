"""Corpus pipeline: score, clean, deduplicate, decontaminate, mix.

Each stage takes ``(spark, docs, sf_dir)`` and what the stage before it kept; all
but the last return the columns of ``documents``. :func:`run` writes every
stage's result to the shared folder and reads it again, so a lost executor
never costs more than one stage. Nulls, empty and very long texts, ties,
repeated rows, empty tables and further columns go through every stage as its
operator defines; further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, lines, minhash, mixing, quality
from siftline.llm.common import Scratch, materialize, table
from siftline.shipping import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be good; an empty or null text is scored like any other."""
    ship(spark)
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    # packed, so that columns of the table may have the names of the scores
    packed = docs.select("text", "n_chars", F.struct("*").alias("__row"))
    return quality.scored(packed, machine).where(F.col("predicted") == 1).select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; ``n_chars`` follows, and no document goes."""
    ship(spark)
    packed = docs.select("text", F.struct("*").alias("__row"))
    cut = lines.drop_recurring_lines(packed)
    return cut.select(
        *[
            F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("__row")[c].alias(c)
            for c in docs.columns
        ]
    )


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one with the smallest id.

    Repeated rows of that document go as well. Documents without words stay.
    """
    ship(spark)
    return minhash.one_of_each(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the words it takes of each (repeats counted); documents of a better score are drawn first.

    The weights are the scores of the machine of the first stage. It is fitted
    again on the same labelled rows of ``documents``, as stages hand on nothing
    but documents.
    """
    ship(spark)
    machine = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = quality.scored(docs.select("doc_id", "text", "source", "n_chars"), machine)
    return mixing.mix(scored, quality=F.greatest("score", F.lit(0.01))).where("taken > 0")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    docs = materialize(docs, "pipeline")
    scratch.clear()
    return docs


#: A trained score and hashed sketches cannot be put in SQL; ``tests/llm/test_pipeline.py`` holds each stage against a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
