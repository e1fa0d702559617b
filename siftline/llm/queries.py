"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import caps, chat, decontaminate, lines, minhash, mixing, pii, quality, ranking, recompression, secrets, spelling, substrings
from siftline.llm.common import table

#: Key of the registered query only; a real run passes its own.
PII_KEY = b"public key of the registered query"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.classify(docs.select("doc_id", "text", "n_chars"), labels)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository is a source in one language, an owner is a source."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup_passages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_secret_scans": op2_secret_scans,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ranked_search": op12_ranked_search,
    "op13_passage_dedup": op13_passage_dedup,
}
ORACLE = {
    "op4_chat_formatting": chat.ORACLE,
    "op6_embedding_near_dedup": caps.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_ranked_search": ranking.ORACLE,
    "op13_passage_dedup": recompression.ORACLE,
}
