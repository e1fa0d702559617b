"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns through every operator."""

import pytest
from pyspark.sql import functions as F

from siftline.llm import caps, chat, decontaminate, lines, minhash, mixing, pii, quality, secrets, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("score", "kept", "taken", "n_lines", "__text", "key", "spans", "row", "tid", "size")
ROWS = [
    (1, "the same text of more than a few words here", "en", "a", 10),
    (1, "the same text of more than a few words here", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "null id but words enough to count for it", "en", "b", 5),
    (None, "null id but words enough to count for it", "en", "b", 5),
    (4, "word " * 30_000, "en", "b", 150_000),
    (5, " \t\n ", "en", "b", 4),
    (6, "x" * 5000, "de", "a", 5000),
    (7, "line one here\nline two here\nÄÖÜ ñ 漢字 \U0001f600", "de", "c", 40),
]
LABELS = "doc_id long, quality int, toxic int"

OPERATORS = {
    "quality": lambda s, d: quality.classify(d, s.createDataFrame([(1, 1, 0), (4, 0, 0), (9, None, 0), (None, 1, 0)], LABELS), max_rows=50).select("doc_id", "score"),
    "secrets": lambda s, d: secrets.scan(d, F.col("source"), F.col("lang")),
    "substrings": lambda s, d: substrings.dedup_substrings(d),
    "minhash": lambda s, d: minhash.near_duplicates(d, 3, 85),
    "mixing": lambda s, d: mixing.mix(d),
    "lines": lambda s, d: lines.drop_recurring_lines(d).select("doc_id", "text"),
    "pii": lambda s, d: pii.pseudonymise(d, b"k").select("doc_id", "text"),
    "decontaminate": lambda s, d: decontaminate.drop_contaminated(d, s.createDataFrame([(1, "no such item in any of these texts"), (2, None), (3, "")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_survive(spark, name):
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("clash") for c in EXTRA})
    got = OPERATORS[name](spark, docs).collect()
    assert len(got) == len(ROWS)
    none = OPERATORS[name](spark, docs.where("false")).collect()
    assert none == []


def test_defined_results(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    near = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert near[3, 0].kept and near[2, 0].component_id == 2 and near[4, 1].kept
    cut = {(r.doc_id, r.n_bytes): r for r in substrings.dedup_substrings(docs).collect()}
    assert cut[4, 150_000].n_removed == 150_000 and cut[6, 5000].n_removed == 5000 and cut[2, 0].n_removed == 0 and cut[7, len(ROWS[-1][1].encode())].n_spans == 0
    scan = secrets.scan(docs, F.col("source"), F.col("lang")).where("doc_id = 2").first()
    assert scan.spans == "" and scan.n_hex == 0


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (2, None, "assistant", "a"), (2, 3, "user", "[INST]x[/INST] <\\s> </s>"), (None, 1, "assistant", "z" * 100_000), (3, 0, "ro\nle%[", "t")]
    schema = "conv_id long, turn long, role string, text string"
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == 4
    assert [tuple(t) for t in got[2].turns] == [("assistant", "a"), ("user", "[INST]x[/INST] <\\s> </s>")]
    assert got[3].turns[0].role == "ro\nle%[" and len(got[1].turns) == 2 and got[None].loss_text == "z" * 100_000
    assert chat.format_conversations(spark.createDataFrame([], schema)).collect() == []


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    got = {r.vec_id: r for r in caps.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].n_links for i in range(1, 12)] == [2, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0]
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert caps.near_duplicates(spark.createDataFrame([], schema)).collect() == []
