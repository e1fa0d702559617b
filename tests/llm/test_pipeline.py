"""Each stage of the pipeline against a plain version, on documents with planted cases, and on odd input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Good and bad texts, recurring lines, exact and near copies, benchmark passages, odd rows."""
    rng = random.Random(31)
    path = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    add = lambda text, source="a": rows.append((len(rows), text, "en", source, None if text is None else len(text)))
    for n in range(240):
        text = "\n".join(prose(rng, 12) for _ in range(8))
        add(text if n % 3 else text.replace(" ", "%%% "), "ab"[n % 2])
        labels.append((n, int(n % 3 > 0), 0))
    line = prose(rng, 14)
    for _ in range(10):
        add(f"{prose(rng, 80)}\n{line}\n{prose(rng, 60)}", "c")
    base = prose(rng, 150)
    for k in range(12):
        words = base.split(" ")
        words[10 + k] = "changed"
        add(base if k < 6 else " ".join(words), "c")
    items = [(n, prose(rng, 40)) for n in range(5)]
    for _, item in items:
        add(f"{prose(rng, 60)} {item} {prose(rng, 60)}", "d")
    for text in (None, "", " ", "one"):
        add(text, None)
    spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items, line


def stage(spark, name, docs, path):
    return dict(pipeline.STAGES)[name](spark, docs, path)


def docs_of(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def test_quality(spark, folder):
    path, rows, _, _ = folder
    docs = docs_of(spark, path)
    kept = stage(spark, "quality_classifier", docs, path)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum((n in ids) == (n % 3 > 0) for n in range(240)) > 235


def test_lines(spark, folder):
    path, rows, _, line = folder
    docs = docs_of(spark, path)
    cut = stage(spark, "line_dedup", docs, path)
    assert cut.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    for doc_id, text, _, _, n_chars in rows:
        want = None if text is None else "\n".join(x for x in text.split("\n") if x != line)
        assert got[doc_id] == (want, None if want is None else len(want))


def test_near_copies(spark, folder):
    path, rows, _, _ = folder
    docs = docs_of(spark, path)
    kept = stage(spark, "minhash_near_dedup", docs.unionByName(docs.where("doc_id % 7 = 0")), path)
    assert kept.columns == docs.columns
    sets = {}
    for doc_id, text, *_ in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[doc_id] = {tuple(found[i : i + 5]) for i in range(max(len(found) - 5, 0) + 1)} if found else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted(i for i in sets if find(i) == i)
    got = sorted(r.doc_id for r in kept.collect())
    # rows without words stay as often as they come; of all others one row of each group stays
    assert [i for i in got if sets[i]] == [i for i in want if sets[i]] and {i for i in got if not sets[i]} == {i for i in want if not sets[i]}


def test_benchmark(spark, folder):
    path, rows, items, _ = folder
    docs = docs_of(spark, path)
    kept = stage(spark, "benchmark_decontamination", docs, path)
    assert kept.columns == docs.columns
    want = {r[0] for r in rows if r[1] is None or not any(item in r[1] for _, item in items)}
    assert {r.doc_id for r in kept.collect()} == want


def test_mixing(spark, folder):
    path, rows, _, _ = folder
    mixed = stage(spark, "source_mixing", docs_of(spark, path), path).collect()
    taken, target, size = {}, {}, {r[0]: len((r[1] or "").split()) for r in rows}
    for r in mixed:
        assert 0 < r.taken <= 3 * size[r.doc_id] and r.size == size[r.doc_id]
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    for source, words in taken.items():
        assert abs(words - target[source]) <= max(1, max((size[r[0]] for r in rows if r[3] == source), default=0))
    again = stage(spark, "source_mixing", docs_of(spark, path), path).collect()
    assert sorted((r.doc_id, r.taken) for r in mixed) == sorted((r.doc_id, r.taken) for r in again)


def test_stages_with_nothing(spark, folder):
    path, *_ = folder
    nothing = docs_of(spark, path).where("false")
    for name, _ in pipeline.STAGES:
        assert stage(spark, name, nothing, path).collect() == []


def test_run(spark, folder):
    path, rows, items, line = folder
    got = pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in got}
    planted = {r[0] for r in rows if r[1] is not None and any(item in r[1] for _, item in items)}
    assert not ids & planted and len(ids & set(range(250, 262))) <= 1 and sum(n % 3 == 0 for n in ids if n < 240) <= 3
