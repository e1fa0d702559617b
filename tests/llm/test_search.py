"""Spelling variants, ranked search and passages against brute force, and their odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import ranking, recompression, spelling

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def prose(rng, n, letters="abcdefgh", size=(2, 7)):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(n))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    uses = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            uses[run] += 1
    uses = {w: n for w, n in uses.items() if len(w) >= 6 and n >= 5}
    beside = {w: [v for v in uses if near(v, w)] for w in uses}
    form = {}
    for w in uses:
        best = min(beside[w], key=lambda v: (-uses[v], v), default=None)
        form[w] = best if best is not None and uses[best] >= 5 * uses[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), uses[w], len(beside[w]), uses[form[w]] if form[w] else None) for w in uses}


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(41)
    words = [prose(rng, 1, "abcé", (6, 9)) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "Straße" * 2, "x" * 300]
    out = ["qrstuvw"] * 400 + ["qrstuvx"] * 50 + ["qrstuzx"] * 7  # a chain
    for w in words:
        out += [w] * rng.choice((5, 8, 30, 160))
        for _ in range(3):
            at = rng.randrange(len(w))
            out += [rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("abz") + w[at:], w[:at] + "b" + w[at + 1 :]))] * rng.choice((5, 6, 20))
    rng.shuffle(out)
    return [(k, " ".join(out[k * 40 : k * 40 + 40])) for k in range(len(out) // 40 + 1)] + [(None, "Abcabca, abcabca"), (None, None), (3, ""), (4, "12 ' --")]


@pytest.mark.parametrize("group, shard", [(4096, 1 << 18), (3, 200)])
def test_spelling(spark, misspelt, group, shard, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "SHARD", shard)
    want = variants(misspelt)
    got = spelling.spelling_variants(spark.createDataFrame(misspelt, DOCS).withColumns({c: F.lit("clash") for c in ("word", "n", "key", "root")}))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert sum(w[1] is not None for w in want) > 10 and any(w[1] != w[2] and w[1] for w in want) and max(w[4] for w in want) > 2


def test_near_words_by_index():
    """The indexes and the search alone, with every length and with runs of one letter."""
    rng = random.Random(7)
    words = sorted({prose(rng, 1, "ab", (6, 9)) for _ in range(300)})
    shard = spelling.Shard(words)
    size = np.array([len(w) for w in words])
    every = np.arange(len(words))
    found = [shard.rightward(every, size // 2, np.zeros(len(words), int)), shard.leftward(every, size - size // 2)]
    pairs = sorted((int(a), int(b)) for x, y in found for a, b in zip(x, y, strict=True))
    assert pairs == sorted((i, j) for i, w in enumerate(words) for j, v in enumerate(words) if len(v) >= len(w) and near(v, w))


def ranked(docs, items, k=10):
    term = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    words = [Counter(re.findall(term, lower(t or ""))) for _, t in docs]
    sizes = [sum(w.values()) for w in words]
    big_n, big_l = sum(s > 0 for s in sizes), sum(sizes)
    holds = Counter(t for w in words for t in w)
    out = set()
    for item, text in set(items):
        wanted = Counter(t for t in re.findall(term, lower(text or "")) if t in holds)
        scores = []
        for (doc, _), w, n in zip(docs, words, sizes, strict=True):
            m = 25 + (75 * n * big_n) // big_l if big_l else 0
            s = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * holds[t] + 1))) * ((10**9 * w[t]) // (1000 * w[t] + 8 * m)) for t, q in wanted.items() if w[t])
            if s > 0:
                scores.append((-s, doc is None, doc))
        scores.sort(key=lambda x: x[:2] if x[1] else x)
        out |= {(item, r, d, -s) for r, (s, _, d) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("entries, starts, fan, terms", [(1 << 21, 32, 16, 1 << 18), (60, 2, 2, 40)])
def test_ranking(spark, entries, starts, fan, terms, monkeypatch):
    for name, value in {"ENTRIES": entries, "STARTS": starts, "DOC_FAN": fan, "ITEM_FAN": fan if fan == 2 else 8, "PASS_TERMS": terms}.items():
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(5)
    bag = prose(rng, 120).split()
    docs = [(n, " ".join(rng.choice(bag[: rng.randint(5, 120)]) for _ in range(rng.randint(1, 60))).replace("a", "A", 3)) for n in range(150)]
    docs += [(1000 + n, docs[7][1]) for n in range(25)] + [(7, docs[7][1]), (None, docs[7][1]), (None, "lone Ünï漢字"), (500, None), (501, ""), (502, "-- !"), (503, "word " * 20_000)]
    items = [(n, " ".join(rng.choice(bag) for _ in range(rng.randint(1, 30)))) for n in range(40)] + [(90, docs[7][1]), (90, docs[7][1]), (91, None), (92, "?"), (93, "nowhere"), (94, "ünï漢字 lone word")]
    rng.shuffle(docs)
    got = ranking.rank_documents(spark.createDataFrame(docs, DOCS).repartition(5).withColumns({c: F.lit("clash") for c in ("n", "rank", "terms", "item_id")}), spark.createDataFrame(items, ITEMS))
    assert Counter(map(tuple, got.collect())) == Counter(ranked(docs, items))


def test_ranking_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((docs.where("false"), items), (docs, items.where("false"))):
        got = ranking.rank_documents(d, i)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def passages(rows):
    """Rows by brute force: every window of every text, in the order of ids."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    for doc, text in order:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - recompression.L + 1):
            window = tuple(words[s : s + recompression.L])
            if seen.setdefault(window, (doc, text, s)) != (doc, text, s):
                gone.update(range(s, s + recompression.L))
        kept = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        out[doc, text] = (doc, len(words), len(gone), kept)
    return Counter(out[r] for r in rows)


@pytest.mark.parametrize("part", [1 << 20, 16])
def test_passages(spark, part, monkeypatch):
    monkeypatch.setattr(recompression, "PART", part)
    rng = random.Random(9)
    base = [prose(rng, rng.randint(15, 120), "abcd", (1, 3)) for _ in range(40)]
    shared = [prose(rng, n) for n in (19, 20, 21, 45)]
    texts = base + base[:6] + [f"{prose(rng, 12)} {s}\t\n{prose(rng, 12)}" for s in shared for _ in range(8)]
    texts += [" ".join(w if rng.random() > 0.03 else "new" for w in b.split()) for b in base[:15] for _ in range(3)]
    texts += ["la " * 70, "la " * 30 + "lo", "la lo " * 40, "a b c " * 30, "a b c d e f g " * 20, f"{shared[3]} {shared[3]} {shared[3]}", "", "one two", "Ünï " * 25 + "\x0b x"]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[3]), (None, texts[3]), (700, None)]
    rng.shuffle(rows)
    got = recompression.dedup_passages(spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit("clash") for c in ("tid", "name", "n_words", "place")}))
    assert Counter(map(tuple, got.collect())) == passages(rows)
    assert recompression.dedup_passages(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_words_give_equal_interior_symbols():
    """Inside a passage, symbols whose context lies within it do not depend on what stands around it."""
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 9, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = []
    for _ in range(20):
        around = [rng.integers(1, 9, int(n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in rng.integers(0, 30, 2)]
        words = np.concatenate([[0], around[0], passage, around[1], [0]]).astype(np.uint64)
        wall = np.zeros(len(words), bool)
        wall[[0, -1]] = True
        at = np.arange(len(words))
        symbols = recompression.Symbols(words, at, np.where(wall, -recompression._FAR, at), np.where(wall, recompression._FAR, at + 1), wall)
        for number in range(1, 5):
            symbols = symbols.runs().pairs(number)
        begin = 1 + len(around[0])
        inside = (symbols.low >= begin) & (symbols.high <= begin + len(passage))
        found.append(list(zip((symbols.at[inside] - begin).tolist(), symbols.name[inside].tolist(), strict=True)))
    assert all(f == found[0] for f in found) and len(found[0]) > 0
