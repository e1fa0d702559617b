"""Benchmark decontamination by a CGK embedding and bit-sampling LSH.

Items and texts are sequences of words (punctuation and case aside), and
distance is the number of word edits. A CGK walk reads a sequence and writes one
symbol a step; whether it moves on depends on a random bit of the step and the
symbol. Two sequences a few edits apart fall in step again, so edit distance
becomes Hamming distance. A repetition has its own walk and samples a few steps;
item and window meet if all sampled symbols agree. A long item takes part in
pieces: its edits cannot exceed the share allowed in every one of them, so some
piece is within the threshold. The number of repetitions grows until simulated
pairs right at the threshold, inside running text, meet with the target recall;
if that takes too many, it is an error. What meets is verified by exact edit
distance of the whole item to the best place in the text.

Windows have the sizes of the pieces, in classes of about 15 % difference, and
start at every word; only those are walked that can match at all: an edit
touches two pairs of neighbouring words, so most pairs of a window must be pairs
of the benchmark. Everything happens while
the documents are scanned; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import Words, mix, parcels, words_of

#: Steps that a repetition samples.
SAMPLED = 3
#: Repetitions are added in blocks; a target recall that MAX_REPETITIONS miss is an error.
BLOCK = 16
MAX_REPETITIONS = 1024
#: Simulated pairs of a size class.
TRIALS = 400
#: Words of a piece; a longer item is cut into pieces of even size.
PIECE_WORDS = 60
#: Benchmark characters that one pass takes to the tasks; a larger benchmark takes several passes.
PASS_CHARS = 8_000_000
_TABLE = 1 << 22
#: Walkers (windows times repetitions) that move together.
TOGETHER = 1 << 18


@dataclass(frozen=True)
class SizeClass:
    """Pieces of about one size with their LSH keys; ``keys`` ascend and ``item`` has the number of each key's item."""

    size: int
    edits: int  # allowed in the largest piece
    bits: np.ndarray  # repetition, step: odd multiplier of the random bit
    steps: np.ndarray  # repetition, sample: ascending step
    keys: np.ndarray
    item: np.ndarray


@dataclass(frozen=True)
class Index:
    """All that a task needs to find a benchmark's items in texts."""

    ids: list
    items: list[np.ndarray]
    similarity: float
    classes: list[SizeClass]
    known: np.ndarray  # table of hashes of neighbouring words


def _pairs(hashed: np.ndarray) -> np.ndarray:
    """Slot of each word and its next one."""
    both = mix(hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:])
    return (both & np.uint64(_TABLE - 1)).astype(np.int64)


def allowed(words: int, similarity: float) -> int:
    return int(np.floor((1 - similarity) * words + 1e-9))


def walk(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, bits: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """LSH key of each repetition for the windows of ``symbols`` from ``start``; 0 is read from ``end`` on."""
    repetitions, n_steps = bits.shape
    padded = np.append(symbols, np.uint64(0))
    at = np.repeat(start[:, None], repetitions, axis=1)
    stop = end[:, None]
    key = np.repeat(np.arange(repetitions, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), len(start), axis=0)
    wanted = [np.flatnonzero((steps == j).any(axis=1)) for j in range(n_steps)]
    for j in range(int(steps.max()) + 1):
        symbol = padded[np.minimum(at, stop - 1)]
        symbol[at >= stop] = 0
        if len(wanted[j]):
            key[:, wanted[j]] = mix(key[:, wanted[j]] + mix(symbol[:, wanted[j]] + np.uint64(j + 1)))
        at += ((symbol + np.uint64(j)) * bits[:, j] >> np.uint64(63)).astype(np.int64)
    return key


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(len(out), 1)))
        fresh = int(rng.integers(1, 2**63))
        if kind == 0 and out:
            out[at] = fresh
        elif kind == 1 and out:
            del out[at]
        else:
            out.insert(at, fresh)
    return np.array(out, np.uint64)


def _walkers(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(i) for i in items], np.int64)
    end = np.cumsum(size)
    return np.concatenate(items), end - size, end


def _enough(known: np.ndarray, size: int, edits: int) -> np.ndarray:
    """Whether so many known pairs are enough for a window of ``size`` words; an edit touches two pairs."""
    return known >= size - 1 - 2 * edits


def _size_class(numbers: list[int], pieces: list[np.ndarray], size: int, similarity: float, recall: float, known: np.ndarray, seed: int) -> SizeClass:
    """``numbers`` are the items of ``pieces``; of each piece the first ``size`` words are walked, as windows have no more."""
    rng = np.random.default_rng(seed)
    edits = max(allowed(len(p), similarity) for p in pieces)
    own = _walkers([p[:size] for p in pieces])
    picked = np.arange(max(TRIALS, len(pieces))) % len(pieces)
    trial = [
        np.concatenate([_edited(pieces[k], allowed(len(pieces[k]), similarity), rng), rng.integers(1, 2**63, size).astype(np.uint64)])[:size]
        for k in picked
    ]
    passed = _enough(np.array([known[_pairs(t)].sum() for t in trial]), size, edits)
    trial = _walkers(trial)
    met = np.zeros(len(picked), bool)
    goal = min(recall + 2 * np.sqrt(recall * (1 - recall) / len(picked)), 1.0)  # two standard errors of the trials above
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    r = 0
    while not r:
        if len(blocks) * BLOCK >= MAX_REPETITIONS:
            raise ValueError(f"recall {recall} at similarity {similarity} is not reached for items of {size} words: {met.mean():.3f} after {MAX_REPETITIONS} repetitions")
        bits = rng.integers(0, 2**63, (BLOCK, 2 * size), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        steps = np.sort(rng.integers(0, 2 * size, (BLOCK, SAMPLED)), axis=1)
        keys = walk(*own, bits, steps)
        same = (walk(*trial, bits, steps) == keys[picked]) & passed[:, None]
        reached = np.maximum.accumulate(np.concatenate([met[:, None], same], axis=1), axis=1)
        enough = np.flatnonzero(reached.mean(axis=0)[1:] >= goal)
        if len(enough):
            r = max(len(blocks) * BLOCK + int(enough[0]) + 1, 8)
        met = reached[:, -1]
        blocks.append((bits, steps))
    bits, steps = (np.concatenate([b[k] for b in blocks])[:r] for k in range(2))
    # a key holds the number of its repetition, so keys are made over all blocks
    flat, item = walk(*own, bits, steps).ravel(), np.repeat(np.array(numbers), r)
    order = np.argsort(flat)
    return SizeClass(size, edits, bits, steps, flat[order], item[order])


def build_index(ids: list, texts: list[str | None], similarity: float = 0.8, recall: float = 0.95) -> Index:
    """Items without words are left out: they match nothing."""
    words = words_of(texts, loose=True)
    items = [words.of(k) for k in range(len(texts))]
    known = np.zeros(_TABLE, bool)
    for item in items:
        known[_pairs(item)] = True
    pieces = [(k, piece) for k, item in enumerate(items) if len(item) for piece in np.array_split(item, -(-len(item) // PIECE_WORDS))]
    classes, number = [], 0
    ranked = sorted(range(len(pieces)), key=lambda k: (len(pieces[k][1]), k))
    while number < len(ranked):
        size = len(pieces[ranked[number]][1])
        members = [pieces[k] for k in ranked[number:] if len(pieces[k][1]) <= size * 1.15]
        number += len(members)
        classes.append(_size_class([m[0] for m in members], [m[1] for m in members], size, similarity, recall, known, seed=size))
    return Index(ids, items, similarity, classes, known)


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where the part ends."""
    row = np.zeros(len(text) + 1, np.int64)
    index = np.arange(len(text) + 1)
    for k, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - index) + index
    end = int(np.argmin(row))
    return int(row[end]), end


def matches(words: Words, index: Index) -> list[tuple[int, int, int, int]]:
    """Text, item, distance and first word of the region, for each item found in a text."""
    hashed = words.hashes
    if not len(hashed) or not index.classes:
        return []
    sums = np.concatenate([[0], np.cumsum(index.known[_pairs(hashed)]), [0]])
    sums[-1] = sums[-2]  # pairs before each word
    text = np.searchsorted(words.word_of, np.arange(len(hashed)), side="right") - 1
    end = words.word_of[1:][text]
    met: set[tuple[int, int, int, int]] = set()
    for c in index.classes:
        # a window that is cut short by the end of the text can still match, with the words it lacks as edits
        stop = np.minimum(np.arange(len(hashed)) + c.size, end)
        start = np.flatnonzero(_enough(sums[stop - 1] - sums[:-1], c.size, c.edits))
        chunk = max(1, TOGETHER // len(c.bits))
        for s in range(0, len(start), chunk):
            own = start[s : s + chunk]
            keys = walk(hashed, own, end[own], c.bits, c.steps)
            low, high = np.searchsorted(c.keys, keys), np.searchsorted(c.keys, keys, side="right")
            for w, r in zip(*np.nonzero(high > low), strict=True):
                at = int(own[w])
                for item in set(c.item[low[w, r] : high[w, r]].tolist()):
                    met.add((int(text[at]), item, at // c.size * c.size, c.size))
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for k, item, at, size in sorted(met):
        n, limit = len(index.items[item]), allowed(len(index.items[item]), index.similarity)
        low = max(at - n - limit, int(words.word_of[k]))
        high = min(at + size + n + limit + 1, int(words.word_of[k + 1]))
        some = regions.setdefault((k, item), [])
        if some and low <= some[-1][1]:
            low, high = some[-1][0], max(high, some.pop()[1])
        some.append((low, high))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for (k, item), some in regions.items():
        symbols = index.items[item]
        n, limit = len(symbols), allowed(len(symbols), index.similarity)
        for low, high in some:
            distance, _ = best_place(symbols, hashed[low:high])
            if distance <= limit and distance < best.get((k, item), (n + 1, 0))[0]:
                best[k, item] = distance, low - int(words.word_of[k])
    return [(k, item, d, low) for (k, item), (d, low) in sorted(best.items())]


def _passes(benchmark: DataFrame, similarity: float, recall: float) -> Iterator[Index]:
    """Indexes over the benchmark, each of at most PASS_CHARS characters (or one item)."""
    sizes = benchmark.select("item_id", "text", F.length("text").alias("n")).where("n > 0")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // PASS_CHARS))
    for part in range(parts):
        rows = sizes.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if rows:
            yield build_index([r["item_id"] for r in rows], [r["text"] for r in rows], similarity, recall)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One row for each item found in each row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, item_id, distance`` (word edits to the best place),
    ``item_words``. An item of n words is found at distance (1 - ``similarity``) n
    or less, with at least ``recall`` of such pairs right at that distance met by
    the LSH in simulation; items of under five words must occur unchanged. Null
    and empty texts or items match nothing; equal rows each get their rows; an
    empty table on either side gives no rows; other columns are ignored.
    """
    schema = "doc_id long, item_id long, distance long, item_words long"
    out = None
    for index in _passes(benchmark, similarity, recall):

        def rows(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            # ids stay in Arrow, which keeps them whole beside nulls
            ids = pa.array(index.ids, pa.int64())
            sizes = np.array([len(i) for i in index.items], np.int64)
            for batch in batches:
                for begin, texts in parcels(batch.column("text").to_pylist()):
                    found = np.array(matches(words_of(texts, loose=True), index), np.int64).reshape(-1, 4)
                    if len(found):
                        doc = batch.column("doc_id").take(pa.array(begin + found[:, 0]))
                        yield pa.RecordBatch.from_arrays(
                            [doc, ids.take(pa.array(found[:, 1])), pa.array(found[:, 2]), pa.array(sizes[found[:, 1]])], names=["doc_id", "item_id", "distance", "item_words"]
                        )

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _clean(index: Index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        for begin, part in parcels(texts.tolist()):
            out[[begin + f[0] for f in matches(words_of(part, loose=True), index)]] = False
        return pd.Series(out)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """``docs`` without the rows in which an item is found; all columns stay. Null texts stay."""
    for index in _passes(benchmark, similarity, recall):
        docs = docs.where(_clean(index)("text"))
    return docs
