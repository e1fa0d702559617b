"""Quality classifier: a factorisation machine over words, structure and metadata.

A document is a sparse vector: hashed words, statistics of its structure (as
values and as one-hot bins) and its recorded length. The score is the logistic
of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairwise sum is taken
in linear time as ``0.5 * sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)``.

The model is fitted on a bounded sample of labelled rows and has a fixed size,
so it travels with the tasks; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import Words, parcels, words_of

WORD_SLOTS = 1 << 14
#: Edges of the one-hot bins of a statistic.
BINS = np.array([0.001, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.85])
N_STATS = 18
N_SLOTS = WORD_SLOTS + N_STATS * (len(BINS) + 2)

def _bytes_of(*ranges: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for r in ranges for c in r]] = True
    return table


_UPPER, _LOWER, _DIGIT = (_bytes_of(x) for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
_MARK, _PUNCT, _BANG = _bytes_of("%#$&*|@^~_=<>{}\\"), _bytes_of(".,;:!?"), _bytes_of("!?")
_SPACE, _LINE = _bytes_of("\t\n\x0b\x0c\r "), _bytes_of("\n")


@dataclass(frozen=True)
class Vectors:
    """Sparse vectors: slots and values of row ``k`` are at ``at[k]`` to ``at[k + 1]``."""

    at: np.ndarray
    slots: np.ndarray
    values: np.ndarray


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring ``cuts``."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[cuts])


def _kinds(hashes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its different hashes with their counts, the most frequent first."""
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    order = np.lexsort((hashes, row))
    first = np.flatnonzero(np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])])) if len(order) else order
    times = np.diff(np.concatenate([first, [len(order)]]))
    kinds, own = hashes[order][first], row[order][first]
    by_times = np.lexsort((-times, own))
    return own[by_times], kinds[by_times], times[by_times]


def statistics(texts: list[str], n_chars: np.ndarray, words: Words, lines: Words) -> np.ndarray:
    """Shares between 0 and 1 that describe the structure of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    cuts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    codes = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    of = lambda table: _sums(table[codes], cuts)
    size = np.maximum(_sums((codes & 0xC0) != 0x80, cuts) - 1, 1)
    bang = np.concatenate([[False], _BANG[codes], [False]])
    edge = np.flatnonzero(bang[1:] != bang[:-1])
    pairs = np.bincount(np.searchsorted(cuts, edge[::2], side="right") - 1, (edge[1::2] - edge[::2]) // 2, len(texts))
    space = np.concatenate([[True], _SPACE[codes], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[::2], edge[1::2]
    # words by text; counts of classes of bytes in a word
    word_cuts = words.word_of
    n = np.maximum(np.diff(word_cuts), 1)
    per_word = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[codes])])[np.stack([begin, end])], axis=0)[0]
    loud = (per_word(_UPPER) > 0) & (per_word(_LOWER) == 0)
    length = end - begin
    own, _, times = _kinds(words.hashes, word_cuts)
    kinds = np.searchsorted(own, np.arange(len(texts) + 1))
    rank = np.arange(len(own)) - kinds[own]
    top = lambda most: np.bincount(own, np.where(rank < most, times, 0), len(texts))
    again = np.concatenate([words.hashes[1:] == words.hashes[:-1], [False]])[: len(words.hashes)]
    again[word_cuts[1:][np.diff(word_cuts) > 0] - 1] = False
    n_lines = of(_LINE)  # the newline behind each text ends its last line
    line_own = _kinds(lines.hashes, lines.word_of)[0]
    blank = n_lines > np.diff(lines.word_of)
    given = np.where(np.isnan(n_chars), _sums((codes & 0xC0) != 0x80, cuts) - 1, n_chars)
    return np.column_stack(
        [
            of(_UPPER) / size,
            of(_DIGIT) / size,
            of(_MARK) / size,
            of(_PUNCT) / size,
            10 * pairs / size,
            _sums(again, word_cuts) / n,
            np.diff(kinds) / n,
            top(1) / n,
            top(4) / n,
            _sums(loud, word_cuts) / n,
            np.minimum(_sums(length, word_cuts) / n / 20, 1.0),
            np.minimum(np.log1p(n) / 12, 1.0),
            np.minimum(np.log1p(n_lines) / 8, 1.0),
            (np.bincount(line_own, minlength=len(texts)) + blank) / n_lines,
            _sums(_PUNCT[codes[end - 1]], word_cuts) / n,
            _sums(length <= 2, word_cuts) / n,
            np.minimum(np.log1p(np.maximum(given, 0.0)) / 15, 1.0),
            (np.diff(word_cuts) == 0).astype(float),
        ]
    )


def features(texts: list[str | None], n_chars: np.ndarray) -> Vectors:
    """Vectors of some documents; every word of the whole texts counts, a null text is empty."""
    texts = [t or "" for t in texts]
    words, lines = words_of(texts, fold=False), words_of(texts, fold=False, parting=_LINE)
    stats = statistics(texts, n_chars, words, lines)
    row = np.repeat(np.arange(len(texts)), np.diff(words.word_of))
    cell, times = np.unique(row * WORD_SLOTS + (words.hashes % np.uint64(WORD_SLOTS)).astype(np.int64), return_counts=True)
    own, slot = np.divmod(cell, WORD_SLOTS)
    # square roots of counts, so the squared norm is the number of words
    weight = np.sqrt(times / np.maximum(np.diff(words.word_of), 1)[own])
    stat = np.arange(N_STATS) * (len(BINS) + 2) + WORD_SLOTS
    every = np.repeat(np.arange(len(texts)), N_STATS)
    rows = np.concatenate([own, every, every])
    order = np.argsort(rows, kind="stable")
    slots = np.concatenate([slot, np.tile(stat, len(texts)), (stat + 1 + np.searchsorted(BINS, stats)).ravel()])
    values = np.concatenate([weight, stats.ravel(), np.ones(len(every))])
    return Vectors(np.searchsorted(rows[order], np.arange(len(texts) + 1)), slots[order], values[order])


@dataclass(frozen=True)
class Machine:
    """Bias, linear weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, rows: Vectors) -> np.ndarray:
        """Value of each row; none is empty."""
        vx = self.factors[rows.slots] * rows.values[:, None]
        total, own = (np.add.reduceat(x, rows.at[:-1], axis=0) for x in (vx, vx * vx))
        return self.bias + np.add.reduceat(self.linear[rows.slots] * rows.values, rows.at[:-1]) + 0.5 * (total * total - own).sum(axis=1)

    def scores(self, rows: Vectors) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit(
    examples: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    n_factors: int = 4,
    epochs: int = 12,
    batch: int = 64,
    rate: float = 0.05,
    decay: float = 1e-4,
    seed: int = 7,
) -> Machine:
    """Mini-batch AdaGrad on the logistic loss. No examples give a machine that scores 0.5."""
    rng = np.random.default_rng(seed)
    # column 0 is the linear weight, the others are factors
    theta = np.hstack([np.zeros((N_SLOTS, 1)), rng.normal(0, 0.01, (N_SLOTS, n_factors))])
    squares, bias, bias_square = np.full_like(theta, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            sizes = [len(examples[i][0]) for i in chosen]
            slots = np.concatenate([examples[i][0] for i in chosen])
            x = np.concatenate([examples[i][1] for i in chosen]).astype(np.float64)[:, None]
            starts, row = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(chosen)), sizes)
            wx = theta[slots] * x
            sums = np.add.reduceat(wx, starts, axis=0)
            own = np.add.reduceat(wx[:, 1:] ** 2, starts, axis=0)
            margin = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - own).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]) / len(chosen)
            grad = x * error[row][:, None] * np.hstack([np.ones((len(x), 1)), sums[row, 1:] - wx[:, 1:]])
            touched, where = np.unique(slots, return_inverse=True)
            step = np.column_stack([np.bincount(where, grad[:, k], len(touched)) for k in range(theta.shape[1])])
            step += decay * theta[touched]
            squares[touched] += step**2
            theta[touched] -= rate * step / np.sqrt(squares[touched])
            bias_square += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(bias_square)
    return Machine(float(bias), theta[:, 0].astype(np.float32), theta[:, 1:].astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Rows of the fold that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = batch["n_chars"].to_numpy(np.float64)
        for begin, texts in parcels(batch["text"].tolist()):
            some = batch.iloc[begin : begin + len(texts)]
            rows = features(texts, sizes[begin : begin + len(texts)])
            parts = [slice(a, b) for a, b in zip(rows.at, rows.at[1:], strict=False)]
            slots, values = rows.slots.astype("<i4"), rows.values.astype("<f4")
            yield pd.DataFrame({"quality": some["quality"].array, "doc_id": some["doc_id"].array, "slots": [slots[p].tobytes() for p in parts], "vals": [values[p].tobytes() for p in parts]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold.

    The sample is the rows with the smallest hash of their id, so it is the same
    in every run. Only vectors of the sample reach the driver, at most
    2 * ``max_rows``, as an id may be repeated. Rows without
    label are skipped; a document with several labels counts as 1 if their mean
    is 0.5 or more.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
        .join(F.broadcast(chosen), "doc_id")  # max_rows at most
        .mapInPandas(_vectors, "quality int, doc_id long, slots binary, vals binary")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "slots", "vals")
        .limit(2 * max_rows)  # ids may be repeated
        .toArrow()  # no Python object for each row
    )
    rows = rows.sort_by([("doc_id", "ascending"), ("slots", "ascending"), ("vals", "ascending")])
    examples = [(np.frombuffer(s.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4")) for s, v in zip(rows["slots"], rows["vals"], strict=True)]
    return fit(examples, rows["quality"].to_numpy().astype(np.float64))


def scored(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    ``text`` and ``n_chars`` are the inputs; null and empty texts get the score of
    an empty document, a null ``n_chars`` counts as the length of the text. Columns
    named like the new ones are replaced; all other columns stay as they are.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            sizes = sizes.to_numpy(np.float64)
            found = [machine.scores(features(part, sizes[begin : begin + len(part)])) for begin, part in parcels(texts.tolist())]
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    out = docs.withColumn("score", score(F.col("text"), F.col("n_chars").cast("double")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 4000) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``."""
    return scored(docs, train(docs, labels, max_rows), threshold)
