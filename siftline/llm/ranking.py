"""Ranked lexical search by two trees: batches of items against blocks of documents.

An item is a vector of term weights, a document a vector of term impacts, and
the score of the two their product. Both sides stand in trees whose nodes hold
the largest value of every coordinate below them. The product of two nodes bounds
every score between them; where it is lower than the weakest k-th score among
the node's items, the whole batch of items is done with the whole block of
documents. Bounds and scores are integers, so nothing is lost to rounding.

Documents are read twice: once as text, which leaves a vector over the items'
terms in a table, and once as these vectors. Every task builds the trees of its
own blocks and keeps k documents an item. Items start with the k-th score that a
share of the documents gives them, which no later result can be below, so a task
sends only rows that may still count.

The items are the stated set of queries. They go to the tasks in passes of at
most PASS_TERMS terms (or one item), each of which reads the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import Scratch
from siftline.llm.tokens import parcels, words_of

#: Everything in ASCII but digits and letters parts terms.
PARTING = np.ones(256, bool)
PARTING[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Terms, repeats included, of the items of one pass.
PASS_TERMS = 1 << 18
#: Children of a node of the documents' tree, and of the items' tree; levels above the documents.
DOC_FAN, ITEM_FAN, DOC_LEVELS, ITEM_LEVELS = 16, 8, 3, 2
#: Entries of the vectors that make one tree, and blocks of documents that an item looks at before it asks for its k-th score again.
ENTRIES, STRIDE = 1 << 21, 8
#: One of so many documents, by a hash of its vector, gives the scores that the items start with.
STARTS = 32


def terms_of(texts: list[str | None]):
    return words_of(texts, parting=PARTING)


def _list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def _vectors(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Id, number of terms, and those of the vocabulary with their occurrences, of each document with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for offset, texts in parcels(batch.column("text").to_pylist()):
                found = terms_of(texts)
                sizes = np.diff(found.word_of)
                at = np.minimum(np.searchsorted(vocabulary, found.hashes), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == found.hashes)
                doc = np.repeat(np.arange(len(texts)), sizes)[known]
                pair, times = np.unique(doc * len(vocabulary) + at[known], return_counts=True)
                doc, term = np.divmod(pair, len(vocabulary))
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
                some = np.flatnonzero(sizes > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(offset, len(texts)).take(pa.array(some)),
                        pa.array(sizes[some], pa.int64()),
                        _list_array([term[cuts[k] : cuts[k + 1]] for k in some], pa.int32()),
                        _list_array([times[cuts[k] : cuts[k + 1]] for k in some], pa.int64()),
                    ],
                    ["doc_id", "n", "terms", "times"],
                )

    return run


class Rows:
    """Sparse rows: ``at[k]`` to ``at[k + 1]`` are the terms and values of row ``k``."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.at, self.terms, self.values = at, terms, values

    def above(self, fan: int) -> Rows:
        """The largest values of each ``fan`` rows."""
        size = int(self.terms.max(initial=0)) + 1
        key = np.repeat(np.arange(len(self.at) - 1) // fan, np.diff(self.at)) * size + self.terms
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        node, terms = np.divmod(key[order][first], size)
        values = np.maximum.reduceat(self.values[order], first) if len(first) else self.values[:0]
        return Rows(np.searchsorted(node, np.arange(-(-(len(self.at) - 1) // fan) + 1)), terms, values)

    def only(self, places: np.ndarray) -> Rows:
        """Terms by their new places, without those that have none (-1)."""
        new = places[self.terms]
        keep = new >= 0
        return Rows(np.concatenate([[0], np.cumsum(keep)])[self.at], new[keep], self.values[keep])

    def times(self, dense: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Product of each of ``rows`` with a dense vector."""
        begin, size = self.at[rows], self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(size)
        entry = np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.concatenate([[0], np.cumsum(dense[self.terms[entry]] * self.values[entry])])
        return sums[ends] - sums[ends - size]


class Items:
    """The items of a pass: their ids, term weights, and k-th scores to begin with."""

    def __init__(self, ids: list, rows: Rows, starts: np.ndarray, k: int):
        self.ids, self.rows, self.starts, self.k = ids, rows, starts, k

    def batches(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For items that are one tree: the first item, its terms, and the dense rows of each level, items first."""
        size = ITEM_FAN**ITEM_LEVELS
        for first in range(0, len(self.ids), size):
            last = min(first + size, len(self.ids))
            lo, hi = self.rows.at[first], self.rows.at[last]
            terms, at = np.unique(self.rows.terms[lo:hi], return_inverse=True)
            dense = np.zeros((last - first, len(terms)), np.int64)
            dense[np.repeat(np.arange(last - first), np.diff(self.rows.at[first : last + 1])), at.reshape(-1)] = self.rows.values[lo:hi]
            levels = [dense]
            for _ in range(ITEM_LEVELS):
                levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), ITEM_FAN), axis=0))
            yield first, terms, levels


class Search:
    """The best k documents of each item so far, and the walk through both trees."""

    def __init__(self, items: Items):
        self.items = items
        self.best: list[list[tuple[int, bool, object]]] = [[] for _ in items.ids]  # minus the score, id is null, id
        self.kth = items.starts.copy()

    def add(self, ids: pa.Array, docs: Rows, size: int) -> None:
        """``docs`` stand in the order of ``ids``; the tree orders them by their weightiest term, so that like are together."""
        row = np.repeat(np.arange(len(ids)), np.diff(docs.at))
        order = np.lexsort((docs.values, row))
        top = np.zeros(len(ids), np.int64)
        top[row[order]] = docs.terms[order]  # the last of a row stays
        self.ids, self.order = ids, np.argsort(top, kind="stable")
        lengths = np.diff(docs.at)[self.order]
        ends = np.cumsum(lengths)
        entry = np.repeat(docs.at[self.order] - ends + lengths, lengths) + np.arange(len(docs.terms))
        levels = [Rows(np.concatenate([[0], ends]), docs.terms[entry], docs.values[entry])]
        for _ in range(DOC_LEVELS):
            levels.append(levels[-1].above(DOC_FAN))
        places = np.full(size, -1)
        for first, terms, dense in self.items.batches():
            places[terms] = np.arange(len(terms))
            self.first, self.dense = first, dense
            self.levels = [level.only(places) for level in levels]
            places[terms] = -1
            self.visit(ITEM_LEVELS, 0, DOC_LEVELS, np.arange(len(levels[-1].at) - 1))

    def weakest(self, level: int, node: int) -> int:
        """Weakest k-th score of the items below a node."""
        size = ITEM_FAN**level
        return int(self.kth[self.first + node * size : min(self.first + (node + 1) * size, self.first + len(self.dense[0]))].min())

    def visit(self, level: int, node: int, depth: int, blocks: np.ndarray) -> None:
        """The items below ``node`` against the documents below ``blocks``; what is equal to a k-th score may still win by its id."""
        bounds = self.levels[depth].times(self.dense[level][node], blocks)
        open_ = np.flatnonzero(bounds >= self.weakest(level, node))
        if not len(open_):
            return
        open_ = open_[np.argsort(-bounds[open_], kind="stable")]
        if depth == 0:
            return self.offer(self.first + node, blocks[open_], bounds[open_])
        if level and level >= depth:
            for child in range(node * ITEM_FAN, min((node + 1) * ITEM_FAN, len(self.dense[level - 1]))):
                self.visit(level - 1, child, depth, np.sort(blocks[open_]))
            return
        stride = STRIDE if level == 0 and depth == 1 else len(open_)
        for begin in range(0, len(open_), stride):
            some = open_[begin : begin + stride]
            if bounds[some[0]] < self.weakest(level, node):
                return
            below = (np.sort(blocks[some])[:, None] * DOC_FAN + np.arange(DOC_FAN)).ravel()
            self.visit(level, node, depth - 1, below[below < len(self.levels[depth - 1].at) - 1])

    def offer(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        rank = self.order[docs]
        chosen = np.lexsort((rank, -scores))[: self.items.k]
        new = [(-int(scores[c]), not self.ids[int(rank[c])].is_valid, self.ids[int(rank[c])].as_py()) for c in chosen]
        kept = self.best[item] = sorted([*self.best[item], *new], key=lambda x: x[:2] if x[1] else x)[: self.items.k]
        if len(kept) == self.items.k:
            self.kth[item] = max(self.kth[item], -kept[-1][0])


def _searched(items: Items, n_docs: int, n_terms: int, size: int, doc_type: pa.DataType, item_type: pa.DataType) -> Callable:
    """The best documents of each item within a task; ``size`` is that of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items)
        for batch in batches:
            ids = batch.column("doc_id")
            sizes = pc.list_value_length(batch.column("terms")).to_numpy()
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(ENTRIES, int(sizes.sum()) + ENTRIES, ENTRIES)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                part = batch.slice(begin, max(min(end, len(ids)) - begin, 0))
                if len(part) == 0:
                    continue
                part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_end"))
                at = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column("terms")).to_numpy())])
                n, times = part.column("n").to_numpy(), part.column("times").flatten().to_numpy()
                m = 25 + (75 * n * n_docs) // n_terms
                impact = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, np.diff(at)))
                search.add(part.column("doc_id"), Rows(at, part.column("terms").flatten().to_numpy(), impact), size)
        rows = [(k, -score, doc) for k, best in enumerate(search.best) for score, _, doc in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([items.ids[r[0]] for r in rows], item_type),
                pa.array([r[2] for r in rows], doc_type),
                pa.array([r[1] for r in rows], pa.int64()),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    return run


def _passes(items: DataFrame) -> Iterator[list[Row]]:
    """Items in runs of at most PASS_TERMS terms, or of one item; a term takes two characters with its gap."""
    rows, total = [], 0
    for row in items.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        size = len(row["text"]) // 2 + 1
        if rows and total + size > PASS_TERMS:
            yield rows
            rows, total = [], 0
        rows.append(row)
        total += size
    if rows:
        yield rows


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item with their ranks; parts of an item's rows come first, so no task gets all of them."""
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(16))
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)


def _ranked(docs: DataFrame, rows: list[Row], item_type: T.DataType, k: int, scratch: Scratch) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    found = terms_of([r["text"] for r in rows])
    vocabulary, term = np.unique(found.hashes, return_inverse=True)
    doc_type = docs.schema["doc_id"].dataType
    empty = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]))
    if not len(vocabulary):
        return empty
    shape = T.StructType([T.StructField("doc_id", doc_type), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))])
    vectors = scratch.write(docs.mapInArrow(_vectors(vocabulary), shape), "vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return empty
    holds = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the vocabulary of a pass
        holds[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * h + 1))) for h in holds.tolist()], np.int64)
    item = np.repeat(np.arange(len(rows)), np.diff(found.word_of))
    pair, times = np.unique(item * len(vocabulary) + term.reshape(-1), return_counts=True)
    item, term = np.divmod(pair, len(vocabulary))
    values = times * weight[term]
    # items that share their weightiest term are neighbours in the tree
    heavy = np.zeros(len(rows), np.int64)
    by_value = np.lexsort((values, item))
    heavy[item[by_value]] = term[by_value]
    order = np.argsort(heavy, kind="stable")
    where = np.empty(len(rows), np.int64)
    where[order] = np.arange(len(rows))
    moved = np.lexsort((term, where[item]))
    sparse = Rows(np.searchsorted(where[item][moved], np.arange(len(rows) + 1)), term[moved], values[moved])
    items = Items([rows[i]["item_id"] for i in order.tolist()], sparse, np.ones(len(rows), np.int64), k)
    result = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    kinds = to_arrow_type(doc_type), to_arrow_type(item_type)
    vectors = vectors.where(F.size("terms") > 0)
    run = lambda share: share.mapInArrow(_searched(items, n_docs, n_terms, len(vocabulary), *kinds), result)
    starts = items.starts.copy()
    for r in _top(run(vectors.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(STARTS)) == 0)), k).where(F.col("rank") == k).select("item", "score").collect():
        starts[r["item"]] = r["score"]  # one row an item
    items.starts = starts
    return scratch.write(_top(run(vectors), k).select("item_id", "rank", "doc_id", "score"), "ranked")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each item.

    ``docs`` has ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``;
    other columns are ignored. Equal scores go by ascending id, null last.
    Null and empty texts have no terms: such documents are not counted, such items
    have no rows. Repeated rows of ``docs`` are documents of their own, repeated
    rows of ``items`` one item; texts that share an item's id are ranked apart.
    Terms are compared by 64-bit hash. No rows on either side give no rows.
    """
    docs, scratch, found = docs.select("doc_id", "text"), Scratch(docs.sparkSession, "ranking"), None
    item_type = items.schema["item_id"].dataType
    for rows in _passes(items):
        part = _ranked(docs, rows, item_type, k, scratch)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return items.join(docs, F.lit(False)).select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return found


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
c AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
i AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY ALL
),
t AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL
),
df AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM i JOIN df USING (term) JOIN t USING (term), c GROUP BY item_id, doc_id
),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
