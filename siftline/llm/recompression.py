"""Substring dedup over words: words covered by a window of L words whose sequence also starts earlier.

The words of a text are rewritten by recompression. A round first names maximal
runs of one symbol, then pairs of neighbours of which the first lies in one half
of all symbols and the second in the other. Names are 64-bit digests of what
they stand for, so all tasks give one name to one thing. Every symbol knows its
context, the words on which it depends; whoever has the same words has the same
symbol, whatever stands around them.

1. The anchor of a window is a symbol of the highest round whose context lies in
   the window, the one with the smallest digest if there are several. Equal
   windows have equal anchors at equal distance.
2. Half of the words of a window besides its anchor lie in front of it or behind
   it. With them the symbol becomes a name, which is counted over all texts. A
   name with one place belongs to windows that occur once.
3. The windows with one anchor and name are a context. Equal contexts are repeats
   as a whole; all but the first are removed. Tasks settle this among the texts
   that they have at hand, so a name that all texts have is sent once by each.
4. Different contexts of one name may share some of their windows. The first
   place of each context sends its windows as digests, and all but the first
   place of a digest are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import Scratch, dealt_join, n_words
from siftline.llm.tokens import mix, parcels, words_of

L = 20
#: A context of round r has at most 2 ** (r + 2) - 2 words, runs aside; the highest that always fits into a window.
ROUNDS = (L + 2).bit_length() - 3
#: Words of a text that are rewritten together; parts overlap by L - 1 words, so every window lies in one part.
PART = 1 << 20

_A, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_FAR = 1 << 40
_PLACE_BITS = 26


class Symbols:
    """Symbols of one round: name, first word and context (``low`` to ``high``); walls stand between texts."""

    def __init__(self, name: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, wall: np.ndarray):
        self.name, self.at, self.low, self.high, self.wall = name, at, low, high, wall

    def runs(self) -> Symbols:
        """Maximal runs as one symbol; that a run ends depends on its neighbours."""
        same = (self.name[1:] == self.name[:-1]) & ~self.wall[1:] & ~self.wall[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.concatenate([first[1:], [len(self.name)]]) - 1
        name, wall, times = self.name[first], self.wall[first], last - first + 1
        name = np.where(times > 1, mix(name * _C + times.astype(np.uint64)), name)
        low = np.where(wall, -_FAR, self.low[np.maximum(first - 1, 0)])
        high = np.where(wall, _FAR, self.high[np.minimum(last + 1, len(self.name) - 1)])
        return Symbols(name, self.at[first], low, high, wall)

    def pairs(self, number: int) -> Symbols:
        """Neighbours from the left and the right half of all symbols as one; who stays single depends on the neighbour."""
        left = (mix(self.name + np.uint64(number * int(_A) % 2**64)) >> np.uint64(63)).astype(bool) & ~self.wall
        right = ~left & ~self.wall
        head = np.concatenate([left[:-1] & right[1:], [False]])
        tail = np.concatenate([[False], head[:-1]])
        after, before = np.roll(self.high, -1), np.roll(self.low, 1)
        name = np.where(head, mix(self.name * _A + mix(np.roll(self.name, -1) + _C)), self.name)
        low = np.where(right & ~tail, before, self.low)
        high = np.where(left, after, self.high)
        stay = ~tail
        return Symbols(name[stay], self.at[stay], low[stay], high[stay], self.wall[stay])


def _least(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest of ``key`` in each range, from the minima of all ranges of 1, 2, 4, ... keys."""
    power = np.frexp(end - begin)[1] - 1
    found = np.empty(len(begin), key.dtype)
    for k in range(int(power.max()) + 1):
        of = np.flatnonzero(power == k)
        found[of] = np.minimum(key[begin[of]], key[end[of] - (1 << k)])
        key = np.minimum(key, np.concatenate([key[1 << k :], key[len(key) - (1 << k) :]])[: len(key)])
    return found


def anchors(words: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and begin and end of the anchor, for each run of windows with one anchor.

    ``wall`` marks the cells between texts, the first and the last cell included; their words count for nothing.
    """
    at = np.arange(len(words))
    rounds = [Symbols(words, at, np.where(wall, -_FAR, at), np.where(wall, _FAR, at + 1), wall)]
    for number in range(1, ROUNDS + 1):
        rounds.append(rounds[-1].runs().pairs(number))
    walls = np.concatenate([[0], np.cumsum(wall)])
    start = np.zeros(len(words), bool)
    start[: max(len(words) - L + 1, 0)] = walls[L:] == walls[: len(words) - L + 1] if len(words) >= L else False
    place, stop = np.full(len(words), -1), np.full(len(words), -1)
    for symbols in reversed(rounds):
        new = np.flatnonzero(start & (place < 0))
        inside = np.flatnonzero(symbols.high - symbols.low <= L)
        # contexts begin and end in the order of their symbols, so those within a window are neighbours
        begin = np.searchsorted(symbols.low[inside], new)
        end = np.searchsorted(symbols.high[inside], new + L, side="right")
        new, begin, end = (x[begin < end] for x in (new, begin, end))
        if not len(new):
            continue
        key = (mix(symbols.name[inside] + _A) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | inside.astype(np.uint64)
        chosen = (_least(key, begin, end) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        place[new], stop[new] = symbols.at[chosen], symbols.at[chosen + 1]  # a wall is the last of all
    own = np.flatnonzero(start)
    if not len(own):
        return own, own, own, own
    change = (np.diff(own) > 1) | (np.diff(place[own]) != 0) | (np.diff(stop[own]) != 0)
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    last = np.concatenate([first[1:], [len(own)]]) - 1
    return own[first], own[last], place[own[first]], stop[own[first]]


class Digests:
    """Digests of all runs of some words."""

    def __init__(self, words: np.ndarray):
        base = np.full(len(words) + 1, _A)
        base[0] = 1
        up = np.multiply.accumulate(base)
        base[1:] = np.uint64(pow(int(_A), -1, 2**64))
        self.down = np.multiply.accumulate(base)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + _C) * up[:-1])])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Digest of ``size`` words from place ``start`` on."""
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])


class Cells:
    """Words of some texts, or parts of texts, with walls around them."""

    def __init__(self, texts: list[str | None]):
        found = words_of(texts, fold=False)
        parts = [
            (k, begin, min(begin + PART + L - 1, size))
            for k, size in enumerate(np.diff(found.word_of).tolist())
            if size >= L
            for begin in range(0, size - L + 1, PART)
        ]
        self.text = np.array([k for k, _, _ in parts], np.int64)
        self.begin = np.array([b for _, b, _ in parts], np.int64)
        size = np.array([e - b for _, b, e in parts], np.int64)
        self.cell = np.cumsum(size + 1) - size  # first cell of a part
        self.words = np.zeros(int((size + 1).sum()) + 1, np.uint64)
        self.wall = np.zeros(len(self.words), bool)
        self.wall[np.concatenate([[0], self.cell + size])] = True
        self.words[~self.wall] = np.concatenate([found.of(k)[b:e] for k, b, e in parts]) if parts else []
        self.digests = Digests(self.words).of

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Text, place of the first cell in the text, first and last window, anchor, name; windows and anchors as cells."""
        first, last, place, stop = anchors(self.words, self.wall)
        half = (L - (stop - place)) // 2
        # windows that hold half of their other words in front of the anchor, and those that hold them behind it
        front, behind = np.flatnonzero(first <= place - half), np.flatnonzero(last > place - half)
        of = np.concatenate([front, behind])
        name = np.concatenate(
            [
                self.digests(place[front] - half[front], stop[front] - place[front] + half[front]),
                ~self.digests(place[behind], L + 1 - half[behind]),
            ]
        )
        first = np.concatenate([first[front], np.maximum(first[behind], place[behind] - half[behind] + 1)])
        last = np.concatenate([np.minimum(last[front], place[front] - half[front]), last[behind]])
        order = np.argsort(first, kind="stable")
        first, last, place, name = first[order], last[order], place[of][order], name[order]
        part = np.searchsorted(self.cell, first, side="right") - 1
        return self.text[part], self.begin[part] - self.cell[part], first, last, place, name


_CONTEXT = [("tid", T.LongType()), ("name", T.LongType()), ("context", T.LongType()), ("at", T.LongType()), ("n", T.IntegerType()), ("again", T.BooleanType())]


def _places(ids: pa.Array, tids: np.ndarray) -> np.ndarray:
    """Places of rows in the order of the documents, null last; repeated rows share one."""
    frame = pa.table({"id": ids, "tid": tids})
    order = pc.sort_indices(frame, [("id", "ascending"), ("tid", "ascending")], null_placement="at_end").to_numpy()
    rows = [(ids[i].as_py(), tids[i]) for i in order.tolist()]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum([0, *(x != y for x, y in zip(rows[1:], rows, strict=False))]) if rows else []
    return place


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first place of each context of a parcel of texts, and the places after it as runs of windows (``again``)."""
    for batch in batches:
        ids, tids = batch.column("doc_id"), batch.column("tid").to_numpy()
        places = _places(ids, tids)
        for offset, texts in parcels(batch.column("text").to_pylist()):
            cells = Cells(texts)
            text, shift, first, last, anchor, name = cells.anchors()
            if not len(text):
                continue
            context = mix(cells.digests(first, last - first + L) + (anchor - first).astype(np.uint64) * _C)
            place, start = places[offset + text], first + shift
            order = np.lexsort((start, place, context, name))
            same = (name[order][1:] == name[order][:-1]) & (context[order][1:] == context[order][:-1])
            group = np.concatenate([[0], np.cumsum(~same)])
            lead = order[np.concatenate([[True], ~same])][group]  # of each row in order, the first of its group
            again = np.zeros(len(text), bool)
            again[order] = (place[order] != place[lead]) | (start[order] != start[lead])
            # consecutive places after the first become one run of windows
            joined = np.concatenate([[False], again[1:] & again[:-1] & (text[1:] == text[:-1]) & (start[1:] <= last[:-1] + shift[:-1] + 1)])
            head = np.flatnonzero(~joined)
            size = np.maximum.reduceat(last, head) - first[head] + 1
            row = offset + text[head]
            columns = [pa.array(tids[row]), pa.array(name[head].view(np.int64)), pa.array(context[head].view(np.int64)), pa.array(start[head]), pa.array(size.astype(np.int32)), pa.array(again[head])]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *columns], ["doc_id", *(c for c, _ in _CONTEXT)])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and digest of the windows of some contexts of each text."""
    for batch in batches:
        ids, tids, runs = batch.column("doc_id"), batch.column("tid").to_numpy(), batch.column("runs").to_pylist()
        for offset, texts in parcels(batch.column("text").to_pylist()):
            found = words_of(texts, fold=False)
            digests = Digests(found.hashes)
            rows = np.repeat(np.arange(len(texts)), [len(r) for r in runs[offset : offset + len(texts)]])
            flat = [(x["at"], x["n"]) for r in runs[offset : offset + len(texts)] for x in r]
            begin, size = np.array(flat, np.int64).reshape(-1, 2).T
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            row = np.repeat(rows, size)
            window = digests.of(found.word_of[row] + at, L).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(offset + row)), pa.array(tids[offset + row]), pa.array(at), pa.array(window)], ["doc_id", "tid", "at", "window"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words removed and digest of the rest, for texts with some spans."""
    for batch in batches:
        removed, digests = [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            gone = np.zeros(len(words) + 1, np.int64)
            spans = spans.as_py()
            np.add.at(gone, [s["lo"] for s in spans], 1)
            np.add.at(gone, [s["hi"] for s in spans], -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(~gone).tolist())).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "tid", "removed", "kept"])


def _beside(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the text of their document, once for repeated documents."""
    on = (F.col("d.tid") == F.col("r.tid")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))
    return docs.alias("d").join(rows.alias("r"), on).select("r.*", "d.text")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans of words, ``lo`` to ``hi``, of the texts (``doc_id``, ``tid``, ``text``) that also start earlier, in the order of ids with null last."""
    doc_id = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    shape = lambda *fields: T.StructType([doc_id, *(T.StructField(name, kind) for name, kind in fields)])
    rows = docs.mapInArrow(_context_rows, shape(*_CONTEXT))
    end = (F.col("at") + F.col("n") + (L - 1)).alias("hi")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tid", "at")
    # rows of a parcel that are known to be later need not meet any others, so no name has more rows than there are parcels
    name = F.when(F.col("again"), F.xxhash64("tid", "at")).otherwise(F.col("name"))
    met = rows.withColumn("name", name).repartition("name").withColumn("place", place)
    met = met.withColumn("lead", F.min(F.when(~F.col("again"), F.col("place"))).over(Window.partitionBy("name", "context", "again")))
    alone = F.min("context").over(Window.partitionBy("name", "again")) == F.max("context").over(Window.partitionBy("name", "again"))
    met = met.withColumn("later", F.col("again") | (F.col("place") > F.col("lead"))).withColumn("alone", alone)
    met = scratch.write(met.where("later OR NOT alone").select("doc_id", "tid", "at", "n", "later"), "contexts")
    whole = met.where("later").select("doc_id", "tid", F.col("at").alias("lo"), end)
    # equal windows are in contexts of one name; the first place of a context stands for its others
    runs = met.where(~F.col("later")).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    windows = _beside(docs, runs).mapInArrow(_window_rows, shape(("tid", T.LongType()), ("at", T.LongType()), ("window", T.LongType())))
    windows = scratch.write(windows.withColumn("place", place), "windows")
    earliest = windows.groupBy("window").agg(F.min("place").alias("lead"), F.count(F.lit(1)).alias("uses")).where("uses > 1").drop("uses")
    far = dealt_join(windows, earliest, ["window"], "tid", parts=4).where(F.col("place") > F.col("lead"))
    return whole.unionByName(far.select("doc_id", "tid", F.col("at").alias("lo"), (F.col("at") + L).alias("hi")))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs`` (``doc_id``, ``text``).

    A word goes if some window of L words that covers it has a sequence of words
    that also starts earlier, in a text of a smaller id or before it in its own
    text; all is judged on the input. Null ids come last, texts of one id in the
    order of a hash; rows repeated with id and text are one text with one
    result. Texts under L words, empty and null ones keep everything (null counts
    as empty). No rows give no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "recompression")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    # shorter texts have no window, and a word and its gap take two characters
    long = docs.where(F.length("text") >= 2 * L - 1)
    spans = repeated_spans(long, scratch).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    shape = T.StructType([docs.schema["doc_id"], docs.schema["tid"], T.StructField("removed", T.LongType()), T.StructField("kept", T.StringType())])
    cut = scratch.write(_beside(long, spans).mapInArrow(_kept, shape).distinct(), "cut")
    plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    rows = docs.select("doc_id", "tid", n_words(F.col("text")).alias("n_words"), F.sha2(plain, 256).alias("whole"))
    on = (F.col("a.tid") == F.col("c.tid")) & F.col("a.doc_id").eqNullSafe(F.col("c.doc_id"))
    return rows.alias("a").join(cut.alias("c"), on, "left").select(
        "a.doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256")
    )


#: Words by place, each window of L words under its words, and the words that a later one covers.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
hashed AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM starts),
later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM hashed) WHERE n > 1
),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
