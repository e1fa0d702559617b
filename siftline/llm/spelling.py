"""Spelling variants: words one edit apart, by bidirectional search in indexes of the vocabulary.

Words of length l and l + 1 that are one replaced or inserted letter apart agree
in one half of the shorter one exactly, at its end of the word. So a word is
posted under both halves of its own length and of the length below, and words
only meet in the shard of a half. A half with very many words is divided: with
it goes also one half of what is left, and so on.

A shard holds its words in one string with delimiters and two FM-indexes, of
the string and of the string reversed. A pattern is an interval of suffix ranks
in each, and a letter more at either end narrows both. A word matches its half
exactly, delimiter included, and is extended over the other half with one error;
a pattern that is delimited at both ends is a word. A letter that may stand in
several places in a run counts in the last one, so a pair is found exactly once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import Scratch, dealt_join

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_USES, RATIO, LOST = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of the words of a shard, about; words that may share a half before it is divided.
SHARD, GROUP = 1 << 18, 4096
#: Symbols between two counts of an index.
STEP = 8


class Index:
    """Ranks of all suffixes of delimited words in order, as counts of the symbols in front of them."""

    def __init__(self, words: list[np.ndarray], alphabet: int):
        """``words`` in order; symbols are 1 and up, 0 is the delimiter."""
        size = np.array([len(w) for w in words], np.int64)
        text = np.zeros(int(size.sum()) + len(words) + 1, np.int64)
        mark = np.concatenate([[0], np.cumsum(size + 1)])
        inner = np.ones(len(text), bool)
        inner[mark] = False
        text[inner] = np.concatenate(words)
        # a suffix ends at its next delimiter, and delimiters are in the order of the words behind them
        rank = text + len(words)
        rank[mark] = [*range(1, len(words) + 1), 0]
        span = 1
        while True:
            after = np.concatenate([rank[span:], np.zeros(min(span, len(rank)), np.int64)])[: len(rank)]
            key = rank * (int(rank.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(key), np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
            if rank[order[-1]] == len(rank) - 1:
                break
            span *= 2
        before = text[order - 1]
        self.first = np.searchsorted(np.sort(text), np.arange(alphabet + 1))
        padded = np.concatenate([before, np.full(STEP - len(before) % STEP, alphabet)]).astype(np.uint8).reshape(-1, STEP)
        blocks = np.zeros((len(padded) + 1, alphabet + 2), np.int32)
        np.add.at(blocks, (np.repeat(np.arange(1, len(padded) + 1), STEP), padded.ravel().astype(np.int64) + 1), 1)
        self.blocks = np.cumsum(np.cumsum(blocks, axis=0), axis=1)  # symbols below, in front of a block
        self.padded = padded

    def counts(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols under ``symbol``, and equal to it, in front of the first ``at`` suffixes."""
        block, rest = np.divmod(at, STEP)
        some, ahead = self.padded[block], np.arange(STEP) < rest[:, None]
        wanted = symbol.astype(np.uint8)[:, None]
        below = self.blocks[block, symbol]
        equal = self.blocks[block, symbol + 1] - below
        return below + ((some < wanted) & ahead).sum(axis=1), equal + ((some == wanted) & ahead).sum(axis=1)

    def narrow(self, symbol: np.ndarray, here: np.ndarray, there: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals with one more symbol at this index's end: begin here, begin in the other index, size."""
        low, equal = self.counts(symbol, here)
        high, more = self.counts(symbol, here + size)
        return self.first[symbol] + equal, there + high - low, more - equal

    def present(self, here: np.ndarray, size: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
        """Which interval can be narrowed by which symbols; a wide one is asked for all of them."""
        wide = np.flatnonzero(size > alphabet)
        few = np.flatnonzero(size <= alphabet)
        ends = np.cumsum(size[few])
        every = np.repeat(few, size[few])
        place = np.repeat(here[few] - ends + size[few], size[few]) + np.arange(len(every))
        key = np.concatenate([every * alphabet + self.padded.ravel()[place], np.repeat(wide * alphabet, alphabet) + np.tile(np.arange(alphabet), len(wide))])
        return np.divmod(np.unique(key), alphabet)


class States:
    """Patterns of many words: the word, its next symbol to match, and the interval in both indexes."""

    def __init__(self, word, at, left, right, size):
        self.word, self.at, self.left, self.right, self.size = word, at, left, right, size

    def where(self, keep: np.ndarray) -> States:
        return States(self.word[keep], self.at[keep], self.left[keep], self.right[keep], self.size[keep])

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("word", "at", "left", "right", "size")))


class Shard:
    """Distinct words in order, both indexes, and the search."""

    def __init__(self, words: list[str]):
        letters = np.array(sorted(set("".join(words))))
        self.alphabet = len(letters) + 1
        code = {c: i for i, c in enumerate(letters.tolist(), 1)}
        self.codes = [np.array([code[c] for c in w], np.int64) for w in words]
        self.size = np.array([len(w) for w in words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.codes)
        self.forward = Index(self.codes, self.alphabet)
        self.backward = Index([np.array([code[c] for c in w], np.int64) for w in sorted(w[::-1] for w in words)], self.alphabet)

    def letter(self, states: States, at: np.ndarray) -> np.ndarray:
        return self.flat[self.begin[states.word] + at]

    def to_left(self, states: States, symbol: np.ndarray, step: int) -> States:
        left, right, size = self.forward.narrow(symbol, states.left, states.right, states.size)
        return States(states.word, states.at + step, left, right, size).where(size > 0)

    def to_right(self, states: States, symbol: np.ndarray, step: int) -> States:
        right, left, size = self.backward.narrow(symbol, states.right, states.left, states.size)
        return States(states.word, states.at + step, left, right, size).where(size > 0)

    def others(self, states: States, but: np.ndarray, right: bool) -> tuple[States, np.ndarray]:
        """Each state with each letter that may follow it on one side, except ``but``."""
        index, here = (self.backward, states.right) if right else (self.forward, states.left)
        every, symbol = index.present(here, states.size, self.alphabet)
        keep = (symbol != but[every]) & (symbol > 0)
        return states.where(every[keep]), symbol[keep]

    def start(self, word: np.ndarray, at: np.ndarray) -> States:
        """The empty pattern; ``at`` is the next symbol."""
        zero = np.zeros(len(word), np.int64)
        return States(word, at, zero, zero, np.full(len(word), len(self.flat) + len(self.size) + 1))

    def ended(self, states: States, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words whose pattern is delimited at both ends, with the word that it is."""
        done = (self.to_right if right else self.to_left)(states, np.zeros(len(states.word), np.int64), 0)
        return done.word, done.left - 1

    def rightward(self, word: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words found with their first ``a`` letters as they are, an error before the last ``b``, and these as they are."""
        states = self.start(word, a - 1)
        matched = [states.where(states.at < -1)]  # none
        stop = self.size[word] - b  # by the place of a state in ``word``
        limit = np.zeros(len(self.size), np.int64)
        limit[word] = stop
        first = np.zeros(len(self.size), np.int64)
        first[word] = a
        while len(states.word):
            states = self.to_left(states, self.letter(states, states.at), -1)
            done = states.at < 0
            matched.append(self.to_left(states.where(done), np.zeros(int(done.sum()), np.int64), 0))
            states = states.where(~done)
        states = States.joined(matched)
        states.at = first[states.word]
        wrong, found = states.where(np.zeros(len(states.word), bool)), []
        while len(states.word) or len(wrong.word):
            # alone in its interval a word has no neighbour there
            states = states.where((states.size > 1) & ((states.at < limit[states.word]) | (limit[states.word] == self.size[states.word])))
            open_ = states.where(states.at < limit[states.word])
            at_end = states.where(states.at >= limit[states.word])
            other, symbol = self.others(open_, self.letter(open_, open_.at), True)
            new = [self.to_right(other, symbol, 1), self.to_right(other, symbol, 0)]
            other, symbol = self.others(at_end, np.zeros(len(at_end.word), np.int64), True)
            new.append(self.to_right(other, symbol, 0))
            states = self.to_right(open_, self.letter(open_, open_.at), 1)
            wrong = States.joined([wrong, *new])
            done = wrong.at >= self.size[wrong.word]
            found.append(self.ended(wrong.where(done), True))
            wrong = wrong.where(~done)
            wrong = self.to_right(wrong, self.letter(wrong, wrong.at), 1)
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (word[:0], word[:0])

    def leftward(self, word: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words found with their last ``b`` letters as they are and an error before them."""
        stop = np.zeros(len(self.size), np.int64)
        stop[word] = self.size[word] - b
        states = self.start(word, self.size[word] - 1)
        states = self.to_left(states, np.zeros(len(word), np.int64), 0)
        matched = [states.where(states.at < -1)]  # none
        while len(states.word):
            done = states.at < stop[states.word]
            matched.append(states.where(done))
            states = states.where(~done)
            states = self.to_left(states, self.letter(states, states.at), -1)
        states = States.joined(matched)
        wrong, found = states.where(np.zeros(len(states.word), bool)), []
        while len(states.word) or len(wrong.word):
            states = states.where((states.size > 1) & (states.at >= 0))
            letter = self.letter(states, states.at)
            other, symbol = self.others(states, letter, False)
            new = [self.to_left(other, symbol, -1)]
            states = self.to_left(states, letter, -1)
            other, symbol = self.others(states, self.letter(states, states.at + 1), False)
            new.append(self.to_left(other, symbol, 0))
            wrong = States.joined([wrong, *new])
            done = wrong.at < 0
            found.append(self.ended(wrong.where(done), False))
            wrong = wrong.where(~done)
            wrong = self.to_left(wrong, self.letter(wrong, wrong.at), -1)
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (word[:0], word[:0])


_REGIONS = "array<struct<length:int,a:int,b:int>>"
_NEAR = "word string, n_near long, best_n long, best string"


def _near_in_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Near words that a shard finds: of each word their number, and the most frequent, the first of equals."""
    words = sorted(set(rows["word"]))
    place = {w: i for i, w in enumerate(words)}
    uses = np.zeros(len(words), np.int64)
    own = rows["word"].map(place).to_numpy()
    uses[own] = rows["n"]
    shard = Shard(words)
    asks = rows["length"].to_numpy() == shard.size[own]
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    met = []
    # a word asks once for each region of its letters, so regions of one word go in turns
    turn = rows.assign(own=own, asks=asks, side=a > 0).groupby(["own", "asks", "side"]).cumcount().to_numpy()
    for k in range(int(turn.max()) + 1):
        right, left = asks & (turn == k) & (a > 0), asks & (turn == k) & (a == 0)
        met += [shard.rightward(own[right], a[right], b[right]), shard.leftward(own[left], b[left])]
    asking, found = (np.concatenate(x).astype(np.int64) for x in zip(*met, strict=True))
    longer = shard.size[found] > shard.size[asking]  # the longer one does not ask itself
    of, near = np.concatenate([asking, found[longer]]), np.concatenate([found, asking[longer]])
    order = np.lexsort((near, -uses[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    names = np.array(words, object)
    return pd.DataFrame({"word": names[of[first]], "n_near": np.diff(np.concatenate([first, [len(of)]])), "best_n": uses[near[first]], "best": names[near[first]]})


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words that are long and frequent enough."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), 0)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    size = F.length("run")
    at = F.pmod(h, size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    word = F.when(F.pmod(h, F.lit(LOST)) == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_USES)


def _region(length: Column, a: Column, b: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def _routes(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, n, length, a, b, key``: the regions in which words may differ; ``key`` is the rest of the word, by which words meet."""
    halves = []
    for less in (0, 1):
        length = F.length("word") - less
        half = F.floor(length / 2)
        both = F.array(_region(length, half, F.lit(0)), _region(length, F.lit(0), length - half))
        halves.append(F.when(length >= LEAST_LENGTH, both).otherwise(F.array().cast(_REGIONS)) if less else both)
    rows = words.select("word", "n", F.inline(F.concat(*halves)))
    key = F.xxhash64("length", "a", F.substring("word", F.lit(1), F.col("a")), "b", F.when(F.col("b") > 0, F.substring(F.col("word"), -F.col("b"), F.col("b"))).otherwise(""))
    done = None
    while True:
        rows = scratch.write(rows.withColumn("key", key), "routes")
        full = scratch.write(rows.groupBy("key", "length", "a", "b").agg(F.count(F.lit(1)).alias("rows")).where((F.col("rows") > GROUP) & (F.col("length") - F.col("a") - F.col("b") > 1)).select("key"), "full")
        if full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rows = dealt_join(rows, full.withColumn("full", F.lit(True)), ["key"], "word", "left")
        kept = rows.where("full is null").drop("full")
        done = kept if done is None else done.unionByName(kept)
        left = F.col("length") - F.col("a") - F.col("b")
        front = F.floor(left / 2)
        split = F.array(_region(F.col("length"), F.col("a") + front, F.col("b")), _region(F.col("length"), F.col("a"), F.col("b") + left - front))
        rows = rows.where("full").select("word", "n", F.inline(split))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``docs`` (``doc_id``, ``text``).

    Words are the runs of letters, A-Z in lower case, of at least LEAST_LENGTH
    letters and LEAST_USES uses; of a run whose hash with its document's id LOST
    divides, one letter is lost first. The form is the most frequent word one
    edit away, if it has RATIO times the uses; the root is the last of a chain of
    forms. Null and empty texts have no words; a null id counts as an empty one;
    repeated rows count as often as they come; other columns are ignored; no
    rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(vocabulary(docs), "words")
    routes = _routes(words, scratch)
    letters = routes.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    shard = F.pmod("key", F.lit(max(1, -(-letters // SHARD))))
    near = routes.withColumn("shard", shard).groupBy("shard").applyInPandas(_near_in_shard, _NEAR)
    # ties go to the first word in code-point order
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top"))
    joined = words.join(best, "word", "left")
    formed = -F.col("top.minus") >= RATIO * F.col("n")
    found = scratch.write(
        joined.select("word", F.when(formed, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, -F.col("top.minus")).alias("form_n")),
        "forms",
    )
    # a form has RATIO times the uses, so a chain is no longer than the logarithm of the most
    most = found.agg(F.max("form_n")).first()[0] or LEAST_USES
    chains = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log(most / LEAST_USES, RATIO))).bit_length()):
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chains = scratch.write(chains.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "chains")
    return found.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The hash by its rule, one step a byte; near words share what is left when each loses one letter in the same place, or one is the other with one letter lost.
ORACLE = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{6,}')) AS run FROM documents
),
u AS (SELECT run, hex(encode(concat(doc_id, ':', run))) AS x, count(*) AS k FROM r GROUP BY ALL),
steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS s
),
h AS (
  SELECT run, k, xor(list_reduce(
    list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM u, steps
),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, (h % len(run))::INT), substr(run, (h % len(run))::INT + 2)) ELSE run END AS word, k FROM h
),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE len(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, p, concat(substr(word, 1, p), substr(word, p + 2)) AS cut FROM (SELECT word, n, unnest(range(len(word)))::INT AS p FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN d b ON a.word = b.cut
  UNION SELECT b.word, a.word, a.n FROM v a JOIN d b ON a.word = b.cut
),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, (list(other ORDER BY m DESC, encode(other)))[1] AS other FROM near GROUP BY word),
f AS (
  SELECT v.word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN m END::BIGINT AS form_n
  FROM v LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root, 0 AS depth FROM f
  UNION ALL SELECT chain.word, f.form, depth + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, (SELECT arg_max(root, depth) FROM chain WHERE chain.word = f.word) AS root, n, n_near, form_n FROM f
"""
