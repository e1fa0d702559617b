"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: a vector is cut into BLOCKS parts,
each part has its own random codewords, and a direction is one codeword of each
part behind each other. A vector is posted under every direction whose cap it
lies in (inner product of at least a threshold); those are listed without
trying all, by adding the two halves of the code in sorted order. Vectors whose
angle is small share caps; they are joined on them and verified in double
precision.

The number of directions grows with the number of vectors and the threshold
with it, so a vector has about CAPS caps, and a cap about CROWD vectors, at
every size. A vector in fewer than LEAST caps gets its LEAST nearest ones, and a
cap that holds many vectors is met in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialize
from siftline.llm.components import connected

BLOCKS = 4
CAPS = 40
CROWD = 4
LEAST = 12
BLOCK = 512
#: Bits of the sign sketch that drops pairs far from the threshold, and its slack in standard deviations.
SIGNS = 128
SLACK = 6.0


def codewords(size: int) -> int:
    """Codewords of each part for ``size`` vectors."""
    return max(4, int(np.ceil((max(size, 1) * CAPS / CROWD) ** (1 / BLOCKS))))


@lru_cache(maxsize=16)
def _code(dim: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codewords of each part (norm 1/2) and the directions of the sign sketch."""
    rng = np.random.default_rng(dim * 1009 + words)
    parts = []
    for part in np.array_split(np.arange(dim), BLOCKS):
        c = rng.normal(size=(words, len(part)))
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        parts.append(c / np.where(norm > 0, norm, 1) / np.sqrt(BLOCKS))
    return parts, rng.normal(size=(SIGNS, dim))


def caps_of(vector: np.ndarray, words: int) -> np.ndarray:
    """All directions in whose cap the unit ``vector`` lies, in ascending order."""
    parts, _ = _code(len(vector), words)
    tail = min(0.5, CAPS / words**BLOCKS)
    limit = NormalDist().inv_cdf(1 - tail) / np.sqrt(len(vector))
    at, products = 0, []
    for c in parts:
        products.append(c @ vector[at : at + c.shape[1]])
        at += c.shape[1]
    low = (products[0][:, None] + products[1][None, :]).ravel()
    high = (products[2][:, None] + products[3][None, :]).ravel()
    order = np.argsort(high)
    ranked = high[order]
    first = np.searchsorted(ranked, limit - low)
    if len(ranked) * len(low) - first.sum() < LEAST:
        # the largest sums are among the largest of either half
        best_low = np.argsort(low)[-LEAST:]
        sums = low[best_low][:, None] + ranked[-LEAST:][None, :]
        top = np.argsort(sums, axis=None)[-LEAST:]
        i, j = np.unravel_index(top, sums.shape)
        return np.sort(best_low[i] * len(ranked) + order[len(ranked) - sums.shape[1] + j]).astype(np.int64)
    counts = len(ranked) - first
    rows = np.repeat(np.arange(len(low)), counts)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + first[rows]
    return np.sort(rows * len(ranked) + order[places]).astype(np.int64)


def _posted(words: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cid, space, vector in zip(batch["cid"], batch["space"], batch["vector"], strict=True):
                v = np.asarray(vector, np.float64)
                v = v / np.linalg.norm(v)
                own = caps_of(v, words)
                sign = np.packbits(_code(len(v), words)[1] @ v > 0).tobytes()
                out.append((cid, space, own, sign, own.astype("<i8").tobytes()))
            yield pd.DataFrame(out, columns=["cid", "space", "caps", "sign", "all"])

    return rows


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest common value of each pair of rows; rows ascend and are filled up with the largest integer."""
    i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    row = np.arange(len(a))
    out = np.full(len(a), -1, np.int64)
    while len(row):
        x, y = a[row, i[row]], b[row, j[row]]
        same = x == y
        out[row[same]] = x[same]
        i[row[x < y]] += 1
        j[row[y < x]] += 1
        row = row[~same]
    return out


def _met(cosine: float):
    """Pairs within each (space, cap, part), each only in the smallest cap that both lie in; rows come sorted."""
    angle = np.arccos(cosine) / np.pi
    most = SIGNS * angle + SLACK * np.sqrt(SIGNS * angle * (1 - angle))

    def pairs(batch: pd.DataFrame) -> pd.DataFrame:
        key = pd.factorize(pd.MultiIndex.from_frame(batch[["space", "cap", "part"]]))[0]
        sign = np.frombuffer(b"".join(map(bytes, batch["sign"])), np.uint64).reshape(len(batch), -1)
        lists = [np.frombuffer(x, "<i8") for x in batch["all"]]
        wide = np.full((len(lists), max(map(len, lists)) + 1), np.iinfo(np.int64).max)
        for k, x in enumerate(lists):
            wide[k, : len(x)] = x
        cid, cap, block, cross = (batch[c].to_numpy() for c in ("cid", "cap", "block", "cross"))
        found = []
        alive, step = np.arange(len(key)), 0
        while len(alive):
            step += 1
            alive = alive[alive + step < len(key)]
            alive = alive[key[alive] == key[alive + step]]
            for s in range(0, len(alive), 100_000):
                i = alive[s : s + 100_000]
                j = i + step
                near = np.bitwise_count(sign[i] ^ sign[j]).sum(axis=1) <= most
                near &= ~cross[i] | (block[i] != block[j])
                i, j = i[near], j[near]
                first = _first_common(wide[i], wide[j]) == cap[i]
                found.append(np.stack([cid[i[first]], cid[j[first]]]))
        if not found:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        both = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": both.min(axis=0), "b": both.max(axis=0)})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = (batch[["space", "cap", "part"]] == batch[["space", "cap", "part"]].iloc[-1]).all(axis=1).to_numpy()
            cut = len(batch) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield pairs(batch.iloc[:cut].reset_index(drop=True))
            rest = batch.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pairs(rest)

    return rows


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Vectors link if their labels are equal and not null and their cosine in double
    precision is at least ``cosine``. ``n_links`` counts the other vectors linked
    directly, copies included; ``component_id`` is the smallest id reachable.
    Vectors that are null, zero or empty, or hold null or non-finite components,
    or have another dimension, link with nothing. Null ids take part but name no
    component unless all its ids are null; no rows give no rows; other columns
    are ignored. Equal vectors of a label are one class and meet others once.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(_dot(v, v))
    usable = F.coalesce(F.col("label").isNotNull() & finite & (norm > 0) & (norm < F.lit(float("inf"))), F.lit(False))
    rows = vectors.select("vec_id", F.when(usable, F.concat_ws(":", F.col("label").cast("string"), F.size(v))).alias("space"), v.alias("vector"))
    rows = rows.withColumn("key", F.when(F.col("space").isNotNull(), F.sha2(F.concat_ws(",", "space", F.col("vector").cast("array<string>")), 256)))
    rows = materialize(rows, "caps-rows")
    classes = materialize(
        rows.where("space is not null")
        .groupBy("key", "space")
        .agg(F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
        .withColumn("norm", F.sqrt(_dot(F.col("vector"), F.col("vector"))))
        .withColumn("cid", F.monotonically_increasing_id()),
        "caps-classes",
    )
    most = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    posted = (
        classes.select("cid", "space", "vector")
        .mapInPandas(_posted(codewords(most)), "cid long, space string, caps array<bigint>, sign binary, all binary")
        .select("cid", "space", "sign", "all", F.explode("caps").alias("cap"))
    )
    posted = materialize(posted, "caps-postings")
    crowds = posted.groupBy("space", "cap").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    met = posted.join(crowds, ["space", "cap"]).withColumn("block", F.pmod(F.xxhash64("cid", "cap"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    spread = met.withColumn("at", F.explode(others)).select(
        "space", "cap", F.concat_ws(":", "at.i", "at.j").alias("part"), (F.col("at.i") != F.col("at.j")).alias("cross"), "block", "cid", "sign", "all"
    )
    pairs = materialize(
        spread.repartition("space", "cap", "part").sortWithinPartitions("space", "cap", "part").mapInPandas(_met(cosine), "a long, b long"), "caps-pairs"
    )
    a = classes.select(F.col("cid").alias("a"), F.col("vector").alias("x"), F.col("norm").alias("nx"), F.col("n").alias("na"))
    b = classes.select(F.col("cid").alias("b"), F.col("vector").alias("y"), F.col("norm").alias("ny"), F.col("n").alias("nb"))
    links = pairs.join(a, "a").join(b, "b").where(_dot(F.col("x"), F.col("y")) / (F.col("nx") * F.col("ny")) >= cosine)
    links = materialize(links.select("a", "b", "na", "nb"), "caps-links")
    degrees = (
        links.select(F.col("a").alias("cid"), F.col("nb").alias("n"))
        .unionByName(links.select(F.col("b").alias("cid"), F.col("na").alias("n")))
        .groupBy("cid")
        .agg(F.sum("n").alias("others"))
    )
    roots = connected(links.select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.select("key", "cid", "n", "low").join(degrees, "cid", "left").join(roots, "cid", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "cid")), "caps-named")
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lows, "root").select(F.col("key").alias("named"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component")
    component = F.when(F.col("space").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return (
        rows.select("vec_id", "space", "key")
        .join(named, F.col("key") == F.col("named"), "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""
