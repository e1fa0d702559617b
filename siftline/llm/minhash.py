"""MinHash near-duplicates by a join of inverted signature coordinates.

Equal shingle sets are one class. Each class has a signature of ``M`` minima;
its tokens are the pairs of coordinate and value. Two classes whose sets are
similar enough share at least T tokens, but for a chance below ``MISS``, so

* prefix: of its tokens, ordered from rare to frequent, a class is posted only
  under the first M - T + 1; tokens nobody shares need no posting;
* skip: tokens behind the prefix are not merged but counted in the signature
  when a pair has met.

Long posting lists are not expanded into pairs. In a turn every long list that
spans components elects HUBS hubs, by hashes of the class alone, so that all lists
of a group of near copies elect the same few; the other classes of the list meet
it, and labels that a link joins become one. Turns go on
while they find links and some long list has several labels. What spans labels is
done in full: short lists pair by
pair, of long ones the classes outside the largest label meet all others, in blocks, each pair in the first token only that both are posted under. A bound on
the symmetric difference (the parity of hashed
shingles) drops pairs that cannot link without loss; what is left is confirmed
on the full sets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import WORD, Scratch, dealt_join, materialize
from siftline.llm.components import connected
from siftline.llm.tokens import Words, parcels, words_of

M = 32
#: Chance that a pair right at the threshold shares fewer than T coordinates.
MISS = 1e-7
PARITY_WORDS = 16
#: Lists with more classes elect hubs; at the end they are met in blocks of BLOCK classes.
LONG = 64
BLOCK = 256
#: Classes of a long list that the others meet in a turn.
HUBS = 3
#: Turns of hubs, and the share of the best turn's links below which no other follows; both are only a matter of pace, as
#: the comparison in full is exact by itself.
TURNS = 3
WORTH = 0.125
#: Parts of the pairs of one hub, and postings of one list that are met together.
PARTS = 16
PART_ROWS = 4096
#: Pairs that are compared at once.
SLICE = 16_384

_seeds = random.Random(20)
_A = np.array([_seeds.getrandbits(64) | 1 for _ in range(M)], np.uint64)
_MUL = np.array([_seeds.getrandbits(64) | 1 for _ in range(64)], np.uint64)
_ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("class", pa.binary()),
        ("tokens", pa.list_(pa.int64())),
        ("parity", pa.list_(pa.int64())),
    ]
)
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def match_threshold(similarity: float, m: int = M, miss: float = MISS) -> int:
    """Largest T such that fewer than T of ``m`` coordinates agree with a chance of at most ``miss``."""
    below = 0.0
    for t in range(m + 1):
        below += comb(m, t) * similarity**t * (1 - similarity) ** (m - t)
        if below > miss:
            return max(t, 1)
    return m


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of ``k``-word shingles, or of all its words if they are fewer."""
    n = len(words.hashes)
    total = np.full(max(n - k + 1, 0), k, np.uint64)
    for i in range(k if len(total) else 0):
        total += words.hashes[i : n - k + 1 + i] * _MUL[i]
    total = _mix(total)
    out = []
    for begin, end in zip(words.word_of[:-1].tolist(), words.word_of[1:].tolist(), strict=True):
        if end - begin >= k:
            one = np.sort(total[begin : end - k + 1])
            out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        else:
            few = words.hashes[begin:end]
            out.append(_mix(np.array([len(few) + int((few * _MUL[: len(few)]).sum(dtype=np.uint64))], np.uint64)) if len(few) else few)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Tokens of each set, none of them empty: the minimum at each coordinate, mixed with the coordinate."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    whole = np.concatenate(sets)
    out = np.empty((len(sets), M), np.uint64)
    for i in range(M):
        out[:, i] = np.minimum.reduceat(whole * _A[i], starts)
    return _mix(out + np.arange(M, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set and each of 64 * PARITY_WORDS slots whether an odd number of members falls into it, as bits."""
    slots = 64 * PARITY_WORDS
    out = np.empty((len(sets), slots // 8), np.uint8)
    for i, one in enumerate(sets):
        out[i] = np.packbits((np.bincount((one % np.uint64(slots)).astype(np.int64), minlength=slots) & 1).astype(np.uint8))
    return out.view(np.uint64)


def _lists(rows: np.ndarray, given: np.ndarray) -> pa.Array:
    """One list of 64-bit numbers for each text; those that are not ``given`` are empty."""
    offsets = np.concatenate([[0], np.cumsum(given * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int64)))


def _documents(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for begin, texts in parcels(batch.column("text").to_pylist()):
                sets = shingle_sets(words_of(texts), k)
                full = [s for s in sets if len(s)]
                given = np.array([len(s) > 0 for s in sets])
                tokens = signatures(full) if full else np.zeros((0, M), np.uint64)
                parity = parities(full) if full else np.zeros((0, PARITY_WORDS), np.uint64)
                columns = [
                    ids.slice(begin, len(texts)),
                    hashes.slice(begin, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _lists(tokens, given),
                    _lists(parity, given),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)

    return rows


def _members(k: int):
    """The full set of each wanted text; a text whose set is not of the class is another one with the same hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nids, classes = batch.column("nid").to_numpy(), batch.column("class").to_pylist()
            for begin, texts in parcels(batch.column("text").to_pylist()):
                found = list(enumerate(shingle_sets(words_of(texts), k), begin))
                found = [(i, s) for i, s in found if xxhash.xxh3_128_digest(s.tobytes()) == classes[i]]
                if found:
                    offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in found])]).astype(np.int32)
                    members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([s for _, s in found]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(nids[[i for i, _ in found]]), members], names=["nid", "members"])

    return rows


def _may_link(left: str, right: str, percent: int, least: int) -> Column:
    """The lossless bound and the count of shared coordinates, for columns under two prefixes."""
    size = F.col(f"{left}.n_shingles") + F.col(f"{right}.n_shingles")
    odd = F.aggregate(
        F.zip_with(f"{left}.parity", f"{right}.parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    gap = F.abs(F.col(f"{left}.n_shingles") - F.col(f"{right}.n_shingles"))
    same = F.size(F.filter(F.zip_with(f"{left}.tokens", f"{right}.tokens", lambda x, y: x == y), lambda x: x))
    bound = (100 - percent) * size
    return ((100 + percent) * gap <= bound) & ((100 + percent) * odd <= bound) & (same >= least)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _compared(rows: pa.RecordBatch | pa.Table, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Candidates among ``rows``, which come sorted by token, part and side, every (token, part) whole.

    In a part that is ``alone`` all rows meet, in others those of one side meet those of the other.
    """
    column = {n: rows.column(n).combine_chunks() for n in rows.schema.names} if isinstance(rows, pa.Table) else {n: rows.column(n) for n in rows.schema.names}
    plain = {n: column[n].to_numpy(zero_copy_only=False) for n in ("token", "part", "side", "alone", "nid", "comp", "n_shingles", "posted")}
    tokens, parity = _matrix(column["tokens"], M), _matrix(column["parity"], PARITY_WORDS).view(np.uint64)
    token, size, comp = plain["token"], plain["n_shingles"], plain["comp"]
    place = np.arange(len(token))
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (plain["part"][1:] != plain["part"][:-1])])
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    ends = np.append(starts[1:], len(token))[group]
    # where the other side of the group begins
    other = np.add.reduceat((plain["side"] == 0).astype(np.int64), starts)[group] + starts[group]
    first = np.where(plain["alone"], place + 1, other)
    count = np.where(plain["alone"] | (plain["side"] == 0), ends - first, 0)
    upto = np.cumsum(count)
    bits = np.int64(1) << np.arange(M, dtype=np.int64)
    for low in range(0, int(upto[-1]), SLICE):
        pair = np.arange(low, min(low + SLICE, int(upto[-1])))
        i = np.searchsorted(upto, pair, side="right")
        j = first[i] + pair - (upto[i] - count[i])
        bound = (100 - percent) * (size[i] + size[j])
        ok = ((100 + percent) * np.abs(size[i] - size[j]) <= bound) & (comp[i] != comp[j])
        i, j, bound = i[ok], j[ok], bound[ok]
        ok = (100 + percent) * np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64) <= bound
        i, j = i[ok], j[ok]
        same = tokens[i] == tokens[j]
        both = same & ((plain["posted"][i] & plain["posted"][j])[:, None] & bits != 0)
        ok = (same.sum(axis=1) >= least) & both.any(axis=1)
        ok &= tokens[i, both.argmax(axis=1)] == token[i]
        left, right = plain["nid"][i[ok]], plain["nid"][j[ok]]
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], schema=_PAIRS)


def _block_pairs(percent: int, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            whole = whole if rest is None else pa.concat_tables([rest, whole]).combine_chunks()
            token, part = whole.column("token").to_numpy(), whole.column("part").to_numpy()
            changes = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) if len(token) else []
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield from _compared(whole.slice(0, cut), percent, least)
            rest = whole.slice(cut).combine_chunks()
        if rest is not None and len(rest):
            yield from _compared(rest, percent, least)

    return rows


def _confirmed(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Pairs (``a``, ``b``) whose full sets link; those of one ``a`` are dealt over ``parts`` tasks."""
    others = sets.select(F.col("nid").alias("b"), F.col("members").alias("y"))
    hubs = pairs.select("a").distinct().join(sets, F.col("a") == F.col("nid")).select("a", F.col("members").alias("x"))
    hubs = hubs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")).join(others, "b").join(hubs, ["a", "part"])
    shared = F.size(F.array_intersect("x", "y"))
    return met.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("sum"))


def _linked(met: DataFrame, percent: int) -> DataFrame:
    return met.where((100 + percent) * F.col("shared") >= percent * F.col("sum")).select("a", "b")


def _labelled(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``postings`` with the component of each class, which is the class itself where nothing links it."""
    if roots is None:
        return postings.withColumn("comp", F.col("nid"))
    return postings.join(roots.select(F.col("node").alias("nid"), "root"), "nid", "left").withColumn("comp", F.coalesce("root", "nid")).drop("root")


def _merged(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``node, root`` after a turn: of two labels that a link joins, the larger becomes the smallest it is joined with.

    Equal labels mean one component, different ones may; that is settled once, by
    :func:`connected` over the links of all turns.
    """
    own = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if labels is None:
        labels = own.withColumn("root", F.col("node"))
    else:
        labels = labels.unionByName(own.join(labels, "node", "left_anti").withColumn("root", F.col("node")))
    left, right = labels.select(F.col("node").alias("a"), F.col("root").alias("x")), labels.select(F.col("node").alias("b"), F.col("root").alias("y"))
    joined = links.join(right, "b").join(left, "a").where("x <> y")
    lower = joined.groupBy(F.greatest("x", "y").alias("root")).agg(F.min(F.least("x", "y")).alias("low"))
    return dealt_join(labels, lower, ["root"], "node", "left").select("node", F.coalesce("low", "root").alias("root"))


def _spread(labelled: DataFrame, posted: DataFrame) -> DataFrame:
    """Postings of the lists that span components, once for each block or pair of blocks they take part in."""
    spans = (
        labelled.groupBy("token", "comp")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("top"))
        .where("comps > 1")
        .select(
            "token",
            (F.col("size") <= LONG).alias("short"),
            F.col("top.comp").alias("main"),
            F.greatest(F.ceil(F.col("top.n") / BLOCK), F.lit(1)).alias("main_blocks"),
            F.greatest(F.ceil((F.col("size") - F.col("top.n")) / BLOCK), F.lit(1)).alias("out_blocks"),
        )
    )
    met = labelled.join(spans, "token").withColumn("outside", F.col("comp") != F.col("main"))
    met = met.withColumn("block", F.pmod(F.xxhash64("nid", "token"), F.when(F.col("outside"), F.col("out_blocks")).otherwise(F.col("main_blocks"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)

    def at(kind: int, i: Column, j: Column, side: Column, alone: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), i, j).alias("part"), side.cast("int").alias("side"), alone.alias("alone"))

    zero, block, no = F.lit(0).cast("long"), F.col("block"), F.lit(False)
    whole = F.array(at(2, zero, zero, zero, F.lit(True)))
    # a class outside meets every block of the main component; of two outside blocks the pair is (low, high)
    main = F.transform(upto(F.col("out_blocks")), lambda i: at(0, i, block, F.lit(1), no))
    with_main = F.transform(upto(F.col("main_blocks")), lambda j: at(0, block, j, F.lit(0), no))
    with_out = F.transform(upto(F.col("out_blocks")), lambda o: at(1, F.least(block, o), F.greatest(block, o), block > o, block == o))
    parts = F.when(F.col("short"), whole).when(F.col("outside"), F.concat(with_main, with_out)).otherwise(main)
    dealt = met.withColumn("at", F.explode(parts)).select("token", "nid", "comp", "at.*")
    return dealt.join(posted.select("nid", "n_shingles", "posted", "tokens", "parity"), "nid")


def _grouped(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and the classes with the root of their component."""
    least = match_threshold(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, n_shingles long, class binary, tokens array<bigint>, parity array<bigint>"
    rows = scratch.write(texts.mapInArrow(_documents(k), schema), "rows")
    classes = scratch.write(
        rows.where("class is not null")
        .groupBy("class")
        .agg(
            F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("first"),
            *[F.any_value(c).alias(c) for c in ("n_shingles", "tokens", "parity")],
        )
        .select("class", "first.doc_id", "first.text_hash", "n_shingles", "tokens", "parity")
        .withColumn("nid", F.monotonically_increasing_id()),
        "classes",
    )
    tokens = classes.select("nid", F.posexplode("tokens").alias("place", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    prefixes = scratch.write(
        tokens.join(shared, "token")
        .groupBy("nid")
        .agg(F.sort_array(F.collect_list(F.struct("uses", "token", "place"))).alias("own"))
        .where(F.size("own") >= least)
        .select("nid", F.slice("own", F.lit(1), F.size("own") - least + 1).alias("own")),
        "prefixes",
    )
    mask = F.aggregate("own", F.lit(0).cast("long"), lambda m, o: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), o["place"])))
    posted = scratch.write(classes.join(prefixes.select("nid", mask.alias("posted")), "nid"), "posted")
    postings = prefixes.select("nid", F.explode("own.token").alias("token"))
    wanted = posted.select("nid", "class", F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))
    sets = scratch.write(
        texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")))
        .select("nid", "class", "text")
        .mapInArrow(_members(k), "nid long, members array<bigint>")
        .dropDuplicates(["nid"]),
        "sets",
    )
    long = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG)
    long = scratch.write(postings.join(long, "token").select("token", F.ceil(F.col("n") / PART_ROWS).alias("parts"), "nid"), "long")
    found, labels, most, x, y = None, None, 0, posted.alias("x"), posted.alias("y")
    for turn in range(TURNS):
        met = scratch.write(_labelled(long, labels), "met")
        hubs = met.groupBy("token", "parts").agg(
            F.array_distinct(F.array(*[F.min_by(F.struct("nid", "comp"), F.xxhash64("nid", F.lit(turn * HUBS + h))) for h in range(HUBS)])).alias("hubs"),
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
        )
        hubs = hubs.where("low <> high").select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "hubs")
        pairs = met.withColumn("part", F.pmod(F.xxhash64("nid"), "parts")).join(hubs, ["token", "part"])
        other = F.transform(F.filter("hubs", lambda h: h["comp"] != F.col("comp")), lambda h: h["nid"])
        # the lists of a class name the same few hubs, so they are put together before they become pairs
        pairs = pairs.select("nid", other.alias("hubs")).where(F.size("hubs") > 0).groupBy("nid").agg(F.collect_set("hubs").alias("hubs"))
        pairs = scratch.write(pairs.select(F.explode(F.array_distinct(F.flatten("hubs"))).alias("a"), F.col("nid").alias("b")), "pairs")
        ends = pairs.select("a").distinct().join(x, F.col("a") == F.col("x.nid")).select(F.col("a").alias("nid"), "n_shingles", "tokens", "parity")
        ends = ends.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).alias("x")
        dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")).alias("p")
        hopeful = dealt.join(y, F.col("b") == F.col("y.nid")).join(ends, (F.col("a") == F.col("x.nid")) & (F.col("p.part") == F.col("x.part")))
        hopeful = scratch.write(hopeful.where(_may_link("x", "y", percent, least)).select("a", "b"), "hopeful")
        links = scratch.write(_linked(_confirmed(hopeful, sets, PARTS), percent), "links")
        most = max(most, n_links := links.count())
        if not n_links:
            break
        found = links if found is None else found.unionByName(links)
        labels = scratch.write(_merged(links, labels), "labels")
        if n_links < WORTH * most:
            break
    spread = _spread(scratch.write(_labelled(postings, labels), "labelled"), posted)
    names = ["token", "part", "side"]
    again = spread.repartition("token", "part").sortWithinPartitions(*names).mapInArrow(_block_pairs(percent, least), "a long, b long").distinct()
    links = scratch.write(_linked(_confirmed(scratch.write(again, "rest"), sets, 1), percent), "links")
    roots = connected(links if found is None else links.unionByName(found), scratch)

    groups = classes.select("class", "doc_id", "text_hash", "nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
    return rows, scratch.write(groups.select("class", "doc_id", "text_hash", F.coalesce("root", "nid").alias("root")), "groups")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``).

    Words are lower-cased (A-Z) and parted by ASCII white space; a set holds the
    distinct ``k``-word shingles of the whole text, or the whole sequence if it has
    fewer words. Sets link if 100 times their intersection is at least ``percent``
    times their union. ``component_id`` is the smallest id reachable by links.
    Texts that are null or without words have an empty set and link with nothing;
    equal texts always link; rows with null id can link but never name a
    component unless all its ids are null; no rows give no rows; other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, groups = _grouped(docs, k, percent, scratch)
    lowest = groups.groupBy("root").agg(F.min("doc_id").alias("low"))
    named = groups.join(lowest, "root").select(F.col("class").alias("named"), "low")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    result = materialize(
        rows.select("doc_id", "n_shingles", "class")
        .join(named, F.col("class") == F.col("named"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")),
        "minhash",
    )
    scratch.clear()
    return result


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`, and all rows whose text has no words.

    The row is that of the smallest id, null ids last; of texts with the same id the
    one with the smallest hash, so repeated ids don't keep copies. All columns stay.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, groups = _grouped(docs, k, percent, scratch)
    first = groups.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash")).alias("f"))
    chosen = materialize(first.select(F.col("f.doc_id").alias("id"), F.col("f.text_hash").alias("hash")), "minhash-chosen")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    repeated = rows.where("class is not null").join(chosen, same, "left_semi").count() > chosen.count()
    scratch.clear()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("some"))
    kept = packed.where("some").join(chosen, same, "left_semi")
    # only where rows are repeated, their texts have to be brought together
    kept = kept.dropDuplicates(["doc_id", "text_hash"]) if repeated else kept
    return kept.unionByName(packed.where("NOT some")).select("row.*")
