"""Line dedup by a fixed-depth log-template tree.

A line goes to the leaf given by its number of tokens and its first tokens.
Tokens with digits or ``@`` are variable fields from the start. Where variants of
a leaf agree in most of their other tokens, the places that differ are variable
too and the variants are one template. A leaf may have many templates: its
variants are grouped by what they have in a few places, for several choices of
places, so other lines of the leaf do not dilute a group. Templates that recur
across documents are boilerplate and their lines go.

A line is judged by its texts, in a second reading, when it is known how often
each line comes. Two texts are alike if as a whole they are as like as near
copies, in the measure of near-duplicate removal (five-word shingles, 0.8), or if
what they have besides is alike: three eighths of the three-word shingles of the
lines that come less than half as often as the line in question. Recurrence is the
number of texts no two of which are alike. So a group of near copies, of any
size, counts as one, and its lines are left to near-duplicate removal; unrelated
texts count one each, be it that one line makes up most of them, or a block of
lines that comes as often.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import dealt_join, materialize
from siftline.llm.tokens import Words, mix, parcels, words_of

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Tokens behind them are folded into so many one-byte slots by place.
SLOTS = 16
MIN_TOKENS = 3
#: Choices of PLACES slots by which the variants of a leaf are grouped; a template with constants in seven of ten slots
#: is missed by all of them with a chance of about 0.4 %, and the leaf as a whole is one more group.
CHOICES = 13
PLACES = 3
#: One-byte hashes of what a text has besides a line, and how many of them alike texts share.
SKETCHES = 32
ALIKE_BESIDES = 12
#: Bins of the shingles of a whole text, two bits each, and the Jaccard coefficient of alike texts.
BINS = 128
ALIKE_WHOLE = 0.8
#: Sketches that are compared together; a line with more is compared in parts first.
TOGETHER = 2048

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def masked_lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line over all texts: number of its tokens and, from ``MIN_TOKENS`` tokens on, a hash with its fields masked, else 0.

    Also the place of each token in its line.
    """
    sizes = np.bincount(words.line, minlength=int(words.line_of[-1]))
    lines = np.flatnonzero(sizes)
    starts = np.cumsum(sizes[lines]) - sizes[lines]
    place = np.arange(len(words.hashes)) - np.repeat(starts, sizes[lines])
    out = np.zeros(len(sizes), np.uint64)
    if len(lines):
        summed = np.add.reduceat(mix(words.hashes + place.astype(np.uint64) * _M1), starts)
        out[lines] = np.where(sizes[lines] >= MIN_TOKENS, mix(summed + sizes[lines].astype(np.uint64) * _M3) | np.uint64(1), np.uint64(0))
    return sizes, out, place


def leaves(words: Words, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each line with tokens, and the slots of its tokens behind the leading ones."""
    used = sizes[sizes > 0]
    row = np.repeat(np.arange(len(used)), used)
    head, behind = place < DEPTH, place >= DEPTH
    leaf = used.astype(np.uint64) * _M1
    np.add.at(leaf, row[head], mix(words.hashes[head] + place[head].astype(np.uint64) * _M3))
    cell = row[behind] * SLOTS + (place[behind] - DEPTH) % SLOTS
    folded = np.bincount(cell, (mix(words.hashes[behind] + place[behind].astype(np.uint64) * _M2) >> np.uint64(40)).astype(np.float64), len(used) * SLOTS)
    return mix(leaf), (folded % 251).astype(np.uint8).reshape(-1, SLOTS)


def whole_sketch(words: Words) -> np.ndarray:
    """BINS codes of two bits for each text: nothing (0), or 1 to 3 by the smallest hash of the five-word shingles in the bin."""
    n = np.diff(words.word_of)
    size = np.where(n >= 5, n - 4, np.minimum(n, 1))  # fewer words are one shingle
    text = np.repeat(np.arange(len(n)), size)
    at = np.repeat(words.word_of[:-1] - np.cumsum(size) + size, size) + np.arange(len(text))
    hashed = np.append(words.plain, np.zeros(4, np.uint64))
    shingle = np.zeros(len(text), np.uint64)
    for k in range(5):
        inside = at + k < words.word_of[1:][text]
        shingle = mix(shingle + np.where(inside, hashed[at + k], np.uint64(0)) * _M1 + np.uint64(k))
    out = np.zeros(len(n) * BINS, np.uint8)
    cell = text * BINS + (shingle % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((shingle, cell))
    first = order[np.flatnonzero(np.diff(cell[order], prepend=-1))]
    out[cell[first]] = 1 + (mix(shingle[first]) % np.uint64(3)).astype(np.uint8)
    codes = out.reshape(len(n), BINS // 4, 4)
    return codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6


def likeness(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated Jaccard coefficient of a text with others, from their codes; a third of what differs agrees by chance."""
    both = ((one > 0) & (others > 0)).sum(axis=1)
    some = ((one > 0) | (others > 0)).sum(axis=1)
    same = ((one == others) & (one > 0)).sum(axis=1)
    return (3 * same - both) / 2 / np.maximum(some, 1)


def besides(words: Words, sizes: np.ndarray, text: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Sketch of what the text of each line with tokens has besides it: of its lines that come less than half as often.

    ``often`` is the binary logarithm of the documents that have a line, -1 for those of no
    interest. A line of fewer than three words is one shingle; no shingle reaches over
    two lines. Nothing besides is a sketch of zeros.
    """
    used = sizes[sizes > 0]
    starts = np.cumsum(used) - used
    row = np.repeat(np.arange(len(used)), used)
    hashed = np.append(words.hashes, np.zeros(2, np.uint64))
    shingle = mix(hashed[:-2] * _M1 + hashed[1:-1] * _M2 + hashed[2:] * _M3)
    short = np.flatnonzero(used < 3)
    pair = hashed[starts[short]] * _M1 + np.where(used[short] == 2, hashed[starts[short] + 1], np.uint64(0)) * _M2
    shingle[starts[short]] = mix(pair + used[short].astype(np.uint64))
    valid = np.concatenate([row[2:] == row[:-2], np.zeros(min(2, len(row)), bool)])
    valid[starts[short]] = True
    shingle = shingle[valid]
    per_line = np.maximum(used - 2, 1)
    line_starts = np.cumsum(per_line) - per_line
    order = np.lexsort((often, text))
    # the lines of a text that come before those at least half as often
    level = text * 64 + often + 1
    wanted = np.flatnonzero(often >= 0)
    upto = np.searchsorted(level[order], text[wanted] * 64 + often[wanted] - 1, side="right") - 1
    some = (upto >= 0) & (text[order][np.maximum(upto, 0)] == text[wanted])
    out = np.zeros((len(wanted), SKETCHES), np.uint8)
    # texts come in order, so minima of a later text are below all before it and one scan serves all of them
    later = (np.uint64(len(text)) - text[order].astype(np.uint64)) << np.uint64(40)
    for k in range(SKETCHES):
        factor = mix(np.array([k + 1], np.uint64) * _M2) | np.uint64(1)
        lowest = np.minimum.reduceat(shingle * factor >> np.uint64(24), line_starts)[order]
        running = np.minimum.accumulate(lowest | later)
        out[some, k] = (mix(running[upto[some]] & np.uint64((1 << 40) - 1)) >> np.uint64(56)).astype(np.uint8) | np.uint8(1)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _line_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each distinct masked line of a document: leaf, variant, slots and number of tokens."""
    for batch in batches:
        for _, texts in parcels(batch["text"].tolist()):
            words = words_of(texts, mask_fields=True)
            if not len(words.hashes):
                continue
            sizes, variant, place = masked_lines(words)
            leaf, slots = leaves(words, sizes, place)
            text = np.searchsorted(words.line_of, np.flatnonzero(sizes), side="right") - 1
            variant, sizes = variant[sizes > 0], sizes[sizes > 0]
            order = np.lexsort((variant, text))
            new = np.concatenate([[True], (variant[order][1:] != variant[order][:-1]) | (text[order][1:] != text[order][:-1])])
            first = order[new & (variant[order] != 0)]
            yield pd.DataFrame({"leaf": _signed(leaf[first]), "variant": _signed(variant[first]), "slots": [s.tobytes() for s in slots[first]], "size": sizes[first]})


def _sketched(texts: list[str | None], often_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pd.DataFrame:
    """``variant, sketch`` of each line of interest in some texts; ``often_of`` tells of texts and variants how often they come."""
    words = words_of(texts, mask_fields=True)
    if not len(words.hashes):
        return pd.DataFrame({"variant": np.zeros(0, np.int64), "sketch": []})
    sizes, variant, _ = masked_lines(words)
    text = np.searchsorted(words.line_of, np.flatnonzero(sizes), side="right") - 1
    variant = _signed(variant[sizes > 0])
    often = np.where(variant != 0, often_of(text, variant), -1)
    wanted = np.flatnonzero(often >= 0)
    sketch = np.concatenate([besides(words, sizes, text, often), whole_sketch(words)[text[wanted]]], axis=1)
    return pd.DataFrame({"variant": variant[wanted], "sketch": [s.tobytes() for s in sketch]}).drop_duplicates()


def sketches(docs: DataFrame, interest: DataFrame, limit: int) -> DataFrame:
    """``variant, sketch`` of each line of interest (``variant``, ``often``) in each document.

    Up to ``limit`` variants go to the tasks; more are joined with the lines, and what is known of a text's lines with the text.
    """
    schema = "variant bigint, sketch binary"
    if interest.count() <= limit:
        rows = interest.toArrow()  # numbers, not a Python object for each
        known, level = rows["variant"].to_numpy(), rows["often"].to_numpy().astype(np.int8)
        known, level = np.sort(known), level[np.argsort(known)]

        def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def often_of(_: np.ndarray, variant: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(known, variant), len(known) - 1)
                return np.where(known[at] == variant, level[at], -1).astype(np.int64) if len(known) else np.full(len(variant), -1)

            for batch in batches:
                for _, texts in parcels(batch["text"].tolist()):
                    yield _sketched(texts, often_of)

        return docs.select("text").mapInPandas(told, schema)

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, texts in parcels(batch["text"].tolist()):
                words = words_of(texts, mask_fields=True)
                variant = _signed(masked_lines(words)[1])
                text = np.repeat(np.arange(len(texts)), np.diff(words.line_of))
                yield pd.DataFrame({"hash": batch["hash"].array[begin + text], "variant": variant}).drop_duplicates()

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, texts in parcels(batch["text"].tolist()):
                given = [{r["variant"]: r["often"] for r in told} for told in batch["told"].iloc[begin : begin + len(texts)]]
                yield _sketched(texts, lambda text, variant, given=given: np.array([given[t].get(v, -1) for t, v in zip(text.tolist(), variant.tolist(), strict=True)], np.int64))

    hashed = docs.select(F.sha2("text", 256).alias("hash"), "text").where("text IS NOT NULL")
    known = hashed.mapInPandas(lines_of, "hash string, variant bigint").join(interest, "variant")
    known = known.groupBy("hash").agg(F.collect_set(F.struct("variant", "often")).alias("told"))
    return hashed.join(known, "hash").select("text", "told").mapInPandas(joined, schema)


def _unlike(sketches: np.ndarray, most: int) -> np.ndarray:
    """Numbers of at most ``most`` rows of ``sketches`` no two of which are alike; each other row is like one of them, or there are ``most``."""
    rest, out = np.arange(len(sketches)), []
    whole = (sketches[:, SKETCHES:, None] >> np.arange(0, 8, 2, dtype=np.uint8) & 3).reshape(len(sketches), BINS)
    while len(rest) and len(out) < most:
        out.append(rest[0])
        same = (sketches[rest, :SKETCHES] == sketches[rest[0], :SKETCHES]).sum(axis=1)
        rest = rest[1:][((same < ALIKE_BESIDES) & (likeness(whole[rest[0]], whole[rest]) < ALIKE_WHOLE))[1:]]
    return np.array(out, np.int64)


def spread(rows: DataFrame, min_docs: int) -> DataFrame:
    """Values of ``key`` that have ``min_docs`` rows or more no two of which are alike; rows are ``key``, ``sketch`` and the ``n`` rows of the key."""

    def kept(final: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # rows come sorted by key and part; what is kept of the last one is taken along
            rest: pd.DataFrame | None = None

            def reduced(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, bool]]:
                both = frame[["key", "part"]].to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1), [True]]))
                values = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(len(frame), -1)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    yield a + _unlike(values[a:b], min_docs), b == len(frame)

            def given(frame: pd.DataFrame, groups: list[np.ndarray]) -> pd.DataFrame:
                some = [g[:1] if final else g for g in groups if not final or len(g) >= min_docs]
                return frame.iloc[np.concatenate(some) if some else []]

            for batch in batches:
                frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
                if not len(frame):
                    continue
                groups = list(reduced(frame))
                yield given(frame, [g for g, last in groups if not last])
                rest = frame.iloc[groups[-1][0]]
            if rest is not None:
                rest = rest.reset_index(drop=True)
                yield given(rest, [g for g, _ in reduced(rest)])

        return run

    schema = "key bigint, part bigint, sketch binary"
    parted = rows.select("key", F.pmod(F.xxhash64("sketch"), F.ceil(F.col("n") / TOGETHER)).alias("part"), "sketch")
    first = parted.repartition("key", "part").sortWithinPartitions("key", "part", "sketch").mapInPandas(kept(False), schema)
    first = first.withColumn("part", F.lit(0).cast("bigint"))
    return first.repartition("key").sortWithinPartitions("key", "sketch").mapInPandas(kept(True), schema).select("key")


def _choices(used: Column) -> Column:
    """Groups of a variant within its leaf: the whole leaf, and the values in PLACES slots for each of CHOICES choices."""
    rng = random.Random(16)
    keys = [F.lit("")]
    for choice in range(CHOICES):
        places = accumulate([rng.randrange(1 << 20), *(rng.randrange(1, 6) for _ in range(PLACES - 1))])
        # the variants of one leaf have equally many slots, so a choice is the same for all of them
        values = [F.substr(F.hex("slots"), (F.pmod(F.lit(place), used) * 2 + 1).cast("int"), F.lit(2)) for place in places]
        keys.append(F.concat(F.lit(f"{choice}:"), *values))
    return F.array(*keys)


def templates(variants: DataFrame, min_variants: int, agree: float, constant: float) -> DataFrame:
    """``leaf, fixed`` of each template: the slots (with their values) that most variants of a group of a leaf agree in."""
    several = variants.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_variants).select("leaf")
    used = F.least(F.col("size") - DEPTH, F.lit(SLOTS)).cast("int")
    wide = dealt_join(variants.where(F.col("size") > DEPTH + 2), several, ["leaf"], "variant").select("leaf", "variant", used.alias("used"), "slots")
    grouped = wide.withColumn("group", F.explode(F.array_distinct(_choices(F.col("used")))))
    groups = grouped.groupBy("leaf", "group").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_variants)
    cells = dealt_join(grouped, groups, ["leaf", "group"], "variant").select("leaf", "group", "m", "used", "slots", F.explode(F.sequence(F.lit(1), F.col("used"))).alias("slot"))
    cells = cells.select("leaf", "group", "m", "used", "slot", F.substring(F.hex("slots"), F.col("slot") * 2 - 1, F.lit(2)).alias("value"))
    best = (
        cells.groupBy("leaf", "group", "m", "used", "slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("leaf", "group", "m", "used", "slot")
        .agg(F.max(F.struct("n", "value")).alias("top"))
        .where(F.col("top.n") >= F.lit(agree) * F.col("m"))
    )
    return (
        best.groupBy("leaf", "group", "used")
        .agg(F.sort_array(F.collect_list(F.struct("slot", F.col("top.value").alias("value")))).alias("fixed"))
        .where((F.size("fixed") >= 3) & (F.size("fixed") >= F.lit(constant) * F.col("used")))
        .select("leaf", "fixed")
        .distinct()
    )


def recurring_variants(docs: DataFrame, min_docs: int, min_variants: int = 4, agree: float = 0.8, constant: float = 0.7, limit: int = 100_000) -> DataFrame:
    """Masked lines (``variant``) whose template recurs, in ``min_docs`` or more texts no two of which are alike besides it.

    A group of a leaf with ``min_variants`` or more variants is generalised: a slot in
    which at least ``agree`` of them have the same value is constant. If 3 slots or
    more, and a share of at least ``constant`` of those in use, are constant, the
    variants of the leaf that have all constant values are one template.
    """
    rows = "leaf bigint, variant bigint, slots binary, size bigint"
    uses = docs.select("text").mapInPandas(_line_rows, rows)
    variants = materialize(uses.groupBy("leaf", "variant", "slots", "size").agg(F.count(F.lit(1)).alias("n")), "line-variants")
    often = variants.where(F.col("n") >= min_docs).select("variant", "n")
    patterns = templates(variants, min_variants, agree, constant).withColumn("key", F.xxhash64("leaf", "fixed"))
    fits = F.forall("fixed", lambda f: F.substring(F.hex("slots"), f["slot"] * 2 - 1, F.lit(2)) == f["value"])
    members = dealt_join(variants, patterns, ["leaf"], "variant").where(fits).select("key", "variant", "n")
    all_of = members.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") >= min_docs)
    members = materialize(dealt_join(members, all_of, ["key"], "variant"), "line-members")
    interest = often.select("variant", "n").unionByName(members.select("variant", F.col("all").alias("n")))
    interest = materialize(interest.groupBy("variant").agg(F.floor(F.log2(F.max("n"))).cast("int").alias("often")), "line-interest")
    met = materialize(sketches(docs, interest, limit).distinct(), "line-met")
    count = lambda rows, key: rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    own = dealt_join(met, count(met, "variant"), ["variant"], "sketch")
    direct = spread(own.select(F.col("variant").alias("key"), "sketch", "n"), min_docs).select(F.col("key").alias("variant"))
    keyed = met.join(members.select("variant", "key"), "variant").select("key", "sketch").distinct()
    wide = spread(dealt_join(keyed, count(keyed, "key"), ["key"], "sketch").select("key", "sketch", "n"), min_docs)
    return direct.unionByName(members.join(wide, "key").select("variant")).distinct()


def _kept(text: str | None, drop: np.ndarray) -> tuple[str | None, int, int]:
    """The text without the lines marked in ``drop``, the number of its lines and of those that went."""
    if text is None:
        return None, 0, 0
    if not text:
        return text, 1, 0
    lines = text.split("\n")
    gone = int(drop.sum())
    return ("\n".join(line for line, d in zip(lines, drop, strict=True) if not d) if gone else text), len(lines), gone


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, broadcast_limit: int = 100_000) -> DataFrame:
    """``docs`` with ``text`` less its recurring lines, and ``n_lines`` and ``n_dropped``.

    Lines are what newlines part. Blank lines and lines under three words always
    stay. Null texts stay null with 0 lines; an empty text has one line, which
    stays; equal rows get equal results; rows are never dropped, even if no line
    is left; other columns stay, but ``n_lines`` and ``n_dropped`` are replaced.

    Variants that come often, and then those that recur, go to the tasks as arrays
    of 64-bit hashes while there are at most ``broadcast_limit``; beyond that, lines
    are joined with them, and what is found with the documents.
    """
    found = materialize(recurring_variants(docs, min_docs, limit=broadcast_limit), "line-recurring")
    result = "text string, n_lines bigint, n_dropped bigint"
    if found.count() <= broadcast_limit:
        known = np.sort(found.toArrow()["variant"].to_numpy())

        @F.pandas_udf(result)
        def kept(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for _, texts in parcels(batch.tolist()):
                    words = words_of(texts, mask_fields=True)
                    variant = _signed(masked_lines(words)[1])
                    drop = np.zeros(len(variant), bool)
                    if len(known):
                        drop = known[np.minimum(np.searchsorted(known, variant), len(known) - 1)] == variant
                    rows += [_kept(t, drop[words.line_of[k] : words.line_of[k + 1]]) for k, t in enumerate(texts)]
                yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        out = docs.select(F.struct("*").alias("row"), kept("text").alias("new"))
    else:

        def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = batch["hash"].array
                for begin, texts in parcels(batch["text"].tolist()):
                    words = words_of(texts, mask_fields=True)
                    variant = _signed(masked_lines(words)[1])
                    text = np.repeat(np.arange(len(texts)), np.diff(words.line_of))
                    line = np.arange(len(variant)) - words.line_of[text]
                    yield pd.DataFrame({"hash": keys[begin + text], "line": line, "variant": variant})

        @F.pandas_udf(result)
        def kept_by_row(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
            rows = []
            for text, numbers in zip(texts, gone, strict=True):
                drop = np.zeros(text.count("\n") + 1 if text is not None else 0, bool)
                if numbers is not None:
                    drop[np.asarray(numbers, np.int64)] = True
                rows.append(_kept(text, drop))
            return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        hashed = docs.select(F.struct("*").alias("row"), F.sha2("text", 256).alias("hash"))
        gone = (
            hashed.select("hash", "row.text")
            .mapInPandas(numbered, "hash string, line bigint, variant bigint")
            .join(found, "variant", "left_semi")
            .groupBy("hash")
            .agg(F.collect_set("line").alias("gone"))
        )
        out = hashed.join(gone, "hash", "left").select("row", kept_by_row("row.text", "gone").alias("new"))
    # rows are packed, so a column of theirs may have any name
    own = [F.col("new.text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, "new.n_lines", "new.n_dropped")
