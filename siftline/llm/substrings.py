"""Exact substring dedup: bytes covered by a string of L bytes that starts anywhere else.

A window of L bytes is represented by its anchor, the leftmost of its K-byte
strings with the smallest hash. The anchor depends on the window's bytes alone,
so equal windows have equal anchors at equal distance, and only windows whose
anchors are equal need to meet:

1. anchors that occur in one place only are dropped (one shuffle of hashes);
2. for the others, the windows of an anchor are one context, routed by the 2K
   bytes around the anchor that all of them contain. Equal contexts are repeats
   as a whole;
3. different contexts of one route are put behind each other and their suffixes
   sorted by :mod:`siftline.llm.suffixes`; a window repeats if its neighbour in
   suffix order starts with the same L bytes. As all contexts of a route are
   aligned at the anchor, the shared middle is one symbol and what follows it is
   read in symbols of eight bytes, which keeps the order of bytes;
4. routes with very many contexts are sorted in parts. A window that finds no
   equal in its part is looked for in the other parts by hash, so no task gets a
   group that grows with the input.

Equal whole texts are one class and take part once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialize
from siftline.llm.suffixes import suffix_array

L = 200
K = 64
W = L - K + 1
#: Contexts of a route that are sorted together; a route with more is sorted in parts.
LIMIT = 256
#: Symbols that are sorted together.
SORTED = 60_000
#: Bytes that are hashed together, and of a long text at once.
PIECE = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 2**64))
_C1, _C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C1
    return x ^ (x >> np.uint64(29))


class Pieces:
    """Hashes of all strings of a few texts, or parts of texts, behind each other."""

    def __init__(self, parts: list[bytes], room: int = 2 * PIECE + L):
        self.size = np.array([len(p) for p in parts], np.int64)
        self.end = np.cumsum(self.size)
        self.data = b"".join(parts)
        if len(self.data) > getattr(Pieces, "_room", 0):
            Pieces._room = max(room, len(self.data))
            base = np.ones(Pieces._room + 1, np.uint64)
            base[1:] = _B
            Pieces._up = np.multiply.accumulate(base)
            base[1:] = _INVERSE
            Pieces._down = np.multiply.accumulate(base)
        symbols = np.frombuffer(self.data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * Pieces._up[: len(symbols)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * Pieces._down[start])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Part, first and last window start, anchor and hash of its K bytes, for each run of windows with one anchor."""
        none = np.zeros(0, np.int64)
        if len(self.data) < L:
            return none, none, none, none, none.astype(np.uint64)
        hashed = self.hashes(np.arange(len(self.data) - K + 1), K)
        key = (hashed & _HIGH) | np.arange(len(hashed), dtype=np.uint64)
        padded = np.concatenate([key, np.full(-len(key) % W, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, W)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - W + 1
        lowest = (np.minimum(behind[:n], ahead[W - 1 : W - 1 + n]) & ~_HIGH).astype(np.int64)
        part = np.repeat(np.arange(len(self.size)), self.size)[:n]
        start = np.flatnonzero(np.arange(n) + L <= self.end[part])
        if not len(start):
            return none, none, none, none, none.astype(np.uint64)
        anchor, own = lowest[start], part[start]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]))
        last = np.concatenate([cut[1:], [len(start)]]) - 1
        return own[cut], start[cut], start[last], anchor[cut], hashed[anchor[cut]]


def _cut(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in parcels of about PIECE bytes: number of the text, offset of the part, part. Parts overlap by L - 1."""
    number, offset, parts, total = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - L + 1, 1), PIECE):
            part = text[at : at + PIECE + L - 1]
            number.append(i)
            offset.append(at)
            parts.append(part)
            total += len(part)
            if total >= PIECE:
                yield number, offset, parts
                number, offset, parts, total = [], [], [], 0
    if parts:
        yield number, offset, parts


def _bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each anchor hash of a part of a text once, a place of it in the text, and whether it occurs in the part again."""
    for batch in batches:
        tids = batch["tid"].to_numpy()
        for number, offset, parts in _cut([_bytes(t) for t in batch["text"]]):
            pieces = Pieces(parts)
            part, _, _, anchor, hashed = pieces.anchors()
            if not len(part):
                continue
            place = np.array(offset)[part] + anchor - (pieces.end - pieces.size)[part]
            pair = np.stack([np.array(number)[part], hashed.view(np.int64)], axis=1)
            pair, first, times = np.unique(pair, axis=0, return_index=True, return_counts=True)
            yield pd.DataFrame({"tid": tids[pair[:, 0]], "anchor": pair[:, 1], "place": place[first], "again": times > 1})


_CONTEXT = "tid long, doc_id string, route long, context long, at long, first int, n int, body binary, again boolean"


def _context_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts of shared anchors; a context that repeats within a text also as spans (null route) for each place."""
    for batch in batches:
        tids, docs = batch["tid"].to_numpy(), batch["doc_id"].array
        shared = [np.sort(np.asarray(a, np.int64)) for a in batch["anchors"]]
        for number, offset, parts in _cut([_bytes(t) for t in batch["text"]]):
            pieces = Pieces(parts)
            part, first, last, anchor, hashed = pieces.anchors()
            if not len(part):
                continue
            text = np.array(number)[part]
            keep = np.zeros(len(part), bool)
            cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
            for s, e in zip(cuts, cuts[1:], strict=False):
                own = shared[text[s]]
                values = hashed[s:e].view(np.int64)
                at = np.minimum(np.searchsorted(own, values), max(len(own) - 1, 0))
                keep[s:e] = own[at] == values if len(own) else False
            part, text, first, last, anchor = (x[keep] for x in (part, text, first, last, anchor))
            begin = (pieces.end - pieces.size)[part]
            rows = []
            for side in (0, 1):
                # windows at least K before the anchor hold the K bytes in front of it, the others the K bytes behind it
                low, high = (first, np.minimum(last, anchor - K)) if side == 0 else (np.maximum(first, anchor - K + 1), last)
                ok = low <= high
                low, high, mid = low[ok], high[ok], anchor[ok]
                around = mid - K if side == 0 else mid
                route = _mix(pieces.hashes(around, 2 * K) + np.uint64(side))
                context = _mix(pieces.hashes(low, high - low + L) + (mid - low).astype(np.uint64) * _C2)
                rows.append((text[ok], np.array(offset)[part[ok]] + low - begin[ok], route, context, mid - low, high - low + 1, low))
            text, at, route, context, before, n, low = (np.concatenate(x) for x in zip(*rows, strict=True))
            if not len(text):
                continue
            same, where, times = np.unique(np.stack([text.view(np.uint64), route, context], axis=1), axis=0, return_inverse=True, return_counts=True)
            del same
            where = where.reshape(-1)
            again = times[where] > 1
            lead = np.zeros(len(text), bool)
            lead[np.unique(where, return_index=True)[1]] = True
            data = pieces.data
            yield pd.DataFrame(
                {
                    "tid": tids[text[lead]],
                    "doc_id": docs[text[lead]],
                    "route": route[lead].view(np.int64),
                    "context": context[lead].view(np.int64),
                    "at": at[lead],
                    "first": before[lead],
                    "n": n[lead],
                    "body": [data[s : s + w + L - 1] for s, w in zip(low[lead].tolist(), n[lead].tolist(), strict=True)],
                    "again": again[lead],
                }
            )
            if again.any():
                yield pd.DataFrame(
                    {
                        "tid": tids[text[again]],
                        "doc_id": docs[text[again]],
                        "route": pd.array([None] * int(again.sum()), "Int64"),
                        "context": 0,
                        "at": at[again],
                        "first": 0,
                        "n": n[again],
                        "body": None,
                        "again": True,
                    }
                )


_FOUND = "tid long, doc_id string, lo long, hi long, window long, again boolean"


def _sorted_symbols(bodies: list[bytes], firsts: list[int], counts: list[int], routes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One string over all contexts, with the context and the window of each symbol (-1: none).

    A context is bytes up to the anchor, a symbol for its route, then symbols of
    eight bytes; a symbol below all others ends it.
    """
    codes, owner, window = [], [], []
    names = {r: i for i, r in enumerate(dict.fromkeys(routes))}
    for i, (body, first, count, route) in enumerate(zip(bodies, firsts, counts, routes, strict=True)):
        tail = body[first + K :]
        tail += b"\0" * (-len(tail) % 8)
        eights = np.frombuffer(tail, ">u8").astype(np.uint64)
        code = np.zeros((first + 1 + len(eights) + 1, 2), np.uint64)
        code[:first, 0], code[:first, 1] = 2, np.frombuffer(body[:first], np.uint8)
        code[first] = 3, names[route]
        code[first + 1 : -1, 0], code[first + 1 : -1, 1] = 1, eights
        codes.append(code)
        owner.append(np.full(len(code), i))
        place = np.full(len(code), -1)
        place[:count] = np.arange(count)  # windows start at or before the anchor
        window.append(place)
    both = np.concatenate(codes)
    # kind above value: ranks of (kind, value) in order
    order = np.lexsort((both[:, 1], both[:, 0]))
    step = np.concatenate([[0], (both[order[1:]] != both[order[:-1]]).any(axis=1)]).cumsum()
    symbols = np.empty(len(both), np.int64)
    symbols[order] = step
    return symbols, np.concatenate(owner), np.concatenate(window)


def _window_hashes(bodies: list[bytes], firsts: np.ndarray, routes: np.ndarray, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, place and hash (of route, distance to the anchor and bytes) of the marked windows."""
    pieces = Pieces(bodies)
    own = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    place = np.concatenate([np.arange(len(m)) for m in marks])
    keep = np.concatenate(marks)
    own, place = own[keep], place[keep]
    salt = (firsts[own] - place).astype(np.uint64) * _C2 + routes.view(np.uint64)[own]
    return own, place, _mix(pieces.hashes((pieces.end - pieces.size)[own] + place, L) + salt).view(np.int64)


def _repeats(group: pd.DataFrame) -> list[pd.DataFrame]:
    """What repeats among the contexts of some whole parts of routes.

    Rows are spans (``window`` null) or, of routes in several parts, windows that
    the other parts have to be asked for, and with ``again`` the windows found here.
    """
    keys = list(zip(group["part"], group["context"], strict=True))
    distinct: dict[tuple[int, int], int] = {}
    for k in keys:
        distinct.setdefault(k, len(distinct))
    index = np.array([distinct[k] for k in keys])
    _, lead = np.unique(index, return_index=True)
    some = group.iloc[lead]
    bodies, firsts = [bytes(b) for b in some["body"]], some["first"].tolist()
    counts, parts, several = some["n"].tolist(), some["part"].tolist(), some["parts"].to_numpy() > 1
    symbols, owner, window = _sorted_symbols(bodies, firsts, counts, parts)
    order = suffix_array(symbols)
    order = order[window[order] >= 0]
    hit, run = [np.zeros(c, bool) for c in counts], [np.zeros(c, bool) for c in counts]
    own, win = owner[order].tolist(), window[order].tolist()
    for i in range(1, len(own)):
        a, b, p, q = own[i - 1], own[i], win[i - 1], win[i]
        if parts[a] == parts[b] and firsts[a] - p == firsts[b] - q and bodies[a][p : p + L] == bodies[b][q : q + L]:
            run[a][p] |= not hit[a][p]  # the first of its equals stands for them
            hit[a][p] = hit[b][q] = True
    whole = np.bincount(index, minlength=len(distinct)) > 1
    whole[index[group["again"].to_numpy()]] = True
    for k in np.flatnonzero(whole):
        hit[k][:] = run[k][:] = True
    rows = []
    for k, tid, doc, at in zip(index, group["tid"], group["doc_id"], group["at"], strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[k].astype(np.int8), [0]])))
        rows += [(tid, doc, at + s, at + e - 1 + L) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    out = [pd.DataFrame(rows, columns=["tid", "doc_id", "lo", "hi"]).assign(window=pd.array([None] * len(rows), "Int64"), again=False)] if rows else []
    if several.any():
        far = np.flatnonzero(several)
        args = [bodies[k] for k in far], np.array(firsts)[far], some["route"].to_numpy()[far]
        for again, marks in ((False, [~hit[k] for k in far]), (True, [run[k] for k in far])):
            who, place, hashed = _window_hashes(*args, marks)
            start = some["at"].to_numpy()[far][who] + place
            out.append(
                pd.DataFrame(
                    {
                        "tid": some["tid"].to_numpy()[far][who],
                        "doc_id": some["doc_id"].array[far[who]],
                        "lo": start,
                        "hi": start + L,
                        "window": pd.array(hashed, "Int64"),
                        "again": again,
                    }
                )
            )
    return out


def _sorted_routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by part; whole parts are gathered up to SORTED symbols."""
    rest: pd.DataFrame | None = None

    def parcels(frame: pd.DataFrame, final: bool) -> Iterator[pd.DataFrame]:
        nonlocal rest
        part = frame["part"].to_numpy()
        ends = np.concatenate([np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)] if final else []]).astype(int)
        weight = np.concatenate([[0], np.cumsum(frame["first"].to_numpy() + frame["body"].map(len).to_numpy() // 8 + 2)])
        begin = 0
        for k, end in enumerate(ends):
            if weight[end] - weight[begin] >= SORTED or k == len(ends) - 1:
                yield frame.iloc[begin:end]
                begin = end
        rest = frame.iloc[begin:]

    for batch in batches:
        frame = batch if rest is None or not len(rest) else pd.concat([rest, batch], ignore_index=True)
        for parcel in parcels(frame, False):
            yield from _repeats(parcel)
    if rest is not None and len(rest):
        for parcel in parcels(rest.reset_index(drop=True), True):
            yield from _repeats(parcel)


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            data, kept, at, gone, runs = _bytes(text), hashlib.sha256(), 0, 0, 0
            stop = -1
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
                if lo > stop:
                    runs += 1
                    if stop >= 0:
                        at = stop
                    kept.update(data[at:lo])
                    gone += hi - lo
                    stop = hi
                elif hi > stop:
                    gone += hi - stop
                    stop = hi
            kept.update(data[stop if stop >= 0 else 0 :])
            rows.append((gone, runs, kept.hexdigest()))
        yield pd.DataFrame({"tid": batch["tid"], "key": batch["key"], "n_removed": [r[0] for r in rows], "n_spans": [r[1] for r in rows], "sha": [r[2] for r in rows]})


def repeated_spans(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Spans ``lo`` to ``hi`` in bytes of each text (``tid``, ``doc_id``) of ``lists`` that repeat elsewhere."""
    rows = materialize(
        docs.alias("d")
        .join(lists.alias("l"), (F.col("d.tid") == F.col("l.tid")) & F.col("d.doc_id").eqNullSafe(F.col("l.rep")))
        .select("d.tid", "d.doc_id", "d.text", "l.anchors")
        .mapInPandas(_context_rows, _CONTEXT),
        "substring-contexts",
    )
    inner = rows.where("route is null").select("tid", "doc_id", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (L - 1)).alias("hi"))
    contexts = rows.where("route is not null")
    # copies of a context are counted, not gathered: one of them stands for all
    copies = contexts.groupBy("route", "context").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("tid", "at")).alias("lead"))
    stats = copies.groupBy("route").agg(F.count(F.lit(1)).alias("kinds"))
    known = copies.join(stats, "route").where("kinds > 1 OR uses > 1")
    met = contexts.join(known, ["route", "context"])
    whole = met.where("uses > 1").select("tid", "doc_id", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (L - 1)).alias("hi"))
    leads = met.where((F.col("kinds") > 1) & (F.struct("tid", "at") == F.col("lead"))).withColumn("again", F.col("again") | (F.col("uses") > 1))
    contested = leads.withColumn("parts", F.ceil(F.col("kinds") / LIMIT)).drop("uses", "lead", "kinds")
    contested = contested.withColumn("part", F.xxhash64("route", F.pmod(F.xxhash64("context"), F.col("parts"))))
    found = materialize(contested.repartition("part").sortWithinPartitions("part").mapInPandas(_sorted_routes, _FOUND), "substring-found")
    near = found.where("window is null").select("tid", "doc_id", "lo", "hi")
    apart = found.where("window is not null")
    twice = apart.groupBy("window").agg(F.count(F.lit(1)).alias("uses"), F.max("again").alias("some")).where("uses > 1 or some")
    far = apart.where(~F.col("again")).join(twice, "window").select("tid", "doc_id", "lo", "hi")
    return inner.unionByName(whole).unionByName(near).unionByName(far)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs`` (``doc_id``, ``text``).

    A byte goes if some string of L bytes that covers it starts also anywhere else,
    in another document or in the same one, overlaps included; all is judged on
    the input. Texts under L bytes, empty and null ones keep everything (null
    counts as empty); rows that are repeated are repeats of each other; null ids
    are ordinary; no rows give no rows; other columns are ignored.
    """
    # the hash routes a text, the digest tells texts apart
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    rows = materialize(docs.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "substring-rows")
    texts = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.col("doc_id").cast("string")).alias("rep"), F.any_value("tid").alias("tid"), F.any_value("n_bytes").alias("n_bytes"))
    texts = materialize(texts, "substring-texts")
    # ids go through Python as strings, which keeps them whole beside nulls
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    anchors = materialize(
        docs.where(F.octet_length("text") >= L).select("tid", "text").mapInPandas(_anchor_rows, "tid long, anchor long, place int, again boolean"), "substring-anchors"
    )
    shared = (
        anchors.groupBy("anchor")
        .agg(
            F.min("tid").alias("low"),
            F.max("tid").alias("high"),
            F.min("place").alias("first"),
            F.max("place").alias("last"),
            F.max("again").alias("again"),
        )
        # parts of one long text tell their places apart, equal texts have equal places
        .where("low <> high or first <> last or again")
        .select("anchor")
    )
    lists = (
        anchors.select("tid", "anchor")
        .join(shared, "anchor")
        .groupBy("tid")
        .agg(F.collect_set("anchor").alias("anchors"))
        .join(texts.where(F.col("n_bytes") >= L).select("tid", "rep"), "tid")
    )
    spans = repeated_spans(docs, materialize(lists, "substring-lists"))
    own = materialize(
        spans.groupBy("tid", "doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).select("tid", F.col("doc_id").alias("key"), "spans"),
        "substring-spans",
    )
    cut = materialize(
        docs.alias("d")
        .join(own.alias("o"), (F.col("d.tid") == F.col("o.tid")) & F.col("d.doc_id").eqNullSafe(F.col("o.key")))
        .select("o.tid", "o.key", "d.text", "o.spans")
        .mapInPandas(_removed, "tid long, key string, n_removed long, n_spans long, sha string")
        .distinct(),
        "substring-cut",
    )
    result = texts.alias("t").join(
        cut.alias("c"), (F.col("t.tid") == F.col("c.tid")) & F.col("t.rep").eqNullSafe(F.col("c.key")) & (F.col("t.copies") == 1), "left"
    )
    copied = (F.col("t.copies") > 1) & (F.col("t.n_bytes") >= L)
    result = result.select(
        F.col("t.sha").alias("text_sha"),
        F.when(copied, F.col("t.n_bytes")).otherwise(F.coalesce("c.n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("c.n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c.sha", "t.sha")).alias("kept_sha256"),
    )
    return rows.join(result, F.col("sha") == F.col("text_sha")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
