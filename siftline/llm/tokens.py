"""Words of many texts at once: places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that are hashed together; a longer text is cut between words.
PARCEL = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 2**64))
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = _SPACE.copy()
_BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Bytes of a variable field: digits and ``@``.
_FIELD = np.zeros(256, bool)
_FIELD[[*range(48, 58), 64]] = True
FIELD_HASH = np.uint64(0x165667B19E3779F9)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= size:
        _powers.clear()
        for factor in (_B, _INVERSE):
            base = np.ones(max(size, 2 * PARCEL) + 1, np.uint64)
            base[1:] = factor
            _powers.append(np.multiply.accumulate(base))
    return _powers[0], _powers[1]


@dataclass(frozen=True)
class Words:
    """Words of texts behind each other: hash, line over all texts, and the first word and line of each text.

    ``plain`` are the hashes before fields were masked.
    """

    hashes: np.ndarray
    line: np.ndarray
    word_of: np.ndarray
    line_of: np.ndarray
    plain: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.word_of[k] : self.word_of[k + 1]]


def _hashed(data: bytes, mask_fields: bool, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and hash of each word, and the hash without a mask."""
    codes = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], breaks[codes], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _tables(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    found = mix((sums[end] - sums[start]) * down[start])
    if not mask_fields:
        return start, found, found
    fields = np.concatenate([[0], np.cumsum(_FIELD[codes])])
    return start, np.where(fields[end] > fields[start], FIELD_HASH, found), found


def words_of(texts: list[str | None], mask_fields: bool = False, loose: bool = False, fold: bool = True, parting: np.ndarray | None = None) -> Words:
    """Words of ``texts`` with A-Z lower-cased, unless not ``fold``; null counts as empty.

    With ``mask_fields``, words with digits or ``@`` are all alike. With ``loose``,
    ASCII punctuation parts words as well and all letters are lower-cased.
    ``parting`` marks other bytes that part words, the newline among them.
    """
    data = [b"" if t is None else (t.lower() if loose else t).encode("utf-8", "surrogatepass") for t in texts]
    if parting is None:
        parting = _BREAK if loose else _SPACE
    size = np.array([len(d) for d in data], np.int64)
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    whole = b"\n".join([*data, b""])
    whole = whole.lower() if fold else whole
    starts, hashes, plain, at = [], [], [], 0
    while at < len(whole):
        end = min(at + PARCEL, len(whole))
        while end < len(whole) and not parting[whole[end]]:
            end += 1
        start, found, raw = _hashed(whole[at:end], mask_fields, parting)
        starts.append(start + at)
        hashes.append(found)
        plain.append(raw)
        at = end
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    breaks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(
        found,
        np.searchsorted(breaks, start),
        np.searchsorted(start, offset),
        np.searchsorted(breaks, offset),
        np.concatenate(plain) if mask_fields and plain else found,
    )


def parcels(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """``texts`` in runs of about PARCEL characters, each with the number of its first."""
    begin, total = 0, 0
    for i, text in enumerate(texts):
        total += len(text or "") + 1
        if total >= PARCEL // 2:
            yield begin, texts[begin : i + 1]
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]
