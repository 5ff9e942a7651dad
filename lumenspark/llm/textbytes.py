"""Vectorised helpers on Arrow string columns.

Everything works on the UTF-8 bytes of a whole column at once.

Words have 64-bit names that are mixed from their bytes, eight at a time, with their length, so texts
that are built to defeat a polynomial (a Thue-Morse word and its complement) have different names.
Words beyond LONG_WORD bytes are named by BLAKE2b.

Spans hashes the many overlapping spans of a piece of text in constant time each, with one prefix
polynomial: with ``P[i] = sum(v[b_j] * M**j for j < i)`` (mod 2**64, ``M`` odd and so invertible) the
span ``[s, e)`` has the position-free value ``(P[e] - P[s]) * M**-s``, which a final mixing step
spreads over 64 bits.  A polynomial modulo a power of two is unsound for long spans (Thue-Morse words
of 1024 letters collide), so spans may have MOST_SPAN bytes at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE, LONG_WORD, MOST_SPAN = 1 << 19, 512, 512
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a splitmix64 finaliser); returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers() -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, for the positions of a piece and one span more."""
    if not _powers:
        for base in (_MULT, _INVERSE):
            p = np.full(PIECE + MOST_SPAN + 1, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


class Spans:
    """Hashes of byte spans of one piece of text, of PIECE + MOST_SPAN bytes at most."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers()
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.total[end] - self.total[start]) * self.down[start]
        raw += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(raw)

    def hash_all(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width."""
        n = len(self.total) - width
        raw = self.total[width:] - self.total[:n]
        raw *= self.down[:n]
        return mix(raw)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, n + 1 + at)[at:].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


class WordRule:
    """Which bytes make words (A-Z as a-z)."""

    def __init__(self, word: np.ndarray):
        self.word = word


def _not_space() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0x20, *range(9, 14)]] = False
    return word


def _alphanumeric() -> np.ndarray:
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return word


#: Runs of bytes other than ASCII white space; runs of ASCII letters, digits and bytes from 0x80.
BLANK_SEPARATED = WordRule(_not_space())
ALPHANUMERIC = WordRule(_alphanumeric())
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of eight (little-endian).
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_START, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; data has eight bytes more than there are places."""
    return np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 8,), (1,))


def names(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit names of the non-empty spans [start, stop) of data."""
    size = stop - start
    at = eights(np.concatenate([data, np.zeros(16, np.uint8)]))
    out = size.astype(np.uint64) * _START
    left, place, todo = size, start, np.arange(len(size))
    long = size > LONG_WORD
    if long.any():
        todo = np.flatnonzero(~long)
        left, place = size[todo], start[todo]
    while len(todo):
        block = at[place] & FIRST[np.minimum(left, 8)]
        out[todo] = mix((out[todo] ^ block) * _FOLD + _START)
        more = left > 8
        todo, place, left = todo[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(long).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : stop[i]], digest_size=8).digest(), "<u8")[0]
    return out


def words(data: np.ndarray, offsets: np.ndarray, rule: WordRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name and byte length of every word of every row, and the offsets of the rows in them.

    Words do not cross rows.  Text is taken in pieces that end at a separator or a row's end, so
    memory beyond one number a word does not grow with the length of a row.
    """
    hashes, starts_at, lengths = [], [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + PIECE, end)
        if to < end:
            row = int(np.searchsorted(offsets, to, "right")) - 1
            cut = int(offsets[row])
            if cut <= at:
                gap = np.flatnonzero(~rule.word[data[at:to]])
                if len(gap):
                    cut = at + int(gap[-1]) + 1
                else:
                    last = int(offsets[row + 1])
                    cut = to
                    while cut < last and rule.word[data[cut]]:
                        gap = np.flatnonzero(~rule.word[data[cut : min(cut + PIECE, last)]])
                        cut = cut + int(gap[0]) if len(gap) else min(cut + PIECE, last)
            to = cut
        piece = data[at:to]
        inside = rule.word[piece]
        edge = np.ones(len(piece) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        breaks = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        edge[breaks] = True
        where = np.flatnonzero(edge)
        kept = inside[np.minimum(where[:-1], len(piece) - 1)]
        start, stop = where[:-1][kept], where[1:][kept]
        if len(start):
            hashes.append(names(_LOWER[piece], start, stop))
            starts_at.append(start + at)
            lengths.append(stop - start)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begun = np.concatenate(starts_at)
    return np.concatenate(hashes), np.concatenate(lengths), np.searchsorted(begun, offsets)


def by_bytes(column, limit: int):
    """Slices of an Arrow string column, as (first row, rows), of about so many bytes; a row of more is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to - at
        at = to


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the width-word shingles of each row, in order, and the rows' offsets in them.

    Words are mixed in one after the other.  A row with fewer words has its whole sequence as the one
    shingle; a row without words has none.  Equal hashes make no equal shingles: where that counts, coded
    tells by the words.
    """
    n_words = np.diff(rows)
    counts = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    out_rows = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), out_rows
    raw = mix((hashes ^ _START) * _FOLD)
    for j in range(1, min(width, n)):
        raw = np.concatenate([mix((raw[: n - j] ^ hashes[j:]) * _FOLD + np.uint64(j)), raw[n - j :]])
    full = np.repeat(np.where(n_words >= width, rows[1:] - width + 1, rows[:-1] + 1), n_words) > np.arange(n)
    for d in np.flatnonzero((n_words > 0) & (n_words < width)):
        one = mix((hashes[rows[d] : rows[d] + 1] ^ _START) * _FOLD)
        for j in range(1, n_words[d]):
            one = mix((one ^ hashes[rows[d] + j]) * _FOLD + np.uint64(j))
        raw[rows[d]] = mix(one + np.uint64(n_words[d]))[0]
    return raw[full], out_rows


def coded(texts: Iterable[list[bytes]], width: int) -> list[np.ndarray]:
    """The sets of shingles of some texts, given by their words, as numbers: equal ones for equal words, others for others.

    Numbers hold among these texts alone.  A text with fewer words has its whole sequence as the one shingle.
    """
    known: dict[bytes, int] = {}
    short: dict[tuple[bytes, ...], int] = {}
    parts, whole = [], []
    for words_ in texts:
        if len(words_) < width:
            parts.append(np.zeros(0, np.int64))
            whole.append(short.setdefault(tuple(words_), -1 - len(short)) if words_ else 0)
        else:
            parts.append(np.array([known.setdefault(w, len(known)) for w in words_], np.int64))
            whole.append(0)
    size = np.array([len(p) for p in parts], np.int64)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    code = ids
    for j in range(1, width if len(ids) >= width else 1):
        # numbers of words and of what is left of them stay below the count of words, so their pairs fit
        code = np.unique(code[: len(ids) - j] * len(known) + ids[j:], return_inverse=True)[1]
    begin = np.cumsum(size) - size
    return [np.unique(code[b : b + n - width + 1]) if n else np.array([w][: int(w < 0)], np.int64) for b, n, w in zip(begin.tolist(), size.tolist(), whole, strict=True)]


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices begins[i], begins[i] + 1, ... (counts[i] of them), for all i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    used = counts > 0
    begins, counts = begins[used], counts[used]
    step = np.ones(total, np.int64)
    step[0] = begins[0]
    at = np.cumsum(counts)[:-1]
    step[at] = begins[1:] - (begins[:-1] + counts[:-1] - 1)
    return np.cumsum(step)
