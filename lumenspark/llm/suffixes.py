"""Repeated byte strings across documents by a sparse, range-partitioned suffix sort.

A byte is removed if a string of ``width`` bytes that covers it also starts in a document with a
smaller doc_id.  Sorting every suffix would move many times the input, so only suffixes at anchors
are sorted: in each window of ``width`` bytes the anchor is the place of the least hash among its
GRAM-byte strings (the leftmost of equals).  Equal windows have their anchor at the same place, so
two equal windows always meet at one anchor's suffixes.  Neighbouring windows share anchors: about
one suffix in fourteen is left.  The bytes that all windows of one anchor cover are its segment.

1.  Documents are dealt to chunks.  A chunk sends the keys of its anchors (the suffix's four leading bytes,
    then a hash of the gram), each once, to ranges between splitters sampled from the keys.  The ranges
    answer which keys occur in several documents; three quarters of the suffixes end here.
2.  Of those keys a chunk sends the segments themselves, equal ones once with the least doc_id, so a
    passage that a third of all documents share sends one entry for each chunk.  A range sorts them by
    multikey quicksort on tokens of eight bytes, to the right of the anchor and then to its left: the next
    token is looked at only among ties.  Equal neighbours are repeats as a whole.  Where one gram has
    several segments, their windows are sorted in the same way, which finds matches that end in between.
    Splitters never part equal keys, so a comparison across the edge of a range has nothing to find.
3.  A key with very many segments (a common phrase amid other words) is not compared in one range: its
    windows are dealt by their own bytes, equal ones of a chunk once.
4.  Each chunk finds its removed bytes from what it was told and from its own documents.

Hashes choose anchors and ranges and rule keys out; what is removed is decided on bytes alone.

Rows: a null text counts as empty; a null doc_id counts as 2**63 - 1, the largest; rows that share a
doc_id do not make each other repeats, so many rows equal in id and text are looked at as one; texts shorter than ``width`` are kept; columns in ``carry``
are handed through, others are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only, saved, shuffle_partitions
from lumenspark.llm.components import SALTS
from lumenspark.llm.textbytes import BLANK_SEPARATED, FIRST, MOST_SPAN, PIECE, Spans, byte_values, eights, mix, ragged, utf8

GRAM = 24
#: Bytes of text in a chunk, and of anchors in a range, about.
CHUNK_BYTES, RANGE_BYTES = 2 << 20, 64 << 20
#: Groups of rows equal in id and text with more than one row in so many are looked at as one row.
OFTEN = 10_000
#: Segments of one key beyond which its windows are dealt by their own bytes, and windows that are sorted at once.
HOT, WINDOWS = 20_000, 400_000
_VALUES = byte_values(9)
_LAST = np.iinfo(np.int64).max
_PLACE = np.uint64((1 << 20) - 1)


def planes(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, all bytes of one significance together: sorted and small numbers then compress well."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def from_planes(data: bytes, columns: int) -> list[np.ndarray]:
    n = len(data) // (8 * columns)
    flat = np.frombuffer(data, np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.uint64).reshape(n) for c in flat]


def sort_by(*columns: np.ndarray) -> np.ndarray:
    """An order by several keys: each next key is looked at only where all before it are equal."""
    order = np.argsort(columns[0], kind="stable")
    group = np.zeros(len(order), np.int64)
    if len(order) > 1:
        group[1:] = np.cumsum(columns[0][order][1:] != columns[0][order][:-1])
    for column in columns[1:]:
        size = np.bincount(group, minlength=1)[group] if len(group) else group
        tied = np.flatnonzero(size > 1)
        if not len(tied):
            break
        inner = np.lexsort((column[order[tied]], group[tied]))
        order[tied] = order[tied][inner]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        now = column[order]
        new[tied[1:]] |= now[tied[1:]] != now[tied[1:] - 1]
        group = np.cumsum(new) - 1
    return order


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of a width, by doubling."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _ordered(table: pa.Table) -> pa.Table:
    """The rows of a chunk in the same order in every pass, whatever order the shuffle gave; rows that tie are equal in id and text."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


class Anchored:
    """Anchors of the windows of a chunk's texts: key, segment hash, doc_id, first and last window start, place."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.data, self.offsets = utf8(table.column("text"))
        self.ids = np.array([_LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        columns = [[], [], [], [], [], []]
        at, end = int(self.offsets[0]), int(self.offsets[-1])
        while at < end:
            to = min(at + PIECE, end)
            part = self.data[at : min(to + width - 1, end)]
            if len(part) >= width:
                for out, got in zip(columns, self._piece(part, at, to), strict=True):
                    out.append(got)
            at = to
        kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)
        self.key, self.segment, self.doc, self.low, self.high, self.place = [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, kinds, strict=True)]

    def _piece(self, part: np.ndarray, at: int, to: int):
        spans = Spans(_VALUES[part])
        grams = spans.hash_all(GRAM)
        least = _least((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), self.width - GRAM + 1)
        place = (least & _PLACE).astype(np.int64)[: to - at]
        valid = np.ones(len(place) + 1, bool)
        valid[-1] = False
        first = int(np.searchsorted(self.offsets, at, "right"))
        last = int(np.searchsorted(self.offsets, to + self.width, "left"))
        for e in (self.offsets[first : last + 1] - at).tolist():
            if e - self.width + 1 < len(place):
                valid[max(0, e - self.width + 1) : max(0, e)] = False
        change = np.ones(len(place) + 1, bool)
        change[1:-1] = (place[1:] != place[:-1]) | (valid[1:-1] != valid[:-2])
        runs = np.flatnonzero(change)
        low, high = runs[:-1], runs[1:] - 1
        used = valid[low]
        low, high = low[used], high[used]
        p = place[low]
        lead = np.zeros(len(p), np.uint64)
        for i in range(4):
            lead = (lead << np.uint64(8)) | part[p + i]
        key = (lead << np.uint64(32)) | (grams[p] >> np.uint64(32))
        doc = self.ids[np.searchsorted(self.offsets, low + at, "right") - 1]
        return key, spans.hash(low, high + self.width), doc, low + at, high + at, p + at

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The order by key, segment and doc_id, and in it the first of each distinct segment (the same in all runs of a chunk)."""
        order = sort_by(self.key, self.segment, self.doc)
        k, s = self.key[order], self.segment[order]
        same = np.flatnonzero((k[1:] == k[:-1]) & (s[1:] == s[:-1])) + 1
        if len(same) and not _equal(self.data, self.low[order[same]], self.low[order[same - 1]], self.size(order[same]), self.size(order[same - 1])).all():
            return self._distinct_by_bytes(order, same)
        first = np.ones(len(order), bool)
        first[same] = False
        return order, first

    def _distinct_by_bytes(self, order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where different segments have equal hashes."""
        tie, tied = np.zeros(len(order), np.int64), order[np.union1d(same, same - 1)]
        texts = [self.data[self.low[i] : self.low[i] + n].tobytes() for i, n in zip(tied.tolist(), self.size(tied).tolist(), strict=True)]
        rank = {t: r for r, t in enumerate(sorted(set(texts)), 1)}
        tie[tied] = [rank[t] for t in texts]
        order = sort_by(self.key, self.segment, tie, self.doc)
        return order, _first_of(self.key[order], self.segment[order], tie[order])[0]

    def size(self, runs: np.ndarray) -> np.ndarray:
        """Bytes of the segments of some anchors."""
        return self.high[runs] - self.low[runs] + self.width

    def answered(self, order: np.ndarray, first: np.ndarray, splitters: np.ndarray, told: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each place in the order: whether its key occurs in several documents, and whether it has very many segments."""
        heads = _first_of(self.key[order])[0]
        keys = self.key[order][heads]
        several, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for part, a, b in _parts(keys, splitters):
            if part in told:
                bits = np.unpackbits(np.frombuffer(told[part], np.uint8), count=2 * (b - a)).astype(bool)
                several[a:b], hot[a:b] = bits[: b - a], bits[b - a :]
        of = np.cumsum(heads) - 1
        return several[of] & ~hot[of], hot[of]


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether spans of data at a (of n bytes) and b (of m bytes) are equal."""
    out = n == m
    at = eights(np.concatenate([data, np.zeros(16, np.uint8)]))
    left = np.where(out, n, 0)
    for k in range(0, int(left.max(initial=0)), 8):
        some = np.flatnonzero(left > k)
        out[some] &= (at[a[some] + k] ^ at[b[some] + k]) & FIRST[np.minimum(left[some] - k, 8)] == 0
    return out


def _tokens(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """The eight-byte tokens of spans, as numbers in the order of bytes; a span's end counts as zeros."""
    at = eights(np.concatenate([data, np.zeros(16, np.uint8)]))
    out = []
    for k in range(0, most, 8):
        left = np.clip(size - k, 0, 8)
        out.append((at[np.minimum(start + k, len(data))] & FIRST[left]).byteswap())
    return out


def _parts(sorted_keys: np.ndarray, splitters: np.ndarray):
    """(range, from, to) of sorted keys, for ranges that hold any."""
    edges = [0, *np.searchsorted(sorted_keys, splitters).tolist(), len(sorted_keys)]
    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            yield part, a, b


def _rows(chunk, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(parts), pa.int64()), "part": pa.array([p for p, _ in parts], pa.int32()), "data": pa.array([d for _, d in parts], pa.binary())})


def _blobs(told: pa.Table) -> dict[int, bytes]:
    return dict(zip(told.column("part").to_pylist(), told.column("data").to_pylist(), strict=True))


def _sampled(width: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((Anchored(pa.Table.from_batches([batch]), width).key >> np.uint64(1)).astype(np.int64))], names=["key"])

    return run


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In sorted columns: whether a row starts a group, and the group's first row for each row."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new, np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)


def _send_keys(width: int, splitters: np.ndarray):
    """Each key of a chunk once, with its number of segments (127 at most) and whether several documents have it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = Anchored(_ordered(table), width)
        order, first = found.distinct()
        if not len(order):
            return _rows(None, [])
        keys, doc = found.key[order], found.doc[order]
        start = np.flatnonzero(_first_of(keys)[0])
        segments = np.minimum(np.add.reduceat(first.astype(np.int64), start), 127)
        mixed = np.maximum.reduceat(doc, start) != np.minimum.reduceat(doc, start)
        keys, info = keys[start], (2 * segments + mixed).astype(np.uint8)
        return _rows(key[0].as_py(), [(p, planes(keys[a:b]) + info[a:b].tobytes()) for p, a, b in _parts(keys, splitters)])

    return run


def _compare_keys(hot: int):
    """One range of keys: tell each chunk, by bits in the order of its keys, which occur in several documents, and which are hot."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blobs = table.column("data").to_pylist()
        size = [len(d) // 9 for d in blobs]
        keys = np.concatenate([from_planes(d[: 8 * n], 1)[0] for d, n in zip(blobs, size, strict=True)])
        info = np.concatenate([np.frombuffer(d, np.uint8, n, 8 * n) for d, n in zip(blobs, size, strict=True)])
        order = np.argsort(keys, kind="stable")
        start = np.flatnonzero(_first_of(keys[order])[0])
        n = np.diff(np.append(start, len(order)))
        several = np.empty(len(order), bool)
        many = np.empty(len(order), bool)
        several[order] = np.repeat((n > 1) | (np.maximum.reduceat(info[order] & 1, start) > 0), n)
        many[order] = np.repeat(np.add.reduceat((info[order] >> 1).astype(np.int64), start) > hot, n)
        edges = np.concatenate([[0], np.cumsum(size)]).tolist()
        out = [_rows(c, [(key[0].as_py(), np.packbits(np.concatenate([several[a:b], many[a:b]])).tobytes())]) for c, a, b in zip(table.column("chunk").to_pylist(), edges[:-1], edges[1:], strict=True) if several[a:b].any()]
        return pa.concat_tables(out) if out else _rows(None, [])

    return run


def _send_segments(width: int, splitters: np.ndarray, ranges: int):
    """Distinct segments of the keys that occur in several documents (doc_id, bytes before the anchor, windows, bytes), and windows of those with hot keys, to ranges named -1, -2, ..."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows or not table.num_rows:
            return _rows(None, [])
        found = Anchored(_ordered(table), width)
        order, first = found.distinct()
        several, hot = found.answered(order, first, splitters, _blobs(told))
        parts = []
        if hot.any():
            w = _HotWindows(found, order, first, hot, ranges)
            parts += [(-1 - p, planes(w.doc[a:b]) + found.data[ragged(w.start[a:b], np.full(b - a, width))].tobytes()) for p, a, b in zip(*_groups(w.part), strict=True)]
        order = order[first & several]
        for p, a, b in _parts(found.key[order], splitters):
            some = order[a:b]
            size = found.size(some)
            left, n = (found.place - found.low)[some].astype(np.uint8), (size - width + 1).astype(np.uint8)
            parts.append((p, np.int64(len(some)).tobytes() + planes(found.doc[some]) + left.tobytes() + n.tobytes() + found.data[ragged(found.low[some], size)].tobytes()))
        return _rows(key[0].as_py(), parts)

    return run


class _Segments:
    """Segments that were sent to one range."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        blobs = table.column("data").to_pylist()
        size = [int(np.frombuffer(d, np.int64, 1)[0]) for d in blobs]
        self.doc = np.concatenate([from_planes(d[8 : 8 + 8 * n], 1)[0] for d, n in zip(blobs, size, strict=True)]).view(np.int64)
        self.left = np.concatenate([np.frombuffer(d, np.uint8, n, 8 + 8 * n) for d, n in zip(blobs, size, strict=True)]).astype(np.int64)
        self.windows = np.concatenate([np.frombuffer(d, np.uint8, n, 8 + 9 * n) for d, n in zip(blobs, size, strict=True)]).astype(np.int64)
        self.data = np.concatenate([np.frombuffer(d, np.uint8, -1, 8 + 10 * n) for d, n in zip(blobs, size, strict=True)])
        self.chunk = np.repeat(np.array(table.column("chunk").to_pylist(), np.int64), size)
        self.index = np.concatenate([np.arange(n) for n in size])
        self.length = self.windows + width - 1
        self.start = np.cumsum(self.length) - self.length

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by the bytes from the anchor on, then by those before it, then by doc_id; where a gram starts in it, and where a segment does."""
        right, most = self.length - self.left, self.width - GRAM
        tokens = _tokens(self.data, self.start + self.left, right, int(right.max()))
        # equal lengths to the right and left leave no doubt about what the zeros at an end mean
        before = _tokens(self.data, self.start, self.left, most) if self.left.any() else []
        columns = [*tokens, right, *before, self.left]
        order = sort_by(*columns, self.doc)
        gram = _first_of(*[c[order] for c in tokens[: GRAM // 8]])[0]
        return order, gram, _first_of(*[c[order] for c in columns])[0]


def _least_docs(data: np.ndarray, start: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For each window of data, the least doc_id of those with equal bytes."""
    tokens = _tokens(data, start, np.full(len(start), width), width)
    order = sort_by(*tokens, doc)
    out = np.empty(len(order), np.int64)
    out[order] = doc[order][_first_of(*[t[order] for t in tokens])[1]]
    return out


def _runs(mask: np.ndarray, owner: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Runs of marked windows (owner, first, last) packed as owner << 16 | first << 8 | last."""
    if not mask.any():
        return np.zeros(0, np.uint64)
    owner, number = owner[mask], number[mask]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(owner)) - 1
    return (owner[begin].astype(np.uint64) << np.uint64(16)) | (number[begin].astype(np.uint64) << np.uint64(8)) | number[end].astype(np.uint64)


def _compare_segments(width: int):
    """One range of suffixes: tell chunks which windows of their segments occur in a document with a smaller doc_id."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _compare_hot_windows(key[0].as_py(), table, width)
        s = _Segments(table, width)
        order, gram, new = s.sorted()
        doc = s.doc[order]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        whole = doc > doc[first]
        # grams with several segments and several documents
        begin = np.flatnonzero(gram)
        n = np.diff(np.append(begin, len(order)))
        mixed = np.repeat((np.add.reduceat(new.astype(np.int64), begin) > 1) & (np.maximum.reduceat(doc, begin) != np.minimum.reduceat(doc, begin)), n)
        told = [(order[whole], (s.index[order[whole]].astype(np.uint64) << np.uint64(16)) | (s.windows[order[whole]] - 1).astype(np.uint64))]
        heads = np.flatnonzero(new & mixed)
        if len(heads):
            windows = s.windows[order[heads]]
            group = (np.cumsum(gram) - 1)[heads]
            # slices of whole grams with about WINDOWS windows
            total = np.cumsum(windows)
            edges, at = [0], 0
            while at < len(heads):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + WINDOWS, "right")))
                to = int(np.searchsorted(group, group[to - 1], "right"))
                edges.append(to)
                at = to
            # rows of other chunks that share the least doc_id of their segment are looked at too
            same = np.flatnonzero(mixed & ~whole)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some, m = order[heads[a:b]], windows[a:b]
                least = _least_docs(s.data, ragged(s.start[some], m), np.repeat(s.doc[some], m), width)
                rows = same[np.searchsorted(same, heads[a]) : np.searchsorted(same, heads[b] if b < len(heads) else len(order))]
                of = np.searchsorted(heads[a:b], rows, "right") - 1
                offset = np.cumsum(m) - m
                count = m[of]
                mask = least[ragged(offset[of], count)] < np.repeat(doc[rows], count)
                if mask.any():
                    packed = _runs(mask, np.repeat(np.arange(len(rows)), count), ragged(np.zeros(len(rows), np.int64), count))
                    owner = order[rows][(packed >> np.uint64(16)).astype(np.int64)]
                    told.append((owner, (s.index[owner].astype(np.uint64) << np.uint64(16)) | (packed & np.uint64(0xFFFF))))
        entry, packed = np.concatenate([e for e, _ in told]), np.concatenate([p for _, p in told])
        chunk = s.chunk[entry]
        order = sort_by(chunk, packed)
        chunk, packed = chunk[order], packed[order]
        out = [_rows(int(c), [(key[0].as_py(), planes(packed[a:b]))]) for c, a, b in zip(*_groups(chunk), strict=True)]
        return pa.concat_tables(out) if out else _rows(None, [])

    return run


def _groups(values: np.ndarray) -> tuple[list, list, list]:
    """Distinct values of a sorted array, and where each begins and ends."""
    some, at = np.unique(values, return_index=True)
    return some.tolist(), at.tolist(), [*at[1:].tolist(), len(values)] if len(values) else []


class _HotWindows:
    """Windows of a chunk's segments with hot keys: distinct ones by their bytes, dealt to ranges by a hash of these."""

    def __init__(self, found: Anchored, order: np.ndarray, first: np.ndarray, hot: np.ndarray, ranges: int):
        self.segments = order[first & hot]
        n = found.high[self.segments] - found.low[self.segments] + 1
        start = ragged(found.low[self.segments], n)
        doc = np.repeat(found.doc[self.segments], n)
        tokens = _tokens(found.data, start, np.full(len(start), found.width), found.width)
        mixed = np.zeros(len(start), np.uint64)
        for t in tokens:
            mixed = mix((mixed ^ t) + np.uint64(1))
        part = (mixed % np.uint64(ranges)).astype(np.int64)
        by = sort_by(part, *tokens, doc)
        new, head = _first_of(part[by], *[t[by] for t in tokens])
        self.begin = np.cumsum(n) - n
        #: of each window (of a segment, in order): its number among the distinct ones; of each distinct one: place, least doc_id, range
        self.number = np.empty(len(by), np.int64)
        self.number[by] = np.cumsum(new) - 1
        self.start, self.doc, self.part = start[by][new], doc[by][new], part[by][new]


def _compare_hot_windows(part: int, table: pa.Table, width: int) -> pa.Table:
    """One range of windows: tell each chunk, by a bit for each of its windows, which a document with a smaller doc_id has."""
    blobs = table.column("data").to_pylist()
    size = [len(d) // (8 + width) for d in blobs]
    doc = np.concatenate([from_planes(d[: 8 * n], 1)[0] for d, n in zip(blobs, size, strict=True)]).view(np.int64)
    data = np.concatenate([np.frombuffer(d, np.uint8, -1, 8 * n) for d, n in zip(blobs, size, strict=True)])
    later = _least_docs(data, np.arange(len(doc)) * width, doc, width) < doc
    edges = np.concatenate([[0], np.cumsum(size)]).tolist()
    return pa.concat_tables([_rows(c, [(part, np.packbits(later[a:b]).tobytes())]) for c, a, b in zip(table.column("chunk").to_pylist(), edges[:-1], edges[1:], strict=True)])


def _words(text: np.ndarray) -> int:
    """Runs of bytes other than ASCII white space."""
    inside = BLANK_SEPARATED.word[text]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def _removed(found: Anchored, splitters: np.ndarray, answers: dict[int, bytes], told: dict[int, bytes], ranges: int) -> np.ndarray:
    """Which bytes of a chunk are covered by a window that a document with a smaller doc_id has."""
    width = found.width
    depth = np.zeros(len(found.data) + 1, np.int32)

    def cover(start: np.ndarray, stop: np.ndarray) -> None:
        np.add.at(depth, start, 1)
        np.add.at(depth, stop, -1)

    order, first = found.distinct()
    if len(order):
        segment = np.cumsum(first) - 1
        least = found.doc[order][first]
        later = found.doc[order] > least[segment]
        cover(found.low[order[later]], found.high[order[later]] + width)
        several, hot = found.answered(order, first, splitters, answers)
        begin = np.flatnonzero(first)  # of each segment, in the order
        stop = np.append(begin[1:], len(order))
        sent = np.flatnonzero((first & several)[begin])
        for part, a, b in _parts(found.key[order[begin[sent]]], splitters):
            if part in told:
                packed = from_planes(told[part], 1)[0]
                of = sent[a:b][(packed >> np.uint64(16)).astype(np.int64)]
                # all rows of the segment: those of later documents are covered anyhow
                count = stop[of] - begin[of]
                rows = order[ragged(begin[of], count)]
                cover(found.low[rows] + np.repeat(((packed >> np.uint64(8)) & np.uint64(255)).astype(np.int64), count), found.low[rows] + np.repeat((packed & np.uint64(255)).astype(np.int64), count) + width)
        if hot.any():
            w = _HotWindows(found, order, first, hot, ranges)
            gone = np.zeros(len(w.start), bool)
            for p, a, b in zip(*_groups(w.part), strict=True):
                if -1 - p in told:
                    gone[a:b] = np.unpackbits(np.frombuffer(told[-1 - p], np.uint8), count=b - a).astype(bool)
            number = np.flatnonzero((first & hot)[begin])
            count = stop[number] - begin[number]
            rows = order[ragged(begin[number], count)]
            windows = found.high[rows] - found.low[rows] + 1
            at = w.number[ragged(np.repeat(w.begin, count), windows)]
            mask = gone[at] | (np.repeat(found.doc[rows], windows) > w.doc[at])
            start = ragged(found.low[rows], windows)[mask]
            cover(start, start + width)
    return np.cumsum(depth[:-1]) > 0


def _remove(width: int, least_words: int, filler: bytes, whole: bool, splitters: np.ndarray, ranges: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, told: pa.Table) -> pa.Table:
        table = _ordered(table)
        found = Anchored(table, width)
        answers = _blobs(told.filter(pc.equal(told.column("kind"), 0)))
        removed = _removed(found, splitters, answers, _blobs(told.filter(pc.equal(told.column("kind"), 1))), ranges)
        kept, spans = [], []
        for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
            text, mask = found.data[a:b], removed[a:b]
            runs, parts, at = [], [], 0
            if mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                for s, e in edge.reshape(-1, 2).tolist():
                    if not least_words or _words(text[s:e]) >= least_words:
                        while whole and s > at and text[s] & 0xC0 == 0x80:
                            s -= 1
                        while whole and e < b - a and text[e] & 0xC0 == 0x80:
                            e += 1
                        runs.append({"start": s, "length": e - s})
                        parts.append(text[at:s].tobytes())
                        at = e
            kept.append(filler.join(x for x in (*parts, text[at:].tobytes()) if x))
            spans.append(runs)
        return pa.table({"doc_id": table.column("doc_id"), "carried": table.column("carried"), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))})

    return run


def _as_one(docs: DataFrame, often: DataFrame, width: int, more: dict) -> DataFrame:
    """The same where some rows are equal in id and text very often: one of each group is looked at for all of them."""
    names = ["doc_id", "text", *more["carry"]]
    # the text's SHA-256, and whether it is null
    rows = only(docs, *names).withColumn("_sha", F.concat(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)), F.when(F.col("text").isNull(), F.lit(b"0")).otherwise(F.lit(b"1"))))
    marked = rows.join(F.broadcast(often), F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left").withColumn("_many", F.col("h").isNotNull())
    one = marked.where("_many").groupBy("doc_id", "_sha").agg(F.first("text").alias("text"))
    filled = [F.lit(None).cast(marked.schema[c].dataType).alias(c) for c in more["carry"]]
    looked = marked.where("not _many").select(*names, F.lit(None).cast("binary").alias("_sha")).union(one.select("doc_id", "text", *filled, "_sha"))
    found = saved(repeated_spans(looked, width, **(more | {"carry": (*more["carry"], "_sha")}), least_copies=_LAST))
    carried = F.struct(*[F.col(f"carried.`{c}`") for c in more["carry"]]) if more["carry"] else F.struct(F.lit(None).cast("int").alias("none"))
    out = lambda df: df.select("doc_id", carried.alias("carried"), "kept", "spans")
    # all copies, which meet the result of their group in several places
    told = found.where("carried._sha is not null").select(F.col("doc_id").alias("d"), F.col("carried._sha").alias("s"), "kept", "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = F.struct(*[F.col(f"`{c}`") for c in more["carry"]]) if more["carry"] else F.struct(F.lit(None).cast("int").alias("none"))
    copies = marked.where("_many").select("doc_id", "_sha", own.alias("carried"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("_salt"))
    met = copies.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_sha") == F.col("s")) & (F.col("_salt") == F.col("salt")))
    return out(found.where("carried._sha is null")).union(met.select("doc_id", "carried", "kept", "spans"))


def repeated_spans(docs: DataFrame, width: int = 50, carry: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES, least_words: int = 0, filler: bytes = b"", whole_characters: bool = False, hot: int = HOT, least_copies: int = 1000) -> DataFrame:
    """(doc_id, text, carry...) -> (doc_id, carried struct, kept binary, spans array of (start, length) removed).

    A maximal run of repeated bytes stays if it has fewer than least_words words; filler joins what is kept
    around a run that goes; with whole_characters a run takes the whole of a character that it parts.
    """
    if not GRAM + 2 <= width <= MOST_SPAN // 2:
        raise ValueError(f"width must be from {GRAM + 2} to {MOST_SPAN // 2} bytes")
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # groups of rows equal in id and text that no chunk should hold: OFTEN at most
    copies = docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") > max(least_copies, size.n // OFTEN))
    often = copies.collect()
    more = {"carry": carry, "chunk_bytes": chunk_bytes, "least_words": least_words, "filler": filler, "whole_characters": whole_characters, "hot": hot}
    if often:
        return _as_one(docs, spark.createDataFrame([(r.doc_id, r.h) for r in often], "d long, h long"), width, more)
    n, total = shuffle_partitions(spark), size.bytes or 0
    chunks = max(n, -(-total // chunk_bytes))
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    dealt = docs.select("doc_id", "text", carried.alias("carried"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))

    # splitters: keys of a bounded sample of documents, about 200 for each range
    ranges = max(n, -(-total * 24 // (14 * RANGE_BYTES)))
    share = min(1.0, ranges * 200 * 14 / max(total, 1))
    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", F.lit("splitters")), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    points = map_batches(sample, _sampled(width), "key long").agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    splitters = np.unique(np.array(points or [], np.int64)).astype(np.uint64) << np.uint64(1)

    schema = "chunk long, part int, data binary"
    # one plan, so that the texts' exchange by chunk serves all passes
    answers = dealt.groupBy("chunk").applyInArrow(_send_keys(width, splitters), schema).groupBy("part").applyInArrow(_compare_keys(hot), schema)
    sent = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send_segments(width, splitters, ranges), schema)
    told = sent.groupBy("part").applyInArrow(_compare_segments(width), schema)
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in dealt.schema["carried"].dataType.fields)
    out = f"doc_id long, carried struct<{kinds}>, kept binary, spans array<struct<start: long, length: long>>"
    all_told = answers.withColumn("kind", F.lit(0)).union(told.withColumn("kind", F.lit(1)))
    return dealt.groupBy("chunk").cogroup(all_told.groupBy("chunk")).applyInArrow(_remove(width, least_words, filler, whole_characters, splitters, ranges), out)
