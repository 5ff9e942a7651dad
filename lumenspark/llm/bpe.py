"""BPE encoding by content-defined chunks that are shared across documents, and decoding.

A rolling hash of the last bytes cuts a text where its content says so, so that a passage which stands in
many documents gives the same chunks in all of them.  A worker encodes each distinct chunk once and keeps
its ids with the places where pretokens start (named by the chunk's whole bytes, in bounded memory).

Ids of a text are those of its chunks, but near the joins.  Splitting goes from left to right and looks at
most LOOK bytes ahead, so the pretokens of a chunk that start LOOK bytes or more before its end are those
of the text, if one of them is; and once a pretoken of the text starts where one of the next chunk's own
does, both agree from there on.  At each join the text from the last sure start on is encoded again, some
pretokens into the next chunk, until such a start is found.  Where there is none (one long word over the
cut, say), or where two repairs would meet, the chunks at the join are encoded again as one, and its own
joins are repaired in their turn, until all agree.

Rows: a null or empty text has no ids and decodes to the empty text; special strings in texts become their
ids, as is the tokenizer library's default; repeated rows and null ids are kept as they are; extra columns
are ignored.  No shuffle is needed.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenspark.llm.common import map_batches, only
from lumenspark.llm.textbytes import Spans, byte_values
from lumenspark.llm.transducer import Encoder, batches_of_texts, byte_letters, encoder

#: Bytes under the rolling hash, bits of it that are zero at a cut, and least and most bytes of a chunk.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 128, 4096
#: Bytes that the splitting may look ahead, and pretokens of the next chunk that a repair takes at first.
LOOK, AHEAD = 8, 6
#: Bytes of the chunks that a worker keeps before it starts anew.
KEPT_BYTES = 24 << 20
#: Bytes that are cut at once.
_PIECE = 1 << 19
_VALUES = byte_values(31)


def cuts(data: np.ndarray, window: int = WINDOW, bits: int = CUT_BITS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Where the chunks of a text's bytes start and end: places between characters, by content; only where content gives none for long, by distance."""
    n = len(data)
    found = []
    for at in range(0, max(n - window, 0) + 1, _PIECE):
        part = data[at : at + _PIECE + window - 1]
        if len(part) >= window:
            found.append(np.flatnonzero(Spans(_VALUES[part]).hash_all(window)[:_PIECE] >> np.uint64(64 - bits) == 0) + at + window)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    places = places[np.diff(places, prepend=-least) >= least]  # none of those that crowd, seen from the text alone
    inside = np.append((data & 0xC0) == 0x80, [False] * 4)  # bytes amid a character
    edges = np.unique(np.concatenate([[0], _to_character(places, inside, n), [n]]))
    wide = np.flatnonzero(np.diff(edges) > most)
    if len(wide):
        more = np.concatenate([np.arange(edges[i] + most, edges[i + 1], most) for i in wide.tolist()])
        edges = np.unique(np.concatenate([edges, _to_character(more, inside, n)]))
    return edges


def _to_character(places: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """Places moved on to where a character starts, if that is before the end."""
    for _ in range(3):
        places = places + inside[places]
    return places[places < n]


class Chunk:
    """Ids of a chunk encoded alone, the bytes at which its pretokens start, and the number of ids before each (and after the last)."""

    __slots__ = ("ids", "starts", "token", "size")

    def __init__(self, ids: np.ndarray, starts: np.ndarray, token: np.ndarray, size: int):
        self.ids, self.starts, self.token, self.size = ids, starts, token, size

    def before(self, place: int) -> int:
        """Ids before the pretoken that starts at a place."""
        return int(self.token[np.searchsorted(self.starts, place)])


class ChunkEncoder:
    """Ids of texts by shared chunks; one for each worker process."""

    def __init__(self, machine: Encoder, **sizes: int):
        self.machine, self.sizes = machine, sizes
        self.kept: dict[bytes, Chunk] = {}
        self.kept_bytes = 0
        #: Chunks met, encoded, and joined with another as no start agreed.
        self.met = self.encoded = self.joined = 0

    def _encode(self, parts: list[bytes]) -> list[Chunk]:
        """Chunks of some stretches of bytes, each encoded alone."""
        if not parts:
            return []
        starts, rows, ids, token, first = self.machine.pretokens([p.decode() for p in parts])
        self.encoded += len(parts)
        out = []
        for p, a, b, c, d in zip(parts, rows[:-1].tolist(), rows[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            out.append(Chunk(ids[c:d].copy(), starts[a:b].astype(np.int32), (token[a : b + 1] - c).astype(np.int32), len(p)))
        return out

    def _chunks(self, parts: list[bytes]) -> list[Chunk]:
        """The same, by what is kept from other documents."""
        if self.kept_bytes > KEPT_BYTES:
            self.kept, self.kept_bytes = {}, 0
        new = [p for p in dict.fromkeys(parts) if p not in self.kept]
        self.met += len(parts)
        self.kept.update(zip(new, self._encode(new), strict=True))
        self.kept_bytes += sum(map(len, new))
        return [self.kept[p] for p in parts]

    def _repair(self, texts: list[bytes], edges: list[list[int]], chunks: list[list[Chunk]]) -> list[list[np.ndarray] | None]:
        """For each text the parts of its ids, if all of its joins agree; else None, and chunks at joins without agreement are one."""
        windows, of = [], []
        for t, (text, at, some) in enumerate(zip(texts, edges, chunks, strict=True)):
            for k in range(len(some) - 1):
                left, right = some[k], some[k + 1]
                place = int(np.searchsorted(left.starts, left.size - LOOK, "right")) - 1
                s = int(left.starts[max(place, 0)])
                e = int(right.starts[AHEAD]) if len(right.starts) > AHEAD else right.size
                windows.append(text[at[k] + s : at[k + 1] + e])
                of.append((t, k, s, e))
        again = self._encode(windows)
        found: list[dict[int, tuple[int, int, np.ndarray]]] = [{} for _ in texts]
        for (t, k, s, e), w in zip(of, again, strict=True):
            join = chunks[t][k].size - s
            own = chunks[t][k + 1].starts
            last = edges[t][k + 1] + e == len(texts[t])
            place = int(np.searchsorted(w.starts, join))
            for i in range(place, len(w.starts)):
                p = int(w.starts[i])
                if p > w.size - LOOK and not last:
                    break
                j = int(np.searchsorted(own, p - join))
                if j < len(own) and own[j] == p - join:
                    found[t][k] = (s, p - join, w.ids[: w.token[i]])
                    break
            else:
                if last:  # the window runs to the end of the text
                    found[t][k] = (s, chunks[t][k + 1].size, w.ids)
        out = []
        for t, some in enumerate(chunks):
            parts, begin, agreed = [], 0, [True] * (len(some) - 1)
            for k in range(len(some) - 1):
                got = found[t].get(k)
                if got is None or got[0] < begin or (got[1] == some[k + 1].size and k + 2 < len(some)):
                    agreed[k] = False
                    begin = 0
                    continue
                s, p, ids = got
                a = some[k].before(begin) if begin < some[k].size else len(some[k].ids)
                parts += [some[k].ids[a : some[k].before(s)], ids]
                begin = p
            if all(agreed):
                parts.append(some[-1].ids[some[-1].before(begin) :] if begin < some[-1].size else some[-1].ids[:0])
                out.append(parts)
                continue
            out.append(None)
            keep = [0, *[k + 1 for k, ok in enumerate(agreed) if ok], len(some)]
            merged = [(a, b) for a, b in zip(keep[:-1], keep[1:], strict=True)]
            wide = [(a, b) for a, b in merged if b - a > 1]
            self.joined += sum(b - a - 1 for a, b in wide)
            made = dict(zip(wide, self._encode([texts[t][edges[t][a] : edges[t][b]] for a, b in wide]), strict=True))
            chunks[t] = [made.get((a, b)) or some[a] for a, b in merged]
            edges[t] = [edges[t][a] for a, _ in merged] + [edges[t][-1]]
        return out

    def stretches(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts without special strings."""
        data = [t.encode() for t in texts]
        edges = [cuts(np.frombuffer(d, np.uint8), **self.sizes).tolist() if d else [0] for d in data]
        flat = self._chunks([d[a:b] for d, at in zip(data, edges, strict=True) for a, b in zip(at[:-1], at[1:], strict=True)])
        chunks, at = [], 0
        for e in edges:
            chunks.append(flat[at : at + len(e) - 1])
            at += len(e) - 1
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(data)
        todo = [i for i, d in enumerate(data) if d]
        while todo:
            some_edges, some_chunks = [edges[i] for i in todo], [chunks[i] for i in todo]
            left = []
            for n, (i, parts) in enumerate(zip(todo, self._repair([data[i] for i in todo], some_edges, some_chunks), strict=True)):
                if parts is None:
                    edges[i], chunks[i] = some_edges[n], some_chunks[n]
                    left.append(i)
                else:
                    out[i] = np.concatenate(parts)
            todo = left
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        cut = [self.machine.stretches(t) for t in texts]
        plain = iter(self.stretches([s for c in cut for s in c[::2]]))
        out = []
        for c in cut:
            parts = [next(plain) if k % 2 == 0 else np.array([self.machine.special[s]], np.uint32) for k, s in enumerate(c)]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        return out


@lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(encoder(path))


def _encode(path: str):
    def run(batches):
        machine = chunk_encoder(path)
        for batch in batches:
            at = 0
            for texts in batches_of_texts(batch.column("text")):
                ids = machine.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "ids"])
                at += len(texts)

    return run


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array of int); tokenizer: a byte-level BPE file with the same path everywhere."""
    return map_batches(only(docs, "doc_id", "text"), _encode(tokenizer), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


@lru_cache(maxsize=1)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token by its id, special tokens included; an id without a token has none."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    tokens = {i: t for t, i in rules["model"]["vocab"].items()} | {t["id"]: t["content"] for t in rules.get("added_tokens") or []}
    of = {chr(letter): byte for byte, letter in byte_letters().items()}
    out = [b""] * (max(tokens, default=-1) + 1)
    for i, t in tokens.items():
        out[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
    return out


def _decode(path: str):
    def run(batches):
        table = token_bytes(path)
        for batch in batches:
            texts = []
            for row in batch.column("ids"):
                ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int64)
                known = ids[(ids >= 0) & (ids < len(table))].astype(np.int64)
                texts.append(b"".join([table[i] for i in known.tolist()]).decode(errors="replace"))
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return run


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, text); ids unknown to the tokenizer give nothing, bytes that make no character U+FFFD."""
    return map_batches(only(rows, "doc_id", "ids"), _decode(tokenizer), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
