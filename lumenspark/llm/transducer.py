"""A byte-level BPE tokenizer as deterministic transducers.

The splitting pattern of the tokenizer becomes a deterministic transducer over character classes.
Its transitions say whether a pretoken ends before the character just read, or one character earlier
(a run of white space gives its last character back when a word follows).  The second
transducer walks the bytes of a pretoken; leaving it emits the tokens of that pretoken, so that the
transition carries their number.  Its states are named by the bytes read so far, whole, never by a hash
of them, and are compiled on demand, each distinct pretoken once in a worker process, from the
tokenizer's own library.

Text is cut into chunks of equal length, which start in unknown states.  All chunks are run at once
from every state, which gives each chunk a map from start state to end state; a parallel prefix scan
composes the maps, and with the true start states known, one more run emits the splits.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache

import numpy as np
import regex

from lumenspark.llm.textbytes import FIRST, eights, mix, ragged

CHUNK = 128
# Character classes: the end of a text, the apostrophe, the space, other white space, numbers, the
# letters of the contractions 's 't 'm 'd 're 've 'll by role, other letters, and all the rest.
END, APOSTROPHE, SPACE, BLANK, NUMBER, STMD, R, V, L, E, LETTER, OTHER = range(12)
_CLASSES = 12
_END_MARK = "\ud800"
#: Bytes of text in the states that a worker keeps before it starts anew, and the bits of its table of recent ones.
_MOST_BYTES, _RECENT = 32 << 20, 18
#: Characters that are run at once; a longer text is cut between pretokens.
_PIECE = 1 << 20
#: Bytes of the pretokens that the table of recent states holds; longer ones are looked up as strings.
_SHORT = 15

# States name what the open pretoken is.
_NAMES = ("start", "letters", "numbers", "others", "lone_quote", "quote_r", "quote_v", "quote_l", "contracted", "one_space", "one_blank", "blanks_space", "blanks_blank")
_STATE = {name: i for i, name in enumerate(_NAMES)}


def _transition(state: str, cls: int) -> tuple[str, int, int]:
    """(next state, a pretoken ends before this character, one ends before the character read last)."""
    if cls == END:
        return "start", 1, int(state.startswith("quote_"))
    letter = cls in (STMD, R, V, L, E, LETTER)
    opens = {APOSTROPHE: "lone_quote", SPACE: "one_space", BLANK: "one_blank", NUMBER: "numbers", OTHER: "others"}.get(cls, "letters")
    kind = "letters" if letter else "numbers" if cls == NUMBER else "others"
    if state == "letters":
        return (state, 0, 0) if letter else (opens, 1, 0)
    if state == "numbers":
        return (state, 0, 0) if cls == NUMBER else (opens, 1, 0)
    if state == "others":
        return (state, 0, 0) if cls in (OTHER, APOSTROPHE) else (opens, 1, 0)
    if state == "lone_quote":
        if cls == STMD:
            return "contracted", 0, 0
        if cls in (R, V, L):
            return {R: "quote_r", V: "quote_v", L: "quote_l"}[cls], 0, 0
        return ("others", 0, 0) if cls in (OTHER, APOSTROPHE) else (opens, 1, 0)
    if state in ("quote_r", "quote_v", "quote_l"):
        if cls == (L if state == "quote_l" else E):
            return "contracted", 0, 0
        # no contraction: the quote was a pretoken, and the letter after it opens the next
        return ("letters", 0, 1) if letter else (opens, 1, 1)
    if state == "contracted":
        return opens, 1, 0
    if state == "start":
        return opens, 0, 0
    if cls in (SPACE, BLANK):
        return ("blanks_space" if cls == SPACE else "blanks_blank"), 0, 0
    # a word after white space: a last space joins it; any other last blank stays alone
    joins = state in ("one_space", "blanks_space")
    ahead = int(state.startswith("blanks"))
    return (kind, 0, ahead) if joins else (opens, 1, ahead)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and the two marks as bits, of state * classes + class."""
    to, marks = np.zeros(len(_NAMES) * _CLASSES, np.int32), np.zeros(len(_NAMES) * _CLASSES, np.uint8)
    for (s, name), c in itertools.product(enumerate(_NAMES), range(_CLASSES)):
        nxt, here, ahead = _transition(name, c)
        to[s * _CLASSES + c] = _STATE[nxt] * _CLASSES
        marks[s * _CLASSES + c] = here + 2 * ahead
    return to, marks


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, as the library's own splitting takes it; U+D800, which no text holds, ends a text.

    The library splits the text of all code points in order: what it leaves together is of one class (but for a
    space before other characters), and one character of each stretch tells which.
    """
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out = np.full(0x110000, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for _, (start, stop) in split("".join(map(chr, range(low, high)))):
            start += low + (start + low == 0x20 and stop - start > 1)
            c = chr(start)
            if len(split("a" + c)) == 1:
                cls = LETTER
            elif len(split("1" + c)) == 1:
                cls = NUMBER
            else:
                cls = OTHER if len(split("!" + c)) == 1 else BLANK
            out[start : stop + low] = cls
    for characters, cls in (("'", APOSTROPHE), (" ", SPACE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in characters]] = cls
    out[ord(_END_MARK)] = END
    return out


def splits(classes: np.ndarray) -> np.ndarray:
    """Where pretokens start in a class sequence that ends with END, as a mask; END is one of its own."""
    to, marks = tables()
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.int32)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    # state maps of all chunks, from every state at once
    maps = np.repeat(np.arange(len(_NAMES), dtype=np.int32)[:, None] * _CLASSES, chunks, axis=1)
    for t in range(CHUNK):
        maps = to[maps + steps[t]]
        if t >= 24 and t % 8 == 0 and (maps == maps[0]).all():
            # every start has led to one state: from here on one run serves for all
            one = maps[0]
            for rest in range(t + 1, CHUNK):
                one = to[one + steps[rest]]
            maps = np.broadcast_to(one, maps.shape)
            break
    # inclusive scan: after round k a map covers 2**k chunks
    scan, reach = maps // _CLASSES, 1
    while reach < chunks:
        if (scan == scan[0]).all():
            break
        scan = np.concatenate([scan[:, :reach], np.take_along_axis(scan[:, reach:], scan[:, :-reach], axis=0)], axis=1)
        reach *= 2
    state = np.concatenate([[0], scan[0, :-1]]).astype(np.int32) * _CLASSES
    out = np.empty((CHUNK, chunks), np.uint8)
    for t in range(CHUNK):
        state += steps[t]
        out[t] = marks[state]
        state = to[state]
    flat = np.ascontiguousarray(out.T).reshape(-1)[:n]
    here = (flat & 1).astype(bool)
    here[:-1] |= flat[1:] > 1
    here[0] = True
    ends = np.flatnonzero(classes[:-1] == END) + 1
    here[ends] = True
    return here


def between_pretokens(text: str, limit: int = _PIECE):
    """A text in parts of about so many characters, each of whole pretokens; one pretoken is never cut."""
    classes = character_classes()
    at, reach = 0, limit
    while at + reach < len(text):
        points = np.frombuffer(text[at : at + reach].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = np.append(classes[points], np.uint8(END))
        # what follows the last character may still move a split to it, and what follows white space splits that
        starts = np.flatnonzero(splits(kinds)[1:-2] & (kinds[:-3] != SPACE) & (kinds[:-3] != BLANK))
        if not len(starts):
            reach *= 2
            continue
        to = int(starts[-1]) + 1
        yield text[at : at + to]
        at, reach = at + to, limit
    yield text[at:]


def check_rules(path: str, text: str) -> None:
    """Raise where a tokenizer file splits texts in another way than the transducer here does."""
    rules = json.loads(text)
    split = rules.get("pre_tokenizer") or {}
    plain = rules.get("model", {}).get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in rules.get("added_tokens") or [])
    if not (plain and added and rules.get("normalizer") is None and not rules.get("truncation") and not rules.get("padding")):
        raise ValueError(f"{path}: only byte-level BPE files with the usual splitting pattern, without a normalizer, are supported")


def byte_letters() -> dict[int, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return dict(zip(printable, printable, strict=True)) | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts by the transducers, for one tokenizer file; one for each worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            check_rules(path, file.read())
        self.library = Tokenizer.from_file(path)
        self.merge, self.letters = self.library.model.tokenize, byte_letters()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        # states in order of compilation: tokens of state i are ids[first[i] : first[i + 1]]
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        # the states' numbers by pretoken, their size, and a direct-mapped table of short ones met lately:
        # their bytes, with the length in the last byte, as two numbers
        self.number: dict[str, int] = {}
        self.size = 0
        self.recent, self.recent_number = np.zeros((1 << _RECENT, 2), np.uint64), np.zeros(1 << _RECENT, np.int64)

    def _learn(self, pretokens: list[str]) -> None:
        """Compile new states."""
        # the library's merging alone: its splitting of each pretoken would cost as much again
        encoded = [[t.id for t in self.merge(p.encode().decode("latin-1").translate(self.letters))] for p in pretokens]
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(counts.sum()))])
        self.number.update(zip(pretokens, range(len(self.first) - 1, len(self.first) - 1 + len(pretokens)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.size += sum(map(len, pretokens)) + 100 * len(pretokens)

    def _numbers(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray, text_of) -> np.ndarray:
        """Numbers of the states of the spans [start, stop) of data; text_of gives the pretokens at some of them."""
        size = stop - start
        at = eights(data)
        low = at[start] & FIRST[np.minimum(size, 8)]
        high = at[start + 8] & FIRST[np.clip(size - 8, 0, 8)]
        high |= size.astype(np.uint64) << np.uint64(56)
        slot = (mix(low ^ (high * np.uint64(0x9E3779B97F4A7C15))) & np.uint64((1 << _RECENT) - 1)).astype(np.int64)
        out = self.recent_number[slot]
        missed = np.flatnonzero((self.recent[slot, 0] != low) | (self.recent[slot, 1] != high) | (size > _SHORT))
        if len(missed):
            texts = text_of(missed)
            new = [t for t in dict.fromkeys(texts) if t not in self.number]
            if new:
                self._learn(new)
            out[missed] = [self.number[t] for t in texts]
            short = missed[size[missed] <= _SHORT]
            # where several share a slot, one of them with all its parts
            slots, one = np.unique(slot[short], return_index=True)
            short = short[one]
            self.recent[slots, 0], self.recent[slots, 1], self.recent_number[slots] = low[short], high[short], out[short]
        return out

    def _located(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The final state of each pretoken of texts that are each followed by the end mark, and -1 for the mark; and the bytes at which they start."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = character_classes()[points]
        starts = np.flatnonzero(splits(classes))
        stops = np.append(starts[1:], len(points))
        ends = classes[starts] == END
        word, stop = starts[~ends], stops[~ends]
        data = np.frombuffer(text.encode("utf-8", "surrogatepass") + bytes(24), np.uint8)
        # places in bytes: those of characters, and the longer ones before them
        first = np.append(np.flatnonzero((data[:-24] & 0xC0) != 0x80), len(data) - 24)
        states = np.full(len(starts), -1, np.int64)
        states[~ends] = self._numbers(data, first[word], first[stop], lambda some: [text[a:b] for a, b in zip(word[some].tolist(), stop[some].tolist(), strict=True)])
        return states, first[starts]

    def pretokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Plain texts without special strings: the bytes at which their pretokens start, from each text's own start, where each text's pretokens begin among them, ids, where each pretoken's ids begin, and where each text's do."""
        if self.size > _MOST_BYTES:
            self.clear()
        states, places = self._located(_END_MARK.join(texts) + _END_MARK)
        ends = np.flatnonzero(states < 0)
        words = states >= 0
        counts = np.diff(self.first)[states[words]] if words.any() else np.zeros(0, np.int64)
        token = np.concatenate([[0], np.cumsum(counts)])
        rows = np.concatenate([[0], ends - np.arange(len(ends))])
        begin = np.concatenate([[0], places[ends[:-1]] + len(_END_MARK.encode("utf-8", "surrogatepass"))])
        return places[words] - np.repeat(begin, np.diff(rows)), rows, self.ids[ragged(self.first[states[words]], counts)], token, token[rows]

    def stretches(self, text: str) -> list[str]:
        """A text as plain stretches with the special strings between them: stretch, special, stretch, ..."""
        return [text] if self.pattern is None or not any(s in text for s in self.special) else self.pattern.split(text)

    def _pieces(self, texts: list[str]):
        """Texts as plain stretches and special tokens: (stretches, special id or -1 after each, stretches of each text)."""
        parts, after, per = [], [], []
        for text in texts:
            cut = self.stretches(text)
            first = len(parts)
            for stretch, mark in itertools.zip_longest(cut[::2], cut[1::2]):
                some = [stretch] if len(stretch) <= _PIECE else list(between_pretokens(stretch))
                parts += some
                after += [-1] * (len(some) - 1) + [-1 if mark is None else self.special[mark]]
            per.append(len(parts) - first)
        return parts, np.array(after, np.int64), np.array(per, np.int64)

    def _run(self, texts: list[str]):
        parts, after, per = self._pieces(texts)
        size = np.cumsum([len(p) for p in parts]) // _PIECE
        edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(parts)]
        # clearing between groups would give numbers of states that are gone
        if self.size > _MOST_BYTES:
            self.clear()
        states = np.concatenate([self._located(_END_MARK.join(parts[a:b]) + _END_MARK)[0] for a, b in zip(edges[:-1], edges[1:], strict=True)])
        ends = np.flatnonzero(states < 0)
        return states, ends, after, per

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        states, ends, after, per = self._run(texts)
        emitted = np.where(states >= 0, np.diff(self.first)[np.maximum(states, 0)] if len(self.number) else 0, 0)
        total = np.concatenate([[0], np.cumsum(emitted)])[ends + 1]
        stretch = np.diff(np.concatenate([[0], total])) + (after >= 0)
        return np.add.reduceat(stretch, np.concatenate([[0], np.cumsum(per)[:-1]]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets in them."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        states, ends, after, per = self._run(texts)
        extra = len(self.ids) + np.arange(len(ends))  # a place for the special token after each stretch
        ids = np.concatenate([self.ids, np.maximum(after, 0).astype(np.uint32)])
        words = states >= 0
        begins, counts = np.empty(len(states), np.int64), np.empty(len(states), np.int64)
        begins[words], counts[words] = self.first[states[words]], np.diff(self.first)[states[words]]
        begins[ends], counts[ends] = extra, after >= 0
        total = np.concatenate([[0], np.cumsum(counts)])
        last = ends[np.cumsum(per) - 1] + 1
        return ids[ragged(begins, counts)], np.concatenate([[0], total[last]])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def batches_of_texts(column, limit: int = 1 << 19):
    """Texts of an Arrow string column in lists of about so many characters; null is empty."""
    some, size = [], 0
    for value in column:
        text = value.as_py() or ""
        some.append(text)
        size += len(text)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some
