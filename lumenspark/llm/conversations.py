"""Conversation structure repair: alignment of turns to the alternating grammar ``(s?(ua)+)?`` at least cost.

A conversation's roles go by their initials: an optional system turn, then user and assistant in turn, or
nothing at all.  Keeping a row costs 0, giving it the role that its place asks for 1, deleting it 2 and
inserting an empty turn 5; a row that is blank or a duplicate must go, a truncated row that stays costs 5.

Rows that must go take no part; the others are aligned with each feasible length of the grammar string by
Wagner and Fischer's table.  All lengths share one table, filled from the end, as shorter strings are ends of
longer ones.  Ukkonen's bands, from the cost of a repair found in one greedy pass, leave out lengths and cells
that cannot beat it.  Of every length of least cost the audit (the initials of its edits in order) is traced,
the ASCII-least choice first, and the least audit wins; deletions that are due come before what they could
come after.

Rows are sorted by conversation and turn over ranges, so that a conversation may span many tasks.  What lies
whole within a range, and has BLOCK rows and BLOCK_BYTES at most, is repaired there.  The others are cut into blocks: each
block is aligned from every state of the grammar to every other, the maps are folded in order, and then each block
writes its repaired turns, which are hashed as a stream.  Folding keeps four paths, as long as the audit.

Order and ties: by turn (nulls first), then role, then the MD5 of the text, then any order, for such rows are equal.
Rows: nulls in role and text count as one space; a null conv_id is a conversation of its own; a null turn is
ignored in gaps; a repeated row is a duplicate; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only, saved, shuffle_partitions
from lumenspark.llm.components import SALTS

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK, BLOCK_BYTES = 2048, 8 << 20
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 40
#: States of the grammar: nothing yet, after the system turn, a user's, an assistant's.
STATES = "bsua"


def flaw(text: str) -> str:
    """'b' if a text is blank, 't' if its last character is no end of a sentence, else ''."""
    text = text.rstrip(_SPACE)
    return "b" if not text else "" if text[-1] in ".!?" else "t"


class Alignment:
    """Rows that may stay (initial, whether truncated) against the ends of the alternating strings that end with a letter."""

    def __init__(self, rows: list[tuple[str, bool]], tail: str, limit: int):
        """limit: a cost that some repair reaches; dearer ones are not looked at."""
        self.rows, self.tail = rows, tail
        m = len(rows)
        ahead = limit // INSERT
        self.low = [max(0, m - i - limit // DELETE) for i in range(m + 1)]
        width = [m - i + ahead - self.low[i] + 1 for i in range(m + 1)]
        self.cost = [np.zeros(0)] * (m + 1)
        self.cost[m] = INSERT * np.arange(width[m], dtype=np.int64)
        for i in range(m - 1, -1, -1):
            low, w = self.low[i], width[i]
            below, shift = self.cost[i + 1], low - self.low[i + 1]  # shift: 0 or 1
            out = np.full(w, _NEVER, np.int64)
            some = below[shift : shift + w]
            out[: len(some)] = some + DELETE
            letters = np.arange(low, low + w)
            skip = 1 - shift  # the place of the first letter that has one fewer below
            from_below = below[: w - skip]
            initial, cut = rows[i]
            own = letters[skip : skip + len(from_below)] % 2 == (initial == tail) if initial in ("u", "a") else np.zeros(len(from_below), bool)
            step = np.where(own, KEEP, REROLE) + TRUNCATED * cut
            out[skip : skip + len(from_below)] = np.minimum(out[skip : skip + len(from_below)], from_below + step)
            # insertions: the least of what is to the left, plus their number
            out = np.minimum.accumulate(out - INSERT * letters) + INSERT * letters
            self.cost[i] = out

    def letter(self, left: int) -> str:
        """The letter with which an end of so many letters begins."""
        return self.tail if left % 2 else "ua"[self.tail == "u"]

    def at(self, i: int, left: int) -> int:
        k = left - self.low[i]
        return int(self.cost[i][k]) if left >= 0 and 0 <= k < len(self.cost[i]) else _NEVER

    def lengths(self, opening: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the ends that begin with a letter, and their costs."""
        left = np.arange(self.low[0], self.low[0] + len(self.cost[0]))
        used = left % 2 == (opening == self.tail)
        return left[used], self.cost[0][used]

    def trace(self, i: int, left: int, due: list[int]) -> list[str]:
        """The least audit of rows from i on against an end; due: rows that must go before each row, and after the last."""
        out, paid = [], -1
        m = len(self.rows)
        while True:
            if paid < i:
                out.append("D" * due[i])
                paid = i
            if i == m and not left:
                return out
            now = self.at(i, left)
            if i < m and now == DELETE + self.at(i + 1, left):
                out.append("D")
                i += 1
            elif left and now == INSERT + self.at(i, left - 1):
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.rows[i][0] == self.letter(left) else "R")
                i, left = i + 1, left - 1


def _greedy(rows: list[tuple[str, bool]], state: str) -> int:
    """The cost of one simple repair from a state, with insertions for any end."""
    cost = 2 * INSERT
    for initial, cut in rows:
        wanted = "a" if state == "u" else "u"
        if cut or initial not in ("u", "a", "s"):
            cost += DELETE
        elif initial == wanted or (initial == "s" and state == "b"):
            state = initial
        else:
            cost, state = cost + REROLE, wanted
    return cost


def repairs(rows: list[tuple[str, str]], starts: str = "b", ends: str = "ba") -> dict[tuple[str, str], tuple[int, str]]:
    """The least cost and audit of some rows (initial; '' or 't' or 'x' for one that must go), from states to states."""
    stay, due = [], [0]
    for initial, kind in rows:
        if kind == "x":
            due[-1] += 1
        else:
            stay.append((initial, kind == "t"))
            due.append(0)
    fixed = DELETE * sum(due)
    limit = max(_greedy(stay, x) for x in starts)
    tables = {y: Alignment(stay, y, limit) for y in "ua" if y in ends}
    systems = [i for i, (initial, _) in enumerate(stay) if initial == "s"]
    out = {}
    for x in starts:
        for y in ends:
            found: list[tuple[int, str]] = []  # least cost and audit of each kind of string
            if y in "ua":
                table = tables[y]
                left, cost = table.lengths("a" if x == "u" else "u")
                if x != y:
                    left, cost = left[left > 0], cost[left > 0]
                if len(cost) and cost.min() <= limit:
                    least = int(cost.min())
                    found.append((least, min("".join(table.trace(0, n, due)) for n in left[cost == least].tolist())))
                if x == "b":
                    found += _with_system(stay, due, systems, table, found[0][0] if found else _NEVER)
            elif x == y:
                found.append((DELETE * len(stay), "D" * len(rows)))
            elif (x, y) == ("b", "s") and systems:
                least = min(stay[i][1] for i in systems)
                i = [i for i in systems if stay[i][1] == least][-1]
                before = i + sum(due[: i + 1])
                found.append((DELETE * (len(stay) - 1) + TRUNCATED * least, "D" * before + "K" + "D" * (len(rows) - before - 1)))
            if found:
                cost, audit = min(found)
                out[x, y] = cost + fixed, audit
    return out


def _with_system(stay, due, systems, table: Alignment, best: int) -> list[tuple[int, str]]:
    """The least repair that keeps a system turn first: all before it goes."""
    options = []
    for i in systems:
        left = np.arange(table.low[i + 1], table.low[i + 1] + len(table.cost[i + 1]))
        used = (left % 2 == (table.tail == "u")) & (left > 0)
        cost = table.cost[i + 1][used] + DELETE * i + TRUNCATED * stay[i][1]
        if len(cost) and cost.min() <= best:
            best = int(cost.min())
            options.append((best, i, left[used][cost == best]))
    # a row goes ahead of all that is traced after it: of equal costs the last system turn has the least audit
    options = [o for o in options if o[0] == best]
    if not options:
        return []
    _, i, left = options[-1]
    lead = "D" * (i + sum(due[: i + 1])) + "K"
    return [(best, lead + min("".join(table.trace(i + 1, n, due)) for n in left.tolist()))]


def turns(audit: str, rows: list[tuple[str, str]], state: str = "b") -> list[str]:
    """The repaired turns, as role:text, of rows (role, text) by an audit that starts in a state."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K" and state == "b" and rows[at][0][:1] == "s":
            wanted = "s"
        else:
            wanted = "a" if state == "u" else "u"
        role = rows[at][0] if edit == "K" else "user" if wanted == "u" else "assistant"
        out.append(f"{role}:{'' if edit == 'I' else rows[at][1]}")
        at += edit != "I"
        state = wanted
    return out


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True))


def _whole(rows: list[tuple]) -> dict:
    """The results of a conversation's rows (turn, role, text, here) in order."""
    rows = [r for r in rows if r[3]]
    seen, kinds, count = set(), [], {"b": 0, "d": 0, "t": 0, "": 0}
    for _, role, text, _ in rows:
        kind = flaw(text)
        if kind != "b" and (role, text) in seen:
            kind = "d"
        seen.add((role, text))
        count[kind] += 1
        kinds.append(kind)
    initials = [r[1][:1] for r in rows]
    got = repairs([(a, "x" if k in ("b", "d") else k) for a, k in zip(initials, kinds, strict=True)])
    cost, audit = min(got.values())
    known = {r[0] for r in rows if r[0] is not None}
    text = "\n".join(turns(audit, [(r[1], r[2]) for r in rows]))
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, "blank": count["b"], "duplicate": count["d"], "truncated": count["t"], "illegal": _illegal(initials), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [f.split()[0] for f in RESULT.split(", ")]
_OPEN = "part int, block int, at int, turn long, role string, text string, here boolean"


def _by_conversation(batches) -> Iterator[tuple]:
    """Rows of sorted batches as tuples."""
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _repair_ranges(schema: pa.Schema, block: int, block_bytes: int):
    """Sorted rows of one range: results of whole conversations, and the rows of others as they are."""

    def frame(made: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(made, schema=schema)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made, size = [], 0
        held, held_bytes, now, first, spills, number = [], 0, None, True, False, 0

        def put(row: dict, n: int):
            nonlocal size
            made.append(row)
            size += n + 100

        def let_go():  # the held rows stay open, as a block
            nonlocal held, held_bytes, number
            for at, (turn, role, text, here) in enumerate(held):
                put({"conv_id": now[0], "part": part, "block": number, "at": at, "turn": turn, "role": role, "text": text, "here": here}, len(text))
            held, held_bytes, number = [], 0, number + 1

        for conv, *row in _by_conversation(batches):
            if now is None or conv != now[0]:
                if now is not None:
                    if first or spills:
                        let_go()
                    else:
                        put({"conv_id": now[0], **_whole(held)}, 200)
                    first, spills = False, False
                now, held, held_bytes = (conv,), [], 0
            held.append(tuple(row))
            held_bytes += len(row[2])
            if len(held) >= block or held_bytes >= block_bytes:
                spills = True
                let_go()
            if size >= 4 << 20:
                yield frame(made)
                made, size = [], 0
        if now is not None:
            let_go()
        if made:
            yield frame(made)

    return run


def _align_blocks(schema: pa.Schema):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("at").to_pylist(), table.column("initial").to_pylist(), table.column("kind").to_pylist(), strict=True))
        initials, kinds = [r[1] for r in rows], [r[2] for r in rows]
        got = repairs([(a, "x" if k in ("b", "d") else k) for a, k in zip(initials, kinds, strict=True)], STATES, STATES)
        one = {"conv": key[0].as_py(), "part": key[1].as_py(), "block": key[2].as_py(), "blank": kinds.count("b"), "duplicate": kinds.count("d"), "truncated": kinds.count("t"), "illegal": _illegal(initials), "opens": initials[0], "closes": initials[-1], "paths": [{"x": x, "y": y, "cost": c, "audit": a} for (x, y), (c, a) in got.items()]}
        return pa.Table.from_pylist([one], schema=schema)

    return run


class _Path:
    """The least way to a state so far: its cost, the audit of its last block, and the way before."""

    __slots__ = ("cost", "block", "x", "audit", "before")

    def __init__(self, cost, block, x, audit, before):
        self.cost, self.block, self.x, self.audit, self.before = cost, block, x, audit, before

    def beats(self, other: _Path) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, theirs = self, other, [], []
        while a is not b:  # both have a block of the same place at each step
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def _fold(schema: pa.Schema):
    """Blocks in order: the state and audit of each block in the least repair, and each conversation's totals on its first block."""

    def done(conv, totals, ways):
        best = None
        for y in "ba":
            if y in ways and (best is None or ways[y].beats(best)):
                best = ways[y]
        chain = []
        while best.before is not None:
            chain.append(best)
            best = best.before
        audit = "".join(p.audit for p in reversed(chain))
        rows = [{"conv": conv, "part": p.block[0], "block": p.block[1], "x": p.x, "edits": p.audit} for p in reversed(chain)]
        rows[0] |= totals | {"cost": chain[0].cost, "audit": audit}
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    def run(batches):
        now, closes = None, ""
        for batch in batches:
            for r in batch.to_pylist():
                if r["conv"] != now:
                    if now is not None:
                        yield done(now, totals, ways)
                    now, closes = r["conv"], None
                    totals = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                    ways = {"b": _Path(0, None, None, "", None)}
                for k in totals:
                    totals[k] += r[k]
                totals["illegal"] += closes is not None and closes + r["opens"] not in _LEGAL
                closes, new = r["closes"], {}
                for p in r["paths"]:
                    if p["x"] in ways:
                        way = _Path(ways[p["x"]].cost + p["cost"], (r["part"], r["block"]), p["x"], p["audit"], ways[p["x"]])
                        if p["y"] not in new or way.beats(new[p["y"]]):
                            new[p["y"]] = way
                ways = new
        if now is not None:
            yield done(now, totals, ways)

    return run


def _write_blocks(schema: pa.Schema):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, chosen: pa.Table) -> pa.Table:
        own = [(role, text) for _, role, text in sorted(zip(rows.column("at").to_pylist(), rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True), key=lambda r: r[0])]
        pieces = turns(chosen.column("edits")[0].as_py(), own, chosen.column("x")[0].as_py())
        if not pieces:
            return pa.Table.from_pylist([], schema=schema)
        return pa.Table.from_pylist([{"conv": key[0].as_py(), "part": key[1].as_py(), "block": key[2].as_py(), "piece": "\n".join(pieces)}], schema=schema)

    return run


def _hash_stream(batches):
    """Sorted pieces (conv, piece): the SHA-256 of each conversation's, joined by line ends."""
    now, digest = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])
    for conv, piece in _by_conversation(batches):
        if conv != now:
            if now is not None:
                yield out()
            now, digest = conv, hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(piece.encode())
    if now is not None:
        yield out()


def _in_order(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), "conv").sortWithinPartitions("conv", "part", "block").select(*names)


def _arrow(df_schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(df_schema))


def _open_conversations(rows: DataFrame, kind: str) -> DataFrame:
    """The results of conversations that lie in several blocks, from their rows."""
    spark = rows.sparkSession
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")))
    here = rows.where("here")
    blank = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    flawed = F.when(blank == "", "b").when(F.substring(blank, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    # blank rows repeat blank rows alone, so what follows needs no look at them
    marked = here.select("conv", "part", "block", "at", F.struct("part", "block", "at").alias("place"), F.substring("role", 1, 1).alias("initial"), flawed.alias("kind"), F.sha2(F.concat(F.md5(F.col("role").cast("binary")), "text").cast("binary"), 256).alias("digest"))
    again = marked.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("conv", "digest", "first")
    salt = F.pmod(F.xxhash64("part", "block", "at"), F.lit(SALTS)).cast("int")
    spread = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = marked.withColumn("salt", salt).join(spread, ["conv", "digest", "salt"], "left")
    told = joined.select("conv", "part", "block", "at", "initial", F.when((F.col("kind") != "b") & (F.col("place") > F.col("first")), "d").otherwise(F.col("kind")).alias("kind"))
    schema = "conv string, part int, block int, blank long, duplicate long, truncated long, illegal long, opens string, closes string, paths array<struct<x: string, y: string, cost: long, audit: string>>"
    blocks = told.groupBy("conv", "part", "block").applyInArrow(_align_blocks(_arrow(schema, spark)), schema)
    schema = "conv string, part int, block int, x string, edits string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    chosen = saved(map_batches(_in_order(blocks, ("conv", "part", "block", "blank", "duplicate", "truncated", "illegal", "opens", "closes", "paths")), _fold(_arrow(schema, spark)), schema))
    schema = "conv string, part int, block int, piece string"
    keys = ["conv", "part", "block"]
    pieces = here.select(*keys, "at", "role", "text").groupBy(*keys).cogroup(chosen.select(*keys, "x", "edits").groupBy(*keys)).applyInArrow(_write_blocks(_arrow(schema, spark)), schema)
    hashed = map_batches(_in_order(pieces, ("conv", "piece")), _hash_stream, "conv string, repaired_sha256 string")
    known = here.where("turn is not null").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    totals = chosen.where("audit is not null").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    all_ = rows.groupBy("conv").agg(F.max("conv_id").alias("conv_id")).join(known, "conv", "left").join(totals, "conv", "left").join(hashed, "conv", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in _NAMES[:6]]
    return all_.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repaired(rows: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, turn long, role, text, here) -> a row for each conv_id with gaps, faults, cost, audit and the digest of the repaired turns.

    Rows with here = false only say that there is such a conversation.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    text = [F.coalesce(n, F.lit(" ")).alias(n) for n in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, "here")
    order = ["conv_id", "turn", "role", F.md5(F.col("text").cast("binary")), F.monotonically_increasing_id()]
    keyed = rows.select("*", order[3].alias("_md5"), order[4].alias("_row"))
    order = ["conv_id", "turn", "role", "_md5", "_row"]
    ranged = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select(*rows.columns)
    schema = f"conv_id {kind}, {RESULT}, {_OPEN}"
    made = saved(map_batches(ranged, _repair_ranges(_arrow(schema, spark), block, block_bytes), schema))
    done = made.where("part is null").select("conv_id", *_NAMES)
    left = made.where("part is not null").select("conv_id", *[f.split()[0] for f in _OPEN.split(", ")])
    return done.union(_open_conversations(left, kind))


def damaged(conversations: DataFrame, luck: Column) -> DataFrame:
    """Turns with a fault by a number from 0 to 19: lost, emptied, without ends of sentences, repeated, or said by the user."""
    rows = only(conversations, "conv_id", "turn", "role", "text").withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))}).withColumn("_luck", luck)
    text = F.when(F.col("_luck") <= 1, "").when(F.col("_luck") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_luck") == 4, "user").otherwise(F.col("role"))
    once = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_luck") != 0).alias("here"), "_luck")
    return once.withColumn("_copy", F.explode(F.when(F.col("_luck") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "_luck")
