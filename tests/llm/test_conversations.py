"""Conversation repair against all possible edits of short conversations, in one block and in many."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lumenspark.llm.conversations import damaged, repaired, repairs, turns
from lumenspark.llm.op13 import op13_conversation_repair

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def every_repair(rows: list[tuple[str, str]], starts: str = "") -> tuple[int, str]:
    """The least (cost, audit) of all sequences of edits with at most two insertions on end."""
    found = []
    inserts = ["", "u", "a", "ua", "au"]
    for kept in itertools.product(*[["D"] + ([] if kind == "x" else [i if i in ("u", "a", "s") else "-", "u", "a"]) for i, kind in rows]):
        for more in itertools.product(inserts, repeat=len(rows) + 1):
            if sum(map(len, more)) > 3:
                continue
            roles = more[0] + "".join(("" if k == "D" else k) + m for k, m in zip(kept, more[1:], strict=True))
            if not GRAMMAR.fullmatch(roles):
                continue
            cost, audit = 5 * sum(map(len, more)), "I" * len(more[0])
            for (initial, kind), k, m in zip(rows, kept, more[1:], strict=True):
                edit = "D" if k == "D" else "K" if k == initial else "R"
                cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if kind == "t" and edit != "D" else 0)
                audit += edit + "I" * len(m)
            found.append((cost, audit))
    return min(found)


def test_least_repairs_of_short_conversations():
    rng = random.Random(3)
    kinds = ["", "", "", "t", "x"]
    for n in range(5):
        for _ in range(25 if n > 2 else 40):
            rows = [(rng.choice("uuaasx"), rng.choice(kinds)) for _ in range(n)]
            assert min(repairs(rows).values()) == every_repair(rows), rows


def by_states(rows):
    """The least (cost, audit) by a plain walk through the grammar's states."""
    ways = {"b": (0, "")}
    def insert(ways):
        for _ in range(2):
            for x, (c, a) in list(ways.items()):
                y = "a" if x == "u" else "u"
                ways[y] = min(ways.get(y, (1 << 30, "")), (c + 5, a + "I"))
        return ways
    for initial, kind in rows:
        ways, new = insert(dict(ways)), {}
        for x, (c, a) in ways.items():
            options = [(x, c + 2, "D")]
            if kind != "x":
                y = "a" if x == "u" else "u"
                fine = 5 if kind == "t" else 0
                options.append((y, c + fine + (initial != y), "K" if initial == y else "R"))
                if x == "b" and initial == "s":
                    options.append(("s", c + fine, "K"))
            for y, cost, e in options:
                new[y] = min(new.get(y, (1 << 30, "")), (cost, a + e))
        ways = new
    ways = insert(dict(ways))
    return min(ways[x] for x in "ba" if x in ways)


def test_long_conversations_against_a_walk_through_states():
    rng = random.Random(8)
    for n in (6, 9, 20, 60, 150):
        for weights in ((5, 5, 1, 1), (9, 1, 1, 0), (1, 1, 5, 5)):
            for _ in range(12):
                rows = [(rng.choices("uasx", weights)[0], rng.choices(["", "t", "x"], (8, 1, 2))[0]) for _ in range(n)]
                assert min(repairs(rows).values()) == by_states(rows), rows


def brute(rows: list[tuple]) -> dict:
    """conv_id -> results, from rows (conv_id, turn, role, text) before damage."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            luck = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if luck == 0:
                continue
            text = "" if luck == 1 else re.sub(r"[.!?]", "", text) if luck == 2 else text
            left += [(turn, "user" if luck == 4 else role, text)] * (2 if luck == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, kinds = set(), []
        for _, role, text in left:
            stem = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            kinds.append("b" if not stem else "d" if (role, text) in seen else "t" if stem[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in left]
        cost, audit = by_states([(i, "x" if k in ("b", "d") else k) for i, k in zip(initials, kinds, strict=True)])
        letters = audit.replace("D", "")
        roles, at, made = (["system"] if len(letters) % 2 else []) + ["user", "assistant"] * (len(letters) // 2), 0, []
        for e in audit:
            if e != "D":
                own = roles[len(made)]
                made.append(f"{left[at][1] if e == 'K' else own}:{'' if e == 'I' else left[at][2]}")
            at += e != "I"
        known = {r[0] for r in left if r[0] is not None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (conv, max(known) - min(known) + 1 - len(known) if known else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def luck():
    return F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r) for r in op13_conversation_repair(spark, SF).collect()} == brute(rows)


@pytest.mark.parametrize(("block", "block_bytes"), [(2048, 8 << 20), (1, 8 << 20), (5, 8 << 20), (7, 60)])
def test_conversations_in_many_blocks_nulls_ties_and_odd_rows(spark, block, block_bytes):
    rng = random.Random(block)
    said = ["Yes.", "No!", "Well", " ", "", "é?\n\n", "ok. ", "a\x0b", None, " "]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    hot = [(7, rng.choice([None, *range(60)]), rng.choice(roles), rng.choice(said)) for _ in range(150)]  # a third of all rows
    same = [(8, 3, "user", "Yes.")] * 60  # equal in all
    rest = [(rng.choice([1, 2, 3, 4, 5, None]), t, rng.choice(roles), f"{rng.random()} {rng.choice(said)}") for t in range(120)]
    lost = [(c, 0, "user", "gone.") for c in range(100, 160)]
    rows = hot + same + rest + lost
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, gaps int, here string")
    out = repaired(damaged(frame, luck()), block, block_bytes).collect()
    assert {r.conv_id: tuple(r) for r in out} == brute(rows) and len(out) == len(brute(rows))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired(damaged(frame, luck())).collect() == []


def test_turns():
    assert turns("DKIRI", [("x", "1"), ("system", "2"), ("b", "3")]) == ["system:2", "user:", "assistant:3", "user:"]
