"""Packing: pieces against the library, the plan against its own rules, capacity and the lower bound."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from lumenspark.llm.op4 import tokenizer_path
from lumenspark.llm import packing
from lumenspark.llm.packing import lower_bound, pack, pack_lengths


def check_plan(counts, capacity):
    plan = pack_lengths(counts, capacity)
    used = Counter()
    for times, items in plan:
        assert times > 0 and sum(items) <= capacity
        for x in items:
            used[x] += times
    assert used == Counter({k: n for k, n in counts.items() if n})
    return sum(t for t, _ in plan)


def test_plans_hold_every_piece_and_stay_near_the_bound():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        bins = check_plan(counts, capacity)
        # no two pieces over half the capacity share a sequence; the larger bound is 2/3 of the least number or more
        bound = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
        assert bound <= bins <= 11 / 9 * 1.5 * bound + 1
    assert pack_lengths({}, 10) == []
    assert check_plan({6: 2, 4: 2, 10: 3, 7: 1}, 10) == 6


def fewest(counts, capacity):
    """The least number of sequences, by trying all sets for the longest piece."""
    from functools import lru_cache

    lengths = sorted(counts, reverse=True)

    @lru_cache(maxsize=None)
    def solve(left):
        first = next((i for i, n in enumerate(left) if n), None)
        if first is None:
            return 0

        def fill(i, room, left):
            if i == len(lengths):
                yield left
                return
            for k in range(min(left[i], room // lengths[i]) + 1):
                yield from fill(i + 1, room - k * lengths[i], left[:i] + (left[i] - k,) + left[i + 1 :])

        start = left[:first] + (left[first] - 1,) + left[first + 1 :]
        return 1 + min(map(solve, fill(first, capacity - lengths[first], start)))

    return solve(tuple(counts[x] for x in lengths))


def test_plans_of_few_pieces_are_nearly_the_least():
    rng = random.Random(4)
    over = 0
    for _ in range(60):
        counts = dict(Counter(rng.randint(2, 20) for _ in range(rng.randint(1, 8))))
        least, bins = fewest(counts, 20), check_plan(counts, 20)
        assert lower_bound(counts, 20) <= least <= bins <= least + 1
        over += bins - least
    assert over <= 3


def test_plans_of_many_pieces_reach_the_bound():
    rng = random.Random(3)
    for draw in (lambda: rng.expovariate(1 / 250) + 1, lambda: rng.randint(1, 1024), lambda: rng.lognormvariate(5.2, 0.9) + 1):
        counts = Counter(min(1024, int(draw())) for _ in range(20000))
        assert check_plan(counts, 1024) <= 1.002 * lower_bound(counts, 1024)
    few = Counter(rng.choice([700, 400, 350, 333, 290, 110]) for _ in range(20000))
    assert check_plan(few, 1024) <= 0.98 * plain_best_fit(few, 1024)


def plain_best_fit(counts, capacity):
    plan = []
    packing._best_fit(dict(counts), capacity, plan)
    return sum(times for times, _ in plan)


def test_reduction_fixes_pieces():
    left, fixed = Counter(min(1024, random.Random(i).randint(1, 1024)) for i in range(5000)), []
    packing._reduce(left, 1024, fixed)
    assert sum(times * len(items) for times, items in fixed) > 1000


def test_the_given_table_is_packed_near_the_bound(spark):
    from lumenspark.llm.op7 import op7_best_fit_packing

    rows = op7_best_fit_packing(spark, "/root/testdata/sf0.01").select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in rows}) <= 1.01 * lower_bound(Counter(r.length for r in rows), 1024)


def test_pieces_sequences_and_offsets(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 5000, "c"), (3, "word " * 5000, "c"), (None, "it's <|endoftext|> x", None), *[(10 + i, "ab cd " * (7 * i % 400), "d") for i in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = pack(docs, tokenizer_path(), 1024, 2).collect()
    library = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for d, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            want[(d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(docs.limit(0), tokenizer_path()).count() == 0
