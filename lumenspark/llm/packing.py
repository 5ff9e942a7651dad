"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens; all that packing needs is how many pieces
have each length, a table of at most ``capacity`` rows whatever the corpus, which the driver gets
from one aggregation.  On it

1. reduction: a set {j, k} that holds length j is fixed for good when it dominates every other
   feasible set with j: k fills the rest exactly; or at most one more piece fits and k is the
   longest that does; or at most two more fit and no feasible pair of them is longer than k; or j
   must stay alone.  Fixing shrinks the instance, and the rules are tried again until none applies;
2. best fit, longest first, packs what remains, in two ways of which the one with fewer sequences is
   kept: each piece goes to the fullest sequence that has room for it, or the longest piece gets the set of
   others that fits its room best.

Both work on counts: equal lengths are placed together, so a plan is a list of patterns with a
multiplicity.  Spark then ranks the pieces of each length (in salted groups with offsets, so that a
length that a third of all pieces share is ranked by many tasks) and each piece looks its rank up in
the plan.

Rows: a null text counts as empty and gives one piece, its end token; repeated rows and repeated or
null ids are packed row by row; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspark.llm.common import map_batches, only, saved, shuffle_partitions
from lumenspark.llm.transducer import batches_of_texts, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _reduce(left: dict[int, int], capacity: int, plan: list[tuple[int, list[int]]]) -> None:
    """Move dominating sets from left to plan until no rule applies."""

    def take(times: int, items: list[int]) -> None:
        plan.append((times, items))
        for x in items:
            left[x] -= times
            if not left[x]:
                del left[x]

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for x in sorted(left):
            out += [x] * min(n - len(out), left[x] - (x == without))
            if len(out) == n:
                break
        return out

    def best_pair(room: int, without: int) -> int:
        have = sorted(left)
        best, high = 0, len(have) - 1
        for x in have:
            while high >= 0 and have[high] + x > room:
                high -= 1
            if high < 0:
                break
            for y in (have[high], have[high - 1] if high else 0):
                need = (y == x) + 1
                if y and left[y] - (y == without) >= need and left[x] - (x == without) >= 1:
                    best = max(best, x + y)
        return best

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                low = smallest(3, j)
                if not low or low[0] > room:
                    take(left[j], [j])
                    changed = True
                    continue
                fits = [x for x in left if x <= room and left[x] - (x == j) > 0]
                k = max(fits)
                few = len(low) < 2 or low[0] + low[1] > room
                if not (k == room or few or ((len(low) < 3 or sum(low) > room) and best_pair(room, j) <= k)):
                    break
                # smaller multiplicities keep the rule's premise true for each copy that is fixed
                times = left[j] // 2 if j == k else min(left[j], left[k])
                take(times, [j, k])
                changed = True


def _best_fit(left: dict[int, int], capacity: int, plan: list[tuple[int, list[int]]]) -> None:
    groups: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(times: int, items: list[int], room: int) -> None:
        if not groups[room]:
            bisect.insort(rooms, room)
        groups[room].append((times, items))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(full, [length] * each, capacity - each * length)
                if rest:
                    put(1, [length] * rest, capacity - rest * length)
                n = 0
                continue
            room = rooms[at]
            times, items = groups[room].pop()
            if not groups[room]:
                rooms.pop(at)
            used = min(n, times)
            if used < times:
                put(times - used, items, room)
            put(used, [*items, length], room - length)
            n -= used
    plan += [g for room in rooms for g in groups[room]]


def _best_set(left: dict[int, int], room: int, without: int) -> tuple[int, ...]:
    """Lengths of pieces that fill the room best, of those that are left after one of a length is taken away."""
    sets: dict[int, tuple[int, ...]] = {0: ()}
    for x in sorted((x for x in left if x <= room), reverse=True):
        more: dict[int, tuple[int, ...]] = {}
        for total, items in sets.items():
            for k in range(1, min(left[x] - (x == without), (room - total) // x) + 1):
                more.setdefault(total + k * x, items + (x,) * k)
        sets = more | sets
        if room in sets:
            break
    return sets[max(sets)]


def _best_sets(left: dict[int, int], capacity: int, plan: list[tuple[int, list[int]]]) -> None:
    """The longest piece with the set of others that leaves least room, as often as there are pieces for it."""
    while left:
        longest = max(left)
        items = [longest, *_best_set(left, capacity - longest, longest)]
        each = Counter(items)
        times = min(left[x] // k for x, k in each.items())
        plan.append((times, items))
        for x, k in each.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The Martello-Toth bound L2: fewer sequences can't hold pieces of these lengths."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(n for x, n in counts.items() if x > capacity - a)
        halves = [(x, n) for x, n in counts.items() if 2 * x > capacity and x <= capacity - a]
        room = sum(n * (capacity - x) for x, n in halves)
        small = sum(x * n for x, n in counts.items() if a <= x and 2 * x <= capacity)
        best = max(best, alone + sum(n for _, n in halves) + max(0, -(-(small - room) // capacity)))
    return best


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """How many sequences hold which lengths: a list of (multiplicity, lengths)."""
    left = {k: n for k, n in counts.items() if n}
    plan: list[tuple[int, list[int]]] = []
    if left.get(capacity):
        plan.append((left.pop(capacity), [capacity]))
    _reduce(left, capacity, plan)
    ways: list[list[tuple[int, list[int]]]] = [[], []]
    _best_fit(dict(left), capacity, ways[0])
    _best_sets(left, capacity, ways[1])
    return plan + min(ways, key=lambda way: sum(times for times, _ in way))


def _cut(path: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        machine = encoder(path)
        for batch in batches:
            ids_of, piece, start, length, sums = [], [], [], [], []
            row = 0
            for texts in batches_of_texts(batch.column("text")):
                ids, at = machine.encode(texts)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n = b - a + 1
                    begin = 0
                    to = n if n <= capacity else (n % capacity or capacity)
                    p = 0
                    while begin < n:
                        crc = zlib.crc32(raw[4 * (a + begin) : 4 * min(a + to, b)])
                        sums.append(crc if to < n else zlib.crc32(tail, crc))
                        ids_of.append(row)
                        piece.append(p)
                        start.append(begin)
                        length.append(to - begin)
                        begin, to, p = to, to + capacity, p + 1
                    row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids_of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _place(plan: list[tuple[int, list[int]]], capacity: int):
    """Slots of each length in the order of the plan: a piece's rank says which one it gets."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for times, items in plan:
        offset = 0
        for length in items:
            slots[length].append((times, first, offset))
            offset += length
        first += times
    by_length = {}
    for length, rows in slots.items():
        times, base, offset = np.array(rows, np.int64).T
        by_length[length] = (np.cumsum(times) - times, base, offset)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                mine = length == x
                starts, base, offsets = by_length[x]
                slot = np.searchsorted(starts, rank[mine], "right") - 1
                sequence[mine] = base[slot] + rank[mine] - starts[slot]
                offset[mine] = offsets[slot]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    pieces = saved(map_batches(only(docs, "doc_id", "text"), _cut(tokenizer, capacity, end), PIECES))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = pack_lengths(counts, capacity)

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(64, shuffle_partitions(spark)))).cast("int"))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    offsets = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = salted.withColumn("within", F.row_number().over(group)).join(offsets, ["length", "salt"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    return rows.mapInArrow(_place(plan, capacity), PIECES + ", sequence_id long, offset long")
