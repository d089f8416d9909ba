"""Packing documents into fixed-length training sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` bins) reaches the driver. There the configuration program
"fewest patterns that cover every length's demand" is solved by multiplicative weights with knapsack dynamic programming
as pricing, to a stated gap from its dual bound, then rounded; what rounding leaves is solved and rounded again, and best-fit
patterns finish the last remainder in count form. Where there are over ``CLASSES`` lengths, or pieces are too few for that,
neighbouring lengths are one class of the program, with their mean length; rounding then picks lengths of a class that fill
the sequence. Pieces find their place by their rank within their length, without any global order.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, pieces
from .token_files import tokenizer_path

CAPACITY = 4096
#: Rows of one length that are ranked in one task.
RANKED = 500

#: Lengths are put in at most so many classes for the linear program, and measured in units of at most so many tokens.
CLASSES, UNIT = 100, 8
#: The linear program is solved to this gap, as a part of its dual bound; what a used pattern may leave free, as a part of the capacity.
GAP, SLACK = 0.02, 0.0005

Pattern = list[tuple[int, int]]


@dataclass
class Plan:
    """A packing in count form: (pattern, times). The first ``from_program`` sequences come from patterns of the linear
    program, whose first solution uses ``value`` sequences where its dual proves that ``bound`` are needed."""

    patterns: list[tuple[Pattern, int]]
    from_program: int = 0
    value: float = 0.0
    bound: float = 0.0

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.patterns)

    @property
    def share(self) -> float:
        """The part of the sequences that the linear program gives."""
        return self.from_program / max(1, self.sequences)


def classes(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """The class of each length: neighbouring lengths of about equal numbers of pieces, the full length by itself."""
    found = np.minimum((np.cumsum(counts) - counts) * most // counts.sum(), most - 1)
    found[lengths == capacity] = most
    return np.unique(found, return_inverse=True)[1]


def knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for every room the largest worth and the kind put last (-1: none).
    ``sizes`` ascend."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = best[c - sizes[:k]] + worth[:k]
            j = int(got.argmax())
            if got[j] > best[c] * (1 + 1e-12):
                best[c], took[c] = got[j], j
    return best, took


def filling(took: list[int], sizes: list[int], room: int, first: int) -> tuple[tuple[int, int], ...]:
    """The (kind, copies) of the best filling of ``room`` that holds one of kind ``first``."""
    found = {first: 1}
    left = room - sizes[first]
    while left > 0:
        if (j := took[left]) < 0:
            left -= 1
        else:
            found[j] = found.get(j, 0) + 1
            left -= sizes[j]
    return tuple(sorted(found.items()))


def fractional(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 600, near: float = 0.05, step: float = 0.05, rate: float = 10.0) -> tuple[dict, float, float]:
    """Multiplicative weights on the configuration program "fewest patterns that cover every kind's demand".

    A kind's weight starts at its size and falls by exp(-rate * its covered part); weights are dual prices, so that their
    worth over that of the best pattern bounds every solution from below. In a round the knapsack table gives, for each
    kind, the best pattern that holds it; all that come within ``near`` of the best are used together, so far that no kind's
    covered part grows by more than ``step``. The sum, scaled to cover every kind, is feasible; it ends within ``gap``
    of the bound, or after ``rounds`` with the gap that the two returned numbers state. Returns the uses of each pattern, their sum and the bound."""
    cover = np.zeros(len(sizes))
    used: dict[tuple, float] = {}
    of, bound, total = sizes.tolist(), 0.0, 0.0
    for turn in range(10 * rounds):
        price = sizes / room * np.exp(-rate * (cover - cover.mean()))
        best, took = knapsack(sizes, price, room)
        bound = max(bound, float(price @ demand / best[room]))
        if cover.min() > 0 and (turn >= rounds or total / cover.min() <= (1 + gap) * bound):
            break
        took = took.tolist()
        mix: dict[tuple, float] = {}
        for first in np.flatnonzero(price + best[room - sizes] >= (1 - near) * best[room]).tolist():
            pattern = filling(took, of, room, first)
            mix[pattern] = mix.get(pattern, 0.0) + demand[first] / dict(pattern)[first]
        gain = np.zeros(len(sizes))
        for pattern, x in mix.items():
            for j, a in pattern:
                gain[j] += a * x / demand[j]
        scale = step / gain.max()
        cover += scale * gain
        for pattern, x in mix.items():
            used[pattern] = used.get(pattern, 0.0) + scale * x
            total += scale * x
    else:
        raise RuntimeError("the configuration program was not covered")
    least = float(cover.min())
    return {pattern: x / least for pattern, x in used.items()}, total / least, bound


def rounded(left: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], float, float]:
    """Solves the program for the pieces ``left`` and takes from them what the rounded patterns hold.

    Uses are rounded so that their running sum is. A pattern's classes get the lengths that are most numerous, its last
    piece is the longest that fits, and what room stays is filled alike; a pattern that leaves over ``SLACK`` more than
    planned is dropped."""
    lengths = np.array(sorted(x for x, n in left.items() if n))
    counts = np.array([left[int(x)] for x in lengths])
    most = int(np.clip(int(lengths @ counts) // capacity // 10, 8, CLASSES))
    single = len(lengths) <= most
    kind = np.arange(len(lengths)) if single else classes(lengths, counts, capacity, most)
    unit = 1 if single else int(np.clip(lengths @ counts / counts.sum() / 32, 1, UNIT))
    demand = np.bincount(kind, weights=counts)
    sizes = np.maximum(1, np.round(np.bincount(kind, weights=counts * lengths) / demand / unit)).astype(np.int64)
    used, value, bound = fractional(sizes, demand, capacity // unit)
    members = [lengths[kind == g].tolist() for g in range(len(demand))]
    of, order = dict(zip(lengths.tolist(), kind.tolist(), strict=True)), lengths.tolist()
    out: list[tuple[Pattern, int]] = []
    carried = 0.0
    for pattern, x in sorted(used.items(), key=lambda u: -u[1]):
        carried += x
        wanted = int(carried + 1e-9)
        carried -= wanted
        spare = SLACK * capacity + max(0, capacity - unit * int(sum(sizes[g] * a for g, a in pattern)))
        kinds = [g for g, a in reversed(pattern) for _ in range(a)][:-1]
        while wanted > 0:
            room, chosen = capacity, {}
            for g in kinds:
                x = max((v for v in members[g] if v <= room and left[v] > chosen.get(v, 0)), key=lambda v: left[v] - chosen.get(v, 0), default=0)
                if not x:
                    break
                chosen[x] = chosen.get(x, 0) + 1
                room -= x
            else:
                at = bisect_right(order, room)
                while at:
                    x = order[at - 1]
                    if left[x] > chosen.get(x, 0):
                        chosen[x] = chosen.get(x, 0) + 1
                        room -= x
                        at = bisect_right(order, room, 0, at)
                    else:
                        at -= 1
                if room <= spare and chosen:
                    times = min(wanted, *(left[v] // a for v, a in chosen.items()))
                    wanted -= times
                    out.append((sorted(chosen.items(), reverse=True), times))
                    for v, a in chosen.items():
                        left[v] -= a * times
                        if not left[v]:
                            order.pop(bisect_left(order, v))
                            members[of[v]].remove(v)
                    continue
            break
    return out, value, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing in count form: each pattern is repeated until one of its bins is empty."""
    out: list[tuple[Pattern, int]] = []
    order = sorted(x for x, n in left.items() if n)
    while order:
        room, pattern, at = capacity, [], len(order)
        while at:
            x = order[at - 1]
            a = min(room // x, left[x])
            pattern.append((x, a))
            room -= a * x
            at = min(at - 1, bisect_right(order, room))
        times = min(left[x] // a for x, a in pattern)
        out.append((pattern, times))
        for x, a in pattern:
            left[x] -= a * times
            if not left[x]:
                order.remove(x)
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, passes: int = 4) -> Plan:
    """Patterns and whole repeat counts that hold every piece of ``histogram`` exactly once: the program's, solved anew for
    what rounding leaves while that gives a fifth of its value at least, then best-fit for the remainder."""
    left = {x: n for x, n in histogram.items() if n}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be from 1 to the capacity")
    plan = Plan([])
    for turn in range(passes):
        if not any(left.values()):
            break
        found, value, bound = rounded(left, capacity)
        plan.patterns += found
        if turn == 0:
            plan.value, plan.bound = value, bound
        if sum(times for _, times in found) < bound / 5:
            break
    plan.from_program = plan.sequences
    plan.patterns += best_fit(left, capacity)
    return plan


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, deal): each document's ids and ``end_id``, cut where longer than ``capacity``;
    ``deal`` tells equal rows apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces.word_pieces(path)
        dealt = 0
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids, at = encode(common.strings(part.column("text")))
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                size = np.diff(at)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                first = at[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(dealt + np.arange(len(row)))], ["doc_id", "piece", "start", "length", "ids_crc32", "deal"])
                dealt += len(row)

    return common.bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


def placed(found: DataFrame, patterns: list[tuple[Pattern, int]]) -> DataFrame:
    """Adds sequence_id and offset to pieces that carry their ``rank`` within their length."""
    slots = []
    seen: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for x, a in pattern:
            slots.append((x, seen.get(x, 0), base, a, offset))
            seen[x] = seen.get(x, 0) + a * times
            offset += a * x
        base += times
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    key = (table[:, 0] << 44) | table[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            turn, slot = np.divmod(rank - table[at, 1], table[at, 3])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(table[at, 2] + turn), pa.array(table[at, 4] + slot * length)], [*names, "sequence_id", "offset"])

    return found.select(*names, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens; one row per piece: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone; rows with equal or null doc_id are packed each for itself; an empty table
    gives an empty packing; other columns are not read. What is sent to the driver is the histogram, at most
    ``capacity`` rows; what goes to the tasks is the patterns, whose number is bounded by the rounds of the program and by
    the emptied bins, whatever the number of pieces."""
    found = common.staged(cut_pieces(docs, path, capacity, end_id), "pieces")
    bins = found.groupBy("length").count().collect()
    patterns = solve({r["length"]: r["count"] for r in bins}, capacity).patterns
    ways = found.sparkSession.createDataFrame([(r["length"], -(-r["count"] // RANKED)) for r in bins], "length long, ways long")
    dealt = found.join(F.broadcast(ways), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal"), "ways")).drop("ways")
    before = dealt.groupBy("length", "salt").count().select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    within = dealt.withColumn("at", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return placed(within.join(before, ["length", "salt"]).withColumn("rank", (F.col("before") + F.col("at")).cast("long")), patterns)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` packed into sequences of at most 4096 tokens."""
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
