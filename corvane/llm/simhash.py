"""SimHash near-duplicates by anchor-point covering.

*Fingerprint.* A text's ASCII letters are lowered, its words cut at ASCII white space; each four-word shingle, repeats
included, is hashed by XXH64 (seed 42); a bit is 1 if over half the hashes have it.

*Anchors.* The 64 bits are cut into three blocks of 22, 21 and 21 bits, each padded to the 23 bits of the perfect binary
Golay code, whose 4096 codewords (the anchors) cover every word within radius 3. Two fingerprints at 4 or fewer
differing bits differ by at most 1 bit in some block; there the anchor nearest to one is within 3 of it and within
3 + 1 of the other. So every fingerprint is replicated, in each block, to all anchors within 4 (the covering radius and
the block's threshold, 5.3 on average), and pairs are compared at each anchor only. For very many fingerprints two
blocks are joined: of any such pair's blocks two differ by at most 2 bits together, so anchors within (3, 5), (4, 4) or
(5, 3) of two blocks at once make buckets thousands of times smaller. Both are exact.

Only distinct fingerprints are compared, so a group of copies is one; at an anchor a spanning forest of the links is
kept, never all pairs. Within 4 bits of a fingerprint there are at most 679,121 words, which bounds what one hot group
adds to a bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: The generator polynomial of the binary Golay code [23, 12, 7], and the blocks of a fingerprint.
GOLAY = 0b101011100011
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints from which two blocks are joined.
JOIN_FROM = 1 << 24
#: Fingerprints of one block of an anchor.
MOST = 8_192
#: Shingles that are counted in one go.
CHUNK = 1 << 16


def hashes_of(words: np.ndarray, text: bytes) -> np.ndarray:
    """The hashes of the shingles of ``text``, which is the words joined by single spaces; ``words`` are their starts, then
    len(text) + 1."""
    n = len(words) - 1
    if n < 1:
        return np.zeros(0, np.uint64)
    k = min(n, SHINGLE)
    first, last = words[: n - k + 1], words[k:] - 1
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(first), np.uint64)
    for at in range(0, len(first), CHUNK):
        out[at : at + CHUNK] = [digest(text[a:b], SEED) for a, b in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)]
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(words: np.ndarray, text: bytes) -> int:
    return majority(hashes_of(words, text))


def cut_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Each text's words, as ``hashes_of`` takes them; null is empty."""
    clean = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.ascii_lower(common.strings(texts)), "[\\x20\\x09-\\x0D]+", " "))
    for t in clean:
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        yield (np.concatenate([[0], spaces + 1, [len(raw) + 1]]) if raw else np.zeros(1, np.int64)), raw


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, the 64 bits as a signed number). Null text is empty: fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                out = np.array([fingerprint(words, raw) for words, raw in cut_words(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return common.bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class Anchors:
    """For a 23-bit word, the codewords of the Golay code within a radius, by its syndrome."""

    def __init__(self):
        def remainder(x: int) -> int:
            for bit in range(22, 10, -1):
                if x >> bit & 1:
                    x ^= GOLAY << (bit - 11)
            return x

        self.low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
        self.high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def errors(self, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Error patterns of at most ``radius`` bits in order of syndrome: starts and numbers by syndrome, patterns."""
        if radius not in self.found:
            e = np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(23), r)], np.int64)
            s = self.syndrome(e)
            order = np.argsort(s, kind="stable")
            n = np.bincount(s, minlength=1 << 11)
            self.found[radius] = (np.cumsum(n) - n, n, e[order])
        return self.found[radius]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    def near(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, codeword) for each codeword within ``radius`` of each x."""
        start, n, e = self.errors(radius)
        s = self.syndrome(x)
        row = np.repeat(np.arange(len(x)), n[s])
        at = np.arange(len(row)) - np.repeat(np.cumsum(n[s]) - n[s], n[s]) + np.repeat(start[s], n[s])
        return row, x[row] ^ e[at]


_anchors: list[Anchors] = []


def anchors() -> Anchors:
    if not _anchors:
        _anchors.append(Anchors())
    return _anchors[0]


def replicas(fp: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor that unsigned fingerprints go to."""
    a = anchors()
    blocks = [((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in BLOCKS]
    out = []
    if not joined:
        for k, x in enumerate(blocks):
            row, word = a.near(x, 3 + 1)
            out.append((row, word | k << 23))
    else:
        for k, (i, j) in enumerate(combinations(range(3), 2)):
            seen = []
            for p, q in ((3, 5), (4, 4), (5, 3)):
                r1, w1 = a.near(blocks[i], p)
                r2, w2 = a.near(blocks[j][r1], q)
                seen.append(np.stack([r1[r2], w1[r2] | w2 << 23 | k << 46]))
            both = np.unique(np.concatenate(seen, axis=1), axis=1)
            out.append((both[0], both[1]))
    return np.concatenate([r for r, _ in out]), np.concatenate([w for _, w in out])


def forest(fp: np.ndarray, threshold: int = THRESHOLD, block: int = 1 << 20) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links among distinct fingerprints: breadth-first, each step comparing one
    fingerprint with those not yet reached, after those without any link are set aside."""
    n = len(fp)
    linked = np.zeros(n, bool)
    step = max(1, block // max(1, n))
    for at in range(0, n, step):
        near = np.bitwise_count(fp[at : at + step, None] ^ fp[None, :]) <= threshold
        linked[at : at + step] = near.sum(axis=1) > 1
    left = np.flatnonzero(linked)
    out: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[x]) <= threshold
        if near.any():
            reached = left[near].tolist()
            out += [(x, y) for y in reached]
            queue += reached
            left = left[~near]
    return out


def links(prints: DataFrame, n: int, most: int = MOST, join_from: int = JOIN_FROM) -> DataFrame:
    """A spanning set of the links (a, b) among ``n`` distinct fingerprints (column fp). An anchor of over ``most`` of them is
    dealt to cells, each of two blocks, so that no task holds more than two blocks of a hot anchor at once."""
    joined = n >= join_from

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            size = 2_000 if joined else 20_000
            for at in range(0, len(fp), size):
                row, word = replicas(fp[at : at + size], joined)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(fp[at : at + size][row].view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column("fps"):
                fp = np.sort(group.values.to_numpy().view(np.uint64))
                for x, y in forest(fp):
                    a.append(fp[x])
                    b.append(fp[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    placed = prints.select("fp").mapInArrow(spread, "anchor long, fp long")
    large = placed.groupBy("anchor").count().where(F.col("count") > most).select("anchor", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    cells = placed.join(common.staged(large, "anchors"), "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    buckets = cells.groupBy("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))
    return buckets.where(F.size("fps") > 1).select("fps").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    A null, empty or blank text has fingerprint zero, linked like any other; a text of fewer than four words is one
    shingle; rows without doc_id take part and have component_id null only if no id is reachable; repeated rows stay;
    an empty table gives no rows; other columns are not read."""
    return grouped(common.staged(fingerprints(docs), "fingerprints"))


def grouped(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The components of ``prints`` (doc_id, fp), whose links ``more`` (a, b: fingerprints) adds to."""
    least = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = links(least, least.count())
    parts = common.components(edges if more is None else edges.unionByName(more))
    grouped = least.join(parts, least["fp"] == parts["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    found = grouped.join(lowest, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicate components of all of ``documents``."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
