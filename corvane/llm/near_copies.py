"""Near copies of five-word similarity: SimHash links and all pairs of texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8.

*Shingles.* The words are those of ``simhash``. Two neighbouring four-word shingles are one five-word shingle, so the hashes
that the fingerprint is made of give the others too; a text of fewer than five words is one shingle.

*Candidates.* ``BANDS`` bands of ``ROWS`` minima each: a pair of similarity 0.8 has a band in common but for
(1 - 0.8^4)^32 = 5e-8 of all cases, a likelier one still less. Copies, with equal sets, are one candidate. Texts that any chain of
common bands joins are a group, by stars of each band and their components, so that no band makes pairs.

*Links.* Each text of a group is read once more and meets the others in one place, where the similarity is worked out
exactly and a spanning forest of the links is kept. A group has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: Shingles that are permuted in one go.
CHUNK = 1 << 10

_random = np.random.default_rng(42)
FLIP, STEP = (_random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))
MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The distinct five-word shingles, sorted, of a text's four-word ones."""
    if len(hashes) < 2:
        return hashes
    x = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ x >> np.uint64(32))


def bands(grams: np.ndarray) -> np.ndarray:
    """One number for each band."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), CHUNK):
        low = np.minimum(low, ((grams[None, at : at + CHUNK] ^ FLIP[:, None]) * STEP[:, None]).min(axis=1))
    x = ((low ^ low >> np.uint64(29)).reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) ^ np.arange(BANDS, dtype=np.uint64)


def marked(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return common.bound_batches(docs).select(F.col("doc_id").cast("long"), F.md5(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, mark: MD5 of the text, key: digest of the set of shingles, bands); a text without words has no key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                fp, key, found = np.zeros(part.num_rows, np.uint64), [], []
                for i, (words, raw) in enumerate(simhash.cut_words(part.column("text"))):
                    hashes = simhash.hashes_of(words, raw)
                    fp[i] = simhash.majority(hashes)
                    grams = shingles(hashes)
                    key.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                    found.append(bands(grams).view(np.int64) if len(grams) else None)
                columns = [part.column("doc_id"), pa.array(fp.view(np.int64)), part.column("mark"), pa.array(key, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "mark", "key", "bands"])

    return marked(docs).mapInArrow(run, "doc_id long, fp long, mark string, key binary, bands array<long>")


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links among sets: breadth-first, each step counting what one set shares with
    those not yet reached, over an index that is made anew when half of them are."""
    num, den = LEAST
    sizes = np.array([len(s) for s in sets])
    left = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    queue: list[int] = []
    held = 0
    while left.any():
        if 2 * np.count_nonzero(left) < held or not held:
            rest = np.flatnonzero(left)
            held = len(rest)
            flat, owner = np.concatenate([sets[i] for i in rest]), np.repeat(rest, sizes[rest])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
        if not queue:
            queue.append(int(np.argmax(left)))
            left[queue[0]] = False
        x = queue.pop()
        first, last = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        n = last - first
        shared = np.bincount(owner[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)], minlength=len(sets))
        near = np.flatnonzero(left & (den * shared >= num * (sizes + sizes[x] - shared)))
        left[near] = False
        out += [(x, y) for y in near.tolist()]
        queue += near.tolist()
    return out


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """A spanning set of the links (a, b) among the fingerprints of near copies; ``prints`` are the signatures of ``docs``."""
    sound = prints.where("key IS NOT NULL")
    units = common.staged(sound.groupBy("key").agg(F.min("fp").alias("fp"), F.min("mark").alias("mark"), F.first("bands").alias("bands")), "units")
    same = sound.select("key", F.col("fp").alias("b")).distinct().join(units.select("key", F.col("fp").alias("a")), "key").where("a <> b").select("a", "b")
    banded = units.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "low")
    stars = banded.join(shared, "band").where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    groups = common.components(stars).withColumnRenamed("id", "key")
    wanted = common.staged(units.select("key", "fp", "mark").join(groups, "key").select("mark", "fp", "root"), "candidates")
    texts = marked(docs).select("mark", "text").join(wanted.select("mark"), "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [shingles(simhash.hashes_of(words, raw)).view(np.int64) for words, raw in simhash.cut_words(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("mark"), pa.array(found, pa.list_(pa.int64()))], ["mark", "grams"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column("members"):
                members = group.values
                fp, lists = members.field("fp").to_numpy(), members.field("grams")
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
                for x, y in forest([flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]):
                    if fp[x] != fp[y]:
                        a.append(fp[x])
                        b.append(fp[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    met = texts.mapInArrow(grams, "mark string, grams array<long>").join(wanted, "mark").groupBy("root").agg(F.collect_list(F.struct("fp", "grams")).alias("members"))
    return met.select("members").mapInArrow(compare, "a long, b long").unionByName(same).distinct()


def representatives(docs: DataFrame) -> DataFrame:
    """(doc_id, mark: MD5 of the text, null as empty) of the rows that stay: of each group of near duplicates, by links of 4
    bits and of near copies, the row of the smallest doc_id (null last) and then mark. Rows of equal doc_id and text are one.
    Texts that are alike only in their doc_id are not a group."""
    prints = common.staged(signatures(docs), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    least = common.staged(prints.groupBy("fp").agg(F.min(row).alias("row")), "distinct")
    parts = common.components(simhash.links(least, least.count()).unionByName(links(docs, prints)))
    rooted = least.join(parts, least["fp"] == parts["id"], "left").select("row", F.coalesce("root", "fp").alias("root"))
    return rooted.groupBy("root").agg(F.min("row").alias("row")).select("row.doc_id", "row.mark")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``simhash.near_duplicates`` with the links of near copies besides those of 4 bits: doc_id, fingerprint, component_id."""
    prints = common.staged(signatures(docs), "signatures")
    return simhash.grouped(prints.select("doc_id", "fp"), links(docs, prints))
