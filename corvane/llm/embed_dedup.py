"""Embedding near-duplicates by cross-polytope hashing with multiprobe buckets and verified pairs.

A vector is turned by three fast Hadamard rotations with random signs; its hash is the nearest corner of the cross
polytope, the coordinate of largest size with its sign. ``K`` such hashes make the bucket of a table. Every distinct
vector goes to its own bucket in each table and, as a probe, to the next likeliest ones by how little the corners lose;
in a bucket its own vectors are compared with all others there by cosine in double precision. A pair that meets in
several buckets counts in the first of them only, which both vectors' hashes tell, so links are counted in the buckets
and only counts and a spanning forest leave them.

Equal vectors are one class, compared once. Buckets of more than ``MOST`` rows are dealt to cells, each the pairs of two
blocks of the bucket, so that a hot bucket is shared by many tasks and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.95
MOST = 4_096
#: By number of hashes a table: tables and probes. At a cosine of 0.95 each finds over 0.999 of pairs (64 dimensions).
PLAN = {1: (4, 2), 2: (6, 4), 3: (10, 7), 4: (16, 12)}
TOP = 4  # corners that probes are made of, for each hash
SEED = 11
#: A cell: vectors of one size and bucket, of two of its blocks.
KEYS = ("bucket", "size", "i", "j")


def hashes_for(n: int) -> int:
    """Hashes a table, so that buckets keep a few vectors whatever their number."""
    k = 1
    while k < max(PLAN) and 128**k < n / 4:
        k += 1
    return k


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform along the last axis, whose size is a power of two, kept at equal length."""
    n = x.shape[-1]
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


def keys_of(x: np.ndarray, k: int, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket keys of unit vectors, the own bucket first."""
    rows, dim = x.shape
    size = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - dim)))
    rng = np.random.default_rng([SEED, dim])
    out = np.empty((rows, tables, 1 + probes), np.int64)
    base = 2 * size
    top = min(TOP, base)
    combos = np.array(list(product(range(top), repeat=k)))
    combos = combos[np.argsort(combos.sum(axis=1), kind="stable")][: max(64, 1 + probes)]
    for t in range(tables):
        code = np.zeros((rows, len(combos)), np.int64)
        loss = np.zeros((rows, len(combos)))
        for j in range(k):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            both = np.concatenate([y, -y], axis=1)
            best = np.argpartition(-both, top - 1, axis=1)[:, :top]
            worth = np.take_along_axis(both, best, 1)
            order = np.argsort(-worth, axis=1, kind="stable")
            best, worth = np.take_along_axis(best, order, 1), np.take_along_axis(worth, order, 1)
            code = code * base + best[:, combos[:, j]]
            loss += ((worth[:, :1] - worth) ** 2)[:, combos[:, j]]
        order = np.argsort(loss, axis=1, kind="stable")[:, : 1 + probes]
        found = np.take_along_axis(code, order, 1)
        if found.shape[1] < 1 + probes:
            found = np.pad(found, ((0, 0), (0, 1 + probes - found.shape[1])), mode="edge")
        out[:, t] = (found * 64 + t) * 8191 + dim
    return out


def unit(vectors: pa.Array) -> list[np.ndarray]:
    """The rows' vectors in double precision at length one."""
    flat, at = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    if len(vectors) and (np.diff(at) == at[1] - at[0]).all():
        x = flat.reshape(len(vectors), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return list(x / np.linalg.norm(x, axis=1, keepdims=True))
    rows = [flat[a:b] / np.abs(flat[a:b]).max() for a, b in zip(at[:-1], at[1:], strict=True)]
    return [x / np.linalg.norm(x) for x in rows]


def compare(x: np.ndarray, own: np.ndarray, block: np.ndarray, crossed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of one cell: one of each pair is in its own bucket, and in a crossed cell the two are
    of different blocks."""
    left, right = [], []
    mine = np.flatnonzero(own)
    step = max(1, (1 << 22) // max(1, len(x)))
    for at in range(0, len(mine), step):
        i = mine[at : at + step]
        hit = x[i] @ x.T >= threshold
        a, b = np.nonzero(hit)
        a = i[a]
        ok = (a != b) & (~own[b] | (a < b))
        if crossed:
            ok &= block[a] != block[b]
        left.append(a[ok])
        right.append(b[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def first_meetings(x: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: np.ndarray, plan: tuple[int, int, int]) -> np.ndarray:
    """Which pairs (a, b) of rows of ``x`` meet here for the first time: in the least of the buckets they share."""
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = keys_of(x[rows], *plan)
    ia, ib = place[: len(a)], place[len(a) :]
    out = np.zeros(len(a), bool)
    never = np.iinfo(np.int64).max
    for at in range(0, len(a), 16_384):
        ka, kb = keys[ia[at : at + 16_384]], keys[ib[at : at + 16_384]]
        least = np.full(len(ka), never)
        for p, q in ((ka, kb), (kb, ka)):  # within a table
            meets = (p[:, :, :1] == q).any(axis=2)
            least = np.minimum(least, np.where(meets, p[:, :, 0], never).min(axis=1))
        out[at : at + 16_384] = least == bucket[at : at + 16_384]
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row reaches over pairs (a, b)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def dedup_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors at a cosine of ``threshold`` or more), component_id (the least
    vec_id reachable, itself included), kept (vec_id = component_id).

    Null, empty or zero vectors and those with null or non-finite components link with nothing; vectors of different
    size do not link; equal vectors are linked, also rows with equal vec_id; a null vec_id takes part, and is its
    component's id only if no other is there; labels and other columns are not read; an empty table gives no rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # A class's name begins with its least id, in an order that text keeps, so a component's least name tells its id.
    at = F.coalesce(F.lpad(F.hex(F.col("least").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("~"))
    classes = common.staged(classes.withColumn("cid", F.concat_ws("-", at, F.hex(F.xxhash64("embedding")), F.hex(F.hash("embedding")))), "vectors")
    k = hashes_for(classes.count())
    plan = (k, *PLAN[k])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                by_size: dict[int, list[int]] = {}
                units = unit(part.column("embedding"))
                for i, x in enumerate(units):
                    by_size.setdefault(len(x), []).append(i)
                for index in by_size.values():
                    keys = keys_of(np.stack([units[i] for i in index]), *plan)
                    n, tables, each = keys.shape
                    row = pa.array(np.repeat(np.array(index), tables * each))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.full(len(row), len(units[index[0]]), np.int32)), pa.array(np.tile(np.arange(each) == 0, n * tables)), part.column("cid").take(row), part.column("weight").take(row), part.column("embedding").take(row)], ["bucket", "size", "own", "cid", "weight", "embedding"])

    schema = "bucket long, size int, own boolean, cid string, weight long, embedding array<double>"
    placed = classes.select("cid", "weight", "embedding").mapInArrow(spread, schema)
    large = placed.groupBy("bucket", "size").count().where(F.col("count") > most).select("bucket", "size", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    large = common.staged(large, "buckets")
    cells = placed.join(large, ["bucket", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cells = cells.withColumn("block", F.pmod(F.hash("cid"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("bucket", "size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "cid", "weight", F.col("embedding").cast("array<float>").alias("narrow"), "embedding")
    cells = cells.withColumn("embedding", F.when(F.col("narrow").cast("array<double>") == F.col("embedding"), None).otherwise(F.col("embedding")))

    def cell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            key = np.stack([t.column(c).to_numpy() for c in KEYS])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if not len(change):
                held = t
                continue
            yield from _linked(t.slice(0, int(change[-1])), plan, threshold)
            held = t.slice(int(change[-1]))
        if held is not None and held.num_rows:
            yield from _linked(held, plan, threshold)

    found = cells.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(cell, "a string, b string, n long")
    found = common.staged(found, "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    parts = common.components(found.where("b IS NOT NULL").select("a", "b"))
    known = classes.join(counts, classes["cid"] == counts["a"], "left").join(parts, F.col("cid") == F.col("id"), "left").select("embedding", F.coalesce("root", "cid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    least = (F.conv(F.substring("root", 1, 16), 16, 10).cast("decimal(20, 0)") - F.lit(str(1 << 63)).cast("decimal(20, 0)")).cast("long")
    known = known.select("embedding", "n_links", F.when(~F.col("root").startswith("~"), least).alias("component_id"), F.lit(True).alias("sound"))
    out = rows.join(known, ["embedding", "sound"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _linked(t: pa.Table, plan: tuple[int, int, int], threshold: float) -> Iterator[pa.RecordBatch]:
    """Counts (a, null, n) and forest edges (a, b, 0) of whole cells in order."""
    key = np.stack([t.column(c).to_numpy() for c in KEYS])
    starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
    sizes = np.diff(starts)
    if not (sizes > 1).any():
        return
    keep = np.repeat(sizes > 1, sizes)
    t = t.filter(pa.array(keep)).combine_chunks()
    sizes = sizes[sizes > 1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bucket = t.column("bucket").to_numpy()
    crossed = t.column("i").to_numpy() != t.column("j").to_numpy()
    own = t.column("own").to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, bool)
    block = t.column("block").to_numpy()
    narrow, wide = t.column("narrow").combine_chunks(), t.column("embedding").combine_chunks()
    if wide.null_count == len(wide):
        units = unit(narrow)
    else:
        units = [unit(w)[0] if w[0].is_valid else unit(n)[0] for n, w in ((narrow.slice(i, 1), wide.slice(i, 1)) for i in range(len(narrow)))]
    left, right = [], []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        a, b = compare(np.stack(units[lo:hi]), own[lo:hi], block[lo:hi], bool(crossed[lo]), threshold)
        if len(a):
            left.append(a + lo)
            right.append(b + lo)
    if not left:
        return
    a, b = np.concatenate(left), np.concatenate(right)
    for size in {len(units[i]) for i in np.unique(a).tolist()}:
        of = np.array([len(u) == size for u in units])
        rows = np.cumsum(of) - 1
        mine = of[a]
        first = np.zeros(len(a), bool)
        first[mine] = first_meetings(np.stack([u for u in units if len(u) == size]), rows[a[mine]], rows[b[mine]], bucket[a[mine]], plan)
        mine &= first
        x, y = a[mine], b[mine]
        if not len(x):
            continue
        weight = t.column("weight").to_numpy()
        n = np.bincount(x, weights=weight[y], minlength=len(own)) + np.bincount(y, weights=weight[x], minlength=len(own))
        low = forest(len(own), x, y)
        cid = t.column("cid").combine_chunks().cast(pa.string())
        counted, tied = np.flatnonzero(n), np.flatnonzero(low != np.arange(len(own)))
        yield pa.RecordBatch.from_arrays([cid.take(pa.array(counted)), pa.nulls(len(counted), pa.string()), pa.array(n[counted].astype(np.int64))], ["a", "b", "n"])
        if len(tied):
            yield pa.RecordBatch.from_arrays([cid.take(pa.array(tied)), cid.take(pa.array(low[tied])), pa.array(np.zeros(len(tied), np.int64))], ["a", "b", "n"])


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicate components of all of ``embeddings``."""
    return dedup_embeddings(common.table(spark, sf_dir, "embeddings"))
