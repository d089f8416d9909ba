"""I-Match document fingerprints over randomised lexicons.

Terms are words (ASCII letters lowered, cut at ASCII white space). The lexicon holds the terms whose document frequency
lies in a band: neither too common to tell documents apart nor too rare to be stable. Of it, ``SUBSETS`` lexicons are
drawn by salted hashes, at rates falling by powers of two, so that short and long documents alike have lexicons that
catch a few of their terms. For each lexicon a document's distinct terms in it are sorted and hashed; the fingerprint is
these hashes side by side. The likeness of two fingerprints is the share of equal hashes among the lexicons in which
either document has a term; two fingerprints without any term are alike if equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The band, as shares of all documents. At most (terms a document) / LOWEST terms can lie in it, which bounds what is
#: sent to the tasks (8 bytes a term) whatever the number of documents.
LOWEST, HIGHEST = 0.001, 0.1
#: A document with fewer terms of the lexicon is fingerprinted by all its terms.
FEW = 4
LEVELS, EACH = 11, 12
SUBSETS = LEVELS * EACH
EMPTY = "...."


def term_hashes(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def doc_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct (document, term) pairs in order, as rows and codes, and the terms of the codes."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = words.offsets.to_numpy() - words.offsets[0].as_py()
    d = words.flatten().dictionary_encode()
    n = max(1, len(d.dictionary))
    pair = np.unique(np.repeat(np.arange(len(texts)), np.diff(at)) * n + d.indices.to_numpy())
    row, code = np.divmod(pair, n)
    if len(d.dictionary):
        blank = pc.equal(d.dictionary, "").to_numpy(zero_copy_only=False)
        if blank.any():
            keep = ~blank[code]
            row, code = row[keep], code[keep]
    return row, code, d.dictionary


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df) over all documents; each task sums its own counts first, in bounded memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])

        def given(t: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(t.set_column(0, "term", t["term"].cast(pa.string())).to_batches(max_chunksize=50_000))

        for batch in batches:
            for part in common.slices(batch, "text"):
                _, code, terms = doc_terms(common.strings(part.column("text")))
                df = np.bincount(code, minlength=len(terms))
                held.append(pa.table({"term": terms, "df": pa.array(df)}).filter(pa.array(df > 0)))
            if sum(len(t) for t in held) > 600_000:
                held = [summed()]
                if len(held[0]) > 400_000:
                    yield from given(held.pop())
        if held:
            yield from given(summed())

    return common.bound_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, lowest: float = LOWEST, highest: float = HIGHEST) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = docs.count()
    rows = document_frequency(docs).where(F.col("df").between(max(2, lowest * n), max(2, highest * n))).select("term").toArrow()
    return np.sort(term_hashes(rows.column("term").to_pylist()))


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser of x and a salt."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """(texts, SUBSETS) of hashes from 0 to 65535, -1 where a text has no term in the lexicon."""
    out = np.full((len(texts), SUBSETS), -1, np.int32)
    row, code, terms = doc_terms(texts)
    if not len(row):
        return out
    known = term_hashes(terms.to_pylist())
    at = np.searchsorted(words, known)
    inside = np.zeros(len(known), bool)
    if len(words):
        inside = words[np.minimum(at, len(words) - 1)] == known
    few = np.bincount(row, weights=inside[code], minlength=len(texts)) < FEW
    keep = inside[code] | few[row]
    row, code = row[keep], code[keep]
    order = np.lexsort((known[code], row))
    row, code = row[order], code[order]
    used, code = np.unique(code, return_inverse=True)
    known = known[used]
    sorted_terms = known[code]
    for k in range(SUBSETS):
        mine = (mixed(known, k + 1) >> np.uint64(63 - k // EACH) == 0)[code]
        if not mine.any():
            continue
        raw = memoryview(np.ascontiguousarray(sorted_terms[mine])).cast("B")
        docs, first = np.unique(row[mine], return_index=True)
        ends = np.append(first[1:], int(mine.sum()))
        digest = xxhash.xxh32_intdigest
        out[docs, k] = [digest(raw[8 * a : 8 * b], k) & 0xFFFF for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = (a >= 0) | (b >= 0)
    filled = either.reshape(-1, LEVELS, EACH).sum(axis=2)
    fit = (filled > 0) & (filled <= 0.75 * EACH)
    fit[~fit.any(axis=1)] = True
    either &= np.repeat(fit, EACH, axis=1)
    equal = ((a == b) & either).sum(axis=1)
    either = either.sum(axis=1)
    return np.where(either > 0, equal / np.maximum(either, 1), 1.0)


def spelled(prints: np.ndarray) -> list[str]:
    return ["".join(f"{x:04x}" if x >= 0 else EMPTY for x in row) for row in prints.tolist()]


def fingerprint_documents(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """All columns of ``docs`` with fingerprint, which replaces a column of this name; null text is empty and has no term in any lexicon."""
    names = [n for n in docs.columns if n != "fingerprint"]
    own = common.free_name(docs, "text_read")
    source = common.bound_batches(docs).select(F.col("text").cast("string").alias(own), *[F.col(f"`{n}`") for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, own):
                prints = spelled(fingerprints(common.strings(part.column(0)), words))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(prints, pa.string())], [*names, "fingerprint"])

    return source.mapInArrow(run, docs.select(*[F.col(f"`{n}`") for n in names], F.lit("").alias("fingerprint")).schema)


def with_successor(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, packed, copy): ``n`` partitions by ranges of doc_id, sorted; each ends with a copy of the first row of the
    next one that has rows, the last with the first row of all. Texts are dealt once, each a zstandard frame, which
    shuffles a third less than text; bounds come from ids alone."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = common.bound_batches(docs).select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_pack, "key long, doc_id long, packed binary")
    ids = docs.select(key.alias("key"))
    marks = sorted({int(x) for x in ids.approxQuantile("key", [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, marks)), lambda x: x < F.col("key"))) if marks else F.lit(0)
    firsts = sorted((r["part"], r["key"]) for r in ids.groupBy(part.alias("part")).agg(F.min("key").alias("key")).collect())
    before = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}  # of the first range: the last
    back = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    places = F.array(F.struct(part.cast("int").alias("part"), F.lit(0).alias("copy")))
    if back is not None:
        copy = F.struct(F.try_element_at(back, F.col("key")).cast("int").alias("part"), F.lit(1).alias("copy"))
        places = F.filter(F.concat(places, F.array(copy)), lambda x: x["part"].isNotNull())
    dealt = keyed.select("key", "doc_id", "packed", F.explode(places).alias("at")).select("key", "doc_id", "packed", "at.part", "at.copy")
    return dealt.repartitionById(n, "part").sortWithinPartitions("copy", "key", "packed").select("doc_id", "packed", "copy")


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in common.slices(batch, "text"):
            packed = [pack(t.as_buffer()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(packed, pa.binary())], ["key", "doc_id", "packed"])


def edits(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last half of its characters replaced by as many
    of the next document's first) and the likeness of its own to both the edited text's and the next document's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
            texts = [t for _, t in rows]
            after = [*texts[1:], following]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, after, strict=True)]
            own = fingerprints(pa.array([*texts, following], pa.large_string()), words)
            new = fingerprints(pa.array(edited, pa.large_string()), words)
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([_sha256(t) for t in edited], pa.string()), pa.array(spelled(own[:-1]), pa.string()), pa.array(spelled(new), pa.string()), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:]))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int | None, str]] = []
        size, ended = 0, False
        for batch in batches:
            for doc_id, packed, copy in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("copy").to_pylist(), strict=True):
                if copy and ended:
                    continue
                text = unpack(packed.as_buffer()).decode()
                if held and (copy or size > common.SLICE_BYTES // 2):
                    yield done(held, text)
                    held, size = [], 0
                ended = ended or bool(copy)
                if not copy:
                    held.append((doc_id, text))
                    size += len(text)

    return with_successor(docs, common.partitions(docs.sparkSession)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _sha256(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def op10_imatch(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all of ``documents`` and their edited texts."""
    docs = common.table(spark, sf_dir, "documents")
    return edits(docs, lexicon(docs))
