"""Binary token files: independent zstandard frames, a document index and a trailing seek table.

A file is, in order: data frames, each an independent zstandard frame whose content is a run of token ids (unsigned
little-endian, 2 or 4 bytes); a skippable frame with the document index; and a skippable frame with the seek table of
the public Zstandard Seekable Format (per frame: compressed size, content size, low 32 bits of the content's XXH64;
then the number of frames, a descriptor byte with the checksum flag, and the magic number). A reader loads the two
tables from the end of the file, finds the frames that hold a document and decompresses only those.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces

# Fixed values of the public Zstandard Seekable Format and frame format.
SEEKABLE_MAGIC = 0x8F92EAB1
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
CHECKSUM_FLAG = 0x80

#: Token ids in a frame, at most; documents may share a frame and long ones span several.
FRAME_TOKENS = 1 << 16
#: Key of a row without doc_id in a file's index.
NO_ID = -(1 << 63)


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder, local or remote, as executors reach it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Appends documents to one file; at most one frame is held in memory."""

    def __init__(self, sink, width: int, frame_tokens: int = FRAME_TOKENS, level: int = 1):
        import zstandard

        self.sink, self.width, self.frame_tokens = sink, width, frame_tokens
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.ends: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.frame_tokens - self.n_held]
            self.held.append(part)
            self.n_held += len(part)
            at += len(part)
            if self.n_held == self.frame_tokens:
                self._flush()
        self.total += len(ids)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.ends.append(self.total)

    def _flush(self) -> None:
        if self.n_held:
            raw = np.concatenate(self.held).astype(f"<u{self.width}").tobytes()
            frame = self.zip.compress(raw)
            self.sink.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        body = self.zip.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.ends, "<i8").tobytes())
        body = struct.pack("<BIQQ", self.width, self.frame_tokens, len(self.ids), xxhash.xxh64_intdigest(body)) + body
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body) + 8) + body + struct.pack("<Q", len(body) + 16))
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.sink.close()


class Reader:
    """Random access to one file: only the frames that hold a requested document are read and decompressed."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        start = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(start, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        (length,) = struct.unpack("<Q", self._at(start - 8 - 8, 8))
        index = self._at(start - 8 - length, length - 8)
        if struct.unpack("<I", index[:4])[0] != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        self.width, self.frame_tokens, docs, digest = struct.unpack("<BIQQ", index[8:29])
        if xxhash.xxh64_intdigest(index[29:]) != digest:
            raise ValueError("damaged document index")
        both = np.frombuffer(self.unzip.decompress(index[29:]), "<i8")
        self.ids, self.ends = both[:docs], both[docs:]
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0))
        self.opened = 0

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            raw = self.unzip.decompress(self._at(int(self.places[k]), int(self.frames[k, 0])))
            if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"damaged frame {k}")
            self.kept = (k, np.frombuffer(raw, f"<u{self.width}"))
            self.opened += 1
        return self.kept[1]

    def parts(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the document at ``row`` of the index, a frame at a time."""
        at, end = (int(self.ends[row - 1]) if row else 0), int(self.ends[row])
        while at < end:
            k, skip = divmod(at, self.frame_tokens)
            got = self.frame(k)[skip : skip + end - at]
            yield got
            at += len(got)

    def document(self, doc_id: int) -> np.ndarray:
        rows = np.flatnonzero(self.ids == doc_id)
        if not len(rows):
            raise KeyError(doc_id)
        return np.concatenate([np.zeros(0, f"<u{self.width}"), *self.parts(int(rows[0]))])


def id_width(path: str, end_id: int) -> int:
    """Bytes of an id: 2 if every id of the vocabulary fits, else 4."""
    return 2 if max(pieces.library(path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 and end_id < 1 << 16 else 4


def encoded(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """(doc_id, ids binary of little-endian ids of ``width`` bytes, end_id last). Null text is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces.word_pieces(path)
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids, at = encode(common.strings(part.column("text")))
                ids = np.insert(ids, at[1:], end_id).astype(f"<u{width}")
                ends = width * (at + np.arange(len(at)))
                out = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), out.cast(pa.binary())], ["doc_id", "ids"])

    return common.bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def by_range(df: DataFrame, key: str, content: str, n: int, ids: DataFrame) -> DataFrame:
    """``df`` dealt to ``n`` partitions by ranges of ``key`` and sorted there, rows of one key by ``content``. The bounds come
    from ``ids``, which has the key alone, so what stands above ``df`` runs once; rows without a key are dealt over as many
    partitions before the others as is their share."""
    counted = ids.agg(F.count("*").alias("n"), F.count(key).alias("keyed")).first()
    without = counted["n"] - counted["keyed"]
    before = -(-without * n // counted["n"]) if without else 0
    marks = sorted(set(ids.approxQuantile(key, [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(int(x)) for x in marks]).cast("array<long>"), lambda x: x < F.col(key))) if marks else F.lit(0)
    return df.withColumn("_part", F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(max(before, 1)))).otherwise(part + before).cast("int")).repartitionById(n + before, "_part").sortWithinPartitions(F.col(key).asc_nulls_first(), content)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, n_files: int | None = None) -> list[dict]:
    """Encodes whole texts and writes them in ascending doc_id order to files ``tokens-NNNNN.zst`` under the shared
    ``folder``. Returns the manifest, one entry per file: file, docs, tokens, base (ids in all files before it).

    Rows without doc_id come first; repeated ids stay, each with its own entry; a null text is empty (its end id only);
    an empty table makes no file. A file is written under a name of the task's attempt and then renamed, so that
    repeated or speculative tasks leave one whole file."""
    spark = docs.sparkSession
    n = n_files or common.partitions(spark)
    width = id_width(path, end_id)
    ordered = by_range(encoded(docs, path, end_id, width), "doc_id", "ids", n, docs.select(F.col("doc_id").cast("long")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = name = None
        k = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if writer is None:
                    files, top = store(folder)
                    files.create_dir(top)
                    k = TaskContext.get().partitionId()
                    name = f"tokens-{k:05d}.zst"
                    own = f"{top}/{name}.{uuid.uuid4().hex}"
                    writer = Writer(files.open_output_stream(own, compression=None), width)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), f"<u{width}"))
        if writer is not None:
            writer.close()
            files.move(own, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"part": [k], "file": [name], "docs": [len(writer.ids)], "tokens": [writer.total]})

    rows = ordered.select("doc_id", "ids").mapInArrow(run, "part long, file string, docs long, tokens long").collect()
    base, out = 0, []
    for r in sorted(rows, key=lambda r: r["part"]):
        out.append({"file": r["file"], "docs": r["docs"], "tokens": r["tokens"], "base": base})
        base += r["tokens"]
    return out


def read_files(spark, folder: str, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files, a task each."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                files, top = store(folder)
                with files.open_input_file(f"{top}/{x['file']}") as source:
                    r = Reader(source)
                    starts = np.concatenate([[0], r.ends[:-1]])
                    sums = []
                    for row in range(len(r.ids)):
                        crc = 0
                        for part in r.parts(row):
                            crc = zlib.crc32(part.astype("<u4").data, crc)
                        sums.append(crc)
                    for at in range(0, len(sums), 50_000):
                        cut = slice(at, at + 50_000)
                        yield pa.RecordBatch.from_arrays([pa.array(r.ids[cut], mask=r.ids[cut] == NO_ID), pa.array(starts[cut] + x["base"]), pa.array(r.ends[cut] - starts[cut]), pa.array(sums[cut], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame([(k, m["file"], m["base"]) for k, m in enumerate(manifest)], "k int, file string, base long")
    return rows.repartitionById(len(manifest), "k").select("file", "base").mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    folder = os.environ.get("CORVANE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` written to token files and read back: doc_id, start, n_tokens, ids_crc32."""
    folder = f"{common.scratch(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write_files(common.table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_files(spark, folder, manifest)
