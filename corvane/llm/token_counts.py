"""Token counts of sections and fields by offset-mapped attribution.

A document is encoded once and whole, since tokens at a boundary differ from those of the parts alone. Byte-level tokens
tile the text's bytes, so their character spans follow from byte lengths; an interval join of the sorted spans with the
sorted section starts gives each token's sections. A token over a boundary is allocated by an explicit rule:
``first`` or ``last``: to the section of its first or last character; ``larger``: to the section with most of its
characters, the earlier of equals; ``share``: to all its sections in proportion to its characters there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces, transducer
from .token_files import tokenizer_path

RULES = ("first", "last", "larger", "share")


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, stop: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section. Tokens are spans [first, end) in order, sections begin at
    ``starts`` (ascending, may be empty ones) and the last ends at ``stop``."""
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, end - 1, side="right") - 1
    n = len(starts)
    over = np.flatnonzero(b > a)
    crossing = np.bincount(np.concatenate([a[over], b[over]]), minlength=n)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float), crossing
    counts = np.bincount(a, minlength=n).astype(float)
    if rule != "first" and len(over):
        size = b[over] - a[over] + 1
        tok = np.repeat(over, size)
        sec = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size) + a[tok]
        ends = np.append(starts[1:], stop)
        part = np.clip(np.minimum(end[tok], ends[sec]) - np.maximum(first[tok], starts[sec]), 0, None)
        counts -= np.bincount(a[over], minlength=n)
        if rule == "share":
            counts += np.bincount(sec, weights=part / (end[tok] - first[tok]), minlength=n)
        else:
            best = np.lexsort((sec, -part, tok))
            lead = np.concatenate([[True], tok[best][1:] != tok[best][:-1]])
            counts += np.bincount(sec[best][lead], minlength=n)
    return counts, crossing


def _run(path: str, rule: str, key: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces.spaced(path)
        size_of = np.array([len(x) for x in transducer.byte_table(path)])
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.strings(part.column("text"))
                ids, _ = encode(texts)
                raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.nbytes and texts.buffers()[2] else np.zeros(0, np.uint8)
                ends = texts.offsets.to_numpy() if hasattr(texts, "offsets") else np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
                raw = raw[: ends[-1]]
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
                docs = chars[ends]
                stop = np.cumsum(size_of[ids])
                first, end = chars[stop - size_of[ids] + 1] - 1, chars[stop]
                if "starts" in part.schema.names:
                    given = part.column("starts")
                    flat, at = given.flatten().to_numpy(), given.offsets.to_numpy() - given.offsets[0].as_py()
                    doc = np.repeat(np.arange(len(texts)), np.diff(at))
                    starts = flat + docs[doc]
                    number = np.arange(len(doc)) - at[doc]
                else:
                    lines = np.flatnonzero(raw == 10) + 1
                    inside = lines[~np.isin(lines, ends)]
                    starts = np.concatenate([docs[:-1], chars[inside]])
                    doc = np.concatenate([np.arange(len(texts)), np.searchsorted(ends, inside, side="right") - 1])
                    order = np.lexsort((starts, doc))
                    starts, doc = starts[order], doc[order]
                    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                counts, crossing = allocate(first, end, starts, int(docs[-1]), rule)
                last = np.append(starts[1:], docs[-1])
                out = [part.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(starts - docs[doc], pa.int64()), pa.array(last - docs[doc], pa.int64()), pa.array(counts) if rule == "share" else pa.array(counts.astype(np.int64)), pa.array(crossing, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, [key, "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return run


def _schema(rows: DataFrame, rule: str, key: str) -> str:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    return f"`{key}` {rows.schema[key].dataType.simpleString()}, section int, start_char long, end_char long, n_tokens {'double' if rule == 'share' else 'long'}, n_crossing long"


def line_counts(docs: DataFrame, path: str, rule: str = "first", key: str = "doc_id") -> DataFrame:
    """Tokens of each line (with its line feed) of every whole text: key, section (from 0), start_char, end_char,
    n_tokens, n_crossing (tokens that reach over one of its boundaries).

    A null or empty text is one section without tokens; null and repeated keys are carried along, each row for itself;
    an empty table gives no rows; other columns are not read. A document's n_tokens add up to its whole count."""
    return common.bound_batches(docs).select(F.col(f"`{key}`").alias("key"), F.col("text").cast("string")).mapInArrow(_run(path, rule, key), _schema(docs, rule, key))


def field_counts(rows: DataFrame, key: str, fields: list[str], path: str, rule: str = "first", separator: str = "\n") -> DataFrame:
    """As line_counts, but a row's text is its ``fields`` joined by ``separator`` (null: empty) and section k is field k
    with the separator that follows it."""
    filled = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    starts, at = [], F.lit(0)
    for f in filled:
        starts.append(at)
        at = at + F.length(f) + len(separator)
    made = common.bound_batches(rows).select(F.col(f"`{key}`").alias("key"), F.concat_ws(separator, *filled).alias("text"), F.array(*starts).cast("array<long>").alias("starts"))
    return made.mapInArrow(_run(path, rule, key), _schema(rows, rule, key))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: the tokens of every line of all of ``documents``; a token over a line's end counts where it begins."""
    return line_counts(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
