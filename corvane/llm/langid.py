"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes (ASCII letters lowered) in windows of ``WINDOW`` bytes that tile the whole text, forwards
and backwards, and labels every position; a document's probabilities are the mean over all its positions. It is trained
here, in numpy, by backpropagation through time with Adam on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
WINDOW = 192
HIDDEN = 12
#: The bounded training sample: labelled documents of each language, and characters of each, from a place in the text
#: that its hash chooses.
SAMPLE_DOCUMENTS = 1_500
MOST_ROWS = 50_000
SAMPLE_CHARS = 400
STEPS, BATCH, SPAN, RATE, SEED = 320, 128, 96, 0.012, 20
#: Windows that are run side by side.
ROWS = 1_024


@dataclass
class Network:
    """Index 0 of the first axis is the forward direction, 1 the backward one. Gates in order: update, reset, new."""

    languages: list[str]
    byte: np.ndarray  # 2, 256, 3H: input weights and biases of each byte
    state: np.ndarray  # 2, H, 3H
    bias: np.ndarray  # 2, 1, H: of the state's part of the new gate
    out: np.ndarray  # 2, H, K
    last: np.ndarray  # K

    def parameters(self) -> list[np.ndarray]:
        return [self.byte, self.state, self.bias, self.out, self.last]


def fresh(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    k = len(languages)
    return Network(languages, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=hidden**-0.5), np.zeros((2, 1, hidden), np.float32), draw(2, hidden, k, scale=hidden**-0.5), np.zeros(k, np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def gradients(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of windows ``x`` (B, T bytes), and its gradients through time."""
    b, span = x.shape
    h_size = net.state.shape[1]
    both = np.stack([x, x[:, ::-1]])
    side = np.arange(2)[:, None]
    h = np.zeros((2, b, h_size), np.float32)
    tape, states = [], np.zeros((span, 2, b, h_size), np.float32)
    for t in range(span):
        g = net.byte[side, both[:, :, t]]
        u = h @ net.state
        zr = sigmoid(g[..., : 2 * h_size] + u[..., : 2 * h_size])
        z, r = zr[..., :h_size], zr[..., h_size:]
        m = u[..., 2 * h_size :] + net.bias
        n = np.tanh(g[..., 2 * h_size :] + r * m)
        tape.append((h, z, r, m, n))
        h = n + z * (h - n)
        states[t] = h
    forward, backward = states[:, 0], states[::-1, 1]
    scores = forward @ net.out[0] + backward @ net.out[1] + net.last
    scores -= scores.max(axis=-1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=-1, keepdims=True)
    loss = float(-np.log(np.maximum(p[:, np.arange(b), label], 1e-9)).mean())
    d = p
    d[:, np.arange(b), label] -= 1
    d /= np.float32(b * span)
    d_out = np.stack([np.einsum("tbh,tbk->hk", forward, d), np.einsum("tbh,tbk->hk", backward, d)])
    d_states = np.stack([d @ net.out[0].T, (d @ net.out[1].T)[::-1]], axis=1)
    d_state, d_bias, d_byte = np.zeros_like(net.state), np.zeros_like(net.bias), np.zeros_like(net.byte)
    carry = np.zeros((2, b, h_size), np.float32)
    gates = np.empty((2, b, 3 * h_size), np.float32)
    inner = np.empty_like(gates)
    for t in range(span - 1, -1, -1):
        h, z, r, m, n = tape[t]
        dh = d_states[t] + carry
        dn = dh * (1 - z) * (1 - n * n)
        gates[..., :h_size] = dh * (h - n) * z * (1 - z)
        gates[..., h_size : 2 * h_size] = dn * m * r * (1 - r)
        gates[..., 2 * h_size :] = dn
        inner[...] = gates
        inner[..., 2 * h_size :] *= r
        d_state += h.transpose(0, 2, 1) @ inner
        d_bias += inner[..., 2 * h_size :].sum(axis=1, keepdims=True)
        carry = dh * z + inner @ net.state.transpose(0, 2, 1)
        for k in range(2):
            np.add.at(d_byte[k], both[k, :, t], gates[k])
    return loss, [d_byte, d_state, d_bias, d_out, d.sum(axis=(0, 1))]


def train(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, span: int = SPAN, rate: float = RATE, seed: int = SEED) -> Network | None:
    """Fits a network to (language, bytes) samples, languages in equal shares; None without samples. The same samples in
    the same order give the same network."""
    languages = sorted({x for x, _ in samples})
    if not languages:
        return None
    streams = [np.frombuffer(b"\n".join([t for x, t in samples if x == k]) + b"\n", np.uint8) for k in languages]
    streams = [np.tile(s, 1 + span // len(s)) if len(s) <= span else s for s in streams]
    rng = np.random.default_rng(seed)
    net = fresh(languages, hidden, rng)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        label = rng.integers(0, len(languages), batch)
        x = np.stack([s[a : a + span] for s, a in ((streams[k], int(rng.integers(0, len(streams[k]) - span + 1))) for k in label)])
        _, grads = gradients(net, x, label)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2.0 * (1 - (step - 1) / steps)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(size, 1e-9)))
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            p -= np.float32(pace) * m / (np.sqrt(v) + np.float32(1e-8))
    return net


def run_windows(net: Network, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums of the position probabilities of each window [start, start + length) of ``raw``: one row of K each. Windows
    must come longest first."""
    h_size, k = net.state.shape[1], len(net.languages)
    half = np.float32(0.5)
    # Update and reset gates are halved: sigmoid(x) = (1 + tanh(x / 2)) / 2. Each gate has arrays of its own.
    parts = [(slice(j * h_size, (j + 1) * h_size), half if j < 2 else np.float32(1)) for j in range(3)]
    byte = [[np.ascontiguousarray(net.byte[side][:, cut] * f) for cut, f in parts] for side in (0, 1)]
    state = [[np.ascontiguousarray(net.state[side][:, cut] * f) for cut, f in parts] for side in (0, 1)]
    out = [np.ascontiguousarray(net.out[side].T) for side in (0, 1)]
    last = net.last[:, None]
    total = np.zeros((len(start), k), np.float32)
    for at in range(0, len(start), ROWS):
        begin, size = start[at : at + ROWS], length[at : at + ROWS]
        span = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(span), side="left")  # windows longer than t
        whole = int(np.searchsorted(-size, -span, side="right"))
        ahead = np.empty((span, k, len(begin)), np.float32)
        sums = np.zeros((k, len(begin)), np.float32)
        for side in (0, 1):
            h = np.zeros((len(begin), h_size), np.float32)
            at_byte = begin if side == 0 else begin + size - 1
            for t in range(span):
                m = int(active[t])
                h = h[:m]
                x = raw[at_byte[:m] + (t if side == 0 else -t)]
                z, r, n = (h @ u for u in state[side])
                z += byte[side][0].take(x, axis=0)
                np.tanh(z, out=z)
                z += np.float32(1)
                z *= half
                r += byte[side][1].take(x, axis=0)
                np.tanh(r, out=r)
                r += np.float32(1)
                r *= half
                n += net.bias[side]
                n *= r
                n += byte[side][2].take(x, axis=0)
                np.tanh(n, out=n)
                h = h - n
                h *= z
                h += n
                scores = out[side] @ h.T
                if side == 0:
                    ahead[t, :, :m] = scores
                    continue
                full = min(whole, m)
                scores[:, :full] += ahead[span - 1 - t, :, :full]
                if full < m:
                    scores[:, full:] += ahead[size[full:m] - 1 - t, :, np.arange(full, m)].T
                scores += last
                scores -= scores.max(axis=0)
                np.exp(scores, out=scores)
                scores /= scores.sum(axis=0)
                sums[:, :m] += scores
        total[at : at + len(begin)] = sums.T
    return total


def label_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean position probabilities (rows, K) of whole texts; zero rows for empty ones."""
    low = pc.ascii_lower(texts)
    _, ends, data = low.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(low) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(ends)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    start = ends[doc] + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    length = np.minimum(ends[doc + 1] - start, WINDOW)
    order = np.argsort(-length, kind="stable")
    sums = run_windows(net, raw, start[order], length[order])
    out = np.zeros((len(size), len(net.languages)))
    np.add.at(out, doc[order], sums)
    return out / np.maximum(size, 1)[:, None]


def sample(docs: DataFrame, most: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """About ``most`` documents of each language, chosen by a hash of id and text, at
    most ``MOST_ROWS`` in all, and ``chars`` characters of each. Not
    read: rows without language or text, and the held-out fifth (crc32 of the id as text divisible by 5)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND pmod(crc32(coalesce(cast(doc_id AS string), '')), 5) <> 0")
    shares = known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(float(most)) / F.col("count")).alias("share"))
    spot = F.xxhash64(F.lit(7), F.col("doc_id").cast("long"), F.col("text"))
    picked = known.join(F.broadcast(shares), "lang").where(F.pmod(spot, F.lit(1 << 20)) < F.col("share") * (1 << 20))
    at = F.pmod(F.xxhash64(F.lit(8), F.col("doc_id").cast("long")), F.greatest(F.length("text") - chars, F.lit(1)))
    rows = picked.select("lang", F.col("doc_id").cast("long").alias("id"), F.col("text").substr(at.cast("int") + 1, F.lit(chars)).alias("text")).limit(MOST_ROWS).collect()
    return [(r["lang"], r["text"].lower().encode() if r["text"].isascii() else _lower(r["text"])) for r in sorted(rows, key=lambda r: (r["lang"], r["id"] is None, r["id"] or 0, r["text"]))]


def _lower(text: str) -> bytes:
    return text.encode().lower()  # of bytes: ASCII letters only


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score, which replace columns of these names. Text alone is read.

    ``und`` with score 0 where text is null or has no letter, or where no language was learned; every other text gets a
    learned language, by all its bytes; empty tables give no rows; repeated rows are labelled alike."""
    names = [n for n in docs.columns if n not in ("lang_pred", "score")]
    own = common.free_name(docs, "text_read")
    schema = docs.select(*[F.col(f"`{n}`") for n in names], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, own):
                texts = common.strings(part.column(0))
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if net is not None:
                    p = label_texts(net, texts)
                    letters = pc.match_substring_regex(texts, "\\pL").to_numpy(zero_copy_only=False)
                    best = p.argmax(axis=1)
                    lang = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    source = common.bound_batches(docs).select(F.col("text").cast("string").alias(own), *[F.col(f"`{n}`") for n in names])
    return source.mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every whole text of ``documents``: doc_id, held_out, lang_pred, score."""
    docs = common.table(spark, sf_dir, "documents")
    net = train(sample(docs))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
