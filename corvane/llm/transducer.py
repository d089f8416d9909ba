"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

*Lookahead.* Merges apply in order of rank, so what stands to the right of a token can change it only along a chain of
rules of falling rank: a rule (u, v) is prevented by a rule (y, c) of lower rank, y being v or a part at v's right rim
that is still free at that time, and (y, c) needs c whole, which again depends on rules at c's right rim. The longest
such chain, in bytes, is computed from the merge list alone by one pass in order of rank. A token that ends that many
bytes before the end of what was read can't change any more: its ids are emitted, and since no merge crosses a settled
boundary, the rest is tokenised on from there. Memory is one window, whatever the length of a text or word.

*Pre-tokens.* A pre-token that a later window can't change is a wall for merges, and settles what stands before it. One that
goes on over ``SHORT`` bytes is merged in windows as above, while its class tells where it ends. So a text of any length,
with or without spaces, is a stream of windows, between which ``Encoder.bound`` bytes are kept at most.

*Tables.* The pre-tokens that all texts of a batch settle in a round are merged together: a matrix of token ids, one merge
of each row a step, ranks from an open-addressed hash of pairs. ``Pieces`` is a cache of short pieces in front of it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, pieces
from .token_files import tokenizer_path

#: A text is read in windows of so many characters.
WINDOW = 4_096
#: Bytes from which a pre-token is streamed by itself, and characters that a text may keep uncut between windows.
SHORT = 64
NONE = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"] | special
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    return out


class Merges:
    """The vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = byte_table(path)
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.size = len(self.bytes)
        self.rules: dict[int, int] | None = None
        self._hash()
        self.longest = max(len(self.bytes[c]) for _, _, c in self.pairs) if self.pairs else 1
        self.lookahead = self._lookahead()

    def _hash(self) -> None:
        bits = 1
        while 1 << bits < 8 * max(1, len(self.pairs)):
            bits += 1
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)  # rank << 20 | merged id
        self.probes = 1
        for rank, (a, b, c) in enumerate(self.pairs):
            key = a * self.size + b
            at, n = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> self.shift, 1
            while self.keys[at] >= 0:
                at, n = (at + 1) & self.mask, n + 1
            self.keys[at], self.values[at] = key, rank << 20 | c
            self.probes = max(self.probes, n)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, NONE where there is no rule or an id is negative."""
        key = np.where((left < 0) | (right < 0), -2, left * self.size + right)
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)
        out = np.where(self.keys[at] == key, self.values[at], NONE)
        for _ in range(self.probes - 1):
            at = (at + 1) & self.mask
            hit = self.keys[at] == key
            out[hit] = self.values[at[hit]]
        return out

    def _lookahead(self) -> int:
        parts = {c: (a, b, r) for r, (a, b, c) in reversed(list(enumerate(self.pairs)))}
        by_left: dict[int, list[tuple[int, int]]] = {}  # left token: (rank, bytes to the right that the rule depends on)

        def reach(token: int, before: int) -> int:
            """Bytes after ``token`` that decide whether it is whole and free when rules of rank ``before`` apply."""
            most = 0
            while True:
                for rank, far in reversed(by_left.get(token, ())):
                    if rank < before:
                        most = max(most, far)
                if token not in parts:
                    return most
                _, token, before = parts[token]

        for rank, (a, b, _) in enumerate(self.pairs):
            by_left.setdefault(a, []).append((rank, len(self.bytes[b]) + reach(b, rank)))
        return max((reach(t, len(self.pairs)) for t in {c for _, _, c in self.pairs} | set(self.of_byte.tolist())), default=0)

    def tokenise(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word by plain BPE, many words at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        lo = int(np.searchsorted(lengths[order], 1))
        while lo < len(order):
            width = int(lengths[order[lo]])
            hi = int(np.searchsorted(lengths[order], width, side="right"))
            hi = min(hi, lo + max(1, (1 << 18) // width))
            rows = order[lo:hi]
            t = self.of_byte[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), width)]
            for i, ids in zip(rows.tolist(), self._merge(t), strict=True):
                out[i] = ids
            lo = hi
        return out

    def tokenise_long(self, word: bytes) -> list[int]:
        """The ids of one word by plain BPE, with a queue of the pairs in order of rank and place."""
        if self.rules is None:
            self.rules = {k: v for k, v in zip(self.keys.tolist(), self.values.tolist(), strict=True) if k >= 0}
        rules, size = self.rules, self.size
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue = [(v, i) for i in range(len(ids) - 1) if (v := rules.get(ids[i] * size + ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            v, i = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or rules.get(ids[i] * size + ids[j]) != v:
                continue  # one of the two has been merged since
            ids[i], ids[j], k = v & 0xFFFFF, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (v := rules.get(ids[i] * size + ids[k])) is not None:
                    heappush(queue, (v, i))
            if (k := before[i]) >= 0 and (v := rules.get(ids[k] * size + ids[i])) is not None:
                heappush(queue, (v, k))
        return [i for i in ids if i >= 0]

    def _merge(self, t: np.ndarray) -> list[np.ndarray]:
        n, width = t.shape
        done: list = [None] * n
        rows = np.arange(n)
        r = self.ranks(t[:, :-1], t[:, 1:]) if width > 1 else np.full((n, 1), NONE)
        while True:
            at = r.argmin(axis=1)
            best = r[np.arange(len(r)), at]
            over = best >= NONE
            if over.any():
                for i, ids in zip(rows[over].tolist(), t[over], strict=True):
                    done[i] = ids[ids >= 0]
                keep = ~over
                rows, t, r, at, best = rows[keep], t[keep], r[keep], at[keep], best[keep]
                if not len(rows):
                    return done
            here = np.arange(len(rows))
            cols = np.arange(t.shape[1] - 1)
            t = np.take_along_axis(t, cols + (cols > at[:, None]), axis=1)
            t[here, at] = best & 0xFFFFF
            if t.shape[1] == 1:
                r = np.full((len(rows), 1), NONE)
                continue
            cols = np.arange(t.shape[1] - 1)
            r = np.take_along_axis(r, cols + (cols > at[:, None]), axis=1)
            left, right = at > 0, at < t.shape[1] - 1
            r[here[left], at[left] - 1] = self.ranks(t[here[left], at[left] - 1], t[here[left], at[left]])
            r[here[right], at[right]] = self.ranks(t[here[right], at[right]], t[here[right], at[right] + 1])


class WordStream:
    """BPE of one pre-token that arrives in parts, in constant memory."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.room = merges.lookahead + 8 * merges.longest
        self.held = b""

    def feed(self, part: bytes) -> Iterator[np.ndarray]:
        at = 0
        while at < len(part):
            take = self.room - len(self.held)
            self.held += part[at : at + take]
            at += take
            if len(self.held) == self.room:
                ids = np.array(self.merges.tokenise_long(self.held), np.int64)
                ends = np.cumsum([len(self.merges.bytes[i]) for i in ids])
                n = int(np.searchsorted(ends, self.room - self.merges.lookahead, side="right"))
                yield ids[:n]
                self.held = self.held[int(ends[n - 1]) :]

    def finish(self) -> np.ndarray:
        ids = np.array(self.merges.tokenise_long(self.held), np.int64)
        self.held = b""
        return ids


def pattern(spaces: str = pieces.SPACES) -> str:
    """The public byte-level pre-token pattern, with white space written out."""
    return f"'(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{spaces}\\p{{L}}\\p{{N}}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"


class Stream:
    """One text that arrives in windows. Between two windows it keeps at most ``SHORT`` characters that are not cut yet, or
    an open pre-token: what goes on with it and the bytes that its ``WordStream`` holds."""

    def __init__(self, owner: Encoder):
        self.owner = owner
        self.held = ""
        self.word: WordStream | None = None
        self.more = owner.kinds[0]
        self.windows = self.most_held = 0

    def feed(self, part: str, last: bool) -> tuple[list[int], str, list[int]]:
        """What is settled after ``part``: ids, then a text whose pre-tokens no later window can change, then ids."""
        text, self.held = self.held + part, ""
        before: list[int] = []
        after: list[int] = []
        if self.word is not None:
            before, text = self._cut(text, last), ""
        elif not last:
            at = text.rfind(" ")
            while at > 0 and self.owner.space.match(text[at - 1]):  # a space after a non-space begins a pre-token, whatever follows
                at = text.rfind(" ", 0, at)
            text, rest = text[: max(at, 0)], text[max(at, 0) :]
            if len(rest) <= SHORT:
                self.held = rest
            else:
                after = self._cut(rest, False)
        self.windows += 1
        self.most_held = max(self.most_held, len(self.held.encode()) + (len(self.word.held) if self.word else 0))
        return before, text, after

    def _cut(self, text: str, last: bool) -> list[int]:
        """Ids of the pre-tokens and special tokens of ``text`` that are settled; the rest is held."""
        o = self.owner
        tail = ""
        if not last:  # a special token may have begun
            n = next((n for n in range(min(o.longest_special - 1, len(text)), 0, -1) if any(s.startswith(text[-n:]) for s in o.merges.special)), 0)
            text, tail = text[: len(text) - n], text[len(text) - n :]
        out: list[int] = []
        at = 0
        for m in o.special.finditer(text):
            out += self._between(text[at : m.start()], True)
            out.append(o.merges.special[m[0]])
            at = m.end()
        out += self._between(text[at:], last)
        self.held += tail
        return out

    def _between(self, text: str, last: bool) -> list[int]:
        """The same where no special token is; ``last``: nothing follows, or a special token does."""
        out: list[int] = []
        at = 0
        if self.word is not None:
            if not text and not last:
                return out
            end = self.more.match(text).end()
            if self.more is self.owner.kinds[0] and not (last and end == len(text)):
                end -= 1  # the last space of a run goes with what follows
                open_ = end + 1 == len(text) and not last
            else:
                open_ = end == len(text) and not last
            out += [i for ids in self.word.feed(text[:end].encode()) for i in ids.tolist()]
            if open_:
                self.held = text[end:]
                return out
            out += self.word.finish().tolist()
            self.word = None
            at = end
        rest = len(text)
        whole = []
        for m in self.owner.pattern.finditer(text, at):
            if not last and (m.end() == len(text) or (text[m.start()] == "'" and m.start() >= len(text) - 2)):
                rest = m.start()
                break
            whole.append(m[0].encode())
        out += [i for ids in self.owner.merged(whole) for i in ids]
        self.held = text[rest:]
        if len(self.held) > SHORT:  # one pre-token that goes on for long
            self.word = WordStream(self.owner.merges)
            self.more = next(k for k in self.owner.kinds if k.match(self.held[-1]).end())
            part, self.held = (self.held[:-1], self.held[-1]) if self.more is self.owner.kinds[0] else (self.held, "")
            out += [i for ids in self.word.feed(part.encode()) for i in ids.tolist()]
        return out


class Encoder:
    """Texts to ids in windows of ``window`` characters, each text through a ``Stream`` of its own. What the streams of a
    batch settle in one round is merged together; short pieces are remembered in a table in front of the merges."""

    def __init__(self, path: str, window: int = WINDOW):
        import regex

        self.merges = Merges(path)
        self.window = window
        self.pattern = regex.compile(pattern())
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special)) or r"(?!)")
        self.longest_special = max(map(len, self.merges.special), default=1)
        self.space = regex.compile(f"[{pieces.SPACES}]")
        self.kinds = [regex.compile(k + "*") for k in (f"[{pieces.SPACES}]", r"\p{L}", r"\p{N}", f"[^{pieces.SPACES}\\p{{L}}\\p{{N}}]")]
        self.kept = pieces.Pieces(self.encode_many, pieces.spaced_pieces)
        #: The most bytes of a text that are kept between two windows.
        self.bound = 4 * (SHORT + self.longest_special) + WordStream(self.merges).room

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The ids of whole pre-tokens; those that are longer than ``SHORT`` bytes go through windows."""
        new = list({w for w in words if len(w) <= SHORT})
        known = dict(zip(new, (x.tolist() for x in self.merges.tokenise(new)), strict=True))
        return [known[w] if len(w) <= SHORT else self._long(w) for w in words]

    def _long(self, word: bytes) -> list[int]:
        stream = WordStream(self.merges)
        return [i for part in stream.feed(word) for i in part.tolist()] + stream.finish().tolist()

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that nothing follows."""
        split: list[list[bytes | int]] = []
        for text in texts:
            words: list[bytes | int] = []
            at = 0
            for m in self.special.finditer(text) if "<" in text else ():
                words += [w.encode() for w in self.pattern.findall(text[at : m.start()])]
                words.append(self.merges.special[m[0]])
                at = m.end()
            split.append(words + [w.encode() for w in self.pattern.findall(text[at:] if at else text)])
        ids = iter(self.merged([w for ws in split for w in ws if isinstance(w, bytes)]))
        return [[i for w in ws for i in ([w] if isinstance(w, int) else next(ids))] for ws in split]

    def settled(self, streams: list[Stream], parts: list[str], last: list[bool]) -> list[np.ndarray]:
        """The ids that each stream settles after its next window."""
        cut = [s.feed(p, e) for s, p, e in zip(streams, parts, last, strict=True)]
        ids, at = self.kept(common.strings(pa.array([c[1] for c in cut], pa.large_string())))
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for k, (before, _, after) in enumerate(cut):
            if before or after:
                out[k] = np.concatenate([np.array(before, np.uint32), out[k], np.array(after, np.uint32)])
        return out

    def rounds(self, texts: list[str]) -> Iterator[tuple[list[int], list[Stream], list[np.ndarray]]]:
        """Runs all ``texts`` at once, a window of each a round: which texts, their streams and the ids they settle."""
        live = list(range(len(texts)))
        streams = [Stream(self) for _ in texts]
        at = 0
        while live:
            parts = [texts[i][at : at + self.window] for i in live]
            at += self.window
            last = [len(texts[i]) <= at for i in live]
            mine = [streams[i] for i in live]
            yield live, mine, self.settled(mine, parts, last)
            live = [i for i, e in zip(live, last, strict=True) if not e]


class Decoder:
    """Ids to text, a part at a time: a byte table and a UTF-8 state machine that keeps an unfinished character."""

    def __init__(self, merges: Merges):
        self.table = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of one worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


class Digest:
    """What is told of one text: its ids are hashed and decoded as they are settled, and none is kept."""

    def __init__(self, merges: Merges):
        self.decoder = Decoder(merges)
        self.ids, self.text, self.n = hashlib.sha256(), hashlib.sha256(), 0

    def feed(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.ids.update(ids.astype("<u4").tobytes())
        self.text.update(self.decoder.feed(ids.tolist()).encode())

    def finish(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_windows long, most_held long"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_windows, most_held) of every whole text; the last two are the
    windows it was read in and the most bytes that were kept between two of them.

    A null or empty text has no ids and the digests of no bytes; equal, null or repeated doc_id are carried along; an
    empty table gives no rows; other columns are not read. The text of a special token counts as that token, as in the
    library. Nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [Digest(e.merges) for _ in texts]
                facts = np.zeros((2, len(texts)), np.int64)
                for live, streams, ids in e.rounds(texts):
                    for i, s, x in zip(live, streams, ids, strict=True):
                        found[i].feed(x)
                        facts[:, i] = s.windows, s.most_held
                n, sha, back = zip(*[f.finish() for f in found], strict=True)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()), pa.array(facts[0]), pa.array(facts[1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_windows", "most_held"])

    return common.bound_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` encoded and decoded by the byte-level vocabulary."""
    return round_trip(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
