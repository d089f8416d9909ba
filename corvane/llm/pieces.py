"""Whole-text encoding by the tokenizers library at the speed of a table lookup.

Both public vocabularies here never let a token reach over certain places in a text: the word vocabulary over ASCII
white space, the byte-level one over the place before a space that a non-space follows. A text is cut there by Arrow
kernels, equal pieces of a batch are encoded once and kept for later batches, and ids are put together by index
arithmetic. ``encode(text)`` of the library equals the pieces' ids one after the other.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space by the Unicode property, as text for character classes of Python's re and of RE2.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES_RE2 = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def spaced_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cuts each text before every space that a non-space follows, and between a letter or digit and a mark. Returns the
    flat pieces and the first piece's index of each text."""
    import regex

    odd = pc.match_substring_regex(texts, f" [{SPACES_RE2}]|\\x00|<\\|").to_numpy(zero_copy_only=False)
    marked = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\x00 "), f"([\\pL\\pN])({MARKS})", "\\1\x00\\2")
    quick = pc.split_pattern(marked, "\x00")
    if not odd.any():
        return quick.flatten(), quick.offsets.to_numpy() - quick.offsets[0].as_py()
    cut = regex.compile(f"(?= [^{SPACES}])")
    lists = [[p for p in cut.split(t.as_py(), flag) if p] if o else q.as_py() for t, q, o in zip(texts, quick, odd, strict=True) for flag in (0,)]
    flat = pa.array([p for x in lists for p in x], pa.large_string())
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


class Pieces:
    """Keeps the ids of pieces of at most ``longest`` characters seen; ``encode_many(list of str) -> list of id lists`` is
    asked for new ones only."""

    def __init__(self, encode_many, cut, most: int = 300_000, longest: int = 64):
        self.encode_many, self.cut, self.most, self.longest = encode_many, cut, most, longest
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most + self.most // 4:  # the first seen, mostly frequent ones, stay
            while len(self.index) > self.most:
                self.index.popitem()
            self.used = int(self.starts[self.most])
        at = list(map(self.index.get, words))
        if missing := [w for w, i in zip(words, at, strict=True) if i is None]:
            missing.sort(key=len)
            for k in range(0, len(missing), 20_000):
                part = missing[k : k + 20_000]
                ids = self.encode_many(part)
                size = np.fromiter(map(len, ids), np.int64, len(part))
                flat = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
                while self.used + len(flat) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                m = len(self.index)
                while m + len(part) > len(self.lens):
                    self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
                self.flat[self.used : self.used + len(flat)] = flat
                self.starts[m : m + len(part)] = self.used + np.cumsum(size) - size
                self.lens[m : m + len(part)] = size
                self.used += len(flat)
                self.index.update(zip(part, range(m, m + len(part)), strict=True))
            at = [self.index[w] if i is None else i for w, i in zip(words, at, strict=True)]
        return np.array(at, np.int64)

    def drop_long(self) -> None:
        """Forgets the long pieces, which are the last ones, so that the table's memory is bounded."""
        n = len(self.index)
        while self.index:
            word, place = self.index.popitem()
            if len(word) <= self.longest:
                self.index[word] = place
                break
        if len(self.index) < n:
            self.used = int(self.starts[len(self.index)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 offsets into them."""
        flat, first = self.cut(texts)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        d = flat.dictionary_encode()
        row = self.lookup(d.dictionary.to_pylist())[d.indices.to_numpy()]
        size = self.lens[row]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(ends[-1])) + np.repeat(self.starts[row] - (ends - size), size)]
        self.drop_long()
        return ids, np.concatenate([[0], ends])[first]


#: ASCII punctuation but the apostrophe, which can begin a contraction.
MARKS = "[!-&(-/:-@\\[-`{-~]"
#: Where marks can't be set apart or letters lowered beforehand: next to an apostrophe or a non-ASCII sign, with
#: combining or control characters, white space beyond ASCII, or what could become a special token.
ODD = f"'{MARKS}|{MARKS}'|{MARKS}[^\\x00-\\x7f\\pL\\pN]|[^\\x00-\\x7f\\pL\\pN]{MARKS}|<\\||\\pM|[\\x00-\\x08\\x0e-\\x1f\\x7f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]"


def word_cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cuts at ASCII white space; where it makes no difference, marks are set apart and ASCII letters lowered first, so
    that fewer pieces are new."""
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), f"({MARKS}+)", " \\1 ")
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
    if odd.any():
        plain = pa.concat_arrays([plain, texts]).take(pa.array(np.arange(len(odd)) + odd * len(odd)))
    words = pc.ascii_split_whitespace(plain)
    return words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()


def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_made: dict[tuple, Pieces] = {}


def word_pieces(path: str) -> Pieces:
    """The encoder of one worker for a vocabulary that drops white space and whose pattern never spans it."""
    if ("word", path) not in _made:
        t = library(path)
        _made["word", path] = Pieces(lambda words: [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)], word_cut)
    return _made["word", path]


def spaced(path: str) -> Pieces:
    """The encoder of one worker for the byte-level vocabulary, new pieces by the library."""
    if ("spaced", path) not in _made:
        t = library(path)
        _made["spaced", path] = Pieces(lambda words: [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)], spaced_pieces)
    return _made["spaced", path]
