"""LM scoring by Brown class-based n-grams.

P(w | previous) = P(class of w | class of previous) * P(w | its class). Classes come from exchange clustering, in three steps
that each look at all training text:

1. Units, which are the ``OWN`` most frequent words and ``TIED`` groups of all others by a hash of their last letters, move one
   by one to the class that raises the likelihood of the training bigrams most, until none moves. The driver's table has
   (OWN + TIED + 1)^2 cells at most, and only starts the classes.
2. Each of the ``FREQUENT`` most frequent words moves by its own counts of the classes before it, the other classes fixed.
3. Every word of the training text, however rare, moves by its own counts of the classes of step 2 before it: a distributed
   pass whose result, a table of word, count and class, grows with the corpus.

So the class that a training word is predicted by comes from its own bigrams. The class that it predicts the next word by is
that of step 2, or, beyond the frequent words, its group's; an unseen word has its group's class and the count 0. Both keep
the probabilities of what can follow a word at a sum of one. The frequent words go to the tasks (bounded in number and in
length), the others' counts and classes are joined by word. So no word that is joined is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OWN, TIED, CLASSES = 1_024, 256, 40
FREQUENT, LONGEST = 100_000, 64
SUFFIX = 3
#: Smoothing: added to each word count, and the weight of the class distribution in each transition.
ADD, BACK = 0.1, 20.0
SWEEPS = 12


@dataclass
class Model:
    words: list[str]  # the frequent ones, most frequent first
    counts: np.ndarray  # theirs
    tokens: int = 0  # N, ends included
    distinct: int = 0  # V, the end included
    ends: int = 0
    unit_class: np.ndarray = field(default_factory=lambda: np.zeros(OWN + TIED + 1, np.int64))
    predicts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # class of each frequent word as the previous one
    predicted: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # and as the next one
    transition: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES + 1, CLASSES + 1)))  # log10, the end's class last
    divisor: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # log10 of each class's N + ADD (V + 1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "names"} | {"words": "\n".join(self.words)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = state["words"].split("\n") if state["words"] else []

    def ready(self) -> Model:
        """Tables that tasks build for themselves."""
        self.names = pa.array(self.words, pa.large_string())
        return self

    def looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place among the frequent words (-1: none) and unit of each word."""
        place = pc.fill_null(pc.index_in(words, value_set=self.names), -1).to_numpy().astype(np.int64)
        ends = pc.utf8_slice_codeunits(words, start=-SUFFIX, stop=None).dictionary_encode()
        unit = np.array([tied(x) for x in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
        return place, np.where((place >= 0) & (place < OWN), place, unit)

    def context(self, place: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """The class that each word predicts the next one by."""
        out = self.unit_class[unit]
        out[place >= 0] = self.predicts[place[place >= 0]]
        return out


def tied(word: str) -> int:
    """The unit of a word that has none of its own."""
    return OWN + zlib.crc32(word[-SUFFIX:].encode()) % TIED


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word offsets of each text, the words' codes, and the words of the codes."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = words.offsets.to_numpy() - words.offsets[0].as_py()
    flat = words.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        at = np.concatenate([[0], np.cumsum(full)])[at]
        flat = flat.filter(pa.array(full))
    d = flat.dictionary_encode()
    return at.astype(np.int64), d.indices.to_numpy(), d.dictionary


def learned(docs: DataFrame) -> DataFrame:
    """The documents that are learned from: all whose crc32 of the id as text is not divisible by 10."""
    return docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) != 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of all words; each task sums its own first, in bounded memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        def given(t: pa.Table) -> Iterator[pa.RecordBatch]:
            return iter(t.set_column(0, "word", t["word"].cast(pa.string())).to_batches(max_chunksize=50_000))

        for batch in batches:
            for part in common.slices(batch, "text"):
                _, code, words = words_of(common.strings(part.column("text")))
                held.append(pa.table({"word": words, "c": pa.array(np.bincount(code, minlength=len(words)))}))
            if sum(len(t) for t in held) > 600_000:
                held = [summed()]
                if len(held[0]) > 400_000:
                    yield from given(held.pop())
        if held:
            yield from given(summed())

    return common.bound_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def summed(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added up."""
    keys, at = np.unique(np.concatenate(held), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def bigrams(docs: DataFrame, model: Model) -> DataFrame:
    """(w, u, n): how often w follows unit u; w is the place of a frequent word, or len(words) + the unit for others; the
    last unit is the end of a text, also before its first word. Each task adds up its own first, in bounded memory."""
    size, frequent = OWN + TIED + 1, len(model.words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.ready()
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def given() -> Iterator[pa.RecordBatch]:
            k, n = summed(keys, counts)
            keys.clear()
            counts.clear()
            for a in range(0, len(k), 100_000):
                part = k[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part // size, pa.int32()), pa.array(part % size, pa.int32()), pa.array(n[a : a + 100_000])], ["w", "u", "n"])

        for batch in batches:
            for part in common.slices(batch, "text"):
                at, code, words = words_of(common.strings(part.column("text")))
                place, unit = m.looked_up(words)
                target = np.where(place >= 0, place, frequent + unit)
                row = np.insert(target[code], at[1:], frequent + size - 1)
                u = np.insert(unit[code], at[1:], size - 1)
                k, n = np.unique(row * size + np.concatenate([[size - 1], u[:-1]]), return_counts=True)
                keys.append(k)
                counts.append(n)
            if sum(map(len, keys)) > 2_000_000:
                k, n = summed(keys, counts)
                keys[:], counts[:] = [k], [n]
                if len(k) > 1_500_000:
                    yield from given()
        if keys:
            yield from given()

    return common.bound_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "w int, u int, n long").repartition(common.partitions(docs.sparkSession), "w", "u").groupBy("w", "u").agg(F.sum("n").alias("n"))


def spread(x: np.ndarray) -> np.ndarray:
    """x log x, 0 at 0."""
    return x * np.log(np.maximum(x, 1.0))


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering of units by their bigram counts ``n``; the last unit keeps a class of its own, the last."""
    size, k = len(n), classes + 1
    weight = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-weight[:-1], kind="stable")
    group = np.zeros(size, np.int64)
    group[order] = np.arange(size - 1) % classes
    group[-1] = classes
    member = np.zeros((size, k))
    member[np.arange(size), group] = 1
    after = n @ member  # unit to class
    before = n.T @ member  # class to unit
    table = member.T @ after
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            old = group[u]
            out, into, own = after[u].copy(), before[u].copy(), n[u, u]
            out[old] -= own  # towards others only
            into[old] -= own
            rest = table.copy()
            rest[old, :] -= out
            rest[:, old] -= into
            rest[old, old] -= own
            left, right = rest.sum(axis=1), rest.sum(axis=0)
            rows = spread(rest + out[None, :]) - spread(rest)  # u in class d: row d gains out
            cols = spread(rest + into[:, None]) - spread(rest)  # column d gains into
            d = np.arange(k)
            gain = rows.sum(axis=1) - rows[d, d] + cols.sum(axis=0) - cols[d, d]
            gain += spread(rest[d, d] + out + into + own) - spread(rest[d, d])
            gain -= spread(left + out.sum() + own) - spread(left) + spread(right + into.sum() + own) - spread(right)
            new = int(gain[:classes].argmax())
            if new == old or gain[new] <= gain[old] + 1e-9:
                continue
            moved += 1
            group[u] = new
            rest[new, :] += out
            rest[:, new] += into
            rest[new, new] += own
            table = rest
            after[:, old] -= n[:, u]
            after[:, new] += n[:, u]
            before[:, old] -= n[u, :]
            before[:, new] += n[u, :]
        if not moved:
            break
    return group


def moved(table: np.ndarray, old: np.ndarray, word: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The exchange step of many words at once: word i, now in class old[i], goes where it raises the likelihood of the
    bigrams most, all other words staying. Its counts after class ``before`` are the rows (word, before, n), in order of
    word; ``table`` holds how often each class follows each other."""
    size, classes = len(old), table.shape[1] - 1
    out = old.copy()
    if not size:
        return out
    table, n = table[:, :classes].astype(float), n.astype(float)
    whole = np.bincount(word, weights=n, minlength=size)
    sums = table.sum(axis=0)
    for a in range(0, len(word), 100_000):
        first, last = word[a], word[min(len(word), a + 100_000) - 1]
        lo, hi = np.searchsorted(word, first, "left"), np.searchsorted(word, last, "right")
        rows, w, x = table[before[lo:hi]], word[lo:hi] - first, n[lo:hi, None]
        mine = np.arange(classes)[None, :] == old[word[lo:hi], None]
        rest = np.maximum(rows - mine * x, 0.0)  # the word is taken out of its class
        gain = np.add.reduceat(spread(rest + x) - spread(rest), np.searchsorted(w, np.arange(last - first + 1)), axis=0)
        here = np.arange(first, last + 1)
        left = np.maximum(sums[None, :] - (np.arange(classes)[None, :] == old[here, None]) * whole[here, None], 0.0)
        gain -= spread(left + whole[here, None]) - spread(left)
        best = gain.argmax(axis=1)
        better = gain[np.arange(len(here)), best] > gain[np.arange(len(here)), old[here]] + 1e-9
        out[here[better]] = best[better]
    return out


def contexts(docs: DataFrame, model: Model) -> DataFrame:
    """(word, tied: the class of its group, d, n): how often each word follows class d; the empty word is the end. The
    frequent words are added up in each task, the others only in a slice of its texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.ready()
        own = np.zeros((len(m.words) + 1, CLASSES + 1), np.int64)  # the frequent words and the end
        names = pa.array([*m.words, ""], pa.large_string())
        group = np.array([m.unit_class[i if i < OWN else tied(w)] for i, w in enumerate(m.words)] + [CLASSES], np.int64)

        def given(words: pa.Array, group: np.ndarray, d: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(words), 50_000):
                cut = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([words[cut].cast(pa.string()), pa.array(group[cut].astype(np.int32)), pa.array(d[cut].astype(np.int32)), pa.array(n[cut])], ["word", "tied", "d", "n"])

        for batch in batches:
            for part in common.slices(batch, "text"):
                at, code, words = words_of(common.strings(part.column("text")))
                place, unit = m.looked_up(words)
                ctx = np.insert(m.context(place, unit)[code], at[1:], CLASSES)
                before = np.concatenate([[CLASSES], ctx[:-1]])
                target = np.insert(place[code], at[1:], len(m.words))
                some = target >= 0
                k, n = np.unique(target[some] * (CLASSES + 1) + before[some], return_counts=True)
                own.reshape(-1)[k] += n
                rare = np.insert(code, at[1:], 0)[~some].astype(np.int64)
                k, n = np.unique(rare * (CLASSES + 1) + before[~some], return_counts=True)
                c = k // (CLASSES + 1)
                yield from given(words.take(pa.array(c)), m.unit_class[unit[c]], k % (CLASSES + 1), n)
        w, d = np.nonzero(own)
        yield from given(names.take(pa.array(w)), group[w], d, own[w, d])

    return common.bound_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "word string, tied int, d int, n long")


def exchanged(rows: DataFrame, key: str, table: np.ndarray) -> DataFrame:
    """``rows`` (key, tied: its class so far, d, n) by key: (key, c, class, d, n), its count, its class after its exchange
    step, and its counts by class before."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("seen")
            at = lists.offsets.to_numpy().astype(np.int64)
            inner = lists.values.slice(int(at[0]), int(at[-1] - at[0]))
            at = at - at[0]
            d, n = inner.field("d").to_numpy().astype(np.int64), inner.field("n").to_numpy()
            old = batch.column("tied").to_numpy().astype(np.int64)
            end = old == CLASSES
            new = moved(table, np.where(end, 0, old), np.repeat(np.arange(batch.num_rows), np.diff(at)), d, n)
            new[end] = CLASSES
            offsets = pa.array(at.astype(np.int32))
            columns = [batch.column(key), pa.array(np.add.reduceat(n, at[:-1])), pa.array(new.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(d.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n))]
            yield pa.RecordBatch.from_arrays(columns, [key, "c", "class", "d", "n"])

    each = rows.repartition(common.partitions(rows.sparkSession), key).groupBy(key, "tied", "d").agg(F.sum("n").alias("n"))
    whole = each.groupBy(key).agg(F.min("tied").alias("tied"), F.collect_list(F.struct("d", "n")).alias("seen"))
    return whole.mapInArrow(run, f"{key} {kind}, c long, class int, d array<int>, n array<long>")


def unit_pairs(pairs: DataFrame, unit_of: np.ndarray) -> np.ndarray:
    """How often each unit (column) follows each unit (row)."""
    size = OWN + TIED + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in batches:
            np.add.at(total, b.column("u").to_numpy().astype(np.int64) * size + unit_of[b.column("w").to_numpy()], b.column("n").to_numpy())
        some = np.flatnonzero(total)
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part // size, pa.int32()), pa.array(part % size, pa.int32()), pa.array(total[part])], ["a", "b", "n"])

    found = pairs.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((size, size))
    n[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return n


def by_class(pairs: DataFrame, unit_of: np.ndarray, unit_class: np.ndarray) -> DataFrame:
    """The bigrams of frequent words as (w, tied, d, n): class before instead of unit before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, old = unit_class[b.column("u").to_numpy()], unit_class[unit_of[b.column("w").to_numpy()]]
            yield pa.RecordBatch.from_arrays([b.column("w"), pa.array(old.astype(np.int32)), pa.array(d.astype(np.int32)), b.column("n")], ["w", "tied", "d", "n"])

    return pairs.mapInArrow(run, "w int, tied int, d int, n long")


def class_pairs(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each class (column) follows each class (row), and how many words each class has."""
    k = CLASSES + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros((k, k), np.int64), np.zeros(k, np.int64)
        for b in batches:
            c, lists = b.column("class").to_numpy(), b.column("d")
            np.add.at(total, (lists.flatten().to_numpy(), np.repeat(c, pc.list_value_length(lists).to_numpy())), b.column("n").flatten().to_numpy())
            kinds += np.bincount(c, minlength=k)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*a.tolist(), *[-1] * k], pa.int32()), pa.array([*b.tolist(), *range(k)], pa.int32()), pa.array([*total[a, b].tolist(), *kinds.tolist()], pa.int64())], ["a", "b", "n"])

    table, kinds = np.zeros((k, k)), np.zeros(k)
    for r in words.select("class", "d", "n").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        if r["a"] < 0:
            kinds[r["b"]] = r["n"]
        else:
            table[r["a"], r["b"]] = r["n"]
    return table, kinds


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of ``docs`` and the table of all their words (word, c, class)."""
    docs = learned(docs)
    spark = docs.sparkSession
    counts = common.staged(word_counts(docs), "counts")
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = docs.count()
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    model = Model(top.column("word").to_pylist(), top.column("c").to_numpy(), (whole["n"] or 0) + ends, whole["v"] + (ends > 0), ends)
    unit_of = np.array([i if i < OWN else tied(w) for i, w in enumerate(model.words)] + list(range(OWN + TIED + 1)), np.int32)

    pairs = common.staged(bigrams(docs, model), "bigrams")
    n = unit_pairs(pairs, unit_of)
    model.unit_class = exchange(n)  # step 1
    member = np.zeros((len(n), CLASSES + 1))
    member[np.arange(len(n)), model.unit_class] = 1
    table = member.T @ n @ member

    frequent = by_class(pairs.where(F.col("w") < len(model.words)), unit_of, model.unit_class)
    found = exchanged(frequent, "w", table).select("w", "class").toArrow()  # step 2
    model.predicts = np.zeros(len(model.words), np.int64)
    model.predicts[found.column("w").to_numpy()] = found.column("class").to_numpy()

    words = common.staged(exchanged(contexts(docs, model), "word", table), "words")  # step 3
    table, kinds = class_pairs(words)
    known = spark.createDataFrame(pa.table({"word": model.words, "place": np.arange(len(model.words))})) if model.words else spark.createDataFrame([], "word string, place long")
    found = words.select("word", "class").join(F.broadcast(known), "word").select("place", "class").toArrow()
    model.predicted = np.zeros(len(model.words), np.int64)
    model.predicted[found.column("place").to_numpy()] = found.column("class").to_numpy()

    share = (table.sum(axis=0) + 1) / (table.sum() + CLASSES + 1)
    model.transition = np.log10((table + BACK * share) / (table.sum(axis=1, keepdims=True) + BACK))
    model.divisor = np.log10(table.sum(axis=0)[:CLASSES] + ADD * (kinds[:CLASSES] + 1))
    common.discard(counts, pairs)
    return model, words.where("word <> ''").select("word", "c", "class")


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity (10 to the minus score a token) of every
    whole text; ``words`` is the table of ``train``.

    A null or empty text is its end alone; an unseen word has count 0 and the class of its last letters; rows with
    equal or null doc_id are scored each for itself; without any training text all base scores are 0; an empty table
    gives no rows; other columns are not read."""
    source = common.bound_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names = ["word", "row", "doc_id", "tf", "d", "tied", "tokens", "known", "counted", "classed"]
    schema = "word string, row long, doc_id long, tf long, d int, tied int, tokens long, known long, counted double, classed double"
    width = CLASSES + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.ready()
        logs = np.append(np.log10(np.asarray(m.counts, float) + ADD), 0.0)
        divisor = np.append(m.divisor, 0.0)
        for batch in batches:
            for part in common.slices(batch, "text"):
                at, code, words = words_of(common.strings(part.column("text")))
                n = len(at) - 1
                place, unit = m.looked_up(words)
                ends = at[1:] + np.arange(n)
                before = np.concatenate([[CLASSES], np.insert(m.context(place, unit)[code], at[1:], CLASSES)[:-1]])
                own = np.insert(place[code], at[1:], -1)  # place, -1: a rare word or an end
                target = np.append(m.predicted, CLASSES)[own]  # an end's class; rare words are put to 0 below
                steps = m.transition[before, target] - divisor[target]
                rare_at = own < 0
                rare_at[ends] = False
                steps[rare_at] = 0
                doc = np.repeat(np.arange(n), np.diff(at) + 1)
                classed = np.bincount(doc, weights=steps, minlength=n)
                seen = own >= 0
                counted = np.bincount(doc[seen], weights=logs[own[seen]], minlength=n).astype(float)  # of nothing: integers
                known = np.bincount(doc[seen], minlength=n) + (m.ends > 0)
                codes = np.insert(code, at[1:], 0).astype(np.int64)[rare_at]
                rare, tf = np.unique((doc[rare_at] * max(1, len(words)) + codes) * width + before[rare_at], return_counts=True)
                rare, d = np.divmod(rare, width)
                rare_doc, rare_code = np.divmod(rare, max(1, len(words)))
                ids = part.column("row")
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise("", ids.cast(pa.string()), " "), ids, part.column("doc_id"), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int32()), pa.array(np.diff(at) + 1), pa.array(known.astype(np.int64)), pa.array(counted), pa.array(classed + counted)], names)
                for k in range(0, len(rare), 50_000):
                    who, c = pa.array(rare_doc[k : k + 50_000]), rare_code[k : k + 50_000]
                    x = len(c)
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(c)).cast(pa.string()), ids.take(who), part.column("doc_id").take(who), pa.array(tf[k : k + 50_000]), pa.array(d[k : k + 50_000].astype(np.int32)), pa.array(m.unit_class[unit[c]].astype(np.int32)), none(x, pa.int64()), none(x, pa.int64()), none(x, pa.float64()), none(x, pa.float64())], names)

    # A document's own row carries a word that no text has, so that it meets no count and is dealt like any other.
    parts = source.mapInArrow(run, schema).join(words, "word", "left")
    steps = F.lit((model.transition - np.append(model.divisor, 0.0)[None, :]).reshape(-1).tolist())
    log = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + ADD)
    step = F.col("tf") * F.get(steps, F.col("d") * width + F.coalesce("class", "tied"))
    summed = parts.groupBy("row", "doc_id").agg(F.sum("tokens").alias("n_tokens"), (F.sum("known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("tf"))), F.lit(0))).cast("long").alias("n_known"), (F.sum("counted") + F.coalesce(F.sum(log), F.lit(0.0))).alias("s"), (F.sum("classed") + F.coalesce(F.sum(log + step), F.lit(0.0))).alias("score"))
    end = float(np.log10(model.ends + ADD))
    base = F.col("s") + F.lit(end) - F.col("n_tokens") * float(np.log10(model.tokens + ADD * (model.distinct + 1)))
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` scored: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model, words = train(docs)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    return score(docs, model, words).withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
