"""Language ID, LM scores, SimHash, line dedup and I-Match against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corvane.llm import brown_lm, common, imatch, langid, line_dedup, simhash


def by_id(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def least(items, linked):
    """Smallest non-null id reachable for each (id, thing)."""
    p = list(range(len(items)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                p[max(find(i), find(j))] = min(find(i), find(j))
    ids: dict[int, list] = {}
    for i, (k, _) in enumerate(items):
        ids.setdefault(find(i), []).append(k)
    return [min((k for k in ids[find(i)] if k is not None), default=None) for i in range(len(items))]


# Language ID


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = langid.fresh(["a", "b", "c"], 3, rng)
    for name in ("byte", "state", "bias", "out", "last"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += 0.1
    x, label = rng.integers(0, 256, (4, 7)), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(net, x, label)
    for p, g in zip(net.parameters(), grads, strict=True):
        flat = p.reshape(-1)
        for k in rng.choice(len(flat), min(12, len(flat)), replace=False):
            old, step = flat[k], 1e-3
            flat[k] = old + step
            up = langid.gradients(net, x, label)[0]
            flat[k] = old - step
            down = langid.gradients(net, x, label)[0]
            flat[k] = old
            assert g.reshape(-1)[k] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_windows_equal_a_plain_network(odd_rows):
    net = langid.fresh(["a", "b", "c"], 5, np.random.default_rng(2))
    net.bias += 0.2
    texts = [t or "" for _, t in odd_rows]
    got = langid.label_texts(net, common.strings(pa.array(texts)))
    sig = lambda v: 1 / (1 + np.exp(-v))
    for text, p in zip(texts, got, strict=True):
        raw = text.encode().lower()
        if not raw or len(raw) > 3_000:
            assert raw or not p.any()
            continue
        total = np.zeros(3)
        for a in range(0, len(raw), langid.WINDOW):
            part = raw[a : a + langid.WINDOW]
            states = []
            for side in (0, 1):
                h, out = np.zeros(5), []
                for b in part if side == 0 else part[::-1]:
                    g, u = net.byte[side][b], h @ net.state[side]
                    z, r = sig(g[:5] + u[:5]), sig(g[5:10] + u[5:10])
                    n = np.tanh(g[10:] + r * (u[10:] + net.bias[side][0]))
                    h = (1 - z) * n + z * h
                    out.append(h)
                states.append(out if side == 0 else out[::-1])
            for f, b in zip(*states, strict=True):
                e = np.exp(f @ net.out[0] + b @ net.out[1] + net.last)
                total += e / e.sum()
        assert p == pytest.approx(total / len(raw), abs=1e-4)


def test_language_id_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.train(langid.sample(docs))
    rows = langid.identify(docs, net).selectExpr("lang", "lang_pred", "score", "pmod(crc32(cast(doc_id AS string)), 5) = 0 AS held").collect()
    held = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_and_other_columns_are_not_learned_from(spark):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", ("x" if i % 2 else "y") if zlib.crc32(str(i).encode()) % 5 else "hidden") for i in range(60)]
    assert {x for x, _ in langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))} == {"x", "y"}


def test_language_id_of_odd_rows(documents, nothing):
    net = langid.train(langid.sample(documents), steps=8)
    rows = langid.identify(documents, net).collect()
    assert len(rows) == documents.count() and set(rows[0].asDict()) == {*documents.columns}
    for r in rows:
        blank = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.lang_pred == langid.UNKNOWN) == blank and (r.score == 0) == blank
    assert langid.train(langid.sample(nothing)) is None
    assert langid.identify(nothing, None).count() == 0
    assert {r.lang_pred for r in langid.identify(documents, None).collect()} == {langid.UNKNOWN}


# LM scores


def lm_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def test_lm_scores(documents, nothing):
    """Against counts made here from the words' classes alone: transitions, class sizes and scores are worked out anew."""
    model, words = brown_lm.train(documents)
    got = by_id(brown_lm.score(documents, model, words).collect(), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    rows = documents.select("doc_id", "text").collect()
    training = [r for r in rows if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10]
    c = Counter(w for r in training for w in lm_tokens(r.text))
    n, v = sum(c.values()), len(c)
    found = {r.word: (r.c, r["class"]) for r in words.collect()}
    assert {w: x for w, (x, _) in found.items()} == {w: x for w, x in c.items() if w != "\n"}  # every training word has a class
    place = {w: i for i, w in enumerate(model.words)}
    end = brown_lm.CLASSES

    def group(w):  # of an unseen word: its last letters'
        return model.unit_class[brown_lm.OWN + zlib.crc32(w[-brown_lm.SUFFIX :].encode()) % brown_lm.TIED]

    def predicts(w):
        return end if w == "\n" else model.predicts[place[w]] if w in place else group(w)

    def predicted(w):
        return end if w == "\n" else found[w][1] if w in found else group(w)

    table, size, kinds = np.zeros((end + 1, end + 1)), Counter(), Counter(predicted(w) for w in c)
    for r in training:
        before = end
        for w in lm_tokens(r.text):
            table[before, predicted(w)] += 1
            size[predicted(w)] += 1
            before = predicts(w)
    share = (table.sum(axis=0) + 1) / (n + end + 1)
    want = []
    for r in rows:
        tokens, score, before = lm_tokens(r.text), 0.0, end
        for w in tokens:
            g = predicted(w)
            score += math.log10((table[before, g] + brown_lm.BACK * share[g]) / (table[before].sum() + brown_lm.BACK))
            if w != "\n":
                score += math.log10((c[w] + 0.1) / (size[g] + 0.1 * (kinds[g] + 1)))
            before = predicts(w)
        want.append((r.doc_id, len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), score, 10 ** (-score / len(tokens))))
    want.sort(key=lambda r: tuple((x is not None, x) for x in r))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-7, abs=1e-6)
    assert (10**model.transition).sum(axis=1) == pytest.approx(1)
    model, words = brown_lm.train(nothing)
    assert brown_lm.score(nothing, model, words).count() == 0
    assert {r.base_score for r in brown_lm.score(documents, model, words).where("n_tokens < 5").collect()} == {0.0}


def test_words_move_to_the_likeliest_class():
    """The exchange step of many words at once against one at a time, from the likelihood itself."""
    rng = np.random.default_rng(8)
    before = rng.integers(0, 6, (5, 30)).astype(float)  # class before (the last is the end) by word
    old = rng.integers(0, 4, 30)
    table = np.zeros((5, 5))
    for w in range(30):
        table[:, old[w]] += before[:, w]
    d, w = np.nonzero(before)
    order = np.argsort(w, kind="stable")
    got = brown_lm.moved(table, old, w[order], d[order], before[d[order], w[order]])

    def likelihood(t):
        x = lambda y: (y[y > 0] * np.log(y[y > 0])).sum()
        return x(t) - x(t.sum(axis=0))

    for k in range(30):
        scores = []
        for g in range(4):
            t = table.copy()
            t[:, old[k]] -= before[:, k]
            t[:, g] += before[:, k]
            scores.append(likelihood(t))
        assert scores[got[k]] == pytest.approx(max(scores))


def test_exchange_raises_the_likelihood_and_finds_classes():
    rng = np.random.default_rng(0)
    true = np.arange(60) % 3
    n = np.zeros((61, 61))
    for _ in range(30_000):
        a = int(rng.integers(60))
        n[a, int(rng.choice(np.flatnonzero(true == (true[a] + 1) % 3)))] += 1
    group = brown_lm.exchange(n, classes=3)
    assert group[60] == 3
    assert all(len(set(group[:60][true == k])) == 1 for k in range(3)) and len(set(group[:60])) == 3


# SimHash


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents, nothing):
    items = [(r.doc_id, simhash_of(r.text)) for r in documents.select("doc_id", "text").collect()]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(items, least(items, lambda a, b: (a ^ b).bit_count() <= 4), strict=True)]
    got = by_id(simhash.near_duplicates(documents).collect(), "doc_id", "fingerprint", "component_id")
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("joined", [False, True])
def test_anchors_lose_no_pair(joined):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64) << np.uint64(1) | rng.integers(0, 2, 2_000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 2_000).astype(np.uint64)
    rows = [{(r, w) for r, w in zip(*map(np.ndarray.tolist, simhash.replicas(v, joined)), strict=True)} for v in (x, y)]
    assert {r for r, _ in rows[0] & rows[1]} == set(range(2_000))


def test_every_word_has_a_golay_anchor_within_three():
    x = np.random.default_rng(5).integers(0, 1 << 23, 5_000)
    row, word = simhash.anchors().near(x, 3)
    assert (np.sort(row) == np.arange(5_000)).all()  # a perfect code: exactly one
    assert (np.bitwise_count(x[row] ^ word) <= 3).all() and (simhash.anchors().syndrome(word) == 0).all()


@pytest.mark.parametrize(("most", "join_from"), [(8_192, 1 << 24), (150, 1 << 24), (8_192, 1)])
def test_chains_and_hot_groups(spark, most, join_from):
    """A chain of near fingerprints is one component; a dense group is linked without all its pairs; anchors dealt to blocks and
    the plan of two joined blocks give the same components."""
    rng = np.random.default_rng(6)
    center = int(rng.integers(1 << 62))
    dense = {center} | {center ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (3_000, 2))}
    chain = [int(rng.integers(1 << 62))]
    for k in range(12):
        chain.append(chain[-1] ^ 0b1111 << 4 * k)
    signed = np.array([*dense, *chain], np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4), len(signed), most, join_from)
    assert edges.count() < 60 * len(signed)
    roots = {r.id: r.root for r in common.components(edges).collect()}
    assert len({roots[x] for x in signed[: len(dense)]}) == 1 and len({roots[x] for x in signed[len(dense) :]}) == 1


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(7)
    pairs = [*map(tuple, rng.integers(0, 400, (260, 2)).tolist()), *((k, k + 1) for k in range(1000, 1070)), *((5000, k) for k in range(5001, 5400)), (7, 7)]
    p: dict[int, int] = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Line dedup


def dedup(rows):
    words = lambda x: x.count(" ") + 1 if x else 0

    def windows(lines):
        for i, x in enumerate(lines):
            if words(x) >= line_dedup.LONG:
                yield i, (x,)
            if i + 1 < len(lines) and min(words(x), words(lines[i + 1])) < line_dedup.LONG:
                yield i, (x, lines[i + 1])

    places: dict[tuple, set] = {}
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
    for r in rows:
        for i, c in windows((r[1] or "").split("\n")):
            places.setdefault(c, set()).add((*key(r), i))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        later = {(i, len(c)) for i, c in windows(lines) if (*key(r), i) != min(places[c])}
        gone = {i for i, n in later if n == 1}
        for i in sorted(i for i, n in later if n == 2):
            if (i - 1, 2) not in later:
                b = i
                while (b, 2) in later:
                    b += 1
                if sum(map(words, lines[i : b + 1])) >= line_dedup.LONG:
                    gone |= set(range(i, b + 1))
        out.append((r[0], "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def test_line_dedup(documents, nothing):
    got = line_dedup.dedup_lines(documents)
    assert set(got.columns) == {*documents.columns}
    want = dedup([(r.doc_id, r.text) for r in documents.collect()])
    assert by_id(got.collect(), "doc_id", "text", "n_lines", "lines_removed") == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_passages_are_found_and_clean_lines_stay(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage, block = words(60), "\n".join(words(9) for _ in range(12))
    clean = [(i, "\n".join(words(int(n)) for n in rng.integers(3, 60, 8))) for i in range(30)]
    hot = [(100 + i, f"{words(30)}\n{passage}\n{words(8)}\n{block}\n{words(40)}") for i in range(50)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(clean + hot, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[i].text == t for i, t in clean) and got[100].lines_removed == 0
    assert all(passage not in got[i].text and got[i].lines_removed >= 5 for i, _ in hot[1:])


@pytest.mark.parametrize(("lines", "each"), [(3, 20), (4, 15), (5, 24), (6, 10), (10, 6), (52, 1), (2, 26)])
def test_blocks_of_short_lines_between_short_lines(spark, lines, each):
    """A repeated passage of over 50 words goes from its first line to its last, and its neighbours stay."""
    rng = np.random.default_rng(lines)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 8)) for _ in range(n))
    block = [words(each) for _ in range(lines)]
    rows, want = [], {}
    for i in range(20):
        before, after = [words(int(n)) for n in rng.integers(2, 20, 5)], [words(int(n)) for n in rng.integers(2, 20, 5)]
        rows.append((i, "\n".join(before + block + after)))
        want[i] = "\n".join(before + (block if i == 0 else []) + after)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_short_shared_lines_stay(spark):
    """What many documents share but has fewer words than a passage is left alone."""
    rows = [(i, f"Yours\nsincerely {i}\nthe\nsame three\nshort lines {i * 7}") for i in range(30)]
    assert all(r.lines_removed == 0 for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_added_columns_meet_no_name(spark):
    docs = spark.createDataFrame([(1, "a", "mine", "kept")], "doc_id long, text string, text_read string, __text string")
    assert tuple(langid.identify(docs, None).first()) == (1, "a", "mine", "kept", "und", 0.0)
    assert tuple(imatch.fingerprint_documents(docs, np.zeros(0, np.uint64)).first())[:4] == (1, "a", "mine", "kept")


def test_columns_of_any_name_are_carried(spark):
    names = ["doc_id", "text", "body", "id", "mark", "carried", "__text", "__row", "key", "at", "gone", "a.b"]
    row = (1, "x", *[f"v{k}" for k in range(10)])
    got = line_dedup.dedup_lines(spark.createDataFrame([row], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names)))
    assert got.columns == [*names, "n_lines", "lines_removed"] and tuple(got.first()) == (*row, 1, 0)


def test_line_dedup_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert by_id(line_dedup.op9_line_dedup(spark, sf_dir).collect(), "doc_id", "n_lines", "lines_removed", "text") == sorted(con.execute(line_dedup.ORACLE_SQL).fetchall())


# I-Match


def test_imatch(documents, nothing):
    words = imatch.lexicon(documents)
    rows = documents.select("doc_id", "text").collect()
    df = Counter(w for r in rows for w in {x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))} if w)
    n = len(rows)
    exact = Counter(w for r in rows for w in set(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))))
    assert set(words.tolist()) == {xxhash.xxh64_intdigest(w) for w, x in exact.items() if max(2, imatch.LOWEST * n) <= x <= max(2, imatch.HIGHEST * n)}
    assert len(df)
    got = imatch.edits(documents, words).collect()
    assert len(got) == n
    keyed = [r for r in rows if r.doc_id is not None]
    found = {r.doc_id: r for r in got}
    ordered = sorted(keyed, key=lambda r: r.doc_id)
    prints: dict[str, set] = {}
    for r in got:
        if r.doc_id is not None:
            prints.setdefault(next(x.text or "" for x in keyed if x.doc_id == r.doc_id), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    for r, after in zip(ordered, ordered[1:], strict=False):
        if r.doc_id != after.doc_id:
            a, b, f = r.text or "", after.text or "", found[r.doc_id]
            edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            assert f.n_chars == len(a) and f.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= f.near_edited <= 1 and 0 <= f.near_next <= 1
            own = imatch.fingerprints(pa.array([a, edited, b], pa.large_string()), words)
            assert [f.fingerprint, f.edited_fingerprint] == imatch.spelled(own[:2])
            assert f.near_next == pytest.approx(imatch.likeness(own[:1], own[2:])[0])
    assert imatch.edits(nothing, imatch.lexicon(nothing)).count() == 0
    assert imatch.fingerprint_documents(documents, words).count() == n


def test_last_document_is_followed_by_the_first(spark):
    rows = [(k, f"{'abcdef'[k]} " * 10) for k in range(6)]
    for n in (1, 6):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.edited_sha256 for r in imatch.edits(docs, imatch.lexicon(docs)).collect()}
        for k in range(n):
            a, b = rows[k][1], rows[(k + 1) % n][1]
            assert got[k] == hashlib.sha256((a[:10] + b[:10]).encode()).hexdigest()


def test_likeness_tells_edits_from_others(spark):
    rows = imatch.op10_imatch(spark, "/root/testdata/sf0.01").collect()
    assert np.mean([r.near_edited for r in rows]) > 0.2 > 10 * np.mean([r.near_next for r in rows])
