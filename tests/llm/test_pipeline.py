"""The pipeline's stages and the registry."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from corvane.llm import common, line_dedup, packing, queries, simhash
from corvane.llm.token_files import tokenizer_path


def test_stages_on_documents(spark, documents, sf_dir):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.staged(stage(spark, docs, sf_dir), name)
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS and docs.dtypes == [(c, t) for c, t in documents.dtypes if c in corpus_pipeline.COLUMNS]
        if name == "language_id":
            gone = before.join(docs, "doc_id", "left_anti").where("doc_id IS NOT NULL").collect()
            assert {10_000, 10_001, 10_002, 10_003, 10_013} <= {r.doc_id for r in gone} and len(gone) < 12
        elif name == "line_dedup":
            want = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(before).where("lines_removed = 0 OR trim(text) <> ''").collect()}
            assert {(r.doc_id, r.text) for r in docs.collect()} == want
        elif name == "simhash_near_dedup":
            parts = simhash.near_duplicates(before).where("doc_id IS NOT NULL").collect()
            kept = [r.doc_id for r in docs.where("doc_id IS NOT NULL").collect()]
            assert set(kept) == {r.component_id for r in parts}
            rows = {(r.doc_id, r.text) for r in before.collect()}
            assert {(r.doc_id, r.text) for r in docs.collect()} <= rows and len(kept) == len(set(kept))
        else:
            assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
            assert docs.count() == packing.pack(before, tokenizer_path("word_bpe_49k.json")).count()


def test_near_copies_that_differ_in_many_bits_go(spark):
    """The stage's groups are those of brute force over five-word similarity 0.8 and 4 differing bits."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(24):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        rows.append((10 * k, " ".join(words)))
        for c, edits in enumerate((5, 6, 9)):
            copy = list(words)
            for at in rng.choice(np.arange(5, 295, 10), edits, replace=False):
                copy[at] = f"x{rng.integers(0, 50_000)}"
            rows.append((10 * k + 1 + c, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    fp = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(docs).collect()}
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(296)} for i, t in rows}
    root = {i: i for i, _ in rows}
    missed = 0
    for i, _ in rows:
        for j in (x for x in sets if x < i):
            alike, close = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]), (fp[i] ^ fp[j]).bit_count() <= 4
            missed += alike and not close
            if alike or close:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert missed > 10 and 24 < len(set(root.values())) < 96
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(set(root.values()))


def test_unlike_texts_of_one_id_stay(spark):
    """Rows are judged by their text, not by their id."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 50_000, 80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (2, c), (2, c), (3, a), (None, d), (None, d), (None, b), (None, None), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(((r.doc_id, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert kept == sorted([(1, a), (1, b), (2, c), (4, ""), (None, d)], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_stages_on_an_empty_table(spark, nothing, sf_dir):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_registry():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_scratch_follows_the_session(spark):
    assert common.scratch(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
