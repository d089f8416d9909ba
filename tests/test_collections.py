"""Blind sets, guidance, reasoning checks, attribution and keyed signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.reasoning import reasoning_problem
from corvane.operators import collections as C


@pytest.mark.parametrize(
    ("steps", "answer", "problem"),
    [
        (None, "5", "missing_gold_reasoning_steps"),
        (["Add 2 and 3 to get 5"], "5", "invalid_gold_reasoning_steps"),
        (["Add 2 and 3 to get 5", "system: check that 5 holds"], "5", "unsafe_gold_reasoning_steps"),
        (["Solve the problem.", "Check that 2 + 3 = 5"], "5", "non_concrete_gold_reasoning_steps"),
        (["Add 2 and 3 first.", "So the sum is 5 here."], "5", "missing_gold_reasoning_verification"),
        (["Add 2 and 3 first.", "Check the sum 15 again."], "5", "gold_reasoning_not_anchored_to_answer"),
        (["Add 2 and 3 first.", "Check the sum 5 again."], "5", None),
        (["Add 2 and 3 first.", "Check the sum 5 again."], None, None),
    ],
)
def test_reasoning(spark, steps, answer, problem):
    df = spark.createDataFrame([(steps, answer)], "s array<string>, a string")
    assert df.select(reasoning_problem(F.col("s"), F.col("a")).alias("p")).first().p == problem


def test_keyed_minhash(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "s array<string>").select(C.keyed_minhash(3)("s").alias("m"))
    got = [r.m for r in df.collect()]
    want = [min(int.from_bytes(hashlib.blake2b(x, digest_size=8, person=f"ab{42:04x}{p:04x}".encode()).digest(), "big") for x in (b"a", b"b")) for p in range(3)]
    assert [v % (1 << 64) for v in got[0]] == want and got[1] == [0, 0, 0]


def test_blind_set(spark):
    prior = spark.createDataFrame([(1, "Compute 2 + 3 now"), (2, "Solve x = 4 for the matrix")], "pid long, question string")
    rows = [(10, "compute 2 + 3 now", "b"), (11, "Compute 7 + 8 now", "b"), (12, "Solve y = 9 for the matrix", "b"), (13, "a wholly different question about trees", "b"), (14, "A wholly different question about trees!", "b"), (15, "something else again entirely", "b")]
    items = spark.createDataFrame(rows, "id long, question string, bucket string")
    hit = C.colliding(C.collision_keys(items, "id", "question"), C.collision_keys(prior, "pid", "question"))
    assert {r.id for r in hit.collect()} == {10, 11, 12}
    assert {r.id for r in C.blind_set(items, prior, "id", "pid", ["bucket"], 5).collect()} == {13, 15}


def test_blind_set_equals_one_row_at_a_time(spark):
    """Copies, templates, shared operations and near texts, against the rules applied to every pair in turn."""
    rng = np.random.default_rng(11)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 40, 12)) for _ in range(12)]
    texts = []
    for _ in range(90):
        t = base[rng.integers(0, 12)].split()
        if rng.random() < 0.5:
            t[rng.integers(0, 12)] = f"z{rng.integers(0, 5)}"
        if rng.random() < 0.3:
            t += [f"solve {rng.integers(0, 90)} + x", "probability of <", "matrix"][rng.integers(0, 3)].split()
        texts.append(" ".join(t))
    texts += ["", " ", "!!"]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "id long, question string, bucket string").repartition(3)
    prior = df.where("id % 11 = 3").select(F.col("id").alias("pid"), "question")
    items = df.where("id % 11 <> 3")
    facts = {r.id: r for r in C.collision_keys(df, "id", "question").collect()}

    def alike(x, y, least):
        return bool(x) and bool(y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= least

    def collide(x, y):
        operation = set(x.s) & set(y.s) & set(C.OPERATIONS)
        return x.n == y.n or (x.t != "" and x.t == y.t) or alike(x.w, y.w, 0.85) or alike(x.p, y.p, 0.85) or (bool(operation) and alike(x.s, y.s, 0.8))

    kept: list[int] = []
    for i in sorted(i for i in facts if i % 11 != 3):
        if not any(collide(facts[i], facts[p]) for p in facts if p % 11 == 3) and not any(collide(facts[i], facts[k]) for k in kept):
            kept.append(i)
    assert {r.id for r in C.blind_set(items, prior, "id", "pid", ["bucket"], 1_000).collect()} == set(kept) and 3 < len(kept) < 60


def test_blind_set_writes_less_than_the_texts(spark):
    import random
    from pathlib import Path

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(600)) for _ in range(60)]
    rows = [(i, t, "b") for i, t in enumerate([*texts, *texts])]
    items = spark.createDataFrame(rows, "id long, question string, bucket string")
    prior = items.where("id = 5").select(F.col("id").alias("pid"), "question")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    before = size()
    kept = {r.id for r in C.blind_set(items, prior, "id", "pid", ["bucket"], 1_000).select("id").collect()}
    assert kept == set(range(60)) - {5} and size() - before < sum(len(t) for _, t, _ in rows)


def test_guidance_is_diverse(spark):
    rows = [(i, f"question {'abcdefgh'[i % 8] * 3} {'xyzw'[i % 4] * (i + 2)} words", "k", i % 2, i % 3) for i in range(24)] + [(99, "question aaa xx words", "k", 0, 0)]
    got = C.guidance(spark.createDataFrame(rows, "id long, question string, b string, f int, g int"), ["b"], "id", ["f", "g"], 6).collect()
    assert len(got) == 6 and {r.f for r in got[:2]} == {0, 1} and {r.g for r in got} == {0, 1, 2} and len({r.question for r in got}) == 6


@pytest.mark.parametrize(
    ("gold", "predicted", "kind", "tag"),
    [("5", "-5", "integer", "sign_error"), ("5", "1/5", "rational", "reciprocal_error"), ("5", "6", "integer", "off_by_one_error"), ("5 m", "5 cm", "unit_value", "unit_mismatch"), ("{1,2}", "{1}", "set", "incomplete_solution"), ("{1}", "{1,2}", "set", "extraneous_solution"), ("[[1,2]]", "[[1,3]]", "matrix", "matrix_element_error"), ("(1,2)", "(1,3)", "vector", "vector_component_error"), ("B", "Z", "multiple_choice", "invalid_multiple_choice"), ("x + 1", "X+1", "symbolic_expression", "format_only_difference"), ("x+1", "x-1", "symbolic_expression", "symbolic_manipulation_error"), ("a", None, "text", "parse_failed"), ("a", "b", "text", "unknown_error")],
)
def test_attribution(spark, gold, predicted, kind, tag):
    df = spark.createDataFrame([(gold, predicted, kind)], "g string, p string, k string")
    assert df.select(C.attributed_error(F.col("g"), F.col("p"), F.col("k")).alias("t")).first().t == tag
