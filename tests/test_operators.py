"""Operators that SQL can't express, edge cases and known values."""

from __future__ import annotations

import inspect
import itertools
from pathlib import Path
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import answers as A
from corvane.functions import difficulty as D
from corvane.functions import numeric as N
from corvane.functions import taxonomy as X
from corvane.functions import text as T
from corvane.operators import agreement, allocate, audit, calibration, composites, curation, equivalence, ledger, pairs, pool, split, stats, study, summary
from corvane.sources import readers, writers
from corvane.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_largest_remainder_known_values(spark):
    df = spark.createDataFrame([("a", 0.45), ("b", 0.40), ("c", 0.15)], "k string, w double")
    got = {r.k: r.allocated for r in allocate.largest_remainder(df, 27, "w", ["k"]).collect()}
    assert got == {"a": 12, "b": 11, "c": 4} == curation.remainder_shares(27, [("a", 0.45), ("b", 0.40), ("c", 0.15)])
    zero = spark.createDataFrame([("a", 0.0)], "k string, w double")
    assert allocate.largest_remainder(zero, 5, "w", ["k"]).first().allocated == 0


def test_finite_numbers(spark):
    rows = [("1.5", 1.5, None), ("7", 7.0, 7), ("nan", None, None), ("inf", None, None), ("x", None, None), (None, None, None), ("true", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string").select("v", N.finite_double(F.col("v")).alias("d"), N.finite_long(F.col("v")).alias("l"))
    assert [(r.v, r.d, r.l) for r in df.collect()] == rows


def test_t_critical_and_interval(spark):
    assert [one(spark, N.t_critical(F.lit(n))) for n in (1, 2, 30)] == [12.706, 4.303, 2.042]
    assert one(spark, N.t_critical(F.lit(1000.0))) == pytest.approx(1.9623, abs=1e-3)
    df = spark.createDataFrame([("m", 0.1), ("m", 0.2), ("m", 0.3), ("n", 0.5), ("n", None)], "k string, v double")
    got = {r.k: r for r in stats.summarize(df, ["k"], "v").collect()}
    assert got["m"].ci_high == pytest.approx(0.2 + 4.303 * 0.1 / math.sqrt(3)) and (got["n"].n, got["n"].std) == (1, 0.0)


def test_exact_mcnemar(spark):
    rows = [("a", True, False), ("a", False, True), ("a", False, True), ("a", True, True)]
    r = stats.mcnemar(spark.createDataFrame(rows, "k string, left boolean, right boolean"), ["k"]).first()
    assert (r.risk_difference, r.left_only, r.right_only) == (0.25, 1, 2) and r.p_value == pytest.approx(1.0)
    assert math.exp(N.log_binomial_tail(2000, 900)) == pytest.approx(sum(math.comb(2000, i) for i in range(901)) / 2**2000)


def test_bootstraps_hold_the_effect(spark):
    rng = np.random.default_rng(0)
    rows = [("x", int(s), int(i), bool(rng.random() < 0.5), bool(rng.random() < 0.6)) for s in range(5) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seed int, item int, left boolean, right boolean")
    for r in (stats.paired_bootstrap(df, ["k"], "item").first(), stats.cluster_bootstrap(df, ["k"], "seed", 300).first()):
        assert r.ci_low <= r.effect <= r.ci_high and -0.2 < r.ci_low and r.ci_high < 0.35
    assert stats.paired_bootstrap(df, ["k"], "item").first() == stats.paired_bootstrap(df.repartition(7), ["k"], "item").first()


def test_jaccard_join_is_complete(spark):
    rng = np.random.default_rng(1)
    sets = {i: sorted({f"t{x}" for x in rng.integers(0, 14, rng.integers(0, 9))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id int, s array<string>")
    got = {(r.left, r.right): r.similarity for r in pairs.jaccard_pairs(df, "id", "s", 0.5).collect()}
    want = {}
    for a, b in itertools.combinations(sets, 2):
        x, y = set(sets[a]), set(sets[b])
        if x and y and len(x & y) / len(x | y) >= 0.5:
            want[a, b] = len(x & y) / len(x | y)
    first = {tuple(s): min(i for i in sets if sets[i] == s) for s in sets.values()}  # copies are linked with the first only
    spanned = {(a, b): v for (a, b), v in want.items() if (first[tuple(sets[a])] == a and (first[tuple(sets[b])] in (a, b)))}
    assert got == pytest.approx(spanned) and 0 < len(spanned) < len(want)


def test_jaccard_join_of_pairs_writes_less_than_the_texts(spark):
    rng = np.random.default_rng(3)
    texts = {i: [f"w{x}" for x in rng.integers(0, 4000, 300)] for i in range(120)}
    for i in range(100, 120):
        texts[i] = [*texts[i - 100][: -1 - i % 20], *texts[i][: 1 + i % 20]]
    texts |= {120: ["one"], 121: ["one"], 122: ["one", "two"], 123: [], 124: texts[3]}
    df = spark.createDataFrame(list(texts.items()), "id long, w array<string>")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    before = size()
    got = {(r.left, r.right): r.similarity for r in pairs.jaccard_pairs(df, "id", "w", 0.8, 2).collect()}
    written = size() - before
    sets = {i: set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w) for i, w in texts.items()}
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if x and y and len(x & y) / len(x | y) >= 0.8}
    want = {k: v for k, v in want.items() if k[0] != 124 and (k[1] != 124 or k[0] == 3)}
    assert got == pytest.approx(want) and len(want) > 10
    assert written < sum(len(" ".join(w)) for w in texts.values())


def test_first_wins_equals_one_row_at_a_time(spark):
    rng = np.random.default_rng(5)
    sets = {i: sorted({f"t{x}" for x in rng.integers(0, 12, rng.integers(0, 8))}) for i in range(80)}
    quality = {i: int(rng.integers(0, 4)) for i in sets}
    df = spark.createDataFrame([(i, s, quality[i]) for i, s in sets.items()], "id int, s array<string>, q int")
    kept: list[int] = []
    for i in sorted(sets, key=lambda i: (-quality[i], i)):
        x = set(sets[i])
        if not x or not any(len(x & set(sets[k])) / len(x | set(sets[k])) >= 0.6 for k in kept if sets[k]):
            kept.append(i)
    got = curation.first_wins(df, "id", "s", [(-F.col("q")).alias("q"), F.col("id").alias("k")], 0.6).collect()
    assert len(got) == 80 and {r.id for r in got if r.kept} == set(kept)


def test_exact_search_by_blocks(spark, monkeypatch):
    """Blocks of any size give the neighbours that brute force does; unsound vectors match nothing."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(90, 6))
    rows = [(i, [float(x) for x in v[i]]) for i in range(90)] + [(90, None), (91, [0.0] * 6), (92, [float("nan")] * 6), (93, [None] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(pairs, "QUERY_BLOCK", 4)
    monkeypatch.setattr(pairs, "CORPUS_BLOCK", 20)
    got = {(r["query"], r["rank"]): (r.match, r.similarity) for r in pairs.top_cosine(df.where("vec_id % 5 = 0"), df, "vec_id", "embedding", 3).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 90, 5):
        s = u @ u[q]
        s[q] = -2
        for n, m in enumerate(np.argsort(-s)[:3]):
            assert got.pop((q, n + 1)) == (m, pytest.approx(s[m]))
    assert not got


def test_refused_events_block_no_later_ones(spark):
    rows = [(1, 1, 100), (1, 2, 5_000), (1, 3, 50), (2, 1, None), (2, 2, 2_000), (2, 3, 1), (None, 1, 3)]
    got = ledger.capped(spark.createDataFrame(rows, "k long, at long, t long").repartition(3), ["k"], ["at"], "t", 2_000).collect()
    assert {(r.k, r.at): (r.running_tokens, r.admitted) for r in got} == {(1, 1): (100, True), (1, 2): (100, False), (1, 3): (150, True), (2, 1): (0, True), (2, 2): (2_000, True), (2, 3): (2_000, False), (None, 1): (3, True)}


def test_greedy_keep_is_the_first_independent_set(spark):
    rng = np.random.default_rng(2)
    edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 40, (60, 2)) if e[0] != e[1]} | {(k, k + 1) for k in range(50, 70)}
    kept: set[int] = set()
    for n in range(75):
        if not any((min(n, k), max(n, k)) in edges for k in kept):
            kept.add(n)
    got = curation.greedy_keep(spark.range(75).select(F.col("id").alias("rank")), spark.createDataFrame(list(edges), "a long, b long"))
    assert {r["rank"] for r in got.where("kept").collect()} == kept


def test_text_functions(spark):
    assert one(spark, T.normalized(F.lit("  What  is\t2 + 2? "))) == "what is 2 + 2"
    assert one(spark, T.template(F.lit("A car drives 60 km in x hours, 3/4 full"))) == "<VAR> car drives <NUM> <UNIT> in <VAR> <UNIT>, <NUM> full"
    assert one(spark, T.parenthesis_depth(F.lit("))((a)[b{c}])("))) == 3
    assert one(spark, T.pair_tfidf(F.array(), F.array())) == 1.0
    assert one(spark, T.structure_signature(F.lit("Solve sin(x) = 2"))) == "sin|solve|(|)|="
    a, b = ["x", "y", "y"], ["y", "z"]
    alone = math.log(1.5) + 1
    want = 2 / math.sqrt((alone**2 + 4) * (1 + alone**2))
    assert one(spark, T.pair_tfidf(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) == pytest.approx(want)
    assert one(spark, T.slug(F.lit("--Ab c!"))) == "ab-c" and one(spark, T.cut_at(F.lit("ab;c.d"), [".", ";"])) == "ab"


def test_difficulty(spark):
    p = one(spark, D.profile(F.lit("Compute 2 + 3.")))
    assert (p["operation_count"], p["constraint_count"], p["band"]) == (1, 1, "foundational")
    hard = one(spark, D.profile(F.lit("x"), expressions=F.array(F.lit("sin(x)^2 + ((y-1)*(z+2))/3 <= 4"), F.lit("x = y")), steps=F.array(*map(F.lit, "abcdef"))))
    assert hard["score"] > p["score"] and hard["confidence"] == 0.95 and hard["reasoning_steps"] == 6
    assert [one(spark, D.next_difficulty(F.lit(c), F.lit(a), F.lit(b))) for c, a, b in ((6, 1, 1), (2, -1, 0), (4, 1, -1))] == [6, 2, 4]


def test_profile_of_accented_text_equals_its_sql(spark, tmp_path):
    import duckdb

    from corvane.plans import policy_queries

    texts = ["Lagab\u00f3 eldoasmentell ci\u00f3nci\u00f3nar ue\u00f1.", "\u00f1dollar", "\u00e9sin(x) a\u017fin(y)", "2\u00e9integer real\u00f3", "per\u00a0cm x\u00a0", "a\u3000" * 24, "M\u0130LE", "per\x0bm x", ""]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(map(tuple, policy_queries.difficulty_profile(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(policy_queries.PROFILE).fetchall())


@pytest.mark.parametrize(
    ("gold", "predicted", "kind", "status"),
    [("1/2", "0.5", "rational", "equal"), ("25%", "0.25", "percentage", "equal"), ("{3,1,2}", "{1, 2, 3}", "set", "equal"), ("[0, 1)", "[0,1)", "interval", "equal"), ("[[1,2],[3,4]]", "1,2;3,4", "matrix", "equal"), ("[[1,2],[3,4]]", "[[1,2],[3,5]]", "matrix", "different"), ("5 meters", "5 m", "unit_value", "equal"), ("(1,2)", "(2,1)", "ordered_tuple", "different"), ("x", "12", "integer", "ambiguous"), ("1/0", "1", "rational", "ambiguous"), ("Yes.", "true", "boolean", "equal")],
)
def test_equivalence(spark, gold, predicted, kind, status):
    assert one(spark, A.equivalent(F.lit(gold), F.lit(predicted), F.lit(kind)))["status"] == status


def test_symbolic_identity():
    s = equivalence.symbolic_status
    assert s("(x+1)^2", "x^2+2x+1", "symbolic_expression") == "equal"
    assert s("(x+1)^2", "x^2+2x", "symbolic_expression") == "different"
    assert s("x/(x-1)", "1 + 1/(x-1)", "symbolic_expression") == "equal"
    assert s("2x = 4", "x - 2 = 0", "equation") == "equal" and s("2x = 4", "x = 3", "equation") == "different"
    assert s("__import__('os')", "1", "symbolic_expression") == "ambiguous" and s(None, "1", "equation") == "ambiguous"
    assert s("2^(9^9)", "1", "symbolic_expression") == "ambiguous"
    assert equivalence.solve_linear([[2, 1, 5], [1, -1, 1]]) == [2, 1] and equivalence.solve_linear([[1, 1, 2], [2, 2, 4]]) is None


def test_lifecycle(spark):
    rows = [("active", 0, None, 1, ("active", 0)), ("active", 0, None, 2, ("stale", 0)), ("stale", 0, None, 4, ("retired", 0)), ("active", 1, True, 0, ("mastered", 2)), ("mastered", 2, False, 0, ("active", 0)), ("mastered", 2, None, 5, ("retired", 2))]
    df = spark.createDataFrame([r[:4] for r in rows], "state string, streak int, ok boolean, age int")
    got = df.select(pool.next_state(F.col("state"), F.col("streak"), F.col("ok"), F.col("age")).alias("n")).collect()
    assert [(r.n["state"], r.n["streak"]) for r in got] == [r[4] for r in rows]


def test_merge_is_idempotent(spark):
    new = spark.createDataFrame([("k", 1, 2, "c", "s", "g")], "unique_key string, cycle int, iteration int, category string, sub_category string, grade string")
    empty = spark.createDataFrame([], "unique_key string, category string, sub_category string, grade string, state string, streak int, last_seen_cycle int, last_iteration int, occurrences int, failures int")
    first = pool.merge(empty, new)
    assert pool.merge(first, new).collect() == first.collect() and first.first().occurrences == 1


def test_cluster_split_keeps_clusters_whole(spark):
    rows = [(i, f"c{i % 17}", "abc"[i % 3]) for i in range(300)]
    out = split.cluster_split(spark.createDataFrame(rows, "id int, cluster string, kind string"), "cluster", ["kind"])
    assert split.split_overlap(out, "cluster").isEmpty()
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(n.values()) == 300 and set(n) == {"train", "validation", "test"} and n["train"] > 200
    with pytest.raises(Exception, match="fewer clusters"):
        split.cluster_split(spark.createDataFrame(rows[:2], "id int, cluster string, kind string"), "cluster", []).collect()


def test_token_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, "a", 6), (2, "b", 5), (3, "a", 3), (4, "b", 2), (5, "a", 50)], "id int, s string, t int")
    got = {r.id for r in split.token_budget(df, ["s"], F.col("id"), "t", 10).collect()}
    assert sum(r[2] for r in [(1, "a", 6), (2, "b", 5), (3, "a", 3), (4, "b", 2)] if r[0] in got) <= 10 and 5 not in got and len(got) >= 2


def test_irt_recovers_difficulties():
    rng = np.random.default_rng(3)
    ability, hard = rng.normal(0, 1, 80), np.linspace(-2, 2, 24)
    y = (rng.random((80, 24)) < 1 / (1 + np.exp(-(ability[:, None] - hard[None, :])))).astype(float)
    y[rng.random(y.shape) < 0.05] = np.nan
    _, got, _ = calibration.fit_irt(y)
    assert np.corrcoef(got, hard)[0, 1] > 0.95 and abs(got.mean()) < 1e-9


def test_simplex_weights(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(0.7 * a + 0.3 * b)) for a, b in rng.random((200, 2))]
    w = calibration.simplex_weights(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    assert w["a"] == pytest.approx(0.7, abs=0.02) and sum(w.values()) == pytest.approx(1)


def test_kappa_of_nothing_and_of_one_label(spark):
    schema = "one string, two string, w double"
    assert agreement.cohen_kappa(spark.createDataFrame([], schema), "one", "two", "w").first().kappa is None
    assert agreement.cohen_kappa(spark.createDataFrame([("a", "a", 1.0)], schema), "one", "two", "w").first().kappa == 1.0


def test_registry_and_audit(spark):
    plan = study.matrix(spark, method=["a", "b"], seed=[1])
    old = plan.limit(1).withColumn("status", F.lit("running"))
    got = study.merge_registry(plan, old, ["method", "seed"])
    assert sorted(r.status for r in got.collect()) == ["partial", "pending"]
    with pytest.raises(ValueError, match="identity"):
        study.merge_registry(plan, old.withColumn("seed", F.lit(9)), ["method", "seed"])
    assert audit.forbidden_fields(spark.createDataFrame([], "a struct<gold:string,b:array<struct<gold:int>>>"), {"gold"}) == ["a.gold", "a.b[].gold"]
    good, bad = audit.validated(spark.createDataFrame([(1,), (None,)], "v int"), [(F.col("v").isNull(), "no_value")])
    assert good.count() == 1 and bad.first().reasons == ["no_value"]


def test_taxonomy(spark):
    assert X.taxonomy(spark).count() == 27
    assert one(spark, X.category_of(F.lit(""), F.lit(""), F.lit("the derivative of f"))) == "Calculus"
    assert one(spark, X.group_of(F.lit("own group"), F.lit("Algebra"), F.lit(""))) == "own group"
    assert one(spark, X.group_of(F.lit(None).cast("string"), F.lit("Algebra"), F.lit("a coin"))) == "Basic Probability"


def test_random_and_empty_plans(spark):
    g = spark.createDataFrame([("a", "x"), ("b", "y")], "c string, s string")
    plan = allocate.random_plan(g, 10, ["c", "s"], 7)
    assert plan.agg(F.sum("question_count")).first()[0] == 10 and plan.collect() == allocate.random_plan(g, 10, ["c", "s"], 7).collect()
    assert allocate.empty_plan(g, ["c", "s"]).count() == 0
    assert allocate.Budget.parse({"questions": 60, "iterations": 5, "cycles": 3}).per_iteration == 4
    with pytest.raises(ValueError, match="evenly"):
        allocate.Budget(10, 3)


def test_set_operations(spark):
    a, b = spark.range(5), spark.range(4)
    assert summary.same_rows(a, spark.range(5)) and not summary.same_rows(a, b)


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q1"}, {"question": "q2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"question": "q3"}]}))
    (tmp_path / "c.json").write_text('{"question": "q4"}\nnot json\n{"question": "q5"}\n')
    (tmp_path / "d.json").write_text(json.dumps([[{"question": "q6"}]]))
    assert sorted(r.question for r in readers.records(spark, str(tmp_path), readers.ITEM).collect()) == [f"q{k}" for k in range(1, 7)]
    assert one(spark, readers.last_boxed(F.lit(r"so \boxed{1} and \boxed{\frac{a}{b}}."))) == r"\frac{a}{b}"
    assert one(spark, readers.last_marked(F.lit("work #### 1,234"))) == "1234"
    g, m, c, t = (tmp_path / n for n in ("g", "m", "c", "t"))
    for d in (g, m, c, t):
        d.mkdir()
    (g / "x.jsonl").write_text(json.dumps({"question": "How many apples cost 3?", "answer": "x #### 36"}) + "\n")
    (m / "x.json").write_text(json.dumps({"problem": "Find x.", "solution": r"\boxed{2}", "level": "Level 3", "type": "Algebra"}))
    (c / "algebra_test.csv").write_text('"What, is it?",a,b,c,d,B\nbad,a,b,c,d,Z\n')
    (t / "arith.txt").write_text("1 + 1?\n2\nWhat is 3?\n3\n")
    out = readers.imported(spark, [("gsm8k_jsonl", str(g)), ("hendrycks_math_json", str(m)), ("mmlu_csv", str(c)), ("deepmind_text", str(t))]).collect()
    assert sorted(r.gold_answer for r in out) == ["2", "2", "3", "36", "B"] and {r.source for r in out} >= {"gsm8k", "Algebra", "algebra", "arith"}
    (t / "odd.txt").write_text("one line\n")
    with pytest.raises(ValueError, match="odd number"):
        readers.alternating(spark, str(t))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    first = writers.publish(df, f"{tmp_path}/set", "id")
    assert first == writers.manifest(df.repartition(3), "id") and first["rows"] == 2
    with pytest.raises(Exception, match="(?i)exist"):
        writers.publish(df, f"{tmp_path}/set", "id")
    writers.blinded(df, f"{tmp_path}/packets", "id", ["v"])
    assert spark.read.csv(f"{tmp_path}/packets/one", header=True).columns == ["id"]
    for _ in range(2):
        writers.by_cycle(df, f"{tmp_path}/cycles", 1, 2)
    writers.by_cycle(df, f"{tmp_path}/cycles", 1, 3)
    assert spark.read.parquet(f"{tmp_path}/cycles").count() == 4
    csv = tmp_path / "x.csv"
    csv.write_text("id,v\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.csv_by_id(spark, str(csv), "id")


def test_model_boundary(spark):
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(10)], "prompt string")
    got = readers.call_model(prompts, lambda: lambda xs: [(x, len(xs)) for x in xs], "answer string, batch int", 3)
    assert got.count() == 10 and got.agg(F.max("batch")).first()[0] <= 3


def test_streams_keep_state_over_batches(spark, tmp_path):
    src, rows = f"{tmp_path}/in", [(i, f"2024-01-01 00:{i:02d}:00", i % 2, i % 3 != 0) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, t string, sample long, is_correct boolean").select("event_id", F.to_timestamp("t").alias("ts"), "sample", "is_correct")
    for k in range(3):
        df.where(f"event_id >= {10 * k} AND event_id < {10 * k + 10}").coalesce(1).write.mode("append").parquet(src)
    stream = events.read(spark, src, "event_id long, ts timestamp, sample long, is_correct boolean", files_per_batch=1)
    got = events.finished(events.lifecycle(stream, "sample"), "update").groupBy("sample").agg(F.max("tests").alias("tests"), F.max("failures").alias("failures")).collect()
    assert {r["sample"]: (r.tests, r.failures) for r in got} == {s: (15, sum(1 for i, _, k, ok in rows if k == s and not ok)) for s in (0, 1)}


def test_repeated_deliveries_count_once(spark, tmp_path):
    """A batch that comes again changes neither the admitted calls nor the blocked rounds nor the upserted rows."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(minutes=k), k % 2, (k * 37) % 60, k % 5 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, k long, t long, fruitful boolean")
    src = f"{tmp_path}/in"
    for first, last in ((0, 20), (0, 20), (20, 40), (10, 30)):
        df.where(f"event_id >= {first} AND event_id < {last}").coalesce(1).write.mode("append").parquet(src)
    read = lambda: events.read(spark, src, "event_id long, ts timestamp, k long, t long, fruitful boolean", files_per_batch=1)
    used, want = {0: 0, 1: 0}, {}
    for event, _, k, t, _ in rows:
        fits = used[k] + t <= 300
        used[k] += t if fits else 0
        want[event] = (fits, used[k])
    got = events.finished(events.budget_cap(read(), "k", "t", 300), "append").collect()
    assert {r.event_id: (r.admitted, r.used) for r in got} == want and len(got) == 40
    assert events.finished(events.cooldown(read(), "k"), "append").count() == 40
    totals = events.finished(events.ledger(read(), ["k"], F.col("t")), "complete").collect()
    assert {r.k: (r.events, r.tokens) for r in totals} == {k: (20, sum(r[3] for r in rows if r[2] == k)) for k in (0, 1)}


def test_upserts_keep_what_other_batches_wrote(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    schema = "k long, part long, v string, n long"
    for batch in ([(1, 1, "a", 1), (2, 1, "b", 1)], [(3, 1, "c", 2)], [(1, 1, "d", 3), (1, 1, "e", 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):  # a second run finds nothing new
        events.upsert_sink(events.read(spark, src, schema, files_per_batch=1), out, f"{tmp_path}/state").awaitTermination()
    got = events.upserted(spark, out, ["k"], ["n"]).collect()
    assert {r.k for r in got} == {1, 2, 3} and len(got) == 3 and next(r.v for r in got if r.k == 2) == "b"


def test_composites_fail_closed(spark, tmp_path):
    """Short pools, targets that are no whole blocks and dimensions out of range are errors; tables are written whole."""
    rows = spark.createDataFrame([(k, "correct_retention_samples" if k % 3 == 0 else "other") for k in range(30)], "id long, source string")
    got = composites.matched_cap(rows, "source", [F.col("id")], 12).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 13]
    for target in (13, 400):
        with pytest.raises(ValueError):
            composites.matched_cap(rows, "source", [F.col("id")], target)
    kind = "k long, d map<string, struct<normalized: double, value: double>>"
    sound = {n: (0.5, None) for n in composites.SCALES} | {"operation_count": (None, 10.0)}
    assert tuple(composites.dimension_matrix(spark.createDataFrame([(1, sound)], kind), "k", "d").first()) == (1, 0.5, 0.5, 0.5, 0.5, 0.5)
    for bad in ({}, sound | {"reasoning_steps": (None, 11.0)}, sound | {"symbolic_depth": (None, None)}, sound | {"symbolic_depth": (-0.1, None)}):
        with pytest.raises(ValueError):
            composites.dimension_matrix(spark.createDataFrame([(1, bad)], kind), "k", "d")
    long = spark.createDataFrame([(m, s, c, q, str(q % 2), str(q % 3), q % 4, (q + s + c + (m == "full")) % 3 > 0) for m in ("base", "full") for s in (1, 2) for c in (0, 1) for q in range(12)], "method string, seed int, cycle int, question_id int, category string, sub_category string, difficulty int, is_correct boolean")
    tables = composites.paper_tables(long, "base", [("base", "full")])
    assert composites.write_tables(tables, f"{tmp_path}/tables") == {"results_long": 96, "run_summary": 4, "main_results": 2, "ablation_results": 1, "category_results": 4, "difficulty_results": 8, "efficiency_results": 4, "significance_tests": 1}


def test_a_sample_seen_again_is_active(spark):
    old = spark.createDataFrame([("a", "c", "s", "train_eligible", "mastered", 2, 1, 1, 3, 0)], "unique_key string, category string, sub_category string, grade string, state string, streak int, last_seen_cycle int, last_iteration int, occurrences int, failures int")
    new = spark.createDataFrame([("a", "c", "s", "easy_sample", 2, 1)], "unique_key string, category string, sub_category string, grade string, cycle int, iteration int")
    for _ in range(2):  # the same delivery again changes nothing
        old = pool.merge(old, new)
        r = old.first()
        assert (r.state, r.streak, r.occurrences, r.grade) == ("active", 0, 4, "easy_sample")


def test_greedy_choice_is_whole_or_fails(spark):
    """A chain keeps every second node however many rounds it takes; a limit that is too low is an error."""
    nodes = spark.range(9).select(F.col("id").alias("rank"))
    chain = spark.range(8).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["rank"] for r in curation.greedy_keep(nodes, chain).where("kept").collect()} == {0, 2, 4, 6, 8}
    assert inspect.signature(curation.greedy_keep).parameters["most_rounds"].default is None
    with pytest.raises(RuntimeError):
        curation.greedy_keep(nodes, chain, 2)


def test_curated_set_has_no_near_copies(spark):
    """Near copies of a benchmark item go; of near copies of each other the one of best quality stays."""
    from corvane.plans.policy_queries import curated

    held, one, other = (" ".join(f"{c}{k}x" for k in range(60)) for c in ("held", "one", "other"))
    rows = [(1, held + " more"), (2, one), (3, one + " end"), (4, other)]
    items = spark.createDataFrame([(i, q, "7", "en", "s", True, False, 3, 0, 0.5 + i / 10) for i, q in rows], "id long, question string, gold_answer string, category string, sub_category string, is_correct boolean, tool_violation boolean, difficulty int, cycle int, confidence double")
    holdout = spark.createDataFrame([(1, held)], "item_id long, text string")
    assert {r.id for r in curated(items, holdout).collect()} == {3, 4}


def test_minhash_pairs_over_all_documents_equal_brute_force(spark, sf_dir):
    """No document is left out, and no pair of 23 equal places of 32 is missed."""
    from corvane.plans.text_queries import minhash_pairs_all

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1_000_000_000).alias("k"), "text")
    held = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("k"), "text")
    signed = docs.unionByName(held).withColumn("s", T.ascii_shingles(F.col("text"))).where(F.size("s") > 0)
    sig = sorted((r.k, np.array(r.sig)) for r in signed.select("k", T.minhash(F.col("s"), 32).alias("sig")).collect())
    first: dict = {}
    for k, x in sig:
        first.setdefault(tuple(x), k)
    want = {(a, b): n / 32 for (a, x), (b, y) in itertools.combinations(sig, 2) if (n := int((x == y).sum())) >= 23 and first[tuple(x)] == a and first[tuple(y)] in (a, b)}
    got = {(r.left, r.right): r.similarity for r in minhash_pairs_all(spark, sf_dir).collect()}
    assert got == {p: round(v, 6) for p, v in want.items()}
    assert any(a > 1_000_000_000 for a, _ in got)


def test_minhash_pairs_find_what_is_alike(spark, sf_dir):
    """Recall against exact Jaccard similarity, over all documents and benchmark items and over made near copies."""
    rng = np.random.default_rng(13)
    made = []
    for k in range(60):
        own = [f"{k}w{x}" for x in range(200)]
        for c in range(3):
            made.append((10 * k + c, [f"{c}e{k}-{x}" if rng.random() < 0.04 * c else w for x, w in enumerate(own)]))
    df = spark.createDataFrame(made, "id long, s array<string>")
    sets = {i: set(s) for i, s in made}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85}
    got = {(r.left, r.right) for r in pairs.minhash_pairs(df, "id", "s", 128, 32, 0.78).collect()}
    assert len(want) > 60 and len(want & got) >= 0.97 * len(want)


def test_complete_minhash_bands_miss_no_pair(spark):
    """Two sets whose signatures agree in 23 places, with a difference in each of eight bands."""
    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in range(60)]
    rows = [(k, [*common, *(f"{k}-{x}" for x in rng.integers(0, 10**6, 14))]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    sig = {r.id: np.array(r.sig) for r in df.select("id", T.minhash(F.col("s"), 32).alias("sig")).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(40), 2) if (sig[a] == sig[b]).sum() >= 23}
    got, few = ({(r.left, r.right) for r in pairs.minhash_pairs(df, "id", "s", 32, n, 0.7).collect()} for n in (None, 8))
    assert got == want and few < got
