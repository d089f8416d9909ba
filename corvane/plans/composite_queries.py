"""Composite reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composites as C
from ..operators import pool
from .base import facts, facts_sql
from .policy_queries import rounded
from .stat_queries import PAIRS, REVIEW
from .stat_queries import QUERIES as STATS
from .stat_queries import panel, reviews
from .state_queries import POOL, attempts, first_pool


def results(spark, sf):
    """Long results of a study: groups of questions stand for its categories, subcategories and difficulties."""
    q = F.col("question_id")
    return facts(spark, sf, "cycle").withColumns({"category": (q % 3).cast("string"), "sub_category": (q % 7).cast("string"), "difficulty": (1 + q % 10).cast("int")})


NUMBERS = ("mean", "std", "minimum", "maximum", "ci_low", "ci_high")


def run_summary(spark, sf):
    return rounded(C.run_summary(results(spark, sf), ["method", "seed"]), "final_accuracy", *C.METRICS)


def main_results(spark, sf):
    x = C.main_results(C.run_summary(results(spark, sf), ["method", "seed"]), [], "method", "N")
    return rounded(x.drop("ci_low", "ci_high"), "mean", "std", "minimum", "maximum", *[f"{m}_mean" for m in C.METRICS], "base_mean_accuracy", "mean_delta_vs_base")


def dimension_tables(spark, sf):
    """The category and the difficulty table, one below the other."""
    t = C.paper_tables(results(spark, sf), "N", PAIRS)
    one = lambda name: t[f"{name}_results"].select("method", F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"), "n", F.round("mean", 6).alias("mean"), "seeds")
    return one("category").unionByName(one("difficulty"))


def significance(spark, sf):
    x = C.significance(facts(spark, sf), ["seed"], "method", "question_id", "is_correct", PAIRS)
    return rounded(x.select("left_method", "right_method", "combined_p", "holm_p"), "combined_p", "holm_p")


def review_report(spark, sf):
    return rounded(C.review_report(reviews(spark, sf), {"kappa": 0.5, "accuracy": 0.6, "macro_f1": 0.9}), "value")


def calibration_report(spark, sf):
    p = panel(spark, sf)
    i = p.select("item").distinct().withColumn("predicted", (F.conv(F.substring(F.md5("item"), 1, 4), 16, 10).cast("long") % 100) / 100.0)
    return rounded(C.calibration_report(i, p, p), "value")


def hard_pool_managed(spark, sf):
    now = attempts(spark, sf).where("cycle = 1996 AND iteration = 5").groupBy("unique_key", "category", "sub_category", "cycle", "iteration").agg(F.min("ok").alias("is_correct"))
    now = now.groupBy("unique_key", "cycle", "iteration").agg(F.min("category").alias("category"), F.min("sub_category").alias("sub_category"), F.min("is_correct").alias("is_correct"))
    return pool.managed(first_pool(spark, sf), now).drop("failures")


def with_evidence(spark, sf):
    k = F.col("unique_key").cast("long")
    return first_pool(spark, sf).withColumns({"verification": F.when(k % 3 == 0, "deterministic"), "confidence": (k % 10) / 10.0, "difficulty": F.when(k % 4 != 0, 1 + k % 10), "error_tags": F.when(k % 2 == 0, F.array(F.lit("sign_error"), F.lit("unit_mismatch"))).otherwise(F.array().cast("array<string>"))})


def variant_context(spark, sf):
    return pool.variant_context(with_evidence(spark, sf)).select("category", "sub_category", "place", "unique_key")


def history_context(spark, sf):
    return pool.history_lines(with_evidence(spark, sf)).groupBy("sub_category", "line").agg(F.count("*").alias("n"))


def matched_cap(spark, sf):
    o = results(spark, sf).where("seed = 1").withColumn("training_source", F.when(F.col("is_correct"), "correct_retention_samples").otherwise("wrong_samples"))
    x = C.matched_cap(o, "training_source", [F.col("question_id"), F.col("method"), F.col("cycle")], 400)
    return x.select("method", "question_id", "cycle", "training_source")


def dimension_matrix(spark, sf):
    from .base import table

    x = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.length("text").alias("n"))
    scales = list(C.SCALES.items())
    entry = lambda k, s: F.when(F.col("n") % 2 == 0, F.struct(((F.col("n") + k) % 11 / 10.0).alias("normalized"), F.lit(None).cast("double").alias("value"))).otherwise(F.struct(F.lit(None).cast("double").alias("normalized"), ((F.col("n") + k) % (int(s) + 1)).cast("double").alias("value")))
    made = F.create_map(*[c for k, (name, s) in enumerate(scales) for c in (F.lit(name), entry(k, s))])
    return rounded(C.dimension_matrix(x.withColumn("d", made), "key", "d"), *C.SCALES)


RESULTS = f"{facts_sql('cycle')}, f AS (SELECT *, question_id % 3 AS category, question_id % 7 AS sub_category, 1 + question_id % 10 AS difficulty, CAST(is_correct AS INT) AS ok, min(cycle) OVER w AS lo, max(cycle) OVER w AS hi FROM facts WINDOW w AS (PARTITION BY method, seed))"
RUNS = f"""{RESULTS}, fin AS (SELECT method, seed, count(*) AS questions, avg(ok) AS final_accuracy FROM f WHERE cycle = hi GROUP BY ALL), s1 AS (SELECT method, seed, sub_category, avg(ok) AS a FROM f WHERE cycle = hi GROUP BY ALL), s2 AS (SELECT method, seed, avg(a) AS macro_accuracy, min(a) AS worst_subcategory_accuracy FROM s1 GROUP BY ALL),
  c1 AS (SELECT method, seed, cycle, avg(ok) AS a FROM f GROUP BY ALL), c2 AS (SELECT *, lead(cycle) OVER w AS nc, lead(a) OVER w AS na FROM c1 WINDOW w AS (PARTITION BY method, seed ORDER BY cycle)), c3 AS (SELECT method, seed, CASE WHEN count(*) = 1 THEN max(a) ELSE sum((a + na) / 2 * (nc - cycle)) / (max(cycle) - min(cycle)) END AS learning_curve_auc FROM c2 GROUP BY ALL),
  g1 AS (SELECT method, seed, question_id FROM f WHERE cycle = lo AND is_correct), g2 AS (SELECT method, seed, count_if(NOT coalesce(z.is_correct, false)) / count(*) AS forgetting_rate FROM g1 LEFT JOIN (SELECT * FROM f WHERE cycle = hi) z USING (method, seed, question_id) GROUP BY ALL),
  runs AS (SELECT * FROM fin JOIN s2 USING (method, seed) LEFT JOIN c3 USING (method, seed) LEFT JOIN g2 USING (method, seed))"""
R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


def dimension_sql(name: str) -> str:
    return f"SELECT method, '{name}' AS dimension, CAST({name} AS VARCHAR) AS value, count(*) AS n, round(avg(a), 6) AS mean, string_agg(seed, ',' ORDER BY seed) AS seeds FROM (SELECT method, seed, {name}, avg(ok) AS a FROM f WHERE cycle = hi GROUP BY ALL) GROUP BY ALL"


def metric_sql(query: str, *names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM ({STATS[query][1]})" for n in names)


LABELS = f"WITH {REVIEW}, g AS (SELECT one AS label, sum(weight) AS support, sum(CASE WHEN one = system THEN weight ELSE 0 END) AS hits FROM rv GROUP BY 1), s AS (SELECT system AS label, sum(weight) AS said FROM rv GROUP BY 1) SELECT label, hits / said AS p, hits / support AS r FROM g JOIN s USING (label)"
REVIEWED = f"""WITH all_metrics AS ({metric_sql('cohen_kappa', 'observed', 'expected', 'kappa')} UNION ALL SELECT 'f1:' || label, f1 FROM ({STATS['confusion_prf'][1]})
  UNION ALL SELECT 'macro_precision', avg(p) FROM ({LABELS}) UNION ALL SELECT 'macro_recall', avg(r) FROM ({LABELS}) UNION ALL SELECT 'macro_f1', avg(2 * p * r / (p + r)) FROM ({LABELS})
  UNION ALL {metric_sql('selective_metrics', 'accuracy', 'selective_coverage', 'selective_accuracy', 'evidence_coverage', 'brier', 'high_confidence_accuracy')})
  SELECT metric, round(value, 6) AS value FROM all_metrics UNION ALL SELECT 'gate:' || metric, CASE WHEN value >= CASE metric WHEN 'kappa' THEN 0.5 WHEN 'accuracy' THEN 0.6 ELSE 0.9 END THEN 1.0 ELSE 0.0 END FROM all_metrics WHERE metric IN ('kappa', 'accuracy', 'macro_f1')"""
EVIDENCE = f"WITH {POOL}, k AS (SELECT *, CAST(unique_key AS BIGINT) AS k FROM p WHERE grade = 'train_eligible')"

QUERIES = {
    "paper_run_summary": (run_summary, f"WITH {RUNS} SELECT method, seed, questions, {R('final_accuracy', *C.METRICS)} FROM runs"),
    "paper_main_results": (main_results, f"""WITH {RUNS}, m AS (SELECT method, count(*) AS n, avg(final_accuracy) AS mean, coalesce(stddev_samp(final_accuracy), 0.0) AS std, min(final_accuracy) AS minimum, max(final_accuracy) AS maximum, {', '.join(f'avg({x}) AS {x}_mean' for x in C.METRICS)} FROM runs GROUP BY method), b AS (SELECT mean AS base_mean_accuracy FROM m WHERE method = 'N'),
      j AS (SELECT *, mean - base_mean_accuracy AS mean_delta_vs_base FROM m LEFT JOIN b ON true) SELECT method, n, {R('mean', 'std', 'minimum', 'maximum', *[f'{x}_mean' for x in C.METRICS], 'base_mean_accuracy', 'mean_delta_vs_base')} FROM j"""),
    "paper_dimension_tables": (dimension_tables, f"WITH {RESULTS} {dimension_sql('category')} UNION ALL {dimension_sql('difficulty')}"),
    "paper_significance": (significance, None),
    "review_report": (review_report, REVIEWED),
    "calibration_report": (calibration_report, """WITH p AS (SELECT user_id % 12 AS model, event_type || '-' || (hour(ts) % 4) AS item, CAST(value > 50 AS INT) AS y FROM events), d AS (SELECT DISTINCT model, item FROM p), n AS (SELECT count(DISTINCT model) AS m, count(DISTINCT item) AS i FROM p),
      a AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM d GROUP BY model)), b AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM d GROUP BY item)),
      o AS (SELECT item, CAST('0x' || substr(md5(item), 1, 4) AS BIGINT) % 100 / 100.0 AS predicted, 1 - avg(y) AS observed FROM p GROUP BY item),
      r AS (SELECT rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS ra, rank() OVER (ORDER BY observed) + (count(*) OVER (PARTITION BY observed) - 1) / 2.0 AS rb FROM o)
      SELECT 'coverage' AS metric, round((SELECT count(*) FROM d) / (m * i), 6) AS value FROM n UNION ALL SELECT 'least_model_coverage', round(a.c / i, 6) FROM a, n UNION ALL SELECT 'least_item_coverage', round(b.c / m, 6) FROM b, n UNION ALL SELECT 'spearman', round(corr(ra, rb), 6) FROM r
      UNION ALL SELECT 'gap:' || CAST(least(4, floor(predicted * 5)) AS INT), round(avg(predicted) - avg(observed), 6) FROM o GROUP BY CAST(least(4, floor(predicted * 5)) AS INT)"""),
    "hard_pool_managed": (hard_pool_managed, f"""WITH {POOL}, o AS (SELECT unique_key, min(category) AS category, min(sub_category) AS sub_category, bool_and(ok) AS ok FROM t WHERE cycle = 1996 AND iteration = 5 GROUP BY unique_key), g AS (SELECT *, avg(CAST(ok AS INT)) OVER (PARTITION BY category, sub_category) AS acc FROM o),
      n AS (SELECT unique_key, category, sub_category, CASE WHEN acc < 0.1 THEN 'hard_unsuitable' WHEN acc <= 0.4 THEN 'train_eligible' ELSE 'easy_sample' END AS grade FROM g WHERE NOT ok)
      SELECT unique_key, coalesce(n.category, p.category) AS category, coalesce(n.sub_category, p.sub_category) AS sub_category, coalesce(n.grade, p.grade) AS grade, 'active' AS state, 0 AS streak, CASE WHEN n.grade IS NULL THEN p.last_seen_cycle ELSE 1996 END AS last_seen_cycle, CASE WHEN n.grade IS NULL THEN p.last_iteration ELSE 5 END AS last_iteration, coalesce(p.occurrences, 0) + CASE WHEN n.grade IS NULL THEN 0 ELSE 1 END AS occurrences FROM p FULL JOIN n USING (unique_key)"""),
    "variant_context": (variant_context, f"{EVIDENCE} SELECT category, sub_category, row_number() OVER (PARTITION BY category, sub_category ORDER BY k % 3 = 0 DESC, k % 10 DESC, last_seen_cycle DESC, last_iteration DESC, unique_key) AS place, unique_key FROM k QUALIFY place <= 12"),
    "history_context": (history_context, f"{EVIDENCE} SELECT sub_category, '- hard_sample_id: ' || substr(unique_key, 1, 16) || ' | difficulty: ' || CASE WHEN k % 4 <> 0 THEN 1 + k % 10 ELSE 5 END || ' | structural_pattern: ' || sub_category || ' problem | observed_failure: ' || CASE WHEN k % 2 = 0 THEN 'sign_error,unit_mismatch' ELSE 'concept_confusion' END || ' | variation_requirements: change values, wording, and structure' AS line, count(*) AS n FROM k GROUP BY ALL"),
    "matched_cap": (matched_cap, f"""WITH {facts_sql('cycle')}, s AS (SELECT method, question_id, cycle, CASE WHEN is_correct THEN 'correct_retention_samples' ELSE 'wrong_samples' END AS training_source, row_number() OVER (PARTITION BY is_correct ORDER BY question_id, method, cycle) AS n FROM facts WHERE seed = 1)
      SELECT method, question_id, cycle, training_source FROM s WHERE n <= CASE training_source WHEN 'correct_retention_samples' THEN 100 ELSE 300 END"""),
    "dimension_matrix": (dimension_matrix, "WITH x AS (SELECT conv_id || '-' || turn AS key, length(text) AS n FROM conversations) SELECT key, " + ", ".join(f"round(CASE WHEN n % 2 = 0 THEN (n + {k}) % 11 / 10.0 ELSE (n + {k}) % {int(s) + 1} / {s} END, 6) AS {name}" for k, (name, s) in enumerate(C.SCALES.items())) + " FROM x"),
}
