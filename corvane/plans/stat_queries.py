"""Studies, statistics, learning curves, agreement, splits, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..operators import agreement, calibration, split, stats, study, summary
from ..sources import readers
from .base import ITEMS, facts, facts_sql, items, table
from .policy_queries import EV, evaluated, rounded

PAIRS = [("A", "N"), ("A", "R"), ("N", "R")]


def pairs_of(spark, sf):
    return stats.paired(facts(spark, sf), ["seed"], "method", "question_id", "is_correct", PAIRS)


def final_cycle(spark, sf):
    x = stats.final_rows(facts(spark, sf, "cycle"), ["method", "seed"], "cycle")
    return rounded(summary.accuracy_rows(x, ["method", "seed", "cycle"]), "accuracy")


def curve(spark, sf):
    x = summary.accuracy_rows(facts(spark, sf, "cycle"), ["method", "seed", "cycle"])
    return rounded(stats.curve_area(x, ["method", "seed"], "cycle", "accuracy"), "auc")


def forgetting(spark, sf):
    return rounded(stats.forgetting(facts(spark, sf, "cycle"), ["method", "seed"], "question_id", "cycle", "is_correct"), "forgetting_rate")


def retention(spark, sf):
    x = facts(spark, sf, "cycle")
    y = x.where("method = 'A' AND seed = 1")
    b, a = y.where("cycle = 1995"), y.where("cycle = 1996")
    got = study.retention(b.withColumn("dim", F.pmod("question_id", F.lit(5)).cast("int")), a, "question_id", "is_correct", "dim")
    return rounded(got, "rate", "ci_low", "ci_high")


def seed_summary(spark, sf):
    by = summary.accuracy_rows(facts(spark, sf), ["method", "seed"])
    return rounded(stats.summarize(by, ["method"], "accuracy"), "mean", "std", "minimum", "maximum", "ci_low", "ci_high")


def across_seeds(spark, sf):
    x = stats.two_level(facts(spark, sf), ["method"], "seed", "is_correct")
    return rounded(x, "mean", "std", "minimum", "maximum", "ci_low", "ci_high").select("method", "n", "mean", "seeds", "questions")


def delta(spark, sf):
    by = summary.accuracy_rows(facts(spark, sf), ["method", "seed"])
    return rounded(stats.delta_to_base(by, ["seed"], "method", "N", "accuracy"), "accuracy", "base_value", "delta")


def mcnemar_counts(spark, sf):
    x = stats.mcnemar(pairs_of(spark, sf), ["seed", "left_method", "right_method"])
    return rounded(x.drop("p_value"), "risk_difference", "odds_ratio")


def mcnemar_exact(spark, sf):
    x = stats.mcnemar(pairs_of(spark, sf), ["seed", "left_method", "right_method"])
    return rounded(x.select("seed", "left_method", "right_method", "p_value"), "p_value")


def fisher(spark, sf):
    x = stats.mcnemar(pairs_of(spark, sf), ["seed", "left_method", "right_method"])
    return rounded(stats.fisher(x, ["left_method", "right_method"], "p_value"), "combined_p")


def holm(spark, sf):
    x = stats.mcnemar(pairs_of(spark, sf), ["seed", "left_method", "right_method"]).select("seed", "left_method", "right_method", "p_value")
    return rounded(stats.holm(x, "p_value", ["seed", "left_method", "right_method"]), "p_value", "holm_p")


def bootstrap(spark, sf):
    return stats.paired_bootstrap(pairs_of(spark, sf), ["left_method", "right_method"], "question_id")


def cluster_bootstrap(spark, sf):
    return stats.cluster_bootstrap(pairs_of(spark, sf), ["left_method", "right_method"], "seed", 500)


def reviews(spark, sf):
    """Two reviewers' labels of items, and a system's, made from the labels and hashes of ids."""
    x = evaluated(spark, sf)
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 4), 16, 10).cast("int")
    names = F.array(F.lit("sign_error"), F.lit("rounding_error"), F.lit("unit_mismatch"))
    return x.select("id", "is_correct", "confidence", F.get(names, h % 3).alias("one"), F.get(names, F.when(h % 5 == 0, (h + 1) % 3).otherwise(h % 3)).alias("two"), F.get(names, F.when(h % 7 == 0, (h + 2) % 3).otherwise(h % 3)).alias("system"), (1 + h % 4).cast("double").alias("weight"), (h % 6 == 0).alias("review"), (h % 3 != 0).alias("evidence"))


def kappa(spark, sf):
    return rounded(agreement.cohen_kappa(reviews(spark, sf), "one", "two", "weight"), "observed", "expected", "kappa")


def confusion(spark, sf):
    return rounded(agreement.label_scores(reviews(spark, sf), "one", "system", "weight"), "precision", "recall", "f1")


def selective(spark, sf):
    x = agreement.selective(reviews(spark, sf), "is_correct", "confidence", "review", "evidence", "weight")
    x = agreement.gates(x, {"accuracy": 0.6, "selective_coverage": 0.9, "evidence_coverage": 0.5})
    return rounded(x, "accuracy", "selective_coverage", "selective_accuracy", "evidence_coverage", "brier", "high_confidence_accuracy")


def round_robin(spark, sf):
    x = split.round_robin(items(spark, sf), ["category", "difficulty"], split.stable_rank(42, F.col("id")), 100)
    return rounded(x.select("id", "category", "difficulty", "selection_probability"), "selection_probability")


def blind_selection(spark, sf):
    return split.first_per_bucket(items(spark, sf), ["category", "sub_category"], 2, split.stable_rank(7, F.col("id"))).select("id")


def cluster_split(spark, sf):
    from ..functions import text as T

    x = items(spark, sf).withColumn("cluster", F.sha2(T.template(F.col("question")), 256))
    y = split.cluster_split(x, "cluster", ["category", "is_correct"])
    return y.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))


def split_manifest(spark, sf):
    x = items(spark, sf).withColumn("split", F.when(split.fold(F.col("id"), 10) < 8, "train").otherwise("rest"))
    return split.split_manifest(x, ["category", "difficulty"])


def token_budget(spark, sf):
    from ..functions.text import estimated_tokens

    x = items(spark, sf).withColumn("tokens", estimated_tokens(F.col("question")))
    y = split.token_budget(x.select("id", "category", "difficulty", "tokens"), ["category", "difficulty"], split.stable_rank(1, F.col("id")), "tokens", 20_000)
    return y.select("id", "tokens")


def ratio_train(spark, sf):
    y = split.ratio_train(evaluated(spark, sf), "is_correct", F.col("id"), 0.25)
    return y.groupBy("is_correct").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def folds(spark, sf):
    return items(spark, sf).groupBy(split.fold(F.col("id"), 5).alias("fold")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def spearman(spark, sf):
    x = table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 50).alias("b"))
    return rounded(stats.spearman(x, "a", "b", ["o_orderpriority"]), "spearman")


def bins(spark, sf):
    return rounded(calibration.calibration_bins(evaluated(spark, sf), "confidence", "is_correct"), "mean_predicted", "mean_observed", digits=9)


def panel(spark, sf):
    return table(spark, sf, "events").select(F.pmod("user_id", F.lit(12)).alias("model"), F.concat_ws("-", "event_type", F.pmod(F.hour("ts"), F.lit(4)).cast("string")).alias("item"), F.lit(1).alias("panel"), (F.col("value") > 50).alias("y"))


def irt(spark, sf):
    return calibration.irt(panel(spark, sf), "panel", "model", "item", "y")


def panel_quality(spark, sf):
    p = panel(spark, sf)
    x = calibration.panel_quality(p, p, p, "model", "item", "y")
    return rounded(x, "coverage", "least_model_coverage", "least_item_coverage")


def schedule(spark, sf):
    s = calibration.panel_schedule(table(spark, sf, "benchmark"), table(spark, sf, "region"), "item_id", "r_name")
    return s.groupBy("r_name").agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"))


def simplex(spark, sf):
    x = evaluated(spark, sf).select((F.col("difficulty") / 10).alias("a"), "confidence", F.lit(1.0).alias("one"), F.col("is_correct").cast("double").alias("y"))
    w = calibration.simplex_weights(x, ["a", "confidence", "one"], "y")
    return spark.createDataFrame(list(w.items()), "feature string, weight double")


def matrix(spark, sf):
    x = study.matrix(spark, method=["base", "uniform", "full"], seed=[1, 2, 3], model=["m"], budget=[450, 1350])
    return x.select("method", "seed", "model", "budget", "study_id")


def fairness(spark, sf):
    x = facts(spark, sf).groupBy("method", "seed").agg(F.count("*").alias("questions"))
    return study.same_in_cell(x, ["seed"], ["questions"]).select("seed", F.col("questions").alias("sizes"))


def seed_sets(spark, sf):
    return study.seed_sets(facts(spark, sf), ["method"], "seed")


def regrade(spark, sf):
    x = evaluated(spark, sf).withColumn("new", (F.col("id") % 3 == 0) | F.col("is_correct"))
    return study.regrade(x, "id", "is_correct", "new").select("transition", "n", F.size("ids").cast("long").alias("ids"), F.element_at("ids", 1).alias("first_id"))


def stage_cycles(spark, sf):
    x = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "baseline").when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("cycle_"), (F.col("o_orderkey") % 9).cast("string"))).otherwise("notes").alias("stage"))
    return x.groupBy(readers.stage_cycle(F.col("stage")).alias("cycle")).agg(F.count("*").alias("n"))


def group_diversity(spark, sf):
    from ..operators import audit

    x = items(spark, sf).withColumn("length_band", F.floor(F.length("question") / 1000))
    return audit.group_diversity(x, ["category"], {"difficulties": "difficulty", "sources": "sub_category", "bands": "length_band"})


def sigmoid_bins(spark, sf):
    x = evaluated(spark, sf).withColumn("p", sigmoid(F.col("difficulty") - 5.0))
    return rounded(x.groupBy("difficulty").agg(F.max("p").alias("p"), F.avg(F.col("is_correct").cast("double")).alias("accuracy")), "p", "accuracy")


BY_SEED = f"{facts_sql()}, s AS (SELECT method, seed, count(*) AS questions, avg(CAST(is_correct AS INT)) AS accuracy FROM facts GROUP BY ALL)"
T6 = 2.447  # 97.5 % quantile at 6 degrees of freedom
PAIRED = f"{facts_sql()}, w(l, r) AS (VALUES ('A', 'N'), ('A', 'R'), ('N', 'R')), pr AS (SELECT a.seed, l AS left_method, r AS right_method, a.question_id, a.is_correct AS lc, b.is_correct AS rc FROM w JOIN facts a ON a.method = l JOIN facts b ON b.method = r AND b.seed = a.seed AND b.question_id = a.question_id), mc AS (SELECT seed, left_method, right_method, count(*) AS n, CAST(count_if(lc AND NOT rc) AS BIGINT) AS left_only, CAST(count_if(rc AND NOT lc) AS BIGINT) AS right_only FROM pr GROUP BY ALL)"
P = "pv AS (SELECT seed, left_method, right_method, CASE WHEN left_only + right_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(left_only, right_only) + 1), lambda i: exp(lgamma(left_only + right_only + 1) - lgamma(i + 1) - lgamma(left_only + right_only - i + 1) - (left_only + right_only) * ln(2))))) END AS p FROM mc)"
HASH = "CAST('0x' || substr(md5(id::VARCHAR), 1, 4) AS INT)"
REVIEW = f"{EV}, hs AS (SELECT *, {HASH} AS h, ['sign_error', 'rounding_error', 'unit_mismatch'] AS nm FROM ev), rv AS (SELECT id, is_correct, confidence, nm[h % 3 + 1] AS one, nm[CASE WHEN h % 5 = 0 THEN (h + 1) % 3 ELSE h % 3 END + 1] AS two, nm[CASE WHEN h % 7 = 0 THEN (h + 2) % 3 ELSE h % 3 END + 1] AS system, CAST(1 + h % 4 AS DOUBLE) AS weight, h % 6 = 0 AS review, h % 3 <> 0 AS evidence FROM hs)"
FOLD = "CAST('0x' || substr(sha256('\"' || id::VARCHAR || '\"'), 1, 8) AS BIGINT) % {k}"

QUERIES = {
    "final_cycle_rows": (final_cycle, f"WITH {facts_sql('cycle')}, m AS (SELECT *, max(cycle) OVER (PARTITION BY method, seed) AS mx FROM facts) SELECT method, seed, cycle, count(*) AS n, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM m WHERE cycle = mx GROUP BY ALL"),
    "learning_curve_auc": (curve, f"WITH {facts_sql('cycle')}, a AS (SELECT method, seed, cycle, avg(CAST(is_correct AS INT)) AS v FROM facts GROUP BY ALL), l AS (SELECT *, lag(v) OVER w AS pv, lag(cycle) OVER w AS pc FROM a WINDOW w AS (PARTITION BY method, seed ORDER BY cycle)) SELECT method, seed, round(CASE WHEN max(cycle) > min(cycle) THEN sum((v + pv) / 2 * (cycle - pc)) / (max(cycle) - min(cycle)) ELSE max(v) END, 6) AS auc FROM l GROUP BY ALL"),
    "forgetting_rate": (forgetting, f"WITH {facts_sql('cycle')}, m AS (SELECT *, min(cycle) OVER w AS lo, max(cycle) OVER w AS hi FROM facts WINDOW w AS (PARTITION BY method, seed)), b AS (SELECT method, seed, question_id FROM m WHERE cycle = lo AND is_correct), a AS (SELECT method, seed, question_id, is_correct AS ok FROM m WHERE cycle = hi) SELECT method, seed, count(*) AS known_before, count_if(NOT coalesce(ok, false)) AS forgotten, round(count_if(NOT coalesce(ok, false)) / count(*), 6) AS forgetting_rate FROM b LEFT JOIN a USING (method, seed, question_id) GROUP BY ALL"),
    "retention_wilson": (retention, f"""WITH {facts_sql('cycle')}, y AS (SELECT * FROM facts WHERE method = 'A' AND seed = 1), x AS (SELECT CAST(b.question_id % 5 AS INT) AS dim, b.is_correct AS bc, a.is_correct AS ac FROM (SELECT * FROM y WHERE cycle = 1995) b LEFT JOIN (SELECT * FROM y WHERE cycle = 1996) a USING (question_id)),
      g AS (SELECT dim, count_if(bc AND ac IS NOT NULL) AS known, count_if(bc AND NOT ac) AS forgotten, count_if(NOT bc AND ac) AS gained, count_if(ac IS NULL) AS unknown FROM x GROUP BY dim), z AS (SELECT *, 1.959963984540054::DOUBLE AS z, forgotten / nullif(known, 0) AS p FROM g)
      SELECT dim, known, forgotten, gained, unknown, round(p, 6) AS rate, round(CASE WHEN known > 0 THEN greatest(0.0, (p + z * z / (2 * known)) / (1 + z * z / known) - z * sqrt(p * (1 - p) / known + z * z / (4 * known * known)) / (1 + z * z / known)) END, 6) AS ci_low, round(CASE WHEN known > 0 THEN least(1.0, (p + z * z / (2 * known)) / (1 + z * z / known) + z * sqrt(p * (1 - p) / known + z * z / (4 * known * known)) / (1 + z * z / known)) END, 6) AS ci_high FROM z"""),
    "seed_summary_tci": (seed_summary, f"WITH {BY_SEED}, q AS (SELECT method, count(*) AS n, avg(accuracy) AS mean, stddev_samp(accuracy) AS std, min(accuracy) AS minimum, max(accuracy) AS maximum FROM s GROUP BY method) SELECT method, n, round(mean, 6) AS mean, round(std, 6) AS std, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(mean - {T6} * std / sqrt(n), 6) AS ci_low, round(mean + {T6} * std / sqrt(n), 6) AS ci_high FROM q"),
    "across_seed_table": (across_seeds, f"WITH {BY_SEED} SELECT method, count(*) AS n, round(avg(accuracy), 6) AS mean, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds, min(questions) AS questions FROM s GROUP BY method"),
    "delta_vs_base": (delta, f"WITH {BY_SEED} SELECT s.seed, s.method, s.questions AS n, round(s.accuracy, 6) AS accuracy, round(b.accuracy, 6) AS base_value, round(s.accuracy - b.accuracy, 6) AS delta FROM s LEFT JOIN s b ON b.seed = s.seed AND b.method = 'N'"),
    "mcnemar_counts": (mcnemar_counts, f"WITH {PAIRED} SELECT *, round((right_only - left_only) / n, 6) AS risk_difference, round((right_only + 0.5) / (left_only + 0.5), 6) AS odds_ratio FROM mc"),
    "mcnemar_exact": (mcnemar_exact, f"WITH {PAIRED}, {P} SELECT seed, left_method, right_method, round(p, 6) AS p_value FROM pv"),
    "fisher_combine": (fisher, f"WITH {PAIRED}, {P}, h AS (SELECT left_method, right_method, CAST(count(*) AS INT) AS k, -sum(ln(greatest(p, 1e-300))) AS h FROM pv GROUP BY ALL) SELECT left_method, right_method, k, round(CASE WHEN h <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, k), lambda i: exp(i * ln(h) - h - lgamma(i + 1))))) END, 6) AS combined_p FROM h"),
    "holm": (holm, f"WITH {PAIRED}, {P}, s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, seed, left_method, right_method) + 1) * p) AS st FROM pv) SELECT seed, left_method, right_method, round(p, 6) AS p_value, round(max(st) OVER (ORDER BY p, seed, left_method, right_method ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM s"),
    "paired_bootstrap": (bootstrap, None),
    "cluster_bootstrap": (cluster_bootstrap, None),
    "cohen_kappa": (kappa, f"WITH {REVIEW}, t AS (SELECT count(*) AS n, sum(weight) AS w, sum(CASE WHEN one = two THEN weight ELSE 0 END) AS same FROM rv), a AS (SELECT one AS l, sum(weight) AS a FROM rv GROUP BY 1), b AS (SELECT two AS l, sum(weight) AS b FROM rv GROUP BY 1), c AS (SELECT sum(a * b) AS c FROM a JOIN b USING (l)) SELECT n, round(same / w, 6) AS observed, round(c / (w * w), 6) AS expected, round((same / w - c / (w * w)) / (1 - c / (w * w)), 6) AS kappa FROM t, c"),
    "confusion_prf": (confusion, f"WITH {REVIEW}, g AS (SELECT one AS label, sum(weight) AS support, sum(CASE WHEN one = system THEN weight ELSE 0 END) AS hits FROM rv GROUP BY 1), s AS (SELECT system AS label, sum(weight) AS said FROM rv GROUP BY 1) SELECT label, support, round(hits / said, 6) AS precision, round(hits / support, 6) AS recall, round(2 * (hits / said) * (hits / support) / (hits / said + hits / support), 6) AS f1 FROM g JOIN s USING (label)"),
    "selective_metrics": (selective, f"""WITH {REVIEW}, c AS (SELECT *, CAST(is_correct AS INT) AS ok FROM rv), m AS (SELECT count(*) AS n, sum(weight * ok) / sum(weight) AS accuracy, sum(CASE WHEN NOT review THEN weight ELSE 0 END) / sum(weight) AS selective_coverage, sum(CASE WHEN NOT review THEN weight * ok ELSE 0 END) / sum(CASE WHEN NOT review THEN weight ELSE 0 END) AS selective_accuracy,
      sum(CASE WHEN evidence THEN weight ELSE 0 END) / sum(weight) AS evidence_coverage, sum(weight * (confidence - ok) * (confidence - ok)) / sum(weight) AS brier, sum(CASE WHEN confidence >= 0.8 THEN weight * ok ELSE 0 END) / sum(CASE WHEN confidence >= 0.8 THEN weight ELSE 0 END) AS high_confidence_accuracy FROM c)
      SELECT n, round(accuracy, 6) AS accuracy, round(selective_coverage, 6) AS selective_coverage, round(selective_accuracy, 6) AS selective_accuracy, round(evidence_coverage, 6) AS evidence_coverage, round(brier, 6) AS brier, round(high_confidence_accuracy, 6) AS high_confidence_accuracy, accuracy >= 0.6 AS accuracy_ok, selective_coverage >= 0.9 AS selective_coverage_ok, evidence_coverage >= 0.5 AS evidence_coverage_ok, accuracy >= 0.6 AND selective_coverage >= 0.9 AND evidence_coverage >= 0.5 AS accepted FROM m"""),
    "round_robin_sample": (round_robin, f"WITH {ITEMS}, t AS (SELECT id, category, difficulty, row_number() OVER (PARTITION BY category, difficulty ORDER BY sha256('42|' || id)) AS turn, count(*) OVER (PARTITION BY category, difficulty) AS size FROM items), c AS (SELECT * FROM t ORDER BY turn, size, category, difficulty LIMIT 100) SELECT id, category, difficulty, round(count(*) OVER (PARTITION BY category, difficulty) / size, 6) AS selection_probability FROM c"),
    "blind_selection": (blind_selection, f"WITH {ITEMS} SELECT id FROM items QUALIFY row_number() OVER (PARTITION BY category, sub_category ORDER BY sha256('7|' || id)) <= 2"),
    "cluster_split": (cluster_split, None),
    "split_manifest": (split_manifest, f"WITH {ITEMS}, s AS (SELECT *, CASE WHEN {FOLD.format(k=10)} < 8 THEN 'train' ELSE 'rest' END AS split FROM items) SELECT split, 'category' AS dimension, category AS value, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT split, 'difficulty', difficulty::VARCHAR, count(*) FROM s GROUP BY ALL"),
    "token_budget_select": (token_budget, None),
    "ratio_train": (ratio_train, f"WITH {EV}, n AS (SELECT least(count_if(is_correct), count_if(NOT is_correct) // 3) AS b FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY is_correct ORDER BY id) AS k FROM ev) SELECT is_correct, count(*) AS n, max(id) AS last FROM r, n WHERE k <= CASE WHEN is_correct THEN b ELSE 3 * b END GROUP BY is_correct"),
    "hash_folds": (folds, f"WITH {ITEMS} SELECT CAST({FOLD.format(k=5)} AS INT) AS fold, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM items GROUP BY 1"),
    "spearman": (spearman, "WITH x AS (SELECT o_orderpriority, o_totalprice AS a, o_custkey % 50 AS b FROM orders), r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY a) + (count(*) OVER (PARTITION BY o_orderpriority, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY o_orderpriority ORDER BY b) + (count(*) OVER (PARTITION BY o_orderpriority, b) - 1) / 2.0 AS rb FROM x) SELECT o_orderpriority, count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY o_orderpriority"),
    "calibration_bins": (bins, f"WITH {EV}, b(low, high) AS (VALUES (0.0::DOUBLE, 0.2::DOUBLE), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.01)) SELECT low, high, count(confidence) AS n, round(avg(confidence), 9) AS mean_predicted, round(avg(CAST(is_correct AS INT)), 9) AS mean_observed FROM b LEFT JOIN ev ON confidence >= low AND confidence < high GROUP BY ALL"),
    "irt_1pl": (irt, None),
    "panel_quality": (panel_quality, "WITH p AS (SELECT DISTINCT user_id % 12 AS model, event_type || '-' || (hour(ts) % 4) AS item FROM events), n AS (SELECT count(DISTINCT model) AS m, count(DISTINCT item) AS i FROM p), a AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM p GROUP BY model)), b AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM p GROUP BY item)) SELECT round((SELECT count(*) FROM p) / (m * i), 6) AS coverage, round(a.c / i, 6) AS least_model_coverage, round(b.c / m, 6) AS least_item_coverage FROM n, a, b"),
    "panel_schedule": (schedule, "SELECT r_name, count(*) AS n, CAST(sum(item_id) AS BIGINT) AS ids FROM benchmark, region GROUP BY r_name"),
    "simplex_weights": (simplex, None),
    "study_matrix": (matrix, "SELECT method, seed, model, budget, substr(sha256(method || '|' || seed || '|' || model || '|' || budget), 1, 16) AS study_id FROM (VALUES ('base'), ('uniform'), ('full')) a(method), (VALUES (1), (2), (3)) b(seed), (VALUES ('m')) c(model), (VALUES (450), (1350)) d(budget)"),
    "fairness_checks": (fairness, f"WITH {BY_SEED} SELECT seed, count(DISTINCT questions) AS sizes FROM s GROUP BY seed HAVING count(DISTINCT questions) > 1"),
    "seed_sets": (seed_sets, f"WITH {BY_SEED} SELECT method, string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds FROM s GROUP BY method"),
    "regrade_transitions": (regrade, f"WITH {EV}, x AS (SELECT id, is_correct AS o, id % 3 = 0 OR is_correct AS n FROM ev) SELECT CASE WHEN o AND n THEN 'still_correct' WHEN o THEN 'became_incorrect' WHEN n THEN 'became_correct' ELSE 'still_incorrect' END AS transition, count(*) AS n, count(*) AS ids, min(id) AS first_id FROM x GROUP BY 1"),
    "stage_cycles": (stage_cycles, "SELECT CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN o_orderkey % 9 ELSE -1 END AS INT) AS cycle, count(*) AS n FROM orders GROUP BY 1"),
    "group_diversity": (group_diversity, f"WITH {ITEMS} SELECT category, count(*) AS n, count(DISTINCT difficulty) AS difficulties, count(DISTINCT sub_category) AS sources, count(DISTINCT length(question) // 1000) AS bands FROM items GROUP BY category"),
    "sigmoid_curve": (sigmoid_bins, f"WITH {EV} SELECT difficulty, round(1 / (1 + exp(-(difficulty - 5.0::DOUBLE))), 6) AS p, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM ev GROUP BY difficulty"),
}
