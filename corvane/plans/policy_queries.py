"""Rejection, mixes, coverage, posteriors, apportionment, policies, difficulty and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import difficulty as D
from ..functions.numeric import history_weight
from ..operators import allocate, coverage, curation, summary
from ..operators.common import cut
from ..operators.equivalence import with_symbolic
from .base import ITEMS, items, table


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def evaluated(spark, sf):
    return items(spark, sf).where("is_correct IS NOT NULL")


def rejection_reasons(spark, sf):
    x = items(spark, sf).withColumn("evaluator_confidence", F.col("confidence"))
    x = x.withColumn("reasons", curation.rejection_reasons(x.columns, 0.2))
    return summary.reason_counts(x, "reasons")


def candidate_mix(spark, sf):
    x = summary.group_accuracy(items(spark, sf), ["category", "sub_category"])
    source = D.candidate_source(F.col("question").rlike(r"^\s*$"), F.col("is_correct"), F.col("group_accuracy"), D.sample_grade(F.col("group_accuracy")))
    return x.withColumn("training_source", source).groupBy("training_source").agg(F.count("*").alias("n"))


def quality(spark, sf):
    x = summary.group_accuracy(items(spark, sf), ["category", "sub_category"])
    return x.select("id", F.round(D.quality_score(F.col("confidence"), F.col("group_accuracy"), F.length("question")), 6).alias("quality"), D.sample_grade(F.col("group_accuracy")).alias("grade"))


def compare_summary(spark, sf):
    x = summary.accuracy_sets(evaluated(spark, sf), [["category", "sub_category"], ["difficulty"], []])
    return rounded(x, "accuracy")


def benchmark_summary(spark, sf):
    x = evaluated(spark, sf)
    return x.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.count_if(F.col("tool_violation")).alias("violations"), F.count_if(F.col("is_correct") & F.col("tool_violation")).alias("correct_violations"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.round(F.avg(F.abs(F.col("confidence") - F.col("is_correct").cast("double"))), 9).alias("mean_gap"), F.countDistinct("category", "sub_category").alias("groups"))


def weakest(spark, sf):
    return rounded(summary.weakest(items(spark, sf), ["category", "sub_category"], 10), "accuracy")


def dimension(spark, sf):
    """The (lang, source) groups as a taxonomy."""
    return table(spark, sf, "documents").select(F.col("lang").alias("category"), F.col("source").alias("sub_category")).distinct().withColumns({"quota": F.lit(8), "base_weight": F.lit(1.0)})


def coverage_metrics(spark, sf):
    x = coverage.coverage_metrics(evaluated(spark, sf), dimension(spark, sf), ["category", "sub_category"], "quota")
    return rounded(x, "raw_coverage", "effective_coverage", "normalized_entropy", "js_divergence", "coefficient_of_variation", "max_min_ratio")


def posterior(spark, sf):
    x = coverage.beta_posterior(evaluated(spark, sf), ["category", "difficulty"], F.col("is_correct"), F.lit(1.0))
    return rounded(x, "posterior_mean", "posterior_variance")


def decayed(spark, sf):
    x = coverage.beta_posterior(evaluated(spark, sf), ["category", "sub_category"], F.col("is_correct"), history_weight(F.col("cycle"), F.lit(3), "time_decay"))
    return rounded(x, "alpha", "beta", "weight", "posterior_mean", "posterior_variance")


def error_posterior(spark, sf):
    x = coverage.error_weights(evaluated(spark, sf).where("cycle < 2"), dimension(spark, sf).select("category", "sub_category"), ["category", "sub_category"], F.col("is_correct"), F.lit(1.0))
    return rounded(x, "posterior_mean", "error_weight")


def round_band(spark, sf):
    x = evaluated(spark, sf).groupBy("cycle").agg(F.count("*").alias("rows"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"))
    return x.select("cycle", "rows", F.round("accuracy", 6).alias("accuracy"), D.global_step(F.col("accuracy"), F.col("rows")).alias("step"))


def remainder(spark, sf):
    x = table(spark, sf, "documents").groupBy("lang", "source").agg(F.sum("n_chars").cast("double").alias("w"))
    return allocate.largest_remainder(x, 1000, "w", ["lang", "source"]).select("lang", "source", "allocated")


def chunks(spark, sf):
    x = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return allocate.chunked(x, "n", 7).select("lang", "source", "chunk", "chunk_count")


def uniform_policy(spark, sf):
    return allocate.uniform_plan(dimension(spark, sf), 1000, ["category", "sub_category"], 5).drop("generation_source")


def state(spark, sf):
    keys = ["category", "sub_category"]
    g = dimension(spark, sf)
    post = coverage.beta_posterior(evaluated(spark, sf), keys, F.col("is_correct"), F.lit(1.0)).drop("alpha", "beta")
    last = coverage.latest(evaluated(spark, sf), keys, "difficulty", "id")
    x = g.join(post, keys, "left").join(last, keys, "left")
    return x.na.fill({"posterior_mean": 0.5, "posterior_variance": 1 / 12, "weight": 0.0, "raw_count": 0, "difficulty": 4})


def error_policy(spark, sf):
    w = state(spark, sf).withColumn("error_weight", 1.05 - F.col("posterior_mean"))
    return allocate.error_plan(w, 1000, ["category", "sub_category"]).drop("generation_source")


def full_policy(spark, sf):
    e = evaluated(spark, sf)
    r = e.agg(F.avg(F.col("is_correct").cast("double")).alias("a"), F.count("*").alias("n")).first()
    pool = e.where("NOT is_correct").select("category", "sub_category")
    return rounded(allocate.adaptive_plan(state(spark, sf), 1000, ["category", "sub_category"], r["a"], r["n"], pool), "priority_score")


def plan_status(spark, sf):
    p = allocate.uniform_plan(dimension(spark, sf), 1000, ["category", "sub_category"], 50)
    return allocate.plan_status(p, items(spark, sf), ["category", "sub_category"])


def difficulty_profile(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", D.profile(F.col("text")).alias("p"))
    return x.select("conv_id", "turn", *[F.col(f"p.{k}") for k in ("reasoning_steps", "operation_count", "constraint_count", "symbolic_depth", "representation_load", "score", "band")])


def answer_pairs(spark, sf):
    x = table(spark, sf, "lineitem")
    q, p = F.col("l_quantity"), F.round("l_extendedprice", 2)
    wrong = F.col("l_linenumber") % 7
    pred = F.when(wrong == 1, -p).when(wrong == 2, p * 100).when(wrong == 3, p + 1).when(wrong == 4, p * 1.005).when(wrong == 5, p + q * 1000).otherwise(p)
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", p.alias("gold"), pred.alias("predicted"))


def error_signatures(spark, sf):
    return answer_pairs(spark, sf).groupBy("l_linenumber", A.error_signature(F.col("gold"), F.col("predicted")).alias("tag")).agg(F.count("*").alias("n"))


def numeric_equivalence(spark, sf):
    x = table(spark, sf, "lineitem").select("l_linenumber", F.format_string("%.2f", "l_discount").alias("gold"), F.concat(F.format_string("%.0f", F.col("l_discount") * 100), F.lit("%")).alias("percent"), F.concat(F.format_string("%.0f", F.col("l_discount") * 100), F.lit("/100")).alias("fraction"), F.format_string("%.2f", F.col("l_tax")).alias("other"))
    x = x.groupBy(*x.columns).agg(F.count("*").alias("rows"))  # each different row is parsed once
    same = lambda c, kind: F.sum(F.when(A.equivalent(F.col("gold"), F.col(c), F.lit(kind))["equivalent"], F.col("rows")).otherwise(0))
    return x.groupBy("l_linenumber").agg(F.sum("rows").alias("n"), same("percent", "percentage").alias("as_percent"), same("fraction", "rational").alias("as_fraction"), same("other", "decimal").alias("as_tax"))


def judge_fusion(spark, sf):
    x = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    typed = F.element_at(F.array(F.lit("equal"), F.lit("different"), F.lit("ambiguous")), (k % 3 + 1).cast("int"))
    v = A.fused_verdict(typed, k % 2 == 0, k % 5 != 0, k % 7 == 0, k % 11 != 0, (k % 100) / 100)
    return x.select(typed.alias("typed"), v["decision"].alias("decision"), v["is_correct"].alias("is_correct")).groupBy("typed", "decision", "is_correct").agg(F.count("*").alias("n"))


def response_parse(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    body = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("final_answer"), F.lit("0.75").alias("confidence")))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Final answer: "), F.col("conv_id").cast("string"))).otherwise(F.lit("no answer here"))
    p = A.parsed_response(body)
    return c.select("conv_id", "turn", p["status"].alias("status"), p["confidence"].alias("confidence"), F.length(p["final_answer"]).alias("answer_length"))


def typed_answers(spark, sf):
    """Answers of many types made of the numbers of line items: kind, gold, predicted and how many line items show them."""
    x = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("a"), F.col("l_quantity").cast("long").alias("b"), F.round(F.col("l_discount") * 100).cast("long").alias("c"))
    x = x.groupBy("a", "b", "c").agg(F.count("*").alias("rows"))
    even = F.col("c") % 2 == 0
    f = F.format_string
    made = {
        "set": (f("{%d, %d}", "a", "b"), F.when(even, f("{%d,%d}", "b", "a")).otherwise(f("{%d, %d}", "b", "c"))),
        "ordered_tuple": (f("(%d, %d)", "a", "b"), f("(%d,%d)", "b", "a")),
        "unit_value": (f("%d meters", "a"), F.when(even, f("%d m", "b")).otherwise(f("%d cm", "b"))),
        "integer": (f("%d,000", "a"), f("%d000", "b")),
        "rational": (f("%d/%d", "a", "b"), F.when(even, f("%d/%d", F.col("a") * 2, F.col("b") * 2)).otherwise(f("%d/%d", "b", "a"))),
        "interval": (f("[%d, %d)", "a", F.col("a") + F.col("b")), F.when(even, f("[%d,%d)", "a", F.col("a") + F.col("b"))).otherwise(f("[%d,%d]", "a", F.col("a") + F.col("b")))),
        "matrix": (f("[[%d,%d],[%d,%d]]", "a", "b", "c", "a"), f("%d,%d;%d,%d", "a", "b", "c", "b")),
        "multiple_choice": (F.lit("B"), F.when(even, "b").otherwise("c")),
        "symbolic_expression": (f("x^2 - %d", "b"), f("(x-%d)(x+%d)", "a", "a")),
    }
    rows = [F.struct(F.lit(kind).alias("kind"), gold.alias("gold"), predicted.alias("predicted")) for kind, (gold, predicted) in made.items()]
    return x.select("rows", F.explode(F.array(*rows)).alias("p")).select("p.*", "rows").groupBy("kind", "gold", "predicted").agg(F.sum("rows").alias("rows"))


def answer_equivalence(spark, sf):
    x = typed_answers(spark, sf)
    g, p, k = F.col("gold"), F.col("predicted"), F.col("kind")
    x = x.withColumn("status", with_symbolic(A.equivalent(g, p, k)["status"], g, p, k))
    return x.groupBy("kind", "status").agg(F.sum("rows").alias("n"))


def training_set(spark, sf):
    """The mix of the curated training set: how many rows of each source, and their quality."""
    y = curation.select_mix(curated(items(spark, sf), table(spark, sf, "benchmark")), "training_source", "quality", "exact_signature", 0.25)
    return y.groupBy("training_source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))


def curated(graded, holdout):
    """Graded items without rejected, leaked and nearly leaked rows, exact and near duplicates and repeated templates."""
    from ..functions import text as T

    x = summary.group_accuracy(graded, ["category", "sub_category"])
    x = x.withColumn("reasons", curation.rejection_reasons(["question", "gold_answer", "tool_violation", "is_correct"])).where(F.size("reasons") == 0)
    x = cut(x.join(curation.exact_leaks(x, "id", holdout, "item_id").select("id"), "id", "left_anti"))
    x = x.join(curation.near_leaks(x, "id", holdout, "item_id").select("id"), "id", "left_anti")
    x = x.withColumns({"quality": D.quality_score(F.col("confidence"), F.col("group_accuracy"), F.length("question")), "exact_signature": T.exact_signature(F.col("question"), F.col("gold_answer"), F.col("category"), F.col("sub_category")), "template_signature": F.sha2(T.template(F.col("question")), 256)})
    x = curation.keep_best(x, ["exact_signature"], "quality", "id")
    x = curation.near_unique(x, "id", "question", "quality")
    return cut(curation.cap_per_key(x, "template_signature", 5, "quality", "id").withColumn("training_source", D.candidate_source(F.lit(False), F.col("is_correct"), F.col("group_accuracy"), F.lit(""))))


PAIR_SQL = "WITH x AS (SELECT CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b, CAST(round(l_discount * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS BIGINT) % 2 = 0 AS even FROM lineitem)"
ACC = "coalesce(avg(CAST(is_correct AS INT)) OVER (PARTITION BY category, sub_category), 0.0)"
EV = f"{ITEMS}, ev AS (SELECT * FROM items WHERE is_correct IS NOT NULL)"
DIM = "dim AS (SELECT DISTINCT lang AS category, source AS sub_category, 8 AS quota, 1.0 AS base_weight FROM documents)"


def lr_sql(source: str, total: str, weight: str, order: str) -> str:
    """Largest-remainder apportionment over all rows of ``source``."""
    return f"""(SELECT * EXCLUDE (fl, fr, rest), fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, {order}) <= rest THEN 1 ELSE 0 END AS allocated FROM
      (SELECT *, {total} - sum(fl) OVER () AS rest FROM (SELECT *, CAST(floor(round({total} * {weight} / sum({weight}) OVER (), 9)) AS BIGINT) AS fl, round({total} * {weight} / sum({weight}) OVER () - floor(round({total} * {weight} / sum({weight}) OVER (), 9)), 9) AS fr FROM {source})))"""


def chunk_sql(source: str, count: str, most: int) -> str:
    return f"(SELECT * FROM (SELECT *, unnest(range(0, CAST(ceil({count} / {most}) AS BIGINT))) AS chunk FROM {source} WHERE {count} > 0))"


STATE = f"""{EV}, {DIM}, post AS (SELECT category, sub_category, 1 + count_if(is_correct) AS a, 1 + count_if(NOT is_correct) AS b, count(*) AS raw_count, arg_max(difficulty, id) AS difficulty FROM ev GROUP BY ALL),
  state AS (SELECT category, sub_category, quota, base_weight, coalesce(a / (a + b), 0.5) AS m, coalesce(a * b / ((a + b) * (a + b) * (a + b + 1.0)), 1 / 12.0) AS v, coalesce(raw_count, 0) AS raw_count, coalesce(difficulty, 4) AS difficulty FROM dim LEFT JOIN post USING (category, sub_category))"""
PRIORITY = "0.40 * exp(-abs(m - 0.20) / 0.15) + 0.25 * greatest(0, quota - raw_count) / greatest(quota, 1) + 0.15 * least(1.0, 4 * sqrt(v)) + 0.15 * (1 - m) + 0.05 * m"
CLOSE = "abs({a} - {b}) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-9)"


def close_sql(a, b):
    return CLOSE.format(a=f"({a})", b=f"({b})")


REPRESENT = " + ".join(f"CAST(regexp_matches(lower(q), '{p}') AS INT)" for p in D.REPRESENTATIONS)
# The dialect has no look-behind: an operator after e or E is counted and taken off.
PROFILE = rf"""WITH x AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM conversations),
  f AS (SELECT *, regexp_replace(regexp_replace(q, '([A-Za-z])-([A-Za-z])', '\1\2', 'g'), '([A-Za-z])-([A-Za-z])', '\1\2', 'g') AS plain, len(regexp_extract_all(q, '(?i)\b(?:{D.FUNCTIONS})\s*\(')) AS calls, len(regexp_extract_all(q, '<=|>=|==|=|<|>')) AS rel,
    list_filter(list_distinct(regexp_extract_all(q, '\b([a-zA-Z]\w*)\b', 1)), lambda t: lower(t) NOT IN ({', '.join(f"'{w}'" for w in (*D.NOT_VARIABLES, *D.FUNCTIONS.split('|')))})) AS names,
    len(regexp_extract_all(q, '(?i)\b(?:{D.DOMAIN})\b')) AS dom FROM x),
  g AS (SELECT *, len(regexp_extract_all(plain, '[+\-*/^]')) - len(regexp_extract_all(plain, '[eE][+\-*/^]')) + len(regexp_extract_all(plain, '<=|>=|==|=|<|>')) + calls AS ops, greatest(1, rel) + least(2, dom) AS con,
    CAST(len(names) > 0 AS INT) + CAST(len(names) > 1 AS INT) + CAST(calls > 0 OR contains(q, '^') AS INT) + CAST(regexp_matches(q, '[(\[{{][^()\[\]{{}}]*[(\[{{]') AS INT) AS dep,
    CAST(len(list_filter(string_split(q, ' '), lambda w: w <> '')) >= 24 AS INT) + {REPRESENT} AS rep FROM f),
  h AS (SELECT *, least(6, greatest(1, CAST(ceil((least(ops, 12) + least(con, 6) + least(dep, 4)) / 4.0) AS INT))) AS steps FROM g),
  k AS (SELECT conv_id, turn, steps AS reasoning_steps, least(12, ops) AS operation_count, least(6, con) AS constraint_count, least(4, dep) AS symbolic_depth, least(4, rep) AS representation_load FROM h),
  s AS (SELECT *, CAST(greatest(1, least(10, floor(1 + 9 * (round((reasoning_steps - 1) / 5.0, 6) * 0.30 + round(operation_count / 12.0, 6) * 0.20 + round((constraint_count - 1) / 5.0, 6) * 0.20 + round(symbolic_depth / 4.0, 6) * 0.20 + round(representation_load / 4.0, 6) * 0.10) + 0.5))) AS INT) AS score FROM k)
  SELECT *, CASE WHEN score <= 2 THEN 'foundational' WHEN score <= 4 THEN 'routine_multistep' WHEN score <= 6 THEN 'integrated' WHEN score <= 8 THEN 'advanced' ELSE 'expert' END AS band FROM s"""
PAIRS = "p AS (SELECT l_linenumber, round(l_extendedprice, 2) AS gold, CASE l_linenumber % 7 WHEN 1 THEN -round(l_extendedprice, 2) WHEN 2 THEN round(l_extendedprice, 2) * 100 WHEN 3 THEN round(l_extendedprice, 2) + 1 WHEN 4 THEN round(l_extendedprice, 2) * 1.005::DOUBLE WHEN 5 THEN round(l_extendedprice, 2) + l_quantity * 1000 ELSE round(l_extendedprice, 2) END AS predicted FROM lineitem)"

QUERIES = {
    "rejection_reasons": (rejection_reasons, f"""WITH {ITEMS}, r AS (SELECT unnest(list_filter([CASE WHEN trim(question) = '' THEN 'missing_question' END, CASE WHEN trim(gold_answer) = '' THEN 'missing_gold_answer' END, CASE WHEN confidence < 0.2 THEN 'low_evaluator_confidence' END, CASE WHEN coalesce(tool_violation, false) THEN 'tool_violation' END, CASE WHEN is_correct IS NULL THEN 'not_evaluated' END], lambda x: x IS NOT NULL)) AS reason FROM items) SELECT reason, count(*) AS n FROM r GROUP BY reason"""),
    "candidate_source_mix": (candidate_mix, rf"""WITH {ITEMS}, a AS (SELECT *, {ACC} AS acc FROM items) SELECT CASE WHEN regexp_matches(question, '^\s*$') THEN 'format' WHEN coalesce(is_correct, false) THEN 'correct' WHEN acc BETWEEN 0.1 AND 0.4 THEN 'boundary' ELSE 'repair' END AS training_source, count(*) AS n FROM a GROUP BY 1"""),
    "quality_score": (quality, f"WITH {ITEMS}, a AS (SELECT *, {ACC} AS acc FROM items) SELECT id, round(0.6 * confidence + 0.3 * exp(-abs(acc - 0.2) / 0.15) + least(length(question) / 300.0, 0.1), 6) AS quality, CASE WHEN acc < 0.1 THEN 'hard_unsuitable' WHEN acc <= 0.4 THEN 'train_eligible' ELSE 'easy_sample' END AS grade FROM a"),
    "compare_summary": (compare_summary, f"WITH {EV} SELECT CASE WHEN grouping(category) = 0 THEN 'category+sub_category' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'all' END AS level, category, sub_category, difficulty, count(*) AS total, count_if(is_correct) AS correct, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM ev GROUP BY GROUPING SETS ((category, sub_category), (difficulty), ())"),
    "benchmark_summary": (benchmark_summary, f"WITH {EV} SELECT count(*) AS total, count_if(is_correct) AS correct, count_if(tool_violation) AS violations, count_if(is_correct AND tool_violation) AS correct_violations, round(avg(confidence), 9) AS mean_confidence, round(avg(abs(confidence - CAST(is_correct AS INT))), 9) AS mean_gap, count(DISTINCT (category, sub_category)) AS groups FROM ev"),
    "weakest_groups": (weakest, f"WITH {EV} SELECT category, sub_category, count(*) AS n, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM ev GROUP BY ALL ORDER BY avg(CAST(is_correct AS INT)), n DESC, category, sub_category LIMIT 10"),
    "coverage_metrics": (coverage_metrics, f"""WITH {EV}, {DIM}, c AS (SELECT dim.category, dim.sub_category, quota, count(ev.id) AS n FROM dim LEFT JOIN ev USING (category, sub_category) GROUP BY ALL), t AS (SELECT sum(n) AS total, count(*) AS k FROM c),
      p AS (SELECT n, quota, k, total, CASE WHEN total > 0 THEN n / total ELSE 0.0 END AS p, 1.0 / k AS u FROM c, t), m AS (SELECT *, (p + u) / 2 AS m FROM p)
      SELECT CAST(max(total) AS BIGINT) AS total, round(avg(CAST(n > 0 AS INT)), 6) AS raw_coverage, round(avg(CAST(n >= quota AS INT)), 6) AS effective_coverage, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(max(k)), 6) AS normalized_entropy, round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + u * ln(u / m)), 6) AS js_divergence,
        round(stddev_pop(n) / avg(n), 6) AS coefficient_of_variation, round(max(n) / min(CASE WHEN n > 0 THEN n END), 6) AS max_min_ratio FROM m"""),
    "beta_posterior": (posterior, f"WITH {EV}, p AS (SELECT category, difficulty, 1.0 + count_if(is_correct) AS alpha, 1.0 + count_if(NOT is_correct) AS beta, count(*) AS raw_count FROM ev GROUP BY ALL) SELECT *, CAST(raw_count AS DOUBLE) AS weight, round(alpha / (alpha + beta), 6) AS posterior_mean, round(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)), 6) AS posterior_variance FROM p"),
    "decayed_posterior": (decayed, f"WITH {EV}, w AS (SELECT *, exp(-0.5 * (3 - cycle)) AS w FROM ev), p AS (SELECT category, sub_category, 1 + sum(CASE WHEN is_correct THEN w ELSE 0 END) AS a, 1 + sum(CASE WHEN is_correct THEN 0 ELSE w END) AS b, count(*) AS raw_count, sum(w) AS w FROM w GROUP BY ALL) SELECT category, sub_category, round(a, 6) AS alpha, round(b, 6) AS beta, raw_count, round(w, 6) AS weight, round(a / (a + b), 6) AS posterior_mean, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 6) AS posterior_variance FROM p"),
    "error_posterior": (error_posterior, f"WITH {EV}, {DIM}, p AS (SELECT category, sub_category, (1.0 + count_if(is_correct)) / (2 + count(*)) AS m, count(*) AS n FROM ev WHERE cycle < 2 GROUP BY ALL) SELECT category, sub_category, round(coalesce(m, 0.5), 6) AS posterior_mean, coalesce(n, 0) AS raw_count, round(1.05 - coalesce(m, 0.5), 6) AS error_weight FROM dim LEFT JOIN p USING (category, sub_category)"),
    "round_accuracy_band": (round_band, f"WITH {EV}, r AS (SELECT cycle, count(*) AS rows, avg(CAST(is_correct AS INT)) AS a FROM ev GROUP BY cycle) SELECT cycle, rows, round(a, 6) AS accuracy, CASE WHEN rows < 10 THEN 0 WHEN a < 0.30 THEN -1 WHEN a > 0.60 THEN 1 ELSE 0 END AS step FROM r"),
    "largest_remainder": (remainder, f"WITH w AS (SELECT lang, source, CAST(sum(n_chars) AS DOUBLE) AS w FROM documents GROUP BY ALL) SELECT lang, source, CAST(allocated AS BIGINT) AS allocated FROM {lr_sql('w', '1000', 'w', 'lang, source')}"),
    "chunked_allocations": (chunks, f"WITH w AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, chunk, least(7, n - chunk * 7) AS chunk_count FROM {chunk_sql('w', 'n', 7)}"),
    "uniform_policy": (uniform_policy, f"WITH {DIM}, w AS (SELECT category, sub_category, 1.0::DOUBLE AS w FROM dim), a AS (SELECT category, sub_category, CAST(allocated AS BIGINT) AS n FROM {lr_sql('w', '1000', 'w', 'category, sub_category')}) SELECT category, sub_category, chunk, least(5, n - chunk * 5) AS question_count, 4 AS difficulty FROM {chunk_sql('a', 'n', 5)}"),
    "error_only_policy": (error_policy, f"WITH {STATE}, w AS (SELECT category, sub_category, difficulty, 1.05 - m AS w FROM state), a AS (SELECT category, sub_category, difficulty, CAST(allocated AS BIGINT) AS n FROM {lr_sql('w', '1000', 'w', 'category, sub_category')}) SELECT category, sub_category, chunk, least(50, n - chunk * 50) AS question_count, difficulty FROM {chunk_sql('a', 'n', 50)}"),
    "full_policy": (full_policy, f"""WITH {STATE}, o AS (SELECT avg(CAST(is_correct AS INT)) AS a, count(*) AS n FROM ev), w AS (SELECT state.*, {PRIORITY} AS pr, greatest(1e-9, ({PRIORITY}) * base_weight) AS w,
        greatest(2, least(6, difficulty + greatest(-1, least(1, CASE WHEN raw_count < 5 THEN 0 WHEN m > 0.30 THEN 1 WHEN m < 0.10 THEN -1 ELSE 0 END + CASE WHEN o.n < 10 THEN 0 WHEN o.a < 0.30 THEN -1 WHEN o.a > 0.60 THEN 1 ELSE 0 END)))) AS nd FROM state, o),
      hp AS (SELECT * FROM w WHERE (category, sub_category) IN (SELECT (category, sub_category) FROM ev WHERE NOT is_correct)),
      u AS (SELECT category, sub_category, pr, nd, 'boundary' AS generation_source, CAST(allocated AS BIGINT) AS n FROM {lr_sql('w', '450', 'w', 'category, sub_category')} UNION ALL SELECT category, sub_category, pr, nd, 'hard_pool', CAST(allocated AS BIGINT) FROM {lr_sql('hp', '400', 'w', 'category, sub_category')} UNION ALL SELECT category, sub_category, pr, nd, 'coverage', CAST(allocated AS BIGINT) FROM {lr_sql('w', '150', 'w', 'category, sub_category')})
      SELECT category, sub_category, generation_source, chunk, least(50, n - chunk * 50) AS question_count, CAST(nd AS INT) AS difficulty, round(pr, 6) AS priority_score FROM {chunk_sql('u', 'n', 50)}"""),
    "plan_status": (plan_status, f"WITH {ITEMS}, {DIM}, w AS (SELECT category, sub_category, 1.0::DOUBLE AS w FROM dim), a AS (SELECT category, sub_category, CAST(allocated AS BIGINT) AS planned FROM {lr_sql('w', '1000', 'w', 'category, sub_category')}), d AS (SELECT category, sub_category, count(*) AS made FROM items GROUP BY ALL) SELECT category, sub_category, planned, coalesce(made, 0) AS made, greatest(0, planned - coalesce(made, 0)) AS missing, CASE WHEN planned <= coalesce(made, 0) THEN 'satisfied' WHEN made > 0 THEN 'partial' ELSE 'unsatisfied' END AS status FROM a LEFT JOIN d USING (category, sub_category) WHERE planned > 0"),
    "difficulty_profile": (difficulty_profile, PROFILE),
    "error_signatures": (error_signatures, f"""WITH {PAIRS} SELECT l_linenumber, CASE WHEN {close_sql('gold', 'predicted')} THEN 'none' WHEN {close_sql('gold', '-predicted')} THEN 'sign_error' WHEN gold <> 0 AND {close_sql('predicted * gold', '1.0')} THEN 'reciprocal_error' WHEN {close_sql('gold * 100', 'predicted')} OR {close_sql('gold', 'predicted * 100')} THEN 'scale_or_percentage_error'
      WHEN {close_sql('abs(gold - predicted)', '1.0')} THEN 'off_by_one_error' WHEN abs(gold - predicted) <= 0.01 * greatest(abs(gold), 1e-12) THEN 'rounding_error' ELSE 'arithmetic_computation_error' END AS tag, count(*) AS n FROM p GROUP BY ALL"""),
    "answer_numeric_equiv": (numeric_equivalence, """WITH t AS (SELECT l_linenumber, printf('%.2f', l_discount) AS gold, printf('%.0f', l_discount * 100) || '%' AS percent, printf('%.0f', l_discount * 100) || '/100' AS fraction, printf('%.2f', l_tax) AS other FROM lineitem),
      v AS (SELECT l_linenumber, CAST(gold AS DOUBLE) AS g, CAST(rtrim(percent, '%') AS DOUBLE) / 100 AS p, CAST(split_part(fraction, '/', 1) AS DOUBLE) / CAST(split_part(fraction, '/', 2) AS DOUBLE) AS f, CAST(other AS DOUBLE) AS o FROM t)
      SELECT l_linenumber, count(*) AS n, CAST(count_if(abs(g - p) <= 1e-9) AS BIGINT) AS as_percent, CAST(count_if(abs(g - f) <= 1e-9) AS BIGINT) AS as_fraction, CAST(count_if(abs(g - o) <= 1e-9) AS BIGINT) AS as_tax FROM v GROUP BY l_linenumber"""),
    "judge_fusion": (judge_fusion, """WITH x AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'equal' WHEN 1 THEN 'different' ELSE 'ambiguous' END AS typed, o_orderkey % 2 = 0 AS j, o_orderkey % 5 <> 0 AS v, o_orderkey % 7 = 0 AS r, o_orderkey % 11 <> 0 AS f, (o_orderkey % 100) / 100 AS c FROM orders),
      d AS (SELECT typed, CASE WHEN r AND NOT v THEN 'judge_failed' WHEN typed = 'equal' AND v AND NOT j THEN 'conflict' WHEN typed = 'equal' THEN 'typed_correct' WHEN typed = 'different' THEN 'typed_incorrect' WHEN v AND j AND f AND c >= 0.80 THEN 'judge_accepted' ELSE 'ambiguous' END AS decision FROM x)
      SELECT typed, decision, decision IN ('typed_correct', 'judge_accepted') AS is_correct, count(*) AS n FROM d GROUP BY ALL"""),
    "response_parse": (response_parse, "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'line' ELSE 'failed' END AS status, CASE WHEN conv_id % 3 = 0 THEN 0.75::DOUBLE END AS confidence, CASE conv_id % 3 WHEN 0 THEN length(text) WHEN 1 THEN length(conv_id::VARCHAR) END AS answer_length FROM conversations WHERE role = 'assistant'"),
    "answer_equivalence": (answer_equivalence, f"""{PAIR_SQL},
      e AS (SELECT 'set' AS kind, list_sort(list_distinct([a, b])) = list_sort(list_distinct(CASE WHEN even THEN [b, a] ELSE [b, c] END)) AS same FROM x UNION ALL SELECT 'ordered_tuple', a = b FROM x UNION ALL SELECT 'unit_value', a = b AND even FROM x
      UNION ALL SELECT 'integer', a * 1000 = b * 1000 FROM x UNION ALL SELECT 'rational', even OR a * a = b * b FROM x UNION ALL SELECT 'interval', even FROM x UNION ALL SELECT 'matrix', a = b FROM x UNION ALL SELECT 'multiple_choice', even FROM x UNION ALL SELECT 'symbolic_expression', b = a * a FROM x)
      SELECT kind, CASE WHEN same THEN 'equal' ELSE 'different' END AS status, count(*) AS n FROM e GROUP BY ALL"""),
    "training_set": (training_set, None),
}


def error_attribution(spark, sf):
    """The error pattern of every answer pair of ``typed_answers`` and of wrong numbers, by kind."""
    from ..operators.collections import attributed_error

    x = typed_answers(spark, sf).where("kind IN ('set', 'unit_value', 'matrix', 'integer', 'multiple_choice')")
    x = x.where("kind <> 'multiple_choice' OR predicted = 'c'")
    return x.groupBy("kind", attributed_error(F.col("gold"), F.col("predicted"), F.col("kind")).alias("tag")).agg(F.sum("rows").alias("n"))


def reasoning_checks(spark, sf):
    """Reasoning steps made of the numbers of line items, each in six forms that the checks tell apart."""
    from ..functions.reasoning import reasoning_problem

    x = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("long").alias("a"), F.col("l_quantity").cast("long").alias("b"), F.pmod("l_orderkey", F.lit(6)).alias("form")).groupBy("a", "b", "form").agg(F.count("*").alias("rows"))
    f, total = F.format_string, F.col("a") + F.col("b")
    first = f("Add %d and %d first.", "a", "b")
    steps = (
        F.array(f("Add %d and %d to get %d", "a", "b", total)),
        F.array(first, f("system: check that %d holds", total)),
        F.array(F.lit("Solve the problem."), f("Check that %d + %d = %d", "a", "b", total)),
        F.array(first, f("So the sum is %d here.", total)),
        F.array(first, f("Check the sum %d again.", F.col("b") * 2)),
        F.array(first, f("Check the sum %d again.", total)),
    )
    problem = F.coalesce(reasoning_problem(F.get(F.array(*steps), F.col("form").cast("int")), total.cast("string")), F.lit("none"))
    return x.groupBy("form", problem.alias("problem")).agg(F.sum("rows").alias("n"))


def blind_set(spark, sf):
    from ..operators.collections import blind_set as chosen

    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("pid"), F.col("text").alias("question"))
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("lang").alias("category"))
    return chosen(x, b, "id", "pid", ["category"], 10).select("id", "category")


def guidance(spark, sf):
    from ..operators.collections import guidance as chosen

    x = evaluated(spark, sf).select("id", "question", "category", "sub_category", "difficulty")
    return chosen(x, ["category", "sub_category"], "id", ["difficulty"], 3).select("id", "category", "sub_category")


QUERIES |= {
    "error_attribution": (error_attribution, f"""{PAIR_SQL},
      e AS (SELECT 'set' AS kind, CASE WHEN [a, b] = CASE WHEN even THEN [b, a] ELSE [b, c] END THEN 'format_only_difference' WHEN list_has_all([a, b], CASE WHEN even THEN [b, a] ELSE [b, c] END) THEN 'incomplete_solution' WHEN list_has_all(CASE WHEN even THEN [b, a] ELSE [b, c] END, [a, b]) THEN 'extraneous_solution' ELSE 'unknown_error' END AS tag FROM x
      UNION ALL SELECT 'unit_value', CASE WHEN even THEN 'unknown_error' ELSE 'unit_mismatch' END FROM x UNION ALL SELECT 'matrix', 'matrix_element_error' FROM x UNION ALL SELECT 'multiple_choice', 'unknown_error' FROM x WHERE NOT even
      UNION ALL SELECT 'integer', CASE WHEN a = b THEN 'unknown_error' WHEN abs(a - b) * 1000 = 1 THEN 'off_by_one_error' WHEN a = 100 * b OR b = 100 * a THEN 'scale_or_percentage_error' ELSE 'arithmetic_computation_error' END FROM x)
      SELECT kind, tag, count(*) AS n FROM e GROUP BY ALL"""),
    "reasoning_checks": (reasoning_checks, """WITH x AS (SELECT CAST(l_linenumber AS BIGINT) AS a, CAST(l_quantity AS BIGINT) AS b, l_orderkey % 6 AS form FROM lineitem)
      SELECT form, CASE form WHEN 0 THEN 'invalid_gold_reasoning_steps' WHEN 1 THEN 'unsafe_gold_reasoning_steps' WHEN 2 THEN 'non_concrete_gold_reasoning_steps' WHEN 3 THEN 'missing_gold_reasoning_verification' WHEN 4 THEN CASE WHEN a = b THEN 'none' ELSE 'gold_reasoning_not_anchored_to_answer' END ELSE 'none' END AS problem, count(*) AS n FROM x GROUP BY ALL"""),
    "blind_set": (blind_set, None),
    "guidance": (guidance, None),
}
