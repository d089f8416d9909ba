"""Pools, ledgers, registries, imports and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import taxonomy as X
from ..operators import audit, ledger, pool, summary
from ..sources import readers
from ..streaming import events as S
from .base import ITEMS, items, table
from .policy_queries import evaluated, rounded


def attempts(spark, sf):
    """Graded line items as attempts at samples: key, outcome, cycle and iteration."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("unique_key"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("sub_category"), F.when(F.col("l_discount") < 0.04, "train_eligible").otherwise("easy_sample").alias("grade"), F.year("l_shipdate").alias("cycle"), F.month("l_shipdate").alias("iteration"), (F.col("l_quantity") > 25).alias("ok"))


def first_pool(spark, sf):
    """The pool after the wrong attempts of 1995 and earlier."""
    x = attempts(spark, sf).where("cycle <= 1995 AND NOT ok")
    empty = x.select("unique_key", "category", "sub_category", "grade", F.lit("active").alias("state"), F.lit(0).alias("streak"), F.col("cycle").alias("last_seen_cycle"), F.col("iteration").alias("last_iteration"), F.lit(1).alias("occurrences"), F.lit(0).alias("failures")).limit(0)
    return pool.merge(empty, _one(x))


def _one(x):
    """One row a key and time, so that a merge doesn't depend on the order of equal ones."""
    return x.groupBy("unique_key", "cycle", "iteration").agg(F.min("category").alias("category"), F.min("sub_category").alias("sub_category"), F.min("grade").alias("grade"))


def hard_pool_merge(spark, sf):
    new = _one(attempts(spark, sf).where("cycle = 1996 AND NOT ok"))
    return pool.merge(first_pool(spark, sf), new).drop("failures", "streak")


def lifecycle(spark, sf):
    p = first_pool(spark, sf)
    o = attempts(spark, sf).where("cycle = 1996 AND iteration = 3").groupBy("unique_key").agg(F.min("ok").alias("is_correct"))
    x = pool.apply_outcomes(p, o, 1997)
    return x.groupBy("state", "streak").agg(F.count("*").alias("n"), F.sum("failures").alias("failures"))


def retest(spark, sf):
    p = first_pool(spark, sf).withColumn("confidence", F.lit(0.5))
    return rounded(pool.retest(p, 20, 1997).select("unique_key", "retest_priority"), "retest_priority")


def pool_export(spark, sf):
    return pool.export(first_pool(spark, sf)).select("unique_key", "category")


def fallback(spark, sf):
    p = first_pool(spark, sf).where("grade = 'train_eligible'").select(F.concat_ws("/", "category", "sub_category").alias("fine"), F.col("category").alias("coarse"), "unique_key")
    plan = spark.createDataFrame([("A/F", "A"), ("A/X", "A"), ("N/O", "N"), ("Q/F", "Q")], "fine string, coarse string")
    return summary.with_fallback(plan, p, "fine", "coarse", 3, [F.col("unique_key")]).select("unique_key", "matched_on", "rank")


def tokens(spark, sf):
    return table(spark, sf, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))


def ledger_rollup(spark, sf):
    x = ledger.rollup(tokens(spark, sf), ["user_id"], "event_type", "tokens", 3.0)
    return rounded(x, "cost")


def idempotent(spark, sf):
    x = table(spark, sf, "events")
    twice = x.unionByName(x.where("event_id % 3 = 0"))
    return S.once(twice, ["event_id"]).groupBy("event_type").agg(F.count("*").alias("events"))


def budget_cap(spark, sf):
    x = ledger.capped(tokens(spark, sf), ["user_id"], ["ts", "event_id"], "tokens", 2_000)
    return x.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.max("running_tokens").alias("used"))


def cost_quality(spark, sf):
    x = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("exact"), F.count_if(F.col("event_type") == "view").alias("estimated"))
    return x.select(ledger.cost_quality("exact", "estimated").alias("quality")).groupBy("quality").agg(F.count("*").alias("users"))


def efficiency(spark, sf):
    x = tokens(spark, sf).groupBy("event_type").agg(F.sum("tokens").alias("tokens"), F.sum("value").alias("gain"), (F.count("*") / 60.0).alias("hours"))
    return rounded(ledger.efficiency(x, "gain", "tokens", "hours").select("event_type", "gain_per_1k_tokens", "gain_per_hour"), "gain_per_1k_tokens", "gain_per_hour", digits=4)


def upsert(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = d.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)).unionByName(spark.createDataFrame([(-1, "N", 1.0)], d.schema))
    return rounded(summary.upsert(d, new, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), "total", digits=2)


def last_by_key(spark, sf):
    x = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return summary.last_by_key(x, ["o_custkey"], "o_orderkey")


def valid_prefix(spark, sf):
    x = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    y = summary.valid_prefix(x, ["o_custkey"], "o_orderkey", F.col("o_totalprice") < 300_000)
    return y.groupBy("o_custkey").agg(F.count("*").alias("n"))


def missing_pairs(spark, sf):
    x = items(spark, sf)
    want = x.select("category").distinct().withColumn("difficulty", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return summary.missing_pairs(want, x, ["category", "difficulty"])


def sum_maps(spark, sf):
    x = table(spark, sf, "events").select("event_type", F.create_map(F.concat(F.lit("h"), (F.hour("ts") % 6).cast("string")), F.lit(1).cast("long")).alias("m"))
    return summary.sum_maps(x, ["event_type"], "m")


def summary_lines(spark, sf):
    return summary.summary_lines(evaluated(spark, sf), ["category"])


def canonical(spark, sf):
    """Records of unlike names made one schema: question, answer, taxonomy and key."""
    from ..functions import text as T

    c = table(spark, sf, "conversations")
    q = F.when(F.col("turn") % 2 == 0, F.col("text"))
    p = F.when(F.col("turn") % 2 == 1, F.col("text"))
    x = c.select("conv_id", "turn", F.coalesce(q, p).alias("question"), F.col("role").alias("sub"))
    x = x.withColumn("category", X.category_of(F.lit(None).cast("string"), F.col("sub"), F.col("question")))
    x = x.withColumn("sub_category", X.group_of(F.lit(""), F.col("category"), F.col("question")))
    return x.select("conv_id", "turn", "category", "sub_category", A.answer_type(F.col("sub"), F.lit("12.5")).alias("answer_type"), T.unique_key(F.col("category"), F.col("sub_category"), F.col("question")).alias("unique_key"))


def answer_types(spark, sf):
    x = table(spark, sf, "lineitem").select(F.element_at(F.array(*map(F.lit, ("12", "1.5", "1/2", "50%", "yes", "x + 1 = 2", "{1,2}", "(1,2)", "3 km", "x^2", "plain words", "x < 3"))), (F.col("l_orderkey") % 12 + 1).cast("int")).alias("answer"))
    return x.groupBy("answer", A.inferred_type(F.col("answer")).alias("type")).agg(F.count("*").alias("n"))


def error_tags(spark, sf):
    x = table(spark, sf, "conversations").where("role = 'assistant'")
    t = X.error_tags(X.category_of(F.lit(""), F.lit(""), F.col("text")), F.col("text"), F.col("text"))
    return x.select(F.explode(t).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def static_set(spark, sf):
    x = readers.static_items(spark, X.taxonomy(spark), 20)
    return x.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("gold_answer").cast("long")).alias("answers"))


def inventory(spark, sf):
    x = readers.inventory(spark, f"{sf}/region.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "kind")
    return x


def human_resolution(spark, sf):
    x = evaluated(spark, sf).select("id", F.array(F.struct(F.lit("a").alias("reviewer"), (F.col("id") % 2 == 0).alias("verdict"), F.lit(False).alias("adjudication")), F.struct(F.lit("b").alias("reviewer"), (F.col("id") % 3 == 0).alias("verdict"), F.lit(False).alias("adjudication")), F.struct(F.when(F.col("id") % 5 == 0, "c").otherwise("a").alias("reviewer"), F.lit(True).alias("verdict"), F.lit(True).alias("adjudication"))).alias("r"))
    return x.groupBy(audit.human_resolution(F.col("r")).alias("resolution")).agg(F.count("*").alias("n"))


def guidance_topk(spark, sf):
    from ..operators import split

    return split.first_per_bucket(evaluated(spark, sf), ["category", "sub_category"], 3, F.struct(-F.col("difficulty"), F.col("id"))).select("id", "category", "sub_category")


def diverse_selection(spark, sf):
    from ..functions import text as T
    from ..operators import split

    x = items(spark, sf).select("id", "category", "sub_category", "difficulty", F.sha2(T.template(F.col("question")), 256).alias("template"))
    return split.diverse(x, ["category"], "id", ["difficulty", "sub_category"], "template", 10).select("id", "category")


def stream_of(spark, sf):
    return S.read(spark, sf, glob="events.parquet")


def tumbling(spark, sf):
    x = S.finished(S.tumbling(stream_of(spark, sf), "6 hours", ["event_type"], "60 days"), "complete")
    return rounded(x, "total", digits=4)


def sliding(spark, sf):
    x = S.finished(S.sliding(stream_of(spark, sf), "1 day", "12 hours", ["event_type"], "60 days"), "complete")
    return x.select("window_start", "event_type", "n", F.round(F.col("mean") * F.col("n"), 3).alias("total"))


def session(spark, sf):
    x = S.finished(S.sessions(stream_of(spark, sf), "2 hours", ["user_id"], "60 days"), "complete")
    return rounded(x, "total", digits=4)


def stream_ledger(spark, sf):
    x = S.ledger(stream_of(spark, sf), ["user_id"], F.get_json_object("props", "$.k").cast("long"))
    return S.finished(x, "complete")


def stream_decay(spark, sf):
    x = S.finished(S.daily_weighted(stream_of(spark, sf), ["event_type"], 0.1, "2024-02-01"), "complete")
    return rounded(x, "weighted")


def stream_lifecycle(spark, sf):
    o = stream_of(spark, sf).select(F.pmod("user_id", F.lit(40)).alias("sample"), "ts", "event_id", (F.col("value") > 50).alias("is_correct"))
    return S.finished(S.lifecycle(o, "sample"), "update")


def stream_cooldown(spark, sf):
    o = stream_of(spark, sf).select("event_type", "ts", "event_id", (F.col("value") > 80).alias("fruitful"))
    x = S.finished(S.cooldown(o, "event_type"), "append")
    return x.groupBy("event_type").agg(F.count("*").alias("rounds"), F.count_if("blocked").alias("blocked"))


def stream_cap(spark, sf):
    o = stream_of(spark, sf).select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    x = S.finished(S.budget_cap(o, "user_id", "tokens", 500), "append")
    return x.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.max("used").alias("used"))


TRIES = "t AS (SELECT l_partkey::VARCHAR AS unique_key, l_returnflag AS category, l_linestatus AS sub_category, CASE WHEN l_discount < 0.04 THEN 'train_eligible' ELSE 'easy_sample' END AS grade, CAST(year(l_shipdate) AS INT) AS cycle, CAST(month(l_shipdate) AS INT) AS iteration, l_quantity > 25 AS ok FROM lineitem)"
POOL = f"{TRIES}, f AS (SELECT unique_key, cycle, iteration, min(category) AS category, min(sub_category) AS sub_category, min(grade) AS grade FROM t WHERE cycle <= 1995 AND NOT ok GROUP BY ALL), p AS (SELECT unique_key, category, sub_category, grade, 'active' AS state, 0 AS streak, cycle AS last_seen_cycle, iteration AS last_iteration, 1 AS occurrences FROM f QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY cycle DESC, iteration DESC) = 1)"
TOK = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"

QUERIES = {
    "hard_pool_merge": (hard_pool_merge, f"WITH {POOL}, g AS (SELECT unique_key, cycle, iteration, min(category) AS category, min(sub_category) AS sub_category, min(grade) AS grade FROM t WHERE cycle = 1996 AND NOT ok GROUP BY ALL), n AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY cycle DESC, iteration DESC) = 1) SELECT unique_key, coalesce(n.category, p.category) AS category, coalesce(n.sub_category, p.sub_category) AS sub_category, coalesce(n.grade, p.grade) AS grade, 'active' AS state, coalesce(n.cycle, p.last_seen_cycle) AS last_seen_cycle, coalesce(n.iteration, p.last_iteration) AS last_iteration, coalesce(occurrences, 0) + CASE WHEN n.cycle IS NULL THEN 0 ELSE 1 END AS occurrences FROM p FULL JOIN n USING (unique_key)"),
    "lifecycle_states": (lifecycle, f"""WITH {POOL}, o AS (SELECT unique_key, bool_and(ok) AS ok FROM t WHERE cycle = 1996 AND iteration = 3 GROUP BY 1), x AS (SELECT p.*, ok, 1997 - last_seen_cycle AS age FROM p LEFT JOIN o USING (unique_key)),
      s AS (SELECT *, CASE WHEN ok THEN 1 ELSE 0 END AS st, CASE WHEN ok IS NULL AND age >= 2 THEN 'stale' ELSE 'active' END AS now FROM x) SELECT CASE WHEN age >= 4 AND now IN ('mastered', 'stale') THEN 'retired' ELSE now END AS state, st AS streak, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failures FROM s GROUP BY 1, 2"""),
    "hard_pool_retest_topk": (retest, f"WITH {POOL} SELECT unique_key, round(exp(-0.5 * greatest(0, 1997 - last_seen_cycle)) * (1 + 0.5 + ln(1 + occurrences)), 6) AS retest_priority FROM p WHERE grade = 'train_eligible' ORDER BY exp(-0.5 * greatest(0, 1997 - last_seen_cycle)) * (1 + 0.5 + ln(1 + occurrences)) DESC, unique_key DESC LIMIT 20"),
    "pool_export": (pool_export, f"WITH {POOL} SELECT unique_key, category FROM p WHERE grade = 'train_eligible'"),
    "plan_fallback": (fallback, f"WITH {POOL}, q AS (SELECT category || '/' || sub_category AS fine, category AS coarse, unique_key FROM p WHERE grade = 'train_eligible'), pl(fine, coarse) AS (VALUES ('A/F', 'A'), ('A/X', 'A'), ('N/O', 'N'), ('Q/F', 'Q')), a AS (SELECT *, row_number() OVER (PARTITION BY fine ORDER BY unique_key) AS k FROM q), b AS (SELECT *, row_number() OVER (PARTITION BY coarse ORDER BY unique_key) AS k FROM q) SELECT unique_key, 'fine' AS matched_on, k AS rank FROM pl JOIN a USING (fine) WHERE k <= 3 UNION ALL SELECT unique_key, 'coarse', k FROM pl JOIN b ON b.coarse = pl.coarse WHERE k <= 3 AND pl.fine NOT IN (SELECT fine FROM q)"),
    "ledger_rollup": (ledger_rollup, f"WITH {TOK} SELECT user_id, event_type, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS peak_tokens, round(sum(tokens) / 1e6 * 3.0, 6) AS cost FROM e GROUP BY ALL"),
    "idempotent_events": (idempotent, "SELECT event_type, count(*) AS events FROM events GROUP BY event_type"),
    "budget_cap": (budget_cap, f"WITH {TOK}, l AS (SELECT user_id, list(coalesce(tokens, 0) ORDER BY ts, event_id) AS t FROM e GROUP BY user_id), r AS (SELECT user_id, list_reduce(list_prepend({{'u': 0::BIGINT, 'n': 0::BIGINT}}, list_transform(t, lambda v: {{'u': v, 'n': 0::BIGINT}})), lambda a, v: CASE WHEN a.u + v.u <= 2000 THEN {{'u': a.u + v.u, 'n': a.n + 1}} ELSE a END) AS x FROM l) SELECT user_id, x.n AS admitted, x.u AS used FROM r"),
    "cost_quality": (cost_quality, "WITH u AS (SELECT user_id, count_if(event_type = 'click') AS e, count_if(event_type = 'view') AS s FROM events GROUP BY 1) SELECT CASE WHEN e = 0 AND s = 0 THEN 'no_token_calls' WHEN s = 0 THEN 'exact' WHEN e = 0 THEN 'estimated' ELSE 'mixed' END AS quality, count(*) AS users FROM u GROUP BY 1"),
    "ledger_efficiency": (efficiency, f"WITH {TOK} SELECT event_type, round(sum(value) / (sum(tokens) / 1000), 4) AS gain_per_1k_tokens, round(sum(value) / (count(*) / 60.0), 4) AS gain_per_hour FROM e GROUP BY event_type"),
    "upsert_rows": (upsert, "WITH u AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS v FROM orders UNION ALL SELECT 'N', 1.0) SELECT o_orderstatus, count(*) AS n, round(sum(v), 2) AS total FROM u GROUP BY 1"),
    "last_by_key": (last_by_key, "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey"),
    "valid_prefix": (valid_prefix, "WITH b AS (SELECT *, min(CASE WHEN NOT o_totalprice < 300000 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS bad FROM orders) SELECT o_custkey, count(*) AS n FROM b WHERE bad IS NULL OR o_orderkey < bad GROUP BY 1"),
    "missing_pairs": (missing_pairs, f"WITH {ITEMS} SELECT category, CAST(d AS INT) AS difficulty FROM (SELECT DISTINCT category FROM items), range(1, 13) r(d) WHERE (category, CAST(d AS INT)) NOT IN (SELECT (category, difficulty) FROM items)"),
    "sum_maps": (sum_maps, "SELECT event_type, 'h' || (hour(ts) % 6) AS key, count(*) AS n FROM events GROUP BY ALL"),
    "summary_lines": (summary_lines, f"WITH {ITEMS} SELECT printf('%s: %.3f (%d)', category, avg(CAST(is_correct AS INT)), count(*)) AS line FROM items WHERE is_correct IS NOT NULL GROUP BY category"),
    "canonical_records": (canonical, None),
    "answer_types": (answer_types, "WITH v(k, answer, type) AS (VALUES (0, '12', 'integer'), (1, '1.5', 'decimal'), (2, '1/2', 'rational'), (3, '50%', 'percentage'), (4, 'yes', 'boolean'), (5, 'x + 1 = 2', 'equation'), (6, '{1,2}', 'set'), (7, '(1,2)', 'interval'), (8, '3 km', 'unit_value'), (9, 'x^2', 'symbolic_expression'), (10, 'plain words', 'text'), (11, 'x < 3', 'inequality')) SELECT answer, type, count(*) AS n FROM v JOIN lineitem ON l_orderkey % 12 = k GROUP BY ALL"),
    "error_tags": (error_tags, None),
    "static_set": (static_set, None),
    "file_inventory": (inventory, "SELECT 'region.parquet' AS file, 'other' AS kind"),
    "human_resolution": (human_resolution, f"WITH {ITEMS} SELECT CASE WHEN id % 5 = 0 THEN 'verified' WHEN (id % 2 = 0) <> (id % 3 = 0) THEN 'disputed' WHEN id % 2 = 0 THEN 'verified' ELSE 'rejected' END AS resolution, count(*) AS n FROM items WHERE is_correct IS NOT NULL GROUP BY 1"),
    "guidance_topk": (guidance_topk, f"WITH {ITEMS} SELECT id, category, sub_category FROM items WHERE is_correct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category, sub_category ORDER BY difficulty DESC, id) <= 3"),
    "diverse_selection": (diverse_selection, None),
    "tumbling_windows": (tumbling, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "sliding_windows": (sliding, "WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS window_start, event_type, value FROM events, range(0, 2) r(k)) SELECT window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM w GROUP BY ALL"),
    "session_windows": (session, "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"),
    "stream_ledger": (stream_ledger, f"WITH {TOK} SELECT user_id, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS peak_tokens FROM e GROUP BY user_id"),
    "stream_decay": (stream_decay, "WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, event_type, n, round(n * exp(-0.1 * date_diff('day', day, DATE '2024-02-01')), 6) AS weighted FROM d"),
    "stream_lifecycle": (stream_lifecycle, "WITH e AS (SELECT user_id % 40 AS sample, ts, event_id, value > 50 AS ok FROM events), l AS (SELECT *, max(CASE WHEN NOT ok THEN (ts, event_id) END) OVER (PARTITION BY sample) AS bad FROM e) SELECT sample, CASE WHEN count_if(ok AND (bad IS NULL OR (ts, event_id) > bad)) >= 2 THEN 'mastered' ELSE 'active' END AS state, count_if(ok AND (bad IS NULL OR (ts, event_id) > bad)) AS streak, count_if(NOT ok) AS failures, count(*) AS tests FROM l GROUP BY sample"),
    "stream_cooldown": (stream_cooldown, """WITH l AS (SELECT event_type, list({'f': value > 80, 'm': 0, 'w': 0, 'b': 0::BIGINT, 'n': 0::BIGINT} ORDER BY ts, event_id) AS v FROM events GROUP BY event_type),
      r AS (SELECT event_type, list_reduce(list_prepend({'f': false, 'm': 0, 'w': 0, 'b': 0::BIGINT, 'n': 0::BIGINT}, v), lambda a, x: CASE WHEN a.w > 0 THEN {'f': a.f, 'm': a.m, 'w': a.w - 1, 'b': a.b + 1, 'n': a.n + 1} WHEN x.f THEN {'f': a.f, 'm': 0, 'w': 0, 'b': a.b, 'n': a.n + 1} WHEN a.m >= 2 THEN {'f': a.f, 'm': 0, 'w': 2, 'b': a.b, 'n': a.n + 1} ELSE {'f': a.f, 'm': a.m + 1, 'w': 0, 'b': a.b, 'n': a.n + 1} END) AS s FROM l)
      SELECT event_type, s.n AS rounds, s.b AS blocked FROM r"""),
    "stream_budget_cap": (stream_cap, f"WITH {TOK}, l AS (SELECT user_id, list(tokens ORDER BY ts, event_id) AS t FROM e GROUP BY user_id), r AS (SELECT user_id, list_reduce(list_prepend({{'u': 0::BIGINT, 'n': 0::BIGINT}}, list_transform(t, lambda v: {{'u': v, 'n': 0::BIGINT}})), lambda a, v: CASE WHEN a.u + v.u <= 500 THEN {{'u': a.u + v.u, 'n': a.n + 1}} ELSE a END) AS x FROM l) SELECT user_id, x.n AS admitted, x.u AS used FROM r"),
}
