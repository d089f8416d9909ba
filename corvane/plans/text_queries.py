"""Text, signatures, dedup, leakage and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..functions import text as T
from ..operators import audit, curation, pairs
from .base import ITEMS, items, norm_sql, shingles_sql, table, template_sql, words_sql


#: Places of a MinHash signature.
PERMUTATIONS = 128


def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalized(F.col("text")).alias("norm"))


def template_clusters(spark, sf):
    x = table(spark, sf, "documents").select(F.sha2(T.template(F.col("text")), 256).alias("template"), "doc_id")
    return x.groupBy("template").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def signatures(spark, sf):
    x = items(spark, sf)
    c = F.col
    return x.select("id", T.exact_signature(c("question"), c("gold_answer"), c("category"), c("sub_category")).alias("exact_signature"), T.unique_key(c("category"), c("sub_category"), c("question")).alias("unique_key"), T.estimated_tokens(c("question")).alias("tokens"))


def exact_dedup(spark, sf):
    x = items(spark, sf).withColumn("norm", T.normalized(F.col("question")))
    return curation.keep_best(x, ["norm"], "confidence", "id").select("id", "confidence")


def template_cap(spark, sf):
    x = items(spark, sf).withColumn("k", F.concat_ws("|", "category", F.col("difficulty").cast("string")))
    return curation.cap_per_key(x, "k", 5, "confidence", "id").select("id", "k")


def exact_leak(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    held = table(spark, sf, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("item_id"), "text").unionByName(table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("item_id"), "text"))
    return curation.exact_leaks(docs, "id", held, "item_id", "text")


def lexical_leak(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    x = curation.lexical_scores(docs, "id", table(spark, sf, "benchmark"), "item_id", "text")
    return x.groupBy("id").agg(F.round(F.max("unigram"), 6).alias("unigram"), F.round(F.max("bigram"), 6).alias("bigram"), F.round(F.max("tfidf"), 6).alias("tfidf"), F.round(F.max("similarity"), 6).alias("similarity"))


def holdout_containment(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.explode(T.shingles(T.words(F.col("text")), 5)).alias("g"))
    held = table(spark, sf, "benchmark").select("item_id", T.shingles(T.words(F.col("text")), 5).alias("s")).select("item_id", F.size("s").alias("size"), F.explode("s").alias("g"))
    x = docs.join(held, "g").groupBy("doc_id", "item_id", "size").agg(F.count("*").alias("shared"))
    return x.select("doc_id", "item_id", F.round(F.col("shared") / F.col("size"), 6).alias("containment")).where("containment >= 0.8")


def pair_jaccard(spark, sf):
    x = table(spark, sf, "documents").withColumn("w", T.words(F.col("text")))
    p = pairs.jaccard_pairs(x, "doc_id", "w", 0.8, 2)
    return p.select("left", "right", F.round("similarity", 6).alias("similarity"))


def pair_tfidf(spark, sf):
    x = table(spark, sf, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    a, b = x.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), x.select((F.col("item_id") - 1).alias("a"), F.col("w").alias("wb"))
    return a.join(b, "a").select(F.col("a").alias("item_id"), F.round(T.pair_tfidf(F.col("wa"), F.col("wb")), 6).alias("cosine"))


def hashed_texts(spark, sf):
    """All of benchmark and documents with their MinHash shingles."""
    x = table(spark, sf, "benchmark").select("item_id", "text").unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 1_000_000_000).alias("item_id"), "text"))
    return x.select("item_id", T.ascii_shingles(F.col("text")).alias("s"))


def minhash_signature(spark, sf):
    signed = hashed_texts(spark, sf).withColumn("sig", T.minhash(F.col("s"), PERMUTATIONS))
    return signed.select("item_id", F.array_join("sig", ",").alias("signature"))


def minhash_pairs(spark, sf):
    """Bands of four places: of pairs of similarity 0.78 all but 4e-7 share one, of 0.7 all but 2e-4."""
    p = pairs.minhash_pairs(hashed_texts(spark, sf), "item_id", "s", PERMUTATIONS, PERMUTATIONS // 4, 0.78)
    return p.select("left", "right", F.round("similarity", 6).alias("similarity"))


def minhash_pairs_all(spark, sf):
    """As ``minhash_pairs`` with as many bands as make it complete at 0.7 of the places of a signature."""
    p = pairs.minhash_pairs(hashed_texts(spark, sf), "item_id", "s", 32, None, 0.7)
    return p.select("left", "right", F.round("similarity", 6).alias("similarity"))


def embedding_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    x = pairs.top_cosine(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return x.select("query", "match", F.round("similarity", 6).alias("similarity"), "rank")


def greedy_near_dedup(spark, sf):
    """First-wins near-duplicate removal over exact Jaccard links of word pairs, in order of quality."""
    x = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100).alias("confidence"), T.words(F.col("text")).alias("w"))
    return curation.first_wins(x, "id", "w", [(-F.col("confidence")).alias("q"), F.col("id").alias("k")], 0.8, 2)


def structure_audit(spark, sf):
    docs = table(spark, sf, "documents")
    x = audit.flags(docs.where("doc_id % 5 = 0").select("doc_id", "text"), "doc_id", "text", docs.where("doc_id % 5 <> 0"), "text")
    return x.select("doc_id", "duplicate_of", "in_training_norm", "in_training_template", (F.when(F.col("in_training_norm") | F.col("in_training_template"), "leaked").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("other")).alias("status"))


def paragraphs(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return x.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("p")).alias("chars"))


def taxonomy_classify(spark, sf):
    x = table(spark, sf, "conversations").select("conv_id", "turn", X.category_of(F.lit(""), F.lit(""), F.col("text")).alias("category"), X.classify_import(F.col("text"), F.lit(""), F.lit("none"))["rule"].alias("rule"))
    return x


def new_text(spark, sf):
    from ..operators.summary import new_texts

    d = table(spark, sf, "documents")
    fresh = new_texts(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), T.normalized(F.col("text")), T.normalized(F.col("text")), "doc_id")
    return fresh.select("doc_id")


def response_checks(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    x = c.where("role = 'assistant'").join(a, ["conv_id", "turn"])
    t = F.col("text")
    return x.select("conv_id", "turn", T.tool_call(t).alias("tool_call"), T.role_prefix(t).alias("role_prefix"), T.has_cjk(t).alias("cjk"), F.length(T.cut_at(t, [".", "\n"])).alias("cut_length"), T.slug(F.substring(t, 1, 40)).alias("slug"), T.estimated_tokens(t).alias("tokens"))


def corpus_summary(spark, sf):
    """Flagship: normalised, exactly deduplicated, capped by template, without benchmark leaks; accuracy by language and
    source."""
    x = items(spark, sf).withColumns({"norm": T.normalized(F.col("question")), "template": F.sha2(T.template(F.col("question")), 256)})
    x = curation.keep_best(x, ["norm"], "confidence", "id")
    x = curation.cap_per_key(x, "template", 5, "confidence", "id")
    leaks = curation.exact_leaks(x, "id", table(spark, sf, "benchmark"), "item_id")
    clean = x.join(leaks.select("id"), "id", "left_anti")
    return clean.groupBy("category", "sub_category").agg(F.count("*").alias("n"), F.count("is_correct").alias("evaluated"), F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("accuracy"))


N, TP = norm_sql("text"), template_sql("text")
RANKED = f"SELECT *, row_number() OVER (PARTITION BY {norm_sql('question')} ORDER BY confidence DESC, id) AS n FROM items"


def keyword_sql(rules, text: str, default: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({text}, '{k}')" for k in words) + f" THEN '{value}'" for value, words in rules)
    return f"CASE {cases} ELSE '{default}' END"


MINHASH = "list_transform(range(0, {p}), lambda p: list_min(list_transform(h, lambda x: ((1 + (p + 1) * 2654435761 % 2147483646) * x + (p + 1) * 1597334677 % 2147483647) % 2147483647)))"
HASHED = "list_transform(s, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT))"
ASCII = "list_distinct(CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: t[i] || chr(9247) || t[i + 1]) WHEN len(t) > 0 THEN t ELSE CAST([] AS VARCHAR[]) END)"
TOKENS = r"regexp_extract_all(lower(trim(text)), '([a-z0-9_]+|[^\p{L}\p{N}_\s])', 1)"

QUERIES = {
    "corpus_summary": (corpus_summary, f"""WITH {ITEMS}, best AS (SELECT * FROM ({RANKED}) WHERE n = 1),
      capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {template_sql('question')} ORDER BY confidence DESC, id) AS m FROM best) WHERE m <= 5),
      held AS (SELECT {N} AS nn, {TP} AS tt FROM benchmark)
      SELECT category, sub_category, count(*) AS n, count(is_correct) AS evaluated, round(avg(CAST(is_correct AS INT)), 6) AS accuracy FROM capped
      WHERE {norm_sql('question')} NOT IN (SELECT nn FROM held) AND {template_sql('question')} NOT IN (SELECT tt FROM held) GROUP BY ALL"""),
    "text_normalize": (text_normalize, f"SELECT doc_id, {N} AS norm FROM documents"),
    "template_clusters": (template_clusters, f"SELECT sha256({TP}) AS template, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"),
    "signatures": (signatures, rf"""WITH {ITEMS} SELECT id, sha256({norm_sql('question')} || '|' || {norm_sql('gold_answer')} || '|' || coalesce(category, '') || '|' || coalesce(sub_category, '')) AS exact_signature,
      sha256(lower(category) || '|' || lower(sub_category) || '|' || regexp_replace(regexp_replace(lower(question), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS unique_key, CAST(ceil(strlen(question) / 4.0) AS BIGINT) AS tokens FROM items"""),
    "exact_dedup": (exact_dedup, f"WITH {ITEMS} SELECT id, confidence FROM ({RANKED}) WHERE n = 1"),
    "template_cap": (template_cap, f"WITH {ITEMS}, k AS (SELECT *, category || '|' || difficulty AS k FROM items) SELECT id, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY confidence DESC, id) AS n FROM k) WHERE n <= 5"),
    "holdout_exact_leak": (exact_leak, f"""WITH held AS (SELECT doc_id AS item_id, text FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT item_id + 1000000000, text FROM benchmark),
      h AS (SELECT item_id, {N} AS n, {TP} AS t FROM held), d AS (SELECT doc_id AS id, {N} AS n, {TP} AS t FROM documents),
      hits AS (SELECT id, item_id, 0 AS r FROM d JOIN h USING (n) UNION ALL SELECT id, item_id, 1 FROM d JOIN h USING (t))
      SELECT id, item_id, CASE WHEN r = 0 THEN 'holdout_exact_match' ELSE 'holdout_template_match' END AS rule FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY item_id, r) = 1"""),
    "holdout_lexical_leak": (lexical_leak, f"""WITH d AS (SELECT doc_id AS id, {words_sql('text')} AS w FROM documents), h AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
      d1 AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(w) AS g FROM d) GROUP BY ALL), h1 AS (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, unnest(w) AS g FROM h) GROUP BY ALL),
      dn AS (SELECT id, count(*) AS n, sum(c * c) AS s FROM d1 GROUP BY id), hn AS (SELECT item_id, count(*) AS n, sum(c * c) AS s FROM h1 GROUP BY item_id),
      one AS (SELECT id, item_id, count(*) AS shared, sum(d1.c * h1.c) AS dot, sum(d1.c * d1.c) AS ha, sum(h1.c * h1.c) AS hb FROM d1 JOIN h1 USING (g) GROUP BY ALL),
      d2 AS (SELECT id, unnest({shingles_sql('w', 2)}) AS g FROM d), h2 AS (SELECT item_id, unnest({shingles_sql('w', 2)}) AS g FROM h),
      d2n AS (SELECT id, count(*) AS n FROM d2 GROUP BY id), h2n AS (SELECT item_id, count(*) AS n FROM h2 GROUP BY item_id),
      two AS (SELECT id, item_id, count(*) AS shared FROM d2 JOIN h2 USING (g) GROUP BY ALL),
      k AS (SELECT (ln(1.5) + 1) * (ln(1.5) + 1) AS q),
      scored AS (SELECT one.id, one.item_id, one.shared / (dn.n + hn.n - one.shared) AS unigram, one.dot / sqrt((q * dn.s - (q - 1) * ha) * (q * hn.s - (q - 1) * hb)) AS tfidf, coalesce(two.shared / (d2n.n + h2n.n - two.shared), 0.0) AS bigram
        FROM one JOIN dn USING (id) JOIN hn USING (item_id) CROSS JOIN k LEFT JOIN two ON two.id = one.id AND two.item_id = one.item_id LEFT JOIN d2n ON d2n.id = one.id LEFT JOIN h2n ON h2n.item_id = one.item_id)
      SELECT id, round(max(unigram), 6) AS unigram, round(max(bigram), 6) AS bigram, round(max(tfidf), 6) AS tfidf, round(max(greatest(unigram, bigram, tfidf)), 6) AS similarity FROM scored GROUP BY id"""),
    "holdout_containment": (holdout_containment, f"""WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), h AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
      dg AS (SELECT doc_id, unnest({shingles_sql('w', 5)}) AS g FROM d), hs AS (SELECT item_id, {shingles_sql('w', 5)} AS s FROM h), hg AS (SELECT item_id, len(s) AS size, unnest(s) AS g FROM hs)
      SELECT * FROM (SELECT doc_id, item_id, round(count(*) / any_value(size), 6) AS containment FROM dg JOIN hg USING (g) GROUP BY doc_id, item_id) WHERE containment >= 0.8"""),
    "pair_jaccard": (pair_jaccard, f"""WITH d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), s AS (SELECT doc_id, list_sort({shingles_sql('w', 2)}) AS s FROM d), f AS (SELECT s, min(doc_id) AS doc_id FROM s WHERE len(s) > 0 GROUP BY s), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM f),
      c AS (SELECT a.doc_id AS l, b.doc_id AS r, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
      SELECT l AS left, r AS right, round(k / (na + nb - k), 6) AS similarity FROM c WHERE k / (na + nb - k) >= 0.8
      UNION ALL SELECT f.doc_id, s.doc_id, 1.0 FROM s JOIN f USING (s) WHERE s.doc_id > f.doc_id"""),
    "pair_tfidf": (pair_tfidf, f"""WITH h AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark), h1 AS (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, unnest(w) AS g FROM h) GROUP BY ALL),
      n AS (SELECT item_id, sum(c * c) AS s FROM h1 GROUP BY item_id), k AS (SELECT (ln(1.5) + 1) * (ln(1.5) + 1) AS q),
      m AS (SELECT a.item_id, sum(a.c * b.c) AS dot, sum(a.c * a.c) AS ha, sum(b.c * b.c) AS hb FROM h1 a JOIN h1 b ON b.item_id = a.item_id + 1 AND a.g = b.g GROUP BY 1)
      SELECT a.item_id, round(coalesce(m.dot, 0) / sqrt((q * a.s - (q - 1) * coalesce(ha, 0)) * (q * b.s - (q - 1) * coalesce(hb, 0))), 6) AS cosine FROM n a JOIN n b ON b.item_id = a.item_id + 1 CROSS JOIN k LEFT JOIN m ON m.item_id = a.item_id"""),
    "minhash_signature": (minhash_signature, f"""WITH u AS (SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id + 1000000000, text FROM documents), x AS (SELECT item_id, {TOKENS} AS t FROM u), y AS (SELECT item_id, {ASCII} AS s FROM x),
      z AS (SELECT item_id, {HASHED} AS h FROM y) SELECT item_id, array_to_string({MINHASH.format(p=PERMUTATIONS)}, ',') AS signature FROM z"""),
    "minhash_pairs": (minhash_pairs, f"""WITH u AS (SELECT item_id, text FROM benchmark UNION ALL SELECT doc_id + 1000000000, text FROM documents), x AS (SELECT item_id, {TOKENS} AS t FROM u), y AS (SELECT item_id, {ASCII} AS s FROM x WHERE len(t) > 0), h AS (SELECT item_id, {HASHED} AS h FROM y),
      z AS (SELECT item_id, {MINHASH.format(p=PERMUTATIONS)} AS sig FROM h), c AS (SELECT sig, min(item_id) AS first FROM z GROUP BY sig),
      b AS (SELECT first, sig, k, array_to_string(sig[k * 4 + 1 : k * 4 + 4], ',') AS v FROM c, range(0, {PERMUTATIONS // 4}) r(k)), m AS (SELECT DISTINCT a.first AS l, b.first AS r, a.sig AS sa, b.sig AS sb FROM b a JOIN b ON a.k = b.k AND a.v = b.v AND a.first < b.first),
      s AS (SELECT l, r, len(list_filter(range(1, {PERMUTATIONS + 1}), lambda i: sa[i] = sb[i])) / {PERMUTATIONS} AS similarity FROM m)
      SELECT l AS left, r AS right, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.78 UNION ALL SELECT c.first, z.item_id, 1.0 FROM z JOIN c USING (sig) WHERE z.item_id > c.first"""),
    "minhash_pairs_all": (minhash_pairs_all, None),
    "embedding_topk": (embedding_topk, """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS match, list_cosine_similarity(a.v, b.v) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
      SELECT query, match, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match) AS rank FROM s) WHERE rank <= 5"""),
    "greedy_near_dedup": (greedy_near_dedup, None),
    "training_overlap_audit": (structure_audit, f"""WITH a AS (SELECT doc_id, {N} AS n, {TP} AS t FROM documents), i AS (SELECT *, min(doc_id) OVER (PARTITION BY n) AS f FROM a WHERE doc_id % 5 = 0), tr AS (SELECT * FROM a WHERE doc_id % 5 <> 0),
      x AS (SELECT doc_id, CASE WHEN f < doc_id THEN f END AS duplicate_of, n <> '' AND n IN (SELECT n FROM tr) AS in_training_norm, t <> '' AND t IN (SELECT t FROM tr) AS in_training_template FROM i)
      SELECT *, CASE WHEN in_training_norm OR in_training_template THEN 'leaked' WHEN duplicate_of IS NOT NULL THEN 'duplicate' ELSE 'other' END AS status FROM x"""),
    "paragraphs": (paragraphs, """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(p)) AS BIGINT) AS chars FROM l WHERE len(string_split(trim(p), ' ')) > 2 AND len(string_split(p, '.')) > 2 GROUP BY doc_id"""),
    "taxonomy_classify": (taxonomy_classify, f"SELECT conv_id, turn, {keyword_sql(X.CATEGORY_WORDS, 'lower(text)', 'Arithmetic')} AS category, {keyword_sql([(r[2], r[3]) for r in X.IMPORT_RULES], 'lower(text)', 'arithmetic_fallback')} AS rule FROM conversations"),
    "anti_join_new_text": (new_text, f"WITH n AS (SELECT doc_id, {N} AS n FROM documents) SELECT min(doc_id) AS doc_id FROM n WHERE doc_id % 2 = 1 AND n NOT IN (SELECT n FROM n AS m WHERE m.doc_id % 2 = 0) GROUP BY n"),
    "response_checks": (response_checks, rf"""SELECT a.conv_id, a.turn, regexp_matches(a.text, '(?i){'|'.join(T.TOOL_PATTERNS)}') AS tool_call, regexp_matches(a.text, '{T.ROLE_PREFIX}') AS role_prefix, regexp_matches(a.text, '[\x{{3400}}-\x{{9fff}}]') AS cjk,
      length(regexp_extract(a.text, '^[^.\n]*')) AS cut_length, regexp_replace(regexp_replace(lower(substr(a.text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CAST(ceil(strlen(a.text) / 4.0) AS BIGINT) AS tokens
      FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user'"""),
}
