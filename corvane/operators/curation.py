"""From graded items to a training set: rejection, leakage, dedup, caps and the mix of sources."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .common import cut, reasons, staged
from .pairs import class_links, set_classes

# The wanted shares of sources among wrong answers.
WRONG_MIX = (("boundary", 0.55), ("repair", 0.15), ("format", 0.05))


def rejection_reasons(columns: list[str], least_confidence: float = 0.8) -> Column:
    """All reasons to reject an item, of the conditions whose columns exist; missing flags are unproblematic, an explicit
    null confidence is not."""
    has = set(columns)
    c = F.col
    flag = lambda name, wanted: F.coalesce(c(name), F.lit(wanted)) != wanted
    cases: list[tuple[Column, str]] = []
    rules = (
        ("question", lambda: F.trim(F.coalesce(c("question"), F.lit(""))) == "", "missing_question"),
        ("gold_answer", lambda: F.trim(F.coalesce(c("gold_answer").cast("string"), F.lit(""))) == "", "missing_gold_answer"),
        ("question_parse_success", lambda: flag("question_parse_success", True), "question_parse_failed"),
        ("answer_validation_success", lambda: flag("answer_validation_success", True), "answer_validation_failed"),
        ("evaluator_confidence", lambda: F.coalesce(c("evaluator_confidence"), F.lit(0.0)) < least_confidence, "low_evaluator_confidence"),
        ("tool_violation", lambda: flag("tool_violation", False), "tool_violation"),
        ("ambiguous", lambda: flag("ambiguous", False), "ambiguous"),
        ("contains_prompt_echo", lambda: flag("contains_prompt_echo", False), "prompt_echo"),
        ("contains_irrelevant_content", lambda: flag("contains_irrelevant_content", False), "irrelevant_content"),
        ("evaluation_role", lambda: F.coalesce(c("evaluation_role"), F.lit("")).isin("blind", "official"), "evaluation_role"),
        ("equivalence_needs_review", lambda: flag("equivalence_needs_review", False), "needs_review"),
        ("evaluation_status", lambda: F.coalesce(c("evaluation_status"), F.lit("ok")) != "ok", "evaluation_failed"),
        ("is_correct", lambda: c("is_correct").isNull(), "not_evaluated"),
    )
    for name, make, code in rules:
        if name in has:
            cases.append((make(), code))
    return reasons(*cases)


def keep_best(df: DataFrame, keys: list[str], quality: str, position: str) -> DataFrame:
    """Of rows with equal keys the one of best quality, the first of equals."""
    w = W.partitionBy(*keys).orderBy(F.desc(quality), position)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_key(df: DataFrame, key: str, cap: int, quality: str, position: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(quality), position)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def exact_leaks(items: DataFrame, key: str, holdout: DataFrame, holdout_key: str, text: str = "question", holdout_text: str = "text") -> DataFrame:
    """(key, holdout_key, rule): the first holdout, in order of its key, that equals the item's normalised text or its
    template; of one holdout the exact rule goes first. Items without any hit are absent."""
    h = holdout.select(F.col(holdout_key), T.normalized(F.col(holdout_text)).alias("n"), T.template(F.col(holdout_text)).alias("t"))
    i = items.select(F.col(key), T.normalized(F.col(text)).alias("n"), T.template(F.col(text)).alias("t"))
    exact = i.join(h.select(holdout_key, "n"), "n").select(key, holdout_key, F.lit(0).alias("r"))
    alike = i.join(h.select(holdout_key, "t"), "t").select(key, holdout_key, F.lit(1).alias("r"))
    first = exact.unionByName(alike).groupBy(key).agg(F.min(F.struct(holdout_key, "r")).alias("m"))
    return first.select(key, f"m.{holdout_key}", F.when(F.col("m.r") == 0, "holdout_exact_match").otherwise("holdout_template_match").alias("rule"))


def lexical_scores(items: DataFrame, key: str, holdout: DataFrame, holdout_key: str, text: str = "question", holdout_text: str = "text") -> DataFrame:
    """(key, holdout_key, unigram, bigram, tfidf, similarity) of every pair that shares a word; similarity is the largest.
    The scores are sums over shared words and word pairs, so they come from equi-joins and aggregations alone."""
    alone = math.log(1.5) + 1

    def side(df: DataFrame, k: str, c: str, n: int) -> DataFrame:
        grams = T.words(F.col(c)) if n == 1 else T.shingles(T.words(F.col(c)), 2)
        flat = df.select(F.col(k), F.explode(grams).alias("g")).groupBy(k, "g").agg(F.count("*").cast("double").alias("c"))
        w = W.partitionBy(k)
        return flat.withColumns({"size": F.count("*").over(w), "squares": F.sum(F.col("c") * F.col("c")).over(w)})

    def met(n: int) -> DataFrame:
        a = side(items, key, text, n).withColumnsRenamed({"c": "ca", "size": "na", "squares": "sa"})
        b = side(holdout, holdout_key, holdout_text, n).withColumnsRenamed({"c": "cb", "size": "nb", "squares": "sb"})
        first = lambda c: F.max(c).alias(c)
        return a.join(b, "g").groupBy(key, holdout_key).agg(first("na"), first("nb"), first("sa"), first("sb"), F.count("*").alias("shared"), F.sum(F.col("ca") * F.col("cb")).alias("dot"), F.sum(F.col("ca") * F.col("ca")).alias("ha"), F.sum(F.col("cb") * F.col("cb")).alias("hb"))

    jaccard = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    norm = lambda s, h: alone**2 * F.col(s) - (alone**2 - 1) * F.col(h)
    one = met(1).select(key, holdout_key, jaccard.alias("unigram"), (F.col("dot") / F.sqrt(norm("sa", "ha") * norm("sb", "hb"))).alias("tfidf"))
    two = met(2).select(key, holdout_key, jaccard.alias("bigram"))
    both = one.join(two, [key, holdout_key], "left").withColumn("bigram", F.coalesce("bigram", F.lit(0.0)))
    return both.withColumn("similarity", F.greatest("unigram", "bigram", "tfidf"))


def near_leaks(items: DataFrame, key: str, holdout: DataFrame, holdout_key: str, threshold: float = 0.85, text: str = "question", holdout_text: str = "text") -> DataFrame:
    """(key, holdout_key, similarity): the first holdout, in order of its key, whose lexical score reaches ``threshold``."""
    scored = lexical_scores(items, key, holdout, holdout_key, text, holdout_text).where(F.col("similarity") >= threshold)
    return scored.groupBy(key).agg(F.min(F.struct(holdout_key, "similarity")).alias("m")).select(key, f"m.{holdout_key}", "m.similarity")


def greedy_keep(nodes: DataFrame, edges: DataFrame | None, most_rounds: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(rank, kept): the first maximal independent set in order of ``nodes.rank``, unique values. ``edges`` (a, b) join two
    ranks, ``groups`` (rank, group) join all ranks of a group, without a row for each pair of them. In each round a node that
    is the first open one of all its groups stays, and the others of these go. Rounds are checkpointed and add up minima by group
    only; nothing but their emptiness reaches the driver. Each round decides the first open node at least, so they end; with
    ``most_rounds``, groups that are open after so many raise an error."""
    joined = []
    if edges is not None:
        pairs = edges.where("a <> b").select("a", "b", F.concat_ws(" ", F.xxhash64(F.lit("p"), F.least("a", "b"), F.greatest("a", "b")), F.xxhash64(F.lit("q"), F.least("a", "b"), F.greatest("a", "b"))).alias("group"))
        joined += [pairs.select(F.col(end).alias("rank"), F.concat(F.lit("pair "), "group").alias("group")) for end in ("a", "b")]
    if groups is not None:
        joined.append(groups.select("rank", F.col("group").cast("string").alias("group")))
    left = joined[0]
    for more in joined[1:]:
        left = left.unionByName(more)
    left = cut(left.distinct())
    dropped = None
    rounds = 0
    while True:
        first = left.groupBy("group").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last")
        rows = cut(left.join(first.select("group", "first"), "group"))
        if rows.isEmpty():
            break
        if rounds == most_rounds:
            raise RuntimeError("greedy choice did not settle")
        rounds += 1
        sure = cut(rows.groupBy("rank").agg(F.max(F.col("rank") != F.col("first")).alias("waits")).where(~F.col("waits")).select("rank"))
        gone = cut(rows.where(F.col("rank") != F.col("first")).join(sure.withColumnRenamed("rank", "first"), "first", "left_semi").select("rank").distinct())
        left = cut(rows.select("rank", "group").join(sure.unionByName(gone), "rank", "left_anti"))
        dropped = gone if dropped is None else cut(dropped.unionByName(gone))
    if dropped is None:
        return nodes.select("rank", F.lit(True).alias("kept"))
    return nodes.select("rank").join(dropped.withColumn("_gone", F.lit(True)), "rank", "left").select("rank", F.col("_gone").isNull().alias("kept"))


def first_wins(df: DataFrame, key: str, tokens: str, rank: list[Column], threshold: float, grams: int = 1) -> DataFrame:
    """(key, kept): greedy near-duplicate removal, in order of ``rank`` (ascending, ending with a unique column): a row is
    dropped if a kept one before it has a token set of at least ``threshold``. Rows of equal sets are neighbours of the same
    rows, so only the first of each set can stay and only the sets are linked, never all their copies."""
    x = df.select(F.col(key).alias("id"), F.struct(*rank).alias("rank"), F.col(tokens).alias("tokens"))
    members, sets = set_classes(x, "rank", "tokens", threshold, grams)
    links = staged(class_links(sets, x, "rank", "tokens", threshold, grams))
    first = staged(members.groupBy("set_key").agg(F.min("id").alias("first")))
    of = lambda end, name: first.select(F.col("set_key").alias(end), F.col("first").alias(name))
    edges = staged(links.join(of("x", "a"), "x").join(of("y", "b"), "y").select("a", "b"))
    linked = edges.select(F.col("a").alias("rank")).unionByName(edges.select(F.col("b").alias("rank"))).distinct()
    gone = greedy_keep(linked, edges).where(~F.col("kept")).select("rank")
    later = members.join(first, "set_key").where("id <> first").select(F.col("id").alias("rank"))
    lost = gone.unionByName(later).distinct().withColumn("_lost", F.lit(True))
    return x.select("id", "rank").join(lost, "rank", "left").select(F.col("id").alias(key), F.col("_lost").isNull().alias("kept"))


def near_unique(df: DataFrame, key: str, text: str, quality: str, threshold: float = 0.9) -> DataFrame:
    """Rows without those whose word pairs have a Jaccard similarity of ``threshold`` to a kept row of better quality, the
    smaller key of equals."""
    x = cut(df)
    marked = x.select(F.col(key), F.col(quality), T.words(F.col(text)).alias("s"))
    kept = first_wins(marked, key, "s", [(-F.col(quality)).alias("q"), F.col(key).alias("k")], threshold, 2)
    return x.join(kept.where("kept").select(key), key, "left_semi")


def mix_targets(correct: int, wrong: int, share_correct: float = 0.25, block: int = 4) -> tuple[int, int]:
    """How many correct and wrong items make whole blocks of the wanted share."""
    from fractions import Fraction

    f = Fraction(share_correct).limit_denominator(100)
    c, b = f.numerator, f.denominator
    if c == 0 or c == b:
        return (0, wrong) if c == 0 else (correct, 0)
    blocks = min(correct // c, wrong // (b - c), (correct + wrong) // b)
    return blocks * c, blocks * (b - c)


def remainder_shares(total: int, weights: list[tuple[str, float]]) -> dict[str, int]:
    """Largest-remainder apportionment of a small list; ties go to the smaller name."""
    size = sum(w for _, w in weights) or 1.0
    exact = {k: total * w / size for k, w in weights}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def select_mix(df: DataFrame, source: str, quality: str, signature: str, share_correct: float = 0.25) -> DataFrame:
    """Items of a strict ratio of correct to wrong ones. The wrong quota is split over its sources; what one lacks is
    filled from the other wrong items by quality, so the ratio holds whenever whole blocks exist."""
    counts = {r[source]: r["n"] for r in df.groupBy(source).agg(F.count("*").alias("n")).collect()}
    wrong = sum(n for k, n in counts.items() if k != "correct")
    want_correct, want_wrong = mix_targets(counts.get("correct", 0), wrong, share_correct)
    quota = remainder_shares(want_wrong, list(WRONG_MIX)) | {"correct": want_correct}
    wanted = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(source).orderBy(F.desc(quality), signature)))
    ranked = ranked.withColumn("_in", F.col("_n") <= F.coalesce(F.try_element_at(wanted, F.col(source)), F.lit(0)))
    missing = want_wrong - sum(min(counts.get(k, 0), n) for k, n in quota.items() if k != "correct")
    # The fill is at most the missing number, taken over all wrong items that are left.
    spare = ranked.where(~F.col("_in") & (F.col(source) != "correct")).orderBy(F.desc(quality), signature).limit(max(0, missing))
    return ranked.where("_in").unionByName(spare).drop("_n", "_in")


def training_rows(df: DataFrame) -> DataFrame:
    """Instruction, input and output rows with metadata."""
    return df.select(F.lit("Solve the problem. Give the reasoning and the final answer.").alias("instruction"), F.col("question").alias("input"), F.col("gold_answer").cast("string").alias("output"), F.struct(*[F.col(c) for c in ("training_source", "exact_signature", "template_signature", "category", "sub_category", "difficulty") if c in df.columns]).alias("_metadata"))
