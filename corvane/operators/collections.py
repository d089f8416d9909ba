"""Blind sets, guidance examples and typed error attribution."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import answers as A
from ..functions import text as T
from .common import staged
from .curation import greedy_keep
from .pairs import class_links, set_classes
from .split import first_per_bucket, stable_rank

# Operation words whose shared presence makes overlapping structures a collision.
OPERATIONS = ("differentiate", "integrate", "derivative", "integral", "matrix", "probability", "solve")


def keyed_minhash(permutations: int, seed: int = 42):
    """A column function from shingles to a signature of keyed 64-bit BLAKE2 minima; no shingles give zeros."""

    @F.pandas_udf(ArrayType(LongType()))
    def signature(items: pd.Series) -> pd.Series:
        people = [f"ab{seed & 0xFFFF:04x}{p & 0xFFFF:04x}".encode() for p in range(permutations)]
        digest = lambda x, p: int.from_bytes(hashlib.blake2b(x, digest_size=8, person=p).digest(), "big", signed=False)
        out = []
        for row in items:
            data = [s.encode() for s in row] if row is not None else []
            found = [min((digest(x, p) for x in data), default=0) for p in people]
            out.append([v - (1 << 64) if v >= 1 << 63 else v for v in found])
        return pd.Series(out)

    return signature


def collision_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """What the collision rules compare: normalised text n, template t, words in order, words w and word pairs p, structure s with its
    operation words o (s is empty where there is none, since it then collides with nothing)."""
    parts = F.array_distinct(F.filter(F.split(T.structure_signature(F.col(text)), "\\|"), lambda t: t != ""))
    words = T.words(F.col(text))
    found = df.select(F.col(key).alias("id"), T.normalized(F.col(text)).alias("n"), T.template(F.col(text)).alias("t"), F.array_distinct(words).alias("w"), words.alias("words"), T.shingles(words, 2).alias("p"), parts.alias("parts"))
    return found.select("id", "n", "t", "words", "w", "p", F.when(F.exists("parts", lambda x: x.isin(*OPERATIONS)), F.col("parts")).otherwise(F.array().cast("array<string>")).alias("s"))


def rule_links(keys: DataFrame, column: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """members (set_key, id) and links (x, y) of the classes of equal sets of ``column``; of structures, links that share an
    operation."""
    tokens, grams = ("words", 2) if column == "p" else (column, 1)
    members, sets = set_classes(keys, "id", tokens, threshold, grams)
    links = class_links(sets, keys, "id", tokens, threshold, grams)
    if column == "s":
        named = keys.where(F.size("s") > 0).select("id", F.filter("s", lambda t: t.isin(*OPERATIONS)).alias("operations"))
        by_set = sets.select("set_key", "id").join(named.dropDuplicates(["id"]), "id")
        of = lambda k, v: by_set.select(F.col("set_key").alias(k), F.col("operations").alias(v))
        links = links.join(of("x", "_x"), "x").join(of("y", "_y"), "y").where(F.arrays_overlap("_x", "_y"))
    return members, staged(links.select("x", "y"))


def _mark(kind: str, *c: str) -> Column:
    return F.concat(F.lit(kind), F.md5(F.concat_ws("\x1f", *c)))


def _marks(keys: DataFrame) -> DataFrame:
    """(id, n, t): digests of the text and of the template, null of an empty template."""
    return keys.select("id", F.md5("n").alias("n"), F.when(F.col("t") != "", F.md5("t")).alias("t"))


def _rules(keys: DataFrame, near: float, overlap: float) -> dict[str, tuple[DataFrame, DataFrame]]:
    return {column: rule_links(keys, column, threshold) for column, threshold in (("w", near), ("p", near), ("s", overlap))}


def _set_groups(rules: dict[str, tuple[DataFrame, DataFrame]]) -> list[DataFrame]:
    """(id, group) of the classes of equal sets, and of each link of two of them."""
    found = []
    for column, (members, links) in rules.items():
        found.append(members.select("id", _mark(column, "set_key").alias("group")))
        for end in ("x", "y"):
            found.append(members.join(links.withColumn("set_key", F.col(end)), "set_key").select("id", _mark(f"{column}2", "x", "y").alias("group")))
    return found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def collision_groups(keys: DataFrame, near: float = 0.85, overlap: float = 0.8) -> DataFrame:
    """(id, group): rows of one group collide with each other, and all that collide share one: equal text, equal template,
    structures that overlap in an operation, similar words or word pairs. Copies add a row to a group, not a pair with each
    other; a link of two classes of equal sets is a group of both."""
    marks = _marks(keys)
    equal = [marks.select("id", F.concat(F.lit("n"), "n").alias("group")), marks.where("t IS NOT NULL").select("id", F.concat(F.lit("t"), "t").alias("group"))]
    return _union(equal + _set_groups(_rules(keys, near, overlap)))


def _sided(keys: DataFrame, prior: DataFrame) -> DataFrame:
    """Both with ids of one kind: struct<side, id>, side 1 of the prior ones."""
    side = lambda df, k: df.select(F.struct(F.lit(k).alias("side"), F.col("id").cast("string").alias("id")).alias("id"), "n", "t", "words", "w", "s")
    return side(keys, 0).unionByName(side(prior, 1))


def _hits(marks: DataFrame, rules: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(id) of the rows of side 0 that collide with one of side 1."""
    found = []
    for c in ("n", "t"):
        found.append(marks.where("id.side = 0").join(marks.where("id.side = 1").select(c).distinct(), c, "left_semi").select("id"))
    for members, links in rules.values():
        earlier = members.where("id.side = 1").select("set_key").distinct()
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.join(earlier.withColumnRenamed("set_key", "y"), "y", "left_semi").select(F.col("x").alias("set_key"))
        found.append(members.where("id.side = 0").join(earlier.unionByName(near).distinct(), "set_key", "left_semi").select("id"))
    return _union(found).distinct()


def colliding(keys: DataFrame, prior: DataFrame, near: float = 0.85, overlap: float = 0.8) -> DataFrame:
    """(id) of the rows of ``keys`` that collide with a row of ``prior`` by any rule."""
    both = _sided(keys, prior)
    return _hits(_marks(both), _rules(both, near, overlap)).select(F.col("id.id").cast(keys.schema["id"].dataType).alias("id"))


def blind_set(items: DataFrame, prior: DataFrame, key: str, prior_key: str, bucket: list[str], per_bucket: int, seed: int = 42, text: str = "question") -> DataFrame:
    """Items that collide with no prior one nor with a kept safe item of smaller key, ``per_bucket`` of each bucket by hash.
    Links are found once, over items and prior ones together. Items of equal text collide with the same ones, so only the
    first of them can stay and only it is a node of the choice. Texts are read and never written."""
    both = _sided(collision_keys(items, key, text), collision_keys(prior, prior_key, text))
    marks = staged(_marks(both))
    rules = _rules(both, 0.85, 0.8)
    own = F.col("id.id").cast(items.schema[key].dataType)
    safe = marks.where("id.side = 0").join(_hits(marks, rules), "id", "left_anti")
    nodes = staged(safe.groupBy("n").agg(F.min(own).alias("rank"), F.first("t").alias("t")).select("rank", "t"))
    held = {}
    for column, (members, links) in rules.items():
        left = staged(members.where("id.side = 0").select("set_key", own.alias("id")).join(nodes.select(F.col("rank").alias("id")), "id", "left_semi"))
        there = left.select("set_key").distinct()
        held[column] = left, links.join(there.withColumnRenamed("set_key", "x"), "x", "left_semi").join(there.withColumnRenamed("set_key", "y"), "y", "left_semi")
    groups = _union([nodes.where("t IS NOT NULL").select(F.col("rank").alias("id"), F.concat(F.lit("t"), "t").alias("group")), *_set_groups(held)])
    kept = greedy_keep(nodes.select("rank"), None, groups=groups.withColumnRenamed("id", "rank")).where("kept")
    return first_per_bucket(items.join(kept.select(F.col("rank").alias(key)), key), bucket, per_bucket, stable_rank(seed, F.col(key)))


def guidance(items: DataFrame, bucket: list[str], key: str, features: list[str], n: int = 10, threshold: float = 0.85, text: str = "question", seed: int = 42) -> DataFrame:
    """Up to n examples of each bucket that are unlike each other and spread over ``features``: the most unseen values
    first, then the rarer ones, then by hash. Buckets run side by side; one bucket's choice is sequential by nature."""
    x = items.withColumns({"_n": T.normalized(F.col(text)), "_t": T.template(F.col(text)), "_1": T.shingles(T.words(F.col(text)), 1), "_2": T.shingles(T.words(F.col(text)), 2), "_h": stable_rank(seed, F.col(key))})

    names, schema = items.columns, items.schema

    def similar(a: set, b: set) -> float:
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(f.to_dict("records"), key=lambda r: r["_h"])
        for r in rows:
            r["_1"], r["_2"] = set(r["_1"]), set(r["_2"])
        used: dict = {}
        chosen: list[dict] = []
        while rows and len(chosen) < n:
            best = max(rows, key=lambda r: (*[not used.get((c, r[c])) for c in features], *[-used.get((c, r[c]), 0) for c in features], r["_h"]))
            chosen.append(best)
            for c in features:
                used[c, best[c]] = used.get((c, best[c]), 0) + 1
            rows = [r for r in rows if r is not best and r["_n"] != best["_n"] and (not r["_t"] or r["_t"] != best["_t"]) and max(similar(r["_1"], best["_1"]), similar(r["_2"], best["_2"])) < threshold]
        return pd.DataFrame([{c: r[c] for c in names} for r in chosen], columns=names)

    return x.groupBy(*bucket).applyInPandas(run, schema)


def attributed_error(gold: Column, predicted: Column, kind: Column) -> Column:
    """The first error pattern of a wrong answer of its type: format only, unit, matrix or vector entries, missing or extra
    set members, choices, and the numeric signatures; unknown_error where no rule speaks."""
    numeric = A.error_signature(A.number(A.candidate(gold), False), A.number(A.candidate(predicted), False))
    gu, pu = A.unit_value(gold), A.unit_value(predicted)
    gi, pi = F.transform(A.items(gold), A.item_key), F.transform(A.items(predicted), A.item_key)
    gm, pm = A.matrix(gold), A.matrix(predicted)
    squeezed = lambda c: F.regexp_replace(F.lower(A.clean(c)), r"\s+", "")
    rules = (
        (predicted.isNull() | (F.trim(predicted) == ""), "parse_failed"),
        (T.tool_call(predicted), "tool_violation"),
        (squeezed(gold) == squeezed(predicted), "format_only_difference"),
        ((kind == "unit_value") & (gu["unit"] != pu["unit"]), "unit_mismatch"),
        ((kind == "multiple_choice") & ~F.upper(A.clean(predicted)).rlike("^[A-E]$"), "invalid_multiple_choice"),
        ((kind == "matrix") & gm.isNotNull() & pm.isNotNull(), "matrix_element_error"),
        (kind.isin("vector", "ordered_tuple") & (F.size(gi) == F.size(pi)), "vector_component_error"),
        (kind.isin("set", "unordered_collection") & (F.size(F.array_except(pi, gi)) == 0), "incomplete_solution"),
        (kind.isin("set", "unordered_collection") & (F.size(F.array_except(gi, pi)) == 0), "extraneous_solution"),
        (kind.isin("integer", "decimal", "rational", "percentage") & (numeric != "none"), None),
        (kind.isin("symbolic_expression", "equation", "inequality"), "symbolic_manipulation_error"),
    )
    out = None
    for case, tag in rules:
        value = numeric if tag is None else F.lit(tag)
        out = F.when(case, value) if out is None else out.when(case, value)
    return out.otherwise("unknown_error")
