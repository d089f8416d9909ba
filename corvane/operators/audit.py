"""Audits of evaluation sets: overlap with training data, duplicates, coverage and the assembly of official sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .common import reasons, require_none


def flags(items: DataFrame, key: str, text: str, training: DataFrame, training_text: str) -> DataFrame:
    """By item: the first item with the same normalised text, and whether its text, template or structure is in training."""
    x = items.select(F.col(key), T.normalized(F.col(text)).alias("norm"), T.template(F.col(text)).alias("template"), T.structure_signature(F.col(text)).alias("structure"))
    first = F.min(key).over(W.partitionBy("norm"))
    x = x.withColumn("duplicate_of", F.when(first < F.col(key), first))
    t = training.select(T.normalized(F.col(training_text)).alias("norm"), T.template(F.col(training_text)).alias("template"), T.structure_signature(F.col(training_text)).alias("structure"))
    for c in ("norm", "template", "structure"):
        seen = t.where(F.col(c) != "").select(c).distinct().withColumn(f"in_training_{c}", F.lit(True))
        x = x.join(seen, c, "left").withColumn(f"in_training_{c}", F.coalesce(f"in_training_{c}", F.lit(False)))
    return x.select(key, "duplicate_of", "in_training_norm", "in_training_template", "in_training_structure")


def status(near: Column, threshold: float = 0.85) -> Column:
    """Leaked, duplicate, suspicious or clean."""
    why = reasons((F.col("in_training_norm"), "exact"), (F.col("in_training_template"), "template"), (near >= threshold, "near"))
    return F.when(F.size(why) > 0, "leaked").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("in_training_structure"), "suspicious").otherwise("clean")


def group_diversity(items: DataFrame, keys: list[str], features: dict[str, str]) -> DataFrame:
    """By group the number of items and of distinct values of each feature."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(name) for name, c in features.items()])


def oversized(items: DataFrame, key: str, cap: int) -> DataFrame:
    return items.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap)


def human_resolution(reviews: Column) -> Column:
    """verified, rejected, disputed or unreviewed, of array<struct<reviewer, verdict, adjudication>>: two reviewers who
    agree, or someone else's adjudication."""
    voters = F.filter(reviews, lambda r: ~r["adjudication"])
    people = F.array_distinct(F.transform(voters, lambda r: r["reviewer"]))
    verdicts = F.array_distinct(F.transform(voters, lambda r: r["verdict"]))
    judges = F.filter(reviews, lambda r: r["adjudication"] & ~F.array_contains(people, r["reviewer"]))
    final = F.when(F.size(judges) > 0, F.element_at(judges, -1)["verdict"]).when((F.size(people) >= 2) & (F.size(verdicts) == 1), verdicts[0])
    return F.when(F.size(F.coalesce(reviews, F.array())) == 0, "unreviewed").when(final.isNull(), "disputed").when(final, "verified").otherwise("rejected")


def assemble(items: DataFrame, taxonomy: DataFrame, keys: list[str], near: DataFrame, template: str, cap: int, text: str) -> DataFrame:
    """The official set, or an error: every group covered, no template too often, no two items alike, no empty text."""
    require_none(items.where(F.trim(F.coalesce(F.col(text), F.lit(""))) == ""), "items without text")
    require_none(taxonomy.select(*keys).join(items.select(*keys).distinct(), keys, "left_anti"), "groups without items")
    require_none(oversized(items, template, cap), "templates above the cap")
    require_none(near, "near-duplicate items")
    return items


def validated(df: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with the reasons against them."""
    x = df.withColumn("reasons", reasons(*checks))
    return x.where(F.size("reasons") == 0).drop("reasons"), x.where(F.size("reasons") > 0)


def forbidden_fields(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of forbidden names anywhere in a schema."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    found: list[str] = []

    def walk(kind, path: str) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                here = f"{path}.{f.name}".lstrip(".")
                if f.name in names:
                    found.append(here)
                walk(f.dataType, here)
        elif isinstance(kind, ArrayType):
            walk(kind.elementType, f"{path}[]")
        elif isinstance(kind, MapType):
            walk(kind.valueType, f"{path}{{}}")

    walk(df.schema, "")
    return found
