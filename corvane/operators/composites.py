"""Composite reports: the tables of a study, review evaluation, calibration, matched training data and difficulty matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import agreement, calibration, stats, summary
from .common import cut, require_none

# The methods of the ablation table, and the scale of each raw difficulty dimension.
ABLATIONS = ("full", "full_no_hard_pool", "full_no_error_targeting", "full_no_observed_difficulty_sampling", "full_no_difficulty_module", "full_no_coverage_priority", "full_no_uncertainty_priority", "full_no_global_difficulty", "full_no_retention_priority")
SCALES = {"reasoning_steps": 10.0, "operation_count": 20.0, "constraint_count": 10.0, "symbolic_depth": 10.0, "representation_load": 10.0}


def run_summary(rows: DataFrame, run: list[str], item: str = "question_id", sub: str = "sub_category", cycle: str = "cycle", correct: str = "is_correct") -> DataFrame:
    """By run: accuracy in the last cycle, the mean and the least accuracy of its subcategories, the area under the learning
    curve, and the share of the items right in the first cycle that are wrong or absent in the last."""
    last = stats.final_rows(rows, run, cycle)
    final = last.groupBy(*run).agg(F.count("*").alias("questions"), F.avg(F.col(correct).cast("double")).alias("final_accuracy"))
    subs = last.groupBy(*run, sub).agg(F.avg(F.col(correct).cast("double")).alias("a")).groupBy(*run).agg(F.avg("a").alias("macro_accuracy"), F.min("a").alias("worst_subcategory_accuracy"))
    curve = stats.curve_area(summary.accuracy_rows(rows, [*run, cycle], correct), run, cycle, "accuracy").withColumnRenamed("auc", "learning_curve_auc")
    lost = stats.forgetting(rows, run, item, cycle, correct).select(*run, "forgetting_rate")
    return final.join(subs, run).join(curve, run, "left").join(lost, run, "left")


METRICS = ("macro_accuracy", "worst_subcategory_accuracy", "learning_curve_auc", "forgetting_rate")


def main_results(runs: DataFrame, cell: list[str], method: str, base: str) -> DataFrame:
    """By cell and method over the runs' seeds: the summary of the final accuracy, the base method's mean and the difference to
    it, and the means of the other metrics; runs without a metric don't count in its mean."""
    keys = [*cell, method]
    x = stats.summarize(runs, keys, "final_accuracy").join(runs.groupBy(*keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in METRICS]), keys)
    to_base = x.where(F.col(method) == base).select(*cell, F.col("mean").alias("base_mean_accuracy"))
    x = x.join(to_base, cell, "left") if cell else x.join(F.broadcast(to_base), how="left")  # one row, or none
    return x.withColumn("mean_delta_vs_base", F.col("mean") - F.col("base_mean_accuracy"))


def significance(rows: DataFrame, cell: list[str], method: str, item: str, correct: str, comparisons: list[tuple[str, str]]) -> DataFrame:
    """By comparison: exact McNemar tests of each cell combined by Fisher's rule and corrected by Holm's."""
    tests = stats.mcnemar(stats.paired(rows, cell, method, item, correct, comparisons), [*cell, "left_method", "right_method"])
    both = stats.fisher(tests, ["left_method", "right_method"], "p_value")
    return stats.holm(both, "combined_p", ["left_method", "right_method"])


def paper_tables(rows: DataFrame, base: str, comparisons: list[tuple[str, str]], method: str = "method", seed: str = "seed") -> dict[str, DataFrame]:
    """The eight tables of a study from its long results (method, seed, cycle, question_id, category, sub_category, difficulty,
    is_correct)."""
    last = stats.final_rows(rows, [method, seed], "cycle")
    runs = cut(run_summary(rows, [method, seed]))
    main = cut(main_results(runs, [], method, base))
    across = lambda dimension: stats.two_level(last, [method, dimension], seed, "is_correct")
    return {
        "results_long": rows,
        "run_summary": runs,
        "main_results": main,
        "ablation_results": main.where(F.col(method).isin(*ABLATIONS)),
        "category_results": across("category"),
        "difficulty_results": across("difficulty"),
        "efficiency_results": runs.select(method, seed, "questions", "final_accuracy"),
        "significance_tests": significance(last, [seed], method, "question_id", "is_correct", comparisons),
    }


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Writes each table as CSV under ``folder``, arrays as JSON, and returns the rows of each."""
    done = {}
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        done[name] = df.sparkSession.read.option("header", True).csv(f"{folder}/{name}").count()
    return done


def measured(df: DataFrame, names: list[str]) -> DataFrame:
    """One row's numbers as rows (metric, value)."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")


def review_report(reviews: DataFrame, least: dict[str, float] | None = None) -> DataFrame:
    """(metric, value) of a reviewed attribution (one, two, system, is_correct, confidence, review, evidence, weight):
    agreement of the reviewers, the system's scores by label and their means against the first, selective accuracy, and
    gates (1: passed) where ``least`` asks for them."""
    reviews = cut(reviews)
    kappa = measured(agreement.cohen_kappa(reviews, "one", "two", "weight"), ["observed", "expected", "kappa"])
    labels = agreement.label_scores(reviews, "one", "system", "weight")
    macro = measured(labels.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1")), ["macro_precision", "macro_recall", "macro_f1"])
    by_label = labels.select(F.concat(F.lit("f1:"), F.coalesce("label", F.lit(""))).alias("metric"), F.col("f1").cast("double").alias("value"))
    names = ["accuracy", "selective_coverage", "selective_accuracy", "evidence_coverage", "brier", "high_confidence_accuracy"]
    found = kappa.unionByName(by_label).unionByName(macro).unionByName(measured(agreement.selective(reviews, "is_correct", "confidence", "review", "evidence", "weight"), names))
    if not least:
        return found
    asked = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    gates = found.where(F.col("metric").isin(*least)).select(F.concat(F.lit("gate:"), "metric").alias("metric"), (F.col("value") >= F.element_at(asked, F.col("metric"))).cast("double").alias("value"))
    return found.unionByName(gates)


def calibration_report(items: DataFrame, panel: DataFrame, models: DataFrame, item: str = "item", model: str = "model", predicted: str = "predicted", y: str = "y") -> DataFrame:
    """(metric, value): coverage of the panel, the rank correlation of an item's predicted difficulty and its observed share of
    wrong answers, and by bin of the prediction the gap to what was observed."""
    quality = measured(calibration.panel_quality(panel, models, items.select(item), model, item, y), ["coverage", "least_model_coverage", "least_item_coverage"])
    seen = panel.groupBy(item).agg((1 - F.avg(F.col(y).cast("double"))).alias("observed"))
    both = cut(items.join(seen, item).withColumn("_all", F.lit(0)))
    rank = stats.spearman(both, predicted, "observed", ["_all"]).select(F.lit("spearman").alias("metric"), F.col("spearman").cast("double").alias("value"))
    bins = both.groupBy(F.least(F.lit(4), F.floor(F.col(predicted) * 5)).alias("bin")).agg(F.avg(predicted).alias("p"), F.avg("observed").alias("o"))
    gaps = bins.select(F.concat(F.lit("gap:"), F.col("bin").cast("string")).alias("metric"), (F.col("p") - F.col("o")).alias("value"))
    return quality.unionByName(rank).unionByName(gaps)


def matched_cap(train: DataFrame, source: str, order: list[Column], target: int, correct: str = "correct_retention_samples") -> DataFrame:
    """The training rows of a data-matched protocol: a quarter of ``target`` from ``correct``, the rest from other sources, the
    first of each by ``order``, whose last column is unique. Raises where the target is no multiple of four or rows are short."""
    if target % 4:
        raise ValueError("the target must be a multiple of four")
    right = F.coalesce(F.col(source) == correct, F.lit(False))
    sizes = {r["right"]: r["n"] for r in train.groupBy(right.alias("right")).agg(F.count("*").alias("n")).collect()}
    wanted = {True: target // 4, False: target - target // 4}
    short = sum(max(0, n - sizes.get(k, 0)) for k, n in wanted.items())
    if short:
        raise ValueError(f"the training pool is short of {short} rows")
    return train.where(right).orderBy(*order).limit(wanted[True]).unionByName(train.where(~right).orderBy(*order).limit(wanted[False]))


def dimension_matrix(items: DataFrame, key: str, dimensions: str) -> DataFrame:
    """(key, the five dimensions in 0 to 1) from a map of name to struct<normalized, value>: the normalised number, else the raw
    value by its scale. Raises where a dimension is missing, has neither, or is out of range."""
    def flat(name: str) -> Column:
        d = F.try_element_at(F.col(dimensions), F.lit(name))
        return F.coalesce(d["normalized"], d["value"] / SCALES[name]).alias(name)

    found = items.select(key, *[flat(n) for n in SCALES])
    sound = [F.coalesce(F.col(n).between(0, 1), F.lit(False)) for n in SCALES]
    bad = ~sound[0]
    for s in sound[1:]:
        bad = bad | ~s
    require_none(found.where(bad), "difficulty dimensions must map to 0 to 1")
    return found
