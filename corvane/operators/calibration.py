"""Item response models and difficulty calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bins of predicted accuracy, the last one closed.
BINS = ((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.01))


def calibration_bins(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    """(low, high, n, mean_predicted, mean_observed) of all five bins, empty ones included."""
    bins = df.sparkSession.createDataFrame(list(BINS), "low double, high double")
    place = F.element_at(F.filter(F.array(*[F.lit(a) for a, _ in BINS]), lambda a: a <= F.col(predicted)), -1)
    x = bins.join(df.where(F.col(predicted).between(0, 1)).withColumn("low", place), "low", "left")
    return x.groupBy("low", "high").agg(F.count(predicted).alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(F.col(observed).cast("double")).alias("mean_observed"))


def panel_quality(panel: DataFrame, models: DataFrame, items: DataFrame, model: str, item: str, y: str) -> DataFrame:
    """One row: the observed share of all cells, and the least share of any model and any item."""
    n_models, n_items = models.select(model).distinct().count(), items.select(item).distinct().count()
    cells = panel.where(F.col(y).isNotNull()).select(model, item).distinct()
    by_model = models.select(model).distinct().join(cells.groupBy(model).count(), model, "left").agg(F.min(F.coalesce("count", F.lit(0)) / n_items).alias("least_model_coverage"))
    by_item = items.select(item).distinct().join(cells.groupBy(item).count(), item, "left").agg(F.min(F.coalesce("count", F.lit(0)) / n_models).alias("least_item_coverage"))
    return cells.agg((F.count("*") / (n_models * n_items)).alias("coverage")).crossJoin(by_model).crossJoin(by_item)  # one row each


def fit_irt(y: np.ndarray, two_parameters: bool = False, iterations: int = 1200, rate: float = 0.05, shrink: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Abilities, difficulties (mean zero) and discriminations of a model x item matrix with NaN for missing, by gradient
    ascent on the penalised likelihood."""
    seen = ~np.isnan(y)
    v = np.where(seen, y, 0.0)
    ability, hard, slope = np.zeros(y.shape[0]), np.zeros(y.shape[1]), np.zeros(y.shape[1])
    m = [np.zeros_like(x) for x in (ability, hard, slope)]
    s = [np.zeros_like(x) for x in (ability, hard, slope)]
    for t in range(1, iterations + 1):
        a = np.exp(slope)
        gap = ability[:, None] - hard[None, :]
        e = np.where(seen, v - 1 / (1 + np.exp(-np.clip(a * gap, -30, 30))), 0.0)
        grads = [(e * a).sum(1) - shrink * ability, -(e * a).sum(0) - shrink * hard, (e * gap * a).sum(0) - shrink * slope if two_parameters else np.zeros_like(slope)]
        for k, (p, g) in enumerate(zip((ability, hard, slope), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        shift = hard.mean()
        hard -= shift
        ability -= shift
    return ability, hard, np.exp(slope)


def irt(panel: DataFrame, group: str, model: str, item: str, y: str, two_parameters: bool = False) -> DataFrame:
    """(group, kind, id, value): abilities of models and difficulties of items, each panel in a task of its own. A panel
    is one group of models by items and small by design; rows of a cell are averaged first."""
    cells = panel.groupBy(group, model, item).agg(F.avg(F.col(y).cast("double")).alias("y"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        t = x.pivot(index=model, columns=item, values="y").sort_index().sort_index(axis=1)
        ability, hard, slope = fit_irt(t.to_numpy(float), two_parameters)
        out = [("ability", str(k), v) for k, v in zip(t.index, ability, strict=True)] + [("difficulty", str(k), v) for k, v in zip(t.columns, hard, strict=True)]
        if two_parameters:
            out += [("discrimination", str(k), v) for k, v in zip(t.columns, slope, strict=True)]
        f = pd.DataFrame(out, columns=["kind", "id", "value"])
        f.insert(0, group, x[group].iloc[0])
        return f

    kind = cells.schema[group].dataType.simpleString()
    return cells.groupBy(group).applyInPandas(run, f"{group} {kind}, kind string, id string, value double")


def irt_errors(spark, y: np.ndarray, iterations: int = 100, seed: int = 42, steps: int = 500) -> DataFrame:
    """(item, se) by a bootstrap over models; the refits run in parallel tasks."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            for k in part.id:
                rng = np.random.default_rng([seed, int(k)])
                _, hard, _ = fit_irt(y[rng.integers(0, len(y), len(y))], iterations=steps)
                yield pd.DataFrame({"item": np.arange(len(hard)), "value": hard})

    return spark.range(0, iterations, 1, min(iterations, 32)).mapInPandas(run, "item long, value double").groupBy("item").agg(F.stddev_samp("value").alias("se"))


def simplex_weights(df: DataFrame, features: list[str], target: str, steps: int = 2000, rate: float = 0.05) -> dict[str, float]:
    """Non-negative weights of sum one that fit ``target`` best. Spark sums the products, at most (features + 1)^2 numbers;
    the gradient steps need nothing else."""
    names = [*features, target]
    row = df.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    n, k = max(1, row["n"]), len(features)
    xx = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) / n
    xy = np.array([row[f"{i}_{k}"] or 0.0 for i in range(k)]) / n
    w = np.full(k, 1.0 / k)
    for _ in range(steps):
        w = np.maximum(w - rate * (xx @ w - xy), 0.0)
        w = w / w.sum() if w.sum() > 0 else np.full(k, 1.0 / k)
    return dict(zip(features, w.tolist(), strict=True))


def panel_schedule(items: DataFrame, models: DataFrame, item: str, model: str) -> DataFrame:
    """Every item for every model: models are a short list, so each item row is multiplied by it."""
    names = F.array(*[F.lit(r[0]) for r in models.select(model).distinct().orderBy(model).collect()])
    return items.select(item).distinct().select(item, F.explode(names).alias(model))
