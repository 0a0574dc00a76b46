"""Sign models on the feature matrix, all keys in one pass: training, comparison, attribution, stability, walk-forward scores.

Every operator takes rows of ``(keys, hour, columns, label, target_fund)`` and works by ``keys``; the training part of a key is the first
``frac`` of its rows. A key's rows are hours, so they fit a task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators import boosting
from tapeloom.operators.boosting import Size
from tapeloom.operators.features import FEATURES, time_split
from tapeloom.operators.order import with_average_ranks
from tapeloom.sources.layers import stored

KEYS = ["coin"]


def enough(rows: DataFrame, minimum: int, keys: list[str] = KEYS) -> DataFrame:
    """Rows of the keys that have ``minimum`` rows or more."""
    held = rows.groupBy(*keys).count().filter(F.col("count") >= minimum).select(*keys)
    return rows.join(held, list(keys), "left_semi")


def split(rows: DataFrame, frac: float = 0.7, keys: list[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    marked = time_split(rows, frac, keys)
    return marked.filter("is_train").drop("is_train"), marked.filter("not is_train").drop("is_train")


def sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def majority_accuracy(train: DataFrame, test: DataFrame, label: str = "label", keys: list[str] = KEYS) -> DataFrame:
    """``(keys, majority, accuracy)``: the training majority of each key and its accuracy on the key's test rows."""
    m = train.groupBy(*keys).agg((F.avg(label) > 0.5).cast("int").alias("majority"))
    right = (F.col(label) == F.col("majority")).cast("double")
    return test.join(m, keys).groupBy(*keys, "majority").agg(F.avg(right).alias("accuracy"))


def persistence_rmse(rows: DataFrame, actual: str, last: str, keys: list[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(actual) - F.col(last), F.lit(2)))).alias("rmse"))


def skill(scored: DataFrame, keys: list[str], p: str = "p", label: str = "label") -> DataFrame:
    """``(keys, n, auc, accuracy)``; the AUC is the rank sum of positives, ties sharing ranks, and null where there is one class."""
    ranked = with_average_ranks(stored(scored.select(*keys, p, label), "scored"), keys, {p: "rank"})
    positive = F.col(label) == 1
    ones = F.count_if(positive)
    zeros = F.count("*") - ones
    area = (F.sum(F.when(positive, F.col("rank"))) - ones * (ones + 1) / 2) / (ones * zeros)
    right = ((F.col(p) > 0.5).cast("int") == F.col(label)).cast("double")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when((ones > 0) & (zeros > 0), area).alias("auc"), F.avg(right).alias("accuracy"))


def boosted_scores(train: DataFrame, test: DataFrame, size: Size = Size(), seed: int = 42, columns: list[str] = FEATURES, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, hour, label, p)`` of the test rows: the probability of a positive sign."""
    trees = boosting.fit(train, keys, columns, size=size, seeds=[seed])
    scored = boosting.margins(test, trees, keys, columns, keep=["label"], size=size)
    p = F.col("margin") if size.bagged else sigmoid(F.col("margin"))
    return scored.select(*keys, "hour", "label", p.alias("p"))


def logistic(train: DataFrame, columns: list[str] = FEATURES, keys: list[str] = KEYS, c: float = 1.0) -> DataFrame:
    """``(keys, intercept, weight, mean, sd)``, arrays by column: ridge logistic regression of standardised columns by Newton's method.

    The loss is summed over rows with ``c`` as its weight beside half the squared weights; the intercept is free.
    """
    kinds = ", ".join(f"`{k}` {train.schema[k].dataType.simpleString()}" for k in keys)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x, y = df[columns].to_numpy(float), df["label"].to_numpy(float)
        mean, sd = x.mean(0), x.std(0)
        sd = np.where(sd > 0, sd, 1.0)
        z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
        w, ridge = np.zeros(z.shape[1]), np.array([1.0] * len(columns) + [1e-9])
        loss = lambda w: c * np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * (ridge * w * w).sum()
        for _ in range(200):
            p = 1 / (1 + np.exp(-(z @ w)))
            g = c * z.T @ (p - y) + ridge * w
            step = np.linalg.solve(c * (z.T * (p * (1 - p))) @ z + np.diag(ridge), g)
            part = 1.0
            while loss(w - part * step) > loss(w) and part > 1e-6:
                part /= 2
            w = w - part * step
            if np.abs(part * step).max() < 1e-9:
                break
        out = df.iloc[:1][keys].copy()
        out["intercept"] = w[-1]
        for name, v in (("weight", w[:-1]), ("mean", mean), ("sd", sd)):
            out[name] = [v.tolist()]
        return out

    return train.select(*keys, "label", *columns).groupBy(*keys).applyInPandas(run, f"{kinds}, intercept double, weight array<double>, mean array<double>, sd array<double>")


def _terms(columns: list[str]) -> list[Column]:
    """A column's part of the margin: coefficient times centred value."""
    return [F.col("weight")[i] * (F.col(c) - F.col("mean")[i]) / F.col("sd")[i] for i, c in enumerate(columns)]


def logistic_scores(models: DataFrame, test: DataFrame, columns: list[str] = FEATURES, keys: list[str] = KEYS) -> DataFrame:
    margin = reduce(lambda a, b: a + b, _terms(columns), F.col("intercept"))
    return test.join(models, keys).select(*keys, "hour", "label", sigmoid(margin).alias("p"))


def logistic_attribution(models: DataFrame, rows: DataFrame, columns: list[str] = FEATURES, keys: list[str] = KEYS) -> DataFrame:
    """Long ``(keys, hour, feature, attribution)``: coefficient times centred feature; adds up to the margin less the base."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), t.alias("attribution")) for c, t in zip(columns, _terms(columns))])
    return rows.join(models, keys).select(*keys, "hour", F.explode(parts).alias("a")).select(*keys, "hour", "a.feature", "a.attribution")


def compare(rows: DataFrame, frac: float = 0.7, seed: int = 42, columns: list[str] = FEATURES, rounds: int = 200, trees: int = 300, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, family, n, auc, accuracy)``: boosted trees, forest, logistic regression and the majority on one time split of each key."""
    train, test = split(rows, frac, keys)
    made = {
        "boosted": boosted_scores(train, test, Size(rounds=rounds), seed, columns, keys),
        "forest": boosted_scores(train, test, boosting.forest(len(columns), trees), seed, columns, keys),
        "logistic": logistic_scores(logistic(train, columns, keys), test, columns, keys)}
    all_of = reduce(DataFrame.unionByName, [df.withColumn("family", F.lit(name)) for name, df in made.items()])
    found = skill(all_of, [*keys, "family"])
    n = test.groupBy(*keys).agg(F.count("*").alias("n"))
    majority = majority_accuracy(train, test, keys=keys).join(n, keys)
    return found.unionByName(majority.select(*keys, F.lit("majority").alias("family"), "n", F.lit(None).cast("double").alias("auc"), "accuracy"))


def magnitude(rows: DataFrame, frac: float = 0.7, seed: int = 42, columns: list[str] = FEATURES, rounds: int = 200, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, forecast, rmse)`` of a boosted regressor of the target, beside the last-value forecast."""
    train, test = split(rows, frac, keys)
    size = Size(rounds=rounds, objective="squared")
    trees = boosting.fit(train, keys, columns, label="target_fund", size=size, seeds=[seed])
    done = boosting.margins(test, trees, keys, columns, keep=["target_fund"], size=size)
    mine = persistence_rmse(done, "target_fund", "margin", keys).select(*keys, F.lit("boosted").alias("forecast"), "rmse")
    return mine.unionByName(persistence_rmse(test, "target_fund", "funding_rate", keys).select(*keys, F.lit("last_value").alias("forecast"), "rmse"))


def top_drivers(attributions: DataFrame, k: int = 5, keys: list[str] = KEYS) -> DataFrame:
    """The ``k`` largest attributions of each row by absolute value; ties by name."""
    held = attributions.filter("feature <> '(base)'").groupBy(*keys, "hour").agg(
        F.array_sort(F.collect_list(F.struct((-F.abs("attribution")).alias("order"), "feature", "attribution"))).alias("all"))
    return held.select(*keys, "hour", F.explode(F.slice("all", 1, k)).alias("d")).select(*keys, "hour", "d.feature", "d.attribution")


def mean_drivers(attributions: DataFrame, k: int = 5, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, feature, mean_abs)``: the ``k`` features of the largest mean absolute attribution; ties by name."""
    held = attributions.filter("feature <> '(base)'").groupBy(*keys, "feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    order = Window.partitionBy(*keys).orderBy(F.desc("mean_abs"), "feature")
    return held.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def sign_summary(rows: DataFrame, frac: float = 0.7, seed: int = 42, k: int = 5, columns: list[str] = FEATURES, rounds: int = 200, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, feature, mean_abs, n_test, auc, accuracy, naive_accuracy)``: the first drivers and the skill behind them, beside the majority's."""
    train, test = split(rows, frac, keys)
    size = Size(rounds=rounds)
    trees = boosting.fit(train, keys, columns, size=size, seeds=[seed])
    scored = boosting.margins(test, trees, keys, columns, keep=["label"], size=size).withColumn("p", sigmoid(F.col("margin")))
    found = skill(scored, keys).withColumnRenamed("n", "n_test")
    naive = majority_accuracy(train, test, keys=keys).select(*keys, F.col("accuracy").alias("naive_accuracy"))
    return mean_drivers(boosting.shapley(test, trees, keys, columns, size=size), k, keys).join(found, keys).join(naive, keys)


def stability(rows: DataFrame, seeds: list[int], frac: float = 0.7, columns: list[str] = FEATURES, rounds: int = 200, subsample: float = 0.7, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, leader, lead_share)``: the most frequent first driver over refits, all keys and seeds at once."""
    train, test = split(rows, frac, keys)
    size = Size(rounds=rounds, subsample=subsample)
    trees = boosting.fit(train, keys, columns, size=size, seeds=seeds)
    first = mean_drivers(boosting.shapley(test, trees, keys, columns, size=size), 1, [*keys, "seed"])
    counts = first.groupBy(*keys, "feature").count()
    return counts.groupBy(*keys).agg(F.max_by("feature", F.struct("count", "feature")).alias("leader"), (F.max("count") / len(seeds)).alias("lead_share"))


def walk_forward(rows: DataFrame, frac: float = 0.7, folds: int = 3, size: Size = Size(), seed: int = 42, columns: list[str] = FEATURES, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, hour, label, p)`` of a key's rows after its first ``frac``: each of ``folds`` equal stretches by a model of all rows before it."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumns({"i": F.row_number().over(w.orderBy("hour")), "n": F.count("*").over(w)}).withColumn("first", F.floor(F.col("n") * frac))
    fold = F.when(F.col("i") > F.col("first"), F.floor((F.col("i") - F.col("first") - 1) * folds / (F.col("n") - F.col("first")))).cast("int")
    placed = placed.withColumn("own", fold).drop("i", "n", "first")
    # A row trains the models of all folds after its own.
    later = F.sequence(F.coalesce(F.col("own") + 1, F.lit(0)), F.lit(folds - 1))
    train = placed.filter(F.col("own").isNull() | (F.col("own") < folds - 1)).withColumn("fold", F.explode(later)).drop("own")
    test = placed.filter("own is not null").withColumnRenamed("own", "fold")
    return boosted_scores(train, test, size, seed, columns, [*keys, "fold"]).drop("fold")


