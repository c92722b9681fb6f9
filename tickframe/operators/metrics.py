"""Ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import argmax


def _below(by: DataFrame, buckets: int = 64) -> DataFrame:
    """Adds ``_below``: ``_neg`` over all lesser ``_s``. Scores are cut into ranges at approximate quantiles; each
    range is one window and only the ranges' totals meet, so no task holds all scores."""
    cuts = by.agg(F.percentile_approx("_s", [i / buckets for i in range(1, buckets)], 1000)).first()[0]
    splits = F.array(*(F.lit(c) for c in sorted(set(cuts or [])))) if cuts else F.expr("cast(array() as array<double>)")
    by = by.withColumn("_b", F.size(F.filter(splits, lambda x: x < F.col("_s"))))
    totals = by.groupBy("_b").agg(F.sum("_neg").alias("_n"))
    offsets = totals.alias("a").join(F.broadcast(totals.alias("b")), F.expr("b._b < a._b"), "left").groupBy("a._b").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    out = by.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
    return out.join(F.broadcast(offsets), "_b").withColumn("_below", F.col("_in") + F.col("_offset"))


def auc(df: DataFrame, score: str, positive: str, keys: tuple[str, ...] = (), empty: float = 0.5) -> DataFrame:
    """Area under the ROC curve by mid-ranks, one row for each key; ``empty`` where a class is missing.

    Equal scores are counted together before they are ranked, so a group's window holds distinct scores.
    """
    p = F.col(positive).cast("bigint")
    by = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(p).alias("_pos"), F.sum(1 - p).alias("_neg"))
    if keys:
        before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        by = by.withColumn("_below", F.coalesce(F.sum("_neg").over(before), F.lit(0)))
    else:
        by = _below(by)
    wins = F.sum(F.col("_pos") * (F.col("_below") + 0.5 * F.col("_neg")))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return by.groupBy(*keys).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.when(pairs > 0, wins / F.nullif(pairs, F.lit(0.0))).otherwise(F.lit(empty)).alias("auc"))


def accuracy(df: DataFrame, scores: list[str], label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose greatest score (the first of equals) is the label's."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((argmax(*scores) == F.col(label)).cast("double")).alias("accuracy"))


def correlation(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson's r, 0 where it is undefined."""
    r = F.corr(a, b)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("corr"))


def move_stats(df: DataFrame, prob: str, keys: tuple[str, ...] = (), collapse: float = 0.05) -> DataFrame:
    """mean, population deviation, max, and whether the probabilities have collapsed to one value."""
    return df.groupBy(*keys).agg(F.avg(prob).alias("mean_prob"), F.stddev_pop(prob).alias("std_prob"), F.max(prob).alias("max_prob")).withColumn("collapsed", F.col("std_prob") < collapse)


def model_health(losses: DataFrame, train: str = "train_loss", validation: str = "val_loss") -> DataFrame:
    """Adds ``ratio`` of validation to training loss and ``health``: within a tenth of 1 healthy, above overfitting, below underfitting."""
    ratio = F.col(validation) / (F.col(train) + 1e-6)
    health = F.when((ratio > 0.9) & (ratio < 1.1), "HEALTHY").when(ratio > 1.1, "OVERFITTING").otherwise("UNDERFITTING")
    return losses.withColumns({"ratio": ratio, "health": health})
