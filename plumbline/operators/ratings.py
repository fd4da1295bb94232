"""Ratings: weighted means, effective size, bands, bootstrap, waterfall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import REASONS
from plumbline.functions.patterns import BANDS
from plumbline.operators.running import running_sums


def weighted_mean(r: Column, w: Column) -> Column:
    """Sum of w * r over sum of w; rows without a rating take no part; null where nothing weighs."""
    return F.sum(w * r) / F.nullif(F.sum(F.when(r.isNotNull(), w)), F.lit(0.0))


def effective_size(w: Column) -> Column:
    return F.coalesce(F.pow(F.sum(w), F.lit(2.0)) / F.nullif(F.sum(w * w), F.lit(0.0)), F.lit(0.0))


def label(share: Column, n: Column) -> Column:
    out = F.when((n < 10) | share.isNull(), F.lit(None).cast("string"))
    for least, reviews, name in BANDS:
        out = out.when((share >= least) & (n >= reviews), name)
    return out.when(n >= 500, "Overwhelmingly Negative").when(n >= 50, "Very Negative").otherwise("Negative")


def summary(decided: DataFrame, *by: str) -> DataFrame:
    """Raw and adjusted rating, effective size, label and action counts (columns rating_norm, weight, code)."""
    counts = [F.count_if(F.col("code") == k).alias(f"n_{n}") for k, n in ((1, "keep"), (2, "downweight"), (3, "flag"), (4, "exclude"))]
    out = decided.groupBy(*by).agg(F.count("*").alias("n"), F.avg("rating_norm").alias("raw"), weighted_mean(F.col("rating_norm"), F.col("weight")).alias("adjusted"), effective_size(F.when(F.col("rating_norm").isNotNull(), F.col("weight"))).alias("n_eff"), *counts)
    return out.withColumn("label", label(F.col("adjusted"), F.col("n_eff")))


def bootstrap(decided: DataFrame, resamples: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Percentile interval of the weighted mean.

    Rows fall into few cells of equal (rating, weight); resampling rows with
    replacement is drawing the cells' counts from a multinomial, so only the
    cells' sizes leave the executors' aggregation.
    """
    cells = decided.where("rating_norm IS NOT NULL").groupBy("rating_norm", "weight").agg(F.count("*").alias("n"))

    def draw(batches):
        import pandas as pd

        rows = pd.concat(list(batches), ignore_index=True)
        if rows.empty:
            return
        rows = rows.sort_values(["rating_norm", "weight"])
        r, w, n = (rows[c].to_numpy(float) for c in ("rating_norm", "weight", "n"))
        counts = np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=resamples)
        below = counts @ w
        stats = np.divide(counts @ (w * r), below, out=np.full(resamples, np.nan), where=below > 0)
        low, high = np.nanquantile(stats, [(1 - level) / 2, (1 + level) / 2])
        yield pd.DataFrame({"ci_low": [low], "ci_high": [high], "resamples": [resamples]})

    return cells.coalesce(1).mapInPandas(draw, "ci_low double, ci_high double, resamples int")


def primary_reason(reasons: Column) -> Column:
    """Place of the first reason in the fixed order, -1 without one."""
    order = F.array(*[F.lit(r) for r in REASONS])
    return F.when(F.size(reasons) > 0, F.array_position(order, F.try_element_at(reasons, F.lit(1))).cast("int") - 1).otherwise(-1)


def waterfall(decided: DataFrame) -> DataFrame:
    """Raw to adjusted, a step a primary reason: step, reason, reviews, after, delta (columns rating_norm, weight, reasons).

    One pass over the reviews: sums by step, with full-weight reviews as a step of their own that only counts in the totals.
    """
    k = primary_reason(F.col("reasons"))
    step = F.when(F.col("weight") >= 1, -1).when(k < 0, len(REASONS)).otherwise(k)
    r, less = F.col("rating_norm"), F.col("weight") - 1
    sums = decided.where("rating_norm IS NOT NULL").groupBy(step.alias("step")).agg(F.count("*").alias("reviews"), F.sum(r).alias("r"), F.sum(F.least(less, F.lit(0.0)) * r).alias("dr"), F.sum(F.least(less, F.lit(0.0))).alias("dw"))
    every, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # at most one row a reason
    totals = sums.withColumns({"sr": F.sum("r").over(every), "sw": F.sum("reviews").over(every).cast("double")})
    after = (F.col("sr") + F.sum("dr").over(upto)) / F.nullif(F.col("sw") + F.sum("dw").over(upto), F.lit(0.0))
    out = totals.withColumn("after", after).where("step >= 0")
    before = F.coalesce(F.lag("after").over(Window.partitionBy(F.lit(0)).orderBy("step")), F.col("sr") / F.col("sw"))
    names = F.array(*[F.lit(r) for r in (*REASONS, "OTHER")])
    return out.select("step", F.element_at(names, F.col("step") + 1).alias("reason"), "reviews", "after", (F.col("after") - before).alias("delta"))


def running(decided: DataFrame, every: int = 250) -> DataFrame:
    """Rating over all reviews up to the end of each batch of ``every`` ids: batch, n, rating (columns id, rating_norm, weight).

    Batches are summed first, then accumulated in two levels.
    """
    batches = decided.groupBy(F.floor(F.col("id") / every).cast("long").alias("batch")).agg(F.count("*").alias("m"), F.sum(F.col("weight") * F.col("rating_norm")).alias("a"), F.sum(F.when(F.col("rating_norm").isNotNull(), F.col("weight"))).alias("b"))
    summed = running_sums(batches, "batch", ["m", "a", "b"])
    return summed.select("batch", F.col("m").alias("n"), (F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("rating"))
