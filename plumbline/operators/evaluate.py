"""Agreement, ranking and clustering measures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Config, overridden


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement, kappa (null where one class is alone on both sides)."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    both = total.crossJoin(chance).withColumns({"po": F.col("same") / F.col("n"), "pe": F.col("x") / (F.col("n") * F.col("n"))})
    return both.select("n", F.col("po").alias("agreement"), F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))).alias("kappa"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the adjusted Rand index of two labelings."""
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    together = cells.agg(F.sum(two("n")).alias("index"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("ra"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("rb"))
    all_ = together.crossJoin(rows).crossJoin(columns).withColumn("chance", F.col("ra") * F.col("rb") / F.nullif(two("n"), F.lit(0.0)))
    return all_.select("n", ((F.col("index") - F.col("chance")) / F.nullif((F.col("ra") + F.col("rb")) / 2 - F.col("chance"), F.lit(0.0))).alias("ari"))


def average_ranks(df: DataFrame, c: str, out: str, pieces: int = 64) -> DataFrame:
    """``df`` with mean ranks of a numeric column: equal values are counted first, and only the distinct values are put in order.

    They are put in order by ranges between approximate quantiles, and moved by
    the sizes of the ranges before, so no task sorts all of them.
    """
    sizes = df.groupBy(c).agg(F.count("*").alias("_n"))
    bounds = sizes.select(F.col(c).cast("double").alias("v")).approxQuantile("v", [k / pieces for k in range(1, pieces)], 0.001)
    piece = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(bounds))]).cast("array<double>"), lambda x: x <= F.col(c).cast("double")))
    ranged = sizes.withColumn("_p", piece)
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy(F.col("_p").alias("_q")).agg(F.sum("_n").alias("_n"))
    starts = totals.select("_q", ahead(Window.orderBy("_q")).alias("_first"))  # a row a range
    placed = ranged.withColumn("_before", ahead(Window.partitionBy("_p").orderBy(c))).join(F.broadcast(starts), F.col("_p") == F.col("_q"))
    ranks = placed.select(F.col(c).alias("_v"), (F.col("_before") + F.col("_first") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(c) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = average_ranks(average_ranks(df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return both.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def line_fit(df: DataFrame, y: Column, x: Column) -> DataFrame:
    """One row: n, slope, intercept and the residuals' standard deviation of y over x."""
    both = df.select(y.cast("double").alias("y"), x.cast("double").alias("x"))
    fit = both.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    return fit.select("n", "slope", "intercept", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n")).alias("residual_sd"))


def pull_removed(clean: DataFrame, attacked: DataFrame) -> DataFrame:
    """One row: how far an attack moves the raw and the adjusted rating (columns raw, adjusted), and the share of the pull that is removed."""
    a, b = clean.select(F.col("raw").alias("r0"), F.col("adjusted").alias("a0")), attacked.select(F.col("raw").alias("r1"), F.col("adjusted").alias("a1"))
    both = a.crossJoin(b)  # one row each
    return both.select((F.col("r1") - F.col("r0")).alias("raw_shift"), (F.col("a1") - F.col("a0")).alias("adjusted_shift"), (1 - (F.col("a1") - F.col("a0")) / F.nullif(F.col("r1") - F.col("r0"), F.lit(0.0))).alias("pull_removed"))


def transitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(transition, n): how actions change between two runs over the same ids (columns id, action)."""
    joined = a.select("id", F.col("action").alias("x")).join(b.select("id", F.col("action").alias("y")), "id")
    return joined.groupBy(F.concat_ws("->", "x", "y").alias("transition")).agg(F.count("*").alias("n"))


def injected(reviews: DataFrame, kind: str, n: int, hours: float, rating: float, text: Column, first_id: int, start: str) -> DataFrame:
    """``n`` reviews of one attack, evenly spread over ``hours`` from ``start``, in the columns of ``reviews``."""
    spark = reviews.sparkSession
    made = {"id": F.col("i") + first_id, "created_at": (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("i") * F.lit(hours * 3600 / n))), "rating_norm": F.lit(rating), "text": text, "ext_id": F.concat(F.lit(f"inj-{kind}-"), F.col("i"))}
    rows = spark.range(n).withColumnRenamed("id", "i")
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in reviews.schema])


def sweep(rows: DataFrame, decide, cfg: Config, changes: dict[str, dict[str, object]]) -> DataFrame:
    """(setting, n, raw, adjusted, n_downweight, n_flag, n_exclude) of one set of answers decided under several settings.

    ``decide(cfg)`` gives the decision column; all settings are decided in one pass over the rows.
    """
    settings = F.array(*[F.struct(F.lit(name).alias("setting"), decide(overridden(cfg, c)).alias("d")) for name, c in changes.items()])
    w = cfg.weights
    decided = rows.select("rating_norm", F.explode(settings).alias("s")).select("rating_norm", "s.setting", F.col("s.d.code").alias("code"))
    weight = F.element_at(F.array(*[F.lit(x) for x in (w.keep, w.keep, w.downweight, w.flag, w.exclude)]), F.col("code") + 1)
    rated = F.when(F.col("rating_norm").isNotNull(), weight)
    return decided.groupBy("setting").agg(
        F.count("*").alias("n"), F.avg("rating_norm").alias("raw"), (F.sum(weight * F.col("rating_norm")) / F.nullif(F.sum(rated), F.lit(0.0))).alias("adjusted"),
        F.count_if(F.col("code") == 2).alias("n_downweight"), F.count_if(F.col("code") == 3).alias("n_flag"), F.count_if(F.col("code") == 4).alias("n_exclude"),
    )
