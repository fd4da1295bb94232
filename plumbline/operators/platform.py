"""Rating by a platform's own rules: key activations and off-topic windows don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Platform
from plumbline.functions.patterns import PROXY_TOPICS
from plumbline.operators.intervals import covered, within


def offtopic(basis: Column, choice: Column) -> Column:
    """1 where the verdict isn't based on use, 0 where it is, null where unknown; the topic is the proxy."""
    return F.when(basis.isNotNull(), (basis < 0.5).cast("double")).when(choice.isNotNull(), choice.isin(*PROXY_TOPICS).cast("double"))


def qualified(reviews: DataFrame, windows: DataFrame, cfg: Platform = Platform()) -> DataFrame:
    """Negative windows with enough judged reviews of which most are off-topic: start, end (exclusive), judged, share.

    ``reviews``: created_at, rating_norm, offtopic; ``windows``: verdict, start,
    end (hour, inclusive). Reviews meet windows by time cells.
    """
    spans = windows.where("verdict = 'negative'").select("start", (F.col("end") + F.expr("interval 1 hour")).alias("end"))
    inside = within(reviews.where("rating_norm < 0.5 AND offtopic IS NOT NULL").select("created_at", "offtopic"), spans, "created_at")
    judged = inside.groupBy("start", "end").agg(F.count("*").alias("judged"), F.avg("offtopic").alias("share"))
    return judged.where((F.col("judged") >= cfg.min_judged) & (F.col("share") > cfg.share))


def extended(reviews: DataFrame, spans: DataFrame, cfg: Platform = Platform()) -> DataFrame:
    """``spans`` grown by whole days, both ways, while each day still has enough judged negatives that are mostly off-topic.

    The few steps of the few windows are broadcast to the reviews and met by
    calendar day; reviews are counted where they are.
    """
    steps = spans.select("start", "end", F.explode(F.sequence(F.lit(1), F.lit(cfg.extend_days))).alias("k"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    day = F.expr("interval 1 day")
    low = F.when(F.col("side") < 0, F.col("start") - day * F.col("k")).otherwise(F.col("end") + day * (F.col("k") - 1))
    steps = steps.withColumn("lo", low).withColumn("hi", F.col("lo") + day)
    dated = steps.withColumn("day", F.explode(F.array(F.to_date("lo"), F.date_add(F.to_date("lo"), 1))))
    negatives = reviews.where("rating_norm < 0.5 AND offtopic IS NOT NULL").select("created_at", "offtopic", F.to_date("created_at").alias("day"))
    met = negatives.join(F.broadcast(dated), "day").where("created_at >= lo AND created_at < hi")
    found = met.groupBy("start", "end", "side", "k").agg(F.count("*").alias("n"), F.avg("offtopic").alias("share"))
    counted = steps.join(found, ["start", "end", "side", "k"], "left")
    good = ((F.coalesce("n", F.lit(0)) >= cfg.extend_daily) & (F.coalesce("share", F.lit(0.0)) > cfg.share)).cast("int")
    upto = Window.partitionBy("start", "end", "side").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    grown = counted.withColumn("ok", F.min(good).over(upto)).groupBy("start", "end").agg(F.sum(F.when(F.col("side") < 0, F.col("ok"))).alias("back"), F.sum(F.when(F.col("side") > 0, F.col("ok"))).alias("ahead"))
    return grown.select(F.col("start").alias("was"), (F.col("start") - day * F.col("back").cast("int")).alias("start"), (F.col("end") + day * F.col("ahead").cast("int")).alias("end"))


def classes(reviews: DataFrame, spans: DataFrame, cfg: Platform = Platform()) -> DataFrame:
    """``reviews`` with platform_class: KEY, WINDOW or COUNTS (null without a rating); keys come first.

    ``purchased``: null counts as purchased.
    """
    key = F.lit(cfg.purchasers_only) & ~F.coalesce("purchased", F.lit(True))
    return covered(reviews, spans, "created_at", "_in").withColumn("platform_class", F.when(F.col("rating_norm").isNull(), None).when(key, "KEY").when(F.col("_in"), "WINDOW").otherwise("COUNTS")).drop("_in")


def rating(classed: DataFrame) -> DataFrame:
    """One row: rating, counted, key_removed, window_removed."""
    of = lambda k: F.count_if(F.col("platform_class") == k)
    return classed.agg(F.avg(F.when(F.col("platform_class") == "COUNTS", F.col("rating_norm"))).alias("rating"), of("COUNTS").alias("counted"), of("KEY").alias("key_removed"), of("WINDOW").alias("window_removed"))
