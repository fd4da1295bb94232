"""Bursts of hourly volume against a robust trailing baseline; change points of the daily share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Bursts
from plumbline.operators.intervals import within

MAD_TO_SD = 1.4826


def rated(reviews: DataFrame) -> DataFrame:
    return reviews.where("created_at IS NOT NULL AND rating_norm IS NOT NULL").withColumns({"hour": F.date_trunc("hour", "created_at").cast("timestamp_ntz"), "verdict": F.when(F.col("rating_norm") >= 0.5, "positive").otherwise("negative")})


def hourly(reviews: DataFrame) -> DataFrame:
    """(verdict, hour, n) over the whole span, empty hours with 0."""
    counts = rated(reviews).groupBy("verdict", "hour").agg(F.count("*").alias("n"))
    span = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).where("a IS NOT NULL")
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour")).select("hour", F.explode(F.array(F.lit("negative"), F.lit("positive"))).alias("verdict"))
    return grid.join(counts, ["verdict", "hour"], "left").select("verdict", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def robust_z(counts: np.ndarray, cfg: Bursts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, flagged, baseline) an hour; hours that are flagged never enter a later baseline."""
    z, base, flagged, past = np.zeros(len(counts)), np.full(len(counts), np.nan), np.zeros(len(counts), bool), []
    for i, x in enumerate(counts):
        if len(past) >= cfg.min_history:
            recent = np.array(past[-cfg.baseline_hours :])
            base[i] = np.median(recent)
            spread = MAD_TO_SD * np.median(np.abs(recent - base[i]))
            z[i] = (x - base[i]) / max(spread, cfg.min_scale)
            flagged[i] = z[i] >= cfg.z and x >= cfg.min_hour
        if not flagged[i]:
            past.append(float(x))
    return z, flagged, base


def scored_hours(reviews: DataFrame, cfg: Bursts = Bursts()) -> DataFrame:
    """``hourly`` with z, flagged and baseline; the series of a verdict is its hours, not its reviews."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour")
        z, flagged, base = robust_z(pdf["n"].to_numpy(float), cfg)
        return pdf.assign(z=z, flagged=flagged, baseline=base)

    return hourly(reviews).groupBy("verdict").applyInPandas(score, "verdict string, hour timestamp_ntz, n long, z double, flagged boolean, baseline double")


def windows(scored: DataFrame, cfg: Bursts = Bursts()) -> DataFrame:
    """Windows of merged flagged hours: verdict, start, end, size, hours, peak_hour, peak_count, peak_z, baseline_per_hour."""
    order = Window.partitionBy("verdict").orderBy("hour")
    at = F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600
    flagged = scored.where("flagged").withColumn("h", at)
    fresh = F.coalesce(F.col("h") - F.lag("h").over(order) > cfg.gap + 1, F.lit(True)).cast("int")
    spans = flagged.withColumn("island", F.sum(fresh).over(order)).groupBy("verdict", "island").agg(F.min("hour").alias("start"), F.max("hour").alias("end"))
    hour_after = F.expr("interval 1 hour")
    inside = within(scored, spans.withColumn("_end", F.col("end") + hour_after), "hour", end="_end", on=("verdict",))
    peak = F.max(F.struct("n", (-F.unix_timestamp(F.col("hour").cast("timestamp"))).alias("early"), "hour", "z"))
    mean = F.avg(F.when(~F.isnan("baseline"), F.col("baseline")))
    out = inside.groupBy("verdict", "start", "end").agg(F.sum("n").alias("size"), F.count("*").alias("hours"), peak.alias("p"), F.round(mean, 2).alias("baseline_per_hour"))
    return out.where(F.col("size") >= cfg.min_reviews).select("verdict", "start", "end", "size", "hours", F.col("p.hour").alias("peak_hour"), F.col("p.n").alias("peak_count"), F.round("p.z", 1).alias("peak_z"), "baseline_per_hour")


def members(reviews: DataFrame, spans: DataFrame) -> DataFrame:
    """(verdict, start, id): the reviews of each window."""
    ends = spans.select("verdict", "start", (F.col("end") + F.expr("interval 1 hour")).alias("end"))
    return within(rated(reviews).select("id", "hour", "verdict"), ends, "hour", on=("verdict",)).select("verdict", "start", "id")


def daily_share(reviews: DataFrame, least: int = 20) -> DataFrame:
    """(day, n, share of positive reviews) of days with ``least`` reviews."""
    r = rated(reviews)
    return r.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("rating_norm") >= 0.5).cast("double")).alias("share")).where(F.col("n") >= least)


def split_points(signal: np.ndarray, penalty: float, min_size: int, jump: int = 5) -> list[int]:
    """Penalised least-squares segmentation; breakpoints are multiples of ``jump``. Pruned exact search."""
    n = len(signal)
    one, two = np.r_[0, np.cumsum(signal)], np.r_[0, np.cumsum(signal**2)]
    cost = lambda a, b: two[b] - two[a] - (one[b] - one[a]) ** 2 / (b - a)
    ends = [k for k in range(0, n, jump) if k >= min_size] + [n]
    best: dict[int, tuple[float, int]] = {0: (-penalty, 0)}
    live = [0]
    for end in ends:
        options = [(best[a][0] + cost(a, end) + penalty, a) for a in live if end - a >= min_size]
        if not options:
            continue
        best[end] = min(options)
        live = [a for a in live if end - a < min_size or best[a][0] + cost(a, end) <= best[end][0]] + [end]
    points, at = [], n
    while at in best and at:
        at = best[at][1]
        if at:
            points.append(at)
    return sorted(points)


def change_points(reviews: DataFrame, cfg: Bursts = Bursts(), jump: int = 5) -> DataFrame:
    """(day): where the daily share of positive reviews shifts. The series has a row a day."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(batches), ignore_index=True)
        if len(days) < 2 * cfg.segment_days:
            return
        days = days.sort_values("day")
        share = days["share"].to_numpy(float)
        penalty = cfg.penalty * np.log(len(share)) * (share.var() or 1e-6)
        yield pd.DataFrame({"day": days["day"].iloc[split_points(share, penalty, cfg.segment_days, jump)]})

    return daily_share(reviews, cfg.daily_min).coalesce(1).mapInPandas(find, "day date")


def trailing_z(series: DataFrame, hours: int = 168, least: int = 72) -> DataFrame:
    """Robust z of hourly counts against all trailing hours, flagged ones included: verdict, hour, n, med, z."""
    past = Window.partitionBy("verdict").orderBy("hour").rowsBetween(-hours, -1)
    framed = series.withColumn("w", F.collect_list("n").over(past)).where(F.size("w") >= least)
    median = lambda a: (F.element_at(a, (F.floor((F.size(a) - 1) / 2) + 1).cast("int")) + F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))) / 2.0
    out = framed.withColumn("med", median(F.array_sort("w")))
    out = out.withColumn("mad", median(F.array_sort(F.transform("w", lambda x: F.abs(x - F.col("med"))))))
    return out.select("verdict", "hour", "n", "med", ((F.col("n") - F.col("med")) / F.greatest(MAD_TO_SD * F.col("mad"), F.lit(1.0))).alias("z"))
