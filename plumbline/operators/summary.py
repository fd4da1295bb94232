"""One-row reports of a run: features, clusters, decisions, ratings, and the live state that its events add up to."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plumbline.config import ACTIONS, Features, Policy
from plumbline.operators.policy import is_later_copy
from plumbline.operators.ratings import effective_size, label, weighted_mean

KINDS = ("burst", "duplicate", "semantic")
#: Points that a rating trail keeps at most.
TRAIL = 240


def feature_counts(feats: DataFrame, cfg: Features = Features()) -> DataFrame:
    """One row of counts over features (id, has_url, has_promo, n_tokens, exact_group_id, dup_group_id, dup_of, low_playtime, single_review_account)."""
    of = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return feats.agg(
        F.count("*").alias("reviews"), of(F.col("has_url")).alias("with_url"), of(F.col("has_promo")).alias("promo"), of(F.col("n_tokens") <= cfg.low_info_tokens).alias("low_info"),
        of(F.col("exact_group_id") >= 0).alias("exact_dup_reviews"), of(F.col("dup_group_id") >= 0).alias("near_dup_reviews"), F.count_distinct(F.when(F.col("dup_group_id") >= 0, F.col("dup_group_id"))).alias("dup_groups"),
        of(is_later_copy(F.col("id"), F.col("dup_of"), F.col("n_tokens"), cfg.dup_min_tokens)).alias("later_copies"), of(F.col("low_playtime")).alias("low_playtime"), of(F.col("single_review_account")).alias("single_review_account"),
    )


def cluster_counts(clusters: DataFrame, p: Policy = Policy()) -> DataFrame:
    """One row: clusters of each kind and suspicious ones."""
    return clusters.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS], F.count_if(F.col("suspicion") > p.cluster_threshold).alias("suspicious"))


def penalties(base: DataFrame, final: DataFrame) -> DataFrame:
    """One row: reviews that the rules for clusters changed in any way, and those whose action they changed (id, code, score, reasons)."""
    names = ("code", "score", "reasons")
    a, b = (d.select("id", *[F.col(n).alias(f"{n}{k}") for n in names]) for k, d in ((1, base), (2, final)))
    both = a.join(b, "id")
    changed = F.lit(False)
    for n in names:
        changed = changed | ~F.col(f"{n}1").eqNullSafe(F.col(f"{n}2"))
    return both.agg(F.count_if(changed).alias("penalised_reviews"), F.count_if(F.col("code1") != F.col("code2")).alias("actions_changed"))


def run_summary(decisions: DataFrame, interval: DataFrame | None, clusters: DataFrame | None, platform: DataFrame | None, calls: DataFrame | None, elapsed: float, scale: str = "binary", model: str | None = None) -> DataFrame:
    """The whole summary of a run as one row; parts that were not computed are null.

    ``decisions``: rating_norm, code, weight; the others are the one-row tables
    of ``ratings.bootstrap``, ``cluster_counts``, ``platform.rating`` and
    ``answers.call_summary``.
    """
    w, r = F.col("weight"), F.col("rating_norm")
    counts = [F.count_if(F.col("code") == k).alias(f"n_{n.lower()}") for k, n in enumerate(ACTIONS)]
    out = decisions.agg(F.count("*").alias("n_reviews"), *counts, F.avg("rating_norm").alias("raw"), weighted_mean(r, w).alias("adjusted"), effective_size(F.when(r.isNotNull(), w)).alias("n_eff"), F.count("rating_norm").alias("n_rated"))
    out = out.withColumn("label_raw", label(F.col("raw"), F.col("n_rated"))).withColumn("label_adjusted", label(F.col("adjusted"), F.col("n_eff"))).drop("n_rated")
    parts = ((interval, ("ci_low", "ci_high"), "double"), (clusters, (*KINDS, "suspicious"), "long"), (platform, ("rating", "counted", "key_removed", "window_removed"), "double"), (calls, ("requests", "retries", "latency_p50_ms", "latency_p95_ms", "tokens", "cost"), "double"))
    for table, names, kind in parts:
        if table is not None:
            out = out.crossJoin(F.broadcast(table.select(*names)))  # one row
        else:
            out = out.withColumns({n: F.lit(None).cast(kind) for n in names})
    rate = F.round(F.col("n_reviews") / elapsed, 2) if elapsed else F.lit(0.0)
    return out.withColumnsRenamed({"rating": "platform_rating"}).withColumns({"rating_scale": F.lit(scale), "model": F.lit(model).cast("string"), "elapsed_s": F.lit(round(elapsed, 3)), "reviews_per_s": rate, "platform_label": label(F.col("platform_rating"), F.col("counted"))})


def run_counters(decisions: DataFrame, total: int, elapsed: float, cost: float = 0.0) -> DataFrame:
    """The counters of a run under way (code 0: pending): keep, down, flag, exclude, processed, total, rps, cost."""
    of = lambda k: F.count_if(F.col("code") == k)
    out = decisions.agg(of(1).alias("keep"), of(2).alias("down"), of(3).alias("flag"), of(4).alias("exclude"), F.count_if(F.col("code") > 0).alias("processed"))
    return out.withColumns({"total": F.lit(total), "rps": F.round(F.col("processed") / (elapsed or 1.0), 2), "cost": F.lit(cost)})


@F.pandas_udf(ArrayType(StructType().add("id", "long").add("code", "integer")))
def unpacked_updates(ids: pd.Series, codes: pd.Series) -> pd.Series:
    """Reviews and actions of an update event: little-endian 32-bit ids and bytes, both in base64."""
    out = []
    for a, b in zip(ids, codes):
        x, y = np.frombuffer(base64.b64decode(a), "<u4"), np.frombuffer(base64.b64decode(b), np.uint8)
        if len(x) != len(y):
            raise ValueError(f"{len(x)} ids and {len(y)} actions")
        out.append([{"id": int(i), "code": int(c)} for i, c in zip(x, y)])
    return pd.Series(out)


def packed_updates(updates: DataFrame, every: int = 250) -> DataFrame:
    """(batch, indices_b64, actions_b64) of updates (id, code, seq): ``every`` updates an event, in their order."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        return pd.DataFrame({"batch": group["batch"].iloc[:1], "indices_b64": [base64.b64encode(group["id"].to_numpy("<u4").tobytes()).decode()], "actions_b64": [base64.b64encode(group["code"].to_numpy(np.uint8).tobytes()).decode()]})

    rows = updates.withColumn("batch", F.floor(F.col("seq") / every).cast("long"))
    return rows.groupBy("batch").applyInPandas(pack, "batch long, indices_b64 string, actions_b64 string")  # ``every`` rows a group


EVENT = "t double, type string, body string"
# Names of the events of a run and the fields of their bodies.
EVENT_BODIES = {
    "stage": "name string, status string",
    "features_done": "counts map<string,bigint>",
    "judged": "indices_b64 string, actions_b64 string",
    "counters": "keep bigint, down bigint, flag bigint, exclude bigint, processed bigint, total bigint, rps double, cost_usd double, elapsed_s double",
    "rating": "raw double, adjusted double, ci array<double>, n_eff double, final boolean, platform double, platform_ci array<double>",
    "cluster": "cid bigint, kind string, size bigint, suspicion double, caption string",
    "done": "summary string",
    "error": "message string, retryable boolean",
}


def event_bodies(log: DataFrame, kind: str) -> DataFrame:
    """Events of one type (t, body as JSON) with their fields as columns."""
    return log.where(F.col("type") == kind).select("t", F.from_json("body", EVENT_BODIES[kind]).alias("b")).select("t", "b.*")


def folded(log: DataFrame) -> dict[str, DataFrame]:
    """The state that a run's events (t, type, body) add up to, each part a table.

    The latest status of a stage, counters and rating hold; a review's last
    action holds; a cluster counts once, as first reported; the phase is error or
    done if the run has said so, else running.
    """
    last = lambda kind, *by: event_bodies(log, kind).groupBy(*by)
    updates = event_bodies(log, "judged").select("t", F.posexplode(unpacked_updates("indices_b64", "actions_b64")).alias("k", "u"))
    grid = updates.groupBy(F.col("u.id").alias("id")).agg(F.max_by("u.code", F.struct("t", "k")).alias("code"))
    phase = log.agg(F.when(F.count_if(F.col("type") == "error") > 0, "error").when(F.count_if(F.col("type") == "done") > 0, "done").when(F.count("*") > 0, "running").otherwise("connecting").alias("phase"), F.max("t").alias("t"))
    return {
        "stages": last("stage", "name").agg(F.max_by("status", "t").alias("status")),
        "counters": last("counters").agg(*[F.max_by(c, "t").alias(c) for c in ("keep", "down", "flag", "exclude", "processed", "total")]),
        "rating": last("rating").agg(*[F.max_by(c, "t").alias(c) for c in ("raw", "adjusted", "n_eff", "platform")]),
        "clusters": last("cluster", "cid").agg(*[F.min_by(c, "t").alias(c) for c in ("kind", "size", "suspicion", "caption")]),
        "grid": grid,
        "tally": grid.groupBy("code").agg(F.count("*").alias("n")),
        "phase": phase,
    }


def trail(log: DataFrame, most: int = TRAIL) -> DataFrame:
    """(place, t, raw, adjusted) of a run's rating events, thinned by whole factors of two to ``most`` points at most; the last one stays.

    Batches of a run make one event each, so the events are few beside the reviews.
    """
    points = event_bodies(log, "rating").select("t", "raw", "adjusted")
    placed = points.withColumn("place", F.row_number().over(Window.orderBy("t")) - 1)
    n = points.agg(F.count("*").alias("n"))
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) / most)))).cast("long")
    kept = placed.crossJoin(F.broadcast(n)).where((F.pmod(F.col("n") - 1 - F.col("place"), step) == 0))
    return kept.select("place", "t", "raw", "adjusted")


def live_class(code: Column, counts: Column, key: Column) -> Column:
    """What the live view says of a review: PENDING until decided, then COUNTS, KEY (keys come first) or WINDOW."""
    return F.when(code == 0, "PENDING").when(counts, "COUNTS").when(F.coalesce(key, F.lit(False)), "KEY").otherwise("WINDOW")


def near_neighbours(neighbours: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row: rows (cosine), and those whose nearest other has at least that cosine."""
    return neighbours.agg(F.count("*").alias("n"), F.count_if(F.col("cosine") >= cosine).alias("near"))


def with_semantics(feats: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Features with the nearest review and its cosine (four digits); rows without a neighbour stay."""
    return feats.join(neighbours.select("id", F.col("neighbour").alias("nearest_id"), F.round("cosine", 4).alias("nearest_cosine")), "id", "left")
