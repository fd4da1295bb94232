"""The whole analysis of a corpus: features, judgments, clusters, decisions, ratings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions import text as T
from plumbline.operators import bursts as B
from plumbline.operators import clusters as C
from plumbline.operators import density as DN
from plumbline.operators import duplicates as D
from plumbline.operators import judgments as J
from plumbline.operators import platform as PL
from plumbline.operators import policy as PO
from plumbline.operators import ratings as RA
from plumbline.operators.drilldown import caption
from plumbline.plans.tables import cut

KIND_ORDER = {"burst": 0, "duplicate": 1, "semantic": 2}


@dataclass
class Result:
    """Tables of a run; each is computed once and cut."""

    features: DataFrame
    bursts: DataFrame
    clusters: DataFrame
    members: DataFrame
    decisions: DataFrame
    summary: DataFrame
    interval: DataFrame
    platform: DataFrame


def features(reviews: DataFrame, cfg: Config) -> DataFrame:
    """Text statistics, account flags and duplicate groups of reviews (id, text, meta)."""
    stats = T.text_features(reviews.select("id", "text", "meta", "created_at", "rating_norm"))
    stats = stats.withColumns(T.account_flags(F.col("meta"), cfg.features.low_playtime_minutes)).drop("meta")
    return stats.join(D.duplicate_groups(reviews.select("id", "text"), features=cfg.features), "id")


def base_decisions(feats: DataFrame, cfg: Config, answers: DataFrame | None) -> DataFrame:
    """(id, base, later_copy): decisions before clusters; floors for notes to a model, then for later copies."""
    p = cfg.policy
    late = PO.is_later_copy(F.col("id"), F.col("dup_of"), F.col("n_tokens"), cfg.features.dup_min_tokens)
    if answers is None:
        base = PO.heuristic(F.col("n_tokens"), F.col("emoji_ratio"), F.col("has_promo"), cfg.features.low_info_tokens)
        rows = feats
    else:
        base = PO.judged(p, F.col("has_promo"))
        rows = feats.join(J.wide(answers), "id")
    floored = PO.floored(PO.floored(base, F.col("model_note"), p.model_note_action, "INFLUENCE_ATTEMPT"), late, p.duplicate_action, "NEAR_DUPLICATE")
    return rows.select("id", floored.alias("base"), late.alias("later_copy"))


def find_clusters(feats: DataFrame, spans: DataFrame, cfg: Config, semantic: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(clusters with their keys, members): bursts, duplicate groups, then given semantic clusters (id, cluster)."""
    rated = feats.select("id", "created_at", "rating_norm")
    burst = B.members(rated, spans).select(F.lit("burst").alias("kind"), F.concat_ws(" ", "verdict", F.col("start").cast("string")).alias("key"), "id")
    groups = feats.where("dup_group_id >= 0").groupBy("dup_group_id").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.suspicion.dup_min_size)
    dup = feats.join(groups, "dup_group_id").select(F.lit("duplicate").alias("kind"), F.lpad(F.col("dup_group_id").cast("string"), 20, "0").alias("key"), "id")
    members = burst.unionByName(dup)
    if semantic is not None:
        members = members.unionByName(semantic.where("cluster >= 0").select(F.lit("semantic").alias("kind"), F.lpad(F.col("cluster").cast("string"), 20, "0").alias("key"), "id"))
    members = cut(members)
    rank = F.create_map(*[x for k, v in KIND_ORDER.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    keys = members.groupBy("kind", "key").agg(F.count("*").alias("size"))
    numbered = cut(keys.withColumn("cluster_id", F.row_number().over(Window.orderBy(rank, "key")) - 1))  # a row a cluster
    return numbered, cut(members.join(numbered, ["kind", "key"]).select("cluster_id", "kind", "id"))


def score_clusters(numbered: DataFrame, members: DataFrame, feats: DataFrame, spans: DataFrame, vectors: DataFrame | None, answers: DataFrame | None, cfg: Config) -> DataFrame:
    """Clusters with their factors (null: not known) and suspicion."""
    s = cfg.suspicion
    rows = members.join(feats.select("id", "created_at", "rating_norm", "single_review_account", "low_playtime"), "id")
    fresh = F.coalesce("single_review_account", F.lit(False)) | F.coalesce("low_playtime", F.lit(False))
    known = feats.agg(F.count("single_review_account").alias("known"), F.avg(fresh.cast("double")).alias("base"))
    grouped = rows.groupBy("cluster_id").agg(C.homogeneity().alias("rating_homogeneity"), F.avg(fresh.cast("double")).alias("fresh"), F.min("created_at").alias("t_start"), F.max("created_at").alias("t_end"))
    out = numbered.join(grouped, "cluster_id").crossJoin(F.broadcast(known))
    out = out.withColumn("new_account_share", F.when(F.col("known") > 0, C.account_lift(F.col("fresh"), F.col("base"))))
    inside = rows.where("kind <> 'burst'").withColumnRenamed("cluster_id", "cluster")
    sizes = inside.where("created_at IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("size"))
    dense = C.time_concentration(inside, C.expected_others(sizes, feats, s), s).select(F.col("cluster").alias("cluster_id"), F.col("concentration").alias("dense"), F.col("hours").alias("window_hours"), F.col("count").alias("window_count"), F.col("start").alias("window_start"), (F.col("expected") + 1).alias("window_expected"))
    rate = spans.select(F.lit("burst").alias("kind"), F.concat_ws(" ", "verdict", F.col("start").cast("string")).alias("key"), F.greatest(F.lit(0.0), 1 - F.col("baseline_per_hour") / F.greatest(F.col("size") / F.col("hours"), F.lit(1e-9))).alias("rate"), (F.col("size") / F.col("hours")).alias("per_hour"), "baseline_per_hour")
    out = out.join(dense, "cluster_id", "left").join(rate, ["kind", "key"], "left").withColumn("time_concentration", F.coalesce("rate", "dense"))
    if vectors is not None:
        like = C.centroid_similarity(members.join(vectors.select("id", "embedding"), "id"), "cluster_id", cosine=s.cosine).select("cluster_id", "similarity")
        out = out.join(like, "cluster_id", "left")
    else:
        out = out.withColumn("similarity", F.lit(None).cast("double"))
    if answers is not None:
        p = F.aggregate(F.map_values(F.map_filter("probabilities", lambda k, _: k.isin(*s.offtopic_topics))), F.lit(0.0), lambda a, x: a + x)
        off = members.join(answers.where("question = 'topic'").select("id", p.alias("p")), "id", "left").groupBy("cluster_id").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("offtopic_mean"))
        out = out.join(off, "cluster_id")
    else:
        out = out.withColumn("offtopic_mean", F.lit(None).cast("double"))
    names = ("time_concentration", "similarity", "rating_homogeneity", "new_account_share", "offtopic_mean")
    suspicion = F.round(C.geometric_mean({n: F.col(n) for n in names}, s), 4)
    dense = F.when(F.col("rate").isNull(), F.col("window_count"))
    said = caption(F.col("size"), F.col("per_hour"), F.col("baseline_per_hour"), dense, F.col("window_hours"), F.col("window_expected"), F.col("similarity"), F.col("rating_homogeneity") * 0.5 + 0.5, F.when(F.col("known") > 0, F.col("fresh")), F.col("offtopic_mean"))
    window = ["per_hour", "baseline_per_hour", "window_hours", "window_count", "window_start", "window_expected"]
    return out.select("cluster_id", "kind", "key", "size", "t_start", "t_end", *[F.round(n, 4).alias(n) for n in names], suspicion.alias("suspicion"), said.alias("caption"), *window)


def analyse(reviews: DataFrame, cfg: Config = Config(), answers: DataFrame | None = None, vectors: DataFrame | None = None, semantic: DataFrame | None = None) -> Result:
    """All tables of a run over reviews (id, text, meta, created_at, rating_norm).

    ``answers``: long typed answers, none for the heuristic run; ``vectors``:
    (id, embedding); ``semantic``: (id, cluster), -1 for noise; without it the
    vectors' density clusters are taken.
    """
    if semantic is None and vectors is not None:
        semantic = cut(DN.density_clusters(vectors, cfg.suspicion.semantic_min_size, id_col="id"))
    feats = cut(features(reviews, cfg))
    spans = cut(B.windows(B.scored_hours(feats, cfg.bursts), cfg.bursts))
    numbered, members = find_clusters(feats, spans, cfg, semantic)
    clusters = cut(score_clusters(numbered, members, feats, spans, vectors, answers, cfg))
    p = cfg.policy
    eligible = clusters.where(F.col("kind").isin(*p.cluster_kinds))
    best = C.best_membership(members.select("cluster_id", "id"), eligible, members.where("kind = 'burst'"), p.cluster_min_size, p.semantic_in_bursts_only)
    joined = base_decisions(feats, cfg, answers).join(best, "id", "left").join(feats.select("id", "rating_norm", "created_at"), "id")
    final = PO.clustered(F.col("base"), F.coalesce("suspicion", F.lit(0.0)), F.col("kind"), F.col("later_copy"), p)
    decisions = cut(joined.withColumn("d", final).select(
        "id", "rating_norm", "created_at", F.col("d.code").alias("code"), PO.action_name(F.col("d.code")).alias("action"), PO.weight_of(F.col("d.code"), cfg.weights).alias("weight"),
        F.round("d.score", 4).alias("integrity_score"), F.round("base.score", 4).alias("base_integrity"), F.col("d.reasons").alias("reasons"),
        F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.round(F.coalesce("suspicion", F.lit(0.0)), 4).alias("cluster_suspicion"),
    ))
    off = answers_offtopic(answers) if answers is not None else None
    rows = decisions.join(feats.select("id", (~F.col("not_purchased")).alias("purchased")), "id")
    rows = rows.join(off, "id", "left") if off is not None else rows.withColumn("offtopic", F.lit(None).cast("double"))
    windows = PL.qualified(rows, spans, cfg.platform)
    if cfg.platform.extend:
        windows = PL.extended(rows, windows, cfg.platform)
    return Result(feats, spans, clusters, members, decisions, RA.summary(decisions), RA.bootstrap(decisions, cfg.resamples, cfg.seed), PL.rating(PL.classes(rows, windows, cfg.platform)))


def answers_offtopic(answers: DataFrame) -> DataFrame:
    of = lambda q, c: F.max(F.when(F.col("question") == q, F.col(c)))
    return answers.groupBy("id").agg(of("verdict_basis", "value").alias("b"), of("topic", "choice").alias("t")).select("id", PL.offtopic(F.col("b"), F.col("t")).alias("offtopic"))
