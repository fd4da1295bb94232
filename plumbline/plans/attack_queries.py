"""Queries of the attack benchmark: waves, how they fare, collateral, controls, changes between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import attacks as A
from plumbline.operators import policy as PO
from plumbline.plans import sql as S
from plumbline.plans.corpus_queries import shown
from plumbline.plans.decision_queries import judged
from plumbline.plans.inspect_queries import CLUSTERS, DECIDED, clusters_of, members_of
from plumbline.registry import query
from plumbline.sources import reviews as R


def _wave_sql(a: A.Attack, seed: int = 7) -> str:
    """One wave's rows in DuckDB."""
    draw = lambda what: f"CAST(('0x' || substr(md5('{seed}|{a.kind}|' || i || '|{what}'), 1, 8)) AS BIGINT)"
    parts = [f"(['" + "', '".join(x.replace("'", "''") for x in p) + f"'])[{draw(f'part{k}')} % {len(p)} + 1]" for k, p in enumerate(a.parts)]
    verdict = f"CASE WHEN {draw('verdict')} / 4294967296e0 < 0.5 THEN 1e0 ELSE 0e0 END" if a.positive is None else f"{1 if a.positive else 0}e0"
    fresh = f"{draw('account')} / 4294967296e0 < {a.new_accounts}"
    minutes = f"CASE WHEN {draw('playtime')} / 4294967296e0 < {a.low_playtime} THEN 5 + {draw('minutes')} % 106 ELSE 150 + {draw('minutes')} % 8851 END"
    return f"""SELECT '{a.kind}' AS wave, i, format('inj-{a.kind}-{{:04d}}', i) AS ext_id, concat_ws(' ', {', '.join(parts)}) AS text, {verdict} AS rating_norm, TIMESTAMP '{a.start}' + to_seconds({draw('time')} % {int(a.hours * 3600)}) AS created_at,
      CASE WHEN {fresh} THEN 1 ELSE 2 + {draw('reviews')} % 59 END AS n_reviews, {minutes} AS minutes, {draw('purchase')} / 4294967296e0 < 0.85 AS purchased FROM range({a.n}) t(i)"""


WAVES = "waves AS (" + " UNION ALL ".join(_wave_sql(a) for a in A.ATTACKS) + ")"


@query(f"""WITH {WAVES} SELECT ext_id, text, rating_norm, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, n_reviews, minutes, purchased FROM waves
UNION ALL SELECT CAST(event_id AS VARCHAR), event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 ELSE 0e0 END, strftime(ts, '%Y-%m-%d %H:%M:%S'), NULL, NULL, NULL FROM events""")
def injected_waves(spark, sf_dir):
    """The events as reviews, with five waves of injected reviews and their account mix among them."""
    events = R.read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ext_id"), F.col("event_type").alias("text"), F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(0.0).alias("rating_norm"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("meta"))
    m = F.from_json("meta", "author_num_reviews long, author_playtime_at_review long, steam_purchase boolean")
    return A.attacked(events, A.injected_rows(spark)).select("ext_id", "text", "rating_norm", shown("created_at"), m["author_num_reviews"].alias("n_reviews"), m["author_playtime_at_review"].alias("minutes"), m["steam_purchase"].alias("purchased"))


@query(f"WITH {WAVES} SELECT wave, count(*) AS n, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last FROM waves GROUP BY wave")
def attack_truth(spark, sf_dir):
    """Waves told apart by the id of their rows; organic rows have none."""
    organic = R.read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ext_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    both = A.attacked(organic, A.injected_rows(spark))
    return both.withColumn("wave", A.truth(F.col("ext_id"))).where("wave IS NOT NULL").groupBy("wave").agg(F.count("*").alias("n"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


#: A decided run in which every ninth review is taken for an injected one of one of five waves.
TAGGED = """tagged AS (SELECT *, CASE WHEN id % 9 = 4 THEN 'w' || (id // 9) % 5 END AS wave FROM decided),
pen AS (SELECT m.id, bool_or(suspicion > 0.5 AND size >= 10) AS penalised, count(*) AS k FROM members m JOIN clusters c USING (cluster_id) WHERE m.id % 4 <> 0 GROUP BY m.id)"""


def tagged(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rows.withColumn("wave", F.when(F.col("id") % 9 == 4, F.concat(F.lit("w"), (F.floor(F.col("id") / 9) % 5).cast("string"))))


@query(DECIDED + f", {CLUSTERS}, {TAGGED}" + """ SELECT wave, count(*) AS n, round(avg(CASE WHEN code <> 1 THEN 1e0 ELSE 0e0 END), 6) AS caught, round(avg(CASE WHEN code IN (2, 4) THEN 1e0 ELSE 0e0 END), 6) AS discounted, round(avg(CASE WHEN code = 4 THEN 1e0 ELSE 0e0 END), 6) AS excluded,
  round(avg(CASE WHEN code = 3 THEN 1e0 ELSE 0e0 END), 6) AS flagged, round(avg(weight), 6) AS mean_weight, round(avg(CASE WHEN pen.k IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS in_cluster, round(avg(CASE WHEN penalised THEN 1e0 ELSE 0e0 END), 6) AS in_penalised_cluster
FROM tagged LEFT JOIN pen USING (id) WHERE wave IS NOT NULL GROUP BY wave""")
def attack_metrics(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    out = A.attack_metrics(rows, A.cluster_map(members_of(rows).where("id % 4 <> 0"), clusters_of(rows)))
    return out.select("wave", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(DECIDED + f", {CLUSTERS} SELECT m.id, kind, cluster_id, suspicion > 0.5 AND size >= 10 AS penalised FROM members m JOIN clusters USING (cluster_id)")
def cluster_map(spark, sf_dir):
    rows = judged(spark, sf_dir)
    found = A.cluster_map(members_of(rows), clusters_of(rows))
    return found.select("id", F.explode("by_kind").alias("kind", "c")).select("id", "kind", "c.cluster_id", "c.penalised")


#: The organic part of the tagged run as a run of its own: decided by other thresholds.
ALIGNED = """organic AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS clean_id, CASE WHEN spam > 0.9e0 THEN 3 WHEN score0 < 0.7e0 THEN 2 ELSE 1 END AS clean_code FROM tagged WHERE wave IS NULL),
w AS (SELECT *, (['0', '1', '0.25', '1', '0'])[clean_code + 1]::DOUBLE AS clean_weight FROM organic)"""


def clean_run(rows):
    """The organic reviews of a tagged run, numbered on their own, with stricter decisions."""
    strict = F.when(F.col("spam") > 0.9, 3).when(F.col("score") < 0.7, 2).otherwise(1)
    organic = rows.where("wave IS NULL").withColumn("strict", strict)
    return R.chronological(organic.select("created_at", "ext_id", "rating_norm", F.col("strict").alias("code")), "created_at", "ext_id")


@query(DECIDED.rstrip() + f", {CLUSTERS}, {TAGGED}, {ALIGNED} SELECT id, clean_id, code, clean_code FROM w")
def aligned_runs(spark, sf_dir):
    """Organic reviews of the attacked run beside those of the clean one."""
    rows = tagged(spark, sf_dir)
    return A.aligned(clean_run(rows), rows, 64).select("id", "clean_id", "code", "clean_code")


@query(DECIDED.rstrip() + f", {CLUSTERS}, {TAGGED}, {ALIGNED} SELECT count(*) AS organic, count(*) FILTER (weight < clean_weight - 1e-9) AS lowered, round(avg(CASE WHEN weight < clean_weight - 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS lowered_share, count(*) FILTER (weight > clean_weight + 1e-9) AS raised, round(avg(CASE WHEN clean_weight < 1 THEN 1e0 ELSE 0e0 END), 6) AS discounted_clean, round(avg(CASE WHEN weight < 1 THEN 1e0 ELSE 0e0 END), 6) AS discounted_attacked FROM w")
def attack_collateral(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    out = A.collateral(A.aligned(clean_run(rows), rows, 64))
    return out.select("organic", "lowered", F.round("lowered_share", 6).alias("lowered_share"), "raised", F.round("discounted_clean", 6).alias("discounted_clean"), F.round("discounted_attacked", 6).alias("discounted_attacked"))


PULL = DECIDED.rstrip() + f""", {CLUSTERS}, {TAGGED}, {ALIGNED}, r AS (SELECT (SELECT avg(rating_norm) FROM w) AS r0, (SELECT sum(clean_weight * rating_norm) / sum(clean_weight) FROM w) AS a0, (SELECT avg(rating_norm) FROM tagged) AS r1, (SELECT sum(weight * rating_norm) / sum(weight) FROM tagged) AS a1)
SELECT round(r1 - r0, 6) AS raw_shift, round(a1 - a0, 6) AS adjusted_shift, round(1 - (a1 - a0) / (r1 - r0), 4) AS pull_removed FROM r"""


@query(PULL)
def pull_removed(spark, sf_dir):
    """How far the tagged rows move the raw and the adjusted rating, and the share of the pull removed."""
    from plumbline.operators import evaluate as E

    rows = tagged(spark, sf_dir)
    rating = lambda df: df.agg(F.avg("rating_norm").alias("raw"), A.weighted_rating(A.bench_weight(F.col("code"))).alias("adjusted"))
    out = E.pull_removed(rating(clean_run(rows)), rating(rows))
    return out.select(F.round("raw_shift", 6).alias("raw_shift"), F.round("adjusted_shift", 6).alias("adjusted_shift"), F.round("pull_removed", 4).alias("pull_removed"))


def _ari(kind: str) -> str:
    return f"""SELECT '{kind}' AS kind, CAST(n AS BIGINT) AS n, round((i - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 6) AS ari FROM (
  SELECT (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*)::DOUBLE AS c FROM l_{kind} GROUP BY wave, label)) AS i, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*)::DOUBLE AS c FROM l_{kind} GROUP BY wave)) AS ra, (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*)::DOUBLE AS c FROM l_{kind} GROUP BY label)) AS rb, (SELECT count(*)::DOUBLE FROM l_{kind}) AS n)"""


ARI_LABELS = ", ".join(f"l_{k} AS (SELECT wave, CASE WHEN c.kind = '{k}' THEN CAST(m.cluster_id AS VARCHAR) ELSE 'none-' || t.id END AS label FROM tagged t JOIN members m USING (id) JOIN clusters c USING (cluster_id) WHERE wave IS NOT NULL)" for k in ("duplicate", "semantic", "burst"))


@query(DECIDED + f", {CLUSTERS}, {TAGGED}, {ARI_LABELS} " + " UNION ALL ".join(_ari(k) for k in ("duplicate", "semantic", "burst")))
def cluster_ari_by_kind(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    return A.ari_by_kind(rows, members_of(rows), clusters_of(rows)).withColumn("ari", F.round("ari", 6))


BURST = "inside AS (SELECT id FROM decided WHERE hour(created_at) IN (3, 4, 5, 17))"


def in_burst(rows):
    return rows.where(F.hour("created_at").isin(3, 4, 5, 17)).select("id")


@query(DECIDED + f", {BURST}, neg AS (SELECT d.*, about_game >= 0.5 AS on_topic, code IN (2, 4) AS hit, i.id IS NOT NULL AS b FROM decided d LEFT JOIN inside i ON i.id = d.id WHERE rating_norm < 0.5) SELECT count(*) AS negatives, count(*) FILTER (on_topic) AS on_topic, count(*) FILTER (on_topic AND hit) AS discounted, round(count(*) FILTER (on_topic AND hit) / count(*) FILTER (on_topic), 6) AS fp_rate, count(*) FILTER (on_topic AND b) AS on_topic_in_bursts, count(*) FILTER (on_topic AND hit AND b) AS discounted_in_bursts FROM neg")
def control_metrics(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return A.control_metrics(rows, in_burst(rows)).withColumn("fp_rate", F.round("fp_rate", 6))


@query(DECIDED + "SELECT coalesce(reasons[1], 'OTHER') AS reason, count(*) AS n FROM decided WHERE rating_norm < 0.5 AND about_game >= 0.5 AND code IN (2, 4) GROUP BY 1")
def control_reasons(spark, sf_dir):
    return A.control_reasons(judged(spark, sf_dir))


TWO = """two AS (SELECT d.*, CASE WHEN spam > 0.9e0 THEN 3 WHEN score0 < 0.7e0 THEN 2 ELSE 1 END AS other, CASE WHEN i.id IS NOT NULL THEN 'bursts' ELSE 'normal' END AS period, ['PENDING','KEEP','DOWNWEIGHT','FLAG','EXCLUDE'] AS names FROM decided d LEFT JOIN inside i ON i.id = d.id)"""


def two_runs(spark, sf_dir):
    rows = judged(spark, sf_dir)
    other = rows.select("id", F.when(F.col("spam") > 0.9, 3).when(F.col("score") < 0.7, 2).otherwise(1).alias("code"))
    return rows, other, in_burst(rows)


@query(DECIDED + f", {BURST}, {TWO} SELECT period, names[code + 1] || '->' || names[other + 1] AS transition, count(*) AS n FROM two WHERE code <> other GROUP BY 1, 2")
def changes_by_period(spark, sf_dir):
    return A.changed_by_period(*two_runs(spark, sf_dir))


@query(DECIDED + f", {BURST}, {TWO} SELECT period, count(*) AS reviews, count(*) FILTER (code <> other) AS changed, round(avg(CASE WHEN code <> other THEN 1e0 ELSE 0e0 END), 6) AS changed_share FROM two GROUP BY period")
def period_shares(spark, sf_dir):
    return A.period_shares(*two_runs(spark, sf_dir)).withColumn("changed_share", F.round("changed_share", 6))


@query(DECIDED + f", {BURST}, {TWO} SELECT id, names[code + 1] AS x, names[other + 1] AS y, left(text, 200) AS text FROM two WHERE code <> other AND period = 'normal' ORDER BY id LIMIT 8")
def changed_examples(spark, sf_dir):
    a, b, inside = two_runs(spark, sf_dir)
    return A.changed_examples(a, b, inside, a)


@query(S.over_reviews(WAVES, f"every AS (SELECT wave, text FROM waves UNION ALL SELECT NULL, text FROM reviews), texts AS (SELECT text, {S.TOKENS} AS n_tokens, {S.SYMBOLS} AS symbols, {S.PROMO} AS promo FROM (SELECT DISTINCT text FROM every))") + """
SELECT wave, CASE WHEN promo THEN 3 WHEN n_tokens <= 3 OR symbols > 0.5 THEN 2 ELSE 1 END AS code, count(*) AS n FROM every JOIN texts USING (text) GROUP BY 1, 2""")
def waves_by_heuristics(spark, sf_dir):
    """What the decisions without a model make of the waves and of the organic reviews; a document's text is decided once."""
    c = F.col("text")
    code = PO.heuristic(T.token_count(c), T.symbol_ratio(c), T.has_promo(c))["code"]
    organic = R.unnumbered(spark, sf_dir, {"code": code}).select(F.col("ext_id").cast("string").alias("ext_id"), "code")
    every = A.attacked(organic, A.injected_rows(spark).withColumn("code", code))
    return every.groupBy(A.truth(F.col("ext_id")).alias("wave"), "code").agg(F.count("*").alias("n"))


SWEPT = (("loose", 0.4), ("usual", 0.55), ("strict", 0.7))


@query(DECIDED + ", s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS setting, rating_norm, CASE WHEN spam > 0.9e0 THEN 3 WHEN score0 < {x}e0 THEN 2 ELSE 1 END AS code FROM decided" for n, x in SWEPT) + """), w AS (SELECT *, CASE code WHEN 2 THEN 0.25e0 ELSE 1e0 END AS w FROM s)
SELECT setting, count(*) AS n, round(avg(rating_norm), 6) AS raw, round(sum(w * rating_norm) / sum(w), 6) AS adjusted, count(*) FILTER (code = 2) AS n_downweight, count(*) FILTER (code = 3) AS n_flag, count(*) FILTER (code = 4) AS n_exclude FROM w GROUP BY setting""")
def swept_settings(spark, sf_dir):
    """One set of answers decided under three thresholds."""
    from plumbline.config import Config
    from plumbline.operators import evaluate as E

    rows = R.numbered_answers(R.reviews(spark, sf_dir))
    out = E.sweep(rows, lambda c: PO.judged(c.policy), Config(), {n: {"policy.downweight_below": x} for n, x in SWEPT})
    return out.withColumns({"raw": F.round("raw", 6), "adjusted": F.round("adjusted", 6)})
