"""Queries of the drill-downs: pages, details, clusters, buckets, and the reports of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import attacks as A
from plumbline.operators import drilldown as I
from plumbline.operators import summary as SU
from plumbline.plans import sql as S
from plumbline.plans.corpus_queries import shown
from plumbline.plans.decision_queries import PLATFORM, classed, judged
from plumbline.registry import query
from plumbline.sources import reviews as R

DECIDED = S.over_reviews(S.ANSWERS, S.JUDGED)
KIND = "CASE author_id % 3 WHEN 0 THEN 'burst' WHEN 1 THEN 'duplicate' ELSE 'semantic' END"
CLUSTERS = f"""clusters AS (SELECT author_id AS cluster_id, {KIND} AS kind, ((author_id * 37 + 11) % 100) / 100e0 AS suspicion, count(*) AS size FROM decided GROUP BY author_id),
members AS (SELECT author_id AS cluster_id, id FROM decided)"""
ACTION = "['PENDING','KEEP','DOWNWEIGHT','FLAG','EXCLUDE'][code + 1]"


def kind_of(author):
    return F.when(author % 3 == 0, "burst").when(author % 3 == 1, "duplicate").otherwise("semantic")


def members_of(rows):
    return rows.select(F.col("author_id").alias("cluster_id"), "id")


def clusters_of(rows):
    """Authors as clusters, with suspicion by integer arithmetic."""
    a = F.col("author_id")
    return rows.groupBy(a.alias("cluster_id"), kind_of(a).alias("kind"), (((a * 37 + 11) % 100) / F.lit(100.0)).alias("suspicion")).agg(F.count("*").alias("size"))


def split(rows):
    """(reviews, decisions) of decided reviews."""
    return rows.select("id", "text", "rating_norm", "created_at"), rows.select("id", "code", "action", "weight", "score", "reasons")


def page_query(sort, f, limit, offset, missing=None):
    def run(spark, sf_dir):
        rows = judged(spark, sf_dir)
        texts = lambda ids: R.reviews(spark, sf_dir, only=ids).select("id", "text")
        found = I.page(I.matching(*split(rows), members_of(rows), f).select("id", "action", "score"), sort, limit, offset, missing, texts)
        return found.select("id", "action", F.round("score", 6).alias("score"), "snippet", "total")

    return run


@query(DECIDED + f"""SELECT id, {ACTION} AS action, round(score, 6) AS score, left(text, 220) AS snippet, total FROM (SELECT *, count(*) OVER () AS total FROM decided WHERE code = 2 AND author_id = 7) ORDER BY id LIMIT 20 OFFSET 5""")
def review_page_of_cluster(spark, sf_dir):
    """Downweighted members of a cluster in time order, with the number of all of them."""
    return page_query("time", I.ReviewFilter(action="downweight", cluster=7), 20, 5)(spark, sf_dir)


@query(DECIDED + f"""SELECT id, {ACTION} AS action, round(score, 6) AS score, left(text, 220) AS snippet, total FROM (SELECT *, count(*) OVER () AS total FROM decided WHERE list_contains(reasons, 'SPAM') AND rating_norm >= 0.5 AND text ILIKE '%AND%') ORDER BY round(coalesce(score, 2), 9), id LIMIT 500""")
def review_page_by_integrity(spark, sf_dir):
    """Positive reviews with a reason and a word, least integrity first; a missing score sorts as 2; the limit is cut to what a page can have."""
    return page_query("integrity", I.ReviewFilter(reason="spam", verdict="positive", text="AND"), 9_999, 0, 2.0)(spark, sf_dir)


@query(DECIDED + f"SELECT id, {ACTION} AS action, round(score, 6) AS score, left(text, 220) AS snippet, total FROM (SELECT *, count(*) OVER () AS total FROM decided) ORDER BY id LIMIT 50")
def review_page_unfiltered(spark, sf_dir):
    return page_query("time", I.ReviewFilter(), 50, 0)(spark, sf_dir)


@query(DECIDED + f"""SELECT id, CASE WHEN id % 13 <> 0 THEN {ACTION} END AS action, CASE WHEN id % 13 <> 0 THEN round(score, 6) END AS score, CASE WHEN id % 13 <> 0 AND id % 4 <> 0 THEN author_id END AS cluster_id,
  CASE WHEN id % 13 <> 0 AND id % 4 <> 0 THEN {KIND} END AS cluster_kind, CASE WHEN id % 5 = 0 AND id % 3 <> 0 THEN id - id % 3 END AS duplicate_of, CASE WHEN k % 4 <> 0 THEN round(CAST(k * 7 AS DOUBLE) / 60, 1) END AS playtime_hours,
  CASE WHEN k % 3 = 0 THEN NULL ELSE k % 2 = 0 END AS steam_purchase, (id % 7) * 900 > 3600 AS edited FROM decided""")
def review_details(spark, sf_dir):
    """All reviews' details; some have no decision, no cluster, no account data."""
    rows = judged(spark, sf_dir)
    meta = F.to_json(F.struct(F.when(F.col("k") % 4 != 0, F.col("k") * 7).alias("author_playtime_at_review"), F.when(F.col("k") % 3 != 0, F.col("k") % 2 == 0).alias("steam_purchase")))
    reviews = rows.select("id", "text", "rating_raw", "rating_norm", "created_at", (F.col("created_at") + F.make_dt_interval(secs=(F.col("id") % 7) * 900)).alias("updated_at"), meta.alias("meta"))
    decisions = rows.where("id % 13 <> 0").select("id", "action", "weight", "score", "reasons", F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("author_id")).alias("cluster_id"))
    features = rows.select("id", F.lit(9).alias("n_tokens"), F.when(F.col("id") % 5 == 0, F.col("id") - F.col("id") % 3).otherwise(-1).alias("dup_of"), F.lit(1.0).alias("dup_score"))
    out = I.details(reviews, decisions, features, clusters_of(rows).withColumn("caption", F.lit("")))
    return out.select("id", "action", F.round("score", 6).alias("score"), "cluster_id", "cluster_kind", "duplicate_of", "playtime_hours", "steam_purchase", "edited")


@query(DECIDED + f", {CLUSTERS} SELECT cluster_id, kind, suspicion, size FROM clusters WHERE kind = 'burst' ORDER BY suspicion DESC, size DESC, cluster_id LIMIT 15")
def cluster_list(spark, sf_dir):
    return I.cluster_list(clusters_of(judged(spark, sf_dir)), "burst", 15).select("cluster_id", "kind", "suspicion", "size")


@query(DECIDED + f", {CLUSTERS} SELECT cluster_id, suspicion FROM clusters ORDER BY suspicion DESC, cluster_id LIMIT 25")
def announced_clusters(spark, sf_dir):
    return I.announced(clusters_of(judged(spark, sf_dir))).select("cluster_id", "suspicion")


@query(DECIDED + f", {CLUSTERS} SELECT cluster_id, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM members JOIN decided USING (id) GROUP BY 1, 2")
def cluster_histogram(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return I.histogram(members_of(rows), rows).select("cluster_id", shown("hour"), "n")


@query(DECIDED + f", {CLUSTERS} SELECT cluster_id, place, id, action FROM (SELECT m.cluster_id, m.id, CASE WHEN d.id % 13 <> 0 THEN {ACTION} END AS action, row_number() OVER (PARTITION BY m.cluster_id ORDER BY md5('5:' || CAST(m.id AS VARCHAR)), m.id) AS place FROM members m JOIN decided d USING (id)) WHERE place <= 6")
def cluster_sample(spark, sf_dir):
    """Six members of each cluster in a drawn order, with the decision where there is one."""
    rows = judged(spark, sf_dir)
    reviews, decisions = split(rows)
    return I.cluster_sample(members_of(rows), reviews, decisions.where("id % 13 <> 0"), 6, 5).select("cluster_id", F.col("place").cast("long").alias("place"), "id", "action")


@query(DECIDED + "SELECT id, author_id = 11 AS inside FROM decided")
def cluster_mask(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return I.membership_mask(rows, members_of(rows), 11)


@query(DECIDED + """, r AS (SELECT lang, avg(rating_norm) AS raw, sum(weight * rating_norm) / sum(weight) AS adj FROM decided GROUP BY lang)
SELECT lang, round(raw * 100, 4) AS percent, round(1 + raw * 4, 4) AS stars5, round(1 + raw * 9, 4) AS stars10, CASE WHEN adj * 100 - raw * 100 > 0 THEN '+' WHEN adj * 100 - raw * 100 < 0 THEN '−' ELSE '±' END || printf('%.1f pp', abs(adj * 100 - raw * 100)) AS delta FROM r""")
def shown_ratings(spark, sf_dir):
    per = judged(spark, sf_dir).groupBy("lang").agg(F.avg("rating_norm").alias("raw"), A.weighted_rating(F.col("weight")).alias("adj"))
    raw = F.col("raw")
    return per.select("lang", F.round(I.shown_rating(raw, "binary"), 4).alias("percent"), F.round(I.shown_rating(raw, "1-5"), 4).alias("stars5"), F.round(I.shown_rating(raw, "1-10"), 4).alias("stars10"), I.shown_delta(raw, F.col("adj"), "binary").alias("delta"))


BUCKETS = "buckets AS (SELECT hour, first_id, n, row_number() OVER (ORDER BY hour) - 1 AS bucket FROM (SELECT date_trunc('hour', created_at) AS hour, min(id) AS first_id, count(*) AS n FROM reviews WHERE id % 3 <> 1 GROUP BY 1))"


def sparse(spark, sf_dir):
    """Reviews of some ids, so that ids and hours have gaps."""
    return R.reviews(spark, sf_dir).where("id % 3 <> 1 AND hour(created_at) % 4 <> 2")


@query(S.over_reviews(BUCKETS.replace("id % 3 <> 1", "id % 3 <> 1 AND hour(created_at) % 4 <> 2")) + "SELECT r.id, coalesce(max(b.bucket), -1) AS bucket FROM reviews r LEFT JOIN buckets b ON r.id >= b.first_id AND r.id < b.first_id + b.n GROUP BY r.id")
def bucket_of_index(spark, sf_dir):
    buckets = I.hour_buckets(sparse(spark, sf_dir))
    return I.bucket_of_index(R.reviews(spark, sf_dir).select("id"), buckets).select("id", F.col("bucket").cast("long").alias("bucket"))


@query(S.over_reviews(BUCKETS.replace("id % 3 <> 1", "id % 3 <> 1 AND hour(created_at) % 4 <> 2")) + """, near AS (SELECT r.id, r.created_at AS t, max(b.bucket) FILTER (b.hour <= r.created_at) AS lo, min(b.bucket) FILTER (b.hour > r.created_at) AS hi FROM reviews r CROSS JOIN buckets b WHERE r.id % 20 = 0 GROUP BY r.id, r.created_at)
SELECT id, CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo WHEN epoch_us(t) - epoch_us(l.hour) < 3600000000 THEN lo WHEN epoch_us(h.hour) - epoch_us(t) <= epoch_us(t) - epoch_us(l.hour) - 3600000000 THEN hi ELSE lo END AS bucket
FROM near LEFT JOIN buckets l ON l.bucket = lo LEFT JOIN buckets h ON h.bucket = hi""")
def nearest_bucket(spark, sf_dir):
    """The hour that holds or lies nearest to each twentieth review; every fourth hour is left out."""
    asked = R.reviews(spark, sf_dir).where("id % 20 = 0").select("id", F.col("created_at").alias("t"))
    return I.nearest_bucket(asked, I.hour_buckets(sparse(spark, sf_dir))).select("id", F.col("bucket").cast("long").alias("bucket"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 23:59:59'")
def pulled_in_days(spark, sf_dir):
    """Rows of an inclusive range of days."""
    return R.read(spark, sf_dir, "events").where(I.in_days(F.col("ts").cast("timestamp_ntz"), "2024-01-05", "2024-01-09")).select("event_id", shown("ts"))


@query("SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at FROM events")
def epoch_to_time(spark, sf_dir):
    """Epoch seconds back to UTC times."""
    rows = R.read(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return rows.select("event_id", R.parsed_time(rows, "s").alias("created_at")).select("event_id", shown("created_at"))


@query("SELECT l_orderkey, l_linenumber, h AS hours, CASE WHEN h < 1 THEN CAST(floor(h * 60) AS INTEGER) || ' min' WHEN h < 48 THEN regexp_replace(CAST(round(h, 4) AS VARCHAR), '\\.0+$', '') || ' h' ELSE regexp_replace(CAST(round(h / 24, 4) AS VARCHAR), '\\.0+$', '') || ' days' END AS words FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) * CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 0.0625 END AS h FROM lineitem)")
def window_words(spark, sf_dir):
    h = F.col("l_quantity").cast("double") * F.when(F.col("l_linenumber") % 2 == 0, 3.0).otherwise(0.0625)
    return R.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", h.alias("hours"), I.window_words(h).alias("words"))


@query(DECIDED + r"""SELECT id, CASE WHEN id % 17 = 0 THEN 'No rating given' ELSE ['Very negative', 'Negative', 'Mixed', 'Positive', 'Very positive'][CAST(least(5, floor((rating_raw - 1) / 4 * 5) + 1) AS INTEGER)] || ' (' || CAST(CAST(rating_raw AS BIGINT) AS VARCHAR) || ' of 5 stars)' END AS stars,
  CASE WHEN rating_norm >= 0.5 THEN 'Recommended' ELSE 'Not recommended' END AS binary_verdict FROM decided""")
def verdict_in_words(spark, sf_dir):
    rows = judged(spark, sf_dir)
    norm = F.when(F.col("id") % 17 != 0, R.normal_rating(F.col("rating_raw"), "1-5"))
    return rows.select("id", T.verdict_words(F.col("rating_raw"), norm, "1-5").alias("stars"), T.verdict_words(F.col("rating_raw"), F.col("rating_norm"), "binary").alias("binary_verdict"))


@query(DECIDED + """, c AS (SELECT author_id AS cluster_id, count(*) AS size, avg(rating_norm) AS pos, avg(about_game) AS off, max(author_id % 4) AS kind FROM decided GROUP BY author_id)
SELECT cluster_id, format('{:,}', size) || ' reviews' || CASE WHEN kind = 0 THEN ' · ' || CAST(round_even(size / 7e0, 0) AS BIGINT) || '/h vs a baseline of ' || CAST(round_even(size / 20e0, 0) AS BIGINT) || '/h' WHEN kind = 1 THEN ' · ' || format('{:,}', size // 2) || ' within 6 h (~' || printf('%.1f', size / 16e0) || ' for a random ' || format('{:,}', size) || ')' ELSE '' END
  || ' · ' || CAST(round_even(greatest(pos, 1 - pos) * 100, 0) AS INTEGER) || '% same verdict' || CASE WHEN kind < 3 THEN ' · ' || CAST(round_even(off * 100, 0) AS INTEGER) || '% off-topic' ELSE '' END AS caption FROM c""")
def cluster_captions(spark, sf_dir):
    """Captions of bursts, of dense clusters and of clusters about which time tells nothing."""
    per = judged(spark, sf_dir).groupBy(F.col("author_id").alias("cluster_id")).agg(F.count("*").alias("size"), F.avg("rating_norm").alias("pos"), I.exact_mean(F.col("about_game")).alias("off"), F.max(F.col("author_id") % 4).alias("kind"))
    size, burst, dense = F.col("size"), F.col("kind") == 0, F.col("kind") == 1
    none = F.lit(None).cast("double")
    said = I.caption(size, F.when(burst, size / 7), F.when(burst, size / 20), F.when(dense, F.floor(size / 2)), F.lit(6.0), size / 16, none, F.greatest(F.col("pos"), 1 - F.col("pos")), none, F.when(F.col("kind") < 3, F.col("off")))
    return per.select("cluster_id", said.alias("caption"))


# --- reports of a run


FEATS = f"""copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {S.NORMALISED}) AS first, count(*) OVER (PARTITION BY {S.NORMALISED}) AS copies, {S.TOKENS} AS n_tokens, {S.PROMO} AS has_promo FROM documents),
feats AS (SELECT doc_id AS id, doc_id % 9 = 0 AS has_url, has_promo, n_tokens, CASE WHEN copies > 1 THEN first ELSE -1 END AS g, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 7 = 0 END AS low_playtime FROM copies)"""


@query(f"""WITH {FEATS} SELECT count(*) AS reviews, count(*) FILTER (has_url) AS with_url, count(*) FILTER (has_promo) AS promo, count(*) FILTER (n_tokens <= 3) AS low_info, count(*) FILTER (g >= 0) AS exact_dup_reviews, count(*) FILTER (g >= 0) AS near_dup_reviews,
  count(DISTINCT g) FILTER (g >= 0) AS dup_groups, count(*) FILTER (g >= 0 AND g <> id AND n_tokens >= 8) AS later_copies, count(*) FILTER (low_playtime) AS low_playtime, 0 AS single_review_account FROM feats""")
def feature_counts(spark, sf_dir):
    docs, c = R.read(spark, sf_dir, "documents"), F.col("text")
    rows = docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 9 == 0).alias("has_url"), T.has_promo(c).alias("has_promo"), T.token_count(c).alias("n_tokens"), T.normalised(c).alias("norm"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 7 == 0).alias("low_playtime"))
    groups = rows.groupBy("norm").agg(F.when(F.count("*") > 1, F.min("id")).otherwise(-1).alias("g"))
    feats = rows.join(groups, "norm").withColumns({"exact_group_id": F.col("g"), "dup_group_id": F.col("g"), "dup_of": F.col("g"), "single_review_account": F.lit(None).cast("boolean")})
    out = SU.feature_counts(feats)
    return out.select(*[F.col(n).cast("long").alias(n) for n in out.columns])


@query(DECIDED + f", {CLUSTERS} SELECT count(*) FILTER (kind = 'burst') AS burst, count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'semantic') AS semantic, count(*) FILTER (suspicion > 0.5) AS suspicious FROM clusters")
def cluster_counts(spark, sf_dir):
    return SU.cluster_counts(clusters_of(judged(spark, sf_dir)))


PENALISED = """mem AS (SELECT *, CASE author_id % 3 WHEN 0 THEN 'burst' WHEN 1 THEN 'duplicate' ELSE NULL END AS kind, ((author_id * 37 + 11) % 100) / 100e0 AS suspicion, id % 11 = 0 AS late FROM decided),
p AS (SELECT *, score * (1 - 0.5e0 * suspicion) AS pen FROM mem),
q AS (SELECT *, greatest(code, CASE WHEN pen < 0.55e0 THEN 2 ELSE 1 END, CASE WHEN late THEN 4 ELSE 0 END) AS c1 FROM p),
r AS (SELECT *, CASE WHEN abs(pen - 0.55e0) <= 0.1e0 AND c1 = 1 THEN 3 ELSE c1 END AS c2, kind IS NOT NULL AND suspicion > 0.5 AS applies FROM q)"""


def clustered(rows):
    """Decisions after the rules for clusters, authors standing for clusters."""
    from plumbline.operators import policy as PO

    a = F.col("author_id")
    kind = F.when(a % 3 == 0, "burst").when(a % 3 == 1, "duplicate")
    base = PO.decision(F.col("code"), F.col("score"), F.col("reasons"))
    d = PO.clustered(base, ((a * 37 + 11) % 100) / F.lit(100.0), kind, F.col("id") % 11 == 0)
    return rows.withColumn("d", d).select("id", "rating_norm", "created_at", "author_id", F.col("d.code").alias("code"), F.col("d.score").alias("score"), F.col("d.reasons").alias("reasons"), PO.weight_of(F.col("d.code")).alias("weight"))


@query(DECIDED + f", {PENALISED} SELECT count(*) FILTER (applies) AS penalised_reviews, count(*) FILTER (applies AND c2 <> code) AS actions_changed FROM r")
def cluster_penalties(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return SU.penalties(rows, clustered(rows))


@query(DECIDED + f""", {CLUSTERS}, s AS (SELECT count(*) AS n, count(*) FILTER (code = 1) AS k, count(*) FILTER (code = 2) AS d, count(*) FILTER (code = 3) AS f, count(*) FILTER (code = 4) AS x, avg(rating_norm) AS raw, sum(weight * rating_norm) / sum(weight) AS adj, pow(sum(weight), 2) / sum(weight * weight) AS neff FROM decided),
c AS (SELECT count(*) FILTER (kind = 'burst') AS burst, count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'semantic') AS semantic, count(*) FILTER (suspicion > 0.5) AS suspicious FROM clusters)
SELECT n AS n_reviews, 0 AS n_pending, k AS n_keep, d AS n_downweight, f AS n_flag, x AS n_exclude, round(raw, 6) AS raw, round(adj, 6) AS adjusted, round(neff, 4) AS n_eff, {S.label('raw', 'n')} AS label_raw, {S.label('adj', 'neff')} AS label_adjusted, burst, duplicate, semantic, suspicious, round(n / 12.5e0, 2) AS reviews_per_s, 'binary' AS rating_scale FROM s, c""")
def run_summary(spark, sf_dir):
    rows = judged(spark, sf_dir)
    out = SU.run_summary(rows, None, SU.cluster_counts(clusters_of(rows)), None, None, 12.5)
    return out.select("n_reviews", "n_pending", "n_keep", "n_downweight", "n_flag", "n_exclude", F.round("raw", 6).alias("raw"), F.round("adjusted", 6).alias("adjusted"), F.round("n_eff", 4).alias("n_eff"), "label_raw", "label_adjusted", "burst", "duplicate", "semantic", "suspicious", "reviews_per_s", "rating_scale")


@query(PLATFORM + ", live AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'PENDING' ELSE platform_class END AS live_class FROM classed) SELECT live_class, count(*) AS n FROM live GROUP BY 1")
def live_classes(spark, sf_dir):
    """Classes of the live view: every sixth review is still pending."""
    c = F.col("platform_class")
    rows = classed(spark, sf_dir).withColumn("live_class", SU.live_class((F.col("id") % 6 != 0).cast("int"), c == "COUNTS", c == "KEY"))
    return rows.groupBy("live_class").agg(F.count("*").alias("n"))


@query(DECIDED + "SELECT count(*) FILTER (code = 1 AND id % 6 <> 0) AS keep, count(*) FILTER (code = 2 AND id % 6 <> 0) AS down, count(*) FILTER (code = 3 AND id % 6 <> 0) AS flag, count(*) FILTER (id % 6 <> 0) AS processed, round(sum(weight * rating_norm) FILTER (id % 6 <> 0) / sum(weight) FILTER (id % 6 <> 0), 6) AS adjusted FROM decided")
def live_counters(spark, sf_dir):
    """Counters and rating over the reviews decided so far; a pending one weighs nothing."""
    rows = judged(spark, sf_dir).withColumn("code", F.when(F.col("id") % 6 == 0, 0).otherwise(F.col("code")))
    rating = rows.agg(F.round(A.weighted_rating(A.bench_weight(F.col("code"))), 6).alias("adjusted"))
    return SU.run_counters(rows, 0, 1.0).select("keep", "down", "flag", "processed").crossJoin(F.broadcast(rating))


@query(DECIDED + ", u AS (SELECT id, code, id AS seq FROM decided UNION ALL SELECT id, 4 AS code, 100000000 + id AS seq FROM decided WHERE id % 10 = 3) SELECT code, count(*) AS n FROM (SELECT id, arg_max(code, seq) AS code FROM u GROUP BY id) GROUP BY code")
def folded_updates(spark, sf_dir):
    """Update events of a run, packed and folded again: the last action of each review."""
    rows = judged(spark, sf_dir).select("id", "code")
    late = rows.where("id % 10 = 3").select("id", F.lit(4).alias("code"), (F.col("id") + 100_000_000).alias("seq"))
    events = SU.packed_updates(rows.withColumn("seq", F.col("id")).unionByName(late))
    log = events.select(F.col("batch").cast("double").alias("t"), F.lit("judged").alias("type"), F.to_json(F.struct("indices_b64", "actions_b64")).alias("body"))
    return SU.folded(log)["tally"].select(F.col("code").cast("int").alias("code"), "n")


@query(DECIDED + """, b AS (SELECT id // 10 AS t, avg(rating_norm) AS raw, avg(weight) AS adjusted FROM decided GROUP BY 1), n AS (SELECT count(*) AS n FROM b), s AS (SELECT CAST(pow(2, greatest(0, ceil(log2(n / 240e0)))) AS BIGINT) AS step, n FROM n)
SELECT t, round(raw, 6) AS raw, round(adjusted, 6) AS adjusted FROM b, s WHERE (n - 1 - t) % step = 0""")
def rating_trail(spark, sf_dir):
    """The trail of the live rating, thinned to what a chart shows."""
    per = judged(spark, sf_dir).groupBy(F.floor(F.col("id") / 10).alias("t")).agg(F.avg("rating_norm").alias("raw"), F.avg("weight").alias("adjusted"))
    log = per.select(F.col("t").cast("double").alias("t"), F.lit("rating").alias("type"), F.to_json(F.struct("raw", "adjusted")).alias("body"))
    return SU.trail(log).select(F.col("t").cast("long").alias("t"), F.round("raw", 6).alias("raw"), F.round("adjusted", 6).alias("adjusted"))


@query("SELECT count(*) AS n, count(*) FILTER (c >= 0.4) AS near FROM (SELECT max(round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)")
def near_neighbour_count(spark, sf_dir):
    """Vectors with another one at a cosine of 0.4 or more (the driver's are spread wide)."""
    from plumbline.operators import clusters as C

    return SU.near_neighbours(C.nearest(R.read(spark, sf_dir, "embeddings")).withColumn("cosine", F.round("cosine", 9)), 0.4)


RUNS = """runs AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS started_at, CASE WHEN o_orderkey % 3 = 0 THEN 'cached' ELSE 'model' END AS backend, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS reuses, CAST(o_totalprice AS DOUBLE) AS cost FROM orders)"""


def runs_of(spark, sf_dir):
    """Orders as runs."""
    o = R.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("started_at"), F.when(k % 3 == 0, "cached").otherwise("model").alias("backend"), F.when(k % 3 == 0, k - 1).alias("reuses"), F.col("o_totalprice").cast("double").alias("cost"))


@query(f"WITH {RUNS} SELECT r.id, CASE WHEN r.backend = 'cached' THEN coalesce(s.cost, 0) ELSE r.cost END AS charged FROM runs r LEFT JOIN runs s ON s.id = r.reuses")
def charged_runs(spark, sf_dir):
    return A.charged(runs_of(spark, sf_dir)).select("id", "charged")


@query(f"WITH {RUNS} SELECT id, backend FROM runs ORDER BY started_at DESC NULLS FIRST, id LIMIT 40")
def latest_runs(spark, sf_dir):
    """Runs as listed: those not started yet, then the latest."""
    from plumbline.sources import catalogue

    return catalogue.listed(runs_of(spark, sf_dir), 40).select("id", "backend")


@query(f"""WITH {RUNS} SELECT CAST(id AS VARCHAR) AS name, 1000 * cost / n AS x, shift AS y FROM (SELECT id, cost, (id % 50) * 2 + id % 7 AS n, CASE WHEN id % 4 <> 0 THEN (id % 100) / 100e0 END AS shift FROM runs) WHERE shift IS NOT NULL AND n > 0 UNION ALL
SELECT CAST(id AS VARCHAR), 0e0, (id % 100) / 100e0 FROM runs WHERE id % 4 <> 0 AND (id % 50) * 2 + id % 7 = 0""")
def cost_points(spark, sf_dir):
    r = runs_of(spark, sf_dir)
    k = F.col("id")
    return A.cost_points(r.select(k.cast("string").alias("name"), "cost", (k % 50).alias("n_organic"), (k % 7).alias("n_injected"), F.when(k % 4 != 0, (k % 100) / F.lit(100.0)).alias("shift_removed")))
