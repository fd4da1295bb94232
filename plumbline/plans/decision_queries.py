"""Queries over decisions: the heuristic and the judged policy, ratings, drill-downs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import Platform, Policy
from plumbline.functions import text as T
from plumbline.operators import evaluate as E
from plumbline.operators import judgments as J
from plumbline.operators import platform as PL
from plumbline.operators import policy as PO
from plumbline.operators import ratings as RA
from plumbline.plans import sql as S
from plumbline.registry import query
from plumbline.sources import reviews as R


def heuristic(spark, sf_dir):
    """Reviews decided without a model; texts are measured once a document, not once a review."""
    c = F.col("text")
    base = PO.heuristic(T.token_count(c), T.symbol_ratio(c), T.has_promo(c))
    return opened(R.reviews(spark, sf_dir, {"d": PO.floored(base, T.model_note(c), Policy().model_note_action, "INFLUENCE_ATTEMPT")}))


def opened(df):
    """``df`` with the decision ``d`` as columns."""
    return df.withColumns({"code": F.col("d.code"), "score": F.col("d.score"), "reasons": F.col("d.reasons")}).withColumns({"weight": PO.weight_of(F.col("code")), "action": PO.action_name(F.col("code"))}).drop("d")


def judged(spark, sf_dir, p: Policy = Policy(), each=None):
    return opened(R.numbered_answers(R.reviews(spark, sf_dir, each)).withColumn("d", PO.judged(p)))


@query(S.over_reviews(S.HEURISTIC) + f"""SELECT lang, n, round(raw, 6) AS raw, round(adjusted, 6) AS adjusted, round(n_eff, 4) AS n_eff, n_keep, n_downweight, n_flag, n_exclude, {S.label('adjusted', 'n_eff')} AS label FROM (
  SELECT lang, count(*) AS n, avg(rating_norm) AS raw, sum(weight * rating_norm) / nullif(sum(weight), 0) AS adjusted, coalesce(pow(sum(weight), 2) / nullif(sum(weight * weight), 0), 0) AS n_eff,
    count(*) FILTER (code = 1) AS n_keep, count(*) FILTER (code = 2) AS n_downweight, count(*) FILTER (code = 3) AS n_flag, count(*) FILTER (code = 4) AS n_exclude FROM decided GROUP BY lang)""")
def heuristic_rating_by_lang(spark, sf_dir):
    out = RA.summary(heuristic(spark, sf_dir), "lang")
    return out.select("lang", "n", F.round("raw", 6).alias("raw"), F.round("adjusted", 6).alias("adjusted"), F.round("n_eff", 4).alias("n_eff"), "n_keep", "n_downweight", "n_flag", "n_exclude", "label")


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT id, code, round(score, 6) AS score, array_to_string(reasons, ',') AS reasons FROM decided")
def policy_v5(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "code", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(S.over_reviews(S.ANSWERS) + """, c AS (SELECT *, 1 - (0e0 + 0.5e0 * p_contradicts + 0.2e0 * spam + 0.15e0 * templated + 0.1e0 * p_offtopic + CASE WHEN low_playtime THEN 0.2e0 * p_offtopic ELSE 0 END) AS s FROM answered)
SELECT id, CASE WHEN spam > 0.9 THEN 3 WHEN support_conf < 0.5 AND topic_conf < 0.5 THEN 3 WHEN greatest(0, s) < 0.55e0 THEN 2 ELSE 1 END AS code, round(greatest(0, s), 6) AS score FROM c""")
def policy_topic_fallback(spark, sf_dir):
    rows = R.numbered_answers(R.reviews(spark, sf_dir)).withColumns({"about_game": F.lit(None).cast("double"), "influence": F.lit(None).cast("double")})
    return opened(rows.withColumn("d", PO.judged())).select("id", "code", F.round("score", 6).alias("score"))


LATER = """copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY """ + S.NORMALISED + """) AS first, """ + S.TOKENS + """ AS n_tokens FROM documents)"""


@query(S.over_reviews(S.ANSWERS, S.JUDGED, LATER) + """SELECT id, CASE WHEN late THEN greatest(code, 2) ELSE code END AS code,
  array_to_string(CASE WHEN late THEN list_concat(['NEAR_DUPLICATE'], reasons)[1:3] ELSE reasons END, ',') AS reasons
FROM (SELECT d.*, c.first <> c.doc_id AND c.n_tokens >= 8 AS late FROM decided d CROSS JOIN nd JOIN copies c ON c.doc_id = d.ext_id % nd.n_docs)""")
def later_copy_floor(spark, sf_dir):
    """Later copies of an earlier document weigh less, at least."""
    docs = R.read(spark, sf_dir, "documents").select("doc_id", T.normalised(F.col("text")).alias("norm"), T.token_count(F.col("text")).alias("n_tokens"))
    firsts = docs.groupBy("norm").agg(F.min("doc_id").alias("first"))
    late = docs.join(firsts, "norm").select("doc_id", PO.is_later_copy(F.col("doc_id"), F.col("first"), F.col("n_tokens")).alias("late"))
    n = docs.agg(F.count("*").alias("n_docs"))
    rows = R.numbered_answers(R.reviews(spark, sf_dir)).crossJoin(F.broadcast(n)).join(late, F.col("ext_id") % F.col("n_docs") == F.col("doc_id"))
    out = opened(rows.withColumn("d", PO.floored(PO.judged(), F.col("late"), Policy().duplicate_action, "NEAR_DUPLICATE")))
    return out.select("id", "code", F.array_join("reasons", ",").alias("reasons"))


MEMBERS = """mem AS (SELECT *, CASE author_id % 3 WHEN 0 THEN 'burst' WHEN 1 THEN 'duplicate' ELSE NULL END AS kind, ((author_id * 37 + 11) % 100) / 100e0 AS suspicion, id % 11 = 0 AS late FROM decided)"""


@query(S.over_reviews(S.ANSWERS, S.JUDGED, MEMBERS) + """, p AS (SELECT *, score * (1 - 0.5e0 * suspicion) AS pen FROM mem),
q AS (SELECT *, greatest(code, CASE WHEN pen < 0.55e0 THEN 2 ELSE 1 END, CASE WHEN late THEN 4 ELSE 0 END) AS c1 FROM p),
r AS (SELECT *, CASE WHEN abs(pen - 0.55e0) <= 0.1e0 AND c1 = 1 THEN 3 ELSE c1 END AS c2, kind IS NOT NULL AND suspicion > 0.5 AS applies, CASE WHEN kind = 'burst' THEN 'BURST_WINDOW' ELSE 'COORDINATED_CLUSTER' END AS why FROM q)
SELECT id, CASE WHEN applies THEN c2 ELSE code END AS code, CAST(round(CAST(CASE WHEN applies THEN pen ELSE score END AS DECIMAL(18, 9)), 6) AS DOUBLE) AS score,
  array_to_string(CASE WHEN applies THEN list_concat([why], reasons)[1:3] ELSE reasons END, ',') AS reasons FROM r""")
def cluster_rules(spark, sf_dir):
    rows = R.numbered_answers(R.reviews(spark, sf_dir)).withColumns({
        "kind": F.when(F.col("author_id") % 3 == 0, "burst").when(F.col("author_id") % 3 == 1, "duplicate"),
        "suspicion": ((F.col("author_id") * 37 + 11) % 100) / F.lit(100.0),
        "late": F.col("id") % 11 == 0,
    }).withColumn("b", PO.judged())
    out = opened(rows.withColumn("d", PO.clustered(F.col("b"), F.col("suspicion"), F.col("kind"), F.col("late"))))
    return out.select("id", "code", F.round(F.col("score").cast("decimal(18,9)"), 6).cast("double").alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT ['PENDING','KEEP','DOWNWEIGHT','FLAG','EXCLUDE'][code + 1] AS action, coalesce(reasons[1], '') AS reason, count(*) AS n FROM decided GROUP BY 1, 2")
def action_counts_and_reasons(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("action", F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT round(avg(rating_norm), 6) AS raw, round(sum(weight * rating_norm) / sum(weight), 6) AS adjusted, round(pow(sum(weight), 2) / sum(weight * weight), 4) AS n_eff FROM decided")
def adjusted_rating_neff(spark, sf_dir):
    return RA.summary(judged(spark, sf_dir)).select(F.round("raw", 6).alias("raw"), F.round("adjusted", 6).alias("adjusted"), F.round("n_eff", 4).alias("n_eff"))


@query()
def bootstrap_ci(spark, sf_dir):
    return RA.bootstrap(judged(spark, sf_dir))


@query(f"""SELECT user_id, n, round(share, 6) AS share, {S.label('share', 'n')} AS label FROM (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 ELSE 0e0 END) AS share FROM events GROUP BY user_id)""")
def label_bands(spark, sf_dir):
    good = F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(0.0)
    per = R.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg(good).alias("share"))
    return per.select("user_id", "n", F.round("share", 6).alias("share"), RA.label(F.col("share"), F.col("n")).alias("label"))


ORDERED = "['OFF_TOPIC','CONTRADICTS_VERDICT','SPAM','TEMPLATED','NEAR_DUPLICATE','COORDINATED_CLUSTER','BURST_WINDOW','LOW_CONFIDENCE','LOW_EXPERIENCE','LOW_INFO','UNSUPPORTED_VERDICT','INFLUENCE_ATTEMPT','OTHER']"


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + f""", t AS (SELECT sum(rating_norm) AS sr, count(*)::DOUBLE AS sw FROM decided),
s AS (SELECT CASE WHEN len(reasons) = 0 THEN 12 ELSE list_position({ORDERED}, reasons[1]) - 1 END AS step, count(*) AS reviews, sum((weight - 1) * rating_norm) AS dr, sum(weight - 1) AS dw FROM decided WHERE weight < 1 GROUP BY 1),
a AS (SELECT step, reviews, (sr + sum(dr) OVER (ORDER BY step)) / (sw + sum(dw) OVER (ORDER BY step)) AS af, sr / sw AS raw FROM s, t)
SELECT CAST(step AS INTEGER) AS step, {ORDERED}[step + 1] AS reason, reviews, round(af, 6) AS after, round(af - coalesce(lag(af) OVER (ORDER BY step), raw), 6) AS delta FROM a""")
def waterfall(spark, sf_dir):
    return RA.waterfall(judged(spark, sf_dir)).select(F.col("step").cast("int").alias("step"), "reason", "reviews", F.round("after", 6).alias("after"), F.round("delta", 6).alias("delta"))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + """SELECT id, ['LOW_INFO', 'UNSUPPORTED_VERDICT', 'CONTRADICTS_VERDICT', 'SPAM', 'TEMPLATED', 'OFF_TOPIC', 'LOW_EXPERIENCE', 'INFLUENCE_ATTEMPT'][i] AS reason, round(w, 6) AS weight, round(w * v, 6) AS contribution
FROM (SELECT id, unnest(range(1, 9)) AS i, unnest([0e0, 0e0, 0.5e0, 0.2e0, 0.15e0, 0.6e0, 0.2e0, 0.6e0]) AS w,
  unnest([1 - informativeness / 3, 1 - support / 3, p_contradicts, spam, templated, off, CASE WHEN low_playtime THEN off ELSE 0e0 END, greatest(0e0, influence - 0.5e0) / 0.5e0]) AS v FROM telling)""")
def integrity_ledger(spark, sf_dir):
    rows = R.numbered_answers(R.reviews(spark, sf_dir)).select("id", F.explode(PO.ledger()).alias("x"))
    return rows.select("id", "x.reason", F.round("x.weight", 6).alias("weight"), F.round("x.contribution", 6).alias("contribution"))


WINDOWS = "[['2024-01-05 00:00:00', '2024-01-06 05:00:00'], ['2024-01-06 04:00:00', '2024-01-08 00:00:00'], ['2024-01-20 10:00:00', '2024-01-20 11:00:00']]"


def fixed_windows(spark):
    rows = [("negative", "2024-01-05 00:00:00", "2024-01-06 04:00:00"), ("negative", "2024-01-06 04:00:00", "2024-01-07 23:00:00"), ("negative", "2024-01-20 10:00:00", "2024-01-20 10:00:00")]
    return spark.createDataFrame(rows, "verdict string, start string, end string").selectExpr("verdict", "cast(start as timestamp_ntz) as start", "cast(end as timestamp_ntz) as end")


PLATFORM = S.over_reviews("""tagged AS (SELECT *, k % 5 <> 0 AS purchased, CASE WHEN (id * 31 + 7) % 3 < 2 THEN ((id * 17 + 3) % 10 >= 3)::INT::DOUBLE END AS offtopic FROM reviews),
spans AS (SELECT CAST(w[1] AS TIMESTAMP) AS s, CAST(w[2] AS TIMESTAMP) AS e FROM (SELECT unnest(""" + WINDOWS + """) AS w)),
ok AS (SELECT s, e FROM tagged JOIN spans ON created_at >= s AND created_at < e WHERE rating_norm < 0.5 AND offtopic IS NOT NULL GROUP BY s, e HAVING count(*) >= 20 AND avg(offtopic) > 0.5),
classed AS (SELECT *, CASE WHEN NOT purchased THEN 'KEY' WHEN EXISTS (SELECT 1 FROM ok WHERE created_at >= s AND created_at < e) THEN 'WINDOW' ELSE 'COUNTS' END AS platform_class FROM tagged)""")


def classed(spark, sf_dir):
    rows = R.reviews(spark, sf_dir).withColumns({"purchased": F.col("k") % 5 != 0, "offtopic": F.when((F.col("id") * 31 + 7) % 3 < 2, ((F.col("id") * 17 + 3) % 10 >= 3).cast("double"))})
    return PL.classes(rows, PL.qualified(rows, fixed_windows(spark)))


@query(PLATFORM + "SELECT round(avg(rating_norm) FILTER (platform_class = 'COUNTS'), 6) AS rating, count(*) FILTER (platform_class = 'COUNTS') AS counted, count(*) FILTER (platform_class = 'KEY') AS key_removed, count(*) FILTER (platform_class = 'WINDOW') AS window_removed FROM classed")
def platform_rating(spark, sf_dir):
    return PL.rating(classed(spark, sf_dir)).withColumn("rating", F.round("rating", 6))


@query(PLATFORM + "SELECT id, platform_class FROM classed")
def platform_classes(spark, sf_dir):
    return classed(spark, sf_dir).select("id", "platform_class")


@query(S.over_reviews("""neg AS (SELECT created_at, CASE WHEN (id * 17 + 3) % 10 >= 3 AND created_at < TIMESTAMP '2024-01-14 00:00:00' THEN 1e0 ELSE 0e0 END AS off FROM reviews WHERE rating_norm < 0.5),
spans AS (SELECT CAST(w[1] AS TIMESTAMP) AS s, CAST(w[2] AS TIMESTAMP) AS e FROM (SELECT unnest(""" + WINDOWS + """) AS w)), ok AS (SELECT s, e FROM neg JOIN spans ON created_at >= s AND created_at < e GROUP BY s, e HAVING count(*) >= 20 AND avg(off) > 0.5),
steps AS (SELECT s, e, side, k, CASE WHEN side < 0 THEN s - to_days(CAST(k AS INTEGER)) ELSE e + to_days(CAST(k - 1 AS INTEGER)) END AS lo FROM ok CROSS JOIN range(1, 46) t(k) CROSS JOIN (SELECT unnest([-1, 1]) AS side)),
c AS (SELECT s, e, side, k, count(created_at) AS n, coalesce(avg(off), 0) AS share FROM steps LEFT JOIN neg ON created_at >= lo AND created_at < lo + INTERVAL 1 DAY GROUP BY 1, 2, 3, 4),
u AS (SELECT *, min(CASE WHEN n >= 5 AND share > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY s, e, side ORDER BY k) AS ok FROM c), g AS (SELECT s, e, CAST(sum(ok) FILTER (side < 0) AS INTEGER) AS back, CAST(sum(ok) FILTER (side > 0) AS INTEGER) AS ahead FROM u GROUP BY s, e)""") + """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS was, strftime(s - to_days(back), '%Y-%m-%d %H:%M:%S') AS start, strftime(e + to_days(ahead), '%Y-%m-%d %H:%M:%S') AS "end" FROM g""")
def window_extension(spark, sf_dir):
    """Windows grown by whole days while they stay off topic; from a day on nothing is."""
    off = ((F.col("id") * 17 + 3) % 10 >= 3) & (F.col("created_at") < F.lit("2024-01-14 00:00:00").cast("timestamp_ntz"))
    rows = R.reviews(spark, sf_dir).withColumn("offtopic", off.cast("double"))
    out = PL.extended(rows, PL.qualified(rows, fixed_windows(spark)), Platform(extend=True))
    return out.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("was", "start", "end")])


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, code, count(*) AS n FROM decided GROUP BY 1, 2")
def hour_action_counts(spark, sf_dir):
    return judged(spark, sf_dir).groupBy(F.date_format(F.date_trunc("hour", "created_at"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "code").agg(F.count("*").alias("n"))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + """, b AS (SELECT min(epoch(date_trunc('hour', created_at))) AS t0, max(epoch(date_trunc('hour', created_at))) + 3600 AS t1 FROM decided)
SELECT CAST(least(99, floor((epoch(date_trunc('hour', created_at)) - t0) / (t1 - t0) * 100)) AS INTEGER) AS col, code, count(*) AS n FROM decided, b GROUP BY 1, 2""")
def bin_columns(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("h", F.unix_timestamp(F.date_trunc("hour", "created_at")).cast("double"))
    span = rows.agg(F.min("h").alias("t0"), (F.max("h") + 3600).alias("t1"))
    col = F.least(F.lit(99), F.floor((F.col("h") - F.col("t0")) / (F.col("t1") - F.col("t0")) * 100)).cast("int")
    return rows.crossJoin(F.broadcast(span)).groupBy(col.alias("col"), "code").agg(F.count("*").alias("n"))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT id, round(score, 6) AS score, left(text, 220) AS snippet FROM decided WHERE code = 2 AND list_contains(reasons, 'OFF_TOPIC') AND rating_norm < 0.5 AND text ILIKE '%the%' ORDER BY round(score, 9), id LIMIT 50 OFFSET 10")
def review_page_filters(spark, sf_dir):
    """A page of reviews: action, reason, verdict and text filters, by score, ties by id."""
    kept = judged(spark, sf_dir).where((F.col("code") == 2) & F.array_contains("reasons", "OFF_TOPIC") & (F.col("rating_norm") < 0.5) & F.col("text").ilike("%the%"))
    return kept.orderBy(F.round("score", 9).asc_nulls_last(), "id").offset(10).limit(50).select("id", F.round("score", 6).alias("score"), F.substring("text", 1, 220).alias("snippet"))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT author_id AS cluster_id, count(*) AS size, count(*) FILTER (code = 1) AS keep, count(*) FILTER (code = 2) AS downweight, count(*) FILTER (code = 3) AS flag, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS t_start, count(DISTINCT date_trunc('hour', created_at)) AS hours FROM decided GROUP BY author_id")
def cluster_detail(spark, sf_dir):
    of = lambda k: F.count_if(F.col("code") == k)
    return judged(spark, sf_dir).groupBy(F.col("author_id").alias("cluster_id")).agg(F.count("*").alias("size"), of(1).alias("keep"), of(2).alias("downweight"), of(3).alias("flag"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("t_start"), F.count_distinct(F.date_trunc("hour", "created_at")).alias("hours"))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + """, b AS (SELECT id // 250 AS batch, count(*) AS m, sum(weight * rating_norm) AS a, sum(weight) AS w FROM decided GROUP BY 1)
SELECT batch, CAST(sum(m) OVER (ORDER BY batch) AS BIGINT) AS n, round(sum(a) OVER (ORDER BY batch) / sum(w) OVER (ORDER BY batch), 6) AS rating FROM b""")
def running_live_rating(spark, sf_dir):
    return RA.running(judged(spark, sf_dir)).select("batch", "n", F.round("rating", 6).alias("rating"))


@query(S.over_reviews() + "SELECT count(*) AS reviews, count(DISTINCT text) AS distinct_inputs, round(avg(length(text)), 4) AS chars, CAST(count(*) AS BIGINT) AS calls, CAST(floor(count(*) * (1553.1 + 0.2445 * avg(length(text)))) AS BIGINT) AS tokens FROM reviews")
def preflight_tokens(spark, sf_dir):
    out = J.preflight(R.unnumbered(spark, sf_dir), F.col("text"))
    return out.select("reviews", "distinct_inputs", F.round("chars", 4).alias("chars"), "calls", "tokens")


LONG = """long AS (SELECT id, draw, q, CASE q WHEN 'topic' THEN NULL ELSE ((id * 7 + draw * 13 + len(q)) % 10) / 10e0 END AS value, ((id + draw * 3) % 5) / 5e0 AS p1, 1 - ((id + draw * 3) % 5) / 5e0 AS p2
FROM (SELECT id, unnest(range(0, 2)) AS draw FROM reviews) CROSS JOIN (SELECT unnest(['spam_promo', 'topic']) AS q))"""


@query(S.over_reviews(LONG) + "SELECT id, q AS question, round(avg(value), 6) AS value, CASE WHEN q = 'topic' THEN CASE WHEN round(avg(p1), 9) >= round(avg(p2), 9) THEN 'a' ELSE 'b' END END AS choice FROM long GROUP BY id, q")
def average_answers(spark, sf_dir):
    draws = R.reviews(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("draw")).select("id", "draw", F.explode(F.array(F.lit("spam_promo"), F.lit("topic"))).alias("question"))
    p1 = ((F.col("id") + F.col("draw") * 3) % 5) / F.lit(5.0)
    value = ((F.col("id") * 7 + F.col("draw") * 13 + F.length("question")) % 10) / F.lit(10.0)
    topic = F.col("question") == "topic"
    answers = draws.select("id", "question", F.when(topic, "choice").otherwise("noul").alias("type"), F.when(~topic, value).alias("value"), F.when(topic, F.create_map(F.lit("a"), p1, F.lit("b"), 1 - p1)).alias("probabilities"), F.lit(None).cast("double").alias("confidence"))
    return J.averaged(answers).select("id", "question", F.round("value", 6).alias("value"), "choice")


@query()
def mock_answers_wide(spark, sf_dir):
    return J.judge_wide(R.numbered(spark, sf_dir))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + f""", x AS (SELECT id, code, CASE WHEN score0 < 0.7e0 THEN 2 ELSE 1 END AS strict, spam FROM decided)
SELECT a || '->' || b AS transition, count(*) AS n FROM (SELECT ['PENDING','KEEP','DOWNWEIGHT','FLAG','EXCLUDE'][code + 1] AS a, CASE WHEN spam > 0.9e0 THEN 'FLAG' WHEN strict = 2 THEN 'DOWNWEIGHT' ELSE 'KEEP' END AS b FROM x) GROUP BY 1""")
def transitions_between_runs(spark, sf_dir):
    return E.transitions(judged(spark, sf_dir), judged(spark, sf_dir, Policy(downweight_below=0.7)))


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, rating_norm, ['PENDING','KEEP','DOWNWEIGHT','FLAG','EXCLUDE'][code + 1] AS action, weight, CAST(round(CAST(score AS DECIMAL(18, 9)), 4) AS DOUBLE) AS integrity_score, array_to_string(reasons, ';') AS reasons, text FROM decided")
def export_decisions(spark, sf_dir):
    """Rows of an export: no ids, no authors."""
    return judged(spark, sf_dir).select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "rating_norm", "action", "weight", F.round(F.col("score").cast("decimal(18,9)"), 4).cast("double").alias("integrity_score"), F.concat_ws(";", "reasons").alias("reasons"), "text")


@query(S.over_reviews(S.HEURISTIC.replace("* EXCLUDE (code0, reasons0)", "*")) + """, w AS (SELECT rating_norm AS r, CASE code0 WHEN 2 THEN 0.25e0 ELSE 1e0 END AS w FROM decided), s AS (SELECT count(*)::DOUBLE AS n, sum(r) AS r, sum(w * r) AS wr, sum(w) AS w FROM w)
SELECT round(r / (n + 150) - r / n, 6) AS raw_shift, round(wr / (w + 37.5) - wr / w, 6) AS adjusted_shift, round(1 - (wr / (w + 37.5) - wr / w) / (r / (n + 150) - r / n), 6) AS pull_removed FROM s""")
def attack_pull_removed(spark, sf_dir):
    """A template attack of 150 reviews in 48 hours, scored with and without."""
    base = PO.heuristic(T.token_count(F.col("text")), T.symbol_ratio(F.col("text")), T.has_promo(F.col("text")))
    clean = R.unnumbered(spark, sf_dir, {"d": base})
    text = F.concat(F.lit("ok "), (F.col("i") % 3).cast("string"))
    attack = E.injected(clean.drop("d"), "template", 150, 48, 0.0, text, 0, "2024-01-10 00:00:00").withColumn("d", base)  # ids are not asked for
    score = lambda df: RA.summary(opened(df))
    out = E.pull_removed(score(clean), score(clean.unionByName(attack)))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
