"""Queries of judgments: sets, states, calls, decoding, reuse, stability and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import answers as AN
from plumbline.plans import sql as S
from plumbline.plans.decision_queries import judged
from plumbline.plans.inspect_queries import ACTION, DECIDED
from plumbline.registry import query
from plumbline.sources import reviews as R

SETS = ", ".join(f"('{v}', {k}, '{n}', '{t}', {m})" for v in AN.ADDED for k, (n, t, m) in enumerate(AN.question_set(v)))


@query(S.over_reviews() + f"SELECT q.*, n AS inputs FROM (VALUES {SETS}) AS q(version, place, question, type, levels) CROSS JOIN (SELECT count(DISTINCT text || CASE WHEN rating_norm >= 0.5 THEN '1' ELSE '0' END) AS n FROM reviews)")
def question_sets(spark, sf_dir):
    """The questions of each set, with the distinct inputs that each would be asked of."""
    inputs = states(R.unnumbered(spark, sf_dir)).select(AN.input_key(F.col("state")).alias("key")).distinct().agg(F.count("*").alias("inputs"))
    return AN.registry(spark).crossJoin(F.broadcast(inputs))  # one row


STATE = """'{"context":"Review of ''' || 'corpus' || '''.","review":' || to_json(text) || ',"verdict":"' || CASE WHEN rating_norm >= 0.5 THEN 'Recommended' ELSE 'Not recommended' END || '"}'"""


def states(rows):
    shown = AN.state("corpus", T.verdict_words(F.col("rating_raw"), F.col("rating_norm"), "binary"), F.col("text"))
    return rows.withColumn("state", shown)


@query(S.over_reviews() + "SELECT id, 'Review of ''corpus''.' AS context, CASE WHEN rating_norm >= 0.5 THEN 'Recommended' ELSE 'Not recommended' END AS verdict, length(text) AS n FROM reviews")
def judge_states(spark, sf_dir):
    """What a model is shown of each review."""
    return states(R.reviews(spark, sf_dir)).select("id", F.col("state.context").alias("context"), F.col("state.verdict").alias("verdict"), F.length("state.review").cast("long").alias("n"))


@query(S.over_reviews() + "SELECT count(*) AS states, count(DISTINCT text || CASE WHEN rating_norm >= 0.5 THEN '1' ELSE '0' END) AS inputs, max(n) AS most FROM (SELECT text, rating_norm, count(*) OVER (PARTITION BY text, rating_norm >= 0.5) AS n FROM reviews)")
def identical_inputs(spark, sf_dir):
    """States, distinct inputs, and how often the commonest one occurs, by digest of the input."""
    per = states(R.unnumbered(spark, sf_dir)).groupBy(AN.input_key(F.col("state")).alias("key")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("states"), F.count("*").alias("inputs"), F.max("n").alias("most"))


RAW = "CASE id % 3 WHEN 0 THEN '{\"type\":\"noul\",\"noul\":' || (id % 10) / 10e0 || ',\"confidence\":0.5}' WHEN 1 THEN '{\"type\":\"score\",\"score\":' || id % 4 || ',\"probabilities\":{\"0\":0.25,\"3\":0.75},\"confidence\":0.5}' ELSE '{\"type\":\"choice\",\"choice\":\"t' || id % 5 || '\",\"probabilities\":{\"a\":1}}' END"


def raw_answer():
    i = F.col("id")
    noul = F.concat(F.lit('{"type":"noul","noul":'), ((i % 10) / F.lit(10.0)).cast("string"), F.lit(',"confidence":0.5}'))
    score = F.concat(F.lit('{"type":"score","score":'), (i % 4).cast("string"), F.lit(',"probabilities":{"0":0.25,"3":0.75},"confidence":0.5}'))
    choice = F.concat(F.lit('{"type":"choice","choice":"t'), (i % 5).cast("string"), F.lit('","probabilities":{"a":1}}'))
    return F.when(i % 3 == 0, noul).when(i % 3 == 1, score).otherwise(choice)


@query(S.over_reviews(f"raw AS (SELECT id, {RAW} AS j FROM reviews)") + """SELECT id, j->>'$.type' AS type, coalesce(CAST(j->>'$.noul' AS DOUBLE), CAST(j->>'$.score' AS DOUBLE)) AS value, j->>'$.choice' AS choice, CAST(j->>'$.probabilities."3"' AS DOUBLE) AS p3,
  CASE WHEN j->>'$.type' <> 'noul' THEN CAST(j->>'$.confidence' AS DOUBLE) END AS confidence FROM raw""")
def decoded_answers(spark, sf_dir):
    rows = R.reviews(spark, sf_dir).select("id", AN.decoded(raw_answer()).alias("a"))
    return rows.select("id", "a.type", "a.value", "a.choice", F.try_element_at("a.probabilities", F.lit("3")).alias("p3"), "a.confidence")


@query(S.over_reviews() + "SELECT id, array_to_string(list_sort(list_filter(['informativeness', 'rating_support', 'topic', 'spam_promo', 'templated', 'campaign_language', 'about_game'], lambda q: length(q) % 3 <> id % 3)), ',') AS missing FROM reviews")
def missing_answers(spark, sf_dir):
    """Questions of the third set that an answer leaves out."""
    names = F.array(*[F.lit(q[0]) for q in AN.question_set("v3")])
    answered = F.filter(names, lambda q: F.length(q) % 3 == F.col("id") % 3)
    return R.reviews(spark, sf_dir).select("id", F.array_join(AN.missing_questions(answered, "v3"), ",").alias("missing"))


@query(S.over_reviews() + "SELECT id, q AS question, ((id % 5) * 10 + length(q)) AS answer FROM reviews CROSS JOIN (SELECT unnest(['spam_promo', 'topic']) AS q)")
def packed_calls(spark, sf_dir):
    """Five states a call, answered by place and question, then taken apart again."""
    calls = AN.packed(R.reviews(spark, sf_dir), 5)
    asked = calls.select("call", F.explode("keys").alias("r"), F.array(F.lit("spam_promo"), F.lit("topic")).alias("qs")).select("call", "r", F.explode("qs").alias("q"))
    answers = asked.select("call", F.concat_ws(AN.SEP, "r", "q").alias("key"), (F.substring("r", 2, 9).cast("long") * 10 + F.length("q")).alias("answer"))
    return AN.unpacked(calls, answers)


@query(S.over_reviews() + "SELECT id // 5 AS call, count(*) AS states, string_agg('Is `reviews[' || id % 5 || '].review` fair, given `reviews[' || id % 5 || '].verdict`?', ' ' ORDER BY id) AS asked FROM reviews GROUP BY 1")
def packed_instructions(spark, sf_dir):
    """Instructions of packed calls point into the states of the call."""
    calls = AN.packed(R.reviews(spark, sf_dir), 5)
    said = F.transform("keys", lambda k: AN.retargeted(F.lit("Is `review` fair, given `verdict`?"), k))
    return calls.select("call", F.size("ids").cast("long").alias("states"), F.array_join(said, " ").alias("asked"))


@query(S.over_reviews() + f"""SELECT id, q.n AS question, round(CASE WHEN q.t = 'noul' THEN 0.2e0 * u ELSE u * (q.l - 1) END, 9) AS value FROM (SELECT id, q, CAST(('0x' || substr(sha256(q.n || '|' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296e0 AS u FROM reviews
  CROSS JOIN (SELECT unnest([{', '.join(f"{{'n': '{n}', 't': '{t}', 'l': {m}}}" for n, t, m in AN.question_set('v5') if t != 'choice')}]) AS q))""")
def fake_answers(spark, sf_dir):
    """Reproducible answers from the digest of question and state."""
    rows = R.reviews(spark, sf_dir).select("id", F.col("id").cast("string").alias("state"))
    return AN.fake_answers(rows, "v5").select("id", "question", F.round("value", 9).alias("value"))


def long_answers(rows):
    """Wide numbered answers in long form."""
    one = lambda q, t, c: F.struct(F.lit(q).alias("question"), F.lit(t).alias("type"), c.alias("value"))
    parts = F.array(one("spam_promo", "noul", F.col("spam")), one("templated", "noul", F.col("templated")), one("about_game", "noul", F.col("about_game")), one("verdict_basis", "noul", F.col("influence")), one("informativeness", "score", F.col("informativeness")))
    return rows.select("id", F.explode(parts).alias("a")).select("id", "a.*", F.lit(None).cast("string").alias("choice"), F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(None).cast("double").alias("confidence"))


@query(DECIDED + "SELECT id, q AS question, value FROM (SELECT id, unnest(['spam_promo', 'templated', 'about_game', 'verdict_basis', 'informativeness']) AS q, unnest([spam, templated, about_game, influence, informativeness]) AS value FROM telling) WHERE id % 4 = 1")
def cached_answers(spark, sf_dir):
    """Answers of a finished run on the same dataset and question set, given again to a quarter of its reviews."""
    answers = long_answers(R.numbered_answers(R.reviews(spark, sf_dir)))
    runs = spark.createDataFrame([("r1", "d1", "v5", "done"), ("r2", "d1", "v5", "running")], "id string, dataset_id string, question_set string, status string")
    judgments = answers.withColumn("run_id", F.lit("r1")).unionByName(answers.where("id < 10").withColumn("run_id", F.lit("r2")))
    cached = AN.CachedAnswers(runs, judgments, "r1", "d1", "v5")
    return cached.judge(R.reviews(spark, sf_dir).where("id % 4 = 1")).select("id", "question", "value")


@query(S.over_reviews() + ", b AS (SELECT id // 50 AS batch, count(*) AS calls, CAST(sum(900 + id % 37) AS BIGINT) AS tokens FROM reviews GROUP BY 1), s AS (SELECT *, sum(tokens) OVER (ORDER BY batch) * 2e0 / 1e6 AS spent FROM b) SELECT batch, calls, tokens, round(spent, 6) AS spent, spent <= 1.25e0 * 8e0 AS goes_on FROM s")
def spending(spark, sf_dir):
    """What a run has cost after each batch, and whether it may go on."""
    calls = R.reviews(spark, sf_dir).select("id", (900 + F.col("id") % 37).alias("tokens"))
    return AN.spending(calls, 8.0, 2.0).withColumn("spent", F.round("spent", 6))


CALLS = "calls AS (SELECT user_id, CAST(value AS DOUBLE) AS latency_ms, event_id % 3 AS retries, 900 + event_id % 37 AS tokens, CAST(epoch(ts) AS DOUBLE) AS start, round(value / 1000, 6) AS seconds FROM events)"


def calls_of(spark, sf_dir):
    e = R.read(spark, sf_dir, "events")
    return e.select("user_id", F.col("value").cast("double").alias("latency_ms"), (F.col("event_id") % 3).alias("retries"), (900 + F.col("event_id") % 37).alias("tokens"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.round(F.col("value") / 1000, 6).alias("seconds"))


@query(f"WITH {CALLS} SELECT user_id, count(*) AS requests, CAST(sum(retries) AS BIGINT) AS retries, CAST(round(CAST(quantile_cont(latency_ms, 0.5) AS DECIMAL(18, 6)), 1) AS DOUBLE) AS latency_p50_ms, CAST(round(CAST(quantile_cont(latency_ms, 0.95) AS DECIMAL(18, 6)), 1) AS DOUBLE) AS latency_p95_ms, CAST(sum(tokens) AS BIGINT) AS tokens FROM calls GROUP BY user_id")
def call_summary(spark, sf_dir):
    """Events as calls: requests, retries, latency percentiles and tokens by user."""
    out = AN.call_summary(calls_of(spark, sf_dir), 1.0, "user_id")
    return out.drop("cost")


@query(f"WITH {CALLS}, l AS (SELECT user_id, list_sort(list(seconds)) AS s, sum(tokens) AS tokens FROM calls GROUP BY user_id) SELECT user_id, CAST(len(s) AS BIGINT) AS rows, s[CAST(floor(0.5e0 * (len(s) - 1)) AS BIGINT) + 1] AS median, s[CAST(floor(0.95e0 * (len(s) - 1)) AS BIGINT) + 1] AS p95, round(tokens / len(s), 6) AS tokens_per_row FROM l")
def throughput(spark, sf_dir):
    """Latencies at whole places of their order, and tokens a row."""
    rows = calls_of(spark, sf_dir).withColumn("start", F.col("us") / 1e6)
    return AN.throughput(rows, "user_id").select("user_id", "rows", "median", "p95", F.round("tokens_per_row", 6).alias("tokens_per_row"))


DRAWS = "draws AS (SELECT id, draw, q, ((id * 7 + draw * draw * 13 * CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END + length(q)) % 100) / 100e0 AS value, 'c' || (CASE WHEN id % 5 = 0 THEN draw % 2 ELSE 0 END) AS choice FROM (SELECT id, unnest(range(0, 4)) AS draw FROM reviews) CROSS JOIN (SELECT unnest(['spam_promo', 'informativeness']) AS q))"


def draws(spark, sf_dir):
    rows = R.reviews(spark, sf_dir).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("draw")).select("id", "draw", F.explode(F.array(F.lit("spam_promo"), F.lit("informativeness"))).alias("question"))
    shift = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("draw") * F.col("draw") * 13)
    value = ((F.col("id") * 7 + shift + F.length("question")) % 100) / F.lit(100.0)
    choice = F.concat(F.lit("c"), F.when(F.col("id") % 5 == 0, F.col("draw") % 2).otherwise(0).cast("string"))
    return rows.withColumns({"value": value, "choice": choice, "type": F.lit("noul"), "confidence": F.lit(None).cast("double")})


@query(S.over_reviews(DRAWS) + ", p AS (SELECT a.id, bool_and(a.value = b.value AND a.choice = b.choice) AS same, max(abs(a.value - b.value)) AS delta FROM draws a JOIN draws b ON a.id = b.id AND a.q = b.q WHERE a.draw = 0 AND b.draw = 1 GROUP BY a.id) SELECT count(*) AS states, count(*) FILTER (same) AS identical, round(avg(CASE WHEN same THEN 1e0 ELSE 0e0 END), 6) AS share, round(max(delta), 6) AS max_delta FROM p")
def determinism(spark, sf_dir):
    d = draws(spark, sf_dir)
    out = AN.determinism(d.where("draw = 0"), d.where("draw = 1"))
    return out.select("states", "identical", F.round("share", 6).alias("share"), F.round("max_delta", 6).alias("max_delta"))


@query(S.over_reviews(DRAWS) + ", p AS (SELECT id, q, stddev_pop(value) AS sd FROM draws GROUP BY id, q) SELECT q AS question, count(*) AS states, round(avg(sd), 6) AS mean_sd, round(max(sd), 6) AS max_sd FROM p GROUP BY q")
def test_retest(spark, sf_dir):
    out = AN.retest(draws(spark, sf_dir))
    return out.select("question", "states", F.round("mean_sd", 6).alias("mean_sd"), F.round("max_sd", 6).alias("max_sd"))


@query(S.over_reviews(DRAWS) + ", p AS (SELECT id, q, CASE WHEN count(DISTINCT choice) = 1 THEN 1e0 ELSE 0e0 END AS same FROM draws GROUP BY id, q) SELECT q AS question, count(*) AS states, round(avg(same), 6) AS share FROM p GROUP BY q")
def choice_stability(spark, sf_dir):
    return AN.choice_stability(draws(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(S.over_reviews(DRAWS) + """, n AS (SELECT DISTINCT id, draw, trial FROM draws CROSS JOIN (SELECT unnest(range(0, 3)) AS trial)), o AS (SELECT *, row_number() OVER (PARTITION BY id, trial ORDER BY md5('0:' || trial || '|' || id || '|' || draw), draw) - 1 AS place FROM n),
g AS (SELECT d.id, o.trial, CASE WHEN place < 2 THEN 'a' ELSE 'b' END AS side, round(avg(d.value), 9) AS score FROM draws d JOIN o ON o.id = d.id AND o.draw = d.draw WHERE place < 4 AND q = 'spam_promo' GROUP BY 1, 2, 3)
SELECT count(*) AS pairs, round(avg(CASE WHEN (a.score < 0.5) <> (b.score < 0.5) THEN 1e0 ELSE 0e0 END), 6) AS flip_rate, round(avg(abs(a.score - b.score)), 6) AS mean_delta FROM g a JOIN g b ON a.id = b.id AND a.trial = b.trial WHERE a.side = 'a' AND b.side = 'b'""")
def flip_rate(spark, sf_dir):
    """How often two independent estimates, each the mean of two draws, lead to different actions."""
    d = AN.disjoint_groups(draws(spark, sf_dir).where("question = 'spam_promo'"), 2, 3)
    decided = d.groupBy("id", "trial", "side").agg(F.round(F.avg("value"), 9).alias("score")).withColumn("action", F.when(F.col("score") < 0.5, "KEEP").otherwise("FLAG"))
    out = AN.flip_rate(decided)
    return out.select("pairs", F.round("flip_rate", 6).alias("flip_rate"), F.round("mean_delta", 6).alias("mean_delta"))


@query(DECIDED + f"SELECT {ACTION} AS action, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN score IS NULL THEN 0 ELSE score END), 6) AS score FROM decided GROUP BY 1")
def decided_batches(spark, sf_dir):
    """Decisions of all batches together."""
    return judged(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))
