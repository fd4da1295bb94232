"""Queries of label sets: samples, labels, agreement, adversarial versions, runs compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import labelsets as L
from plumbline.plans import sql as S
from plumbline.plans.answer_queries import long_answers
from plumbline.plans.corpus_queries import shown
from plumbline.plans.decision_queries import judged
from plumbline.plans.inspect_queries import ACTION, DECIDED
from plumbline.plans.tables import cut
from plumbline.registry import query
from plumbline.sources import reviews as R
from plumbline.sources import sinks

DOCS = f"docs AS (SELECT doc_id AS id, coalesce(text, '') AS text, {S.TOKENS} AS n_tokens, lang, source FROM documents)"


def docs_of(spark, sf_dir):
    from plumbline.functions import text as T

    return R.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), T.token_count(F.col("text")).alias("n_tokens"), "lang", "source")


def drawn(name: str, seed: int) -> str:
    return f"md5('{seed}:{name}|' || CAST(id AS VARCHAR))"


@query(f"""WITH {DOCS}, a AS (SELECT id FROM docs WHERE n_tokens <= 30 ORDER BY {drawn('short', 3)}, id LIMIT 15), b AS (SELECT id FROM docs WHERE n_tokens >= 150 AND id NOT IN (SELECT id FROM a) ORDER BY {drawn('long', 3)}, id LIMIT 15),
c AS (SELECT id FROM docs WHERE n_tokens < 60 AND id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b) ORDER BY {drawn('medium', 3)}, id LIMIT 20)
SELECT id, 'short' AS stratum FROM a UNION ALL SELECT id, 'long' FROM b UNION ALL SELECT id, 'medium' FROM c""")
def strata_in_order(spark, sf_dir):
    """Strata filled one after the other without replacement; their rules overlap."""
    n = F.col("n_tokens")
    return L.filled(docs_of(spark, sf_dir), {"short": (15, n <= 30), "long": (15, n >= 150), "medium": (20, n < 60)}, seed=3).select("id", "stratum")


@query(f"WITH {DOCS} SELECT id, CASE WHEN n_tokens <= 30 THEN 'short' WHEN n_tokens >= 150 THEN 'long' WHEN lang = 'de' THEN 'german' END AS stratum FROM docs")
def first_stratum(spark, sf_dir):
    n = F.col("n_tokens")
    return docs_of(spark, sf_dir).select("id", L.first_stratum({"short": n <= 30, "long": n >= 150, "german": F.col("lang") == "de"}).alias("stratum"))


@query(f"""WITH {DOCS}, u AS (SELECT id FROM docs ORDER BY {drawn('uniform', 11)}, id LIMIT 60), s AS (SELECT id FROM docs WHERE lang = 'fr' AND id NOT IN (SELECT id FROM u) ORDER BY {drawn('special', 11)}, id LIMIT 20),
b AS (SELECT id, 'uniform' AS stratum FROM u UNION ALL SELECT id, 'special' FROM s) SELECT id, stratum, row_number() OVER (ORDER BY {drawn('position', 11)}, id) - 1 AS position FROM b""")
def label_set(spark, sf_dir):
    """A sample for people: uniform rows, then others of a special kind, shuffled."""
    return L.label_set(docs_of(spark, sf_dir), F.col("lang") == "fr", 60, 20).select("id", "stratum", F.col("position").cast("long").alias("position"))


@query(f"WITH {DOCS} SELECT lang, id FROM (SELECT lang, id, row_number() OVER (PARTITION BY lang ORDER BY md5('11:' || CAST(id AS VARCHAR)), id) AS place FROM docs WHERE length(text) > 0) WHERE place <= 8")
def probes(spark, sf_dir):
    return L.probes(docs_of(spark, sf_dir), "lang", 8).select("lang", "id")


ENOUGH = r"len(regexp_split_to_array(trim(text, ' '), '\s+')) >= 8"
SOURCES = DECIDED + f""", enough AS (SELECT *, md5('13:' || CAST(id AS VARCHAR)) AS o FROM decided WHERE {ENOUGH}), a AS (SELECT 0 AS g, 'offtopic' AS grp, id, text, rating_norm, o FROM enough WHERE code = 2 AND list_contains(reasons, 'OFF_TOPIC') ORDER BY o, id LIMIT 30), b AS (SELECT 1 AS g, 'kept' AS grp, id, text, rating_norm, o FROM enough WHERE code = 1 ORDER BY o, id LIMIT 20),
sources AS (SELECT row_number() OVER (ORDER BY g, o, id) - 1 AS source, * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
versions AS (SELECT source, grp, rating_norm, v.k AS k, v.version AS version, v.a || text || v.b AS text FROM sources CROSS JOIN (SELECT unnest([{', '.join("{'k': %d, 'version': '%s', 'a': '%s', 'b': '%s'}" % (k, v, a, b) for k, (v, (a, b)) in enumerate(L.VERSIONS['v1'].items()))}]) AS v))"""


def sources(spark, sf_dir):
    rows = judged(spark, sf_dir, each={"source_words": L.source_words()})
    groups = {"offtopic": (30, (F.col("code") == 2) & F.array_contains("reasons", "OFF_TOPIC")), "kept": (20, F.col("code") == 1)}
    return L.adversarial_sources(rows, groups)


@query(SOURCES + " SELECT source, grp AS \"group\", id FROM sources")
def adversarial_sources(spark, sf_dir):
    """Long enough reviews that were discounted as off topic, and kept ones, in a drawn order."""
    return sources(spark, sf_dir).select(F.col("source").cast("long").alias("source"), "group", "id")


@query(SOURCES + " SELECT format('adv-{:03d}-', source) || version AS ext_id, md5(text) AS text_md5, rating_norm >= 0.5 AS positive, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(source AS INTEGER)) + to_minutes(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS posted FROM versions")
def adversarial_versions(spark, sf_dir):
    """Five versions of each source, an hour apart."""
    drawn = cut(sources(spark, sf_dir))
    texts = R.reviews(spark, sf_dir, only=drawn).select("id", "text")
    return L.versions(texts.join(F.broadcast(drawn), "id")).select("ext_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "positive", shown("posted"))


@query(SOURCES + """, j AS (SELECT source, grp, version, ((source * 37 + length(version) * 11) % 100) / 100e0 AS integrity, version = 'injection' AND source % 2 = 0 AS excluded FROM versions), o AS (SELECT source, integrity AS a FROM j WHERE version = 'original')
SELECT grp AS "group", version, count(*) AS n, round(avg(CASE WHEN a < 0.55 AND integrity >= 0.55 AND NOT excluded THEN 1e0 ELSE 0e0 END), 6) AS laundered, round(avg(CASE WHEN excluded THEN 1e0 ELSE 0e0 END), 6) AS excluded, round(avg(CASE WHEN a >= 0.55 AND integrity < 0.55 THEN 1e0 ELSE 0e0 END), 6) AS harmed, round(avg(integrity - a), 6) AS mean_shift FROM j JOIN o USING (source) WHERE version <> 'original' GROUP BY 1, 2""")
def laundering(spark, sf_dir):
    """How often added claims lift a discounted text over the line, or push a kept one below it."""
    rows = L.versions(sources(spark, sf_dir).withColumn("text", F.lit(None).cast("string")))  # what is judged here isn't the text
    judged_ = rows.select("source", "group", "version", (((F.col("source") * 37 + F.length("version") * 11) % 100) / F.lit(100.0)).alias("integrity"), ((F.col("version") == "injection") & (F.col("source") % 2 == 0)).alias("excluded"))
    out = L.laundering(judged_)
    return out.select("group", "version", "n", *[F.round(c, 6).alias(c) for c in ("laundered", "excluded", "harmed", "mean_shift")])


MACHINE = """machine AS (SELECT id, unnest(['about_game', 'verdict_basis', 'contradicts', 'spam', 'copied', 'overall']) AS key, unnest([CASE WHEN about_game >= 0.5 THEN 'yes' ELSE 'no' END, CASE WHEN influence >= 0.5 THEN 'playing' ELSE 'other' END, CASE WHEN id % 4 = 0 THEN 'yes' ELSE 'no' END, CASE WHEN spam >= 0.5 THEN 'yes' ELSE 'no' END,
  CASE WHEN templated >= 0.5 THEN 'yes' ELSE 'no' END, CASE code WHEN 2 THEN 'downweight' WHEN 4 THEN 'exclude' ELSE 'keep' END]) AS label FROM decided)"""


def machine(spark, sf_dir):
    rows = judged(spark, sf_dir)
    support = rows.select("id", F.lit("rating_support").alias("question"), F.lit("score").alias("type"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("choice"), F.create_map(F.lit("0"), F.when(F.col("id") % 4 == 0, 0.6).otherwise(0.2), F.lit("3"), F.lit(0.4)).alias("probabilities"), F.lit(None).cast("double").alias("confidence"))
    return L.machine_labels(long_answers(rows).unionByName(support), rows)


@query(DECIDED + f", {MACHINE} SELECT id, key, label FROM machine")
def machine_labels(spark, sf_dir):
    """A run's answers in the terms of people."""
    return machine(spark, sf_dir)


HUMAN = """human AS (SELECT id, key, CASE WHEN (id * 31 + length(key)) % 7 < 2 THEN CASE key WHEN 'overall' THEN 'exclude' WHEN 'verdict_basis' THEN 'other' ELSE 'no' END ELSE label END AS label FROM machine WHERE id % 3 <> 0)"""


def human(rows):
    other = F.when(F.col("key") == "overall", "exclude").when(F.col("key") == "verdict_basis", "other").otherwise("no")
    return rows.where("id % 3 <> 0").withColumn("label", F.when((F.col("id") * 31 + F.length("key")) % 7 < 2, other).otherwise(F.col("label")))


@query(DECIDED + f", {MACHINE}, {HUMAN}" + """, b AS (SELECT m.id, m.key, m.label AS x, h.label AS y, unnest(['all', CASE WHEN m.id % 2 = 0 THEN 'uniform' ELSE 'bomb' END]) AS stratum FROM machine m JOIN human h ON h.id = m.id AND h.key = m.key),
n AS (SELECT *, CASE key WHEN 'about_game' THEN 'no' WHEN 'verdict_basis' THEN 'other' WHEN 'overall' THEN 'keep' ELSE 'yes' END AS pos FROM b), t AS (SELECT key, stratum, count(*) AS n, avg(CASE WHEN x = y THEN 1e0 ELSE 0e0 END) AS po, avg(CASE WHEN (x = pos) <> (key = 'overall') THEN 1e0 ELSE 0e0 END) AS ra, avg(CASE WHEN (y = pos) <> (key = 'overall') THEN 1e0 ELSE 0e0 END) AS rb FROM n GROUP BY 1, 2),
e AS (SELECT key, stratum, sum(nx * ny) AS s FROM (SELECT key, stratum, x AS v, count(*) AS nx FROM n GROUP BY 1, 2, 3) JOIN (SELECT key, stratum, y AS v, count(*) AS ny FROM n GROUP BY 1, 2, 3) USING (key, stratum, v) GROUP BY 1, 2)
SELECT key, stratum, n, round(po, 6) AS agreement, round(CASE WHEN s / (n * n) < 1 THEN (po - s / (n * n)) / (1 - s / (n * n)) END, 6) AS kappa, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b FROM t JOIN e USING (key, stratum)""")
def agreement_by_stratum(spark, sf_dir):
    """Two raters by label and stratum: agreement, kappa, and how often each gives the minority label."""
    a = machine(spark, sf_dir)
    strata = judged(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "uniform").otherwise("bomb").alias("stratum"))
    out = L.agreement(a, human(a), strata)
    return out.select("key", "stratum", "n", *[F.round(c, 6).alias(c) for c in ("agreement", "kappa", "rate_a", "rate_b")])


RATED = "rated AS (SELECT doc_id AS id, 's' || doc_id % 2 AS \"set\", 'r' || doc_id % 3 AS rater, quality AS label FROM labels)"


def rated(spark, sf_dir):
    d = F.col("doc_id")
    return R.read(spark, sf_dir, "labels").select(d.alias("id"), F.concat(F.lit("s"), (d % 2).cast("string")).alias("set"), F.concat(F.lit("r"), (d % 3).cast("string")).alias("rater"), F.col("quality").alias("label"))


@query(f"WITH {RATED} SELECT \"set\", rater, count(DISTINCT id) AS n FROM rated GROUP BY 1, 2")
def labels_per_rater(spark, sf_dir):
    return L.per_rater(rated(spark, sf_dir))


@query(f"WITH {RATED}, items AS (SELECT doc_id AS id, doc_id % 100 AS position FROM documents) SELECT position, i.id, r.label FROM items i LEFT JOIN (SELECT * FROM rated WHERE rater = 'r1') r ON r.id = i.id")
def blind_labels(spark, sf_dir):
    """One rater's view of a set: nobody else's labels."""
    items = R.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("position"))
    return L.blind(items, rated(spark, sf_dir), "r1")


@query(f"WITH {RATED}, changes AS (SELECT id, \"set\", rater, 1 - label AS label FROM rated WHERE id % 10 = 0 UNION ALL SELECT id + 1000000, \"set\", rater, label FROM rated WHERE id % 50 = 0) SELECT r.id, r.\"set\", r.rater, coalesce(c.label, r.label) AS label FROM rated r LEFT JOIN changes c ON c.id = r.id AND c.rater = r.rater UNION ALL SELECT id, \"set\", rater, label FROM changes WHERE id >= 1000000")
def upserted_labels(spark, sf_dir):
    """New labels replace a rater's old ones; others are added."""
    rows = rated(spark, sf_dir)
    changes = rows.where("id % 10 = 0").withColumn("label", 1 - F.col("label")).unionByName(rows.where("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000))
    out = sinks.upsert(rows.withColumn("seq", F.lit(0)), changes.withColumn("seq", F.lit(1)), ["id", "set", "rater"], F.col("seq"))
    return out.drop("seq")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def among_ids(spark, sf_dir):
    """Documents whose ids are in two sets at once, by semi joins."""
    labels = R.read(spark, sf_dir, "labels")
    both = labels.where("quality = 1").select("doc_id").intersect(labels.where("toxic = 0").select("doc_id"))
    return R.read(spark, sf_dir, "documents").join(both, "doc_id", "left_semi").select("doc_id", "n_chars")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_path_filter(spark, sf_dir):
    return R.read(spark, sf_dir, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("SELECT a.doc_id AS id_a, min(b.doc_id) AS id_b FROM documents a JOIN documents b ON coalesce(a.text, '') = coalesce(b.text, '') AND a.text IS NOT NULL AND b.text IS NOT NULL WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY a.doc_id")
def matched_by_text(spark, sf_dir):
    """Documents of even ids beside those of odd ids with the same text."""
    docs = R.read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return L.matched_by_text(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"))


COMPARED = DECIDED + """, la AS (SELECT id, unnest(['spam_promo', 'templated', 'informativeness']) AS q, unnest([spam, templated, informativeness]) AS a, unnest([round(spam * 0.8 + templated * 0.2, 6), round(spam, 6), informativeness]) AS b FROM telling WHERE id % 3 <> 1),
r AS (SELECT q, a, b, rank() OVER (PARTITION BY q ORDER BY a) + (count(*) OVER (PARTITION BY q, a) - 1) / 2e0 AS ra, rank() OVER (PARTITION BY q ORDER BY b) + (count(*) OVER (PARTITION BY q, b) - 1) / 2e0 AS rb FROM la)
SELECT q AS question, count(*) AS n, round(avg(abs(a - b)), 6) AS mean_delta, round(corr(ra, rb), 6) AS rho FROM r GROUP BY q"""


@query(COMPARED)
def compared_runs(spark, sf_dir):
    """Two runs' answers by question: rank correlation and mean difference, over the reviews that both have."""
    rows = judged(spark, sf_dir)
    names = ["spam_promo", "templated", "informativeness"]
    a = long_answers(rows).where(F.col("question").isin(names))
    b = long_answers(rows.where("id % 3 <> 1").withColumns({"spam": F.round(F.col("spam") * 0.8 + F.col("templated") * 0.2, 6), "templated": F.round("spam", 6)})).where(F.col("question").isin(names))
    return L.compared_runs(a, b).select("question", "n", F.round("mean_delta", 6).alias("mean_delta"), F.round("rho", 6).alias("rho"))


@query(DECIDED + "SELECT count(*) AS n, round(avg(CASE WHEN code = CASE WHEN spam > 0.9e0 THEN 3 WHEN score0 < 0.7e0 THEN 2 ELSE 1 END THEN 1e0 ELSE 0e0 END), 6) AS agreement FROM decided WHERE id % 3 <> 1")
def decision_agreement(spark, sf_dir):
    rows = judged(spark, sf_dir)
    other = rows.where("id % 3 <> 1").select("id", F.when(F.col("spam") > 0.9, 3).when(F.col("score") < 0.7, 2).otherwise(1).alias("code"))
    return L.decision_agreement(rows, other).withColumn("agreement", F.round("agreement", 6))


@query(DECIDED + f"SELECT id, {ACTION} AS action, array_to_string(reasons, ',') AS reasons, round(score, 6) AS score, left(regexp_replace(text, chr(10), ' ', 'g'), 200) AS text FROM decided WHERE id % 10 = 3 ORDER BY id LIMIT 20")
def tuning_set_shown(spark, sf_dir):
    """The first decisions of one stratum of a tuning set, for reading."""
    rows = judged(spark, sf_dir).withColumn("stratum", F.when(F.col("id") % 10 == 3, "third"))
    out = L.shown(rows.drop("text"), R.reviews(spark, sf_dir), "third")
    return out.select("id", "action", F.array_join("reasons", ",").alias("reasons"), F.round("score", 6).alias("score"), "text")
