"""Queries of single steps of a run: clusters found and scored, memberships, policy branches, sketches, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions import text as T
from plumbline.operators import bursts as B
from plumbline.operators import clusters as C
from plumbline.operators import duplicates as D
from plumbline.operators import platform as PL
from plumbline.operators import policy as PO
from plumbline.operators import summary as SU
from plumbline.plans import run as RUN
from plumbline.plans import sql as S
from plumbline.plans.corpus_queries import EVENTS, PLANTED, SCALES, _burst_sql, planted, rated_events, shown
from plumbline.plans.decision_queries import judged, opened
from plumbline.plans.inspect_queries import CLUSTERS, DECIDED, clusters_of, members_of
from plumbline.registry import query
from plumbline.sources import reviews as R

GROUPED = f"grp AS (SELECT id, created_at, rating_norm, user_id, id % 17 AS g FROM ({PLANTED}) WHERE id % 5 = 0)"


@query(f"""WITH RECURSIVE {_burst_sql(PLANTED, 6, 5, 30)}, {GROUPED}, b AS (SELECT 'burst' AS kind, v.verdict || ' ' || strftime(a, '%Y-%m-%d %H:%M:%S') AS key, e.id FROM win v JOIN ({PLANTED}) e ON (CASE WHEN rating_norm >= 0.5 THEN 'positive' ELSE 'negative' END) = v.verdict AND date_trunc('hour', e.created_at) BETWEEN a AND b),
d AS (SELECT 'duplicate' AS kind, lpad(CAST(g AS VARCHAR), 20, '0') AS key, id FROM grp WHERE g IN (SELECT g FROM grp GROUP BY g HAVING count(*) >= 3)), s AS (SELECT 'semantic' AS kind, lpad(CAST(id % 4 AS VARCHAR), 20, '0') AS key, id FROM ({EVENTS}) WHERE id % 9 = 0 AND id % 4 < 3),
m AS (SELECT * FROM b UNION ALL SELECT * FROM d UNION ALL SELECT * FROM s), k AS (SELECT kind, key, count(*) AS size FROM m GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY CASE kind WHEN 'burst' THEN 0 WHEN 'duplicate' THEN 1 ELSE 2 END, key) - 1 AS cluster_id, kind, key, size FROM k""")
def clusters_found(spark, sf_dir):
    """Bursts, duplicate groups of three and more, and given semantic clusters, numbered in that order."""
    rows = planted(spark, sf_dir).withColumn("dup_group_id", F.when(F.col("id") % 5 == 0, F.col("id") % 17).otherwise(-1))
    semantic = rated_events(spark, sf_dir).where("id % 9 = 0").select("id", F.when(F.col("id") % 4 < 3, F.col("id") % 4).otherwise(-1).alias("cluster"))
    numbered, _ = RUN.find_clusters(rows, B.windows(B.scored_hours(rows)), Config(), semantic)
    return numbered.select(F.col("cluster_id").cast("long").alias("cluster_id"), "kind", "key", "size")


@query(DECIDED + f""", {CLUSTERS}, eligible AS (SELECT * FROM clusters WHERE size >= 10 AND suspicion > 0), inside AS (SELECT id FROM members JOIN clusters USING (cluster_id) WHERE kind = 'burst' AND id % 2 = 0),
mm AS (SELECT * FROM members UNION ALL SELECT (cluster_id * 7 + 3) % 150 AS cluster_id, id FROM members), j AS (SELECT m.id, e.* FROM mm m JOIN eligible e ON e.cluster_id = m.cluster_id WHERE e.kind <> 'semantic' OR m.id IN (SELECT id FROM inside))
SELECT id, arg_max(cluster_id, (suspicion, -cluster_id)) AS cluster_id, arg_max(kind, (suspicion, -cluster_id)) AS kind, max(suspicion) AS suspicion FROM j GROUP BY id""")
def best_membership(spark, sf_dir):
    """Each review's most suspicious eligible cluster; semantic ones count within bursts only."""
    rows = judged(spark, sf_dir)
    clusters, members = clusters_of(rows), members_of(rows)
    both = members.unionByName(members.withColumn("cluster_id", (F.col("cluster_id") * 7 + 3) % 150))
    inside = members.join(clusters.where("kind = 'burst'"), "cluster_id").where("id % 2 = 0").select("id")
    return C.best_membership(both, clusters, inside)


@query("WITH t AS (SELECT user_id AS cluster, epoch_us(ts) AS us FROM events), s AS (SELECT cluster, count(*) AS size FROM t GROUP BY 1), " + ", ".join(f"w{k} AS (SELECT cluster, {h}e0 AS hours, {k} AS k, max(n) AS count FROM (SELECT cluster, count(*) OVER (PARTITION BY cluster ORDER BY us RANGE BETWEEN CURRENT ROW AND {int(h * 3_600_000_000) - 1} FOLLOWING) AS n FROM t) GROUP BY cluster)" for h, k in SCALES) + f""",
v AS (SELECT cluster, hours, k, count, CASE WHEN count - 1 <= 0 THEN 0 ELSE greatest(0, 1 - greatest(size * hours / 500, 0.5) / (count - 1)) END AS value FROM ({' UNION ALL '.join(f'SELECT * FROM w{k}' for _, k in SCALES)}) JOIN s USING (cluster))
SELECT cluster, round(max(value), 6) AS concentration, arg_max(hours, (round(value, 12), -k)) AS hours FROM v GROUP BY cluster""")
def concentration_at_scales(spark, sf_dir):
    """Best of five time scales against a given expectation, of equal values the first scale."""
    rows = rated_events(spark, sf_dir).withColumnRenamed("user_id", "cluster")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size")).select("size").distinct()
    hours = F.explode(F.array(*[F.lit(float(h)) for h, _ in SCALES])).alias("hours")
    expected = sizes.select("size", hours).withColumn("expected", F.col("size") * F.col("hours") / 500)
    return C.time_concentration(rows, expected).select("cluster", F.round("concentration", 6).alias("concentration"), "hours")


@query(S.over_reviews(S.ANSWERS, S.JUDGED) + "SELECT id, CASE WHEN spam > 0.9e0 THEN CASE WHEN id % 2 = 0 THEN 4 ELSE 3 END ELSE code END AS code, array_to_string(reasons, ',') AS reasons FROM decided")
def policy_with_promotion(spark, sf_dir):
    """Spam is excluded where a deterministic sign of promotion confirms it, else flagged."""
    rows = R.numbered_answers(R.reviews(spark, sf_dir))
    return opened(rows.withColumn("d", PO.judged(promo=F.col("id") % 2 == 0))).select("id", "code", F.array_join("reasons", ",").alias("reasons"))


@query(S.over_reviews(S.ANSWERS) + "SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN influence < 0.5 THEN 1e0 ELSE 0e0 END WHEN id % 3 = 1 THEN CASE WHEN id % 5 IN (0, 1) THEN 1e0 ELSE 0e0 END END AS offtopic FROM answered")
def offtopic_verdicts(spark, sf_dir):
    """Whether a verdict rests on playing; the topic is the proxy where that was not asked; unknown without both."""
    rows = R.numbered_answers(R.reviews(spark, sf_dir))
    i = F.col("id")
    topic = F.when(i % 5 == 0, "platform_policy").when(i % 5 == 1, "developer_conduct").otherwise("gameplay")
    return rows.select("id", PL.offtopic(F.when(i % 3 == 0, F.col("influence")), F.when(i % 3 == 1, topic)).alias("offtopic"))


@query("SELECT a.vec_id AS id, v.label, n.neighbour AS nearest_id, round(n.cosine, 4) AS nearest_cosine FROM (SELECT vec_id FROM embeddings) a JOIN embeddings v USING (vec_id) LEFT JOIN (SELECT a.vec_id AS id, arg_min(b.vec_id, (-round(s, 9), b.vec_id)) AS neighbour, max(s) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_inner_product(a.v, b.v) AS s) WHERE a.vec_id % 3 <> 0 AND b.vec_id % 3 <> 0 GROUP BY a.vec_id) n ON n.id = a.vec_id")
def features_with_neighbours(spark, sf_dir):
    """Features with the nearest review; rows that were not embedded stay without one."""
    vectors = R.read(spark, sf_dir, "embeddings")
    near = C.nearest(vectors.where("vec_id % 3 <> 0"))
    return SU.with_semantics(vectors.select(F.col("vec_id").alias("id"), "label"), near)


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+')) AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, CAST(('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2)) AS BIGINT) % 64 AS place, count(*) AS n FROM (SELECT doc_id, md5(w) AS m FROM w WHERE w <> '') GROUP BY 1, 2)
SELECT doc_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 4) AS x FROM h""")
def hashed_embeddings(spark, sf_dir):
    """Bag-of-words vectors by digest, their non-zero places."""
    docs = R.read(spark, sf_dir, "documents").where("text IS NOT NULL")
    vectors = C.embed(docs.select("doc_id", "text"))
    return vectors.select("doc_id", F.posexplode("embedding").alias("place", "x")).where("x > 0").select("doc_id", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query("""WITH d AS (SELECT greatest(4, least(9, CAST(floor(10 * (n - 10) / (n + 10e0)) AS INTEGER))) / 10e0 AS t, count(*) AS documents FROM (SELECT greatest(length(coalesce(text, '')) - 4, 0) AS n FROM documents) GROUP BY 1),
p AS (SELECT r, b FROM range(1, 129) t(r), range(1, 129) u(b) WHERE r * b <= 128), g AS (SELECT i / 2000e0 AS s FROM range(0, 2001) t(i)),
c AS (SELECT t, r, b, 0.5 * (sum(CASE WHEN s <= t THEN 1 - pow(1 - pow(s, r), b) ELSE 0 END) + sum(CASE WHEN s >= t THEN pow(1 - pow(s, r), b) ELSE 0 END)) / 2000 AS cost FROM (SELECT DISTINCT t FROM d), p, g GROUP BY t, r, b),
best AS (SELECT t, CAST(arg_min(b, (round(cost, 12), r, b)) AS BIGINT) AS bands, CAST(arg_min(r, (round(cost, 12), r, b)) AS BIGINT) AS rows FROM c GROUP BY t)
SELECT t AS threshold, documents, bands, rows FROM d JOIN best USING (t)""")
def lsh_parameters(spark, sf_dir):
    """Bands and rows with the least area of wrong answers, for the similarity that one edited word leaves of a document of each length."""
    n = F.greatest(F.length(F.coalesce("text", F.lit(""))) - 4, F.lit(0))
    left = F.greatest(F.lit(4), F.least(F.lit(9), F.floor(10 * (n - 10) / (n + 10.0)))) / 10.0
    found = R.read(spark, sf_dir, "documents").groupBy(left.cast("double").alias("threshold")).agg(F.count("*").alias("documents"))
    table = spark.createDataFrame([(t / 10, *D.lsh_parameters(t / 10)) for t in range(4, 10)], "threshold double, bands long, rows long")
    return found.join(table, "threshold")


WORD_SHINGLES = r"""ws AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i : i + 2], ' ')))) AS s FROM ws WHERE len(w) > 0)"""


@query(f"WITH {WORD_SHINGLES}, z AS (SELECT doc_id, count(*)::DOUBLE AS n FROM sh GROUP BY 1) SELECT doc_id, CAST(n AS BIGINT) AS shingles FROM z")
def word_shingles(spark, sf_dir):
    """Distinct three-word shingles of a document."""
    docs = R.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.word_shingles(F.col("text"), 3)).cast("long").alias("shingles")).where("shingles > 0")


@query(S.over_reviews(S.ANSWERS) + "SELECT id, round(CASE WHEN id % 2 = 0 THEN informativeness / 3 ELSE support / 3 END, 6) AS level, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM answered")
def score_levels(spark, sf_dir):
    """Scores over their levels, in [0, 1]."""
    from plumbline.operators.answers import score_levels as levels

    n = levels("v5")
    rows = R.numbered_answers(R.reviews(spark, sf_dir))
    value = F.when(F.col("id") % 2 == 0, F.col("informativeness") / (n["informativeness"] - 1)).otherwise(F.col("support") / (n["rating_support"] - 1))
    return rows.select("id", F.round(value, 6).alias("level"), shown("created_at"))
