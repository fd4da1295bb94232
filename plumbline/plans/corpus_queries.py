"""Queries over time series, vectors, clusters, labels and the star schema's events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.config import Bursts
from plumbline.functions import text as T
from plumbline.operators import bursts as B
from plumbline.operators import clusters as C
from plumbline.operators import density as DN
from plumbline.operators import evaluate as E
from plumbline.plans import sql as S
from plumbline.registry import query
from plumbline.sources import reviews as R
from plumbline.streaming import live

#: The driver's events are flat: lower thresholds than the defaults.
FLAT = replace(Bursts(), z=3.0, min_reviews=5)
EVENTS = "SELECT event_id AS id, ts AS created_at, CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 ELSE 0e0 END AS rating_norm, user_id FROM events"


def rated_events(spark, sf_dir):
    return R.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type").isin("purchase", "signup"), 1.0).otherwise(0.0).alias("rating_norm"), "user_id")


def shown(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS id FROM events")
def chronological_ids(spark, sf_dir):
    return R.chronological(R.read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "id")


@query("WITH " + S.REVIEWS + " SELECT rating_raw, (rating_raw - 1) / 4 AS rating_norm, count(*) AS n FROM reviews GROUP BY rating_raw")
def rating_scale_and_norm(spark, sf_dir):
    rows = R.reviews(spark, sf_dir)
    return rows.groupBy("rating_raw").agg(F.count("*").alias("n")).withColumn("rating_norm", R.normal_rating(F.col("rating_raw"), "1-5")).select("rating_raw", "rating_norm", "n")


@query("WITH " + S.REVIEWS + " SELECT rating_raw, count(*) AS n FROM reviews GROUP BY rating_raw")
def rating_histogram(spark, sf_dir):
    return R.reviews(spark, sf_dir).where("rating_raw IS NOT NULL").groupBy("rating_raw").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(rating_norm), 6) AS mean FROM ({EVENTS}) GROUP BY 1")
def daily_timeline(spark, sf_dir):
    return rated_events(spark, sf_dir).groupBy(F.to_date("created_at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("rating_norm"), 6).alias("mean"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, min(id) AS first_id, count(*) AS n FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS id FROM events) GROUP BY 1")
def hour_index(spark, sf_dir):
    rows = R.chronological(R.read(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id")
    return rows.groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


GRID = f"""e AS ({EVENTS}), h AS (SELECT date_trunc('hour', created_at) AS hour, CASE WHEN rating_norm >= 0.5 THEN 'positive' ELSE 'negative' END AS verdict, count(*) AS n FROM e GROUP BY 1, 2),
g AS (SELECT unnest(range(a, b + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour FROM (SELECT min(hour) AS a, max(hour) AS b FROM h)),
grid AS (SELECT g.hour, v.verdict, coalesce(h.n, 0) AS n FROM g CROSS JOIN (SELECT unnest(['positive', 'negative']) AS verdict) v LEFT JOIN h ON h.hour = g.hour AND h.verdict = v.verdict)"""


@query(f"WITH {GRID} SELECT verdict, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n FROM grid")
def hour_verdict_grid(spark, sf_dir):
    return B.hourly(rated_events(spark, sf_dir)).select("verdict", shown("hour"), "n")


@query(f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS n, round(avg(CASE WHEN rating_norm >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS share FROM ({EVENTS}) GROUP BY 1 HAVING count(*) >= 20")
def daily_positive_share(spark, sf_dir):
    return B.daily_share(rated_events(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "n", F.round("share", 6).alias("share"))


@query(f"""WITH {GRID}, w AS (SELECT verdict, hour, n, list(n) OVER (PARTITION BY verdict ORDER BY hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING) AS w FROM grid),
m AS (SELECT *, list_median(w) AS med FROM w WHERE len(w) >= 72), d AS (SELECT *, list_median(list_transform(w, lambda x: abs(x - med))) AS mad FROM m)
SELECT verdict, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n, med, round((n - med) / greatest(1.4826e0 * mad, 1e0), 6) AS z FROM d""")
def trailing_robust_z(spark, sf_dir):
    return B.trailing_z(B.hourly(rated_events(spark, sf_dir))).select("verdict", shown("hour"), "n", "med", F.round("z", 6).alias("z"))


def _grid(events: str) -> str:
    return GRID.replace(EVENTS, events)


def _burst_sql(events: str, z: float, least: int, size: int) -> str:
    """Hours scored one after the other (flagged ones never enter the past), merged into windows."""
    return f"""{_grid(events)}, ser AS (SELECT verdict, hour, n, row_number() OVER (PARTITION BY verdict ORDER BY hour) AS i FROM grid),
st AS (SELECT DISTINCT verdict, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS past, CAST(NULL AS TIMESTAMP) AS hour, CAST(0 AS BIGINT) AS n, 0e0 AS z, false AS f, CAST(NULL AS DOUBLE) AS base FROM ser
 UNION ALL SELECT verdict, i, CASE WHEN f THEN past ELSE list_append(past, CAST(n AS DOUBLE))[-168:] END, hour, n, z, f, base FROM (SELECT *, coalesce(z >= {z}e0 AND n >= {least}, false) AS f FROM (
  SELECT *, CASE WHEN base IS NULL THEN 0e0 ELSE (n - base) / greatest(1.4826e0 * list_median(list_transform(past, lambda x: abs(x - base))), 1e0) END AS z FROM (SELECT s.verdict, g.i, s.past, g.hour, g.n, CASE WHEN len(s.past) >= 72 THEN list_median(s.past) END AS base FROM st s JOIN ser g ON g.verdict = s.verdict AND g.i = s.i + 1)))),
fl AS (SELECT *, CASE WHEN coalesce(epoch(hour) / 3600 - lag(epoch(hour) / 3600) OVER (PARTITION BY verdict ORDER BY hour) > 3, true) THEN 1 ELSE 0 END AS fresh FROM st WHERE f),
sp AS (SELECT verdict, min(hour) AS a, max(hour) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY verdict ORDER BY hour) AS island FROM fl) GROUP BY verdict, island),
win AS (SELECT sp.verdict, a, b, CAST(sum(n) AS BIGINT) AS size, count(*) AS hours, arg_max(hour, (n, -epoch(hour))) AS peak, max(n) AS peak_count, round(arg_max(z, (n, -epoch(hour))), 1) AS peak_z, round(avg(base), 2) AS baseline FROM sp JOIN st ON st.verdict = sp.verdict AND st.hour BETWEEN a AND b GROUP BY 1, 2, 3 HAVING sum(n) >= {size})"""


_SHOWN = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_WINDOWS = f"SELECT verdict, {_SHOWN.format('a')} AS start, {_SHOWN.format('b')} AS \"end\", size, hours, {_SHOWN.format('peak')} AS peak_hour, peak_count, peak_z, baseline AS baseline_per_hour FROM win"
#: Hours in which every event is planted twelve times.
BUSY = ("2024-01-15 14:00:00", "2024-01-15 15:00:00", "2024-01-15 16:00:00", "2024-01-22 03:00:00")
PLANTED = f"SELECT id + 1000000 * r AS id, created_at, rating_norm, user_id FROM ({EVENTS}) e CROSS JOIN range(12) t(r) WHERE r = 0 OR {_SHOWN.format("date_trunc('hour', created_at)")} IN {BUSY}"


def planted(spark, sf_dir):
    """Rated events with bursts."""
    rows = rated_events(spark, sf_dir)
    busy = F.date_format(F.date_trunc("hour", "created_at"), "yyyy-MM-dd HH:mm:ss").isin(*BUSY)
    return rows.withColumn("r", F.explode(F.when(busy, F.sequence(F.lit(0), F.lit(11))).otherwise(F.array(F.lit(0))))).withColumn("id", F.col("id") + 1_000_000 * F.col("r")).drop("r")


def shown_windows(found):
    return found.select("verdict", shown("start"), shown("end"), "size", "hours", shown("peak_hour"), "peak_count", "peak_z", "baseline_per_hour")


@query(f"WITH RECURSIVE {_burst_sql(EVENTS, 3, 5, 5)} {_WINDOWS}")
def bursts_exact(spark, sf_dir):
    return shown_windows(B.windows(B.scored_hours(rated_events(spark, sf_dir), FLAT), FLAT))


@query(f"WITH RECURSIVE {_burst_sql(PLANTED, 6, 5, 30)} {_WINDOWS}")
def planted_bursts(spark, sf_dir):
    """Bursts at the default thresholds, in a series that has some."""
    return shown_windows(B.windows(B.scored_hours(planted(spark, sf_dir))))


@query(f"WITH RECURSIVE {_burst_sql(PLANTED, 6, 5, 30)} SELECT v.verdict, {_SHOWN.format('a')} AS start, e.id FROM win v JOIN ({PLANTED}) e ON (CASE WHEN rating_norm >= 0.5 THEN 'positive' ELSE 'negative' END) = v.verdict AND date_trunc('hour', e.created_at) BETWEEN a AND b")
def burst_members(spark, sf_dir):
    rows = planted(spark, sf_dir)
    return B.members(rows, B.windows(B.scored_hours(rows))).select("verdict", shown("start"), "id")


#: From this day on most events count as positive.
STEP = "2024-01-16 00:00:00"
STEPPED = f"SELECT id, created_at, CASE WHEN created_at >= TIMESTAMP '{STEP}' AND id % 10 < 8 THEN 1e0 ELSE rating_norm END AS rating_norm, user_id FROM ({EVENTS})"


@query(f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY day) - 1 AS k, day, share FROM (SELECT CAST(created_at AS DATE) AS day, avg(CASE WHEN rating_norm >= 0.5 THEN 1e0 ELSE 0e0 END) AS share FROM ({STEPPED}) GROUP BY 1 HAVING count(*) >= 20)),
n AS (SELECT count(*) AS n, 3 * ln(count(*)) * CASE WHEN var_pop(share) = 0 THEN 1e-6 ELSE var_pop(share) END AS pen FROM d), nodes AS (SELECT k FROM d, n WHERE k % 5 = 0 AND (k = 0 OR k >= 3) UNION SELECT n FROM n),
seg AS (SELECT a.k AS a, b.k AS b, sum(share * share) - pow(sum(share), 2) / count(*) AS cost FROM nodes a JOIN nodes b ON b.k - a.k >= 3 JOIN d ON d.k >= a.k AND d.k < b.k GROUP BY 1, 2),
path AS (SELECT CAST(0 AS BIGINT) AS pos, -pen AS total, CAST([] AS BIGINT[]) AS points FROM n UNION ALL SELECT s.b, p.total + s.cost + n.pen, list_append(p.points, CAST(s.b AS BIGINT)) FROM path p JOIN seg s ON s.a = p.pos, n),
best AS (SELECT arg_min(points, total) AS points FROM path, n WHERE pos = n) SELECT CAST(day AS VARCHAR) AS day FROM d WHERE k IN (SELECT unnest(points) FROM best)""")
def change_points(spark, sf_dir):
    """Where the daily share of positive events shifts, in a series with a step."""
    stepped = F.when((F.col("created_at") >= F.lit(STEP).cast("timestamp_ntz")) & (F.col("id") % 10 < 8), 1.0).otherwise(F.col("rating_norm"))
    return B.change_points(rated_events(spark, sf_dir).withColumn("rating_norm", stepped)).select(F.col("day").cast("string").alias("day"))


NEAREST = """SELECT a.vec_id AS id, arg_min(b.vec_id, (-round(s, 9), b.vec_id)) AS neighbour, round(max(s), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_inner_product(a.v, b.v) AS s) GROUP BY a.vec_id"""


@query(NEAREST)
def nearest_neighbour(spark, sf_dir):
    return C.nearest(R.read(spark, sf_dir, "embeddings")).select("id", "neighbour", F.round("cosine", 6).alias("cosine"))


@query("""WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY label)
SELECT label, count(*) AS size, round(avg(CASE WHEN list_inner_product(embedding::DOUBLE[], c) / greatest(sqrt(list_inner_product(c, c)), 1e-9) >= 0.2 THEN 1e0 ELSE 0e0 END), 6) AS similarity FROM embeddings JOIN c USING (label) GROUP BY label""")
def centroid_similarity(spark, sf_dir):
    """At a cosine of 0.2, as the driver's vectors are spread wide."""
    return C.centroid_similarity(R.read(spark, sf_dir, "embeddings"), "label", cosine=0.2).select("label", "size", F.round("similarity", 6).alias("similarity"))


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), root AS (SELECT v.vec_id AS id, least(v.vec_id, coalesce(min(r.b), v.vec_id)) AS root FROM embeddings v LEFT JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY root) >= 2 THEN root ELSE -1 END AS cluster FROM root""")
def semantic_clusters(spark, sf_dir):
    return C.cosine_components(R.read(spark, sf_dir, "embeddings"), 0.45)

DENSE = 5
#: Mutual reachability, the spanning tree by Prim's rule, its edges joined in order, clusters by excess of mass: lists over all rows, a row a step.
DENSITY = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, embedding::DOUBLE[] AS v FROM embeddings), size AS (SELECT count(*) AS n FROM v),
d AS MATERIALIZED (SELECT a.i, b.i AS j, round(list_distance(a.v, b.v), 8) AS d FROM v a JOIN v b ON a.i <> b.i),
core AS MATERIALIZED (SELECT i, d AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d) WHERE k = {DENSE - 1}),
r AS MATERIALIZED (SELECT d.i, list(greatest(d, a.core, b.core) ORDER BY j) AS row FROM (SELECT * FROM d UNION ALL SELECT i, i, 0 FROM v) d JOIN core a ON a.i = d.i JOIN core b ON b.i = d.j GROUP BY d.i),
prim AS (SELECT 0 AS k, CAST(1 AS BIGINT) AS cur, {{'w': 0e0, 'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT)}} AS e, list_transform(range(1, n + 1), lambda j: CASE WHEN j > 1 THEN {{'w': 1e300, 'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT), 'j': j}} END) AS near FROM size
 UNION ALL SELECT k + 1, best.j, best, list_transform(near, lambda x, j: CASE WHEN j <> best.j THEN x END) FROM (SELECT k, near, list_min(near) AS best FROM (
  SELECT k, list_transform(list_zip(near, row), lambda z, j: CASE WHEN z[1] IS NULL THEN NULL WHEN {{'w': z[2], 'a': least(j, cur), 'b': greatest(j, cur), 'j': j}} < z[1] THEN {{'w': z[2], 'a': least(j, cur), 'b': greatest(j, cur), 'j': j}} ELSE z[1] END) AS near FROM prim JOIN r ON r.i = cur)) WHERE best IS NOT NULL),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e.w, e.a, e.b) AS k, e.w AS w, e.a AS a, e.b AS b FROM prim WHERE k > 0),
kr AS (SELECT CAST(0 AS BIGINT) AS k, 0e0 AS w, range(1, n + 1) AS comp, list_transform(range(1, n + 1), lambda x: CAST(0 AS BIGINT)) AS node, CAST(0 AS BIGINT) AS na, CAST(0 AS BIGINT) AS nb, CAST(0 AS BIGINT) AS made, CAST([] AS BIGINT[]) AS gone FROM size
 UNION ALL SELECT k, w, list_transform(comp, lambda x: CASE WHEN x = ca OR x = cb THEN least(ca, cb) ELSE x END), list_transform(list_zip(comp, node), lambda z: CASE WHEN z[1] = ca OR z[1] = cb THEN made ELSE z[2] END), na, nb, made,
  CASE WHEN made > 0 THEN list_transform(list_filter(list_zip(comp, node, range(1, len(comp) + 1)), lambda z: (z[1] = ca OR z[1] = cb) AND z[2] = 0), lambda z: z[3]) ELSE [] END
  FROM (SELECT *, CASE WHEN na > 0 AND nb > 0 THEN k WHEN na + nb > 0 THEN na + nb WHEN len(list_filter(comp, lambda x: x = ca OR x = cb)) >= {DENSE} THEN k ELSE 0 END AS made FROM (
   SELECT e.k, e.w, comp, node, comp[e.a] AS ca, comp[e.b] AS cb, node[e.a] AS na, node[e.b] AS nb FROM kr JOIN e ON e.k = kr.k + 1))),
dropped AS MATERIALIZED (SELECT unnest(gone) AS i, w, made FROM kr WHERE made > 0), own AS MATERIALIZED (SELECT made, count(*) AS n, sum(1 / greatest(w, 1e-12)) AS mass FROM dropped GROUP BY made),
ups AS MATERIALIZED (SELECT na AS x, k AS up FROM kr WHERE na > 0 AND nb > 0 UNION ALL SELECT nb, k FROM kr WHERE na > 0 AND nb > 0),
nodes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY kr.k) AS t, kr.k AS x, 1 / greatest(kr.w, 1e-12) AS dense, coalesce(own.n, 0) AS n, coalesce(own.mass, 0) AS mass, ups.up, coalesce(1 / greatest(u.w, 1e-12), 0) AS start FROM kr LEFT JOIN own ON own.made = kr.k LEFT JOIN ups ON ups.x = kr.k LEFT JOIN kr u ON u.k = ups.up WHERE kr.made = kr.k AND kr.k > 0),
kids AS MATERIALIZED (SELECT up, list(x) AS kids FROM ups GROUP BY up),
eom AS (SELECT CAST(0 AS BIGINT) AS t, list_transform(range(1, n + 1), lambda x: 0e0) AS kept, list_transform(range(1, n + 1), lambda x: CAST(0 AS BIGINT)) AS pts, list_transform(range(1, n + 1), lambda x: false) AS sel FROM size
 UNION ALL SELECT t, list_transform(kept, lambda y, i: CASE WHEN i = x THEN CASE WHEN up IS NULL OR (len(kids) > 0 AND parts > m) THEN parts ELSE m END ELSE y END), list_transform(pts, lambda y, i: CASE WHEN i = x THEN inner_n + n ELSE y END), list_transform(sel, lambda y, i: CASE WHEN i = x THEN NOT (up IS NULL OR (len(kids) > 0 AND parts > m)) ELSE y END)
  FROM (SELECT *, mass - n * start + inner_n * (dense - start) AS m FROM (SELECT g.t, g.x, g.up, g.n, g.mass, g.start, g.dense, kept, pts, sel, coalesce(kids, []) AS kids, coalesce(list_sum(list_transform(kids, lambda c: kept[c])), 0) AS parts, CAST(coalesce(list_sum(list_transform(kids, lambda c: pts[c])), 0) AS BIGINT) AS inner_n FROM eom JOIN nodes g ON g.t = eom.t + 1 LEFT JOIN kids ON kids.up = g.x))),
anc AS (SELECT x, x AS y FROM nodes UNION SELECT anc.x, ups.up FROM anc JOIN ups ON ups.x = anc.y), done AS (SELECT sel FROM eom ORDER BY t DESC LIMIT 1),
top AS (SELECT x, max(y) AS y FROM anc, done WHERE sel[y] GROUP BY x), placed AS (SELECT v.vec_id, top.y FROM v LEFT JOIN dropped ON dropped.i = v.i LEFT JOIN top ON top.x = dropped.made)
SELECT vec_id AS id, CASE WHEN y IS NULL THEN -1 ELSE min(vec_id) OVER (PARTITION BY y) END AS cluster FROM placed"""


@query(DENSITY)
def density_clusters(spark, sf_dir):
    """Hierarchical density clusters of at least five vectors; -1 is noise."""
    return DN.density_clusters(R.read(spark, sf_dir, "embeddings"), DENSE)


@query("""WITH t AS (SELECT user_id, epoch_us(ts) AS us FROM events), w AS (SELECT user_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 3599999999 FOLLOWING) AS n FROM t)
SELECT user_id, max(n) AS count, strftime(make_timestamp(arg_max(us, (n, -us))), '%Y-%m-%d %H:%M:%S') AS start FROM w GROUP BY user_id""")
def densest_window(spark, sf_dir):
    rows = rated_events(spark, sf_dir)
    return C.densest(rows, 1, key="user_id").select("user_id", "count", shown("start"))


SCALES = ((0.25, 0), (1, 1), (6, 2), (24, 3), (72, 4))


def _scales(name: str, rows: str, keys: str, value: str) -> str:
    """The fullest window of each group of rows at each scale."""
    return ", ".join(f"{name}{k} AS (SELECT {keys}, {h}e0 AS hours, {k} AS k, {value} AS v FROM (SELECT {keys}, count(*) OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN CURRENT ROW AND {int(h * 3_600_000_000) - 1} FOLLOWING) AS n FROM {rows}) GROUP BY {keys})" for h, k in SCALES)


@query("WITH t AS (SELECT event_id AS id, user_id AS cluster, epoch_us(ts) AS us FROM events), s AS (SELECT cluster, count(*) AS size FROM t GROUP BY 1), sizes AS (SELECT DISTINCT size FROM s WHERE size >= 2), "
  "o AS (SELECT draw, us, row_number() OVER (PARTITION BY draw ORDER BY CAST(('0x' || substr(md5('7|' || draw || '|' || id), 1, 12)) AS BIGINT), id) AS rank FROM t, range(24) r(draw)), sub AS MATERIALIZED (SELECT size, draw, us FROM o JOIN sizes ON rank <= size), "
  + _scales("x", "sub", "size, draw", "max(n) - 1") + ", e AS (SELECT size, hours, avg(v) AS expected FROM (" + " UNION ALL ".join(f"SELECT * FROM x{k}" for _, k in SCALES) + ") GROUP BY 1, 2), "
  + _scales("w", "t", "cluster", "max(n)") + f""", v AS (SELECT cluster, hours, k, v AS count, CASE WHEN v - 1 <= 0 THEN 0 ELSE greatest(0, 1 - greatest(coalesce(expected, 0), 0.5) / (v - 1)) END AS value FROM ({' UNION ALL '.join(f'SELECT * FROM w{k}' for _, k in SCALES)}) JOIN s USING (cluster) LEFT JOIN e USING (size, hours))
SELECT cluster, round(max(value), 6) AS concentration, arg_max(hours, (round(value, 12), -k)) AS hours, arg_max(count, (round(value, 12), -k)) AS count FROM v GROUP BY cluster""")
def null_concentration(spark, sf_dir):
    """Concentration of each user's events against random subsets of all times."""
    rows = rated_events(spark, sf_dir).withColumnRenamed("user_id", "cluster")
    sizes = rows.where("created_at IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("size"))
    return C.time_concentration(rows, C.expected_others(sizes, rows)).select("cluster", F.round("concentration", 6).alias("concentration"), "hours", "count")


@query(f"SELECT user_id, count(*) AS n, round((greatest(avg(rating_norm), 1 - avg(rating_norm)) - 0.5) / 0.5, 6) AS homogeneity FROM ({EVENTS}) GROUP BY user_id")
def rating_homogeneity(spark, sf_dir):
    return rated_events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(C.homogeneity(), 6).alias("homogeneity"))


LIFT = S.over_reviews(S.ANSWERS) + """, b AS (SELECT avg(CASE WHEN low_playtime THEN 1e0 ELSE 0e0 END) AS base FROM answered),
f AS (SELECT author_id, count(*) AS n, avg(CASE WHEN low_playtime THEN 1e0 ELSE 0e0 END) AS share, avg(p_offtopic) AS offtopic, (greatest(avg(rating_norm), 1 - avg(rating_norm)) - 0.5) / 0.5 AS hom, any_value(base) AS base FROM answered, b GROUP BY author_id),
l AS (SELECT *, CASE WHEN share > 0 THEN greatest(0, 1 - base / share) ELSE 0 END AS lift FROM f)"""


def author_factors(spark, sf_dir):
    rows = R.numbered_answers(R.reviews(spark, sf_dir))
    base = rows.agg(F.avg(F.col("low_playtime").cast("double")).alias("base"))
    per = rows.groupBy("author_id").agg(F.count("*").alias("n"), F.avg(F.col("low_playtime").cast("double")).alias("share"), F.avg("p_offtopic").alias("offtopic"), C.homogeneity().alias("hom"))
    return per.crossJoin(F.broadcast(base)).withColumn("lift", C.account_lift(F.col("share"), F.col("base")))


@query(LIFT + " SELECT author_id, n, round(lift, 6) AS lift FROM l")
def new_account_lift(spark, sf_dir):
    return author_factors(spark, sf_dir).select("author_id", "n", F.round("lift", 6).alias("lift"))


@query(LIFT + " SELECT author_id, n, CAST(round(CAST(offtopic AS DECIMAL(18, 9)), 6) AS DOUBLE) AS offtopic FROM l")
def offtopic_mean(spark, sf_dir):
    return author_factors(spark, sf_dir).select("author_id", "n", F.round(F.col("offtopic").cast("decimal(18,9)"), 6).cast("double").alias("offtopic"))


@query(LIFT + " SELECT author_id, round(exp((0.5 * ln(greatest(0.02, least(1, lift))) + 0.5 * ln(greatest(0.02, least(1, offtopic))) + ln(greatest(0.02, least(1, hom)))) / 2), 6) AS suspicion FROM l")
def suspicion_score(spark, sf_dir):
    s = C.geometric_mean({"new_account_share": F.col("lift"), "offtopic_mean": F.col("offtopic"), "similarity": F.lit(None).cast("double"), "rating_homogeneity": F.col("hom")})
    return author_factors(spark, sf_dir).select("author_id", F.round(s, 6).alias("suspicion"))


@query(f"""WITH p AS (SELECT l.toxic AS a, CASE WHEN {S.TOKENS} % 2 = 0 THEN 1 ELSE 0 END AS b FROM labels l JOIN documents d USING (doc_id)), n AS (SELECT count(*)::DOUBLE AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) AS po,
  avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM p) SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM n""")
def kappa_agreement(spark, sf_dir):
    docs = R.read(spark, sf_dir, "documents").select("doc_id", F.when(T.token_count(F.col("text")) % 2 == 0, 1).otherwise(0).alias("b"))
    pairs = R.read(spark, sf_dir, "labels").join(docs, "doc_id")
    return E.kappa(pairs, "toxic", "b").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""WITH p AS (SELECT label AS a, list_position(embedding[1:10], list_max(embedding[1:10])) AS b FROM embeddings), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM p GROUP BY a, b),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY a)) AS ra, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY b)) AS rb, (SELECT sum(n) FROM c) AS n)
SELECT CAST(n AS BIGINT) AS n, round((i - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 6) AS ari FROM s""")
def adjusted_rand_index(spark, sf_dir):
    """Labels against the largest of the first ten components."""
    top = F.slice("embedding", 1, 10)
    pairs = R.read(spark, sf_dir, "embeddings").select("label", F.array_position(top, F.array_max(top)).alias("b"))
    return E.adjusted_rand(pairs, "label", "b").select("n", F.round("ari", 6).alias("ari"))


@query("""WITH r AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), x AS (SELECT (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0) AS ra, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0) AS rb FROM r)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM x""")
def spearman_agreement(spark, sf_dir):
    return E.spearman(R.read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").select("n", F.round("rho", 6).alias("rho"))


@query("SELECT event_id, k % 7 = 0 AS low_playtime, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 4 <= 1 END AS single_review_account FROM (SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def account_flags(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    meta = F.to_json(F.struct(F.when(k % 7 == 0, 60).otherwise(600).alias("author_playtime_at_review"), F.when(k % 3 != 0, k % 4).alias("author_num_reviews")))
    rows = R.read(spark, sf_dir, "events").select("event_id", meta.alias("meta"))
    flags = T.account_flags(F.col("meta"))
    return rows.select("event_id", flags["low_playtime"].alias("low_playtime"), flags["single_review_account"].alias("single_review_account"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(round(count(*) * 0.2) AS BIGINT) AS n FROM events GROUP BY 1")
def stratified_sample_per_day(spark, sf_dir):
    """Sizes of a 20 % sample of each day; which rows are drawn depends on a seeded hash."""
    rows = R.daily_sample(R.read(spark, sf_dir, "events"), "ts", "event_id", 0.2)
    return rows.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS action FROM events GROUP BY user_id")
def streaming_last_write_wins(spark, sf_dir):
    """The batch form of the streaming query that the tests replay."""
    updates = R.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    return live.last_write(updates)
