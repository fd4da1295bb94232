"""Catalogues, caches, the paged source, and what raises."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators import answers as AN
from plumbline.operators import attacks as A
from plumbline.operators import clusters as C
from plumbline.operators import drilldown as I
from plumbline.operators import labelsets as L
from plumbline.operators import summary as SU
from plumbline.sources import catalogue, paged, sinks


def test_dataset_catalogue(spark, tmp_path):
    path = str(tmp_path / "datasets")
    assert catalogue.datasets(spark, path).count() == 0
    catalogue.record_dataset(spark, path, "d1", "First", "upload", "1-5", 10, "loading")
    catalogue.record_dataset(spark, path, "d2", "Second", "pull", "binary", 20)
    catalogue.set_status(spark, path, "d1", "ready")
    rows = {r.id: r for r in catalogue.datasets(spark, path).collect()}
    assert (rows["d1"].status, rows["d1"].n_reviews, rows["d2"].status) == ("ready", 10, "ready")
    with pytest.raises(KeyError):
        catalogue.set_status(spark, path, "d9", "ready")


def test_pull_parts_and_import(spark, tmp_path):
    pull, rows = str(tmp_path / "pull"), [(f"e{k % 70}", f"text {k}", 1000 + k) for k in range(100)]
    df = spark.createDataFrame(rows, "ext_id string, text string, s long").select("ext_id", "text", F.timestamp_seconds("s").cast("timestamp_ntz").alias("created_at"), F.lit(1.0).alias("rating_norm"))
    df.where("ext_id < 'e4'").coalesce(1).write.mode("append").parquet(pull)
    df.where("ext_id >= 'e4'").coalesce(1).write.mode("append").parquet(pull)
    found = catalogue.pulled(spark, pull).orderBy("id").collect()
    assert len(found) == len({r.ext_id for r in found}) == 70 and [r.id for r in found] == list(range(70))
    assert [r.created_at for r in found] == sorted(r.created_at for r in found) and all(r.text == "text " + r.ext_id[1:] for r in found)
    reviews, entries = str(tmp_path / "reviews"), str(tmp_path / "datasets")
    catalogue.import_pull(spark, pull, reviews, entries, "d1", "Pulled", 0.5)
    entry = catalogue.datasets(spark, entries).first()
    assert entry.n_reviews == spark.read.parquet(reviews).count() == 35


def test_vectors_are_cached_by_digest(spark, tmp_path):
    cache, calls = str(tmp_path / "vectors"), str(tmp_path / "neighbours")
    df = spark.createDataFrame([(1, "good game"), (2, "bad game"), (3, "good game"), (4, None)], "id long, text string")
    first, hit = catalogue.embed_cached(df, cache, "words")
    assert not hit and first.count() == 4
    again, hit = catalogue.embed_cached(df.where("id < 3"), cache, "words")
    assert hit and spark.read.parquet(cache).count() == 3
    assert not catalogue.embed_cached(df, cache, "other")[1]
    near = catalogue.nearest_cached(first, calls).orderBy("id").collect()
    assert near[0].neighbour == 3 and catalogue.nearest_cached(first, calls).count() == len(near)
    assert np.allclose(again.where("id = 1").first().embedding, first.where("id = 3").first().embedding)


def test_stored_neighbours_follow_their_rows(spark, tmp_path):
    """Rows that come, change and go: the table always equals a full search, and only what must be is searched for against all."""
    rng = np.random.default_rng(3)
    x = {i: v for i, v in enumerate(rng.normal(size=(120, 8)))}
    x[50], x[51] = x[20], x[20]
    cache = str(tmp_path / "neighbours")

    def frame(ids):
        return spark.createDataFrame([(i, (x[i] / np.linalg.norm(x[i])).tolist()) for i in ids], "id long, embedding array<double>")

    def check(ids):
        df = frame(ids)
        got = sorted(map(tuple, catalogue.nearest_cached(df, cache).selectExpr("id", "neighbour", "round(cosine, 9)").collect()))
        want = C.nearest(df, "id", "embedding").selectExpr("id", "neighbour", "round(cosine, 9)").collect()
        assert got == sorted(map(tuple, want)) and len(got) == len(ids)

    check(range(80))
    check(range(120))  # rows come
    x[5], x[90] = -x[5], x[91]
    check(range(120))  # two change
    check([i for i in range(120) if i % 3])  # some go
    check([i for i in range(120) if i % 3])
    known = catalogue.stored(spark, cache, catalogue.NEIGHBOUR)
    known = known.where(F.col("batch") == known.agg(F.max("batch")).first()[0])
    rows = frame([i for i in range(120) if i % 3] + [0]).withColumnRenamed("embedding", "v").withColumn("digest", F.md5(F.col("v").cast("string")))
    asked, new, held = catalogue.neighbour_plan(rows, known)
    assert (asked.count(), new.count(), held.count()) == (1, 1, 80)


def test_run_index_and_label_sets(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "d1", 2), ("r2", "d2", None), ("r3", "d1", 1)], "id string, dataset_id string, started_at int")
    sets = spark.createDataFrame([("d1", "First")], "id string, name string")
    replays = spark.createDataFrame([("r3",)], "run_id string")
    index = catalogue.run_index(runs, sets, replays, {"shown": "r1"}).collect()
    assert [(r.id, r.dataset, r.replay, r.showcase) for r in index] == [("r2", None, False, None), ("r3", "First", True, None), ("r1", "First", False, "shown")]
    with pytest.raises(ValueError, match="not found"):
        catalogue.run_index(runs, sets, replays, {"x": "r9"})
    (tmp_path / "set-1.json").write_text(json.dumps({"name": "set-1", "reference_run": "r1", "items": [{"review_id": 5, "stratum": "uniform"}, {"review_id": 2, "stratum": "bomb"}]}, indent=1))
    assert [tuple(r) for r in catalogue.label_set(spark, str(tmp_path), "set-1").collect()] == [(5, "uniform", 0), (2, "bomb", 1)]
    with pytest.raises(ValueError):
        catalogue.label_set(spark, str(tmp_path), "../set-1")


def test_paged_source_streams_and_resumes(spark, tmp_path):
    schema = StructType().add("id", "long").add("ts", "long")

    def fetch(cursor):
        k = 0 if cursor == "*" else int(cursor)
        if k >= 50:
            return {"rows": [], "cursor": str(k)}
        return {"rows": [{"id": 10 * k + j, "ts": 10_000 - 10 * k - j} for j in range(10)], "cursor": str(k + 1)}

    spark.dataSource.register(paged.paged_source("test_pages", fetch, schema, "ts", 9_705, wait=lambda s: None))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # the second run has nothing left to do
        q = spark.readStream.format("test_pages").load().writeStream.format("parquet").option("checkpointLocation", mark).start(out)
        q.processAllAvailable()
        q.stop()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(296))


def test_retries_and_soft_throttling():
    waits = []
    answers = iter([(429, 45.0, {}), (429, None, {}), (503, None, {}), (200, None, {"rows": [1]})])
    assert paged.retried(lambda c: next(answers), waits.append)("*") == {"rows": [1]} and waits == [45.0, 60.0, 4.0]
    with pytest.raises(paged.Unavailable):
        paged.retried(lambda c: (404, None, {}), waits.append)("*")
    with pytest.raises(paged.Unavailable):
        paged.retried(lambda c: (429, None, {}), lambda s: None)("*")
    pages, waits = iter([{"rows": [], "cursor": "a"}, {"rows": [1], "cursor": "*"}, {"rows": [1], "cursor": "b"}]), []
    assert paged.next_page(lambda c: next(pages), "*", set(), waits.append)["cursor"] == "b" and waits == [30.0, 60.0]
    assert paged.next_page(lambda c: {"rows": []}, "*", set(), lambda s: None) is None


def test_calls_are_retried_inside_tasks(spark):
    def ask(state):
        n = state["n"] = state.get("n", 0) + 1
        if state["id"] % 3 == 0:
            return 500, {}
        return 200, {"answers": {"topic": {"type": "choice", "choice": "x"}}, "usage": {"input_tokens": 9}}

    states = spark.range(6).select("id", F.to_json(F.struct("id")).alias("state"))
    rows = {r.id: r for r in AN.asked(states, ask, wait=lambda s: None, attempts=3).collect()}
    assert rows[0].status == 500 and rows[0].retries == 2 and rows[0].answers == {}
    assert rows[1].status == 200 and rows[1].retries == 0 and rows[1].tokens == 9 and json.loads(rows[1].answers["topic"])["choice"] == "x"


def test_cached_answers_are_checked(spark):
    runs = spark.createDataFrame([("a", "d", "v5", "done"), ("b", "d", "v5", "failed"), ("c", "d", "v5", "done")], "id string, dataset_id string, question_set string, status string")
    judged = spark.createDataFrame([("a", 1, "topic")], "run_id string, id long, question string").selectExpr("*", "'choice' type", "1D value", "'x' choice", "cast(null as map<string,double>) probabilities", "1D confidence")
    for args, said in ((("z", "d", "v5"), "not found"), (("b", "d", "v5"), "not done"), (("a", "e", "v5"), "another dataset"), (("a", "d", "v4"), "question set"), (("c", "d", "v5"), "no judgments")):
        with pytest.raises(ValueError, match=said):
            AN.CachedAnswers(runs, judged, *args)
    cached = AN.CachedAnswers(runs, judged, "a", "d", "v5")
    assert cached.judge(spark.range(1, 2)).first().question == "topic"
    with pytest.raises(Exception, match="no cached judgment"):
        cached.judge(spark.range(1, 3)).collect()


def test_unknown_answers_raise(spark):
    assert spark.range(1).select(AN.decoded(F.lit('{"type":"noul","noul":1,"confidence":0.3}')).alias("a")).first().a.confidence is None
    with pytest.raises(Exception, match="unknown answer type"):
        spark.range(1).select(AN.decoded(F.lit('{"type":"rank"}')).alias("a")).collect()
    with pytest.raises(KeyError):
        AN.question_set("v9")
    assert [len(AN.question_set(v)) for v in ("v1", "v2", "v3", "v4", "v5")] == [6, 6, 7, 8, 9]


def test_runs_that_do_not_line_up_raise(spark):
    clean = spark.createDataFrame([(0, 1.0, 1), (1, 0.0, 1)], "id long, rating_norm double, code int")
    both = spark.createDataFrame([(0, None, 1.0, 1), (1, "w", 0.0, 4), (2, None, 1.0, 2)], "id long, wave string, rating_norm double, code int")
    with pytest.raises(Exception, match="line up"):
        A.aligned(clean, both).collect()


def test_upsert_and_pages(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, seq int")
    assert sorted(tuple(r) for r in sinks.upsert(rows, spark.createDataFrame([(2, "c", 2)], rows.schema), ["id"], F.col("seq")).collect()) == [(1, "a", 1), (2, "c", 2)]
    none = spark.createDataFrame([], "id long, text string, rating_norm double, action string, reasons array<string>, score double")
    assert I.page(none.where(I.ReviewFilter("keep", "spam", "negative", "x").condition())).count() == 0
    assert SU.trail(spark.createDataFrame([], SU.EVENT)).count() == 0


def test_strata_never_share_a_row(spark):
    rows = spark.range(40)
    drawn = L.filled(rows, {"a": (10, F.col("id") < 15), "b": (10, F.col("id") < 18), "c": (99, F.lit(True))}).collect()
    assert len(drawn) == len({r.id for r in drawn}) == 40
    assert sum(r.stratum == "a" for r in drawn) == 10 and sum(r.stratum == "b" for r in drawn) == 8


def test_exported_runs_hold_no_contacts(spark, tmp_path):
    path = str(tmp_path / "run")
    reviews = spark.createDataFrame([(k, f"mail me at a{k}@b.com or @someone{k}", 1.0, "author") for k in range(25)], "id long, text string, rating_norm double, author_hash string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    decisions = reviews.where("id > 3").select("id", F.lit("KEEP").alias("action"), F.lit(1).alias("code"), F.lit(1.0).alias("weight"), F.lit(0.5).alias("score"), F.array(F.lit("SPAM")).alias("reasons"))
    clusters = spark.createDataFrame([(1, "burst", "see c@d.org")], "cluster_id long, kind string, caption string")
    sinks.export_run(reviews, decisions, clusters, reviews.select(F.lit(1).alias("cluster_id"), "id"), path, 10)
    assert sinks.leaks(spark, path).count() == 0
    rows = spark.read.json(f"{path}/reviews")
    assert rows.count() == 25 and "author_hash" not in rows.columns and {r.chunk for r in rows.collect()} == {0, 1, 2}
    assert spark.read.json(f"{path}/clusters").first().members == 25
    assert sorted(r.code for r in spark.read.json(f"{path}/scores").collect())[:5] == [0, 0, 0, 0, 1]


def test_ranks_over_ranges(spark):
    from plumbline.operators.evaluate import average_ranks

    rows = [(float(k * 7919 % 503), k) for k in range(2000)] + [(1.0, -1)] * 5
    got = {r.k: r.rank for r in average_ranks(spark.createDataFrame(rows, "v double, k long"), "v", "rank", 8).collect() if r.k >= 0}
    order = sorted(v for v, _ in rows)
    mean = {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(order)}
    assert all(got[k] == mean[v] for v, k in rows if k >= 0)
