"""A dataset, a run over it, and the questions asked of both."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.drilldown import ReviewFilter
from plumbline.sources import sinks
from plumbline.store import Store


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    hours = [(h, 3) for h in range(200)] + [(150, 60)]
    rows, k = [], 0
    for h, n in hours:
        for j in range(n):
            text = "Bad bad update, do not buy this broken thing ever again" if n == 60 else ("free steam keys here" if k % 50 == 7 else f"I played it for {k} hours and the story number {k * 7} is fun")
            rows.append((f"e{k}", text, 0.0 if n == 60 or j == 0 else 1.0, h * 3600 + j * 60, f"u{k % 9}"))
            k += 1
    df = spark.createDataFrame(rows, "ext_id string, text string, rating_norm double, s long, author_hash string")
    reviews = df.select("ext_id", "author_hash", "text", F.col("rating_norm").alias("rating_raw"), "rating_norm", F.timestamp_seconds("s").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"), F.lit('{"author_playtime_at_review": 90}').alias("meta"))
    store.add_dataset(reviews, "d1", "Planted")
    return store, store.run("d1"), len(rows)


def test_datasets(stored):
    store, _, n = stored
    assert [(r.id, r.n_reviews, r.status) for r in store.datasets().collect()] == [("d1", n, "ready")]
    assert store.hours("d1").count() == 200 and store.limits()["rows"] > 0
    with pytest.raises(KeyError):
        store.dataset("d9")


def test_run_and_pages(stored):
    store, run, n = stored
    assert [r.id for r in store.runs().collect()] == [run]
    summary = store.summary(run).first()
    assert summary.n_reviews == n and summary.adjusted > summary.raw
    assert summary.ci_low <= summary.adjusted <= summary.ci_high
    assert summary.counted == n and summary.platform_rating is not None and summary.platform_label and summary.requests is None
    assert summary.elapsed_s > 0 and summary.reviews_per_s > 0
    assert store.grid(run).where("code > 0").count() == n
    page = store.review_page(run, ReviewFilter(reason="spam"), limit=5).collect()
    assert len(page) == 5 and page[0].total > 5 and all("free" in r.snippet for r in page)
    first = store.details(run).where("id = 0").first()
    assert first.playtime_hours == 1.5 and first.edited is False and first.action
    with pytest.raises(KeyError):
        store.review_page("nothing")


def test_clusters_and_export(stored, spark, tmp_path):
    store, run, n = stored
    clusters = store.clusters(run).collect()
    assert {"burst", "duplicate"} <= {c.kind for c in clusters}
    worst = store.cluster(run, clusters[0].cluster_id)
    assert worst["cluster"].count() == 1 and 0 < worst["sample"].count() <= 10
    assert worst["hours"].agg(F.sum("n")).first()[0] == worst["actions"].agg(F.sum("n")).first()[0] == clusters[0].size
    member = ReviewFilter(cluster=clusters[0].cluster_id)
    assert store.review_page(run, member).first().total == clusters[0].size
    store.export(run, str(tmp_path / "out"))
    assert sinks.leaks(spark, str(tmp_path / "out")).count() == 0
    assert spark.read.json(str(tmp_path / "out" / "scores")).count() == n


def test_labels_are_replaced(stored, spark):
    store, _, _ = stored
    assert store.labels("s").count() == 0
    store.add_labels(spark.createDataFrame([("s", "r1", 1, "spam", "yes"), ("s", "r1", 2, "spam", "no")], "name string, rater string, id long, key string, label string"))
    store.add_labels(spark.createDataFrame([("s", "r1", 1, "spam", "no")], "name string, rater string, id long, key string, label string"))
    assert {(r.id, r.label) for r in store.labels("s").collect()} == {(1, "no"), (2, "no")}
    assert store.labels_per_rater("s").first().n == 2


def test_command_line(spark, tmp_path):
    from plumbline.__main__ import main
    from plumbline.config import Backend, Config, overridden

    lines = ["body,stars,day,who"] + [f'"review {k} says, it is {k % 3} times fun to play with friends",{k % 2},2024-04-{1 + k % 28:02d}T10:00:00Z,u{k % 5}' for k in range(400)]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    root = ["--store", str(tmp_path / "store")]
    row = main([*root, "import", "--path", str(tmp_path / "in.csv"), "--dataset", "d", "--text", "body", "--rating", "stars", "--timestamp", "day", "--author", "who"], spark)[0]
    assert row["n_reviews"] == 400 and row["rating_scale"] == "binary"
    clean = main([*root, "run", "d"], spark)[0]
    assert main([*root, "inject", "d", "e"], spark)[0]["n_reviews"] == 400 + 690
    hit = main([*root, "run", "e", "--set", "weights.downweight=0.1"], spark)[0]
    pull = main([*root, "pull", clean["run"], hit["run"]], spark)[0]
    assert pull["raw_shift"] < 0 and pull["pull_removed"] is not None
    main([*root, "export", hit["run"], str(tmp_path / "out")], spark)
    assert {(r["id"], r["kind"]) for r in main([*root, "list"], spark)} == {("d", "dataset"), ("e", "dataset"), (clean["run"], "run"), (hit["run"], "run")}
    with pytest.raises(KeyError):
        overridden(Config(), {"policy.nothing": 1})
    assert overridden(Config(), {"seed": 3, "bursts.z": 2.0}).bursts.z == 2.0
    assert Backend("own", "http://localhost", "m", concurrency=8, local=True).at_once == 2 and Backend("x", "u", "m", 2.0).cost(500_000) == 1.0
