"""Datasets, runs and labels in one folder of tables, and the questions that are asked of them."""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.operators import answers as AN
from plumbline.operators import drilldown as I
from plumbline.operators import labelsets as L
from plumbline.operators import summary as SU
from plumbline.plans import run as RUN
from plumbline.sources import catalogue, readers, sinks

TABLES = ("features", "clusters", "members", "decisions", "interval", "platform")
RUN_ROW = "id string, dataset_id string, backend string, question_set string, status string, config string, cost double, elapsed_s double, at timestamp"
CALLS = "run_id string, requests long, retries long, latency_p50_ms double, latency_p95_ms double, tokens long, cost double"
LABEL = "name string, rater string, id long, key string, label string, at timestamp"


class Store:
    """Tables under ``root``: reviews by dataset, a run's tables by run, and catalogues that only grow."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # datasets

    def add_dataset(self, reviews: DataFrame, id_: str, name: str, source: str = "upload", scale: str = "binary") -> None:
        """Stores reviews, numbered in time order, and enters them into the catalogue."""
        sinks.store_reviews(reviews, self._path("reviews"), id_)
        catalogue.record_dataset(self.spark, self._path("datasets"), id_, name, source, scale, self.reviews(id_).count())

    def datasets(self) -> DataFrame:
        return catalogue.datasets(self.spark, self._path("datasets")).orderBy("name", "id")

    def dataset(self, id_: str) -> DataFrame:
        """One row; an unknown id raises."""
        row = self.datasets().where(F.col("id") == id_)
        if row.isEmpty():
            raise KeyError(id_)
        return row

    def reviews(self, dataset: str) -> DataFrame:
        return self.spark.read.parquet(self._path("reviews")).where(F.col("dataset_id") == dataset)

    def hours(self, dataset: str) -> DataFrame:
        """(bucket, hour, first_id, n) of the hours that hold reviews."""
        return I.hour_buckets(self.reviews(dataset))

    @staticmethod
    def limits() -> dict:
        return asdict(readers.Limits())

    # runs

    def run(self, dataset: str, cfg: Config = Config(), answers: DataFrame | None = None, vectors: DataFrame | None = None, semantic: DataFrame | None = None, question_set: str = "v5", cost: float = 0.0, calls: DataFrame | None = None, price: float = 1.0) -> str:
        """Analyses a dataset and stores all tables of the run under a new id; ``calls``: those of a service (latency_ms, retries, tokens)."""
        self.dataset(dataset)
        id_, began = uuid.uuid4().hex[:12], time.time()
        result = RUN.analyse(self.reviews(dataset), cfg, answers, vectors, semantic)
        for name in TABLES:
            sinks.store_run(getattr(result, name), self._path(name), id_)
        if answers is not None:
            sinks.store_run(answers, self._path("judgments"), id_)
        if calls is not None:
            sinks.store_run(AN.call_summary(calls, price), self._path("calls"), id_)
        backend = "heuristic" if answers is None else "model"
        row = self.spark.createDataFrame([(id_, dataset, backend, question_set, "done", repr(cfg), cost, round(time.time() - began, 3))], RUN_ROW.rsplit(",", 1)[0])
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self._path("runs"))
        return id_

    def runs(self, limit: int = 100) -> DataFrame:
        rows = catalogue.stored(self.spark, self._path("runs"), RUN_ROW)
        return catalogue.listed(rows.withColumn("started_at", F.col("at")), limit).drop("started_at")

    def table(self, name: str, run: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name)).where(F.col("run_id") == run)

    def _dataset_of(self, run: str) -> str:
        rows = catalogue.stored(self.spark, self._path("runs"), RUN_ROW).where(F.col("id") == run).take(1)
        if not rows:
            raise KeyError(run)
        return rows[0].dataset_id

    def _decisions(self, run: str) -> DataFrame:
        return self.table("decisions", run).withColumn("score", F.col("integrity_score")).drop("run_id", "rating_norm", "created_at")

    def summary(self, run: str) -> DataFrame:
        """The run's summary as one row."""
        row = catalogue.stored(self.spark, self._path("runs"), RUN_ROW).where(F.col("id") == run).first()
        clusters = SU.cluster_counts(self.table("clusters", run))
        calls = catalogue.stored(self.spark, self._path("calls"), CALLS).where(F.col("run_id") == run)
        return SU.run_summary(self.table("decisions", run), self.table("interval", run), clusters, self.table("platform", run), None if calls.isEmpty() else calls, row.elapsed_s)

    def grid(self, run: str) -> DataFrame:
        """(id, code) of every review of the run's dataset."""
        return sinks.grid(self.reviews(self._dataset_of(run)), self.table("decisions", run))

    def review_page(self, run: str, f: I.ReviewFilter = I.ReviewFilter(), sort: str = "time", limit: int = 50, offset: int = 0) -> DataFrame:
        reviews = self.reviews(self._dataset_of(run)).select("id", "text", "rating_norm", "created_at")
        return I.page(I.matching(reviews, self._decisions(run), self.table("members", run), f), sort, limit, offset)

    def details(self, run: str) -> DataFrame:
        """All reviews with all that is known of them; filter by ``id`` for one."""
        reviews = self.reviews(self._dataset_of(run)).select("id", "text", "rating_raw", "rating_norm", "created_at", "updated_at", "meta")
        features = self.table("features", run).select("id", "n_tokens", "dup_of", "dup_score")
        return I.details(reviews, self._decisions(run), features, self.table("clusters", run))

    def clusters(self, run: str, kind: str | None = None, limit: int = 100) -> DataFrame:
        return I.cluster_list(self.table("clusters", run), kind, limit)

    def cluster(self, run: str, cluster: int, sample: int = 10) -> dict[str, DataFrame]:
        """One cluster: its row, its members by hour, their actions, and some of them."""
        members, reviews = self.table("members", run).where(F.col("cluster_id") == cluster).drop("run_id", "kind"), self.reviews(self._dataset_of(run))
        decisions = self._decisions(run).drop("cluster_id")
        return {
            "cluster": self.table("clusters", run).where(F.col("cluster_id") == cluster),
            "hours": I.histogram(members, reviews),
            "actions": members.join(decisions, "id").groupBy("action").agg(F.count("*").alias("n")),
            "sample": I.cluster_sample(members, reviews.select("id", "text", "rating_norm", "created_at"), decisions, sample),
        }

    def export(self, run: str, path: str) -> None:
        """The run as static files without authors or outside ids."""
        sinks.export_run(self.reviews(self._dataset_of(run)), self._decisions(run), self.table("clusters", run).drop("run_id"), self.table("members", run).select("cluster_id", "id"), path)

    # labels

    def add_labels(self, labels: DataFrame) -> None:
        """Labels (name, rater, id, key, label); a later one of the same rater, review and key replaces an earlier one."""
        labels.select("name", "rater", "id", "key", "label").withColumn("at", F.current_timestamp()).write.mode("append").parquet(self._path("labels"))

    def labels(self, name: str) -> DataFrame:
        rows = catalogue.stored(self.spark, self._path("labels"), LABEL).where(F.col("name") == name)
        return rows.groupBy("name", "rater", "id", "key").agg(F.max_by("label", "at").alias("label"))

    def labels_per_rater(self, name: str) -> DataFrame:
        return L.per_rater(self.labels(name).withColumnRenamed("name", "set"))
