"""Catalogues beside the reviews: datasets, runs, label sets, cached vectors and neighbours."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.operators.clusters import embed, hash_embedder, nearest_of
from plumbline.plans.tables import cut
from plumbline.sources.reviews import chronological, daily_sample, keep_first
from plumbline.sources.sinks import store_reviews

DATASET = "id string, name string, source string, rating_scale string, n_reviews long, status string, at timestamp"
VECTOR = "digest string, encoder string, embedding array<float>"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table at ``path``, empty where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def record_dataset(spark: SparkSession, path: str, id_: str, name: str, source: str, scale: str, n_reviews: int, status: str = "ready") -> None:
    """Appends a dataset's entry; a later entry of the same id replaces it for readers."""
    row = spark.createDataFrame([(id_, name, source, scale, n_reviews, status)], DATASET.rsplit(",", 1)[0])
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def set_status(spark: SparkSession, path: str, id_: str, status: str) -> None:
    """Appends the dataset's latest entry with another status; an unknown id raises."""
    row = datasets(spark, path).where(F.col("id") == id_).withColumns({"status": F.lit(status), "at": F.current_timestamp()})
    if row.isEmpty():
        raise KeyError(id_)
    spark.createDataFrame(row.drop("at").collect(), DATASET.rsplit(",", 1)[0]).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)  # one row


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each dataset."""
    rows = stored(spark, path, DATASET)
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "at").alias("r")).select("id", "r.*")


def pulled(spark: SparkSession, path: str, key: str = "ext_id", time: str = "created_at") -> DataFrame:
    """All parts of a pull: the first row of each key by part and time, numbered in time order."""
    rows = spark.read.parquet(path).withColumns({"_part": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return chronological(keep_first(rows, key, "_part", "_row").drop("_part", "_row"), time, key)


def import_pull(spark: SparkSession, pull: str, reviews: str, catalogue: str, dataset: str, name: str, share: float = 1.0, seed: int = 7) -> None:
    """A dataset from a pull: deduplicated, sampled by day, stored, and entered into the catalogue."""
    rows = pulled(spark, pull).drop("id")
    if share < 1:
        rows = daily_sample(rows, "created_at", "ext_id", share, seed)
    store_reviews(rows, reviews, dataset)
    n = spark.read.parquet(reviews).where(F.col("dataset_id") == dataset).count()
    record_dataset(spark, catalogue, dataset, name, "pull", "binary", n)


def listed(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Runs for a list: those not started first, then the latest, ties by id."""
    return runs.orderBy(F.desc_nulls_first("started_at"), "id").limit(limit)


def run_index(runs: DataFrame, datasets_: DataFrame, replays: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Every run with its dataset's name, whether a replay is there, and the label it is shown under.

    ``labels``: label to run id; a label whose run is missing raises.
    """
    spark = runs.sparkSession
    names = spark.createDataFrame([(v, k) for k, v in labels.items()], "id string, showcase string")
    missing = [r.showcase for r in names.join(runs.select(F.col("id").cast("string").alias("id")), "id", "left_anti").collect()]
    if missing:
        raise ValueError(f"runs not found: {sorted(missing)}")
    has = replays.select("run_id").distinct().withColumn("replay", F.lit(True))
    out = runs.join(datasets_.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset")), "dataset_id", "left").join(has, F.col("id") == F.col("run_id"), "left").drop("run_id")
    shown = out.join(F.broadcast(names.withColumnRenamed("id", "_id")), F.col("id").cast("string") == F.col("_id"), "left").drop("_id")
    return shown.withColumn("replay", F.coalesce("replay", F.lit(False))).orderBy(F.asc_nulls_first("started_at"), "id")


def label_set(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(review_id, stratum, position) of a label set's JSON file; names are letters, digits, hyphens and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not a name of a label set: {name!r}")
    items = spark.read.schema("name string, reference_run string, items array<struct<review_id: bigint, stratum: string>>").option("multiLine", True).json(f"{folder}/{name}.json")
    return items.select(F.posexplode("items").alias("position", "i")).select("i.review_id", "i.stratum", "position")


def embed_cached(df: DataFrame, cache: str, encoder: str, encode: Callable[[list[str]], np.ndarray] = hash_embedder, text_col: str = "text") -> tuple[DataFrame, bool]:
    """``df`` with ``embedding`` from a cache by text digest and encoder, and whether every text was there before.

    Only distinct texts that are missing are encoded; they are appended to the cache.
    """
    spark, digest = df.sparkSession, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    known = stored(spark, cache, VECTOR).where(F.col("encoder") == encoder)
    texts = df.select(digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    missing = texts.join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    hit = missing.isEmpty()
    if not hit:
        embed(missing, encode, "text").select("digest", F.lit(encoder).alias("encoder"), "embedding").write.mode("append").parquet(cache)
    vectors = spark.read.schema(VECTOR).parquet(cache).where(F.col("encoder") == encoder).dropDuplicates(["digest"]).select("digest", "embedding")
    return df.withColumn("digest", digest).join(vectors, "digest").drop("digest"), hit


NEIGHBOUR = "id long, digest string, neighbour long, cosine double, batch long"


def neighbour_plan(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, v, digest) rows and a stored table: those to search for against all, those new, and those whose stored neighbour holds.

    A row is searched for against all where it is new or changed, or where its
    neighbour is gone or changed; all others need only be compared with the new.
    """
    now = rows.select("id", "digest")
    same = known.join(now, ["id", "digest"])
    new = rows.join(same.select("id"), "id", "left_anti")
    held = cut(same.join(same.select(F.col("id").alias("neighbour")), "neighbour", "left_semi").select("id", "neighbour", "cosine"))
    return rows.join(held.select("id"), "id", "left_anti"), new, held


def nearest_cached(vectors: DataFrame, cache: str, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Nearest neighbours (id, neighbour, cosine) of all rows, from a stored table that is kept up to date.

    The table holds a digest of each row's vector. New and changed rows, and rows
    whose neighbour is gone or changed, are searched for against all rows; all
    others only against the new ones, and keep the better of that and what is
    stored. Each update is a batch of its own; readers take the latest. Ids are unique.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL").withColumn("digest", F.md5(F.col("v").cast("string"))))
    stored_ = stored(spark, cache, NEIGHBOUR)
    last = stored_.agg(F.max("batch")).first()[0]
    asked, new, held = neighbour_plan(rows, stored_.where(F.col("batch") == F.lit(last)) if last is not None else stored_.limit(0))
    new = cut(new)
    found = nearest_of(asked, rows)
    if last is not None and not held.isEmpty():
        better = held if new.isEmpty() else held.union(nearest_of(rows.join(held.select("id"), "id", "left_semi"), new))
        best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), "neighbour", "cosine"))
        found = found.union(better.groupBy("id").agg(best.alias("b")).select("id", "b.neighbour", "b.cosine"))
    written = rows.select("id", "digest").join(found, "id", "left").withColumn("batch", F.lit(0 if last is None else last + 1).cast("long"))
    written.write.mode("append").parquet(cache)
    latest = spark.read.schema(NEIGHBOUR).parquet(cache).where(F.col("batch") == F.lit(0 if last is None else last + 1))
    return latest.where("neighbour IS NOT NULL").select("id", "neighbour", "cosine")
