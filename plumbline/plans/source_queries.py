"""Queries that write tables into the shared folder and read them again: files, sinks, logs, caches, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import deflated, public_scrub
from plumbline.plans import sql as S
from plumbline.plans.corpus_queries import NEAREST, rated_events, shown
from plumbline.plans.decision_queries import judged
from plumbline.plans.inspect_queries import ACTION, DECIDED, clusters_of, members_of
from plumbline.plans.tables import scratch
from plumbline.registry import query
from plumbline.sources import catalogue, readers, sinks
from plumbline.sources import reviews as R
from plumbline.streaming import live


@query("SELECT event_id AS ext_id, (floor(least(value, 99.0) / 20)) / 4 AS rating_norm, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, sha256('pepper' || user_id) AS author_hash, 'line ' || event_id || chr(10) || 'two, \"quoted\"' AS text FROM events")
def mapped_csv(spark, sf_dir):
    """Reviews from a CSV file with quoted line breaks: types inferred, columns mapped, ratings scaled, authors hashed."""
    e = R.read(spark, sf_dir, "events")
    made = e.select(F.concat(F.lit("line "), "event_id", F.lit('\ntwo, "quoted"')).alias("body"), (1 + F.floor(F.least("value", F.lit(99.0)) / 20)).alias("stars"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("when"), F.col("user_id").alias("user"), F.col("event_id").alias("key"))
    path = scratch(spark, "csv")
    made.write.options(header=True, escape='"', quoteAll=True).csv(path)
    rows, _ = R.mapped(R.read_csv(spark, path), R.Mapping("body", "stars", "when", "user", "key"), "pepper")
    return rows.select(F.col("ext_id").cast("long").alias("ext_id"), "rating_norm", shown("created_at"), "author_hash", "text")


@query("SELECT row_number() OVER (PARTITION BY event_id % 2 ORDER BY ts, CAST(event_id AS VARCHAR)) - 1 AS id, CAST(event_id AS VARCHAR) AS ext_id, 'd' || event_id % 2 AS dataset_id, CAST(NULL AS VARCHAR) AS lang FROM events")
def stored_reviews(spark, sf_dir):
    """Two datasets in one table, numbered in time order; columns that a source lacks are null."""
    path = scratch(spark, "reviews")
    e = R.read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ext_id"), F.col("ts").alias("created_at"), "event_id")
    for k in (0, 1):
        sinks.store_reviews(e.where(F.col("event_id") % 2 == k).drop("event_id"), path, f"d{k}")
    return spark.read.parquet(path).select("id", "ext_id", "dataset_id", "lang")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS run_id, count(*) AS n, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS version FROM events GROUP BY 1")
def stored_runs(spark, sf_dir):
    """A run that is stored again replaces its own rows only."""
    path, e = scratch(spark, "runs"), R.read(spark, sf_dir, "events").select("event_id")
    sinks.store_run(e.where("event_id % 3 = 0").withColumn("version", F.lit(1)), path, "a")
    sinks.store_run(e.where("event_id % 3 <> 0").withColumn("version", F.lit(1)), path, "b")
    sinks.store_run(e.where("event_id % 3 = 0").withColumn("version", F.lit(2)), path, "a")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("version").alias("version"))


@query("SELECT round(epoch_us(ts) / 1e6, 3) AS t, event_type AS type, '{\"id\":' || event_id || '}' AS body FROM events")
def replayed_log(spark, sf_dir):
    """A run's events from compressed JSON lines, in the order of their offsets."""
    path = scratch(spark, "log")
    e = R.read(spark, sf_dir, "events")
    sinks.write_events(e.select(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("t"), F.col("event_type").alias("type"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("body")), path)
    return sinks.replay(spark, path)


@query(DECIDED + f"SELECT id // 1000 AS chunk, count(*) AS n, count(DISTINCT id) AS ids, count(*) FILTER ({ACTION} = 'KEEP') AS keep FROM decided GROUP BY 1")
def exported_chunks(spark, sf_dir):
    """A finished run as files of a thousand reviews each."""
    rows, path = judged(spark, sf_dir, each={"scrubbed": deflated(public_scrub(F.col("text")))}), scratch(spark, "bundle")
    sinks.export_run(rows, rows, clusters_of(rows).withColumn("caption", F.lit("")), members_of(rows), path)
    found = spark.read.json(f"{path}/reviews")
    return found.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("action") == "KEEP").alias("keep"))


LEAKS = r"[\w.+-]+@[\w-]+\.[\w.-]+|\b7656119\d{10}\b|steamcommunity\.com/(?:id|profiles)/"


@query(f"SELECT found, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '[\\r\\n]', ' ', 'g'), {S.quoted('(?i)' + LEAKS)})) AS found FROM documents) GROUP BY 1")
def leaked_contacts(spark, sf_dir):
    """Contacts that a check of exported files finds in raw texts."""
    path = scratch(spark, "leaks")
    R.read(spark, sf_dir, "documents").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value")).where("value IS NOT NULL").write.text(path)
    return sinks.leaks(spark, path).select(F.explode("found").alias("found")).groupBy("found").agg(F.count("*").alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS ext_id, sha256('salt' || 'u' || user_id) AS author_hash, CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END AS rating_norm, strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS lang, user_id % 4 AS n_reviews FROM events")
def pulled_records(spark, sf_dir):
    """Reviews from JSON records of a pull; authors are hashed at the boundary."""
    e = R.read(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    author = F.struct(F.concat(F.lit("u"), "user_id").alias("steamid"), (F.col("user_id") % 4).cast("int").alias("num_reviews"), F.lit(5).alias("playtime_at_review"))
    names = F.when(F.col("event_id") % 3 == 0, "english").when(F.col("event_id") % 3 == 1, "german").otherwise("klingon")
    raw = e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("recommendationid"), author.alias("author"), F.lit("<b>fine</b>").alias("review"), seconds.alias("timestamp_created"), seconds.alias("timestamp_updated"), (F.col("event_type") == "purchase").alias("voted_up"), names.alias("language"))).alias("value"))
    rows = readers.records_to_reviews(raw, "salt")
    return rows.select("ext_id", "author_hash", "rating_norm", shown("created_at"), "lang", F.get_json_object("meta", "$.author_num_reviews").cast("long").alias("n_reviews"))


@query("SELECT CAST(event_id % 4000 AS VARCHAR) AS ext_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at FROM events GROUP BY 1")
def pulled_parts(spark, sf_dir):
    """Parts of a pull with repeated keys: the first part's rows win."""
    path = scratch(spark, "pull")
    e = R.read(spark, sf_dir, "events").select((F.col("event_id") % 4000).cast("string").alias("ext_id"), F.col("ts").alias("created_at"), "event_id")
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").drop("event_id").write.parquet(path)  # parts are named in the order of their ranges
    return catalogue.pulled(spark, path).select("ext_id", shown("created_at"))


@query("SELECT count(*) AS rows, count(DISTINCT coalesce(text, '')) AS stored, true AS hit FROM documents")
def cached_embeddings(spark, sf_dir):
    """Embedded twice: the second time all texts are there, stored once each."""
    path = scratch(spark, "vectors")
    docs = R.read(spark, sf_dir, "documents").select("doc_id", "text")
    catalogue.embed_cached(docs, path, "words")
    again, hit = catalogue.embed_cached(docs, path, "words")
    return again.agg(F.count("*").alias("rows")).crossJoin(spark.read.parquet(path).agg(F.count("*").alias("stored"))).withColumn("hit", F.lit(hit))


@query(NEAREST)
def updated_neighbours(spark, sf_dir):
    """Neighbours from a stored table that was made of the first four fifths of the rows by id, then brought up to all."""
    path = scratch(spark, "neighbours")
    vectors = R.read(spark, sf_dir, "embeddings")
    n = vectors.agg(F.percentile_approx("vec_id", 0.8)).first()[0]
    catalogue.nearest_cached(vectors.where(F.col("vec_id") <= F.lit(n)), path, "vec_id")
    return catalogue.nearest_cached(vectors, path, "vec_id").select("id", "neighbour", F.round("cosine", 6).alias("cosine"))


@query("SELECT doc_id AS review_id, CASE WHEN doc_id % 3 = 0 THEN 'bomb' ELSE 'uniform' END AS stratum FROM documents WHERE doc_id % 4 = 0")
def label_set_file(spark, sf_dir):
    """A label set from its JSON file."""
    folder = scratch(spark, "labelsets")
    items = R.read(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.struct(F.col("doc_id").alias("review_id"), F.when(F.col("doc_id") % 3 == 0, "bomb").otherwise("uniform").alias("stratum")).alias("i"))
    items.agg(F.collect_list("i").alias("items")).select(F.lit("set-1").alias("name"), F.lit("r1").alias("reference_run"), "items").coalesce(1).write.json(f"{folder}/set-1.json")  # a set for people
    return catalogue.label_set(spark, folder, "set-1").select("review_id", "stratum")


@query("SELECT 'run' || o_custkey AS id, 'Dataset ' || o_custkey % 3 AS dataset, bool_or(o_orderkey % 7 = 0) AS replay, CASE WHEN o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_custkey % 1000 = 1) THEN 'first' END AS showcase FROM orders GROUP BY o_custkey")
def run_index(spark, sf_dir):
    """Runs with their dataset's name, whether they can be replayed, and what they are shown as."""
    o = R.read(spark, sf_dir, "orders")
    name = F.concat(F.lit("run"), "o_custkey")
    runs = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("started_at")).select(name.alias("id"), (F.col("o_custkey") % 3).cast("string").alias("dataset_id"), "started_at")
    sets = spark.range(3).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Dataset "), "id").alias("name"))
    first = o.where("o_custkey % 1000 = 1").agg(F.min("o_custkey")).first()[0]
    labels = {"first": f"run{first}"} if first is not None else {}
    return catalogue.run_index(runs, sets, o.where("o_orderkey % 7 = 0").select(name.alias("run_id")), labels).select("id", "dataset", "replay", "showcase")


@query("WITH h AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' ELSE 'negative' END AS verdict, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT verdict, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def streamed_hours(spark, sf_dir):
    """Hourly counts of a stream with a watermark: hours that the watermark has not passed stay open."""
    source, out, mark = (scratch(spark, n) for n in ("stream", "hours", "mark"))
    rated_events(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = live.hourly_counts(stream).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out).select("verdict", shown("hour"), "n")


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS action FROM events GROUP BY user_id")
def streamed_updates(spark, sf_dir):
    """The last update of each key, from micro-batches that are merged into a table."""
    source, out, mark = (scratch(spark, n) for n in ("updates", "table", "mark"))
    R.read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("action")).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)

    def merge(batch, number):
        newest = batch.groupBy("id").agg(F.max_by(F.struct("seq", "action"), "seq").alias("u")).select("id", "u.*")
        newest.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return live.last_write(spark.read.parquet(out).drop("batch"))
