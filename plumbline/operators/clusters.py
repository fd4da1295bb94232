"""Embeddings, neighbours, clusters, phrases and suspicion."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.config import Suspicion
from plumbline.functions.patterns import STOP_WORDS
from plumbline.operators.blocks import against
from plumbline.operators.duplicates import components
from plumbline.plans.tables import cut, landed

WIDTH = 64
#: Ranks of a random order that meet the sizes of subsets together.
RANK_CELL = 1024
#: Terms of a cluster that are scored first, about.
LEADING = 64
#: Terms that a task counts before it passes them on; what a word is, as in the engine's expressions.
TERMS_HELD = 500_000
WORDS = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]+").findall
#: Vectors of a block, and of a block at once in a product.
BLOCK_ROWS, SLICE_ROWS = 8192, 1024
#: Characters of texts that are encoded at once.
CHARS_AT_ONCE = 1_000_000


def hash_embedder(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """Unit bag-of-words vectors: a word counts at its md5's first four bytes modulo ``width``."""
    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "little") % width] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def text_slices(column: pa.Array, chars: int = CHARS_AT_ONCE) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts with about ``chars`` characters each, a longer text alone; nothing is copied."""
    at, held = 0, 0
    for k, n in enumerate(pc.utf8_length(column).fill_null(0).to_pylist()):
        if held and held + n + 1 > chars:
            yield column.slice(at, k - at)
            at, held = k, 0
        held += n + 1
    if held:
        yield column.slice(at)


def embed(df: DataFrame, encode: Callable[[list[str]], np.ndarray] = hash_embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with a unit vector from any encoder of texts to rows; of a batch's texts some are taken from Arrow at a time."""

    @F.arrow_udf("array<float>")
    def vector(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [np.asarray(encode([x or "" for x in part.to_pylist()]), np.float32) for part in text_slices(column)]
            x = np.concatenate(found) if found else np.zeros((0, 0), np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return df.withColumn(out, vector(F.col(text_col)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def vector_classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of each row and (rep, v) of each distinct vector; ``rep`` is the smallest id that has it."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    reps = cut(rows.groupBy("v").agg(F.min("id").alias("rep")).select("rep", "v"))
    return rows.join(reps, "v").select("id", "rep"), reps


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of a graph: each node that isn't the smallest of its component, and that smallest."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = inverse[: len(a)], inverse[len(a) :], np.arange(len(ids))
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nearer := label[label], label):
            label = nearer
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def block_pairs(reps: DataFrame, blocks: int | None, compare: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, both_ways: bool) -> DataFrame:
    """``compare`` (ids, vectors, ids, vectors) over all pairs of blocks of (rep, v), each pair in one task.

    Without ``blocks`` there are as many as make ``BLOCK_ROWS`` rows each. A task
    holds the first block of a pair, packed, and reads the second in slices.
    """
    blocks = blocks or max(1, -(-reps.count() // BLOCK_ROWS))
    dealt = reps.withColumn("blk", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    held = dealt.select(F.col("blk").alias("i"), F.explode(every if both_ways else F.sequence(F.col("blk"), F.lit(blocks - 1))).alias("j"), F.lit(0).alias("side"), "rep", "v")
    passed = dealt.select(F.col("blk").alias("j"), F.explode(every if both_ways else F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.lit(1).alias("side"), "rep", "v")
    sides = held.unionByName(passed).repartition("i", "j").sortWithinPartitions("i", "j", "side", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, ids, vectors = None, [], []
        for batch in batches:
            for (i, j, side), part in batch.groupby(["i", "j", "side"], sort=True):
                if (i, j) != pair:
                    pair, ids, vectors = (i, j), [], []
                r, v = part["rep"].to_numpy(), np.stack(part["v"].to_numpy())
                if side == 0:
                    ids.append(r)
                    vectors.append(v)
                elif ids:
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for at in range(0, len(r), SLICE_ROWS):
                        yield compare(ids[0], vectors[0], r[at : at + SLICE_ROWS], v[at : at + SLICE_ROWS].astype(float))

    return sides.mapInPandas(run, schema)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int | None = None) -> DataFrame:
    """(id, neighbour, cosine): exact nearest other row of each row, ties to the smaller id.

    Equal vectors are searched for once, with their two smallest ids as
    candidates. Exact search is quadratic in the distinct vectors by nature.
    """
    rows, reps = vector_classes(df, id_col, vec_col)

    def product(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        best, who = np.full(len(y), -np.inf), np.zeros(len(y), np.int64)
        for at in range(0, len(ids), SLICE_ROWS):
            s = np.round(y @ x[at : at + SLICE_ROWS].astype(float).T, 12)
            s[others[:, None] == ids[None, at : at + SLICE_ROWS]] = -np.inf
            k = s.argmax(axis=1)
            value = s[np.arange(len(y)), k]
            better = value > best
            best[better], who[better] = value[better], ids[at : at + SLICE_ROWS][k[better]]
        return pd.DataFrame({"rep": others, "other": who, "cosine": best}).query("cosine > -inf")

    met = block_pairs(reps, blocks, product, "rep long, other long, cosine double", True)
    between = met.select("rep", F.struct((-F.round("cosine", 9)).alias("c"), "other", "cosine").alias("b")).groupBy("rep").agg(F.min("b").alias("b"))
    second = rows.where("id <> rep").groupBy("rep").agg(F.min("id").alias("twin"))
    own = reps.join(second, "rep").select("rep", "twin", dot(F.col("v"), F.col("v")).alias("square"))
    joined = rows.join(between, "rep", "left").join(own, "rep", "left")
    twin = F.when(F.col("twin").isNotNull(), F.struct((-F.round("square", 9)).alias("c"), F.when(F.col("id") == F.col("rep"), F.col("twin")).otherwise(F.col("rep")).alias("other"), F.col("square").alias("cosine")))
    found = joined.select("id", F.when(F.col("b").isNull(), twin).when(twin.isNull(), F.col("b")).otherwise(F.least("b", twin)).alias("b")).where("b IS NOT NULL")
    return found.select("id", F.col("b.other").alias("neighbour"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "b.cosine")).alias("cosine"))


def nearest_of(queries: DataFrame, rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(id, neighbour, cosine): for each of (id, v) queries the nearest of (id, v) rows but itself, ties to the smaller id.

    Its work is queries by rows, in blocks.
    """

    def compare(asked: pd.DataFrame, y: np.ndarray, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        ids, s = own["id"].to_numpy(), np.round(y @ x.T, 12)
        s[asked["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        shown = np.round(s, 9)
        best = shown.max(axis=1)
        other = np.where(shown == best[:, None], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
        at = np.searchsorted(ids, other, sorter=(order := np.argsort(ids, kind="stable")))
        out = pd.DataFrame({"id": asked["id"], "neighbour": other, "cosine": s[np.arange(len(s)), order[np.minimum(at, len(ids) - 1)]]})
        return out[np.isfinite(best)]

    found = against(rows.select("id", "v"), queries.select("id", "v"), compare, "id long, neighbour long, cosine double", block_rows)
    best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), "neighbour", "cosine"))
    return found.groupBy("id").agg(best.alias("b")).select("id", "b.neighbour", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "b.cosine")).alias("cosine"))


def cosine_components(df: DataFrame, cosine: float, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int | None = None, min_size: int = 2) -> DataFrame:
    """(id, cluster): components of the graph of rows whose cosine is at least ``cosine``; rows in smaller ones get -1.

    Equal vectors count as one node, linked if their own product reaches ``cosine``.
    """
    rows, reps = vector_classes(df, id_col, vec_col)

    def links(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(ids), SLICE_ROWS):
            p, q = np.nonzero(y @ x[at : at + SLICE_ROWS].astype(float).T >= cosine)
            a, b = forest(np.r_[a, others[p]], np.r_[b, ids[at + q]])
        return pd.DataFrame({"a": a, "b": b}).astype("int64")

    edges = block_pairs(reps, blocks, links, "a long, b long", False)
    apart = reps.where(dot(F.col("v"), F.col("v")) < cosine).select("rep", F.lit(True).alias("alone"))
    named = rows.join(components(edges).withColumnRenamed("node", "rep"), "rep", "left").join(apart, "rep", "left").withColumn("root", F.when(F.col("alone"), F.col("id")).otherwise(F.coalesce("root", "rep")))
    sizes = named.groupBy("root").agg(F.count("*").alias("n"))
    return named.join(sizes, "root").select("id", F.when(F.col("n") >= min_size, F.col("root")).otherwise(-1).alias("cluster"))


def term_counts(df: DataFrame, cluster: str, text_col: str = "text") -> DataFrame:
    """(cluster, term, n): words of two characters and more that are no English stop words, and pairs of neighbours among them.

    Terms are counted within a task before they are passed on, so a shuffled row
    is a term of a task, not an occurrence.
    """
    stop = frozenset(STOP_WORDS)
    kind = df.schema[cluster].dataType

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[object, Counter] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for c, n in seen.items():
                yield pd.DataFrame({"cluster": pd.Series([c] * len(n), dtype=object), "term": list(n), "n": list(n.values())})

        for batch in batches:
            for c, text in zip(batch["cluster"], batch["text"]):
                kept = [w for w in WORDS(text.lower()) if len(w) > 1 and w not in stop] if isinstance(text, str) else []
                own = seen.setdefault(None if c is None or c != c else c, Counter())
                own.update(kept)
                own.update(map(" ".join, zip(kept, kept[1:])))
            if sum(map(len, seen.values())) > TERMS_HELD:
                yield from rows()
                seen.clear()
        yield from rows()

    schema = StructType([StructField("cluster", kind)]).add("term", "string").add("n", "long")
    parts = df.select(F.col(cluster).alias("cluster"), F.col(text_col).alias("text")).mapInPandas(count, schema)
    return parts.groupBy("cluster", "term").agg(F.sum("n").alias("n"))


def top_phrases(df: DataFrame, cluster: str, k: int = 6, text_col: str = "text") -> DataFrame:
    """(cluster, rank, term, score): most telling one- and two-word phrases of each cluster by class TF-IDF.

    A term occurs at least as often in all clusters as in one, which bounds its
    score by its count there. The commonest terms of a cluster are scored first;
    of the others only those whose bound reaches the k-th best of these are, so
    few terms are summed over all clusters and put in order.
    """
    tf = landed(term_counts(df, cluster, text_col), "terms")
    key = F.coalesce(F.col("cluster").cast("string"), F.lit("")), F.col("cluster").isNull()
    tf = tf.withColumns({"_c": key[0], "_none": key[1]})
    of = ["_c", "_none"]
    sizes = tf.groupBy(*of, "n").agg(F.count("*").alias("terms"))
    common = Window.partitionBy(*of).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    least = sizes.withColumn("before", F.coalesce(F.sum("terms").over(common), F.lit(0))).groupBy(*of).agg(F.sum(F.col("n") * F.col("terms")).alias("words"), F.min(F.when(F.col("before") < LEADING, F.col("n"))).alias("least"))
    mean = least.agg(F.avg("words").alias("mean"))
    # Tables of a row a cluster, whose sizes are known: a join by cluster alone would bring all terms of one to a task.
    classes = landed(least.crossJoin(F.broadcast(mean)), "terms")  # the mean is one row
    best = Window.partitionBy(*of).orderBy(F.desc(F.round("score", 9)), "term")

    def scored(rows: DataFrame) -> DataFrame:
        freq = tf.join(rows.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("freq"))
        return rows.join(freq, "term").withColumn("score", F.col("n") / F.col("words") * F.log1p(F.col("mean") / F.col("freq"))).withColumn("rank", F.row_number().over(best))

    every = tf.join(classes, of)
    first = landed(every.where("n >= least"), "terms")
    kth = landed(scored(first).where(F.col("rank") == k).select(*of, F.col("score").alias("kth")), "terms")
    bound = F.col("n") / F.col("words") * F.log1p(F.col("mean") / F.col("n"))
    some = landed(every.join(kth, of, "left").where(F.col("kth").isNull() | (bound >= F.col("kth") - 1e-8)), "terms")
    return scored(some).where(F.col("rank") <= k).select("cluster", "rank", "term", "score")


def densest(members: DataFrame, hours: float, key: str | list[str] = "cluster", time: str = "created_at") -> DataFrame:
    """(key, count, start): the fullest half-open window of a width, the earliest of equals.

    Time is cut into cells as wide as the window; a cell gets its own instants,
    where windows start, and those of the next one. Equal instants are counted
    before. So a key with very many rows is many small groups.
    """
    keys, width = [key] if isinstance(key, str) else key, int(hours * 3_600_000_000)
    counted = members.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count("*").alias("_n")).withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    cell = F.floor(F.col("_us") / width).cast("long")
    placed = counted.withColumn("_cell", F.explode(F.array(cell, cell - 1)))
    frame = Window.partitionBy(*keys, "_cell").orderBy("_us").rangeBetween(0, width - 1)
    starts = placed.withColumn("count", F.sum("_n").over(frame)).where(F.col("_cell") == cell)
    return starts.groupBy(*keys).agg(F.max(F.struct("count", (-F.col("_us")).alias("e"), F.col(time).alias("start"))).alias("m")).select(*keys, F.col("m.count").alias("count"), F.col("m.start").alias("start"))


def digest_share(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of parts joined by bars: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long") / float(16**12)


def random_order(rows: DataFrame, draws: int, most: int, seed: int, bucket_rows: int = 50_000) -> DataFrame:
    """(draw, rank, created_at): for each draw the first ``most`` of (id, created_at) in an order of its own, by digest, ties by id.

    Rows are ranked within buckets of digests, moved by the sizes of the buckets
    before; buckets that begin beyond ``most`` aren't ranked.
    """
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    share = digest_share(F.lit(seed), F.col("draw"), F.col("id"))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("share", share).withColumn("bucket", F.floor(F.col("share") * buckets).cast("long"))
    sizes = drawn.groupBy("draw", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("draw").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = sizes.withColumn("before", before).where(F.col("before") < most).select("draw", "bucket", "before")
    place = F.row_number().over(Window.partitionBy("draw", "bucket").orderBy("share", "id")) + F.col("before")
    return drawn.join(needed, ["draw", "bucket"]).withColumn("rank", place).where(F.col("rank") <= most).select("draw", "rank", "created_at")


def expected_others(sizes: DataFrame, rows: DataFrame, cfg: Suspicion = Suspicion()) -> DataFrame:
    """(size, hours, expected): mean densest count less one of random subsets of all rows' times, for each distinct size.

    ``rows``: id, created_at. A subset of a draw is its first ``size`` rows by
    digest of (seed, draw, id), so any engine draws the same at any size. Sizes
    of one row, or of more than there are, expect none.
    """
    timed = rows.where("created_at IS NOT NULL").select("id", "created_at")
    wanted = cut(sizes.select("size").distinct())
    total = timed.count()
    most = wanted.where(F.col("size").between(2, total)).agg(F.max("size")).first()[0] or 0
    hours = F.explode(F.array(*[F.lit(float(h)) for h in cfg.scales_hours])).alias("hours")
    every = wanted.select("size", hours)
    if not most:
        return every.withColumn("expected", F.lit(0.0))
    ordered = cut(random_order(timed, cfg.null_samples, int(most), cfg.seed))
    # A row is in all subsets of its rank and more; ranks meet sizes by cells.
    reach = wanted.where(F.col("size").between(2, total)).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / RANK_CELL))))
    met = ordered.withColumn("cell", F.floor(F.col("rank") / RANK_CELL)).join(reach, "cell")
    subsets = cut(met.where("rank <= size").select("size", "draw", "created_at"))
    parts = [densest(subsets, h, ["size", "draw"]).groupBy("size").agg(F.avg(F.col("count") - 1).alias("found")).withColumn("hours", F.lit(float(h))) for h in cfg.scales_hours]
    found = reduce(DataFrame.unionByName, parts)
    return every.join(found, ["size", "hours"], "left").select("size", "hours", F.coalesce("found", F.lit(0.0)).alias("expected"))


def time_concentration(members: DataFrame, expected: DataFrame, cfg: Suspicion = Suspicion(), key: str = "cluster") -> DataFrame:
    """(key, concentration, hours, count, start, expected): best scale against chance; of values equal to 12 places the first scale."""
    sizes = members.where("created_at IS NOT NULL").groupBy(key).agg(F.count("*").alias("size"))
    every = None
    for k, hours in enumerate(cfg.scales_hours):
        one = densest(members, hours, key).withColumns({"hours": F.lit(float(hours)), "k": F.lit(k)})
        every = one if every is None else every.unionByName(one)
    observed = F.col("count") - 1
    value = F.when(observed <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest("expected", F.lit(cfg.null_floor)) / observed))
    scored = every.join(sizes, key).join(expected, ["size", "hours"]).withColumn("value", value)
    best = scored.groupBy(key).agg(F.max("value").alias("concentration"), F.max(F.struct(F.round("value", 12).alias("shown"), (-F.col("k")).alias("early"), "hours", "count", "start", "expected")).alias("b"))
    return best.select(key, "concentration", "b.hours", "b.count", "b.start", "b.expected")


def geometric_mean(factors: dict[str, Column], cfg: Suspicion = Suspicion()) -> Column:
    """Weighted geometric mean of the factors that are there, each within [floor, 1]; 0 without any."""
    logs, weights = F.lit(0.0), F.lit(0.0)
    for name, c in factors.items():
        w = 0.5 if name in cfg.half_weight else 1.0
        logs = logs + F.when(c.isNotNull(), w * F.log(F.greatest(F.lit(cfg.floor), F.least(F.lit(1.0), c)))).otherwise(0.0)
        weights = weights + F.when(c.isNotNull(), w).otherwise(0.0)
    return F.when(weights > 0, F.exp(logs / F.nullif(weights, F.lit(0.0)))).otherwise(0.0)


def homogeneity(rating: str = "rating_norm") -> Column:
    """Aggregate: (majority share - 0.5) / 0.5; 0 without ratings."""
    share = F.avg(F.when(F.col(rating).isNotNull(), (F.col(rating) >= 0.5).cast("double")))
    return F.coalesce((F.greatest(share, 1 - share) - 0.5) / 0.5, F.lit(0.0))


def centroid_similarity(df: DataFrame, key: str, vec_col: str = "embedding", cosine: float = 0.8) -> DataFrame:
    """(key, size, similarity): share of members whose product with the unit centroid is at least ``cosine``."""
    parts = df.select(key, F.posexplode(vec_col).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    centroid = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # as many rows as dimensions
    norm = F.greatest(F.sqrt(dot(F.col("c"), F.col("c"))), F.lit(1e-9))
    joined = df.select(key, vec_col).join(centroid.withColumn("norm", norm), key)
    return joined.groupBy(key).agg(F.count("*").alias("size"), F.avg((dot(F.col(vec_col), F.col("c")) / F.col("norm") >= cosine).cast("double")).alias("similarity"))


def account_lift(share: Column, base: Column) -> Column:
    return F.when(share > 0, F.greatest(F.lit(0.0), 1 - base / share)).otherwise(F.when(share.isNotNull(), 0.0))


def best_membership(members: DataFrame, clusters: DataFrame, in_burst: DataFrame, min_size: int = 10, semantic_in_bursts: bool = True) -> DataFrame:
    """(id, cluster_id, kind, suspicion): each review's most suspicious eligible cluster, the first of equals."""
    eligible = clusters.where((F.col("size") >= min_size) & (F.col("suspicion") > 0))
    joined = members.join(eligible.select("cluster_id", "kind", "suspicion"), "cluster_id")
    if semantic_in_bursts:
        inside = in_burst.select("id").distinct().withColumn("b", F.lit(True))
        joined = joined.join(inside, "id", "left").where((F.col("kind") != "semantic") | F.col("b")).drop("b")
    best = joined.groupBy("id").agg(F.max(F.struct("suspicion", (-F.col("cluster_id")).alias("early"), "kind")).alias("m"))
    return best.select("id", (-F.col("m.early")).alias("cluster_id"), F.col("m.kind").alias("kind"), F.col("m.suspicion").alias("suspicion"))
