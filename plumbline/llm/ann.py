"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

Each table turns a unit vector by three rounds of random signs and a fast
Hadamard transform and hashes it to the nearest signed axis. Every distinct
vector is indexed in every table; a query probes the axes nearest to its own
turned vector. Per bucket, queries and members meet in blocks, and the best of
each query are reranked by the exact inner product of the original vectors.

Equal vectors are one index row with their smallest ids (no more can be among
the nearest), and one search. A bucket with more than ``bucket_rows`` members is
cut into parts that each query visits; many queries are dealt over copies of the
buckets. A task holds the members of one part and reads its queries in batches.
A query with too few neighbours found is searched again over every bucket of the
first table, so none is left short.

Products are of the vectors as they are, in double precision; only the hashing
is in single precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

K = 20
TABLES = 8
#: Axes that a query probes in a table, however many vectors there are.
PROBES = 16
SEED = 11
BUCKET_ROWS = 50_000
#: Queries of a bucket, on average, beyond which they are dealt over copies of it.
BUCKET_QUERIES = 20_000
#: Results that a task holds before it passes them on.
HELD_ROWS = 400_000
BLOCK = 1 << 22


def usable(vector: str) -> Column:
    """Whether a vector is there, finite in every component and not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (its length a power of two), orthonormal."""
    n, width, half = *x.shape, 1
    while half < width:
        pair = x.reshape(n, -1, 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


class Rotations:
    def __init__(self, dim: int, tables: int, seed: int = SEED):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, 3, self.width))

    def __call__(self, x: np.ndarray, table: int) -> np.ndarray:
        """(n, 2 * width): how near each vector is to each axis, then to each negated one."""
        y = np.zeros((len(x), self.width), np.float32)
        y[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            y = hadamard(y * signs)
        return np.concatenate([y, -y], axis=1)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _lifted(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Vectors whose cosine orders like the inner product: a coordinate brings every row to the norm ``top``; queries get 0 there."""
    squares = (x * x).sum(axis=1)
    if query:
        x = x / np.sqrt(squares)[:, None]
    return np.c_[x, np.zeros(len(x)) if query else np.sqrt(np.maximum(top * top - squares, 0))]


def _index(dim: int, tables: int, top: float, even: bool):
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = Rotations(dim + (not even), tables)
        for batch in batches:
            x = _matrix(batch["v"], dim)
            x = (x if even else _lifted(x, top, False)) / top  # within the range of single precision
            for t in range(tables):
                yield batch.assign(bucket=(turn(x, t).argmax(axis=1) + t * 2 * turn.width).astype(np.int64))[["bucket", "rep", "ids", "v"]]

    return index


def _probe(dim: int, tables: int, top: float, even: bool, probes: int | None):
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = Rotations(dim + (not even), tables)
        for batch in batches:
            x = _matrix(batch["v"], dim)
            x = x / top if even else _lifted(x, top, True)
            n = min(probes or 2 * turn.width, 2 * turn.width)
            for t in range(tables):
                near = np.argsort(-turn(x, t), axis=1, kind="stable")[:, :n] + t * 2 * turn.width
                for k in range(n):
                    yield batch.assign(bucket=near[:, k].astype(np.int64))[["bucket", "rep", "v"]]

    return probe


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _rerank(dim: int, keep: int):
    """Best ``keep`` members of each query in each bucket part; rows of a run: members (role 0), then queries."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True).drop_duplicates(["query", "id"])
        rows = rows.sort_values(["query", "score", "id"], ascending=[True, False, True])
        return rows[rows.groupby("query").cumcount() < keep]

    def listed(rows: pd.DataFrame) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, rows["query"].to_numpy()[1:] != rows["query"].to_numpy()[:-1]])
        cut_at = starts[1:]
        return pd.DataFrame({"query": rows["query"].to_numpy()[starts], "s": np.split(-rows["score"].to_numpy(), cut_at), "id": np.split(rows["id"].to_numpy(), cut_at)})

    def near(members: pd.DataFrame, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        m = _matrix(members["v"], dim)
        ids = members["ids"].tolist()
        step = max(1, BLOCK // max(1, len(m)))
        for at in range(0, len(queries), step):
            part = queries.iloc[at : at + step]
            q = _matrix(part["v"], dim)
            rough = q @ m.T
            n = min(keep, len(m))
            floor = np.partition(rough, len(m) - n, axis=1)[:, len(m) - n] - 1e-9 * (1 + np.abs(rough).max())
            i, j = np.nonzero(rough >= floor[:, None])
            exact = (q[i] * m[j]).sum(axis=1)  # the same order of additions for every pair, so equal vectors tie
            count = [len(ids[x]) for x in j]
            yield pd.DataFrame({"query": np.repeat(part["rep"].to_numpy()[i], count), "id": np.array([y for x in j for y in ids[x]], np.int64), "score": np.repeat(exact, count)})

    def rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, key, members, ready = [], 0, None, [], None
        for batch in batches:
            for (*own, role), rows in batch.groupby(["bucket", "part", "deal", "role"], sort=False):
                if own != key:
                    key, members, ready = own, [], None
                if role == 0:
                    members.append(rows)
                    continue
                if ready is None and members:
                    ready = pd.concat(members, ignore_index=True)
                    members = []
                if ready is None:
                    continue
                for found in near(ready, rows):
                    held.append(found)
                    size += len(found)
                    if size > HELD_ROWS:
                        held = [flush(held)]
                        size = len(held[0])
                        if size > HELD_ROWS // 2:
                            yield listed(held.pop())
                            size = 0
        if held:
            yield listed(flush(held))

    return rerank


def _search(index: DataFrame, queries: DataFrame, n_queries: int, dim: int, tables: int, top: float, even: bool, probes: int | None, keep: int, bucket_rows: int) -> DataFrame:
    """(query, near): the ``keep`` best found of each query, near an array of (s, id) with s the negated score.

    A task passes on one list a query, so a list's entries don't cross the shuffle one by one.
    """
    kind = index.schema["v"].dataType.simpleString()
    members = index.mapInPandas(_index(dim, tables, top, even), f"bucket long, rep long, ids array<long>, v {kind}")
    visits = queries.mapInPandas(_probe(dim, tables, top, even, probes), f"bucket long, rep long, v {kind}")
    sizes = members.groupBy("bucket").count()  # as many rows as there are buckets: 2 * tables * width
    parts = F.coalesce("parts", F.lit(1))
    cuts = F.broadcast(sizes.where(F.col("count") > bucket_rows).select("bucket", F.ceil(F.col("count") / bucket_rows).cast("long").alias("parts")))
    width = 2 * Rotations(dim + (not even), 1).width
    deals = max(1, n_queries * min(probes or width, width) // (width * BUCKET_QUERIES))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal")
    left = members.join(cuts, "bucket", "left").select("bucket", F.pmod(F.xxhash64("rep"), parts).alias("part"), copies, F.lit(0).alias("role"), "rep", "ids", "v")
    dealt = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(deals)).alias("deal")
    right = visits.join(cuts, "bucket", "left").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), dealt, F.lit(1).alias("role"), "rep", F.lit(None).cast("array<long>").alias("ids"), "v")
    met = left.unionByName(right).repartition("bucket", "part", "deal").sortWithinPartitions("bucket", "part", "deal", "role")
    lists = met.mapInPandas(_rerank(dim, keep), "query long, s array<double>, id array<long>")
    merged = lists.groupBy("query").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("s", "id"))))).alias("near"))
    return merged.select("query", F.slice("near", 1, keep).alias("near"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vec_col: str = "embedding", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The ``k`` nearest of each query: query_id, rank from 1, the neighbour's id, score (inner product, double).

    Candidates are all rows but those with the query's own id; all of them are
    returned if there are fewer than ``k``. Vectors that are null, zero or hold
    null or non-finite components take no part, nor do null ids. Shorter vectors
    count as filled with zeros. Ties go to the smaller id; a repeated id is one
    candidate a distinct vector. Empty tables give no rows. Other columns are ignored.
    """
    keep = k + 1
    single = all(df.schema[vec_col].dataType.simpleString() == "array<float>" for df in (vectors, queries))
    kind = "array<float>" if single else "array<double>"
    clean = lambda df: df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind).alias("v")).where(usable("v") & F.col("id").isNotNull()).withColumn("content", F.md5(F.col("v").cast("string")))
    rows, asked = clean(vectors), clean(queries)
    first = Window.partitionBy("content").orderBy("id")
    smallest = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    index = cut(smallest.groupBy("content").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select("rep", "ids", "v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dim, top, low, total = index.agg(F.max(F.size("v")), F.max(norm), F.min(norm), F.sum(F.size("ids"))).first()
    searches = cut(asked.groupBy("content").agg(F.min("id").alias("rep"), F.first("v").alias("v")))
    n_queries = searches.count()
    if dim is None:
        dim, top, low, total = 1, 1.0, 1.0, 0
    even = top - low <= 1e-5 * top
    args = (dim, tables, top, even)
    found = cut(_search(index, searches.select("rep", "v"), n_queries, *args, probes, keep, bucket_rows))
    short = searches.join(found.where(F.size("near") >= min(keep, total)).select("query"), searches["rep"] == F.col("query"), "left_anti").select("rep", "v")
    short = cut(short)
    if not short.isEmpty():
        again = _search(index, short, short.count(), dim, 1, top, even, None, keep, bucket_rows)
        found = found.join(short, found["query"] == short["rep"], "left_anti").unionByName(again)
    per_id = asked.select("id", "content").distinct().join(searches.select("content", "rep"), "content").join(found, F.col("rep") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return per_id.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))
