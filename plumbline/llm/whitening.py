"""Embedding whitening by a compensated covariance.

Vectors are whole numbers (fixed point), so their sums are exact. They are
centred by the mean as an unevaluated sum of two doubles; outer products are
accumulated in double-double arithmetic with error-free transformations (two-sum,
two-product), each task's high and low parts are merged in two levels, and the
covariance's eigenvectors come from LAPACK's tridiagonal divide and conquer
(``numpy.linalg.eigh``). The covariance's side is the vectors' length: that
matrix is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh_path

SCALE, SHIFT = 1024, 100_000
#: Fixed-point entries are less than this, so that sums of a batch are exact in 64 bits.
LARGEST = 1 << 45
#: Products that are held at a time.
CELLS = 1 << 18
#: Partial results are merged in so many groups first.
GROUPS = 32
#: An eigenvalue under this share of the largest, times the vectors' length, is zero to double precision.
TINY = 2.0**-50


# ---------------------------------------------------------------- double-double


def two_sum(a, b):
    """a + b as the rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a):
    """a as two parts of at most 26 bits each."""
    t = 134217729.0 * a
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    """a * b as the rounded product and its exact error."""
    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a, b):
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


def total(high: np.ndarray, low: np.ndarray):
    """Sum of double-doubles along the first axis, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        s = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))
        high, low = (np.concatenate([x, y[2 * half :]]) for x, y in zip(s, (high, low)))
    return high[0], low[0]


def outer_sum(high: np.ndarray, low: np.ndarray):
    """Upper triangle (by rows) of the sum of rows' outer products, as double-double; rows are ``high + low``."""
    d = high.shape[1]
    i, j = np.triu_indices(d)
    out = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, CELLS // len(i))
    for k in range(0, len(high), step):
        h, lo = high[k : k + step], low[k : k + step]
        p, e = two_product(h[:, i], h[:, j])
        e = e + (h[:, i] * lo[:, j] + lo[:, i] * h[:, j])
        s = p + e
        out = add(out, total(s, e - (s - p)))
    return out


# ---------------------------------------------------------------- Spark


def fixed_point(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and x: each entry c as floor(1024 c) + 100000.

    Rows go whose vector is null or empty, holds null or non-finite entries, or
    entries that fixed point cannot hold exactly (of 2^35 and more).
    """
    held = rows.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda c: c.cast("double")).alias("c"))
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(LARGEST // SCALE)))
    return held.where(F.col("c").isNotNull() & (F.size("c") > 0) & ~bad).select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and each dimension's exact sum, of the vectors of the most frequent length (ties: the longest)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for d, part in batch.groupby(batch["x"].map(len)):
                n, s = sums.get(d, (0, [0] * d))
                sums[d] = n + len(part), [a + int(b) for a, b in zip(s, matrix(part["x"]).sum(axis=0))]
        for d, (n, s) in sums.items():
            yield pd.DataFrame({"d": d, "place": range(d), "n": n, "s": [str(v) for v in s]})

    parts = rows.select("x").mapInPandas(run, "d int, place int, n long, s string")
    sums = parts.groupBy("d", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    lengths = sums.groupBy("d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "s"))).alias("s"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return (found["n"], [int(r["s"]) for r in found["s"]]) if found else (0, [])


def merged(parts: DataFrame) -> DataFrame:
    """Rows (i, task, high, low) of partial matrices summed by i, in two levels."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        high, low = total(matrix(group["high"]), matrix(group["low"]))
        return pd.DataFrame({"i": group["i"].iloc[:1], "task": group["task"].iloc[:1], "high": [high], "low": [low]})

    schema = "i int, task int, high array<double>, low array<double>"
    return parts.groupBy("i", (F.col("task") % GROUPS).alias("part")).applyInPandas(run, schema).groupBy("i").applyInPandas(run, schema)


def covariance(rows: DataFrame, column: str, mean: list[Fraction], n: int) -> np.ndarray:
    """Covariance, divisor ``n``, of a column of vectors of ``mean``'s length, centred before multiplying."""
    d = len(mean)
    centre, rest = _parts(mean)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out = np.zeros(d * (d + 1) // 2), np.zeros(d * (d + 1) // 2)
        for batch in batches:
            if len(batch):
                out = add(out, outer_sum(*centred(matrix(batch[column]), centre, rest)))
        ends = np.cumsum(np.arange(d, 0, -1))
        cells = [(i, out[0][e - (d - i) : e], out[1][e - (d - i) : e]) for i, e in enumerate(ends)]
        yield pd.DataFrame({"i": [c[0] for c in cells], "task": TaskContext.get().partitionId(), "high": [c[1] for c in cells], "low": [c[2] for c in cells]})

    parts = rows.select(column).mapInPandas(run, "i int, task int, high array<double>, low array<double>")
    out = np.zeros((d, d))
    for r in merged(parts).collect():
        out[r["i"], r["i"] :] = [float((Fraction(h) + Fraction(lo)) / n) for h, lo in zip(r["high"], r["low"])]
    return out + np.triu(out, 1).T


def _parts(mean: list[Fraction]) -> tuple[np.ndarray, np.ndarray]:
    """Means as unevaluated sums of two doubles."""
    high = [float(m) for m in mean]
    return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(mean, high)])


def centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x less the mean, as double-double."""
    s, e = two_sum(x.astype(np.float64), -mean)
    e = e - rest
    high = s + e
    return high, e - (high - s)


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and unit eigenvectors (columns), largest first; a vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row: the exact sum over dimensions of (n x - S)^2."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
    return [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


def whiten(rows: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact.

    The fit list is all rows that ``fixed_point`` keeps, of the most frequent
    length; other lengths take no part. Repeated rows and ids count each time,
    null ids stay, other columns are ignored. ``deviation`` is null where it
    passes 64 bits; ``deviation_exact`` has its digits. A component whose
    eigenvalue is zero to double precision (one vector, equal vectors, dependent
    dimensions) has a null ``whitened`` and takes no part in ``identity_error``;
    without variance ``explained`` is 0. An empty table gives no rows. The
    projections are written once to the shared folder and read for the rest.
    """
    spark = rows.sparkSession
    fixed = fixed_point(rows, id_col, vector_col)
    n, sums = exact_sums(fixed)
    d, kind = len(sums), fixed.schema["vec_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string")
    fixed = fixed.where(F.size("x") == d)
    mean = [Fraction(s, n) for s in sums]
    spread = covariance(fixed, "x", mean, n)
    (values, vectors), trace = components(spread, min(most, d)), float(np.trace(spread))
    sound = values > max(values[0], 0) * d * TINY
    across = np.where(sound, vectors / np.sqrt(np.where(sound, values, 1)), 0)
    centre, rest = _parts(mean)

    def project(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = matrix(batch["x"])
                high, low = centred(x, centre, rest)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation_exact": [str(v) for v in deviations(x, n, sums)], "y": list(high @ across + low @ across)})

    path = fresh_path(spark, "whitened")
    # Ids travel as text, since pandas makes doubles of whole numbers beside nulls.
    fixed.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(project, "vec_id string, deviation_exact string, y array<double>").write.parquet(path)
    projected = spark.read.parquet(path).withColumn("vec_id", F.col("vec_id").cast(kind))
    k = len(values)
    means = projected.agg(*[F.avg(F.col("y")[i]).alias(str(i)) for i in range(k)]).first()
    kept, unit = np.flatnonzero(sound), covariance(projected, "y", [Fraction(m) for m in means], n)
    error = float(np.abs(unit[np.ix_(kept, kept)] - np.eye(len(kept))).max(initial=0))
    shares = [float(v / trace) if trace > 0 else 0.0 for v in values]
    each = projected.select("vec_id", "deviation_exact", F.posexplode("y").alias("at", "y"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation_exact as bigint)").alias("deviation"),
        F.when(F.array(*[F.lit(bool(v)) for v in sound])[F.col("at")], F.col("y")).alias("whitened"),
        F.array(*map(F.lit, shares))[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_exact",
    )
