"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 6 characters of lower-cased text, within and
across word ends, by presence in a document. Their counts in toxic and in other
documents cover all labelled training rows; the log of the smoothed ratio of the
two scales a feature. The most telling features enter a logistic regression that
is trained in numpy on a bounded sample (about ``SAMPLE_DOCS`` rows a label, each
with at most ``SELECTED`` features).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.llm.common import cut, slices, texts

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 19
SMOOTHING = 0.5
#: Features with the largest absolute z-value of the difference between the two classes that enter the classifier.
SELECTED = 8_000
LEAST_Z = 3.0
#: Training rows a label from which the classifier's weights are learned.
SAMPLE_DOCS = 4_000
#: Code points of a text whose n-grams are held at once.
CODES_AT_ONCE = 1 << 18
STEPS, RATE, L2 = 400, 0.05, 1e-4


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with one blank around, white space runs as one blank."""
    joined = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def buckets_of(codes: np.ndarray, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Buckets of all n-grams of code points, repeats included."""
    out, hashed = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        hashed = hashed[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in orders:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            out.append((mixed ^ (mixed >> np.uint32(13))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text's n-grams, of those that are not zero in ``wanted``; long texts in overlapping slices."""
    codes, reach, found = codes_of(text), max(ORDERS) - 1, []
    for at in range(0, max(1, len(codes) - reach), CODES_AT_ONCE):
        part = buckets_of(codes[at : at + CODES_AT_ONCE + reach])
        found.append(np.unique(part if wanted is None else part[wanted[part] != 0]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Model:
    """Weight of each bucket (ratio times coefficient, 0 where not selected) and the intercept."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-self.bias - self.weights[present(text, self.weights)].sum(dtype=np.float64))))


def count_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(2, BUCKETS) documents of each label that hold a feature, and (2,) documents, over all rows (text, label)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for text, label in zip(texts(batch["text"]), batch["label"]):
                sums[label][present(text)] += 1
                sums[label][BUCKETS] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"bucket": at, "n0": sums[0][at], "n1": sums[1][at]})

    found = rows.mapInPandas(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, BUCKETS + 1))
    at = found["bucket"].to_numpy()
    out[0][at], out[1][at] = found["n0"].to_numpy(), found["n1"].to_numpy()
    return out[:, :BUCKETS], out[:, BUCKETS]


def ratios(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratios of the selected features, 0 elsewhere."""
    p = (counts + SMOOTHING) / (totals[:, None] + 2 * SMOOTHING)
    pooled = (counts.sum(axis=0) + 2 * SMOOTHING) / (totals.sum() + 4 * SMOOTHING)
    z = np.abs(p[1] - p[0]) / np.sqrt(pooled * (1 - pooled) * (1 / max(totals[0], 1) + 1 / max(totals[1], 1)) + 1e-12)
    z[counts.sum(axis=0) < 3] = 0
    chosen = np.argsort(-z, kind="stable")[:SELECTED]
    chosen = chosen[z[chosen] >= LEAST_Z]
    out = np.zeros(counts.shape[1])
    out[chosen] = np.log(p[1][chosen] / p[0][chosen])
    return out


def learn(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression by Adam; ``flat`` has the rows' buckets end to end, ``sizes`` their numbers.

    Row weights undo the sample's share of each label.
    """
    used = np.unique(flat)
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    flat = place[flat]
    full = np.flatnonzero(sizes)  # rows with features: only these have a segment
    starts = (np.cumsum(sizes) - sizes)[full]
    value = ratio[used]
    rate = np.clip((weights * labels).sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4)
    theta = np.r_[np.full(len(used), 0.05), np.log(rate / (1 - rate))]
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    share = weights / max(weights.sum(), 1e-9)
    for step in range(1, STEPS + 1):
        z = np.full(len(sizes), theta[-1])
        if len(full):
            z[full] += np.add.reduceat((theta[:-1] * value)[flat], starts)
        miss = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        grad = np.r_[np.bincount(flat, np.repeat(miss, sizes), len(used)) * value + L2 * theta[:-1], miss.sum()]
        mean += 0.1 * (grad - mean)
        square += 0.001 * (grad * grad - square)
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = theta[:-1] * value
    return Model(out, float(theta[-1]))


def _drawn(rows: DataFrame, key: Column) -> DataFrame:
    """About ``SAMPLE_DOCS`` rows of each ``label``: those with the smallest hashes of distinct keys.

    The number varies as a binomial's does, by some hundred at most; nothing is
    sorted, so no task gets the rows of a label.
    """
    share = F.broadcast(rows.groupBy("label").agg((F.lit(float(SAMPLE_DOCS)) / F.count("*")).alias("share")))
    return rows.withColumn("drawn", F.pmod(F.xxhash64(key), F.lit(1 << 40))).join(share, "label").where(F.col("drawn") < F.col("share") * (1 << 40))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of ``labels`` (0 or 1, others and null left out) on the rows of ``docs`` that they name.

    An id with both labels counts with each, repeated rows as often as they
    occur. Without rows of both labels, as on empty tables, every text gets the
    share of the label that is there (one half without any).
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)").distinct()
    # Labels grow with the documents: a merge join at every size, so that plans are alike.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(marked.hint("merge"), "doc_id").select("doc_id", "text", "label")
    counts, totals = count_features(rows.select("text", "label"))
    if not totals.all():
        share = 0.5 if not totals.sum() else float(totals[1] > 0)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 0.01) / (1.01 - share))))
    ratio = ratios(counts, totals)
    chosen = docs.sparkSession.sparkContext.broadcast(np.packbits(ratio != 0))

    @F.pandas_udf("array<int>")
    def selected(column: pd.Series) -> pd.Series:
        mark = np.unpackbits(chosen.value)
        return pd.Series([present(t, mark).astype(np.int32) for t in column])

    # Only labels whose documents are there may be drawn.
    there = docs.select(F.col(id_col).alias("doc_id"))
    there = cut(marked.join(there.hint("merge"), "doc_id", "left_semi"))
    drawn = _drawn(there, F.xxhash64(F.col("doc_id").cast("string"), "label")).select("doc_id", "label")
    texts_ = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # About 2 * SAMPLE_DOCS ids are broadcast, so the texts don't cross a second shuffle. Equal rows are one.
    named = texts_.join(F.broadcast(drawn), "doc_id").withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "label", "text"))
    sample = _drawn(cut(named.select("label", "key", selected("text").alias("found")).dropDuplicates(["label", "key"])), F.col("key")).select("label", "found").toArrow()
    if not sample.num_rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    label, lists = sample["label"].to_numpy(), sample["found"].combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    del sample, lists
    weights = np.where(label == 1, totals[1] / max((label == 1).sum(), 1), totals[0] / max((label == 0).sum(), 1))
    return learn(flat, sizes, label.astype(float), weights, ratio)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: id, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    A null text counts as empty and is scored by the intercept. Repeated rows
    give repeated results, an empty table none; very long texts are taken in
    slices. Other columns are ignored.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType)]).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            scores = np.array([shared.value.score(t) for t in texts(batch["text"])])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores, "predicted": (scores >= threshold).astype(np.int32)})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(score, schema).withColumnRenamed("doc_id", id_col)
