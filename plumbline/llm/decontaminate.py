"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Benchmark items become windows of ten consecutive words. The windows' hashes are
broadcast; every document's windows are hashed and looked up, and each hit is
verified word by word before its words count as hit. The set has a checked
size: beyond ``set_windows`` windows it is cut into parts by hash. Then every part
is a pass of its own over the documents, after which it is let go, and the
parts' verified hits meet in one shuffle by the text's digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plumbline.llm.common import cut, slices, texts, trimmed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows in one broadcast part; about 300 bytes each in a task.
SET_WINDOWS = 500_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FIND = re.compile(WORD).findall
_LOWER = str.maketrans(UPPER, UPPER.lower())
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words of a text; null has none."""
    return _FIND(text.translate(_LOWER)) if text else []


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item_id, words): distinct windows of each item; a shorter item is one window, one without words none.

    Items without an id are one item with the empty id.
    """
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    split = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    return split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("words")).distinct()


class WindowSet:
    """Windows by length and hash, for look-up in a document's words."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.ids: dict[str, int] = {}
        self.items: dict[tuple[int, ...], list[str]] = {}
        for item, words in rows:
            self.items.setdefault(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words), []).append(item)
        self.by_length: dict[int, np.ndarray] = {}
        for n in {len(k) for k in self.items}:
            mine = np.array([k for k in self.items if len(k) == n], np.uint64)
            self.by_length[n] = np.unique(self._hashes(mine.ravel(), n)[::n])

    @staticmethod
    def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            out = out * _BASE + ids[k : len(ids) - n + 1 + k] * np.uint64(0xD6E8FEB86659FD93)
        return out

    def hits(self, words: list[str]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside a window that occurs, and the items of those windows."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        hit, items = np.zeros(len(words), bool), set()
        for n, known in self.by_length.items():
            if len(words) < n:
                continue
            hashes = self._hashes(ids, n)
            at = np.searchsorted(known, hashes)
            for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes):
                found = self.items.get(tuple(ids[i : i + n].tolist()))
                if found:
                    hit[i : i + n] = True
                    items.update(found)
        return hit, items


def _parts(windows: DataFrame, set_windows: int) -> list[DataFrame]:
    """The windows in parts of about ``set_windows``, by hash; more than one are cut off first."""
    cuts = max(1, -(-windows.count() // set_windows))
    if cuts == 1:
        return [windows]
    windows = cut(windows)
    return [windows.where(F.pmod(F.xxhash64("words"), F.lit(cuts)) == k) for k in range(cuts)]


def _shared(part: DataFrame) -> Broadcast:
    return part.sparkSession.sparkContext.broadcast([(r.item_id, r.words) for r in part.collect()])


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def found_hits(docs: DataFrame, parts: list[DataFrame], text_col: str = "text") -> DataFrame:
    """(digest, n_words, n_hit, spans, items) of each distinct text with a hit, one pass over ``docs`` a part.

    ``spans`` are the runs of hit words, as (start, end). Each pass is written
    before the next part is gathered, so the driver and a task hold one part.
    """
    passes = []
    for part in parts:
        shared = _shared(part)

        def look(batches: Iterator[pd.DataFrame], shared: Broadcast = shared) -> Iterator[pd.DataFrame]:
            known = WindowSet(shared.value)
            for batch in (piece for whole in batches for piece in slices(whole, "text")):
                out = []
                for digest, text in zip(batch["digest"], texts(batch["text"])):
                    words = words_of(text)
                    hit, items = known.hits(words)
                    if items:
                        out.append((digest, len(words), [list(x) for x in _runs(hit)], sorted(items)))
                yield pd.DataFrame(out, columns=["digest", "n_words", "spans", "items"])

        keyed = docs.select(_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
        passes.append(cut(keyed.mapInPandas(look, "digest string, n_words long, spans array<array<int>>, items array<string>").dropDuplicates(["digest"])))
        shared.unpersist()
    every = reduce(DataFrame.unionByName, passes).groupBy("digest").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )  # one row a part and text

    def join(spans: Column, x: Column) -> Column:
        last = F.element_at(spans, -1)
        touching = (F.size(spans) > 0) & (F.try_element_at(last, F.lit(2)) >= x[0])
        return F.when(touching, F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1]))))).otherwise(F.concat(spans, F.array(x)))

    merged = every.withColumn("spans", F.aggregate("s", F.expr("cast(array() as array<array<int>>)"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(join(acc, x))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x[1] - x[0])
    return cut(merged.select("digest", "n_words", n_hit.alias("n_hit"), "spans", "items"))


def scan(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text", set_windows: int = SET_WINDOWS) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or wordless texts have no words and no hits. Repeated rows give
    repeated results; an empty benchmark leaves all clean, no documents give no
    rows. Very long texts are taken one by one. Other columns are ignored.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType)]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    parts = _parts(windows, set_windows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(parts) > 1:
        found = found_hits(rows, parts).select("digest", "n_hit", "items")

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in (piece for whole in batches for piece in slices(whole, "text")):
                yield pd.DataFrame({"doc_id": batch["doc_id"], "digest": batch["digest"], "n_words": [len(words_of(t)) for t in texts(batch["text"])]})

        keyed = rows.withColumn("digest", _digest(F.col("text")))
        counted = keyed.mapInPandas(count, StructType([schema[0]]).add("digest", "string").add("n_words", "long"))
        n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.expr("cast(array() as array<string>)"))
        joined = counted.join(found, "digest", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"))
        return joined.withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("doc_id", id_col)
    shared = _shared(parts[0])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WindowSet(shared.value)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            split = [words_of(t) for t in texts(batch["text"])]
            found = [known.hits(w) for w in split]
            n_hit = [int(h.sum()) for h, _ in found]
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for _, x in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [len(w) for w in split], "n_hit": n_hit, "n_items": [len(x) for _, x in found], "items_sha256": digest, "contaminated": [n > 0 for n in n_hit]})

    return rows.mapInPandas(look, schema).withColumnRenamed("doc_id", id_col)


def decontaminate(docs: DataFrame, windows: DataFrame, text_col: str = "text", most_hit: float = 0.0, set_windows: int = SET_WINDOWS) -> DataFrame:
    """``docs`` without the rows in which over the share ``most_hit`` of the words is hit; of the rest, the hit spans are cut out.

    With the default 0 every document with a hit goes, so nothing is cut. A cut
    text loses each run of hit words and what stands between them; it is scanned
    again until no window occurs. All columns stay, whatever their names; rows
    whose text is null stay; an empty table stays empty.
    """
    parts = _parts(windows, set_windows)
    if len(parts) > 1:
        return _decontaminate_in_parts(docs, parts, text_col, most_hit)
    shared = _shared(parts[0])

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WindowSet(shared.value)
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            new, kept = [], []
            for value, text in zip(batch[text_col], texts(batch[text_col])):
                ok = True
                while ok:
                    words = words_of(text)
                    hit = known.hits(words)[0]
                    if not hit.any():
                        break
                    ok = hit.mean() <= most_hit
                    value = text = cut_words(text, hit)
                new.append(value)
                kept.append(ok)
            yield batch.assign(**{text_col: new})[kept]

    return docs.mapInPandas(trimmed(keep), docs.schema)


def _decontaminate_in_parts(docs: DataFrame, parts: list[DataFrame], text_col: str, most_hit: float) -> DataFrame:
    """Rounds over all parts until no text has a hit: too much hit goes, the rest is cut and scanned again."""
    row, clean = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), []
    left = docs.select(row)

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            hit = np.zeros(len(words_of(t)), bool)
            for a, b in s:
                hit[a:b] = True
            out.append(cut_words(t, hit))
        return pd.Series(out)

    while True:
        text = F.col("row")[text_col]
        found = found_hits(left.select(text.alias("text")), parts)
        if found.isEmpty():
            return reduce(DataFrame.unionByName, [*clean, left]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
        joined = left.withColumn("digest", _digest(text)).join(found.select("digest", "n_words", "n_hit", "spans"), "digest", "left")
        clean.append(joined.where("n_hit IS NULL").select("row"))
        part = joined.where(F.col("n_hit") <= F.col("n_words") * most_hit)
        left = cut(part.select(F.col("row").withField(text_col, without(text, F.col("spans"))).alias("row")))


def cut_words(text: str, hit: np.ndarray) -> str:
    """``text`` without the spans from the first to the last word of each run of hit words."""
    spans = [m.span() for m in re.finditer(WORD, text.translate(_LOWER))]
    out, at = [], 0
    for i in np.flatnonzero(hit & ~np.r_[False, hit[:-1]]):
        j = i
        while j + 1 < len(hit) and hit[j + 1]:
            j += 1
        out.append(text[at : spans[i][0]])
        at = spans[j][1]
    return "".join([*out, text[at:]])


ORACLE = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
cand AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, cand.n, item_id FROM cand JOIN win ON win.s = cand.s AND win.n = cand.n),
per AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN per USING (r) LEFT JOIN its USING (r)
"""
