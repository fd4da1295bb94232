"""Token counts through a digest cache.

A text is counted once per (content digest, tokenizer-version digest). Documents
are joined with the cache table on both digests; only distinct misses are
encoded, and their counts are appended to the cache.

The content is normalised before its digest only where that cannot change the
count: white space runs become one space for tokenizers that drop white space.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, slices, texts

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"
#: Pieces of text whose counts a Python worker remembers.
MEMO_PIECES = 400_000
#: Characters on which Python and the tokenizer's own Unicode tables agree in any version: Latin letters, common punctuation.
_PLAIN = regex.compile(r"[\x00-\x1B\x20-įı-ɏ‐-‧€]*").fullmatch


class TokenCounter:
    """Counts of the tokens that the tokenizer's library gives, without added special tokens.

    For a tokenizers file that is known to split texts into independent pieces
    by one pattern, texts of plain characters are split here and only new pieces
    are encoded by the library; any other text goes to the library whole. With
    ``pieces=False`` all texts do.
    """

    def __init__(self, path: str, pieces: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.memo: dict[str, int] = {}
        self.split = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda batch: [len(x) for x in model.encode(batch, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda batch: [len(x.ids) for x in model.encode_batch_fast(batch, add_special_tokens=False)]
            self._plan(json.loads(model.to_str()), pieces)

    def _plan(self, spec: dict, pieces: bool) -> None:
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps, kinds = before.get("pretokenizers", []), [x["type"] for x in normal.get("normalizers", [])]
        if not pieces or [x["type"] for x in steps] != ["Split", "ByteLevel"] or kinds != ["NFC", "Replace", "Lowercase"]:
            return
        first, second = steps
        if first["behavior"] == "Removed" and first["invert"] and not second["use_regex"] and not second["add_prefix_space"]:
            self.split = regex.compile(first["pattern"]["Regex"]).findall
            self.marks = [x["content"] for x in spec["added_tokens"]]

    @property
    def drops_white_space(self) -> bool:
        return self.split is not None

    def counts(self, batch: list[str]) -> list[int]:
        out, whole, parts = [0] * len(batch), [], {}
        for i, text in enumerate(batch):
            if self.split and _PLAIN(text) and not any(m in text for m in self.marks):
                parts[i] = self.split(text.lower())
            else:
                whole.append(i)
        if whole:
            for i, n in zip(whole, self.encode([batch[i] for i in whole])):
                out[i] = n
        for i, pieces in parts.items():
            memo = self.memo
            try:
                out[i] = sum([memo[p] for p in pieces])
            except KeyError:
                new = list({p for p in pieces if p not in memo})
                memo.update(zip(new, self.encode(new)))
                out[i] = sum([memo[p] for p in pieces])
            if len(memo) > MEMO_PIECES:
                memo.clear()
        return out


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file and of its library's version."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + version.encode()).hexdigest()


def content_digest(text, drops_white_space: bool):
    """SHA-256 of the normalised content as a column; null counts as empty."""
    value = F.coalesce(text, F.lit(""))
    return F.sha2(F.trim(F.regexp_replace(value, "[ \\t\\n\\r]+", " ")) if drops_white_space else value, 256)


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at ``path``, made empty if it isn't there."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens; ``cache`` gains the counts of distinct misses.

    Null is the empty text. Repeated rows and equal texts are encoded once.
    Rows with a null id stay; an empty table gives no rows. Other columns are
    ignored. Two writers at a time may append a digest twice with the same
    count; readers take one. The counts are cut off before the last join, so that
    both its sides are bare shuffles and a digest with very many rows is split.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    drops = TokenCounter(tokenizer).drops_white_space
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content", content_digest(F.col("text"), drops))
    known = open_cache(spark, cache).where(F.col("tokenizer") == version).select("content")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(tokenizer)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            yield pd.DataFrame({"content": batch["content"], "tokenizer": version, "n_tokens": counter.counts(texts(batch["text"]))})

    # Copies are collapsed within each task before the shuffle, so a text with many copies crosses it once a task.
    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    distinct.join(known, "content", "left_anti").mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    stored = cut(stored)
    sizes = keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(stored, "content").select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens")
