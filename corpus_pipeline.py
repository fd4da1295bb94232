"""Corpus pipeline: language ID, near-dedup, decontamination, PII, SentencePiece.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. The driver writes a stage's result as Parquet and reads it
as the next one's ``docs``. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language_crf, pii, sentence_pieces, simhash
from plumbline.llm.common import fresh_path, give_back, table

#: A document is rejected where no language holds this share of its words.
LEAST_SHARE = 0.5
#: Near-duplicates: similarity of their shingles, and words of a shingle.
SIMILARITY, SHINGLE_WORDS = 0.8, 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: null or letterless texts, and those where no language holds half of the words.

    The model is learned from the documents' own text and non-null ``lang``.
    Each row is judged on its own.
    """
    model = language_crf.fit(docs)
    give_back(spark)
    return language_crf.keep_determined(docs, model, LEAST_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that with the smallest doc_id; equal rows are one.

    Near-duplicates are texts whose sets of shingles of ``SHINGLE_WORDS`` words have
    a Jaccard similarity of ``SIMILARITY`` or more. Columns may have any names; an
    empty table stays empty.
    """
    return simhash.keep_first(docs, SIMILARITY, SHINGLE_WORDS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; an empty table stays empty, other columns may have any name."""
    return decontaminate.decontaminate(docs, decontaminate.item_windows(table(spark, sf_dir, "benchmark")))


def pii_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the kind's name in brackets; n_chars follows the text. Null texts and columns of any other name stay as they are."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentence_piece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces, the best path's score and the next best paths as edits; columns of the same names, in any case, are replaced; an empty table stays empty."""
    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("pii", pii_redacted),
    ("sentence_pieces", sentence_piece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; results between stages are tables in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The conditional random field's decisions can't be written in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
