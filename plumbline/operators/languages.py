"""Languages of texts by character trigrams, learned from texts whose language is known.

A profile is a table of fixed size: the ``GRAMS`` most frequent trigrams of all
texts with the logarithm of their smoothed share in each language. A text gets
the language under which its known trigrams are likeliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.plans.tables import cut

GRAMS = 3000
SMOOTHING = 0.5
#: Scripts of languages that are told by them, in the order in which they are asked.
SCRIPTS = (("ja", r"[\x{3040}-\x{30FF}]"), ("ko", r"[\x{AC00}-\x{D7A3}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"), ("ru", r"[\x{0400}-\x{04FF}]"))


#: Trigrams of a language that a task holds before it counts them.
KEYS_HELD = 4_000_000


def trigrams(text: str) -> np.ndarray:
    """A number for each run of three characters, 21 bits each; in the order of their texts."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) > 2 else c[:0]


def counted(lang: str, held: list[np.ndarray]) -> pd.DataFrame:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return pd.DataFrame({"lang": lang, "key": keys, "n": n})


@F.pandas_udf(StringType())
def spelled(column: pd.Series) -> pd.Series:
    """The texts of trigrams' numbers."""
    return column.map(lambda k: "".join(chr(k >> shift & (1 << 21) - 1) for shift in (42, 21, 0)))


def letters(text: Column) -> Column:
    """Lower-case letters of a text, everything else as one blank, a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def profiles(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", grams: int = GRAMS) -> DataFrame:
    """(gram, lang, weight) of the most frequent trigrams, ties in their order; rows without a language are left out.

    Trigrams are counted within a batch of texts before they are shuffled, and once for all that is made of the counts.
    """
    shown = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("s"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                held, size = [], 0
                for keys in map(trigrams, part["s"]):
                    held.append(keys)
                    size += len(keys)
                    if size > KEYS_HELD:
                        yield counted(lang, held)
                        held, size = [], 0
                yield counted(lang, held)

    found = shown.mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = cut(found.select("lang", F.col("key").alias("gram"), "n"))  # numbers of trigrams are in the order of their texts
    most = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(grams).select("gram")
    kept = counts.join(most, "gram")
    totals = kept.groupBy("lang").agg(F.sum("n").alias("total")).crossJoin(most.agg(F.count("*").alias("size")))  # a row a language
    cells = most.crossJoin(totals).join(counts, ["lang", "gram"], "left")
    weight = F.log((F.coalesce("n", F.lit(0)) + SMOOTHING) / (F.col("total") + SMOOTHING * F.col("size")))
    return cells.select(spelled("gram").alias("gram"), "lang", weight.alias("weight"))


def guesser(profile: DataFrame):
    """A column function of a text: the likeliest language of ``profile``, null without a known trigram.

    The profile goes to each task: ``GRAMS`` rows a language.
    """
    rows = profile.toPandas()
    names = sorted(rows["lang"].unique())
    keys = np.array([trigrams(g)[0] for g in rows["gram"]], np.int64)
    known = np.unique(keys)
    weights = np.zeros((len(known), len(names)))
    weights[np.searchsorted(known, keys), [names.index(x) for x in rows["lang"]]] = rows["weight"]

    @F.pandas_udf(StringType())
    def likeliest(column: pd.Series) -> pd.Series:
        out = []
        for s in column:
            own = trigrams(s)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            at = at[known[at] == own] if len(known) else at[:0]
            out.append(names[int(np.round(np.bincount(at, minlength=len(known)) @ weights, 6).argmax())] if len(at) else None)
        return pd.Series(out, dtype="object")

    return likeliest


def language(text: Column, profile: DataFrame, least: int = 20) -> Column:
    """Language of a text, null for texts of under ``least`` characters or without a known trigram.

    A script of its own that makes up a fifth of the text or more decides; else the profile does.
    """
    held = F.coalesce(text, F.lit(""))
    out = F.when(F.length(held) < least, F.lit(None).cast("string"))
    for lang, script in SCRIPTS:
        out = out.when(F.regexp_count(held, F.lit(script)) * 5 >= F.length(held), lang)
    return out.otherwise(guesser(profile)(letters(text)))
