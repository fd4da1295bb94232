"""Typed answers: long to wide, averages of repeated draws, pluggable backends, cost before a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.patterns import TOPICS

ANSWER = "id long, question string, type string, value double, choice string, probabilities map<string,double>, confidence double"
# Questions of the first set with their type and number of levels.
QUESTIONS = {"informativeness": ("score", 4), "rating_support": ("score", 4), "topic": ("choice", 8), "spam_promo": ("noul", 0), "templated": ("noul", 0), "campaign_language": ("noul", 0)}
# Measured tokens of a call by question set, per character, and the factor of packed calls.
INTERCEPTS = {"v1": 893.1, "v2": 1139.1, "v3": 1270.1, "v4": 1403.1, "v5": 1553.1}
TOKENS_PER_CHAR, PACKED = 0.2445, 0.888
#: Columns of answers in one row: name, question, and a column of its answer or the names whose probabilities are added up.
WIDE = (
    ("informativeness", "informativeness", "value"), ("support", "rating_support", "value"), ("p_contradicts", "rating_support", ("0",)), ("spam", "spam_promo", "value"), ("templated", "templated", "value"), ("about_game", "about_game", "value"),
    ("influence", "influence_attempt", "value"), ("p_offtopic", "topic", ("off_topic", "joke_meme")), ("topic", "topic", "choice"), ("info_conf", "informativeness", "confidence"), ("support_conf", "rating_support", "confidence"), ("topic_conf", "topic", "confidence"),
)
#: States that are asked together.
ASKED = 2_000


def mock_answers(ids: list[int], seed: int = 7) -> pd.DataFrame:
    """Reproducible answers, seeded by (seed, id)."""
    rows, asked = [], []
    for q, (kind, levels) in QUESTIONS.items():
        names = list(TOPICS) if kind == "choice" else [str(k) for k in range(levels)]
        asked.append((q, kind, levels, names, np.full(len(names), 0.5) if kind == "choice" else np.linspace(1, 3, levels)))
    for i in ids:
        rng = np.random.default_rng([seed, int(i)])
        for q, kind, levels, names, shares in asked:
            if kind == "noul":
                rows.append((i, q, kind, round(float(rng.beta(1, 12)), 4), None, None, None))
                continue
            p = rng.dirichlet(shares)
            chosen = names[int(p.argmax())] if kind == "choice" else None
            value = None if kind == "choice" else round(float((p * np.arange(levels)).sum()), 4)
            rows.append((i, q, kind, value, chosen, {k: round(float(x), 4) for k, x in zip(names, p)}, round(float(rng.beta(5, 2)), 4)))
    return pd.DataFrame(rows, columns=["id", "question", "type", "value", "choice", "probabilities", "confidence"])


def judge(states: DataFrame, backend: Callable[[list[int]], pd.DataFrame] = mock_answers, key: str | None = None) -> DataFrame:
    """Answers in long form; with ``key`` rows of equal key are asked once and share the answers."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield backend(batch["id"].tolist())

    if key is None:
        return states.select("id").mapInPandas(ask, ANSWER)
    firsts = states.groupBy(key).agg(F.min("id").alias("id"))
    answers = firsts.select("id").mapInPandas(ask, ANSWER).withColumnRenamed("id", "first")
    members = states.select("id", key).join(firsts.withColumnRenamed("id", "first"), key).select("id", "first")
    return members.join(answers, "first").drop("first").select("id", "question", "type", "value", "choice", "probabilities", "confidence")


def wide(answers: DataFrame) -> DataFrame:
    """One row an id with the columns that decisions read; questions not asked are null."""
    of = lambda c: F.col(c) if isinstance(c, str) else sum((F.coalesce(F.try_element_at("probabilities", F.lit(k)), F.lit(0.0)) for k in c), F.lit(0.0))
    return answers.groupBy("id").agg(*[F.max(F.when(F.col("question") == q, of(c))).alias(name) for name, q, c in WIDE])


def wide_batch(answers: pd.DataFrame, ids: list[int]) -> pd.DataFrame:
    """``wide`` of all answers of some ids, a row for each id that has any."""
    there = pd.Index(ids).unique()
    there = there[there.isin(answers["id"])]
    by = {q: rows.set_index("id") for q, rows in answers.groupby("question", sort=False)}

    def of(q: str, column: pd.Series) -> pd.Series:
        if not column.index.is_unique:
            column = column[column.notna()].groupby(level=0).max()
        return column.reindex(there)

    out = {"id": there}
    for name, q, c in WIDE:
        if q not in by:
            out[name] = None
        elif isinstance(c, str):
            out[name] = of(q, by[q][c]).to_numpy()
        else:
            shares = [p if isinstance(p, dict) else {} for p in by[q]["probabilities"]]
            out[name] = of(q, pd.Series([sum((p.get(k) or 0.0 for k in c), 0.0) for p in shares], by[q].index)).to_numpy()
    return pd.DataFrame(out)


def judge_wide(states: DataFrame, backend: Callable[[list[int]], pd.DataFrame] = mock_answers) -> DataFrame:
    """``wide`` of ``judge`` for states whose ids are unique: a state's answers come together, so they are put in a row where they are made."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].tolist()
            for at in range(0, len(ids), ASKED):
                yield wide_batch(backend(ids[at : at + ASKED]), ids[at : at + ASKED])

    kinds = ", ".join(f"{name} {'string' if c == 'choice' else 'double'}" for name, _, c in WIDE)
    return states.select("id").mapInPandas(ask, f"id long, {kinds}")


def averaged(draws: DataFrame) -> DataFrame:
    """Mean answer of several draws: values, confidences and probabilities (a missing one is 0); the choice is the largest mean, of equals the first name."""
    keys = ["id", "question"]
    flat = draws.groupBy(*keys).agg(F.max("type").alias("type"), F.avg("value").alias("value"), F.avg("confidence").alias("confidence"), F.count("*").alias("k"))
    parts = draws.select(*keys, F.explode("probabilities").alias("name", "p")).groupBy(*keys, "name").agg(F.sum("p").alias("p"))
    mean = parts.join(flat.select(*keys, "k"), keys).withColumn("p", F.col("p") / F.col("k"))
    maps = mean.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "p")))).alias("probabilities"), F.min(F.struct((-F.col("p")).alias("m"), "name")).alias("best"))
    out = flat.join(maps, keys, "left")
    return out.select(*keys, "type", "value", F.when(F.col("type") == "choice", F.col("best.name")).alias("choice"), "probabilities", "confidence")


def preflight(states: DataFrame, state: Column, question_set: str = "v5", samples: int = 1, pack: int = 1, price: float = 1.0, reuse: bool = False) -> DataFrame:
    """One row: reviews, calls, distinct inputs, mean length, tokens and cost of a run before it starts."""
    seen = states.select(F.length(state).alias("n"), F.sha2(state, 256).alias("h"))
    out = seen.agg(F.count("*").alias("reviews"), F.count_distinct("h").alias("distinct_inputs"), F.avg("n").alias("chars"))
    calls = (F.col("distinct_inputs") if reuse else F.col("reviews")) * samples
    per_call = (F.lit(INTERCEPTS[question_set]) + TOKENS_PER_CHAR * F.col("chars")) * (PACKED if pack > 1 else 1.0)
    return out.withColumn("calls", calls).withColumn("tokens", F.floor(F.col("calls") * per_call).cast("long")).withColumn("cost", F.col("tokens") * price / 1e6)
