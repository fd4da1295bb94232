"""Model judgments around the backend: question sets, states, calls, decoding, reuse, stability and cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.drilldown import drawn_order
from plumbline.operators.running import running_sums

# Questions by set, each set with those of the one before; type, and number of levels or choices.
FIRST_SET = (("informativeness", "score", 4), ("rating_support", "score", 4), ("topic", "choice", 8), ("spam_promo", "noul", 0), ("templated", "noul", 0), ("campaign_language", "noul", 0))
ADDED = {"v1": (), "v2": (), "v3": (("about_game", "noul", 0),), "v4": (("verdict_basis", "noul", 0),), "v5": (("influence_attempt", "noul", 0),)}
DEFAULT_SET = "v5"
#: A run stops once it has cost this share of its estimate.
SPEND_LIMIT = 1.25
#: States in one batch of calls.
BATCH = 50
#: Statuses of a service that are asked again, and how often a call is tried.
RETRIED = (429, 500, 502, 503, 504, 529)
ATTEMPTS = 6
SEP = "__"
ANSWER = "type string, noul double, score double, choice string, probabilities map<string,double>, confidence double"


def question_set(version: str = DEFAULT_SET) -> tuple[tuple[str, str, int], ...]:
    """(name, type, levels) of a set's questions, in order."""
    out = list(FIRST_SET)
    for v, more in ADDED.items():
        out += more
        if v == version:
            return tuple(out)
    raise KeyError(f"no question set {version!r}")


def score_levels(version: str = DEFAULT_SET) -> dict[str, int]:
    return {name: n for name, kind, n in question_set(version) if kind == "score"}


def registry(spark: SparkSession) -> DataFrame:
    """(version, place, question, type, levels) of all sets."""
    rows = [(v, k, *q) for v in ADDED for k, q in enumerate(question_set(v))]
    return spark.createDataFrame(rows, "version string, place int, question string, type string, levels int")


def state(subject: Column | str, verdict: Column, text: Column, store: bool = False) -> Column:
    """What a model is shown of a review: context, verdict in words, text."""
    subject = F.lit(subject) if isinstance(subject, str) else subject
    context = F.concat(F.lit("Store review of '" if store else "Review of '"), subject, F.lit("'."))
    return F.struct(context.alias("context"), verdict.alias("verdict"), text.alias("review"))


def input_key(shown: Column) -> Column:
    """Digest of a state with its fields in name order: equal for equal input."""
    return F.sha2(F.to_json(F.struct(shown["context"].alias("context"), shown["review"].alias("review"), shown["verdict"].alias("verdict"))), 256)


def decoded(raw: Column) -> Column:
    """A typed answer from JSON text.

    An unknown type raises; probabilities are keyed by text; the confidence of a
    yes-or-no answer is dropped, as not all services give one.
    """
    a = F.from_json(raw, ANSWER)
    kind = a["type"]
    known = F.when(kind.isin("noul", "score", "choice"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown answer type: "), F.coalesce(kind, F.lit("null")))).cast("string"))
    value = F.when(kind == "noul", a["noul"]).when(kind == "score", a["score"])
    confidence = F.when(kind != "noul", a["confidence"])
    return F.struct(known.alias("type"), value.alias("value"), F.when(kind == "choice", a["choice"]).alias("choice"), a["probabilities"].alias("probabilities"), confidence.alias("confidence"))


def missing_questions(answered: Column, version: str = DEFAULT_SET) -> Column:
    """Names of a set's questions that are not among ``answered`` (array), by name."""
    return F.array_sort(F.array_except(F.array(*[F.lit(q[0]) for q in question_set(version)]), answered))


def packed(states: DataFrame, size: int, id_col: str = "id") -> DataFrame:
    """(call, ids, keys): calls of ``size`` consecutive states each; ``keys`` is each state's prefix in the call's questions."""
    place = F.col(id_col) % size
    rows = states.select(F.floor(F.col(id_col) / size).cast("long").alias("call"), F.struct(place.alias("at"), F.col(id_col).alias("id")).alias("s"))
    calls = rows.groupBy("call").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most ``size`` a call
    return calls.select("call", F.transform("s", lambda x: x["id"]).alias("ids"), F.transform("s", lambda x, i: F.concat(F.lit("r"), i.cast("string"))).alias("keys"))


def retargeted(instructions: Column, key: Column, fields: tuple[str, ...] = ("context", "verdict", "review")) -> Column:
    """Instructions whose quoted field names point into one state of a packed call."""
    place = F.concat(F.lit("`reviews["), F.substring(key, 2, 9), F.lit("]."))
    for f in fields:
        instructions = F.replace(instructions, F.lit(f"`{f}`"), F.concat(place, F.lit(f"{f}`")))
    return instructions


def unpacked(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, question, answer) from answers (call, key, answer) whose key is a state's prefix and a question."""
    states = calls.select("call", F.explode(F.arrays_zip("ids", "keys")).alias("s")).select("call", F.col("s.ids").alias("id"), F.col("s.keys").alias("r"))
    parts = F.split("key", SEP, 2)
    return answers.select("call", parts[0].alias("r"), parts[1].alias("question"), "answer").join(states, ["call", "r"]).select("id", "question", "answer")


def fake_unit(question: Column, shown: Column) -> Column:
    """A number in [0, 1) from the digest of question and state, the same in any engine."""
    digest = F.sha2(F.concat(question, F.lit("|"), shown), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def fake_answers(states: DataFrame, version: str = DEFAULT_SET, id_col: str = "id", state_col: str = "state") -> DataFrame:
    """Reproducible answers (id, question, type, value) for tests: yes-or-no below 0.2, scores over their levels."""
    questions = F.array(*[F.struct(F.lit(n).alias("question"), F.lit(k).alias("type"), F.lit(v).alias("levels")) for n, k, v in question_set(version) if k != "choice"])
    rows = states.select(F.col(id_col).alias("id"), F.col(state_col).alias("state"), F.explode(questions).alias("q"))
    u = fake_unit(F.col("q.question"), F.col("state"))
    return rows.select("id", "q.question", "q.type", F.when(F.col("q.type") == "noul", 0.2 * u).otherwise(u * (F.col("q.levels") - 1)).alias("value"))


class CachedAnswers:
    """Answers of a finished run, given again at no cost.

    ``runs``: id, dataset_id, question_set, status; ``judgments``: run_id, id,
    question, type, value, choice, probabilities, confidence. The run must be
    there, done, on the same dataset and question set, and hold answers.
    """

    def __init__(self, runs: DataFrame, judgments: DataFrame, source: str, dataset: str, version: str):
        run = runs.where(F.col("id") == source).select("dataset_id", "question_set", "status").take(1)
        if not run:
            raise ValueError(f"source run {source} not found")
        if run[0].status != "done":
            raise ValueError(f"source run {source} is {run[0].status}, not done")
        if run[0].dataset_id != dataset:
            raise ValueError("source run is on another dataset")
        if run[0].question_set != version:
            raise ValueError(f"source run used question set {run[0].question_set}, not {version}")
        self.answers = judgments.where(F.col("run_id") == source).drop("run_id")
        if self.answers.isEmpty():
            raise ValueError("source run has no judgments")

    def judge(self, states: DataFrame) -> DataFrame:
        """Long answers of the states' ids; ids without any raise when the plan runs."""
        asked = states.select("id").distinct()
        joined = asked.join(self.answers, "id", "left")
        there = F.when(F.col("question").isNotNull(), F.col("question")).otherwise(F.raise_error(F.concat(F.lit("no cached judgment of review "), F.col("id").cast("string"))).cast("string"))
        return joined.withColumn("question", there)


def spending(calls: DataFrame, estimate: float, price: float, batch: int = BATCH) -> DataFrame:
    """(batch, calls, tokens, spent, goes_on) over calls (id, tokens) in order of id: a run goes on while it has cost at most ``SPEND_LIMIT`` of the estimate.

    Batches are summed first, then accumulated in two levels.
    """
    per = calls.groupBy(F.floor(F.col("id") / batch).cast("long").alias("batch")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    per = running_sums(per.withColumn("upto", F.col("tokens")), "batch", ["upto"])
    return per.withColumn("spent", F.col("upto") * F.lit(price) / F.lit(1e6)).drop("upto").withColumn("goes_on", F.col("spent") <= SPEND_LIMIT * estimate)


def asked(states: DataFrame, ask: Callable[[dict], tuple[int, dict]], wait: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> DataFrame:
    """(id, status, retries, latency_ms, tokens, answers) of calls made inside tasks, one a state (id, state).

    ``ask`` takes a state and gives a status and a body; a status in ``RETRIED``
    is tried again after growing pauses. Answers are a map of JSON texts.
    """
    import json

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, shown in zip(batch["id"], batch["state"]):
                for n in range(attempts):
                    began = time.perf_counter()
                    status, body = ask(json.loads(shown))
                    ms = (time.perf_counter() - began) * 1000
                    if status not in RETRIED:
                        break
                    if n + 1 < attempts:
                        wait(min(30.0, 0.5 * 2**n))
                answers = {q: json.dumps(a) for q, a in body.get("answers", {}).items()} if status == 200 else {}
                out.append((id_, status, n, ms, int(body.get("usage", {}).get("input_tokens", 0)), answers))
            yield pd.DataFrame(out, columns=["id", "status", "retries", "latency_ms", "tokens", "answers"])

    return states.select("id", "state").mapInPandas(call, "id long, status int, retries int, latency_ms double, tokens long, answers map<string,string>")


def call_summary(calls: DataFrame, price: float = 1.0, *by: str) -> DataFrame:
    """Requests, retries, latency percentiles (interpolated), tokens and cost of calls (latency_ms, retries, tokens)."""
    p = lambda q: F.round(F.percentile("latency_ms", F.lit(q)).cast("decimal(18,6)"), 1).cast("double")
    return calls.groupBy(*by).agg(F.count("*").alias("requests"), F.sum("retries").alias("retries"), p(0.5).alias("latency_p50_ms"), p(0.95).alias("latency_p95_ms"), F.sum("tokens").alias("tokens"), (F.sum("tokens") * price / 1e6).alias("cost"))


def throughput(calls: DataFrame, *by: str, rows: int = 50_000) -> DataFrame:
    """Rows, wall seconds (start, seconds), rows a second, median and the latency at place int(0.95 (n - 1)), tokens a row, and hours for ``rows`` rows."""
    end = F.max(F.col("start") + F.col("seconds")) - F.min("start")
    ordered = calls.groupBy(*by, "seconds").agg(F.count("*").alias("m"), F.min("start").alias("first"), F.max(F.col("start") + F.col("seconds")).alias("last"), F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*by).orderBy("seconds")
    placed = ordered.withColumn("upto", F.sum("m").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    sums = placed.groupBy(*by).agg(F.sum("m").alias("n"), (F.max("last") - F.min("first")).alias("wall"), F.sum("tokens").alias("tokens"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("n") - 1)), F.col("seconds")))
    both = (placed.join(sums.select(*by, "n"), list(by)) if by else placed.crossJoin(F.broadcast(sums.select("n")))).groupBy(*by).agg(at(F.lit(0.5)).alias("median"), at(F.lit(0.95)).alias("p95"))
    out = sums.join(both, list(by)) if by else sums.crossJoin(both)
    rate = F.col("n") / F.nullif("wall", F.lit(0.0))
    return out.select(*by, F.col("n").alias("rows"), "wall", rate.alias("rows_per_s"), "median", "p95", (F.col("tokens") / F.col("n")).alias("tokens_per_row"), (F.lit(rows) / rate / 3600).alias("hours_for_all"))


def determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: states, how many got identical answers twice, their share, and the largest numeric difference (long answers)."""
    names = ["type", "value", "choice", "confidence"]
    a, b = (d.select("id", "question", *[F.col(n).alias(f"{n}{k}") for n in names]) for k, d in ((1, first), (2, second)))
    joined = a.join(b, ["id", "question"])
    same = F.lit(True)
    for n in names:
        same = same & F.col(f"{n}1").eqNullSafe(F.col(f"{n}2"))
    delta = F.greatest(F.coalesce(F.abs(F.col("value1") - F.col("value2")), F.lit(0.0)), F.coalesce(F.abs(F.col("confidence1") - F.col("confidence2")), F.lit(0.0)))
    per = joined.groupBy("id").agg(F.bool_and(same).alias("same"), F.max(delta).alias("delta"))
    return per.agg(F.count("*").alias("states"), F.count_if("same").alias("identical"), F.avg(F.col("same").cast("double")).alias("share"), F.max("delta").alias("max_delta"))


def retest(draws: DataFrame) -> DataFrame:
    """(question, states, mean_sd, max_sd): spread of a state's repeated values (id, question, draw, value), population SD."""
    per = draws.groupBy("id", "question").agg(F.stddev_pop("value").alias("sd"))
    return per.groupBy("question").agg(F.count("*").alias("states"), F.avg("sd").alias("mean_sd"), F.max("sd").alias("max_sd"))


def choice_stability(draws: DataFrame) -> DataFrame:
    """(question, share): states whose choice (id, question, draw, choice) is the same in all draws."""
    per = draws.where("choice IS NOT NULL").groupBy("id", "question").agg((F.count_distinct("choice") == 1).cast("double").alias("same"))
    return per.groupBy("question").agg(F.count("*").alias("states"), F.avg("same").alias("share"))


def disjoint_groups(draws: DataFrame, k: int, trials: int = 1, seed: int = 0) -> DataFrame:
    """``draws`` (id, draw, ...) by trial and side: for each trial, two disjoint groups of ``k`` draws of every id, drawn by digest."""
    numbers = draws.groupBy("id").agg(F.collect_set("draw").alias("draws"))  # a state's draws are few
    order = lambda d: drawn_order(F.concat_ws("|", "trial", "id", d), seed)
    sorted_ = F.array_sort(F.transform("draws", lambda d: F.struct(order(d).alias("o"), d.alias("draw"))))
    placed = numbers.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).select("id", "trial", F.posexplode(F.slice(sorted_, 1, 2 * k)).alias("place", "d"))
    return draws.join(placed.select("id", F.col("d.draw").alias("draw"), "trial", F.when(F.col("place") < k, "a").otherwise("b").alias("side")), ["id", "draw"])


def flip_rate(decided: DataFrame) -> DataFrame:
    """One row: pairs of independent decisions (id, trial, side, action, score), how many differ in action, and the mean difference of scores."""
    a, b = (decided.where(F.col("side") == s).select("id", "trial", F.col("action").alias(f"x{s}"), F.col("score").alias(f"s{s}")) for s in ("a", "b"))
    joined = a.join(b, ["id", "trial"])
    differs = (F.col("xa") != F.col("xb")).cast("double")
    return joined.agg(F.count("*").alias("pairs"), F.avg(differs).alias("flip_rate"), F.avg(F.abs(F.col("sa") - F.col("sb"))).alias("mean_delta"))
