"""Progressive decisions: batches of judged reviews, the last update of each id wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.config import Bursts
from plumbline.operators.bursts import robust_z


def last_write(updates: DataFrame, key: str = "id", seq: str = "seq", value: str = "action") -> DataFrame:
    """(id, action): the update with the highest sequence number; works on batches and, in complete mode, on streams."""
    return updates.groupBy(key).agg(F.max_by(value, seq).alias(value))


def counters(updates: DataFrame) -> DataFrame:
    """(action, n) over the last updates of a batch table."""
    return last_write(updates).groupBy("action").agg(F.count("*").alias("n"))


def hourly_counts(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """(verdict, hour, n) of a stream of reviews; hours close once the watermark has passed them."""
    verdict = F.when(F.col("rating_norm") >= 0.5, "positive").otherwise("negative")
    windowed = stream.where("rating_norm IS NOT NULL").withWatermark("created_at", delay).groupBy(verdict.alias("verdict"), F.window("created_at", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return windowed.select("verdict", F.col("w.start").alias("hour"), "n")


def flag_hours(hours: DataFrame, cfg: Bursts = Bursts()) -> DataFrame:
    """(verdict, hour, n, z, flagged) of a stream of hourly counts in time order.

    The state of a verdict is the trailing history of unflagged counts; flagged
    hours never enter it. Hours missing between two counts count as empty.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past, last = list(state.get[0]) if state.exists else [], state.get[1] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("hour")
        out = []
        for hour, n in zip(rows["hour"], rows["n"]):
            at = int(pd.Timestamp(hour).timestamp() // 3600)
            if last is not None and at <= last:
                continue
            gap = min(max(0, at - last - 1), cfg.baseline_hours) if last is not None else 0
            past = (past + [0.0] * gap)[-cfg.baseline_hours :]
            z, flagged, _ = robust_z(pd.Series([*past, float(n)]).to_numpy(), _only_last(cfg, len(past)))
            if not flagged[-1]:
                past = [*past, float(n)][-cfg.baseline_hours :]
            last = at
            out.append((key[0], hour, int(n), float(z[-1]), bool(flagged[-1])))
        state.update((past, last if last is not None else -1))
        yield pd.DataFrame(out, columns=["verdict", "hour", "n", "z", "flagged"])

    return hours.groupBy("verdict").applyInPandasWithState(step, "verdict string, hour timestamp, n long, z double, flagged boolean", "past array<double>, last long", "append", GroupStateTimeout.NoTimeout)


def _only_last(cfg: Bursts, held: int) -> Bursts:
    """Settings under which only the newest of ``held + 1`` counts is judged: the held ones are unflagged already."""
    from dataclasses import replace

    return replace(cfg, min_history=max(cfg.min_history, held)) if held >= cfg.min_history else replace(cfg, min_history=held + 2)
