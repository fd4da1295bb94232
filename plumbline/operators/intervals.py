"""Joins of instants with intervals by time cells.

Intervals are cut into cells of fixed width; instants meet them on the cell, an
equi-join that is planned by size and split where a cell is hot, and the exact
ends are checked then. An instant lies in one cell, so no pair is met twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of a cell; an interval takes one row a cell that it touches.
CELL_SECONDS = 86_400


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def celled(spans: DataFrame, start: str, end: str, seconds: int = CELL_SECONDS) -> DataFrame:
    """``spans`` [start, end) once a cell that they touch, with ``_cell``, ``_low`` and ``_high`` (microseconds); empty ones have none."""
    width = seconds * 1_000_000
    timed = spans.withColumns({"_low": micros(F.col(start)), "_high": micros(F.col(end))}).where("_low < _high")
    cell = lambda c: F.floor(c / width).cast("long")
    return timed.withColumn("_cell", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high") - 1))))


def within(points: DataFrame, spans: DataFrame, at: str, start: str = "start", end: str = "end", on: tuple[str, ...] = (), seconds: int = CELL_SECONDS) -> DataFrame:
    """Pairs of points and the spans [start, end) that hold them, equal in ``on``; instants without a time are in none."""
    placed = points.withColumn("_at", micros(F.col(at))).withColumn("_cell", F.floor(F.col("_at") / (seconds * 1_000_000)).cast("long"))
    met = placed.join(celled(spans, start, end, seconds), ["_cell", *on])
    return met.where("_at >= _low AND _at < _high").drop("_cell", "_at", "_low", "_high")


def covered(points: DataFrame, spans: DataFrame, at: str, name: str, start: str = "start", end: str = "end", seconds: int = CELL_SECONDS) -> DataFrame:
    """``points``, each once, with ``name``: whether any span [start, end) holds its instant.

    The spans of a cell are one row's array: at most those that touch it.
    """
    cells = celled(spans.select(start, end), start, end, seconds).groupBy("_cell").agg(F.collect_list(F.struct("_low", "_high")).alias("_spans"))
    placed = points.withColumn("_at", micros(F.col(at))).withColumn("_cell", F.floor(F.col("_at") / (seconds * 1_000_000)).cast("long"))
    inside = F.exists("_spans", lambda s: (F.col("_at") >= s["_low"]) & (F.col("_at") < s["_high"]))
    return placed.join(cells, "_cell", "left").withColumn(name, F.coalesce(inside, F.lit(False))).drop("_cell", "_at", "_spans")
