"""Comparison of queries with all rows, a block of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, and rows that are compared with a block at once.
BLOCK_ROWS, SLICE_ROWS = 8192, 512


def against(rows: DataFrame, queries: DataFrame, compare: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, block_rows: int | None = None) -> DataFrame:
    """``compare`` (queries, their vectors, a block's rows, their vectors) for all queries and blocks of ``rows``.

    Both have columns ``id``, ``v`` and others of the same names. A task holds one
    block; queries go to every block and are read in slices.
    """
    blocks = max(1, -(-rows.count() // (block_rows or BLOCK_ROWS)))
    held = rows.withColumns({"blk": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "side": F.lit(0)})
    asked = queries.withColumns({"blk": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "side": F.lit(1)})
    both = held.unionByName(asked.select(*held.columns)).repartition("blk").sortWithinPartitions("blk", "side", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, x = None, [], None
        for batch in batches:
            for (blk, side), part in batch.groupby(["blk", "side"], sort=True):
                if blk != block:
                    block, parts, x = blk, [], None
                if side == 0:
                    parts.append(part)
                    continue
                if x is None:
                    own = pd.concat(parts, ignore_index=True) if parts else None
                    x = np.stack(own["v"].to_numpy()).astype(float) if parts else np.zeros((0, 0))
                for at in range(0, len(part) if len(x) else 0, SLICE_ROWS):
                    piece = part.iloc[at : at + SLICE_ROWS].reset_index(drop=True)
                    yield compare(piece, np.stack(piece["v"].to_numpy()).astype(float), own, x)

    return both.mapInPandas(run, schema)
