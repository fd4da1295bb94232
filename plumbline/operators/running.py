"""Running sums in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places that are summed together.
BLOCK = 4096


def running_sums(rows: DataFrame, place: str, names: list[str], inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """``rows`` with the named columns replaced by their sums over all rows up to each one's ``place``, a whole number; nulls add nothing.

    Rows are summed within blocks of places and moved by the sums of the blocks
    before, so one task orders a row a block, not the rows. Without ``inclusive``
    a row's own place is left out.
    """
    cut = rows.withColumn("_block", F.floor(F.col(place) / block).cast("long"))
    totals = cut.groupBy("_block").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_block", *[F.sum(f"_{n}").over(ahead).alias(f"_{n}") for n in names])
    own = Window.partitionBy("_block").orderBy(place).rangeBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    summed = cut.withColumns({n: F.sum(n).over(own) for n in names}).join(starts, "_block")
    both = lambda n: F.when(F.col(n).isNull(), F.col(f"_{n}")).when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(F.col(n) + F.col(f"_{n}"))
    return summed.withColumns({n: both(n) for n in names}).drop("_block", *[f"_{n}" for n in names])
