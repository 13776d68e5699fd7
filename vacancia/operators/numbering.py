"""Numbers by a global order, without a window that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancia.sources.shared import written


def numbered(rows: DataFrame, order: Sequence[str | Column], into: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their number from 1 in the order, in each group of ``by`` if given.

    Rows are sorted by ranges, each partition numbers its own, and what earlier partitions hold is added: a row a
    partition. Groups may be as large as they like.
    """
    at = f"_{into}_at"
    sorted_ = written(rows.orderBy(*by, *order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part, nth = F.shiftright(at, 33).alias("_part"), F.col(at).bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy(part).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = sorted_.withColumn("_part", part).join(F.broadcast(parts.drop("_n")), "_part").withColumn(into, F.col("_before") + nth + 1).drop("_part", "_before", at)  # a row a partition
    if not by:
        return placed
    keys = [F.col(k).alias(f"_{k}") for k in by]
    first = placed.groupBy(*keys).agg(F.min(into).alias("_first"))
    same = [placed[k].eqNullSafe(first[f"_{k}"]) for k in by]
    return placed.join(first, same).withColumn(into, F.col(into) - F.col("_first") + 1).select(*placed.columns)
