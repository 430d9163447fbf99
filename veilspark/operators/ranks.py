"""Places in a global order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage

#: ``monotonically_increasing_id`` holds the partition above this many bits, the row below them.
_ROW_BITS = 33


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """*df* with its row's place in *order*, from 1, in a column *name*.

    Rows are cut into ranges of the order, each range is sorted by its task, and the
    sizes of the ranges before it are added; only these sizes, one row a range, meet in
    one task.  The sorted rows are written once, so that places cannot change when a
    task runs again.  Rows equal in all of *order* get places next to each other in no
    stated order; an empty *df* stays empty.
    """
    kept = df.columns
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = stage(ordered.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.shiftright(at, _ROW_BITS).alias("part"),
        at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("nth")), "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    # one row for each range, never more than there are shuffle partitions
    return placed.join(F.broadcast(starts), "part").select("row.*", (F.col("start") + F.col("nth") + 1).alias(name))
