"""Lag over an ordered group without one task per group.

A plain window sorts each group in one task.  Here a group is cut into chunks
(leading parts of the sort order), a lag runs inside each chunk, and the last
value of every chunk is carried to the next one.  The plan is the same for all
groups and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_value(df: DataFrame, keys: list[str], chunk: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the preceding row of the group.

    ``keys`` and ``chunk`` must not hold nulls; rows are ordered by ``chunk``
    and then ``order``.
    """
    cells = [*keys, *chunk]
    inside = Window.partitionBy(*cells).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*chunk)
    marked = df.withColumns({"_first": F.row_number().over(inside) == 1, "_inner": F.lag(value).over(inside)})
    # One row per chunk; a group's chunks are few against its rows.
    ends = df.groupBy(*cells).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = ends.select(*cells, F.lag("_end").over(across).alias("_carried"))
    return (
        marked.join(carried, cells)
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inner")))
        .drop("_first", "_inner", "_carried")
    )
