"""Pairing rows of two tables by nearest time, with one shuffle and no Python.

Both tables are put under one another, sorted per entity and time, and each left row takes the last right row
before it and the next one after it; the nearer within the tolerance wins. An entity may hold a third of all rows:
as a partner lies within the tolerance, the sort runs per entity and slice of time, and a right row near the edge
of a slice is also placed in the neighbouring one, so that at most two copies of it are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def match_nearest(left: DataFrame, right: DataFrame, tolerance: float, slice_width: float = 20.0) -> DataFrame:
    """The nearest right row of each left row.

    ``left`` and ``right`` have ``entity string, time double, id bigint``; other columns are not read, whatever
    their names. Rows with a null in one of the three, or a time that is not finite, take no part. Rows that repeat
    (same entity, time and id) count once. The result is ``left_id, right_id, gap`` with one row for each left row
    that has a right row of the same entity with ``abs(left time - right time) <= tolerance``: the nearest; of two
    equally near ones the earlier, of two at the same time the one with the smaller id. Left rows without such a
    partner give no row; an empty table on either side gives an empty result.
    """
    if tolerance < 0 or slice_width <= 0:
        raise ValueError("tolerance must not be negative and slice_width must be positive")
    width = max(float(slice_width), 4.0 * tolerance)
    reach = tolerance * (1 + 1e-9) + 1e-9  # wider than the tolerance, which is applied exactly below

    def side(df: DataFrame, flag: int, slices: Column) -> DataFrame:
        rows = df.select(F.col("entity").cast("string").alias("entity"), F.col("time").cast("double").alias("time"), F.col("id").cast("bigint").alias("id"))
        rows = rows.where("entity is not null and id is not null and time is not null and not isnan(time) and abs(time) < double('Infinity')")
        return rows.select("entity", F.explode(slices).alias("slice"), "time", F.lit(flag).alias("side"), "id")

    def at(t: Column) -> Column:
        return F.floor(t / F.lit(width))

    time = F.col("time")
    both = side(right, 0, F.array_distinct(F.array(at(time - reach), at(time + reach)))).union(side(left, 1, F.array(at(time))))
    w = Window.partitionBy("entity", "slice").orderBy("time", "side", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of right rows at one time only the first, which has the smallest id, is a candidate; this also drops repeats.
    first = both.select("*", F.lag("time").over(w).alias("t0"), F.lag("side").over(w).alias("s0"), F.lag("id").over(w).alias("i0"))
    candidate = F.expr("case when side = 0 and not (s0 <=> 0 and t0 <=> time) then struct(time as t, id as i) end")
    repeat = F.expr("side = 1 and s0 <=> 1 and t0 <=> time and i0 <=> id")
    marked = first.select("entity", "slice", "time", "side", "id", candidate.alias("c"), repeat.alias("repeat"))
    carried = marked.select("time", "side", "id", "repeat", F.last("c", ignorenulls=True).over(so_far).alias("before"), F.expr("lead(c) ignore nulls over (partition by entity, slice order by time, side, id)").alias("after"))
    gap_before, gap_after = F.col("time") - F.col("before.t"), F.col("after.t") - F.col("time")
    take_after = F.col("before").isNull() | (gap_after < gap_before)
    chosen = carried.where("side = 1 and not repeat").select(F.col("id").alias("left_id"), F.when(take_after, F.col("after.i")).otherwise(F.col("before.i")).alias("right_id"), F.when(take_after, gap_after).otherwise(gap_before).alias("gap"))
    return chosen.where((F.col("right_id").isNotNull()) & (F.col("gap") <= F.lit(float(tolerance))))
