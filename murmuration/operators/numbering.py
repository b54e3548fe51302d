"""Numbers from 0 in a given order, for any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_table


def number_rows(rows: DataFrame, order: list[str], out: str, label: str = "numbered") -> DataFrame:
    """``rows`` with ``out``: the position of each row by the columns ``order``, which tell all rows apart.

    Rows are range-partitioned, sorted and written; a row's number is its place in its partition plus the rows of
    the partitions before, of which there is one count each.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    table = write_table(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), label).df
    counts = table.groupBy("_part").agg(F.count("*").alias("n"), F.min("_place").alias("base"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", (before - F.col("base")).alias("_shift"))
    return table.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")
