"""Rank-frequency tables of tokens and of cluster sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_table

# Labels that are no tokens.
STOPLIST = ("", "<unk>", "sp", "sil", "spn")


def clean_tokens(intervals: DataFrame, tier: str = "words", drop_blank: bool = False) -> DataFrame:
    """``intervals`` of one tier with ``token``: the label stripped, in lower case, without digits. Labels that are
    null or on the stoplist are left out. A label of digits alone becomes an empty token, which stays unless
    ``drop_blank``."""
    stripped = F.lower(F.regexp_replace("label", r"(?U)^\s+|\s+$", ""))
    token = F.regexp_replace(stripped, r"(?U)\d+", "")
    rows = intervals.where((F.col("tier") == tier) & F.col("label").isNotNull() & ~stripped.isin(*STOPLIST)).withColumn("token", token)
    return rows.where("token <> ''") if drop_blank else rows


def token_counts(tokens: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``token, cnt``."""
    return tokens.groupBy(*(keys or []), "token").agg(F.count("*").alias("cnt"))


def rank_frequency(counts: DataFrame, item: str, keys: list[str] | None = None) -> DataFrame:
    """``item, cnt, rank, prob``: rank from 1 by falling count, then by item; ``prob`` is the share of the total.

    The different items may be very many: they are range-partitioned in rank order, numbered within partitions,
    and the numbers of the partitions before, one row a partition and key, are added.
    """
    keys = keys or []
    order = [*keys, "neg", item]
    ranged = counts.select(*keys, item, "cnt", (-F.col("cnt")).alias("neg")).repartitionByRange(*order).withColumn("pid", F.spark_partition_id())
    table = write_table(ranged, "ranks").df
    parts = table.groupBy(*keys, "pid").agg(F.count("*").alias("n"), F.sum("cnt").alias("s"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*keys, "pid", before.alias("offset"), F.sum("s").over(Window.partitionBy(*keys)).alias("total"))
    local = F.row_number().over(Window.partitionBy(*keys, "pid").orderBy("neg", item))
    joined = table.withColumn("local", local).join(offsets, [*keys, "pid"])
    return joined.select(*keys, item, "cnt", (F.col("local") + F.col("offset")).cast("int").alias("rank"), (F.col("cnt") / F.col("total")).alias("prob"))


def extent(ranks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``max_prob, max_rank``: what spans the axes of a rank-frequency plot."""
    return ranks.groupBy(*(keys or [])).agg(F.max("prob").alias("max_prob"), F.max("rank").alias("max_rank"))


def reference_curve(span: DataFrame, points: int = 100, factor: float = 1.2) -> DataFrame:
    """``i, r, p``: ``points`` ranks at equal steps of their logarithm from 1 to the largest rank, and the curve
    ``factor * largest probability / r``."""

    def step(i: Column) -> Column:
        return F.pow(F.lit(10.0), F.log10(F.col("max_rank").cast("double")) * i / F.lit(float(max(points - 1, 1))))

    rows = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return rows.select("i", step(F.col("i")).alias("r"), (F.lit(factor) * F.col("max_prob") / step(F.col("i"))).alias("p"))


def plotted_runs(runs: DataFrame) -> DataFrame:
    """The runs that take part in a comparison: those whose name has neither ``knn`` nor ``edit``, and a method
    that is known; in order of threshold, those without one last. ``runs`` is ``sources.files.run_metadata``'s."""
    name = F.col("stem")
    return runs.where(~name.contains("knn") & ~name.contains("edit") & F.col("run_method").isNotNull()).orderBy(F.col("run_threshold").asc_nulls_last(), "path")
