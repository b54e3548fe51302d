"""One group identifier for all records that are linked directly or indirectly: hash-to-min over edges.

In each round every vertex sends its cluster set to the set's smallest member, and that member to all others of
the set. A cluster set is never gathered into one row: it is the rows of an edge table, and a round is a minimum
per vertex (combined before the shuffle), a join and a distinct. The sets of neighbours are symmetric, so an edge
is stored once, smaller id first. When every edge touches the minimum of its other end, the sets are stable.
Most groups are stable long before the one with the longest chain: as the rows that are not become few, groups that
are whole stars leave the table, so that later rounds are about the rest alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import Table, write_table


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", id_col: str = "id", group_col: str = "group_id", max_rounds: int = 100) -> DataFrame:
    """``id_col, group_col`` for every id that is an end of at least one link.

    The group of an id is the smallest id linked with it directly or indirectly, itself included. Direction,
    repeated links and extra columns do not matter; links with a null end and links of an id with itself do not
    count. No links give an empty result. Each round is written to the shared folder, so a lost executor costs
    one round at most. The number of rounds is logarithmic in the longest chain in practice; an error is raised
    if ``max_rounds`` do not suffice, and no wrong result is returned.
    """
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where((F.col(src).isNotNull()) & F.col(dst).isNotNull() & (F.col("a") < F.col("b"))).distinct()
    table = write_table(edges, "links")
    if table.df.isEmpty():
        return table.df.select(F.col("b").alias(id_col), F.col("a").alias(group_col))
    done: list[DataFrame] = []
    few = 0.25  # share of open rows at which stars are taken out, four times smaller each time
    for _ in range(max_rounds):
        sent = table.df.select(F.explode(F.expr("array(struct(a as v, b as u), struct(b as v, a as u))")).alias("e")).select("e.v", "e.u")
        least = sent.groupBy("v").agg(F.min("u").alias("u0")).select("v", F.least("v", "u0").alias("m"))
        joined = sent.join(least, "v")
        seen = Observation()
        joined = joined.observe(seen, F.count(F.when((F.col("v") != F.col("m")) & (F.col("u") != F.col("m")), 1)).alias("open"), F.count(F.lit(1)).alias("rows"))
        out = joined.select(F.explode(F.expr("array(struct(m as a, u as b), struct(m as a, v as b))")).alias("e")).select("e.a", "e.b").where("a < b").distinct()
        following = write_table(out, "links")
        table.drop()
        table = following
        counts = seen.get
        if counts["open"] and counts["open"] < few * counts["rows"]:
            few /= 4
            settled, rest = _parted(table.df)
            done.append(settled.df)
            table.drop()
            table = rest
        if not counts["open"] or table.df.isEmpty():
            stars = reduce(DataFrame.union, done, table.df)
            return stars.select(F.col("b").alias(id_col), F.col("a").alias(group_col)).union(stars.select("a", "a").distinct())
    raise RuntimeError(f"the groups are not stable after {max_rounds} rounds")


def _parted(edges: DataFrame) -> tuple[Table, Table]:
    """The edges ``a, b`` of groups that are whole stars around their smallest id, and the others.

    A star's centre is no edge's larger end, and each of its other ends is in one edge only. Centres with another end
    that is not, and ids that are both kinds of ends, are marked; what is left are stars."""
    ends = edges.select(F.explode(F.expr("array(struct(a as v, 0 as larger), struct(b as v, 1 as larger))")).alias("e")).select("e.*")
    kinds = ends.groupBy("v").agg(F.count("*").alias("n"), F.sum("larger").alias("as_b"))
    mixed = kinds.where("as_b > 0 and n > 1").select("v")
    open_centres = edges.join(mixed, F.col("b") == F.col("v"), "left_semi").select(F.col("a").alias("v")).union(mixed).distinct()
    marked = write_table(edges.join(open_centres.withColumn("open", F.lit(True)), F.col("a") == F.col("v"), "left").select("a", "b", F.coalesce("open", F.lit(False)).alias("open")), "parted")
    parts = [write_table(marked.df.where(c).select("a", "b"), "links") for c in ("not open", "open")]
    marked.drop()
    return parts[0], parts[1]


def countable_links(edges: DataFrame, low: float = 0.5, high: float = 1.0) -> DataFrame:
    """Links with two different non-null ends and a weight from ``low`` to ``high``; null and NaN weights fail."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & ~F.isnan("weight") & F.col("weight").between(low, high)).select("src", "dst")
