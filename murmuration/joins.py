"""A join whose keys may be of very uneven size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on its row of the other table is sent to all tasks.
HOT_ROWS = 1_000_000


def join_sized(rows: DataFrame, table: DataFrame, keys: list[str], n: str, most: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and, in ``n``, the number of rows with the key.

    A null key equals a null key; rows whose key ``table`` lacks are left out. Rows of a key with more than ``most`` of
    them stay where they are, and the key's row of ``table`` is sent to all tasks: there are no more of these than one
    for each ``most`` rows. The rest meet by a shuffle, in which no key is large. ``rows`` is read three times, so it
    should be a written table. Other columns that both have must differ in name.
    """
    named = table.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c) for c in table.columns if c not in keys))
    same: Column = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys))
    hot, cold = named.where(F.col(n) > most), named.where(F.col(n) <= most)
    few = rows.join(F.broadcast(hot.select(*(f"_{k}" for k in keys))), same, "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(few.join(cold, same)).drop(*(f"_{k}" for k in keys))
