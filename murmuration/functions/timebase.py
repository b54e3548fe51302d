"""Seconds and frames of 20 ms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_MS = 20


def seconds_to_frames(seconds: Column) -> Column:
    """Frame number of a time: the quotient is rounded to one decimal, half to even, then to the nearest whole
    number, half up. Null stays null. ``rint`` of ten times the quotient is used, as ``bround`` differs from it on
    quotients that have no exact binary form."""
    tenths = F.rint(seconds.cast("double") / F.lit(float(FRAME_MS)) * F.lit(1000.0) * F.lit(10.0))
    return F.floor(tenths / F.lit(10.0) + F.lit(0.5)).cast("int")


def frames_to_seconds(frames: Column) -> Column:
    """Time of a frame in seconds, to two decimals. Null stays null."""
    return F.round(frames * F.lit(float(FRAME_MS)) / F.lit(1000.0), 2)
