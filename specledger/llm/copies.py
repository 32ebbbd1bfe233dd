"""Joining rows to their groups of equal rows, where one group may hold a large part of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A group with more than one in so many rows is joined by broadcast: there are fewer than that many of those, whatever the size of the table.
HOT = 5000


def join_copies(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a stored table of one row per ``key`` and its number of ``copies``: large groups by broadcast, others by shuffle."""
    total = groups.agg(F.sum("copies").alias("n")).first()["n"] or 0
    large = F.col("copies") * HOT > total
    hot = groups.filter(large)
    near = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(~large), key)
    return near.unionByName(rest)
