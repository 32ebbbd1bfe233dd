"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Rows one task may take for one key. The list of keys above it has at most rows/HOT_ROWS entries,
# which bounds what is broadcast below.
HOT_ROWS = 2_000_000
NULL_SLOTS = 1024


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "left",
                counts: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``big`` to ``small`` (at most one row per key) on ``keys``.

    Keys with more than ``hot_rows`` rows in ``big`` are split into slots by a hash of the ``spread`` columns, and
    only their rows in ``small`` are repeated once per slot. Rows with a null key match nothing and are spread too.
    ``counts`` (keys and ``n_rows``) may be passed when they are known already.
    """
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    # With a hint: the list is short (see above), but the planner takes it for as large as ``counts`` and would shuffle ``big`` for it, and again for its slots.
    hot = F.broadcast(counts.filter(F.col("n_rows") > hot_rows).select(
        *keys, F.ceil(F.col("n_rows") / F.lit(hot_rows)).cast("int").alias("_slots")))
    null_key: Column = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    noise = F.xxhash64(*[F.col(f"`{c}`") for c in spread])
    left = big.join(hot, keys, "left").withColumn(
        "_slot",
        F.when(null_key, F.pmod(noise, F.lit(NULL_SLOTS)))
        .otherwise(F.coalesce(F.pmod(noise, F.col("_slots")), F.lit(0))).cast("int"),
    ).drop("_slots")
    right = small.join(hot, keys, "left").withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slots"), F.lit(1)) - 1))
    ).drop("_slots")
    return left.join(right, [*keys, "_slot"], how).drop("_slot")


# Rows of the larger side that one task meets with the facts of a key.
MEET_ROWS = 200_000


def join_few(big: DataFrame, few: DataFrame, key: str, spread: str, rows: int = MEET_ROWS) -> DataFrame:
    """Join a large table to a smaller one on a key of few values, each of which may hold any share of the rows.

    The rows of a key in ``big`` are dealt over as many slots as their number asks for, and the rows of ``few`` are repeated once per slot. Keys that ``big``
    does not have are dropped from ``few`` before anything moves. ``key`` has few values, so the table of slots is small.
    """
    slots = big.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("_slots"))
    dealt = big.join(slots, key).withColumn("_slot", F.pmod(F.xxhash64(spread), F.col("_slots")).cast("int")).drop("_slots")
    repeated = few.join(slots, key).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1))).drop("_slots")
    return dealt.join(repeated, [key, "_slot"]).drop("_slot")
