"""Evaluate costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read as values.

    The optimiser copies the expression of a plain column into every later expression and pushed filter that uses it,
    which multiplies nested array and pattern work. Here a projection computes the columns (compiled, with common parts
    shared), and a one-element ``inline`` over the finished columns keeps filters on them above it; filters on other
    columns still go below.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    names = {n: f"_once_{n}" for n in columns}
    made = df.select(*keep, *[e.alias(names[n]) for n, e in columns.items()])
    return made.select(*keep, F.inline(F.array(F.struct(*[F.col(f"`{t}`").alias(n) for n, t in names.items()]))))
