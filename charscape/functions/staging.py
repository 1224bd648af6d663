"""Columns that are computed once.

Spark merges adjacent projections and pushes filters through them, which repeats an expensive
expression wherever its column is used. A generator of one row is not crossed by either, so the
columns it yields are computed exactly once per row, inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
