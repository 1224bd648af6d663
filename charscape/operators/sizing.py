"""Size checks before a broadcast, and the lookup join used with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
BROADCAST_ROWS = 200_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and, as text, ``size`` bytes.

    Reads no more than one row beyond the limit.
    """
    text = F.octet_length(F.to_json(F.struct("*")))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(text).alias("bytes")).first()
    return seen["n"] <= rows and (seen["bytes"] or 0) <= size


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join facts of any key distribution to a lookup with unique keys.

    A lookup whose size has been checked is broadcast. Beyond that both sides are shuffled, and
    adaptive execution splits the facts of a key that fills a partition.
    """
    if how not in ("left", "inner"):
        raise ValueError("a lookup join is left or inner")
    small = F.broadcast(lookup) if fits(lookup, limit) else lookup.hint("merge")
    return facts.join(small, list(keys), how)
