"""The small side of a join: broadcast only behind a check of its rows and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a broadcast side may have at most, and how many bytes.
ROWS, BYTES = 100_000, 32 << 20


def is_small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> bool:
    """Whether a table has at most so many rows and bytes of text; its first ``rows`` + 1 rows are read at most."""
    width = F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), width.alias("size")).first()
    return found["n"] <= rows and (found["size"] or 0) <= size


def small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """The table, marked for broadcast if it is small; a larger one is joined by shuffle."""
    return F.broadcast(df) if is_small(df, rows, size) else df
