"""Result shaping: top-k with a declared order (O17) and scalar bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """ORDER BY ... LIMIT k. Spark plans ``TakeOrderedAndProject``:
    every task keeps its own k best rows, so only k rows per task move.
    ``order`` must end in a unique tie-break for a deterministic answer."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def bundle(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Merge one-row frames (global aggregates) into one record.

    Each further frame becomes one uncorrelated scalar subquery (its columns
    packed in a struct) attached once as a column: Spark runs it once, and
    its values join the first frame's single row without a join."""
    df, cols = first, [F.col(c) for c in first.columns]
    for i, frame in enumerate(others):
        packed = f"_bundle{i}"
        df = df.withColumn(packed, frame.select(F.struct(*frame.columns)).scalar())
        cols += [F.col(packed).getField(c).alias(c) for c in frame.columns]
    return df.select(*cols)
