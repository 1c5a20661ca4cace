"""Per-entity activity operators.

O11 frequency bands  events per entity, then entities per band
O12 dormant entities active before a cutoff and not on or after it
O13 repeat entities  more than one event

All are aggregations keyed by the entity. A NULL entity is a group of its
own, as in SQL GROUP BY. Partial aggregation runs before every shuffle, so
a hot entity (say a NULL customer holding a third of the rows) reaches the
shuffle as one row per task, not as its raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frequency_bands(df: DataFrame, entity: str,
                    bands: Sequence[tuple[int, int | None, str]],
                    band_col: str = "band", count_col: str = "entities") -> DataFrame:
    """Count events per ``entity``, then entities per band.

    ``bands`` are (low, high, label) with inclusive bounds, tried in order;
    high=None means open-ended. The result carries ``_min_events`` so the
    caller can order bands by their smallest count."""
    per_entity = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_events"))
    n = F.col("_events")
    label: Column | None = None
    for low, high, text in bands:
        cond = (n >= low) if high is None else n.between(low, high)
        label = F.when(cond, F.lit(text)) if label is None else label.when(cond, F.lit(text))
    return (per_entity.groupBy(label.alias(band_col))
            .agg(F.count(F.lit(1)).cast("bigint").alias(count_col),
                 F.min("_events").alias("_min_events")))


def repeat_count(df: DataFrame, entity: str, min_events: int = 2) -> DataFrame:
    """One row, the number of entity groups with >= min_events rows."""
    per_entity = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_events"))
    return per_entity.agg(F.count_if(F.col("_events") >= min_events).cast("bigint").alias("repeat"))


def dormant_count(df: DataFrame, entity: str, day: str, cutoff, null_aware: bool = False,
                  alias: str = "dormant") -> DataFrame:
    """One row, COUNT(DISTINCT entity) of entities with a dated row
    before ``cutoff`` and none on or after it.

    This is ``NOT IN (recent entities)`` computed by one aggregate: an
    entity qualifies when its latest date is before the cutoff. With
    ``null_aware=True`` the SQL NOT IN rule applies as well: a recent row
    with a NULL entity makes every comparison unknown, so the count is 0.
    """
    latest = (df.where(F.col(day).isNotNull())
                .groupBy(entity).agg(F.max(day).alias("_latest")))
    return dormant_in_state(latest, entity, "_latest", cutoff, null_aware, alias)


def dormant_in_state(state: DataFrame, entity: str, latest: str, cutoff, null_aware: bool = False,
                     alias: str = "dormant") -> DataFrame:
    """O12 from one row per entity (NULL is one) with its latest date."""
    e, last, cut = F.col(entity), F.col(latest), F.lit(cutoff)
    counts = state.agg(
        F.count_if(e.isNotNull() & (last < cut)).alias("_n"),
        F.max(F.when(e.isNull() & (last >= cut), F.lit(1)).otherwise(F.lit(0))).alias("_null_recent"))
    value = F.col("_n")
    if null_aware:
        value = F.when(F.col("_null_recent") == 1, F.lit(0)).otherwise(value)
    return counts.select(F.coalesce(value, F.lit(0)).cast("bigint").alias(alias))


def activity_summary(df: DataFrame, entity: str, day: str, cutoff, counted: Column,
                     min_events: int = 2, null_aware: bool = False,
                     repeat_alias: str = "repeat", dormant_alias: str = "dormant") -> DataFrame:
    """O13 and O12 from one aggregation per entity (one scan, one shuffle).

    One row: ``repeat`` = entity groups (NULL included) with at least
    ``min_events`` rows satisfying ``counted``; ``dormant`` = as
    ``dormant_count`` over every row."""
    per_entity = df.groupBy(entity).agg(
        F.count_if(counted).alias("_events"),
        F.max(day).alias("_latest"))
    e, latest, cut = F.col(entity), F.col("_latest"), F.lit(cutoff)
    counts = per_entity.agg(
        F.count_if(F.col("_events") >= min_events).cast("bigint").alias(repeat_alias),
        F.count_if(e.isNotNull() & (latest < cut)).alias("_n"),
        F.max(F.when(e.isNull() & (latest >= cut), F.lit(1)).otherwise(F.lit(0))).alias("_null_recent"))
    dormant = F.col("_n")
    if null_aware:
        dormant = F.when(F.col("_null_recent") == 1, F.lit(0)).otherwise(dormant)
    return counts.select(repeat_alias, F.coalesce(dormant, F.lit(0)).cast("bigint").alias(dormant_alias))
