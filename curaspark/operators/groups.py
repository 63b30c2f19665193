"""Group statistics next to their rows, without collecting a group into one task.

A window over a key puts a whole group into one task. Here the group is aggregated first (partial aggregates before
the shuffle, so a hot key costs one row per map task) and the small result is joined back; adaptive execution
broadcasts that result when it is small and splits a skewed partition when it is not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join the columns of ``other`` to ``df`` on ``keys``; NULL keys match each other."""
    renamed = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, (df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys))
    return df.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add per-group aggregates to every row. With no keys the group is the whole table (a scalar subquery)."""
    if keys:
        return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()]), keys, "inner")
    one = df.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("__s"))
    return df.withColumn("__s", one.scalar()).select("*", *[F.col(f"__s.{n}").alias(n) for n in stats]).drop("__s")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows of each group. Spark limits each map task to ``k`` rows per group before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")
