"""Row positions in a total order, without one task that sees all rows.

``row_number()`` over an unpartitioned window sends every row to one task. Here rows are cut into ranges at sampled
bounds, ranges are counted, and a row's position is its rank within its range plus the rows before that range. The
bounds are literals of the plan, so a task that runs again (say, after the loss of an executor) finds the same ranges.
The three preparing jobs read the order columns only; the rows themselves are shuffled once. Beyond ``LITERAL_RANGES`` ranges
each range is cut once more at bounds kept in a table, so that a range has about ``ROWS_PER_RANGE`` rows at any size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.session import cut_lineage

LITERAL_RANGES = 4096  # ranges whose bounds stand in the plan; each of them is cut again when more are needed
ROWS_PER_RANGE = 200_000
SAMPLES_PER_RANGE = 64


@dataclass(frozen=True)
class Positioned:
    """Rows with their position, and the number of rows."""

    rows: DataFrame
    n: int


def with_position(df: DataFrame, order: Sequence[str], out: str = "pos", ranges: int | None = None) -> Positioned:
    """Add the 0-based position of each row in the order of ``order``, whose values must identify a row."""
    keys = df.select(*order)
    n = keys.count()
    if ranges is None:
        ranges = max(math.ceil(n / ROWS_PER_RANGE), min(n // 2000, df.sparkSession.sparkContext.defaultParallelism))
    local = Window.partitionBy("__range").orderBy(*order)
    if ranges <= 1:
        rows = df.withColumn("__range", F.lit(0)).withColumn(out, F.row_number().over(local).cast("bigint") - 1)
        return Positioned(rows.drop("__range"), n)
    bounds = _sample_bounds(keys, order, n, min(ranges, LITERAL_RANGES))
    ranged = _range_of(df, order, bounds)
    if ranges > LITERAL_RANGES:
        return Positioned(_two_levels(ranged, order, out, bounds, n, math.ceil(ranges / LITERAL_RANGES)), n)
    counted = dict(_range_of(keys, order, bounds).groupBy("__range").count().collect())  # at most ``ranges`` rows
    before, offsets = 0, []
    for i in range(len(bounds) + 1):
        offsets.append(before)
        before += counted.get(i, 0)
    start = F.get(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col("__range"))
    position = start + F.row_number().over(local) - 1
    return Positioned(ranged.withColumn(out, position).drop("__range"), n)


def written_positions(df: DataFrame, order: Sequence[str], out: str = "pos") -> Positioned:
    """As ``with_position``, for rows of a few short columns, which are sorted by ranges and written to the shared folder once.

    A position is the place within the written range plus the rows of the ranges before it, so no row is compared with literal
    bounds, and a task that runs again reads what was written.
    """
    n = df.count()
    ranges = max(1, math.ceil(n / ROWS_PER_RANGE), min(n // 2000, df.sparkSession.sparkContext.defaultParallelism))
    ordered = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = cut_lineage(ordered.select("*", F.spark_partition_id().alias("__range"), place.alias("__place")))
    counts = written.groupBy("__range").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.orderBy("__range")) - F.col("k")  # a row per range
    starts = counts.select(F.col("__range").alias("__r"), before.alias("__start"))
    placed = written.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    return Positioned(placed.withColumn(out, F.col("__start") + F.col("__place")).drop("__range", "__place", "__r", "__start"), n)


def _two_levels(ranged: DataFrame, order: Sequence[str], out: str, bounds: list[str], n: int, parts: int) -> DataFrame:
    """Positions when the plan cannot hold all bounds: every range is cut into about ``parts`` at bounds of its own.

    The inner bounds and the counts of the inner ranges are tables in the shared folder, one row per outer range and per inner
    range, and are joined to the rows: the driver sees none of them, and a task that runs again finds the same.
    """
    key = F.struct(*order)
    share = min(1.0, SAMPLES_PER_RANGE * parts * (len(bounds) + 1) / n)
    keys = ranged.select("__range", key.alias("key"))
    sample = keys.sample(fraction=share, seed=11) if share < 1.0 else keys
    # some ``parts`` * SAMPLES_PER_RANGE keys to an outer range, of which every so many become a bound
    picked = sample.groupBy("__range").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    step = F.greatest(F.ceil(F.size("keys") / F.lit(parts)).cast("int"), F.lit(1))
    picked = picked.select("__range", F.filter("keys", lambda k, i: (i > 0) & (i % step == 0)).alias("bounds")).filter(F.size("bounds") > 0)
    width = F.ceil(F.sqrt(F.size("bounds"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("bounds") / width).cast("int") - 1), lambda i: F.slice("bounds", i * width + 1, width))
    inner = picked.select(F.col("__range").alias("__outer"), blocks.alias("__blocks"), width.alias("__width"))
    inner = cut_lineage(inner.withColumn("__heads", F.transform("__blocks", lambda b: F.get(b, F.lit(0)))))

    def cut(rows: DataFrame) -> DataFrame:
        """Number of inner bounds not above the row's key, searched in two steps as the outer ones are."""
        joined = rows.join(inner, F.col("__range") == F.col("__outer"), "left")
        joined = joined.withColumn("__block", F.size(F.filter("__heads", lambda h: h <= key)))
        within = F.size(F.filter(F.get("__blocks", F.col("__block") - 1), lambda b: b <= key))
        found = F.when(F.col("__heads").isNull() | (F.col("__block") == 0), 0).otherwise((F.col("__block") - 1) * F.col("__width") + within)
        return joined.withColumn("__inner", found).drop("__outer", "__blocks", "__width", "__heads", "__block")

    inner_counts = cut(ranged.select("__range", *order)).groupBy("__range", "__inner").agg(F.count(F.lit(1)).alias("k"))
    inner_counts = cut_lineage(inner_counts)
    outer = inner_counts.groupBy("__range").agg(F.sum("k").alias("k"))
    before = F.sum("k").over(Window.orderBy("__range")) - F.col("k")  # a row per outer range
    outer = outer.select(F.col("__range").alias("__r"), before.alias("before"))
    within = F.sum("k").over(Window.partitionBy("__range").orderBy("__inner")) - F.col("k")
    starts = inner_counts.withColumn("within", within).join(outer, F.col("__range") == F.col("__r"))
    starts = cut_lineage(starts.select(F.col("__range").alias("__r"), F.col("__inner").alias("__i"), (F.col("before") + F.col("within")).alias("__start")))
    placed = cut(ranged).join(starts, (F.col("__range") == F.col("__r")) & (F.col("__inner") == F.col("__i")))
    local = Window.partitionBy("__range", "__inner").orderBy(*order)
    position = F.col("__start") + F.row_number().over(local) - 1
    return placed.withColumn(out, position).drop("__range", "__inner", "__r", "__i", "__start")


def first_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows in the order of ``order``, whose values must identify a row; all rows if there are fewer.

    The k-th key is found by counting: keys are cut into ranges at sampled bounds, the range with the k-th key is cut again,
    and the last of them, of at most ``ROWS_PER_RANGE`` keys, is sorted. Rows are then only compared with that key, so no task
    holds ``k`` of them.
    """
    keys = df.select(*order)
    n, wanted, rest = keys.count(), k, keys
    if k >= n:
        return df
    if k <= 0:
        return df.limit(0)
    while n > ROWS_PER_RANGE:
        bounds = _sample_bounds(rest, order, n, min(LITERAL_RANGES, math.ceil(n / ROWS_PER_RANGE) + 1))
        ranged = _range_of(rest, order, bounds)
        counts = dict(ranged.groupBy("__range").count().collect())
        at = 0
        while wanted > counts.get(at, 0):
            wanted -= counts.get(at, 0)
            at += 1
        if counts[at] == n:
            break  # bounds that do not part the rows: few distinct samples, sort what is left
        n, rest = counts[at], ranged.filter(F.col("__range") == at).drop("__range")
    last = rest.orderBy(*order).limit(wanted).agg(F.to_json(F.max(F.struct(*order))).alias("j")).first()["j"]
    kind = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    return df.filter(F.struct(*order) <= F.from_json(F.lit(last), kind))


def _sample_bounds(keys: DataFrame, order: Sequence[str], n: int, ranges: int) -> list[str]:
    """Bounds between ranges as JSON texts, from a sample of a fixed size per range."""
    share = min(1.0, SAMPLES_PER_RANGE * ranges / n)
    sample = keys.sample(fraction=share, seed=7) if share < 1.0 else keys
    texts = sample.orderBy(*order).select(F.to_json(F.struct(*order)).alias("j")).collect()
    picks = sorted({len(texts) * i // ranges for i in range(1, ranges)})
    return [texts[i]["j"] for i in picks if 0 < i < len(texts)]


def _range_of(df: DataFrame, order: Sequence[str], bounds: list[str]) -> DataFrame:
    """Number of bounds not above the row's key, searched in two steps: blocks of bounds, then bounds of a block."""
    key_type = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def literal(texts: list, data_type: T.DataType) -> Column:
        return F.from_json(F.lit("[" + ",".join(texts) + "]"), data_type)

    key = F.struct(*[F.col(c) for c in order])
    heads = literal([b[0] for b in blocks], T.ArrayType(key_type))
    inner = literal(["[" + ",".join(b) + "]" for b in blocks], T.ArrayType(T.ArrayType(key_type)))
    df = df.withColumn("__block", F.size(F.filter(heads, lambda h: h <= key)))
    within = F.size(F.filter(F.get(inner, F.col("__block") - 1), lambda h: h <= key))
    found = F.when(F.col("__block") == 0, F.lit(0)).otherwise((F.col("__block") - 1) * width + within)
    return df.withColumn("__range", found).drop("__block")


# ---------------------------------------------------------------- shards from positions


def contiguous_shard(pos: Column, n: int, shards: int) -> Column:
    """Shard of size ``n // shards + 1``; the last shards may stay short or empty."""
    return F.floor(pos / F.lit(n // shards + 1)).cast("int")


def strided_shard(pos: Column, shards: int) -> Column:
    return F.pmod(pos, F.lit(shards)).cast("int")


def balanced_shard(pos: Column, n: int, shards: int) -> Column:
    """Contiguous shards whose sizes differ by at most one, the larger ones first."""
    size, extra = divmod(n, shards)
    edge = extra * (size + 1)
    large = F.floor(pos / F.lit(size + 1))
    small = F.lit(extra) + F.floor((pos - edge) / F.lit(max(size, 1)))
    return F.when(pos < edge, large).otherwise(small).cast("int")
