"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total size in proportion to its weight, but no more than ``max_epochs`` times what it has:
sources above that are clamped there, and what they cannot take is shared by weight among the rest, until none is above.
A target is met by whole repetitions of all documents of a source and one fractional repetition: documents in the order of a
seeded hash, as many as come nearest to the remainder.

The order is cut without sorting a source: sizes are summed per hash bucket, the bucket in which the remainder ends is the
only one whose rows are looked at, and the last document taken is a bound that every row compares itself with. A source that
holds a third of all rows is thus summed map-side and its rows never meet in one task.

Null texts have size zero, as empty ones; a document of size zero is never taken. The null source is a source, the last
one. Rows that repeat an identifier share their place in the order, and are taken or left together. An empty table, or one
whose sizes are all zero, gives targets of zero. Other columns are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import n_words
from curaspark.operators.position import with_position
from curaspark.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
BUCKETS_HEX = 3  # 16 ** 3 hash buckets per source
_HASH_HEX = 15


def place(key: Column, seed: int = SEED) -> Column:
    """Seeded place of a document in the order of its source, 60 bits."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, _HASH_HEX), 16, 10).cast("bigint")


def bucket(place: Column) -> Column:
    return F.shiftright(place, 4 * (_HASH_HEX - BUCKETS_HEX))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Each round reads one row of sums. The level rem / weight only rises, so a source once clamped stays clamped, and the
    rounds end when no further source is.
    """
    ranked = with_position(sources.withColumn("null_last", F.col("source").isNull()), ["null_last", "source"], "rank").rows
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    rows = cut_lineage(ranked.select("source", "source_size", weight.cast("bigint").alias("weight")))

    def clamped(left: int, share: int) -> Column:
        return (F.lit(max_epochs) * F.col("source_size")).cast("decimal(38,0)") * share <= F.col("weight").cast("decimal(38,0)") * left

    def sums(cond: Column) -> tuple[int, int, int]:
        got = rows.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(cond, max_epochs * F.col("source_size")).otherwise(0)).alias("fixed"),
            F.sum(F.when(cond, 0).otherwise(F.col("weight"))).alias("share"),
        ).first()
        return got["total"] or 0, (got["total"] or 0) - (got["fixed"] or 0), got["share"] or 0

    total, left, share = sums(F.lit(False))
    while share:
        _, next_left, next_share = sums(clamped(left, share))
        if next_share == share or not next_share:
            break
        left, share = next_left, next_share
    if not share or not total:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    free = (F.col("weight").cast("decimal(38,0)") * left).cast("double") / F.lit(float(share))
    target = F.when(clamped(left, share), (max_epochs * F.col("source_size")).cast("double")).otherwise(free)
    return rows.select("source", "source_size", target.alias("target"))


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size, place) of every document -> one row per source.

    source_size, target, whole (repetitions of all its documents) and last (place of the last document that is taken once
    more; null if none is).
    """
    rows = sized.select("source", "size", "place", bucket(F.col("place")).alias("bucket"))
    by_bucket = cut_lineage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    targets = cut_lineage(source_targets(by_bucket.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs))
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    needs = targets.withColumn("whole", ratio).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))

    so_far = Window.partitionBy("source").orderBy("bucket")  # at most 16 ** BUCKETS_HEX rows each
    ends = by_bucket.withColumn("before", F.sum("size").over(so_far) - F.col("size"))
    same = ends["source"].eqNullSafe(needs["source"])
    ends = ends.join(needs, same).select(ends["source"], "bucket", "before", "size", "need").filter("before <= need AND size > 0")
    cut = ends.groupBy("source").agg(F.max(F.struct("bucket", "before", "need")).alias("c")).select(F.col("source").alias("cut_source"), "c.*")

    # the rows of one bucket per source, in order; documents with one place go together
    inside = rows.filter("size > 0").join(cut, rows["source"].eqNullSafe(cut["cut_source"]) & (rows["bucket"] == cut["bucket"]))
    inside = inside.groupBy("cut_source", "place").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("need").alias("need"))
    order = Window.partitionBy("cut_source").orderBy("place")
    middle = F.col("before") + F.sum("size").over(order) - F.col("size") / 2
    taken = inside.withColumn("taken", middle <= F.col("need"))
    last = taken.groupBy("cut_source").agg(F.max(F.when(F.col("taken"), F.col("place"))).alias("last"))
    # where not even the first document of the bucket is taken, all buckets before it are
    last = last.join(cut.select(F.col("cut_source").alias("s"), "bucket"), F.col("cut_source").eqNullSafe(F.col("s")))
    bound = F.coalesce(F.col("last"), F.shiftleft(F.col("bucket"), 4 * (_HASH_HEX - BUCKETS_HEX)) - 1)
    last = last.select("cut_source", bound.alias("last"))
    return cut_lineage(needs.join(last, needs["source"].eqNullSafe(last["cut_source"]), "left").select("source", "source_size", "target", "whole", "last"))


def repetitions(place: Column) -> Column:
    """How often a document is taken, beside the columns of ``plan``."""
    return F.col("whole") + F.when(place <= F.col("last"), 1).otherwise(0)


def _sized(df: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    return df.select(F.col(source).alias("source"), F.col(key).alias("key"), n_words(F.col(text)).alias("size"), place(F.col(key), seed).alias("place"))


def mix_counts(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """(key, size, source_size, target, times): one row per document; texts are read once."""
    sized = cut_lineage(_sized(df, key, source, text, seed))
    sources = plan(sized, weights, max_epochs).withColumnRenamed("source", "plan_source")
    joined = sized.join(sources, sized["source"].eqNullSafe(sources["plan_source"]))
    times = F.when(F.col("size") > 0, repetitions(F.col("place"))).otherwise(0).cast("bigint")
    return joined.select(F.col("key").alias(key), "size", "source_size", "target", times.alias("times"))


def mix(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """The documents of the mixture with their columns, each as often as it is taken."""
    sources = plan(cut_lineage(_sized(df, key, source, text, seed)), weights, max_epochs)
    sources = sources.select(F.col("source").alias("__source"), "whole", "last", F.lit(True).alias("__plan"))
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]  # names may hold dots
    joined = df.select(F.struct(*quoted).alias("__row")).join(sources, F.col(f"__row.`{source}`").eqNullSafe(F.col("__source")))
    times = F.when(n_words(F.col(f"__row.`{text}`")) > 0, repetitions(place(F.col(f"__row.`{key}`"), seed))).otherwise(0)
    repeated = joined.withColumn("__times", times.cast("int")).filter("__times > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__times"))))
    return repeated.select("__row.*")
