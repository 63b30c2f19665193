"""Shaping batches: slicing, repeating, padding, planning mini-batches and balancing lengths over workers."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.operators.position import Positioned, with_position, written_positions

def _pos() -> Column:
    return F.col("pos")


# ---------------------------------------------------------------- rows and columns


def head_fraction(batch: Positioned, fraction: float) -> DataFrame:
    """The first ``fraction`` of the rows, at least one; everything when it is not between 0 and 1."""
    if not 0 < fraction < 1:
        return batch.rows
    return batch.rows.filter(_pos() < max(1, int(batch.n * fraction)))


def slice_rows(batch: Positioned, start: int | None = None, end: int | None = None, step: int = 1) -> DataFrame:
    """Rows of a slice; negative bounds count from the end."""
    first, last, _ = slice(start, end, step).indices(batch.n)
    if step < 1:
        raise ValueError("step must be positive")
    return batch.rows.filter((_pos() >= first) & (_pos() < last) & ((_pos() - first) % step == 0))


def select_rows(batch: Positioned, wanted: DataFrame, index: str = "index", order: str = "order") -> DataFrame:
    """Rows at the wanted positions, with their new position; a position may be wanted more than once."""
    picks = wanted.select(F.col(index).alias("pos"), F.col(order).alias("new_pos"))
    return batch.rows.join(picks, "pos").withColumn("pos", F.col("new_pos")).drop("new_pos")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns that exist; unknown names are ignored."""
    return df.select(*[c for c in columns if c in df.columns])


def pop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the rest)."""
    return select_columns(df, columns), df.drop(*columns)


def rename_columns(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names but {len(new)} new names")
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_columns(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One batch with the columns of both; rows must match one to one and shared columns must agree."""
    shared = [c for c in right.columns if c in left.columns and c not in key]
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in [*shared, *key]})
    cond = reduce(lambda a, b: a & b, (left[k].eqNullSafe(r[f"__r_{k}"]) for k in key))
    both = left.withColumn("__in_l", F.lit(True)).join(r.withColumn("__in_r", F.lit(True)), cond, "full_outer")
    matched = F.when(
        F.col("__in_l").isNull() | F.col("__in_r").isNull(), F.raise_error(F.lit("the batches have different rows")).cast("boolean")
    )
    checks = [
        F.when(~F.col(c).eqNullSafe(F.col(f"__r_{c}")), F.raise_error(F.lit(f"column {c} differs between the batches")).cast("boolean"))
        for c in shared
    ]
    fault = F.coalesce(matched, *checks, F.lit(False))
    return both.filter(~fault).drop("__in_l", "__in_r", *[f"__r_{c}" for c in [*shared, *key]])


def repeat_rows(batch: Positioned, times: int, interleave: bool = True) -> Positioned:
    """Every row ``times`` times: 1,1,2,2 interleaved or 1,2,1,2 tiled."""
    copies = batch.rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy"))
    pos = _pos() * times + F.col("copy") if interleave else F.col("copy") * F.lit(batch.n) + _pos()
    return Positioned(copies.withColumn("pos", pos.cast("bigint")), batch.n * times)


def pad_rows(batch: Positioned, divisor: int) -> tuple[Positioned, int]:
    """Pad to a multiple of ``divisor`` with the head rows, over and over if need be. Padding is marked ``is_pad``."""
    size = -batch.n % divisor
    rows = batch.rows.withColumn("is_pad", F.lit(False))
    if size == 0 or batch.n == 0:
        return Positioned(rows, batch.n), 0
    again = F.explode(F.sequence(_pos(), F.lit(size - 1).cast("bigint"), F.lit(batch.n).cast("bigint"))).alias("__t")
    head = batch.rows.filter(_pos() < size).select("*", again)
    pads = head.withColumn("pos", F.col("__t") + batch.n).drop("__t").withColumn("is_pad", F.lit(True))
    return Positioned(rows.unionByName(pads), batch.n + size), size


def unpad_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("is_pad")).drop("is_pad")


def _even(n: int, parts: int, what: str) -> int:
    if n % parts:
        raise ValueError(f"{n} rows do not divide into {parts} {what}")
    return n // parts


def chunk_rows(batch: Positioned, chunks: int) -> DataFrame:
    """Number of the equal, contiguous chunk each row falls in."""
    size = _even(batch.n, chunks, "chunks")
    return batch.rows.withColumn("chunk", F.floor(_pos() / F.lit(max(size, 1))).cast("int"))


def split_rows(batch: Positioned, size: int) -> DataFrame:
    return chunk_rows(batch, _even(batch.n, size, "rows per split"))


def concat_rows(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fold_rows(batch: Positioned, new_size: int, columns: Sequence[str]) -> DataFrame:
    """``new_size`` rows, each holding the columns of its consecutive old rows as arrays in order."""
    width = _even(batch.n, new_size, "rows")
    item = F.struct("pos", *columns)
    folded = batch.rows.groupBy(F.floor(_pos() / F.lit(width)).alias("pos")).agg(F.sort_array(F.collect_list(item)).alias("__l"))

    def column(name: str) -> Column:
        return F.transform("__l", lambda s: s[name]).alias(name)

    return folded.select("pos", *[column(c) for c in columns])


# ---------------------------------------------------------------- mini-batches


def clamp_batch_size(n: int, wanted: int) -> int:
    """The wanted size if there are enough rows, else the largest 16 * 2^k that fits (16 at least)."""
    if n <= 0 or wanted <= n:
        return wanted
    return 16 * 2 ** max(0, int(math.log2(n / 16))) if n >= 16 else 16


def plan_batches(
    df: DataFrame, key: Sequence[str], size: int, epochs: int = 1, seed: int | None = None, drop_last: bool = True
) -> DataFrame:
    """(key, epoch, batch, slot) of every row for every epoch.

    With a seed each epoch has its own order, by a seeded hash of the key: reproducible on any cluster. Only whole
    batches are planned unless ``drop_last`` is off.
    """
    rows = df.select(*key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    order = ["epoch", *key]
    if seed is not None:
        parts = [F.lit(str(seed)), *[F.col(c).cast("string") for c in ("epoch", *key)]]
        rows = rows.withColumn("__hash", F.md5(F.concat_ws(":", *parts)))
        order = ["epoch", "__hash", *key]
    placed = written_positions(rows, order)
    n = placed.n // epochs
    pos = _pos() - F.col("epoch") * n
    planned = placed.rows.select(*key, "epoch", F.floor(pos / F.lit(size)).cast("int").alias("batch"), (pos % size).cast("int").alias("slot"))
    return planned.filter(F.col("batch") < n // size) if drop_last else planned


# ---------------------------------------------------------------- balancing lengths


def deal(rank: Column, workers: int | Column) -> Column:
    """Deal ranks out like cards, turning round at each end: 0 1 2 2 1 0 0 1 2 ..."""
    k = workers if isinstance(workers, Column) else F.lit(workers)
    turn, seat = F.floor(rank / k), F.pmod(rank, k)
    return F.when(turn % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")


def balance(df: DataFrame, key: Sequence[str], length: str, workers: int) -> DataFrame:
    """Worker of every row: equal counts and nearly equal length sums, longest rows dealt first."""
    ranked = with_position(df.withColumn("__neg", -F.col(length)), ["__neg", *key], out="__rank")
    if ranked.n < workers:
        raise ValueError(f"{ranked.n} rows for {workers} workers")
    return ranked.rows.withColumn("worker", deal(F.col("__rank"), workers)).drop("__rank", "__neg")


CLASSES = 65_536  # lengths are told apart as finely as this when rounds are planned


def balance_level(df: DataFrame, key: Sequence[str], length: str, workers: int) -> DataFrame:
    """Worker of every row: equal counts, and length sums that differ by at most the longest length.

    Rows are taken longest first, in rounds of one row per worker. In a round the longest row goes to the worker with the least
    so far, which never lets the difference grow beyond the spread within a round. Only rounds whose lengths differ matter, and
    there are no more of them than distinct lengths: the driver plans them from the counts per length, and the plan is joined to the
    rows by round and seat. In rounds of equal lengths seats are workers. A null length counts as 0.
    """
    size = F.coalesce(F.col(length), F.lit(0))
    ranked = with_position(df.withColumn("__neg", -size), ["__neg", *key], out="__rank")
    if ranked.n < workers:
        raise ValueError(f"{ranked.n} rows for {workers} workers")
    longest = df.agg(F.max(size)).first()[0]
    width = max(1, -(-longest // CLASSES))  # lengths of one class count as its largest when rounds are planned
    counts = df.groupBy((F.floor(size / F.lit(width)) * width).cast("bigint").alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    plan = _level_rounds([(r["c"], r["n"]) for r in counts], ranked.n, workers)
    seats = df.sparkSession.createDataFrame(plan or [(-1, 0, 0)], "__round bigint, __seat int, __worker int")
    rows = ranked.rows.withColumn("__round", F.floor(F.col("__rank") / F.lit(workers))).withColumn("__seat", (F.col("__rank") % workers).cast("int"))
    placed = rows.join(seats, ["__round", "__seat"], "left")
    return placed.withColumn("worker", F.coalesce("__worker", "__seat")).drop("__round", "__seat", "__worker", "__rank", "__neg")


def _level_rounds(counts: list[tuple[int, int]], n: int, workers: int) -> list[tuple[int, int, int]]:
    """(round, seat, worker) of the rounds whose lengths differ, and of the last one if it is short."""
    ends = list(accumulate(k for _, k in counts))
    sums = [0] * workers
    mixed = {(end - 1) // workers for end in ends if end % workers} | ({n // workers} if n % workers else set())
    plan = []
    for turn in sorted(mixed):
        first = bisect_right(ends, turn * workers)
        lengths = []
        for rank in range(turn * workers, min((turn + 1) * workers, n)):
            while ends[first] <= rank:
                first += 1
            lengths.append(counts[first][0])
        order = sorted(range(workers), key=lambda w: (sums[w], w))
        for seat, (worker, size) in enumerate(zip(order, lengths)):
            plan.append((turn, seat, worker))
            sums[worker] += size - lengths[-1]  # what all get alike changes no difference
        if len(lengths) < workers:
            break
    return plan


def balance_report(balanced: Positioned, length: str, workers: int) -> DataFrame:
    """Length sums per worker before (contiguous chunks of the input order) and after balancing."""
    size = balanced.n // workers
    before = balanced.rows.groupBy(F.floor(_pos() / F.lit(size)).alias("w")).agg(F.sum(length).alias("s"))
    after = balanced.rows.groupBy("worker").agg(F.sum(length).alias("s"))
    b = before.agg(F.min("s").alias("min"), F.max("s").alias("max"), F.sum("s").alias("total"))
    a = after.agg(F.struct(F.min("s").alias("lo"), F.max("s").alias("hi")))
    return b.withColumn("__a", a.scalar()).select(
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("minmax_diff"),
        F.col("__a.lo").alias("balanced_min"),
        F.col("__a.hi").alias("balanced_max"),
        (F.col("total") / F.lit(workers)).alias("mean"),
    )


def micro_batches(df: DataFrame, key: Sequence[str], length: str, max_tokens: int) -> DataFrame:
    """Micro batch of every row, numbered from the heaviest by the sum of squared lengths.

    The number of micro batches is what the token total needs, at most one per row. Rows keep their columns, so sorting
    by the original position restores the input order.
    """
    ranked = with_position(df.withColumn("__neg", -F.col(length)), ["__neg", *key], out="__rank")
    total = df.agg(F.coalesce(F.sum(length), F.lit(0)).alias("t")).collect()[0]["t"]
    parts = max(1, min(ranked.n, math.ceil(total / max_tokens)))
    dealt = ranked.rows.withColumn("__part", deal(F.col("__rank"), parts))
    square = F.col(length).cast("bigint") * F.col(length)
    weights = dealt.groupBy("__part").agg(F.sum(square).alias("workload"))
    order = with_position(weights.withColumn("__neg_w", -F.col("workload")), ["__neg_w", "__part"], out="micro_batch").rows
    places = order.select("__part", "micro_batch", "workload")
    return dealt.join(places, "__part").drop("__part", "__rank", "__neg")
