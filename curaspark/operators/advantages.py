"""Group-relative advantages over rollouts.

Every estimator takes a DataFrame of rollouts and returns it with an ``advantage`` (and ``returns``) column. Groups are
aggregated and joined back (see ``groups``); token recursions stay within a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions import tokens as tk
from curaspark.functions.text import let
from curaspark.operators.groups import attach, top_per_group, with_group_stats
from curaspark.operators.position import first_rows

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str):
    """Make an estimator available by name to ``advantage``."""

    def add(fn):
        ESTIMATORS[name] = fn
        return fn

    return add


def advantage(name: str, rollouts: DataFrame, **options) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; known: {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](rollouts, **options)


def _need_pair(n: Column, value: Column) -> Column:
    return F.when(n > 1, value).otherwise(F.raise_error(F.lit("a group needs more than one rollout")).cast("double"))


@register_estimator("grpo")
def grpo(rollouts: DataFrame, group: Sequence[str] = ("uid",), score: str = "score", eps: float = 1e-6) -> DataFrame:
    s = F.col(score)
    rows = with_group_stats(rollouts, group, __mean=F.avg(s), __std=F.stddev_samp(s), __n=F.count(F.lit(1)))
    value = (s - F.col("__mean")) / (F.col("__std") + eps)
    return rows.withColumn("advantage", _need_pair(F.col("__n"), value)).drop("__mean", "__std", "__n")


@register_estimator("grpo_passk")
def grpo_passk(
    rollouts: DataFrame, group: Sequence[str] = ("uid",), score: str = "score", tie: str = "rollout_id", eps: float = 1e-6
) -> DataFrame:
    """Only the best rollout of a group gets an advantage: its lead over the second, in standard deviations."""
    s = F.col(score)
    best = top_per_group(rollouts.select(*group, score, tie), group, [s.desc(), F.col(tie)], 2)
    leads = best.groupBy(*group).agg(
        F.min(F.struct((-s).alias("s"), F.col(tie).alias("id")))["id"].alias("__best"), (F.max(s) - F.min(s)).alias("__lead")
    )
    spread = rollouts.groupBy(*group).agg(F.stddev_samp(s).alias("__std"), F.count(F.lit(1)).alias("__n"))
    rows = attach(rollouts, attach(leads, spread, group, "inner"), group, "inner")
    value = F.when(F.col(tie) == F.col("__best"), F.col("__lead") / (F.col("__std") + eps)).otherwise(F.lit(0.0))
    return rows.withColumn("advantage", _need_pair(F.col("__n"), value)).drop("__best", "__lead", "__std", "__n")


@register_estimator("rloo")
def rloo(rollouts: DataFrame, group: Sequence[str] = ("uid",), score: str = "score") -> DataFrame:
    s = F.col(score)
    rows = with_group_stats(rollouts, group, __sum=F.sum(s), __n=F.count(F.lit(1)))
    value = s - F.try_divide(F.col("__sum") - s, F.col("__n") - 1)
    return rows.withColumn("advantage", _need_pair(F.col("__n"), value)).drop("__sum", "__n")


def masked_whiten(
    rows: DataFrame, values: str, mask: str, batch: Sequence[str] = (), out: str | None = None, eps: float = tk.EPS
) -> DataFrame:
    """Whiten token arrays with the mean and variance of the valid tokens of a batch.

    Valid tokens are exploded into a partial aggregate (count, mean, sample variance), so no token is shuffled and the
    variance does not lose digits.
    """
    kept = F.filter(
        F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), lambda t: t["m"] != 0
    )
    valid = rows.select(*batch, F.explode(kept).alias("t")).select(*batch, F.col("t.v").alias("v"))
    n, v = F.count(F.lit(1)), F.col("v")
    moments = {"__n": n, "__avg": F.avg(v), "__var": F.coalesce(F.var_samp(v), F.lit(0.0))}
    if batch:
        stats = valid.groupBy(*batch).agg(*[c.alias(k) for k, c in moments.items()])
        joined = attach(rows, stats, batch)
    else:
        one = valid.agg(F.struct(*[c.alias(k) for k, c in moments.items()]).alias("s"))
        joined = rows.withColumn("__s", one.scalar()).select("*", *[F.col(f"__s.{k}").alias(k) for k in moments]).drop("__s")
    n = F.col("__n").cast("double")
    mean = F.col("__avg") * n / (n + eps)
    squares = (n - 1) * F.col("__var") + n * (F.col("__avg") - mean) * (F.col("__avg") - mean)
    var = squares / (n + eps) * F.when(n > 1, n / (n - 1)).otherwise(F.lit(1.0))
    moment = F.struct(mean.alias("mean"), (F.lit(1.0) / F.sqrt(var + eps)).alias("scale"))
    # a batch without any valid token keeps its values
    white = let(moment, lambda s: F.transform(values, lambda x: F.coalesce((x - s["mean"]) * s["scale"], x)))
    return joined.withColumn(out or values, white).drop("__n", "__avg", "__var")


@register_estimator("reinforce_plus_plus")
def reinforce_plus_plus(
    rollouts: DataFrame, rewards: str = "rewards", mask: str = "mask", batch: Sequence[str] = (), gamma: float = 1.0
) -> DataFrame:
    rows = rollouts.withColumn("returns", tk.discounted_returns(F.col(rewards), F.col(mask), gamma))
    return masked_whiten(rows, "returns", mask, batch, out="advantage")


@register_estimator("remax")
def remax(rollouts: DataFrame, rewards: str = "rewards", mask: str = "mask", baseline: str = "baseline") -> DataFrame:
    """Response reward less the reward of the greedy response, on every valid token."""
    lead = tk.total(F.col(rewards)) - F.col(baseline)
    masked = F.zip_with(rewards, mask, lambda r, m: r * m)
    return rollouts.select(
        "*", tk.spread(lead, F.col(mask)).alias("advantage"), tk.suffix_sums(masked).alias("returns")
    )


@register_estimator("gae")
def gae(
    rollouts: DataFrame,
    rewards: str = "rewards",
    values: str = "values",
    mask: str = "mask",
    batch: Sequence[str] = (),
    gamma: float = 1.0,
    lam: float = 1.0,
) -> DataFrame:
    raw = tk.gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam)
    rows = rollouts.withColumn("__adv", raw).withColumn("returns", F.zip_with("__adv", values, lambda a, v: a + v))
    return masked_whiten(rows, "__adv", mask, batch, out="advantage").drop("__adv")


# ---------------------------------------------------------------- groups of rollouts


def online_filter(rollouts: DataFrame, group: Sequence[str], score: str, low: float, high: float) -> DataFrame:
    """Rollouts of the groups whose mean score lies strictly between the bounds."""
    mean = F.col("__mean")
    kept = rollouts.groupBy(*group).agg(F.avg(score).alias("__mean")).filter((mean > low) & (mean < high)).select(*group)
    return rollouts.join(kept, list(group), "left_semi")


def fill_quota(rollouts: DataFrame, group: str, arrival: str, quota: int) -> DataFrame:
    """Rollouts of the first ``quota`` groups by arrival; an error when there are fewer.

    The last group to make it is found by counting ranges of arrivals, so no task sorts the groups of the quota.
    """
    groups = rollouts.groupBy(group).agg(F.min(arrival).alias("__at"))
    chosen = first_rows(groups, ["__at", group], quota).select(group)
    enough = F.assert_true(chosen.agg(F.count(F.lit(1))).scalar() >= quota, F.lit(f"fewer than {quota} groups"))
    kept = rollouts.join(chosen, group, "left_semi")
    return kept.withColumn("__ok", enough).filter(F.col("__ok").isNull()).drop("__ok")
