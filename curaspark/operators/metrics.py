"""Metrics of training steps: rewards, lengths, losses, throughput, and metric logs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions import tokens as tk
from curaspark.operators.groups import attach

EPS = tk.EPS


# ---------------------------------------------------------------- long metric tables


def long_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], prefix: str = "") -> DataFrame:
    """(keys, metric, value): one row per metric of every input row."""
    wide = rows.select(*keys, *[F.col(m).cast("double").alias(f"{prefix}{m}") for m in metrics])
    return wide.unpivot(list(keys), [f"`{prefix}{m}`" for m in metrics], "metric", "value")


def reduce_metrics(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("value"))


def mean_metrics(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """Means of the metrics as a long table; the means are taken before the table is made long."""
    means = rows.groupBy(*keys).agg(*[F.avg(m).alias(f"{prefix}{m}{suffix}") for m in metrics])
    return means.unpivot(list(keys), [f"`{prefix}{m}{suffix}`" for m in metrics], "metric", "value")


def nest_metrics(reduced: DataFrame, keys: Sequence[str], value: Column | None = None) -> DataFrame:
    """One JSON object per step, metric names nested at '/', as deep as the names go.

    Input is one row per (step, metric name): a handful of rows per step.
    """
    text = F.col("value").cast("string") if value is None else value
    level = reduced.select(*keys, F.split("metric", "/").alias("path"), text.alias("json"))
    depth = level.agg(F.max(F.size("path"))).first()[0] or 0
    for size in range(depth, 0, -1):
        deep, rest = level.filter(F.size("path") == size), level.filter(F.size("path") != size)
        entry = F.concat(F.lit('"'), F.element_at("path", -1), F.lit('":'), F.col("json"))
        parents = deep.groupBy(*keys, F.slice("path", 1, size - 1).alias("path")).agg(
            F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("json")
        )
        level = rest.unionByName(parents)
    return level.select(*keys, F.col("json").alias("log"))


def flatten_metrics(logs: DataFrame, keys: Sequence[str], log: str = "log") -> DataFrame:
    """The inverse of ``nest_metrics``: (keys, metric, value) from JSON objects nested to any depth."""
    level = logs.select(*keys, F.lit("").alias("metric"), F.col(log).alias("json"))
    done = None
    while done is None or not level.isEmpty():
        opened = level.select(*keys, "metric", F.explode(F.from_json("json", "map<string,string>")).alias("k", "json"))
        name = F.when(F.col("metric") == "", F.col("k")).otherwise(F.concat_ws("/", "metric", "k"))
        opened = opened.select(*keys, name.alias("metric"), "json")
        is_object = F.col("json").startswith("{")
        leaves = opened.filter(~is_object).select(*keys, "metric", F.col("json").cast("double").alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        level = opened.filter(is_object)
    return done


# ---------------------------------------------------------------- lengths, scores, throughput


def length_metrics(rows: DataFrame, batch: Sequence[str], max_prompt: int, max_response: int) -> DataFrame:
    """Mean, max, min of prompt and response lengths, and the share that reaches the limit."""
    out = []
    for name, limit in (("prompt", max_prompt), ("response", max_response)):
        n = F.col(f"{name}_length").cast("double")
        out += [
            F.avg(n).alias(f"{name}_length/mean"),
            F.max(n).alias(f"{name}_length/max"),
            F.min(n).alias(f"{name}_length/min"),
            F.avg((n >= limit).cast("double")).alias(f"{name}_length/clip_ratio"),
        ]
    return rows.groupBy(*batch).agg(*out)


def _stats(prefix: str, value: Column) -> list[Column]:
    return [F.avg(value).alias(f"{prefix}/mean"), F.max(value).alias(f"{prefix}/max"), F.min(value).alias(f"{prefix}/min")]


def data_metrics(rows: DataFrame, batch: Sequence[str], critic: bool = False) -> DataFrame:
    """Statistics of scores and rewards per response, of advantages, returns and values per valid token.

    Responses and tokens are two partial aggregates joined per batch; token rows never leave their task.
    """
    responses = rows.groupBy(*batch).agg(
        *_stats("critic/score", tk.total(F.col("token_level_scores"))),
        *_stats("critic/rewards", tk.total(F.col("token_level_rewards"))),
    )
    columns = ["advantages", "returns"] + (["values"] if critic else [])
    zipped = F.arrays_zip(*[F.col(c) for c in columns], F.col("mask"))
    valid = rows.select(*batch, F.explode(F.filter(zipped, lambda t: t["mask"] != 0)).alias("t"))
    stats = _stats("critic/advantages", F.col("t.advantages")) + _stats("critic/returns", F.col("t.returns"))
    if critic:
        gap = F.col("t.returns") - F.col("t.values")
        explained = F.lit(1.0) - F.var_samp(gap) / (F.var_samp("t.returns") + 1e-5)
        stats += [*_stats("critic/values", F.col("t.values")), explained.alias("critic/vf_explained_var")]
    return attach(responses, valid.groupBy(*batch).agg(*stats), batch)


# Which token count a timed section is divided by.
RESPONSE_SECTIONS = ["gen", "reward"]
OVERALL_SECTIONS = ["ref", "old", "values", "adv", "update_critic", "update_actor"]


def timing_metrics(timings: DataFrame, tokens: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Seconds per section, and milliseconds per token for the sections that have a token count.

    ``timings`` is (batch, section, seconds); ``tokens`` has response_tokens and overall_tokens per batch.
    """
    rows = attach(timings, tokens, batch)
    section = F.col("section")
    n = F.when(section.isin(RESPONSE_SECTIONS), F.col("response_tokens")).when(section.isin(OVERALL_SECTIONS), F.col("overall_tokens"))
    return rows.select(
        *batch, "section", F.col("seconds").alias("timing_s"), F.try_divide(F.col("seconds") * 1000.0, n).alias("timing_per_token_ms")
    )


def throughput(timings: DataFrame, tokens: DataFrame, batch: Sequence[str], n_devices: int) -> DataFrame:
    steps = timings.filter("section = 'step'").select(*batch, F.col("seconds").alias("time_per_step"))
    return attach(steps, tokens, batch).select(
        *batch,
        F.col("overall_tokens").alias("total_num_tokens"),
        "time_per_step",
        (F.col("overall_tokens") / (F.col("time_per_step") * n_devices)).alias("throughput"),
    )


@dataclass(frozen=True)
class ModelShape:
    """Sizes of a decoder; ``experts`` and ``active_experts`` describe a mixture of experts."""

    hidden: int
    vocab: int
    layers: int
    heads: int
    kv_heads: int
    intermediate: int
    head_dim: int | None = None
    experts: int | None = None
    active_experts: int | None = None

    def dense_parameters(self) -> int:
        dim = self.head_dim or self.hidden // self.heads
        mlp = self.hidden * self.intermediate * 3
        if self.experts:
            mlp = mlp * self.active_experts + self.hidden * self.experts
        attention = self.hidden * dim * 2 * (self.heads + self.kv_heads)
        return (mlp + attention) * self.layers + self.vocab * self.hidden * 2

    def attention_factor(self) -> int:
        return 12 * (self.head_dim or self.hidden // self.heads) * self.heads * self.layers


# Peak TFLOPS per device.
DEVICE_TFLOPS = {"H100": 989.0, "H800": 989.0, "A100": 312.0, "A800": 312.0, "L40": 181.05, "L20": 119.5, "H20": 148.0, "910B": 354.0}


def flops_estimate(lengths: DataFrame, batch: Sequence[str], length: str, shape: ModelShape, seconds: Column) -> DataFrame:
    """Estimated TFLOPS per step from the sums of the lengths and of their squares."""
    n = F.col(length).cast("double")
    sums = lengths.groupBy(*batch).agg(F.sum(n).alias("tokens"), F.sum(n * n).alias("squares"), seconds.alias("seconds"))
    flops = F.lit(6.0 * shape.dense_parameters()) * F.col("tokens") + F.lit(float(shape.attention_factor())) * F.col("squares")
    return sums.select(*batch, "tokens", "squares", "seconds", (flops / F.col("seconds") / 1e12).alias("tflops"))


# ---------------------------------------------------------------- divergence from the reference policy


def kl_penalized(rows: DataFrame, coef: Column, kind: str = "kl", mask: str = "mask") -> DataFrame:
    """Token rewards = scores - coef * kl * mask, with the mean kl of each response."""
    kl = F.zip_with(tk.kl_terms(F.col("old_log_probs"), F.col("ref_log_probs"), kind), mask, lambda k, m: k * m)
    rows = rows.withColumn("__kl", kl)
    return rows.select(
        "*",
        F.zip_with("token_level_scores", "__kl", lambda s, k: s - coef * k).alias("token_level_rewards"),
        tk.masked_mean(F.col("__kl"), F.col(mask)).alias("response_kl"),
    ).drop("__kl")


def kl_per_step(penalized: DataFrame, batch: Sequence[str]) -> DataFrame:
    return penalized.groupBy(*batch).agg(F.avg("response_kl").alias("kl"), F.count(F.lit(1)).alias("n_rows"))


def kl_controller(
    steps: DataFrame, init: float, target: float, horizon: float, step: str = "step", run: Sequence[str] = (), adaptive: bool = True
) -> DataFrame:
    """Coefficient in force at every step, and the one after it. One row per step, so one window per run is small."""
    error = tk.clip(F.col("kl") / target - 1.0, -0.2, 0.2)
    factor = (1.0 + error * F.col("n_rows") / F.lit(float(horizon))) if adaptive else F.lit(1.0)
    w = Window.partitionBy(*(run or [F.lit(1)])).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    after = F.lit(init) * F.product("__factor").over(w)
    rows = steps.withColumn("__factor", factor).withColumn("coef_after", after)
    return rows.withColumn("coef", F.col("coef_after") / F.col("__factor")).drop("__factor")


# ---------------------------------------------------------------- losses over logged log-probabilities

LOSS_TYPES = ["default", "gspo", "gspo_token", "cispo", "sapo"]


def _per_batch_means(tokens: DataFrame, batch: Sequence[str], row: str, names: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Masked means over all tokens of a batch, and means of the responses' means for ``seq``."""
    per_row = tokens.groupBy(*batch, row).agg(
        F.sum("m").alias("m"), *[F.sum(F.col(n) * F.col("m")).alias(n) for n in names]
    )
    return per_row.groupBy(*batch).agg(
        *[(F.sum(n) / (F.sum("m") + EPS)).alias(n) for n in names],
        *[F.avg(F.col(n) / (F.col("m") + EPS)).alias(f"{n}_seq") for n in seq],
    )


@dataclass(frozen=True)
class LossSettings:
    clip_low: float = 0.2
    clip_high: float = 0.3
    clip_dual: float = 3.0
    tau_positive: float = 1.0
    tau_negative: float = 1.05


def _loss_columns(loss_type: str, s: LossSettings) -> dict[str, Column]:
    """Loss of a token and, where the loss clips, its clip fractions, from the columns a, gap, seq_gap, lp and m."""
    a = F.col("a")
    log_ratio = {"gspo": F.col("seq_gap") * F.col("m"), "gspo_token": F.col("seq_gap")}.get(loss_type, F.col("gap"))
    ratio = F.exp(tk.clip(log_ratio, -20.0, 20.0))
    clipped = F.exp(tk.clip(log_ratio, math.log(1 - s.clip_low), math.log(1 + s.clip_high)))
    none = F.lit(None).cast("double")
    if loss_type == "cispo":
        return {"loss": -a * F.col("lp") * clipped, "pg_clipfrac_higher": none, "pg_clipfrac_lower": none}
    if loss_type == "sapo":

        def gate(tau: float) -> Column:
            return F.lit(4.0 / tau) / (F.lit(1.0) + F.exp(F.lit(-tau) * (ratio - 1.0)))

        return {"loss": -a * F.when(a >= 0, gate(s.tau_positive)).otherwise(gate(s.tau_negative)), "pg_clipfrac_higher": none, "pg_clipfrac_lower": none}
    plain, capped, dual = -a * ratio, -a * clipped, -a * s.clip_dual
    high = F.greatest(plain, capped)
    return {
        "loss": F.when(a < 0, F.least(high, dual)).otherwise(high),
        "pg_clipfrac_higher": (plain < capped).cast("double"),
        "pg_clipfrac_lower": ((high > dual) & (a < 0)).cast("double"),
    }


def policy_diagnostics(
    rows: DataFrame, batch: Sequence[str], row: str, loss_types: Sequence[str] = ("default",), settings: LossSettings = LossSettings()
) -> DataFrame:
    """(loss_type, batch, ...): loss (averaged by token and by response), clip fractions, kl and entropy of a step.

    ``rows`` holds old_log_probs, log_probs and mask arrays and one ``advantage`` per response. All kinds of loss are
    columns of one pass over the tokens. Nothing is trained: these are readings of logged log-probabilities.
    """
    if unknown := set(loss_types) - set(LOSS_TYPES):
        raise ValueError(f"unknown loss types {sorted(unknown)}")
    gap = F.zip_with("log_probs", "old_log_probs", lambda p, o: p - o)
    rows = rows.select(*batch, row, "advantage", gap.alias("gap"), F.col("log_probs").alias("lp"), "mask")
    rows = rows.withColumn("seq_gap", tk.masked_mean(F.col("gap"), F.col("mask")))
    zipped = F.arrays_zip("gap", "lp", "mask")
    t = rows.select(*batch, row, "advantage", "seq_gap", F.explode(zipped).alias("t")).select(
        *batch, row, F.col("advantage").alias("a"), "seq_gap", F.col("t.gap").alias("gap"), F.col("t.lp").alias("lp"),
        F.col("t.mask").cast("double").alias("m"),
    )
    parts = ("loss", "pg_clipfrac_higher", "pg_clipfrac_lower")
    columns = {f"{kind}__{part}": c for kind in loss_types for part, c in _loss_columns(kind, settings).items()}
    t = t.withColumns({**columns, "ppo_kl": -F.col("gap"), "entropy_loss": -F.col("lp")})
    wide = _per_batch_means(t, batch, row, [*columns, "ppo_kl", "entropy_loss"], [f"{k}__loss" for k in loss_types] + ["entropy_loss"])
    kinds = [
        F.struct(F.lit(k).alias("loss_type"), *[F.col(f"{k}__{p}").alias(p) for p in parts], F.col(f"{k}__loss_seq").alias("loss_seq"))
        for k in loss_types
    ]
    shared = ["ppo_kl", "entropy_loss", "entropy_loss_seq"]
    return wide.select(*batch, *shared, F.explode(F.array(*kinds)).alias("k")).select("k.loss_type", *batch, "k.loss", "k.loss_seq", "k.pg_clipfrac_higher", "k.pg_clipfrac_lower", *shared)


def value_diagnostics(rows: DataFrame, batch: Sequence[str], row: str, clip_range: float = 0.5) -> DataFrame:
    """Clipped value loss (by token and by response), its clip fraction, and the mean prediction.

    ``rows`` holds predictions, returns, values and mask arrays.
    """
    zipped = F.arrays_zip("predictions", "returns", "values", "mask")
    t = rows.select(*batch, row, F.explode(zipped).alias("t")).select(*batch, row, "t.*")
    t = t.withColumn("m", F.col("mask").cast("double"))
    p, r, v = F.col("predictions"), F.col("returns"), F.col("values")
    near = F.least(F.greatest(p, v - clip_range), v + clip_range)
    free, held = (p - r) * (p - r), (near - r) * (near - r)
    t = t.withColumn("vf_loss", F.lit(0.5) * F.greatest(free, held)).withColumn("vf_clipfrac", (free < held).cast("double"))
    t = t.withColumn("vpred_mean", p)
    return _per_batch_means(t, batch, row, ["vf_loss", "vf_clipfrac", "vpred_mean"], ["vf_loss"])
