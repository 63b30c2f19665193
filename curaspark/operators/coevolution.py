"""Health of the loop across iterations: difficulty, solvability, funnel counts and diversity per version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.operators.evaluate import label_version, mean_accuracy
from curaspark.operators.groups import attach


def category_counts(rows: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Count and share of every category per key; a missing category counts as ``unknown``."""
    label = F.coalesce(F.col(category), F.lit("unknown")).alias(category)
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("__total"))
    return attach(counts, totals, keys, "inner").withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def entropy_of_counts(n: str = "n") -> Column:
    """Normalised Shannon entropy of a group of counts: 0 for one class, NULL for none."""
    c = F.col(n).cast("double")
    nats = F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)
    return F.when(F.count(F.lit(1)) <= 1, F.lit(0.0)).otherwise(nats / F.log(F.count(F.lit(1)).cast("double")))


def normalized_entropy(rows: DataFrame, keys: Sequence[str], category: str, out: str = "entropy") -> DataFrame:
    return category_counts(rows, keys, category).groupBy(*keys).agg(entropy_of_counts().alias(out))


def iteration_metrics(
    results: DataFrame,
    rendered: DataFrame,
    codes: DataFrame,
    proposals: DataFrame,
    codegen_train: DataFrame,
    solver_train: DataFrame,
    keys: Sequence[str] = ("run", "version"),
) -> DataFrame:
    """One row per evaluated version. Every input is reduced to the keys before anything is joined."""
    hard = F.coalesce("hard_consistency", "score")
    base = results.groupBy(*keys).agg(
        F.avg(F.lit(1.0) - F.abs(F.lit(2.0) * hard - 1.0)).alias("avg_difficulty"),
        F.avg("easy_consistency").alias("avg_solvability"),
        (F.avg("easy_consistency") - F.avg(hard)).alias("easy_hard_gap"),
        F.count(hard).alias("n_evaluated"),
    )
    made = codes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_proposals"), F.avg(F.length(F.coalesce("generated_code", F.lit("")))).alias("avg_code_length")
    )
    out = attach(base, rendered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rendered")), keys)
    out = attach(out, made, keys)
    out = attach(out, normalized_entropy(proposals, keys, "content_type", "content_diversity"), keys)
    out = attach(out, normalized_entropy(results, keys, "question_type", "question_diversity"), keys)
    for name, train in (("n_codegen_filtered", codegen_train), ("n_solver_filtered", solver_train)):
        out = attach(out, train.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)
    out = out.fillna(0, ["n_rendered", "n_proposals"])
    return out.withColumn("render_rate", F.try_divide(F.col("n_rendered").cast("double"), F.col("n_proposals")))


def with_accuracy(metrics: DataFrame, summary: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Attach the mean accuracy of the model whose label names the version."""
    accuracy = mean_accuracy(summary, datasets).withColumn("__v", label_version(F.col("model"))).filter("__v IS NOT NULL")
    accuracy = accuracy.select(F.concat(F.lit("v"), F.col("__v")).alias("version"), "model", "mean_accuracy")
    return attach(metrics, accuracy, ["version"])
