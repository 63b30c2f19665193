"""Benchmark accuracy, and models set against the base model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.answers import answered, exact_match, judged_correct
from curaspark.operators.groups import attach

FAMILY = "MMMU-pro (macro)"


def accuracy(records: DataFrame, response: str = "model_response", truth: str = "ground_truth") -> DataFrame:
    """Accuracy per (model, dataset) in percent, over all rows and over the answered rows."""
    hit = exact_match(F.col(response), F.col(truth))
    scored = records.select("model", "dataset", hit.alias("ok"), answered(F.col(response), F.col(truth)).alias("has"))
    sums = scored.groupBy("model", "dataset").agg(
        F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("total"), F.count_if("has").alias("answered")
    )
    return sums.select(
        "model",
        "dataset",
        F.round(F.col("correct") / F.col("total") * 100, 2).alias("accuracy"),
        F.coalesce(F.round(F.try_divide(F.col("correct") * 100.0, F.col("answered")), 2), F.lit(0.0)).alias("answered_accuracy"),
        "correct",
        "total",
        "answered",
    )


def judge_accuracy(records: DataFrame, verdict: str) -> DataFrame:
    """Accuracy per (model, dataset) from the verdicts of a judge."""
    sums = records.groupBy("model", "dataset").agg(
        F.count_if(judged_correct(F.col(verdict))).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return sums.withColumn("accuracy", F.round(F.col("correct") / F.col("total") * 100, 2))


def in_family(dataset: Column) -> Column:
    d = F.lower(F.coalesce(dataset, F.lit("")))
    return d.contains("mmmu") & d.contains("pro")


def exclude_datasets(summary: DataFrame, excluded: Sequence[str]) -> DataFrame:
    return summary.filter(~F.coalesce(F.col("dataset"), F.lit("")).isin(list(excluded))) if excluded else summary


def fold_family(summary: DataFrame) -> DataFrame:
    """One row per (model, dataset), the family of datasets folded into its mean."""
    name = F.when(in_family(F.col("dataset")), F.lit(FAMILY)).otherwise(F.col("dataset"))
    return summary.withColumn("dataset", name).groupBy("model", "dataset").agg(F.avg("accuracy").alias("accuracy"))


def micro_macro(summary: DataFrame) -> DataFrame:
    """Micro accuracy (from raw counts) and macro accuracy (mean over all datasets, a missing one counts as 0)."""
    micro = summary.groupBy("model").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    folded = fold_family(summary)
    n_datasets = folded.agg(F.count_distinct("dataset")).scalar()
    sums = folded.groupBy("model").agg(F.sum("accuracy").alias("__acc"))
    return attach(micro, sums, ["model"]).select(
        "model",
        "correct",
        "total",
        F.coalesce(F.try_divide(F.col("correct") * 100.0, F.col("total")), F.lit(0.0)).alias("micro"),
        (F.col("__acc") / n_datasets).alias("macro"),
    )


def mean_accuracy(summary: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Mean accuracy per model over the datasets it has."""
    chosen = summary if datasets is None else summary.filter(F.col("dataset").isin(list(datasets)))
    return chosen.groupBy("model").agg(F.avg("accuracy").alias("mean_accuracy"))


def label_order(model: Column) -> list[Column]:
    """Sort keys of a model label: base first, then version, then step."""
    numbers = F.regexp_extract_all(model, F.lit(r"(\d+)"), 1)
    n = F.size(numbers)
    major = F.when(model == "base", F.lit(-1)).when(n > 0, F.get(numbers, F.lit(0)).cast("bigint")).otherwise(F.lit(999))
    minor = F.when((model != "base") & (n > 1), F.get(numbers, n - 1).cast("bigint")).otherwise(F.lit(0))
    return [major, minor]


def label_version(model: Column) -> Column:
    return F.nullif(F.regexp_extract(model, r"solver_v(\d+)", 1), F.lit("")).cast("int")


def versus_base(folded: DataFrame, base: str = "base") -> DataFrame:
    """Every other model's accuracy next to the base model's, per dataset.

    ``folded`` holds one row per (model, dataset): a small report table, so the join is left to the optimiser.
    """
    base_rows = folded.filter(F.col("model") == base).select("dataset", F.col("accuracy").alias("base_accuracy"))
    return attach(folded.filter(F.col("model") != base), base_rows, ["dataset"]).withColumn(
        "delta", F.col("accuracy") - F.col("base_accuracy")
    )


def trend(delta: Column, band: float = 0.01) -> Column:
    return F.when(delta > band, F.lit("better")).when(delta < -band, F.lit("worse")).when(delta.isNotNull(), F.lit("same"))


def verdicts(folded: DataFrame, base: str = "base", band: float = 0.01) -> DataFrame:
    """Trend counts per model against the base, and a one-word verdict.

    The trend counts only datasets both models have. The verdict treats a missing accuracy as 0 on either side.
    """
    base_rows = folded.filter(F.col("model") == base).select("dataset", F.col("accuracy").alias("base_accuracy"))
    others = folded.filter(F.col("model") != base).select("model", "dataset", "accuracy")
    # every model against every dataset, missing ones included; dataset names are a short list, one per benchmark
    names = folded.select("dataset").distinct().agg(F.collect_list("dataset")).scalar()
    grid = others.select("model").distinct().select("model", F.explode(names).alias("dataset"))
    grid = attach(attach(grid, base_rows, ["dataset"]), others, ["model", "dataset"])
    delta = F.col("accuracy") - F.col("base_accuracy")
    filled = F.coalesce("accuracy", F.lit(0.0)) - F.coalesce("base_accuracy", F.lit(0.0))
    out = grid.groupBy("model").agg(
        F.count_if(delta > band).alias("improving"),
        F.count_if(delta < -band).alias("decreasing"),
        F.count_if((delta <= band) & (delta >= -band)).alias("same"),
        F.coalesce(F.avg(delta), F.lit(0.0)).alias("avg_delta"),
        F.count_if(filled > band).alias("better_all"),
        F.count_if(filled < -band).alias("worse_all"),
    )
    verdict = (
        F.when(F.col("better_all") > F.col("worse_all"), F.lit("IMPROVING"))
        .when(F.col("worse_all") > F.col("better_all"), F.lit("DECREASING"))
        .otherwise(F.lit("MIXED/SAME"))
    )
    return out.withColumn("verdict", verdict)
