"""Rewards that users register by name, over the answers of evaluated models."""

import os

from pyspark.sql import functions as F

from curaspark.operators import registry
from curaspark.plans.catalog import query
from curaspark.plans.standins import view, with_views

SCORED_SQL = """ SELECT model, dataset, COUNT(*) AS n, ROUND(SUM(overall), 4) AS overall, ROUND(SUM(detail), 4) AS detail FROM scored GROUP BY model, dataset"""


def _scored(spark, sf, name, fn, kind, metric, **options):
    records = view(spark, sf, "eval_records", wide=True).withColumnRenamed("model_response", "response")
    registry.register_reward(name, fn, kind)
    scored = registry.score_rows(records, name, **options)
    sums = scored.groupBy("model", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reward.overall"), 4).alias("overall"), F.round(F.sum(F.col("reward.metrics")[metric]), 4).alias("detail")
    )
    return sums


def boxed_reward(inputs, weight=0.5):
    """Column form: whether the response has a box, and whether it ends with the ground truth in it."""
    boxed = inputs["response"].contains("boxed{").cast("double")
    right = F.coalesce(inputs["response"].endswith(F.concat(F.lit("boxed{"), inputs["ground_truth"], F.lit("}"))).cast("double"), F.lit(0.0))
    return F.struct((weight * boxed + (1 - weight) * right).alias("overall"), right.alias("right"))


@query(
    "user_reward_column",
    with_views("eval_records")
    + """, scored AS (SELECT model, dataset, CASE WHEN ends_with(model_response, CONCAT('boxed{', ground_truth, '}')) THEN 1.0 ELSE 0.0 END AS detail,
        0.5 * CASE WHEN contains(model_response, 'boxed{') THEN 1 ELSE 0 END + 0.5 * CASE WHEN ends_with(model_response, CONCAT('boxed{', ground_truth, '}')) THEN 1 ELSE 0 END AS overall FROM eval_records)"""
    + SCORED_SQL,
    doubles=("overall", "detail"),
)
def user_reward_column(spark, sf):
    return _scored(spark, sf, "boxed", boxed_reward, "column", "right")


def brevity_reward(reward_input):
    """Sequential form: shorter responses score higher."""
    length = len(reward_input["response"])
    return {"overall": 1.0 / (1 + length), "length": length, "known": float(bool(reward_input["ground_truth"]))}


@query(
    "user_reward_sequential",
    with_views("eval_records")
    + """, scored AS (SELECT model, dataset, 1.0::DOUBLE / (1 + length(model_response)) AS overall, length(model_response)::DOUBLE AS detail FROM eval_records)"""
    + SCORED_SQL,
    doubles=("overall", "detail"),
)
def user_reward_sequential(spark, sf):
    return _scored(spark, sf, "brevity", brevity_reward, "sequential", "length")


def relative_length_reward(reward_inputs):
    """Batch form: how much shorter a response is than its batch on average, and how large the batch is."""
    lengths = [len(r["response"]) for r in reward_inputs]
    mean = sum(lengths) / len(lengths)
    return [{"overall": (mean - x) / mean, "of": len(lengths)} for x in lengths]


@query(
    "user_reward_batch",
    with_views("eval_records")
    + """, b AS (SELECT model, dataset, length(model_response) AS x, AVG(length(model_response)) OVER (PARTITION BY item) AS mean, COUNT(*) OVER (PARTITION BY item) AS size FROM eval_records),
    scored AS (SELECT model, dataset, (mean - x) / mean AS overall, size::DOUBLE AS detail FROM b)"""
    + SCORED_SQL,
    doubles=("overall", "detail"),
)
def user_reward_batch(spark, sf):
    # a batch is what belongs to one item, over all models
    return _scored(spark, sf, "relative_length", relative_length_reward, None, "of", batch=["item"])


@query(
    "user_reward_file",
    with_views("eval_records")
    + """, scored AS (SELECT model, dataset, 0.75 * CASE WHEN contains(model_response, ground_truth) THEN 1 ELSE 0 END + 0.25 * CASE WHEN item % 5 = 0 THEN 0 ELSE item % 4 END / 4.0 AS overall,
        length(CONCAT('Question ', item)) + length(ground_truth) + length(dataset) AS detail FROM eval_records)"""
    + SCORED_SQL,
    doubles=("overall", "detail"),
)
def user_reward_file(spark, sf):
    """A reward of the list interface, loaded from its file; it asks for the question, further answers and the images.

    The question stands under ``raw_prompt_text`` and the images under ``image``, which serve where the first names are missing.
    """
    records = view(spark, sf, "eval_records", wide=True).withColumnsRenamed({"model_response": "response"})
    records = records.withColumns(
        {
            "raw_prompt_text": F.concat(F.lit("Question "), F.col("item").cast("string")),
            "description_answers": F.array("ground_truth", "dataset"),
            "image": F.when(F.col("item") % 5 != 0, F.array_repeat(F.lit("image"), (F.col("item") % 4).cast("int"))),
        }
    )
    reward = registry.load_reward(os.path.join(os.path.dirname(__file__), "example_reward.py"), weight=0.75)
    scored = registry.score_rows(records, reward.name, batch=["item"], order=["model", "dataset"])
    return scored.groupBy("model", "dataset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("reward.overall"), 4).alias("overall"), F.round(F.sum(F.col("reward.metrics")["asked"]), 4).alias("detail")
    )
