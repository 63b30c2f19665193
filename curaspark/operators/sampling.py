"""Small samples of a large table for people to read. The limit is the feature here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_examples(samples: DataFrame, proposals: DataFrame, n: int = 10, width: int = 500) -> DataFrame:
    """First rendered sample of each proposal, for the first ``n`` proposals by id, texts cut to ``width``."""
    firsts = samples.filter("is_rendered").groupBy("proposal_id").agg(F.min("sample_id").alias("rollout"))
    joined = firsts.join(proposals, "proposal_id").orderBy("proposal_id").limit(n)
    texts = [f.name for f in proposals.schema if f.name != "proposal_id" and f.dataType.simpleString() == "string"]
    file = F.concat(F.lit("proposal_"), F.col("proposal_id"), F.lit("_rollout_"), F.col("rollout"), F.lit(".png"))
    return joined.select("proposal_id", file.alias("file"), *[F.substring(t, 1, width).alias(t) for t in texts])


def sample_generations(rows: DataFrame, text: str, tie: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a reproducible shuffled order, by a seeded hash: each task keeps its ``n`` best, nothing is sorted whole."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(text), *[F.col(c).cast("string") for c in tie]))
    return rows.withColumn("shuffle_key", order).orderBy("shuffle_key", *tie).limit(n)
