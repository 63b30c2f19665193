"""Bookkeeping of runs: latest completed step, retention, what is left to do, and collected episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.operators.groups import attach


def latest_completed(tracker: DataFrame, steps: DataFrame, run: str = "run") -> DataFrame:
    """Last step each run's tracker names, NULL when that step was never stored.

    ``tracker`` has (run, last_step), ``steps`` the stored (run, step) pairs.
    """
    stored = steps.select(run, F.col("step").alias("last_step"), F.col("step").alias("latest")).distinct()
    return attach(tracker, stored, [run, "last_step"]).select(run, F.col("latest").alias("step"))


def obsolete_steps(steps: DataFrame, current: DataFrame, limit: int, run: str = "run") -> DataFrame:
    """Stored steps a run no longer keeps. Lists them; deletes nothing.

    ``current`` has (run, current_step, best_step). Of the steps before the current one the newest ``limit - 1`` stay;
    the best step always stays and takes one of those places.
    """
    if limit <= 0:
        return steps.select(run, "step").limit(0)
    older = steps.select(run, "step").distinct().join(current, run).filter(F.col("step") < F.col("current_step"))
    others = older.filter(~F.col("step").eqNullSafe(F.col("best_step"))).select(run, "step")
    has_best = older.groupBy(run).agg(F.max(F.col("step").eqNullSafe(F.col("best_step")).cast("int")).alias("__best"))
    # the newest steps of a run: at most ``limit - 1`` rows per run leave each map task
    newest = Window.partitionBy(run).orderBy(F.desc("step"))
    places = others.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= limit - 1)
    kept = places.join(has_best, run).filter(F.col("__rn") <= F.lit(limit - 1) - F.col("__best")).select(run, "step")
    return others.join(kept, [run, "step"], "left_anti")


def next_step(steps: DataFrame, run: str = "run") -> DataFrame:
    return steps.groupBy(run).agg((F.max("step") + 1).alias("next_step"))


def pending(planned: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Planned phases whose output does not exist yet."""
    return planned.join(done.select(*key).distinct(), list(key), "left_anti")


def episode_rounds(episodes: DataFrame) -> DataFrame:
    """One row per round of each episode."""
    return episodes.select("episode_id", "device_id", F.explode("rounds").alias("r")).select("episode_id", "device_id", "r.*")


def device_summary(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("total_episodes"),
        F.count_if("success").alias("successful_episodes"),
        F.sum("completed_rounds").alias("total_rounds_collected"),
    )


def total_summary(devices: DataFrame) -> DataFrame:
    return devices.agg(
        F.count(F.lit(1)).alias("total_devices"),
        F.sum("total_episodes").alias("total_episodes"),
        F.sum("successful_episodes").alias("successful_episodes"),
        F.sum("total_rounds_collected").alias("total_rounds_collected"),
    )


def game_summary(results: DataFrame) -> DataFrame:
    """Games and mean final score per model; games without a score count only as games."""
    return results.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("games"), F.count("final_score").alias("scored"), F.avg("final_score").alias("avg_score")
    )
