"""Filtering rows and assembling training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.images import is_image_text
from curaspark.functions.prompts import proposal_prompt
from curaspark.functions.proposals import parse_strict, parse_tolerant
from curaspark.functions.text import strip
from curaspark.operators.groups import attach

# Topics that seed a proposal, in order.
SEED_TOPICS = [
    "chart and graph understanding",
    "statistical and trend analysis",
    "mathematical and quantitative reasoning",
    "spatial and geometric reasoning",
    "logical and abstract reasoning",
    "diagram and structural comprehension",
    "visual text recognition and OCR",
    "basic shape and object perception",
]
SEED_ROWS = 1008


def seed_topic(position: Column) -> Column:
    """Topic of the sample at a 0-based position."""
    topics = F.array(*[F.lit(t) for t in SEED_TOPICS])
    return F.get(topics, F.pmod(position, F.lit(len(SEED_TOPICS))).cast("int"))


def seed_prompts(spark, rows: int = SEED_ROWS) -> DataFrame:
    return spark.range(rows).select(seed_topic(F.col("id")).alias("problem"), F.lit("").alias("answer"))


def filled(*columns: str) -> Column:
    """None of the columns is NULL or empty."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.col(c), F.lit("")) != "")
    return out


def parse_proposals(rows: DataFrame, response: str, strict: bool = False, keep_incomplete: bool = True) -> DataFrame:
    """Parse the response of every row into proposal columns, evaluating the parser once per row.

    The strict form drops unparseable rows, or keeps them with NULL fields. The tolerant form keeps an unparseable
    response as its caption, or drops rows that lack a caption, an easy question or an easy answer.
    """
    text = F.col(response)
    keys = [c for c in rows.columns if c != response]
    if strict:
        found = F.array_compact(F.array(parse_strict(text)))
        return rows.select(*keys, F.inline_outer(found) if keep_incomplete else F.inline(found))
    found = F.array(parse_tolerant(text))
    if not keep_incomplete:
        found = F.filter(found, lambda p: p["parsed"])
    return rows.select(*keys, F.inline(found))


def complete_proposals(proposals: DataFrame) -> DataFrame:
    return proposals.filter(filled("caption", "easy_question", "easy_answer"))


def codegen_training_set(proposals: DataFrame) -> DataFrame:
    fields = ["caption", "easy_question", "easy_answer", "hard_question", "hard_answer"]
    return complete_proposals(proposals).select(
        *[c for c in proposals.columns if c.endswith("_id")],
        proposal_prompt(*[F.col(f) for f in fields]).alias("prompt_text"),
        "easy_answer",
        "caption",
        "easy_question",
        F.coalesce("hard_question", F.lit("")).alias("hard_question"),
        F.coalesce("hard_answer", F.lit("")).alias("hard_answer"),
        F.lit("svg").alias("visual_type"),
    )


def rendered_set(codes: DataFrame) -> DataFrame:
    """Rendered rows that carry a hard question and a hard answer."""
    return codes.filter(F.col("is_rendered") & filled("hard_question", "hard_answer"))


def render_rates(
    proposals: DataFrame, samples: DataFrame, key: Sequence[str], low: float = 0.25, high: float = 0.75
) -> DataFrame:
    """Share of rendered samples per proposal, and whether that keeps the proposal.

    ``outcome`` is kept, too_low or too_high; a proposal without any sample is too low.
    """
    rates = samples.groupBy(*key).agg(F.avg(F.col("is_rendered").cast("double")).alias("render_success_rate"))
    rate = F.col("render_success_rate")
    outcome = (
        F.when(rate.isNull() | (rate < low), F.lit("too_low")).when(rate > high, F.lit("too_high")).otherwise(F.lit("kept"))
    )
    return attach(proposals, rates, key).withColumn("outcome", outcome)


def evaluated_set(hard: DataFrame, easy: DataFrame, key: Sequence[str]) -> DataFrame:
    """Votes on the hard question with the agreement on the easy question; no easy vote counts as 0."""
    agreement = easy.select(*key, F.col("score").alias("easy_consistency"))
    return attach(hard.withColumn("hard_consistency", F.col("score")), agreement, key).withColumn(
        "easy_consistency", F.coalesce("easy_consistency", F.lit(0.0))
    )


def is_usable(answer: Column, image: Column) -> Column:
    return ~F.coalesce(answer, F.lit("")).isin("", "None") & is_image_text(image)


def solver_candidates(
    evaluated: DataFrame,
    min_easy: float = 0.5,
    min_hard: float = 0.25,
    max_hard: float = 0.75,
    min_score: float = 0.3,
    max_score: float = 0.8,
    bands: bool = True,
) -> DataFrame:
    """Mark every row with the reason it is rejected, NULL when it is kept.

    Rows on a band's edge are kept. When no row of the whole input has a consistency the older band on ``score``
    applies instead. ``bands=False`` only drops unusable rows.
    """
    reason = F.when(~is_usable(F.col("answer"), F.col("image")), F.lit("unusable"))
    if bands:
        columns = evaluated.columns
        easy = F.coalesce("easy_consistency", F.lit(0.0)) if "easy_consistency" in columns else F.lit(0.0)
        hard = F.coalesce("hard_consistency", F.lit(0.0)) if "hard_consistency" in columns else F.lit(0.0)
        if "easy_consistency" in columns:
            known = evaluated.agg(F.coalesce(F.max("easy_consistency") >= 0, F.lit(False))).scalar()
        else:
            known = F.lit(False)
        by_consistency = (
            F.when(easy < min_easy, F.lit("easy_low")).when(hard < min_hard, F.lit("hard_low")).when(hard > max_hard, F.lit("hard_high"))
        )
        by_score = F.when((F.col("score") < min_score) | (F.col("score") > max_score), F.lit("score"))
        evaluated = evaluated.withColumn("__known", known)
        reason = F.coalesce(reason, F.when(F.col("__known"), by_consistency).otherwise(by_score))
    return evaluated.withColumn("reject_reason", reason).drop("__known")


def solver_training_set(candidates: DataFrame) -> DataFrame:
    """Training rows of the kept candidates, absent fields filled with their defaults."""
    have = set(candidates.columns)

    def or_default(name: str, default) -> Column:
        return (F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)).alias(name)

    return candidates.filter("reject_reason IS NULL").select(
        F.col("question").alias("problem"),
        "answer",
        "score",
        or_default("hard_consistency", -1.0),
        or_default("easy_consistency", -1.0),
        strip(F.col("image")).alias("images"),
        or_default("question_type", "numerical").alias("problem_type"),
        or_default("caption", ""),
        or_default("easy_question", ""),
        or_default("easy_answer", ""),
    )


def reject_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def within_length(rows: DataFrame, length: Column, limit: int) -> DataFrame:
    """Rows whose token count is within the limit."""
    return rows.filter(length <= limit)


def score_stats(rows: DataFrame, scores: Sequence[str], sentinel: Sequence[str]) -> DataFrame:
    """n, min, max and mean per score column in one pass; negative sentinels of ``sentinel`` columns are left out."""

    def stats(name: str) -> Column:
        v = F.when(F.col(name) >= 0, F.col(name)) if name in sentinel else F.col(name)
        return F.struct(
            F.lit(name).alias("column"), F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")
        )

    names = [*scores, *sentinel]
    return rows.agg(F.array(*[stats(n) for n in names]).alias("s")).select(F.inline("s"))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram; every bin is listed, the last one includes its upper edge."""
    v = F.col(value)
    half = F.when(F.min(v) == F.max(v), F.lit(0.5)).otherwise(F.lit(0.0))
    limits = rows.agg(F.struct((F.min(v) - half).alias("lo"), (F.max(v) + half).alias("hi")).alias("e"))
    ranged = rows.filter(v.isNotNull()).select(v.alias("v"), limits.scalar().alias("e"))
    step = (F.col("e.hi") - F.col("e.lo")) / bins
    guess = F.least(F.floor((F.col("v") - F.col("e.lo")) / step), F.lit(bins - 1))
    ranged = ranged.select("v", "e", step.alias("step"), guess.alias("g"))
    # division may land next door: settle by the edges themselves
    low, high = F.col("e.lo") + F.col("g") * F.col("step"), F.col("e.lo") + (F.col("g") + 1) * F.col("step")
    settled = F.when(F.col("v") < low, F.col("g") - 1).when((F.col("v") >= high) & (F.col("g") < bins - 1), F.col("g") + 1).otherwise(F.col("g"))
    counts = ranged.groupBy(settled.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = limits.select("e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return attach(frame, counts, ["bin"]).select(
        "bin",
        (F.col("e.lo") + F.col("bin") * width).alias("low"),
        (F.col("e.lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
