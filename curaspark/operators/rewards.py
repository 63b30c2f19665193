"""Batch rewards for proposals and code, and the diversity terms that read the make-up of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.proposals import is_svg
from curaspark.operators.groups import attach
from curaspark.operators.votes import difficulty, majority_vote, solvability


def clamp(value: Column, limit: float) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), value))


# ---------------------------------------------------------------- make-up of a batch


def type_shares(rows: DataFrame, batch: Sequence[str], kind: str) -> DataFrame:
    """One row per (batch, kind): its count and share, the batch size and the number of kinds.

    The batch totals come from the counted rows, so the input is shuffled once.
    """
    counts = rows.groupBy(*batch, kind).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*batch).agg(F.sum("n").alias("n_batch"), F.count(F.lit(1)).alias("n_kinds"))
    return attach(counts, totals, batch, "inner").withColumn("share", F.col("n") / F.col("n_batch"))


def content_type_penalty(
    rows: DataFrame, batch: Sequence[str], kind: str, weight: float = 0.15, threshold: float = 0.5
) -> DataFrame:
    """Penalty of an over-represented content type; none in a batch of one row or of one type."""
    shares = type_shares(rows, batch, kind)
    excess = F.greatest(F.lit(0.0), F.col("share") - threshold)
    scaled = excess / (1.0 - threshold) if threshold < 1.0 else F.when(excess > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    penalty = F.when((F.col("n_batch") > 1) & (F.col("n_kinds") > 1), scaled * weight).otherwise(F.lit(0.0))
    return attach(rows, shares.select(*batch, kind, penalty.alias("content_type_penalty")), [*batch, kind], "inner")


def linear_type_bonus(share: Column, limit: float = 0.3) -> Column:
    return clamp(F.lit(0.25) / F.greatest(share, F.lit(0.01)) - 1.0, limit)


def tiered_type_bonus(share: Column, limit: float = 0.3) -> Column:
    return F.when(share > 0.8, F.lit(-limit * 2.0)).when(share > 0.6, F.lit(-limit * 1.5)).otherwise(linear_type_bonus(share, limit))


def code_diversity_penalty(
    rows: DataFrame, batch: Sequence[str], kind: str, subtype: str, target: float, bonus: float, limit: float = 0.4
) -> DataFrame:
    """Penalty for a dominating visual type plus one for a dominating subtype, less a bonus for a rare subtype.

    ``target`` (wanted share of a subtype) and ``bonus`` have no default: the formula does not fix them.
    """
    kinds = type_shares(rows, batch, kind).select(*batch, kind, F.col("share").alias("type_share"))
    subtypes = type_shares(rows, batch, subtype).select(*batch, subtype, F.col("share").alias("subtype_share"))
    share, part = F.col("type_share"), F.col("subtype_share")
    by_type = (
        F.when(share > 0.8, F.lit(limit * 2.0)).when(share > 0.6, F.lit(limit * 1.5)).when(share > 0.4, F.lit(limit * 0.5)).otherwise(F.lit(0.0))
    )
    excess = F.least(F.lit(1.0 - target), part - target)
    rare = F.when(part < max(0.05, target * 0.5), F.lit(-bonus)).otherwise(F.lit(0.0))
    over = F.least(F.lit(limit) * (1.0 + excess / (1.0 - target)), F.lit(limit * 2.5))
    by_subtype = F.when(part <= target, rare).otherwise(over)
    out = attach(attach(rows, kinds, [*batch, kind], "inner"), subtypes, [*batch, subtype], "inner")
    return out.withColumn("diversity_penalty", by_type + by_subtype)


# ---------------------------------------------------------------- proposals


def sample_scores(
    proposals: DataFrame, samples: DataFrame, easy: DataFrame, hard: DataFrame, order: Sequence[str], code_form: bool = False
) -> DataFrame:
    """Solvability and difficulty of every rendered sample.

    ``easy`` and ``hard`` hold one row per rollout: (proposal_id, sample_id, answer, order columns). A rendered sample
    without rollouts scores 0 on both.
    """
    key = ["proposal_id", "sample_id"]
    rendered = samples.filter("is_rendered").select(*key)
    items = attach(rendered, proposals.select("proposal_id", "easy_answer"), ["proposal_id"], "inner")
    solved = solvability(easy, items, key, "answer", "easy_answer", code_form=code_form)
    # rollouts of other proposals meet no item
    asked = proposals.select(F.col("proposal_id").alias("__asked"))
    hard = hard.join(asked, F.col("proposal_id").eqNullSafe(F.col("__asked")), "left_semi")
    votes = majority_vote(hard, key, "answer", order).select(*key, difficulty(F.col("score")).alias("difficulty"))
    return attach(solved, votes, key).select(*key, "solvability", F.coalesce("difficulty", F.lit(0.0)).alias("difficulty"))


def proposer_reward(
    proposals: DataFrame,
    samples: DataFrame,
    scores: DataFrame,
    solvability_cap: float | None = 0.5,
    easy_hard_threshold: float = 0.15,
    easy_hard_penalty: float = 0.3,
) -> DataFrame:
    """Reward of each proposal from its samples and the penalties already attached to it.

    ``proposals`` needs proposal_id and format_ok; optional columns content_type_penalty, diversity_penalty,
    cross_step_penalty, image_penalty and type_bonus enter the sum. A malformed proposal scores -1.
    ``solvability_cap=None`` and ``easy_hard_penalty=0`` give the image-diversity variant.
    """
    solved, hard = F.col("solvability"), F.col("difficulty")
    capped = F.least(solved, F.lit(solvability_cap)) if solvability_cap is not None else solved
    over_cap = solved > solvability_cap if solvability_cap is not None else F.lit(False)
    per_proposal = scores.groupBy("proposal_id").agg(
        F.sum(capped + hard).alias("__sum"),
        F.avg(solved).alias("__solv"),
        F.avg(hard).alias("__diff"),
        F.count(F.lit(1)).alias("__rendered"),
        F.count_if(over_cap).alias("__capped"),
    )
    counts = samples.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("__samples"))
    rows = attach(attach(proposals, per_proposal, ["proposal_id"]), counts, ["proposal_id"])
    have = set(proposals.columns)

    def term(name: str, sign: float) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) * sign if name in have else F.lit(0.0)

    n = F.greatest(F.coalesce("__samples", F.lit(0)), F.lit(1))
    avg_diff = F.coalesce("__diff", F.lit(0.0))
    too_easy = (F.coalesce("__rendered", F.lit(0)) > 0) & (avg_diff < easy_hard_threshold)
    eh = F.when(too_easy, F.lit(-easy_hard_penalty)).otherwise(F.lit(0.0)) if easy_hard_penalty else F.lit(0.0)
    parts = {
        "num_rendered": F.coalesce("__rendered", F.lit(0)),
        "num_rollouts": n,
        "avg_solvability": F.coalesce("__solv", F.lit(0.0)),
        "avg_difficulty": avg_diff,
        "n_capped": F.coalesce("__capped", F.lit(0)),
        "easy_hard_penalty": eh,
        "vt_diversity_bonus": term("type_bonus", 1.0),
        "content_type_diversity_bonus": term("content_type_penalty", -1.0),
        "caption_diversity_bonus": term("diversity_penalty", -1.0),
        "img_diversity_bonus": term("image_penalty", -1.0),
        "cross_step_penalty": term("cross_step_penalty", -1.0),
    }
    ok = F.col("format_ok")
    rows = rows.withColumn("__base", F.coalesce("__sum", F.lit(0.0)) / n)
    keep = [c for c in proposals.columns if c not in parts and not c.endswith("_penalty") and c != "type_bonus"]
    rows = rows.select(
        *keep,
        "__base",
        *[F.when(ok, c).otherwise(F.lit(0).cast("double") if i > 1 and k != "n_capped" else F.lit(0)).alias(k) for i, (k, c) in enumerate(parts.items())],
    )
    terms = [k for k in parts if k.endswith("_penalty") or k.endswith("_bonus")]
    total = F.col("__base")
    for t in terms:
        total = total + F.col(t)
    return rows.select(
        *keep,
        F.when(ok, total).otherwise(F.lit(-1.0)).alias("overall"),
        F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0)).alias("format"),
        *parts,
    )


def proposer_summary(rewards: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Per-batch means over well-formed proposals; ``avg_overall`` covers all of them."""
    ok = F.col("format") > 0

    def mean(name: str) -> Column:
        return F.avg(F.when(ok, F.col(name)))

    return rewards.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("format_ok"),
        mean("num_rendered").alias("avg_rendered"),
        mean("avg_solvability").alias("avg_solvability"),
        mean("avg_difficulty").alias("avg_difficulty"),
        F.sum("n_capped").alias("n_capped"),
        F.count_if(F.col("easy_hard_penalty") < 0).alias("n_penalized"),
        mean("vt_diversity_bonus").alias("avg_vt_bonus"),
        mean("content_type_diversity_bonus").alias("avg_content_type"),
        mean("caption_diversity_bonus").alias("avg_caption_div"),
        mean("cross_step_penalty").alias("avg_cross_step"),
        F.avg("overall").alias("avg_overall"),
    )


# ---------------------------------------------------------------- code


def codegen_reward(
    rows: DataFrame,
    compliant: Column | None = None,
    empty: Column | None = None,
    diversity: Column | None = None,
    no_render: float = 0.1,
    syntax_error: float = 0.05,
    wrong_type: float = 0.5,
    floor: float = -0.5,
) -> DataFrame:
    """Reward of each code answer: rendered + solvability + difficulty less penalties, never below ``floor``.

    ``rows`` needs code, is_rendered, solvability and difficulty. ``compliant`` and ``empty`` default to the checks of
    an SVG answer; ``diversity`` is subtracted from rendered answers only.
    """
    r = F.when(F.col("is_rendered"), F.lit(1.0)).otherwise(F.lit(0.0))
    compliant = is_svg(F.col("code")) if compliant is None else compliant
    empty = F.trim("code") == "" if empty is None else empty
    out = rows.select(
        "*",
        r.alias("renderability"),
        F.when(compliant, F.lit(1.0)).otherwise(F.lit(0.0)).alias("type_compliant"),
        F.when(empty, F.lit(1.0)).otherwise(F.lit(0.0)).alias("__empty"),
        (diversity if diversity is not None else F.lit(0.0)).alias("vt_diversity_penalty"),
    )
    for c in ("solvability", "difficulty"):
        out = out.withColumn(c, F.when(F.col("renderability") > 0, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)))
    penalty = F.col("__empty") * syntax_error + (1.0 - F.col("type_compliant")) * wrong_type
    shown = F.col("renderability") + F.col("solvability") + F.col("difficulty") - penalty - F.col("vt_diversity_penalty")
    overall = F.when(F.col("renderability") > 0, shown).otherwise(-penalty - no_render)
    return out.withColumn("overall", F.greatest(F.lit(floor), overall)).drop("__empty")


def codegen_summary(rewards: DataFrame, batch: Sequence[str]) -> DataFrame:
    shown = F.col("renderability") > 0
    return rewards.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(shown).alias("renderable"),
        F.count_if(F.col("type_compliant") > 0).alias("compliant"),
        F.avg(F.when(shown, F.col("solvability"))).alias("avg_solvability"),
        F.avg(F.when(shown, F.col("difficulty"))).alias("avg_difficulty"),
        F.avg("overall").alias("avg_overall"),
    )


def field_diversity_penalty(shares: dict[str, Column], n: Column, weights: dict[str, float], weight: float = 0.5) -> Column:
    """Weighted excess of cluster shares over a uniform batch, scaled by the batch size and clamped; 0 for one row."""
    excess = F.lit(0.0)
    for name, share in shares.items():
        excess = excess + F.lit(weights[name]) * (share - F.lit(1.0) / n)
    return F.when(n > 1, clamp(excess * n * weight, weight)).otherwise(F.lit(0.0))


def image_diversity_penalty(share: Column, n: Column, weight: float = 0.15) -> Column:
    return F.when(n > 1, clamp((share - F.lit(1.0) / n) * n * weight, weight)).otherwise(F.lit(0.0))
