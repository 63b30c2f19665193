"""Token arrays: masks, padding, element-wise terms and reverse recursions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.text import let

EPS = 1e-8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked_total(values: Column, mask: Column) -> Column:
    return total(F.zip_with(values, mask, lambda v, m: v * m))


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_total(values, mask) / (total(mask.cast("array<double>")) + EPS)


def response_mask(ids: Column, eos: Sequence[int]) -> Column:
    """1 up to and including the first end token, 0 after it; all 1 without an end token."""
    ends = F.array_compact(F.array(*[F.nullif(F.array_position(ids, F.lit(e)), F.lit(0)) for e in eos]))
    return let(
        F.coalesce(F.array_min(ends), F.size(ids).cast("bigint")),
        lambda last: F.transform(ids, lambda _, i: F.when(i < last, F.lit(1)).otherwise(F.lit(0))),
    )


def position_ids(mask: Column) -> Column:
    """clip(cumsum(mask) - 1, 0) for a mask made of left padding, tokens and right padding.

    Counting ones before a position needs no running sum there: ones start at the first 1 and end at the last.
    """
    first = F.array_position(mask, F.lit(1))
    ones = F.size(F.filter(mask, lambda m: m == 1))

    def ids(s: Column) -> Column:
        return F.transform(
            mask,
            lambda _, i: F.when(s["first"] == 0, F.lit(0)).otherwise(
                F.greatest(F.lit(0), F.least(i + 2 - s["first"], s["ones"]) - 1).cast("int")
            ),
        )

    return let(F.struct(first.alias("first"), ones.alias("ones")), ids)


def pad_or_cut(
    ids: Column, length: int, pad: Column, left_pad: bool = True, truncation: str = "error"
) -> Column:
    """Array of exactly ``length``: padded left or right, or cut on the left or right, or an error when too long."""
    if truncation not in ("left", "right", "error"):
        raise ValueError(f"unknown truncation {truncation}")
    n = F.size(ids)
    fill = F.array_repeat(pad, F.greatest(F.lit(length) - n, F.lit(0)))
    padded = F.concat(fill, ids) if left_pad else F.concat(ids, fill)
    cut = {
        "left": F.slice(ids, F.greatest(n - length + 1, F.lit(1)), F.lit(length)),
        "right": F.slice(ids, 1, length),
        "error": F.raise_error(F.concat(F.lit("sequence of "), n.cast("string"), F.lit(f" tokens is longer than {length}"))),
    }[truncation]
    return F.when(n <= length, padded).otherwise(cut)


def kl_terms(log_probs: Column, ref_log_probs: Column, kind: str) -> Column:
    """Per-token estimate of the divergence from the reference policy."""
    estimators = {
        "kl": lambda p, q: p - q,
        "abs": lambda p, q: F.abs(p - q),
        "mse": lambda p, q: F.lit(0.5) * (p - q) * (p - q),
        "low_var_kl": lambda p, q: low_variance_kl(p, q),
    }
    if kind not in estimators:
        raise ValueError(f"unknown estimator {kind}")
    return F.zip_with(log_probs, ref_log_probs, estimators[kind])


def low_variance_kl(p: Column, q: Column) -> Column:
    gap = clip(q - p, -20.0, 20.0)
    return clip(F.exp(gap) - gap - 1.0, -10.0, 10.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def reward_at_last_token(score: Column, length: Column, width: Column) -> Column:
    """Token rewards of a response: the score on its last valid token, 0 elsewhere."""
    at = F.struct(score.cast("double").alias("score"), (length - 1).alias("spot"))
    zeros = F.array_repeat(F.lit(0.0), width)
    return let(at, lambda s: F.transform(zeros, lambda z, i: F.when(i == s["spot"], s["score"]).otherwise(z)))


def spread(advantage: Column, mask: Column) -> Column:
    """The same advantage on every valid token."""
    return let(advantage, lambda a: F.transform(mask, lambda m: a * m))


# ---- reverse recursions: vectorised over the rows of an Arrow batch, one numpy step per token position


def _blocks(lengths: np.ndarray, cells: int = 2_000_000) -> Iterator[np.ndarray]:
    """Row numbers in blocks of similar length, each block within ``cells`` matrix cells."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * max(int(lengths[order[stop]]), 1) <= cells:
            stop += 1
        yield order[start:stop]
        start = stop


def _matrix(column: pd.Series, rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = column.iloc[r]
        out[i, : len(v)] = v
    return out


def _scan(columns: list[pd.Series], step) -> pd.Series:
    """Run ``step(t, [column at t], state) -> (output at t, state)`` from the last position to the first."""
    lengths = columns[0].map(len).to_numpy()
    result: list = [None] * len(lengths)
    for rows in _blocks(lengths):
        width = int(lengths[rows].max(initial=0))
        mats = [_matrix(c, rows, width) for c in columns]
        out = np.zeros((len(rows), width))
        state = (np.zeros(len(rows)), np.zeros(len(rows)))
        for t in range(width - 1, -1, -1):
            out[:, t], state = step([m[:, t] for m in mats], state)
        for i, r in enumerate(rows):
            result[r] = out[i, : lengths[r]]
    return pd.Series(result)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted sum of the rewards, restarted wherever the mask is 0."""

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, m: pd.Series) -> pd.Series:
        def step(at, state):
            value = at[0] + gamma * state[0]
            return value, (value * at[1], state[1])

        return _scan([r, m], step)

    return run(rewards, mask.cast("array<double>"))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates; a masked token passes on what follows it unchanged."""

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, v: pd.Series, m: pd.Series) -> pd.Series:
        def step(at, state):
            following, carried = state
            fresh = at[0] + gamma * following - at[1] + gamma * lam * carried
            on = at[2] > 0
            carried = np.where(on, fresh, carried)
            return carried, (np.where(on, at[1], following), carried)

        return _scan([r, v, m], step)

    return run(rewards, values, mask.cast("array<double>"))


def suffix_sums(values: Column) -> Column:
    return discounted_returns(values, F.transform(values, lambda _: F.lit(1.0)), 1.0)
