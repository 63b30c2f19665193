"""Token-array queries: masks, padding, divergence and loss readings."""

from pyspark.sql import functions as F

from curaspark.functions import tokens as tk
from curaspark.functions.text import words
from curaspark.operators import advantages as adv
from curaspark.operators import metrics as mt
from curaspark.plans.advantages import TOKENS_SQL, by_token, token_rows, whiten_sql
from curaspark.plans.catalog import query
from curaspark.plans.rewards import rounded
from curaspark.plans.standins import view, with_views

IDS_SQL = (
    with_views("turns")
    + r", ids AS (SELECT rollout_id, step, list_transform(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x85\p{Z}]+'), lambda x: length(x)) AS ids FROM turns)"
)


def joined(column, name=None):
    """An array of whole numbers as one text."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(name or column)


def _ids(spark, sf):
    ids = F.transform(words(F.col("text")), lambda w: F.length(w))
    return view(spark, sf, "turns", wide=True).select("rollout_id", "step", ids.alias("ids"))


@query(
    "token_mask",
    IDS_SQL
    + """, ends AS (SELECT rollout_id, ids, list_min(list_filter([list_position(ids, 9), list_position(ids, 11)], lambda p: p > 0)) AS e FROM ids),
    masks AS (SELECT rollout_id, ids, list_transform(ids, lambda x, i: CASE WHEN e IS NULL OR i <= e THEN 1 ELSE 0 END) AS mask FROM ends),
    padded AS (SELECT rollout_id, mask, list_concat([0, 0, 0], mask) AS p FROM masks)
    SELECT rollout_id, array_to_string(mask, ' ') AS mask, array_to_string(list_transform(p, lambda x, i: GREATEST(0, list_sum(p[1:i]) - 1)::INT), ' ') AS position_ids FROM padded""",
)
def token_mask(spark, sf):
    rows = _ids(spark, sf).withColumn("mask", tk.response_mask(F.col("ids"), [9, 11]))
    padded = F.concat(F.array_repeat(F.lit(0), 3), "mask")  # three tokens of left padding
    return rows.withColumn("padded", padded).select("rollout_id", joined("mask"), joined(tk.position_ids(F.col("padded")), "position_ids"))


@query(
    "token_pad",
    IDS_SQL
    + """, s AS (SELECT rollout_id, ids, len(ids) AS n FROM ids)
    SELECT rollout_id, array_to_string(CASE WHEN n <= 64 THEN list_concat(list_transform(range(64 - n), lambda x: 0), ids) ELSE ids[n - 63:] END, ' ') AS left_left,
           array_to_string(CASE WHEN n <= 64 THEN list_concat(ids, list_transform(range(64 - n), lambda x: 0)) ELSE ids[1:64] END, ' ') AS right_right FROM s""",
)
def token_pad(spark, sf):
    ids = F.col("ids")
    return _ids(spark, sf).select(
        "rollout_id",
        joined(tk.pad_or_cut(ids, 64, F.lit(0), left_pad=True, truncation="left"), "left_left"),
        joined(tk.pad_or_cut(ids, 64, F.lit(0), left_pad=False, truncation="right"), "right_right"),
    )


@query(
    "masked_whiten",
    TOKENS_SQL
    + f""", {whiten_sql('tokens', 'r')}
    SELECT rollout_id, i::INT AS i, ROUND(white, 5) + 0.0 AS rewards FROM white""",
)
def masked_whiten(spark, sf):
    rows = token_rows(spark, sf).select("rollout_id", "step", "rewards", "mask")
    return by_token(adv.masked_whiten(rows, "rewards", "mask", ["step"]), ["rollout_id"], ["rewards"])


@query(
    "kl_estimators",
    TOKENS_SQL
    + """, k AS (SELECT rollout_id, m, old_lp - ref_lp AS d FROM tokens)
    SELECT rollout_id, ROUND(SUM(d * m) / (SUM(m) + 1e-8), 6) AS kl, ROUND(SUM(abs(d) * m) / (SUM(m) + 1e-8), 6) AS abs, ROUND(SUM(0.5::DOUBLE * d * d * m) / (SUM(m) + 1e-8), 6) AS mse,
           ROUND(SUM((EXP(-d) + d - 1) * m) / (SUM(m) + 1e-8), 6) AS low_var_kl FROM k GROUP BY rollout_id""",
)
def kl_estimators(spark, sf):
    old, ref = F.col("old_log_probs"), F.col("ref_log_probs")
    return token_rows(spark, sf).select(
        "rollout_id",
        *[F.round(tk.masked_mean(tk.kl_terms(old, ref, k), F.col("mask")), 6).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")],
    )


KL_SQL = (
    TOKENS_SQL
    + """, k AS (SELECT *, EXP(ref_lp - old_lp) - (ref_lp - old_lp) - 1 AS kl FROM tokens),
rowkl AS (SELECT step, rollout_id, SUM(kl * m) / (SUM(m) + 1e-8) AS response_kl, SUM(r - 0.2::DOUBLE * kl * m) AS reward FROM k GROUP BY step, rollout_id),
stepkl AS (SELECT step, AVG(response_kl) AS kl, COUNT(*) AS n_rows, SUM(reward) AS reward FROM rowkl GROUP BY step)
"""
)


def _penalized(spark, sf):
    rows = token_rows(spark, sf).withColumnRenamed("rewards", "token_level_scores")
    return mt.kl_penalized(rows, F.lit(0.2), "low_var_kl")


@query("kl_penalty", KL_SQL + "SELECT step, rollout_id, ROUND(response_kl, 6) AS response_kl, ROUND(reward, 6) AS reward FROM rowkl")
def kl_penalty(spark, sf):
    return _penalized(spark, sf).select(
        "step", "rollout_id", F.round("response_kl", 6).alias("response_kl"), F.round(tk.total(F.col("token_level_rewards")), 6).alias("reward")
    )


@query(
    "kl_controller",
    KL_SQL
    + """, f AS (SELECT *, 1 + LEAST(GREATEST(kl / 0.03 - 1, -0.2::DOUBLE), 0.2::DOUBLE) * n_rows / 1000.0 AS f FROM stepkl),
    c AS (SELECT step, kl, n_rows, 0.2::DOUBLE * EXP(SUM(LN(f)) OVER (ORDER BY step)) AS coef_after, f FROM f)
    SELECT step, ROUND(kl, 6) AS kl, n_rows, ROUND(coef_after / f, 6) AS coef, ROUND(coef_after, 6) AS coef_after FROM c""",
)
def kl_controller(spark, sf):
    steps = mt.kl_per_step(_penalized(spark, sf), ["step"])
    return rounded(mt.kl_controller(steps, init=0.2, target=0.03, horizon=1000.0), "kl", "coef", "coef_after")


ADV_SQL = TOKENS_SQL + ", a AS (SELECT rollout_id, (COUNT(*) % 7 - 3) / 2.0::DOUBLE AS a FROM tokens GROUP BY rollout_id)"

LOSS_SQL = {
    "default": ("lp - old_lp", None),
    "gspo": ("seq_gap * m", None),
    "gspo_token": ("seq_gap", None),
    "cispo": ("lp - old_lp", "-a * lp * clipped"),
    "sapo": ("lp - old_lp", "-a * CASE WHEN a >= 0 THEN 4.0 / (1 + EXP(-(ratio - 1))) ELSE 4.0::DOUBLE / 1.05::DOUBLE / (1 + EXP(-1.05::DOUBLE * (ratio - 1))) END"),
}


def _loss_sql(kind: str) -> str:
    gap, loss = LOSS_SQL[kind]
    loss = loss or "CASE WHEN a < 0 THEN LEAST(GREATEST(-a * ratio, -a * clipped), -a * 3) ELSE GREATEST(-a * ratio, -a * clipped) END"
    fractions = kind in ("default", "gspo", "gspo_token")
    high = "CASE WHEN -a * ratio < -a * clipped THEN 1.0 ELSE 0.0 END" if fractions else "NULL::DOUBLE"
    low = "CASE WHEN a < 0 AND GREATEST(-a * ratio, -a * clipped) > -a * 3 THEN 1.0 ELSE 0.0 END" if fractions else "NULL::DOUBLE"
    return f"""SELECT '{kind}' AS loss_type, step, ROUND(SUM(s_loss) / (SUM(n) + 1e-8), 6) AS loss, ROUND(AVG(s_loss / (n + 1e-8)), 6) AS loss_seq,
        ROUND(SUM(s_kl) / (SUM(n) + 1e-8), 6) AS ppo_kl, ROUND(SUM(s_high) / (SUM(n) + 1e-8), 6) AS pg_clipfrac_higher, ROUND(SUM(s_low) / (SUM(n) + 1e-8), 6) AS pg_clipfrac_lower
      FROM (SELECT step, rollout_id, SUM(m) AS n, SUM(m * ({loss})) AS s_loss, SUM(m * (old_lp - lp)) AS s_kl, SUM(m * {high}) AS s_high, SUM(m * {low}) AS s_low
            FROM (SELECT *, EXP(g) AS ratio, EXP(LEAST(GREATEST(g, LN(0.8::DOUBLE)), LN(1.3::DOUBLE))) AS clipped FROM (SELECT *, {gap} AS g FROM full_rows)) GROUP BY step, rollout_id) GROUP BY step"""


@query(
    "policy_diagnostics",
    ADV_SQL
    + """, seq AS (SELECT rollout_id, SUM((lp - old_lp) * m) / (SUM(m) + 1e-8) AS seq_gap FROM tokens GROUP BY rollout_id),
    full_rows AS (SELECT t.*, a, seq_gap FROM tokens t JOIN a USING (rollout_id) JOIN seq USING (rollout_id))
    """
    + " UNION ALL ".join(_loss_sql(k) for k in LOSS_SQL),
)
def policy_diagnostics(spark, sf):
    rows = token_rows(spark, sf).withColumn("advantage", (F.size("mask") % 7 - 3) / F.lit(2.0))
    out = mt.policy_diagnostics(rows, ["step"], "rollout_id", list(LOSS_SQL))
    out = out.select("loss_type", "step", "loss", "loss_seq", "ppo_kl", "pg_clipfrac_higher", "pg_clipfrac_lower")
    return rounded(out, "loss", "loss_seq", "ppo_kl", "pg_clipfrac_higher", "pg_clipfrac_lower")


@query(
    "value_diagnostics",
    TOKENS_SQL
    + """, l AS (SELECT *, -lp AS p, -old_lp AS ret FROM tokens),
    c AS (SELECT *, LEAST(GREATEST(p, v - 0.15::DOUBLE), v + 0.15::DOUBLE) AS near FROM l),
    e AS (SELECT step, rollout_id, SUM(m) AS n, SUM(m * 0.5::DOUBLE * GREATEST((p - ret) * (p - ret), (near - ret) * (near - ret))) AS s_loss,
            SUM(m * CASE WHEN (p - ret) * (p - ret) < (near - ret) * (near - ret) THEN 1.0 ELSE 0.0 END) AS s_frac, SUM(m * p) AS s_p FROM c GROUP BY step, rollout_id)
    SELECT step, ROUND(SUM(s_loss) / (SUM(n) + 1e-8), 6) AS vf_loss, ROUND(AVG(s_loss / (n + 1e-8)), 6) AS vf_loss_seq, ROUND(SUM(s_frac) / (SUM(n) + 1e-8), 6) AS vf_clipfrac,
           ROUND(SUM(s_p) / (SUM(n) + 1e-8), 6) AS vpred_mean FROM e GROUP BY step""",
)
def value_diagnostics(spark, sf):
    rows = token_rows(spark, sf).withColumn("predictions", F.transform("log_probs", lambda x: -x)).withColumn("returns", F.transform("old_log_probs", lambda x: -x))
    out = mt.value_diagnostics(rows, ["step"], "rollout_id", clip_range=0.15)
    return rounded(out, "vf_loss", "vf_loss_seq", "vf_clipfrac", "vpred_mean")


@query(
    "reward_tokens",
    with_views("turns")
    + r""", w AS (SELECT rollout_id, len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x85\p{Z}]+')) AS n FROM turns),
    t AS (SELECT rollout_id, n, unnest(range(n + 3)) AS spot FROM w)
    SELECT rollout_id, COUNT(*) AS width, SUM(CASE WHEN spot = n - 1 THEN n / 10.0 ELSE 0.0 END) AS total, COALESCE(MAX(spot) FILTER (spot = n - 1), -1)::BIGINT AS place FROM t GROUP BY rollout_id""",
    doubles=("total",),
)
def reward_tokens(spark, sf):
    """The score of a response on its last token, the padding behind it without reward."""
    rows = view(spark, sf, "turns", wide=True).select("rollout_id", F.size(words(F.col("text"))).alias("n"))
    rewards = rows.select("rollout_id", tk.reward_at_last_token(F.col("n") / 10.0, F.col("n"), F.col("n") + 3).alias("r"))
    place = F.coalesce(F.array_position(F.transform("r", lambda x: x != 0.0), F.lit(True)) - 1, F.lit(-1)).cast("bigint")
    return rewards.select("rollout_id", F.size("r").cast("bigint").alias("width"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x).alias("total"), place.alias("place"))
