"""Advantage queries."""

from pyspark.sql import functions as F

from curaspark.functions import tokens as tk
from curaspark.functions.text import words
from curaspark.operators import advantages as adv
from curaspark.plans.catalog import query
from curaspark.plans.standins import view, with_views

ROLLOUTS = with_views("rollouts")


def _scored(spark, sf):
    return view(spark, sf, "rollouts").withColumnRenamed("overall", "score")


def _out(df, *extra):
    return df.select("uid", "rollout_id", F.round("advantage", 6).alias("advantage"), *extra)


@query(
    "adv_grpo",
    ROLLOUTS
    + """, s AS (SELECT uid, AVG(overall) AS m, STDDEV_SAMP(overall) AS sd FROM rollouts GROUP BY uid)
    SELECT r.uid, rollout_id, ROUND((overall - m) / (sd + 1e-6), 6) AS advantage FROM rollouts r JOIN s ON s.uid = r.uid""",
)
def adv_grpo(spark, sf):
    return _out(adv.advantage("grpo", _scored(spark, sf)))


@query(
    "adv_passk",
    ROLLOUTS
    + """, s AS (SELECT uid, STDDEV_SAMP(overall) AS sd FROM rollouts GROUP BY uid),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY uid ORDER BY overall DESC, rollout_id) AS rn, LEAD(overall) OVER (PARTITION BY uid ORDER BY overall DESC, rollout_id) AS second FROM rollouts)
    SELECT r.uid, rollout_id, ROUND(CASE WHEN rn = 1 THEN (overall - second) / (sd + 1e-6) ELSE 0.0 END, 6) AS advantage FROM r JOIN s ON s.uid = r.uid""",
)
def adv_passk(spark, sf):
    return _out(adv.advantage("grpo_passk", _scored(spark, sf)))


@query(
    "adv_rloo",
    ROLLOUTS
    + """, s AS (SELECT uid, SUM(overall) AS t, COUNT(*) AS n FROM rollouts GROUP BY uid)
    SELECT r.uid, rollout_id, ROUND(overall - (t - overall) / (n - 1), 10) AS advantage FROM rollouts r JOIN s ON s.uid = r.uid""",
)
def adv_rloo(spark, sf):
    # ten digits: the quotient is a short decimal that would sit on a rounding edge at six
    return adv.advantage("rloo", _scored(spark, sf)).select("uid", "rollout_id", F.round("advantage", 10).alias("advantage"))


@query(
    "filter_online",
    ROLLOUTS
    + """, s AS (SELECT uid, AVG(overall) AS m FROM rollouts GROUP BY uid)
    SELECT r.* FROM rollouts r JOIN s ON s.uid = r.uid WHERE m > 0.4 AND m < 0.45""",
)
def filter_online(spark, sf):
    return adv.online_filter(view(spark, sf, "rollouts"), ["uid"], "overall", 0.4, 0.45)


@query(
    "quota_fill",
    ROLLOUTS
    + """, g AS (SELECT uid, MIN(rollout_id) AS arrival FROM rollouts GROUP BY uid ORDER BY arrival LIMIT 10)
    SELECT uid, rollout_id, overall FROM rollouts WHERE uid IN (SELECT uid FROM g)""",
)
def quota_fill(spark, sf):
    return adv.fill_quota(view(spark, sf, "rollouts").select("uid", "rollout_id", "overall"), "uid", "rollout_id", 10)


# token arrays of a turn: every word is a token; two-letter words stand in for masked tokens
def token_rows(spark, sf):
    w = F.col("w")
    rows = view(spark, sf, "turns", wide=True).select("uid", "rollout_id", "step", "turn", words(F.col("text")).alias("w"))
    return rows.filter(F.size(w) > 0).select(
        "uid",
        "rollout_id",
        "step",
        "turn",
        F.transform(w, lambda x: (F.length(x) % 5) / F.lit(10.0)).alias("rewards"),
        F.transform(w, lambda x: (F.length(x) % 3) / F.lit(10.0)).alias("values"),
        F.transform(w, lambda x: -(F.length(x) % 7) / F.lit(10.0)).alias("old_log_probs"),
        F.transform(w, lambda x: -(F.length(x) % 4) / F.lit(8.0)).alias("ref_log_probs"),
        F.transform(w, lambda x: -(F.length(x) % 6) / F.lit(9.0)).alias("log_probs"),
        F.transform(w, lambda x: F.when(F.length(x) == 2, F.lit(0)).otherwise(F.lit(1))).alias("mask"),
    )


TOKENS_SQL = (
    with_views("turns")
    + r""", lists AS (SELECT uid, rollout_id, step, turn, regexp_extract_all(text, '[^\t-\r\x1c-\x20\x85\p{Z}]+') AS w FROM turns),
tokens AS (SELECT uid, rollout_id, step, turn, i, (l % 5) / 10.0::DOUBLE AS r, (l % 3) / 10.0::DOUBLE AS v, -(l % 7) / 10.0::DOUBLE AS old_lp, -(l % 4) / 8.0::DOUBLE AS ref_lp,
    -(l % 6) / 9.0::DOUBLE AS lp, CASE WHEN l = 2 THEN 0 ELSE 1 END AS m
  FROM (SELECT uid, rollout_id, step, turn, length(UNNEST(w)) AS l, generate_subscripts(w, 1) AS i FROM lists))
"""
)


def whiten_sql(source: str, column: str) -> str:
    return f"""{column}_stats AS (SELECT step, AVG({column}) AS mean, VAR_SAMP({column}) AS var FROM {source} WHERE m = 1 GROUP BY step),
    white AS (SELECT t.*, ({column} - mean) / SQRT(var + 1e-8) AS white FROM {source} t JOIN {column}_stats s ON s.step = t.step)"""


def by_token(df, keys, columns, digits: int = 5):
    """One row per token, numbered from 1; values rounded, and -0.0 written as 0.0."""
    spots = df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("i", "t"))
    return spots.select(
        *keys, (F.col("i") + 1).alias("i"), *[(F.round(F.col(f"t.{c}"), digits) + F.lit(0.0)).alias(c) for c in columns]
    )


@query(
    "adv_rpp",
    TOKENS_SQL
    + f""", seg AS (SELECT *, SUM(1 - m) OVER (PARTITION BY rollout_id ORDER BY i) AS seg FROM tokens),
    rel AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rollout_id, seg ORDER BY i) AS k FROM seg),
    ret AS (SELECT *, SUM(r * POW(0.97::DOUBLE, k)) OVER (PARTITION BY rollout_id, seg ORDER BY i DESC) / POW(0.97::DOUBLE, k) AS ret FROM rel),
    {whiten_sql('ret', 'ret')}
    SELECT uid, rollout_id, i::INT AS i, ROUND(white, 5) + 0.0 AS advantage, ROUND(ret, 5) + 0.0 AS returns FROM white""",
)
def adv_rpp(spark, sf):
    out = adv.advantage("reinforce_plus_plus", token_rows(spark, sf), batch=["step"], gamma=0.97)
    return by_token(out, ["uid", "rollout_id"], ["advantage", "returns"])


@query(
    "adv_remax",
    TOKENS_SQL
    + """, sums AS (SELECT rollout_id, SUM(r) AS s FROM tokens GROUP BY rollout_id),
    base AS (SELECT uid, MAX(s) FILTER (turn = 0) AS b FROM sums JOIN (SELECT DISTINCT uid, rollout_id, turn FROM tokens) USING (rollout_id) GROUP BY uid),
    x AS (SELECT t.uid, t.rollout_id, i, (s - b) * m AS a, SUM(r * m) OVER (PARTITION BY t.rollout_id ORDER BY i DESC) AS ret FROM tokens t JOIN sums USING (rollout_id) JOIN base ON base.uid = t.uid WHERE b IS NOT NULL)
    SELECT uid, rollout_id, i::INT AS i, ROUND(a, 5) + 0.0 AS advantage, ROUND(ret, 5) + 0.0 AS returns FROM x""",
)
def adv_remax(spark, sf):
    rows = token_rows(spark, sf)
    # the first turn of a conversation stands in for the greedy response
    greedy = rows.filter("turn = 0").select("uid", tk.total(F.col("rewards")).alias("baseline"))
    out = adv.advantage("remax", rows.join(greedy, "uid"))
    return by_token(out, ["uid", "rollout_id"], ["advantage", "returns"])


@query(
    "adv_gae",
    TOKENS_SQL
    + f""", on_tokens AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rollout_id ORDER BY i) AS k, r + 0.99::DOUBLE * COALESCE(LEAD(v) OVER (PARTITION BY rollout_id ORDER BY i), 0) - v AS delta FROM tokens WHERE m = 1),
    est AS (SELECT rollout_id, i, SUM(delta * POW(0.99::DOUBLE * 0.95::DOUBLE, k)) OVER (PARTITION BY rollout_id ORDER BY i DESC) / POW(0.99::DOUBLE * 0.95::DOUBLE, k) AS a FROM on_tokens),
    raw AS (SELECT t.*, COALESCE(FIRST_VALUE(a IGNORE NULLS) OVER (PARTITION BY t.rollout_id ORDER BY t.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS raw FROM tokens t LEFT JOIN est e ON e.rollout_id = t.rollout_id AND e.i = t.i),
    {whiten_sql('raw', 'raw')}
    SELECT uid, rollout_id, i::INT AS i, ROUND(white, 5) + 0.0 AS advantage, ROUND(raw + v, 5) + 0.0 AS returns FROM white""",
)
def adv_gae(spark, sf):
    out = adv.advantage("gae", token_rows(spark, sf), batch=["step"], gamma=0.99, lam=0.95)
    return by_token(out, ["uid", "rollout_id"], ["advantage", "returns"])
