"""Batch reward queries."""

from pyspark.sql import functions as F

from curaspark.functions.proposals import code_subtype, normalize_visual_type, visual_type_of_code
from curaspark.operators import rewards as rw
from curaspark.operators import votes
from curaspark.operators.groups import attach
from curaspark.plans.answers import ORDER, SERVICE_SQL
from curaspark.plans.catalog import query
from curaspark.plans.proposals import CODE_SQL, SUBTYPE_SQL, codes
from curaspark.plans.standins import answer_key_sql, view, with_views


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(
    "type_fractions",
    with_views("proposal_rows")
    + """SELECT step, content_type, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY step), 6) AS share,
                COUNT(*) OVER (PARTITION BY step) AS n_kinds FROM proposal_rows WHERE format_ok GROUP BY step, content_type""",
)
def type_fractions(spark, sf):
    rows = view(spark, sf, "proposal_rows").filter("format_ok")
    return rounded(rw.type_shares(rows, ["step"], "content_type"), "share").select("step", "content_type", "n", "share", "n_kinds")


PENALTY_SQL = """, ct_counts AS (SELECT step, content_type, COUNT(*) AS n FROM proposal_rows WHERE format_ok GROUP BY step, content_type),
ct_totals AS (SELECT step, SUM(n) AS n_batch, COUNT(*) AS kinds FROM ct_counts GROUP BY step),
ct AS (SELECT step, content_type, CASE WHEN n_batch > 1 AND kinds > 1 THEN 0.15::DOUBLE * GREATEST(0, n / n_batch - 0.5::DOUBLE) / 0.5::DOUBLE ELSE 0 END AS pen
       FROM ct_counts JOIN ct_totals USING (step))
"""


@query(
    "content_type_penalty",
    with_views("proposal_rows")
    + PENALTY_SQL
    + "SELECT p.proposal_id, p.step, p.content_type, ROUND(pen, 6) AS content_type_penalty FROM proposal_rows p JOIN ct USING (step, content_type) WHERE format_ok",
)
def content_type_penalty(spark, sf):
    rows = view(spark, sf, "proposal_rows").filter("format_ok").select("proposal_id", "step", "content_type")
    return rounded(rw.content_type_penalty(rows, ["step"], "content_type"), "content_type_penalty")


REWARD_VIEWS = ("proposal_rows", "proposal_samples", "easy_rollouts", "hard_rollouts")


# solvability and difficulty of the rendered samples of proposal_rows
SAMPLES_SQL = f"""solved AS (SELECT s.proposal_id, s.sample_id, AVG(CASE WHEN TRY_CAST(trim(e.answer) AS DOUBLE) = TRY_CAST(p.easy_answer AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS solv
  FROM proposal_samples s JOIN proposal_rows p USING (proposal_id) JOIN easy_rollouts e ON e.proposal_id = s.proposal_id AND e.sample_id = s.sample_id
  WHERE s.is_rendered GROUP BY 1, 2),
classes AS (SELECT proposal_id, sample_id, {answer_key_sql('answer')} AS k, COUNT(*) AS n FROM hard_rollouts WHERE lower(trim(answer)) <> 'n/a' GROUP BY 1, 2, 3),
hard AS (SELECT proposal_id, sample_id, MAX(n) / SUM(n) AS score FROM classes GROUP BY 1, 2),
scored AS (SELECT s.proposal_id, s.sample_id, COALESCE(solv, 0.0) AS solv, COALESCE(LEAST(score, 1 - score), 0.0) AS diff
  FROM proposal_samples s LEFT JOIN solved USING (proposal_id, sample_id) LEFT JOIN hard USING (proposal_id, sample_id) WHERE s.is_rendered)"""

PROPOSER_SQL = (
    with_views(*REWARD_VIEWS)
    + PENALTY_SQL
    + f""", {SAMPLES_SQL},
agg AS (SELECT proposal_id, SUM(LEAST(solv, 0.5) + diff) AS total, AVG(solv) AS avg_solv, AVG(diff) AS avg_diff, COUNT(*) AS rendered, COUNT(*) FILTER (solv > 0.5) AS capped FROM scored GROUP BY 1),
cnt AS (SELECT proposal_id, COUNT(*) AS samples FROM proposal_samples GROUP BY 1),
joined AS (SELECT p.*, COALESCE(total, 0) AS total, COALESCE(avg_solv, 0) AS avg_solv, COALESCE(avg_diff, 0) AS avg_diff, COALESCE(rendered, 0) AS rendered, COALESCE(capped, 0) AS capped,
    GREATEST(COALESCE(samples, 0), 1) AS n, COALESCE(pen, 0) AS pen, CASE WHEN COALESCE(rendered, 0) > 0 AND avg_diff < 0.15 THEN -0.3::DOUBLE ELSE 0 END AS eh
  FROM proposal_rows p LEFT JOIN agg USING (proposal_id) LEFT JOIN cnt USING (proposal_id) LEFT JOIN ct ON p.format_ok AND ct.step = p.step AND ct.content_type = p.content_type),
rewards AS (SELECT proposal_id, step, format_ok, CASE WHEN format_ok THEN total / n + eh - pen ELSE -1.0 END AS overall, CASE WHEN format_ok THEN 1.0 ELSE 0.0 END AS format,
    CASE WHEN format_ok THEN rendered ELSE 0 END AS num_rendered, CASE WHEN format_ok THEN n ELSE 0 END AS num_rollouts, CASE WHEN format_ok THEN avg_solv ELSE 0.0 END AS avg_solvability,
    CASE WHEN format_ok THEN avg_diff ELSE 0.0 END AS avg_difficulty, CASE WHEN format_ok THEN capped ELSE 0 END AS n_capped, CASE WHEN format_ok THEN eh ELSE 0.0 END AS easy_hard_penalty,
    CASE WHEN format_ok THEN -pen ELSE 0.0 END AS content_type_diversity_bonus FROM joined)
"""
)


def _proposer(spark, sf):
    rows, samples = view(spark, sf, "proposal_rows"), view(spark, sf, "proposal_samples")
    penalties = rw.content_type_penalty(rows.filter("format_ok"), ["step"], "content_type")
    proposals = attach(rows, penalties.select("proposal_id", "content_type_penalty"), ["proposal_id"])
    scores = rw.sample_scores(rows.filter("format_ok"), samples, view(spark, sf, "easy_rollouts"), view(spark, sf, "hard_rollouts"), ORDER)
    return rw.proposer_reward(proposals, samples, scores)


@query(
    "proposer_reward",
    PROPOSER_SQL
    + """SELECT proposal_id, step, ROUND(overall, 6) AS overall, format, num_rendered, num_rollouts, ROUND(avg_solvability, 6) AS avg_solvability, ROUND(avg_difficulty, 6) AS avg_difficulty,
                n_capped, easy_hard_penalty, ROUND(content_type_diversity_bonus, 6) AS content_type_diversity_bonus FROM rewards""",
    doubles=("format",),
)
def proposer_reward(spark, sf):
    out = rounded(_proposer(spark, sf), "overall", "avg_solvability", "avg_difficulty", "content_type_diversity_bonus")
    return out.select(
        "proposal_id", "step", "overall", "format", "num_rendered", "num_rollouts", "avg_solvability", "avg_difficulty",
        "n_capped", "easy_hard_penalty", "content_type_diversity_bonus",
    )


@query(
    "reward_summary",
    PROPOSER_SQL
    + """SELECT step, COUNT(*) AS n, COUNT(*) FILTER (format > 0) AS format_ok, ROUND(AVG(num_rendered) FILTER (format > 0), 6) AS avg_rendered, ROUND(AVG(avg_solvability) FILTER (format > 0), 6) AS avg_solvability,
         ROUND(AVG(avg_difficulty) FILTER (format > 0), 6) AS avg_difficulty, SUM(n_capped)::BIGINT AS n_capped, COUNT(*) FILTER (easy_hard_penalty < 0) AS n_penalized,
         ROUND(AVG(content_type_diversity_bonus) FILTER (format > 0), 6) AS avg_content_type, 0.0 AS avg_caption_div, ROUND(AVG(overall), 6) AS avg_overall FROM rewards GROUP BY step""",
    doubles=("avg_caption_div",),
)
def reward_summary(spark, sf):
    out = rw.proposer_summary(_proposer(spark, sf), ["step"]).drop("avg_vt_bonus", "avg_cross_step")
    return rounded(out, "avg_rendered", "avg_solvability", "avg_difficulty", "avg_content_type", "avg_caption_div", "avg_overall")


CODEGEN_SQL = (
    SERVICE_SQL.replace("WITH ", CODE_SQL + ", ", 1)
    + f""", easy AS (SELECT question_id, AVG(CASE WHEN question_id % 4 <> 0 AND k = CAST(CAST(question_id % 4 AS DECIMAL(38,12)) AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS solv FROM keyed GROUP BY question_id),
shaped AS (SELECT c.response_id, c.step, c.svg_code AS code, c.response_id % 4 <> 1 AS rendered, CASE WHEN c.response_id % 4 = 0 THEN 0.0 ELSE COALESCE(solv, 0.0) END AS solv,
    COALESCE(LEAST(score, 1 - score), 0.0) AS diff FROM codes c LEFT JOIN easy e ON e.question_id = c.response_id LEFT JOIN voted v ON v.question_id = c.response_id),
flagged AS (SELECT *, trim(code) = '' AS empty, (trim(code) <> '' AND (starts_with(trim(code), '<') OR contains(lower(code), '<svg'))) AS ok FROM shaped),
coded AS (SELECT response_id, step, CASE WHEN rendered THEN 1.0 ELSE 0.0 END AS renderability, CASE WHEN rendered THEN solv ELSE 0.0 END AS solvability, CASE WHEN rendered THEN diff ELSE 0.0 END AS difficulty,
    CASE WHEN ok THEN 1.0 ELSE 0.0 END AS type_compliant,
    GREATEST(-0.5::DOUBLE, CASE WHEN rendered THEN 1 + solv + diff ELSE -0.1::DOUBLE END - CASE WHEN empty THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN ok THEN 0 ELSE 0.5::DOUBLE END) AS overall FROM flagged)
"""
)


def _codegen(spark, sf):
    answers = view(spark, sf, "answers")
    rows = codes(spark, sf).select("response_id", "step", F.col("svg_code").alias("code"), (F.col("response_id") % 4 != 1).alias("is_rendered"))
    silver = F.when(F.col("response_id") % 4 == 0, F.lit("")).otherwise((F.col("response_id") % 4).cast("string"))
    items = rows.select(F.col("response_id").alias("question_id"), silver.alias("silver"))
    solved = votes.solvability(answers, items, ["question_id"], "answer", "silver", code_form=True)
    hard = votes.majority_vote(answers, ["question_id"], "answer", ORDER)
    scores = attach(solved, hard.select("question_id", votes.difficulty(F.col("score")).alias("difficulty")), ["question_id"])
    scores = scores.select(F.col("question_id").alias("response_id"), "solvability", "difficulty")
    return rw.codegen_reward(attach(rows, scores, ["response_id"]))


@query(
    "codegen_reward",
    CODEGEN_SQL
    + "SELECT response_id, step, renderability, ROUND(solvability, 6) AS solvability, ROUND(difficulty, 6) AS difficulty, type_compliant, ROUND(overall, 6) AS overall FROM coded",
    doubles=("renderability", "type_compliant",),
)
def codegen_reward(spark, sf):
    out = rounded(_codegen(spark, sf), "solvability", "difficulty", "overall")
    return out.select("response_id", "step", "renderability", "solvability", "difficulty", "type_compliant", "overall")


@query(
    "codegen_summary",
    CODEGEN_SQL
    + """SELECT step, COUNT(*) AS n, COUNT(*) FILTER (renderability > 0) AS renderable, COUNT(*) FILTER (type_compliant > 0) AS compliant, ROUND(AVG(solvability) FILTER (renderability > 0), 6) AS avg_solvability,
         ROUND(AVG(difficulty) FILTER (renderability > 0), 6) AS avg_difficulty, ROUND(AVG(overall), 6) AS avg_overall FROM coded GROUP BY step""",
)
def codegen_summary(spark, sf):
    return rounded(rw.codegen_summary(_codegen(spark, sf), ["step"]), "avg_solvability", "avg_difficulty", "avg_overall")


@query(
    "code_diversity_penalty",
    SUBTYPE_SQL
    + """, tc AS (SELECT step, visual_type, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY step) AS ts FROM subtyped GROUP BY step, visual_type),
    sc AS (SELECT step, subtype, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY step) AS ss FROM subtyped GROUP BY step, subtype)
    SELECT response_id, s.visual_type, s.subtype, ROUND(ts, 6) AS type_share, ROUND(ss, 6) AS subtype_share,
      ROUND(CASE WHEN ts > 0.8 THEN 0.8 WHEN ts > 0.6 THEN 0.6 WHEN ts > 0.4 THEN 0.2 ELSE 0.0 END
          + CASE WHEN ss <= 0.25 THEN CASE WHEN ss < 0.125 THEN -0.1 ELSE 0.0 END ELSE LEAST(0.4::DOUBLE * (1 + LEAST(0.75, ss - 0.25) / 0.75), 1.0) END, 6) AS diversity_penalty
    FROM subtyped s JOIN tc USING (step, visual_type) JOIN sc USING (step, subtype)""",
)
def code_diversity_penalty(spark, sf):
    code = F.col("any_code")
    rows = codes(spark, sf).select("response_id", "step", visual_type_of_code(code).alias("visual_type"), code_subtype(code).alias("subtype"))
    out = rw.code_diversity_penalty(rows, ["step"], "visual_type", "subtype", target=0.25, bonus=0.1)
    return rounded(out, "type_share", "subtype_share", "diversity_penalty").drop("step")


TAG = "CASE WHEN kind = 'click' THEN ' SVG ' WHEN kind = 'view' THEN 'Plotly' WHEN kind = 'error' THEN NULL WHEN kind = 'signup' THEN 'pillow' ELSE 'excel' END"


@query(
    "vt_bonus",
    with_views("rollouts")
    + f""", t AS (SELECT rollout_id, step, CASE WHEN lower(trim({TAG})) IN ('matplotlib', 'plotly', 'pillow', 'svg') THEN lower(trim({TAG})) ELSE 'matplotlib' END AS vt FROM rollouts),
    s AS (SELECT step, vt, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY step) AS share FROM t GROUP BY step, vt)
    SELECT rollout_id, vt AS visual_type, ROUND(GREATEST(-0.3::DOUBLE, LEAST(0.3::DOUBLE, 0.25 / GREATEST(share, 0.01) - 1)), 6) AS linear_bonus,
           ROUND(CASE WHEN share > 0.8 THEN -0.6::DOUBLE WHEN share > 0.6 THEN -0.45::DOUBLE ELSE GREATEST(-0.3::DOUBLE, LEAST(0.3::DOUBLE, 0.25 / GREATEST(share, 0.01) - 1)) END, 6) AS tiered_bonus
    FROM t JOIN s USING (step, vt)""",
)
def vt_bonus(spark, sf):
    rows = view(spark, sf, "rollouts").select("rollout_id", "step", normalize_visual_type(F.expr(TAG)).alias("visual_type"))
    shares = rw.type_shares(rows, ["step"], "visual_type").select("step", "visual_type", "share")
    out = attach(rows, shares, ["step", "visual_type"], "inner")
    share = F.col("share")
    return out.select(
        "rollout_id",
        "visual_type",
        F.round(rw.linear_type_bonus(share), 6).alias("linear_bonus"),
        F.round(rw.tiered_type_bonus(share), 6).alias("tiered_bonus"),
    )
