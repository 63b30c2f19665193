"""Votes over solver answers and the rewards that read a single response."""

from pyspark.sql import functions as F

from curaspark.functions.answers import choice_index
from curaspark.functions.rewards import (
    answer_tag_reward,
    choice_reward,
    length_aware_reward,
    math_reward,
    solver_reward,
)
from curaspark.operators import votes
from curaspark.plans.catalog import query
from curaspark.plans.standins import answer_key_sql, table, view, with_views

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

KEYED_SQL = (
    with_views("answers")
    + f""", keyed AS (
  SELECT question_id, answer, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
         {answer_key_sql('answer')} AS k,
         lower(trim(answer)) IN ('', 'none', 'n/a', 'na', 'null', 'unknown', '-') AS bad
  FROM answers)
"""
)

VOTE_SQL = """, classes AS (SELECT question_id, k, COUNT(*) AS n, MIN(pos) AS pos, arg_min(answer, pos) AS answer FROM keyed WHERE {valid} GROUP BY question_id, k),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY n DESC, pos) AS r, SUM(n) OVER (PARTITION BY question_id) AS n_valid FROM classes),
totals AS (SELECT question_id, COUNT(*) AS n_total FROM keyed GROUP BY question_id),
voted AS (SELECT t.question_id, COALESCE(r.answer, '') AS answer, COALESCE(r.n / r.n_valid, 0.0) AS score, COALESCE(r.n_valid, 0)::BIGINT AS n_valid, n_total
  FROM totals t LEFT JOIN ranked r ON r.question_id = t.question_id AND r.r = 1)
"""
SERVICE_SQL = KEYED_SQL + VOTE_SQL.format(valid="NOT bad")
OFFLINE_SQL = KEYED_SQL + VOTE_SQL.format(valid="answer <> ''")


def _vote(spark, sf, service_form=True):
    return votes.majority_vote(view(spark, sf, "answers", wide=True), ["question_id"], "answer", ORDER, service_form)


@query("majority_vote", SERVICE_SQL + "SELECT question_id, answer, ROUND(score, 6) AS score, n_valid, n_total FROM voted")
def majority_vote(spark, sf):
    return _vote(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "majority_vote_offline",
    OFFLINE_SQL + "SELECT question_id, answer, ROUND(score, 6) AS score, n_valid, n_total FROM voted WHERE n_valid > 0",
)
def majority_vote_offline(spark, sf):
    voted = _vote(spark, sf, service_form=False)
    # questions without any answer are skipped in the offline form
    return voted.filter(F.col("n_valid") > 0).withColumn("score", F.round("score", 6))


# silver answer per question; some are blank, some questions got no rollouts
SILVER = """SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '1.0' ELSE CAST(o_orderkey % 4 AS VARCHAR(8)) END AS silver,
       CAST(o_custkey % 5 AS DOUBLE) / 4 AS service_score FROM orders"""

SOLVABILITY_SQL = (
    KEYED_SQL
    + f""", silver AS ({SILVER}),
shares AS (SELECT s.question_id, AVG(CASE WHEN s.silver <> '' AND k.k = CAST(CAST(s.silver AS DECIMAL(38,12)) AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS share
           FROM keyed k JOIN (SELECT question_id, NULLIF(silver, '') AS silver FROM silver) s USING (question_id) GROUP BY s.question_id)
"""
)


def _silver(spark, sf):
    return spark.sql(SILVER.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


@query(
    "solvability",
    SOLVABILITY_SQL
    + """SELECT s.question_id, ROUND(COALESCE(h.share, s.service_score), 6) AS proposer_form,
                ROUND(CASE WHEN s.silver <> '' AND h.share IS NOT NULL THEN h.share ELSE s.service_score END, 6) AS code_form
         FROM silver s LEFT JOIN shares h USING (question_id)""",
)
def solvability(spark, sf):
    items, answers = _silver(spark, sf), view(spark, sf, "answers", wide=True)
    both = votes.solvability_forms(answers, items, ["question_id"], "answer", "silver", "service_score")
    return both.select("question_id", F.round("proposer_form", 6).alias("proposer_form"), F.round("code_form", 6).alias("code_form"))


@query(
    "difficulty",
    SERVICE_SQL
    + """SELECT question_id, ROUND(CASE WHEN n_valid = 0 THEN -1.0 ELSE score END, 6) AS score,
                ROUND(LEAST(CASE WHEN n_valid = 0 THEN -1.0 ELSE score END, 1 - CASE WHEN n_valid = 0 THEN -1.0 ELSE score END), 6) AS difficulty FROM voted""",
)
def difficulty(spark, sf):
    # questions without a valid answer stand in for failed generations, which carry the sentinel -1
    score = F.when(F.col("n_valid") == 0, F.lit(-1.0)).otherwise(F.col("score"))
    return _vote(spark, sf).select("question_id", F.round(score, 6).alias("score"), F.round(votes.difficulty(score), 6).alias("difficulty"))


@query(
    "reward_solver",
    with_views("eval_records")
    + r""", shaped AS (
      SELECT model, dataset, item, ground_truth,
             CASE WHEN item % 4 = 3 THEN CONCAT('<think> a </think> <answer> ', ground_truth, ' </answer>') WHEN item % 4 = 2 THEN CONCAT('lead ', model_response, ' tail') ELSE model_response END AS response
      FROM eval_records),
    clean AS (SELECT *, regexp_replace(response, '\s*(<|>|/)\s*', '\1', 'g') AS c FROM shaped),
    parts AS (SELECT *, regexp_extract_all(c, '\\boxed\{([^}]*)\}', 1) AS boxes, CASE WHEN item % 4 = 3 THEN ground_truth ELSE trim(response) END AS given FROM clean),
    flags AS (SELECT *, CASE WHEN regexp_matches(c, '(?s)^<think>.*?</think>\s*\\boxed\{.*?\}\s*$') THEN 1.0 ELSE 0.0 END AS f_solver,
                CASE WHEN regexp_matches(c, '(?s)^<think>.*</think>.*\\boxed\{.*\}.*$') THEN 1.0 ELSE 0.0 END AS f_math,
                CASE WHEN regexp_matches(response, '(?s)^<think>.*?</think>\s*<answer>.*?</answer>$') THEN 1.0 ELSE 0.0 END AS f_tag,
                CASE WHEN len(boxes) > 0 AND ground_truth <> '' AND TRY_CAST(rtrim(trim(list_extract(boxes, -1)), '.') AS DOUBLE) = TRY_CAST(ground_truth AS DOUBLE) THEN 1.0 ELSE 0.0 END AS a_box,
                CASE WHEN item % 4 = 3 AND ground_truth <> '' THEN 1.0 ELSE 0.0 END AS a_tag FROM parts)
    SELECT model, dataset, COUNT(*) AS n, ROUND(SUM(0.9 * a_box + 0.1 * f_solver), 4) AS solver_overall, ROUND(SUM(f_solver), 4) AS solver_format, ROUND(SUM(a_box), 4) AS accuracy,
           ROUND(SUM(0.9 * a_box + 0.1 * f_math), 4) AS math_overall, ROUND(SUM(0.5 * a_tag + 0.5 * f_tag), 4) AS tag_overall
    FROM flags GROUP BY model, dataset""",
    doubles=("solver_overall", "solver_format", "accuracy", "math_overall", "tag_overall",),
)
def reward_solver(spark, sf):
    records = view(spark, sf, "eval_records", wide=True)
    item, truth, response = F.col("item"), F.col("ground_truth"), F.col("model_response")
    shaped = (
        F.when(item % 4 == 3, F.concat(F.lit("<think> a </think> <answer> "), truth, F.lit(" </answer>")))
        .when(item % 4 == 2, F.concat(F.lit("lead "), response, F.lit(" tail")))
        .otherwise(response)
    )
    scored = records.withColumn("response", shaped).select(
        "model",
        "dataset",
        solver_reward(F.col("response"), truth).alias("s"),
        math_reward(F.col("response"), truth).alias("m"),
        answer_tag_reward(F.col("response"), truth).alias("t"),
    )
    return scored.groupBy("model", "dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("s.overall"), 4).alias("solver_overall"),
        F.round(F.sum("s.format"), 4).alias("solver_format"),
        F.round(F.sum("s.accuracy"), 4).alias("accuracy"),
        F.round(F.sum("m.overall"), 4).alias("math_overall"),
        F.round(F.sum("t.overall"), 4).alias("tag_overall"),
    )


# responses that carry the answer in one of several notations, after the whole text of a turn
MATH_ANSWERS = """SELECT uid, rollout_id, text, length(text) AS n_chars,
  CASE WHEN turn % 6 = 0 THEN '1,234' WHEN turn % 6 = 1 THEN '12' WHEN turn % 6 = 2 THEN CONCAT(CHR(92), 'frac{{1}}{{2}}') WHEN turn % 6 = 3 THEN '5' WHEN turn % 6 = 4 THEN 'x' ELSE CONCAT(CHR(92), 'sqrt{{3}}') END AS truth,
  CASE WHEN turn % 6 = 0 THEN 'n = 1234' WHEN turn % 6 = 1 THEN CONCAT('a 12', CHR(92), 'text{{ cm}}') WHEN turn % 6 = 2 THEN CONCAT('$', CHR(92), 'frac12$')
       WHEN turn % 6 = 3 THEN '6' WHEN turn % 6 = 4 THEN '$y = x$.' ELSE CONCAT('  ', CHR(92), 'sqrt3 units') END AS given
  FROM {turns}"""


@query(
    "reward_dapo",
    with_views("turns")
    + f""", m AS ({MATH_ANSWERS.format(turns='turns')}),
    r AS (SELECT *, CASE WHEN uid % 5 = 0 THEN CONCAT(text, CHR(10), 'Answer: 99', CHR(10), 'aNSWER : ', given) WHEN uid % 5 = 1 THEN text ELSE CONCAT(text, ' answer:', given) END AS response FROM m)
    SELECT uid, rollout_id,
      CASE WHEN uid % 5 = 1 THEN -1.0 WHEN rollout_id % 1000 % 6 = 3 THEN -1.0 WHEN rollout_id % 1000 % 6 = 4 THEN -1.0 ELSE 1.0 END AS accuracy,
      ROUND(CASE WHEN n_chars <= 200 THEN 0.0 WHEN n_chars <= 300 THEN (200 - n_chars) / 100.0::DOUBLE ELSE -1.0 END, 6) AS overlong,
      ROUND(CASE WHEN uid % 5 = 1 THEN -1.0 WHEN rollout_id % 1000 % 6 IN (3, 4) THEN -1.0 ELSE 1.0 END + 0.5 * CASE WHEN n_chars <= 200 THEN 0.0 WHEN n_chars <= 300 THEN (200 - n_chars) / 100.0::DOUBLE ELSE -1.0 END, 6) AS overall,
      CASE WHEN uid % 5 = 1 THEN 0.0 WHEN rollout_id % 1000 % 6 IN (3, 4) THEN 0.0 ELSE 1.0 END AS accuracy_normalized
    FROM r""",
    doubles=("accuracy", "accuracy_normalized",),
)
def reward_dapo(spark, sf):
    m = spark.sql(MATH_ANSWERS, turns=view(spark, sf, "turns"))
    uid, text, given = F.col("uid"), F.col("text"), F.col("given")
    response = (
        F.when(uid % 5 == 0, F.concat(text, F.lit("\nAnswer: 99\naNSWER : "), given))
        .when(uid % 5 == 1, text)
        .otherwise(F.concat(text, F.lit(" answer:"), given))
    )
    score = length_aware_reward(response, F.col("n_chars"), F.col("truth"), 300, 100, 0.5)
    return m.select("uid", "rollout_id", score.alias("s")).select(
        "uid",
        "rollout_id",
        "s.accuracy",
        F.round("s.overlong", 6).alias("overlong"),
        F.round("s.overall", 6).alias("overall"),
        "s.accuracy_normalized",
    )


@query(
    "reward_choice",
    """SELECT event_id, CAST(regexp_extract(CONCAT(event_type, props), '[012]') AS VARCHAR) AS predicted,
              CASE WHEN regexp_extract(CONCAT(event_type, props), '[012]') = CASE WHEN event_id % 4 = 3 THEN '' ELSE CAST(event_id % 4 AS VARCHAR) END THEN 1.0 ELSE 0.0 END AS overall
       FROM events""",
    doubles=("overall",),
)
def reward_choice(spark, sf):
    events = table(spark, sf, "events")
    truth = F.when(F.col("event_id") % 4 == 3, F.lit("")).otherwise((F.col("event_id") % 4).cast("string"))
    score = choice_reward(F.concat("event_type", "props"), truth)
    return events.select("event_id", score.alias("s")).select("event_id", "s.predicted", "s.overall")


CHOICE_TEXT = """CASE WHEN item % 8 = 0 THEN CONCAT('ok <ACTION>select(', CAST(item % 5 AS VARCHAR(4)), ')</action> answer: 1')
  WHEN item % 8 = 1 THEN CONCAT(dataset, ' 选择的索引： ', CAST(item % 4 AS VARCHAR(4))) WHEN item % 8 = 2 THEN CONCAT('Select(', CAST(item % 3 AS VARCHAR(4)), ')')
  WHEN item % 8 = 3 THEN CONCAT('第 ', CAST(item % 3 AS VARCHAR(4)), ' 个') WHEN item % 8 = 4 THEN CONCAT('ANSWER: ', CAST(item % 6 AS VARCHAR(4)), ' 选项 B')
  WHEN item % 8 = 5 THEN '选项C' WHEN item % 8 = 6 THEN CONCAT('选择 ', CAST(item % 3 AS VARCHAR(4))) ELSE model_response END"""


@query(
    "choice_parse",
    with_views("eval_records")
    + f""", t AS (SELECT model, item, {CHOICE_TEXT} AS reply FROM eval_records),
    found AS (SELECT model, item, [TRY_CAST(regexp_extract(reply, '(?i)<action>select\\((\\d+)\\)</action>', 1) AS INT), TRY_CAST(regexp_extract(reply, '选择的?索引[:：]\\s*(\\d+)', 1) AS INT),
        TRY_CAST(regexp_extract(reply, '索引[:：]\\s*(\\d+)', 1) AS INT), TRY_CAST(regexp_extract(reply, '(?i)select\\((\\d+)\\)', 1) AS INT), TRY_CAST(regexp_extract(reply, '选择\\s*(\\d+)', 1) AS INT),
        TRY_CAST(regexp_extract(reply, '第\\s*(\\d+)\\s*个', 1) AS INT), TRY_CAST(regexp_extract(reply, '(?i)answer[:：]\\s*(\\d+)', 1) AS INT),
        CASE lower(regexp_extract(reply, '(?i)选项\\s*([abc])', 1)) WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 END] AS c FROM t)
    SELECT model, item, list_extract(list_filter(c, lambda x: x IS NOT NULL AND x BETWEEN 0 AND 2), 1) AS choice FROM found""",
)
def choice_parse(spark, sf):
    return view(spark, sf, "eval_records", wide=True).select("model", "item", choice_index(F.expr(CHOICE_TEXT)).alias("choice"))
