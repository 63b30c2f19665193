"""Benchmark evaluation queries."""

from pyspark.sql import functions as F

from curaspark.functions.answers import answer_to_judge, first_boxed, last_boxed, tag_or_whole
from curaspark.functions.prompts import judge_prompt
from curaspark.operators import evaluate as ev
from curaspark.plans.catalog import query
from curaspark.plans.standins import view, with_views
from curaspark.session import cut_lineage

ACCURACY_SQL = with_views("eval_records") + r"""
, boxed AS (
  SELECT model, dataset, ground_truth, list_extract(regexp_extract_all(model_response, '\\boxed\{([^}]*)\}', 1), -1) AS raw FROM eval_records),
scored AS (
  SELECT model, dataset, (raw IS NOT NULL AND trim(raw) <> '' AND ground_truth <> '') AS has,
         rtrim(lower(trim(raw)), '.') = rtrim(lower(trim(ground_truth)), '.') AS same FROM boxed),
accuracy_summary AS (
  SELECT model, dataset, ROUND(COUNT(*) FILTER (has AND same) / COUNT(*) * 100, 2) AS accuracy,
         CASE WHEN COUNT(*) FILTER (has) = 0 THEN 0.0 ELSE ROUND(COUNT(*) FILTER (has AND same) * 100.0::DOUBLE / COUNT(*) FILTER (has), 2) END AS answered_accuracy,
         COUNT(*) FILTER (has AND same) AS correct, COUNT(*) AS total, COUNT(*) FILTER (has) AS answered
  FROM scored GROUP BY model, dataset)
"""

FOLDED_SQL = ACCURACY_SQL + """
, folded AS (
  SELECT model, CASE WHEN dataset LIKE 'mmmu_pro%' THEN 'MMMU-pro (macro)' ELSE dataset END AS dataset, AVG(accuracy) AS accuracy
  FROM accuracy_summary GROUP BY 1, 2)
"""


def _summary(spark, sf):
    return ev.accuracy(view(spark, sf, "eval_records", wide=True))


def _kept_summary(spark, sf):
    """The summary is one row per model and dataset; written once, the comparisons below all read it."""
    return cut_lineage(_summary(spark, sf))


@query("eval_accuracy", ACCURACY_SQL + "SELECT * FROM accuracy_summary ORDER BY model, dataset")
def eval_accuracy(spark, sf):
    return _summary(spark, sf).orderBy("model", "dataset")


@query(
    "eval_vs_base",
    FOLDED_SQL
    + """SELECT m.model, m.dataset, ROUND(m.accuracy, 6) AS accuracy, ROUND(b.accuracy, 6) AS base_accuracy,
                ROUND(m.accuracy - b.accuracy, 6) AS delta,
                CASE WHEN m.accuracy - b.accuracy > 0.01 THEN 'better' WHEN m.accuracy - b.accuracy < -0.01 THEN 'worse'
                     WHEN b.accuracy IS NOT NULL THEN 'same' END AS trend
         FROM folded m LEFT JOIN folded b ON b.model = 'base' AND b.dataset = m.dataset
         WHERE m.model <> 'base' AND m.dataset <> 'bench_11'""",
)
def eval_vs_base(spark, sf):
    folded = ev.fold_family(ev.exclude_datasets(_kept_summary(spark, sf), ["bench_11"]))
    out = ev.versus_base(folded).withColumn("trend", ev.trend(F.col("delta")))
    return out.select("model", "dataset", *[F.round(c, 6).alias(c) for c in ("accuracy", "base_accuracy", "delta")], "trend")


@query(
    "eval_micro_macro",
    FOLDED_SQL
    + """, sums AS (SELECT model, SUM(correct)::BIGINT AS correct, SUM(total)::BIGINT AS total FROM accuracy_summary GROUP BY model),
    macro AS (SELECT model, SUM(accuracy) / (SELECT COUNT(DISTINCT dataset) FROM folded) AS macro FROM folded GROUP BY model),
    chosen AS (SELECT model, AVG(accuracy) AS mean_accuracy FROM accuracy_summary WHERE dataset IN ('bench_3', 'bench_4', 'bench_5') GROUP BY model)
    SELECT s.model, correct, total, ROUND(100.0::DOUBLE * correct / total, 6) AS micro, ROUND(macro, 6) AS macro,
           ROUND(mean_accuracy, 6) AS mean_accuracy,
           ROW_NUMBER() OVER (ORDER BY CASE s.model WHEN 'base' THEN 0 WHEN 'solver_v1_step20' THEN 1 ELSE 2 END) AS place
    FROM sums s JOIN macro USING (model) LEFT JOIN chosen USING (model)""",
)
def eval_micro_macro(spark, sf):
    summary = _kept_summary(spark, sf)
    means = ev.mean_accuracy(summary, ["bench_3", "bench_4", "bench_5"])
    from pyspark.sql import Window

    # one row per model: a report, so one ordered window is fine
    place = F.row_number().over(Window.orderBy(*ev.label_order(F.col("model"))))
    out = ev.micro_macro(summary).join(means, "model", "left").withColumn("place", place)
    return out.select("model", "correct", "total", *[F.round(c, 6).alias(c) for c in ("micro", "macro", "mean_accuracy")], "place")


@query(
    "eval_verdict",
    FOLDED_SQL
    + """, gaps AS (SELECT * FROM folded WHERE NOT (model <> 'base' AND dataset = 'bench_4') AND NOT (model = 'base' AND dataset = 'bench_5')),
    grid AS (SELECT m.model, d.dataset, a.accuracy AS a, b.accuracy AS b
             FROM (SELECT DISTINCT model FROM gaps WHERE model <> 'base') m CROSS JOIN (SELECT DISTINCT dataset FROM gaps) d
             LEFT JOIN gaps a ON a.model = m.model AND a.dataset = d.dataset
             LEFT JOIN gaps b ON b.model = 'base' AND b.dataset = d.dataset),
    counted AS (
      SELECT model, COUNT(*) FILTER (a - b > 0.01) AS improving, COUNT(*) FILTER (a - b < -0.01) AS decreasing,
             COUNT(*) FILTER (a - b BETWEEN -0.01 AND 0.01) AS same, ROUND(COALESCE(AVG(a - b), 0), 6) AS avg_delta,
             COUNT(*) FILTER (COALESCE(a, 0) - COALESCE(b, 0) > 0.01) AS better_all,
             COUNT(*) FILTER (COALESCE(b, 0) - COALESCE(a, 0) > 0.01) AS worse_all
      FROM grid GROUP BY model)
    SELECT *, CASE WHEN better_all > worse_all THEN 'IMPROVING' WHEN worse_all > better_all THEN 'DECREASING' ELSE 'MIXED/SAME' END AS verdict
    FROM counted""",
)
def eval_verdict(spark, sf):
    folded = ev.fold_family(_kept_summary(spark, sf))
    is_base = F.col("model") == "base"
    gaps = folded.filter(~(~is_base & (F.col("dataset") == "bench_4")) & ~(is_base & (F.col("dataset") == "bench_5")))
    return ev.verdicts(gaps).withColumn("avg_delta", F.round("avg_delta", 6))


VERDICT_TEXT = """CASE WHEN item % 7 = 0 THEN '' WHEN item % 5 = 0 THEN CONCAT('  Yes, ', dataset) WHEN item % 5 = 1 THEN 'YES.'
                       WHEN item % 5 = 2 THEN 'No' WHEN item % 5 = 3 THEN CONCAT('not yes', CHR(10)) ELSE CONCAT(CHR(10), 'yesno') END"""


@query(
    "judge_accuracy",
    with_views("eval_records")
    + f""", judged AS (SELECT model, dataset, {VERDICT_TEXT} AS verdict FROM eval_records)
    SELECT model, dataset, COUNT(*) FILTER (regexp_matches(lower(verdict), '^\\s*yes')) AS correct, COUNT(*) AS total,
           ROUND(COUNT(*) FILTER (regexp_matches(lower(verdict), '^\\s*yes')) / COUNT(*) * 100, 2) AS accuracy
    FROM judged GROUP BY model, dataset""",
)
def judge_accuracy(spark, sf):
    return ev.judge_accuracy(view(spark, sf, "eval_records", wide=True).withColumn("verdict", F.expr(VERDICT_TEXT)), "verdict")


@query(
    "judge_prompt",
    r"""WITH r AS (
      SELECT conv_id, turn, trim(regexp_replace(text, '^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$', '', 'g')) AS q,
             CASE WHEN turn % 2 = 0 THEN '  ' ELSE CONCAT(' short ', role, ' ') END AS extracted FROM conversations),
    a AS (SELECT conv_id, turn, q, CASE WHEN trim(extracted) <> '' THEN trim(extracted) ELSE substring(q, 1, 600) END AS answer FROM r)
    SELECT conv_id, turn, answer, CONCAT('You are an answer correctness judge. Given a question, the gold (correct) answer, and the model''s answer, determine if the model''s answer is correct: equivalent to the gold answer or semantically the same. Consider numeric equality (e.g. 14 vs 14.0), option equivalence (A vs A.), and paraphrases. Answer with exactly one word: Yes or No.',
      CHR(10), CHR(10), 'Question: ', CASE WHEN length(q) > 400 THEN CONCAT(substring(q, 1, 400), '...') ELSE q END,
      CHR(10), CHR(10), 'Gold answer: ', substring(q, 1, 600),
      CHR(10), CHR(10), 'Model answer: ', regexp_replace(answer, '[\t-\r\x1c-\x20\x85\p{Z}]+$', ''),
      CHR(10), CHR(10), 'Is the model answer correct? Answer with exactly one word: Yes or No.') AS prompt
    FROM a""",
)
def judge_prompt_query(spark, sf):
    turns = view(spark, sf, "turns")
    extracted = F.when(F.col("turn") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" short "), "role", F.lit(" ")))
    answered = turns.select(F.col("uid").alias("conv_id"), "turn", "text", answer_to_judge(extracted, F.col("text")).alias("answer"))
    prompt = judge_prompt(F.col("text"), F.col("text"), F.col("answer"))
    return answered.select("conv_id", "turn", "answer", prompt.alias("prompt"))


@query(
    "extract_answer",
    with_views("eval_records")
    + r""", wrapped AS (SELECT model, item, ground_truth, model_response,
        CASE WHEN item % 3 = 0 THEN CONCAT('<description>', CHR(10), dataset, ' </description><answer> ', ground_truth, ' </answer>')
             ELSE model_response END AS tagged FROM eval_records)
    SELECT model, item, trim(list_extract(regexp_extract_all(model_response, '\\boxed\{([^}]*)\}', 1), 1)) AS first_box,
           trim(list_extract(regexp_extract_all(model_response, '\\boxed\{([^}]*)\}', 1), -1)) AS last_box,
           CASE WHEN item % 3 = 0 THEN ground_truth ELSE model_response END AS answer_text,
           CASE WHEN item % 3 = 0 THEN regexp_extract(tagged, '(?s)<description>\s*(.*?)\s*</description>', 1) ELSE model_response END AS description_text
    FROM wrapped""",
)
def extract_answer(spark, sf):
    tagged = F.when(
        F.col("item") % 3 == 0,
        F.concat(F.lit("<description>\n"), "dataset", F.lit(" </description><answer> "), "ground_truth", F.lit(" </answer>")),
    ).otherwise(F.col("model_response"))
    r = F.col("model_response")
    return view(spark, sf, "eval_records", wide=True).select(
        "model",
        "item",
        first_boxed(r).alias("first_box"),
        last_boxed(r).alias("last_box"),
        tag_or_whole(tagged, "answer").alias("answer_text"),
        tag_or_whole(tagged, "description").alias("description_text"),
    )
