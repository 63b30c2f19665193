"""Training-set assembly queries."""

from pyspark.sql import functions as F

from curaspark.functions.text import words
from curaspark.operators import assemble, votes
from curaspark.plans.answers import ORDER
from curaspark.plans.catalog import query
from curaspark.plans.proposals import FIELDS, PROMPT_SQL, STRICT_SQL, _loose_sql, strict
from curaspark.plans.standins import answer_key_sql, table, view, with_views

IMAGE_OK_SQL = "(length(image) > 100 AND (starts_with(image, 'data:image') OR length(image) > 200))"
USABLE_SQL = f"(answer NOT IN ('', 'None') AND {IMAGE_OK_SQL})"
TRAIN_COLUMNS_SQL = "question AS problem, answer, score, hard_consistency, easy_consistency, image AS images, question_type AS problem_type, '' AS caption, '' AS easy_question, '' AS easy_answer"


@query("image_valid", with_views("evaluated") + f"SELECT question_id, {IMAGE_OK_SQL} AS valid FROM evaluated")
def image_valid(spark, sf):
    return view(spark, sf, "evaluated", wide=True).select("question_id", assemble.is_image_text(F.col("image")).alias("valid"))


@query(
    "asm_solver_train",
    with_views("evaluated")
    + f"SELECT {TRAIN_COLUMNS_SQL} FROM evaluated WHERE {USABLE_SQL} AND easy_consistency >= 0.5 AND hard_consistency BETWEEN 0.25 AND 0.75",
)
def asm_solver_train(spark, sf):
    return assemble.solver_training_set(assemble.solver_candidates(view(spark, sf, "evaluated", wide=True)))


@query(
    "asm_solver_rejects",
    with_views("evaluated")
    + f"""SELECT CASE WHEN NOT {USABLE_SQL} THEN 'unusable' WHEN easy_consistency < 0.5 THEN 'easy_low' WHEN hard_consistency < 0.25 THEN 'hard_low'
                 WHEN hard_consistency > 0.75 THEN 'hard_high' ELSE 'kept' END AS outcome, COUNT(*) AS n FROM evaluated GROUP BY 1""",
)
def asm_solver_rejects(spark, sf):
    return assemble.reject_counts(assemble.solver_candidates(view(spark, sf, "evaluated", wide=True)))


@query(
    "asm_solver_train_legacy",
    with_views("evaluated")
    + f"""SELECT {TRAIN_COLUMNS_SQL.replace(', hard_consistency, easy_consistency', ', -1.0 AS hard_consistency, -1.0 AS easy_consistency')}
          FROM evaluated WHERE {USABLE_SQL} AND score BETWEEN 0.3 AND 0.8""",
    doubles=("hard_consistency", "easy_consistency",),
)
def asm_solver_train_legacy(spark, sf):
    old = view(spark, sf, "evaluated", wide=True).drop("hard_consistency").withColumn("easy_consistency", F.lit(-1.0))
    return assemble.solver_training_set(assemble.solver_candidates(old))


@query("asm_solver_train_nofilter", with_views("evaluated") + f"SELECT {TRAIN_COLUMNS_SQL} FROM evaluated WHERE {USABLE_SQL}")
def asm_solver_train_nofilter(spark, sf):
    return assemble.solver_training_set(assemble.solver_candidates(view(spark, sf, "evaluated", wide=True), bands=False))


LOOSE_SQL = (
    with_views("loose_proposals")
    + f", f AS (SELECT proposal_id, {', '.join(f'{_loose_sql(f)} AS {f}' for f in FIELDS)} FROM loose_proposals)\n"
)


CODEGEN_TRAIN_SQL = (
    LOOSE_SQL
    + f"""SELECT proposal_id, {PROMPT_SQL} AS prompt_text, easy_answer, caption, easy_question, COALESCE(hard_question, '') AS hard_question,
                COALESCE(hard_answer, '') AS hard_answer, 'svg' AS visual_type
         FROM f WHERE caption IS NOT NULL AND easy_question IS NOT NULL AND easy_answer IS NOT NULL"""
)


@query("asm_codegen_train", CODEGEN_TRAIN_SQL)
def asm_codegen_train(spark, sf):
    return assemble.codegen_training_set(assemble.parse_proposals(view(spark, sf, "loose_proposals", wide=True), "response", keep_incomplete=False))


@query(
    "seed_prompts",
    "SELECT doc_id, ['chart and graph understanding', 'statistical and trend analysis', 'mathematical and quantitative reasoning', 'spatial and geometric reasoning', "
    "'logical and abstract reasoning', 'diagram and structural comprehension', 'visual text recognition and OCR', 'basic shape and object perception'][(doc_id % 8 + 1)::INT] AS problem, '' AS answer FROM documents",
)
def seed_prompts(spark, sf):
    # one seed per document, so that the work grows with the table
    return table(spark, sf, "documents").select("doc_id", assemble.seed_topic(F.col("doc_id")).alias("problem"), F.lit("").alias("answer"))


@query(
    "asm_rendered",
    STRICT_SQL.replace("WITH ", with_views("code_samples") + ", ", 1)
    + """SELECT s.proposal_id, s.sample_id, p.easy_answer, p.hard_question, p.hard_answer FROM code_samples s JOIN parsed p ON p.proposal_id = s.proposal_id
         WHERE s.is_rendered AND p.format_ok AND p.hard_question <> '' AND p.hard_answer <> ''""",
)
def asm_rendered(spark, sf):
    proposals = strict(spark, sf).select("proposal_id", "easy_answer", "hard_question", "hard_answer")
    codes = view(spark, sf, "code_samples").select("proposal_id", "sample_id", "is_rendered").join(proposals, "proposal_id")
    return assemble.rendered_set(codes).select("proposal_id", "sample_id", "easy_answer", "hard_question", "hard_answer")


@query(
    "filter_render_rate",
    with_views("code_samples")
    + """, rates AS (SELECT proposal_id, AVG(CASE WHEN is_rendered THEN 1.0 ELSE 0.0 END) AS rate FROM code_samples GROUP BY proposal_id)
    SELECT o_orderkey AS proposal_id, ROUND(rate, 6) AS render_success_rate, CASE WHEN rate IS NULL OR rate < 0.25 THEN 'too_low' WHEN rate > 0.75 THEN 'too_high' ELSE 'kept' END AS outcome
    FROM orders LEFT JOIN rates ON proposal_id = o_orderkey""",
)
def filter_render_rate(spark, sf):
    proposals = table(spark, sf, "orders").select(F.col("o_orderkey").alias("proposal_id"))
    rates = assemble.render_rates(proposals, view(spark, sf, "code_samples"), ["proposal_id"])
    return rates.withColumn("render_success_rate", F.round("render_success_rate", 6))


def _halves_sql(half: str, name: str) -> str:
    return f"""{name}_k AS (SELECT question_id, {answer_key_sql('answer')} AS k,
        row(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, answer FROM answers WHERE part = '{half}'),
    {name}_c AS (SELECT question_id, k, COUNT(*) AS n, MIN(pos) AS pos, arg_min(answer, pos) AS answer FROM {name}_k GROUP BY question_id, k),
    {name}_r AS (SELECT question_id, answer, n, ROW_NUMBER() OVER (PARTITION BY question_id ORDER BY n DESC, pos) AS r, SUM(n) OVER (PARTITION BY question_id) AS total FROM {name}_c),
    {name} AS (SELECT question_id, answer, n / total AS score FROM {name}_r WHERE r = 1)"""


@query(
    "asm_evaluated",
    with_views("answers")
    + f", {_halves_sql('O', 'easy')}, {_halves_sql('F', 'hard')}"
    + """ SELECT h.question_id, h.answer, ROUND(h.score, 6) AS score, ROUND(h.score, 6) AS hard_consistency, ROUND(COALESCE(e.score, 0.0), 6) AS easy_consistency
          FROM hard h LEFT JOIN easy e USING (question_id)""",
)
def asm_evaluated(spark, sf):
    answers = view(spark, sf, "answers", wide=True)

    def vote(half):
        return votes.majority_vote(answers.filter(F.col("part") == half), ["question_id"], "answer", ORDER, service_form=False)

    out = assemble.evaluated_set(vote("F").filter("n_valid > 0"), vote("O"), ["question_id"])
    return out.select("question_id", "answer", *[F.round(c, 6).alias(c) for c in ("score", "hard_consistency", "easy_consistency")])


@query(
    "filter_overlong",
    r"""WITH n AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x85\p{Z}]+')) AS n_tokens FROM conversations)
    SELECT conv_id, turn, n_tokens FROM n WHERE n_tokens <= 60""",
)
def filter_overlong(spark, sf):
    tokens = table(spark, sf, "conversations").select("conv_id", "turn", F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"))
    return assemble.within_length(tokens, F.col("n_tokens"), 60)


SENTINELS_SQL = """, s AS (SELECT score, CASE WHEN question_id % 5 = 0 THEN -1.0 ELSE easy_consistency END AS easy_consistency, CASE WHEN question_id % 7 = 0 THEN -1.0 ELSE hard_consistency END AS hard_consistency FROM evaluated)"""


def _with_sentinels(spark, sf):
    q = F.col("question_id")
    return view(spark, sf, "evaluated", wide=True).select(
        "score",
        F.when(q % 5 == 0, F.lit(-1.0)).otherwise(F.col("easy_consistency")).alias("easy_consistency"),
        F.when(q % 7 == 0, F.lit(-1.0)).otherwise(F.col("hard_consistency")).alias("hard_consistency"),
    )


@query(
    "score_stats",
    with_views("evaluated")
    + SENTINELS_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) AS n, ROUND(MIN({c}), 6) AS min, ROUND(MAX({c}), 6) AS max, ROUND(AVG({c}), 6) AS mean FROM s WHERE {c} >= {-9 if c == 'score' else 0}"
        for c in ("score", "easy_consistency", "hard_consistency")
    ),
)
def score_stats(spark, sf):
    out = assemble.score_stats(_with_sentinels(spark, sf), ["score"], ["easy_consistency", "hard_consistency"])
    return out.select("column", "n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")])


@query(
    "score_histogram",
    with_views("evaluated")
    + """, lim AS (SELECT MIN(score) AS lo, (MAX(score) - MIN(score)) / 20 AS step FROM evaluated),
    bins AS (SELECT i AS bin, lo + i * step AS low, lo + (i + 1) * step AS high FROM lim, range(20) t(i))
    SELECT CAST(bin AS INT) AS bin, ROUND(low, 6) AS low, ROUND(high, 6) AS high, (SELECT COUNT(*) FROM evaluated WHERE score >= low AND (score < high OR bin = 19)) AS n FROM bins""",
)
def score_histogram(spark, sf):
    out = assemble.histogram(view(spark, sf, "evaluated", wide=True), "score")
    return out.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")
