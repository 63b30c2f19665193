"""Step metrics and iteration metrics."""

from pyspark.sql import functions as F

from curaspark.functions import tokens as tk
from curaspark.functions.text import words
from curaspark.operators import assemble
from curaspark.operators import coevolution as co
from curaspark.operators import evaluate as ev
from curaspark.operators import metrics as mt
from curaspark.plans.advantages import TOKENS_SQL, token_rows
from curaspark.plans.assembly import USABLE_SQL
from curaspark.plans.catalog import query
from curaspark.plans.evaluation import ACCURACY_SQL
from curaspark.plans.rewards import rounded
from curaspark.plans.standins import table, view, with_views

LENGTHS_SQL = (
    with_views("turns")
    + r""", n AS (SELECT uid, turn, step, len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x85\p{Z}]+')) AS n FROM turns),
lengths AS (SELECT r.uid, r.turn, r.step, p.n AS prompt_length, r.n AS response_length FROM n r JOIN n p ON p.uid = r.uid AND p.turn = r.turn - 1)
"""
)


def _lengths(spark, sf):
    """Every turn is the response to the turn before it; lengths are those of whole turns."""
    n = view(spark, sf, "turns", wide=True).select("uid", "turn", "step", F.size(words(F.col("text"))).alias("n"))
    prompts = n.select("uid", (F.col("turn") + 1).alias("turn"), F.col("n").alias("prompt_length"))
    return n.join(prompts, ["uid", "turn"]).select("uid", "turn", "step", "prompt_length", F.col("n").alias("response_length"))


@query(
    "length_metrics",
    LENGTHS_SQL
    + "SELECT step, "
    + ", ".join(
        f"ROUND(AVG({k}_length), 6) AS \"{k}_length/mean\", MAX({k}_length)::DOUBLE AS \"{k}_length/max\", MIN({k}_length)::DOUBLE AS \"{k}_length/min\", "
        f"ROUND(AVG(CASE WHEN {k}_length >= {m} THEN 1.0 ELSE 0.0 END), 6) AS \"{k}_length/clip_ratio\""
        for k, m in (("prompt", 30), ("response", 60))
    )
    + " FROM lengths GROUP BY step",
)
def length_metrics(spark, sf):
    out = mt.length_metrics(_lengths(spark, sf), ["step"], max_prompt=30, max_response=60)
    return out.select("step", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in out.columns if c != "step"])


DATA_SQL = (
    TOKENS_SQL
    + """, seqs AS (SELECT step, rollout_id, SUM(r) AS score, SUM(r + old_lp) AS reward FROM tokens GROUP BY step, rollout_id),
s AS (SELECT step, AVG(score) AS "critic/score/mean", MAX(score) AS "critic/score/max", MIN(score) AS "critic/score/min", AVG(reward) AS "critic/rewards/mean", MAX(reward) AS "critic/rewards/max", MIN(reward) AS "critic/rewards/min" FROM seqs GROUP BY step),
t AS (SELECT step, """
    + ", ".join(f'AVG({c}) AS "critic/{n}/mean", MAX({c}) AS "critic/{n}/max", MIN({c}) AS "critic/{n}/min"' for n, c in (("advantages", "lp"), ("returns", "ref_lp"), ("values", "v")))
    + """, 1 - VAR_SAMP(ref_lp - v) / (VAR_SAMP(ref_lp) + 1e-5) AS "critic/vf_explained_var" FROM tokens WHERE m = 1 GROUP BY step)
SELECT s.step, ROUND(COLUMNS('critic/.*'), 6) FROM s JOIN t ON s.step = t.step"""
)


@query("data_metrics", DATA_SQL)
def data_metrics(spark, sf):
    rows = token_rows(spark, sf).select(
        "step",
        F.col("rewards").alias("token_level_scores"),
        F.zip_with("rewards", "old_log_probs", lambda r, o: r + o).alias("token_level_rewards"),
        F.col("log_probs").alias("advantages"),
        F.col("ref_log_probs").alias("returns"),
        "values",
        "mask",
    )
    out = mt.data_metrics(rows, ["step"], critic=True)
    return out.select("step", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in out.columns if c != "step"])


# timed sections of a step, in seconds, from the events
TIMINGS = """SELECT CAST(event_id % 10 AS INT) AS step, CASE WHEN event_type = 'click' THEN 'gen' WHEN event_type = 'error' THEN 'update_actor' WHEN event_type = 'purchase' THEN 'step'
     WHEN event_type = 'signup' THEN 'save_checkpoint' ELSE 'reward' END AS section, SUM(value) AS seconds FROM {events} GROUP BY 1, 2"""
TIMED_SQL = LENGTHS_SQL + f""", timings AS ({TIMINGS.format(events='events')}),
tok AS (SELECT step, SUM(response_length) AS response_tokens, SUM(prompt_length + response_length) AS overall_tokens FROM lengths GROUP BY step)
"""


def _timed(spark, sf):
    timings = spark.sql(TIMINGS, events=table(spark, sf, "events"))
    tokens = _lengths(spark, sf).groupBy("step").agg(
        F.sum("response_length").alias("response_tokens"), F.sum(F.col("prompt_length") + F.col("response_length")).alias("overall_tokens")
    )
    return timings, tokens


@query(
    "timing_per_token",
    TIMED_SQL
    + """SELECT t.step, section, ROUND(seconds, 4) AS timing_s, ROUND(CASE WHEN section IN ('gen', 'reward') THEN seconds * 1000 / response_tokens WHEN section = 'update_actor' THEN seconds * 1000 / overall_tokens END, 6) AS timing_per_token_ms
         FROM timings t LEFT JOIN tok ON tok.step = t.step""",
)
def timing_per_token(spark, sf):
    timings, tokens = _timed(spark, sf)
    return rounded(mt.timing_metrics(timings, tokens, ["step"]), "timing_per_token_ms").withColumn("timing_s", F.round("timing_s", 4))


@query(
    "throughput",
    TIMED_SQL
    + """SELECT t.step, overall_tokens::BIGINT AS total_num_tokens, ROUND(seconds, 4) AS time_per_step, ROUND(overall_tokens / (seconds * 8), 6) AS throughput
         FROM timings t JOIN tok ON tok.step = t.step WHERE section = 'step'""",
)
def throughput(spark, sf):
    timings, tokens = _timed(spark, sf)
    return rounded(mt.throughput(timings, tokens, ["step"], n_devices=8), "throughput").withColumn("time_per_step", F.round("time_per_step", 4))


# (6 * dense parameters, attention factor) of the two shapes below, worked out by hand
DENSE = mt.ModelShape(hidden=2048, vocab=151936, layers=36, heads=16, kv_heads=2, intermediate=11008)
MOE = mt.ModelShape(hidden=2048, vocab=151936, layers=48, heads=32, kv_heads=4, intermediate=768, head_dim=128, experts=128, active_experts=8)
FLOPS_SQL = """SELECT '{name}' AS model, step, tokens, squares, ROUND((6.0::DOUBLE * (({mlp} + 2048.0::DOUBLE * ({q} + {kv} + {kv} + {q})) * {layers} + 151936.0::DOUBLE * 2048 * 2) * tokens
    + 12.0::DOUBLE * squares * {q} * {layers}) / n / 1e12, 6) AS tflops FROM sums"""


@query(
    "flops_estimate",
    LENGTHS_SQL
    + """, sums AS (SELECT step, SUM(response_length)::DOUBLE AS tokens, SUM(response_length * response_length)::DOUBLE AS squares, COUNT(*) AS n FROM lengths GROUP BY step) """
    + FLOPS_SQL.format(name="dense", mlp="2048.0::DOUBLE * 11008 * 3", q="16 * 128", kv="2 * 128", layers=36)
    + " UNION ALL "
    + FLOPS_SQL.format(name="moe", mlp="(2048.0::DOUBLE * 8 * 768 * 3 + 2048 * 128)", q="32 * 128", kv="4 * 128", layers=48),
)
def flops_estimate(spark, sf):
    lengths = _lengths(spark, sf)
    seconds = F.count(F.lit(1)).cast("double")  # one second per response stands in for the step time
    out = None
    for name, shape in (("dense", DENSE), ("moe", MOE)):
        part = mt.flops_estimate(lengths, ["step"], "response_length", shape, seconds).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out.drop("seconds"), "tflops")


METRICS_SQL = (
    with_views("rollouts")
    + """, wide AS (SELECT step, AVG(overall) AS a, AVG(CASE WHEN kind = 'click' THEN 1.0 ELSE 0.0 END) AS b, AVG(CASE WHEN overall > 0.5 THEN 1.0 ELSE 0.0 END) AS c FROM rollouts GROUP BY step),
long AS (SELECT step, UNNEST(['reward/overall', 'reward/detail/format', 'accuracy']) AS metric, UNNEST([a, b, c]) AS value FROM wide)
"""
)


def _metric_rows(spark, sf):
    rows = view(spark, sf, "rollouts")
    return rows.select(
        "step",
        F.col("overall").alias("reward/overall"),
        (F.col("kind") == "click").cast("double").alias("reward/detail/format"),
        (F.col("overall") > 0.5).cast("double").alias("accuracy"),
    )


METRIC_NAMES = ["reward/overall", "reward/detail/format", "accuracy"]


@query("metrics_long", METRICS_SQL + "SELECT step, metric, ROUND(value, 6) AS value FROM long")
def metrics_long(spark, sf):
    rows = _metric_rows(spark, sf)
    long = mt.long_metrics(rows, ["step"], METRIC_NAMES)
    return rounded(mt.reduce_metrics(long, ["step"]), "value")


@query(
    "metrics_nested",
    METRICS_SQL
    + """, v AS (SELECT step, metric, CAST(ROUND(value, 4) AS VARCHAR) AS v FROM long)
    SELECT step, CONCAT('{"accuracy":', MAX(v) FILTER (metric = 'accuracy'), ',"reward":{"detail":{"format":', MAX(v) FILTER (metric = 'reward/detail/format'), '},"overall":', MAX(v) FILTER (metric = 'reward/overall'), '}}') AS log FROM v GROUP BY step""",
)
def metrics_nested(spark, sf):
    rows = _metric_rows(spark, sf)
    means = rows.groupBy("step").agg(*[F.avg(F.col(f"`{m}`")).alias(m) for m in METRIC_NAMES])
    long = means.unpivot(["step"], [f"`{m}`" for m in METRIC_NAMES], "metric", "value")
    return mt.nest_metrics(long, ["step"], F.round("value", 4).cast("string"))


@query(
    "validation_summary",
    TOKENS_SQL
    + """, s AS (SELECT rollout_id, SUM(r) AS score, SUM(v) AS v, SUM(m) AS n FROM tokens GROUP BY rollout_id)
    SELECT UNNEST(['val/reward_score', 'val/critic_reward', 'val/length_reward']) AS metric, UNNEST([ROUND(AVG(score), 6), ROUND(AVG(v), 6), ROUND(AVG(n), 6)]) AS value FROM s""",
)
def validation_summary(spark, sf):
    rows = token_rows(spark, sf).select(
        F.lit("all").alias("step"),
        tk.total(F.col("rewards")).alias("score"),
        tk.total(F.col("values")).alias("critic"),
        tk.total(F.col("mask").cast("array<double>")).alias("length"),
    )
    means = mt.mean_metrics(rows, ["step"], ["score", "critic", "length"], prefix="val/", suffix="_reward")
    name = F.when(F.col("metric") == "val/score_reward", F.lit("val/reward_score")).otherwise(F.col("metric"))
    return means.select(name.alias("metric"), F.round("value", 6).alias("value"))


@query(
    "entropy",
    """WITH c AS (SELECT lang, source, COUNT(*) AS n FROM documents GROUP BY lang, source), t AS (SELECT lang, SUM(n) AS total, COUNT(*) AS k FROM c GROUP BY lang),
    e AS (SELECT lang, CASE WHEN MAX(k) <= 1 THEN 0.0 ELSE -SUM(n / total * LN(n / total)) / LN(MAX(k)) END AS entropy FROM c JOIN t USING (lang) GROUP BY lang)
    SELECT c.lang, c.source, c.n, ROUND(c.n / t.total, 6) AS share, ROUND(entropy, 6) AS entropy FROM c JOIN t USING (lang) JOIN e USING (lang)""",
)
def entropy(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source")
    counts = co.category_counts(docs, ["lang"], "source")
    out = co.attach(counts, counts.groupBy("lang").agg(co.entropy_of_counts().alias("entropy")), ["lang"])
    return rounded(out, "share", "entropy").orderBy("lang", F.desc("n"), "source")


VERSIONS = "CONCAT('run', CAST({k} % 2 AS VARCHAR(4))) AS run, CONCAT('v', CAST(1 + {k} % 5 AS VARCHAR(4))) AS version"


def _versions(key: str):
    k = F.col(key)
    return [F.concat(F.lit("run"), (k % 2).cast("string")).alias("run"), F.concat(F.lit("v"), (k % 5 + 1).cast("string")).alias("version")]


COEVOLUTION_SQL = (
    ACCURACY_SQL.replace("WITH ", with_views("evaluated", "proposal_samples") + ", ", 1)
    + f""", res AS (SELECT {VERSIONS.format(k='question_id')}, CASE WHEN question_id % 6 = 0 THEN score ELSE hard_consistency END AS h, easy_consistency AS e, question_type FROM evaluated),
base AS (SELECT run, version, AVG(1 - ABS(2 * h - 1)) AS avg_difficulty, AVG(e) AS avg_solvability, AVG(e) - AVG(h) AS easy_hard_gap, COUNT(h) AS n_evaluated FROM res GROUP BY 1, 2),
ren AS (SELECT {VERSIONS.format(k='proposal_id')}, COUNT(*) AS n_rendered FROM proposal_samples WHERE is_rendered GROUP BY 1, 2),
made AS (SELECT {VERSIONS.format(k='page_id')}, COUNT(*) AS n_proposals, AVG(length(html)) AS avg_code_length FROM pages GROUP BY 1, 2),
ctn AS (SELECT {VERSIONS.format(k='doc_id')}, lang, COUNT(*) AS n FROM documents GROUP BY 1, 2, 3),
ctd AS (SELECT run, version, CASE WHEN COUNT(*) <= 1 THEN 0.0 ELSE (LN(SUM(n)) - SUM(n * LN(n)) / SUM(n)) / LN(COUNT(*)) END AS content_diversity FROM ctn GROUP BY 1, 2),
qtn AS (SELECT run, version, question_type, COUNT(*) AS n FROM res GROUP BY 1, 2, 3),
qtd AS (SELECT run, version, (LN(SUM(n)) - SUM(n * LN(n)) / SUM(n)) / LN(COUNT(*)) AS question_diversity FROM qtn GROUP BY 1, 2),
sv AS (SELECT {VERSIONS.format(k='question_id')}, COUNT(*) AS n_solver_filtered FROM evaluated WHERE {USABLE_SQL} AND easy_consistency >= 0.5 AND hard_consistency BETWEEN 0.25 AND 0.75 GROUP BY 1, 2),
cg AS (SELECT {VERSIONS.format(k='doc_id')}, COUNT(*) AS n_codegen_filtered FROM documents WHERE n_chars >= 1000 GROUP BY 1, 2),
acc AS (SELECT model, CONCAT('v', regexp_extract(model, 'solver_v(\\d+)', 1)) AS version, AVG(accuracy) AS mean_accuracy FROM accuracy_summary WHERE model <> 'base' GROUP BY model)
SELECT b.run, b.version, ROUND(avg_difficulty, 6) AS avg_difficulty, ROUND(avg_solvability, 6) AS avg_solvability, ROUND(easy_hard_gap, 6) AS easy_hard_gap, n_evaluated, COALESCE(n_rendered, 0) AS n_rendered,
    COALESCE(n_proposals, 0) AS n_proposals, ROUND(COALESCE(n_rendered, 0) / n_proposals, 6) AS render_rate, ROUND(avg_code_length, 4) AS avg_code_length, ROUND(content_diversity, 6) AS content_diversity,
    ROUND(question_diversity, 6) AS question_diversity, n_codegen_filtered, n_solver_filtered, model, ROUND(mean_accuracy, 6) AS mean_accuracy
FROM base b LEFT JOIN ren USING (run, version) LEFT JOIN made USING (run, version) LEFT JOIN ctd USING (run, version) LEFT JOIN qtd USING (run, version)
LEFT JOIN sv USING (run, version) LEFT JOIN cg USING (run, version) LEFT JOIN acc USING (version)"""
)


@query("coevolution", COEVOLUTION_SQL)
def coevolution(spark, sf):
    evaluated = view(spark, sf, "evaluated")
    hard = F.when(F.col("question_id") % 6 != 0, F.col("hard_consistency"))
    results = evaluated.select(*_versions("question_id"), hard.alias("hard_consistency"), "score", "easy_consistency", "question_type")
    rendered = view(spark, sf, "proposal_samples").filter("is_rendered").select(*_versions("proposal_id"))
    codes = table(spark, sf, "pages").select(*_versions("page_id"), F.col("html").alias("generated_code"))
    proposals = table(spark, sf, "documents").select(*_versions("doc_id"), F.col("lang").alias("content_type"))
    codegen = table(spark, sf, "documents").filter("n_chars >= 1000").select(*_versions("doc_id"))
    solver = assemble.solver_candidates(evaluated).filter("reject_reason IS NULL").select(*_versions("question_id"))
    out = co.iteration_metrics(results, rendered, codes, proposals, codegen, solver)
    out = co.with_accuracy(out, ev.accuracy(view(spark, sf, "eval_records", wide=True)))
    out = rounded(out, "avg_difficulty", "avg_solvability", "easy_hard_gap", "render_rate", "content_diversity", "question_diversity", "mean_accuracy")
    return out.withColumn("avg_code_length", F.round("avg_code_length", 4))
