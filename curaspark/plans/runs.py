"""Run bookkeeping and episode queries."""

from pyspark.sql import functions as F

from curaspark.operators import runs as rn
from curaspark.plans.catalog import query
from curaspark.plans.rewards import rounded
from curaspark.plans.standins import table

# a user is a run, an event a stored step; the tracker of every third run names a step that was never stored
STEPS_SQL = """WITH steps AS (SELECT DISTINCT CONCAT('run', CAST(user_id AS VARCHAR)) AS run, event_id AS step FROM events),
tracker AS (SELECT CONCAT('run', CAST(user_id AS VARCHAR)) AS run, MAX(event_id) + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS last_step FROM events GROUP BY user_id),
current AS (SELECT CONCAT('run', CAST(user_id AS VARCHAR)) AS run, MAX(event_id) AS current_step, arg_max(event_id, row(value, -event_id)) AS best_step FROM events GROUP BY user_id)
"""


def _run(c="user_id"):
    return F.concat(F.lit("run"), F.col(c).cast("string")).alias("run")


def _steps(spark, sf):
    return table(spark, sf, "events").select(_run(), F.col("event_id").alias("step"))


@query(
    "run_latest",
    STEPS_SQL + "SELECT t.run, s.step FROM tracker t LEFT JOIN steps s ON s.run = t.run AND s.step = t.last_step",
)
def run_latest(spark, sf):
    events = table(spark, sf, "events")
    bump = F.when(F.col("user_id") % 3 == 0, F.lit(1)).otherwise(F.lit(0))
    tracker = events.groupBy("user_id").agg(F.max("event_id").alias("m")).select(_run(), (F.col("m") + bump).alias("last_step"))
    return rn.latest_completed(tracker, _steps(spark, sf))


@query(
    "run_retention",
    STEPS_SQL
    + """, older AS (SELECT s.run, s.step, best_step, ROW_NUMBER() OVER (PARTITION BY s.run ORDER BY CASE WHEN step = best_step THEN 1 ELSE 0 END, step DESC) AS rn,
        COUNT(*) FILTER (step = best_step) OVER (PARTITION BY s.run) AS has_best FROM steps s JOIN current c ON c.run = s.run WHERE step < current_step)
    SELECT run, step FROM older WHERE step <> best_step AND rn > GREATEST(4 - has_best, 0)""",
)
def run_retention(spark, sf):
    events = table(spark, sf, "events")
    best = F.max(F.struct("value", (-F.col("event_id")).alias("neg"))).alias("b")
    current = events.groupBy("user_id").agg(F.max("event_id").alias("current_step"), best)
    current = current.select(_run(), "current_step", (-F.col("b.neg")).alias("best_step"))
    return rn.obsolete_steps(_steps(spark, sf), current, limit=5)


@query(
    "run_pending",
    """WITH planned AS (SELECT DISTINCT CONCAT('run', CAST(user_id AS VARCHAR)) AS run, p AS phase FROM events, (SELECT UNNEST(['click', 'error', 'purchase', 'signup', 'view', 'export']) AS p)),
    done AS (SELECT DISTINCT CONCAT('run', CAST(user_id AS VARCHAR)) AS run, event_type AS phase FROM events WHERE value > 60),
    nxt AS (SELECT CONCAT('run', CAST(user_id AS VARCHAR)) AS run, MAX(event_id) + 1 AS next_step FROM events GROUP BY 1)
    SELECT run, phase, next_step FROM planned JOIN nxt USING (run) WHERE (run, phase) NOT IN (SELECT run, phase FROM done)""",
)
def run_pending(spark, sf):
    events = table(spark, sf, "events")
    phases = F.array(*[F.lit(p) for p in ("click", "error", "purchase", "signup", "view", "export")])
    planned = events.select("user_id").distinct().select(_run(), F.explode(phases).alias("phase"))
    done = events.filter("value > 60").select(_run(), F.col("event_type").alias("phase"))
    return rn.pending(planned, done, ["run", "phase"]).join(rn.next_step(_steps(spark, sf)), "run")


# a document is an episode, its lines are the rounds; nested as the collector writes them
def _episodes(spark, sf):
    docs = table(spark, sf, "documents")
    lines = F.split("text", "\n", -1)

    def played(line, i):
        return F.struct(
            (i + 1).alias("round"),
            F.concat(F.lit("q"), i.cast("string")).alias("question_screenshot"),
            F.substring(line, 1, 8).alias("result_screenshot"),
            (F.length(line) % 3).alias("selected_index"),
            F.array(F.length(line), i).alias("click_position"),
            F.lit("2024-01-01T00:00:00").alias("timestamp"),
        )

    return docs.select(
        F.col("doc_id").cast("int").alias("episode_id"),
        F.concat(F.lit("device_"), "source").alias("device_id"),
        F.size(lines).alias("completed_rounds"),
        (F.size(lines) >= 10).alias("success"),
        F.transform(lines, played).alias("rounds"),
    )


@query(
    "episode_summary",
    """WITH e AS (SELECT doc_id, CONCAT('device_', source) AS device_id, len(string_split(text, CHR(10))) AS n FROM documents),
    d AS (SELECT device_id, COUNT(*) AS total_episodes, COUNT(*) FILTER (n >= 10) AS successful_episodes, SUM(n)::BIGINT AS total_rounds_collected FROM e GROUP BY device_id)
    SELECT device_id, 1::BIGINT AS total_devices, total_episodes, successful_episodes, total_rounds_collected FROM d
    UNION ALL SELECT 'all', COUNT(*), SUM(total_episodes)::BIGINT, SUM(successful_episodes)::BIGINT, SUM(total_rounds_collected)::BIGINT FROM d""",
)
def episode_summary(spark, sf):
    devices = rn.device_summary(_episodes(spark, sf))
    total = rn.total_summary(devices).withColumn("device_id", F.lit("all"))
    return devices.withColumn("total_devices", F.lit(1).cast("bigint")).unionByName(total)


@query(
    "episode_rounds",
    """WITH l AS (SELECT doc_id, source, UNNEST(string_split(text, CHR(10))) AS line, generate_subscripts(string_split(text, CHR(10)), 1) AS i FROM documents)
    SELECT doc_id::INT AS episode_id, CONCAT('device_', source) AS device_id, i::INT AS round, (length(line) % 3)::INT AS selected_index, length(line)::INT AS x, (i - 1)::INT AS y FROM l""",
)
def episode_rounds(spark, sf):
    rounds = rn.episode_rounds(_episodes(spark, sf))
    return rounds.select(
        "episode_id", "device_id", "round", "selected_index", F.col("click_position")[0].alias("x"), F.col("click_position")[1].alias("y")
    )


@query(
    "game_summary",
    """WITH g AS (SELECT CONCAT('model', event_type) AS model_name, CASE WHEN value > 100 THEN NULL ELSE floor(value / 10) END AS final_score FROM events)
    SELECT model_name, COUNT(*) AS games, COUNT(final_score) AS scored, ROUND(AVG(final_score), 6) AS avg_score FROM g GROUP BY model_name""",
)
def game_summary(spark, sf):
    score = F.when(F.col("value") <= 100, F.floor(F.col("value") / 10).cast("double"))
    games = table(spark, sf, "events").select(F.concat(F.lit("model"), "event_type").alias("model_name"), score.alias("final_score"))
    return rounded(rn.game_summary(games), "avg_score")
