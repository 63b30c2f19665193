"""Streaming queries: the input is written to the shared folder and taken in by Structured Streaming."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from curaspark.plans.catalog import query
from curaspark.plans.standins import table, view
from curaspark.session import shared_path
from curaspark.streaming import streams as st


@query("stream_results", "SELECT event_type AS kind, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY event_type")
def stream_results(spark, sf):
    folder, out, checkpoint = (shared_path(spark, f"results-{p}") for p in ("in", "out", "state"))
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    schema = "event_id BIGINT, kind STRING, value DOUBLE"
    # two waves of files; the second run takes in only what is new
    for late in (False, True):
        rows.filter((F.col("event_id") % 3 == 0) == late).write.mode("append").json(folder)
        st.consume_results(spark, folder, schema, out, checkpoint, files_per_batch=2)
    taken = spark.read.schema(schema).parquet(out)
    return taken.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "stream_progress",
    """SELECT user_id % 16 AS shard, COUNT(*) FILTER (event_id % 32 < CASE WHEN user_id % 16 % 3 = 0 THEN 20 ELSE 32 END) AS done, COUNT(*) AS total
    FROM events GROUP BY 1 HAVING done > 0""",
)
def stream_progress(spark, sf):
    folder, out, checkpoint = (shared_path(spark, f"progress-{p}") for p in ("in", "out", "state"))
    events = table(spark, sf, "events").select((F.col("user_id") % 16).alias("shard"), (F.col("event_id") % 32).alias("chunk"))
    # a worker finishes its items in 32 chunks and logs a line after each; every third worker has come to chunk 20
    chunks = events.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("k"))
    worker = Window.partitionBy("shard")
    chunks = chunks.withColumn("done", F.sum("k").over(worker.orderBy("chunk"))).withColumn("total", F.sum("k").over(worker))
    chunks = chunks.filter(F.col("chunk") < F.when(F.col("shard") % 3 == 0, 20).otherwise(32))
    text = F.format_string("  [shard %d] chunk %d/32 (%d/%d)...", "shard", F.col("chunk") + 1, "done", "total")
    # the logs are read twice: when they are part written, and after a restart
    for late in (False, True):
        part = chunks.filter((F.col("chunk") >= 12) == late)
        part.select(F.explode(F.array(text, F.lit("Loading..."))).alias("value")).write.mode("append").text(folder)
        st.track_progress(spark, folder, out, checkpoint, files_per_batch=2)
    return st.latest_progress(spark, out)


@query(
    "stream_caption_memory",
    """WITH c AS (SELECT CAST(doc_id % 10 AS INT) AS step, COUNT(*) AS n, SUM(length(text))::BIGINT AS chars FROM documents GROUP BY 1)
    SELECT now.step, COALESCE(SUM(past.n), 0)::BIGINT AS n_remembered, COALESCE(SUM(past.chars), 0)::BIGINT AS chars FROM c now LEFT JOIN c past ON past.step >= now.step - 5 AND past.step < now.step GROUP BY now.step""",
)
def stream_caption_memory(spark, sf):
    folder, state, out, checkpoint = (shared_path(spark, f"captions-{p}") for p in ("in", "state", "out", "checkpoint"))
    captions = table(spark, sf, "documents").select(
        (F.col("doc_id") % 10).cast("int").alias("step"), F.col("doc_id").alias("proposal_id"), F.col("text").alias("caption")
    )
    schema = "step INT, proposal_id BIGINT, caption STRING"

    def count(recent, batch, batch_id):
        seen = recent.groupBy(F.col("now").alias("step")).agg(F.count(F.lit(1)).alias("n_remembered"), F.sum(F.length("caption")).cast("bigint").alias("chars"))
        batch.select("step").distinct().join(seen, "step", "left").fillna(0).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # a file per step; the stream runs when half of them are there, and again after a restart
    for steps in (range(5), range(5, 10)):
        for step in steps:
            captions.filter(F.col("step") == step).coalesce(1).write.mode("append").json(folder)
        st.remember_captions(spark, folder, schema, state, checkpoint, count, files_per_batch=1)
    return spark.read.parquet(out).select("step", "n_remembered", "chars")


WAIT_SQL = """WITH e AS (SELECT CAST(user_id % 7 AS INT) AS round, CAST(event_id % 8 AS INT) AS shard, value FROM events),
    r AS (SELECT DISTINCT round FROM e),
    s AS (SELECT round, s.shard, CASE WHEN round = 3 AND s.shard = 5 THEN 'lost' WHEN round % 2 = 1 AND s.shard = 2 THEN 'late' ELSE 'here' END AS fate FROM r, range(8) s(shard)),
    -- the rounds without a late shard go first; the third of the others is out of time before its last shard comes
    kept AS (SELECT round, shard FROM s WHERE fate = 'here' OR (fate = 'late' AND round <> 3))
    SELECT k.round, COUNT(DISTINCT k.shard) AS n_shards, COUNT(value) AS n, ROUND(COALESCE(SUM(value), 0), 4) AS total,
           (SELECT COALESCE(string_agg(shard::VARCHAR, ',' ORDER BY shard), '') FROM s WHERE s.round = k.round AND NOT EXISTS (SELECT 1 FROM kept q WHERE q.round = s.round AND q.shard = s.shard)) AS missing
    FROM kept k JOIN e ON e.round = k.round AND e.shard = k.shard GROUP BY k.round"""


@query("stream_wait", WAIT_SQL)
def stream_wait(spark, sf):
    """Rounds of eight shards: some come late, one comes twice, one never, and one too late for its round."""
    folder, state, checkpoint = (shared_path(spark, f"wait-{p}") for p in ("in", "state", "checkpoint"))
    schema = "round INT, shard INT, value DOUBLE"
    rows = table(spark, sf, "events").select((F.col("user_id") % 7).cast("int").alias("round"), (F.col("event_id") % 8).cast("int").alias("shard"), "value")
    expected = rows.select("round").distinct().select("round", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("shard"))
    expected = expected.withColumn("deadline", F.timestamp_seconds(F.when(F.col("round") == 3, 100).otherwise(1000)))
    lost, late = (F.col("round") == 3) & (F.col("shard") == 5), (F.col("round") % 2 == 1) & (F.col("shard") == 2)
    waves = ((~late & ~lost, 50), (F.lit(False), 150), (late | ((F.col("round") == 0) & (F.col("shard") == 1)), 200))
    for wave, (arriving, seconds) in enumerate(waves):
        # a file holds whole shards
        if wave != 1:
            rows.filter(arriving).repartition("round", "shard").write.mode("append").json(folder)
        st.wait_for_shards(spark, folder, schema, expected, state, checkpoint, now=F.timestamp_seconds(F.lit(seconds)), files_per_batch=3)
    taken = st.released_rows(spark, state, schema).groupBy("round").agg(F.countDistinct("shard").alias("n_shards"), F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    gone = st.missing_shards(spark, state, "round INT, shard INT").groupBy("round").agg(F.array_join(F.sort_array(F.collect_list(F.col("shard"))), ",").alias("missing"))
    return taken.join(gone, "round", "left").fillna("", ["missing"])
