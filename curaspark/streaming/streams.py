"""Structured Streaming forms of the operators that are incremental by nature.

Each runs with the ``availableNow`` trigger: it takes in what has arrived since the last run and stops, and a folder of
checkpoints remembers how far it came. A batch is written under its batch id with ``overwrite``, so a batch that runs
again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def consume_results(
    spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, multi_line: bool = False, files_per_batch: int = 64
) -> None:
    """Take in result files as they appear and append their rows to a parquet table."""
    stream = (
        spark.readStream.schema(schema).option("multiLine", multi_line).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(stream, sink, checkpoint)


# Fixed value: a progress line of a worker's log, such as "[shard 3] chunk 2/5 (512/1280)...".
PROGRESS_LINE = r"\[shard (\d+)\] chunk (\d+)/(\d+) \((\d+)/(\d+)\)"


def progress_of_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """(shard, done, total, chunk, chunks) of the progress lines of a log; other lines are dropped."""
    names = ["shard", "chunk", "chunks", "done", "total"]
    parts = [F.regexp_extract(F.col(line), PROGRESS_LINE, i + 1).cast("bigint").alias(n) for i, n in enumerate(names)]
    return lines.filter(F.col(line).rlike(PROGRESS_LINE)).select(*parts)


def track_progress(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 64) -> None:
    """Items done and total per shard, from the logs the workers write.

    Complete mode holds one row per shard. Each batch writes the report anew under its number; ``latest_progress`` reads
    the last one, so a reader never meets a report that is half written.
    """
    logs = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    progress = progress_of_lines(logs).groupBy("shard").agg(F.max("done").alias("done"), F.max("total").alias("total"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(progress, sink, checkpoint, mode="complete")


def latest_progress(spark: SparkSession, out: str) -> DataFrame:
    """(shard, done, total) of the last report."""
    reports = spark.read.option("basePath", out).schema("shard BIGINT, done BIGINT, total BIGINT, batch BIGINT").parquet(out)
    last = reports.groupBy("shard").agg(F.max_by(F.struct("done", "total"), "batch").alias("r"))
    return last.select("shard", "r.done", "r.total")


# ---------------------------------------------------------------- waiting for shards


def wait_for_shards(
    spark: SparkSession, folder: str, schema: str, expected: DataFrame, state: str, checkpoint: str, now: Column | None = None, files_per_batch: int = 64
) -> None:
    """Take in the files of rounds whose shards arrive in any order, and let a round go when it is complete or out of time.

    ``expected`` has one row (round, shard, deadline) per shard to wait for; rows of the files name their ``round`` and
    ``shard``. A shard that arrives twice counts once, as it came first. Below ``state`` the tables ``staged`` (rows, by batch and
    round), ``arrivals`` (round, shard, batch, file) and ``released`` (rounds, with the shards they went without) are kept;
    ``released_rows`` and ``missing_shards`` read them. What comes for a round that has gone stays in ``arrivals`` and is not
    released. A round is decided on after the stream has taken in what is there, so a call without new files lets rounds
    go whose deadline has passed. ``now`` is the time of the decision.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    stream = stream.withColumn("file", F.col("_metadata.file_path"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("round").parquet(f"{state}/staged/batch={batch_id}")
        arrived = batch.groupBy("round", "shard", "file").agg(F.count(F.lit(1)).alias("n"))
        arrived.write.mode("overwrite").parquet(f"{state}/arrivals/batch={batch_id}")

    run_available(stream, sink, checkpoint)
    key_types = ", ".join(f"{c} {expected.schema[c].dataType.simpleString()}" for c in ("round", "shard"))
    arrivals = _table(spark, f"{state}/arrivals", f"{key_types}, file STRING, n BIGINT, batch INT")
    done = _table(spark, f"{state}/released", f"{key_types}, arrived BOOLEAN, late BOOLEAN, batch INT")
    there = arrivals.select("round", "shard", F.lit(True).alias("arrived")).distinct()
    waited = expected.join(there, ["round", "shard"], "left").join(done.select("round").distinct(), "round", "left_anti")
    rounds = waited.groupBy("round").agg(F.every(F.col("arrived").isNotNull()).alias("complete"), F.max("deadline").alias("deadline"))
    going = rounds.filter(F.col("complete") | (F.col("deadline") <= (F.current_timestamp() if now is None else now)))
    decided = waited.join(going, "round").select("round", "shard", F.coalesce("arrived", F.lit(False)).alias("arrived"), (~F.col("complete")).alias("late"))
    number = (done.agg(F.max("batch")).first()[0] or 0) + 1
    decided.write.mode("overwrite").parquet(f"{state}/released/batch={number}")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written by batches; empty before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def released_rows(spark: SparkSession, state: str, schema: str) -> DataFrame:
    """Rows of the rounds that have gone: of each shard the file that came first, as far as it had come by then."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    staged = _table(spark, f"{state}/staged", f"{schema}, file STRING, batch INT")
    keys = ", ".join(f"{c} {staged.schema[c].dataType.simpleString()}" for c in ("round", "shard"))
    arrivals = _table(spark, f"{state}/arrivals", f"{keys}, file STRING, n BIGINT, batch INT")
    gone = _table(spark, f"{state}/released", f"{keys}, arrived BOOLEAN, late BOOLEAN, batch INT").filter("arrived").select("round", "shard")
    first = arrivals.join(gone, ["round", "shard"], "left_semi").groupBy("round", "shard").agg(F.min(F.struct("batch", "file")).alias("f"))
    return staged.join(first.select("round", "shard", "f.batch", "f.file"), ["round", "shard", "batch", "file"]).select(*names)


def missing_shards(spark: SparkSession, state: str, keys: str) -> DataFrame:
    """(round, shard) of the shards that rounds went without; ``keys`` gives the types of both columns."""
    return _table(spark, f"{state}/released", f"{keys}, arrived BOOLEAN, late BOOLEAN, batch INT").filter("NOT arrived").select("round", "shard")


# ---------------------------------------------------------------- caption memory


def remember_captions(
    spark: SparkSession, folder: str, schema: str, state: str, checkpoint: str, use: Callable[[DataFrame, DataFrame, int], None], memory: int = 5, files_per_batch: int = 64
) -> None:
    """Captions (step, proposal_id, caption) as they arrive, next to those of the ``memory`` steps before them.

    ``use(recent, batch, batch_id)`` gets the arriving rows and ``recent``: for each of their steps (``now``) the captions it looks
    back on. Steps arrive in order, a step in one batch or several. The state is a table by batch and step; a batch first lets go of
    steps that neither it nor a later one can look back on, so the state holds the last steps only, however many went by. What is let
    go follows from earlier batches alone, so a batch that runs again finds what it found before.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("step", "proposal_id", "caption")
        held = _table(spark, state, f"{schema}, batch INT").filter(F.col("batch") < batch_id)
        newest = held.agg(F.max("step")).first()[0]
        if newest is not None:
            _forget(spark, state, newest - memory)
            held = _table(spark, state, f"{schema}, batch INT").filter(F.col("batch") < batch_id)
        use(recent_captions(held.select(*batch.columns).unionByName(batch), batch.select("step").distinct(), memory), batch, batch_id)
        batch.write.mode("overwrite").partitionBy("step").parquet(f"{state}/batch={batch_id}")

    run_available(stream, sink, checkpoint)


def recent_captions(captions: DataFrame, steps: DataFrame, memory: int = 5) -> DataFrame:
    """(now, step, proposal_id, caption): for every step of ``steps`` the captions of the ``memory`` steps before it.

    The steps of a batch are few numbers; they are sent to the captions, which are not shuffled.
    """
    asked = steps.select(F.col("step").alias("now"), F.explode(F.sequence(F.col("step") - memory, F.col("step") - 1)).alias("step"))
    return captions.join(F.broadcast(asked), "step").select("now", *captions.columns)


def _forget(spark: SparkSession, state: str, before: int) -> None:
    """Delete the folders of steps before ``before``, and batches that hold none any more. A listing of a few folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(state).getFileSystem(spark._jsc.hadoopConfiguration())
    for batch in files.listStatus(path(state)):
        steps = [s.getPath() for s in files.listStatus(batch.getPath()) if s.isDirectory()]
        old = [s for s in steps if int(s.getName().partition("=")[2]) < before]
        for s in [batch.getPath()] if steps and len(old) == len(steps) else old:
            files.delete(s, True)
