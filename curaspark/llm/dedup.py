"""Exact deduplication by a stateful stream.

Texts are equal when their bytes agree after every run of white space became one space. A row reduces to an arrival: the
digest of its text, its identifier and its number among the arrivals. A streaming aggregation keyed by the digest holds, in
a disk-backed state store without watermark and so without expiry, the smallest identifier, the arrival number that
locates its content, and how many rows came. State is written to the shared folder with each batch, so later arrivals can
continue it and lost executors cost no more than the batch at hand.

A digest met twice is a hit, and hits are checked on full bytes: the texts behind repeated digests are grouped by the bytes
themselves. Should two texts share a digest, the bytes decide and each text gets a group of its own.

Null texts count as empty, and empty texts equal each other. A null identifier is the smallest. Rows that repeat an
identifier and a text are rows of their own: the first arrival among the smallest identifiers is the one that stays. An
empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from contextlib import contextmanager
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.llm.common import sent_if_small
from curaspark.session import cut_lineage, shared_path

FILES_PER_BATCH = 1000
BROADCAST_ROWS = 200_000  # digests; above it the join that looks for them shuffles
#: On disk, without space set aside ahead (megabytes per partition), and with changes rather than copies written per batch.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the queries started within."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(arrivals: str, schema, state: str, out: str, spark: SparkSession, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Bring the files that are new in the folder ``arrivals`` into the state; the latest state of every digest.

    ``state`` holds the stream's checkpoint and ``out`` the changes of each batch. Calling again with the same folders
    goes on where the last call ended.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    keyed = stream.groupBy("digest").agg(F.min(F.struct("key", "number")).alias("first"), F.count(F.lit(1)).alias("group_size"))

    def changes(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that runs again replaces itself

    with _conf(spark, STORE):
        query = keyed.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(changes).start()
        query.awaitTermination()
    changed = spark.read.option("basePath", out).schema(keyed.schema.add("batch", T.LongType())).parquet(out)
    latest = changed.groupBy("digest").agg(F.max(F.struct("batch", "first", "group_size")).alias("s"))
    return latest.select("digest", F.col("s.first").alias("first"), F.col("s.group_size").alias("group_size"))


def exact_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """(key, digest, keep_key, group_size, kept): one row per row of ``df``; ``kept`` marks the one row of a group that stays."""
    spark = df.sparkSession
    texts = df.select(F.col(key).alias("key"), normalised(F.col(text)).alias("content"))
    path = shared_path(spark, "arrivals")
    rows = texts.select("key", digest(F.col("content")).alias("digest"), F.monotonically_increasing_id().alias("number"))
    rows.write.parquet(path)
    arrivals = spark.read.schema(rows.schema).parquet(path)
    if arrivals.isEmpty():
        return arrivals.select(F.col("key").alias(key), "digest", F.col("key").alias("keep_key"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    state = cut_lineage(keyed_state(path, rows.schema, shared_path(spark, "state"), shared_path(spark, "changes"), spark, files_per_batch))

    # hits: the texts behind a repeated digest, grouped by their bytes (equal ones merge before they are shuffled)
    repeated = state.filter("group_size > 1").select("digest")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    behind = texts.select("key", "content", digest(F.col("content")).alias("digest")).join(repeated, "digest", "left_semi")
    contents = cut_lineage(behind.groupBy("digest", "content").agg(F.min("key").alias("least"), F.count_if(F.col("key").isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")))
    shared = contents.groupBy("digest").count().filter("count > 1").select("digest")
    grouped = arrivals.join(state, "digest").select(
        F.col("key").alias(key), "digest", F.col("first.key").alias("keep_key"), "group_size", (F.col("number") == F.col("first.number")).alias("kept")
    )
    if shared.isEmpty():
        return grouped
    # digests that stand for several texts: the bytes are the key
    apart = behind.join(shared, "digest", "left_semi").join(contents, ["digest", "content"])
    keep = F.when(F.col("nulls") > 0, F.lit(None)).otherwise(F.col("least"))
    first = F.row_number().over(Window.partitionBy("digest", "content", "key").orderBy("key")) == 1
    apart = apart.select(F.col("key").alias(key), "digest", keep.alias("keep_key"), F.col("rows").alias("group_size"), (F.col("key").eqNullSafe(keep) & first).alias("kept"))
    return grouped.join(shared, "digest", "left_anti").unionByName(apart)


def drop_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Rows are told apart by identifier and text. Those that repeat both keep one row.
    """
    groups = cut_lineage(exact_groups(df, key, text))
    ids = cut_lineage(groups.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"), F.max("kept").alias("__kept")))
    if ids.filter("__rows > 1").isEmpty():  # identifiers tell rows apart
        dropped = sent_if_small(ids.filter("NOT __kept").select("__key"))
        return df.join(dropped, df[key].eqNullSafe(dropped["__key"]), "left_anti")
    by_id = groups.groupBy(F.col(key).alias("__key"), F.col("digest").alias("__digest")).agg(F.count(F.lit(1)).alias("__rows"), F.max("kept").alias("__kept"))
    by_id = cut_lineage(by_id.filter("NOT __kept OR __rows > 1"))
    marked = df.withColumn("__digest", sha256(normalised(F.col(text))))
    same = marked[key].eqNullSafe(by_id["__key"]) & (marked["__digest"] == by_id["__digest"])
    stay = marked.join(sent_if_small(by_id), same, "left_anti").drop("__digest")
    if by_id.filter("__kept").isEmpty():
        return stay
    once = marked.join(by_id.filter("__kept"), same, "left_semi").dropDuplicates([key, "__digest"]).drop("__digest")
    return stay.unionByName(once)
