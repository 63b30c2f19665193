"""Reader queries: the tables are written out in the loop's file layouts and read back.

Files go to the shared folder of the session, so every executor sees them.
"""

from pyspark.sql import functions as F

from curaspark import schemas
from curaspark.operators import assemble
from curaspark.operators import evaluate as ev
from curaspark.plans import assembly, evaluation
from curaspark.plans.catalog import query
from curaspark.plans.evaluation import ACCURACY_SQL
from curaspark.plans.standins import table, view, with_views
from curaspark.session import shared_path
from curaspark.sources import files as fl

DOCUMENT = "doc_id BIGINT, lang STRING, text STRING"


def _per_lang(rows):
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def write_shard_files(spark, sf, path):
    """JSON array files of at most 200 documents each (ids are unique); every seventh file is cut off in the middle."""
    docs = table(spark, sf, "documents")
    record = F.to_json(F.struct("doc_id", "lang", "text"))
    shard = F.floor(F.col("doc_id") / 200)
    arrays = docs.groupBy(shard.alias("shard")).agg(F.concat_ws(",\n", F.collect_list(record)).alias("body"))
    whole = F.concat(F.lit("["), "body", F.lit("]"))
    cut_off = F.concat(F.lit("["), F.expr("left(body, length(body) - 5)"))
    text = F.when(F.col("shard") % 7 == 3, cut_off).otherwise(whole)
    arrays.select("shard", text.alias("value")).write.partitionBy("shard").text(path)


@query(
    "io_sharded_json",
    """SELECT lang, COUNT(*) AS n, SUM(length(text))::BIGINT AS chars FROM documents WHERE floor(doc_id / 200) % 7 <> 3 GROUP BY lang
       UNION ALL SELECT 'unreadable files', COUNT(DISTINCT floor(doc_id / 200)), 0 FROM documents WHERE floor(doc_id / 200) % 7 = 3""",
)
def io_sharded_json(spark, sf):
    path = shared_path(spark, "shards")
    write_shard_files(spark, sf, path)
    shards = fl.read_shards(spark, f"{path}/shard=*/*.txt", DOCUMENT)
    bad = fl.bad_files(shards).agg(F.lit("unreadable files").alias("lang"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("chars"))
    return _per_lang(fl.good_rows(shards)).unionByName(bad)


@query(
    "io_jsonl",
    """SELECT 'tolerant' AS form, lang, COUNT(*) AS n, SUM(length(text))::BIGINT AS chars FROM documents WHERE doc_id % 10 <> 3 GROUP BY lang
       UNION ALL SELECT 'strict', lang, COUNT(*), SUM(length(text))::BIGINT FROM documents GROUP BY lang""",
)
def io_jsonl(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    record = F.to_json(F.struct("doc_id", "lang", "text"))
    bad = F.when(F.col("doc_id") % 10 == 3, F.expr("left(j, length(j) - 2)")).otherwise(F.col("j"))
    loose, clean = shared_path(spark, "loose"), shared_path(spark, "clean")
    lines = docs.select("doc_id", record.alias("j"))
    # blank lines between the records, every tenth record cut off
    lines.select(F.explode(F.array(F.lit(""), bad)).alias("value")).write.text(loose)
    lines.select("j").write.text(clean)
    tolerant = _per_lang(fl.read_jsonl(spark, loose, DOCUMENT)).withColumn("form", F.lit("tolerant"))
    strict = _per_lang(fl.read_jsonl(spark, clean, DOCUMENT, strict=True)).withColumn("form", F.lit("strict"))
    return tolerant.unionByName(strict)


@query("io_path_keys", ACCURACY_SQL + "SELECT model, dataset, accuracy, correct, total FROM accuracy_summary WHERE model = 'solver_v2_step20'")
def io_path_keys(spark, sf):
    root = shared_path(spark, "responses")
    records = view(spark, sf, "eval_records", wide=True)
    # a shard file that must be ignored
    partial = records.withColumn("dataset", F.concat("dataset", F.lit(".shard0")))
    fl.write_eval_responses(records.unionByName(partial), root)
    read = fl.read_eval_responses(spark, root, "item BIGINT, ground_truth STRING, model_response STRING", model="solver_v2_step20")
    return ev.accuracy(read).select("model", "dataset", "accuracy", "correct", "total")


@query(
    "io_dataset_open",
    """SELECT 'train' AS split, lang, COUNT(*) AS n, SUM(length(text))::BIGINT AS chars FROM documents GROUP BY lang
       UNION ALL SELECT 'test', role, COUNT(*), SUM(length(text))::BIGINT FROM conversations GROUP BY role""",
)
def io_dataset_open(spark, sf):
    root = shared_path(spark, "dataset")
    table(spark, sf, "documents").select("lang", "text").write.parquet(f"{root}/train")
    table(spark, sf, "conversations").select(F.col("role").alias("lang"), "text").write.json(f"{root}/test")
    train = _per_lang(fl.open_dataset(spark, root)).withColumn("split", F.lit("train"))
    test = _per_lang(fl.open_dataset(spark, f"{root}@test", "lang STRING, text STRING")).withColumn("split", F.lit("test"))
    return train.unionByName(test)


# metric names of one to five parts
METRIC_NAME = """CONCAT(CASE user_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'reward/' WHEN 2 THEN 'reward/detail/' WHEN 3 THEN 'val/reward/detail/'
    ELSE 'val/reward/detail/by_kind/' END, event_type)"""


@query(
    "io_metric_log",
    f"SELECT CAST(event_id % 10 AS INT) AS step, {METRIC_NAME} AS metric, ROUND(AVG(value), 9) AS value FROM events GROUP BY 1, 2",
)
def io_metric_log(spark, sf):
    from curaspark.operators.metrics import flatten_metrics, nest_metrics

    events = table(spark, sf, "events")
    means = events.groupBy((F.col("event_id") % 10).cast("int").alias("step"), F.expr(METRIC_NAME).alias("metric"))
    logs = nest_metrics(means.agg(F.avg("value").alias("value")), ["step"])
    path = shared_path(spark, "log")
    # two appends, as two stages of a run would write them
    fl.append_metric_log(logs.filter("step < 5"), path)
    fl.append_metric_log(logs.filter("step >= 5"), path)
    read = fl.read_jsonl(spark, path, "step INT, log STRING")
    return flatten_metrics(read, ["step"]).withColumn("value", F.round("value", 9))


@query(
    "io_solver_sink",
    with_views("evaluated")
    + f""", kept AS (SELECT * FROM evaluated WHERE {assembly.USABLE_SQL} AND easy_consistency >= 0.5 AND hard_consistency BETWEEN 0.25 AND 0.75)
    SELECT question_type AS problem_type, COUNT(*) AS n, ROUND(AVG(score), 6) AS mean_score, (SELECT COUNT(*) FROM evaluated) AS total_raw_samples,
           (SELECT COUNT(*) FROM kept) AS total_filtered_samples FROM kept GROUP BY question_type""",
)
def io_solver_sink(spark, sf):
    """The solver's training set and its summary, as a later stage reads them."""
    path = shared_path(spark, "solver") + ".parquet"
    fl.write_solver_train(assemble.solver_candidates(view(spark, sf, "evaluated", wide=True)), path, "solver")
    summary = spark.read.schema("total_raw_samples BIGINT, total_filtered_samples BIGINT").json(path.removesuffix(".parquet") + "_summary")
    kept = spark.read.parquet(path).groupBy("problem_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    return kept.select("*", *[summary.select(c).scalar().alias(c) for c in summary.columns])


@query("io_codegen_sink", assembly.CODEGEN_TRAIN_SQL)
def io_codegen_sink(spark, sf):
    """The CodeGen training set, written and read again."""
    path = shared_path(spark, "codegen")
    fl.write_training_set(assembly.asm_codegen_train(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "io_shard_merge",
    with_views("eval_records") + "SELECT model, dataset, COUNT(*) AS n, SUM(length(model_response))::BIGINT AS chars FROM eval_records GROUP BY model, dataset",
)
def io_shard_merge(spark, sf):
    """Each of eight workers writes the sums of its shard; the report adds them up."""
    records = view(spark, sf, "eval_records", wide=True).withColumn("worker", F.pmod("item", F.lit(8)).cast("int"))
    sums = records.groupBy("model", "dataset", "worker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("model_response")).alias("chars"))
    path = shared_path(spark, "shards")
    fl.write_shards(sums.drop("worker"), F.pmod(F.col("n"), F.lit(8)).cast("int"), path)
    merged = fl.read_shard_folders(spark, path, "model STRING, dataset STRING, n BIGINT, chars BIGINT")
    return merged.groupBy("model", "dataset").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query("io_accuracy_summary", ACCURACY_SQL + "SELECT model, dataset, accuracy, correct, total FROM accuracy_summary")
def io_accuracy_summary(spark, sf):
    """The accuracy report, written as JSON lines and read again."""
    path = shared_path(spark, "accuracy")
    fl.write_accuracy_summary(evaluation.eval_accuracy(spark, sf), path)
    return fl.read_jsonl(spark, path, schemas.ACCURACY_SUMMARY).select("model", "dataset", "accuracy", "correct", "total")
