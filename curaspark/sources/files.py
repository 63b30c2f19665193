"""Readers and writers for the files of a self-play loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


# ---------------------------------------------------------------- JSON array shards


def read_shards(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Rows of JSON array files. Unreadable files give one row each with ``_corrupt_record`` set and no data.

    Missing files of a fixed shard set are simply not matched by a glob such as ``name_[0-7].json``. The shard file is
    kept as ``source_file``. Use ``good_rows`` to drop the unreadable ones and ``bad_files`` to list them.
    """
    fields = _struct(schema).add(BAD, T.StringType())
    df = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    return df.json(paths if isinstance(paths, str) else list(paths)).withColumn("source_file", F.col("_metadata.file_path"))


def _reads_data(shards: DataFrame) -> Column:
    """Always true, but looks at a data column: Spark refuses to scan JSON for the corrupt column alone."""
    data = next(c for c in shards.columns if c not in (BAD, "source_file"))
    return F.length(F.coalesce(F.col(data).cast("string"), F.lit(""))) >= 0


def good_rows(shards: DataFrame) -> DataFrame:
    return shards.filter(F.col(BAD).isNull() & _reads_data(shards)).drop(BAD)


def bad_files(shards: DataFrame) -> DataFrame:
    """Files that could not be read, with the number of faulty records."""
    faulty = shards.filter(F.col(BAD).isNotNull() & _reads_data(shards))
    return faulty.groupBy("source_file").agg(F.count(F.lit(1)).alias("bad_records"))


# ---------------------------------------------------------------- JSON lines


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. Bad lines are skipped too, or raise in the strict form."""
    fields = _struct(schema)
    names = paths if isinstance(paths, str) else list(paths)
    if strict:
        return spark.read.schema(fields).option("mode", "FAILFAST").json(names)
    return spark.read.schema(fields).option("mode", "DROPMALFORMED").json(names)


def read_eval_responses(
    spark: SparkSession, root: str, schema: str | T.StructType, model: str | None = None, dataset: str | None = None
) -> DataFrame:
    """Records of ``root/<model>/<dataset>.jsonl`` (a file or a folder of part files), keyed by their path.

    A wanted model or dataset narrows the glob, so other files are never listed. Partial ``.shard`` files are left out
    by a condition on the file path, which Spark applies to the list of files.
    """
    pattern = f"{root}/{model or '*'}/{dataset or '*'}.jsonl"
    df = spark.read.schema(_struct(schema)).option("mode", "DROPMALFORMED").json(pattern)
    path = F.col("_metadata.file_path")
    return df.filter(~path.contains(".shard")).withColumns(_path_keys(path))


def _path_keys(path: Column) -> dict[str, Column]:
    """Model and dataset of ``<model>/<dataset>.jsonl`` or of a file in such a folder; other paths have empty ones.

    The path is a value of every row, so it is cut at its last slashes: a pattern with an open start would try every place of it.
    """

    def part(n: int) -> Column:
        """The ``n``-th part from the end."""
        return F.substring_index(F.substring_index(path, "/", -n), "/", 1)

    def named(name: Column) -> Column:
        return name.endswith(".jsonl") & (F.length(name) > len(".jsonl"))

    def stem(name: Column) -> Column:
        return F.substring(name, F.lit(1), F.length(name) - len(".jsonl"))

    in_folder, is_file = named(part(2)), named(part(1))
    return {
        "model": F.when(in_folder, part(3)).when(is_file, part(2)).otherwise(F.lit("")),
        "dataset": F.when(in_folder, stem(part(2))).when(is_file, stem(part(1))).otherwise(F.lit("")),
    }


def write_eval_responses(records: DataFrame, root: str) -> None:
    """Write records as ``root/<model>/<dataset>.jsonl``: folders of part files, so a large data set stays split."""
    spark = records.sparkSession
    staged = f"{root}/_staged"
    records.write.partitionBy("model", "dataset").json(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for model in fs.listStatus(hadoop.Path(staged)):
        if not model.isDirectory():
            continue
        target = f"{root}/{model.getPath().getName().partition('=')[2]}"
        fs.mkdirs(hadoop.Path(target))
        for dataset in fs.listStatus(model.getPath()):
            name = dataset.getPath().getName().partition("=")[2]
            fs.rename(dataset.getPath(), hadoop.Path(f"{target}/{name}.jsonl"))


# ---------------------------------------------------------------- datasets


def open_dataset(spark: SparkSession, location: str, schema: str | None = None) -> DataFrame:
    """A data set by its location: ``path`` or ``path@split``; the format follows the file extension.

    A split is a sub-folder of that name, or files that start with it. Without one the split is ``train``, and a path
    that has no such split is read whole.
    """
    path, _, split = location.partition("@")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop.Path(path)):
        raise FileNotFoundError(path)

    def names(folder: str) -> list[str]:
        return [s.getPath().getName() for s in fs.listStatus(hadoop.Path(folder))]

    wanted, prefix = split or "train", ""
    if not fs.getFileStatus(hadoop.Path(path)).isFile():
        listed = names(path)
        if wanted in listed:
            path = f"{path}/{wanted}"
        elif any(n.startswith(wanted) for n in listed):
            prefix = wanted
        elif split:
            raise FileNotFoundError(f"no split {split} in {path}")
        listed = [n for n in names(path) if n.startswith(prefix) and n[:1] not in "_."]
        extension = listed[0].rpartition(".")[2] if listed else "parquet"
    else:
        extension = path.rpartition(".")[2]
    fmt = {"jsonl": "json"}.get(extension, extension)
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if prefix:
        reader = reader.option("pathGlobFilter", f"{prefix}*")
    return reader.load(path)


# ---------------------------------------------------------------- sinks


def write_training_set(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_solver_train(candidates: DataFrame, path: str, name: str, score_range: tuple[float, float] = (0.3, 0.8)) -> DataFrame:
    """Write the kept candidates as parquet and a one-row JSON summary next to it; return the summary.

    Kept rows are counted from what was written, all rows from the input's reject reasons.
    """
    from curaspark.operators.assemble import solver_training_set

    spark = candidates.sparkSession
    write_training_set(solver_training_set(candidates), path)
    kept = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("total_filtered_samples"))
    summary = candidates.agg(F.count(F.lit(1)).alias("total_raw_samples")).select(
        "total_raw_samples",
        kept.scalar().alias("total_filtered_samples"),
        F.array(*[F.lit(s) for s in score_range]).alias("score_range"),
        F.lit(name).alias("experiment_name"),
        F.lit(path).alias("output_file"),
    )
    summary.write.mode("overwrite").json(f"{path.removesuffix('.parquet')}_summary")
    return summary


def write_shards(rows: DataFrame, shard: Column, path: str) -> None:
    """One folder per shard. A shard is written by as many tasks as its size asks for."""
    rows.withColumn("shard", shard).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").json(path)


def read_shard_folders(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all shards that ``write_shards`` wrote below ``path``, with their shard number."""
    return spark.read.option("basePath", path).schema(f"{schema}, shard INT").json(path)


def write_accuracy_summary(summary: DataFrame, path: str) -> None:
    """The merged summary in (model, dataset) order as JSON lines: a small report, hence one file."""
    summary.orderBy("model", "dataset").coalesce(1).write.mode("overwrite").json(path)


def append_metric_log(logs: DataFrame, path: str) -> None:
    """Append one JSON object per step to a log folder."""
    logs.write.mode("append").json(path)
