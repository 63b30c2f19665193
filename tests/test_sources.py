"""Readers, writers and streams on files written here."""

import json

import pytest
from pyspark.sql import functions as F

from curaspark import schemas
from curaspark.operators import assemble
from curaspark.session import shared_path
from curaspark.sources import files as fl
from curaspark.sources.tables import read_table
from curaspark.streaming import streams as st


def test_json_shards(spark, tmp_path):
    for i in (0, 1, 3):
        rows = [{"question": f"q{i}{k}", "answer": "1", "score": 0.5, "results": ["1", None]} for k in range(2)]
        (tmp_path / f"run_{i}_results.json").write_text(json.dumps(rows, indent=4))
    (tmp_path / "run_2_results.json").write_text('[{"question": "half')
    shards = fl.read_shards(spark, f"{tmp_path}/run_[0-7]_results.json", schemas.EVALUATED)
    good = fl.good_rows(shards)
    assert good.count() == 6 and good.select("results").first()[0] == ["1", None]
    assert good.filter("easy_consistency IS NULL").count() == 6
    assert [r["source_file"].rsplit("/", 1)[1] for r in fl.bad_files(shards).collect()] == ["run_2_results.json"]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"model": "a", "accuracy": 1.5}\n\n{"model": "b"\n{"model": "c", "accuracy": 2}\n')
    tolerant = fl.read_jsonl(spark, str(path), schemas.ACCURACY_SUMMARY)
    assert sorted((r["model"], r["accuracy"]) for r in tolerant.collect()) == [("a", 1.5), ("c", 2.0)]
    with pytest.raises(Exception):
        fl.read_jsonl(spark, str(path), schemas.ACCURACY_SUMMARY, strict=True).collect()


def test_eval_responses_by_path(spark, tmp_path):
    for model in ("base", "m1"):
        (tmp_path / model).mkdir()
        for dataset in ("Chart", "Doc", "Chart.shard0"):
            (tmp_path / model / f"{dataset}.jsonl").write_text('{"index": 1, "correct": true}\n')
    found = fl.read_eval_responses(spark, str(tmp_path), "index BIGINT, correct BOOLEAN")
    assert sorted((r["model"], r["dataset"]) for r in found.collect()) == [("base", "Chart"), ("base", "Doc"), ("m1", "Chart"), ("m1", "Doc")]
    one = fl.read_eval_responses(spark, str(tmp_path), "index BIGINT", model="m1", dataset="Doc")
    assert [(r["model"], r["dataset"]) for r in one.collect()] == [("m1", "Doc")]


def test_path_keys_are_cut_not_searched(spark):
    """Keys of odd paths are those of the patterns that say what they are; no row has its path searched by a pattern."""
    root = "file:/tmp/" + "a-long-folder_name.jsonl2" * 4
    tails = ["m/d.jsonl", "m/d.jsonl/part-0.json", "m/d.jsonl/part-0.jsonl", "m.jsonl/d.jsonl", "m/d.jsonl.jsonl", "m/.jsonl/x", "m/d.json", "m/d.jsonl/a/b", "m%20x/d e.jsonl/p", "m//d.jsonl"]
    df = spark.createDataFrame([(f"{root}/{t}",) for t in tails], "path string")
    want = {"model": F.regexp_extract("path", r"([^/]+)/[^/]+\.jsonl(?:/[^/]*)?$", 1), "dataset": F.regexp_extract("path", r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)}
    assert df.withColumns(fl._path_keys(F.col("path"))).exceptAll(df.withColumns(want)).count() == 0
    spark.createDataFrame([(1,)], "item int").write.json(f"{(folder := shared_path(spark, 'keys'))}/m/d.jsonl")
    read = fl.read_eval_responses(spark, folder, "item INT")
    assert [tuple(r) for r in read.collect()] == [(1, "m", "d")]
    assert "regexp" not in read._jdf.queryExecution().optimizedPlan().toString()


def test_open_dataset(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a/train")
    spark.range(2).write.json(f"{tmp_path}/a/test")
    (tmp_path / "one.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "train-0.jsonl").write_text('{"id": 1}\n')
    (tmp_path / "flat" / "val-0.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert fl.open_dataset(spark, f"{tmp_path}/a").count() == 3
    assert fl.open_dataset(spark, f"{tmp_path}/a@test").count() == 2
    assert fl.open_dataset(spark, f"{tmp_path}/one.jsonl").count() == 2
    assert fl.open_dataset(spark, f"{tmp_path}/flat@val").count() == 2
    assert fl.open_dataset(spark, f"{tmp_path}/flat").count() == 1
    with pytest.raises(FileNotFoundError):
        fl.open_dataset(spark, f"{tmp_path}/a@nope")


def test_solver_train_and_summary(spark, tmp_path):
    img = "x" * 300
    df = spark.createDataFrame([("q1", "1", 0.5, 0.5, 0.5, img), ("q2", "", 0.5, 0.5, 0.5, img)], "question string, answer string, score double, hard_consistency double, easy_consistency double, image string")
    fl.write_solver_train(assemble.solver_candidates(df), f"{tmp_path}/s_train.parquet", "s")
    kept = spark.read.parquet(f"{tmp_path}/s_train.parquet")
    assert [f.name for f in kept.schema] == [c.split()[0] for c in schemas.SOLVER_TRAIN.split(", ")]
    assert [(r["problem"], r["problem_type"], r["caption"]) for r in kept.collect()] == [("q1", "numerical", "")]
    summary = spark.read.json(f"{tmp_path}/s_train_summary").collect()[0]
    assert (summary["total_raw_samples"], summary["total_filtered_samples"], summary["score_range"]) == (2, 1, [0.3, 0.8])


def test_write_shards_and_summary(spark, tmp_path):
    df = spark.range(10)
    fl.write_shards(df, F.pmod("id", F.lit(3)), f"{tmp_path}/sh")
    assert spark.read.json(f"{tmp_path}/sh/shard=1").count() == 3
    acc = spark.createDataFrame([("b", "x", 1.0), ("a", "y", 2.0)], "model string, dataset string, accuracy double")
    fl.write_accuracy_summary(acc, f"{tmp_path}/acc")
    assert [r["model"] for r in fl.read_jsonl(spark, f"{tmp_path}/acc", schemas.ACCURACY_SUMMARY).collect()] == ["a", "b"]


def test_narrow_scan_is_spread_only_when_narrow(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(16).write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/many")
    assert read_table(spark, f"{tmp_path}/one", wide=True).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Exchange" not in read_table(spark, f"{tmp_path}/many", wide=True)._jdf.queryExecution().executedPlan().toString()


def test_stream_takes_only_new_files(spark, tmp_path):
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    schema = "question STRING, score DOUBLE"
    for wave in range(3):
        spark.createDataFrame([(f"q{wave}", 0.5)], schema).write.mode("append").json(folder)
        st.consume_results(spark, folder, schema, out, state)
        st.consume_results(spark, folder, schema, out, state)  # nothing new: nothing happens
        assert spark.read.parquet(out).count() == wave + 1


def test_caption_memory(spark, tmp_path):
    """Each step finds the five before it, the state does not grow with the steps, and a call without new files does nothing."""
    folder, held, state = f"{tmp_path}/in", f"{tmp_path}/held", f"{tmp_path}/state"
    schema = "step INT, proposal_id BIGINT, caption STRING"
    seen = {}

    def use(recent, batch, batch_id):
        for r in recent.groupBy("now").agg(F.sort_array(F.collect_list("caption")).alias("c")).collect():
            seen[r["now"]] = r["c"]

    for step in range(12):
        spark.createDataFrame([(step, step, f"c{step:02}")], schema).write.mode("append").json(folder)
        for _ in range(1 + step % 2):
            st.remember_captions(spark, folder, schema, held, state, use)
        assert len(list((tmp_path / "held").glob("batch=*"))) <= 7
    assert seen == {s: [f"c{p:02}" for p in range(max(0, s - 5), s)] for s in range(1, 12)}


def test_captions_are_not_shuffled_to_their_steps(spark):
    """However large the captions are, the few steps go to them; a null step is remembered by none."""
    captions = spark.createDataFrame([(0, 1, "a"), (0, 1, "a"), (4, 2, "b"), (None, 3, "c"), (5, 4, "d")], "step INT, proposal_id BIGINT, caption STRING")
    steps = spark.createDataFrame([(5,), (6,), (None,)], "step INT")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        recent = st.recent_captions(captions, steps)
        assert sorted(map(tuple, recent.collect())) == [(5, 0, 1, "a"), (5, 0, 1, "a"), (5, 4, 2, "b"), (6, 4, 2, "b"), (6, 5, 4, "d")]
        assert "hashpartitioning" not in recent._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounds_wait_for_their_shards(spark, tmp_path):
    """A round goes when it is complete or out of time; a shard counts as it came first; what comes too late stays out."""
    folder, state, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "state", "checkpoint"))
    schema = "round INT, shard STRING, v INT"
    expected = spark.createDataFrame([(r, s, d) for r, d in ((1, 10), (2, 10), (3, 99)) for s in "ab"], "round INT, shard STRING, d BIGINT").select("round", "shard", F.timestamp_seconds("d").alias("deadline"))

    def arrive(second, *rows):
        for r in rows:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").json(folder)
        st.wait_for_shards(spark, folder, schema, expected, state, checkpoint, now=F.timestamp_seconds(F.lit(second)), files_per_batch=1)
        got = sorted(map(tuple, st.released_rows(spark, state, schema).collect()))
        return got, sorted(map(tuple, st.missing_shards(spark, state, "round INT, shard STRING").collect()))

    assert arrive(1, (1, "a", 5), (2, "a", 6)) == ([], [])
    assert arrive(2, (1, "a", 50), (1, "b", 7)) == ([(1, "a", 5), (1, "b", 7)], [])
    assert arrive(10) == ([(1, "a", 5), (1, "b", 7), (2, "a", 6)], [(2, "b")])
    assert arrive(20, (2, "b", 8), (3, "b", 9)) == ([(1, "a", 5), (1, "b", 7), (2, "a", 6)], [(2, "b")])
    assert arrive(100) == ([(1, "a", 5), (1, "b", 7), (2, "a", 6), (3, "b", 9)], [(2, "b"), (3, "a")])
