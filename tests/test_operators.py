"""Operators on small tables: votes, rewards, advantages, batches, runs, evaluation, registry."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from curaspark.operators import advantages as adv
from curaspark.operators import assemble, coevolution, evaluate, metrics, registry, rewards, runs, votes
from curaspark.operators import batch as bt
from curaspark.operators import position as ps
from curaspark.operators.graph import components
from curaspark.operators.position import Positioned, with_position


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- votes


def test_majority_vote(spark):
    data = [(1, 0, "4"), (1, 1, " 4"), (1, 2, "n/a"), (1, 3, "5"), (2, 0, "None"), (3, 0, "7"), (3, 1, "8")]
    df = spark.createDataFrame(data, "q int, pos int, a string")
    got = {r["q"]: (r["answer"], r["score"], r["n_valid"]) for r in votes.majority_vote(df, ["q"], "a", ["pos"]).collect()}
    assert got == {1: ("4", pytest.approx(2 / 3), 3), 2: ("", 0.0, 0), 3: ("7", 0.5, 2)}
    offline = {r["q"]: r["score"] for r in votes.majority_vote(df, ["q"], "a", ["pos"], service_form=False).collect()}
    assert offline == {1: 0.5, 2: 1.0, 3: 0.5}


def test_solvability_and_difficulty(spark):
    items = spark.createDataFrame([(1, "4", 0.9), (2, "", 0.7), (3, "x", 0.3)], "q int, silver string, score double")
    rolls = spark.createDataFrame([(1, "4.0"), (1, None), (2, "4")], "q int, a string")
    got = {r["q"]: r["solvability"] for r in votes.solvability(rolls, items, ["q"], "a", "silver", "score").collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.3}
    code = {r["q"]: r["solvability"] for r in votes.solvability(rolls, items, ["q"], "a", "silver", "score", code_form=True).collect()}
    assert code == {1: 0.5, 2: 0.7, 3: 0.3}
    assert spark.range(1).select(votes.difficulty(F.lit(-1.0))).collect()[0][0] == -1.0


# ---------------------------------------------------------------- rewards


def test_proposer_reward(spark):
    proposals = spark.createDataFrame([(1, True, 0.1), (2, False, 0.0), (3, True, 0.0), (4, True, 0.0)], "proposal_id int, format_ok boolean, content_type_penalty double")
    samples = spark.createDataFrame([(1, i, i < 2) for i in range(4)] + [(3, 0, False)], "proposal_id int, sample_id int, is_rendered boolean")
    scores = spark.createDataFrame([(1, 0, 0.8, 0.1), (1, 1, 0.4, 0.1)], "proposal_id int, sample_id int, solvability double, difficulty double")
    got = {r["proposal_id"]: r for r in rewards.proposer_reward(proposals, samples, scores).collect()}
    assert got[1]["overall"] == pytest.approx((0.5 + 0.1 + 0.4 + 0.1) / 4 - 0.3 - 0.1)
    assert (got[1]["n_capped"], got[1]["num_rollouts"], got[1]["num_rendered"]) == (1, 4, 2)
    assert (got[2]["overall"], got[2]["format"]) == (-1.0, 0.0)
    assert (got[3]["overall"], got[3]["easy_hard_penalty"], got[4]["num_rollouts"]) == (0.0, 0.0, 1)


def test_codegen_reward(spark):
    data = [("<svg/>", True, 0.5, 0.25), ("", False, None, None), ("text", False, 0.0, 0.0), ("", True, 0.0, 0.0)]
    df = spark.createDataFrame(data, "code string, is_rendered boolean, solvability double, difficulty double")
    got = [r["overall"] for r in rewards.codegen_reward(df).collect()]
    assert got == pytest.approx([1.75, -0.5, -0.5, 0.45])


def test_content_type_penalty_needs_two_types(spark):
    one = spark.createDataFrame([(0, "map")] * 3, "step int, kind string")
    assert {r["content_type_penalty"] for r in rewards.content_type_penalty(one, ["step"], "kind").collect()} == {0.0}
    two = spark.createDataFrame([(0, "map")] * 3 + [(0, "table")], "step int, kind string")
    got = {r["kind"]: r["content_type_penalty"] for r in rewards.content_type_penalty(two, ["step"], "kind").collect()}
    assert got == {"map": pytest.approx(0.15 * 0.25 / 0.5), "table": 0.0}


# ---------------------------------------------------------------- advantages


def test_group_advantages(spark):
    data = [("a", 1, 0.1), ("a", 2, 0.5), ("a", 3, 0.9), ("b", 4, 1.0), ("b", 5, 1.0)]
    df = spark.createDataFrame(data, "uid string, rollout_id int, score double")
    grpo = {r["rollout_id"]: r["advantage"] for r in adv.advantage("grpo", df).collect()}
    std = statistics.stdev([0.1, 0.5, 0.9])
    assert grpo[3] == pytest.approx(0.4 / (std + 1e-6)) and sum(grpo[i] for i in (1, 2, 3)) == pytest.approx(0)
    rloo = {r["rollout_id"]: r["advantage"] for r in adv.advantage("rloo", df).collect()}
    assert rloo[1] == pytest.approx(0.1 - 0.7) and sum(rloo.values()) == pytest.approx(0)
    best = {r["rollout_id"]: r["advantage"] for r in adv.advantage("grpo_passk", df).collect()}
    assert best[3] == pytest.approx(0.4 / (std + 1e-6)) and best[1] == best[2] == best[4] == best[5] == 0.0
    with pytest.raises(Exception, match="more than one rollout"):
        adv.advantage("grpo", df.filter("rollout_id = 1")).collect()
    with pytest.raises(ValueError, match="unknown estimator"):
        adv.advantage("nope", df)


def test_hot_group_is_not_gathered(spark):
    """A third of all rows in one group: the plan aggregates before it shuffles and holds no window over the group."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("uid"), F.col("id").alias("rollout_id"), (F.col("id") % 7).cast("double").alias("score"))
    kept = adv.online_filter(df, ["uid"], "score", 2.0, 4.0)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_avg" in plan
    assert kept.filter("uid = 0").count() == 10000


def test_quota(spark):
    df = spark.createDataFrame([("a", 3), ("a", 9), ("b", 1), ("c", 5)], "uid string, at int")
    assert sorted(rows(adv.fill_quota(df, "uid", "at", 2))) == [("a", 3), ("a", 9), ("b", 1)]
    with pytest.raises(Exception, match="fewer than 4"):
        adv.fill_quota(df, "uid", "at", 4).collect()


# ---------------------------------------------------------------- positions and batches


@pytest.fixture(scope="module")
def container(spark):
    df = spark.createDataFrame([(i + 1, c) for i, c in enumerate("abcdef")], "obs int, labels string")
    return with_position(df, ["obs"])


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_positions(spark, ranges):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("hot"))
    # a leading column on which a third of the rows agree
    placed = with_position(df.repartition(5), ["hot", "k"], ranges=ranges)
    got = [r["pos"] for r in placed.rows.orderBy("hot", "k").collect()]
    assert placed.n == 5000 and got == list(range(5000))


@pytest.mark.parametrize("ranges", [9, 60, 1000])
def test_positions_on_two_levels(spark, monkeypatch, ranges):
    """More ranges than the plan may hold bounds for, with nulls, texts and a hot leading column."""
    monkeypatch.setattr(ps, "LITERAL_RANGES", 4)
    rows = [(None if i % 5 == 0 else i % 2, f"k{i * 7919 % 4001}", i) for i in range(4001)]
    placed = with_position(spark.createDataFrame(rows, "hot int, k string, v int"), ["hot", "k"], ranges=ranges)
    want = [r[2] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [r["v"] for r in placed.rows.orderBy("pos").collect()] == want and placed.rows.columns == ["hot", "k", "v", "pos"]
    assert [r["pos"] for r in placed.rows.select("pos").orderBy("pos").collect()] == list(range(4001))


@pytest.mark.parametrize("k", [0, 1, 7, 1500, 2999, 3000, 9999])
def test_first_rows(spark, monkeypatch, k):
    monkeypatch.setattr(ps, "ROWS_PER_RANGE", 100)
    df = spark.range(3000).select((F.col("id") * 7 % 10).alias("a"), (F.col("id") * 7919 % 3000).alias("b"), F.lit("x").alias("c"))
    want = [(r["a"], r["b"]) for r in df.orderBy("a", "b").limit(k).collect()]
    assert sorted((r["a"], r["b"]) for r in ps.first_rows(df, ["a", "b"], k).collect()) == want


def test_half_of_all_groups_are_chosen_without_sorting_them(spark, monkeypatch):
    from curaspark.operators import advantages as adv

    monkeypatch.setattr(ps, "ROWS_PER_RANGE", 50)
    df = spark.range(4000).select((F.col("id") % 1000).alias("uid"), F.col("id").alias("at"))
    kept = adv.fill_quota(df, "uid", "at", 500)
    assert sorted({r["uid"] for r in kept.collect()}) == list(range(500)) and kept.count() == 2000
    assert "TakeOrdered" not in kept._jdf.queryExecution().executedPlan().toString()


def test_shards(spark):
    pos = F.col("id")
    for n, k in ((17, 8), (16, 8), (5, 8), (100, 7)):
        got = spark.range(n).select(ps.contiguous_shard(pos, n, k), ps.strided_shard(pos, k), ps.balanced_shard(pos, n, k)).collect()
        size = n // k + 1
        q, r = divmod(n, k)
        balanced = [i for i in range(k) for _ in range(q + (i < r))]
        assert [g[0] for g in got] == [i // size for i in range(n)]
        assert [g[1] for g in got] == [i % k for i in range(n)]
        assert [g[2] for g in got] == balanced


def labels(df):
    return [r["labels"] for r in df.orderBy("pos").collect()]


def test_container_select(spark, container):
    assert labels(bt.slice_rows(container, 1, 3)) == ["b", "c"]
    assert labels(bt.slice_rows(container, -2)) == ["e", "f"]
    picks = spark.createDataFrame([(3, 0), (4, 1), (2, 2), (0, 3), (1, 4), (5, 5)], "index bigint, order bigint")
    assert labels(bt.select_rows(container, picks)) == ["d", "e", "c", "a", "b", "f"]
    popped, rest = bt.pop_columns(container.rows, ["obs", "unknown"])
    assert popped.columns == ["obs"] and rest.columns == ["labels", "pos"]
    assert bt.rename_columns(popped, ["obs"], ["o"]).columns == ["o"]
    with pytest.raises(ValueError):
        bt.rename_columns(popped, ["obs"], [])


def test_container_chunk_and_split(spark, container):
    assert [r["chunk"] for r in bt.chunk_rows(container, 2).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1]
    assert [r["chunk"] for r in bt.split_rows(container, 2).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        bt.chunk_rows(container, 4)
    chunked = bt.chunk_rows(container, 3)
    joined = bt.concat_rows([chunked.filter(F.col("chunk") == i).drop("chunk") for i in range(3)])
    assert labels(joined) == list("abcdef")


def test_container_repeat(spark):
    two = with_position(spark.createDataFrame([(1, "a"), (2, "b")], "obs int, labels string"), ["obs"])
    assert [r["obs"] for r in bt.repeat_rows(two, 2, True).rows.orderBy("pos").collect()] == [1, 1, 2, 2]
    assert [r["obs"] for r in bt.repeat_rows(two, 2, False).rows.orderBy("pos").collect()] == [1, 2, 1, 2]


def test_container_pad(spark):
    three = with_position(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "obs int, labels string"), ["obs"])
    padded, size = bt.pad_rows(three, 2)
    assert (labels(padded.rows), size, padded.n) == (["a", "b", "c", "a"], 1, 4)
    assert labels(bt.unpad_rows(padded.rows)) == ["a", "b", "c"]
    assert bt.pad_rows(three, 3)[1] == 0
    around, size = bt.pad_rows(three, 8)
    assert (labels(around.rows), size) == (list("abcabcab"), 5)


def test_container_fold_and_union(spark, container):
    folded = bt.fold_rows(container, 2, ["obs", "labels"]).orderBy("pos").collect()
    assert [r["labels"] for r in folded] == [["a", "b", "c"], ["d", "e", "f"]]
    left = spark.createDataFrame([(1, "a", 5)], "id int, x string, y int")
    right = spark.createDataFrame([(1, "a", 7)], "id int, x string, z int")
    assert rows(bt.union_columns(left, right, ["id"]).select("id", "x", "y", "z")) == [(1, "a", 5, 7)]
    with pytest.raises(Exception, match="column x differs"):
        bt.union_columns(left, right.withColumn("x", F.lit("b")), ["id"]).collect()
    with pytest.raises(Exception, match="different rows"):
        bt.union_columns(left, right.withColumn("id", F.lit(2)), ["id"]).collect()


def test_plan_and_clamp(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    plan = bt.plan_batches(df, ["k"], 10, epochs=2, seed=3)
    counts = {(r["epoch"], r["batch"]): r["count"] for r in plan.groupBy("epoch", "batch").count().collect()}
    assert counts == {(e, b): 10 for e in range(2) for b in range(10)}
    assert bt.plan_batches(df, ["k"], 10, drop_last=False).count() == 103
    orders = [[r["k"] for r in plan.filter(F.col("epoch") == e).orderBy("batch", "slot").collect()] for e in range(2)]
    assert orders[0] != orders[1] and orders[0] != sorted(orders[0])
    assert [bt.clamp_batch_size(n, 512) for n in (600, 512, 511, 100, 31, 5)] == [512, 512, 256, 64, 16, 16]


def test_batches_are_planned_from_written_positions(spark, monkeypatch):
    """Positions count nulls first and rows that come twice, over many ranges, and no row is compared with literal bounds."""
    from curaspark.operators import position

    keys = [*range(500), *range(100), None, None]
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(7)
    monkeypatch.setattr(position, "ROWS_PER_RANGE", 50)
    monkeypatch.setattr(position, "_range_of", None)
    placed = position.written_positions(df, ["k"])
    got = sorted((r["pos"], r["k"]) for r in placed.rows.collect())
    assert placed.n == len(keys)
    assert got == list(enumerate(sorted(keys, key=lambda k: (k is not None, k))))
    plan = bt.plan_batches(df, ["k"], 100, epochs=2, seed=3)
    assert {(r["epoch"], r["batch"]): r["count"] for r in plan.groupBy("epoch", "batch").count().collect()} == {(e, b): 100 for e in range(2) for b in range(6)}
    assert bt.plan_batches(df.limit(0), ["k"], 10).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_level_balance(spark, seed):
    """Equal counts; sums differ by at most the longest length, and on heavy tails by less than dealing in turns leaves."""
    import random

    rng = random.Random(seed)
    sizes = [int(rng.paretovariate(0.8)) if seed else rng.randint(1, 5) for _ in range(1003)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, length bigint")
    by_worker = {}
    for r in bt.balance_level(df, ["id"], "length", 7).collect():
        by_worker.setdefault(r["worker"], []).append(r["length"] or 0)
    dealt = {}
    for r in bt.balance(df.fillna(0), ["id"], "length", 7).collect():
        dealt.setdefault(r["worker"], []).append(r["length"])
    counts, sums = [len(v) for v in by_worker.values()], [sum(v) for v in by_worker.values()]
    assert sorted(by_worker) == list(range(7)) and max(counts) - min(counts) <= 1 and sum(counts) == 1004
    longest = max(s or 0 for s in sizes)
    assert max(sums) - min(sums) <= longest
    # plain version: all rounds one after the other
    order = sorted(range(1004), key=lambda i: (-(sizes[i] or 0), i))
    want = [0] * 7
    for at in range(0, 1004, 7):
        turn = [sizes[i] or 0 for i in order[at : at + 7]]
        for w, x in zip(sorted(range(7), key=lambda w: (want[w], w)) if turn[0] != turn[-1] or len(turn) < 7 else range(7), turn):
            want[w] += x
    assert [sum(by_worker[w]) for w in range(7)] == want
    assert max(sums) - min(sums) <= max(map(sum, dealt.values())) - min(map(sum, dealt.values())) or not seed


def test_balance_and_micro_batches(spark):
    lengths = [(i, 50 + (i * 37) % 41) for i in range(40)]
    df = spark.createDataFrame(lengths, "id int, length int")
    balanced = bt.balance(df, ["id"], "length", 8)
    sums = balanced.groupBy("worker").agg(F.count("id").alias("n"), F.sum("length").alias("s")).collect()
    assert {r["n"] for r in sums} == {5} and max(r["s"] for r in sums) - min(r["s"] for r in sums) <= 41
    placed = with_position(df, ["id"])
    report = bt.balance_report(Positioned(bt.balance(placed.rows, ["id"], "length", 8), placed.n), "length", 8).collect()[0]
    assert report["balanced_max"] - report["balanced_min"] <= report["minmax_diff"]
    micro = bt.micro_batches(placed.rows, ["id"], "length", 300)
    total = sum(n for _, n in lengths)
    assert micro.select("micro_batch").distinct().count() == math.ceil(total / 300)
    loads = [r["workload"] for r in micro.select("micro_batch", "workload").distinct().orderBy("micro_batch").collect()]
    assert loads == sorted(loads, reverse=True)
    assert [(r["id"], r["length"]) for r in micro.orderBy("pos").collect()] == lengths


# ---------------------------------------------------------------- runs, evaluation, metrics


def test_retention(spark):
    steps = spark.createDataFrame([("r", s) for s in (5, 10, 15, 20, 25, 30)], "run string, step bigint")
    now = spark.createDataFrame([("r", 30, 10)], "run string, current_step bigint, best_step bigint")
    assert sorted(rows(runs.obsolete_steps(steps, now, 3))) == [("r", 5), ("r", 15), ("r", 20)]
    assert runs.obsolete_steps(steps, now, 0).count() == 0
    assert sorted(r[1] for r in rows(runs.obsolete_steps(steps, now, 1))) == [5, 15, 20, 25]
    tracker = spark.createDataFrame([("r", 30), ("x", 7)], "run string, last_step bigint")
    assert dict(rows(runs.latest_completed(tracker, steps))) == {"r": 30, "x": None}
    assert rows(runs.next_step(steps)) == [("r", 31)]


def test_evaluation(spark):
    data = [("base", "mmmu_pro_1", 40.0, 4, 10), ("base", "mmmu_pro_2", 60.0, 6, 10), ("base", "chart", 50.0, 5, 10), ("m", "chart", 50.005, 5, 10), ("m", "doc", 10.0, 1, 10)]
    summary = spark.createDataFrame(data, "model string, dataset string, accuracy double, correct bigint, total bigint")
    micro = {r["model"]: (r["micro"], r["macro"]) for r in evaluate.micro_macro(summary).collect()}
    assert micro["base"] == (50.0, pytest.approx((50 + 50) / 3)) and micro["m"] == (30.0, pytest.approx((50.005 + 10) / 3))
    v = evaluate.verdicts(evaluate.fold_family(summary)).collect()[0]
    assert (v["improving"], v["decreasing"], v["same"]) == (0, 0, 1)
    assert (v["better_all"], v["worse_all"], v["verdict"]) == (1, 1, "MIXED/SAME")
    order = spark.createDataFrame([("solver_v2_step5",), ("base",), ("solver_v1_step20",), ("odd",), ("solver_v1_step5",)], "model string")
    assert [r[0] for r in order.orderBy(*evaluate.label_order(F.col("model"))).collect()] == ["base", "solver_v1_step5", "solver_v1_step20", "solver_v2_step5", "odd"]


def test_two_accuracy_denominators(spark):
    df = spark.createDataFrame([("m", "d", r"\boxed{1}", "1"), ("m", "d", "none", "1")], "model string, dataset string, model_response string, ground_truth string")
    r = evaluate.accuracy(df).collect()[0]
    assert (r["accuracy"], r["answered_accuracy"], r["total"], r["answered"]) == (50.0, 100.0, 2, 1)


def test_bands_keep_their_edges(spark):
    img = "x" * 300
    data = [("q", "1", 0.5, 0.25, 0.5, img), ("q", "1", 0.5, 0.75, 0.5, img), ("q", "1", 0.5, 0.76, 0.5, img), ("q", "1", 0.5, 0.2, 0.4, img), ("q", "None", 0.5, 0.5, 0.5, img)]
    df = spark.createDataFrame(data, "question string, answer string, score double, hard_consistency double, easy_consistency double, image string")
    assert [r["reject_reason"] for r in assemble.solver_candidates(df).collect()] == [None, None, "hard_high", "easy_low", "unusable"]


def test_entropy_and_histogram(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "k string, c string")
    assert dict(rows(coevolution.normalized_entropy(df, ["k"], "c"))) == {"a": pytest.approx(1.0), "b": 0.0}
    values = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 5, 10)], "v double")
    got = [r["n"] for r in assemble.histogram(values, "v", 10).orderBy("bin").collect()]
    assert got == [2, 1, 0, 0, 0, 1, 0, 0, 0, 1]
    flat = assemble.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in flat] == [0, 0, 4, 0] and flat[0]["low"] == 2.5


def test_metric_logs_round_trip(spark):
    long = spark.createDataFrame([(1, "a/b/c", 0.5), (1, "a/d", 2.0), (1, "e", 1.5)], "step int, metric string, value double")
    logs = metrics.nest_metrics(long, ["step"])
    assert rows(logs) == [(1, '{"a":{"b":{"c":0.5},"d":2.0},"e":1.5}')]
    assert sorted(rows(metrics.flatten_metrics(logs, ["step"]))) == sorted(rows(long))


def test_kl_controller(spark):
    steps = spark.createDataFrame([(1, 0.2, 100), (2, 0.05, 100)], "step int, kl double, n_rows bigint")
    got = [(r["coef"], r["coef_after"]) for r in metrics.kl_controller(steps, 0.1, 0.1, 1000.0).orderBy("step").collect()]
    assert got[0] == pytest.approx((0.1, 0.1 * 1.02)) and got[1] == pytest.approx((0.102, 0.102 * 0.98))
    fixed = metrics.kl_controller(steps, 0.1, 0.1, 1000.0, adaptive=False).collect()
    assert {r["coef_after"] for r in fixed} == {0.1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 99)] + [(200, k) for k in range(201, 240)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(rows(components(df)))
    assert {got[i] for i in range(61)} == {0} and got[101] == got[100] == 99 and {got[i] for i in range(200, 240)} == {200}


# ---------------------------------------------------------------- user rewards


def test_registry_kinds(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab", "ab", "q1"), (2, "abc", "x", "q2")], "id int, response string, ground_truth string, raw_prompt_text string")
    registry.register_reward("col", lambda c, w: F.struct((c["response_length"] * w).alias("overall"), F.lit(1.0).alias("m")), "column", w=2.0)
    assert [(r["reward"]["overall"], r["reward"]["metrics"]) for r in registry.score_rows(df, "col").orderBy("id").collect()] == [(4.0, {"m": 1.0}), (6.0, {"m": 1.0})]

    def one(reward_input):
        return {"overall": 1.0 if reward_input["response"] == reward_input["ground_truth"] else 0.0, "n": reward_input["response_length"]}

    registry.register_reward("one", one, "sequential")
    assert [r["reward"]["overall"] for r in registry.score_rows(df, "one").orderBy("id").collect()] == [1.0, 0.0]
    path = tmp_path / "mine.py"
    path.write_text("REWARD_NAME = 'mine'\ndef helper(q):\n    return len(q)\ndef compute_score(predicts, ground_truths, questions, scale=1):\n    return [{'overall': scale * helper(q), 'k': 2} for q in questions]\n")
    assert registry.load_reward(str(path), scale=3).kind == "legacy_batch"
    with pytest.raises(ValueError, match="whole batch"):
        registry.score_rows(df, "mine")
    got = registry.score_rows(df, "mine", batch=["ground_truth"]).orderBy("id").collect()
    assert [r["reward"]["overall"] for r in got] == [6.0, 6.0] and got[0]["reward"]["metrics"] == {"k": 2.0}
    registry.register_reward("bad", lambda reward_inputs: [{"x": 1} for _ in reward_inputs])
    with pytest.raises(Exception, match="without overall"):
        registry.score_rows(df, "bad", batch=["id"]).collect()


def test_batches_are_told_apart_whatever_their_names(spark):
    """Null, empty and odd batch names, a column of a nested type that passes through, and names with dots."""
    rows = [(i, *b, [i, None], "r" * i, "") for i, b in enumerate([(None, "a"), ("", "a"), (None, None), ("a", None), ("a", "a"), (None, "a"), ("\x1f", ""), ("a.b", "")])]
    df = spark.createDataFrame(rows, "id int, `x.y` string, z string, kept array<int>, response string, ground_truth string")
    registry.register_reward("size", lambda reward_inputs: [{"overall": len(reward_inputs), "first": reward_inputs[0]["response_length"]} for _ in reward_inputs], "batch")
    got = {r["id"]: (r["reward"]["overall"], r["reward"]["metrics"]["first"], r["kept"]) for r in registry.score_rows(df, "size", batch=["x.y", "z"], order=["id"]).collect()}
    assert got == {i: (2.0 if i in (0, 5) else 1.0, 0.0 if i == 5 else float(i), [i, None]) for i in range(8)}
    assert registry.score_rows(df.limit(0), "size", batch=["z"]).count() == 0


def test_batch_rewards_see_their_whole_batch(spark):
    """However rows are sliced on their way to Python, a batch is scored at once and in order."""
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("step"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("response"), F.lit("").alias("ground_truth"))
    registry.register_reward("place", lambda reward_inputs: [{"overall": i, "of": len(reward_inputs)} for i in range(len(reward_inputs))], "batch")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = registry.score_rows(df.repartition(5), "place", batch=["step"], order=["id"]).collect()
        small = registry.score_rows(df, "place", batch=["response"], order=["id"]).orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert registry.score_rows(df, "place", batch=["response"], order=["id"]).orderBy("id").collect() == small
    assert all(r["reward"]["overall"] == r["id"] // 3 and r["reward"]["metrics"]["of"] == (334 if r["step"] == 0 else 333) for r in got) and len(got) == 1000


def test_list_rewards_get_what_they_ask_for(spark):
    """Lists with nulls and empty ones arrive as they are, missing inputs have their stand-ins, and no column travels twice."""
    rows = [(i, i // 2, f"r{i}", "t", *x) for i, x in enumerate([(["a", None], [["x"], None, []]), (None, None), ([], []), (["b"], [["y", None]]), (["c"], None)])]
    df = spark.createDataFrame(rows, "id int, step int, response string, ground_truth string, description_answers array<string>, images array<array<string>>")

    def told(predicts, ground_truths, questions, description_answers, images, base=0):
        return [{"overall": base, repr((p, t, q, a, x)): 1} for p, t, q, a, x in zip(predicts, ground_truths, questions, description_answers, images)]

    registry.register_reward("told", told, base=3)
    scored = registry.score_rows(df, "told", batch=["step"], order=["id"])
    got = {r["id"]: (r["reward"]["overall"], r["reward"]["metrics"]) for r in scored.collect()}
    assert got == {i: (3.0, {repr((r, t, "", a, x)): 1.0}) for i, _, r, t, a, x in rows}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "__in_images" in plan and not any(f"__in_{x}" in plan for x in ("response", "ground_truth", "description_answers"))


def test_votes_are_taken_on_rollouts_of_scored_proposals_only(spark):
    """Rollouts of proposals that are not scored leave before the votes are counted; null keys stay."""
    proposals = spark.createDataFrame([(1, "4"), (None, "2")], "proposal_id bigint, easy_answer string")
    samples = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True), (None, 1, True)], "proposal_id bigint, sample_id int, is_rendered boolean")
    rollouts = [(p, 1, a, i) for p in (1, 2, None) for i, a in enumerate(["4", "4", "2", "4"])]
    rollouts = spark.createDataFrame(rollouts, "proposal_id bigint, sample_id int, answer string, n int")
    scores = rewards.sample_scores(proposals, samples, rollouts, rollouts, ["n"])
    got = {r["proposal_id"]: (r["solvability"], r["difficulty"]) for r in scores.collect()}
    assert got == {1: (0.75, 0.25), None: (0.25, 0.25)}
    assert "LeftSemi" in scores._jdf.queryExecution().optimizedPlan().toString()
