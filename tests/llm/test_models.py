"""SimHash groups, toxicity and language-model scores against brute force, held-out rows and messy tables."""

import math
import os
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import LONG, MESSY
from pyspark.sql import functions as F

from curaspark.llm import lm, simhash, toxicity
from curaspark.llm.queries import op4_toxicity, op6_lm_score, remainder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- simhash


def brute_fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint); smallest identifier reachable, by flooding."""
    left, out = set(range(len(prints))), {}
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            seen.add(i)
            near = {j for j in left if (prints[i][1] ^ prints[j][1]).bit_count() <= 3}
            left -= near
            todo += near
        ids = [prints[i][0] for i in seen if prints[i][0] is not None]
        out |= {i: min(ids, default=None) for i in seen}
    return sorted(((prints[i][0], prints[i][1], c) for i, c in out.items()), key=str)


@pytest.mark.parametrize("text", ["", " \n", "One", "one two", "a b c", "A b C d É é", LONG, "x y " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_groups(spark, messy, documents, nothing):
    for df in (messy, documents):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted([(r["doc_id"], r["fp"] % 2**64, r["component"]) for r in simhash.near_groups(df).collect()], key=str)
        assert got == brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    assert simhash.near_groups(nothing).count() == 0


def near_copies(r, n, centres, flips):
    base = r.integers(0, 2**63, centres, dtype=np.uint64) * np.uint64(2)
    out = base[r.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64))
    return np.unique(out)


def all_links(points):
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3, 1))
    return points[a], points[b]


@pytest.mark.parametrize("centres, flips", [(2000, 3), (3, 2), (1, 4), (50, 8), (1500, 0)])
def test_links_connect_what_is_near(spark, centres, flips):
    """In one shard, and dealt to many; clusters that share a half, and clusters around few centres."""
    points = near_copies(np.random.default_rng(centres), 3000, centres, flips)
    wanted = simhash.forest(*all_links(points))
    found = [simhash.search(points, points, half, 3) for half in (0, 1)]
    assert all(map(np.array_equal, simhash.forest(*map(np.concatenate, zip(*found))), wanted))
    nodes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    for shard in (100, 100_000):
        got = simhash.near_links(nodes, shard=shard).toPandas()
        assert all((np.bitwise_count((got["a"] ^ got["b"]).to_numpy().view(np.uint64)) >= 0))
        links = simhash.forest(got["a"].to_numpy().view(np.uint64), got["b"].to_numpy().view(np.uint64)) if len(got) else wanted
        assert all(map(np.array_equal, links, wanted))


def test_links_of_split_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "QUERIES_PER_TASK", 300)
    points = near_copies(np.random.default_rng(5), 2000, 400, 3)
    nodes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    got = simhash.near_links(nodes, shard=500).toPandas()
    links = simhash.forest(got["a"].to_numpy().view(np.uint64), got["b"].to_numpy().view(np.uint64))
    assert all(map(np.array_equal, links, simhash.forest(*all_links(points))))


def test_drop_near_copies(messy, documents, nothing):
    for df in (messy, documents):
        groups = simhash.near_groups(df).collect()
        got = simhash.drop_near_copies(df)
        assert got.columns == df.columns
        kept = [(r["doc_id"], brute_fingerprint(r["text"])) for r in got.select("doc_id", "text").collect()]
        component = {(r["doc_id"], r["fp"] % 2**64): r["component"] for r in groups}
        assert sorted((component[k] for k in kept), key=str) == sorted({r["component"] for r in groups} if df is documents else [component[k] for k in kept], key=str)
        assert len(kept) == len(set(kept))
        assert all(component[k] == k[0] for k in kept)
    # two components of the messy table are named 9, by two rows with this identifier
    assert len([k for k in kept]) and simhash.drop_near_copies(messy).filter("doc_id = 9").count() == 2
    assert simhash.drop_near_copies(nothing).count() == 0


# ---------------------------------------------------------------- toxicity


@pytest.fixture(scope="module")
def classifier(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.learned(docs, labels, training=remainder(5) != 0)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op4_toxicity(spark, SF)
    assert rows.count() == 1000
    held = rows.join(labels, "doc_id").filter("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in held)
    right = sum(r["predicted"] == r["toxic"] for r in held)
    assert right >= 0.93 * len(held)


def test_scores_do_not_read_other_columns(spark, classifier):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 200")
    mixed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, toxicity.scored(docs, classifier).collect())) == sorted(map(tuple, toxicity.scored(mixed, classifier).collect()))


def test_stretches_give_the_same_score(classifier, monkeypatch):
    texts = [LONG[:20_000], "", None, "stupid", "a b", "idiot " + "the " * 3000, "the " * 3000 + "idiot clown"]
    whole = toxicity.distances(classifier, texts, toxicity.Vectors(classifier))
    one = np.concatenate([toxicity.distances(classifier, [t], toxicity.Vectors(classifier)) for t in texts])
    monkeypatch.setattr(toxicity, "STRETCH", 100)
    assert np.allclose(toxicity.distances(classifier, texts, toxicity.Vectors(classifier)), whole, atol=1e-4) and np.allclose(whole, one, atol=1e-4)


def test_convolution_equals_loops(classifier):
    words = "the idiot and the clown of the house".split()
    features = np.array([toxicity.buckets(w) for w in words])
    x = [classifier.embedding[f].sum(0) for f in features] + [np.zeros(toxicity.DIM)] * 2
    want = []
    for k, w in enumerate(classifier.filters):
        responses = [sum(x[t + j] @ w[j] for j in range(len(w))) + classifier.biases[k] for t in range(len(words))]
        want += list(np.max(responses, axis=0))
    known = toxicity.Vectors(classifier)
    got = toxicity.pool(classifier, [known.ids(words)], known.look_up)[0]
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity_of_messy_tables(spark, messy, nothing, classifier):
    scores = toxicity.scored(messy, classifier).collect()
    assert len(scores) == len(MESSY) and all(0 <= r["score"] <= 1 for r in scores)
    kept = toxicity.clean(messy, classifier)
    assert kept.columns == messy.columns and kept.count() == sum(r["score"] < 0.5 for r in scores)
    assert toxicity.scored(nothing, classifier).count() == 0 and toxicity.clean(nothing, classifier).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 0), (6, 0)], "doc_id bigint, toxic int")
    assert toxicity.learned(messy, labels) is None  # one kind of label only
    assert {r["score"] for r in toxicity.scored(messy, None).collect()} == {0.0}
    assert toxicity.learned(messy, spark.createDataFrame([(1, 0), (7, 1), (8, 1)], labels.schema)) is not None


def test_features_are_held_while_they_are_needed(classifier):
    """Features become vectors when first looked up and are not kept beside them; those of a text are packed without a list."""
    found = [f"word{i}" for i in range(25_000)]
    known = toxicity.Vectors(classifier)
    got = known.look_up(known.ids(found))
    assert not known.new and len(known.table) == 1 + len(found)
    assert np.array_equal(got, classifier.vectors(np.array([toxicity.buckets(w) for w in found])))
    tracemalloc.start()
    packed = toxicity._packed_features(found * 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.frombuffer(packed, np.uint16).reshape(-1, 3)[: len(found)], [toxicity.buckets(w) for w in found])
    assert peak < 3 * len(packed) + 8 * len(found) * 8 and toxicity._packed_features([]) == b""


@pytest.mark.parametrize("long", [1, 20])
def test_long_texts_do_not_end_the_training_sample(spark, monkeypatch, long):
    """The first labelled texts of each kind by hash, or all of them, are longer than what is read of a kind."""
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 200)
    ids = spark.range(40).select("id", F.xxhash64(F.lit(0), F.col("id").cast("string")).alias("o")).orderBy("o").collect()
    seen, rows = Counter(), []
    for i in [r["id"] for r in ids]:
        seen[i % 2] += 1
        rows.append((i, ("idiot " if i % 2 else "friend ") * (300 if seen[i % 2] <= long else 4)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.learned(docs, labels)
    assert model is not None
    toxic, clean = toxicity.distances(model, ["idiot", "friend"], toxicity.Vectors(model))
    assert toxic > clean


# ---------------------------------------------------------------- language model


def brute_base(rows):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)."""
    train = [WORD.findall(lowered(t)) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for ws in train for w in ws)
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for i, t in rows:
        words = WORD.findall(lowered(t))
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        out.append((i, len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), n, score))
    return sorted(out, key=lambda x: (str(x[0]), x[1:]))


@pytest.fixture
def quick(monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_IDS", 20_000)
    monkeypatch.setattr(lm, "EPOCHS", 1)
    monkeypatch.setattr(lm, "MOST_EPOCHS", 1)


@pytest.mark.parametrize("common", [0, 40, 200_000])
def test_base_scores(spark, messy, documents, quick, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm.common_words, "__defaults__", (common,))
    for df in (messy, documents):
        got = lm.lm_scores(df, PATH, training=remainder(7) != 2).collect()
        rows = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=lambda x: (str(x[0]), x[1:]))
        want = brute_base([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        assert [r[:4] for r in rows] == [w[:4] for w in want]
        assert np.allclose([r[4] for r in rows], [w[4] for w in want])
        assert all(r["score"] < 0 for r in got)


def test_scores_use_the_shares_of_rare_words(spark, documents, quick, monkeypatch):
    got = []
    for common in (0, 200_000):
        monkeypatch.setattr(lm.common_words, "__defaults__", (common,))
        got.append(sorted((r["doc_id"], r["score"]) for r in lm.lm_scores(documents, PATH, training=remainder(7) != 2).collect()))
    assert np.allclose(*got)


def test_a_long_text_does_not_end_the_sample(spark, quick, monkeypatch):
    sizes = []
    monkeypatch.setattr(lm, "train", lambda texts, *a, **b: sizes.extend(map(len, texts)) or lm.new_weights())
    lm.lm_scores(spark.createDataFrame([(i, "some words " * 15_000) for i in range(8)], "doc_id bigint, text string"), PATH, training=F.lit(True))
    assert len(sizes) == 7 and min(sizes) > 0


def test_every_training_text_is_learnt_from(spark, quick, monkeypatch):
    """The sample is a start: passes and the mixture together see each training row once, however few the sample has."""
    seen = []

    def noted(result):
        return lambda rows, model, *a: seen.append([r["doc_id"] for r in rows.select("doc_id").collect()]) or (result or model)

    monkeypatch.setattr(lm, "TRAIN_TEXTS", 3)
    monkeypatch.setattr(lm, "taught", noted(None))
    monkeypatch.setattr(lm, "whole_mixture_weight", noted(0.5))
    df = spark.range(90).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id", F.lit(" and more")).alias("text"))
    lm.lm_scores(df.unionByName(df.filter("doc_id < 9")), PATH, training=F.col("doc_id") % 3 != 0)
    assert len(seen) == lm.PASSES + 1 and all(seen)
    assert sorted(i for some in seen for i in some) == sorted(i for i in [*range(90), *range(9)] if i % 3)


def test_lessons_have_every_id_once():
    weights, places = small_model()
    texts = [np.random.default_rng(n).integers(0, 3000, n) for n in (1, lm.WINDOW, lm.WINDOW + 1, lm.WINDOW * lm.STEP + 5, 7)]
    got = list(lm.lessons(texts, places, 7))
    assert np.array_equal(np.concatenate([ids[inside] for _, ids, inside in got]), np.concatenate(texts))
    before = np.concatenate([np.concatenate(([7], t[:-1])) for t in texts])
    assert np.array_equal(np.concatenate([rows[inside] for rows, _, inside in got]), places.row[before])
    assert max(len(rows) for rows, _, _ in got) < 2 * lm.STEP and not list(lm.lessons([], places, 7))


@pytest.fixture(scope="module")
def wide_places():
    return lm.id_places(np.arange(50257), np.arange(50257) % 2 == 0, 50256)


def test_a_pass_averages_what_the_tasks_learn(spark, wide_places):
    weights = lm.new_weights(3)
    df = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}" for j in range(40 * i))) for i in range(9)], "i int, text string").repartitionByRange(3, "i")
    kept = [(r["p"], r["text"]) for r in df.select(F.spark_partition_id().alias("p"), "text").collect()]
    ended = []
    for task in sorted({p for p, _ in kept}):
        w = {k: v.copy() for k, v in weights.items()}
        steps, n = lm._Steps(w), 0
        ids = [lm.text_ids(lm.lower_words(t), lm.word_ids(PATH), 50256)[0] for p, t in kept if p == task]
        for rows, target, inside in lm.lessons(ids, wide_places, 50256):
            steps.take(lm.gradients(w, rows, wide_places.group[target], wide_places.slot[target], inside)[1], 0.01 * min(1.0, (steps.taken + 1) / lm.WARM))
            n += len(rows)
        ended.append((n, w))
    got = lm.taught(df, weights, wide_places, PATH, 50256, "text", 0.01)
    assert len(ended) > 1 and got.keys() == weights.keys()
    for k in weights:
        want = sum(n * w[k].astype(float) for n, w in ended) / sum(n for n, _ in ended)
        assert got[k].shape == weights[k].shape and np.allclose(got[k], want, atol=1e-3) and not np.allclose(got[k], weights[k], atol=1e-6)
    assert lm.taught(df.limit(0), weights, wide_places, PATH, 50256, "text", 0.01) is weights


@pytest.mark.parametrize("common", [0, 3, 1000])
def test_the_mixture_is_set_by_all_words(spark, wide_places, common):
    """As from the log ratios of all words themselves, whether their counts are sent or joined."""
    texts = [" ".join(f"w{min(i, i * j % 19)}" for j in range(60)) for i in range(1, 40)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = lm.cut_lineage(lm.word_counts(df))
    sent = {r["word"].encode(): r["n"] for r in lm.common_words(counts, common)[0].collect()}
    tokens = sum(r["n"] for r in counts.collect()) + len(texts)
    model = lm.Fitted(lm.ready(lm.new_weights(1)), wide_places, PATH, 50256, sent, tokens, 0.0)
    held = [(ws := lm.lower_words(t), *lm.text_ids(ws, lm.word_ids(PATH), 50256)) for t in texts]
    want = lm._sample_mixture_weight(held, model, counts, len(texts))
    assert abs(lm.whole_mixture_weight(df, model, counts, len(texts), "text") - want) < 1e-3
    assert lm.whole_mixture_weight(df.limit(0), model, counts, len(texts), "text") is None


def test_without_training_texts(spark, nothing, messy, quick):
    assert lm.lm_scores(nothing, PATH, training=remainder(7) != 2).count() == 0
    got = lm.lm_scores(messy, PATH, training=F.lit(False)).collect()
    assert len(got) == len(MESSY) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)


def small_model(seed=0):
    counts = np.random.default_rng(seed).integers(0, 50, 3000)
    begins = np.arange(3000) % 2 == 0
    places = lm.id_places(counts, begins, 7)
    return lm.ready(lm.new_weights(seed)), places


def test_probabilities_sum_to_one():
    weights, places = small_model()
    cells = np.bincount(places.group * lm.SLOTS + places.slot, np.exp(places.share), lm.GROUPS * lm.SLOTS)
    used = cells > 0
    assert np.allclose(cells[used], 1)
    rows = places.row[np.random.default_rng(1).integers(0, 3000, (2, lm.WINDOW))]
    h = lm.forward(weights, rows)[:, -1]
    total = 0.0
    for g in range(lm.GROUPS):
        for s in range(lm.SLOTS):
            total = total + np.exp(lm.id_log_probability(weights, h, np.full(2, g), np.full(2, s)))
    assert np.allclose(total, 1, atol=1e-5)


def test_each_id_is_scored_once_with_its_context():
    weights, places = small_model()
    r = np.random.default_rng(2)
    for n in (1, 2, lm.WINDOW - 1, lm.WINDOW, lm.WINDOW + 1, lm.WINDOW + lm.STRIDE, 500):
        ids = r.integers(0, 3000, n)
        _, target, scored = lm.windows(ids, places, 7)
        assert target[scored].tolist() == ids.tolist()
        got = lm.id_scores(weights, places, [ids], 7)[0]
        before = np.concatenate(([7], ids[:-1]))
        for at in {0, n // 2, n - 1}:
            window = 0 if at < lm.WINDOW else -(-(at + 1 - lm.WINDOW) // lm.STRIDE)
            context = before[window * lm.STRIDE : at + 1]
            rows = np.zeros((1, lm.WINDOW), int)
            rows[0, : len(context)] = places.row[context]
            h = lm.forward(weights, rows)[:, len(context) - 1]  # the plain form, which training uses
            one = lm.id_log_probability(weights, h, places.group[ids[[at]]], places.slot[ids[[at]]]) + places.share[ids[at]]
            assert np.allclose(got[at], one[0], atol=1e-4)


def test_every_id_of_a_long_text_has_sixteen_ids_of_context():
    weights, places = small_model()
    ids = np.random.default_rng(5).integers(0, 3000, 400)
    at = np.arange(150, 150 + 3 * lm.STRIDE)
    changed = np.repeat(ids[None, :], len(at), axis=0)
    far = ids[at - 16]
    changed[np.arange(len(at)), at - 16] = np.where(far == 11, 12, 11)
    plain, *others = lm.id_scores(weights, places, [ids, *changed], 7)
    assert all(t[i] != plain[i] for t, i in zip(others, at))
    assert lm.GROUPS * lm.SLOTS >= 768


def test_long_texts_are_scored_in_stretches():
    weights, places = small_model()
    ids = np.random.default_rng(3).integers(0, 3000, lm.STRIDE * 4096 + 777)
    got = lm.id_scores(weights, places, [ids], 7)[0]
    tail = lm.STRIDE * 4090
    near = lm.id_scores(weights, places, [ids[tail:]], int(ids[tail - 1]))[0]
    skip = lm.WINDOW  # the first window of the part has less context
    assert np.allclose(got[tail + skip :], near[skip:], atol=1e-4)


def test_gradients():
    weights, places = small_model()
    weights = {k: v.astype(np.float64) for k, v in weights.items() if k not in ("kv", "scaled_q", "bias")}
    r = np.random.default_rng(4)
    weights["near"] = r.normal(0, 0.1, lm.WINDOW)
    ids = r.integers(0, 3000, 90)
    rows, target, scored = lm.windows(ids, places, 7)
    group, slot = places.group[target], places.slot[target]
    _, g = lm.gradients(weights, rows, group, slot, scored)
    for name in weights:
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        moved = []
        for step in (1e-4, -1e-4):
            weights[name][at] += step
            moved.append(lm.gradients(weights, rows, group, slot, scored)[0])
            weights[name][at] -= step
        assert np.isclose((moved[0] - moved[1]) / 2e-4, g[name][at], rtol=0.02, atol=1e-6), name


def test_model_beats_word_counts_on_held_out_texts(spark):
    rows = op6_lm_score(spark, SF).filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


_FAULTS = """
import resource
import numpy as np
from curaspark.llm import lm
places = lm.id_places(np.arange(3000), np.arange(3000) % 2 == 0, 7)
texts = [np.random.default_rng(n).integers(0, 3000, lm.WINDOW * lm.STEP) for n in range(4)]
faults = []
for epochs in (1, 3):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    lm.train(texts, places, 7, epochs, batch=lm.STEP)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
steps = -(-sum(len(lm.windows(t, places, 7)[0]) for t in texts) // lm.STEP)
print(faults[1] / (3 * steps))
"""


def test_steps_do_not_fetch_their_memory_anew():
    """Pages that a step of learning takes from the system, once the process is warm: a step holds some thousand."""
    got = subprocess.run([sys.executable, "-c", _FAULTS], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True, timeout=300)
    assert float(got.stdout) < 500


def test_gradients_equal_finite_differences_with_holes_and_far_places():
    """Blocks of places give what the whole square of a window gives, also where places in the middle are left out."""
    weights, _ = small_model(2)
    weights = {k: v.astype(np.float64) for k, v in weights.items() if k not in ("kv", "scaled_q", "bias")}
    r = np.random.default_rng(6)
    weights["near"] = r.normal(0, 0.5, lm.WINDOW)
    weights["o"] = weights["o"] * 5
    rows = r.integers(0, lm.ROWS, (5, lm.WINDOW))
    group, slot, mask = r.integers(0, lm.GROUPS, rows.shape), r.integers(0, lm.SLOTS, rows.shape), r.random(rows.shape) < 0.7

    def loss() -> float:
        x = weights["rows"][rows]
        q, k, v = x @ weights["q"], x @ weights["k"], x @ weights["v"]
        back = np.arange(lm.WINDOW)[:, None] - np.arange(lm.WINDOW)[None, :]
        a = np.where(back < 0, -np.inf, q @ k.transpose(0, 2, 1) * lm.DIM**-0.5 + weights["near"][np.maximum(back, 0)])
        a = np.exp(a - a.max(-1, keepdims=True))
        h = x + (a / a.sum(-1, keepdims=True)) @ v @ weights["o"]
        h = (h + np.maximum(h @ weights["up"] + weights["up_bias"], 0) @ weights["down"])[mask]
        g, s, n = group[mask], slot[mask], np.arange(mask.sum())
        z = h @ weights["group"] + weights["group_bias"]
        y = np.einsum("nd,nds->ns", h, weights["slot"][g]) + weights["slot_bias"][g]
        return -np.mean(z[n, g] - np.log(np.exp(z).sum(1)) + y[n, s] - np.log(np.exp(y).sum(1)))

    got, g = lm.gradients(weights, rows, group, slot, mask)
    assert np.isclose(got, loss(), rtol=1e-9)
    for name in weights:
        for at in r.choice(g[name].size, 3, replace=False):
            at, moved = np.unravel_index(at, g[name].shape), []
            for step in (1e-5, -1e-5):
                weights[name][at] += step
                moved.append(loss())
                weights[name][at] -= step
            assert np.isclose((moved[0] - moved[1]) / 2e-5, g[name][at], rtol=1e-3, atol=1e-8), name
