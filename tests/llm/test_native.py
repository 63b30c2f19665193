"""Exact dedup, source mixing and chat collapse: messy tables and comparison with plain Python or SQL."""

import re
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from conftest import LONG, MESSY
from pyspark.sql import functions as F

from curaspark.llm import chat, dedup, mixing
from curaspark.llm.queries import ORACLES

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    out = []
    for ids in groups.values():
        least = min(ids, key=lambda i: (i is not None, i))
        out += [(i, least, len(ids)) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_groups(messy, documents, digest):
    for df, rows in ((messy, MESSY), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])):
        got = dedup.exact_groups(df, digest=digest, files_per_batch=3).collect()
        assert sorted([(r["doc_id"], r["keep_key"], r["group_size"]) for r in got], key=str) == plain_groups(rows)
        texts = len({SPACE.sub(" ", r[1] or "") for r in rows})
        assert sum(r["kept"] for r in got) == texts
        assert all(r["doc_id"] == r["keep_key"] for r in got if r["kept"])


def test_exact_groups_go_on_with_their_state(spark, tmp_path):
    """State is kept between runs: later arrivals meet the digests of earlier ones."""
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    schema = "key bigint, digest string, number bigint"
    spark.createDataFrame([(5, "a", 0), (7, "b", 1)], schema).write.parquet(folder)
    dedup.keyed_state(folder, spark.read.parquet(folder).schema, state, out, spark)
    spark.createDataFrame([(3, "a", 2), (9, "c", 3)], schema).write.mode("append").parquet(folder)
    got = dedup.keyed_state(folder, spark.read.parquet(folder).schema, state, out, spark).collect()
    assert {(r["digest"], r["first"]["key"], r["group_size"]) for r in got} == {("a", 3, 2), ("b", 7, 1), ("c", 9, 1)}


def test_drop_copies(messy, nothing):
    got = dedup.drop_copies(messy)
    assert got.columns == messy.columns
    rows = got.collect()
    texts = [SPACE.sub(" ", r["text"] or "") for r in rows]
    assert len(texts) == len(set(texts)) == len({SPACE.sub(" ", r[1] or "") for r in MESSY})
    assert LONG in {r["text"] for r in rows}
    assert dedup.drop_copies(nothing).count() == 0 and dedup.exact_groups(nothing).count() == 0


# ---------------------------------------------------------------- mixing


def mix_sql(spark, df, tmp_path):
    path = str(tmp_path / "documents.parquet")
    pq.write_table(df.toArrow(), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return con.sql(ORACLES["op8_mix_sources"]).fetchall()


def test_mix_counts_equal_sql(spark, messy, documents, tmp_path):
    for df in (documents, messy.filter("text != ''"), messy.select("doc_id", "text", "source")):
        got = mixing.mix_counts(df).collect()
        rows = [(r["doc_id"], r["size"], r["source_size"], r["target"], r["size"] * r["times"]) for r in got]
        assert sorted(rows, key=str) == sorted(mix_sql(spark, df.select("doc_id", "source", "text"), tmp_path), key=str)


def test_mix_meets_targets(documents):
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in mixing.mix_counts(documents).collect():
        s = by[r["source_size"]]
        s[0], s[1] = r["source_size"], r["target"]
        s[2] += r["size"] * r["times"]
        s[3] = max(s[3], r["size"])
        assert r["times"] <= 3
    for size, target, taken, largest in by.values():
        assert target <= 3 * size and abs(taken - target) <= largest / 2 + 1
    assert abs(sum(s[1] for s in by.values()) - sum(s[0] for s in by.values())) < 1e-3


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10}, {"a": 1, "b": 1, "c": 1000, None: 5}, {"a": 0, "b": 7}, {"a": 0}, {}])
def test_water_filling(spark, sizes):
    """No target above its cap, all of the total shared while a cap allows it, free sources in proportion to weights."""
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total = sum(sizes.values())
    assert set(got) == set(sizes)
    assert all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert abs(sum(got.values()) - total) < 1e-6
    free = [got[s] / weights[s] for s in sizes if got[s] < 3 * sizes[s]]
    assert not free or max(free) - min(free) < 1e-6
    assert all(not free or got[s] / weights[s] <= free[0] + 1e-6 for s in sizes)


def test_mix_rows(messy, nothing, documents):
    times = {}
    for r in mixing.mix_counts(documents).collect():
        times[r["doc_id"]] = r["times"]
    got = mixing.mix(documents)
    assert got.columns == documents.columns
    seen = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert seen == {k: v for k, v in times.items() if v}
    assert mixing.mix(messy).columns == messy.columns and mixing.mix(messy).count() > 0
    dotted = documents.withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    assert mixing.mix(dotted).columns == dotted.columns and mixing.mix(dotted).count() == got.count()
    assert mixing.mix(nothing).count() == 0 and mixing.mix_counts(nothing).count() == 0


# ---------------------------------------------------------------- chats


def plain_chats(rows):
    chats = defaultdict(set)
    for conv, turn, role, text in rows:
        chats[conv].add((turn, role, text))
    first = lambda x: (x is not None, x)
    whole = {c: [t[1:] for t in sorted(ts, key=lambda t: tuple(map(first, t)))] for c, ts in chats.items()}
    out = set()
    for c, turns in whole.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in whole.values()):
            continue
        same = sorted((o for o in whole if whole[o] == turns), key=first)
        if same[0] == c:
            out |= {(c, i + 1, len(turns), len(same), chat.OPEN + (r or "") + chat.MIDDLE + (t or "") + chat.CLOSE) for i, (r, t) in enumerate(turns)}
    return out


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"),  # a snapshot of 1
    (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 9, "assistant", "hello"),  # equals 1 under other numbers, a repeated row
    (4, 0, "user", None), (4, 1, None, ""), (5, 0, "user", ""),  # null is not empty
    (None, 0, "user", "x"), (6, 0, "user", "x"), (7, None, "user", "first"), (7, 0, "user", "second"),
    (8, 0, "user", "tie b"), (8, 0, "user", "tie a"), (9, 0, "user", "tie a"), (9, 1, "user", "tie b"),
]


def test_chats(spark):
    long = [(20, i, "user", f"t{i}") for i in range(1000)] + [(21, i, "user", f"t{i}") for i in range(700)] + [(22, i + 3, "user", f"t{i}") for i in range(1000)]
    for rows in (CHATS, CHATS + long, []):
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, chunk string, position int")
        got = chat.format_chats(df).collect()
        assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_chats(rows)
