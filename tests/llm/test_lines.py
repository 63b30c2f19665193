"""Cuckoo filters, and line deduplication that is taken back: against brute force after every step."""

import random

import numpy as np
import pytest
from conftest import LONG, MESSY
from pyspark.sql import functions as F

from curaspark.llm import lines
from curaspark.llm.cuckoo import CuckooFilter, Full


def keys(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**64, (n, 2), dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1, 230, 60_000])
def test_filter_holds_inserts_and_forgets(n):
    sieve, k = CuckooFilter.sized(n), keys(n)
    for part in np.array_split(k, 3):
        sieve.insert(part[:, 0], part[:, 1])
    assert len(sieve) == n and sieve.contains(k[:, 0], k[:, 1]).all()
    sieve = CuckooFilter.from_bytes(sieve.to_bytes())
    others = keys(100_000, 2)
    assert sieve.contains(others[:, 0], others[:, 1]).mean() < 8 / 65535 * 1.5
    gone, left = k[::2], k[1::2]
    sieve.delete(gone[:, 0], gone[:, 1])
    assert len(sieve) == len(left) and sieve.contains(left[:, 0], left[:, 1]).all()
    sieve.delete(left[:, 0], left[:, 1])
    assert len(sieve) == 0


def test_filter_says_when_it_is_full():
    sieve, k = CuckooFilter.sized(200), keys(300)
    with pytest.raises(Full):
        sieve.insert(k[:, 0], k[:, 1])
    with pytest.raises(KeyError):
        CuckooFilter.sized(10).delete(k[:, 0], k[:, 1])


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(docs):
    """[(doc_id, n_lines, dropped, kept)] of (doc_id, text) rows."""
    holders = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(doc_id)
    order = lambda d: (d is not None, d)
    keep = {k: min(ids, key=order) for k, ids in holders.items() if len(ids) > 1}
    out = []
    for doc_id, text in docs:
        all_lines = (text or "").split("\n")
        kept = [line for line in all_lines if key(line) not in keep or keep[key(line)] == doc_id]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(index, df):
    kept = index.kept_lines(df)
    got = kept.select("doc_id", lines.n_lines(F.col("text")), "__dropped", "__kept").collect()
    return sorted(map(tuple, got), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    common = [f"  Shared Line number {i}, Ä\t" for i in range(30)] + ["short", "", "x" * 10, "é" * 9, "É" * 10]
    return [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else f"own line {i} {rng.random()}" for _ in range(rng.randint(0, 12)))) for i in range(n)]


def test_documents_come_and_go(spark, monkeypatch):
    """Three arrivals, two of them partly removed again: at each step as if only what is there had ever come."""
    rows = texts(200, 3)
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, text string")
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 50)
    index = lines.LineIndex.create(spark)
    index.insert(frame(rows[100:]))
    there = rows[100:]
    assert result(index, frame(there)) == brute(there)
    index.insert(frame(rows[:100]))  # smaller identifiers come later and take the lines over
    there = rows
    assert result(index, frame(there)) == brute(there)
    gone = {r[0] for r in rows if r[0] % 3 == 0}
    index.remove(frame([(g, None) for g in gone]))
    there = [r for r in rows if r[0] not in gone]
    assert result(index, frame(there)) == brute(there)
    index = lines.LineIndex.open(spark, index.folder)  # after a restart
    index.insert(frame([r for r in rows if r[0] in gone]))
    assert result(index, frame(rows)) == brute(rows)
    index.remove(frame(rows))
    held = index._filters().collect()
    assert held and all(len(CuckooFilter.from_bytes(r["filter"])) == 0 for r in held)
    index.drop()


def test_full_filters_are_built_anew(spark, monkeypatch):
    monkeypatch.setattr(lines, "SPARE", 1.0)
    monkeypatch.setattr(lines, "MIN_CHARS", 3)
    some = [(i, f"line {i}") for i in range(20)]
    many = [(i, f"line {i}") for i in range(10, 9000)]
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, text string")
    index = lines.LineIndex.create(spark)
    index.insert(frame(some))
    index.insert(frame(many))
    assert sum(len(CuckooFilter.from_bytes(r["filter"])) for r in index._filters().collect()) == 9000
    index.insert(frame([(9999, "line 17\nline 8000")]))
    assert [r["__dropped"] for r in index.kept_lines(frame([(9999, "line 17\nline 8000")])).collect()] == [2]


def test_false_alarms_change_nothing(spark, monkeypatch):
    """A filter that takes every key for held: references decide, and the filter still holds each key once."""
    rows = texts(40, 5)
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, text string")
    index = lines.LineIndex.create(spark)
    index.insert(frame(rows[:20]))
    state, rows_of, words, built = lines._state, lines._rows, lines._words, lines._built

    def all_maybe(keys, filters):
        shard, blob = state(keys, filters)
        return rows_of(shard, blob or built(*words(keys.slice(0, 0))).to_bytes(), False, keys["digest"].to_pylist())

    monkeypatch.setattr(lines, "_probe", all_maybe)
    index.insert(frame(rows[20:]))
    assert result(index, frame(rows)) == brute(rows)
    distinct = {key(x) for _, t in rows for x in t.split("\n") if len(key(x)) >= 10}
    assert sum(len(CuckooFilter.from_bytes(r["filter"])) for r in index._filters().collect()) == len(distinct)


def test_messy_and_empty(spark, messy, nothing):
    index = lines.LineIndex.create(spark)
    index.insert(messy)
    got = index.kept_lines(messy)
    assert got.columns == [*messy.columns, "__kept", "__dropped"]
    assert result(index, messy) == brute([r[:2] for r in MESSY])
    assert LONG in {r["__kept"] for r in got.collect()}
    none = lines.LineIndex.create(spark)
    none.insert(nothing)
    none.insert(nothing)
    assert none.kept_lines(nothing).count() == 0
    assert result(none, messy.filter("doc_id = 1")) == brute([MESSY[0][:2]])
