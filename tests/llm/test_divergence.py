"""Terms, their counts and the divergences of sources against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import MESSY

from curaspark.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = ["a", "I", "the", "Ünï", "漢字", "Haus", "aaaaaaaa", "aaaaaaab", "aaaaaaaaa", "zebra" * 3 + "q", "Donaudampfschiff", "Donaudampfschiffe", "x" * 300, "x" * 301, "don't", "a1b2", "😀", "ÿÿÿÿÿÿÿÿ", "-", "é"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_counts(rows):
    """{(lang, source, term): [n, docs]} of (lang, source, text) rows."""
    out = defaultdict(lambda: [0, 0])
    for lang, source, text in rows:
        for term, n in Counter(TERM.findall(lower(text))).items():
            out[lang, source, term][0] += n
            out[lang, source, term][1] += 1
    return {k: tuple(v) for k, v in out.items()}


def random_rows(n, seed=1):
    rng = random.Random(seed)
    joiners = [" ", "\n", ", ", "_", "7", "\t", "\x00"]
    return [
        (rng.choice("xy"), rng.choice(["s1", "s2", "S", ""]), "".join(rng.choice(WORDS) + rng.choice(joiners) for _ in range(rng.randint(0, 40))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("size", [1, 50, 700, 10**7])
def test_counts_whatever_the_stretch(size):
    """Texts longer than a stretch are cut between terms, and a document counts once for each of its terms."""
    rows = random_rows(80)
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "source": [r[1] for r in rows], "text": [r[2] for r in rows]})
    got = defaultdict(lambda: [0, 0])
    for part in dv.count_batch(batch, size):
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in part.columns)):
            got[lang, source, term][0] += n
            got[lang, source, term][1] += docs
    assert {k: tuple(v) for k, v in got.items()} == brute_counts(rows)


def test_radix_order_is_that_of_bytes():
    rng = np.random.default_rng(3)
    terms = [bytes(rng.integers(97, 123, 11).astype(np.uint8)) for _ in range(500)] * 2
    low = np.frombuffer(b" ".join(terms), np.uint8)
    starts, lengths = np.arange(len(terms)) * 12, np.full(len(terms), 11)
    words = dv.pack(low, starts, lengths, two=True)
    order = dv.radix_order(words, 6)
    assert [terms[i] for i in order] == sorted(terms)
    same = [(int(i), int(j)) for i, j in zip(order, order[1:]) if terms[i] == terms[j]]
    assert len(same) == 500 and all(i < j for i, j in same)  # stable


def brute(rows, min_docs, top):
    counts = brute_counts(rows)
    groups = {(r[0], r[1]) for r in rows}
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        df, total = Counter(), Counter()
        for (x, _, t), (n, docs) in counts.items():
            if x == lang:
                df[t] += docs
                total[t] += n
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        sizes = {s: sum(counts.get((lang, s, t), (0, 0))[0] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (counts.get((lang, s, t), (0, 0))[0] + 2) // (sizes[s] + 2 * v) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (total[t] + 2) // (sum(sizes.values()) + 2 * v) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s, t] - p[o, t]) ** 2 // (p[s, t] + p[o, t]) for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -x, i + 1) for i, (x, o) in enumerate(sorted(pairs, key=lambda r: (r[0], r[1].encode())))]
            terms = [(-((p[s, t] - q[t]) ** 2 // (p[s, t] + q[t])), t) for t in kept if (lang, s, t) in counts and p[s, t] > q[t]]
            out += [(lang, s, "term", t, -x, i + 1) for i, (x, t) in enumerate(sorted(terms, key=lambda r: (r[0], r[1].encode()))[:top])]
    return sorted(out)


@pytest.mark.parametrize("bucket, block", [(100_000, 64), (5, 2)])
def test_divergence(spark, monkeypatch, bucket, block):
    """Also with many buckets of terms and blocks of two sources, a source without terms, and a language without kept terms."""
    monkeypatch.setattr(dv, "ROWS_PER_BUCKET", bucket)
    monkeypatch.setattr(dv, "SOURCES_PER_BLOCK", block)
    rng = random.Random(9)
    rows = random_rows(60, 4) + [("x", "void", "12 34"), ("z", "a", "rare"), ("z", "b", "words")]
    rows += [("y", f"t{i}", " ".join(rng.choice(WORDS) for _ in range(20))) for i in range(5)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(map(tuple, dv.source_divergence(df, min_docs=3, top=4).collect()))
    assert got == brute(rows, 3, 4)


def test_messy_and_empty(spark, messy, nothing):
    got = sorted(map(tuple, dv.source_divergence(messy, min_docs=2).collect()))
    assert got == brute([(r[2] or "", r[3] or "", r[1] or "") for r in MESSY], 2, 10)
    assert dv.source_divergence(nothing).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    df = spark.createDataFrame([(4 * 10**17, 9 * 10**17, 10**6)], "n bigint, total bigint, v bigint")
    want = 1 + 10**9 * (4 * 10**17 + 2) // (9 * 10**17 + 2 * 10**6)
    assert df.select(dv.share("n", "total", "v")).first()[0] == want
