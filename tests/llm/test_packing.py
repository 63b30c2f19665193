import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curaspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcTHE 019.,'!?<|>\n\t\r éñ \u0085\x1c漢😀ſ")) | st.characters(exclude_categories=["Cs"]), max_size=30))
def test_ids_are_those_of_the_library(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_ids_are_those_of_the_library, "t") else test_ids_are_those_of_the_library.t
    test_ids_are_those_of_the_library.t = library
    for t in (text, text + "<|endoftext|> a", f"one two\n{text} three"):
        assert packing.token_bytes(t, PATH) == array("I", library.encode(t, add_special_tokens=False).ids).tobytes()


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        best = min((i for i, g in enumerate(gaps) if g >= x), key=lambda i: gaps[i], default=None)
        if best is None:
            gaps.append(capacity - x)
        else:
            gaps[best] -= x
    return len(gaps)


def check_places(rows, capacity):
    """(number, length, sequence, offset): every piece once, sequences without gaps and within their capacity."""
    by = {}
    for _, length, seq, offset in rows:
        by.setdefault(seq, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


LENGTHS = {
    "mixed": lambda r: np.minimum(1 + r.lognormal(3.2, 1.0, 1500).astype(int), 100),
    "tiny": lambda r: r.integers(1, 6, 2000),
    "one length": lambda r: np.full(500, 37),
    "large": lambda r: r.integers(51, 101, 300),
    "full": lambda r: np.full(20, 100),
    "single": lambda r: np.array([1]),
}


@pytest.mark.parametrize("name", list(LENGTHS))
def test_place(spark, name, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PART", 200)  # so that common lengths are ranked in parts
    lengths = LENGTHS[name](np.random.default_rng(3)).tolist()
    df = spark.createDataFrame(list(enumerate(lengths)), "number bigint, length bigint")
    rows = packing.place(df, 100).join(df, "number").select("number", "length", "sequence_id", "offset").collect()
    assert sorted(r["number"] for r in rows) == list(range(len(lengths)))
    used = check_places([tuple(r) for r in rows], 100)
    assert used <= 1.01 * best_fit_decreasing(lengths, 100) + 1


def test_pack_returns_whole_documents(spark, messy, nothing, library):
    got = packing.pack(messy, PATH, capacity=64).orderBy("doc_id", "sequence_id").collect()
    check_places([(0, r["length"], r["sequence_id"], r["offset"]) for r in got], 64)
    wanted = sorted([[*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in messy.collect()])
    single = [r["ids"] for r in got if r["start"] == 0 and r["piece"] == 0]
    assert sorted(w for w in wanted if len(w) <= 64) == sorted(s for s, r in zip(single, [r for r in got if r["start"] == 0 and r["piece"] == 0]) if len(s) <= 64 and r["doc_id"] not in (6, 11))
    for doc_id, text in ((6, None), (11, None)):
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids"]) for r in got if r["doc_id"] == doc_id)
        ids = [i for p in pieces for i in p[3]]
        text = messy.filter(F.col("doc_id") == doc_id).first()["text"]
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 0]
        assert all(p[2] == 64 for p in pieces[1:]) and [p[1] for p in pieces] == [sum(q[2] for q in pieces[:i]) for i in range(len(pieces))]
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    assert packing.pack(nothing, PATH).count() == 0
