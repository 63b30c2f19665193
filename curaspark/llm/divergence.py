"""How the words of one source differ from those of the other sources of its language.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case; in UTF-8 a byte decides that alone,
so a batch of texts is cut into terms as one byte array. Terms are counted by length: up to 16 bytes they are packed into
one or two uint64 words, which are radix-sorted by as many 16-bit digits as the length needs, and equal neighbours are
counted as runs; longer ones are sorted as bytes, in buckets of their own. What leaves a task is one row per source and term of
a stretch of text, not one per word, and Spark adds the rows up before and after its shuffle: a frequent term or a source
that holds a third of all documents costs a row per stretch.

A language keeps the terms that at least ``MIN_DOCS`` of its documents hold. Shares are whole numbers of billionths, smoothed
by two: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N counts over V kept terms. The divergence of two shares is
floor((p - q)^2 / (p + q)). All arithmetic is exact: decimals where 64 bits could overflow, whole numbers elsewhere.

Pairs of sources are compared within buckets of terms, block of sources against block, so that a task holds a bounded table
whatever the number of terms and sources. A bucket returns sums per pair; there are as many pairs as the result has rows.

Null texts, languages and sources count as empty. Repeated rows are documents of their own. A text without terms still makes its
language and source occur; a language without kept terms has pairs of value 0. Texts longer than a stretch are counted in
pieces cut between terms and added up, whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.llm.common import sent_if_small
from curaspark.session import cut_lineage, release

MIN_DOCS = 10
TOP_TERMS = 10
STRETCH = 4_000_000  # bytes of text whose terms are sorted at once
ROWS_PER_BUCKET = 20_000  # rows of (source, term) that are compared in one task
SOURCES_PER_BLOCK = 64
BILLION = 1_000_000_000
PACKED = 16  # bytes of the longest term that is packed

_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)

COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


# ---------------------------------------------------------------- terms of a stretch of text


def find_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with lower-case letters, starts, lengths, documents) of the terms of texts that lie end to end."""
    low = _LETTERS[data]
    inside = low != 0
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(low), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(low), dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    lengths = np.flatnonzero(inside & (~after | edge[1:])) + 1 - starts
    return low, starts, lengths, np.searchsorted(offsets, starts, side="right") - 1


def radix_order(words: list[np.ndarray], digits: int) -> np.ndarray:
    """Stable order of keys of one or two words by their lowest ``digits`` 16-bit digits; the last word is the lowest."""
    order = np.arange(len(words[0]))
    for d in range(digits):
        digit = ((words[-1 - d // 4] >> np.uint64(16 * (d % 4))) & np.uint64(0xFFFF)).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def pack(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, two: bool) -> list[np.ndarray]:
    """Terms as right-aligned numbers: one uint64 word for up to 8 bytes, two for up to 16."""
    padded = np.concatenate([np.zeros(PACKED, dtype=np.uint8), low])
    at_every_byte = np.ndarray((len(low) + PACKED - 7,), dtype=">u8", buffer=padded.data, strides=(1,))
    ends = starts + lengths + PACKED

    def word(end: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ``size`` bytes before ``end``, 1 to 8 of them."""
        drop = (8 * (8 - size)).astype(np.uint64)
        return at_every_byte[end - 8].astype(np.uint64) << drop >> drop

    return [word(ends - 8, lengths - 8), word(ends, np.full(len(ends), 8))] if two else [word(ends, lengths)]


def _runs(low, starts, lengths, docs, groups) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, lengths, groups, counts, documents) of the distinct packed terms per group, a length bucket at a time.

    ``docs`` rises and ``groups`` with it, and sorting by terms is stable, so equal terms lie together by group and document.
    """
    digits = (lengths + 1) // 2
    for d in range(1, PACKED // 2 + 1):
        pick = np.flatnonzero(digits == d)
        if not len(pick):
            continue
        words = pack(low, starts[pick], lengths[pick], two=d > 4)
        order = radix_order(words, d)
        words, pick = [w[order] for w in words], pick[order]
        new = np.ones(len(pick), dtype=bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        doc, group = docs[pick], groups[pick]
        new_doc, new_run = new.copy(), new.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        new_run[1:] |= group[1:] != group[:-1]
        heads = np.flatnonzero(new_run)
        counts = np.diff(np.append(heads, len(pick)))
        yield starts[pick[heads]], lengths[pick[heads]], group[heads], counts, np.add.reduceat(new_doc.astype(np.int64), heads)


def _long_runs(low, starts, lengths, docs, groups) -> Iterator[tuple[bytes, int, int, int]]:
    """(term, group, count, documents) of the terms that are not packed: sorted as bytes, by buckets of their length."""
    for size in np.unique(lengths[lengths > PACKED]):
        pick = np.flatnonzero(lengths == size)
        items = sorted((low[s : s + size].tobytes(), g, d) for s, g, d in zip(starts[pick], groups[pick].tolist(), docs[pick].tolist()))
        for (term, group), run in groupby(items, key=lambda i: i[:2]):
            held = [d for _, _, d in run]
            yield term, group, len(held), len(set(held))


def _strings(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.cumsum(lengths)
    data = low[np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def counted(data: np.ndarray, offsets: np.ndarray, group_of: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, groups, counts, documents) of texts that lie end to end, sorted by group."""
    low, starts, lengths, docs = find_terms(data, offsets)
    groups = group_of[docs]
    for s, size, g, n, held in _runs(low, starts, lengths, docs, groups):
        yield _strings(low, s, size), g, n, held
    if rest := list(_long_runs(low, starts, lengths, docs, groups)):
        terms, g, n, held = zip(*rest)
        yield pa.array([t.decode() for t in terms], pa.string()), np.array(g), np.array(n), np.array(held)


def _pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``size`` bytes, cut where no term is; a term longer than that makes a longer piece."""
    start = 0
    while start < len(data):
        stop = min(start + size, len(data))
        while stop < len(data) and _LETTERS[data[stop]]:
            ahead = np.flatnonzero(_LETTERS[data[stop : stop + size]] == 0)
            stop = min(stop + (int(ahead[0]) if len(ahead) else size), len(data))
        yield data[start:stop]
        start = stop


def _long_text(data: np.ndarray, size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """The terms of one text that is longer than a stretch; a term of several pieces is one document's."""
    total: Counter[str] = Counter()
    for piece in _pieces(data, size):
        for terms, _, n, _ in counted(piece, np.array([0, len(piece)]), np.zeros(1, dtype=np.int64)):
            for t, k in zip(terms.to_pylist(), n.tolist()):
                total[t] += k
    if total:
        yield pa.array(list(total), pa.string()), np.zeros(len(total), dtype=np.int64), np.array(list(total.values())), np.ones(len(total), dtype=np.int64)


def count_batch(batch: pa.RecordBatch, size: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """Counts of the (lang, source, text) rows of a batch, a stretch of rows at a time, whatever their lengths."""
    names = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist()))
    distinct = sorted(set(names))
    number = {g: i for i, g in enumerate(distinct)}
    codes = np.array([number[g] for g in names], dtype=np.int64)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    langs, sources = pa.array([g[0] for g in distinct], pa.string()), pa.array([g[1] for g in distinct], pa.string())
    lengths = pc.binary_length(batch["text"]).to_numpy().astype(np.int64)[order]
    start = 0
    while start < len(order):
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(lengths[start:]), size, side="right")))
        ends = np.concatenate([[0], np.cumsum(lengths[start:stop])])
        texts = batch["text"].take(pa.array(order[start:stop]))
        first = int(np.frombuffer(texts.buffers()[1], np.int32, 1, 4 * texts.offset)[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, int(ends[-1]), first) if ends[-1] else np.zeros(0, np.uint8)
        long = len(data) > size and stop == start + 1
        for terms, group, n, docs in _long_text(data, size) if long else counted(data, ends, codes[start:stop]):
            at = pa.array(group + codes[start] if long else group)
            yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)
        start = stop


# ---------------------------------------------------------------- tables


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs in the documents of a source, and in how many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from count_batch(batch)

    found = plain(docs).mapInArrow(run, COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """Smoothed share in billionths, exact for counts of any size; 1 where no term is kept."""
    ratio = f"(cast({BILLION} as decimal(10,0)) * cast({n} + 2 as decimal(20,0))) div cast(greatest({total} + 2 * {kept}, 1) as decimal(20,0))"
    return F.expr(f"1 + {ratio}")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(rows: pa.Table) -> pa.Table:
    """Sums over a bucket's terms for the pairs of two blocks of sources: (lang, a, b, value, terms).

    Rows without a term say what share each source has of a term that it does not hold. Terms that neither block holds are
    not counted here.
    """
    lang, block, block2 = (rows[c][0].as_py() for c in ("lang", "block", "block2"))
    is_base = rows["term"].is_null().to_numpy()
    base = rows.filter(pa.array(is_base))
    names = base["source"].to_pylist()
    place = {s: i for i, s in enumerate(names)}
    floor = base["p"].to_numpy().astype(np.int64)
    held = rows.filter(pa.array(~is_base))
    term = held["term"].combine_chunks().dictionary_encode()
    table = np.repeat(floor[None, :], len(term.dictionary), axis=0)
    table[term.indices.to_numpy(), np.array([place[s] for s in held["source"].to_pylist()], dtype=np.int64)] = held["p"].to_numpy()
    side = base["own"].to_numpy()
    a, b, value = [], [], []
    for i, name in enumerate(names):
        others = [j for j, other in enumerate(names) if (name < other if block == block2 else side[i] == block and side[j] == block2)]
        if others:
            p, q = table[:, [i]], table[:, others]
            value += ((p - q) * (p - q) // (p + q)).sum(axis=0).tolist()
            a += [name] * len(others)
            b += [names[j] for j in others]
    n = len(a)
    return pa.table({"lang": [lang] * n, "a": a, "b": b, "value": value, "terms": [len(table)] * n}, schema=_SUMS)


SUMS = "lang string, a string, b string, value bigint, terms bigint"
_SUMS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("terms", pa.int64())])


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for every source its divergence from each other source of the language
    (part ``pair``), and the terms it uses more than the language does, the ``top`` most telling of them (part ``term``).
    """
    counts = cut_lineage(term_counts(docs))
    of_term = Window.partitionBy("lang", "term")  # as many rows as a language has sources
    kept = counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("df"), F.sum("n").over(of_term).alias("lang_n"), (F.min("source").over(of_term) == F.col("source")).alias("once")
    )
    kept = cut_lineage(kept.filter(F.col("df") >= min_docs).drop("df"))
    release(counts)
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("once"), 1)).alias("v"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = plain(docs).select("lang", "source").distinct()
    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    groups = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").join(per_lang, "lang")
    groups = cut_lineage(groups.fillna(0, ["total", "lang_total", "v"]))
    small = sent_if_small(groups)

    shares = kept.join(small, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q"), "n_sources"
    )
    telling = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(shares, groups, kept.count())
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    columns = ["lang", "source", "part", "item", "value"]
    return pairs.select(*columns, rank).unionByName(telling.select(*columns, rank).filter(F.col("rank") <= top))


def _pairs(shares: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """(lang, source, part, item, value) of every two sources of a language."""
    buckets = max(groups.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / ROWS_PER_BUCKET))
    blocks = F.ceil(F.col("n_sources") / F.lit(SOURCES_PER_BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("source"), blocks).cast("int")

    def met(rows: DataFrame) -> DataFrame:
        """Every row for each pair of blocks that its source's block is part of."""
        rows = rows.select("lang", "source", "term", "p", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("met"))
        return rows.select("lang", "bucket", F.least("own", "met").alias("block"), F.greatest("own", "met").alias("block2"), "own", "source", "term", "p")

    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    held = met(shares.select("lang", "source", "term", "p", "n_sources", bucket))
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    floors = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), share("0", "total", "v").alias("p"), "n_sources", every)
    both = held.unionByName(met(floors))
    sums = both.groupBy("lang", "bucket", "block", "block2").applyInArrow(_pair_sums, SUMS)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    # terms that neither source holds and that no bucket saw have the same two shares each
    floor = groups.select("lang", F.col("source").alias("a"), "v", share("0", "total", "v").alias("p"))
    floor2 = groups.select("lang", F.col("source").alias("b"), share("0", "total", "v").alias("q"))
    value = F.col("value") + (F.col("v") - F.col("terms")) * divergence(F.col("p"), F.col("q"))
    sums = sums.join(sent_if_small(floor), ["lang", "a"]).join(sent_if_small(floor2), ["lang", "b"]).select("lang", "a", "b", value.alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    return sums.select("lang", ways, "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
