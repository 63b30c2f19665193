"""Line deduplication that can be taken back: sharded cuckoo filters in front of exact tables of references.

A line's key is the line without white space at its ends and with A-Z in lower case. A key of at least ``MIN_CHARS`` code
points that two or more documents hold stays in the document with the smallest identifier, and all lines with that key go
from the others. Documents come and go in generations:

``references``  (digest, doc_id, change): one row per document and distinct key, +1 when the document comes and -1 when it
                goes. Written where the lines are, without a shuffle, and exact: a document holds a key while its sum is
                positive.
``filters``     one cuckoo filter per shard of the digests, holding every key that some document holds.
``repeats``     digests that met their like: twice in a generation, or found by the filter in an earlier one.

An arrival asks the filter of each shard which of its keys may be held already. Most lines are unique, and what no filter
knows and the arrival holds once needs no look at earlier references. What may be repeated is counted in the references,
so a false alarm of a filter costs a look-up and changes nothing. When documents leave, keys without a holder leave their filter, and the lines
that the documents had taken from others come back, for the keeper follows from the references that are left.

A generation counts from the moment its last table is complete, so a job that dies part way is run again under the same
number. A line that a third of all documents hold is one row per map task when keys are counted; the filters see distinct
keys only. A shard holds at most about ``KEYS_PER_SHARD`` keys of the first arrival, and a filter that grows full is built
anew, at twice the size, from the references of its shard.

Null and empty texts are one empty line. Rows that share an identifier are one document, and a null identifier is a document
of its own, smaller than any other. Repeated rows keep their lines, for a document never loses a line to itself. Digests are
128 bits of SHA-256. Other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm.common import sent_if_small
from curaspark.llm.cuckoo import CuckooFilter, Full
from curaspark.operators.groups import attach
from curaspark.session import cut_lineage, release, shared_path

MIN_CHARS = 10
KEYS_PER_SHARD = 200_000
SENT = 500_000  # digests that may be sent to all executors, some 20 bytes each; more are joined by a shuffle
SPARE = 2.5  # room of a new filter, as a multiple of what it holds at first
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PROBED = "shard int, digest binary, filter binary, full boolean"
_PROBED = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("filter", pa.binary()), ("full", pa.bool_())])


def line_keys(text: Column) -> Column:
    """Keys of a text's lines in order, short ones too."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: F.translate(F.btrim(x, F.lit(SPACE)), UPPER, LOWER))


def key_of(line: str) -> bytes:
    """The key of one line as ``line_keys`` makes it, in UTF-8."""
    return line.encode().strip(SPACE.encode()).lower()


def digest_of(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def held_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest): the distinct long enough keys of every row."""
    hexes = F.transform(line_keys(F.col(text)), lambda k: F.when(F.char_length(k) >= MIN_CHARS, F.substring(F.sha2(k, 256), 1, 32)))
    held = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.filter(hexes, lambda h: h.isNotNull()))).alias("h"))
    return held.select("doc_id", F.unhex("h").alias("digest"))


def _words(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The digests in order, as two uint64 columns; the order makes a task that runs again build the same filter."""
    joined = b"".join(sorted(keys["digest"].to_pylist()))
    both = np.frombuffer(joined, ">u8").reshape(-1, 2).astype(np.uint64) if joined else np.zeros((0, 2), np.uint64)
    return both[:, 0], both[:, 1]


def _bytes(high: np.ndarray, low: np.ndarray) -> list[bytes]:
    joined = np.stack([high, low], axis=1).astype(">u8").tobytes()
    return [joined[i : i + 16] for i in range(0, len(joined), 16)]


def _state(keys: pa.Table, filters: pa.Table) -> tuple[int, bytes | None]:
    return (filters if filters.num_rows else keys)["shard"][0].as_py(), filters["filter"][0].as_py() if filters.num_rows else None


def _rows(shard: int, blob: bytes | None, full: bool = False, found: Sequence[bytes] = ()) -> pa.Table:
    n = len(found)
    return pa.table({"shard": [shard] * (n + 1), "digest": [*found, None], "filter": [None] * n + [blob], "full": [None] * n + [full]}, schema=_PROBED)


def _built(high: np.ndarray, low: np.ndarray) -> CuckooFilter:
    """A filter of the keys, with room for more."""
    room = math.ceil(SPARE * len(high))
    while True:
        sieve = CuckooFilter.sized(room)
        try:
            sieve.insert(high, low)
            return sieve
        except Full:
            room = 2 * room + 1


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Of one shard: the keys its filter may hold, and the filter with the other keys added.

    The row without a digest holds the filter; ``full`` says that it has to be built anew.
    """
    shard, blob = _state(keys, filters)
    high, low = _words(keys)
    if blob is None:
        return _rows(shard, _built(high, low).to_bytes())
    sieve = CuckooFilter.from_bytes(blob)
    maybe = sieve.contains(high, low)
    found = _bytes(high[maybe], low[maybe])
    try:
        sieve.insert(high[~maybe], low[~maybe])
    except Full:
        return _rows(shard, blob, True, found)
    return _rows(shard, sieve.to_bytes(), False, found)


def _add(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Of one shard: the filter with keys added that its first look took for held."""
    shard, blob = _state(keys, filters)
    full = filters["full"][0].as_py()
    if keys.num_rows and not full:
        sieve = CuckooFilter.from_bytes(blob)
        try:
            sieve.insert(*_words(keys))
            blob = sieve.to_bytes()
        except Full:
            full = True
    return _rows(shard, blob, full)


def _rebuild(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Of one shard: its filter, built anew if it was full."""
    shard, blob = _state(keys, filters)
    return _rows(shard, _built(*_words(keys)).to_bytes() if filters["full"][0].as_py() else blob)


def _without(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Of one shard: the filter without the given keys."""
    shard, blob = _state(keys, filters)
    sieve = CuckooFilter.from_bytes(blob)
    sieve.delete(*_words(keys))
    return _rows(shard, sieve.to_bytes())


@dataclass
class LineIndex:
    """The lines of the documents that came and have not gone, in a folder that all executors share."""

    spark: SparkSession
    folder: str
    shards: int = 0
    generation: int = 0

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None) -> LineIndex:
        return cls(spark, folder or shared_path(spark, "lines"))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineIndex:
        """The index as its last complete generation left it."""
        done = spark.read.parquet(f"{folder}/done").agg(F.max("generation").alias("g"), F.max("shards").alias("s")).first()
        return cls(spark, folder, done["s"], done["g"])

    # ------------------------------------------------------------ tables

    def _path(self, name: str, generation: int) -> str:
        return f"{self.folder}/{name}/{generation}"

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        """Write a table of the generation in the making, replacing what a failed attempt left."""
        path = self._path(name, self.generation + 1)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _read(self, name: str, upto: int | None = None) -> DataFrame:
        last = self.generation if upto is None else upto
        return self.spark.read.parquet(*[self._path(name, g) for g in range(1, last + 1)])

    def _filters(self) -> DataFrame:
        return self.spark.read.parquet(self._path("filters", self.generation))

    def _finish(self) -> None:
        done = self.spark.createDataFrame([(self.generation + 1, self.shards)], "generation int, shards int")
        done.coalesce(1).write.mode("append").parquet(f"{self.folder}/done")
        self.generation += 1

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int").alias("shard")

    # ------------------------------------------------------------ documents come and go

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        """Take in documents; ones that share an identifier with earlier ones add to what that document holds."""
        references = self._write(held_keys(docs, text, doc_id).withColumn("change", F.lit(1)), "references")
        by_key = references.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
        twice = (F.col("low") < F.col("high")) | ((F.col("nulls") > 0) & F.col("low").isNotNull())
        keys = cut_lineage(by_key.select("digest", F.coalesce(twice, F.lit(False)).alias("twice")))
        first = self.generation == 0
        if first:
            self.shards = max(self.spark.sparkContext.defaultParallelism, math.ceil(keys.count() / KEYS_PER_SHARD))
        keyed = keys.select(self._shard(), "digest").groupBy("shard")
        earlier = self.spark.createDataFrame([], "shard int, filter binary") if first else self._filters().select("shard", "filter")
        probed = cut_lineage(keyed.cogroup(earlier.groupBy("shard")).applyInArrow(_probe, PROBED))
        maybe = probed.filter("digest IS NOT NULL").select("shard", "digest")
        # read once more, for a join of two parts of one table is ambiguous
        filters = self.spark.read.schema(probed.schema).parquet(probed.cut_path).filter("digest IS NULL")
        self._write(keys.filter("twice").select("digest").unionByName(maybe.select("digest")).distinct(), "repeats")
        if not first:
            filters = self._settle(filters, maybe, references)
        self._write(filters.select("shard", "filter"), "filters")
        self._finish()
        release(keys, probed)

    def _settle(self, probed: DataFrame, maybe: DataFrame, references: DataFrame) -> DataFrame:
        """Filters with their false alarms added, and full ones built from all that their shard holds."""
        earlier = self._read("references")
        known = self._holders(earlier, maybe.select("digest")).select("digest").distinct()
        late = maybe.join(known, "digest", "left_anti")
        filters = cut_lineage(late.groupBy("shard").cogroup(probed.select("shard", "filter", "full").groupBy("shard")).applyInArrow(_add, PROBED))
        full = filters.filter("full").select(F.col("shard").alias("in_full"))
        if full.isEmpty():
            return filters
        shard_rows = earlier.unionByName(references).select(self._shard(), "*").join(full, F.col("shard") == F.col("in_full"), "left_semi")
        held = self._positive(shard_rows).select(self._shard(), "digest").distinct()
        return held.groupBy("shard").cogroup(filters.select("shard", "filter", "full").groupBy("shard")).applyInArrow(_rebuild, PROBED)

    def remove(self, documents: DataFrame, doc_id: str = "doc_id") -> None:
        """Let documents go: all that the identifiers hold, in whatever generations it came."""
        gone_ids = documents.select(F.col(doc_id).alias("doc_id")).distinct()
        earlier = self._read("references")
        gone = self._positive(attach(earlier, gone_ids, ["doc_id"], "left_semi"))
        changes = self._write(gone.select("doc_id", "digest", (-F.col("held")).cast("int").alias("change")), "references")
        digests = changes.select("digest").distinct()
        left = self._holders(earlier.unionByName(changes), digests).select("digest").distinct()
        free = digests.join(left, "digest", "left_anti").select(self._shard(), "digest")
        filters = free.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_without, PROBED)
        self._write(filters.select("shard", "filter"), "filters")
        self._write(self.spark.createDataFrame([], "digest binary"), "repeats")
        self._finish()

    # ------------------------------------------------------------ what is held, and what goes

    @staticmethod
    def _positive(references: DataFrame) -> DataFrame:
        """(digest, doc_id, held) of the documents that still hold a key."""
        return references.groupBy("digest", "doc_id").agg(F.sum("change").alias("held")).filter("held > 0")

    def _holders(self, references: DataFrame, digests: DataFrame) -> DataFrame:
        """Who holds the given digests. Few digests are sent to the references, so that a line all documents hold stays where it is."""
        return self._positive(references.join(sent_if_small(digests, SENT), "digest", "left_semi"))

    def repeated(self) -> DataFrame:
        """(digest, doc_id, keep): every document that holds a key of two or more, and the one that keeps its lines."""
        repeats = cut_lineage(self._read("repeats").distinct())
        holders = cut_lineage(self._holders(self._read("references"), repeats))
        # nulls are smaller than any identifier
        keys = holders.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id")).alias("keep"))
        keys = cut_lineage(keys.filter("n >= 2"))
        return holders.join(sent_if_small(keys, SENT), "digest").select("digest", "doc_id", F.col("keep.doc_id").alias("keep"))

    def kept_lines(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """The documents with two more columns: ``__kept``, the text that stays, and ``__dropped``, the number of lines that go."""
        lost = self.repeated().filter(~F.col("doc_id").eqNullSafe(F.col("keep"))).groupBy("doc_id").agg(F.collect_list("digest").alias("__lost"))
        joined = attach(docs, lost.withColumnRenamed("doc_id", doc_id), [doc_id])
        whole = F.coalesce(F.col(text), F.lit(""))

        @F.pandas_udf("text string, dropped bigint")
        def without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, lists in parts:
                out = []
                for t, digests in zip(texts, lists):
                    gone = set() if t is None else set(digests)
                    lines = [] if t is None else t.split("\n")
                    kept = [line for line in lines if digest_of(key_of(line)) not in gone]
                    out.append(("\n".join(kept), len(lines) - len(kept)))
                yield pd.DataFrame(out, columns=["text", "dropped"])

        # a text that loses nothing does not go to Python
        loses = F.col("__lost").isNotNull()
        joined = joined.withColumn("__r", without(F.when(loses, whole), F.col("__lost")))
        kept = F.when(loses, F.col("__r.text")).otherwise(whole).alias("__kept")
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], kept, F.col("__r.dropped").alias("__dropped"))

    def drop(self) -> None:
        """Delete the index."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def n_lines(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("bigint")
