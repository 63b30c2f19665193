"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become pieces of at most ``capacity`` tokens; a full piece is a sequence by itself. The others are packed in
bulk-synchronous rounds over a table of documents and of gaps (what is left of a sequence), until no document is left:

- *sweep*: documents and gaps are ranked by size, the largest first, and each document takes the smallest gap that is at
  least as large and that no larger document claims. Walking down the ranks, a gap is a step up and a document a step
  down; a document meets the gap that made the last step up to its level. The level of a row follows from counts of sizes
  and its rank among rows of its size, so the sweep is one shuffle by rank and one by level.
- *fill*: when mostly small documents are left for few gaps, documents and gaps are laid end to end, the largest first, and
  a document that lies wholly within a gap goes there; many go into one gap in one round.
- when no document fits any gap, new sequences are opened: a little fewer than the remaining tokens would fill (``OPEN``),
  since the small documents that stay behind pack well.

What reaches the driver is the number of documents and gaps of each size, at most twice ``capacity`` numbers. Rows
of a size that is common are ranked in parts, so one length that a third of all documents share is no hot key.

Null texts are empty texts; an empty text is the end token alone. Texts of any length are tokenised whole; rows that repeat
are packed as often as they come. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from curaspark.session import cut_lineage

CAPACITY = 2048
END_ID = 0
OPEN = 0.97
ROWS_PER_PART = 50_000  # of one size, ranked in one window
STRIP = 64  # capacities per stretch of the end-to-end axis
DOC, GAP = 0, 1


# ---------------------------------------------------------------- tokens


class Chunks(dict):
    """Ids of a chunk of text, as little-endian unsigned 32-bit numbers, remembered for the commonest chunks first met.

    ``encode`` is the tokenizer; ``limit`` bounds the memory.
    """

    def __init__(self, encode, prefix: str = "", limit: int = 250_000):
        super().__init__()
        self.encode, self.prefix, self.limit = encode, prefix, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = packed(self.encode(self.prefix + chunk))
        if len(self) < self.limit:
            self[chunk] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def byte_bpe(path: str):
    """The tokenizer at ``path`` as a function from text to ids, and what it remembers: chunks that begin a line or follow a space.

    The byte-level BPE of ``path`` starts a token at every space and makes a line break between two words a token of its
    own. So a text without adjoining white space is its lines, and a line is the chunks between its spaces, each but the first
    with the space before it. The merges run in tiktoken, from the vocabulary in the same file, which gives the same
    ids several times faster; added tokens are recognised as the file says.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {token: i for token, i in ranks.items() if i not in added.values()}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        return bpe.encode(text, allowed_special="all") if any(a in text for a in added) else bpe.encode_ordinary(text)

    return encode, Chunks(encode, ""), Chunks(encode, " ")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


@functools.cache
def _adjoining():
    import re

    return re.compile(r"\s\s")


def token_bytes(text: str | None, path: str) -> bytes:
    """Ids of a whole text, four bytes each."""
    if not text:
        return b""
    encode, begin, follow = byte_bpe(path)
    if _adjoining().search(text) or text[0].isspace() or text[-1].isspace():
        return packed(encode(text))
    lines = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        lines.append(begin[first] + b"".join(map(follow.__getitem__, rest)))
    return begin["\n"].join(lines)


def token_pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, number[, ids]): the pieces of every document with the end token.

    Longer documents are cut into pieces of ``capacity`` tokens, the first of which takes the remainder. ``number`` tells pieces apart.
    ``tokenizer`` is a file in a place that every executor has.
    """
    columns = f"{key} {df.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")
    schema = to_arrow_schema(StructType.fromDDL(columns))
    tail, step = packed([end]), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out: list[list] = [[] for _ in schema.names]
            for k, t in zip(batch.column(0).to_pylist(), (v.as_py() for v in batch.column(1))):  # one text at a time
                ids = token_bytes(t, tokenizer) + tail
                first = len(ids) % step
                cuts = ([0] if first else []) + list(range(first, len(ids), step)) + [len(ids)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row = [k, i, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])]
                    for column, value in zip(out, row + ([np.frombuffer(ids[a:b], "<i4")] if keep_ids else [])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return df.select(key, text).mapInArrow(run, columns).withColumn("number", F.monotonically_increasing_id())


# ---------------------------------------------------------------- rounds


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def _sizes(rows: DataFrame, capacity: int) -> list[list[int]]:
    """Number of documents and of gaps of each size."""
    table = [[0] * (capacity + 1), [0] * (capacity + 1)]
    for r in rows.groupBy("kind", "size").count().collect():  # at most 2 * capacity rows
        table[r["kind"]][r["size"]] = r["count"]
    return table


def _ranked(rows: DataFrame, counts: list[list[int]]) -> DataFrame:
    """Rows with ``rank``, from 0, among those of their kind and size."""
    parts = [[max(1, math.ceil(n / ROWS_PER_PART)) for n in kind] for kind in counts]
    of = F.get(F.get(_literal(parts, "array<array<int>>"), F.col("kind")), F.col("size"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), of).cast("int"))
    window = Window.partitionBy("kind", "size", "part").orderBy("id")
    rank = (F.row_number().over(window) - 1).cast("bigint")
    if all(p == 1 for kind in parts for p in kind):
        return rows.withColumn("rank", rank).drop("part")
    # common sizes: the rows of earlier parts come before
    common = rows.filter(of > 1).groupBy("kind", "size", "part").count().collect()  # one row per ROWS_PER_PART rows, about
    offsets: dict[str, list[int]] = {}
    for r in sorted(common, key=lambda r: (r["kind"], r["size"], r["part"])):
        offsets.setdefault(f"{r['kind']}:{r['size']}", [0] * parts[r["kind"]][r["size"]])[r["part"]] = r["count"]
    before = {k: [sum(v[:i]) for i in range(len(v))] for k, v in offsets.items()}
    start = F.get(F.element_at(_literal(before, "map<string,array<bigint>>"), F.concat_ws(":", "kind", "size")), F.col("part"))
    start = F.when(of > 1, F.coalesce(start, F.lit(0))).otherwise(0)
    return rows.withColumn("rank", rank + start).drop("part")


def _sweep(rows: DataFrame, counts: list[list[int]], capacity: int) -> DataFrame:
    """Documents with the gap they take: (kind, size, id, seq, gap); seq is null where there is none.

    Gaps that were taken are left out, the others stay as they are.
    """
    base, level = [[0] * (capacity + 1), [0] * (capacity + 1)], 0
    for size in range(capacity, -1, -1):  # levels before each size; its gaps come before its documents
        base[GAP][size] = level
        level += counts[GAP][size]
        base[DOC][size] = level
        level -= counts[DOC][size]
    before = F.get(F.get(_literal(base, "array<array<bigint>>"), F.col("kind")), F.col("size"))
    # a gap makes the step up to its level, a document the step down from it
    edge = F.when(F.col("kind") == GAP, before + F.col("rank") + 1).otherwise(before - F.col("rank"))
    walk = Window.partitionBy("edge").orderBy(F.desc("size"), F.desc("kind"), F.col("rank"))
    walked = _ranked(rows, counts).withColumn("edge", edge)
    up = F.lag(F.struct("kind", "id", "size")).over(walk)
    down = F.lead("kind").over(walk)
    walked = walked.withColumn("up", up).withColumn("taken", (F.col("kind") == GAP) & (F.coalesce(down, F.lit(GAP)) == DOC))
    meets = (F.col("kind") == DOC) & (F.col("up.kind") == GAP)
    return walked.filter("NOT taken").select("kind", "size", "id", F.when(meets, F.col("up.id")).alias("seq"), F.when(meets, F.col("up.size")).alias("gap"))


def _fill(rows: DataFrame, counts: list[list[int]], capacity: int) -> DataFrame:
    """Documents with the gap in which they lie end to end: (kind, size, id, seq, at); gaps are left out."""
    base = [[0] * (capacity + 1), [0] * (capacity + 1)]
    for kind in (DOC, GAP):
        tokens = 0
        for size in range(capacity, -1, -1):
            base[kind][size] = tokens
            tokens += size * counts[kind][size]
    before = F.get(F.get(_literal(base, "array<array<bigint>>"), F.col("kind")), F.col("size"))
    laid = _ranked(rows, counts).withColumn("at", before + F.col("rank") * F.col("size"))
    strip = F.lit(STRIP * capacity)
    first, last = F.floor(F.col("at") / strip), F.floor((F.col("at") + F.col("size") - 1) / strip)
    # a gap shows in each strip it reaches into, a document where it starts
    laid = laid.withColumn("strip", F.explode(F.when(F.col("kind") == GAP, F.sequence(first, last)).otherwise(F.array(first))))
    order = Window.partitionBy("strip").orderBy("at", F.desc("kind"), "rank")
    over = F.last(F.when(F.col("kind") == GAP, F.struct("id", "at", "size")), ignorenulls=True).over(order)
    laid = laid.withColumn("over", over).filter(F.col("kind") == DOC)
    lies = F.col("at") + F.col("size") <= F.col("over.at") + F.col("over.size")
    return laid.select("kind", "size", "id", F.when(lies, F.col("over.id")).alias("seq"), "at")


def _mode(counts: list[list[int]], capacity: int) -> str:
    """Which round suits the sizes at hand: ``fill`` where most documents are small and come several to a usable gap."""
    docs, gaps = counts
    least = next(s for s, n in enumerate(docs) if n)
    usable, n = sum(gaps[least:]), sum(docs)
    if not usable:
        return "open"
    large = sum(docs[capacity // 8 + 1 :])
    return "fill" if n >= 3 * usable and large < 0.2 * n else "sweep"


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(number, length) -> (number, sequence_id, offset): where every piece goes; each length is between 1 and ``capacity``."""
    spark = pieces.sparkSession
    rows = pieces.filter(F.col("length") < capacity).select(F.lit(DOC).alias("kind"), F.col("length").cast("int").alias("size"), F.col("number").alias("id"))
    full = pieces.filter(F.col("length") == capacity).select(F.col("number").alias("id"), (-1 - F.col("number")).alias("seq"), F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("at"), F.col("length").cast("int").alias("size"))
    placed, opened, turn, before = [full], 0, 0, ""
    counts = _sizes(rows, capacity)
    while sum(counts[DOC]):
        mode, turn = _mode(counts, capacity), turn + 1
        if mode == "fill" and before == "fill":
            mode = "sweep"
        if mode == "open":
            tokens = sum(s * n for s, n in enumerate(counts[DOC]))
            need = math.ceil(tokens / capacity)
            new = max(need if need <= 50 else math.ceil(OPEN * need), sum(counts[DOC][capacity // 2 + 1 :]))
            fresh = spark.range(opened, opened + new).select(F.lit(GAP).alias("kind"), F.lit(capacity).alias("size"), "id")
            rows, opened = rows.unionByName(fresh), opened + new
            counts[GAP][capacity] += new
            mode = "sweep"
        if mode == "sweep":
            done = cut_lineage(_sweep(rows, counts, capacity))
            hit = F.col("seq").isNotNull()
            placed.append(done.filter(hit).select("id", "seq", F.lit(turn).alias("round"), F.lit(0).cast("bigint").alias("at"), "size"))
            rows = done.select(
                F.when(hit, GAP).otherwise(F.col("kind")).alias("kind"), F.when(hit, F.col("gap") - F.col("size")).otherwise(F.col("size")).alias("size"), F.coalesce("seq", "id").alias("id")
            )
        else:
            done = cut_lineage(_fill(rows, counts, capacity))
            placed.append(done.filter("seq IS NOT NULL").select("id", "seq", F.lit(turn).alias("round"), "at", "size"))
            used = done.filter("seq IS NOT NULL").groupBy(F.col("seq").alias("id")).agg(F.sum("size").cast("int").alias("used"))
            gaps = rows.filter(F.col("kind") == GAP).join(used, "id", "left").select("kind", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size"), "id")
            rows = cut_lineage(done.filter("seq IS NULL").select("kind", "size", "id").unionByName(gaps))
        before = mode
        counts = _sizes(rows, capacity)
        if least := next((s for s, n in enumerate(counts[DOC]) if n), 0):  # gaps below the smallest document are closed
            rows = rows.filter((F.col("kind") == DOC) | (F.col("size") >= least))
            counts[GAP][:least] = [0] * least
    order = Window.partitionBy("seq").orderBy("round", "at", "id")
    all_placed = functools.reduce(DataFrame.unionByName, placed)
    return all_placed.select(F.col("id").alias("number"), F.col("seq").alias("sequence_id"), (F.sum("size").over(order) - F.col("size")).alias("offset"))


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]): one row per piece."""
    pieces = cut_lineage(token_pieces(df, tokenizer, key, text, capacity, end, keep_ids))
    return pieces.join(place(pieces, capacity), "number").drop("number")
