"""Near-duplicate groups of SimHash fingerprints, found with vantage-point trees.

A fingerprint holds, bit by bit, the majority of the 64-bit hashes of a text's word shingles. Fingerprints link when they
differ in at most ``bits`` bits, and linked ones form components.

Links are searched among distinct fingerprints. Two that differ in at most 3 bits differ in at most one bit in one of
their halves, so there is one tree per half, and its radius is 1 (in general ``bits // 2``): on half the bits the distances
spread just as wide for a third of the radius, and the triangle bounds prune far more. A node of a tree is a vantage point with
a median distance: what is nearer goes left, the rest right, and a query goes to each side that its radius can reach. Where
a half cannot tell points apart, as among near copies that share it, the node measures the other half with the full radius.

The top of each tree is fitted on a sample of at most ``SAMPLE_PER_SHARD`` fingerprints per shard (its size decides only how
even the shards are, never what is found) and deals fingerprints into shards: each lives in one and is sent as a query to
every shard its ball overlaps. Each shard searches on with a tree of its own, compares the full 64 bits at the leaves, and
returns a spanning forest of its links instead of all pairs. Shards with very many queries are split by query.

Null and empty texts have the fingerprint zero and link like any other. Copies share a fingerprint and cost one point.
Texts of fewer words than a shingle are one shingle. A null identifier takes part but names a component only if no other can.
Rows that repeat an identifier are rows of their own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import lower_words, per_row, sent_if_small
from curaspark.operators.graph import components
from curaspark.session import cut_lineage

SHINGLE = 3
BITS = 3
SEED = 42
SHARD = 20_000  # fingerprints that live in a shard, about
SAMPLE_PER_SHARD = 64
QUERIES_PER_TASK = 1_000_000
LEAF = 64  # points compared one by one at the end of a branch
_PAIRS_AT_ONCE = 1 << 20
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number. A bit is 1 if set in over half the hashes."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - shingle + 1, 1)
    spans = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_digest  # big-endian, so the highest bit comes first
    hashes = b"".join([digest(joined[a:b], seed) for a, b in spans])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last).view(">i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp): the fingerprint of every text."""
    return per_row(df, [key, text], lambda k, t: {key: k, "fp": fingerprint(t, shingle, seed)}, f"{key} {df.schema[key].dataType.simpleString()}, fp bigint")


# ---------------------------------------------------------------- trees


@dataclass(frozen=True)
class Node:
    """Points within ``median`` of the vantage point, on the bits of ``mask``, are in ``near``; the others in ``far``.

    ``near`` and ``far`` are nodes or shard numbers. A ball of ``radius`` that crosses the median overlaps both.
    """

    point: int
    mask: int
    radius: int
    median: int
    near: Node | int
    far: Node | int

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.bitwise_count((points ^ np.uint64(self.point)) & np.uint64(self.mask)).astype(np.int16)


def split(points: np.ndarray, masks: list[tuple[np.uint64, int]], tries: int = 4) -> tuple[int, int, int, int] | None:
    """(vantage point, mask, radius, median) that part the points best, or None if none leaves a fifth on either side.

    The masks are tried in order, so the wide one is used only where the narrow one fails.
    """
    for mask, radius in masks:
        best, even = None, 0.2
        for i in range(tries):
            point = points[(2 * i + 1) * len(points) // (2 * tries)]
            d = np.bitwise_count((points ^ point) & mask)
            median = int(np.median(d))
            for at in (median, median - 1):
                share = float((d <= at).mean())
                if min(share, 1 - share) > even:
                    best, even = (int(point), int(mask), radius, at), min(share, 1 - share)
        if best:
            return best
    return None


def masks_of(half: int, bits: int) -> list[tuple[np.uint64, int]]:
    return [(HALVES[half], bits // 2), (HALVES[1 - half], bits)]


def build(sample: np.ndarray, half: int, bits: int, leaf: int) -> tuple[Node | int, int]:
    """A tree whose leaves hold at most ``leaf`` points of the sample, where they can be told apart; the number of leaves."""
    count = 0

    def grow(points: np.ndarray, wide: int) -> Node | int:
        nonlocal count
        # the wide radius prunes little, so a branch may use it a few times only
        found = split(points, masks_of(half, bits)[: 2 if wide < 3 else 1]) if len(points) > leaf else None
        if not found:
            count += 1
            return count - 1
        point, mask, radius, median = found
        near = np.bitwise_count((points ^ np.uint64(point)) & np.uint64(mask)) <= median
        wide += radius == bits
        return Node(point, mask, radius, median, grow(points[near], wide), grow(points[~near], wide))

    return grow(sample, 0), count


def route(tree: Node | int, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, index of the points sent there, whether each lives there)."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, lives = stack.pop()
        if not len(at):
            continue
        if not isinstance(node, Node):
            yield node, at, lives
            continue
        d = node.distances(points[at])
        to_near, to_far, near = d - node.radius <= node.median, d + node.radius > node.median, d <= node.median
        stack.append((node.near, at[to_near], (lives & near)[to_near]))
        stack.append((node.far, at[to_far], (lives & ~near)[to_far]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each node and the smallest node of its component: as connected as the given ones, and fewer."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def search(points: np.ndarray, queries: np.ndarray, half: int, bits: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between queries and points that differ in at most ``bits`` bits."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(points, queries, 0)]
    while stack:
        p, q, wide = stack.pop()
        if not len(p) or not len(q):
            continue
        found = split(p, masks_of(half, bits)[: 2 if wide < 3 else 1]) if len(p) > leaf else None
        if found:
            point, mask, radius, median = found
            node = Node(point, mask, radius, median, 0, 0)
            dp, dq = node.distances(p), node.distances(q)
            wide += radius == bits
            stack.append((p[dp <= median], q[dq - radius <= median], wide))
            stack.append((p[dp > median], q[dq + radius > median], wide))
            continue
        step = max(1, _PAIRS_AT_ONCE // len(p))
        for i in range(0, len(q), step):
            near = np.bitwise_count(q[i : i + step, None] ^ p[None, :]) <= bits
            near &= q[i : i + step, None] < p[None, :]  # the other order is found from the other side
            x, y = np.nonzero(near)
            if len(x):
                kept.append((q[i : i + step][x], p[y]))
                held += len(x)
                if held > _PAIRS_AT_ONCE:
                    kept = [forest(*map(np.concatenate, zip(*kept)))]
                    held = len(kept[0][0])
    if not kept:
        return points[:0], points[:0]
    return forest(*map(np.concatenate, zip(*kept)))


# ---------------------------------------------------------------- links and components


def near_links(nodes: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """(fp) of distinct fingerprints -> (a, b): links that connect what differs in at most ``bits`` bits."""
    spark = nodes.sparkSession
    n = nodes.count()
    shards = max(1, math.ceil(n / shard))
    most = SAMPLE_PER_SHARD * shards
    # a hash picks the sample, so that it is the same one whenever it is read
    share = min(1.0, 2 * most / max(n, 1))
    picked = nodes.filter(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64(F.lit(1), "fp")).limit(most)
    sample = np.array([r["fp"] for r in picked.collect()], np.int64).view(np.uint64) if shards > 1 else np.zeros(0, np.uint64)
    trees = [build(sample, half, bits, max(1, len(sample) // shards))[0] for half in (0, 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for half in (0, 1):
                for to, at, lives in route(trees[half], points):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), 2 * to + half, np.int64)), pa.array(points[at].view(np.int64)), pa.array(lives)], ["shard", "fp", "lives"]
                    )

    dealt = cut_lineage(nodes.select("fp").mapInArrow(deal, "shard bigint, fp bigint, lives boolean"))
    # a shard's queries are split so that no task gets too many; the points that live there go to each part
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).alias("parts")).filter("parts > 1")
    parts = {r["shard"]: r["parts"] for r in sizes.collect()}  # shards beyond the size only
    if parts:
        table = spark.createDataFrame(list(parts.items()), "shard bigint, parts bigint")
        dealt = dealt.join(table, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        dealt = dealt.withColumn("parts", F.lit(1).cast("bigint"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    queries = dealt.select("shard", "fp", own.alias("part"), F.lit(False).alias("lives"))
    points = dealt.filter("lives").select("shard", "fp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "lives")

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fp, lives = rows["fp"].to_numpy().view(np.uint64), rows["lives"].to_numpy()
        a, b = search(np.sort(fp[lives]), np.sort(fp[~lives]), int(rows["shard"].iloc[0]) % 2, bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return queries.unionByName(points).groupBy("shard", "part").applyInPandas(links, "a bigint, b bigint")


def near_components(prints: DataFrame, key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(key, fp) -> (fp, component, least_fp): of every distinct fingerprint, the smallest identifier reachable.

    ``least_fp`` is the smallest fingerprint (as a signed number) that has this identifier in the component.
    """
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("rep")))
    links = cut_lineage(near_links(nodes, bits).distinct())
    if links.isEmpty():
        return nodes.select("fp", F.col("rep").alias("component"), F.col("fp").alias("least_fp"))
    groups = components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    grouped = nodes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a null identifier comes last, so it names a component only if there is no other
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "fp")).alias("least"))
    return grouped.join(least, "root").select("fp", F.col("least.rep").alias("component"), F.col("least.fp").alias("least_fp"))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(key, fp, component): one row per row of ``df``."""
    prints = cut_lineage(fingerprints(df, key, text, shingle))
    named = near_components(prints, key, bits)
    return prints.join(named, "fp").select(key, "fp", "component")


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest identifier.

    Of rows that repeat this identifier within the component, the one with the smallest fingerprint stays, and of
    those that also share it, any one.
    """
    prints = cut_lineage(fingerprints(df, key, text, shingle))
    named = prints.join(near_components(prints, key, bits), "fp")
    stays = F.col(key).eqNullSafe(F.col("component")) & (F.col("fp") == F.col("least_fp"))
    by_id = cut_lineage(named.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__rows"), F.count_if(stays).alias("__stay")))
    same = df[key].eqNullSafe(by_id["__key"])
    once = df.join(sent_if_small(by_id.filter("__stay = 0 OR __rows > 1")), same, "left_anti")
    repeated = by_id.filter("__stay > 0 AND __rows > 1")
    if repeated.isEmpty():
        return once
    # identifiers that occur more than once: their rows are told apart by fingerprint
    rows = cut_lineage(df.join(repeated, same, "left_semi").withColumn("__row", F.monotonically_increasing_id()))
    left = fingerprints(rows, "__row", text, shingle).join(rows.select("__row", F.col(key).alias("__key")), "__row")
    keep = named.filter(stays).select(F.col(key).alias("k"), F.col("fp").alias("f")).distinct()
    left = left.join(keep, left["__key"].eqNullSafe(keep["k"]) & (left["fp"] == keep["f"]), "left_semi").groupBy("__key", "fp").agg(F.min("__row").alias("__row"))
    return once.unionByName(rows.join(left.select("__row"), "__row", "left_semi").drop("__row"))
