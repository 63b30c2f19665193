"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation several times, each snapshot one turn longer. Every turn is hashed with its position, and
the exclusive-or of the hashes of the first k turns identifies the prefix of length k; two independent 64-bit hashes make
128 bits. A conversation whose whole hash is a prefix of a longer one is a snapshot and goes, by an anti-join; of equal
conversations the smallest identifier stays, and counts its copies. What remains is rendered turn by turn, each piece with its
place in the rendered text, so that no conversation has to fit into one task.

Turns are ordered by number, then role, then text; a repeated row (same conversation, turn, role and text) counts once.
Only the order counts, not the numbers themselves. Null roles and texts are values of their own for the comparison, and
render as empty; a null conversation is a conversation and the smallest one; a null turn comes first. An empty table gives
an empty result. Other columns are ignored.

Prefix hashes are summed per chunk of turns first, so a conversation that holds a third of all rows is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curaspark.session import cut_lineage

CHUNK = 256  # turn numbers per chunk
#: What stands around the role and after the text of a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    """Hash of a turn at its position; xxhash64 skips nulls, so their place is hashed too."""
    return F.xxhash64(F.lit(seed), F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def prefix_hashes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, role, text, h1, h2): h1 and h2 identify the first ``position`` turns; positions count from 1."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    inner = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text")
    rows = cut_lineage(rows.withColumn("at", F.row_number().over(inner)))

    # positions before each chunk, then hashes before each chunk: a few rows per conversation
    outer = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("start"))
    placed = rows.join(starts, F.col("conv").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k"))).drop("c", "k")
    placed = placed.withColumn("position", F.col("start") + F.col("at")).withColumn("t1", _turn_hash(1)).withColumn("t2", _turn_hash(2))
    totals = placed.groupBy("conv", "chunk").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    zero = F.lit(0).cast("bigint")
    before = totals.select(
        F.col("conv").alias("c"),
        F.col("chunk").alias("k"),
        F.coalesce(F.bit_xor("x1").over(outer), zero).alias("b1"),
        F.coalesce(F.bit_xor("x2").over(outer), zero).alias("b2"),
    )
    upto = Window.partitionBy("conv", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed.join(before, F.col("conv").eqNullSafe(F.col("c")) & F.col("chunk").eqNullSafe(F.col("k")))
    h1, h2 = (F.col(f"b{i}").bitwiseXOR(F.bit_xor(f"t{i}").over(upto)) for i in (1, 2))
    return hashed.select("conv", "position", "role", "text", h1.alias("h1"), h2.alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies): conversations that no longer one begins with; the smallest of equal ones."""
    last = prefixes.groupBy("conv").agg(F.max(F.struct("position", "h1", "h2")).alias("l")).select("conv", "l.*")
    whole = last.groupBy("position", "h1", "h2").agg(F.min("conv").alias("conv"), F.count_if(F.col("conv").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n_copies"))
    longer = prefixes.join(last.select(F.col("conv").alias("c"), F.col("position").alias("n")), F.col("conv").eqNullSafe(F.col("c")))
    longer = longer.filter("position < n").select("position", "h1", "h2").distinct()
    kept = whole.join(longer, ["position", "h1", "h2"], "left_anti")
    conv = F.when(F.col("nulls") > 0, F.lit(None)).otherwise(F.col("conv"))
    return kept.select(conv.alias("conv"), F.col("position").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit(OPEN), F.coalesce(role, empty), F.lit(MIDDLE), F.coalesce(text, empty), F.lit(CLOSE))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, n_turns, n_copies, rendered): the turns of the maximal conversations, rendered, by position.

    The text of a conversation is its pieces joined in the order of ``position``.
    """
    prefixes = cut_lineage(prefix_hashes(df, conv, turn, role, text))
    kept = maximal(prefixes).withColumnRenamed("conv", "c")
    rows = prefixes.join(kept, F.col("conv").eqNullSafe(F.col("c")))
    return rows.select(F.col("conv").alias(conv), "position", "n_turns", "n_copies", rendered(F.col("role"), F.col("text")).alias("rendered"))
