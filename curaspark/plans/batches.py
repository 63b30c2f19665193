"""Batch-shaping queries."""

from pyspark.sql import functions as F

from curaspark.functions.text import words
from curaspark.operators import batch as bt
from curaspark.operators import position as ps
from curaspark.operators.position import Positioned, with_position
from curaspark.plans.catalog import query
from curaspark.plans.rewards import rounded
from curaspark.plans.standins import table, view, with_views
from curaspark.session import cut_lineage

POSITIONED_SQL = "WITH n AS (SELECT COUNT(*) AS n FROM orders), p AS (SELECT o_orderkey, o_custkey, o_orderpriority, ROW_NUMBER() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders)\n"


def _batch(spark, sf) -> Positioned:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return with_position(orders, ["o_custkey", "o_orderkey"])


@query(
    "shard_assign",
    POSITIONED_SQL
    + """SELECT o_orderkey, pos, CAST(floor(pos / (floor(n / 8) + 1)) AS INT) AS contiguous, CAST(pos % 8 AS INT) AS strided,
                CAST(NTILE(8) OVER (ORDER BY pos) - 1 AS INT) AS balanced FROM p, n""",
)
def shard_assign(spark, sf):
    b = _batch(spark, sf)
    pos = F.col("pos")
    return b.rows.select(
        "o_orderkey",
        "pos",
        ps.contiguous_shard(pos, b.n, 8).alias("contiguous"),
        ps.strided_shard(pos, 8).alias("strided"),
        ps.balanced_shard(pos, b.n, 8).alias("balanced"),
    )


@query("head_fraction", POSITIONED_SQL + "SELECT o_orderkey, pos FROM p, n WHERE pos < GREATEST(1, floor(n * 0.37))")
def head_fraction(spark, sf):
    return bt.head_fraction(_batch(spark, sf), 0.37).select("o_orderkey", "pos")


@query(
    "batch_repeat",
    POSITIONED_SQL
    + """SELECT 'interleaved' AS form, o_orderkey, (pos * 3 + c)::BIGINT AS pos FROM p, range(3) t(c) UNION ALL SELECT 'tiled', o_orderkey, (c * n + pos)::BIGINT FROM p, n, range(3) t(c)""",
)
def batch_repeat(spark, sf):
    b = _batch(spark, sf)
    forms = [bt.repeat_rows(b, 3, inter).rows.select(F.lit(name).alias("form"), "o_orderkey", "pos") for name, inter in (("interleaved", True), ("tiled", False))]
    return bt.concat_rows(forms)


@query(
    "batch_pad",
    POSITIONED_SQL
    + """, s AS (SELECT n, (7 - n % 7) % 7 AS size FROM n)
    SELECT o_orderkey, pos, FALSE AS is_pad FROM p UNION ALL SELECT o_orderkey, pos + n, TRUE FROM p, s WHERE pos < size""",
)
def batch_pad(spark, sf):
    padded, _ = bt.pad_rows(_batch(spark, sf), 7)
    return padded.rows.select("o_orderkey", "pos", "is_pad")


@query(
    "batch_select",
    POSITIONED_SQL
    + """SELECT 'slice' AS form, o_orderkey AS order_id, pos FROM p, n WHERE pos >= 5 AND pos < n - 3 AND (pos - 5) % 4 = 0
         UNION ALL SELECT 'reorder', o_orderkey, n - 1 - pos FROM p, n
         UNION ALL SELECT 'index', o_orderkey, r FROM (SELECT doc_id AS i, ROW_NUMBER() OVER (ORDER BY doc_id) - 1 AS r FROM documents) JOIN p ON p.pos = i""",
)
def batch_select(spark, sf):
    b = _batch(spark, sf)
    popped, _ = bt.pop_columns(b.rows, ["o_orderkey", "pos", "no_such_column"])
    b = Positioned(bt.rename_columns(popped, ["o_orderkey"], ["order_id"]), b.n)
    everything = b.rows.select(F.col("pos").alias("index"), (F.lit(b.n - 1) - F.col("pos")).alias("order"))
    docs = with_position(table(spark, sf, "documents").select(F.col("doc_id").alias("index")), ["index"], out="order").rows
    return bt.concat_rows(
        [
            bt.slice_rows(b, 5, -3, 4).withColumn("form", F.lit("slice")),
            bt.select_rows(b, everything).withColumn("form", F.lit("reorder")),
            bt.select_rows(b, docs).withColumn("form", F.lit("index")),
        ]
    )


@query(
    "batch_fold",
    POSITIONED_SQL + "SELECT CAST(floor(pos / 5) AS BIGINT) AS pos, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY p.pos) AS o_orderkey, string_agg(o_orderpriority, ' ' ORDER BY p.pos) AS o_orderpriority FROM p GROUP BY floor(pos / 5)",
)
def batch_fold(spark, sf):
    b = _batch(spark, sf)
    folded = bt.fold_rows(b, b.n // 5, ["o_orderkey", "o_orderpriority"])
    keys = F.transform("o_orderkey", lambda k: k.cast("string"))
    return folded.select("pos", F.array_join(keys, " ").alias("o_orderkey"), F.array_join("o_orderpriority", " ").alias("o_orderpriority"))


@query(
    "batch_plan",
    POSITIONED_SQL
    + """, b AS (SELECT 16 * CAST(pow(2, floor(log2(n / 16.0))) AS BIGINT) AS clamped, n FROM n)
    SELECT o_orderkey, e::INT AS epoch, CAST(floor(k / 512) AS INT) AS batch, CAST(k % 512 AS INT) AS slot, clamped AS clamped_size
    FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders), b, range(2) t(e) WHERE floor(k / 512) < floor(n / 512)""",
)
def batch_plan(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    clamped = bt.clamp_batch_size(orders.count(), 10**9)
    return bt.plan_batches(orders, ["o_orderkey"], 512, epochs=2).withColumn("clamped_size", F.lit(clamped).cast("bigint"))


@query(
    "batch_plan_shuffled",
    """WITH h AS (SELECT o_orderkey, e, ROW_NUMBER() OVER (PARTITION BY e ORDER BY md5(CONCAT('42:', e, ':', o_orderkey)), o_orderkey) - 1 AS k FROM orders, range(2) t(e))
    SELECT o_orderkey, e::INT AS epoch, CAST(floor(k / 512) AS INT) AS batch, CAST(k % 512 AS INT) AS slot FROM h WHERE floor(k / 512) < (SELECT floor(COUNT(*) / 512) FROM orders)""",
)
def batch_plan_shuffled(spark, sf):
    return bt.plan_batches(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 512, epochs=2, seed=42)


@query(
    "batch_chunk",
    POSITIONED_SQL
    + """SELECT o_orderkey, CAST(floor(pos / (n / 10)) AS INT) AS chunk, CAST(floor(pos / 50) AS INT) AS split FROM p, n""",
)
def batch_chunk(spark, sf):
    b = _batch(spark, sf)
    chunked = bt.chunk_rows(b, 10)
    splits = bt.split_rows(Positioned(chunked.withColumnRenamed("chunk", "c"), b.n), 50)
    return splits.select("o_orderkey", F.col("c").alias("chunk"), F.col("chunk").alias("split"))


@query(
    "batch_union",
    "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders",
)
def batch_union(spark, sf):
    orders = table(spark, sf, "orders")
    left = orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    right = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return bt.union_columns(left, right, ["o_orderkey"])


LENGTH_SQL = (
    with_views("turns")
    + r""", l AS (SELECT rollout_id, len(regexp_extract_all(text, '[^\t-\r\x1c-\x20\x85\p{Z}]+')) AS length FROM turns),
ranked AS (SELECT rollout_id, length, ROW_NUMBER() OVER (ORDER BY length DESC, rollout_id) - 1 AS r, ROW_NUMBER() OVER (ORDER BY rollout_id) - 1 AS pos FROM l),
"""
)


def _dealt_sql(k: str) -> str:
    return f"dealt AS (SELECT rollout_id, length, pos, CASE WHEN floor(r / {k}) % 2 = 0 THEN r % {k} ELSE {k} - 1 - r % {k} END AS worker FROM ranked)"


def _lengths(spark, sf):
    return view(spark, sf, "turns", wide=True).select("rollout_id", F.size(words(F.col("text"))).cast("bigint").alias("length"))


@query("balance_assign", LENGTH_SQL + _dealt_sql("8") + " SELECT rollout_id, length, worker::INT AS worker FROM dealt")
def balance_assign(spark, sf):
    return bt.balance(cut_lineage(_lengths(spark, sf)), ["rollout_id"], "length", 8)


# rounds of eight rows, longest first; in a round whose lengths differ the longest row goes to the worker with the least
LEVEL_SQL = (
    LENGTH_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + """rounds AS (SELECT r // 8 AS t, list(length ORDER BY r) AS ls FROM ranked GROUP BY 1),
    go AS (SELECT -1::BIGINT AS t, list_transform(range(8), lambda w: {'s': 0::BIGINT, 'w': w}) AS sums, range(8) AS seats
        UNION ALL
        SELECT t, list_transform(range(1, 9), lambda i: {'s': (o[i].s + COALESCE(ls[i], 0))::BIGINT, 'w': o[i].w}), list_transform(o, lambda x: x.w)
        FROM (SELECT n.t, n.ls, CASE WHEN n.ls[1] = n.ls[8] THEN list_transform(list_sort(list_transform(sums, lambda x: {'w': x.w, 's': x.s})), lambda x: {'s': x.s, 'w': x.w}) ELSE list_sort(sums) END AS o
              FROM go JOIN rounds n ON n.t = go.t + 1)),
    dealt AS (SELECT rollout_id, length, pos, seats[r % 8 + 1] AS worker FROM ranked JOIN go ON go.t = r // 8)
    """
)


@query("balance_level", LEVEL_SQL + " SELECT rollout_id, length, worker::INT AS worker FROM dealt")
def balance_level(spark, sf):
    return bt.balance_level(cut_lineage(_lengths(spark, sf)), ["rollout_id"], "length", 8).select("rollout_id", "length", "worker")


@query(
    "balance_level_report",
    LEVEL_SQL
    + """, n AS (SELECT floor(COUNT(*) / 8) AS size FROM dealt), b AS (SELECT SUM(length) AS s FROM dealt, n GROUP BY floor(pos / size)), a AS (SELECT SUM(length) AS s FROM dealt GROUP BY worker)
    SELECT (SELECT MIN(s)::BIGINT FROM b) AS min, (SELECT MAX(s)::BIGINT FROM b) AS max, (SELECT (MAX(s) - MIN(s))::BIGINT FROM b) AS minmax_diff,
           (SELECT MIN(s)::BIGINT FROM a) AS balanced_min, (SELECT MAX(s)::BIGINT FROM a) AS balanced_max, (SELECT ROUND(SUM(s) / 8, 6) FROM b) AS mean""",
)
def balance_level_report(spark, sf):
    placed = with_position(cut_lineage(_lengths(spark, sf)), ["rollout_id"])
    balanced = bt.balance_level(placed.rows, ["rollout_id"], "length", 8)
    return rounded(bt.balance_report(Positioned(balanced, placed.n), "length", 8), "mean")


@query(
    "balance_report",
    LENGTH_SQL
    + _dealt_sql("8")
    + """, n AS (SELECT floor(COUNT(*) / 8) AS size FROM dealt), b AS (SELECT SUM(length) AS s FROM dealt, n GROUP BY floor(pos / size)), a AS (SELECT SUM(length) AS s FROM dealt GROUP BY worker)
    SELECT (SELECT MIN(s)::BIGINT FROM b) AS min, (SELECT MAX(s)::BIGINT FROM b) AS max, (SELECT (MAX(s) - MIN(s))::BIGINT FROM b) AS minmax_diff,
           (SELECT MIN(s)::BIGINT FROM a) AS balanced_min, (SELECT MAX(s)::BIGINT FROM a) AS balanced_max, (SELECT ROUND(SUM(s) / 8, 6) FROM b) AS mean""",
)
def balance_report(spark, sf):
    placed = with_position(cut_lineage(_lengths(spark, sf)), ["rollout_id"])
    balanced = bt.balance(placed.rows, ["rollout_id"], "length", 8)
    return rounded(bt.balance_report(Positioned(balanced, placed.n), "length", 8), "mean")


@query(
    "micro_batches",
    LENGTH_SQL.replace("ranked AS", "k AS (SELECT LEAST(COUNT(*), ceil(SUM(length) / 700))::BIGINT AS k FROM l),\nranked AS", 1)
    + _dealt_sql("k").replace("FROM ranked", "FROM ranked, k")
    + """, w AS (SELECT worker, SUM(length * length)::BIGINT AS workload FROM dealt GROUP BY worker),
    o AS (SELECT worker, workload, ROW_NUMBER() OVER (ORDER BY workload DESC, worker) - 1 AS micro_batch FROM w)
    SELECT rollout_id, length, pos, micro_batch, workload FROM dealt JOIN o USING (worker)""",
)
def micro_batches(spark, sf):
    placed = with_position(cut_lineage(_lengths(spark, sf)), ["rollout_id"])
    return bt.micro_batches(placed.rows, ["rollout_id"], "length", 700).orderBy("pos")


@query("batch_unpad", POSITIONED_SQL + "SELECT o_orderkey, pos FROM p")
def batch_unpad(spark, sf):
    """Padded and taken back."""
    padded, _ = bt.pad_rows(_batch(spark, sf), 7)
    return bt.unpad_rows(padded.rows).select("o_orderkey", "pos")
