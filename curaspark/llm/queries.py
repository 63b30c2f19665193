"""The registered queries of this subpackage: thin, on whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.llm import chat, dedup, divergence, html_extract, lines, lm, mixing, packing, quality, repair, secret_scan, simhash, toxicity
from curaspark.llm.common import table
from curaspark.operators.groups import attach
from curaspark.session import cut_lineage

QueryFn = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers are installed, on the driver and on every executor alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = secret_scan.secret_report(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return report.select("doc_id", *map(counted, secret_scan.BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html_extract.extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    text = F.array_join("blocks", "\n\n")
    return blocks.select("page_id", "url", text.alias("text"), F.char_length(text).cast("bigint").alias("n_chars"))


def remainder(parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``: the folds of the labelled and of the language-model operators."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learned(documents, table(spark, sf_dir, "labels"), training=remainder(5) != 0)
    scores = toxicity.scored(documents, model)
    held_out = F.coalesce(remainder(5) == 0, F.lit(True))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.lm_scores(table(spark, sf_dir, "documents"), tokenizer_path(), training=remainder(7) != 2)
    held_out = F.coalesce(remainder(7) == 2, F.lit(True))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return times.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged_texts(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *base, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), F.round("quality", 9).alias("quality"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.col("keep_key").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of identifier and turn; nulls become one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    rows = conversations.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies)
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = cut_lineage(damaged(conversations))
    repaired = repair.repair(rows)
    out = conversations.select("conv_id").distinct()
    for more in (repair.turn_gaps(rows), repaired.audits, repair.digests(repaired.turns)):
        out = attach(out, more, ["conv_id"])
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.coalesce("audit", F.lit("")).alias("audit")
    return out.select("conv_id", *numbers, audit, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two halves; the second meets the filters of the first."""
    documents = table(spark, sf_dir, "documents")
    index = lines.LineIndex.create(spark)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for arrival in (0, 1):
        index.insert(documents.filter(half == arrival))
    kept = index.kept_lines(documents)
    result = cut_lineage(kept.select("doc_id", lines.n_lines(F.col("text")).alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256")))
    index.drop()
    return result


QUERIES: dict[str, QueryFn] = {
    f.__name__: f
    for f in (op1_best_fit_pack, op2_secret_scan, op3_html_extract, op4_toxicity, op5_simhash_groups, op6_lm_score, op7_chat_format, op8_mix_sources, op9_quality_rules, op10_exact_dedup, op11_conversation_repair, op12_source_divergence, op13_line_dedup)
}

_WORD = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    "op7_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        p AS (SELECT conv_id, role, text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
                     string_agg(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, ''), '|')
                       OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS prefix
              FROM t),
        n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM p),
        whole AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM n WHERE position = n_turns GROUP BY ALL),
        longer AS (SELECT DISTINCT prefix FROM n WHERE position < n_turns),
        kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM longer))
        SELECT n.conv_id, n.position, n.n_turns, n_copies,
               '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
        FROM n JOIN kept USING (conv_id)""",
    "op8_mix_sources": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
                          CAST('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS BIGINT) AS place FROM documents),
        z AS (SELECT source, sum(size)::HUGEINT AS z, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
        w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM z),
        o AS (SELECT *, row_number() OVER (ORDER BY 3 * z / w, rank) AS i,
                     coalesce(sum(3 * z) OVER (ORDER BY 3 * z / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
                     sum(w) OVER (ORDER BY 3 * z / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
                     sum(z) OVER () AS total FROM w),
        free AS (SELECT min(i) AS i FROM o WHERE 3 * z * share > w * (total - fixed)),
        level AS (SELECT total - fixed AS rest, share FROM o JOIN free USING (i)),
        t AS (SELECT source, z, CASE WHEN o.i < free.i THEN (3 * z)::DOUBLE ELSE (w * rest)::DOUBLE / level.share::DOUBLE END AS target FROM o, free, level),
        n AS (SELECT *, floor(target / z) AS whole, target - floor(target / z) * z AS need FROM t),
        g AS (SELECT source, place, sum(size) AS size FROM d WHERE size > 0 GROUP BY source, place),
        c AS (SELECT source, place, size, sum(size) OVER (PARTITION BY source ORDER BY place) - size / 2 AS middle FROM g),
        last AS (SELECT c.source, max(place) AS last FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE middle <= need GROUP BY c.source)
        SELECT doc_id, size, z::BIGINT AS source_size, target,
               (size * (whole + CASE WHEN place <= last THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN last ON d.source IS NOT DISTINCT FROM last.source""",
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY content) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY content) AS kept, sha256(content) AS text_sha256 FROM d""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
        raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       [4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations),
        hashed AS (SELECT raw.*, xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS k FROM raw, steps),
        damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                           CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
                    FROM hashed WHERE k <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                     row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
        f AS (SELECT conv_id, i, role, text, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS earlier, turn,
                     CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault FROM o),
        -- from the last row to the first: cheapest way on from each grammar state (nothing yet, after system, user, assistant) as cost, edits and lines
        go AS (SELECT conv_id, max(i) + 1 AS i, {'c': 0, 'e': '', 'l': ''} AS n, {'c': 4, 'e': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s,
                      {'c': 2, 'e': 'I', 'l': chr(10) || 'assistant:'} AS u, {'c': 0, 'e': '', 'l': ''} AS a FROM f GROUP BY conv_id
               UNION ALL
               SELECT conv_id, i, list_min([n, {'c': u2.c + 2, 'e': 'I' || u2.e, 'l': chr(10) || 'user:' || u2.l}]), list_min([s, {'c': u2.c + 2, 'e': 'I' || u2.e, 'l': chr(10) || 'user:' || u2.l}]), u2, a2
               FROM (SELECT *, list_min([u, {'c': a.c + 2, 'e': 'I' || a.e, 'l': chr(10) || 'assistant:' || a.l}]) AS u2, list_min([a, {'c': u.c + 2, 'e': 'I' || u.e, 'l': chr(10) || 'user:' || u.l}]) AS a2
                     FROM (SELECT conv_id, i,
                             list_min([{'c': n.c + 3, 'e': 'D' || n.e, 'l': n.l}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 2 + late, 'e': 'R' || u.e, 'l': chr(10) || 'user:' || text || u.l}] END
                               || CASE WHEN gone OR initial <> 's' THEN [] ELSE [{'c': s.c + late, 'e': 'K' || s.e, 'l': line || s.l}] END
                               || CASE WHEN gone OR initial <> 'u' THEN [] ELSE [{'c': u.c + late, 'e': 'K' || u.e, 'l': line || u.l}] END) AS n,
                             list_min([{'c': s.c + 3, 'e': 'D' || s.e, 'l': s.l}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 2 + late, 'e': 'R' || u.e, 'l': chr(10) || 'user:' || text || u.l}] END
                               || CASE WHEN gone OR initial <> 'u' THEN [] ELSE [{'c': u.c + late, 'e': 'K' || u.e, 'l': line || u.l}] END) AS s,
                             list_min([{'c': u.c + 3, 'e': 'D' || u.e, 'l': u.l}] || CASE WHEN gone THEN [] ELSE [{'c': a.c + 2 + late, 'e': 'R' || a.e, 'l': chr(10) || 'assistant:' || text || a.l}] END
                               || CASE WHEN gone OR initial <> 'a' THEN [] ELSE [{'c': a.c + late, 'e': 'K' || a.e, 'l': line || a.l}] END) AS u,
                             list_min([{'c': a.c + 3, 'e': 'D' || a.e, 'l': a.l}] || CASE WHEN gone THEN [] ELSE [{'c': u.c + 2 + late, 'e': 'R' || u.e, 'l': chr(10) || 'user:' || text || u.l}] END
                               || CASE WHEN gone OR initial <> 'u' THEN [] ELSE [{'c': u.c + late, 'e': 'K' || u.e, 'l': line || u.l}] END) AS a
                           FROM (SELECT f.conv_id, f.i, n, s, u, a, text, initial, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS late, chr(10) || role || ':' || text AS line
                                 FROM go JOIN f ON f.conv_id IS NOT DISTINCT FROM go.conv_id AND f.i = go.i - 1)))),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                          count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND coalesce(earlier, '') || coalesce(initial, '') NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(go.n.c, 0)::BIGINT AS cost, coalesce(go.n.e, '') AS audit, sha256(coalesce(substr(go.n.l, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
        LEFT JOIN go ON go.conv_id IS NOT DISTINCT FROM c.conv_id AND go.i = 1""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
        kc AS (SELECT lang, source, term, c.n FROM c JOIN k USING (lang, term)),
        g AS (SELECT d.lang, d.source, coalesce(any_value(t.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) d
              LEFT JOIN (SELECT lang, source, sum(n) AS n FROM kc GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(kc.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(kc.n, 0) + 2)) // (g.total + 2 * v.v) AS p,
                     1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
              FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN kc ON kc.lang = g.lang AND kc.source = g.source AND kc.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
        k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        shared AS (SELECT key, min(doc_id) AS keep FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM k LEFT JOIN shared USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY r, doc_id""",
}
