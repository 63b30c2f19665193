"""Views that let the driver's tables stand in for the tables of a self-play loop.

Each text is plain SQL that Spark and DuckDB read alike, so one text feeds a query and its check. Curly brackets
name input tables; literal ones are doubled. Every view covers its whole table and whole texts.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from curaspark.sources.tables import read_table

VIEWS: dict[str, str] = {
    # one rollout per event, group = user
    "rollouts": """
        SELECT user_id AS uid, event_id AS rollout_id, CAST(event_id % 10 AS INT) AS step,
               ROUND(LEAST(value, 100.0) / 100.0, 6) AS overall, event_type AS kind
        FROM {events}""",
    # one solver answer per order line, in the notations a solver may choose; some are non-answers
    "answers": """
        SELECT l_orderkey AS question_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus AS part,
               CASE WHEN CAST(l_quantity AS INT) % 11 = 0 THEN 'N/A'
                    WHEN CAST(l_quantity AS INT) % 13 = 0 THEN CONCAT('no change ', CAST(CAST(l_quantity AS INT) AS VARCHAR(8)))
                    WHEN l_partkey % 19 = 0 THEN CONCAT('$', CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR(8)), '.00')
                    WHEN l_partkey % 23 = 0 THEN CONCAT(CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR(8)), '%')
                    WHEN l_partkey % 29 = 0 THEN CONCAT(CAST(CAST(l_quantity AS INT) % 4 * 3 AS VARCHAR(8)), '/3')
                    WHEN l_partkey % 31 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN '12,345' ELSE '12345.0' END
                    WHEN l_partkey % 37 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN '(1,2000)' ELSE '(12,000)' END
                    WHEN l_partkey % 41 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN '12345678901234567' ELSE '12345678901234568' END
                    WHEN l_partkey % 43 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN '0.0000000001' ELSE '-0.50' END
                    WHEN l_partkey % 47 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN '1.5e3' ELSE '2 1/2' END
                    WHEN CAST(l_quantity AS INT) % 2 = 0 THEN CONCAT(' ', CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR(8)))
                    WHEN CAST(l_quantity AS INT) % 5 = 0 THEN CONCAT(CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR(8)), '.0')
                    ELSE CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR(8)) END AS answer
        FROM {lineitem}""",
    # answers of an evaluated model and of the base
    "eval_records": """
        SELECT CASE WHEN l_returnflag = 'A' THEN 'base' WHEN l_returnflag = 'N' THEN 'solver_v1_step20' ELSE 'solver_v2_step20' END AS model,
               CASE WHEN l_suppkey % 12 < 3 THEN CONCAT('mmmu_pro_', CAST(l_suppkey % 12 AS VARCHAR(8)))
                    ELSE CONCAT('bench_', CAST(l_suppkey % 12 AS VARCHAR(8))) END AS dataset,
               l_orderkey AS item,
               CASE WHEN l_partkey % 17 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR(8)) END AS ground_truth,
               CASE WHEN l_partkey % 19 = 0 THEN 'no box here'
                    WHEN l_partkey % 5 = 0 THEN CONCAT('<think>x</think> ', CHR(92), 'boxed{{7}} then ', CHR(92), 'boxed{{ ', CAST(l_linenumber % 3 AS VARCHAR(8)), '. }}')
                    ELSE CONCAT('<think>x</think> ', CHR(92), 'boxed{{', CAST(l_linenumber % 3 AS VARCHAR(8)), '}}') END AS model_response
        FROM {lineitem}""",
    # whole documents wrapped in tags; every 7th one is malformed
    "raw_proposals": """
        SELECT doc_id AS proposal_id, CAST(doc_id % 10 AS INT) AS step,
               CONCAT('<content_type>', CASE WHEN doc_id % 3 = 0 THEN 'data chart' WHEN doc_id % 3 = 1 THEN 'Geometry' ELSE 'nonsense' END, '</content_type>',
                      '< caption >', text, '</caption><easy_question>What is q', CAST(doc_id AS VARCHAR(12)), '?</easy_question><easy_answer>',
                      CAST(n_chars % 4 AS VARCHAR(8)), '</easy_answer>',
                      CASE WHEN doc_id % 7 = 0 THEN ''
                           ELSE CONCAT('<hard_question>Which of the sources of ', lang, ' is ', source, '?</hard_question> <hard_answer>1</hard_answer>') END) AS response
        FROM {documents}""",
    # the same documents with the looser notations a model may produce
    "loose_proposals": """
        SELECT doc_id AS proposal_id,
               CASE WHEN doc_id % 5 = 0 THEN CONCAT('<Caption>', text, '</Caption><easy_question>q', CAST(doc_id AS VARCHAR(12)), '</easy_question><easy_answer>4</easy_answer><content_type>map</content_type>')
                    WHEN doc_id % 5 = 1 THEN CONCAT('<caption>', text, CHR(10), '<easy_question>open q', CHR(10), '<easy_answer> 7 <hard_question>h')
                    WHEN doc_id % 5 = 2 THEN CONCAT('CAPTION: ', text, CHR(10), '  easy_question : label q', CHR(10), 'easy_answer:5', CHR(10), 'hard_answer: <6>', CHR(10), 'content_type: Data Chart')
                    WHEN doc_id % 5 = 3 THEN CONCAT('caption: <', text, '>', CHR(10), 'easy_question: <bracket q>', CHR(10), 'easy_answer: < 8 >')
                    ELSE text END AS response
        FROM {documents}""",
    # rendered proposals: four code samples each, some fail
    "code_samples": """
        SELECT o_orderkey AS proposal_id, l_linenumber AS sample_id, l_partkey, l_suppkey, l_extendedprice,
               CAST(l_quantity AS INT) % 3 <> 0 AS is_rendered
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # consistency columns per question
    "evaluated": """
        SELECT o_orderkey AS question_id, CONCAT('q', CAST(o_orderkey AS VARCHAR(20))) AS question,
               CASE WHEN o_orderkey % 17 = 0 THEN 'None' WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(o_orderkey % 5 AS VARCHAR(8)) END AS answer,
               CAST(o_custkey % 21 AS DOUBLE) / 20 AS score,
               CAST(o_custkey % 11 AS DOUBLE) / 10 AS easy_consistency, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS hard_consistency,
               CONCAT(CASE WHEN o_orderkey % 3 = 0 THEN 'data:image/png;base64,' ELSE '' END,
                      REPEAT('x', CAST(CASE WHEN o_orderkey % 13 = 0 THEN 50 WHEN o_orderkey % 7 = 0 THEN 120 ELSE 250 END AS INT))) AS image,
               o_orderpriority AS question_type
        FROM {orders}""",
    # code answers: the fences and code styles a model may produce, around the whole text of a page
    "code_responses": """
        SELECT page_id AS response_id, CAST(page_id % 10 AS INT) AS step,
               CASE WHEN page_id % 8 = 0 THEN CONCAT('Here:', CHR(10), '```svg', CHR(10), '<svg>', html, '</svg>', CHR(10), '```')
                    WHEN page_id % 8 = 1 THEN CONCAT('```xml', CHR(10), '<SVG>', html, '</SVG>', CHR(10), '```')
                    WHEN page_id % 8 = 2 THEN CONCAT('```xml', CHR(10), html, CHR(10), '``` <svg>', url, '</svg>')
                    WHEN page_id % 8 = 3 THEN CONCAT('text <Svg a="1">', html, '</sVG> tail')
                    WHEN page_id % 8 = 4 THEN CONCAT('```python', CHR(10), 'import plotly', CHR(10), 'x = """', html, '"""', CHR(10), '```')
                    WHEN page_id % 8 = 5 THEN CONCAT('import matplotlib', CHR(10), 'ax.bar(', url, ', bottom=b)')
                    WHEN page_id % 8 = 6 THEN CONCAT('from x import y', CHR(10), 'plt.hist(', CAST(page_id AS VARCHAR(12)), ')')
                    ELSE html END AS response
        FROM {pages}""",
    # proposals, their code samples, and the solver's rollouts on the easy and on the hard question
    "proposal_rows": """
        SELECT o_orderkey AS proposal_id, CAST(o_orderkey % 10 AS INT) AS step, o_orderkey % 7 <> 0 AS format_ok,
               CASE WHEN o_orderkey % 10 < 3 THEN 'data_chart' WHEN o_orderkey % 10 = 9 AND o_custkey % 5 < 4 THEN 'geometry' WHEN o_orderpriority = '1-URGENT' THEN 'map'
                    WHEN o_orderkey % 10 < 6 AND o_custkey % 4 <> 0 THEN 'table' ELSE 'other' END AS content_type,
               CASE WHEN o_custkey % 9 = 0 THEN '' ELSE CAST(o_orderkey % 4 AS VARCHAR(8)) END AS easy_answer
        FROM {orders}""",
    "proposal_samples": """
        SELECT DISTINCT l_orderkey AS proposal_id, l_linenumber AS sample_id, (l_orderkey + l_linenumber) % 3 <> 0 AS is_rendered
        FROM {lineitem}""",
    "easy_rollouts": """
        SELECT l_orderkey AS proposal_id, l_linenumber AS sample_id, CAST(CAST(l_quantity AS INT) % 4 AS VARCHAR(8)) AS answer,
               l_linenumber, l_partkey, l_suppkey, l_extendedprice
        FROM {lineitem} WHERE l_linestatus = 'O'""",
    "hard_rollouts": """
        SELECT l_orderkey AS proposal_id, l_linenumber AS sample_id,
               CASE WHEN CAST(l_quantity AS INT) % 11 = 0 THEN 'N/A' ELSE CONCAT(CAST(CAST(l_quantity AS INT) % 3 AS VARCHAR(8)), ' ') END AS answer,
               l_linenumber, l_partkey, l_suppkey, l_extendedprice
        FROM {lineitem} WHERE l_linestatus <> 'O'""",
    # one rollout per conversation turn; the words of the turn are its tokens
    "turns": """
        SELECT conv_id AS uid, conv_id * 1000 + turn AS rollout_id, CAST(conv_id % 10 AS INT) AS step, turn, role, text
        FROM {conversations}""",
}


def answer_key_sql(answer: str) -> str:
    """The vote key of an answer of the stand-in tables, in the SQL of the comparison: the 'no ' class, numbers by value, texts."""
    plain = f"rtrim(regexp_replace(lower(trim({answer})), '[$%]', '', 'g'), '. ')"
    plain = f"CASE WHEN regexp_matches({plain}, '^[-+]?\\d{{1,3}}(,\\d{{3}})+$') THEN replace({plain}, ',', '') ELSE {plain} END"
    ratio = f"round(CAST(split_part({plain}, '/', 1) AS DOUBLE) / CAST(split_part({plain}, '/', 2) AS DOUBLE), 9)"
    return (
        f"CASE WHEN contains(lower({answer}), 'no ') THEN 'no' WHEN regexp_matches({plain}, '^[-+]?(\\d+(\\.\\d*)?|\\.\\d+)$') THEN CAST(CAST({plain} AS DECIMAL(38,12)) AS VARCHAR)"
        f" WHEN regexp_matches({plain}, '^\\d+/\\d+$') THEN CAST(CAST({ratio} AS DECIMAL(38,12)) AS VARCHAR) ELSE {plain} END"
    )


def _tables_of(text: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", wide)


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A stand-in view as a DataFrame over the parquet tables; ``wide`` for work that is heavy per row."""
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t, wide) for t in _tables_of(text)})


def with_views(*names: str) -> str:
    """The same views as a ``WITH`` list for the comparison SQL."""
    parts = []
    for name in names:
        text = VIEWS[name]
        parts.append(f"{name} AS ({text.format(**{t: t for t in _tables_of(text)})})")
    return "WITH " + ",\n".join(parts) + "\n"
