"""Words, bytes and row batches shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word, as a regular expression both Java and Python read alike: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text as bytes, with A-Z in lower case and other letters as they are; a null text has none.

    ``bytes.split`` cuts at exactly the six white-space bytes that WORD leaves out.
    """
    return text.encode().lower().split() if text else []


def n_words(text: Column) -> Column:
    """Number of words of a text column, without Python; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


BROADCAST_ROWS = 1_000_000


def sent_if_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The small side of a join, broadcast if it has at most ``most`` rows of a few numbers; else the join shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_row(df: DataFrame, columns: list[str], fn: Callable[..., dict | list[dict]], schema: str) -> DataFrame:
    """``fn(*values of columns)`` of every row, run in Arrow batches by the tasks that hold the rows.

    ``fn`` returns the row(s) that ``schema`` names. Only the named columns reach Python. Nothing is shuffled, and a
    task holds one batch at a time.
    """
    types = _arrow_schema(schema)
    names = types.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                got = fn(*values)
                rows.extend(got) if isinstance(got, list) else rows.append(got)
            yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, schema=types)

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))
