"""User reward functions by name.

Kinds
-----
``column``        fn(inputs: dict[str, Column], **options) -> struct Column with ``overall``; stays in the JVM (preferred)
``batch``         fn(reward_inputs: list[dict], **options) -> list[dict]
``sequential``    fn(reward_input: dict, **options) -> dict
``legacy_batch``  fn(predicts, ground_truths, [questions, description_answers, images], **options) -> list[dict]

Inputs are response, response_length and ground_truth, and where the table has them question, description_answers and
images. Every score must hold ``overall``; further numbers become metrics. A ``batch`` or ``legacy_batch`` function gets
the rows of one batch at once, as the columns that name a batch tell, in the order asked for; a batch is what a trainer
scores in one call, so it fits into a task. A ``sequential`` function sees a row at a time, wherever the row lies.
"""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from curaspark.functions.prompts import images_or_image, question_or_prompt

KINDS = ("column", "batch", "sequential", "legacy_batch")
SCORE = "overall double, metrics map<string,double>"


@dataclass(frozen=True)
class Reward:
    name: str
    fn: Callable[..., Any]
    kind: str
    options: dict[str, Any] = field(default_factory=dict)


REWARDS: dict[str, Reward] = {}


def detect_kind(fn: Callable[..., Any]) -> str:
    """``batch`` when the first parameter is called reward_inputs, else the older list interface."""
    first = next(iter(inspect.signature(fn).parameters), "")
    return "batch" if first == "reward_inputs" else "legacy_batch"


def register_reward(name: str, fn: Callable[..., Any], kind: str | None = None, **options: Any) -> Reward:
    kind = kind or detect_kind(fn)
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; known: {KINDS}")
    REWARDS[name] = Reward(name, fn, kind, options)
    return REWARDS[name]


def load_reward(path: str, function: str = "compute_score", **options: Any) -> Reward:
    """Register a function of a Python file. REWARD_NAME and REWARD_TYPE of the file are honoured."""
    spec = importlib.util.spec_from_file_location("user_reward", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, function):
        raise AttributeError(f"{path} has no function {function}")
    # the file exists on this machine only: ship its functions by value
    import sys

    sys.modules["user_reward"] = module
    cloudpickle.register_pickle_by_value(module)
    return register_reward(getattr(module, "REWARD_NAME", "unknown"), getattr(module, function), getattr(module, "REWARD_TYPE", None), **options)


def _inputs(rows: DataFrame) -> dict[str, Column]:
    have = set(rows.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    length = F.col("response_length") if "response_length" in have else F.length("response")
    out = {"response": F.col("response"), "response_length": length, "ground_truth": F.col("ground_truth")}
    if have & {"question", "raw_prompt_text"}:
        out["question"] = question_or_prompt(col("question"), col("raw_prompt_text"))
    if "description_answers" in have:
        out["description_answers"] = F.col("description_answers")
    if have & {"images", "image"}:
        out["images"] = images_or_image(col("images"), col("image"))
    return out


def _lists(reward: Reward) -> list[tuple[str, str]]:
    """(parameter, input) of the further lists that a function of the list interface asks for."""
    wanted = set(inspect.signature(reward.fn).parameters)
    pairs = [("questions", "question"), ("question", "question"), ("description_answers", "description_answers"), ("images", "images"), ("image", "images")]
    return [(name, source) for name, source in pairs if name in wanted and not (name in ("question", "image") and f"{name}s" in wanted)]


def _checked(reward: Reward, scores: list[dict[str, float]], n: int) -> list[tuple[float, dict[str, float]]]:
    """(overall, metrics) of the scores of ``n`` rows."""
    if len(scores) != n:
        raise ValueError(f"reward {reward.name} gave {len(scores)} scores for {n} rows")
    if any("overall" not in s for s in scores):
        raise ValueError(f"reward {reward.name} gave a score without overall")
    return [(float(s["overall"]), {k: float(v) for k, v in s.items() if k != "overall"}) for s in scores]


def score_rows(rows: DataFrame, name: str, out: str = "reward", batch: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Add a struct (overall, metrics) with the scores of a registered reward.

    ``batch`` names the columns whose values make up a batch, ``order`` those that order the rows within; both are for
    rewards that see a whole batch, which are refused without ``batch``.
    """
    if name not in REWARDS:
        raise ValueError(f"unknown reward {name}; known: {sorted(REWARDS)}")
    reward = REWARDS[name]
    inputs = _inputs(rows)
    if reward.kind == "column":
        scored = rows.withColumn("__score", reward.fn(inputs, **reward.options))
        fields = scored.schema["__score"].dataType.names
        if "overall" not in fields:
            raise ValueError(f"reward {name} has no overall")
        numbers = [f.name for f in scored.schema["__score"].dataType if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name != "overall"]
        pairs = [x for n in numbers for x in (F.lit(n), F.col(f"__score.{n}").cast("double"))]
        metrics = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        return scored.withColumn(out, F.struct(F.col("__score.overall").cast("double").alias("overall"), metrics.alias("metrics"))).drop("__score")

    if reward.kind == "sequential":

        @F.pandas_udf(SCORE)
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                scores = [reward.fn(r, **reward.options) for r in pdf.to_dict("records")]
                yield pd.DataFrame(_checked(reward, scores, len(pdf)), columns=["overall", "metrics"])

        return rows.withColumn(out, run(F.struct(*[c.alias(k) for k, c in inputs.items()])))

    if not batch:
        raise ValueError(f"reward {name} sees a whole batch: name the columns that tell batches apart")

    return _score_batches(rows, reward, inputs, out, batch, order)


def _score_batches(rows: DataFrame, reward: Reward, inputs: dict[str, Column], out: str, batch: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Scores of a reward that sees whole batches: a worker takes many batches in one pass.

    Rows are dealt out and sorted by their batch. A worker cuts what it reads where a batch ends and carries an unfinished batch over
    to what it reads next, so the size of the transfer decides nothing. Only the inputs that the function asks for become Python values;
    an input that is a column of the rows travels once, and the other columns pass through as they came.
    """
    lists = _lists(reward) if reward.kind == "legacy_batch" else []
    asked = ["response", "ground_truth", *dict.fromkeys(source for _, source in lists)] if reward.kind == "legacy_batch" else list(inputs)
    width, own = len(rows.columns), {"response", "response_length", "ground_truth", "description_answers"}.intersection(rows.columns)
    more = {f"__in_{k}": inputs[k] for k in asked if k in inputs and k not in own}
    held_as = {k: f"__{rows.columns.index(k)}" if k in own else f"__in_{k}" for k in asked if k in inputs}
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch]))
    shaped = rows.withColumns({**more, "__batch": key})
    shaped = shaped.repartition("__batch").sortWithinPartitions("__batch", *order)
    # by number, for the way to Python takes no names with dots
    shaped = shaped.toDF(*[f"__{i}" for i in range(width)], *more, "__batch")

    def scored(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole batches, end to end."""
        table = pa.Table.from_batches(parts).combine_chunks()
        given = {k: _values(table[name].combine_chunks()) for k, name in held_as.items()}
        for k in asked:
            if k not in given:
                given[k] = [None if k == "images" else ""] * table.num_rows
        rest = {name: given[source] for name, source in lists}
        starts = _batch_starts(table["__batch"].combine_chunks())
        overall, names, values, ends = [], [], [], [0]
        for start, end in zip(starts, [*starts[1:], table.num_rows]):
            if reward.kind == "batch":
                scores = reward.fn([dict(zip(given, r)) for r in zip(*(v[start:end] for v in given.values()))], **reward.options)
            else:
                some = {name: v[start:end] for name, v in rest.items()}
                scores = reward.fn(given["response"][start:end], given["ground_truth"][start:end], **(reward.options | some))
            for number, metrics in _checked(reward, scores, end - start):
                overall.append(number)
                names += metrics.keys()
                values += metrics.values()
                ends.append(len(names))
        metrics = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.float64()))
        column = pa.StructArray.from_arrays([pa.array(overall, pa.float64()), metrics], ["overall", "metrics"])
        for piece in pa.Table.from_arrays([*table.columns[:width], column], names=[*table.column_names[:width], "__score"]).to_batches():
            yield piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for part in batches:
            if not part.num_rows:
                continue
            starts = _batch_starts(part["__batch"])
            if held and part["__batch"][0].as_py() != last:
                yield from scored(held)
                held = []
            if len(starts) > 1:
                yield from scored([*held, part.slice(0, starts[-1])])
                held = []
            held.append(part.slice(starts[-1]))
            last = part["__batch"][part.num_rows - 1].as_py()
        if held:
            yield from scored(held)

    schema = StructType([StructField(f"__{i}", f.dataType) for i, f in enumerate(rows.schema.fields)] + [StructField("__score", StructType.fromDDL(SCORE))])
    return shaped.mapInArrow(run, schema).toDF(*rows.columns, out)


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, which would make an array of every list first."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    inside, out, at = _values(column.flatten()), [], 0
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else inside[at : at + n])
        at += n or 0
    return out


def _batch_starts(keys: pa.Array) -> list[int]:
    """Where a new batch begins in a sorted column of batch names; names are never null."""
    changes = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(changes.nonzero()[0] + 1).tolist()]
