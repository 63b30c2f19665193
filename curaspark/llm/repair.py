"""Repair of conversation structure: the cheapest edits that make the roles of a conversation ``(system? (user assistant)+)?``.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, then by text, both by their UTF-8 bytes). The
first fault of a row counts: ``blank`` (nothing but white space), ``duplicate`` (role and text seen earlier), ``truncated``
(the last character that is no white space is none of ``.!?``). A row is kept at cost 0 if its role's initial fits, given the role user or assistant
at 2, or deleted at 3, which blank and duplicate rows must be; an empty turn of user or assistant is inserted anywhere at 2. A
truncated row that stays adds 1. Of the cheapest ways the one whose initials (Delete, Insert, Keep, Rerole) come first in ASCII is taken.

What follows a row depends on nothing before it but the grammar state, so conversations reduce to one letter a row for role and fault,
and equal suffixes share their nodes: the distinct letter strings of the whole table are sorted from their ends, and a task
that walks them in that order builds the suffix-shared automaton node by node. Cost-to-go and best edit of the four grammar states are worked
out once per node; an audit is read off the path from a conversation's first node. At most one path per range of the sort is walked twice.
The strings are one byte a row and built from blocks of ``BLOCK`` rows; counts of faults are read off them as well.

Edits are then carried out in a stream over the rows, sorted by conversation and position behind a row that brings the audit. A conversation's
audit is in memory, as it is a value of the result; its rows are not.

A null role or text counts as one space. A null identifier is a conversation of its own, and a null turn comes first. Repeated
rows are duplicates of the first. Conversations whose rows all go keep an empty audit or one of deletions, and no turns. An empty table gives
empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.operators.groups import attach
from curaspark.operators.position import with_position
from curaspark.session import cut_lineage, release

BLOCK = 4096  # rows of a conversation that are put together at once
SPACE = " \t\n\x0b\x0c\r"

# grammar states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state after a turn whose role may be chosen, and the role that then is the only one to fit.
CHOSEN = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: The state after a row that keeps its role, by the role's initial.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters of a row: four to an initial (s, u, a, another), for no fault, blank, duplicate, truncated.
LETTERS = "abcdefghijklmnop"
DELETED = "x"  # a row that must go, whatever its role

#: What is left to pay at the end of a conversation, and the edit to take there.
END = ((0, 2 * INSERT, INSERT, 0), ("", "I", "I", ""))


# ---------------------------------------------------------------- the automaton


def node(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost-to-go and best edit by state of a node whose row has this letter and whose successor has these costs."""
    best: list[tuple[int, str]] = []
    for state in STATES:
        ways = [(DELETE + after[state], "D")]
        if letter != DELETED:
            initial, late = "suao"[LETTERS.index(letter) // 4], TRUNCATED * (LETTERS.index(letter) % 4 == 3)
            ways.append((REROLE + late + after[CHOSEN[state][0]], "R"))
            if state in KEPT[initial]:
                ways.append((late + after[KEPT[initial][state]], "K"))
        best.append(min(ways))
    costs = [c for c, _ in best]
    for _ in range(2):  # two insertions lead back to the same state
        costs = [min(c, INSERT + costs[CHOSEN[s][0]]) for s, c in enumerate(costs)]
    edits = []
    for state in STATES:
        inserted = INSERT + costs[CHOSEN[state][0]] == costs[state]
        edit = best[state][1] if best[state][0] == costs[state] else "I"
        edits.append(min(edit, "I") if inserted else edit)
    return tuple(costs), tuple(edits)


class SuffixAutomaton:
    """The nodes of a path from the end, shared with the next path as far as their suffixes agree.

    Costs are kept relative to the least of a node, so few distinct (letter, costs) pairs occur and each is solved once.
    """

    def __init__(self) -> None:
        self.word = ""
        self.nodes: list[tuple[tuple[int, ...], tuple[str, ...], int]] = [(*END, 0)]
        self.solved: dict[tuple[str, tuple[int, ...]], tuple[tuple[int, ...], tuple[str, ...], int]] = {}
        self.built = 0

    def audit(self, backwards: str) -> tuple[int, str]:
        """Cost and edits of a letter string that is given from its end."""
        shared = len(commonprefix([self.word, backwards]))
        del self.nodes[shared + 1 :]
        for letter in backwards[shared:]:
            costs, _, base = self.nodes[-1]
            key = (letter, costs)
            if key not in self.solved:
                total, edits = node(letter, costs)
                least = min(total)
                self.solved[key] = (tuple(c - least for c in total), edits, least)
            relative, edits, least = self.solved[key]
            self.nodes.append((relative, edits, base + least))
            self.built += 1
        self.word = backwards
        at, state, out = len(backwards), START, []
        while edit := self.nodes[at][1][state]:
            out.append(edit)
            if edit == "K":
                state = KEPT["suao"[LETTERS.index(backwards[at - 1]) // 4]][state]
            elif edit != "D":
                state = CHOSEN[state][0]
            at -= edit != "I"
        return self.nodes[-1][2] + self.nodes[-1][0][START], "".join(out)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    for batch in batches:
        words = batch["backwards"].to_pylist()
        costs, audits = zip(*map(automaton.audit, words)) if words else ((), ())
        yield pa.RecordBatch.from_pydict({"backwards": words, "cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string())})


# ---------------------------------------------------------------- tables


def ordered_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, letter, again, pos): rows in order, equal ones as one row that counts them.

    ``letter`` is that of the first, ``again`` that of its ``n - 1`` copies.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role, text).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(rows.withColumn("digest", F.sha2("text", 256)))
    said = ["conv_id", "role", "digest"]
    first = rows.groupBy(*said).agg(F.min(F.struct("turn")).alias("first"))  # a null turn is the earliest
    rows = attach(rows, first, said, "inner")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    blank = trimmed == ""
    whole = F.substring(trimmed, -1, 1).isin(".", "!", "?")
    fault = F.when(blank, 1).when(~F.struct("turn").eqNullSafe(F.col("first")), 2).when(~whole, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    row = 4 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)

    def letter(f: Column) -> Column:
        return F.substring(F.lit(LETTERS), row + f + 1, F.lit(1))

    rows = rows.select("conv_id", "turn", "role", "text", "n", letter(fault).alias("letter"), letter(F.when(blank, 1).otherwise(2)).alias("again"))
    return with_position(rows, ["conv_id", "turn", "role", "text"]).rows


def letter_strings(rows: DataFrame) -> DataFrame:
    """(conv_id, letters): one letter a row, in order."""
    piece = F.concat("letter", F.repeat("again", (F.col("n") - 1).cast("int"))).alias("piece")
    for columns, at in (([F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")], "pos"), ([], "block")):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at), piece))), lambda x: x["piece"]), "")
        rows = rows.groupBy("conv_id", *columns).agg(joined.alias("piece"))
        piece = F.col("piece")
    return rows.withColumnRenamed("piece", "letters")


def audited(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of conversations with rows."""
    strings = cut_lineage(letter_strings(rows).withColumn("backwards", F.reverse(F.translate("letters", "bcfgjkno", DELETED * 8))))
    distinct = strings.select("backwards").distinct()
    solved = distinct.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(_audits, "backwards string, cost bigint, audit string")

    def count(pattern: str) -> Column:
        return F.regexp_count("letters", F.lit(pattern)).cast("bigint")

    legal = count("[a-d](?=[e-h])|[e-h](?=[i-l])|[i-l](?=[e-h])")
    return strings.join(solved, "backwards").select(
        "conv_id",
        count("[bfjn]").alias("blank"),
        count("[cgko]").alias("duplicate"),
        count("[dhlp]").alias("truncated"),
        (F.length("letters") - 1 - legal).cast("bigint").alias("illegal"),
        "cost",
        "audit",
    )


@dataclass(frozen=True)
class Repaired:
    """``audits``: one row per conversation with rows. ``turns``: (conv_id, position, edit, role, text) of the repaired
    conversations, in order and a conversation whole within its partition."""

    audits: DataFrame
    turns: DataFrame


def repair(turns: DataFrame) -> Repaired:
    rows = cut_lineage(ordered_rows(turns))
    audits = cut_lineage(audited(rows))
    heads = audits.select("conv_id", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("n"))
    both = heads.unionByName(rows.select("conv_id", "pos", "role", "text", "n"))
    sorted_rows = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL("position bigint, edit string, role string, text string").fields])
    return Repaired(audits, sorted_rows.mapInArrow(_edits, schema))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carry out audits: a row at position -1 brings the audit of the rows that follow it."""
    audit, at, state, position, conv = "", 0, START, 0, None
    out: list[tuple] = []

    def add(edit: str, role: str, text: str) -> None:
        nonlocal position
        out.append((conv, position, edit, role, text))
        position += 1

    def inserted() -> None:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state, role = CHOSEN[state]
            add("I", role, "")
            at += 1

    def emitted(schema: pa.Schema) -> pa.RecordBatch:
        names = ["conv_id", "position", "edit", "role", "text"]
        columns = list(zip(*out)) if out else [()] * 5
        types = [schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    schema = None
    for batch in batches:
        schema = batch.schema
        for conv_id, pos, role, text, n in zip(*(batch[c].to_pylist() for c in ("conv_id", "pos", "role", "text", "n"))):
            if pos < 0:
                inserted()  # at the end of the conversation before
                conv, audit, at, state, position = conv_id, text, 0, START, 0
                continue
            for _ in range(n):
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    state = KEPT[role[0]][state]
                    add("K", role, text)
                elif edit == "R":
                    state, new = CHOSEN[state]
                    add("R", new, text)
        yield emitted(schema)
    if schema is not None:
        inserted()
        yield emitted(schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text`` lines of repaired turns, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        names = ["conv_id", "sha256"]
        kind = None
        for batch in batches:
            done = []
            kind = batch.schema.field("conv_id").type
            for conv_id, position, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "position", "role", "text"))):
                if position == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = conv_id, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            ids, found = zip(*done) if done else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string())], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([state.hexdigest()], pa.string())], names=names)

    return turns.mapInArrow(run, T.StructType([turns.schema["conv_id"], T.StructField("sha256", T.StringType())]))


def turn_gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between the first and the last; nulls are ignored."""
    distinct = turns.select("conv_id", "turn").distinct().groupBy("conv_id")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return distinct.agg(F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"))
