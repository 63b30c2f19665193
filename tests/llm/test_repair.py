"""Conversation repair against an exhaustive search in order of cost and edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from curaspark.llm import repair
from curaspark.llm.queries import damaged

BLANK = re.compile(r"[^\x20\x09-\x0D]")
FINE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """First fault of each (role, text) in order: b, d, t or nothing."""
    seen, out = set(), []
    for role, text in rows:
        marks = BLANK.findall(text)
        out.append("b" if not marks else "d" if (role, text) in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows):
    """(cost, edits, repaired rows): the first complete way in order of cost, then edits."""
    marks = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and FINE.fullmatch(initials):
            return cost, edits, list(out)
        if (i, initials) in done or not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        done.add((i, initials))
        if len(initials) < 2 * len(rows) + 3:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, edits + "I", i, initials + role[0], (*out, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, initials, out))
            if marks[i] not in ("b", "d"):
                late = marks[i] == "t"
                heapq.heappush(heap, (cost + late, edits + "K", i + 1, initials + (role[:1] if role[:1] in ("s", "u", "a") else "?"), (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + late, edits + "R", i + 1, initials + new[0], (*out, (new, text))))


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " ").encode(), (r[3] if r[3] is not None else " ").encode()))


def brute(rows):
    """{conv_id: (blank, duplicate, truncated, illegal, cost, audit, repaired)} of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in order([r for r in rows if r[0] == conv])]
        marks = faults(own)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(own, own[1:]))
        cost, audit, repaired = search(own)
        out[conv] = (marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, repaired)
    return out


def conversations(n, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "superuser", "User"]
    said = ["Fine.", "Well", "Yes!", "no ", "", " \n", None, "Ä?  ", "long " * 5 + "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(said)
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(roles), text if rng.random() < 0.4 or text is None else f"{turn} {text}"))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def check(spark, rows):
    got = repair.repair(spark.createDataFrame(rows, SCHEMA))
    audits = {r["conv_id"]: (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for r in got.audits.collect()}
    turns = {}
    for r in sorted(got.turns.collect(), key=lambda r: r["position"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    hashes = {r["conv_id"]: r["sha256"] for r in repair.digests(got.turns).collect()}
    want = brute(rows)
    assert audits == {c: w[:-1] for c, w in want.items()}
    assert turns == {c: w[-1] for c, w in want.items() if w[-1]}
    assert hashes == {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in w[-1]).encode()).hexdigest() for c, w in want.items() if w[-1]}


@pytest.mark.parametrize("block", [repair.BLOCK, 2])
def test_repairs_are_the_cheapest(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    check(spark, conversations(150, 1))


def test_odd_conversations(spark):
    """Null identifiers and turns, one row many times, only rows that must go, and a single row of each kind."""
    rows = [(None, 1, "user", "a."), (None, None, "assistant", "b"), (1, 0, "user", "x.")] + [(2, 5, "user", "same.")] * 40 + [(3, i, "user", " ") for i in range(4)]
    rows += [(10 + i, 0, role, text) for i, (role, text) in enumerate([("system", "s."), ("user", "u."), ("assistant", "a"), ("tool", "t."), (None, None)])]
    check(spark, rows)


def test_a_long_conversation(spark):
    """Several batches of rows and blocks of letters; the audit by the plain recursion over all rows."""
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant", "tool"]), f"{i}" + rng.choice([".", ""])) for i in range(25_000)]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA))
    audit = got.audits.first()
    letters = "".join(repair.LETTERS[4 * "uat".index(r[2][0]) + 4 + 3 * (not r[3].endswith("."))] for r in rows)
    cost = dict(zip(repair.STATES, (0, 4, 2, 0)))
    for x in reversed(letters):
        k = repair.LETTERS.index(x)
        new = {}
        for s in repair.STATES:
            ways = [cost[s] + 3, cost[repair.CHOSEN[s][0]] + 2 + (k % 4 == 3)]
            if s in repair.KEPT["suao"[k // 4]]:
                ways.append(cost[repair.KEPT["suao"[k // 4]][s]] + (k % 4 == 3))
            new[s] = min(ways)
        for _ in range(3):
            new = {s: min(c, 2 + new[repair.CHOSEN[s][0]]) for s, c in new.items()}
        cost = new
    assert audit["cost"] == cost[0]
    kept = [x for x in audit["audit"] if x != "D"]
    turns = got.turns.collect()
    assert len(turns) == len(kept) and re.fullmatch(r"s?(ua)*", "".join(r["role"][0] for r in turns))


def test_suffixes_are_built_once():
    words = sorted(w[::-1] for w in ("eie", "eieie", "aeie", "ieie", "eie"))
    automaton = repair.SuffixAutomaton()
    for w in words:
        automaton.audit(w)
    assert automaton.built == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_damage(spark):
    """The faults that are put in, against a plain version; and clashing columns, and empty tables."""
    rows = conversations(60, 3) + [(None, None, None, None), (None, 4, "user", "Hm?")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "pos", "letter", "block", "audit", "copy", "kind")})
    want = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    got = damaged(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert repair.repair(df).audits.count() == len({r[0] for r in rows})
    nothing = repair.repair(spark.createDataFrame([], SCHEMA))
    assert nothing.audits.count() == nothing.turns.count() == repair.digests(nothing.turns).count() == 0
    assert sorted(map(tuple, repair.turn_gaps(spark.createDataFrame([(1, 3, "", ""), (1, 7, "", ""), (1, 7, "", ""), (2, None, "", "")], SCHEMA)).collect())) == [(1, 3), (2, 0)]
