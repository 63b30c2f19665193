"""Quality of texts by weak supervision.

Every rule looks at one measure of a text and votes good, bad, or abstains. How far a vote can be trusted is not set by
hand: texts are counted by their pattern of votes (at most 3 ** rules patterns, whatever the number of texts), and
expectation-maximisation over these counts estimates, for each rule, how it votes on good and on bad texts. The posterior
probability of a good text then replaces a filter that wants every rule passed.

Null and empty texts have all measures zero and only abstentions; their posterior is the prior. Texts are measured whole,
rows where they lie; repeated rows count and repeat. An empty table has no pattern, and no row to judge.
"""

from __future__ import annotations

import json
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.llm.common import per_row
from curaspark.session import cut_lineage

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
_SYMBOL_WORD = re.compile(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\Z)")
_ASCII_UPPER, _ASCII_LETTERS = string.ascii_uppercase.encode(), string.ascii_letters.encode()

# Common function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "the and of to in is that it for was on are with as be at by this from or an"
        " der die und das von zu den mit ist im des ein nicht sich als auch dem eine für auf"
        " le la et les des en un une est que dans qui pour sur pas au par du avec"
        " el los del las por con para una se su al lo como más es y"
    ).split()
)

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, n_same_words bigint, n_symbol_words bigint, n_letters bigint, n_upper bigint, n_bangs bigint, n_function_words bigint"


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, its first place included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def measures(text: str | None) -> dict[str, int]:
    """What the rules look at, of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "n_same_words": sum(map(bytes.__eq__, words, words[1:])),
        "n_symbol_words": len(_SYMBOL_WORD.findall(text)),
        "n_letters": len(raw) - len(raw.translate(None, _ASCII_LETTERS)),
        "n_upper": len(raw) - len(raw.translate(None, _ASCII_UPPER)),
        "n_bangs": text.count("!"),
        "n_function_words": len(FUNCTION_WORDS.intersection(w.lower() for w in words)),
    }


def measured(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures): one row per text."""
    return per_row(df, [key, text], lambda k, t: {key: k, **measures(t)}, f"{key} {df.schema[key].dataType.simpleString()}, {MEASURES}")


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` holds, and abstains elsewhere; SQL over the measures."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0).cast("int")


RULES = (
    Rule("symbols", "word_chars > 0 AND n_symbols <= 0.03 * word_chars", "n_symbols > 0.08 * word_chars"),
    Rule("symbol_words", "n_words > 0 AND n_symbol_words <= 0.03 * n_words", "n_symbol_words > 0.15 * n_words"),
    Rule("capitals", "n_letters > 0 AND n_upper <= 0.2 * n_letters", "n_letters >= 20 AND n_upper > 0.5 * n_letters"),
    Rule("exclamation", "n_words > 0 AND n_bangs <= 0.1 * n_words", "n_bangs > 0.3 * n_words"),
    Rule("repeated_windows", "n_words >= 10 AND n_repeat_words <= 0.1 * n_words", "n_repeat_words > 0.45 * n_words"),
    Rule("repeated_lines", "n_lines >= 2 AND n_dup_lines <= 0.1 * n_lines", "n_dup_lines >= 2 AND n_dup_lines > 0.3 * n_lines"),
    Rule("stutter", "n_words >= 10 AND n_same_words <= 0.05 * n_words", "n_same_words > 0.2 * n_words"),
    Rule("function_words", "n_function_words >= 2", "n_words >= 30 AND n_function_words = 0"),
    Rule("word_length", "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
)

# ---------------------------------------------------------------- label model


@dataclass(frozen=True)
class LabelModel:
    """Share of good texts, and for each rule how it votes on bad and on good texts when it does not abstain."""

    prior: float
    votes: np.ndarray  # [rule, class (bad, good), vote + 1]; abstentions stand as 1

    def accuracy(self) -> list[float]:
        """Probability that a rule is right when it votes."""
        share = np.array([1 - self.prior, self.prior])
        right = self.votes[:, 0, 0] * share[0] + self.votes[:, 1, 2] * share[1]
        return [float(x) for x in right]

    def log_odds(self) -> tuple[float, np.ndarray]:
        """Log odds of a good text before any vote, and what each vote adds; an abstention adds nothing."""
        odds = np.log(self.votes[:, 1] / self.votes[:, 0])
        odds[:, 1] = 0.0
        return float(np.log(self.prior / (1 - self.prior))), odds


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, smoothing: float = 1.0) -> LabelModel:
    """Expectation-maximisation over vote patterns [pattern, rule] and how many texts show each.

    It starts from the belief that a text with any bad vote is rather bad, which also settles which of the two classes is
    the bad one, and stays proper by ``smoothing`` texts per vote and class. No rule may be read against its meaning: a
    bad vote never speaks for a good text and a good vote never for a bad one.
    """
    counts = counts.astype(float)
    bad_votes = (patterns == -1).sum(1)
    good = np.where(bad_votes == 0, 0.9, np.where(bad_votes == 1, 0.3, 0.1))
    onehot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    prior, votes = 0.5, np.ones((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = float((weight[1].sum() + smoothing) / (weight.sum() + 2 * smoothing))
        votes = np.einsum("cp,prv->rcv", weight, onehot) + smoothing
        votes[:, :, [0, 2]] /= votes[:, :, [0, 2]].sum(2, keepdims=True)  # among the votes cast
        votes[:, :, 1] = 1.0
        # votes read in their meaning only: pool both classes where the estimate says otherwise
        for v, sign in ((0, 1), (2, -1)):
            off = sign * (votes[:, 1, v] - votes[:, 0, v]) > 0
            votes[off, :, v] = votes[off, :, v].mean(1, keepdims=True)
        base, odds = LabelModel(prior, votes).log_odds()
        total = base + np.einsum("prv,rv->p", onehot, odds)
        good = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
    return LabelModel(prior, votes)


def vote_patterns(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of votes and their counts over all rows; at most 3 ** len(rules) of them reach the driver."""
    got = rows.groupBy(*[r.vote().alias(r.name) for r in rules]).count().collect()
    return np.array([list(x)[:-1] for x in got], dtype=int).reshape(-1, len(rules)), np.array([x["count"] for x in got])


def posterior(model: LabelModel, rules: tuple[Rule, ...] = RULES) -> Column:
    """Probability that a text is good, from its measures."""
    base, odds = model.log_odds()
    total = F.lit(base)
    for rule, table in zip(rules, odds.tolist()):
        total = total + F.get(F.from_json(F.lit(json.dumps(table)), "array<double>"), rule.vote() + 1)
    return 1 / (1 + F.exp(-total))


def judge(rows: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Measured rows with ``quality`` (posterior) and ``good`` (posterior of at least ``least``)."""
    patterns, counts = vote_patterns(rows, rules)
    if not len(counts):
        return rows.withColumn("quality", F.lit(0.0)).withColumn("good", F.lit(False))
    quality = posterior(fit_label_model(patterns, counts), rules)
    return rows.withColumn("quality", quality).withColumn("good", F.col("quality") >= least)


def judged_texts(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """(key, measures, quality, good) of every text. Measures are written once, counted for the fit, then judged."""
    return judge(cut_lineage(measured(df, key, text)), rules, least)
