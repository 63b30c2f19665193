"""Extracting, normalising and comparing answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.text import SPACE, between, blank_to_null, collapse_spaces, cut, first_match, last_match, let, strip

BOXED = r"\\boxed\{([^}]*)\}"

# Answers that say nothing, compared in lower case.
NON_ANSWERS = ["", "none", "n/a", "na", "null", "unknown", "-"]

# Replacements applied to a quantitative answer, in this order.
MATH_SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]

# Expressions removed from a quantitative answer, in this order.
MATH_REMOVALS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots",
    "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds",
    "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!",
    "{,}", '"', "\\dots",
]

# Patterns for the choice index of an agent, in order of preference, after the action tag.
CHOICE_PATTERNS = [
    r"选择的?索引[:：]\s*(\d+)",
    r"索引[:：]\s*(\d+)",
    r"select\((\d+)\)",
    r"选择\s*(\d+)",
    r"第\s*(\d+)\s*个",
    r"answer[:：]\s*(\d+)",
    r"选项\s*([abc])",
]
CHOICE_ACTION = r"<action>select\((\d+)\)</action>"


def first_boxed(response: Column) -> Column:
    return strip(first_match(response, BOXED))


def last_boxed(response: Column) -> Column:
    return strip(last_match(response, BOXED))


def boxed_content(response: Column) -> Column:
    """Content of the last ``\\boxed{...}`` up to its own closing brace, ``None`` (the word) when there is none.

    The text after the last opening is split at closing braces; the box ends at the first closing brace that leaves as
    many openings as closings behind it.
    """
    opening = "\\boxed{"

    def nested(tail: Column) -> Column:
        pieces = F.split(tail, "\\}", -1)
        closed = F.slice(pieces, 1, F.size(pieces) - 1)  # the last piece has no closing brace
        start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("opened"), F.lit(-1).alias("end"))

        def step(acc, piece):
            opened = acc["opened"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
            end = F.when(acc["end"] >= 0, acc["end"]).when(opened == acc["seen"], acc["seen"]).otherwise(F.lit(-1))
            return F.struct((acc["seen"] + 1).alias("seen"), opened.alias("opened"), end.alias("end"))

        end = F.aggregate(closed, start, step)["end"]
        return let(end, lambda e: F.when(e >= 0, F.array_join(F.slice(pieces, 1, e + 1), "}")))

    def inside(tail: Column) -> Column:
        plain = F.substring_index(tail, "}", 1)
        simple = tail.contains("}") & ~plain.contains("{")
        return F.when(simple, plain).otherwise(nested(tail))

    found = F.when(response.contains(opening), let(F.substring_index(response, opening, -1), inside))
    return F.coalesce(strip(found), F.lit("None"))


def tag_or_whole(response: Column, tag: str) -> Column:
    """Inside of ``<tag>``, or the untouched text when the tag is missing."""
    return F.coalesce(strip(between(response, f"<{tag}>", f"</{tag}>")), response)


def normalize_answer(answer: Column) -> Column:
    return F.rtrim(F.lower(strip(answer)), F.lit("."))


def exact_match(response: Column, ground_truth: Column) -> Column:
    """Last boxed answer equals the ground truth after normalisation; false when either is empty."""
    same = normalize_answer(blank_to_null(last_match(response, BOXED))) == normalize_answer(ground_truth)
    return F.coalesce((ground_truth != "") & same, F.lit(False))


def answered(response: Column, ground_truth: Column) -> Column:
    return blank_to_null(last_match(response, BOXED)).isNotNull() & (F.coalesce(ground_truth, F.lit("")) != "")


def is_non_answer(answer: Column) -> Column:
    return answer.isNull() | F.lower(strip(answer)).isin(NON_ANSWERS)


def vote_text(answer: Column) -> Column:
    """Case and spacing folded, long answers cut at 120 characters."""
    return cut(F.lower(collapse_spaces(answer)), 120)


def canonical(answer: Column) -> Column:
    """One spelling per value: numbers, percentages, money and simple fractions meet on their numeric value.

    Numbers are compared by their digits, so long ones stay exact; fractions by nine decimals of their quotient. A comma
    between whole groups of three digits is dropped, but not inside brackets, where it parts the members of a tuple or
    an interval. Powers of ten (``1.5e3``) and mixed numbers (``2 1/2``) are texts, not numbers.
    """

    def digits_key(number: Column) -> Column:
        whole = F.regexp_extract(number, r"\A[-+]?0*(\d*)", 1)
        part = F.regexp_replace(F.regexp_extract(number, r"\.(\d*)\z", 1), r"0+\z", "")
        digits = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
        sign = F.when(number.startswith("-") & (digits != ""), F.lit("-")).otherwise(F.lit(""))
        return F.concat(F.lit("\x00n"), sign, F.when(digits == "", F.lit("0")).otherwise(digits))

    def without_signs(s: Column) -> Column:
        tuple_or_interval = s.rlike(r"[(\[].*,.*[)\]]")
        return F.when(tuple_or_interval, F.regexp_replace(s, r"[$%]", "")).otherwise(F.regexp_replace(s, r"[$%]|(?<=\d),(?=\d{3}(?!\d))", ""))

    plain = F.rtrim(let(F.lower(collapse_spaces(answer)), without_signs), F.lit(". "))
    plain = F.regexp_replace(F.ltrim(plain), r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")

    def value(s: Column) -> Column:
        ratio = F.regexp_extract_all(s, F.lit(r"[-+]?\d+(?:\.\d+)?"), 0)
        quotient = F.try_divide(F.get(ratio, F.lit(0)).try_cast("double"), F.get(ratio, F.lit(1)).try_cast("double"))
        number = F.when(s.rlike(r"\A[-+]?(\d+(\.\d*)?|\.\d+)\z"), s).when(
            s.rlike(r"\A[-+]?\d+(\.\d+)? ?/ ?[-+]?\d+(\.\d+)?\z"), F.round(quotient, 9).try_cast("decimal(38,9)").cast("string")
        )
        return F.coalesce(digits_key(number), s)

    # most answers are plain short numbers: settle those without the rewriting
    short = (F.length(answer) <= 20) & answer.rlike(r"\A *[-+]?\d+(\.\d+)? *\z")
    return F.when(short, digits_key(F.trim(answer))).otherwise(let(plain, value))


def same_answer(a: Column, b: Column) -> Column:
    """Equivalence by canonical form; a NULL or empty answer matches nothing."""
    ok = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return F.coalesce(ok & (canonical(a) == canonical(b)), F.lit(False))


def vote_key(answer: Column, fold: bool = True) -> Column:
    """Key under which answers count as one.

    All answers holding ``no `` (also inside a longer word) form one class. ``fold`` selects the service form, which
    cuts answers at 120 characters first; the offline form compares them whole.
    """
    text = vote_text(answer) if fold else answer
    says_no = F.lower(answer).contains("no ")
    return F.when(says_no, F.lit("\x00no")).otherwise(canonical(text))


def normalize_math(answer: Column) -> Column:
    """Normal form of a quantitative answer: the part after the last '=', units and TeX wrappers removed."""
    s = F.substring_index(answer, "=", -1)  # the whole text when there is no '='
    for old, new in MATH_SUBSTITUTIONS + [(r, "") for r in MATH_REMOVALS]:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, r"(?d)(.*?)\$(.*?)\$(.*)", r"\$$2\$")
    for macro in ("text", "textbf", "overline"):
        s = F.regexp_replace(s, rf"(?d)\\{macro}\{{(.*?)\}}", "$1")
    s = F.regexp_replace(s, r"(?d)\\boxed\{(.*)\}", "$1")
    s = F.regexp_replace(s, r"(?d)frac([^{])(.)", "frac{$1}{$2}")
    s = F.regexp_replace(s, r"sqrt([^{])", "sqrt{$1}")
    s = F.replace(s, F.lit("$"), F.lit(""))
    number = r"\A,*\d[\d,]*\z"
    return strip(let(s, lambda t: F.when(t.rlike(number), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)))


def last_answer_line(response: Column, tail: int = 300) -> Column:
    """Last ``Answer: ...`` within the final ``tail`` characters, else ``[INVALID]``."""
    end = F.when(F.length(response) > tail, F.substring(response, -tail, tail)).otherwise(response)
    return F.coalesce(last_match(end, rf"(?i)Answer{SPACE}*:{SPACE}*([^\n]+)"), F.lit("[INVALID]"))


def first_choice_digit(response: Column) -> Column:
    """First of the digits 0, 1, 2 in the text, '' when there is none."""
    return F.regexp_extract(response, "([012])", 1)


def choice_index(response: Column) -> Column:
    """Choice 0-2 of an agent: the action tag, then looser patterns; an index out of range tries the next pattern."""

    def index(pattern: str) -> Column:
        def number(found: Column) -> Column:
            return F.when(found.rlike("[a-c]"), F.ascii(found) - F.ascii(F.lit("a"))).otherwise(found.try_cast("int"))

        n = let(F.lower(first_match(response, f"(?iu){pattern}")), number)
        return let(n, lambda i: F.when(i.between(0, 2), i))

    return F.coalesce(*[index(p) for p in [CHOICE_ACTION] + CHOICE_PATTERNS])


def judged_correct(verdict: Column) -> Column:
    """First word of a judge's verdict starts with ``yes``."""
    return F.coalesce(F.lower(strip(verdict)).startswith("yes"), F.lit(False))


def answer_to_judge(extracted: Column, response: Column) -> Column:
    """The extracted answer, or the first 600 characters of the response."""
    return F.coalesce(blank_to_null(extracted), cut(strip(F.coalesce(response, F.lit(""))), 600))
