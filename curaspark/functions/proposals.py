"""Parsing the text of a proposal and of a code answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.rewards import tighten_tags
from curaspark.functions.text import SPACE, between, blank_to_null, first_match, let, strip

# Field names, content types and visual types.
REQUIRED_FIELDS = ["caption", "easy_question", "easy_answer", "hard_question", "hard_answer"]
CONTENT_TYPES = ["data_chart", "diagram", "geometry", "timeline", "map", "table", "other"]
VISUAL_TYPES = ["matplotlib", "plotly", "pillow", "svg"]

# Caption keywords per content type; the first type with a hit wins.
CAPTION_KEYWORDS = [
    ("diagram", ["flowchart", "flow chart", "network diagram", "org chart", "state diagram", "circuit diagram", "block diagram"]),
    ("data_chart", ["bar chart", "line chart", "pie chart", "scatter", "histogram", "area chart", "stacked", "heatmap", "treemap", "radar chart", "bubble chart"]),
    ("geometry", ["angle", "triangle", "circle", "radius", "coordinate", "geometry", "perpendicular", "chord", "polygon", "rectangle"]),
    ("timeline", ["timeline", "schedule", "gantt"]),
    ("map", ["map", "region", "geographic", "country"]),
    ("table", ["table", "grid", "comparison table"]),
]

# Words that tell the plotting library and the kind of chart, in order of preference.
PLOTLY_WORDS = ["import plotly", "plotly.", "go."]
PILLOW_WORDS = ["from pil", "import pil", "image.new", "image.draw", "image.open"]
CHART_WORDS = [
    ("mpl_stacked_area", ["stackplot", "fill_between", "stacked"]),
    ("mpl_bar", ["bar(", "barh("]),
    ("mpl_scatter", ["scatter("]),
    ("mpl_pie", ["pie("]),
    ("mpl_histogram", ["hist("]),
    ("mpl_heatmap", ["imshow(", "heatmap", "pcolormesh"]),
    ("mpl_contour", ["contour(", "contourf("]),
    ("mpl_polar", ["polar"]),
    ("mpl_line", ["plot("]),
]


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


def normalize_content_type(raw: Column) -> Column:
    return let(
        F.replace(F.lower(strip(raw)), F.lit(" "), F.lit("_")),
        lambda t: F.when(t.isin(CONTENT_TYPES), t).when(t == "datachart", F.lit("data_chart")).otherwise(F.lit("other")),
    )


def content_type_of_caption(caption: Column) -> Column:
    def kind(text: Column) -> Column:
        first, *rest = CAPTION_KEYWORDS
        out = F.when(contains_any(text, first[1]), F.lit(first[0]))
        for label, needles in rest:
            out = out.when(contains_any(text, needles), F.lit(label))
        return out.otherwise(F.lit("other"))

    return let(F.lower(caption), kind)


def resolve_content_type(tag: Column, caption: Column) -> Column:
    """The tag when it says something, else what the caption suggests."""
    return F.coalesce(F.nullif(normalize_content_type(tag), F.lit("other")), content_type_of_caption(caption))


def normalize_visual_type(raw: Column) -> Column:
    return let(F.lower(strip(raw)), lambda t: F.when(t.isin(VISUAL_TYPES), t).otherwise(F.lit("matplotlib")))


def parse_strict(response: Column) -> Column:
    """Struct of the proposal fields, NULL unless all five required tags are present."""
    def fields(clean: Column) -> Column:
        return F.struct(
            *[strip(between(clean, f"<{n}>", f"</{n}>")).alias(n) for n in [*REQUIRED_FIELDS, "content_type"]]
        )

    def proposal(f: Column) -> Column:
        complete = reduce(lambda a, b: a & b, (f[n].isNotNull() for n in REQUIRED_FIELDS))
        return F.when(
            complete,
            F.struct(
                F.lit("svg").alias("visual_type"),
                normalize_content_type(f["content_type"]).alias("content_type"),
                *[f[n].alias(n) for n in REQUIRED_FIELDS],
            ),
        )

    return let(let(tighten_tags(response), fields), proposal)


def loose_field(response: Column, name: str) -> Column:
    """Field in any of four notations; the first one with a non-blank value wins."""
    return F.coalesce(
        blank_to_null(first_match(response, rf"(?is)<{name}>(.*?)</{name}>")),
        blank_to_null(first_match(response, rf"(?is)<{name}>(.*?)(?:<[^/]|\n|\z)")),
        blank_to_null(first_match(response, rf"(?i)(?:\A|\n){SPACE}*{name}{SPACE}*:{SPACE}*([^\n<]+)")),
        blank_to_null(first_match(response, rf"(?i)(?:\A|\n){SPACE}*{name}{SPACE}*:{SPACE}*<([^>]+)>")),
    )


def parse_tolerant(response: Column) -> Column:
    """Struct of the proposal fields; an unparseable response is kept whole as its caption.

    ``parsed`` tells the two apart. Only caption, easy question and easy answer are required here.
    """
    fields = F.struct(*[loose_field(response, n).alias(n) for n in [*REQUIRED_FIELDS, "content_type"]])

    def proposal(f: Column) -> Column:
        parsed = f["caption"].isNotNull() & f["easy_question"].isNotNull() & f["easy_answer"].isNotNull()

        def value(name: str, fallback: Column) -> Column:
            return F.when(parsed, F.coalesce(f[name], F.lit(""))).otherwise(fallback).alias(name)

        return F.struct(
            parsed.alias("parsed"),
            F.lit("svg").alias("visual_type"),
            F.when(parsed, normalize_content_type(f["content_type"])).alias("content_type"),
            value("caption", response),
            *[value(name, F.lit("")) for name in REQUIRED_FIELDS[1:]],
        )

    return let(fields, proposal)


def _fence(response: Column, language: str) -> Column:
    return strip(first_match(response, rf"(?s)```{language}{SPACE}*\n(.*?)```"))


def _raw_svg(response: Column) -> Column:
    return strip(first_match(response, r"(?is)(<svg.*?</svg>)"))


def svg_block(response: Column) -> Column:
    """SVG of a code answer: svg fence, xml fence holding ``<svg``, raw markup, else ''."""
    xml = let(_fence(response, "xml"), lambda x: F.when(F.lower(x).contains("<svg"), x))
    return F.coalesce(_fence(response, "svg"), xml, _raw_svg(response), F.lit(""))


def code_block(response: Column, visual_type: Column) -> Column:
    """Code of an answer of any visual type: svg markup first for svg, then a python fence, then bare imports."""
    text = strip(response)
    bare = F.when(text.startswith("import ") | text.startswith("from "), text)
    svg = F.when(visual_type == "svg", F.coalesce(_fence(response, "svg"), _raw_svg(response)))
    return F.coalesce(svg, _fence(response, "(?:python)?"), bare, F.lit(""))


def is_svg(code: Column) -> Column:
    text = strip(code)
    return (text != "") & (text.startswith("<") | F.lower(code).contains("<svg"))


def visual_type_of_code(code: Column) -> Column:
    def kind(s: Column) -> Column:
        head, text = F.lower(F.substring(s, 1, 200)), F.lower(s)
        return (
            F.when(s == "", F.lit("matplotlib"))
            .when(s.startswith("<") | F.substring(s, 1, 200).contains("<?xml") | head.contains("<svg"), F.lit("svg"))
            .when(contains_any(text, PLOTLY_WORDS), F.lit("plotly"))
            .when(contains_any(text, PILLOW_WORDS), F.lit("pillow"))
            .otherwise(F.lit("matplotlib"))
        )

    return let(strip(code), kind)


def chart_type_of_code(code: Column) -> Column:
    """Kind of chart in plotting code; a bar chart built with ``bottom=`` counts as stacked."""
    def kind(text: Column) -> Column:
        bar = F.when(contains_any(text, ["bottom=", "stacked"]), F.lit("mpl_stacked_bar")).otherwise(F.lit("mpl_bar"))
        first, *rest = CHART_WORDS
        out = F.when(contains_any(text, first[1]), F.lit(first[0]))
        for label, needles in rest:
            out = out.when(contains_any(text, needles), bar if label == "mpl_bar" else F.lit(label))
        return out.otherwise(F.lit("mpl_other"))

    return let(F.lower(code), kind)


def code_subtype(code: Column) -> Column:
    """Chart type for matplotlib code, else the visual type."""
    kind = visual_type_of_code(code)
    return F.when(kind == "matplotlib", chart_type_of_code(code)).otherwise(kind)
