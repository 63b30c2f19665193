"""Hand cases for parsers, answers, prompts, images, tokens and single-response rewards."""

import base64
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.functions import answers as an
from curaspark.functions import images as im
from curaspark.functions import prompts as pr
from curaspark.functions import proposals as pp
from curaspark.functions import rewards as rw
from curaspark.functions import tokens as tk


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).collect()[0]["x"]


def many(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_choice_reward_nine_pairs(spark):
    cases = [
        ("0", "0", 1.0), ("1", "1", 1.0), ("2", "2", 1.0), ("The answer is 1", "1", 1.0), ("I choose option 2", "2", 1.0),
        ("0", "1", 0.0), ("2", "0", 0.0), ("I don't know", "1", 0.0), ("", "2", 0.0),
    ]
    df = spark.createDataFrame(cases, "r string, t string, want double")
    for r in df.select("want", rw.choice_reward(F.col("r"), F.col("t"))["overall"].alias("got")).collect():
        assert r["got"] == r["want"]


def test_boxes(spark):
    texts = [r"\boxed{1} and \boxed{ 2 }", "none", r"\boxed{\frac{1}{2}} tail", r"\boxed{open", r"\boxed{}"]
    assert many(spark, texts, an.first_boxed) == ["1", None, r"\frac{1", None, ""]
    assert many(spark, texts, an.last_boxed) == ["2", None, r"\frac{1", None, ""]
    assert many(spark, texts, an.boxed_content) == ["2", "None", r"\frac{1}{2}", "None", ""]


def test_canonical_answers(spark):
    same = [["4", " 4", "4.0", "4.", "$4$", "400%"[0:1]], ["1/2", "0.5", r"\frac{1}{2}", r"\dfrac{1}{2}", ".5"], ["1,234", "1234", "1234.00"], ["Blue", " blue ", "BLUE."]]
    for group in same:
        assert len(set(many(spark, group, an.canonical))) == 1, group
    different = many(spark, ["4", "5", "1/3", "blue", "", "-4"], an.canonical)
    assert len(set(different)) == 6


def test_canonical_keeps_values_apart(spark):
    apart = ["(1,2000)", "(12,000)", "12000", "12345678901234567", "12345678901234568", "0.0000000001", "0", "1.5e3", "1500", "2 1/2", "2.5", "[1,234]", "1234", "1,23", "123"]
    assert len(set(many(spark, apart, an.canonical))) == len(apart)
    for group in (["0", "-0", "0.0", "0/5", "000"], ["-0.50", "-.5", "-1/2"], ["1,234,567.50", "+1234567.5"], ["$12,000", "12000", "12,000.00"], ["1/3", "2/6"]):
        assert len(set(many(spark, group, an.canonical))) == 1, group


def test_no_rule_also_hits_longer_words(spark):
    keys = many(spark, ["no change", "casino 5", "5", "No way"], an.vote_key)
    assert keys[0] == keys[1] == keys[3] != keys[2]


def test_math_normaliser(spark):
    pairs = [("x = 1,234", "1234"), (r"12\text{ cm}", "12"), (r"$\frac12$", r"\frac{1}{2}"), (r"\sqrt3 units", r"\sqrt{3}"), (r"\text{and}", ","), (r"90^\circ", "90")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("a", an.normalize_math(F.col("a")).alias("x"), an.normalize_math(F.col("b")).alias("y")).collect():
        assert r["x"] == r["y"], r


def test_judge(spark):
    assert many(spark, ["Yes", " yes.", "YES\nno", "No", "", "not yes", "yesterday"], an.judged_correct) == [True, True, True, False, False, False, True]


def test_choice_index(spark):
    texts = ["<action>select(1)</action>", "<action>select(7)</action> answer: 2", "选项 B", "第 0 个", "answer： 5 选项c", "nothing"]
    assert many(spark, texts, an.choice_index) == [1, 2, 1, 0, 2, None]


def test_content_types(spark):
    assert many(spark, ["Data Chart", "datachart", "data  chart", " MAP ", "", None], pp.normalize_content_type) == ["data_chart", "data_chart", "other", "map", "other", "other"]
    captions = ["A flow chart of a bar chart", "Stacked things", "a RECTANGLE on a map", "gantt", "country", "a grid", "none"]
    assert many(spark, captions, pp.content_type_of_caption) == ["diagram", "data_chart", "geometry", "timeline", "map", "table", "other"]


def test_strict_and_tolerant_parse(spark):
    good = "< caption >\nA  b</ caption ><easy_question>q</easy_question><easy_answer>1</easy_answer><hard_question>h</hard_question><hard_answer>2</hard_answer>"
    strict = many(spark, [good, good.replace("hard_answer", "x"), ""], pp.parse_strict)
    assert strict[0]["caption"] == "A  b" and strict[0]["content_type"] == "other" and strict[1] is None and strict[2] is None
    loose = many(spark, ["Caption: a\neasy_question: b\neasy_answer: <c>", "<caption>x", good], pp.parse_tolerant)
    assert (loose[0]["parsed"], loose[0]["caption"], loose[0]["easy_answer"]) == (True, "a", "c")
    assert (loose[1]["parsed"], loose[1]["caption"], loose[1]["content_type"]) == (False, "<caption>x", None)


def test_code_blocks(spark):
    texts = ["```svg\n<svg/>\n```", "```xml\n<SVG></SVG>\n```", "```xml\nx\n``` <svg>y</svg>", "a <SVG>z</svg> b", "no code", "```svg \n\n```"]
    assert many(spark, texts, pp.svg_block) == ["<svg/>", "<SVG></SVG>", "<svg>y</svg>", "<SVG>z</svg>", "", ""]
    assert many(spark, ["import a\nx", "```python\nf()\n```", "```\ng()\n```", "x"], lambda c: pp.code_block(c, F.lit("plotly"))) == ["import a\nx", "f()", "g()", ""]
    kinds = many(spark, ["", "<svg/>", "import plotly", "from PIL import Image", "plt.plot(x)", "ax.bar(x, bottom=y)", "polar"], pp.code_subtype)
    assert kinds == ["mpl_other", "svg", "plotly", "pillow", "mpl_line", "mpl_stacked_bar", "mpl_polar"]


def test_prompt_round_trip(spark):
    prompt = pr.proposal_prompt(F.lit("line 1\n\nline 2"), F.lit("e?"), F.lit("1"), F.lit(""), F.lit(None).cast("string"))
    assert one(spark, pr.prompt_caption(prompt)) == "line 1\n\nline 2"
    assert one(spark, pr.prompt_line(prompt, "Easy Question")) == "e?"
    assert one(spark, pr.prompt_line(prompt, "Hard Answer")) == "N/A"
    assert one(spark, pr.fill_template("a {{ content | trim }} $1 b", F.lit(" \\x$ "))) == "a \\x$ $1 b"


def test_image_tags(spark):
    def fit(text, n):
        t, i = pr.fit_images(F.lit(text), F.array(*[F.lit(f"i{k}") for k in range(n)]))
        return one(spark, F.struct(t.alias("t"), i.alias("i")))

    assert fit("<image>a<image>b<image>", 1)["t"] == "<image>ab"
    assert fit("<image>a", 3)["i"] == ["i0"]
    assert fit("no tags", 2)["i"] == ["i0", "i1"]
    parts = one(spark, pr.message_parts(F.lit("<image>look<image>")))
    assert [(p["type"], p["text"]) for p in parts] == [("image", None), ("text", "look"), ("image", None)]


def png(w, h):
    return base64.b64encode(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x06\x00\x00\x00").decode()


def test_image_headers(spark):
    texts = [png(640, 480), "data:image/png;base64," + png(1, 20000), "no image", png(0, 5), ""]
    sizes = many(spark, texts, im.png_size)
    assert [(s["width"], s["height"]) if s else None for s in sizes] == [(640, 480), (1, 20000), None, (0, 5), None]
    ok = many(spark, texts, lambda c: im.is_renderable_size(im.png_size(c)["width"], im.png_size(c)["height"]))
    assert ok == [True, False, None, False, None]
    assert many(spark, ["x" * 100, "x" * 201, "data:image" + "x" * 91, None], im.is_image_text) == [False, True, True, False]


@pytest.mark.parametrize("size,want", [((0, 5), (0, 5)), ((100, 100), (100, 100)), ((1000, 1), (199, 1)), ((1, 1000), (1, 199)), ((2560, 1280), (1810, 905))])
def test_target_size(spark, size, want):
    got = one(spark, im.target_size(F.lit(size[0]), F.lit(size[1])))
    assert (got["width"], got["height"]) == want


def test_response_mask(spark):
    ids = F.array(*[F.lit(i) for i in [0, 0, 2, 4, 3, 5, 1, 0, 0]])
    assert one(spark, tk.response_mask(ids, [1])) == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert one(spark, tk.response_mask(ids, [1, 4])) == [1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert one(spark, tk.response_mask(ids, [9])) == [1] * 9
    mask = F.array(*[F.lit(i) for i in [0, 0, 1, 1, 1, 0]])
    assert one(spark, tk.position_ids(mask)) == [0, 0, 0, 1, 2, 2]


def test_padding(spark):
    ids = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, tk.pad_or_cut(ids, 5, F.lit(0))) == [0, 0, 1, 2, 3]
    assert one(spark, tk.pad_or_cut(ids, 5, F.lit(0), left_pad=False)) == [1, 2, 3, 0, 0]
    assert one(spark, tk.pad_or_cut(ids, 2, F.lit(0), truncation="left")) == [2, 3]
    assert one(spark, tk.pad_or_cut(ids, 2, F.lit(0), truncation="right")) == [1, 2]
    with pytest.raises(Exception, match="longer than 2"):
        one(spark, tk.pad_or_cut(ids, 2, F.lit(0)))


def test_reverse_recursions(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(30):
        n = int(rng.integers(0, 40))
        rows.append((i, rng.normal(size=n).tolist(), rng.normal(size=n).tolist(), rng.integers(0, 2, n).tolist()))
    df = spark.createDataFrame(rows, "i int, r array<double>, v array<double>, m array<int>").repartition(3)
    out = df.select("*", tk.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("ret"), tk.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("adv"))
    for row in out.collect():
        running, following, carried, ret, adv = 0.0, 0.0, 0.0, [], []
        for r, v, m in zip(reversed(row["r"]), reversed(row["v"]), reversed(row["m"])):
            running = r + 0.9 * running
            ret.append(running)
            running *= m
            if m:
                carried = r + 0.9 * following - v + 0.9 * 0.8 * carried
                following = v
            adv.append(carried)
        assert row["ret"] == pytest.approx(ret[::-1]) and row["adv"] == pytest.approx(adv[::-1])


def test_formats(spark):
    good = r"<think>a</think> \boxed{4}"
    got = many(spark, [good, good + " tail", "x " + good, r"<think>a</think>\boxed{\frac{8}{2}}"], lambda c: rw.solver_reward(c, F.lit("4")))
    assert [(g["format"], g["accuracy"]) for g in got] == [(1.0, 1.0), (0.0, 1.0), (0.0, 1.0), (1.0, 1.0)]
    assert got[0]["overall"] == pytest.approx(1.0) and got[1]["overall"] == pytest.approx(0.9)
    tagged = many(spark, ["<think>a</think> <answer>4</answer>", "4", "<answer>\n4</answer>"], lambda c: rw.answer_tag_reward(c, F.lit("4")))
    assert [t["overall"] for t in tagged] == [1.0, 0.5, 0.0]


def test_last_token_reward(spark):
    assert one(spark, tk.reward_at_last_token(F.lit(0.7), F.lit(2), F.lit(4))) == [0.0, 0.7, 0.0, 0.0]
