"""Proposal and code parsing, prompts and message parts."""

from pyspark.sql import functions as F

from curaspark.functions import prompts as pr
from curaspark.functions import proposals as pp
from curaspark.operators.assemble import parse_proposals
from curaspark.operators.sampling import sample_examples, sample_generations
from curaspark.plans.catalog import query
from curaspark.plans.standins import table, view, with_views

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _tag_sql(text: str, tag: str) -> str:
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN {_strip_sql(f'''regexp_extract({text}, '{pattern}', 1)''')} END"


def _type_sql(raw: str) -> str:
    t = f"replace(lower({_strip_sql(raw)}), ' ', '_')"
    return (
        f"CASE WHEN {t} IN ('data_chart', 'diagram', 'geometry', 'timeline', 'map', 'table', 'other') THEN {t} "
        f"WHEN {t} = 'datachart' THEN 'data_chart' ELSE 'other' END"
    )


FIELDS = ["caption", "easy_question", "easy_answer", "hard_question", "hard_answer"]

STRICT_SQL = (
    with_views("raw_proposals")
    + f""", clean AS (SELECT proposal_id, step, regexp_replace(response, '{WS}*([<>/]){WS}*', '\\1', 'g') AS c FROM raw_proposals),
fields AS (SELECT proposal_id, step, {', '.join(f"{_tag_sql('c', f)} AS {f}" for f in FIELDS)}, {_tag_sql('c', 'content_type')} AS raw_type FROM clean),
parsed AS (SELECT proposal_id, step, ({' AND '.join(f'{f} IS NOT NULL' for f in FIELDS)}) AS format_ok, * EXCLUDE (proposal_id, step) FROM fields)
"""
)


def strict(spark, sf):
    """Parsed proposals: format_ok and the fields, NULL where the response is malformed."""
    parsed = parse_proposals(view(spark, sf, "raw_proposals", wide=True), "response", strict=True)
    return parsed.withColumn("format_ok", F.col("visual_type").isNotNull())


@query(
    "parse_proposal_strict",
    STRICT_SQL
    + f"""SELECT proposal_id, step, format_ok, CASE WHEN format_ok THEN 'svg' END AS visual_type, CASE WHEN format_ok THEN {_type_sql('raw_type')} END AS content_type,
          {', '.join(f'CASE WHEN format_ok THEN {f} END AS {f}' for f in FIELDS)} FROM parsed""",
)
def parse_proposal_strict(spark, sf):
    return strict(spark, sf)


def _loose_sql(field: str) -> str:
    def part(pattern):
        return f"NULLIF({_strip_sql(f'''regexp_extract(response, '{pattern}', 1)''')}, '')"

    return "COALESCE(" + ", ".join(
        part(p)
        for p in (
            f"(?is)<{field}>(.*?)</{field}>",
            f"(?is)<{field}>(.*?)(?:<[^/]|\\n|\\z)",
            f"(?i)(?:^|\\n){WS}*{field}{WS}*:{WS}*([^\\n<]+)",
            f"(?i)(?:^|\\n){WS}*{field}{WS}*:{WS}*<([^>]+)>",
        )
    ) + ")"


@query(
    "parse_proposal_tolerant",
    with_views("loose_proposals")
    + f""", f AS (SELECT proposal_id, response, {', '.join(f'{_loose_sql(f)} AS {f}' for f in FIELDS)}, {_loose_sql('content_type')} AS raw_type FROM loose_proposals),
    p AS (SELECT *, (caption IS NOT NULL AND easy_question IS NOT NULL AND easy_answer IS NOT NULL) AS parsed FROM f)
    SELECT proposal_id, parsed, 'svg' AS visual_type, CASE WHEN parsed THEN {_type_sql("COALESCE(raw_type, '')")} END AS content_type,
           CASE WHEN parsed THEN caption ELSE response END AS caption,
           {', '.join(f"CASE WHEN parsed THEN COALESCE({f}, '') ELSE '' END AS {f}" for f in FIELDS[1:])} FROM p""",
)
def parse_proposal_tolerant(spark, sf):
    return parse_proposals(view(spark, sf, "loose_proposals", wide=True), "response")


def _keyword_sql(text: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({text}), '{'|'.join(needles)}') THEN '{kind}'" for kind, needles in pp.CAPTION_KEYWORDS
    )
    return f"CASE {whens} ELSE 'other' END"


# captions: whole documents with a phrase that may name a type
TYPED = """SELECT doc_id, lang, CASE WHEN doc_id % 6 = 0 THEN 'Data Chart' WHEN doc_id % 6 = 1 THEN ' TIMELINE ' WHEN doc_id % 6 = 2 THEN 'datachart' ELSE source END AS tag,
  CONCAT(text, CASE WHEN doc_id % 5 = 0 THEN ' A Bar Chart of a country' WHEN doc_id % 5 = 1 THEN ' block diagram' WHEN doc_id % 5 = 2 THEN ' triangle on a grid' WHEN doc_id % 5 = 3 THEN ' Gantt' ELSE '' END) AS caption
  FROM {documents}"""


@query(
    "content_type",
    f"WITH t AS ({TYPED.format(documents='documents')}), n AS (SELECT doc_id, {_type_sql('tag')} AS tag_type, {_keyword_sql('caption')} AS caption_type FROM t)"
    "SELECT doc_id, tag_type, caption_type, CASE WHEN tag_type <> 'other' THEN tag_type ELSE caption_type END AS content_type FROM n",
)
def content_type(spark, sf):
    tag, caption = F.col("tag"), F.col("caption")
    return spark.sql(TYPED, documents=table(spark, sf, "documents", wide=True)).select(
        "doc_id",
        pp.normalize_content_type(tag).alias("tag_type"),
        pp.content_type_of_caption(caption).alias("caption_type"),
        pp.resolve_content_type(tag, caption).alias("content_type"),
    )


def _fence_sql(lang: str) -> str:
    pattern = f"(?s)```{lang}{WS}*\\n(.*?)```"
    return f"CASE WHEN regexp_matches(response, '{pattern}') THEN {_strip_sql(f'''regexp_extract(response, '{pattern}', 1)''')} END"


RAW_SVG_SQL = f"""CASE WHEN regexp_matches(response, '(?is)<svg.*?</svg>') THEN {_strip_sql("regexp_extract(response, '(?is)(<svg.*?</svg>)', 1)")} END"""
CODE_SQL = (
    with_views("code_responses")
    + f""", parts AS (SELECT response_id, step, response, {_fence_sql('svg')} AS svg, {_fence_sql('xml')} AS xml, {RAW_SVG_SQL} AS raw, {_fence_sql('(?:python)?')} AS py, {_strip_sql('response')} AS whole FROM code_responses),
codes AS (SELECT response_id, step, COALESCE(svg, CASE WHEN contains(lower(xml), '<svg') THEN xml END, raw, '') AS svg_code,
          COALESCE(CASE WHEN response_id % 2 = 1 THEN COALESCE(svg, raw) END, py, CASE WHEN starts_with(whole, 'import ') OR starts_with(whole, 'from ') THEN whole END, '') AS any_code FROM parts)
"""
)


def codes(spark, sf):
    response = F.col("response")
    wanted = F.when(F.col("response_id") % 2 == 1, F.lit("svg")).otherwise(F.lit("plotly"))
    return view(spark, sf, "code_responses", wide=True).select(
        "response_id", "step", pp.svg_block(response).alias("svg_code"), pp.code_block(response, wanted).alias("any_code")
    )


@query("extract_code", CODE_SQL + "SELECT * FROM codes")
def extract_code(spark, sf):
    return codes(spark, sf)


def _any_sql(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


CHART_SQL = "CASE " + " ".join(
    f"WHEN {_any_sql('l', needles)} THEN "
    + ("CASE WHEN contains(l, 'bottom=') OR contains(l, 'stacked') THEN 'mpl_stacked_bar' ELSE 'mpl_bar' END" if kind == "mpl_bar" else f"'{kind}'")
    for kind, needles in pp.CHART_WORDS
) + " ELSE 'mpl_other' END"

SUBTYPE_SQL = (
    CODE_SQL
    + f""", typed AS (SELECT response_id, step, any_code, lower(any_code) AS l,
  CASE WHEN any_code = '' THEN 'matplotlib' WHEN starts_with(any_code, '<') OR contains(substring(any_code, 1, 200), '<?xml') OR contains(lower(substring(any_code, 1, 200)), '<svg') THEN 'svg'
       WHEN {_any_sql('lower(any_code)', pp.PLOTLY_WORDS)} THEN 'plotly' WHEN {_any_sql('lower(any_code)', pp.PILLOW_WORDS)} THEN 'pillow' ELSE 'matplotlib' END AS visual_type FROM codes),
subtyped AS (SELECT response_id, step, visual_type, CASE WHEN visual_type = 'matplotlib' THEN {CHART_SQL} ELSE visual_type END AS subtype FROM typed)
"""
)


@query("code_subtype", SUBTYPE_SQL + "SELECT response_id, visual_type, subtype FROM subtyped")
def code_subtype(spark, sf):
    code = F.col("any_code")
    return codes(spark, sf).select(
        "response_id", pp.visual_type_of_code(code).alias("visual_type"), pp.code_subtype(code).alias("subtype")
    )


PROMPT_SQL = "CONCAT('Visual Type: svg', CHR(10), CHR(10), 'Chart Description:', CHR(10), caption, CHR(10), CHR(10), 'Easy Question: ', easy_question, CHR(10), 'Easy Answer: ', easy_answer, CHR(10), CHR(10), 'Hard Question: ', COALESCE(NULLIF(hard_question, ''), 'N/A'), CHR(10), 'Hard Answer: ', COALESCE(NULLIF(hard_answer, ''), 'N/A'))"


def _prompt():
    return pr.proposal_prompt(*[F.col(f) for f in FIELDS])


PROMPTS_SQL = (
    STRICT_SQL
    + f", prompts AS (SELECT proposal_id, caption, easy_question, easy_answer, hard_question, hard_answer, {PROMPT_SQL} AS prompt FROM parsed WHERE caption IS NOT NULL)"
)


def _prompts(spark, sf):
    """Prompt texts of all proposals with a caption; the malformed ones lack hard fields."""
    from curaspark.functions.text import between, let, strip

    def fields(clean):
        return F.struct(*[strip(between(clean, f"<{f}>", f"</{f}>")).alias(f) for f in FIELDS])

    found = F.filter(F.array(let(pp.tighten_tags(F.col("response")), fields)), lambda f: f["caption"].isNotNull())
    return view(spark, sf, "raw_proposals", wide=True).select("proposal_id", F.inline(found)).withColumn("prompt", _prompt())


@query(
    "prompt_render",
    PROMPTS_SQL
    + f""", trimmed AS (SELECT proposal_id, prompt, {_strip_sql('prompt')} AS t FROM prompts)
    SELECT proposal_id, CONCAT('Task: ', t, ' -- draw it.') AS filled,
           CONCAT('<|im_start|>system', CHR(10), 'You are a helpful assistant.<|im_end|>', CHR(10), '<|im_start|>user', CHR(10),
             repeat('<|vision_start|><|image_pad|><|vision_end|>', (proposal_id % 3)::INT), t,
             ' Please reason step by step based on the question and image. Put your final answer inside \\boxed{{}} as a single number, single word, or short phrase only (e.g. \\boxed{{42}}, \\boxed{{blue}}, \\boxed{{Q1}})—no units, no full sentences, so the grader can match it.',
             '<|im_end|>', CHR(10), '<|im_start|>assistant', CHR(10)) AS chat FROM trimmed""",
)
def prompt_render(spark, sf):
    return _prompts(spark, sf).select(
        "proposal_id",
        pr.fill_template("Task: {{ content | trim }} -- draw it.", F.col("prompt")).alias("filled"),
        pr.chat_prompt(F.col("prompt"), (F.col("proposal_id") % 3).cast("int")).alias("chat"),
    )


@query(
    "prompt_field",
    PROMPTS_SQL
    + """ SELECT proposal_id, easy_question, easy_answer, COALESCE(NULLIF(hard_question, ''), 'N/A') AS hard_question,
          COALESCE(NULLIF(hard_answer, ''), 'N/A') AS hard_answer, CASE WHEN proposal_id % 2 = 0 THEN 'given' ELSE prompt END AS question,
          '' AS missing FROM prompts""",
)
def prompt_field(spark, sf):
    prompt = F.col("prompt")
    given = F.when(F.col("proposal_id") % 2 == 0, F.lit("given"))
    return _prompts(spark, sf).select(
        "proposal_id",
        *[pr.prompt_line(prompt, label).alias(label.lower().replace(" ", "_")) for label in ("Easy Question", "Easy Answer", "Hard Question", "Hard Answer")],
        pr.question_or_prompt(given, prompt).alias("question"),
        pr.prompt_line(prompt, "No Such Field").alias("missing"),
    )


# the caption of the stand-in never holds a question label, so the text read back is the caption itself
@query("prompt_caption", PROMPTS_SQL + " SELECT proposal_id, caption FROM prompts")
def prompt_caption(spark, sf):
    return _prompts(spark, sf).select("proposal_id", pr.prompt_caption(F.col("prompt")).alias("caption"))


TAGGED = """SELECT conv_id, turn, CONCAT(CASE WHEN turn % 4 = 0 THEN '' ELSE '<image>' END, text, CASE WHEN turn % 4 >= 2 THEN '<image> and <image>' ELSE '' END, role) AS text,
   CASE WHEN conv_id % 3 = 0 THEN 1 WHEN conv_id % 3 = 1 THEN 2 ELSE 4 END AS n_images FROM {conversations}"""


@query(
    "placeholder_fix",
    f"""WITH t AS ({TAGGED.format(conversations='conversations')}),
    n AS (SELECT *, string_split(text, '<image>') AS p, len(string_split(text, '<image>')) - 1 AS tags FROM t)
    SELECT conv_id, turn, CASE WHEN tags > n_images THEN CONCAT(array_to_string(p[1:n_images + 1], '<image>'), array_to_string(p[n_images + 2:], '')) ELSE text END AS text,
           CAST(CASE WHEN tags > 0 AND tags < n_images THEN tags ELSE n_images END AS INT) AS n_images, CAST(tags AS INT) AS n_tags FROM n""",
)
def placeholder_fix(spark, sf):
    rows = spark.sql(TAGGED, conversations=table(spark, sf, "conversations"))
    images = F.transform(F.sequence(F.lit(1), F.col("n_images")), lambda i: F.concat(F.lit("img"), i.cast("string")))
    text, kept = pr.fit_images(F.col("text"), images)
    return rows.select("conv_id", "turn", text.alias("text"), F.size(kept).alias("n_images"), pr.tag_count(F.col("text")).alias("n_tags"))


@query(
    "message_parts",
    f"""WITH t AS ({TAGGED.format(conversations='conversations')}),
    p AS (SELECT conv_id, turn, string_split(text, '<image>') AS p FROM t),
    u AS (SELECT conv_id, turn, UNNEST(p) AS piece, generate_subscripts(p, 1) AS i FROM p)
    SELECT conv_id, turn, COUNT(*) FILTER (i > 1) AS n_image_parts, COUNT(*) FILTER (piece <> '') AS n_text_parts,
           string_agg(CASE WHEN i > 1 THEN '[image]' ELSE '' END || piece, '' ORDER BY i) AS flat FROM u GROUP BY conv_id, turn""",
)
def message_parts(spark, sf):
    rows = spark.sql(TAGGED, conversations=table(spark, sf, "conversations")).select(
        "conv_id", "turn", pr.message_parts(F.col("text")).alias("parts")
    )
    flat = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("[image]"))), "")
    return rows.select(
        "conv_id",
        "turn",
        F.size(F.filter("parts", lambda p: p["type"] == "image")).cast("bigint").alias("n_image_parts"),
        F.size(F.filter("parts", lambda p: p["type"] == "text")).cast("bigint").alias("n_text_parts"),
        flat.alias("flat"),
    )


@query(
    "sample_examples",
    with_views("code_samples")
    + """, firsts AS (SELECT proposal_id, MIN(sample_id) AS rollout FROM code_samples WHERE is_rendered GROUP BY proposal_id),
    joined AS (SELECT d.doc_id AS proposal_id, d.text, f.rollout FROM firsts f JOIN documents d ON d.doc_id = f.proposal_id)
    SELECT proposal_id, CONCAT('proposal_', proposal_id, '_rollout_', rollout, '.png') AS file, substring(text, 1, 500) AS caption FROM joined ORDER BY proposal_id LIMIT 10""",
)
def sample_examples_query(spark, sf):
    samples = view(spark, sf, "code_samples")
    captions = table(spark, sf, "documents").select(F.col("doc_id").alias("proposal_id"), F.col("text").alias("caption"))
    return sample_examples(samples, captions, n=10)


@query(
    "sample_generations",
    """SELECT text AS input, role AS output, conv_id * 1000 + turn AS rollout_id, md5(CONCAT('42:', text, ':', conv_id * 1000 + turn)) AS shuffle_key FROM conversations ORDER BY 4 LIMIT 20""",
)
def sample_generations_query(spark, sf):
    turns = view(spark, sf, "turns").select(F.col("text").alias("input"), F.col("role").alias("output"), "rollout_id")
    return sample_generations(turns, "input", ["rollout_id"], n=20, seed=42)


@query(
    "message_videos",
    """WITH p AS (SELECT conv_id, turn, string_split(CONCAT('<video>', replace(text, 'a ', '<video>')), '<video>') AS p FROM conversations),
    u AS (SELECT conv_id, turn, UNNEST(p) AS piece, generate_subscripts(p, 1) AS i FROM p)
    SELECT conv_id, turn, COUNT(*) FILTER (i > 1) AS n_videos, COUNT(*) FILTER (piece <> '') AS n_texts, string_agg(CASE WHEN i > 1 THEN '[video]' ELSE '' END || piece, '' ORDER BY i) AS flat FROM u GROUP BY conv_id, turn""",
)
def message_videos(spark, sf):
    """Turns cut at their video tags."""
    text = F.concat(F.lit("<video>"), F.replace("text", F.lit("a "), F.lit("<video>")))
    parts = table(spark, sf, "conversations", wide=True).select("conv_id", "turn", pr.message_parts(text, "video").alias("parts"))
    flat = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("[video]"))), "").alias("flat")

    def count(kind):
        return F.size(F.filter("parts", lambda p: p["type"] == kind)).cast("bigint")

    return parts.select("conv_id", "turn", count("video").alias("n_videos"), count("text").alias("n_texts"), flat)


@query(
    "prompt_images",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1 WHEN turn % 3 = 1 THEN len(string_split(text, ' ')) END AS n_images, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN string_split(text, ' ')[1] END AS first
    FROM conversations""",
)
def prompt_images(spark, sf):
    """Images under ``images``, else the one under ``image``, else none."""
    rows = table(spark, sf, "conversations")
    kind = F.col("turn") % 3
    images = pr.images_or_image(F.when(kind == 1, F.split("text", " ")), F.when(kind == 0, F.array("text")))
    found = rows.select("conv_id", "turn", images.alias("images"))
    return found.select("conv_id", "turn", F.when(F.col("images").isNotNull(), F.size("images")).cast("bigint").alias("n_images"), F.get("images", F.lit(0)).alias("first"))
