"""Building prompts and reading fields back out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.text import SPACE, cut, cut_with_dots, first_match, strip

# Wording and tokens the models were trained on.
JUDGE_TASK = (
    "You are an answer correctness judge. Given a question, the gold (correct) answer, "
    "and the model's answer, determine if the model's answer is correct: equivalent to the "
    "gold answer or semantically the same. Consider numeric equality (e.g. 14 vs 14.0), "
    "option equivalence (A vs A.), and paraphrases. Answer with exactly one word: Yes or No."
)
JUDGE_QUESTION = "Is the model answer correct? Answer with exactly one word: Yes or No."
SOLVER_TASK = (
    "Please reason step by step based on the question and image. "
    "Put your final answer inside \\boxed{} as a single number, single word, "
    "or short phrase only (e.g. \\boxed{42}, \\boxed{blue}, \\boxed{Q1})"
    "\u2014no units, no full sentences, so the grader can match it."
)
VISION_TOKEN = "<|vision_start|><|image_pad|><|vision_end|>"
IMAGE_TAG = "<image>"
TEMPLATE_SLOT = "{{ content | trim }}"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or_na(c: Column) -> Column:
    return F.when(_or_empty(c) == "", F.lit("N/A")).otherwise(c)


def proposal_prompt(
    caption: Column, easy_question: Column, easy_answer: Column, hard_question: Column, hard_answer: Column
) -> Column:
    """Prompt text of a proposal; a missing hard question or answer reads ``N/A``."""
    return F.concat(
        F.lit("Visual Type: svg\n\nChart Description:\n"), caption,
        F.lit("\n\nEasy Question: "), easy_question,
        F.lit("\nEasy Answer: "), easy_answer,
        F.lit("\n\nHard Question: "), _or_na(hard_question),
        F.lit("\nHard Answer: "), _or_na(hard_answer),
    )


def fill_template(template: str, content: Column) -> Column:
    """Template text with its slot filled by the stripped content (plain replacement, no pattern)."""
    return F.replace(F.lit(template), F.lit(TEMPLATE_SLOT), strip(content))


def prompt_line(prompt: Column, field: str) -> Column:
    """One-line field of a prompt text, '' when missing. ``.`` stops at a newline only."""
    return _or_empty(strip(first_match(prompt, rf"(?d){field}:{SPACE}*(.+?)(?:\n|$)")))


def prompt_caption(prompt: Column) -> Column:
    """Caption of a prompt text; it may span lines and ends at the next question or the end of the text."""
    tail = r"(?=\n\nEasy Question:|\n\nHard Question:|\z)"
    return _or_empty(strip(first_match(prompt, rf"(?s)Chart Description:{SPACE}*(.*?){tail}")))


def chat_prompt(problem: Column, n_images: Column) -> Column:
    """Chat prompt with a vision token per image tag, or the tokens in front when the text has no tag."""
    text = strip(problem)
    body = F.when(text.contains(IMAGE_TAG), F.replace(text, F.lit(IMAGE_TAG), F.lit(VISION_TOKEN))).otherwise(
        F.concat(F.repeat(F.lit(VISION_TOKEN), n_images), text)
    )
    return F.concat(
        F.lit("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n"),
        body,
        F.lit(f" {SOLVER_TASK}<|im_end|>\n<|im_start|>assistant\n"),
    )


def judge_prompt(question: Column, gold: Column, answer: Column, max_q: int = 400, max_a: int = 600) -> Column:
    return F.concat(
        F.lit(f"{JUDGE_TASK}\n\nQuestion: "),
        cut_with_dots(strip(_or_empty(question)), max_q),
        F.lit("\n\nGold answer: "),
        cut(strip(_or_empty(gold)), max_a),
        F.lit("\n\nModel answer: "),
        cut_with_dots(strip(_or_empty(answer)), max_a),
        F.lit(f"\n\n{JUDGE_QUESTION}"),
    )


def tag_count(text: Column, tag: str = IMAGE_TAG) -> Column:
    return F.size(F.split(text, f"\\Q{tag}\\E", -1)) - 1


def fit_images(text: Column, images: Column, tag: str = IMAGE_TAG) -> tuple[Column, Column]:
    """Reconcile image tags with images: surplus images are cut, surplus tags are removed from the end."""
    parts = F.split(text, f"\\Q{tag}\\E", -1)
    n_tags, n_images = F.size(parts) - 1, F.size(images)
    kept = F.array_join(F.slice(parts, 1, n_images + 1), tag)
    rest = F.array_join(F.slice(parts, n_images + 2, F.greatest(n_tags - n_images, F.lit(0))), "")
    new_text = F.when(n_tags > n_images, F.concat(kept, rest)).otherwise(text)
    new_images = F.when((n_tags > 0) & (n_tags < n_images), F.slice(images, 1, n_tags)).otherwise(images)
    return new_text, new_images


def message_parts(prompt: Column, kind: str = "image") -> Column:
    """Typed content parts of a prompt split at ``<image>`` or ``<video>`` tags; empty texts are left out."""
    pieces = F.split(prompt, f"\\Q<{kind}>\\E", -1)

    def parts(piece, i):
        tag = F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("text"))
        text = F.struct(F.lit("text").alias("type"), piece.alias("text"))
        return F.filter(
            F.array(F.when(i > 0, tag), F.when(piece != "", text)),
            lambda p: p.isNotNull(),
        )

    return F.flatten(F.transform(pieces, parts))


def question_or_prompt(question: Column, raw_prompt: Column) -> Column:
    return F.coalesce(question, raw_prompt)


def images_or_image(images: Column, image: Column) -> Column:
    return F.coalesce(images, image)
