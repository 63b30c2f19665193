"""Fixed schemas of the tables a self-play loop leaves behind. An absent field reads as NULL."""

from __future__ import annotations

SEED_PROMPTS = "problem STRING, answer STRING"
PROPOSALS = (
    "visual_type STRING, content_type STRING, caption STRING, easy_question STRING, easy_answer STRING, "
    "hard_question STRING, hard_answer STRING, render_success_rate DOUBLE"
)
GENERATED_CODE = PROPOSALS + ", generated_code STRING, raw_response STRING"
CODE_SAMPLES = PROPOSALS + ", generated_codes ARRAY<STRING>"
CODEGEN_TRAIN = (
    "prompt_text STRING, easy_answer STRING, caption STRING, easy_question STRING, hard_question STRING, "
    "hard_answer STRING, visual_type STRING"
)
RENDERED = (
    "caption STRING, easy_question STRING, easy_answer STRING, hard_question STRING, hard_answer STRING, "
    "image STRING, generated_code STRING"
)
SOLVER_RESULTS = "question STRING, answer STRING, score DOUBLE, results ARRAY<STRING>, error STRING"
EVALUATED = (
    "question STRING, answer STRING, score DOUBLE, hard_consistency DOUBLE, easy_consistency DOUBLE, image STRING, "
    "caption STRING, easy_question STRING, easy_answer STRING, hard_question STRING, hard_answer STRING, "
    "question_type STRING, results ARRAY<STRING>"
)
SOLVER_TRAIN = (
    "problem STRING, answer STRING, score DOUBLE, hard_consistency DOUBLE, easy_consistency DOUBLE, images STRING, "
    "problem_type STRING, caption STRING, easy_question STRING, easy_answer STRING"
)
EVAL_RESPONSES = (
    "dataset STRING, index BIGINT, question STRING, ground_truth STRING, model_response STRING, "
    "extracted_answer STRING, correct BOOLEAN, model_path STRING, save_name STRING, question_type STRING, "
    "task_types STRING, task_id STRING, id STRING, difficulty STRING"
)
ACCURACY_SUMMARY = "model STRING, model_path STRING, dataset STRING, accuracy DOUBLE, correct BIGINT, total BIGINT"
ROLLOUT_TOKENS = (
    "uid STRING, rollout_id BIGINT, step INT, prompt_len INT, response_len INT, response_mask ARRAY<INT>, "
    "token_level_scores ARRAY<DOUBLE>, old_log_probs ARRAY<DOUBLE>, ref_log_probs ARRAY<DOUBLE>, `values` ARRAY<DOUBLE>"
)
REWARD_INPUT = "response STRING, response_length INT, ground_truth STRING, question STRING"
EPISODES = (
    "episode_id INT, device_id STRING, start_time STRING, end_time STRING, completed_rounds INT, success BOOLEAN, "
    "rounds ARRAY<STRUCT<round: INT, question_screenshot: STRING, result_screenshot: STRING, selected_index: INT, "
    "click_position: ARRAY<INT>, timestamp: STRING>>"
)
GAME_RESULTS = "device_id STRING, timestamp STRING, total_rounds INT, final_score DOUBLE, model_type STRING, model_name STRING"
RUN_MANIFEST = "run STRING, step BIGINT, is_best BOOLEAN, completed BOOLEAN"
