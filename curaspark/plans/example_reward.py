"""A reward as a user would keep it in a file of their own, in the older list interface; a query loads it from here."""

REWARD_NAME = "illustrated"


def _share(images):
    return len(images or ()) / 4


def compute_score(predicts, ground_truths, questions, description_answers, images=None, weight=0.5):
    """Whether the answer occurs in the response, how many images the question came with, and what else was asked of them."""
    scores = []
    for predict, truth, question, answers, shown in zip(predicts, ground_truths, questions, description_answers, images):
        right = float(truth in predict)
        scores.append({"overall": weight * right + (1 - weight) * _share(shown), "asked": len(question) + sum(map(len, answers))})
    return scores
