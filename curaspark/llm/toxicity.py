"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and six letters, so endings that were
never seen in training still share the vector of their stem. Filters of several widths slide over the words, the largest
response of each filter over the whole text is kept, and a logistic layer reads these. Because the maximum alone counts, a
few words decide in a text of any length, and in the backward step only the windows that won carry gradients.

Training sees labelled rows only, at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` other ones and ``TRAIN_WORDS`` words
in all, chosen by a hash of the identifier (a text too long for what is left is passed over); one part in ``1 / CALIBRATION`` of them is held back to set, for each
language, the threshold that separates best. The language is guessed from the text by its function words. A score is the
logistic of the distance to the threshold of its language, so 0.5 is the threshold everywhere.

Scoring reads whole texts; long ones are convolved in overlapping stretches, whose largest responses are the text's. Null
and empty texts have no word, and the score of an empty window. Without labelled rows of both kinds every score is 0. Labels
that are null are no labels, and of repeated labels any toxic one counts. Repeated rows repeat. Other columns, the language
column among them, are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.session import cut_lineage

BUCKETS = 1 << 15
LETTERS = (4, 6)  # lengths of the stems that are hashed beside the word
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16  # per width
EPOCHS = 6
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_WORDS = 3_000, 5_000, 3_000_000
CALIBRATION = 0.2
STRETCH = 50_000  # words convolved at once
REMEMBERED = 150_000  # words whose vectors a task keeps
LOOKED_UP = 10_000  # new words whose features are summed at once

_WORD = re.compile(r"\w+")

# Frequent function words by language.
LANGUAGES = ("en", "de", "fr", "es")
_FUNCTION_WORDS = (
    "the of and to in that is was for it with as be by on are from this have not they at or an he",
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "le la les des et en du une est que dans qui pour pas au sur se plus par avec ce il sont ne un",
    "el los del las por con una su para como más al lo pero sus este ya entre cuando muy sin sobre también me hasta",
)
_LANGUAGE_OF = {}
for _i, _words in enumerate(_FUNCTION_WORDS):
    for _w in _words.split():
        _LANGUAGE_OF.setdefault(_w, _i)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def language(found: list[str]) -> int:
    """Index of the language whose function words the text has most kinds of; the first one if none."""
    kinds = [0] * len(LANGUAGES)
    for w in set(found).intersection(_LANGUAGE_OF):
        kinds[_LANGUAGE_OF[w]] += 1
    return kinds.index(max(kinds))


def buckets(word: str) -> tuple[int, ...]:
    """Hashed features of a word; bucket 0 is the empty place around a text."""
    raw = [word, *(f"{n}{word[:n]}" for n in LETTERS)]
    return tuple(1 + zlib.crc32(w.encode()) % (BUCKETS - 1) for w in raw)


def _packed_features(found: list[str]) -> bytes:
    """The features of all words as 16-bit numbers."""
    return np.fromiter(chain.from_iterable(map(buckets, found)), np.uint16, len(found) * (1 + len(LETTERS))).tobytes()


# ---------------------------------------------------------------- the classifier


@dataclass
class Model:
    embedding: np.ndarray  # [bucket, dim]; bucket 0 stays zero
    filters: list[np.ndarray]  # per width [width, dim, filter]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def vectors(self, features: np.ndarray) -> np.ndarray:
        return self.embedding[features].sum(axis=-2)

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """Filter responses of the windows that begin at each word; x ends in WIDTHS[-1] - 1 empty places."""
        w, n = self.filters[width], len(x) - WIDTHS[-1] + 1
        out = x[:n] @ w[0]
        for j in range(1, len(w)):
            out += x[j : n + j] @ w[j]
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.bias


def new_model(seed: int = 0) -> Model:
    r = np.random.default_rng(seed)
    embedding = r.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    embedding[0] = 0
    filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)


def padded(features: np.ndarray) -> np.ndarray:
    """Features of a text, at least one place, and the empty places after its last word."""
    return np.concatenate([features, np.zeros((WIDTHS[-1] - 1 + (len(features) == 0), 1 + len(LETTERS)), features.dtype)])


class _Steps:
    """Steps of decreasing size, by the squares of the gradients so far; rows that no gradient reached stay as they are."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.squares = value, rate, np.full(value.shape, 1e-8, np.float32)

    def step(self, gradient: np.ndarray, rows=slice(None)) -> None:
        self.squares[rows] += gradient * gradient
        self.value[rows] -= self.rate * gradient / np.sqrt(self.squares[rows])


def train(texts: list[np.ndarray], toxic: np.ndarray, epochs: int = EPOCHS, batch: int = 32, seed: int = 0) -> Model:
    """Fit to texts given as features [word, feature]; both classes weigh the same."""
    model, r = new_model(seed), np.random.default_rng(seed + 1)
    weight = np.where(toxic == 1, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9)).astype(np.float32)
    bias = np.zeros(1, np.float32)
    steps = _Steps(model.embedding, 0.05), [_Steps(w, 0.05) for w in model.filters], [_Steps(b, 0.05) for b in model.biases], _Steps(model.out, 0.05), _Steps(bias, 0.05)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            pooled = np.empty((len(some), FILTERS * len(WIDTHS)), np.float32)
            won: list[list[np.ndarray]] = []
            inputs = []
            for i, t in enumerate(some):
                f = padded(texts[t])
                x = model.vectors(f)
                best = []
                for k in range(len(WIDTHS)):
                    y = model.responses(x, k)
                    at = y.argmax(axis=0)
                    best.append(at)
                    pooled[i, k * FILTERS : (k + 1) * FILTERS] = y[at, np.arange(FILTERS)] + model.biases[k]
                won.append(best)
                inputs.append((f, x))
            active = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ model.out + bias[0], -30, 30)))
            error = ((p - toxic[some]) * weight[some] / len(some)).astype(np.float32)
            back = error[:, None] * model.out * (pooled > 0)
            g_filters = [np.zeros_like(w) for w in model.filters]
            rows, grads = [], []
            for i, (f, x) in enumerate(inputs):
                for k, w in enumerate(model.filters):
                    g, at = back[i, k * FILTERS : (k + 1) * FILTERS], won[i][k]
                    if not g.any():
                        continue
                    for j in range(len(w)):
                        g_filters[k][j] += x[at + j].T * g
                        rows.append(f[at + j])
                        grads.append((w[j] * g).T)
            steps[3].step(active.T @ error + 1e-5 * model.out)
            steps[4].step(error.sum(keepdims=True))
            for k in range(len(WIDTHS)):
                steps[1][k].step(g_filters[k])
                steps[2][k].step(back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0))
            if rows:
                at = np.concatenate(rows)
                flat, place = np.unique(at, return_inverse=True)
                total = np.zeros((len(flat), DIM), np.float32)
                np.add.at(total, place.reshape(at.shape), np.concatenate(grads)[:, None, :])
                total[flat == 0] = 0
                steps[0].step(total, flat)
    model.bias = float(bias[0])
    return model


def pool(model: Model, texts: list[np.ndarray], vectors) -> np.ndarray:
    """Largest response of every filter over each text, given as indices that ``vectors`` turns into word vectors."""
    pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    tail = WIDTHS[-1] - 1
    stretches: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not stretches:
            return
        owner = np.array([i for i, _ in stretches])
        starts = np.concatenate(([0], np.cumsum([len(s) for _, s in stretches])))
        x = vectors(np.concatenate([*(s for _, s in stretches), empty[:1]]))  # one place more, so that the last bound is a row
        for k in range(len(WIDTHS)):
            y = model.responses(x, k)
            # windows that begin in the empty places behind a text are not its windows
            bounds = np.stack([starts[:-1], starts[1:] - tail], axis=1).ravel()
            top = np.maximum.reduceat(y, bounds, axis=0)[::2]
            np.maximum.at(pooled[:, k * FILTERS : (k + 1) * FILTERS], owner, top + model.biases[k])
        stretches.clear()
        size = 0

    empty = np.zeros(tail, np.int64)
    for i, ids in enumerate(texts):
        ids = ids if len(ids) else np.zeros(1, np.int64)
        for a in range(0, len(ids), STRETCH):
            stretch = ids[a : a + STRETCH + tail]
            stretch = np.concatenate([stretch, empty[: tail - max(0, len(stretch) - STRETCH)]])
            if size and size + len(stretch) > STRETCH:
                flush()
            stretches.append((i, stretch))
            size += len(stretch)
    flush()
    return pooled


class Vectors(dict):
    """Word -> index of its vector, worked out when first met; emptied when too many are held."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.table = model, [], np.zeros((1, DIM), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = index = len(self.table) + len(self.new)
        self.new.append(buckets(word))
        return index

    def ids(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))

    def look_up(self, ids: np.ndarray) -> np.ndarray:
        if self.new:
            parts = [self.model.vectors(np.array(self.new[a : a + LOOKED_UP])) for a in range(0, len(self.new), LOOKED_UP)]
            self.table = np.concatenate([self.table, *parts])
            self.new = []
        return self.table[ids]

    def forget(self) -> None:
        if len(self.table) + len(self.new) > REMEMBERED:
            self.clear()
            self.new, self.table = [], self.table[:1].copy()


def distances(model: Model, texts: Iterable[str | None], known: Vectors) -> np.ndarray:
    """Logit of each text above the threshold of its language."""
    out, group, languages, held = [], [], [], 0

    def flush() -> None:
        nonlocal held
        if group:
            out.append(model.logit(pool(model, group, known.look_up)) - model.thresholds[languages])
        group.clear()
        languages.clear()
        known.forget()
        held = 0

    for t in texts:
        found = words(t)
        group.append(known.ids(found))
        languages.append(language(found))
        held += len(found)
        if held > 4 * STRETCH:
            flush()
    flush()
    return np.concatenate(out) if out else np.zeros(0)


# ---------------------------------------------------------------- fitting and scoring tables


def learned(df: DataFrame, labels: DataFrame, training: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 0) -> Model | None:
    """The classifier fitted to the labels of those rows of ``df`` for which ``training`` holds; None without both labels.

    Labels meet identifiers first, a bounded number of them is chosen by a hash, and only these meet their texts: a
    part of them trains and another calibrates.
    """
    known = labels.groupBy(F.col(key).alias("label_key")).agg((F.max(label) > 0).cast("int").alias("toxic")).filter("toxic IS NOT NULL AND label_key IS NOT NULL")
    rows = df.select(F.col(key).alias("key")) if training is None else df.filter(training).select(F.col(key).alias("key"))
    order = F.xxhash64(F.lit(seed), F.col("key").cast("string"))
    labelled = cut_lineage(rows.join(known, F.col("key") == F.col("label_key")).select("key", "toxic").distinct().withColumn("order", order))
    kinds = {kind: labelled.filter(F.col("toxic") == kind).orderBy("order", "key").limit(most) for kind, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))}
    chosen = cut_lineage(kinds[1].unionByName(kinds[0]))
    texts = df.select(F.col(key).alias("text_key"), F.col(text).alias("text"))
    # at most TRAIN_TOXIC + TRAIN_CLEAN identifiers
    labelled = cut_lineage(texts.join(F.broadcast(chosen), F.col("text_key") == F.col("key")).select("key", "text", "toxic", "order"))

    room = TRAIN_WORDS // 2

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spoken, packed = [], [], []
            for t in batch.column("text"):  # one at a time: the words of a batch as objects are many times its size
                found = words(t.as_py())
                sizes.append(len(found))
                spoken.append(language(found))
                packed.append(_packed_features(found[:room]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("order"), pa.array(sizes, pa.int64()), pa.array(spoken, pa.int32()), pa.array(packed, pa.binary())],
                ["toxic", "order", "n_words", "language", "features"],
            )

    got: list[tuple[int, int, np.ndarray]] = []
    for kind, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        total, long = 0, None
        some = labelled.filter(F.col("toxic") == kind).orderBy("order", "key").limit(most)
        for r in some.mapInArrow(featured, "toxic int, order bigint, n_words bigint, language int, features binary").toLocalIterator():
            row = (r["toxic"], r["language"], np.frombuffer(r["features"], np.uint16).reshape(-1, 1 + len(LETTERS)))
            if total + r["n_words"] <= room:
                total += r["n_words"]
                got.append(row)
            else:  # it does not fit, but a later one may
                long = long or row
        if long and not any(g[0] == kind for g in got):
            got.append(long)  # no text of the kind fits: the beginning of the first one
    toxic = np.array([g[0] for g in got])
    if len(got) < 2 or toxic.min() == toxic.max():
        return None
    held = np.random.default_rng(seed).random(len(got)) < CALIBRATION
    if len(got) < 50 or toxic[held].min(initial=1) == toxic[held].max(initial=0):
        held = np.zeros(len(got), bool)
    model = train([g[2] for g, h in zip(got, held) if not h], toxic[~held], seed=seed)
    calibrate(model, got if not held.any() else [g for g, h in zip(got, held) if h])
    return model


def calibrate(model: Model, rows: list[tuple[int, int, np.ndarray]], least: int = 10) -> None:
    """Set the threshold of each language where toxic and other rows are told apart best.

    A language with fewer than ``least`` rows of either kind takes the threshold over all languages.
    """
    logits = []
    for _, _, features in rows:
        places = np.concatenate([np.zeros_like(features, shape=(1, 1 + len(LETTERS))), features])  # 0 is the empty place
        pooled = pool(model, [np.arange(1, len(places))], lambda ids: model.vectors(places[ids]))  # noqa: B023
        logits.append(model.logit(pooled)[0])
    logits = np.array(logits)
    toxic, spoken = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    overall = best_threshold(logits, toxic)
    for i in range(len(LANGUAGES)):
        own = spoken == i
        enough = min(toxic[own].sum(), (1 - toxic[own]).sum()) >= least
        model.thresholds[i] = best_threshold(logits[own], toxic[own]) if enough else overall


def best_threshold(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest weighted errors; both classes weigh the same."""
    order = np.argsort(logits, kind="stable")
    x, y = logits[order], toxic[order]
    missed = np.concatenate(([0], np.cumsum(y))) / max(y.sum(), 1)
    false = np.concatenate(([0], np.cumsum(1 - y)))
    false = (false[-1] - false) / max(false[-1], 1)
    edges = np.concatenate(([x[0] - 1], x, [x[-1] + 1]))
    low, high = edges[:-1], edges[1:]
    errors = missed + 2 * false  # clean texts are many, so a false alarm weighs double
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    i = best[np.argmax(high[best] - low[best])]
    return float((low[i] + high[i]) / 2)


def _texts(column: pa.Array) -> Iterator[str | None]:
    """Texts one after the other; a batch has thousands, which need not all be Python objects at once."""
    return (t.as_py() for t in column)


def clean(df: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose score is below ``least``, with all their columns, filtered where they lie."""
    if model is None:
        return df
    shared, at, cut = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text), float(np.log(least / (1 - least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vectors(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(distances(shared.value, _texts(batch.column(at)), known) < cut))

    return df.mapInArrow(run, df.schema)


def scored(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    kind = df.schema[key].dataType.simpleString()
    if model is None:
        return df.select(key, F.lit(0.0).alias("score"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few megabytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vectors(shared.value)
        for batch in batches:
            d = distances(shared.value, _texts(batch.column(1)), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(d, -500, 500))), pa.float64())], [key, "score"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, score double")
