"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled rows are a sample of all
training documents, drawn without a look at the labels: those with no label, with
a 0 and with a 1 in their natural share. With the class prior p the negative risk is
what the unlabelled rows show less p times what the positives show, and it may
not fall below zero: where it would, a step climbs back instead. Several linear
classifiers over word presence are fitted in numpy on different shares of the
unlabelled rows, and their probabilities are averaged.

Features are the word slots that confirmed rows hold clearly more often than
unlabelled ones: by ``least_z`` standard errors, and in ``support`` of them, three at
least. So few confirmed rows give few features, many give more, and rare words
that two of them share by chance are none.

The prior is a parameter or estimated from the same two samples. Unlabelled rows
are p parts positives, so whatever set of texts is looked at, p is at most its
share among them over its share among positives. The estimate is the least such
ratio over the sets "scores at least t", with scores of classifiers that were
fitted on the other parts of the rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import map_column
from corpusloom.llm.labelled import fit_in_task, fold, sample_texts, sample_unlabelled, training_labels
from corpusloom.plans.staging import table

SLOTS = 1 << 18
CACHED = 400_000
STRIP = b".,;:!?\"'()[]{}<>*&%$#@|-_"
FOLDS, HELD_OUT, CUT = 3, 1, 0.7


class _Slots(dict):
    """Hash slot by word, for as many words as the bound allows."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = slot = zlib.crc32(word.strip(STRIP)) % SLOTS
        return slot


def word_slots(text: bytes | None, slots: _Slots) -> np.ndarray:
    """Distinct slots of the words of a whole text in UTF-8; A-Z in lower case, signs around words dropped."""
    words = set((text or b"").lower().split())
    return np.unique(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)))


@dataclass
class Model:
    weights: np.ndarray  # classifiers x slots
    bias: np.ndarray
    prior: float

    def score(self, slots: np.ndarray) -> float:
        z = self.weights[:, slots].sum(axis=1) + self.bias
        return float(np.mean(1 / (1 + np.exp(-np.clip(z, -30, 30)))))


def _fit_one(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, weight: np.ndarray, n_cols: int, prior: float, steps: int, l2: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with logistic loss; (weights, bias)."""
    theta, m, v = np.zeros(n_cols + 1), np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    theta[-1] = np.log(prior / (1 - prior))
    n = len(positive)
    unlabelled = weight / weight.sum()
    confirmed = positive / positive.sum()
    for t in range(1, steps + 1):
        z = np.bincount(rows, theta[cols], n) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        down = np.logaddexp(0, z)  # loss as a negative
        negative = (unlabelled * down).sum() - prior * (confirmed * down).sum()
        against = (unlabelled - prior * confirmed) * p  # gradient of the negative risk by z
        g = against - prior * confirmed * (1 - p) if negative >= 0 else -against
        grad = np.append(np.bincount(cols, g[rows], n_cols), g.sum())
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def features(sets: list[np.ndarray], positive: np.ndarray, support: float, least_z: float) -> np.ndarray:
    """Slots that occur clearly more often in the positive ``sets`` than in all, in order."""
    cols, own = np.concatenate(sets), np.concatenate([s for s, y in zip(sets, positive, strict=True) if y])
    seen, seen_positive = np.bincount(cols, minlength=SLOTS), np.bincount(own, minlength=SLOTS)
    n_p, expected = positive.sum(), seen / len(sets)
    z = (seen_positive / n_p - expected) / np.sqrt(expected * (1 - expected) / n_p + 1e-9)
    return np.flatnonzero((seen_positive >= max(3, support * n_p)) & (z >= least_z))


def fit(texts: list[tuple[str, int]], prior: float, classifiers: int = 3, support: float = 0.01, least_z: float = 4, steps: int = 300, l2: float = 0.003, seed: int = 11) -> Model:
    """Fit on (text, 1 if confirmed toxic else 0 for unlabelled, positives in their share included). Without either kind every score is ``prior``.

    ``l2`` is the weight of the squares in terms of one confirmed row.
    """
    positive = np.array([y for _, y in texts], float)
    prior = float(np.clip(prior, 1e-4, 0.9))
    flat = np.log(prior / (1 - prior))
    model = Model(np.zeros((classifiers, SLOTS), np.float32), np.full(classifiers, flat), prior)
    if not 0 < positive.sum() < len(texts):
        return model
    slots = _Slots()
    sets = [word_slots(t.encode(), slots) for t, _ in texts]
    chosen = features(sets, positive, support, least_z)
    rows, cols = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[cols] >= 0
    rows, cols = rows[use], place[cols[use]]
    draw = np.random.default_rng(seed)
    for k in range(classifiers):
        w = (positive == 0) * (draw.random(len(texts)) < 0.8)
        if w.any():
            model.weights[k, chosen], model.bias[k] = _fit_one(rows, cols, positive, w, len(chosen), prior, steps, l2 / positive.sum())
    return model


def estimate_prior(texts: list[tuple[str, int]], start: float = 0.1, least: float = 0.5, parts: int = 4, seed: int = 11) -> float:
    """Share of positives among the unlabelled of ``texts``: the least ratio of tails of cross-fitted scores.

    Tails hold at least ``least`` of the positives. One row is added to the
    unlabelled ones of a tail, so an empty one gives no prior of zero.
    """
    part = np.array([zlib.crc32(f"{seed}{t}".encode()) % parts for t, _ in texts])
    truth, slots, scores = np.array([y for _, y in texts]), _Slots(), np.zeros(len(texts))
    for k in range(parts):
        model = fit([x for x, h in zip(texts, part, strict=True) if h != k], start, classifiers=1, seed=seed)
        for i in np.flatnonzero(part == k):
            scores[i] = model.score(word_slots(texts[i][0].encode(), slots))
    confirmed, others = np.sort(scores[truth == 1]), np.sort(scores[truth == 0])
    if not len(confirmed) or not len(others):
        return 0.0
    tails = np.unique(confirmed)
    share = 1 - np.searchsorted(confirmed, tails) / len(confirmed)
    tail = (len(others) - np.searchsorted(others, tails) + 1) / (len(others) + 1)
    return min(1.0, float(np.min((tail / share)[share >= least])))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 4000, max_bytes: int = 16384, seed: int = 11, prior: float | None = None) -> Model:
    """Learn from confirmed toxic rows and unlabelled ones outside the held-out fold; without ``prior`` it is estimated.

    At most ``per_label`` confirmed toxic rows and as many unlabelled ones, of
    at most ``max_bytes`` each. Labels other than 1 are not read.
    """
    known = training_labels(labels, "toxic", FOLDS, HELD_OUT).filter("label = 1")
    sample = sample_texts(docs, known, per_label, max_bytes, seed).unionByName(sample_unlabelled(docs, FOLDS, HELD_OUT, per_label, max_bytes, seed))

    def of(texts: list[tuple[str, int]]) -> Model:
        if not any(y for _, y in texts):
            return fit([], 0.0)
        return fit(texts, estimate_prior(texts, seed=seed) if prior is None else prior, seed=seed)

    return fit_in_task(sample, of)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1) of every row; every whole text is read. Null and empty texts have a score too.

    Null ids, repeated rows and other columns of ``docs`` make no difference; a
    column of ``keep`` that is named score gives way to the new one. No rows: no
    rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)  # classifiers x 2^18 floats, whatever the corpus

    def make():
        slots, model = _Slots(), weights.value
        return lambda texts: (None, [model.score(word_slots(t, slots)) for t in texts])

    kept = [F.col(c) for c in keep if c != "score"]
    return map_column(docs.select(*kept, F.col(text_col).cast("binary").alias("text of score")), "text of score", make, "score double")


def reject_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows whose score reaches ``cut``; columns and their names as before.

    No labels: all rows stay. Null and empty texts, null ids and repeated rows
    are scored like any other.
    """
    model = train(docs, labels)
    weights = docs.sparkSession.sparkContext.broadcast(model)
    slots = _Slots()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([weights.value.score(word_slots(t, slots)) for t in texts], dtype=float)

    return docs.filter(score(F.col("text").cast("binary")) < cut)


def op1_toxicity(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document; null ids are in no fold and not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
