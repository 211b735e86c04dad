"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by the filter width less
one, so every window of the whole document is in exactly one chunk. Learned
filters slide over the bytes; each is max-pooled within a chunk; the document
is described by the maximum and the mean of its chunks, and a logistic unit
turns that into one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import map_column
from corpusloom.llm.labelled import fit_in_task, fold, sample_texts, training_labels
from corpusloom.plans.staging import table

WIDTH, FILTERS, CHUNK = 8, 16, 512
WINDOWS = CHUNK - WIDTH + 1
BLOCK = 1 << 15
FOLDS, HELD_OUT, CUT = 4, 2, 0.7


@dataclass
class Net:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray  # of maxima, then of means
    out_bias: float

    def pairs(self) -> np.ndarray:
        """Filters of two neighbouring bytes at once, by the 16-bit number they form."""
        f = self.filters
        return np.stack([(f[j][:, None] + f[j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)])


def join_texts(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, each padded for its last window; the first window of each chunk; the first chunk of each text; windows of no text)."""
    parts, starts, firsts, at, between = [], [], [], 0, []
    for text in texts:
        data = (text.encode() if isinstance(text, str) else text) or b"\0"
        firsts.append(len(starts))
        starts.extend(range(at, at + len(data), WINDOWS))
        parts += [data, bytes(WIDTH - 1)]
        at += len(data) + WIDTH - 1
        between.append(np.arange(at - WIDTH + 1, at))
    return np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(firsts), np.concatenate(between[:-1] or [np.array([], int)])


def pooled(data: np.ndarray, starts: np.ndarray, between: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Maximum of each filter over each chunk's windows; chunks x FILTERS."""
    n = len(data) - WIDTH + 1
    both = data[:-1].astype(np.uint16) << 8 | data[1:]
    best = np.full((len(starts), FILTERS), -np.inf, np.float32)
    a_chunk = 0
    while a_chunk < len(starts):  # whole chunks, about BLOCK windows at a time
        b_chunk = min(len(starts), a_chunk + BLOCK // WINDOWS)
        a, b = starts[a_chunk], starts[b_chunk] if b_chunk < len(starts) else n
        z = pairs[0].take(both[a:b], axis=0)
        for j in range(1, WIDTH // 2):
            z += pairs[j].take(both[a + 2 * j : b + 2 * j], axis=0)
        z[between[np.searchsorted(between, a) : np.searchsorted(between, b)] - a] = -np.inf
        best[a_chunk:b_chunk] = np.maximum.reduceat(z, starts[a_chunk:b_chunk] - a, axis=0)
        a_chunk = b_chunk
    return best


def _describe(chunks: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(firsts, len(chunks)))[:, None]
    return np.concatenate([np.maximum.reduceat(chunks, firsts, axis=0), np.add.reduceat(chunks, firsts, axis=0) / counts], axis=1)


def probabilities(net: Net, pairs: np.ndarray, texts: list[str | None]) -> np.ndarray:
    data, starts, firsts, between = join_texts(texts)
    hidden = np.maximum(pooled(data, starts, between, pairs) + net.bias, 0)
    return 1 / (1 + np.exp(-np.clip(_describe(hidden, firsts) @ net.out + net.out_bias, -30, 30)))


def fit(texts: list[tuple[str, int]], epochs: int = 4, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Net:
    """Fit on (text, label) by Adam; gradients reach the windows that held a maximum. One label only: its share is every score."""
    draw = np.random.default_rng(seed)
    net = Net((draw.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32), np.zeros(FILTERS, np.float32), (draw.standard_normal(2 * FILTERS) * 0.3).astype(np.float32), 0.0)
    y = np.array([k for _, k in texts], float)
    share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
    net.out_bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        net.out[:] = 0
        return net
    theta = [net.filters, net.bias, net.out, np.array([net.out_bias], np.float32)]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # labels count alike while filters form
    t = 0
    for _ in range(epochs):
        for some in np.array_split(draw.permutation(len(texts)), -(-len(texts) // batch)):
            data, starts, firsts, between = join_texts([texts[i][0] for i in some])
            ends = np.append(starts[1:], len(data) - WIDTH + 1)
            z = theta[0][0].take(data[: len(data) - WIDTH + 1], axis=0)
            for j in range(1, WIDTH):
                z += theta[0][j].take(data[j : len(data) - WIDTH + 1 + j], axis=0)
            z[between] = -np.inf
            top = np.stack([a + z[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])  # chunks x FILTERS
            pre = np.take_along_axis(z, top, axis=0) + theta[1]
            hidden = np.maximum(pre, 0)
            doc = np.repeat(np.arange(len(some)), np.diff(np.append(firsts, len(starts))))
            features = _describe(hidden, firsts)
            p = 1 / (1 + np.exp(-np.clip(features @ theta[2] + theta[3], -30, 30)))
            g = (weight[some] * (p - y[some]) / len(some)).astype(np.float32)
            by_feature = g[:, None] * theta[2]
            counts = np.bincount(doc)[:, None]
            is_max = hidden == features[doc, :FILTERS]
            back = (by_feature[doc, :FILTERS] * is_max + (by_feature[:, FILTERS:] / counts)[doc]) * (pre > 0)
            grad = np.zeros_like(theta[0])
            column = np.broadcast_to(np.arange(FILTERS), top.shape)
            for j in range(WIDTH):
                np.add.at(grad[j], (data[top + j], column), back)
            grads = [grad, back.sum(axis=0), features.T @ g, np.array([g.sum()], np.float32)]
            t += 1
            for x, m, v, d in zip(theta, first, second, grads, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.out_bias = float(theta[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1200, max_bytes: int = 16384, seed: int = 5) -> Net:
    """Learn from labels outside the held-out fold, on at most ``per_label`` rows of each label, of at most ``max_bytes`` each."""
    sample = sample_texts(docs, training_labels(labels, "quality", FOLDS, HELD_OUT), per_label, max_bytes, seed)
    return fit_in_task(sample, lambda texts: fit(texts, seed=seed))


def score_texts(docs: DataFrame, net: Net, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1) of every row, from all bytes of its text. Null and empty texts are scored as one zero byte.

    Null ids, repeated rows and other columns of ``docs`` make no difference; a
    column of ``keep`` that is named score gives way to the new one. No rows: no
    rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of one size whatever the corpus

    def make():
        net = shared.value
        pairs = net.pairs()
        return lambda texts: (None, probabilities(net, pairs, texts).astype(float))

    kept = [F.col(c) for c in keep if c != "score"]
    return map_column(docs.select(*kept, F.col(text_col).cast("binary").alias("text of score")), "text of score", make, "score double", 200, 2 << 20)


def op6_quality(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document; null ids are in no fold and not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
