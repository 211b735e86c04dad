"""Scoring by a gated recurrent language model in numpy.

Word counts cover all training texts. The most frequent words have places in
the model, in classes of equal size by frequency; all others form one class
whose words keep their smoothed share of its counts. The output is factored:
the probability of a word is that of its class, given the state, times that of
the word within the class. Training is truncated backpropagation through time:
a bounded sample gives a starting point, then every task trains that model on
all training texts of its partition and the results are averaged, weighted by
tokens (so scores depend a little on how the table is split). Training and scoring carry the state from window to window, so that a document's
log-likelihood is that of the complete document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corpusloom.llm.batches import map_column, pieces_of
from corpusloom.llm.labelled import fit_in_task, fold
from corpusloom.plans.staging import stage, table

STATE, PER_CLASS, CLASSES = 32, 64, 16
PLACES = PER_CLASS * CLASSES  # place 0 is the end; place PLACES stands for all other words
KNOWN = 1 << 20  # words whose counts travel to the tasks; the others' counts are joined
FOLDS, HELD_OUT = 7, 2
BLOCK = 4096  # parameters that are averaged in one row
SIGNS = np.array([-1, -1, -2], np.float32)  # of what is added up for the gates and the new state
END = 0  # hash of the end, which is no word
STEP_TOKENS = 2048  # tokens, at least, that a step of training is taken over
AT_ONCE = 10_000, 32 << 20  # rows and bytes of texts that are laid out in lanes together


def word_hashes(words) -> np.ndarray:
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    h[h == END] = 1
    return h


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    counts: np.ndarray
    places: np.ndarray  # PLACES for words that have none
    tokens: int  # N
    types: int  # V
    rest: float  # log10 of what a smoothed count is divided by among words without a place


@dataclass
class Batch:
    """Texts as numbers: of words here, then of places in the model."""

    ids: list[np.ndarray]
    hashes: np.ndarray
    found: np.ndarray
    counts: np.ndarray
    places: np.ndarray


def words_of(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, the number of each word of all texts among them, where each text's words start, and the end); null as empty."""
    as_text = pa.array(texts, pa.binary()).fill_null(b"").view(pa.string())  # bytes stay as they are: A-Z only, ASCII white space only
    split = pc.ascii_split_whitespace(pc.ascii_lower(as_text))
    flat, starts = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty word
    if not there.all():
        flat, starts = flat.filter(pa.array(there)), np.concatenate([[0], np.cumsum(there)])[starts]
    encoded = flat.dictionary_encode()
    return encoded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), encoded.indices.to_numpy(), starts


def number(texts: list[bytes | None], vocabulary: Vocabulary) -> Batch:
    words, numbers, starts = words_of(texts)
    ids = [numbers[i:j] for i, j in pairwise(starts.tolist())]
    hashes = word_hashes(words)
    at = np.minimum(np.searchsorted(vocabulary.hashes, hashes), max(0, len(vocabulary.hashes) - 1))
    found = vocabulary.hashes[at] == hashes if len(vocabulary.hashes) else np.zeros(len(hashes), bool)
    pick = lambda x, other: np.where(found, x[at], other) if len(x) else np.full(len(hashes), other)
    return Batch(ids, hashes, found, pick(vocabulary.counts, 0), pick(vocabulary.places, PLACES))


class Net:
    """Parameters in one flat vector, so that they can be averaged."""

    SHAPES = {"x": (3, PLACES + 1, STATE), "u": (3, STATE, STATE), "wc": (STATE, CLASSES + 1), "bc": (CLASSES + 1,), "wo": (CLASSES, STATE, PER_CLASS), "bo": (CLASSES, PER_CLASS)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, seed: int = 3) -> Net:
        net = cls((np.random.default_rng(seed).standard_normal(cls.SIZE) * 0.1).astype(np.float32))
        net.bc[:] = 0
        net.bo[:] = 0
        return net


@dataclass
class Lanes:
    """Documents laid end to end in parallel lanes, longest lane first; steps x lanes."""

    tokens: np.ndarray
    before: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    active: np.ndarray = field(default=None)


def lanes(docs: list[np.ndarray], width: int, draw: np.random.Generator | None = None) -> Lanes:
    """``docs``: places. The longest are dealt first, each to the shortest lane; with ``draw`` every lane is shuffled."""
    width = max(1, min(width, len(docs)))
    heap, dealt = [(0, k) for k in range(width)], [[] for _ in range(width)]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, k = heapq.heappop(heap)
        dealt[k].append(d)
        heapq.heappush(heap, (n + len(docs[d]), k))
    for lane in dealt if draw else ():
        draw.shuffle(lane)
    length = np.array([sum(len(docs[d]) for d in lane) for lane in dealt])
    order = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    tokens, doc = np.zeros((steps, width), np.int32), np.full((steps, width), -1, np.int32)
    first = np.ones((steps, width), bool)
    for column, k in enumerate(order):
        at = 0
        for d in dealt[k]:
            n = len(docs[d])
            tokens[at : at + n, column], doc[at : at + n, column], first[at + 1 : at + n, column] = docs[d], d, False
            at += n
    before = np.zeros_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = 0  # a document starts after an end
    return Lanes(tokens, before, first, doc, (doc >= 0).sum(axis=1))


def _logits(s: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of states ``s``, less their maximum if they could overflow; no state is beyond 1."""
    x = s @ weights
    x += bias
    if np.abs(weights).sum(axis=0).max() + np.abs(bias).max() > 80:
        x -= x.max(axis=1, keepdims=True)
    return x


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of logits ``x`` at one place of each row."""
    found = x[np.arange(len(x)), at]
    return found - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], np.float32))


def _softmax_error(x: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """(softmax of ``x``, less 1 at one place of each row) x ``scale``, in place."""
    np.exp(x, out=x)
    x *= (scale / (x @ np.ones(x.shape[1], np.float32)))[:, None]
    x[np.arange(len(x)), at] -= scale
    return x


def _starts(run: Lanes, a: int, b: int, n: int) -> list[np.ndarray]:
    """For each of the steps a to b, which of the first n lanes start a text there, or are over."""
    step, lane = np.nonzero(run.first[a:b, :n])
    return np.split(lane, np.searchsorted(step, np.arange(1, b - a)))


def _forward(net: Net, run: Lanes, a: int, b: int, n: int, h: np.ndarray, keep: bool):
    """States of steps a to b for the first n lanes; what the backward pass needs, if ``keep``: states before, gates, -2 x what
    the reset gate lets through, states less new ones, where texts start.

    Everything that a step touches is contiguous. A gate is 1 / (1 + exp(-x)), and tanh x is 2 / (1 + exp(-2 x)) - 1, which takes
    less time than numpy's; the signs and the 2 are in the weights.
    """
    starts = _starts(run, a, b, n)
    gates = np.empty((3, b - a, n, STATE), np.float32)  # reset, update and new state
    for table, factor, gate in zip(net.x, SIGNS, gates, strict=True):
        np.take(table * factor, run.before[a:b, :n], axis=0, out=gate, mode="clip")
    u = net.u * SIGNS[:, None, None]
    states, y = np.empty((b - a, n, STATE), np.float32), np.empty((3, n, STATE), np.float32)
    before, passed, moved = (np.empty((b - a if keep else 1, n, STATE), np.float32) for _ in range(3))
    for t in range(b - a):
        k = t if keep else 0
        h0, through, less = before[k], passed[k], moved[k]
        h0[:] = h
        if len(starts[t]):
            h0[starts[t]] = 0
        np.matmul(h0, u, out=y)
        both = gates[:2, t]
        both += y[:2]
        np.exp(both, out=both)
        both += 1
        np.reciprocal(both, out=both)
        new = gates[2, t]
        np.multiply(y[2], both[0], out=through)
        new += through
        np.exp(new, out=new)
        new += 1
        np.divide(2, new, out=new)
        new -= 1
        np.subtract(h0, new, out=less)
        less *= both[1]
        h = np.add(less, new, out=states[t])
    return states, (before, gates, passed, moved, starts), h


def _by_class(run: Lanes, a: int, b: int, n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(places in the window, words, (class, from, to)) of the tokens of a window, in the order of their classes."""
    at = np.flatnonzero(run.doc[a:b, :n].ravel() >= 0)
    word = run.tokens[a:b, :n].ravel()[at]
    order = np.argsort((word // PER_CLASS).astype(np.uint8), kind="stable")
    at, word = at[order], word[order]
    bounds = np.searchsorted(word // PER_CLASS, np.arange(CLASSES + 1))
    return at, word, [(c, i, j) for c, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if i < j]


def _windows(run: Lanes, window: int, tokens: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, lanes) of windows of ``window`` steps, longer where few lanes go on: up to ``tokens`` tokens, 512 steps at most."""
    a = 0
    while a < len(run.tokens):
        n = int(run.active[a])
        b = min(len(run.tokens), a + max(window, min(512, tokens // n)))
        yield a, b, n
        a = b


def log_likelihoods(net: Net, docs: list[np.ndarray], width: int = 512, window: int = 32) -> np.ndarray:
    """Natural log-likelihood of each document's places (for PLACES, of its class), the state carried across windows."""
    run, total = lanes(docs, width), np.zeros(len(docs))
    h = np.zeros((run.tokens.shape[1], STATE), np.float32)
    for a, b, n in _windows(run, window, 4096):
        states, _, h = _forward(net, run, a, b, n, h[:n], False)
        at, word, classes = _by_class(run, a, b, n)
        s = states.reshape(-1, STATE).take(at, axis=0)
        found = _log_of(_logits(s, net.wc, net.bc), word // PER_CLASS)
        for c, i, j in classes:
            found[i:j] += _log_of(_logits(s[i:j], net.wo[c], net.bo[c]), word[i:j] - c * PER_CLASS)
        total += np.bincount(run.doc[a:b, :n].ravel()[at], found, len(docs))
    return total


class Trainer:
    """Truncated backpropagation through time with Adam.

    Gradients of windows are summed until STEP_TOKENS tokens have been read, so
    that every token has the same say: long texts, which go on alone when the
    others have ended, do not take steps of their own.
    """

    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.tokens, self.t = Net(net.flat.copy()), rate, 0, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)
        self.held, self.waiting = Net(np.zeros(Net.SIZE, np.float32)), 0

    def learn(self, docs: list[np.ndarray], width: int = 384, window: int = 16) -> None:
        """One pass over all of ``docs``; gradients stop at the bounds of a window, states go on to the end of the text."""
        run, net = lanes(docs, width, np.random.default_rng(self.t)), self.net
        h = np.zeros((run.tokens.shape[1], STATE), np.float32)
        for a, b, n in _windows(run, window, STEP_TOKENS):
            states, (before, gates, passed, moved, starts), h = _forward(net, run, a, b, n, h[:n], True)
            at, word, classes = _by_class(run, a, b, n)
            s = states.reshape(-1, STATE).take(at, axis=0)
            grad, scale = self.held, np.float32(1)
            p = _softmax_error(_logits(s, net.wc, net.bc), word // PER_CLASS, scale)
            grad.wc += s.T @ p
            grad.bc += np.ones(len(p), np.float32) @ p
            back = p @ net.wc.T
            for c, i, j in classes:
                q = _softmax_error(_logits(s[i:j], net.wo[c], net.bo[c]), word[i:j] - c * PER_CLASS, scale)
                grad.wo[c] += s[i:j].T @ q
                grad.bo[c] += np.ones(j - i, np.float32) @ q
                back[i:j] += q @ net.wo[c].T
            outer = np.zeros_like(states)
            outer.reshape(-1, STATE)[at] = back
            halves = np.array([-0.5, 1, 1], np.float32)  # into[0] is made of -2 x what was let through
            into, d_new, dh = np.empty_like(gates), np.empty_like(states), np.zeros((n, STATE), np.float32)
            other, y, back_u = np.empty_like(dh), np.empty((3, n, STATE), np.float32), net.u.transpose(0, 2, 1) * halves[:, None, None]
            for t in range(b - a - 1, -1, -1):
                r, z, new = gates[:, t]
                dr, dz, inner_d = into[:, t]
                dn = d_new[t]
                dh += outer[t]
                np.subtract(1, z, out=other)
                np.multiply(new, new, out=dn)
                np.subtract(1, dn, out=dn)
                dn *= other
                dn *= dh
                np.multiply(moved[t], other, out=dz)
                dz *= dh
                np.subtract(1, r, out=dr)
                dr *= passed[t]
                dr *= dn
                np.multiply(dn, r, out=inner_d)
                dh *= z
                np.matmul(into[:, t], back_u, out=y)
                for part in y:
                    dh += part
                if len(starts[t]):
                    dh[starts[t]] = 0
            came = run.before[a:b, :n].ravel()
            known = np.flatnonzero(came < PLACES)
            known = known[np.argsort(came[known].astype(np.uint16), kind="stable")]
            came = came[known]
            first = np.flatnonzero(np.diff(came, prepend=-1))
            held, one, ones = before.reshape(-1, STATE).T, np.ones((b - a) * n, np.float32), np.ones(len(known), np.float32)
            for k, d in enumerate((into[0], into[1], d_new)):
                grad.u[k] += (held @ into[k].reshape(-1, STATE)) * halves[k]
                d = d.reshape(-1, STATE)
                rows = d.take(known, axis=0)
                grad.x[k, PLACES] += (one @ d - ones @ rows) * halves[k]  # the most frequent place: what the others leave
                if len(known):
                    grad.x[k, came[first]] += np.add.reduceat(rows, first, axis=0) * halves[k]
            self.tokens += len(word)
            self.waiting += len(word)
            if self.waiting >= STEP_TOKENS:
                self.step()

    def step(self) -> None:
        """Take the step that is due for the gradients since the last one; too few tokens make a smaller one."""
        if self.waiting:
            self._step(self.held.flat / np.float32(max(self.waiting, STEP_TOKENS)))
            self.held.flat[:], self.waiting = 0, 0

    def _step(self, g: np.ndarray) -> None:
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g = g / norm
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.005 * (g * g - self.v)
        rate = self.rate / (1 + self.t / 400)
        self.net.flat -= (rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.v / (1 - 0.995**self.t)) + 1e-8)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word, by its 64-bit hash, and the end occur in the column ``text``, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.diff(h, prepend=h[0] - 1))
            return h[first], np.add.reduceat(n, first)

        for batch in batches:
            text = batch.column(0)
            for a, b in pieces_of(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), *AT_ONCE):
                words, numbers, _ = words_of(text.slice(a, b - a).to_pylist())
                held.append((np.append(word_hashes(words), END), np.append(np.bincount(numbers, minlength=len(words)), b - a)))
                if sum(len(h) for h, _ in held) > 1_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    return texts.select(F.col("text").cast("binary")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The counts that tasks look up themselves: of the end and the most frequent words, at most KNOWN, and the totals of all."""
    level = F.floor(F.log2("n") * 8)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).orderBy(F.desc("level")).collect()  # 8 x 64 rows at most
    types, tokens, least, held = sum(r["types"] for r in levels), sum(r["tokens"] for r in levels), None, 0
    for r in levels:
        if (held := held + r["types"]) > KNOWN:
            break
        least = r["level"]
    top = counts.filter((F.col("h") == END) | (level >= least if least is not None else F.lit(False))).toArrow()
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((h, -n))
    order = np.concatenate([order[h[order] == END], order[h[order] != END]])[:PLACES]  # the end first
    places = np.full(len(h), PLACES, np.int64)
    places[order] = np.arange(len(order))
    other = tokens - int(n[order].sum()) + types - len(order) + 1
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], n[by_hash], places[by_hash], tokens, types, float(np.log10(other)))


def totals(batch: Batch) -> tuple:
    """For each text: how many words are found, the sum of log10 (count + 1), how many words have no place and their sum; the hashes and numbers of words that are not found."""
    n, w = len(batch.ids), max(1, len(batch.hashes))
    flat = np.concatenate([np.empty(0, np.int32), *batch.ids])
    doc = np.repeat(np.arange(n), [len(i) for i in batch.ids])
    logs, away = np.log10(batch.counts + 1.0), batch.places == PLACES
    total = lambda of_word: np.bincount(doc, of_word[flat], n)
    there = np.flatnonzero(~batch.found[flat])
    pairs, times = np.unique(doc[there] * w + flat[there], return_counts=True)
    bounds, hashes = np.searchsorted(pairs, np.arange(n + 1) * w).tolist(), batch.hashes[pairs % w]
    rest = [(hashes[i:j], times[i:j]) for i, j in pairwise(bounds)]
    return total(batch.found).astype(np.int64), total(logs), total(away).astype(np.int64), total(np.where(away, logs, 0)), [h for h, _ in rest], [k for _, k in rest]


def _placed(batch: Batch) -> list[np.ndarray]:
    return [np.append(batch.places[i], 0).astype(np.int32) for i in batch.ids]


def train(texts: DataFrame, words: Vocabulary, sample: int = 1500, max_bytes: int = 32768, rate: float = 0.01) -> Net:
    """A start from at most ``sample`` texts of at most ``max_bytes``, then one averaged pass over all of ``texts`` (id, text)."""
    spark = texts.sparkSession
    some = texts.filter(F.octet_length("text").between(1, max_bytes)).select("text", F.xxhash64("id", F.lit(1)).alias("rank"))
    last = some.select("rank").orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]
    known = spark.sparkContext.broadcast(words)  # KNOWN words at most
    picked = some.filter(F.col("rank") <= last).orderBy("rank", F.xxhash64("text")).limit(sample).select(F.col("rank").alias("id"), "text", F.lit(0).alias("label"))

    def begin(rows: list[tuple[str, int]]) -> np.ndarray:
        first, texts = Trainer(Net.start(), rate), [t.encode() for t, _ in rows]
        while texts and first.t < 1500:
            first.learn(_placed(number(texts, known.value)), 128)
        first.step()
        return first.net.flat

    begun = fit_in_task(picked, begin) if last is not None else Net.start().flat
    start = spark.sparkContext.broadcast(begun)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, shard = Trainer(Net(start.value), rate / 3), 0
        for batch in batches:
            text, part = batch.columns
            for a, b in pieces_of(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), *AT_ONCE):
                shard = part[a].as_py()
                trainer.learn(_placed(number(text.slice(a, b - a).to_pylist(), known.value)))
        trainer.step()
        if trainer.tokens:
            flat = trainer.net.flat
            blocks = [flat[a : a + BLOCK] for a in range(0, Net.SIZE, BLOCK)]
            columns = [pa.array(range(len(blocks)), pa.int32()), pa.array([shard] * len(blocks), pa.int32()), pa.array([float(trainer.tokens)] * len(blocks)), pa.array(blocks, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "shard", "tokens", "flat"])

    def mean(f: pd.DataFrame) -> pd.DataFrame:
        flat = np.average(np.stack(f["flat"].to_numpy()), axis=0, weights=f["tokens"])
        return pd.DataFrame({"block": [f["block"].iloc[0]], "shard": [0], "tokens": [f["tokens"].sum()], "flat": [flat.tolist()]})

    schema = "block int, shard int, tokens double, flat array<float>"
    trained = stage(texts.select(F.col("text").cast("binary"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("shard")).mapInArrow(run, schema), "trained")
    near = trained.groupBy("block", "shard").applyInPandas(mean, schema)  # two levels, so that no group has all tasks' rows
    rows = near.groupBy("block").applyInPandas(mean, schema).select("block", "flat").collect()  # one model
    if not rows:
        return Net(begun)
    return Net(np.concatenate([np.array(r["flat"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]))


def score(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    The model learns from rows where ``held_out`` is false. Null texts count as
    empty: the end alone. Without any training rows every count is zero. Words
    are told apart by 64-bit hashes. Null ids and repeated rows are scored like
    others; other columns of ``docs`` are not read. No rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    training = rows.filter(~F.col("held"))
    counts = stage(word_counts(training), "word-counts")
    words = vocabulary(counts)
    net = train(training.select("id", "text"), words)
    known, flat = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(net.flat)

    def make():
        words, net = known.value, Net(flat.value)
        end = int(words.counts[np.searchsorted(words.hashes, END)]) if len(words.hashes) and END in words.hashes else 0

        def measure(texts):
            batch = number(texts, words)
            known, logs, away, away_logs, rest_h, rest_n = totals(batch)
            return None, [len(i) + 1 for i in batch.ids], known + (end > 0), logs + np.log10(end + 1.0), away, away_logs, log_likelihoods(net, _placed(batch)) / np.log(10), rest_h, rest_n

        return measure

    new = "n_tokens long, known long, logs double, away long, away_logs double, model double, rest_h array<long>, rest_n array<long>"
    scored = stage(map_column(rows.withColumn("text", F.col("text").cast("binary")), "text", make, new, *AT_ONCE), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rest_h", "rest_n")).alias("x")).select("row", F.col("x.rest_h").alias("h"), F.col("x.rest_n").alias("k"))
    met = rare.join(counts, "h").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    all_ = scored.drop("rest_h", "rest_n").join(stage(met, "rare-words"), "row", "left")
    more = F.coalesce("more_logs", F.lit(0.0))
    base = F.col("logs") + more - F.col("n_tokens") * float(np.log10(words.tokens + words.types + 1))
    full = F.col("model") + F.col("away_logs") + more - F.col("away") * words.rest
    return all_.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))


def op7_language_model(spark, sf_dir):
    """The contract's columns of every document; null ids are in no fold and learnt from."""
    return score(table(spark, sf_dir, "documents"), fold("doc_id", FOLDS) == HELD_OUT)
