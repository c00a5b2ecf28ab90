"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Every word enters the network as a hashed word embedding, the mean embedding of its hashed
character n-grams, and the log-odds of the word and of its most telling n-gram. Two recurrent
passes read a window of words, attention pools their states, and a document's score is that
of its highest window; windows overlap by half and cover the whole text. A word of over 64 bytes,
such as text without blanks, takes a place for each of its overlapping parts. The network is
trained in numpy on the driver from a bounded sample of labelled documents, and scores run in
Arrow batches on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, STRIDE = 24, 12
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 18
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 8
GRAM_SIZES = (3, 4, 5, 6)
#: Words of more bytes fall into parts of so many, each so far after the last; what two parts share holds every n-gram.
LONG_BYTES, PART_BYTES, PART_STRIDE = 64, 24, 18
#: Labelled documents of each class that a fit takes at most.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 1500, 3000
#: Words of one text that a fit holds; of a longer one it takes so many in passages spread evenly over all of it.
SAMPLE_WORDS, PASSAGE = 16_384, 64
THRESHOLD = 0.3
#: Steps of an epoch, if that leaves each at least 16 windows and at most 256.
STEPS = 32
_CACHE_WORDS = 200_000
_BLOCK_WINDOWS = 8192

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words, the long ones in parts; a blank stands where the word goes on before or after a part."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []
    if max(map(len, words), default=0) <= LONG_BYTES:
        return words
    return [part for word in words for part in (_parts(word) if len(word) > LONG_BYTES else (word,))]


def _parts(word: bytes) -> list[bytes]:
    last = -(-(len(word) - PART_BYTES) // PART_STRIDE) * PART_STRIDE
    return [
        (b" " if at else b"") + word[at : at + PART_BYTES] + (b" " if at < last else b"")
        for at in range(0, last + 1, PART_STRIDE)
    ]


def grams_of(word: bytes) -> list[int]:
    """Buckets of the n-grams of a word, or of a part of one, with marks at the word's ends."""
    marked = (b"" if word[:1] == b" " else b"<") + word.strip(b" ") + (b"" if word[-1:] == b" " else b">")
    crc = zlib.crc32
    return [crc(marked[i : i + n]) % GRAM_BUCKETS for n in GRAM_SIZES for i in range(len(marked) - n + 1)] or [crc(marked) % GRAM_BUCKETS]


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % WORD_BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def windows_of(length: int) -> int:
    return max(1, -(-max(0, length - WINDOW) // STRIDE) + 1)


@dataclass
class Network:
    """Parameters; the first half of ``u`` and ``w`` reads forwards, the other backwards."""

    word: np.ndarray
    gram: np.ndarray
    word_odds: np.ndarray
    gram_odds: np.ndarray
    w: np.ndarray  # inputs x (2 directions * 3 gates * hidden)
    b: np.ndarray
    u: np.ndarray  # 2 x hidden x (3 gates * hidden)
    attention: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    index: dict[bytes, int] = field(default_factory=dict, repr=False)
    rows: list[np.ndarray] = field(default_factory=list, repr=False)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        inputs = WORD_DIM + GRAM_DIM + 2
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            normal(WORD_BUCKETS, WORD_DIM, scale=0.1), normal(GRAM_BUCKETS, GRAM_DIM, scale=0.1),
            np.zeros(WORD_BUCKETS, np.float32), np.zeros(GRAM_BUCKETS, np.float32),
            normal(inputs, 6 * HIDDEN, scale=0.3), np.zeros(6 * HIDDEN, np.float32), normal(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            normal(2 * HIDDEN, scale=0.3), normal(2 * HIDDEN, scale=0.3), np.full(1, -2.0, np.float32),
        )

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of some words, and the buckets they came from."""
        buckets = np.array([_bucket(w) for w in words], dtype=np.int64)
        grams = [grams_of(w) for w in words]
        sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        flat = np.fromiter((g for own in grams for g in own), dtype=np.int64, count=int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(self.gram[flat], starts, axis=0) / sizes[:, None]
        odds = np.maximum.reduceat(self.gram_odds[flat], starts)
        flat = flat.astype(np.int32)
        x = np.concatenate([self.word[buckets], mean, self.word_odds[buckets, None], odds[:, None]], axis=1)
        return x.astype(np.float32), buckets, flat, sizes

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words, and the table of their projected inputs; row 0 is padding."""
        if len(self.index) > _CACHE_WORDS or not self.rows:
            self.index, self.rows = {}, [np.zeros((1, 6 * HIDDEN), np.float32)]
        index = self.index
        fresh: list[bytes] = []
        for words in texts:
            for w in words:
                if w not in index:
                    index[w] = len(index) + 1
                    fresh.append(w)
        for first in range(0, len(fresh), 20_000):
            self.rows.append(self.inputs(fresh[first : first + 20_000])[0] @ self.w + self.b)
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]
        return np.array([index[w] for words in texts for w in words], dtype=np.int64), self.rows[0]

    def forward(self, table: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows, given as rows of ``table`` (windows x words, 0 after the end)."""
        n, length = at.shape
        mask = (at > 0).astype(np.float32)
        states = np.zeros((n, length, 2 * HIDDEN), np.float32)
        steps = []
        for way in (0, 1):
            own = np.ascontiguousarray(table[:, way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                x, g = own.take(at[:, t], axis=0), h @ self.u[way]
                gates = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
                gates *= 0.5  # the logistic function by way of tanh, which cannot overflow
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = r * g[:, 2 * HIDDEN :]
                new += x[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                was, h = h, h + mask[:, t, None] * (1 - z) * (new - h)
                states[:, t, way * HIDDEN : (way + 1) * HIDDEN] = h
                if keep:
                    steps.append((way, t, was, z, r, new, g[:, 2 * HIDDEN :]))
        scores = np.where(mask > 0, states @ self.attention, -1e9)
        weights = np.exp(scores - scores.max(axis=1, keepdims=True)) * mask
        weights /= np.maximum(weights.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weights, states)
        logits = pooled @ self.out + self.bias[0]
        return (logits, mask, states, weights, pooled, steps) if keep else logits

    def backward(self, kept, at: np.ndarray, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the projected input at every place."""
        _, mask, states, weights, pooled, steps = kept
        grads = {"out": pooled.T @ slope, "bias": slope.sum(keepdims=True), "u": np.zeros_like(self.u)}
        d_pooled = slope[:, None] * self.out
        by_weight = np.einsum("nh,nth->nt", d_pooled, states)
        d_scores = weights * (by_weight - (weights * by_weight).sum(axis=1, keepdims=True))
        grads["attention"] = np.einsum("nt,nth->h", d_scores, states)
        d_states = weights[:, :, None] * d_pooled[:, None, :] + d_scores[:, :, None] * self.attention
        d_inputs = np.zeros((*at.shape, 6 * HIDDEN), np.float32)
        carry = [np.zeros((len(at), HIDDEN), np.float32) for _ in (0, 1)]
        for way, t, was, z, r, new, g in reversed(steps):
            d_h = carry[way] + d_states[:, t, way * HIDDEN : (way + 1) * HIDDEN]
            m = mask[:, t, None]
            d_new = d_h * m * (1 - z) * (1 - new * new)
            d_z = d_h * m * (was - new) * z * (1 - z)
            d_r = d_new * g * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_inputs[:, t, way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN] = d_x
            grads["u"][way] += was.T @ d_g
            carry[way] = d_h * (1 - m * (1 - z)) + d_g @ self.u[way].T
        return grads, d_inputs

    def window_logits(self, numbers: np.ndarray, table: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of all documents, and each document's first window."""
        windows = np.array([windows_of(int(n)) for n in counts], dtype=np.int64)
        first = np.cumsum(windows) - windows
        logits = np.empty(int(windows.sum()), np.float32)
        for low in range(0, len(logits), _BLOCK_WINDOWS):
            picked = np.arange(low, min(low + _BLOCK_WINDOWS, len(logits)))
            logits[picked] = self.forward(table, self.places(picked, numbers, counts, first))
        return logits, first

    @staticmethod
    def places(picked: np.ndarray, numbers: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Row numbers of the words of some windows."""
        doc = np.searchsorted(first, picked, side="right") - 1
        start = (picked - first[doc]) * STRIDE
        within = start[:, None] + np.arange(WINDOW)
        base = (np.cumsum(counts) - counts)[doc]
        flat = np.minimum(base[:, None] + within, max(0, len(numbers) - 1))
        return np.where(within < counts[doc][:, None], numbers[flat] if len(numbers) else 0, 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores from 0 to 1; a text without words has the score of an empty window."""
        words = [words_of(text) for text in texts]
        numbers, table = self.numbers(words)
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        if not len(words):
            return np.zeros(0)
        logits, first = self.window_logits(numbers, table, counts)
        return _sigmoid(self.slope * np.maximum.reduceat(logits, first).astype(np.float64) + self.shift)


def _odds(table: np.ndarray, docs: Iterable[np.ndarray], labels: np.ndarray) -> None:
    """Log-odds of buckets by the documents that have them, shrunk where few do."""
    seen = np.zeros((2, len(table)))
    for own, label in zip(docs, labels):
        seen[int(label), own] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    rate = (seen + 0.5) / (total + 1)
    support = seen.sum(axis=0)
    table[:] = np.log(rate[1] / rate[0]) * support / (support + 20)
    table[support < 5] = 0


_PART = 20_000


class _Words:
    """The distinct words of a sample: their buckets and n-grams, flat, and their current inputs."""

    def __init__(self, network: Network, words: list[bytes]):
        parts = [network.inputs(words[k : k + _PART]) for k in range(0, len(words), _PART)]
        none = np.zeros(0, np.int64)
        self.network = network
        self.buckets, self.flat, self.sizes = (np.concatenate([p[k] for p in parts]) if parts else none for k in (1, 2, 3))
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])

    def grams(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([self.flat[self.offsets[k] : self.offsets[k + 1]] for k in words]) if len(words) else np.zeros(0, np.int32)

    def inputs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of some words from the parameters as they are now, and their n-grams."""
        n, own, sizes = self.network, self.grams(words), self.sizes[words]
        if not len(words):
            return np.zeros((0, WORD_DIM + GRAM_DIM + 2), np.float32), own
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(n.gram[own], starts, axis=0) / sizes[:, None]
        odds = np.maximum.reduceat(n.gram_odds[own], starts)
        buckets = self.buckets[words]
        return np.concatenate([n.word[buckets], mean, n.word_odds[buckets, None], odds[:, None]], axis=1).astype(np.float32), own

    def table(self) -> np.ndarray:
        """Projections of all words, with the padding row first."""
        n = self.network
        table = np.zeros((len(self.buckets) + 1, 6 * HIDDEN), np.float32)
        for k in range(0, len(self.buckets), _PART):
            words = np.arange(k, min(k + _PART, len(self.buckets)))
            table[words + 1] = self.inputs(words)[0] @ n.w + n.b
        return table

    def told(self) -> np.ndarray:
        """Log-odds of all words together with their n-grams', with the padding row first."""
        parts = [np.zeros(1, np.float32)]
        for k in range(0, len(self.buckets), _PART):
            parts.append(self.inputs(np.arange(k, min(k + _PART, len(self.buckets))))[0][:, -2:].sum(axis=1))
        return np.concatenate(parts)


def train(texts: list[str | None], labels: list[int], epochs: int = 7, seed: int = 7, rate: float | None = None) -> Network:
    """Fit to documents: each epoch takes a document's highest windows, which stand for it.

    ``rate`` is the share of positives where scores are used, if it isn't the sample's.
    """
    rng = np.random.default_rng(seed)
    network = Network.fresh(seed)
    y = np.array(labels, dtype=np.int64)
    if not len(y) or len(set(labels)) < 2:
        network.bias[:] = 3.0 if len(y) and y.all() else -3.0
        return network
    held = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~held)
    if len(set(y[fit].tolist())) < 2:
        held[:], fit = False, np.arange(len(y))
    vocabulary: dict[bytes, int] = {}
    parts = []
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
    numbers = np.concatenate(parts) + 1
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    known = _Words(network, list(vocabulary))
    del parts, vocabulary
    ends = np.cumsum(counts)
    distinct = [np.unique(numbers[ends[i] - counts[i] : ends[i]]) - 1 for i in fit]
    _odds(network.word_odds, (np.unique(known.buckets[own]) for own in distinct), y[fit])
    _odds(network.gram_odds, (np.unique(known.grams(own)) for own in distinct), y[fit])
    del distinct
    buckets, sizes = known.buckets, known.sizes
    windows = np.array([windows_of(int(n)) for n in counts], dtype=np.int64)
    first = np.cumsum(windows) - windows
    moments = {k: [np.zeros_like(getattr(network, k)), np.zeros_like(getattr(network, k))] for k in ("w", "b", "u", "attention", "out", "bias")}
    scale = {"word": np.full(WORD_BUCKETS, 1e-3, np.float32), "gram": np.full(GRAM_BUCKETS, 1e-3, np.float32)}
    step = 0

    for epoch in range(epochs):
        table = known.table() if epoch else None
        if epoch == 0:  # nothing is learnt yet, so the log-odds choose
            told = known.told()
            high = np.array([told[network.places(np.arange(s, s + n), numbers, counts, first)].max(axis=1).argmax() for s, n in zip(first, windows)])
            logits = None
        else:
            logits, _ = network.window_logits(numbers, table, counts)
        chosen: list[int] = []
        target: list[int] = []
        for i in fit:
            if logits is None:
                best = [int(first[i] + high[i])]
                best += rng.integers(first[i], first[i] + windows[i], 1).tolist() if y[i] == 0 else []
            else:
                own = logits[first[i] : first[i] + windows[i]]
                best = (first[i] + np.argsort(-own)[: 1 if y[i] else 3]).tolist()
            chosen += best
            target += [int(y[i])] * len(best)
        order = rng.permutation(len(chosen))
        picked, goal = np.array(chosen)[order], np.array(target, np.float32)[order]
        weight = np.where(goal > 0, 0.5 / max(1e-9, goal.mean()), 0.5 / max(1e-9, 1 - goal.mean())).astype(np.float32)
        size = int(np.clip(len(picked) // STEPS, 16, 256))
        for low in range(0, len(picked), size):
            at = network.places(picked[low : low + size], numbers, counts, first)
            used, where = np.unique(np.concatenate([[0], at.ravel()]), return_inverse=True)
            own, where = used[1:] - 1, where[1:].reshape(at.shape)
            x, gram_at = known.inputs(own)
            local = np.concatenate([np.zeros((1, 6 * HIDDEN), np.float32), x @ network.w + network.b])
            kept = network.forward(local, where, keep=True)
            slope = ((_sigmoid(kept[0]) - goal[low : low + size]) * weight[low : low + size] / len(at)).astype(np.float32)
            grads, d_inputs = network.backward(kept, where, slope)
            d_rows = np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(d_rows, where.ravel(), d_inputs.reshape(-1, 6 * HIDDEN))
            d_rows = d_rows[1:]
            grads["w"], grads["b"] = x.T @ d_rows, d_rows.sum(axis=0)
            d_x = d_rows @ network.w.T
            step += 1
            pace = 0.02 * min(1.0, step / 10) / (1 + 0.3 * epoch)
            for name, grad in grads.items():
                value, (mean, square) = getattr(network, name), moments[name]
                grad = grad + 1e-4 * value
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                value -= pace * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            shares = np.repeat(d_x[:, WORD_DIM : WORD_DIM + GRAM_DIM] / sizes[own, None], sizes[own], axis=0)
            for name, rows, grad in (("word", buckets[own], d_x[:, :WORD_DIM]), ("gram", gram_at, shares)):
                np.add.at(scale[name], rows, (grad * grad).mean(axis=1))
                np.add.at(getattr(network, name), rows, -0.02 * grad / np.sqrt(scale[name][rows])[:, None])
    logits, _ = network.window_logits(numbers, known.table(), counts)
    top = np.maximum.reduceat(logits, first).astype(np.float64)
    checked = np.flatnonzero(held) if len(set(y[held].tolist())) == 2 else np.arange(len(y))
    network.slope, network.shift = _calibrated(top[checked], y[checked])
    if rate is not None and 0 < rate < 1:
        network.shift += float(np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean())))
    return network


def _calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, with targets drawn off 0 and 1 (Platt)."""
    positive = labels.sum()
    goal = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(slope * logits + shift)
        curve = p * (1 - p) + 1e-6
        gradient = np.array([((p - goal) * logits).sum() + 1e-3 * (slope - 1), (p - goal).sum()])
        hessian = np.array([[(curve * logits**2).sum() + 1e-3, (curve * logits).sum()], [(curve * logits).sum(), curve.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        size = max(1.0, float(np.abs(move).max()))
        slope, shift = max(0.05, slope - move[0] / size), shift - move[1] / size
    return float(slope), float(shift)


def spread(text: str | None) -> str | None:
    """A labelled text, or evenly spread passages of one with over ``SAMPLE_WORDS`` words."""
    count = len(words_of(text))
    if count <= SAMPLE_WORDS:
        return text
    passages = SAMPLE_WORDS // PASSAGE
    size = len(text) * PASSAGE // count + 1
    return " ".join(text[at : at + size] for at in np.linspace(0, len(text) - size, passages).astype(int).tolist())


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column) -> tuple[list[str | None], list[int], float | None]:
    """A bounded, repeatable sample of labelled documents: the first of each class by a hash of the id, whatever their length.

    A document labelled both 0 and 1 counts as 1; of several texts with one id the least is taken.
    The last value is the share of positives among all labels that may be learnt from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_POSITIVE)
    picked = picked.unionByName(known.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_NEGATIVE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([spread(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], texts], names=["doc_id", "y", "text"])

    short = rows.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, text string")
    first = short.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] for r in first], [r["y"] for r in first], known.agg(F.avg("y")).first()[0]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", learn: Column | None = None) -> Network:
    """Train on a bounded sample of ``labels(doc_id, label)`` joined to ``docs(doc_id, text)``.

    ``learn`` is a condition on ``doc_id`` that sample rows must meet. Labels other than 0 and 1
    and ids without a document teach nothing; without both classes every score is alike.
    """
    texts, targets, rate = sample_labelled(docs, labels, label_col, F.lit(True) if learn is None else learn)
    return train(texts, targets, rate=rate)


def score(docs: DataFrame, network: Network, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double column ``out``; null, empty and word-less texts get one low score.

    Texts of any length are scored whole. Rows, repeated ones included, and their other columns
    stay as they are, but a column named ``out`` gives way.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()])
    network.index, network.rows = {}, []
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = shared.value.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
