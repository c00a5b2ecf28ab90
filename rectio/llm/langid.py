"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters are hashed; their share of a text times their inverse document
frequency is the feature. The follow-the-regularised-leader update with L1 and L2 penalties
keeps most weights at zero, and a temperature fitted to documents left out calibrates the
probabilities. Training runs in numpy on a bounded sample, scoring in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

UNKNOWN = "und"
BUCKET_BITS = 15
SIZES = (1, 2, 3)
#: Labelled documents of each language that a fit takes at most.
SAMPLE_DOCS = 1500
SALTS = 64
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
SCALE = 30.0
_CHUNK = 1 << 20
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a blank."""
    if not _LETTERS:
        _LETTERS.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32))
    return _LETTERS[0]


def codes_of(text: str | None) -> np.ndarray:
    """Lower-case code points between two blanks, with a blank for each character that is no letter."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _letters()[raw]


def buckets_of(codes: np.ndarray, size: int) -> np.ndarray:
    """Buckets of all n-grams of one size."""
    if len(codes) < size:
        return np.zeros(0, dtype=np.uint32)
    hashed = np.full(len(codes) - size + 1, size, dtype=np.uint32)
    for k in range(size):
        hashed = (hashed ^ codes[k : len(codes) - size + 1 + k]) * _FACTORS[k % 3]
        hashed ^= hashed >> np.uint32(15)
    return hashed >> np.uint32(32 - BUCKET_BITS)


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs among the n-grams of a whole text, or None without a letter; long texts are read in chunks."""
    codes = codes_of(text)
    if not (codes != 32).any():
        return None
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for size in SIZES:
        for low in range(0, len(codes), _CHUNK):
            total += np.bincount(buckets_of(codes[low : low + _CHUNK + size - 1], size), minlength=len(total))
    return total


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequencies included
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        """Logits of the languages, or None without a letter."""
        counts = gram_counts(text)
        if counts is None:
            return None
        own = np.flatnonzero(counts)
        return counts[own] @ self.weights[own] * (SCALE / counts.sum()) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            z = self.logits(text) if self.langs else None
            if z is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = np.exp((z - z.max()) / self.temperature)
            best = int(p.argmax())
            names.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
        return names, scores


Features = tuple[np.ndarray, np.ndarray]


def features(text: str | None) -> Features | None:
    """Buckets of a text and their shares of its n-grams."""
    counts = gram_counts(text)
    if counts is None:
        return None
    own = np.flatnonzero(counts)
    return own, counts[own] * (SCALE / counts.sum())


def train(texts: list[Features | None], langs: list[str], seed: int = 7) -> LanguageModel:
    """Follow-the-regularised-leader on :func:`features` of texts, with a fifth of them kept for the temperature."""
    usable = [(t, g) for t, g in zip(texts, langs) if t is not None]
    names = sorted({g for _, g in usable})
    count = 1 << BUCKET_BITS
    if len(names) < 2:
        return LanguageModel(names, np.zeros((count, len(names))), np.zeros(len(names)))
    rng = np.random.default_rng(seed)
    place = {g: k for k, g in enumerate(names)}
    rows = [(*t, place[g]) for t, g in usable]
    held = rng.random(len(rows)) < 0.2
    if len({y for (_, _, y), h in zip(rows, held) if not h}) < len(names):
        held[:] = False
    fit = [r for r, h in zip(rows, held) if not h]
    document_frequency = np.zeros(count)
    for own, _, _ in fit:
        document_frequency[own] += 1
    idf = np.log((1 + len(fit)) / (1 + document_frequency)) + 1
    z, n = np.zeros((count, len(names))), np.zeros((count, len(names)))
    z0, n0 = np.zeros(len(names)), np.zeros(len(names))

    def leader(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            own, value, y = fit[k]
            x = value * idf[own]
            w, w0 = leader(z[own], n[own]), -z0 / ((BETA + np.sqrt(n0)) / ALPHA + L2)
            logit = x @ w + w0
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[own] += g - (np.sqrt(n[own] + g * g) - np.sqrt(n[own])) / ALPHA * w
            n[own] += g * g
            z0 += p - (np.sqrt(n0 + p * p) - np.sqrt(n0)) / ALPHA * w0
            n0 += p * p
    model = LanguageModel(names, leader(z, n) * idf[:, None], -z0 / ((BETA + np.sqrt(n0)) / ALPHA + L2))
    checked = [r for r, h in zip(rows, held) if h] or fit
    logits = np.array([x @ model.weights[own] + model.bias for own, x, _ in checked])
    target = np.array([y for _, _, y in checked])

    def loss(t: float) -> float:
        scaled = logits / t
        top = scaled.max(axis=1)
        return float((np.log(np.exp(scaled - top[:, None]).sum(axis=1)) + top - scaled[np.arange(len(target)), target]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 200), key=loss))
    return model


def fit(docs: DataFrame, learn: Column | None = None) -> LanguageModel:
    """Train on ``text`` and ``lang`` of a bounded sample: ``SAMPLE_DOCS`` rows of each language, the first by a hash of the id.

    Whole texts of any length teach, and all languages are learnt. Null languages and ids and texts
    without a letter teach nothing; without a language every text is ``und``. One pass ranks the
    ids, and n-grams are counted where the texts are.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn))
    # a text has a letter if it has one that the model's table tells, and only such rows count
    known = known.where(F.col("text").rlike(r"\p{L}"))
    # a language's ids are ranked in SALTS parts first, so that no task sees more than SALTS times SAMPLE_DOCS of them
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = known.select("lang", "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= SAMPLE_DOCS)
    picked = known.join(F.broadcast(ids.select("lang", "doc_id").distinct()), ["lang", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (found := features(text)) is not None:
                    own = pa.array([found[0].astype("<u2").tobytes()], pa.binary()), pa.array([found[1].astype("<f4").tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([doc_id], pa.int64()), *own], names=["lang", "doc_id", "at", "share"])

    # no more rows than the sample has, but for repeated ids
    counted = picked.select("lang", "doc_id", "text").mapInArrow(run, "lang string, doc_id long, at binary, share binary")
    rows = sorted(((r["lang"], r["doc_id"], bytes(r["at"]), bytes(r["share"])) for r in counted.distinct().collect()))
    texts, langs = [], []
    for lang, _, own, share in rows:
        texts.append((np.frombuffer(own, "<u2").astype(np.int64), np.frombuffer(share, "<f4").astype(np.float64)))
        langs.append(lang)
    return train(texts, langs)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability.

    A text that is null or has no letter is ``und`` with the score 0; texts of any length are read
    whole. Rows, repeated ones included, and their other columns stay as they are, but columns
    with the two new names give way.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (lang_out.lower(), score_out.lower())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
