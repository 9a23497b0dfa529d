"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of word characters, lower-cased.  A document's features are its
distinct hashed unigrams, adjacent pairs and one-word skip pairs, and the hashed
leading stems of its words (a stem lets inflected forms share evidence).
Per-coordinate rates and the L1 term leave few non-zero weights, so what goes to
the executors is a pair of small arrays whose size is checked.

Defined results: null or empty text has no feature but the bias, so its score is
the bias alone; repeated rows score alike; very long texts are scored whole; ids must be whole
numbers; an empty table gives no rows; without
labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, chunks, fold_of_value, hash_text, in_arrow, kept, labelled_sample, mix, texts_of

WORD = re.compile(r"\w+")
BITS = 20
STEM = 6
#: The driver fits, so it takes texts in steps of so many characters and remembers so many words' hashes.
FIT_CHARS, FIT_WORDS = 100_000, 30_000
#: A model beyond this many non-zero weights is refused, never broadcast.
MAX_WEIGHTS = 1 << 19


class Features:
    """Distinct hashed features of texts; the bias is added by the model."""

    def __init__(self, bits: int = BITS, stem: int = STEM, words: int = 250_000):
        self.shift, self.stem = np.uint64(64 - bits), stem
        self.words = BoundedCache(hash_text, words)
        self.stems = BoundedCache(lambda w: hash_text("^" + w[:stem], 7), words)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, feature) of every occurrence."""
        found = [WORD.findall(t.lower()) for t in texts]
        counts = [len(ws) for ws in found]
        n = sum(counts)
        doc = np.repeat(np.arange(len(texts)), counts)
        out_d, out_f = [], []
        for cache, salt, gaps in ((self.words, 1, (1, 2)), (self.stems, 101, ())):
            h = np.fromiter((cache[w] for ws in found for w in ws), np.uint64, n)
            out_d.append(doc)
            out_f.append(mix(h + np.uint64(salt)))
            for gap in gaps:
                same = doc[:-gap] == doc[gap:] if n > gap else np.zeros(0, bool)
                a, b = h[: max(0, n - gap)][same], h[gap:][same] if n > gap else h[:0]
                out_d.append(doc[: max(0, n - gap)][same])
                out_f.append(mix(a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt + gap)))
        return np.concatenate(out_d), (np.concatenate(out_f) >> self.shift).astype(np.int64)


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # int32, ascending
    weights: np.ndarray  # float32
    bias: float
    bits: int = BITS
    stem: int = STEM

    def scorer(self):
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.buckets] = self.weights
        features = Features(self.bits, self.stem)

        def score(texts: list[str]) -> np.ndarray:
            doc, f = features(texts)
            used = dense[f] != 0
            key = np.unique((doc[used] << np.int64(self.bits)) | f[used])
            z = np.bincount(key >> self.bits, dense[key & ((1 << self.bits) - 1)], len(texts)) + self.bias
            return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

        return score


def fit_ftrl(rows: list, alpha: float = 0.5, beta: float = 1.0, l1: float = 5.0, l2: float = 0.5, epochs: int = 2, positive_weight: float = 2.0, bits: int = BITS, stem: int = STEM, seed: int = 17) -> ToxicityModel:
    """FTRL-proximal over (id, text, 0/1) rows; ``rows`` is bounded by the caller.

    The rows' features wait in a temporary file, from which each step reads one row's.
    """
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y)) < 2:
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, bits, stem)
    features, ends = Features(bits, stem, FIT_WORDS), [0]
    texts = [r[1] for r in rows]
    with tempfile.TemporaryFile() as each:
        for lo, hi in chunks(texts, FIT_CHARS):
            doc, f = features(texts[lo:hi])
            key = np.unique((doc << np.int64(bits)) | f)
            ends += (ends[-1] + np.searchsorted(key, np.arange(1, hi - lo + 1) << bits)).tolist()
            each.write((key & ((1 << bits) - 1)).astype(np.int32))
        del features, texts
        return _fit(each, ends, y, alpha, beta, l1, l2, epochs, positive_weight, bits, stem, seed)


def _fit(each, ends: list[int], y: np.ndarray, alpha: float, beta: float, l1: float, l2: float, epochs: int, positive_weight: float, bits: int, stem: int, seed: int) -> ToxicityModel:
    """``each``: the file of the rows' int32 features; those of row i stand from ends[i] to ends[i + 1]."""
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)).tolist():
            each.seek(4 * ends[i])
            x = np.frombuffer(each.read(4 * (ends[i + 1] - ends[i])), np.int32)
            zi, root = z[x], np.sqrt(n[x])
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + nb**0.5) / alpha + l2)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y[i]) * (positive_weight if y[i] else 1.0)
            step = (np.sqrt(n[x] + g * g) - root) / alpha
            z[x] = zi + g - step * w
            n[x] += g * g
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias, nb + g * g
    used = np.flatnonzero((z > l1) | (z < -l1))
    z, n = z[used], n[used]
    w = (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)
    if len(used) > MAX_WEIGHTS:
        raise ValueError(f"{len(used)} weights exceed {MAX_WEIGHTS}; raise l1")
    return ToxicityModel(used.astype(np.int32), w.astype(np.float32), -zb / ((beta + nb**0.5) / alpha + l2), bits, stem)


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, max_docs: int = 10_000, **params) -> ToxicityModel:
    """Fit on at most ``max_docs`` labelled rows outside the held-out fold."""
    return fit_ftrl(labelled_sample(docs, labels, "toxic", folds, held_fold, max_docs), **params)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = kept(sent.value, "scorer")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in chunks(texts):
                s = score(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array([fold_of_value(i, folds) == held_fold for i in ids[lo:hi]]), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return in_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, that score below ``threshold``; one narrow pass."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        score = kept(sent.value, "scorer")
        for b in batches:
            texts = texts_of(b.column(at))
            clean = [s < threshold for lo, hi in chunks(texts) for s in score(texts[lo:hi])]
            yield b.filter(pa.array(clean, pa.bool_()))

    return in_arrow(docs, run, docs.schema)
