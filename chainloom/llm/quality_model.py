"""Quality classifier: supervised subword embeddings, softmax, numpy SGD.

A document is the average of the learned vectors of its hashed words, their
character n-grams, and marker words for repetition (a word said again within
three words, a word of a repeated line).  The softmax over two classes is linear
in that average, so scoring needs one number for each feature; these are cached
by word.

Defined results: null or empty text has no feature, so the class bias decides;
repeated rows score alike; very long texts are scored whole; ids must be whole
numbers; an empty table gives no rows; without labelled rows of
both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CHUNK_CHARS, chunks, fold_of_value, hash_text, in_arrow, kept, labelled_sample, mix, texts_of

BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4)
#: Longer words count in full, but aren't cached.
CACHED_WORD = 48
MAX_WORDS = 400_000
#: Marker features, weighted by their number.
MARKS = ("\x00again", "\x00line")


def ngrams(points: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(points) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
    return mix(h)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def subwords(words: list[str], buckets: int = BUCKETS, limit: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, bucket) of each whole word and of all its character n-grams with boundary marks.

    They come in parts of about ``limit`` characters; a longer word is walked in overlapping pieces.
    """
    for lo, hi in chunks(words, limit):
        outs = [(np.arange(lo, hi), np.fromiter((hash_text(w) for w in words[lo:hi]), np.uint64, hi - lo))]
        joined = "".join(f"<{w}>" for w in words[lo:hi])
        word = np.repeat(np.arange(lo, hi), [len(w) + 2 for w in words[lo:hi]]) if hi - lo > 1 else None
        step = limit if word is None else len(joined)
        for start in range(0, len(joined), step):
            points = code_points(joined[start : start + step + max(GRAMS) - 1])
            for n in GRAMS:
                own = points[: step + n - 1]
                if len(own) >= n:
                    h = ngrams(own, n)
                    if word is None:
                        outs.append((np.full(len(h), lo), h))
                    else:
                        same = word[: len(h)] == word[n - 1 :]
                        outs.append((word[: len(h)][same], h[same]))
            if not outs:
                break
            yield np.concatenate([w for w, _ in outs]), (np.concatenate([h for _, h in outs]) % np.uint64(buckets)).astype(np.int64)
            outs = []


def markers(text: str) -> tuple[list[str], int, int]:
    """Words, how many repeat one of the three before, how many stand in repeated lines."""
    words = text.split()
    again = sum(sum(map(eq, words, words[gap:])) for gap in (1, 2, 3))
    lines = text.split("\n")
    doubled = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            doubled += len(line.split()) if line in seen else 0
            seen.add(line)
    return words, again, doubled


@dataclass
class QualityModel:
    value: np.ndarray  # float32 by bucket: margin of class 1
    bias: float

    def scorer(self):
        value, buckets = self.value, len(self.value)
        known: dict[str, complex] = {}  # sum of values, and number of features
        again, line = (float(value[hash_text(m) % buckets]) for m in MARKS)

        def score(texts: list[str]) -> np.ndarray:
            if len(known) > MAX_WORDS:
                known.clear()
            found = [markers(t) for t in texts]
            missing = list(set().union(*(f[0] for f in found)) - known.keys())
            if missing:
                sums = np.zeros(len(missing), complex)
                for w, f in subwords(missing, buckets):
                    sums += np.bincount(w, value[f], len(missing)) + 1j * np.bincount(w, minlength=len(missing))
                known.update(zip(missing, sums.tolist()))
            z = np.zeros(len(texts))
            for i, (words, n_again, n_lines) in enumerate(found):
                s = sum(map(known.__getitem__, words), 0j)
                z[i] = (s.real + n_again * again + n_lines * line) / max(1.0, s.imag + n_again + n_lines) + self.bias
            for w in missing:
                if len(w) > CACHED_WORD:
                    del known[w]
            return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

        return score


def fit_embeddings(rows: list, epochs: int = 4, rate: float = 4.0, dim: int = DIM, buckets: int = BUCKETS, seed: int = 5) -> QualityModel:
    """SGD over (id, text, 0/1) rows, one document a step; ``rows`` is bounded by the caller."""
    y = [r[2] for r in rows]
    if len(set(y)) < 2:
        return QualityModel(np.zeros(buckets, np.float32), 0.0)
    again, line = (hash_text(m) % buckets for m in MARKS)
    each = []
    for _, text, _ in rows:
        words, n_again, n_lines = markers(text)
        parts = [np.unique(f, return_counts=True) for _, f in subwords(words, buckets)] + [(np.array([again, line]), np.array([n_again, n_lines]))]
        u, at = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([n for _, n in parts]), len(u))
        u, c = u[c > 0], c[c > 0]
        each.append((u, (c / max(1, c.sum())).astype(np.float32)))
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = draw.normal(0, 0.1, (dim, 2)).astype(np.float32), np.log([1 - np.mean(y), np.mean(y)]).astype(np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            u, c = each[i]
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            h = c @ vectors[u]
            z = h @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y[i]] -= 1
            back = out @ g
            out -= 0.05 * lr * np.outer(h, g)
            bias -= 0.01 * lr * g
            vectors[u] -= lr * c[:, None] * back
    return QualityModel(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, max_docs: int = 8_000, **params) -> QualityModel:
    """Fit on at most ``max_docs`` labelled rows outside the held-out fold."""
    return fit_embeddings(labelled_sample(docs, labels, "quality", folds, held_fold, max_docs), **params)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: one float for each bucket

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
