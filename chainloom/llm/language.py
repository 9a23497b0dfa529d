"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1/-1.  An n-gram of three letters is bound
by multiplying the letters' vectors, each rotated by its place; a text or a
language is the sum (bundle) of its n-grams.  A document goes to the language
whose bundle has the greatest cosine with its own.

Every code point that is a letter has a vector of its own, drawn from its number,
and every language of the labelled rows has a bundle.  A worker computes the dot
product of an n-gram with each bundle when it first meets it and keeps it, so a
document costs table look-ups only.  Bundles are whole numbers and the products
exact, so results don't depend on which texts a worker met.  A text's own norm is taken as that of a bundle
of near-orthogonal n-grams; it scales all languages alike and never decides.

Defined results: null text or a text without letters is ``und`` with score 0;
ties go to the first language in alphabetical order; with no labelled row all
texts are ``und``; very long texts count whole; ids must be whole numbers; repeated
rows and empty tables need no special case.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, chunks, fold_of, fold_of_value, in_arrow, kept, texts_of

DIM = 4096
SHARPNESS = 24.0
#: Bits of a code point.
BITS = 21
#: N-grams whose vectors are made at once.
BLOCK = 1_024
#: Bytes of dot products that a worker keeps, and letters whose vectors it keeps.
KEPT_BYTES = 64 << 20
KEPT_LETTERS = 8_192
#: (language, n-gram) counts held before they are added to the bundles.
PENDING = 2_000_000


class Letters:
    """Code points of lower-cased text: 0 if no letter, else the code point."""

    def __init__(self):
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, letter), each text between non-letters."""
        lower = [t.lower() for t in texts]
        joined = "".join(f" {t} " for t in lower)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[points]
        if (out < 0).any():
            for c in np.unique(points[out < 0]).tolist():
                self.table[c] = c if chr(c).isalpha() else 0
            out = self.table[points]
        return np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lower]), out


def grams(doc: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram number) of all windows of three that hold a letter and lie in one text."""
    a = letter.astype(np.int64)
    g = (a[:-2] << BITS | a[1:-1]) << BITS | a[2:]
    ok = (doc[:-2] == doc[2:]) & (g > 0) & ~((a[:-2] > 0) & (a[1:-1] == 0))
    return doc[:-2][ok], g[ok]


def counted(where: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams, and (where, index of the n-gram, sum of n) of each pair that occurs."""
    u, at = np.unique(g, return_inverse=True)
    pair, back = np.unique(where * max(1, len(u)) + at, return_inverse=True)
    return u, pair // max(1, len(u)), pair % max(1, len(u)), np.bincount(back, n, len(pair)).astype(float)


class Vectors:
    """Vectors of n-grams; those of the letters are drawn when first met."""

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed, self.known = dim, seed, {}

    def letter(self, c: int) -> np.ndarray:
        if c not in self.known:
            if len(self.known) >= KEPT_LETTERS:
                self.known.clear()
            self.known[c] = (np.random.default_rng([self.seed, c]).integers(0, 2, self.dim) * 2 - 1).astype(np.int8)
        return self.known[c]

    def __call__(self, g: np.ndarray) -> np.ndarray:
        """float64 (n-gram, dim) of +1/-1."""
        out = np.ones((len(g), self.dim), np.int8)
        for place in range(3):
            u, at = np.unique(g >> BITS * (2 - place) & (1 << BITS) - 1, return_inverse=True)
            out *= np.stack([np.roll(self.letter(c), 2 - place) for c in u.tolist()])[at]
        return out.astype(float)


@dataclass
class LanguageModel:
    languages: list
    bundles: np.ndarray  # float64 (language, dim), whole numbers
    dim: int
    seed: int

    def predict(self):
        letters, vectors = Letters(), Vectors(self.dim, self.seed)
        width = len(self.languages)
        norms = np.maximum(np.linalg.norm(self.bundles, axis=1), 1)
        keep = max(BLOCK, KEPT_BYTES // (8 + 4 * width))
        keys, table = np.zeros(0, np.int64), np.zeros((0, width), np.float32)

        def dots(g: np.ndarray) -> np.ndarray:
            """float32 (n-gram, language) of at most ``keep`` distinct n-grams in ascending order: dot product over the bundle's norm."""
            nonlocal keys, table
            new = g[~np.isin(g, keys, assume_unique=True)]
            if len(new):
                if len(keys) + len(new) > keep:
                    keys, table, new = keys[:0], table[:0], g
                made = [(vectors(new[lo : lo + BLOCK]) @ self.bundles.T / norms).astype(np.float32) for lo in range(0, len(new), BLOCK)]
                keys, table = np.concatenate([keys, new]), np.concatenate([table, *made])
                order = np.argsort(keys)
                keys, table = keys[order], table[order]
            return table[np.searchsorted(keys, g)]

        def run(texts: list[str]) -> tuple[list, np.ndarray]:
            doc, letter = letters(texts)
            has = np.bincount(doc, letter > 0, len(texts)) > 0
            if not self.languages:
                return ["und"] * len(texts), np.zeros(len(texts))
            u, d, at, count = counted(*grams(doc, letter))
            norm = np.sqrt(self.dim * np.bincount(d, count**2, len(texts)))
            cos = np.zeros((len(texts), width))
            for lo in range(0, len(u), keep):
                found, mine = dots(u[lo : lo + keep]), (at >= lo) & (at < lo + keep)
                for k in range(width):
                    cos[:, k] += np.bincount(d[mine], count[mine] * found[at[mine] - lo, k], len(texts))
            cos /= np.maximum(norm, 1)[:, None]
            best = cos.argmax(1)
            e = np.exp(SHARPNESS * (cos - cos.max(1, keepdims=True)))
            score = np.where(has, 1 / e.sum(1), 0.0)
            return [self.languages[k] if h else "und" for k, h in zip(best, has)], score

        return run


def fit_profiles(rows: Iterable, dim: int = DIM, seed: int = 11) -> LanguageModel:
    """Bundle (id, text, language) rows, read once in any order; memory is bounded by the number of languages."""
    letters, vectors = Letters(), Vectors(dim, seed)
    bundles: dict[str, np.ndarray] = {}
    names: list[str] = []
    number: dict[str, int] = {}
    pending = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def flush():
        where, g, n = pending
        u, at = np.unique(g, return_inverse=True)
        order = np.argsort(at, kind="stable")
        where, at, n = where[order], at[order], n[order]
        ends = np.searchsorted(at, np.arange(0, len(u) + BLOCK, BLOCK))
        for b, lo in enumerate(range(0, len(u), BLOCK)):
            mine, made = slice(ends[b], ends[b + 1]), vectors(u[lo : lo + BLOCK])
            for k in np.unique(where[mine]).tolist():
                of = where[mine] == k
                bundles[names[k]] += n[mine][of] @ made[at[mine][of] - lo]
        pending[:] = [x[:0] for x in pending]

    def take(batch: list):
        for lang in {r[2] for r in batch} - number.keys():
            number[lang] = len(names)
            names.append(lang)
            bundles[lang] = np.zeros(dim)
        doc, letter = letters([r[1] for r in batch])
        d, g = grams(doc, letter)
        where = np.array([number[r[2]] for r in batch])[d]
        u, where, at, n = counted(*(np.concatenate(x) for x in zip(pending[:2], (where, g))), np.concatenate([pending[2], np.ones(len(g))]))
        pending[:] = [where, u[at], n]
        if len(n) > PENDING:
            flush()

    batch, size = [], 0
    for row in rows:
        batch.append(row)
        size += len(row[1])
        if size > CHUNK_CHARS:
            take(batch)
            batch, size = [], 0
    if batch:
        take(batch)
    flush()
    languages = sorted(bundles)
    return LanguageModel(languages, np.stack([bundles[k] for k in languages]) if languages else np.zeros((0, dim)), dim, seed)


def fit_languages(docs: DataFrame, folds: int = 4, held_fold: int = 2, per_language: int = 1_500, **params) -> LanguageModel:
    """Fit on about ``per_language`` documents of each language outside the held-out fold, drawn by a hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", folds) != held_fold))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    below = known.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share"))
    below = below.select(F.col("lang").alias("of"), (F.col("share") * 1_000_000).cast("int").alias("below"))
    rows = known.join(F.broadcast(below), known["lang"] == below["of"]).where(draw < F.col("below")).select("doc_id", "text", "lang").toLocalIterator()
    return fit_profiles(((r["doc_id"], r["text"], r["lang"]) for r in rows), **params)


def predict_language(docs: DataFrame, model: LanguageModel, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one bundle for each language

    def run(batches):
        predict = kept(sent.value, "predict")
        for b in batches:
            ids, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in chunks(texts):
                lang, score = predict(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array([fold_of_value(i, folds) == held_fold for i in ids[lo:hi]]), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return in_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")
