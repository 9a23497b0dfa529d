"""Best-fit packing: vector best-fit over token, document-count and attention-cost capacities.

A document longer than a sequence is cut into full pieces, its remainder first.
A piece needs (length, 1, length squared) of a sequence's capacities (tokens,
documents, attention cost), so pieces of one length are interchangeable and the
packing can be planned over the histogram of lengths: at most ``max_tokens``
rows, whatever the size of the corpus.  The plan takes lengths in descending
order and gives each to the open kind of bin that scores best, by weighted dot
product of residual and need or by the norm of what would be left, under every
constraint.  Bins with equal contents are planned together as (contents, number).

The executors then number the pieces of each length and look their place up in
the plan; no group of rows is gathered anywhere.

Defined results: a null or empty text is one piece with the end id only; repeated
rows are packed once each; a very long text is encoded whole and cut into as many
pieces as it needs; ids must be whole numbers; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, in_arrow, texts_of
from .tokens import load_encoder

END = 2
MAX_TOKENS = 1024
#: Characters of texts that are encoded in one step: their words then are few enough for the processor's caches.
STEP_CHARS = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter."""
    first = n % most or min(n, most)
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def pieces_of(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end: int = END) -> DataFrame:
    """One row for each piece; (part, length, k) numbers the pieces of a length in a partition."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encoder, part = load_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for b in batches:
            names, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in chunks(texts, STEP_CHARS):
                rows = []
                for name, made in zip(names[lo:hi], encoder(texts[lo:hi])):
                    made = memoryview(made + tail)
                    for p, (s, n) in enumerate(cut_points(len(made) // 4, max_tokens)):
                        rows.append((name, p, s, n, zlib.crc32(made[4 * s : 4 * (s + n)]), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return in_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, PIECES)


@dataclass
class Plan:
    """For each length: the places in order, as (first rank, first sequence, offset)."""

    places: dict  # length -> (ranks, sequences, offsets), int64 arrays
    sequences: int


def plan_bins(histogram: dict[int, int], capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.2), rule: str = "dot") -> Plan:
    """Vector best-fit over the histogram {length: pieces}.

    ``rule``: "dot" takes the bin with the least weighted dot product of residual
    and need among those that fit (the fullest in the item's own direction),
    "norm" the one whose weighted residual norm after placing is least.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    w = w / cap**2  # capacities differ in scale
    left, number, contents = np.zeros((64, 3)), np.zeros(64, np.int64), []  # open kinds of bins
    used = 0
    for length in sorted(histogram, reverse=True):
        todo, need = histogram[length], np.array([length, 1.0, float(length) ** 2])
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            ok = (left[:used] >= need).all(1) & (number[:used] > 0)
            if ok.any():
                score = (left[:used] * need) @ w if rule == "dot" else ((left[:used] - need) ** 2) @ w
                at = int(np.argmin(np.where(ok, score, np.inf)))
                here, rest, held = min(todo, int(number[at])), left[at].copy(), contents[at]
                number[at] -= here
            else:
                each = int(min((cap // need).min(), todo))  # new bins, filled with this length
                here, rest, held = todo // each, cap.copy(), ()
                rest -= need * (each - 1)
                held = (length,) * (each - 1)
                todo -= here * (each - 1)
            if used == len(left):
                left, number = np.concatenate([left, np.zeros_like(left)]), np.concatenate([number, np.zeros_like(number)])
            left[used], number[used] = rest - need, here
            contents.append((*held, length))
            used += 1
            todo -= here
    ranks: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for at in np.flatnonzero(number[:used]).tolist():
        offset = 0
        for length in contents[at]:
            first = taken.get(length, 0)
            ranks.setdefault(length, []).append((first, sequence, offset))
            taken[length] = first + int(number[at])
            offset += length
        sequence += int(number[at])
    assert taken == {k: v for k, v in histogram.items() if v}
    return Plan({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in ranks.items()}, sequence)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_documents: int | None = None, max_cost: float | None = None, rule: str = "dot", end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    ``max_documents`` and ``max_cost`` (sum of squared lengths) default to what
    the token capacity allows at most, so they then never cost a sequence.
    """
    capacity = (max_tokens, max_documents or max_tokens, max_cost or float(max_tokens) ** 2)
    pieces = cut(pieces_of(docs, tokenizer_path, max_tokens, end), "pieces")
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # max_tokens rows at most
    sent = docs.sparkSession.sparkContext.broadcast(plan_bins(histogram, capacity, rule=rule))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))

    def run(batches):
        places = sent.value.places
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, seq, off = places[int(length[group[0]])]
                at = np.searchsorted(first, rank[group], "right") - 1
                sequence[group], offset[group] = seq[at] + rank[group] - first[at], off[at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return in_arrow(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
