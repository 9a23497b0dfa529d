"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = m * rate edits.  Cut into
k + 1 pieces, one piece must occur unchanged, so an automaton over all pieces
finds every place worth a look; Myers' bit-parallel distance over the
neighbourhood of the hits then decides.  Items and texts are compared lower-cased
with white space runs as single blanks.

Items go to the executors in blocks of bounded size; each block is matched
against all documents.

An item shorter than ``min_chars`` is searched without edits and as whole words
(no letter or digit beside it): with edits, or inside words, it would be met by
chance.

Defined results: null or empty texts and items match nothing; items that share an
id (a null id too) but not the text are all searched, and for each id the closest
counts, the least text of equally close ones; repeated documents are reported
each; of equally good places the first counts; very long texts are searched whole,
in time that grows with their length and their hits; ids must be whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_text, in_arrow, texts_of

RATE = 0.06
MIN_CHARS = 30
#: Characters of items that one block holds about at most.
BLOCK_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to a substring of ``text``, where that one ends): Myers' bit-parallel way."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


@dataclass
class Matcher:
    items: dict  # any key, such as (id, normal text) -> normal text
    rate: float = RATE
    min_chars: int = MIN_CHARS
    automaton: object = field(default=None, repr=False)

    def __post_init__(self):
        import ahocorasick

        pieces: dict[str, list] = {}
        for item, text in self.items.items():
            k = self.edits(text)
            for p in range(k + 1):
                a, b = len(text) * p // (k + 1), len(text) * (p + 1) // (k + 1)
                pieces.setdefault(text[a:b], []).append((item, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def edits(self, item: str) -> int:
        return int(len(item) * self.rate) if len(item) >= self.min_chars else 0

    def __call__(self, text: str, first_only: bool = False) -> list[tuple]:
        """(item, distance, start of the searched place, end of the match) of each item that occurs in a normal text."""
        if not self.items:
            return []
        places: dict = {}
        for end, (n, hits) in self.automaton.iter(text):
            for item, offset in hits:
                places.setdefault(item, []).append(end + 1 - n - offset)
        out = []
        for item, starts in places.items():
            pattern = self.items[item]
            m, k = len(pattern), self.edits(pattern)
            if m < self.min_chars:
                whole = next((a for a in sorted(starts) if stands_alone(text, a, a + m)), -1)
            else:
                whole = text.find(pattern)
            if whole >= 0:
                found = (item, 0, whole, whole + m)
            elif m < self.min_chars:
                continue
            else:
                found = None
                for lo, hi in merged(starts, m, k):
                    lo = max(0, lo)
                    distance, end = best_match(pattern, text[lo:hi])
                    if distance <= k and (found is None or distance < found[1]):
                        found = (item, distance, lo, lo + end)
            if found:
                out.append(found)
                if first_only:
                    return out
        return out


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit that belongs to a word lies across either end."""
    left = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not (left or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum()))


def merged(starts: list[int], m: int, k: int) -> list[tuple[int, int]]:
    """Neighbourhoods of hits, those that overlap as one."""
    out: list[list[int]] = []
    for s in sorted(set(starts)):
        if out and s - k <= out[-1][1]:
            out[-1][1] = s + m + k
        else:
            out.append([s - k, s + m + k])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The items as dictionaries of about ``block_chars`` characters at most."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        texts = ((r["item_id"], normal(r["text"])) for r in rows.toLocalIterator())
        yield {(i, text): text for i, text in texts if text}


def closest(hits: list[tuple]) -> list[tuple]:
    """Of hits whose items are (id, text), the one of least distance for each id: (id, distance, start, end, item's text)."""
    best: dict = {}
    for (item, text), *found in hits:
        if item not in best or (found[0], text) < best[item][:2]:
            best[item] = (found[0], text, found)
    return [(item, *found, text) for item, (_, text, found) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end (in the normal text) for each item id in each document."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, match_start long, match_end long"
    columns = schema.replace(",", "").split()[::2]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    picked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    parts = []
    for block in item_blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            match = Matcher(sent.value, rate, min_chars)
            for b in batches:
                rows = [(i, *hit, hash_text(t) - (1 << 63)) for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))) for hit in closest(match(normal(t)))]
                found = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], [*columns, "item", "said"])

        parts.append(in_arrow(picked, run, f"{schema}, item string, said long"))
    if not parts:
        return spark.createDataFrame([], schema)
    if len(parts) > 1:  # an id's texts may lie in several blocks; equal rows of a document are counted and stay
        every = reduce(DataFrame.unionAll, parts).groupBy(*columns, "item", "said").agg(F.count("*").alias("n"))
        least = every.groupBy("doc_id", "said", "item_id").agg(F.min(F.struct("distance", "item", "match_start", "match_end", "n")).alias("x"))
        return least.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("x.n").cast("int")))).select("doc_id", "item_id", "x.distance", "x.match_start", "x.match_end")
    return parts[0].select(*columns)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, all columns, in which no item occurs; one narrow pass for each block of items."""
    at = docs.columns.index("text")
    for block in item_blocks(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            match = Matcher(sent.value, rate, min_chars)
            for b in batches:
                yield b.filter(pa.array([not match(normal(t), first_only=True) for t in texts_of(b.column(at))], pa.bool_()))

        docs = in_arrow(docs, run, docs.schema)
    return docs
