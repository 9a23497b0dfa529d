"""Near-duplicate documents by min-max hashing.

Each 64-bit shingle hash is permuted ``PERMUTATIONS`` times; both the least and
the greatest value of each permutation are kept, so one evaluation gives two
unbiased signature values.  Bands of ``ROWS`` values bring candidates together.

1. Documents with equal shingle sets form a class (equal 128-bit digests); the
   smallest id stands for it, so copies are never compared.
2. In each band, every class is compared with the least class of that band, by
   signatures, and where these agree to within five standard errors of the threshold
   on full sets: work in proportion to the rows, whatever the size of a group.
3. The links are contracted to components.  Only bands whose classes are still of
   several components have pairs left.  Their signatures are compared in blocks,
   each pair of blocks a task of its own; a pair that agrees in the same way, in the
   first band it shares, is confirmed on full sets.
4. Components of all links; copies follow their class.

Equality of words and shingles is equality of 64-bit hashes (BLAKE2b of the word,
mixed); two given ones differ but for a chance of 5e-20.

Defined results: without words, or for a null text, the set is empty and linked
with nothing, and the document is its own component; rows that share a doc_id
are one node; with fewer than five words the whole sequence is the one shingle; a
null doc_id is treated as the smallest id; very long texts are hashed whole, in
parts; ids must be whole numbers; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BoundedCache, chunks, cut, discard, fresh, hash_text, in_arrow, mix, of_ids, small, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WIDTH = 5
PERMUTATIONS = 60
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Classes of a block of signatures.
BLOCK = 128
#: Classes that one copy of a center's text is compared with.
STAR = 64
#: Signature values are kept shortened; unequal ones look equal once in 65 536.
SHORT = np.uint16
NULL_ID = -(1 << 63)

_draw = np.random.default_rng(20240229)
_MUL = _draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_PLACE = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, WIDTH + 1, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words = width, BoundedCache(hash_text)

    def __call__(self, text: str) -> np.ndarray:
        words = WORD.findall(text.translate(ASCII_LOWER) if not text.isascii() else text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out += mix(h[k : len(h) - width + 1 + k] + np.uint64(k)) * _PLACE[k]
        return np.unique(mix(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation: 2 * PERMUTATIONS numbers."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):  # bounded memory for long texts
        p = shingles[at : at + 4096, None] * _MUL + _ADD
        np.minimum(low, p.min(0), out=low)
        np.maximum(high, p.max(0), out=high)
    return np.stack([low, high], 1).ravel()


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, k])
    return key.view(np.int64)


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc, n_shingles, digest of the set, bands, signature; empty sets have none of the last three."""
    types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())

    def run(batches):
        shingle = Shingler()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in chunks(texts):
                rows = []
                for i, t in zip(ids[lo:hi], texts[lo:hi]):
                    s = shingle(t)
                    if len(s):
                        sig = signature(s)
                        rows.append((i, len(s), digest_of(s), band_keys(sig), sig.astype(SHORT).tobytes()))
                    else:
                        rows.append((i, 0, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc", "n_shingles", "digest", "bands", "sig"])

    return in_arrow(with_id(docs), run, "doc long, n_shingles long, digest binary, bands array<long>, sig binary")


def with_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), F.col("text"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the links (a, b); equal labels, one component.

    Each round sends every node to the least of itself and its neighbours, by a
    hash that is drawn anew every other round, and contracts the links: settled
    nodes are gone from the next round, and stars as well as chains shrink by a
    share of their nodes.  Only pairs of keys move.
    """
    at, maps = cut(links.where("a <> b").distinct(), "links"), []
    while not at.isEmpty():
        drawn = len(maps) // 2
        order = lambda c, r=drawn: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("to"))
        both = at.select(F.col("a").alias("node"), F.col("b").alias("v")).unionAll(at.select(F.col("b"), F.col("a")))
        near = both.groupBy("node").agg(F.min(order("v")).alias("m"))
        moved = cut(near.select("node", F.least(order("node"), F.col("m"))["to"].alias("to")), "moved")
        maps.append(moved)
        lookup = small(moved)
        to_a, to_b = (lookup.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        before, at = at, cut(at.join(to_a, "a").join(to_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "links")
        discard(before)
    discard(at)
    if not maps:
        return cut(links.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false"), "labels")
    out = maps[-1].select("node", F.col("to").alias("label"))
    for earlier in maps[-2::-1]:
        later = out.select(F.col("node").alias("to"), "label")
        out = earlier.join(small(later), "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    labels = cut(out, "labels")
    discard(*maps)
    return labels


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two full sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def pairs_schema(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["a", "b"])


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task and next to each other, by the further columns of the order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The (center, center_doc, node, doc, size) pairs whose signatures agree to within five standard errors of ``percent``."""
    least = least_agreement(percent)
    sigs = reps.select("node", "sig")
    both = pairs.join(sigs, "node").join(sigs.select(F.col("node").alias("center"), F.col("sig").alias("center_sig")), "center")

    def run(batches):
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(k).to_pylist()), SHORT).reshape(b.num_rows, -1) for k in (5, 6))
            yield b.select([0, 1, 2, 3, 4]).filter(pa.array((one == two).sum(1) >= least, pa.bool_()))

    return in_arrow(both.select(*PAIR.split()[::2], "sig", "center_sig"), run, ", ".join(map(" ".join, zip(PAIR.split()[::2], PAIR.split()[1::2]))))


PAIR = "center binary center_doc long node binary doc long size long"


def star_links(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among (center, node) pairs, confirmed on full sets.

    A center is sent once to each part of its nodes (about ``STAR`` of them), and
    the nodes stream past it, so a task holds one set whatever the group's size.
    """
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / STAR)).alias("salt")
    one = pairs.select("center", salt, F.lit(1).alias("rank"), "node", "doc")
    two = pairs.select("center", salt, F.lit(0).alias("rank"), F.col("center").alias("node"), F.col("center_doc").alias("doc")).distinct()
    wanted = cut(one.unionAll(two), "wanted")
    texts = dealt(of_ids(with_id(docs), "doc", wanted.select("doc").distinct()).join(small(wanted), "doc"), "center", "salt").select("center", "salt", "rank", "node", "text").sortWithinPartitions("center", "salt", "rank")

    def run(batches):
        shingle, current, center = Shingler(), None, None
        for batch in batches:
            found = []
            for key, salt, rank, node, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingle(text or "")
                if digest_of(s) != node:  # another text of the same id
                    continue
                if (key, salt) != current:
                    current, center = (key, salt), None
                if rank == 0:
                    center = s
                elif center is not None and linked(center, s, percent):
                    found.append((key, node))
            yield pairs_schema(found)

    found = cut(in_arrow(texts, run, "a binary, b binary"), "stars")
    discard(wanted)
    return found


def groups_of(batches, width: int):
    """Lists of rows that share their first ``width`` values and follow each other."""
    held, current = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != current:
                if held:
                    yield held
                held, current = [], row[:width]
            held.append(row)
    if held:
        yield held


def least_agreement(percent: int) -> float:
    """Signature values that agree, at least, for a pair of ``percent``: five standard errors below the mean."""
    n, share = 2 * PERMUTATIONS, percent / 100
    return n * share - 5 * (n * share * (1 - share)) ** 0.5


def rest_links(open_: DataFrame, docs: DataFrame, percent: int, block: int) -> DataFrame:
    """The links left among nodes that share a band but no component yet.

    ``open_``: hub, size, least (its center), node, doc, label, n, bands, sig.  A
    hub's nodes are dealt in blocks, and each pair of blocks is a task of
    signatures.  What may be linked there, by signature and size and not seen in an
    earlier band, goes on with its text and is confirmed on full sets.
    """
    blocks = F.ceil(F.col("size") / block)
    own = F.pmod(F.xxhash64("node"), blocks)
    keyed = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    x, y = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    keyed = keyed.select("hub", x, y, "own", "node", "doc", "label", "n", "bands", "sig", (F.col("node") == F.col("least")).alias("center"))
    least = least_agreement(percent)

    def candidates(batches):
        for held in groups_of(batches, 3):
            hub, x, y = held[0][:3]
            labels = {}
            label = np.array([labels.setdefault(r[6], len(labels)) for r in held])
            own, n = np.array([r[3] for r in held]), np.array([r[7] for r in held])
            bands, center = np.array([r[8] for r in held]), np.array([r[10] for r in held])
            sigs = np.frombuffer(b"".join(r[9] for r in held), SHORT).reshape(len(held), -1)
            here, hit = int(np.flatnonzero(bands[0] == hub)[0]), np.zeros(len(held), bool)
            for i in range(1, len(held)):
                near = (label[:i] != label[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i]))
                near &= ~(center[:i] | center[i])  # those pairs are settled
                if x != y:
                    near &= own[:i] != own[i]
                at = np.flatnonzero(near)
                at = at[(sigs[at] == sigs[i]).sum(1) >= least]
                at = at[(bands[at] == bands[i]).argmax(1) == here]
                hit[at] = True
                hit[i] |= len(at) > 0
            rows = [held[i] for i in np.flatnonzero(hit).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip((0, 1, 2, 3, 4, 5, 6), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["hub", "x", "y", "own", "node", "doc", "label"])

    wanted = cut(in_arrow(dealt(keyed, "hub", "x", "y").sortWithinPartitions("hub", "x", "y"), candidates, "hub long, x long, y long, own long, node binary, doc long, label binary"), "wanted")
    texts = dealt(of_ids(with_id(docs), "doc", wanted.select("doc").distinct()).join(small(wanted), "doc"), "hub", "x", "y").select("hub", "x", "y", "own", "node", "label", "text").sortWithinPartitions("hub", "x", "y")

    def confirm(batches):
        shingle = Shingler()
        for held in groups_of(batches, 3):
            sets = [(r, shingle(r[6] or "")) for r in held]
            yield pairs_schema(links_in([(r[4], r[5], r[3], s) for r, s in sets if digest_of(s) == r[4]], percent, held[0][1] != held[0][2]))

    found = cut(in_arrow(texts, confirm, "a binary, b binary"), "rest")
    discard(wanted)
    return found


def links_in(rows: list[tuple], percent: int, two_sides: bool = False) -> list[tuple]:
    """Links among (node, label, side, set) that join different labels: a spanning forest of them."""
    up: dict = {}

    def root(v):
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    sigs = np.stack([signature(r[3]).astype(SHORT) for r in rows]) if rows else np.zeros((0, 1))
    least, out = least_agreement(percent), []
    for i in range(1, len(rows)):
        for j in np.flatnonzero((sigs[:i] == sigs[i]).sum(1) >= least).tolist():
            if two_sides and rows[i][2] == rows[j][2]:
                continue
            a, b = root(rows[i][1]), root(rows[j][1])
            if a != b and linked(rows[i][3], rows[j][3], percent):
                up[a] = b
                out.append((rows[i][0], rows[j][0]))
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links have 100 * intersection >= percent * union."""
    drawn = cut(sketches(docs), "sketches")
    full = drawn.where("digest IS NOT NULL")
    classes = cut(full.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = full.join(classes.select("digest", F.col("rep").alias("doc")), ["digest", "doc"], "left_semi").select(F.col("digest").alias("node"), "doc", F.col("n_shingles").alias("n"), "bands", "sig")
    reps = cut(reps, "reps")

    # Stars: in each band, every class against the least one.
    keyed = reps.select("node", "doc", "n", F.explode("bands").alias("hub"))
    hubs = keyed.groupBy("hub").agg(F.min(F.struct("node", "doc", "n")).alias("c"), F.max("node").alias("most"), F.count("*").alias("size")).where("c.node <> most")
    hubs = cut(hubs.select("hub", "c", "size"), "hubs")
    members = keyed.join(small(hubs), "hub")
    fits = 100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")
    pairs = members.where(fits & (F.col("node") != F.col("c.node"))).groupBy(F.col("c.node").alias("center"), F.col("c.doc").alias("center_doc"), "node", "doc").agg(F.max("size").alias("size"))
    # Classes that share an id are one node.
    ids = full.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc", "a")
    same = full.select("doc", F.col("digest").alias("b")).join(ids, "doc").select("a", "b").where("a <> b").distinct()
    pairs = cut(likely(pairs, reps, percent), "pairs")
    stars = star_links(pairs, docs, percent)
    discard(pairs)
    found = components(stars.unionAll(same))

    # The rest: bands of three and more classes that aren't one component yet.
    labelled = keyed.join(small(hubs.where("size > 2")), "hub").join(small(found), "node", "left").select("hub", "size", F.col("c.node").alias("least"), "node", F.coalesce("label", "node").alias("label"))
    labelled = cut(labelled, "labelled")
    unsettled = cut(labelled.groupBy("hub").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("hub"), "open")
    if not unsettled.isEmpty():
        open_ = labelled.join(small(unsettled), "hub", "left_semi").join(reps, "node")
        rest = rest_links(open_, docs, percent, block)
        if not rest.isEmpty():
            before, found = found, components(stars.unionAll(same).unionAll(rest))
            discard(before)
        discard(rest)

    # A class without copies and links needs no look-up: its component is its own id.
    by_class = classes.join(found.withColumnRenamed("node", "digest"), "digest", "left")
    least = by_class.where("label IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    by_class = by_class.where("label IS NOT NULL OR copies > 1").join(least, "label", "left").select("digest", F.coalesce("least", "rep").alias("component"))
    by_class = cut(by_class, "by_class")
    discard(classes, reps, hubs, stars, labelled, unsettled)
    out = drawn.select("doc", "n_shingles", "digest").join(small(by_class), "digest", "left")
    component = F.coalesce("component", "doc")
    null = F.lit(None).cast("long")
    return out.select(
        F.when(F.col("doc") != NULL_ID, F.col("doc")).otherwise(null).alias("doc_id"), "n_shingles", F.when(component != NULL_ID, component).otherwise(null).alias("component_id"), (component == F.col("doc")).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 80, groups: DataFrame | None = None) -> DataFrame:
    """The documents, all columns, that are the smallest id of their component; rows sharing an id stay together.

    ``groups``: what ``near_duplicates`` returned, if it ran on other texts of these ids.
    """
    doc = fresh(docs, "doc")
    found = near_duplicates(docs, percent) if groups is None else groups
    gone = found.where("NOT kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(doc))
    return docs.join(gone, F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == F.col(doc), "left_anti")
