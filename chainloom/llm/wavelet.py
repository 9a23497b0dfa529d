"""Token-ID output as wavelet matrices: one succinct file for each shard.

A shard holds the ids of consecutive documents.  Its wavelet matrix keeps one
bit-plane for each bit of an id, most significant first; below each plane the ids
with a 0 come before those with a 1, both in their old order.  Ranks at every
512th bit give access, counting and occurrence look-up in one step a plane.

Layout of a file (little-endian): magic ``CLWM1``, then uint64 n, uint32 planes,
uint32 documents; for each plane uint64 zeros, the ranks, the packed bits; then
the documents' ids (int64) and numbers of tokens (int64).

Files are rows of a binary column written by Spark itself, one for each shard,
so any store Spark can write will do and a lost task is written again.

Defined results: a null text counts as empty and has only the end id; documents
with the same id follow each other, ordered by text; a null id sorts first; a very
long text is encoded whole and may make a shard of its own that is longer; ids
must be whole numbers; an empty table gives no shard and no row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, in_arrow, shared_dir, texts_of
from .tokens import load_encoder

END = 2
MAGIC = b"CLWM1\0\0\0"
BLOCK = 512
#: A shard is closed at this many ids; one document is never split.
SHARD_TOKENS = 1 << 19
SHARD_SCHEMA = "first_doc long, part int, shard int, n_docs long, n_tokens long, file binary"


class WaveletMatrix:
    """Access, rank and select over a sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes  # (zeros, ranks of ones at each block, packed bits)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        ids, planes = np.asarray(ids).astype(np.uint16 if depth <= 16 else np.uint32), []
        n, blocks = len(ids), -(-len(ids) // BLOCK)
        for shift in range(depth - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << shift)) != 0
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros(blocks * BLOCK // 8, np.uint8)
            padded[: len(packed)] = packed
            ranks = np.zeros(blocks + 1, np.uint32)
            np.cumsum(np.bitwise_count(padded.view(np.uint64)).reshape(blocks, BLOCK // 64).sum(1), out=ranks[1:])
            zeros = n - int(ranks[-1])
            planes.append((zeros, ranks, packed))
            below = np.empty_like(ids)
            np.compress(~bit, ids, out=below[:zeros])
            np.compress(bit, ids, out=below[zeros:])
            ids = below
        return cls(n, planes)

    def _ones(self, plane, i: int) -> int:
        """Ones before position i of a plane."""
        _, ranks, packed = plane
        b = i // BLOCK
        seen = int(ranks[b])
        bits = packed[b * BLOCK // 8 : -(-i // 8)]
        return seen + (int(np.unpackbits(bits, bitorder="little")[: i - b * BLOCK].sum()) if i > b * BLOCK else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit = plane[2][i // 8] >> (i % 8) & 1
            value = value << 1 | int(bit)
            ones = self._ones(plane, i)
            i = plane[0] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` before ``end`` lie below the last plane."""
        if symbol >> len(self.planes):
            return 0, 0
        lo, hi = 0, end
        for k, plane in enumerate(self.planes):
            a, b = self._ones(plane, lo), self._ones(plane, hi)
            if symbol >> (len(self.planes) - 1 - k) & 1:
                lo, hi = plane[0] + a, plane[0] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, end: int) -> int:
        """Occurrences of ``symbol`` among the first ``end`` ids."""
        lo, hi = self._range(symbol, end)
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select(self, plane, k: int, one: bool) -> int:
        """Position of the k-th (from 0) bit of a kind in a plane."""
        _, ranks, packed = plane
        before = ranks.astype(np.int64) if one else np.arange(len(ranks)) * BLOCK - ranks.astype(np.int64)
        b = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(packed[b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == one)[k - before[b]])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``symbol``."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            plane = self.planes[level]
            one = bool(symbol >> (len(self.planes) - 1 - level) & 1)
            i = self._select(plane, i - plane[0] if one else i, one)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: planes are undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level, (zeros, _, packed) in enumerate(reversed(self.planes)):
            bit = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~bit)] = out[:zeros]  # by places: a mask is slow where bits alternate
            before[np.flatnonzero(bit)] = out[zeros:] | kind(1 << level)
            out = before
        return out.astype(np.uint32)


def to_file(ids: np.ndarray, doc_ids: list, lengths: list) -> bytes:
    m = WaveletMatrix.build(ids)
    parts = [MAGIC, struct.pack("<QII", m.n, len(m.planes), len(doc_ids))]
    for zeros, ranks, packed in m.planes:
        parts += [struct.pack("<Q", zeros), ranks.astype("<u4").tobytes(), packed.tobytes()]
    return b"".join([*parts, np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<i8").tobytes()])


def from_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
    """The matrix, the documents' ids and their numbers of tokens."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    n, depth, docs = struct.unpack_from("<QII", data, 8)
    at, blocks, size, planes = 24, -(-n // BLOCK) + 1, -(-n // 8), []
    for _ in range(depth):
        (zeros,) = struct.unpack_from("<Q", data, at)
        ranks = np.frombuffer(data, "<u4", blocks, at + 8)
        at += 8 + 4 * blocks
        planes.append((zeros, ranks, np.frombuffer(data, np.uint8, size, at)))
        at += size
    return WaveletMatrix(n, planes), np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<i8", docs, at + 8 * docs)


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode all texts in ascending doc_id order and write one file row for each shard."""
    spark = docs.sparkSession
    tail = np.array([end], "<u4").tobytes()
    none = -(1 << 63)  # a null id

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, shard = load_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, data, size = [], [], 0

        def close():
            file = to_file(np.frombuffer(b"".join(data), "<u4"), ids, [len(x) // 4 for x in data])
            return pa.RecordBatch.from_pydict({"first_doc": [ids[0]], "part": [part], "shard": [shard], "n_docs": [len(ids)], "n_tokens": [size], "file": [file]}, schema=schema)

        for b in batches:
            names, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in chunks(texts):
                for name, made in zip(names[lo:hi], encoder(texts[lo:hi])):
                    made += tail
                    if ids and size + len(made) // 4 > shard_tokens:
                        yield close()
                        shard, ids, data, size = shard + 1, [], [], 0
                    ids.append(none if name is None else name)
                    data.append(made)
                    size += len(made) // 4
        if ids:
            yield close()

    schema = pa.schema([("first_doc", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    in_arrow(ordered, run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard, shard_start: ids of all shards before it.  One small row for each
    range partition meets in the window; within a partition the sum is local."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    local = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("local_start", F.coalesce(local, F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("local_start")).alias("shard_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    shards = spark.read.parquet(path)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for part, shard, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                matrix, names, lengths = from_file(data)
                ids = matrix.decode().astype("<u4")
                at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]
                k = len(names)
                yield pa.RecordBatch.from_pydict({"doc_id": [None if x == -(1 << 63) else x for x in names.tolist()], "part": [part] * k, "shard": [shard] * k, "local": at[:-1], "n_tokens": lengths, "ids_crc32": crc}, schema=schema)

    decoded = in_arrow(shards.select("part", "shard", "file"), run, "doc_id long, part int, shard int, local long, n_tokens long, ids_crc32 long")
    return decoded.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _per_shard(shards: DataFrame, answer, fields: str, types: list) -> DataFrame:
    """part, shard and what ``answer(matrix, ask)`` gives, row by row; ``ask`` is the shard's column of that name if it has one."""
    asked = "ask" in shards.columns
    names = ["part", "shard", *(f.split()[0] for f in fields.split(", "))]

    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                found = list(answer(from_file(row[2])[0], row[3] if asked else None))
                columns = list(zip(*found)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array([row[0]] * len(found), pa.int32()), pa.array([row[1]] * len(found), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return in_arrow(shards.select("part", "shard", "file", *(["ask"] if asked else [])), run, f"part int, shard int, {fields}")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each token in all files, from ranks alone."""
    counts = _per_shard(spark.read.parquet(path), lambda m, _: ((t, m.count(t)) for t in tokens), "token long, n long", [pa.int64(), pa.int64()])
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(position): where a token stands in the sequence of all ids, from selects alone."""
    shards = spark.read.parquet(path)
    found = _per_shard(shards, lambda m, _: ((m.select(token, k),) for k in range(m.count(token))), "local long", [pa.int64()])
    return found.join(shard_starts(shards), ["part", "shard"]).select((F.col("shard_start") + F.col("local")).alias("position"))


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) of the positions that exist: each goes to its shard, and only those shards are read bit by bit.

    Shards and positions meet by stretches of ``SHARD_TOKENS`` ids, an equi-join.
    """
    shards = spark.read.parquet(path)
    starts = shard_starts(shards).join(shards.select("part", "shard", "n_tokens"), ["part", "shard"])
    end = F.col("shard_start") + F.col("n_tokens")
    stretch = lambda at: F.floor(at / SHARD_TOKENS).cast("long")
    spread = starts.select("*", end.alias("end"), F.explode(F.sequence(stretch(F.col("shard_start")), stretch(end - 1))).alias("stretch"))
    asked = positions.select("position").distinct().withColumn("stretch", stretch(F.col("position"))).join(spread, "stretch")
    asked = asked.where((F.col("position") >= F.col("shard_start")) & (F.col("position") < F.col("end")))
    asks = asked.groupBy("part", "shard").agg(F.collect_list(F.col("position") - F.col("shard_start")).alias("ask"))
    found = _per_shard(shards.join(asks, ["part", "shard"]), lambda m, ask: ((i, m.access(i)) for i in ask), "local long, token long", [pa.int64(), pa.int64()])
    return found.join(starts, ["part", "shard"]).select((F.col("shard_start") + F.col("local")).alias("position"), "token")


def encode_to_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents as shards in the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/chainloom/wavelet-{uuid.uuid4().hex}"
    write_shards(docs, tokenizer_path, path)
    return read_documents(spark, path)
