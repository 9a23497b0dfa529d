"""Shared pieces of the training-data operators: folds, shared storage, batching.

Null handling used throughout: a null ``text`` counts as the empty text, a null
``doc_id`` hashes as the empty string.  Operators read only the columns they
name, so extra columns of any name are ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step of a Python worker handles.
CHUNK_CHARS = 1_000_000
#: Bytes of an Arrow batch (one row at least).
BATCH_BYTES = 8 << 20
#: Rows of a few numbers up to which a table is broadcast: under 8 MB.
FEW = 100_000
#: Ids up to which a set of nothing else is broadcast: under 40 MB.
FEW_IDS = 1_000_000
#: Characters of a training sample, which the driver holds.
SAMPLE_CHARS = 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def fold_of_value(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only on a local master where none is set (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='chainloom-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The files are reliable storage, so a lost executor costs a re-read and not a
    recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chainloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for these, once all that is made of them is written itself."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> bool:
    """Delete all tables that ``cut`` and the token files left in the shared folder.

    Call it when their results are written; a DataFrame that still reads one fails afterwards.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/chainloom")
    return path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, weight: Column | None = None, most: int = FEW) -> DataFrame:
    """Broadcast what was counted and is small; else leave the join to the planner.

    Rows must be of a few numbers or digests; where a row holds a list, ``weight``
    is the list's length, and the sum of lengths is what counts.
    """
    n = df.agg(F.count("*") if weight is None else F.sum(weight + 1)).first()[0]
    return F.broadcast(df) if (n or 0) <= most else df


def of_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among the ``ids`` (one column of whole numbers): without a shuffle of ``rows`` if the ids are few."""
    return rows.join(small(ids, most=FEW_IDS), key, "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out in taken:
        out += "_"
    return out


def one_row_per_id(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Labels with repeated ids: the greatest value of each column counts."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(v).alias(v) for v in values])


def texts_by_id(docs: DataFrame, drawn: list, max_chars: int) -> dict:
    """Texts of the first of the ``drawn`` (doc_id, n_chars) whose characters sum up to ``max_chars`` at most.

    Where an id repeats, its least text counts.
    """
    ids, total = [], 0
    for doc_id, n in drawn:
        total += n
        if total > max_chars and ids:
            break
        ids.append((doc_id,))
    if not ids:
        return {}
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    wanted = F.broadcast(spark.createDataFrame(ids, docs.select("doc_id").schema))
    rows = docs.select("doc_id", text.alias("text")).join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return {r["doc_id"]: r["text"] for r in rows.toLocalIterator()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, max_docs: int, max_chars: int = SAMPLE_CHARS) -> list:
    """At most ``max_docs`` labelled (doc_id, text, label) rows outside the held-out fold, of ``max_chars`` characters in all.

    They are the first by a hash of the id among documents that have a 0/1 label,
    so the sample is the same at every partitioning.
    """
    known = one_row_per_id(labels.select("doc_id", label), "doc_id", label).where(F.col(label).isin(0, 1))
    train = docs.where(fold_of("doc_id", folds) != held_fold).select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    found = train.join(known, "doc_id").groupBy("doc_id", label).agg(F.max("n").alias("n"))
    drawn = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    texts, marks = texts_by_id(docs, [(r["doc_id"], r["n"]) for r in drawn], max_chars), {r["doc_id"]: int(r[label]) for r in drawn}
    return sorted(((i, t, marks[i]) for i, t in texts.items()), key=lambda r: (fold_of_value(r[0], 1 << 31), r[0]))


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``BATCH_BYTES``, so a worker never holds thousands of whole texts at once.

    Spark reads the bound from the session when the plan runs, so it stays set there.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)


def lean(run):
    """``run`` in a worker that keeps what this function made, for its further tasks, but not what others made, nor freed memory."""
    owner = f"{run.__module__}.{run.__qualname__}"

    def within(batches):
        take_over(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return within


#: Calls that drop what a process keeps from task to task, and the function that it works for.
_drops: list = []
_owner = ""


def dropped_by(drop):
    """Register a call that drops what its module keeps in a process."""
    _drops.append(drop)


def take_over(owner: str) -> None:
    global _owner
    if owner != _owner:
        for drop in _drops:
            drop()
        _owner = owner


def give_back() -> None:
    """Freed memory goes back to the system; a worker, idle or not, would hold it beside the JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``limit`` characters (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


class BoundedCache(dict):
    """``cache[key]`` computes and keeps; emptied at ``limit`` entries, so memory stays bounded."""

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


#: The model that a process works with, and what was made of it.
_made: list = []


def kept(model, maker: str):
    """``model.maker()``, made once while a process works with the model, so caches outlive a task."""
    if not _made or _made[0] is not model:
        _made[:] = model, getattr(model, maker)()
    return _made[1]


dropped_by(_made.clear)


def hash_text(word: str, seed: int = 0) -> int:
    """64-bit hash, the same in every process."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiply-xorshift hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def texts_of(column) -> list:
    return [t or "" for t in column.to_pylist()]


def starts_of(lengths: Iterable[int]) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
