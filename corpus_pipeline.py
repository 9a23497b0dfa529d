"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes all its predecessor kept, is written as Parquet in the shared
folder, and is read again as the next one's documents.

Defined results: a null text counts as empty; columns of any further name stay
through all stages but the last; rows that share a doc_id are kept or dropped
together by near-dedup; very long texts are handled whole; empty tables give no
rows; ids must be whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from chainloom.llm.common import cut, fresh, of_ids, table
from chainloom.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; every document stays, and n_chars follows its text."""
    out = line_dedup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, and none that line dedup left empty.

    Line dedup takes from a copy all that equals its original and so hides it.  So a
    document counts with two texts where they differ, the one it has and the one it
    came with, and is linked through either.  One that lost all its words says
    nothing that an earlier one doesn't.
    """
    id_, digest, lost = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), fresh(docs, "lost")
    now, came = docs.select(id_, "text"), table(spark, sf_dir, "documents").select(id_, "text")
    # Which texts differ is found on ids and digests alone.
    same = docs.select(id_, digest)
    other = came.select("doc_id", digest).join(same.distinct(), ["doc_id", "h"], "left_anti").join(same.select("doc_id").distinct(), "doc_id", "left_semi")
    other = cut(other.select("doc_id").distinct(), "other")
    changed = of_ids(came, "doc_id", other)
    groups = cut(near_dedup.near_duplicates(now.unionByName(changed)), "groups")
    emptied = changed.where(has_words("text")).select(F.col("doc_id").alias(lost)).distinct()
    kept = near_dedup.keep_one(docs, groups=groups)
    blank = kept.where(~has_words("text")).join(emptied, kept["doc_id"].cast("long") == F.col(lost), "left_anti")
    return kept.where(has_words("text")).unionByName(blank)


def has_words(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can't express trained models, edit distances and tokenizers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
