"""Graph epochs: immutable snapshots as partitions, and a pointer to the promoted one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph


def build(edges: DataFrame, packages: DataFrame, path: str, epoch_id: str) -> DataFrame:
    """Write the edges, nodes and reach sketches of an epoch; returns its one-row description."""
    nodes = graph.cut_lineage(graph.nodes_of(edges, packages))
    scc = graph.components(edges, nodes)
    edges.withColumn("epoch_id", F.lit(epoch_id)).write.mode("append").partitionBy("epoch_id").parquet(f"{path}/edges")
    graph.reach_sketches(edges, nodes).withColumn("epoch_id", F.lit(epoch_id)).write.mode("append").partitionBy("epoch_id").parquet(f"{path}/nodes")
    row = nodes.agg(F.count("*").alias("num_nodes")).join(edges.agg(F.count("*").alias("num_edges"))).join(scc.agg(F.count_distinct("scc").alias("num_scc_components")))
    row = row.select(F.lit(epoch_id).alias("epoch_id"), "*", F.current_timestamp().alias("built_at"))
    row.write.mode("append").parquet(f"{path}/epochs")
    return read_epochs(edges.sparkSession, path).where(F.col("epoch_id") == epoch_id)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/epochs")


def promote(spark: SparkSession, path: str, epoch_id: str) -> None:
    """Make an epoch the active one; all promoted epochs stay readable."""
    if read_epochs(spark, path).where(F.col("epoch_id") == epoch_id).isEmpty():
        raise KeyError(epoch_id)
    spark.range(1).select(F.lit(epoch_id).alias("epoch_id"), F.current_timestamp().alias("promoted_at")).write.mode("append").parquet(f"{path}/promoted")


def active(spark: SparkSession, path: str) -> DataFrame:
    """The edges of the epoch promoted last."""
    last = spark.read.parquet(f"{path}/promoted").agg(F.max_by("epoch_id", "promoted_at")).first()[0]
    return get(spark, path, last)


def get(spark: SparkSession, path: str, epoch_id: str) -> DataFrame:
    """The edges of a promoted epoch."""
    if spark.read.parquet(f"{path}/promoted").where(F.col("epoch_id") == epoch_id).isEmpty():
        raise KeyError(epoch_id)
    return spark.read.parquet(f"{path}/edges").where(F.col("epoch_id") == epoch_id).drop("epoch_id")
