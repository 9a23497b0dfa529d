"""Session settings and reliable lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive plans); a running one is reused."""
    builder = SparkSession.builder.appName("chainloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only on a local master where none is set (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            found = tempfile.mkdtemp(prefix="chainloom-")
        sc.setCheckpointDir(found)
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]
