"""The change feed as a structured stream: checkpointed, idempotent by sequence number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "seq string, id string, deleted boolean"


def read_feed(spark: SparkSession, folder: str, schema: str = CHANGES, fmt: str = "json") -> DataFrame:
    """A stream over a landing folder of change files."""
    return spark.readStream.schema(schema).format(fmt).load(folder)


def dispatch(changes: DataFrame, can_hydrate: bool = True) -> DataFrame:
    """Adds number (null for a sequence that is no integer) and status: marked_unpublished, hydrated or processed."""
    named = F.coalesce(F.col("id") != "", F.lit(False))
    status = F.when(named & F.coalesce("deleted", F.lit(False)), "marked_unpublished").when(named & F.lit(can_hydrate), "hydrated").otherwise("processed")
    return changes.withColumn("number", F.col("seq").try_cast("long")).withColumn("status", status)


def last_write_wins(events: DataFrame) -> DataFrame:
    """(id, number, status): the state of each package after all events; late ones with an old number don't override."""
    return events.where("number IS NOT NULL").groupBy("id").agg(F.max("number").alias("number"), F.max_by("status", "number").alias("status"))


def follow(feed: DataFrame, out: str, checkpoint: str, hydrate: Callable[[DataFrame], None] | None = None):
    """Process all that is there, then stop; a restart with the same checkpoint goes on behind it.

    Each batch is appended with its number; a batch that is replayed after a
    failure overwrites its own part, and an event that an earlier batch brought is
    left out, so events land exactly once.
    """

    def batch(df: DataFrame, n: int) -> None:
        new = df.dropDuplicates(["seq", "id"])
        if n:
            earlier = df.sparkSession.read.schema("seq string, id string, batch long").parquet(out).where(F.col("batch") < n).select(F.col("seq").alias("s"), F.col("id").alias("i"))
            new = new.join(earlier, new["seq"].eqNullSafe(earlier["s"]) & new["id"].eqNullSafe(earlier["i"]), "left_anti")
        events = dispatch(new, hydrate is not None)
        events.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)
        if hydrate is not None:
            hydrate(events.where("status = 'hydrated'"))

    query = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def offset(spark: SparkSession, out: str) -> DataFrame:
    """One row: the greatest integer sequence number processed; it never goes back."""
    return spark.read.parquet(out).agg(F.max("number").alias("last_seq"))


def running_alerts(rows: DataFrame, budget: int = 10):
    """Stateful form of the alert gate: rows(tenant, arrival, eligible) in, with alert out; one counter for each tenant."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def count(key, frames, state):
        used = state.get[0] if state.exists else 0
        # A trigger's rows of one tenant come in several frames; three plain columns of them are put in order as a whole.
        for f in [pd.concat(frames).sort_values("arrival", kind="stable")]:
            alerts = []
            for ok in f["eligible"]:
                fire = bool(ok) and used < budget
                used += fire
                alerts.append(fire)
            yield pd.DataFrame({"tenant": f["tenant"], "arrival": f["arrival"], "alert": alerts})
        state.update((used,))

    return rows.groupBy("tenant").applyInPandasWithState(count, "tenant string, arrival long, alert boolean", "used long", "append", GroupStateTimeout.NoTimeout)
