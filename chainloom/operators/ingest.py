"""Keyed writes, maintainer histories and reconciliation as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seconds_between

# How each column of a table resolves repeated writes.
PACKAGE_POLICY = {"name": "first", "purl": "first", "first_seen": "first", "poll_tier": "last", "is_deprecated": "last", "repo_url": "last_known", "repo_owner": "last_known", "repo_name": "last_known"}
MAINTAINER_POLICY = {"email_hash": "last_known", "email_domain": "last_known", "github_login": "last_known", "account_created_at": "last_known"}
VERSION_POLICY = {
    "published_at": "first", "publisher": "first", "raw_blob_sha256": "first", "unpacked_size": "last_known", "file_count": "last_known", "entropy_p99": "last_known", "prov_source_repo": "last_known",
    "prov_build_wf": "last_known", "repo_drift_score": "last_known", "has_install_hook": "last", "install_hook_kind": "last", "has_native_binary": "last", "provenance": "last",
}
EDGE_POLICY = {"range_raw": "last", "range_class": "last", "alias_target": "last", "is_optional": "last"}


def upsert(writes: DataFrame, keys: list[str], policy: dict[str, str], order: str = "seq") -> DataFrame:
    """The table after all ``writes`` in ``order``: per column the first, the last, or the last known value.

    A single aggregation with map-side combine; no window and no sort.
    """
    pick = {"first": lambda c: F.min_by(c, order), "last": lambda c: F.max_by(c, order), "last_known": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))}
    return writes.groupBy(*keys).agg(*[pick[how](c).alias(c) for c, how in policy.items() if c in writes.columns], F.max(order).alias(order))


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the table yet, one for each key."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def latest_written(versions: DataFrame, order: str = "seq") -> DataFrame:
    """package, the version written last, and the greatest by version order among finals."""
    from ..functions.semver import order as semver_order

    return versions.groupBy("package").agg(F.max_by("version", order).alias("latest_version"), F.max_by("version", semver_order(F.col("version"))).alias("semver_latest"))


def snapshots(observed: DataFrame) -> DataFrame:
    """(package, observed_at, handles): the maintainer set of each poll."""
    return observed.groupBy("package", "observed_at").agg(F.array_sort(F.collect_set("handle")).alias("handles"))


def maintainer_events(snaps: DataFrame) -> DataFrame:
    """Changes between consecutive polls: ADDED, REMOVED, SOLE_OWNER_BEGIN and SOLE_OWNER_END, with the gap in seconds."""
    w = Window.partitionBy("package").orderBy("observed_at")
    none = F.array().cast("array<string>")
    rows = snaps.withColumn("before", F.coalesce(F.lag("handles").over(w), none)).withColumn("gap", seconds_between(F.col("observed_at"), F.lag("observed_at").over(w)))
    event = lambda kind, handles: F.transform(handles, lambda h: F.struct(F.lit(kind).alias("event_type"), h.alias("handle")))
    n, m = F.size("before"), F.size("handles")
    found = F.concat(
        event("ADDED", F.array_except("handles", "before")),
        event("REMOVED", F.array_except("before", "handles")),
        F.when((n > 1) & (m == 1), event("SOLE_OWNER_BEGIN", F.col("handles"))).otherwise(event("SOLE_OWNER_BEGIN", none)),
        F.when((n == 1) & (m > 1), event("SOLE_OWNER_END", F.slice("handles", 1, 1))).otherwise(event("SOLE_OWNER_END", none)),
    )
    return rows.select("package", "observed_at", "gap", F.explode(found).alias("e")).select("package", "observed_at", "e.event_type", "e.handle", F.col("gap").alias("observation_gap_seconds"))


def first_publishes(versions: DataFrame) -> DataFrame:
    """(package, publisher, published_at): the only release of a publisher in a package."""
    return versions.where("publisher IS NOT NULL").groupBy("package", "publisher").agg(F.count("*").alias("n"), F.min("published_at").alias("published_at")).where("n = 1").drop("n")


def current_maintainers(snaps: DataFrame) -> DataFrame:
    """(package, handle, since): members of the latest poll and when their present stay began."""
    last = snaps.groupBy("package").agg(F.max_by("handles", "observed_at").alias("now"))
    added = maintainer_events(snaps).where("event_type = 'ADDED'").groupBy("package", "handle").agg(F.max("observed_at").alias("since"))
    return last.select("package", F.explode("now").alias("handle")).join(added, ["package", "handle"])


def last_polled(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy("package").agg(F.max("observed_at").alias("last_polled_at"))


def reconcile(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """(package, missed, missed_count): versions the registry has and the store lacks, for packages the store knows."""
    known = registry.join(stored.select("package").distinct(), "package", "left_semi")
    gaps = known.select("package", "version").distinct().join(stored.select("package", "version"), ["package", "version"], "left_anti")
    return gaps.groupBy("package").agg(F.array_sort(F.collect_list("version")).alias("missed"), F.count("*").alias("missed_count"))


def feed_gaps(gaps: DataFrame) -> DataFrame:
    """The record of each gap that ``reconcile`` found."""
    # Fixed value: why a feed misses versions.
    return gaps.select("package", "missed", "missed_count", F.lit("upstream_replication_loss").alias("reason"))


def reload(rows: DataFrame, path: str) -> DataFrame:
    """Replace all of a table by ``rows`` and return it as stored."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def apply_deletions(packages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Marks packages that a feed deleted as unpublished."""
    return packages.join(deleted.select("name").distinct().withColumn("__gone", F.lit(True)), "name", "left").withColumn("is_unpublished", F.coalesce("__gone", F.lit(False))).drop("__gone")


def apply_tiers(packages: DataFrame, tiers: DataFrame) -> DataFrame:
    """Overwrites poll_tier of npm packages, by normalised name; of several tiers for one name the least counts."""
    new = tiers.groupBy(F.lower(F.trim("name")).alias("__key")).agg(F.min("tier").alias("__tier"))
    out = packages.join(new, (F.lower(F.trim(packages["name"])) == F.col("__key")) & (packages["ecosystem"] == "npm"), "left")
    return out.withColumn("poll_tier", F.coalesce("__tier", "poll_tier")).drop("__key", "__tier")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Blob store partitioned by the first two digits; digests already there are skipped."""
    spark = blobs.sparkSession
    new = blobs
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        new = insert_new(spark.read.parquet(path), blobs, ["sha256"])
    new.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def read_blob(spark, path: str, sha256: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("prefix") == sha256[:2]) & (F.col("sha256") == sha256))
