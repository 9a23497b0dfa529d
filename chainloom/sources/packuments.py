"""Registry documents: one JSON text for each package, exploded into relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..functions import text as X
from ..session import let

PACKUMENT = (
    "name string, maintainers array<struct<name:string,email:string>>, repository string, deprecated string, time map<string,string>,"
    "versions map<string,struct<name:string,version:string,_npmUser:struct<name:string,email:string>,scripts:map<string,string>,dependencies:map<string,string>,"
    "files:array<string>,gypfile:boolean,_hasProvenance:string,dist:struct<unpackedSize:long,fileCount:long,attestations:string>>>"
)


def truthy(json_text: Column) -> Column:
    """Whether a JSON value, as text, counts as true: not null, false, zero or empty."""
    return F.coalesce(~F.trim(json_text).isin("", "null", "false", "0", "0.0", "[]", "{}", '""'), F.lit(False))


def parse(documents: DataFrame) -> DataFrame:
    """``documents``: content, observed_at.  Documents without a name are left out."""
    d = documents.select("observed_at", F.col("content"), F.from_json("content", PACKUMENT).alias("d"))
    return d.where("d.name IS NOT NULL")


def packages(parsed: DataFrame) -> DataFrame:
    """name, normal name, purl, repository, deprecation, observed_at."""
    link = F.coalesce(F.get_json_object("d.repository", "$.url"), F.col("d.repository"))
    repo = X.repository(link)
    return parsed.select(
        F.col("d.name").alias("name"), X.normal_name(F.col("d.name")).alias("name_normalized"), X.purl(F.lit("npm"), F.col("d.name")).alias("purl"), link.alias("repo_url"),
        repo["owner"].alias("repo_owner"), repo["repo"].alias("repo_name"), truthy(F.col("d.deprecated")).alias("is_deprecated"), "observed_at",
    )


def versions(parsed: DataFrame) -> DataFrame:
    """One row for each version with publish facts, hooks, binaries and provenance."""
    rows = parsed.select("observed_at", F.col("d.name").alias("package"), F.col("d.time").alias("time"), F.explode("d.versions").alias("version", "v"))
    hooks = X.hooks_of(F.col("v.scripts"))
    attested = truthy(F.col("v.dist.attestations")) | truthy(F.col("v._hasProvenance"))
    return rows.select(
        "package", "version", semver.sort_key(F.col("version")).alias("version_sort"), X.instant(F.col("time")[F.col("version")], F.col("observed_at")).alias("published_at"),
        F.col("v._npmUser.name").alias("publisher"), F.col("v.dist.unpackedSize").alias("unpacked_size"), F.col("v.dist.fileCount").alias("file_count"),
        (F.size(hooks) > 0).alias("has_install_hook"), hooks.alias("install_hook_kind"), X.has_native(F.col("v.gypfile"), F.col("v.files")).alias("has_native_binary"),
        F.when(attested, "ATTESTED").otherwise("UNATTESTED").alias("provenance"), "observed_at",
    )


def dependency_edges(parsed: DataFrame) -> DataFrame:
    """package, version, dependency, range and its class; runtime dependencies only."""
    rows = parsed.select(F.col("d.name").alias("package"), F.explode("d.versions").alias("version", "v"))
    rows = rows.select("package", "version", F.explode("v.dependencies").alias("dependency", "range_raw"))
    return rows.select("*", F.lit("RUNTIME").alias("kind"), semver.classify(F.col("range_raw")).alias("range_class"))


def maintainers(parsed: DataFrame) -> DataFrame:
    """package, observed_at, handle, email_hash, email_domain; addresses themselves are never kept."""
    rows = parsed.select("observed_at", F.col("d.name").alias("package"), F.explode("d.maintainers").alias("m")).where("m.name IS NOT NULL")
    mail = F.nullif(F.col("m.email"), F.lit(""))
    return rows.select("package", "observed_at", F.col("m.name").alias("handle"), X.email_hash(mail).alias("email_hash"), F.when(mail.isNotNull(), X.email_domain(mail)).alias("email_domain"))


def blobs(documents: DataFrame) -> DataFrame:
    """sha256, content, size: one row for each distinct document."""
    raw = documents.select(F.encode("content", "UTF-8").alias("content"))
    return raw.select(F.sha2("content", 256).alias("sha256"), "content", F.length("content").cast("long").alias("size_bytes")).dropDuplicates(["sha256"])


def pointers(documents: DataFrame) -> DataFrame:
    """name, fetched_at and digest of each document as it came."""
    return documents.select(F.get_json_object("content", "$.name").alias("package_name"), F.col("observed_at").alias("fetched_at"), let(F.encode("content", "UTF-8"), lambda b: F.sha2(b, 256)).alias("raw_blob_sha256"))
