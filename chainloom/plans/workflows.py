"""Queries over documents and reports: what a user's workflow asks, from tables to documents and back.

Documents (registry texts, sources, lockfiles) are made from the tables in Spark, read by the
operators, and compared with SQL over the tables that the second engine runs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from ..functions import text as X
from ..functions.scoring import intervention_cost
from ..operators import customer, epochs, fragility, graph, ingest, policy, reachability, reports
from ..session import shared_folder
from ..sources import corpus, lockfiles, packuments, seed, trees
from ..streaming import feed
from . import catalogue as C
from .adapters import view, with_views
from .catalogue import query


def _table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/chainloom/{name}-{uuid.uuid4().hex}"


# ---- registry documents ------------------------------------------------------


def _packuments(spark, sf) -> DataFrame:
    """(content, observed_at): a registry text for each customer with orders; an order is a version."""
    o, c = _table(spark, sf, "orders"), _table(spark, sf, "customer")
    k = F.col("o_orderkey")
    version = F.concat(F.lit("1."), k, F.lit(".0"))
    empty = F.expr("CAST(NULL AS map<string,string>)")
    body = F.struct(
        version.alias("version"),
        F.when(~F.col("o_orderpriority").startswith("4"), F.struct(F.col("o_orderpriority").alias("name"))).alias("_npmUser"),
        F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("postinstall"), F.lit("x"), F.lit("test"), F.lit("y"))).when(F.col("o_orderstatus") == "P", F.create_map(F.lit("install"), F.lit("z"))).otherwise(F.create_map(F.lit("test"), F.lit("t"))).alias("scripts"),
        F.when(k % 2 == 0, F.create_map(F.concat(F.lit("pkg-"), k % 97), F.concat(F.lit("^1."), k % 7, F.lit(".0")), F.lit("util"), F.lit("*"))).otherwise(empty).alias("dependencies"),
        F.when(k % 10 == 0, F.array(F.lit("a.js"), F.lit("b.node"))).alias("files"),
        F.when(k % 15 == 0, True).alias("gypfile"),
        F.struct(F.floor("o_totalprice").alias("unpackedSize"), (k % 9).alias("fileCount"), (F.col("o_orderstatus") == "O").alias("attestations")).alias("dist"),
    )
    when = F.when(k % 6 != 0, F.struct(version, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    packs = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.map_from_entries(F.collect_list(F.struct(version, body))).alias("versions"), F.map_from_entries(F.collect_list(when)).alias("time"))
    n = F.col("c_custkey")
    head = [F.concat(F.lit("Pkg-"), n).alias("name"), F.array(F.struct(F.col("c_mktsegment").alias("name"), F.concat(F.lit(" Ann@Host"), F.col("c_nationkey"), F.lit(".Example ")).alias("email"))).alias("maintainers"), F.when(n % 20 == 0, "use other").alias("deprecated"), "time", "versions"]
    url = F.concat(F.lit("git+https://github.com/org"), n, F.lit("/repo"), n, F.lit(".git/"))
    content = F.when(n % 3 == 0, F.to_json(F.struct(*head, F.struct(F.lit("git").alias("type"), url.alias("url")).alias("repository")))).otherwise(F.to_json(F.struct(*head, F.when(n % 3 == 1, "https://gitlab.com/x/y").alias("repository"))))
    return packs.join(c, "c_custkey").select(content.alias("content"), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("observed_at"))


KNOWN = "FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"


@query(
    f"""SELECT 'Pkg-' || c_custkey::VARCHAR AS name, 'pkg-' || c_custkey::VARCHAR AS name_normalized, 'pkg:npm/Pkg-' || c_custkey::VARCHAR AS purl,
    CASE c_custkey % 3 WHEN 0 THEN 'git+https://github.com/org' || c_custkey::VARCHAR || '/repo' || c_custkey::VARCHAR || '.git/' WHEN 1 THEN 'https://gitlab.com/x/y' END AS repo_url,
    CASE WHEN c_custkey % 3 = 0 THEN 'org' || c_custkey::VARCHAR END AS repo_owner, CASE WHEN c_custkey % 3 = 0 THEN 'repo' || c_custkey::VARCHAR END AS repo_name, c_custkey % 20 = 0 AS is_deprecated {KNOWN}"""
)
def hydrate_packages(spark, sf):
    return api.hydrate(_packuments(spark, sf))["packages"].drop("observed_at")


@query(
    """SELECT 'Pkg-' || o_custkey::VARCHAR AS package, '1.' || o_orderkey::VARCHAR || '.0' AS version, epoch_us(CASE WHEN o_orderkey % 6 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE o_orderdate END) AS published_us,
    CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE o_orderpriority END AS publisher, floor(o_totalprice)::BIGINT AS unpacked_size, o_orderkey % 9 AS file_count, o_orderstatus IN ('F', 'P') AS has_install_hook,
    CASE o_orderstatus WHEN 'F' THEN 'postinstall' WHEN 'P' THEN 'install' ELSE '' END AS hooks, o_orderkey % 10 = 0 OR o_orderkey % 15 = 0 AS has_native_binary, CASE WHEN o_orderstatus = 'O' THEN 'ATTESTED' ELSE 'UNATTESTED' END AS provenance FROM orders"""
)
def hydrate_versions(spark, sf):
    v = api.hydrate(_packuments(spark, sf))["versions"]
    return v.select("package", "version", F.unix_micros("published_at").alias("published_us"), "publisher", "unpacked_size", "file_count", "has_install_hook", F.array_join("install_hook_kind", ",").alias("hooks"), "has_native_binary", "provenance")


@query(
    """SELECT 'Pkg-' || o_custkey::VARCHAR AS package, '1.' || o_orderkey::VARCHAR || '.0' AS version, 'pkg-' || (o_orderkey % 97)::VARCHAR AS dependency, '^1.' || (o_orderkey % 7)::VARCHAR || '.0' AS range_raw, 'RUNTIME' AS kind, 'CARET' AS range_class FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'Pkg-' || o_custkey::VARCHAR, '1.' || o_orderkey::VARCHAR || '.0', 'util', '*', 'RUNTIME', 'WILDCARD' FROM orders WHERE o_orderkey % 2 = 0"""
)
def hydrate_edges(spark, sf):
    return api.hydrate(_packuments(spark, sf))["edges"]


@query(f"SELECT 'Pkg-' || c_custkey::VARCHAR AS package, c_mktsegment AS handle, sha256('ann@host' || c_nationkey::VARCHAR || '.example') AS email_hash, 'host' || c_nationkey::VARCHAR || '.example' AS email_domain, epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS polled_us {KNOWN}")
def hydrate_maintainers(spark, sf):
    out = api.hydrate(_packuments(spark, sf))
    polled = out["last_polled"].select("package", F.unix_micros("last_polled_at").alias("polled_us"))
    return out["current_maintainers"].select("package", "handle").join(out["maintainers"], ["package", "handle"]).join(polled, "package").select("package", "handle", "email_hash", "email_domain", "polled_us")


@query(f"SELECT 'Pkg-' || c_custkey::VARCHAR AS package_name, true AS stored {KNOWN}")
def raw_pointers(spark, sf):
    """Pointers of documents to their blobs, appended twice as two fetches would; each points to a stored blob."""
    docs = graph.cut_lineage(_packuments(spark, sf))
    path = _folder(spark, "pointers")
    for _ in range(2):
        packuments.pointers(docs).write.mode("append").parquet(path)
    blobs = packuments.blobs(docs).select(F.col("sha256").alias("raw_blob_sha256"), F.lit(True).alias("stored"))
    return spark.read.parquet(path).join(blobs, "raw_blob_sha256", "left").groupBy("package_name").agg((F.bool_and(F.coalesce("stored", F.lit(False))) & (F.count("*") == 2)).alias("stored"))


@query("SELECT substr(sha256(html), 1, 2) AS prefix, count(DISTINCT html) AS n, sum(octet_length(encode(html)))::BIGINT AS size_bytes FROM (SELECT DISTINCT html FROM pages) GROUP BY ALL")
def blob_store(spark, sf):
    """Pages written to the blob store twice; what is there already is skipped."""
    docs = _table(spark, sf, "pages").select(F.col("html").alias("content"), F.lit(None).cast("timestamp").alias("observed_at"))
    path = _folder(spark, "blobs")
    for _ in range(2):
        ingest.write_blobs(packuments.blobs(docs), path)
    return spark.read.parquet(path).groupBy(F.col("prefix").cast("string").alias("prefix")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"))


@query("SELECT sha256(html) AS sha256, html AS text FROM (SELECT DISTINCT html FROM pages ORDER BY sha256(html) LIMIT 1)")
def blob_read(spark, sf):
    """One blob back from the store by its digest."""
    docs = _table(spark, sf, "pages").select(F.col("html").alias("content"), F.lit(None).cast("timestamp").alias("observed_at"))
    path = _folder(spark, "blobs")
    ingest.write_blobs(packuments.blobs(docs), path)
    first = docs.agg(F.min(F.sha2(F.encode("content", "UTF-8"), 256))).first()[0]
    return ingest.read_blob(spark, path, first).select("sha256", F.decode("content", "UTF-8").alias("text"))


@query(
    """WITH RECURSIVE e(src, dst) AS (VALUES ('chalk', 'ansi-styles'), ('chalk', 'supports-color'), ('ansi-styles', 'color-convert'), ('color-convert', 'color-name'), ('supports-color', 'has-flag'), ('express', 'accepts'), ('express', 'body-parser'), ('express', 'chalk'),
    ('api-gateway', 'express'), ('web-dashboard', 'express'), ('web-dashboard', 'chalk'), ('auth-service', 'express'), ('payment-api', 'api-gateway'), ('admin-portal', 'web-dashboard'), ('event-stream', 'flatmap-stream')),
    w AS (SELECT DISTINCT dst AS root, dst AS node, 0 AS depth FROM e UNION SELECT DISTINCT src, src, 0 FROM e UNION SELECT w.root, e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.node)
    SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node"""
)
def seed_radius(spark, sf):
    """The starting registry hydrated, its package graph, and every blast radius in it."""
    edges = api.hydrate(seed.packuments(spark))["edges"].select(F.col("package").alias("src"), F.col("dependency").alias("dst")).distinct()
    return graph.closure(edges, graph.nodes_of(edges)).select("root", "node", "depth")


# ---- keyed writes ------------------------------------------------------------


@query(with_views(["mails"], "SELECT sha256(lower(trim(email))) AS handle, CASE WHEN max(c_custkey % 2) = 1 THEN max_by('login-' || c_custkey::VARCHAR, c_custkey) FILTER (c_custkey % 2 = 1) END AS github_login, max(c_custkey) AS seq FROM mails GROUP BY 1"))
def maintainer_upsert(spark, sf):
    writes = view(spark, sf, "mails").select(X.email_hash(F.col("email")).alias("handle"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("login-"), "c_custkey")).alias("github_login"), F.col("c_custkey").alias("seq"))
    return ingest.upsert(writes, ["handle"], ingest.MAINTAINER_POLICY)


@query(
    with_views(
        ["versions"],
        """, p AS (SELECT package, seq, '1.' || (seq % 5)::VARCHAR || '.' || (seq % 11)::VARCHAR || CASE WHEN seq % 4 = 0 THEN '-rc.1' ELSE '' END AS version, seq % 5 AS b, seq % 11 AS c, CASE WHEN seq % 4 = 0 THEN 0 ELSE 1 END AS fin FROM versions)
        SELECT package, max_by(version, seq) AS latest_version, max_by(version, (b, c, fin)) AS semver_latest FROM p GROUP BY package""",
    )
)
def latest_versions(spark, sf):
    v = view(spark, sf, "versions").withColumn("version", F.concat(F.lit("1."), F.col("seq") % 5, F.lit("."), F.col("seq") % 11, F.when(F.col("seq") % 4 == 0, "-rc.1").otherwise("")))
    return ingest.latest_written(v)


@query(with_views(["polls"], "SELECT package, epoch_us(max(observed_at)) AS polled_us FROM polls GROUP BY package"))
def last_polled(spark, sf):
    return ingest.last_polled(ingest.snapshots(view(spark, sf, "polls"))).select("package", F.unix_micros(F.col("last_polled_at").cast("timestamp")).alias("polled_us"))


@query(with_views(["nodes"], "SELECT name, name IN (SELECT 'pkg-' || user_id::VARCHAR FROM events WHERE event_type = 'error') AS is_unpublished FROM nodes"))
def unpublished_packages(spark, sf):
    """What a feed deleted, carried over to the packages."""
    changes = _table(spark, sf, "events").select(F.col("event_id").cast("string").alias("seq"), F.concat(F.lit("pkg-"), "user_id").alias("id"), (F.col("event_type") == "error").alias("deleted"))
    gone = feed.dispatch(changes).where("status = 'marked_unpublished'").select(F.col("id").alias("name"))
    return ingest.apply_deletions(view(spark, sf, "nodes"), gone)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE WHEN p_partkey % 3 = 0 AND p_partkey < (SELECT count(*) FROM supplier) THEN (p_partkey % 4)::INT ELSE 3 END AS poll_tier FROM part")
def tier_updates(spark, sf):
    packages = _table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" PKG-"), "p_partkey", F.lit(" ")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "npm").otherwise("pypi").alias("ecosystem"), F.lit(3).alias("poll_tier"))
    tiers = _table(spark, sf, "supplier").select(F.concat(F.lit("pkg-"), "s_suppkey").alias("name"), (F.col("s_suppkey") % 4).cast("int").alias("tier"))
    return ingest.apply_tiers(packages, tiers).select("p_partkey", "ecosystem", "poll_tier")


@query(with_views(["versions"], "SELECT package, version FROM versions WHERE seq % 2 = 1"))
def table_reload(spark, sf):
    """A table that is replaced as a whole: of two loads the second counts."""
    v, path = view(spark, sf, "versions"), _folder(spark, "reload")
    ingest.reload(v.where("seq % 2 = 0").select("package", "version"), path)
    return ingest.reload(v.where("seq % 2 = 1").select("package", "version"), path)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'DEV' ELSE 'RUNTIME' END AS kind, CASE o_orderstatus WHEN 'O' THEN 'ATTESTED' ELSE 'UNKNOWN' END AS provenance, CASE o_orderkey % 3 WHEN 0 THEN 'CARET' ELSE 'EXACT' END AS range_class FROM orders")
def enum_fallback(spark, sf):
    from ..functions.semver import RANGE_CLASSES

    k = F.col("o_orderkey")
    kind, said = F.when(k % 4 == 0, "DEV").when(k % 4 == 1, "odd").when(k % 4 == 2, "dev"), F.when(F.col("o_orderstatus") == "O", "ATTESTED").otherwise(F.col("o_orderstatus"))
    of = F.when(k % 3 == 0, "CARET").when(k % 3 == 1, "caret")
    return _table(spark, sf, "orders").select("o_orderkey", X.one_of(kind, X.KINDS, "RUNTIME").alias("kind"), X.one_of(said, X.PROVENANCES, "UNKNOWN").alias("provenance"), X.one_of(of, tuple(RANGE_CLASSES), "EXACT").alias("range_class"))


@query(
    with_views(
        ["versions"],
        """, stored AS (SELECT package, version FROM versions WHERE seq % 3 <> 0), gaps AS (SELECT package, string_agg(version, ',' ORDER BY version) AS missed, count(*) AS missed_count, 'upstream_replication_loss' AS reason FROM versions v
        WHERE package IN (SELECT package FROM stored) AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.package = v.package AND s.version = v.version) GROUP BY package)
        SELECT package, missed, missed_count, reason, (SELECT count(*) FROM versions v WHERE v.package = gaps.package) AS versions_after FROM gaps""",
    )
)
def feed_gap_records(spark, sf):
    """Gap records, kept as a table, and the versions of each such package once it is loaded again."""
    registry, path = view(spark, sf, "versions"), _folder(spark, "gaps")
    stored = registry.where("seq % 3 <> 0")
    ingest.feed_gaps(ingest.reconcile(registry, stored)).write.mode("append").parquet(path)
    gaps = spark.read.parquet(path)
    missing = ingest.insert_new(stored, registry.join(gaps.select("package"), "package", "left_semi"), ["package", "version"])
    after = stored.unionByName(missing).groupBy("package").agg(F.count("*").alias("versions_after"))
    return gaps.join(after, "package").select("package", F.array_join("missed", ",").alias("missed"), "missed_count", "reason", "versions_after")


@query(with_views(["polls"], C.POLLS + " SELECT package, event_type, handle, epoch_us(observed_at) AS observed_us FROM found WHERE event_type LIKE 'SOLE%'"))
def sole_owner_transitions(spark, sf):
    events = ingest.maintainer_events(ingest.snapshots(view(spark, sf, "polls")))
    return events.where("event_type LIKE 'SOLE%'").select("package", "event_type", "handle", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_us"))


@query(with_views(["polls"], C.POLLS + " SELECT package, epoch_us(observed_at) AS observed_us, gap AS gap_seconds FROM gaps WHERE gap IS NOT NULL"))
def observation_gap(spark, sf):
    snaps = ingest.snapshots(view(spark, sf, "polls"))
    from pyspark.sql import Window

    w = Window.partitionBy("package").orderBy("observed_at")
    return snaps.select("package", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_us"), X.seconds_between(F.col("observed_at"), F.lag("observed_at").over(w)).alias("gap_seconds")).where("gap_seconds IS NOT NULL")


@query(with_views(["polls"], C.POLLS + " SELECT package, event_type, handle, epoch_us(observed_at) AS observed_us, sha256(handle || '@x.org') AS email_hash FROM found WHERE handle <> 'error'"))
def maintainer_history(spark, sf):
    events = ingest.maintainer_events(ingest.snapshots(view(spark, sf, "polls")))
    mails = view(spark, sf, "polls").select("handle").distinct().where("handle <> 'error'").withColumn("email_hash", X.email_hash(F.concat("handle", F.lit("@X.org "))))
    return reports.maintainer_history(events, mails).select("package", "event_type", "handle", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("observed_us"), "email_hash")


# ---- sources and documents -----------------------------------------------------


def _sources(spark, sf) -> DataFrame:
    """(project_id, path, content) of made-up source files; ``mentions`` lists what they import."""
    m, q = view(spark, sf, "mentions"), "'"
    text = (
        F.when(F.col("kind") == 0, F.concat(F.lit("import { parse, view as v,\n  click } from '"), "a", F.lit("/sub/deep';")))
        .when(F.col("kind") == 1, F.concat(F.lit('// head\nimport main from "'), "b", F.lit(f'/lib";\nimport * as all from {q}../'), "c", F.lit(q)))
        .when(F.col("kind") == 2, F.concat(F.lit(f"\nconst ns = require({q}"), "a", F.lit(f'{q});\nconst {{ call, view }} = require("'), "d", F.lit('/fp")')))
        .otherwise(F.concat(F.lit(f"no imports here\n\nawait import({q}./"), "a", F.lit(f"{q})")))
    )
    return m.select("project_id", "path", text.alias("content"))


USES = """, found(project_id, pkg, symbol, dyn, ns, path, line) AS (
    SELECT project_id, a, unnest(['parse', 'view', 'click']), false, false, path, 1 FROM mentions WHERE kind = 0
    UNION ALL SELECT project_id, b, 'default', false, false, path, 2 FROM mentions WHERE kind = 1 UNION ALL SELECT project_id, c, NULL, false, true, path, 3 FROM mentions WHERE kind = 1
    UNION ALL SELECT project_id, a, NULL, true, true, path, 2 FROM mentions WHERE kind = 2 UNION ALL SELECT project_id, d, unnest(['call', 'view']), true, false, path, 3 FROM mentions WHERE kind = 2
    UNION ALL SELECT project_id, a, NULL, true, false, path, 3 FROM mentions WHERE kind = 3),
    indexed AS (SELECT project_id, pkg, coalesce(string_agg(DISTINCT symbol, ',' ORDER BY symbol), '') AS symbols, bool_or(dyn) AS is_dynamic, bool_or(ns) AS is_namespace, string_agg(DISTINCT path || ':' || line::VARCHAR, ',' ORDER BY path || ':' || line::VARCHAR) AS sites FROM found GROUP BY project_id, pkg)"""


@query(with_views(["mentions"], USES + " SELECT project_id, pkg, symbols, is_dynamic, is_namespace, sites FROM indexed"))
def source_index(spark, sf):
    """The import index of source files, by project: symbols, flags and places."""
    index = api.import_index(_sources(spark, sf))
    sites = F.array_sort(F.array_distinct(F.transform("sites", lambda s: F.concat(s["file"], F.lit(":"), s["line"]))))
    return index.select("project_id", "pkg", F.array_join("symbols", ",").alias("symbols"), "is_dynamic", "is_namespace", F.array_join(sites, ",").alias("sites"))


def _found_verdicts(spark, sf) -> DataFrame:
    """Verdicts of the advisories against the index of the made-up sources, all projects together."""
    index = reachability.merge_index(trees.index_files(_sources(spark, sf)).drop("project_id"))
    adv = view(spark, sf, "advisories").withColumn("package", F.concat(F.lit("pkg-"), F.col("advisory") % 120))
    adv = adv.select(F.concat(F.lit("ADV-"), "advisory").alias("vulnerability"), "package", F.lit("1.0.0").alias("version"), F.when(F.col("symbol").isNotNull(), F.array("symbol")).alias("affected_symbols"), "has_install_hook", "is_transitive")
    return reachability.verdicts(adv, index)


FOUND = USES + """, idx AS (SELECT pkg, list(DISTINCT symbol) FILTER (symbol IS NOT NULL) AS symbols, bool_or(dyn OR ns) AS unclear FROM found GROUP BY pkg),
    adv AS (SELECT 'ADV-' || advisory::VARCHAR AS vulnerability, 'pkg-' || (advisory % 120)::VARCHAR AS package, symbol, has_install_hook AS hook, is_transitive AS far FROM advisories),
    verdict AS (SELECT vulnerability, package, CASE WHEN hook THEN 'REACHABLE_INSTALL' WHEN pkg IS NULL THEN 'NOT_REACHABLE' WHEN symbol IS NULL OR list_contains(coalesce(symbols, []), symbol) THEN 'REACHABLE' WHEN unclear THEN 'UNKNOWN' ELSE 'NOT_REACHABLE' END AS reachability,
        CASE WHEN hook THEN 'HIGH' WHEN pkg IS NULL THEN CASE WHEN far THEN 'MEDIUM' ELSE 'HIGH' END WHEN symbol IS NULL THEN 'LOW' WHEN list_contains(coalesce(symbols, []), symbol) THEN 'HIGH' WHEN unclear THEN 'LOW' ELSE 'HIGH' END AS confidence FROM adv LEFT JOIN idx ON pkg = package)"""
FOUND_VIEWS = ["mentions", "advisories"]
SAFE = "reachability = 'NOT_REACHABLE' AND confidence = 'HIGH'"


@query(with_views(FOUND_VIEWS, FOUND + f" SELECT package, vulnerability, 'pkg:npm/' || package || '@1.0.0' AS product, CASE WHEN {SAFE} THEN 'not_affected' WHEN reachability LIKE 'REACHABLE%' THEN 'affected' ELSE 'under_investigation' END AS status, CASE WHEN {SAFE} THEN 'vulnerable_code_not_in_execute_path' END AS justification FROM verdict"))
def openvex_documents(spark, sf):
    """OpenVEX documents, one for each package, read back statement by statement."""
    docs = reachability.openvex(_found_verdicts(spark, sf), ("package",))
    shape = "struct<statements:array<struct<vulnerability:struct<name:string>,products:array<struct<`@id`:string>>,status:string,justification:string>>>"
    s = docs.select("package", F.explode(F.from_json("document", shape)["statements"]).alias("s"))
    return s.select("package", F.col("s.vulnerability.name").alias("vulnerability"), F.col("s.products")[0]["@id"].alias("product"), "s.status", "s.justification")


@query(with_views(FOUND_VIEWS, FOUND + f" SELECT package, vulnerability, 'pkg:npm/' || package || '@1.0.0' AS ref, CASE WHEN {SAFE} THEN 'not_affected' WHEN reachability LIKE 'REACHABLE%' THEN 'exploitable' ELSE 'in_triage' END AS state, CASE WHEN {SAFE} THEN 'code_not_reachable' END AS justification FROM verdict"))
def cyclonedx_vex_documents(spark, sf):
    """CycloneDX documents with analyses, one for each package, read back."""
    docs = reachability.cyclonedx_vex(_found_verdicts(spark, sf), ("package",))
    shape = "struct<vulnerabilities:array<struct<id:string,analysis:struct<state:string,justification:string>,affects:array<struct<ref:string>>>>>"
    v = docs.select("package", F.explode(F.from_json("document", shape)["vulnerabilities"]).alias("v"))
    return v.select("package", F.col("v.id").alias("vulnerability"), F.col("v.affects")[0]["ref"].alias("ref"), "v.analysis.state", "v.analysis.justification")


NAMED = "SELECT DISTINCT project_id, name FROM (SELECT project_id, src AS name FROM project_edges UNION ALL SELECT project_id, dst FROM project_edges)"
SCORES = ", scores AS (SELECT 'pkg-' || c_custkey::VARCHAR AS name, consequence AS score, fragility, kev_listed FROM components)"


def _named(spark, sf) -> DataFrame:
    e = view(spark, sf, "project_edges")
    return e.select("project_id", F.col("src").alias("name")).union(e.select("project_id", "dst")).distinct()


def _scores(spark, sf) -> DataFrame:
    return view(spark, sf, "components").select(F.concat(F.lit("pkg-"), "c_custkey").alias("name"), F.col("consequence").alias("score"), "fragility", "kev_listed")


@query(with_views(["project_edges", "components"], SCORES + f", n AS ({NAMED}) SELECT n.project_id, n.name, 'pkg:npm/' || n.name AS purl, round(coalesce(score, 35.0), 4)::DOUBLE AS score FROM n LEFT JOIN scores USING (name)"))
def sbom_documents(spark, sf):
    """Bills of materials with scores, one for each project, read back."""
    docs = api.sbom(_named(spark, sf), _scores(spark, sf), ("project_id",))
    shape = "struct<components:array<struct<name:string,purl:string,properties:array<struct<value:string>>>>>"
    c = docs.select("project_id", F.explode(F.from_json("document", shape)["components"]).alias("c"))
    return c.select("project_id", "c.name", "c.purl", F.round(F.col("c.properties")[0]["value"].cast("double"), 4).alias("score"))


@query(with_views(["multigraph", "components"], SCORES + " SELECT s.name AS package, CASE WHEN s.score >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, (SELECT count(*) FROM multigraph m WHERE m.dst = s.name)::INT AS path_count FROM scores s"))
def evidence_documents(spark, sf):
    paths = view(spark, sf, "multigraph").groupBy(F.col("dst").alias("name")).agg(F.array_sort(F.collect_list("src")).alias("paths"))
    rows = _scores(spark, sf).join(paths, "name", "left").select(F.col("name").alias("package"), (F.col("score") / 100).alias("probability"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
    d = F.from_json("document", "struct<confidence:string,path_count:int>")
    return fragility.evidence(rows).select("package", d["confidence"].alias("confidence"), d["path_count"].alias("path_count"))


# ---- projects ------------------------------------------------------------------


def _locked(spark, sf) -> DataFrame:
    """(project_id, filename, content): a lockfile of version 2 for each project; packages that nothing needs are its direct ones in odd projects."""
    e = view(spark, sf, "project_edges")
    needs = e.groupBy("project_id", F.col("src").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("dst", F.lit("^1.0.0")))).alias("dependencies"))
    n = F.substring("name", 5, 20).cast("int")
    entry = F.struct(F.lit("1.0.0").alias("version"), F.when(n % 3 == 0, F.concat(F.lit("sha512-"), "name")).alias("integrity"), "dependencies")
    entries = needs.groupBy("project_id").agg(F.collect_list(F.struct(F.concat(F.lit("node_modules/"), "name"), entry)).alias("all"))
    tops = e.select("project_id", F.col("src").alias("name")).distinct().join(e.select("project_id", F.col("dst").alias("name")), ["project_id", "name"], "left_anti")
    root = tops.where(F.substring("project_id", 6, 5).cast("int") % 2 == 1).groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.lit("^1.0.0")))).alias("direct"))
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(""), F.struct(none.alias("version"), none.alias("integrity"), F.coalesce("direct", F.expr("CAST(map() AS map<string,string>)")).alias("dependencies")))
    body = F.to_json(F.struct(F.lit(2).alias("lockfileVersion"), F.map_from_entries(F.concat(F.array(first), "all")).alias("packages")))
    return entries.join(root, "project_id", "left").select("project_id", F.lit("package-lock.json").alias("filename"), body.alias("content"))


LOCKED = """, own AS (SELECT DISTINCT project_id, src AS name FROM project_edges), tops AS (SELECT project_id, name FROM own WHERE NOT EXISTS (SELECT 1 FROM project_edges x WHERE x.project_id = own.project_id AND x.dst = own.name)),
    extra AS (SELECT DISTINCT project_id, dst AS name FROM project_edges WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.project_id = project_edges.project_id AND own.name = project_edges.dst)),
    loaded AS (SELECT project_id, name, '1.0.0' AS version, CASE WHEN substr(name, 5)::INT % 3 = 0 THEN 'ATTESTED' ELSE 'UNATTESTED' END AS provenance, EXISTS (SELECT 1 FROM tops t WHERE t.project_id = own.project_id AND t.name = own.name) AS is_direct FROM own
        UNION ALL SELECT project_id, name, '1.0.0', 'UNATTESTED', false FROM extra)"""


@query(with_views(["project_edges"], LOCKED + " SELECT project_id, name, version, provenance, is_direct FROM loaded"))
def project_packages(spark, sf):
    """Packages of projects, from lockfiles; without marked ones, what nobody needs is direct."""
    return customer.load(lockfiles.parse_lockfiles(graph.cut_lineage(_locked(spark, sf))))[0]


@query(with_views(["project_edges"], LOCKED + " SELECT project_id, src, dst, '^1.0.0' AS range_raw, 'CARET' AS range_class FROM project_edges UNION ALL SELECT project_id, 'root', name, '*', 'CARET' FROM tops"))
def project_graph(spark, sf):
    return customer.load(lockfiles.parse_lockfiles(graph.cut_lineage(_locked(spark, sf))))[1].select("project_id", "src", "dst", "range_raw", "range_class")


@query(
    with_views(
        ["project_edges", "components"],
        LOCKED
        + SCORES
        + """, rated AS (SELECT l.project_id, l.name, coalesce(score, 40.0) AS score FROM loaded l LEFT JOIN scores USING (name))
        SELECT project_id, name, round(score, 1) AS risk FROM rated WHERE score >= 60 UNION ALL SELECT project_id, max(name), 75.0 FROM rated GROUP BY project_id HAVING max(score) < 60""",
    )
)
def project_risks(spark, sf):
    packages, _ = customer.load(lockfiles.parse_lockfiles(graph.cut_lineage(_locked(spark, sf))))
    return customer.risks(packages, _scores(spark, sf))


@query(
    C.with_views(
        ["project_edges"],
        C.PLANNED.replace("substr(name, 5)::DOUBLE AS risk", "substr(name, 5)::DOUBLE AS risk") + " SELECT project_id, step, action, target, eliminated, total, percentage, cost_used FROM planned",
        True,
    )
)
def solve_projects(spark, sf):
    """From lockfiles to plans: parse, load, rate, dominators, candidates, choice."""
    risk = _named(spark, sf).where("length(name) % 2 = 0").select("name", F.substring("name", 5, 20).cast("double").alias("score")).distinct()
    # All even-length names are at risk, whatever their number, as in the query of plans.
    packages, edges = customer.load(lockfiles.parse_lockfiles(graph.cut_lineage(_locked(spark, sf))))
    at_risk = packages.join(risk, "name").select("project_id", "name", F.col("score").alias("risk"))
    below = graph.dominated_sets(graph.immediate_dominators(edges))
    direct = packages.where("is_direct").select("project_id", "name")
    return customer.plan(customer.candidates(direct, below, at_risk), at_risk, 10.0).select("project_id", "step", "action", "target", "eliminated", "total", "percentage", "cost_used")


@query(
    with_views(
        ["project_edges", "components"],
        LOCKED
        + SCORES
        + """ SELECT own.project_id, own.name, '1.0.0' AS version, own.project_id IN ('proj-1', 'proj-3', 'proj-5', 'proj-7') AND EXISTS (SELECT 1 FROM tops t WHERE t.project_id = own.project_id AND t.name = own.name) AS is_direct, coalesce(score, 35.0) AS consequence, coalesce(fragility, 0.0) AS fragility,
        CASE WHEN coalesce(score, 35.0) > 80 THEN 'WARN' ELSE 'PASS' END AS status FROM own LEFT JOIN scores USING (name)""",
    )
)
def project_scan(spark, sf):
    """Every dependency of every lockfile with its scores and policy status."""
    return api.scan(graph.cut_lineage(_locked(spark, sf)), _scores(spark, sf), _scores(spark, sf))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'pnpm' WHEN 1 THEN 'yarn' WHEN 2 THEN 'npm' WHEN 3 THEN 'pnpm' ELSE 'yarn' END AS kind FROM customer")
def lockfile_sniff(spark, sf):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "PNPM-lock.YAML").when(k == 1, "yarn.lock").when(k == 2, "package-lock.json")
    text = F.when(k == 3, "x\nimporters:\n").when(k == 4, "# yarn lockfile v1\n").otherwise("{}")
    return _table(spark, sf, "customer").select("c_custkey", lockfiles.sniff(name, text).alias("kind"))


@query("SELECT c_custkey, 'pkg-' || c_custkey::VARCHAR AS name, '1.' || (c_custkey % 9)::VARCHAR || '.0' AS version, 'dep-' || (c_custkey % 7)::VARCHAR || ' ^2.0.0' AS needs FROM customer")
def yarn_entries(spark, sf):
    """A yarn file for each customer, written from the table and read by the parser."""
    c = F.col("c_custkey")
    text = F.concat(F.lit("# yarn lockfile v1\n\n\npkg-"), c, F.lit("@^1.0.0, pkg-"), c, F.lit('@^1.1.0:\n  version "1.'), c % 9, F.lit('.0"\n  resolved "https://r/x#1"\n  dependencies:\n    dep-'), c % 7, F.lit(' "^2.0.0"\n  optionalDependencies:\n    other "1.0.0"\n'))
    rows = lockfiles.yarn(_table(spark, sf, "customer").select(c.alias("project_id"), text.alias("content")))
    return rows.select(F.col("project_id").cast("long").alias("c_custkey"), "name", "version", F.array_join(F.transform(F.map_entries("dependencies"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ",").alias("needs"))


@query("SELECT c_custkey, '@s/pkg-' || c_custkey::VARCHAR AS name, '1.' || (c_custkey % 9)::VARCHAR || '.0' AS version, c_custkey % 2 = 0 AS is_direct FROM customer")
def pnpm_entries(spark, sf):
    c = F.col("c_custkey")
    top = F.when(c % 2 == 0, F.concat(F.lit("    dependencies:\n      '@s/pkg-"), c, F.lit("': 1.0.0\n"))).otherwise(F.lit("    devDependencies: {}\n"))
    text = F.concat(F.lit("importers:\n  .:\n"), top, F.lit("packages:\n  '/@s/pkg-"), c, F.lit("@1."), c % 9, F.lit(".0':\n    resolution: {integrity: x}\n"))
    rows = lockfiles.pnpm(_table(spark, sf, "customer").select(c.alias("project_id"), text.alias("content")))
    return rows.select(F.col("project_id").cast("long").alias("c_custkey"), "name", "version", "is_direct")


@query("SELECT c_custkey, 'cdx' AS format, 'lib-' || c_custkey::VARCHAR AS name, '2.' || (c_custkey % 4)::VARCHAR AS version, 'ref-' || (c_custkey % 8)::VARCHAR || ' *' AS needs FROM customer UNION ALL SELECT c_custkey, 'spdx', 'lib-' || c_custkey::VARCHAR, CASE WHEN c_custkey % 2 = 0 THEN '2.' || (c_custkey % 4)::VARCHAR ELSE '0.0.0' END, '' FROM customer")
def sbom_entries(spark, sf):
    """Bills of materials of both formats, written from the table and read by the parsers."""
    c = F.col("c_custkey")
    name, version = F.concat(F.lit("lib-"), c), F.concat(F.lit("2."), c % 4)
    cdx = F.to_json(F.struct(F.array(F.struct(name.alias("name"), version.alias("version"), F.concat(F.lit("r"), c).alias("bom-ref"))).alias("components"), F.array(F.struct(F.concat(F.lit("r"), c).alias("ref"), F.array(F.concat(F.lit("ref-"), c % 8)).alias("dependsOn"))).alias("dependencies")))
    spdx = F.to_json(F.struct(F.array(F.struct(name.alias("name"), F.when(c % 2 == 0, version).alias("versionInfo"))).alias("packages")))
    t, out = _table(spark, sf, "customer"), None
    for fmt, text, parser in (("cdx", cdx, lockfiles.cyclonedx), ("spdx", spdx, lockfiles.spdx)):
        rows = parser(graph.cut_lineage(t.select(c.alias("project_id"), text.alias("content"))))
        rows = rows.select(F.col("project_id").alias("c_custkey"), F.lit(fmt).alias("format"), "name", "version", F.array_join(F.transform(F.map_entries("dependencies"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ",").alias("needs"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    with_views(
        ["project_edges"],
        LOCKED + " SELECT project_id, name FROM (SELECT project_id, name, row_number() OVER (PARTITION BY project_id ORDER BY name) AS place FROM own) WHERE place <= 15",
    )
)
def scan_display(spark, sf):
    """The first fifteen dependencies of each project, as a display shows them."""
    parsed = lockfiles.parse_lockfiles(graph.cut_lineage(_locked(spark, sf)))
    return reports.first_of_each(parsed.select("project_id", "name"), "project_id", "name", 15)


@query(with_views(["mentions"], "SELECT project_id, path FROM (SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY path) AS place FROM mentions) WHERE place <= 50"))
def first_sources(spark, sf):
    return reports.first_of_each(_sources(spark, sf).select("project_id", "path"), "project_id", "path", 50)


RANGES = """, r AS (SELECT c_custkey, '1.' || (c_custkey % 5)::VARCHAR || '.' || (c_custkey % 3)::VARCHAR AS version, c_custkey % 5 AS b, c_custkey % 3 AS c, c_custkey % 13 AS k FROM customer),
    forms(k, range_raw, range_class) AS (VALUES (0, '>=1.1.0 <1.3.0', 'RANGE'), (1, '1.x', 'RANGE'), (2, 'latest', 'WILDCARD'), (3, '', 'WILDCARD'), (4, 'workspace:*', 'WORKSPACE'), (5, 'npm:other@1.0.0', 'ALIAS'), (6, 'git+https://h/x', 'GIT'), (7, 'https://h/x.tgz', 'URL'), (8, '=1.2.1', 'EXACT'), (9, '1.0.0 - 1.2.0', 'RANGE'), (10, '>1.2.0 || <1.1.0', 'RANGE'), (11, '^1.2.0', 'CARET'), (12, '~1.3.0', 'TILDE'))"""


@query(
    "WITH x AS (SELECT 1)"
    + RANGES
    + """ SELECT c_custkey, version, range_raw, range_class, CASE k WHEN 0 THEN b >= 1 AND b < 3 WHEN 8 THEN b = 2 AND c = 1 WHEN 10 THEN (b > 2 OR (b = 2 AND c > 0)) AND b < 1 WHEN 11 THEN b >= 2 WHEN 12 THEN b = 3 ELSE true END AS ok FROM r JOIN forms USING (k)"""
)
def range_forms(spark, sf):
    """All classes of ranges, several tokens, bars and hyphens: every token must hold, and what is no comparison holds."""
    from ..functions import semver

    forms = F.array(*[F.lit(x) for x in (">=1.1.0 <1.3.0", "1.x", "latest", "", "workspace:*", "npm:other@1.0.0", "git+https://h/x", "https://h/x.tgz", "=1.2.1", "1.0.0 - 1.2.0", ">1.2.0 || <1.1.0", "^1.2.0", "~1.3.0")])
    k = F.col("c_custkey")
    rows = _table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("1."), k % 5, F.lit("."), k % 3).alias("version"), forms[(k % 13).cast("int")].alias("range_raw"))
    return rows.withColumn("range_class", semver.classify(F.col("range_raw"))).withColumn("ok", semver.satisfies(F.col("version"), F.col("range_raw")))


# ---- reports -------------------------------------------------------------------


@query(
    with_views(
        ["nodes", "versions", "components", "maintainers"],
        SCORES
        + """, facts AS (SELECT name, count(DISTINCT version) AS version_count, count(DISTINCT publisher) AS publishers, coalesce(bool_or(has_install_hook), false) AS has_install_hook, coalesce(max(provenance), 'UNKNOWN') AS provenance, max_by(version, seq) AS latest_version FROM nodes LEFT JOIN versions ON package = name GROUP BY name),
        rated AS (SELECT f.*, coalesce(score, 0.0) AS consequence, coalesce(fragility, 0.0) AS fragility, (SELECT count(DISTINCT maintainer) FROM maintainers m WHERE m.package = f.name)::INT AS maintainer_count FROM facts f LEFT JOIN scores USING (name))
        SELECT *, CASE WHEN has_install_hook AND provenance <> 'ATTESTED' THEN 'BLOCKED' WHEN (consequence > 80 AND maintainer_count = 1) OR (consequence > 70 AND provenance = 'UNATTESTED') THEN 'WARN' ELSE 'PASS' END AS status FROM rated""",
    )
)
def package_list(spark, sf):
    """Every package with facts, scores, maintainers and policy status."""
    s = _scores(spark, sf)
    return reports.package_list(reports.package_facts(view(spark, sf, "nodes"), view(spark, sf, "versions")), s, s, view(spark, sf, "maintainers"))


@query(
    with_views(
        ["multigraph", "versions", "polls", "components"],
        C.POLLS
        + SCORES
        + f""", target AS ({C.BUSIEST.format(e='multigraph WHERE dst IN (SELECT package FROM versions)')}), walk AS (SELECT dst AS node, 0 AS depth FROM target UNION SELECT e.src, w.depth + 1 FROM walk w JOIN multigraph e ON e.dst = w.node WHERE w.depth < 30), least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
        SELECT dst AS name, (SELECT string_agg(version, ',' ORDER BY published_at DESC, version DESC) FROM versions WHERE package = dst) AS versions, (SELECT string_agg(src, ',' ORDER BY src) FROM multigraph m WHERE m.dst = target.dst) AS dependents,
        coalesce((SELECT string_agg(m.dst, ',' ORDER BY m.dst) FROM multigraph m WHERE m.src = target.dst), '') AS dependencies, (SELECT count(*) FROM found WHERE package = target.dst)::INT AS n_events, (SELECT count(*) FROM least) AS reach, (SELECT max(depth) FROM least) AS max_depth,
        (SELECT fragility FROM scores WHERE name = target.dst) AS fragility, CASE WHEN (SELECT fragility FROM scores WHERE name = target.dst) >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM target WHERE EXISTS (SELECT 1 FROM versions WHERE package = dst)""",
        True,
    )
)
def package_detail(spark, sf):
    """All sections of the package with most direct dependents among those with versions."""
    edges, versions = graph.cut_lineage(view(spark, sf, "multigraph")), view(spark, sf, "versions")
    name = C._busiest(edges.join(versions.select(F.col("package").alias("dst")).distinct(), "dst", "left_semi"))
    reached = graph.blast_radius(edges, name, timeout_s=3600)[0].select(F.lit(name).alias("root"), "node", "depth")
    rated = _scores(spark, sf).select(F.col("name").alias("package"), "fragility", (F.col("fragility") / 100).alias("probability"))
    d = reports.package_detail(name, versions, edges, ingest.maintainer_events(ingest.snapshots(view(spark, sf, "polls"))), reached, rated)
    return d.select("name", F.array_join(F.transform("versions", lambda v: v["version"]), ",").alias("versions"), F.array_join("dependents", ",").alias("dependents"), F.array_join("dependencies", ",").alias("dependencies"), F.size("events").alias("n_events"), "reach", "max_depth", "fragility", F.get_json_object("evidence", "$.confidence").alias("confidence"))


@query(
    with_views(
        ["multigraph", "components"],
        SCORES
        + f""", target AS ({C.BUSIEST.format(e='multigraph')}), walk AS (SELECT dst AS node, 0 AS depth FROM target UNION SELECT e.src, w.depth + 1 FROM walk w JOIN multigraph e ON e.dst = w.node WHERE w.depth < 30), least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
        SELECT dst AS name, (SELECT count(*) FROM least) AS reach, (SELECT max(depth) FROM least) AS max_depth, (SELECT count(*) FROM multigraph m WHERE m.dst = target.dst) AS direct_dependents, coalesce((SELECT score FROM scores WHERE name = target.dst), 0.0) AS consequence FROM target""",
        True,
    )
)
def blast_report(spark, sf):
    edges = graph.cut_lineage(view(spark, sf, "multigraph"))
    return reports.blast_report(edges, _scores(spark, sf), C._busiest(edges))


WALKED = """, walk AS (SELECT dst AS node FROM target UNION SELECT e.src FROM walk w JOIN multigraph e ON e.dst = w.node), hit AS (SELECT name FROM gated WHERE p >= 0.1)"""


@query(with_views(["multigraph"], C.GATED + WALKED + " SELECT node AS name FROM walk WHERE node NOT IN (SELECT name FROM hit)", True))
def pruned_nodes(spark, sf):
    """What a naive radius holds and the range gates rule out."""
    edges = graph.cut_lineage(C._multigraph(spark, sf))
    return graph.pruned(edges, C._busiest(edges), "1.2.5")


@query(
    with_views(
        ["multigraph", "components"],
        C.GATED + WALKED + SCORES + """, kept AS (SELECT name FROM hit WHERE name NOT IN (SELECT name FROM scores WHERE kev_listed)), n AS (SELECT (SELECT count(*) FROM walk) AS naive, (SELECT count(*) FROM hit) AS gated, (SELECT count(*) FROM kept) AS source_gated)
        SELECT naive, gated, round((1 - gated / naive) * 100, 1) AS noise_reduction, source_gated, round((1 - source_gated / naive) * 100, 1) AS source_noise_reduction FROM n""",
        True,
    )
)
def simulation_report(spark, sf):
    """Naive, range-gated and source-gated numbers; listed packages count as not reachable here."""
    edges = graph.cut_lineage(C._multigraph(spark, sf))
    safe = _scores(spark, sf).where("kev_listed").select(F.col("name").alias("package"), F.lit("NOT_REACHABLE").alias("reachability"))
    return api.simulate(edges, C._busiest(edges), "1.2.5", verdicts=safe)


@query(with_views(["components"], "SELECT c_custkey, CASE WHEN fragility >= 70 OR consequence >= 75 THEN 'WARN' ELSE 'PASS' END AS status FROM components"))
def live_status(spark, sf):
    return reports.live_summary(view(spark, sf, "components")).select("c_custkey", "status")


@query(with_views(["components"], "SELECT (SELECT count(*) FROM components) AS components, count(DISTINCT c_custkey) AS blocked, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM components WHERE (has_install_hook AND provenance <> 'ATTESTED') OR (kev_listed AND reachability = 'REACHABLE')"))
def policy_gate(spark, sf):
    return policy.gate_result(policy.violations(view(spark, sf, "components")))


@query("SELECT 24 AS early_warning_hours, 72 AS notification_hours, 14 AS final_report_days, 1 AS sla_rules")
def sla_summary(spark, sf):
    return policy.sla_summary(spark)


TEXT_POLICY = """
rules:
  - {id: fragile, when: "fragility >= 60 and not kev_listed", action: block, message: m, sla_hours: 8}
  - {id: few, when: "maintainer_count in [0, 1] or consequence < -5", action: warn}
  - {id: bad, when: "__import__('os').system('x')", action: block}
"""


@query(with_views(["components"], "SELECT c_custkey, CASE WHEN fragility >= 60 AND NOT kev_listed THEN 'BLOCKED' WHEN maintainer_count IN (0, 1) OR consequence < -5 THEN 'WARN' ELSE 'PASS' END AS status FROM components"))
def policy_of_text(spark, sf):
    """A policy read from YAML; a condition outside the language never fires."""
    return api.check_policy(view(spark, sf, "components"), policy.load_rules(TEXT_POLICY)).select("c_custkey", "status")


@query(
    with_views(
        ["versions"],
        """, g AS (SELECT package, published_at, version, (epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY package ORDER BY published_at))) / 86400000000.0::DOUBLE AS gap FROM versions),
        s AS (SELECT package, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, max_by(gap, (published_at, gap)) FILTER (gap IS NOT NULL) AS last FROM g GROUP BY package)
        SELECT package, CASE WHEN gaps[len(gaps) // 2 + 1] > 0 THEN round(last / greatest(1.0, gaps[len(gaps) // 2 + 1]), 2) ELSE 0.1 END::DOUBLE AS cadence FROM s""",
    )
)
def release_cadence(spark, sf):
    return fragility.cadence_telemetry(view(spark, sf, "versions").select("package", "published_at"))


LIVE = """, seen AS (SELECT package, count(DISTINCT maintainer) AS n FROM maintainers GROUP BY package), agg AS (SELECT package, max(entropy) AS entropy, coalesce(bool_or(has_install_hook), false) AS hook, max(provenance) AS prov FROM versions GROUP BY package),
    facts AS (SELECT nodes.name AS package, substr(name, 5)::BIGINT AS k, coalesce(hook, false) AS hook, coalesce(prov, 'UNKNOWN') AS prov, coalesce(nullif(n, 0), 1) AS n, entropy FROM nodes LEFT JOIN agg ON agg.package = name LEFT JOIN seen ON seen.package = name),
    vec AS (SELECT package, CASE WHEN k % 11 = 0 THEN 'root' WHEN k % 5 = 0 THEN 'telemetry' ELSE 'aggregates' END AS origin,
        CASE WHEN k % 11 = 0 THEN 1.0 WHEN k % 5 = 0 THEN CASE k % 3 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.5 END ELSE CASE n WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.5 END END::DOUBLE AS bus_factor,
        CASE WHEN k % 11 = 0 THEN 0 WHEN hook OR (k % 5 = 0 AND k % 2 = 0) THEN 1 ELSE 0 END::DOUBLE AS new_install_hook, CASE WHEN k % 11 <> 0 AND k % 5 = 0 AND k % 400 > 180 THEN 1 ELSE 0 END::DOUBLE AS churn_after_dormancy,
        CASE WHEN k % 11 = 0 THEN 0 WHEN k % 5 = 0 THEN CASE WHEN prov = 'ATTESTED' OR k % 4 = 0 THEN 0 ELSE 0.5 END WHEN prov = 'UNATTESTED' THEN 0.5 ELSE 0 END::DOUBLE AS provenance_drift,
        CASE WHEN k % 11 = 0 THEN 1 WHEN k % 5 = 0 THEN CASE WHEN prov = 'ATTESTED' OR k % 4 = 0 THEN 1 ELSE 0 END WHEN prov = 'ATTESTED' THEN 1 ELSE 0 END::DOUBLE AS trusted_publishing,
        CASE WHEN k % 11 = 0 THEN 0 WHEN k % 5 = 0 THEN CASE WHEN k % 3 > 1 THEN 0.3 ELSE 0 END WHEN n > 1 THEN 0.3 ELSE 0 END::DOUBLE AS ownership_churn,
        CASE WHEN k % 11 = 0 THEN 0.05 WHEN k % 5 = 0 THEN least(3.0, (k % 9) / 2) ELSE 0.2 END::DOUBLE AS cadence_break, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 5 = 0 AND k % 7 = 0 THEN 0.5 ELSE 0.05 END::DOUBLE AS size_delta,
        CASE WHEN k % 11 <> 0 AND k % 5 <> 0 AND entropy > 7.5 THEN 1.5 ELSE 0 END::DOUBLE AS entropy_spike FROM facts),
    z AS (SELECT package, origin, -3.5 + 3.2 * churn_after_dormancy + 2.8 * new_install_hook + 2.2 * provenance_drift + 1.5 * ownership_churn + 1.2 * cadence_break + 1.2 * size_delta + 1.5 * entropy_spike + bus_factor + trusted_publishing
        + 3.5 * ownership_churn * churn_after_dormancy + 2.0 * entropy_spike * size_delta + 2.5 * provenance_drift * ownership_churn AS z FROM vec)"""


@query(with_views(["nodes", "versions", "maintainers"], LIVE + " SELECT package, origin, round(z, 6) AS z, round(100 / (1 + exp(-z)), 2) AS fragility FROM z"))
def live_fragility(spark, sf):
    """Ratings from live facts: incidents, the project's root, registry telemetry, then what is stored."""
    v = view(spark, sf, "versions").groupBy("package").agg(F.max("entropy").alias("entropy"), F.max("has_install_hook").alias("has_install_hook"), F.max("provenance").alias("provenance"))
    nodes = view(spark, sf, "nodes").select(F.col("name").alias("package"))
    k = F.substring("package", 5, 20).cast("long")
    telemetry = nodes.where(k % 5 == 0).select("package", (k % 3).alias("maintainer_count"), (k % 2 == 0).alias("has_install_hook"), (k % 4 == 0).alias("attested"), (k % 400).alias("days_dormant"), ((k % 9) / 2).alias("cadence"), F.when(k % 7 == 0, 9_000_000).otherwise(10).alias("unpacked_size"))
    bus = view(spark, sf, "maintainers").groupBy("package").agg(F.count_distinct("maintainer").alias("maintainer_count"))
    stored = v.select("package", "entropy").join(bus, "package", "full_outer").select("package", "maintainer_count", F.lit(0.0).alias("max_gap_seconds"), F.lit(0.0).alias("repo_drift"), "entropy")
    facts = nodes.join(v.select("package", "has_install_hook", "provenance"), "package", "left")
    out = fragility.live_vector(facts, corpus.incidents(spark), nodes.where(k % 11 == 0), telemetry, stored)
    return fragility.predict_live(out).select("package", "origin", F.round("z", 6).alias("z"), "fragility")


@query("SELECT 4::BIGINT AS tp, 1::BIGINT AS fp, 2::BIGINT AS tn, 1::BIGINT AS fn, 0.8::DOUBLE AS precision, 0.8::DOUBLE AS recall")
def backtest_with_more(spark, sf):
    """The corpus with two further incidents: a quiet malicious release and a loud harmless one."""
    extra = spark.createDataFrame([("quiet", True, {"bus_factor": 4.0}), ("loud", False, {"new_install_hook": 1.0, "repo_drift": 10.0})], "incident_id string, is_malicious boolean, features map<string,double>")
    return api.backtest(spark, extra=extra)


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 WHEN 2 THEN 2 + 3.0 * (o_orderkey % 3) WHEN 3 THEN 4 + 2.0 * least(3, o_orderkey % 5) WHEN 4 THEN 8 + 2.0 * least(3, o_orderkey % 5) WHEN 5 THEN 12.0 ELSE 2.0 END::DOUBLE AS cost FROM orders")
def intervention_costs(spark, sf):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(a) for a in ("PIN", "OVERRIDE", "UPGRADE", "REMOVE", "SWAP", "VENDOR", "OTHER")])
    return _table(spark, sf, "orders").select("o_orderkey", intervention_cost(names[(k % 7).cast("int")], k % 3, k % 5).alias("cost"))


# ---- epochs and streams ----------------------------------------------------------


@query(
    with_views(
        ["cyclic", "nodes"],
        C.SCC
        + """, half AS (SELECT * FROM cyclic WHERE length(src) % 2 = 0) SELECT 'e1' AS epoch_id, (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM cyclic) AS num_edges, (SELECT count(DISTINCT least(scc, name)) FROM scc) AS num_scc_components, (SELECT count(*) FROM cyclic) AS readable, true AS active_is_last, true AS unpromoted_hidden""",
        True,
    )
)
def graph_epochs(spark, sf):
    """Three epochs are built and two promoted: all facts of the first, read after the second is active."""
    edges, nodes, path = graph.cut_lineage(view(spark, sf, "cyclic")), view(spark, sf, "nodes"), _folder(spark, "epochs")
    half, quarter = edges.where("length(src) % 2 = 0"), edges.where("length(src) % 2 = 1 AND false")
    first = epochs.build(edges, nodes, path, "e1")
    epochs.promote(spark, path, "e1")
    epochs.build(half, nodes, path, "e2")
    epochs.promote(spark, path, "e2")
    epochs.build(quarter, nodes, path, "e3")
    try:
        epochs.get(spark, path, "e3")
        hidden = False
    except KeyError:
        hidden = True
    last = epochs.active(spark, path).count() == half.count()
    old = epochs.get(spark, path, "e1").agg(F.count("*").alias("readable"))
    return first.drop("built_at").join(old).select("*", F.lit(last).alias("active_is_last"), F.lit(hidden).alias("unpromoted_hidden"))


@query("SELECT user_id, event_id, event_type = 'error' AND count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) <= 10 AS alert FROM events")
def running_alerts(spark, sf):
    """The alert gate as a stateful stream over the events, read back."""
    schema = _table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").selectExpr("cast(user_id AS string) AS tenant", "event_id AS arrival", "event_type = 'error' AS eligible")
    out, mark = _folder(spark, "alerts"), _folder(spark, "alerts-checkpoint")
    feed.running_alerts(rows, 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("tenant").cast("long").alias("user_id"), F.col("arrival").alias("event_id"), "alert")


@query("SELECT 'pkg-' || user_id::VARCHAR AS id, max(event_id) AS number, max_by(CASE WHEN event_type = 'error' THEN 'marked_unpublished' ELSE 'hydrated' END, event_id) AS status, count(*) AS kept, (SELECT max(event_id) FROM events) AS last_seq FROM events GROUP BY user_id")
def feed_of_files(spark, sf):
    """A change feed of JSON files in two deliveries that overlap; each event is kept once."""
    land, out, mark = _folder(spark, "land"), _folder(spark, "feed"), _folder(spark, "feed-checkpoint")
    changes = _table(spark, sf, "events").selectExpr("cast(event_id AS string) AS seq", "'pkg-' || cast(user_id AS string) AS id", "event_type = 'error' AS deleted", "event_id")
    for part in ("event_id % 3 <> 0", "event_id % 3 <> 1"):
        changes.where(part).drop("event_id").write.mode("append").json(land)
        feed.follow(feed.read_feed(spark, land), out, mark, lambda df: None)
    rows = spark.read.parquet(out)
    return feed.last_write_wins(rows).join(rows.groupBy("id").agg(F.count("*").alias("kept")), "id").join(feed.offset(spark, out))


@query(with_views(["multigraph"], "SELECT dst AS name, true AS within FROM multigraph GROUP BY dst"))
def sketch_union(spark, sf):
    """Sketches of direct dependents by package, in two halves that are merged; each estimate within a tenth, or two, of the truth."""
    edges = view(spark, sf, "multigraph").select("src", "dst")
    nodes = edges.select(F.col("dst").alias("name")).distinct()
    halves = [graph.reach_sketches(edges.where(F.pmod(F.xxhash64("src"), F.lit(2)) == h), nodes) for h in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("name").agg(F.hll_union_agg("sketch").alias("sketch"))
    # A package without dependents in a half has a sketch of itself; those outside ``nodes`` have none to compare with.
    truth = edges.select(F.col("dst").alias("name"), F.col("src").alias("m")).union(nodes.select("name", "name")).groupBy("name").agg(F.count_distinct("m").alias("n"))
    return merged.join(truth, "name").select("name", (F.abs(F.hll_sketch_estimate("sketch") - F.col("n")) <= F.greatest(F.lit(2.0), 0.1 * F.col("n"))).alias("within"))
