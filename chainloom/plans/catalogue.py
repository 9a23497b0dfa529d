"""All registered queries of the risk engine and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semver
from ..functions import text as X
from ..operators import consequence, customer, fragility, graph, ingest, policy, reachability, reports
from ..session import shared_folder
from ..sources import corpus, lockfiles
from . import documents as D
from .adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# ---- graph -----------------------------------------------------------------

#: Classes of the ranges that the adapters use.
FORMS = """CASE WHEN range_raw LIKE '^%' THEN 'CARET' WHEN range_raw LIKE '~%' THEN 'TILDE' WHEN range_raw = '*' THEN 'WILDCARD' WHEN range_raw LIKE 'git%' THEN 'GIT' WHEN range_raw = '1.2.3' THEN 'EXACT' ELSE 'RANGE' END"""


def _multigraph(spark, sf):
    return view(spark, sf, "multigraph").withColumn("range_class", semver.classify(F.col("range_raw")))


def _busiest(edges: DataFrame) -> str:
    """The package with most direct dependents, the first by name among equals."""
    row = edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return row["dst"] if row else ""


BUSIEST = "SELECT dst FROM {e} GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1"


@query(with_views(["multigraph"], "SELECT src, dst, range_raw, count(*) AS n FROM multigraph GROUP BY ALL"))
def edge_projection(spark, sf):
    deps = view(spark, sf, "dependencies").withColumn("range_class", semver.classify(F.col("range_raw")))
    part = spark.read.parquet(f"{sf}/part.parquet")
    versions = part.select(F.col("p_partkey").alias("version_id"), F.col("p_partkey").alias("package_id"))
    packages = part.select(F.col("p_partkey").alias("package_id"), F.concat(F.lit("pkg-"), F.col("p_partkey").cast("string")).alias("name"))
    return graph.project_edges(deps, versions, packages).groupBy("src", "dst", "range_raw").agg(F.count("*").alias("n"))


@query(with_views(["multigraph", "nodes"], "SELECT n.name, (SELECT count(*) FROM multigraph m WHERE m.dst = n.name) AS in_degree, (SELECT count(*) FROM multigraph m WHERE m.src = n.name) AS out_degree FROM nodes n"))
def degree_counts(spark, sf):
    return graph.degrees(_multigraph(spark, sf), view(spark, sf, "nodes"))


@query(with_views(["multigraph"], f"SELECT src AS name FROM multigraph WHERE dst = ({BUSIEST.format(e='multigraph')})"))
def direct_dependents(spark, sf):
    edges = _multigraph(spark, sf)
    return graph.direct_dependents(edges, _busiest(edges))


@query(with_views(["multigraph"], "SELECT dst AS name FROM multigraph WHERE src = (SELECT src FROM multigraph GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"))
def direct_dependencies(spark, sf):
    edges = _multigraph(spark, sf)
    row = edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return graph.direct_dependencies(edges, row["src"] if row else "")


CLOSURE = """, walk AS (SELECT name AS root, name AS node, 0 AS depth FROM nodes
    UNION SELECT w.root, e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < 30),
    closure AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)"""


@query(with_views(["edges", "nodes"], CLOSURE + " SELECT root, node, depth FROM closure", True))
def blast_radius_all(spark, sf):
    return graph.closure(view(spark, sf, "edges"), view(spark, sf, "nodes")).select("root", "node", "depth")


@query(
    with_views(
        ["cyclic"],
        f""", walk AS (SELECT dst AS node, 0 AS depth FROM ({BUSIEST.format(e='cyclic')}) UNION SELECT e.src, w.depth + 1 FROM walk w JOIN cyclic e ON e.dst = w.node WHERE w.depth < 31),
        least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
        SELECT node, depth, (SELECT max(depth) FROM least) > 30 AS truncated FROM least WHERE depth <= 30""",
        True,
    )
)
def blast_radius_single(spark, sf):
    edges = graph.cut_lineage(view(spark, sf, "cyclic"))
    rows, truncated = graph.blast_radius(edges, _busiest(edges), timeout_s=3600)
    return rows.select("node", "depth", F.lit(truncated).alias("truncated"))


REACH = CLOSURE + """, summary AS (SELECT root AS name, count(*) AS reach, avg(depth) AS mean_depth, max(depth) AS max_depth, sum(1000 * power(0.8::DOUBLE, depth)) AS weighted_downloads FROM closure GROUP BY root)"""


@query(with_views(["edges", "nodes"], REACH + " SELECT name, reach, round(mean_depth, 6) AS mean_depth, max_depth, round(weighted_downloads, 4) AS weighted_downloads FROM summary", True))
def reach_summary(spark, sf):
    out = graph.reach(view(spark, sf, "edges"), view(spark, sf, "nodes"))
    return out.select("name", "reach", F.round("mean_depth", 6).alias("mean_depth"), "max_depth", F.round("weighted_downloads", 4).alias("weighted_downloads"))


SCC = """, reach AS (SELECT src AS a, dst AS b FROM cyclic UNION SELECT r.a, e.dst FROM reach r JOIN cyclic e ON e.src = r.b),
    scc AS (SELECT n.name, coalesce(min(m.b), n.name) AS scc FROM nodes n LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) m ON m.a = n.name GROUP BY n.name)"""


@query(with_views(["cyclic", "nodes"], SCC + " SELECT name, least(scc, name) AS scc FROM scc", True))
def scc_components(spark, sf):
    return graph.components(view(spark, sf, "cyclic"), view(spark, sf, "nodes"))


@query(with_views(["cyclic", "nodes"], SCC + " SELECT DISTINCT least(a.scc, a.name) AS src, least(b.scc, b.name) AS dst FROM cyclic e JOIN scc a ON a.name = e.src JOIN scc b ON b.name = e.dst WHERE least(a.scc, a.name) <> least(b.scc, b.name)", True))
def condensed_dag(spark, sf):
    edges = view(spark, sf, "cyclic")
    return graph.condensed(edges, graph.components(edges, view(spark, sf, "nodes")))


PIVOTS = "pv AS (SELECT name FROM nodes ORDER BY md5(name), name LIMIT 100),"


def _between_sql(pivots: bool) -> str:
    """Betweenness over the paths from a hundred pivots, or over all shortest paths."""
    return f""", size AS (SELECT count(*) AS n FROM nodes), {PIVOTS if pivots else ""}
    paths AS (SELECT src AS s, dst AS t, 1 AS len FROM edges UNION ALL SELECT p.s, e.dst, p.len + 1 FROM paths p JOIN edges e ON e.src = p.t),
    lens AS (SELECT s, t, len, count(*)::DOUBLE AS c FROM paths GROUP BY ALL),
    best AS (SELECT s, t, min(len) AS d, arg_min(c, len) AS c FROM lens GROUP BY s, t),
    share AS (SELECT a.t AS name, sum(a.c * b.c / x.c) AS share FROM best a {"JOIN pv ON pv.name = a.s " if pivots else ""}JOIN best b ON b.s = a.t JOIN best x ON x.s = a.s AND x.t = b.t
        WHERE a.d + b.d = x.d AND a.s <> b.t GROUP BY a.t),
    between_ AS (SELECT nodes.name, coalesce(share, 0){" * (n / least(100, n))" if pivots else ""} / greatest(1, (n - 1) * (n - 2)) AS betweenness FROM nodes LEFT JOIN share USING (name), size)"""


BETWEEN = _between_sql(True)


@query(with_views(["edges", "nodes"], BETWEEN + " SELECT name, round(betweenness, 10) AS betweenness FROM between_", True))
def betweenness_pivots(spark, sf):
    return graph.betweenness(view(spark, sf, "edges"), view(spark, sf, "nodes")).select("name", F.round("betweenness", 10).alias("betweenness"))


# ---- consequence -----------------------------------------------------------

RATING = """, inputs AS (SELECT name, reach, mean_depth, weighted_downloads, betweenness, has_install_hook, (SELECT count(*) FROM edges e WHERE e.src = s.name) AS out_degree
        FROM summary s JOIN between_ USING (name) JOIN hooks USING (name)),
    raws AS (SELECT *, 2.0::DOUBLE * log10(1 + reach) + 1.5::DOUBLE * log10(1 + weighted_downloads) + 3.0::DOUBLE * betweenness + mean_depth
        + 1.5::DOUBLE * CASE WHEN has_install_hook THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END + 1.2::DOUBLE * log10(1 + reach / greatest(1, out_degree)) AS raw FROM inputs),
    rated AS (SELECT *, CASE WHEN max(raw) OVER () > min(raw) OVER () THEN round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) * 100, 1) ELSE 50.0 END AS score FROM raws)"""
RATED = REACH + BETWEEN + RATING
RATED_VIEWS = ["edges", "nodes", "hooks"]


def _rated(spark, sf, k: int | None = 100):
    return consequence.scores(consequence.metrics(view(spark, sf, "edges"), view(spark, sf, "nodes"), view(spark, sf, "hooks"), k=k))


@query(with_views(RATED_VIEWS, RATED + " SELECT name, round(raw, 6) AS raw, score FROM rated", True))
def consequence_score(spark, sf):
    return _rated(spark, sf).select("name", F.round("raw", 6).alias("raw"), "score")


@query(with_views(RATED_VIEWS, REACH + _between_sql(False) + RATING + " SELECT name, round(raw, 4) AS raw, reach, round(mean_depth, 2) AS mean_depth, round(betweenness, 4) AS betweenness, has_install_hook, round(reach / greatest(1, out_degree), 2) AS asymmetry, out_degree, score FROM rated", True))
def consequence_detail(spark, sf):
    return consequence.details(_rated(spark, sf, k=None))


@query(
    with_views(
        RATED_VIEWS,
        RATED
        + """, placed AS (SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS rank, count(*) OVER () AS total FROM rated)
        SELECT name, score, rank, CASE WHEN (rank - 1) / total <= 0.10 THEN 0 WHEN (rank - 1) / total <= 0.30 THEN 1 WHEN (rank - 1) / total <= 0.60 THEN 2 ELSE 3 END AS tier FROM placed""",
        True,
    )
)
def poll_tiers(spark, sf):
    return consequence.poll_tiers(_rated(spark, sf))


@query(
    with_views(
        [*RATED_VIEWS, "versions"],
        RATED
        + """, top AS (SELECT name, score, row_number() OVER (ORDER BY score DESC, name) AS rank FROM rated ORDER BY score DESC, name LIMIT 10)
        SELECT rank, name, score, (SELECT count(*) FROM versions v WHERE v.package = top.name) AS version_count, coalesce((SELECT bool_or(has_install_hook) FROM versions v WHERE v.package = top.name), false) AS has_install_hook,
        CASE WHEN length(name) % 2 = 0 THEN 'https://github.com/sponsors/own-' || name ELSE 'https://opencollective.com/' || name END AS sponsor_url FROM top""",
        True,
    )
)
def watch_index_top10(spark, sf):
    packages = view(spark, sf, "nodes").select("name", F.when(F.length("name") % 2 == 0, F.concat(F.lit("own-"), F.col("name"))).alias("repo_owner"))
    return consequence.watch_index(_rated(spark, sf), packages, view(spark, sf, "versions").withColumnRenamed("package", "name"), 10)


# ---- versions --------------------------------------------------------------

_RE = r"'^[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$'"


def _parts(c: str, p: str) -> str:
    number = lambda i: f"coalesce(try_cast(nullif(regexp_extract({c}, {_RE}, {i}), '') AS BIGINT), 0) AS {p}{i}"
    return f"{number(1)}, {number(2)}, {number(3)}, nullif(regexp_extract({c}, {_RE}, 4), '') AS {p}4, regexp_matches({c}, {_RE}) AS {p}ok"


CLASS = """CASE WHEN range_raw LIKE '^%' THEN 'CARET' WHEN range_raw LIKE '~%' THEN 'TILDE' WHEN range_raw LIKE '>%' OR range_raw LIKE '<%' THEN 'RANGE' ELSE 'EXACT' END"""


@query(with_views(["ranges"], f", p AS (SELECT DISTINCT version, {_parts('version', 'a')} FROM ranges) SELECT version, a1 AS major, a2 AS minor, a3 AS patch, a4 AS prerelease FROM p"))
def semver_parse(spark, sf):
    return view(spark, sf, "ranges").select("version").distinct().withColumn("v", semver.parse(F.col("version"))).select("version", "v.major", "v.minor", "v.patch", "v.prerelease")


@query(with_views(["ranges"], f", p AS (SELECT DISTINCT version, {_parts('version', 'a')} FROM ranges) SELECT version, row_number() OVER (ORDER BY a1, a2, a3, CASE WHEN a4 IS NULL THEN 1 ELSE 0 END, a4) AS place FROM p"))
def semver_sort(spark, sf):
    keyed = view(spark, sf, "ranges").select("version").distinct().withColumn("key", semver.sort_key(F.col("version")))
    return consequence.ranked(keyed, "version", F.asc("key"), name="place").select("version", F.col("place").cast("long").alias("place"))


@query(with_views(["ranges"], f"SELECT DISTINCT range_raw, {CLASS} AS range_class FROM ranges"))
def range_classify(spark, sf):
    return view(spark, sf, "ranges").select("range_raw").distinct().withColumn("range_class", semver.classify(F.col("range_raw")))


_TARGET = "regexp_replace(range_raw, '^(>=|<=|[~^=<>])', '')"
SATISFIES = f""", p AS (SELECT version, range_raw, {CLASS} AS k, {_parts('version', 'a')}, {_parts(_TARGET, 'b')} FROM ranges),
    m AS (SELECT *, (a1, a2, a3) < (b1, b2, b3) AS lt, (a1, a2, a3) = (b1, b2, b3) AS eq, a4 IS NOT NULL AND b4 IS NULL AS pre FROM p),
    s AS (SELECT version, range_raw, k, aok AND CASE k
        WHEN 'EXACT' THEN eq AND a4 IS NOT DISTINCT FROM b4
        WHEN 'CARET' THEN NOT pre AND NOT lt AND CASE WHEN b1 > 0 THEN a1 = b1 WHEN b2 > 0 THEN a1 = 0 AND a2 = b2 ELSE a1 = 0 AND a2 = 0 AND a3 = b3 END
        WHEN 'TILDE' THEN NOT pre AND NOT lt AND a1 = b1 AND a2 = b2
        ELSE CASE WHEN range_raw LIKE '>=%' THEN NOT lt WHEN range_raw LIKE '>%' THEN NOT lt AND NOT eq WHEN range_raw LIKE '<=%' THEN lt OR eq ELSE lt END END AS ok FROM m)"""


@query(with_views(["ranges"], SATISFIES + " SELECT version, range_raw, ok FROM s"))
def semver_satisfies(spark, sf):
    return view(spark, sf, "ranges").withColumn("ok", semver.satisfies(F.col("version"), F.col("range_raw")))


@query(with_views(["ranges"], SATISFIES + " SELECT version, range_raw, CASE WHEN k = 'EXACT' THEN 0.0 WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS p FROM s"))
def propagation(spark, sf):
    return view(spark, sf, "ranges").withColumn("p", semver.propagation(F.col("range_raw"), semver.classify(F.col("range_raw")), F.col("version")))


GATED = f""", target AS ({BUSIEST.format(e='multigraph')}),
    hop1 AS (SELECT src AS name, max(CASE WHEN range_raw IN ('^1.2.0', '~1.2.0', '*', '>=1.0.0 <2.0.0', '1.x') THEN 0.6::DOUBLE ELSE 0 END) AS p FROM multigraph WHERE dst = (SELECT dst FROM target) GROUP BY src),
    one AS (SELECT dst AS name, 1.0::DOUBLE AS p FROM target UNION ALL SELECT name, p FROM hop1 WHERE p > 0),
    gated AS (SELECT * FROM one UNION ALL SELECT m.src, max(0.8::DOUBLE * h.p) FROM multigraph m JOIN hop1 h ON h.name = m.dst AND h.p > 0 WHERE m.src NOT IN (SELECT name FROM one) GROUP BY m.src)"""


@query(with_views(["multigraph"], GATED + " SELECT name, round(p, 6) AS probability FROM gated"))
def gated_reach(spark, sf):
    edges = graph.cut_lineage(_multigraph(spark, sf))
    return graph.gated_reach(edges, _busiest(edges), "1.2.5", 0.6).select("name", F.round("probability", 6).alias("probability"))


@query(
    with_views(
        ["multigraph"],
        GATED
        + """, walk AS (SELECT dst AS node FROM target UNION SELECT e.src FROM walk w JOIN multigraph e ON e.dst = w.node)
        SELECT (SELECT count(*) FROM walk) AS naive, (SELECT count(*) FROM gated WHERE p >= 0.1) AS gated, round((1 - (SELECT count(*) FROM gated WHERE p >= 0.1) / (SELECT count(*) FROM walk)) * 100, 1) AS noise_reduction""",
        True,
    )
)
def simulation_summary(spark, sf):
    edges = graph.cut_lineage(_multigraph(spark, sf))
    return graph.simulate(edges, _busiest(edges), "1.2.5")


@query("SELECT true AS within")
def reach_sketch_estimate(spark, sf):
    """Whether the merged sketch of all nodes is within a tenth of the truth."""
    edges, nodes = view(spark, sf, "edges"), view(spark, sf, "nodes")
    truth = graph.nodes_of(edges, nodes).agg(F.count("*").alias("n"))
    return graph.merged_estimate(graph.reach_sketches(edges, nodes)).join(truth).select((F.abs(F.col("estimate") - F.col("n")) <= 0.1 * F.col("n")).alias("within"))


# ---- ingestion -------------------------------------------------------------


@query("SELECT sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS size_bytes FROM pages GROUP BY html")
def blob_dedup(spark, sf):
    raw = spark.read.parquet(f"{sf}/pages.parquet").select(F.encode("html", "UTF-8").alias("content"))
    blobs = raw.select(F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"))
    return ingest.insert_new(blobs.where("false"), blobs, ["sha256"])


@query(with_views(["mails"], "SELECT c_custkey, sha256(lower(trim(email))) AS email_hash, CASE WHEN contains(email, '@') THEN split_part(lower(trim(email)), '@', 2) ELSE '' END AS email_domain FROM mails"))
def hash_email(spark, sf):
    return view(spark, sf, "mails").select("c_custkey", X.email_hash(F.col("email")).alias("email_hash"), X.email_domain(F.col("email")).alias("email_domain"))


@query(with_views(["versions"], "SELECT package, arg_min(version, seq) AS name, arg_max(size, seq) AS poll_tier, arg_max(publisher, seq) FILTER (publisher IS NOT NULL) AS repo_owner, max(seq) AS seq FROM versions GROUP BY package"))
def package_upsert(spark, sf):
    writes = view(spark, sf, "versions").select("package", F.col("version").alias("name"), F.col("size").alias("poll_tier"), F.col("publisher").alias("repo_owner"), "seq")
    return ingest.upsert(writes, ["package"], ingest.PACKAGE_POLICY)


@query(with_views(["versions"], "SELECT package, provenance, min_by(published_at, seq) AS published_at, max_by(size, seq) AS unpacked_size, max_by(has_install_hook, seq) AS has_install_hook, max(seq) AS seq FROM versions GROUP BY package, provenance"))
def version_upsert(spark, sf):
    writes = view(spark, sf, "versions").select("package", "provenance", "published_at", F.col("size").alias("unpacked_size"), "has_install_hook", "seq")
    return ingest.upsert(writes, ["package", "provenance"], {k: v for k, v in ingest.VERSION_POLICY.items() if k != "provenance"})


@query(
    with_views(
        ["multigraph"],
        "SELECT src, dst, max(range_raw) AS range_raw FROM multigraph GROUP BY src, dst",
    )
)
def edge_upsert(spark, sf):
    writes = _multigraph(spark, sf).select("src", "dst", "range_raw", F.col("range_raw").alias("seq"))
    return ingest.upsert(writes, ["src", "dst"], {"range_raw": "last"}).select("src", "dst", "range_raw")


POLLS = """, polls_n AS (SELECT package, observed_at, row_number() OVER (PARTITION BY package ORDER BY observed_at) AS i, count(*) AS n FROM polls GROUP BY package, observed_at),
    members AS (SELECT p.package, p.observed_at, p.handle, q.i, q.n FROM polls p JOIN polls_n q USING (package, observed_at)),
    gaps AS (SELECT b.package, b.observed_at, b.i, b.n, a.n AS before_n, CASE WHEN a.i IS NOT NULL THEN epoch(b.observed_at) - epoch(a.observed_at) END::DOUBLE AS gap FROM polls_n b LEFT JOIN polls_n a ON a.package = b.package AND a.i = b.i - 1),
    found AS (SELECT g.package, g.observed_at, 'ADDED' AS event_type, m.handle, g.gap FROM members m JOIN gaps g USING (package, i) WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.package = m.package AND o.i = m.i - 1 AND o.handle = m.handle)
      UNION ALL SELECT g.package, g.observed_at, 'REMOVED', m.handle, g.gap FROM members m JOIN gaps g ON g.package = m.package AND g.i = m.i + 1 WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.package = m.package AND o.i = m.i + 1 AND o.handle = m.handle)
      UNION ALL SELECT g.package, g.observed_at, CASE WHEN g.n = 1 THEN 'SOLE_OWNER_BEGIN' ELSE 'SOLE_OWNER_END' END, min(m.handle), min(g.gap) FROM gaps g JOIN members m USING (package, i) WHERE (g.before_n > 1 AND g.n = 1) OR (g.before_n = 1 AND g.n > 1) GROUP BY g.package, g.observed_at, g.n)"""


@query(with_views(["polls"], POLLS + " SELECT package, observed_at, event_type, handle, gap AS observation_gap_seconds FROM found"))
def maintainer_events(spark, sf):
    return ingest.maintainer_events(ingest.snapshots(view(spark, sf, "polls")))


@query(with_views(["polls"], POLLS + ", last AS (SELECT package, max(i) AS i FROM polls_n GROUP BY package) SELECT m.package, m.handle, (SELECT max(f.observed_at) FROM found f WHERE f.package = m.package AND f.handle = m.handle AND f.event_type = 'ADDED') AS since FROM members m JOIN last USING (package, i)"))
def current_maintainers(spark, sf):
    return ingest.current_maintainers(ingest.snapshots(view(spark, sf, "polls")))


@query(with_views(["versions"], "SELECT package, publisher, min(published_at) AS published_at FROM versions WHERE publisher IS NOT NULL GROUP BY package, publisher HAVING count(*) = 1"))
def first_publishes(spark, sf):
    return ingest.first_publishes(view(spark, sf, "versions"))


@query(
    with_views(
        ["versions"],
        """, stored AS (SELECT package, version FROM versions WHERE seq % 3 <> 0) SELECT package, string_agg(version, ',' ORDER BY version) AS missed, count(*) AS missed_count FROM versions v
        WHERE package IN (SELECT package FROM stored) AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.package = v.package AND s.version = v.version) GROUP BY package""",
    )
)
def reconcile_gaps(spark, sf):
    registry = view(spark, sf, "versions")
    return ingest.reconcile(registry, registry.where("seq % 3 <> 0")).select("package", F.array_join("missed", ",").alias("missed"), "missed_count")


# ---- fragility -------------------------------------------------------------


def _signals_sql(condition: str) -> str:
    return f""", v AS (SELECT package, version, published_at, publisher, size, has_install_hook, CASE WHEN entropy = 0 THEN 4.5 ELSE entropy END AS entropy, provenance FROM versions),
    h AS (SELECT v.package, v.version, o.version AS ov, o.published_at AS op, o.publisher AS opub, o.size AS osize, o.has_install_hook AS ohook, o.provenance AS oprov,
        row_number() OVER (PARTITION BY v.package, v.version ORDER BY o.published_at DESC, o.version DESC) AS rn,
        (epoch_us(o.published_at) - epoch_us(lag(o.published_at) OVER (PARTITION BY v.package, v.version ORDER BY o.published_at, o.version))) / 86400000000.0::DOUBLE AS gap
        FROM v JOIN v o ON o.package = v.package AND {condition}),
    herf AS (SELECT package, version, sum(c * c) AS hh FROM (SELECT package, version, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY package, version) AS c FROM h WHERE rn <= 20 AND opub IS NOT NULL GROUP BY package, version, opub) GROUP BY package, version),
    agg AS (SELECT package, version, count(*) AS n, max(op) FILTER (rn = 1) AS last_at, max(osize) FILTER (rn = 1) AS last_size, bool_or(ohook) FILTER (rn = 1) AS last_hook,
        coalesce(bool_or(oprov = 'ATTESTED') FILTER (rn <= 5), false) AS was_attested, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, list(DISTINCT opub) FILTER (opub IS NOT NULL) AS pubs FROM h GROUP BY package, version),
    bus AS (SELECT package, count(DISTINCT maintainer)::DOUBLE AS b FROM maintainers GROUP BY package), ch AS (SELECT package, max(CASE WHEN event_type = 'ADDED' THEN 1.0 ELSE 0.0 END)::DOUBLE AS c FROM churn GROUP BY package),
    breadth AS (SELECT publisher, count(DISTINCT package)::DOUBLE AS w FROM v WHERE publisher IS NOT NULL GROUP BY publisher),
    j AS (SELECT v.*, coalesce(n, 0) AS n, last_at, last_size, coalesce(last_hook, false) AS last_hook, coalesce(was_attested, false) AS was_attested, gaps, coalesce(pubs, []) AS pubs, coalesce(hh, 0) AS hh, coalesce(b, 1) AS b, coalesce(c, 0) AS churn, w,
        CASE WHEN n > 0 THEN greatest(0, (epoch_us(published_at) - epoch_us(last_at)) / 86400000000.0::DOUBLE) ELSE 0 END AS dormant, CASE WHEN n >= 3 THEN gaps[len(gaps) // 2 + 1] END AS cadence
        FROM v LEFT JOIN agg USING (package, version) LEFT JOIN herf USING (package, version) LEFT JOIN bus USING (package) LEFT JOIN ch USING (package) LEFT JOIN breadth USING (publisher)),
    sig AS (SELECT package, version, b::DOUBLE AS bus_factor, hh AS publish_concentration, churn::DOUBLE AS ownership_churn, CASE WHEN churn > 0 AND dormant >= 180 THEN 1.0 ELSE 0.0 END::DOUBLE AS churn_after_dormancy,
        CASE WHEN publisher IS NOT NULL AND NOT list_contains(pubs, publisher) THEN 1.0 ELSE 0.0 END::DOUBLE AS first_publish_by_new_owner, CASE WHEN publisher IS NOT NULL THEN w ELSE 1.0 END::DOUBLE AS publisher_portfolio_breadth,
        dormant::DOUBLE AS days_dormant, CASE WHEN cadence > 0 THEN abs(dormant - cadence) / greatest(1.0, cadence) ELSE 0 END::DOUBLE AS cadence_break, CASE WHEN dormant < 0.01 AND n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS rapid_republish,
        CASE WHEN n > 0 THEN greatest(0, (coalesce(size, 0) - coalesce(nullif(last_size, 0), 1)) / greatest(1.0, coalesce(nullif(last_size, 0), 1))) ELSE 0 END::DOUBLE AS size_delta,
        CASE WHEN has_install_hook AND NOT last_hook THEN 1.0 ELSE 0.0 END::DOUBLE AS new_install_hook, greatest(0, entropy - 6.5)::DOUBLE AS entropy_spike, 0.0::DOUBLE AS repo_drift,
        CASE WHEN provenance = 'UNATTESTED' AND was_attested THEN 1.0 ELSE 0.0 END::DOUBLE AS provenance_drift, CASE WHEN provenance = 'ATTESTED' THEN 1.0 ELSE 0.0 END::DOUBLE AS trusted_publishing FROM j)"""


ROUNDED = ("publish_concentration", "days_dormant", "cadence_break", "size_delta", "entropy_spike")
SIG_VIEWS = ["versions", "maintainers", "churn"]
SIG_COLS = ", ".join(f"round({s}, 6) AS {s}" if s in ROUNDED else s for s in fragility.SIGNALS)
COMPAT, POINT = "o.version <> v.version", "(o.published_at < v.published_at OR (o.published_at = v.published_at AND o.version < v.version))"


def _signals(spark, sf, mode="compat"):
    return fragility.signals(*(view(spark, sf, n) for n in SIG_VIEWS), mode=mode)


def _round(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(with_views(SIG_VIEWS, _signals_sql(COMPAT) + f" SELECT package, version, {SIG_COLS} FROM sig"))
def signals_compat(spark, sf):
    return _round(_signals(spark, sf), ROUNDED)


@query(with_views(SIG_VIEWS, _signals_sql(POINT) + f" SELECT package, version, {SIG_COLS} FROM sig"))
def signals_point_in_time(spark, sf):
    return _round(_signals(spark, sf, "point_in_time"), ROUNDED)


CONTINUOUS = ("days_dormant", "cadence_break", "size_delta", "entropy_spike", "publisher_portfolio_breadth", "publish_concentration")
LONG = ", long AS (" + " UNION ALL ".join(f"SELECT package, '{s}' AS signal, {s} AS value FROM sig" for s in CONTINUOUS) + ")"
MAD = LONG + ", med AS (SELECT package, signal, median(value) AS median, count(*) AS n FROM long GROUP BY ALL), base AS (SELECT l.package, l.signal, m.median, greatest(median(abs(l.value - m.median)), 1e-4) AS mad, m.n FROM long l JOIN med m USING (package, signal) GROUP BY l.package, l.signal, m.median, m.n)"


def _long(sig):
    return sig.select("package", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in CONTINUOUS])).alias("x")).select("package", "x.signal", "x.value")


@query(with_views(SIG_VIEWS, _signals_sql(COMPAT) + MAD + " SELECT package, signal, round(median, 6) AS median, round(mad, 6) AS mad, n FROM base"))
def mad_baseline(spark, sf):
    return _round(fragility.mad_baseline(_long(_signals(spark, sf)), "package", "signal"), ("median", "mad"))


def _normal_sql(deep: bool) -> str:
    out = []
    for s in fragility.SIGNALS:
        if s in ("ownership_churn", "churn_after_dormancy", "first_publish_by_new_owner", "new_install_hook", "rapid_republish", "provenance_drift"):
            e = f"least(1.0, greatest(0.0, {s}))"
        elif s == "bus_factor":
            e = "greatest(0.0, least(1.0, 1 - (bus_factor - 1) / 3))"
        elif s == "trusted_publishing":
            e = "CASE WHEN trusted_publishing > 0.5 THEN 0.0 ELSE 1.0 END"
        elif s == "repo_drift":
            e = "0.0"
        else:
            by = {"size_delta": 5, "entropy_spike": 2, "cadence_break": 4, "publisher_portfolio_breadth": 20}.get(s)
            e = f"least(1.0, {s} / {by})" if by else f"least(1.0, greatest(0.0, {s}))"
            if deep:
                b = f"(SELECT b.median FROM base b WHERE b.package = sig.package AND b.signal = '{s}')", f"(SELECT b.mad FROM base b WHERE b.package = sig.package AND b.signal = '{s}')", f"(SELECT b.n FROM base b WHERE b.package = sig.package AND b.signal = '{s}')"
                e = f"CASE WHEN {b[2]} >= 3 THEN round(least(5.0, greatest(0.0, ({s} - {b[0]}) / (1.4826::DOUBLE * {b[1]}))) / 5, 4) ELSE {e} END"
        out.append(f"({e})::DOUBLE AS {s}")
    return f", normal AS (SELECT package, version, {', '.join(out)} FROM sig)"


@query(with_views(SIG_VIEWS, _signals_sql(COMPAT) + MAD + _normal_sql(True) + " SELECT package, version, " + ", ".join(f"round({s}, 4) AS {s}" for s in fragility.SIGNALS) + " FROM normal"))
def signals_normalized(spark, sf):
    sig = graph.cut_lineage(_signals(spark, sf))
    out = fragility.normalised(sig, fragility.mad_baseline(_long(sig), "package", "signal"))
    return out.select("package", "version", *[F.round(s, 4).alias(s) for s in fragility.SIGNALS])


_TERMS = [f"{w}::DOUBLE * {s}" for s, w in fragility.scoring.WEIGHTS.items()] + [f"{w}::DOUBLE * {a} * {b}" for (a, b), w in fragility.scoring.INTERACTIONS.items()]
SCORED = _normal_sql(False) + f", scored AS (SELECT *, -3.5 + {' + '.join(_TERMS)} AS z FROM normal)"


def _vectors(spark, sf):
    return fragility.normalised(_signals(spark, sf))


@query(with_views(SIG_VIEWS, _signals_sql(COMPAT) + SCORED + " SELECT package, version, round(z, 6) AS z, round(100 / (1 + exp(-z)), 2) AS fragility, round(1 / (1 + exp(-z)), 4) AS probability FROM scored"))
def fragility_scores(spark, sf):
    return fragility.predict(_vectors(spark, sf)).select("package", "version", F.round("z", 6).alias("z"), "fragility", "probability")


_NAMED = [(s, f"{w}::DOUBLE * {s}") for s, w in fragility.scoring.WEIGHTS.items()] + [(f"interaction:{fragility.scoring.INTERACTION_NAMES[a, b]}", f"{w}::DOUBLE * {a} * {b}") for (a, b), w in fragility.scoring.INTERACTIONS.items()]
PARTS = ", parts AS (" + " UNION ALL ".join(f"SELECT package, version, '{n}' AS signal, {e} AS value FROM normal" for n, e in _NAMED) + ")"


@query(
    with_views(SIG_VIEWS, _signals_sql(COMPAT) + _normal_sql(False) + PARTS + " SELECT package, version, place, signal, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY package, version ORDER BY value DESC, signal) AS place FROM parts WHERE value > 0) WHERE place <= 3")
)
def top_contributions(spark, sf):
    return _round(fragility.top_contributions(_vectors(spark, sf), "package", "version"), ("value",))


@query(
    with_views(
        ["components"],
        """, e AS (SELECT c_custkey, reachability AS tenant, fragility >= 70 AND consequence >= 50 AS posture, kev_listed AS exposed FROM components),
        u AS (SELECT *, sum(CASE WHEN posture AND exposed THEN 1 ELSE 0 END) OVER (PARTITION BY tenant ORDER BY c_custkey) AS used FROM e)
        SELECT c_custkey, posture, posture AND exposed AND used <= 10 AS alert, greatest(0, 10 - used)::BIGINT AS budget_remaining FROM u""",
    )
)
def alert_gate_budget(spark, sf):
    rows = view(spark, sf, "components").withColumn("tenant", F.col("reachability")).withColumn("exposed", F.col("kev_listed")).withColumn("arrival", F.col("c_custkey"))
    return fragility.gate(rows).select("c_custkey", "posture", "alert", F.col("budget_remaining").cast("long").alias("budget_remaining"))


@query(
    """SELECT * FROM (VALUES ('event-stream-2018', 11.7167, 100.0, 1.0, 'TP'), ('xz-utils-cve-2024-3094', 11.4367, 100.0, 1.0, 'TP'), ('shai-hulud-v2', 12.7, 100.0, 1.0, 'TP'),
    ('ua-parser-js-2021', 4.05, 98.29, 0.9829, 'TP'), ('chalk-4.1.2-benign', -2.3552, 8.67, 0.0867, 'TN'), ('express-4.18.2-benign', -2.3276, 8.89, 0.0889, 'TN')) t(incident_id, z, fragility, probability, outcome)"""
)
def incident_backtest(spark, sf):
    return fragility.backtest_rows(corpus.incidents(spark)).drop("is_malicious")


@query("SELECT 4::BIGINT AS tp, 0::BIGINT AS fp, 2::BIGINT AS tn, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall")
def backtest_metrics(spark, sf):
    return fragility.backtest_metrics(fragility.backtest_rows(corpus.incidents(spark)))


# ---- customer trees --------------------------------------------------------


def _parsed_out(df):
    needs = F.array_join(F.array_sort(F.transform(F.map_entries("dependencies"), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))), ", ")
    return df.select("project_id", "name", "version", "is_direct", needs.alias("needs"), "integrity")


def _register_parsers():
    for name, parser in (("npm", lockfiles.npm), ("cyclonedx", lockfiles.cyclonedx), ("spdx", lockfiles.spdx), ("yarn", lockfiles.yarn), ("pnpm", lockfiles.pnpm)):

        def run(spark, sf, name=name, parser=parser):
            return _parsed_out(parser(spark.createDataFrame(D.FILES[name], "project_id string, content string")))

        run.__name__ = f"{'sbom' if name in ('cyclonedx', 'spdx') else 'lockfile'}_{name}_parse"
        query(D.expected_sql(name))(run)


_register_parsers()

ROOTED = """, tops AS (SELECT DISTINCT project_id, src FROM project_edges e WHERE NOT EXISTS (SELECT 1 FROM project_edges x WHERE x.project_id = e.project_id AND x.dst = e.src)),
    tree AS (SELECT project_id, src, dst FROM project_edges UNION ALL SELECT project_id, 'root', src FROM tops),
    all_nodes AS (SELECT DISTINCT project_id, dst AS node FROM tree), reached AS (SELECT project_id, 'root' AS node FROM tops UNION SELECT r.project_id, t.dst FROM reached r JOIN tree t ON t.project_id = r.project_id AND t.src = r.node),
    cutoff AS (SELECT project_id, node AS d, 'root' AS node FROM all_nodes UNION SELECT c.project_id, c.d, t.dst FROM cutoff c JOIN tree t ON t.project_id = c.project_id AND t.src = c.node WHERE t.dst <> c.d),
    dominated AS (SELECT a.project_id, a.node, r.node AS dominated FROM all_nodes a JOIN reached r ON r.project_id = a.project_id AND r.node <> a.node AND r.node <> 'root' JOIN reached x ON x.project_id = a.project_id AND x.node = a.node
        WHERE NOT EXISTS (SELECT 1 FROM cutoff c WHERE c.project_id = a.project_id AND c.d = a.node AND c.node = r.node))"""


def _tree(spark, sf):
    edges = view(spark, sf, "project_edges")
    tops = edges.select("project_id", "src").distinct().join(edges.select("project_id", F.col("dst").alias("src")), ["project_id", "src"], "left_anti").select("project_id", F.lit("root").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(tops).select("project_id", F.lit("root").alias("root"), "src", "dst")


@query(with_views(["project_edges"], ROOTED + " SELECT project_id, node, dominated FROM dominated", True))
def dominated_sets(spark, sf):
    return graph.dominated_sets(graph.immediate_dominators(_tree(spark, sf))).where("node <> 'root'").select("project_id", "node", "dominated")


@query(
    with_views(
        ["project_edges"],
        ROOTED
        + """, depth AS (SELECT project_id, dominated, count(*) AS n FROM dominated GROUP BY project_id, dominated),
        near AS (SELECT x.project_id, x.dominated, arg_max(x.node, coalesce(y.n, 0)) AS node FROM dominated x LEFT JOIN depth y ON y.project_id = x.project_id AND y.dominated = x.node GROUP BY x.project_id, x.dominated)
        SELECT r.project_id, r.node, coalesce(near.node, 'root') AS idom FROM reached r LEFT JOIN near ON near.project_id = r.project_id AND near.dominated = r.node WHERE r.node <> 'root'""",
        True,
    )
)
def dominator_tree(spark, sf):
    return graph.immediate_dominators(_tree(spark, sf)).where("idom IS NOT NULL").select("project_id", "node", "idom")


def _risky(spark, sf):
    edges = view(spark, sf, "project_edges")
    nodes = edges.select("project_id", F.col("src").alias("name")).union(edges.select("project_id", "dst")).distinct()
    return nodes.where("length(name) % 2 = 0").select("project_id", "name", F.col("name").substr(5, 20).cast("double").alias("risk"))


CANDIDATES = ROOTED + """, risk AS (SELECT project_id, name, substr(name, 5)::DOUBLE AS risk FROM (SELECT project_id, src AS name FROM project_edges UNION SELECT project_id, dst FROM project_edges) WHERE length(name) % 2 = 0),
    reach2 AS (SELECT d.project_id, d.node AS target, d.dominated AS name FROM dominated d JOIN tops ON tops.project_id = d.project_id AND tops.src = d.node UNION SELECT project_id, src, src FROM tops),
    grp AS (SELECT project_id, target, list(name ORDER BY name) AS covered, sum(risk) AS gain FROM reach2 JOIN risk USING (project_id, name) GROUP BY project_id, target),
    cand AS (SELECT project_id, action, target, cost, covered, gain, ord FROM grp, (VALUES ('UPGRADE', 2.0::DOUBLE, 0), ('PIN', 1.0::DOUBLE, 1), ('REMOVE', 4.0::DOUBLE, 2)) t(action, cost, ord)
        UNION ALL SELECT project_id, 'OVERRIDE', name, 1.5::DOUBLE, [name], risk, 3 FROM risk WHERE NOT EXISTS (SELECT 1 FROM tops WHERE tops.project_id = risk.project_id AND tops.src = risk.name))"""


@query(with_views(["project_edges"], CANDIDATES + " SELECT project_id, action, target, cost, array_to_string(covered, ',') AS covered, gain FROM cand", True))
def intervention_candidates(spark, sf):
    tree = graph.cut_lineage(_tree(spark, sf))
    direct = tree.where("src = 'root'").select("project_id", F.col("dst").alias("name"))
    out = customer.candidates(direct, graph.dominated_sets(graph.immediate_dominators(tree)), _risky(spark, sf))
    return out.select("project_id", "action", "target", "cost", F.array_join("covered", ",").alias("covered"), "gain")


# Greedy choice as a recursion over steps; a project's options are a list, and its state what is met and spent.
PLANNED = CANDIDATES + """, o AS (SELECT project_id, list({'action': action, 'target': target, 'cost': cost, 'covered': covered, 'gain': gain} ORDER BY action = 'OVERRIDE', target, ord) AS options FROM cand GROUP BY project_id),
    steps AS (SELECT project_id, 0 AS step, options, []::VARCHAR[] AS met, 0.0::DOUBLE AS spent, 0::BIGINT AS pick FROM o
        UNION ALL SELECT project_id, step + 1, options, list_distinct(list_concat(met, options[b.i].covered)), spent + options[b.i].cost, b.i FROM (
            SELECT *, list_sort(list_filter(list_transform(options, lambda x, i: {'r': -coalesce(list_sum(list_transform(list_filter(x.covered, lambda p: NOT list_contains(met, p)), lambda p: substr(p, 5)::DOUBLE)), 0) / x.cost, 'i': i, 'c': x.cost}), lambda y: spent + y.c <= 10.0))[1] AS b
            FROM steps WHERE spent < 10.0) WHERE b.r < 0),
    greedy AS (SELECT project_id, max_by(met, step) AS met, max(spent) AS spent FROM steps GROUP BY project_id),
    single AS (SELECT project_id, list_sort(list_filter(list_transform(options, lambda x, i: {'g': -x.gain, 'i': i, 'c': x.cost}), lambda y: y.c <= 10.0))[1] AS b, options FROM o),
    sums AS (SELECT g.project_id, s.options, s.b, g.met, g.spent, list_sum(list_transform(g.met, lambda p: substr(p, 5)::DOUBLE)) AS got, (SELECT sum(risk) FROM risk WHERE risk.project_id = g.project_id) AS total FROM greedy g JOIN single s USING (project_id)),
    final AS (SELECT project_id, CASE WHEN -b.g > coalesce(got, 0) THEN 1 ELSE 0 END AS alone, options, b, total, CASE WHEN -b.g > coalesce(got, 0) THEN options[b.i].covered ELSE met END AS met, CASE WHEN -b.g > coalesce(got, 0) THEN options[b.i].cost ELSE spent END AS spent, CASE WHEN -b.g > coalesce(got, 0) THEN -b.g ELSE got END AS got FROM sums),
    picks AS (SELECT f.project_id, 1 AS step, options[b.i] AS x FROM final f WHERE alone = 1 UNION ALL SELECT s.project_id, s.step, s.options[s.pick] FROM steps s JOIN final f USING (project_id) WHERE alone = 0 AND s.step > 0),
    planned AS (SELECT p.project_id, p.step, x.action AS action, x.target AS target, x.cost AS cost, x.covered AS covered, round(got, 2) AS eliminated, round(total, 2) AS total, round(got / total * 100, 1) AS percentage, spent AS cost_used, f.met FROM picks p JOIN final f USING (project_id))"""


def _plans(spark, sf):
    tree = graph.cut_lineage(_tree(spark, sf))
    direct = tree.where("src = 'root'").select("project_id", F.col("dst").alias("name"))
    options = customer.candidates(direct, graph.dominated_sets(graph.immediate_dominators(tree)), _risky(spark, sf))
    return customer.plan(options, _risky(spark, sf), 10.0)


@query(
    with_views(
        ["project_edges"],
        PLANNED
        + """ SELECT project_id, step, action, target, cost, array_to_string(list_sort(covered), ',') AS covered, eliminated, total, percentage, cost_used,
        coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM risk WHERE risk.project_id = planned.project_id AND NOT list_contains(planned.met, name)), '') AS unresolved FROM planned""",
        True,
    )
)
def intervention_plan(spark, sf):
    out = _plans(spark, sf)
    return out.withColumn("covered", F.array_join("covered", ",")).withColumn("unresolved", F.array_join("unresolved", ","))


@query(with_views(["project_edges"], PLANNED + ", gone AS (SELECT DISTINCT project_id, unnest(covered) AS name FROM planned) SELECT project_id, string_agg(name || '=latest-safe', ',' ORDER BY name) AS overrides FROM gone GROUP BY project_id", True))
def manifest_overrides(spark, sf):
    out = customer.overrides(_plans(spark, sf))
    return out.select("project_id", F.array_join(F.array_sort(F.transform(F.map_entries("overrides"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("overrides"))


# ---- policy, reachability, reports ------------------------------------------

RULES = (
    ("no-unmaintained-critical", "warn", "consequence > 80 AND maintainer_count = 1"),
    ("block-new-install-hooks", "block", "has_install_hook AND provenance <> 'ATTESTED'"),
    ("provenance-required-critical", "warn", "consequence > 70 AND provenance = 'UNATTESTED'"),
    ("block-active-exploitation", "block", "kev_listed AND reachability IN ('REACHABLE', 'REACHABLE_INSTALL')"),
)
FIRED = ", fired AS (" + " UNION ALL ".join(f"SELECT c_custkey, '{i}' AS rule_id, '{a}' AS action FROM components WHERE {w}" for i, a, w in RULES) + ")"


@query(with_views(["components"], FIRED + " SELECT c_custkey, rule_id, action FROM fired"))
def policy_violations(spark, sf):
    return policy.violations(view(spark, sf, "components")).select("c_custkey", F.explode("violations").alias("v")).select("c_custkey", "v.rule_id", "v.action")


@query(with_views(["components"], FIRED + " SELECT c.c_custkey, CASE WHEN bool_or(f.action = 'block') THEN 'BLOCKED' WHEN count(f.rule_id) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM components c LEFT JOIN fired f USING (c_custkey) GROUP BY c.c_custkey"))
def policy_status(spark, sf):
    return policy.with_status(policy.violations(view(spark, sf, "components"))).select("c_custkey", "status")


@query("SELECT split_part(regexp_replace(link, '^(\\.{1,2}/)+', ''), '/', 1) AS pkg, count(*) AS sites FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY 1")
def import_index(spark, sf):
    """The regular-expression form of the import scan, over links of pages."""
    links = spark.read.parquet(f"{sf}/pages.parquet").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("link"))
    return links.groupBy(X.import_package(F.col("link")).alias("pkg")).agg(F.count("*").alias("sites"))


def _verdicts(spark, sf):
    adv = view(spark, sf, "advisories").withColumn("affected_symbols", F.when(F.col("symbol").isNotNull(), F.array("symbol")))
    uses = view(spark, sf, "uses").select("pkg", F.array("symbol").alias("symbols"), "is_dynamic", "is_namespace", F.array().cast("array<struct<file:string,line:int>>").alias("sites"))
    return reachability.verdicts(adv, reachability.merge_index(uses))


VERDICT = """, idx AS (SELECT pkg, list(DISTINCT symbol) AS symbols, bool_or(is_dynamic) OR bool_or(is_namespace) AS unclear FROM uses GROUP BY pkg),
    verdict AS (SELECT advisory, CASE WHEN has_install_hook THEN 'REACHABLE_INSTALL' WHEN pkg IS NULL THEN 'NOT_REACHABLE' WHEN symbol IS NULL THEN 'REACHABLE' WHEN list_contains(symbols, symbol) THEN 'REACHABLE' WHEN unclear THEN 'UNKNOWN' ELSE 'NOT_REACHABLE' END AS reachability,
        CASE WHEN has_install_hook THEN 'HIGH' WHEN pkg IS NULL THEN CASE WHEN is_transitive THEN 'MEDIUM' ELSE 'HIGH' END WHEN symbol IS NULL THEN 'LOW' WHEN list_contains(symbols, symbol) THEN 'HIGH' WHEN unclear THEN 'LOW' ELSE 'HIGH' END AS confidence FROM advisories LEFT JOIN idx ON pkg = package)"""
VERDICT_VIEWS = ["advisories", "uses"]


@query(with_views(VERDICT_VIEWS, VERDICT + " SELECT advisory, reachability, confidence FROM verdict"))
def reachability_verdicts(spark, sf):
    return _verdicts(spark, sf).select("advisory", "reachability", "confidence")


@query(with_views(VERDICT_VIEWS, VERDICT + " SELECT advisory, CASE WHEN reachability = 'NOT_REACHABLE' AND confidence = 'HIGH' THEN 'not_affected' WHEN reachability LIKE 'REACHABLE%' THEN 'affected' ELSE 'under_investigation' END AS status, CASE WHEN reachability = 'NOT_REACHABLE' AND confidence = 'HIGH' THEN 'vulnerable_code_not_in_execute_path' END AS justification FROM verdict"))
def vex_status(spark, sf):
    return reachability.vex_status(_verdicts(spark, sf)).select("advisory", "status", "justification")


@query(with_views(VERDICT_VIEWS, VERDICT + " SELECT advisory, CASE WHEN reachability = 'NOT_REACHABLE' AND confidence = 'HIGH' THEN 'not_affected' WHEN reachability LIKE 'REACHABLE%' THEN 'exploitable' ELSE 'in_triage' END AS state FROM verdict"))
def cyclonedx_state(spark, sf):
    return reachability.cyclonedx_state(_verdicts(spark, sf)).select("advisory", "state")


@query(
    with_views(
        ["nodes", "versions"],
        """SELECT name, count(DISTINCT version) AS version_count, count(DISTINCT publisher) AS publishers, coalesce(bool_or(has_install_hook), false) AS has_install_hook, coalesce(max(provenance), 'UNKNOWN') AS provenance, max_by(version, seq) AS latest_version
        FROM nodes LEFT JOIN versions ON package = name GROUP BY name""",
    )
)
def package_report(spark, sf):
    return reports.package_facts(view(spark, sf, "nodes"), view(spark, sf, "versions"))


@query(
    with_views(
        ["components", "nodes", "versions", "maintainers", "edges"],
        """SELECT (SELECT count(*) FROM nodes) AS packages, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM maintainers) AS maintainers, (SELECT count(*) FROM edges) AS edges,
        count(*) FILTER (consequence >= 75) AS critical, count(*) FILTER (consequence >= 50 AND consequence < 75) AS high, count(*) FILTER (consequence < 50) AS low, 24 AS early_warning_hours, 72 AS notification_hours, 14 AS final_report_days, 1 AS sla_rules FROM components""",
    )
)
def overview_counts(spark, sf):
    return reports.overview(*(view(spark, sf, n) for n in ("nodes", "versions", "maintainers", "edges")), view(spark, sf, "components").withColumnRenamed("consequence", "score")).join(policy.sla_summary(spark))


@query(
    with_views(
        ["nodes", "multigraph", "hooks", "components", "versions"],
        "SELECT n.name, coalesce((SELECT consequence FROM components WHERE 'pkg-' || c_custkey::VARCHAR = n.name), 0.0)::DOUBLE AS score, (SELECT count(*) FROM multigraph m WHERE m.dst = n.name) AS in_degree, (SELECT count(*) FROM multigraph m WHERE m.src = n.name) AS out_degree, h.has_install_hook, coalesce((SELECT max(provenance) FROM versions v WHERE v.package = n.name), 'UNKNOWN') AS provenance FROM nodes n JOIN hooks h USING (name)",
    )
)
def graph_export(spark, sf):
    scores = view(spark, sf, "components").select(F.concat(F.lit("pkg-"), "c_custkey").alias("name"), F.col("consequence").alias("score"))
    said = view(spark, sf, "versions").groupBy(F.col("package").alias("name")).agg(F.max("provenance").alias("provenance"))
    return graph.node_link(_multigraph(spark, sf), view(spark, sf, "nodes"), scores, view(spark, sf, "hooks").join(said, "name", "left"))


@query(with_views(["multigraph"], f"SELECT src AS source, dst AS target, range_raw, {FORMS} AS range_class, count(*) AS n FROM multigraph GROUP BY ALL"))
def graph_export_links(spark, sf):
    return graph.links(_multigraph(spark, sf))


@query(
    with_views(
        ["versions", "components"],
        """, a AS (SELECT package AS name, max_by(version, seq) AS version FROM versions WHERE seq % 2 = 0 GROUP BY 1), b AS (SELECT package AS name, max_by(version, seq) AS version FROM versions WHERE seq % 3 = 0 GROUP BY 1),
        s AS (SELECT 'pkg-' || c_custkey::VARCHAR AS name, consequence, fragility FROM components)
        SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.version IS NULL THEN 'ADDED' WHEN b.version IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change, a.version AS old_version, b.version AS new_version, coalesce(s.consequence, 0) AS consequence,
        CASE WHEN a.version IS NULL THEN coalesce(s.consequence, 0) WHEN b.version IS NULL THEN -coalesce(s.consequence, 0) ELSE 0 END AS risk_delta, s.fragility FROM a FULL JOIN b ON a.name = b.name LEFT JOIN s ON s.name = coalesce(a.name, b.name) WHERE a.version IS DISTINCT FROM b.version""",
    )
)
def snapshot_diff(spark, sf):
    v = view(spark, sf, "versions")
    snap = lambda c: v.where(c).groupBy(F.col("package").alias("name")).agg(F.max_by("version", "seq").alias("version"))
    scores = view(spark, sf, "components").select(F.concat(F.lit("pkg-"), F.col("c_custkey").cast("string")).alias("name"), F.col("consequence").alias("score"), "fragility")
    return reports.snapshot_diff(snap("seq % 2 = 0"), snap("seq % 3 = 0"), scores, scores)


@query("SELECT 'pkg-' || user_id::VARCHAR AS id, max(event_id) AS number, CASE WHEN max_by(event_type, event_id) = 'error' THEN 'marked_unpublished' ELSE 'processed' END AS status FROM events GROUP BY user_id")
def feed_apply_stream(spark, sf):
    """The events as a change feed: streamed to the end with a checkpoint, then read back."""
    import uuid

    from ..streaming import feed

    base = f"{shared_folder(spark)}/chainloom/feed-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    changes = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").selectExpr("cast(event_id AS string) AS seq", "'pkg-' || cast(user_id AS string) AS id", "event_type = 'error' AS deleted")
    feed.follow(changes, f"{base}/out", f"{base}/checkpoint")
    return feed.last_write_wins(spark.read.parquet(f"{base}/out"))


from . import workflows  # noqa: E402, F401  (registers its queries)
