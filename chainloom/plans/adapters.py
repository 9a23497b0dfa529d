"""Domain inputs as views over the driver's tables, in SQL that both engines read.

Each adapter is one SELECT with tables in braces; Spark binds DataFrames to them,
the oracle uses the tables' names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LEAD = "lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_RANGE = (
    "CASE l_suppkey % 9 WHEN 0 THEN '^1.2.0' WHEN 1 THEN '~1.2.0' WHEN 2 THEN '*' WHEN 3 THEN '1.2.3' WHEN 4 THEN '>=1.0.0 <2.0.0' "
    "WHEN 5 THEN '1.x' WHEN 6 THEN 'git+https://host/x' WHEN 7 THEN '^0.2.3' ELSE '>=3.0.0' END"
)


def _pkg(column: str) -> str:
    return f"'pkg-' || cast({column} AS string)"


def _pairs(quantity: int) -> str:
    return f"SELECT l_partkey AS a, {_LEAD} AS b, l_suppkey FROM {{lineitem}} WHERE l_returnflag = 'R' AND l_quantity >= {quantity}"


ADAPTERS = {
    "nodes": f"SELECT {_pkg('p_partkey')} AS name FROM {{part}}",
    "hooks": f"SELECT {_pkg('p_partkey')} AS name, p_size % 7 = 0 AS has_install_hook FROM {{part}}",
    "edges": f"SELECT DISTINCT {_pkg('a')} AS src, {_pkg('b')} AS dst FROM ({_pairs(35)}) t WHERE b IS NOT NULL AND a <> b",
    "cyclic": f"SELECT DISTINCT {_pkg('a')} AS src, {_pkg('b')} AS dst FROM ({_pairs(30)}) t WHERE b IS NOT NULL AND a <> b",
    "dependencies": f"SELECT a AS from_version_id, b AS to_package_id, 'RUNTIME' AS kind, {_RANGE} AS range_raw FROM ({_pairs(35)}) t WHERE b IS NOT NULL AND a <> b",
    "multigraph": f"SELECT {_pkg('a')} AS src, {_pkg('b')} AS dst, {_RANGE} AS range_raw FROM ({_pairs(35)}) t WHERE b IS NOT NULL AND a <> b",
    "project_edges": f"SELECT DISTINCT 'proj-' || cast(l_suppkey % 8 AS string) AS project_id, {_pkg('a')} AS src, {_pkg('b')} AS dst FROM ({_pairs(35)}) t WHERE b IS NOT NULL AND a <> b",
    "mentions": (  # what the sources below say, import by import
        "SELECT 'proj-' || cast(c_nationkey % 5 AS string) AS project_id, 'src/f' || cast(c_custkey AS string) || '.js' AS path, c_custkey % 4 AS kind, 'pkg-' || cast(c_custkey % 90 AS string) AS a, "
        "'@scope/p' || cast(c_custkey % 90 AS string) AS b, 'pkg-' || cast(c_custkey % 7 AS string) AS c, 'pkg-' || cast(c_custkey % 11 AS string) AS d FROM {customer}"
    ),
    "versions": (
        f"SELECT {_pkg('o_custkey')} AS package, cast(o_orderkey AS string) AS version, o_orderkey AS seq, o_orderdate AS published_at, "
        "CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE o_orderpriority END AS publisher, cast(floor(o_totalprice) AS bigint) AS size, "
        "o_orderstatus = 'F' AS has_install_hook, cast(o_orderkey % 50 AS double) / 10 + 4.0 AS entropy, "
        "CASE o_orderstatus WHEN 'O' THEN 'ATTESTED' WHEN 'F' THEN 'UNATTESTED' ELSE 'UNKNOWN' END AS provenance FROM {orders}"
    ),
    "maintainers": f"SELECT DISTINCT {_pkg('o_custkey')} AS package, o_orderpriority AS maintainer FROM {{orders}} WHERE o_orderstatus = 'O'",
    "churn": f"SELECT {_pkg('c_custkey')} AS package, CASE WHEN c_nationkey % 3 = 0 THEN 'ADDED' ELSE 'REMOVED' END AS event_type FROM {{customer}}",
    "polls": f"SELECT DISTINCT {_pkg('user_id')} AS package, date_trunc('day', ts) AS observed_at, event_type AS handle FROM {{events}}",
    "ranges": (
        "SELECT DISTINCT cast(l_linenumber AS string) || '.' || cast(l_suppkey % 10 AS string) || '.' || cast(cast(l_quantity AS int) AS string) "
        "|| CASE WHEN l_partkey % 11 = 0 THEN '-beta.' || cast(l_partkey % 3 AS string) ELSE '' END AS version, "
        "CASE l_suppkey % 9 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' WHEN 3 THEN '' WHEN 4 THEN '>' WHEN 5 THEN '<' WHEN 6 THEN '<=' WHEN 7 THEN '=' ELSE 'v' END "
        "|| cast(l_linenumber AS string) || '.' || cast(l_suppkey % 7 AS string) || '.' || cast(l_partkey % 5 AS string) AS range_raw FROM {lineitem}"
    ),
    "components": (
        "SELECT c_custkey, c_acctbal / 100 AS consequence, cast(c_nationkey AS double) * 4 AS fragility, cast(c_custkey % 3 AS int) AS maintainer_count, c_custkey % 7 = 0 AS has_install_hook, "
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'ATTESTED' WHEN 'MACHINERY' THEN 'UNATTESTED' ELSE 'UNKNOWN' END AS provenance, c_custkey % 5 = 0 AS kev_listed, "
        "CASE WHEN c_nationkey % 2 = 0 THEN 'REACHABLE' ELSE 'NOT_REACHABLE' END AS reachability FROM {customer}"
    ),
    "advisories": (
        f"SELECT c_custkey AS advisory, {_pkg('c_custkey % 400')} AS package, CASE c_nationkey % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' END AS symbol, "
        "c_custkey % 13 = 0 AS has_install_hook, c_custkey % 2 = 0 AS is_transitive FROM {customer}"
    ),
    "uses": f"SELECT {_pkg('user_id')} AS pkg, event_type AS symbol, event_id % 40 = 0 AS is_dynamic, event_id % 60 = 0 AS is_namespace FROM {{events}}",
    "mails": "SELECT c_custkey, '  ' || upper(c_name) || CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '@Host' || cast(c_nationkey AS string) || '.Example' END || ' ' AS email FROM {customer}",
}


def tables_of(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", ADAPTERS[name])))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter as a DataFrame."""
    return spark.sql(ADAPTERS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(name)})


def sql(name: str) -> str:
    """The adapter for the oracle."""
    return re.sub(r"\{(\w+)\}", r"\1", ADAPTERS[name])


def with_views(names: list[str], query: str, recursive: bool = False) -> str:
    """``query`` after the named adapters as common table expressions; a query that starts with "," adds more of them."""
    head = ", ".join(f"{n} AS ({sql(n)})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{'' if query.lstrip().startswith(',') else ' '}{query}"
