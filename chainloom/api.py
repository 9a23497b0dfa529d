"""The library surface: one function for each thing a user asks, all returning DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import consequence, customer, fragility, graph, ingest, policy, reachability, reports
from .sources import corpus, lockfiles, packuments, trees


def hydrate(documents: DataFrame) -> dict[str, DataFrame]:
    """Registry documents (content, observed_at) to tables."""
    parsed = packuments.parse(documents)
    observed = packuments.maintainers(parsed)
    snaps = ingest.snapshots(observed)
    return {
        "blobs": packuments.blobs(documents), "pointers": packuments.pointers(documents), "packages": packuments.packages(parsed), "versions": packuments.versions(parsed), "edges": packuments.dependency_edges(parsed),
        "maintainers": observed, "maintainer_events": ingest.maintainer_events(snaps), "current_maintainers": ingest.current_maintainers(snaps), "last_polled": ingest.last_polled(snaps),
    }


def reconcile(registry: DataFrame, stored: DataFrame) -> DataFrame:
    return ingest.reconcile(registry, stored)


def scan(files: DataFrame, scores: DataFrame, fragility_rows: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Lockfiles (project_id, filename, content) to rated dependencies."""
    return reports.scan_report(lockfiles.parse_lockfiles(files), scores, fragility_rows, rules)


def blast_radius(edges: DataFrame, name: str, **budget) -> DataFrame:
    return graph.blast_radius(edges, name, **budget)[0]


def consequence_scores(edges: DataFrame, nodes: DataFrame, hooks: DataFrame | None = None, **options) -> DataFrame:
    return consequence.scores(consequence.metrics(edges, nodes, hooks, **options))


def simulate(edges: DataFrame, name: str, version: str, **options) -> DataFrame:
    return reports.simulation_report(edges, name, version, **options)


def solve(files: DataFrame, scores: DataFrame, budget: float = 10.0) -> DataFrame:
    return customer.solve(lockfiles.parse_lockfiles(files), scores, budget)


def import_index(files: DataFrame) -> DataFrame:
    return reachability.merge_index(trees.index_files(files))


def vex(advisories: DataFrame, index: DataFrame, keys: tuple[str, ...], fmt: str = "openvex") -> DataFrame:
    rows = reachability.verdicts(advisories, index)
    return reachability.openvex(rows, keys) if fmt == "openvex" else reachability.cyclonedx_vex(rows, keys)


def sbom(nodes: DataFrame, scores: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return reachability.sbom_export(nodes, scores, keys)


def watch_index(scores: DataFrame, packages: DataFrame, versions: DataFrame, top_n: int = 25) -> DataFrame:
    return consequence.watch_index(scores, packages, versions, top_n)


def backtest(spark, threshold: float = 70.0, extra: DataFrame | None = None) -> DataFrame:
    return fragility.backtest_metrics(fragility.backtest_rows(corpus.incidents(spark, extra), threshold))


def check_policy(components: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    return policy.with_status(policy.violations(components, rules))


def diff(before: DataFrame, after: DataFrame, scores: DataFrame) -> DataFrame:
    return reports.snapshot_diff(before, after, scores)


def rated_fragility(versions: DataFrame, mode: str = "compat", **facts) -> DataFrame:
    return fragility.predict(fragility.normalised(fragility.signals(versions, mode=mode, **facts))).select("package", "version", "z", "fragility", F.col("probability"))
