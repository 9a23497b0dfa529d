"""Reports: joined views that replace one query for each package by one for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def package_facts(packages: DataFrame, versions: DataFrame) -> DataFrame:
    """name, version_count, publishers, has_install_hook, provenance (the alphabetically last), latest_version.

    The latest version is the one stored last where versions have a ``seq``, else the one published last.
    """
    newest = ("seq",) if "seq" in versions.columns else ("published_at", "version")
    facts = versions.groupBy(F.col("package").alias("name")).agg(
        F.count_distinct("version").alias("version_count"),
        F.count_distinct("publisher").alias("publishers"),
        F.max("has_install_hook").alias("has_install_hook"),
        F.max("provenance").alias("provenance"),
        F.max_by("version", F.struct(*newest)).alias("latest_version"),
    )
    out = packages.select("name").join(facts, "name", "left")
    return out.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("version_count", "publishers")], F.coalesce("has_install_hook", F.lit(False)).alias("has_install_hook"), F.coalesce("provenance", F.lit("UNKNOWN")).alias("provenance"), "latest_version")


def package_list(facts: DataFrame, scores: DataFrame, fragility: DataFrame, maintainers: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """One row for each package with scores, maintainers and policy status, most consequential first."""
    from . import policy

    bus = maintainers.groupBy(F.col("package").alias("name")).agg(F.count_distinct("maintainer").cast("int").alias("maintainer_count"))
    out = facts.join(scores.select("name", F.col("score").alias("consequence")), "name", "left").join(fragility.select("name", "fragility"), "name", "left").join(bus, "name", "left")
    out = out.withColumns({"consequence": F.coalesce("consequence", F.lit(0.0)), "fragility": F.coalesce("fragility", F.lit(0.0)), "maintainer_count": F.coalesce("maintainer_count", F.lit(0))})
    checked = policy.with_status(policy.violations(out, rules))
    return checked.select(*out.columns, "status").orderBy(F.desc("consequence"), "name")


def overview(packages: DataFrame, versions: DataFrame, maintainers: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: table sizes and score bands."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    s = F.col("score")
    bands = scores.agg(F.count_if(s >= 75).alias("critical"), F.count_if((s >= 50) & (s < 75)).alias("high"), F.count_if(s < 50).alias("low"))
    out = count(packages, "packages")
    for df, name in ((versions, "versions"), (maintainers, "maintainers"), (edges, "edges")):
        out = out.join(count(df, name))
    return out.join(bands)


def blast_report(edges: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """One row: score, affected packages, direct dependents and depth of one package."""
    from . import graph

    reached, _ = graph.blast_radius(edges, name)
    totals = reached.agg(F.count("*").alias("reach"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    direct = graph.direct_dependents(edges, name).agg(F.count("*").alias("direct_dependents"))
    score = scores.where(F.col("name") == name).agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("consequence"))
    return totals.join(direct).join(score).select(F.lit(name).alias("name"), "*")


def package_detail(name: str, versions: DataFrame, edges: DataFrame, events: DataFrame, reached: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """One row with nested sections of one package; no row for an unknown one."""
    mine = versions.where(F.col("package") == name)
    history = mine.agg(F.reverse(F.array_sort(F.collect_list(F.struct("published_at", "version", "has_install_hook", "provenance")))).alias("versions"))
    up = edges.where(F.col("dst") == name).agg(F.array_sort(F.collect_list("src")).alias("dependents"))
    down = edges.where(F.col("src") == name).agg(F.array_sort(F.collect_list("dst")).alias("dependencies"))
    seen = events.where(F.col("package") == name).agg(F.reverse(F.array_sort(F.collect_list(F.struct("observed_at", "event_type", "handle")))).alias("events"))
    radius = reached.where(F.col("root") == name).agg(F.count("*").alias("reach"), F.max("depth").alias("max_depth"))
    out = history.join(up).join(down).join(seen).join(radius).where(F.size("versions") > 0).select(F.lit(name).alias("name"), "*")
    if rated is None:
        return out
    from . import fragility

    mine = rated.where(F.col("package") == name).agg(F.max("fragility").alias("fragility"), F.coalesce(F.max("probability"), F.lit(0.0)).alias("probability"))
    contract = fragility.evidence(out.join(mine).select(F.col("name").alias("package"), "probability", F.transform("dependents", lambda d: F.concat(d, F.lit(" -> "), F.col("name"))).alias("paths")))
    return out.join(mine).join(contract.select(F.col("document").alias("evidence")))


def scan_report(parsed: DataFrame, scores: DataFrame, fragility: DataFrame, rules: list[dict] | None = None, default_score: float = 35.0) -> DataFrame:
    """Dependencies of projects with scores and policy status; every row, without a display cap."""
    from . import policy

    rows = parsed.join(scores.select("name", F.col("score").alias("consequence")), "name", "left").join(fragility.select("name", "fragility"), "name", "left")
    rows = rows.withColumn("consequence", F.coalesce("consequence", F.lit(default_score))).withColumn("fragility", F.coalesce("fragility", F.lit(0.0)))
    return policy.with_status(policy.violations(rows, rules)).select("project_id", "name", "version", "is_direct", "consequence", "fragility", "status")


def first_of_each(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each key, for a display (the limit is the feature).

    Each partition keeps its own first ``n`` before any row moves.
    """
    own = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__place", F.row_number().over(own)).where(F.col("__place") <= n).drop("__place")


def maintainer_history(events: DataFrame, mails: DataFrame) -> DataFrame:
    """Maintainer events with what is known of each handle, newest first; unknown handles are left out."""
    return events.join(mails, "handle").orderBy(F.desc("observed_at"), "package", "event_type", "handle")


def live_summary(rows: DataFrame) -> DataFrame:
    """Adds status of a single-package summary: WARN at fragility 70 or consequence 75, else PASS."""
    return rows.withColumn("status", F.when((F.col("fragility") >= 70) | (F.col("consequence") >= 75), "WARN").otherwise("PASS"))


def snapshot_diff(before: DataFrame, after: DataFrame, scores: DataFrame, fragility: DataFrame | None = None) -> DataFrame:
    """name, change (ADDED, REMOVED, CHANGED), both versions and the change in consequence between two dependency snapshots."""
    b = before.select("name", F.col("version").alias("old_version"))
    a = after.select("name", F.col("version").alias("new_version"))
    both = b.join(a, "name", "full_outer").where(~F.col("old_version").eqNullSafe(F.col("new_version")))
    change = F.when(F.col("old_version").isNull(), "ADDED").when(F.col("new_version").isNull(), "REMOVED").otherwise("CHANGED")
    out = both.join(scores.select("name", F.coalesce("score", F.lit(0.0)).alias("consequence")), "name", "left").withColumn("consequence", F.coalesce("consequence", F.lit(0.0)))
    if fragility is not None:
        out = out.join(fragility.select("name", "fragility"), "name", "left")
    delta = F.when(change == "ADDED", F.col("consequence")).when(change == "REMOVED", -F.col("consequence")).otherwise(0.0)
    return out.select("name", change.alias("change"), "old_version", "new_version", "consequence", delta.alias("risk_delta"), *(["fragility"] if fragility is not None else []))


def net_risk(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"), F.sum("risk_delta").alias("risk_delta"))


def simulation_report(edges: DataFrame, name: str, version: str, verdicts: DataFrame | None = None, damping: float = 0.6, threshold: float = 0.1) -> DataFrame:
    """One row: naive, gated and source-gated numbers, and the share of noise taken away by each gate."""
    from . import graph

    base = graph.simulate(edges, name, version, damping, threshold)
    if verdicts is None:
        return base.withColumn("source_gated", F.col("gated")).withColumn("source_noise_reduction", F.col("noise_reduction"))
    gated = graph.gated_reach(edges, name, version, damping).where(F.col("probability") >= threshold)
    safe = verdicts.where("reachability = 'NOT_REACHABLE'").select(F.col("package").alias("name"))
    left = gated.join(safe, "name", "left_anti").agg(F.count("*").alias("source_gated"))
    return base.join(left).withColumn("source_noise_reduction", F.round((1 - F.col("source_gated") / F.greatest(F.lit(1), F.col("naive"))) * 100, 1))
