"""Fragility: publish-time signals, robust normalisation, model, gate, backtest."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scoring import SIGNALS
from ..session import cut_lineage, let
from .graph import modest

DAY = 86_400_000_000.0  # microseconds


def _days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY)


#: Releases before a version whose publishers count, and those whose provenance counts.
TAIL, ATTESTED_TAIL = 20, 5


def signals(versions: DataFrame, maintainers: DataFrame | None = None, events: DataFrame | None = None, drift: DataFrame | None = None, mode: str = "compat") -> DataFrame:
    """The fifteen signals of every version.

    ``versions``: package, version (unique in it), published_at, publisher, size,
    has_install_hook, entropy, provenance.  ``maintainers``: package, maintainer
    (current ones).  ``events``: package, event_type.  ``drift``: package, version,
    repo_drift.

    ``mode="compat"`` takes all other versions of the package as history, later
    ones too; ``"point_in_time"`` only earlier ones.  Versions are ordered by time,
    then name.  Rows carry the last ``TAIL`` releases of their history at most;
    everything else comes from windows over the sorted releases, which spill.
    """
    if mode not in ("compat", "point_in_time"):
        raise ValueError(mode)
    entropy = F.coalesce(F.nullif("entropy", F.lit(0.0)), F.lit(4.5)).alias("entropy")
    rows = versions.select("package", "version", F.col("published_at").cast("timestamp").alias("published_at"), "publisher", "size", "has_install_hook", "provenance", entropy)
    rows = (_with_others if mode == "compat" else _with_earlier)(rows)

    # A few publishers have most releases; their numbers go to the releases, which aren't dealt by publisher.
    breadth = cut_lineage(versions.where("publisher IS NOT NULL").groupBy("publisher").agg(F.count_distinct("package").cast("double").alias("breadth")))
    rows = rows.join(modest(breadth), "publisher", "left")
    rows = rows.join(maintainers.groupBy("package").agg(F.count_distinct("maintainer").cast("double").alias("bus")), "package", "left") if maintainers is not None else rows.withColumn("bus", F.lit(None).cast("double"))
    rows = rows.join(events.groupBy("package").agg(F.max((F.col("event_type") == "ADDED").cast("double")).alias("churn")), "package", "left") if events is not None else rows.withColumn("churn", F.lit(None).cast("double"))
    rows = rows.join(drift.select("package", "version", F.col("repo_drift").cast("double").alias("drift")), ["package", "version"], "left") if drift is not None else rows.withColumn("drift", F.lit(None).cast("double"))

    n = F.col("n_past")
    last = lambda c: F.expr(f"get(tail, size(tail) - 1).{c}")
    rows = rows.withColumn("recent", F.expr("filter(transform(tail, x -> x.publisher), p -> p IS NOT NULL)"))
    rows = rows.withColumn("dormant", F.when(n > 0, F.greatest(F.lit(0.0), _days(F.col("published_at"), last("published_at")))).otherwise(0.0))
    concentration = F.expr("aggregate(array_distinct(recent), 0D, (a, p) -> a + power(size(filter(recent, q -> q = p)) / size(recent), 2))")
    churn = F.coalesce("churn", F.lit(0.0))
    known = F.col("publisher").isNotNull()
    previous_size = F.coalesce(F.nullif(last("size").cast("double"), F.lit(0.0)), F.lit(1.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return rows.select(
        "package",
        "version",
        F.coalesce(F.nullif("bus", F.lit(0.0)), F.lit(1.0)).alias("bus_factor"),
        concentration.alias("publish_concentration"),
        churn.alias("ownership_churn"),
        flag((churn > 0) & (F.col("dormant") >= 180)).alias("churn_after_dormancy"),
        flag(known & (F.col("n_same_publisher") == 0)).alias("first_publish_by_new_owner"),
        F.when(known, F.coalesce("breadth", F.lit(1.0))).otherwise(1.0).alias("publisher_portfolio_breadth"),
        F.col("dormant").alias("days_dormant"),
        F.when(F.col("cadence") > 0, F.abs(F.col("dormant") - F.col("cadence")) / F.greatest(F.lit(1.0), F.col("cadence"))).otherwise(0.0).alias("cadence_break"),
        flag((F.col("dormant") < 0.01) & (n > 0)).alias("rapid_republish"),
        F.when(n > 0, F.greatest(F.lit(0.0), (F.coalesce("size", F.lit(0)) - previous_size) / F.greatest(F.lit(1.0), previous_size))).otherwise(0.0).alias("size_delta"),
        flag(F.coalesce("has_install_hook", F.lit(False)) & ~F.coalesce(last("has_install_hook"), F.lit(False))).alias("new_install_hook"),
        F.greatest(F.lit(0.0), F.col("entropy") - 6.5).alias("entropy_spike"),
        F.coalesce("drift", F.lit(0.0)).alias("repo_drift"),
        flag((F.col("provenance") == "UNATTESTED") & F.expr(f"exists(slice(reverse(tail), 1, {ATTESTED_TAIL}), x -> x.provenance = 'ATTESTED')")).alias("provenance_drift"),
        flag(F.col("provenance") == "ATTESTED").alias("trusted_publishing"),
    )


_RELEASE = ("published_at", "version", "publisher", "size", "has_install_hook", "provenance")


def _in_order():
    return Window.partitionBy("package").orderBy("published_at", "version")


def _with_earlier(rows: DataFrame) -> DataFrame:
    """Adds n_past, tail, n_same_publisher and cadence over the earlier releases."""
    own = Window.partitionBy("package", "publisher").orderBy("published_at", "version")
    out = running_cadence(rows)
    return out.select(
        "*",
        (F.row_number().over(_in_order()) - 1).alias("n_past"),
        F.collect_list(F.struct(*_RELEASE)).over(_in_order().rowsBetween(-TAIL, -1)).alias("tail"),
        (F.row_number().over(own) - 1).alias("n_same_publisher"),
    )


def _with_others(rows: DataFrame) -> DataFrame:
    """The same over all other releases.

    Leaving one release out takes two gaps away from the package's gaps and adds
    their sum, so the middle one moves by two places at most: the eight gaps around
    the middle decide.
    """
    whole = Window.partitionBy("package")
    gap = F.when(F.lag("published_at").over(_in_order()).isNotNull(), _days(F.col("published_at"), F.lag("published_at").over(_in_order())))
    following = _days(F.lead("published_at").over(_in_order()), F.col("published_at"))
    across = _days(F.lead("published_at").over(_in_order()), F.lag("published_at").over(_in_order()))
    at = F.row_number().over(_in_order())
    out = rows.select("*", F.count("*").over(whole).alias("n_all"), at.alias("at"), gap.alias("before"), following.alias("after"), across.alias("across"), (F.count("publisher").over(Window.partitionBy("package", "publisher")) - 1).alias("n_same_publisher"))
    tails = out.where(F.col("at") >= F.col("n_all") - TAIL).groupBy("package").agg(F.array_sort(F.collect_list(F.struct(*_RELEASE))).alias("last"))
    middle = F.floor((F.col("n_all") - 2) / 2)
    placed = out.where("before IS NOT NULL").select("package", "before", middle.alias("k"), (F.row_number().over(Window.partitionBy("package").orderBy("before")) - 1).alias("rank"))
    near = placed.where((F.col("rank") >= F.col("k") - 3) & (F.col("rank") <= F.col("k") + 4)).groupBy("package").agg(F.array_sort(F.collect_list("before")).alias("w"), F.min("rank").cast("long").alias("lo"))
    out = out.join(tails, "package").join(near, "package", "left").withColumn("k", middle)

    def less(state: Column, gap: Column) -> Column:
        w = state["w"]
        same = F.filter(w, lambda y: y == gap)
        rest = F.concat(F.filter(w, lambda y: y < gap), F.slice(same, F.lit(2), F.greatest(F.size(same) - 1, F.lit(0))), F.filter(w, lambda y: y > gap))
        return F.when(gap.isNull() | (gap > F.element_at(w, -1)), state).when(gap < w[0], F.struct(w.alias("w"), (state["lo"] - 1).alias("lo"))).otherwise(F.struct(rest.alias("w"), state["lo"].alias("lo")))

    state = F.struct("w", "lo")
    pick = let(let(state, lambda s: less(s, F.col("before"))), lambda s: let(less(s, F.col("after")), lambda t: F.get(F.array_sort(F.when(F.col("across").isNull(), t["w"]).otherwise(F.concat(t["w"], F.array("across")))), (F.col("k") - t["lo"]).cast("int"))))
    tail = F.filter("last", lambda x: x["version"] != F.col("version"))
    return out.select(*rows.columns, (F.col("n_all") - 1).alias("n_past"), F.slice(tail, F.greatest(F.size(tail) - TAIL + 1, F.lit(1)), F.lit(TAIL)).alias("tail"), "n_same_publisher", F.when(F.col("n_all") >= 4, pick).alias("cadence"))


def running_cadence(rows: DataFrame) -> DataFrame:
    """Adds cadence: the upper median of the gaps among a package's earlier releases; null below three of them.

    Releases stream by in order; what a task holds is the sorted gaps of one package, one number each.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    day, at, name = DAY, rows.columns.index("published_at"), rows.columns.index("package")

    def run(batches):
        import pyarrow as pa

        package, last, gaps, n = None, None, [], 0
        for b in batches:
            out = []
            for p, t in zip(b.column(name).to_pylist(), b.column(at).cast(pa.timestamp("us", b.column(at).type.tz)).cast(pa.int64()).to_pylist()):
                if n == 0 or p != package:
                    package, last, gaps, n = p, None, [], 0
                out.append(gaps[len(gaps) // 2] if n >= 3 and gaps else None)
                if last is not None and t is not None:
                    insort(gaps, (t - last) / day)
                last, n = t, n + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*rows_columns, "cadence"])

    rows_columns = rows.columns
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "package").sortWithinPartitions("package", "published_at", "version").mapInArrow(run, StructType([*rows.schema.fields, StructField("cadence", DoubleType())]))


def mad_baseline(long: DataFrame, *keys: str) -> DataFrame:
    """(keys, median, mad, n) of ``value``: exact median, and median absolute deviation floored at 1e-4."""
    middle = long.groupBy(*keys).agg(F.median("value").alias("median"), F.count("value").alias("n"))
    away = long.join(middle, list(keys)).groupBy(*keys).agg(F.greatest(F.median(F.abs(F.col("value") - F.col("median"))), F.lit(1e-4)).alias("mad"))
    return middle.join(away, list(keys)).select(*keys, "median", "mad", "n")


def normalised(raw: DataFrame, baseline: DataFrame | None = None, min_history: int = 3) -> DataFrame:
    """Signals as anomalies in 0..1.  ``baseline``: package, signal, median, mad, n; without it, or with a short history, fixed divisors are used."""
    if baseline is None:
        return raw.select(*[c for c in raw.columns if c not in SIGNALS], *[scoring.normalise(s, F.coalesce(s, F.lit(0.0))).alias(s) for s in SIGNALS if s in raw.columns])
    wide = baseline.groupBy("package").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("median", "mad", "n")))).alias("__b"))
    joined = raw.join(wide, "package", "left")

    def one(s: str) -> Column:
        b = F.col("__b")[s]
        return scoring.normalise(s, F.coalesce(s, F.lit(0.0)), b["median"], b["mad"], F.coalesce(b["n"] >= min_history, F.lit(False))).alias(s)

    return joined.select(*[c for c in raw.columns if c not in SIGNALS], *[one(s) for s in SIGNALS])


def predict(vectors: DataFrame, calibration: tuple[float, float] = (1.0, 0.0), **model) -> DataFrame:
    """Adds z, fragility (0..100) and probability; missing signals count as 0."""
    have = set(vectors.columns)
    signal = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in have else F.lit(0.0)
    a, b = calibration
    out = vectors.withColumn("z", scoring.linear_term(signal, **model))
    return out.withColumn("fragility", F.round(100 * scoring.sigmoid(F.col("z")), 2)).withColumn("probability", F.round(scoring.sigmoid(a * F.col("z") + b), 4))


def with_contributions(vectors: DataFrame) -> DataFrame:
    have = set(vectors.columns)
    return vectors.withColumn("contributions", scoring.contributions(lambda name: F.coalesce(F.col(name), F.lit(0.0)) if name in have else F.lit(0.0)))


def top_contributions(vectors: DataFrame, *keys: str, n: int = 3) -> DataFrame:
    """(keys, place, signal, value): the terms of each row that weigh most, by absolute value; only positive ones are kept in rows."""
    entries = F.transform(F.map_entries("contributions"), lambda e: F.struct((-F.abs(e["value"])).alias("minus"), e["key"].alias("signal"), e["value"].alias("value")))
    top = with_contributions(vectors).select(*keys, F.posexplode(F.slice(F.array_sort(entries), 1, n)).alias("at", "e"))
    return top.select(*keys, (F.col("at") + 1).alias("place"), F.col("e.signal").alias("signal"), F.col("e.value").alias("value"))


def gate(rows: DataFrame, budget: int = 10, min_fragility: float = 70.0, min_consequence: float = 50.0, per: tuple[str, ...] = ("tenant",), order: str = "arrival") -> DataFrame:
    """Adds posture, alert and budget_remaining: the first ``budget`` eligible rows of each tenant, in order of arrival, alert."""
    posture = (F.col("fragility") >= min_fragility) & (F.col("consequence") >= min_consequence)
    out = rows.withColumn("posture", posture).withColumn("__ok", posture & F.col("exposed"))
    used = F.sum(F.col("__ok").cast("long")).over(Window.partitionBy(*per).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("__used", used)
    return out.withColumn("alert", F.col("__ok") & (F.col("__used") <= budget)).withColumn("budget_remaining", F.greatest(F.lit(0), budget - F.col("__used"))).drop("__ok", "__used")


def backtest_rows(incidents: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Normalise, predict and judge each labelled incident; ``features`` is a map of the signals given."""
    given = [F.col("features")[s].alias(s) for s in SIGNALS]
    wide = incidents.select("incident_id", "is_malicious", *given)
    # An absent signal stays out of the model, also where its normal form of 0 isn't 0.
    normal = wide.select("incident_id", "is_malicious", *[F.when(F.col(s).isNotNull(), scoring.normalise(s, F.col(s))).alias(s) for s in SIGNALS])
    hit = F.col("fragility") >= threshold
    bad = F.col("is_malicious")
    outcome = F.when(hit & bad, "TP").when(hit, "FP").when(bad, "FN").otherwise("TN")
    return predict(normal).select("incident_id", "is_malicious", F.round("z", 4).alias("z"), "fragility", "probability", outcome.alias("outcome"))


def backtest_metrics(rows: DataFrame) -> DataFrame:
    """One row: counts, precision and recall (1 where nothing was to be found)."""
    counts = rows.agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "TN", "FN")])
    share = lambda den: F.when(den == 0, 1.0).otherwise(F.round(F.col("tp") / F.nullif(den, F.lit(0)), 4))
    return counts.select("*", share(F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp") + F.col("fn")).alias("recall"))


def evidence(rows: DataFrame) -> DataFrame:
    """(package, document): the evidence contract as JSON; ``rows`` has package, probability and paths."""
    # The disclaimers of the document.
    disclaimer = "Automated analysis of structural posture. This does not assert or imply malicious intent on the part of maintainers."
    doc = F.struct(
        "package",
        "probability",
        F.when(F.col("probability") >= 0.5, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.lit(disclaimer).alias("disclaimer"),
        F.col("paths").alias("dependency_paths"),
        F.size("paths").alias("path_count"),
    )
    return rows.select("package", F.to_json(doc).alias("document"))


def cadence_telemetry(published: DataFrame) -> DataFrame:
    """(package, cadence): last gap over the upper median of all gaps, rounded; 0.1 without one."""
    order = Window.partitionBy("package").orderBy("published_at")
    when = published.select("package", F.col("published_at").cast("timestamp").alias("published_at"))
    gaps = when.select("package", "published_at", _days(F.col("published_at"), F.lag("published_at").over(order)).alias("gap"))
    by_size = Window.partitionBy("package").orderBy(F.col("gap").asc_nulls_last())
    placed = gaps.select("*", (F.row_number().over(by_size) - 1).alias("rank"), F.count("gap").over(Window.partitionBy("package")).alias("n"))
    out = placed.groupBy("package").agg(F.max_by("gap", F.struct("published_at", "gap")).alias("last"), F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2), F.col("gap"))).alias("m"))
    return out.select("package", F.when(F.col("m") > 0, F.round(F.col("last") / F.greatest(F.lit(1.0), F.col("m")), 2)).otherwise(0.1).alias("cadence"))


def _live_features(maintainers, hook, dormant, provenance, churn, drift, cadence, size, entropy) -> Column:
    """The features that live facts stand for, as the model takes them."""
    given = {
        "bus_factor": F.when(maintainers == 1, 2.0).when(maintainers == 2, 1.0).otherwise(0.5),
        "new_install_hook": hook.cast("double"),
        "churn_after_dormancy": dormant.cast("double"),
        "provenance_drift": F.when(provenance == "UNATTESTED", 0.5).otherwise(0.0),
        "trusted_publishing": F.when(provenance == "ATTESTED", 1.0).otherwise(0.0),
        "ownership_churn": F.when(maintainers > 1, churn).otherwise(0.0),
        "repo_drift": drift,
        "cadence_break": cadence,
        "size_delta": size,
        "entropy_spike": entropy,
    }
    return F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.coalesce(v, F.lit(0.0)))])


# Limits and levels of the live rules; features of a project's own root.
DORMANT_DAYS, GAP_DAYS, HIGH_ENTROPY, LARGE_KB = 180, 60, 7.5, 5000
ROOT_FEATURES = {"bus_factor": 1.0, "new_install_hook": 0.0, "churn_after_dormancy": 0.0, "provenance_drift": 0.0, "trusted_publishing": 1.0, "ownership_churn": 0.0, "repo_drift": 0.0, "cadence_break": 0.05, "size_delta": 0.0, "entropy_spike": 0.0}


def live_vector(packages: DataFrame, incidents: DataFrame | None = None, roots: DataFrame | None = None, telemetry: DataFrame | None = None, aggregates: DataFrame | None = None) -> DataFrame:
    """(package, origin, features): the first source that knows a package wins; features go to the model as they are.

    ``packages``: package, has_install_hook, provenance.  ``incidents``: package,
    features.  ``roots``: package.  ``telemetry``: package, maintainer_count,
    has_install_hook, attested, days_dormant, cadence, unpacked_size.
    ``aggregates``: package, maintainer_count, max_gap_seconds, repo_drift, entropy;
    a package that no source knows is rated as one without such facts.
    """
    hook, said = F.coalesce("has_install_hook", F.lit(False)), F.coalesce("provenance", F.lit("UNKNOWN"))
    out, picks = packages, []
    if incidents is not None:
        out = out.join(incidents.groupBy("package").agg(F.max_by("features", "incident_id").alias("known")), "package", "left")
        picks.append(("incident", F.col("known").isNotNull(), F.col("known")))
    if roots is not None:
        out = out.join(roots.select("package").distinct().withColumn("root", F.lit(True)), "package", "left")
        picks.append(("root", F.col("root").isNotNull(), F.create_map(*[F.lit(x) for kv in ROOT_FEATURES.items() for x in kv])))
    if telemetry is not None:
        out = out.join(telemetry.select("package", F.struct("maintainer_count", "has_install_hook", "attested", "days_dormant", "cadence", "unpacked_size").alias("t")), "package", "left")
        t = F.col("t")
        provenance = F.when(F.coalesce(t["attested"], F.lit(False)) | (said == "ATTESTED"), "ATTESTED").otherwise("UNATTESTED")
        size = F.when(t["unpacked_size"] / 1024 > LARGE_KB, 0.5).otherwise(0.05)
        made = _live_features(t["maintainer_count"], hook | F.coalesce(t["has_install_hook"], F.lit(False)), t["days_dormant"] > DORMANT_DAYS, provenance, F.lit(0.3), F.lit(0.0), F.least(F.lit(3.0), t["cadence"]), size, F.lit(0.0))
        picks.append(("telemetry", t.isNotNull(), made))
    if aggregates is not None:
        out = out.join(aggregates.select("package", F.struct("maintainer_count", "max_gap_seconds", "repo_drift", "entropy").alias("a")), "package", "left")
    else:
        out = out.withColumn("a", F.lit(None).cast("struct<maintainer_count:long,max_gap_seconds:double,repo_drift:double,entropy:double>"))
    a = F.col("a")
    gap = F.coalesce(a["max_gap_seconds"], F.lit(0.0)) > 86400 * GAP_DAYS
    spike = F.when(a["entropy"] > HIGH_ENTROPY, 1.5).otherwise(0.0)
    rest = _live_features(F.coalesce(F.nullif(a["maintainer_count"], F.lit(0)), F.lit(1)), hook, gap, said, F.lit(0.3), F.coalesce(a["repo_drift"], F.lit(0.0)), F.lit(0.2), F.lit(0.05), spike)
    picks.append(("aggregates", F.lit(True), rest))
    return out.select("package", F.coalesce(*[F.when(c, F.lit(k)) for k, c, _ in picks]).alias("origin"), F.coalesce(*[F.when(c, f) for _, c, f in picks]).alias("features"))


def predict_live(live: DataFrame, **options) -> DataFrame:
    """package, origin, z, fragility, probability of live vectors, which are not normalised."""
    return predict(live.select("package", "origin", *[F.coalesce(F.col("features")[s], F.lit(0.0)).alias(s) for s in SIGNALS]), **options)
