"""Scores as Column functions: consequence, normalisation, fragility, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the consequence terms and the decay of downloads with depth.
ALPHA = {"reach": 2.0, "downloads": 1.5, "betweenness": 3.0, "depth": 1.0, "hook": 1.5, "asymmetry": 1.2}
GAMMA = 0.8
DEFAULT_DOWNLOADS = 1000

# The fragility model's intercept, weights and interactions.
INTERCEPT = -3.5
WEIGHTS = {
    "churn_after_dormancy": 3.2,
    "repo_drift": 4.5,
    "new_install_hook": 2.8,
    "publisher_portfolio_breadth": 2.2,
    "provenance_drift": 2.2,
    "ownership_churn": 1.5,
    "cadence_break": 1.2,
    "size_delta": 1.2,
    "entropy_spike": 1.5,
    "bus_factor": 1.0,
    "trusted_publishing": 1.0,
    "rapid_republish": 1.5,
    "first_publish_by_new_owner": 1.8,
}
INTERACTIONS = {
    ("ownership_churn", "churn_after_dormancy"): 3.5,
    ("new_install_hook", "publisher_portfolio_breadth"): 2.5,
    ("entropy_spike", "size_delta"): 2.0,
    ("provenance_drift", "ownership_churn"): 2.5,
}

# What the interactions are called among contributions.
INTERACTION_NAMES = {
    ("ownership_churn", "churn_after_dormancy"): "churn_x_dormancy",
    ("new_install_hook", "publisher_portfolio_breadth"): "new_hook_x_portfolio",
    ("entropy_spike", "size_delta"): "entropy_x_size",
    ("provenance_drift", "ownership_churn"): "prov_drift_x_churn",
}

# The signals, those bounded to 0..1, and divisors without a history.
SIGNALS = (
    "bus_factor", "publish_concentration", "ownership_churn", "churn_after_dormancy", "first_publish_by_new_owner", "publisher_portfolio_breadth", "days_dormant", "cadence_break",
    "rapid_republish", "size_delta", "new_install_hook", "entropy_spike", "repo_drift", "provenance_drift", "trusted_publishing",
)
BINARY = ("ownership_churn", "churn_after_dormancy", "first_publish_by_new_owner", "new_install_hook", "rapid_republish", "provenance_drift")
DIVISOR = {"size_delta": 5.0, "entropy_spike": 2.0, "cadence_break": 4.0, "publisher_portfolio_breadth": 20.0}


def sigmoid(x: Column) -> Column:
    """Logistic function that never overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def consequence_raw(reach: Column, downloads: Column, betweenness: Column, mean_depth: Column, hook: Column, out_degree: Column, alpha: dict[str, float] | None = None) -> Column:
    a = ALPHA | (alpha or {})
    return (
        a["reach"] * F.log10(1 + reach)
        + a["downloads"] * F.log10(1 + downloads)
        + a["betweenness"] * betweenness
        + a["depth"] * mean_depth
        + a["hook"] * F.when(hook, 1.5).otherwise(1.0)
        + a["asymmetry"] * F.log10(1 + reach / F.greatest(F.lit(1), out_degree))
    )


def min_max_score(raw: Column, low: Column, high: Column) -> Column:
    """0..100, one decimal; 50 where all are equal."""
    return F.when(high > low, F.round((raw - low) / (high - low) * 100, 1)).otherwise(50.0)


def normalise(feature: str, value: Column, median: Column | None = None, mad: Column | None = None, deep: Column | None = None, z_max: float = 5.0) -> Column:
    """A raw signal as an anomaly in 0..1.  ``deep``: whether the history is long enough for median and deviation."""
    if feature in BINARY:
        return clamp(value)
    if feature == "bus_factor":
        return clamp(1 - (value - 1) / 3)
    if feature == "trusted_publishing":
        return F.when(value > 0.5, 0.0).otherwise(1.0)
    if feature == "repo_drift":
        return F.when(value > 0, F.least(F.lit(1.0), value / 10)).otherwise(0.0)
    shallow = F.least(F.lit(1.0), value / DIVISOR[feature]) if feature in DIVISOR else clamp(value)
    if deep is None:
        return shallow
    return F.when(deep, F.round(clamp((value - median) / (1.4826 * mad), 0.0, z_max) / z_max, 4)).otherwise(shallow)


def linear_term(signal, weights: dict[str, float] | None = None, interactions: dict | None = None, intercept: float = INTERCEPT) -> Column:
    """Intercept, weighted signals and interactions; ``signal(name)`` gives a column without nulls."""
    z = F.lit(intercept)
    for name, w in (weights or WEIGHTS).items():
        z = z + w * signal(name)
    for (a, b), w in (interactions or INTERACTIONS).items():
        z = z + w * signal(a) * signal(b)
    return z


def contributions(signal) -> Column:
    """Map of the positive terms."""
    names = [*WEIGHTS, *(f"interaction:{INTERACTION_NAMES[pair]}" for pair in INTERACTIONS)]
    values = [*(w * signal(n) for n, w in WEIGHTS.items()), *(w * signal(a) * signal(b) for (a, b), w in INTERACTIONS.items())]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values)), lambda _, v: v > 0)


def intervention_cost(action: Column, major_bumps: Column, sites: Column) -> Column:
    few = F.least(F.lit(3), sites)
    return (
        F.when(action == "PIN", 1.0)
        .when(action == "OVERRIDE", 1.5)
        .when(action == "UPGRADE", 2.0 + 3.0 * major_bumps)
        .when(action == "REMOVE", 4.0 + 2.0 * few)
        .when(action == "SWAP", 8.0 + 2.0 * few)
        .when(action == "VENDOR", 12.0)
        .otherwise(2.0)
    )

