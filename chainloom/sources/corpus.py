"""The labelled incidents that the model is tested on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Published incidents (id, package, version, year, malicious, non-zero signals), and harmless releases.
INCIDENTS = (
    ("event-stream-2018", "event-stream", "3.3.6", 2018, True, {"ownership_churn": 1.0, "churn_after_dormancy": 1.0, "new_install_hook": 1.0, "bus_factor": 2.0, "first_publish_by_new_owner": 1.0, "cadence_break": 2.5, "trusted_publishing": 0.0}),
    ("xz-utils-cve-2024-3094", "xz-utils-embedded", "5.6.1", 2024, True, {"ownership_churn": 1.0, "churn_after_dormancy": 1.0, "repo_drift": 15.0, "bus_factor": 2.0, "cadence_break": 1.5, "size_delta": 0.5, "trusted_publishing": 0.0}),
    ("shai-hulud-v2", "shai-hulud-worm", "2.0.1", 2026, True, {"publisher_portfolio_breadth": 45.0, "new_install_hook": 1.0, "rapid_republish": 1.0, "provenance_drift": 1.0, "ownership_churn": 1.0, "trusted_publishing": 0.0}),
    ("ua-parser-js-2021", "ua-parser-js", "0.7.29", 2021, True, {"rapid_republish": 1.0, "new_install_hook": 1.0, "entropy_spike": 1.8, "cadence_break": 3.0, "trusted_publishing": 0.0}),
    ("chalk-4.1.2-benign", "chalk", "4.1.2", 2021, False, {"bus_factor": 1.0, "publisher_portfolio_breadth": 1.0, "cadence_break": 0.1, "size_delta": 0.02, "trusted_publishing": 1.0}),
    ("express-4.18.2-benign", "express", "4.18.2", 2022, False, {"bus_factor": 1.0, "publisher_portfolio_breadth": 1.0, "cadence_break": 0.2, "size_delta": 0.01, "trusted_publishing": 1.0}),
)
# What happened, the advisory and its other name, by incident.
FACTS = {
    "event-stream-2018": ("Dormancy handover to stranger + malicious preinstall hook (flatmap-stream)", "GHSA-mh6f-8j2x-4483", "CVE-2018-3721"),
    "xz-utils-cve-2024-3094": ("2-year social engineering + tarball repo drift (M4 backdoor)", "CVE-2024-3094", "CVE-2024-3094"),
    "shai-hulud-v2": ("Self-replicating npm worm + preinstall execution + broad portfolio", "DEMO-WORM-2026", "Synthetic Benchmark"),
    "ua-parser-js-2021": ("Account compromise + rapid republish + crypto miner hook", "GHSA-pjwm-rvh2-c87w", "CVE-2021-43616"),
    "chalk-4.1.2-benign": ("Normal bugfix release by trusted maintainer", "BENIGN-CONTROL", "None"),
    "express-4.18.2-benign": ("Normal release by primary maintainer", "BENIGN-CONTROL", "None"),
}
SCHEMA = "incident_id string, package string, version string, year int, is_malicious boolean, features map<string,double>, mechanism string, advisory_id string, cve_id string"


def incidents(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """The corpus, with further rows of the same kind if given."""
    out = spark.createDataFrame([(*row, *FACTS[row[0]]) for row in INCIDENTS], SCHEMA)
    return out if extra is None else out.unionByName(extra, allowMissingColumns=True)
