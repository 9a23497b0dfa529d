from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chainloom.operators import fragility, policy, reachability
from chainloom.sources import corpus, trees


def test_backtest(spark):
    rows = fragility.backtest_rows(corpus.incidents(spark)).collect()
    got = {r["incident_id"]: (r["z"], r["fragility"], r["probability"], r["outcome"]) for r in rows}
    assert got["event-stream-2018"] == (11.7167, 100.0, 1.0, "TP")
    assert got["ua-parser-js-2021"] == (4.05, 98.29, 0.9829, "TP")
    assert got["chalk-4.1.2-benign"] == (-2.3552, 8.67, 0.0867, "TN")
    extra = spark.createDataFrame([("quiet", True, {"bus_factor": 4.0})], "incident_id string, is_malicious boolean, features map<string,double>")
    m = fragility.backtest_metrics(fragility.backtest_rows(corpus.incidents(spark, extra))).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"], m["precision"], m["recall"]) == (4, 0, 2, 1, 1.0, 0.8)


VERSIONS = [
    ("event-stream", "3.3.4", datetime(2016, 1, 10), "A", 100, False, None, "UNATTESTED"),
    ("event-stream", "3.3.5", datetime(2018, 9, 5), "B", 300, False, 7.0, "UNATTESTED"),
    ("event-stream", "3.3.6", datetime(2018, 9, 10), "B", 300, True, 0.0, "UNATTESTED"),
    ("calm", "1.0.0", datetime(2020, 1, 1), None, None, None, None, None),
]
SCHEMA = "package string, version string, published_at timestamp, publisher string, size long, has_install_hook boolean, entropy double, provenance string"


@pytest.mark.parametrize("mode, dormant, hook, first", [("compat", 0.0, 0.0, 0.0), ("point_in_time", 969.0, 0.0, 1.0)])
def test_signals(spark, mode, dormant, hook, first):
    df = spark.createDataFrame(VERSIONS, SCHEMA)
    rows = {(r["package"], r["version"]): r for r in fragility.signals(df, mode=mode).collect()}
    r = rows["event-stream", "3.3.5"]
    assert (r["days_dormant"], r["new_install_hook"], r["first_publish_by_new_owner"]) == (dormant, hook, first)
    assert r["entropy_spike"] == 0.5
    last = rows["event-stream", "3.3.6"]
    assert last["new_install_hook"] == 1.0 and last["days_dormant"] == 5.0 and last["entropy_spike"] == 0.0
    calm = rows["calm", "1.0.0"]
    assert calm["publish_concentration"] == 0.0 and calm["bus_factor"] == 1.0 and calm["publisher_portfolio_breadth"] == 1.0


def test_mad_normalisation(spark):
    raw = spark.createDataFrame([("p", 10.0)], "package string, days_dormant double")
    for s in fragility.SIGNALS:
        if s != "days_dormant":
            raw = raw.withColumn(s, F.lit(0.0))
    base = spark.createDataFrame([("p", "days_dormant", 4.0, 2.0, 5)], "package string, signal string, median double, mad double, n long")
    assert fragility.normalised(raw, base).first()["days_dormant"] == round((10 - 4) / (1.4826 * 2) / 5, 4)
    short = base.withColumn("n", F.lit(2))
    assert fragility.normalised(raw, short).first()["days_dormant"] == 1.0
    long = spark.createDataFrame([("p", x) for x in (1.0, 2.0, 4.0, 9.0)], "package string, value double")
    assert tuple(fragility.mad_baseline(long, "package").first()) == ("p", 3.0, 1.5, 4)


def test_gate(spark):
    rows = [("t", 1, 85.0, 20.0, True), ("t", 2, 85.0, 80.0, False), ("t", 3, 85.0, 80.0, True), ("t", 4, 90.0, 90.0, True), ("t", 5, 90.0, 90.0, True), ("u", 1, 90.0, 90.0, True)]
    df = spark.createDataFrame(rows, "tenant string, arrival long, fragility double, consequence double, exposed boolean")
    got = {(r["tenant"], r["arrival"]): r["alert"] for r in fragility.gate(df, budget=2).collect()}
    assert got == {("t", 1): False, ("t", 2): False, ("t", 3): True, ("t", 4): True, ("t", 5): False, ("u", 1): True}


def test_evidence(spark):
    import json

    doc = fragility.evidence(spark.createDataFrame([("p", 0.88, ["a", "b"]), ("q", 0.2, [])], "package string, probability double, paths array<string>"))
    got = {r["package"]: json.loads(r["document"]) for r in doc.collect()}
    assert got["p"]["confidence"] == "HIGH" and got["p"]["path_count"] == 2 and got["q"]["confidence"] == "MEDIUM" and "malicious" in got["p"]["disclaimer"]


def test_policy(spark):
    rows = [("a", 85.0, 40.0, 1, False, "UNKNOWN", False, "UNKNOWN"), ("b", 90.0, 80.0, 3, False, "UNKNOWN", True, "REACHABLE"), ("c", 10.0, 0.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, consequence double, fragility double, maintainer_count int, has_install_hook boolean, provenance string, kev_listed boolean, reachability string")
    got = {r["name"]: (r["status"], [(v["rule_id"], v["sla_hours"]) for v in r["violations"]]) for r in policy.with_status(policy.violations(df)).collect()}
    assert got["a"] == ("WARN", [("no-unmaintained-critical", None)])
    assert got["b"] == ("BLOCKED", [("block-active-exploitation", 24)])
    assert got["c"] == ("PASS", [])
    assert policy.gate_result(policy.violations(df)).first()["exit_code"] == 1
    rules = policy.load_rules("rules:\n  - {id: x, when: \"not added and fragility >= 80 or consequence < 20\", action: warn, message: m}\n  - {id: y, when: \"__import__('os')\"}\n")
    got = {r["name"]: [v["rule_id"] for v in r["violations"]] for r in policy.violations(df, rules).collect()}
    assert got == {"a": [], "b": ["x"], "c": ["x"]}
    with pytest.raises(ValueError):
        policy.compile_condition("consequence.__class__ == 1")


SOURCE = "import { parse, stringify as str } from 'yaml';\nimport express from 'express';\nconst lodash = require('lodash');\nconst { cloneDeep } = require('lodash/fp');\nimport('./async-dep');\nimport * as ns from '@scope/x/y';\n"


def test_import_index(spark):
    files = spark.createDataFrame([("main.js", SOURCE), ("other.js", "import { dump } from 'yaml'\n"), ("empty.js", None)], "path string, content string")
    rows = {r["pkg"]: r for r in reachability.merge_index(trees.index_files(files)).collect()}
    assert rows["yaml"]["symbols"] == ["dump", "parse", "stringify"] and rows["express"]["symbols"] == ["default"]
    assert rows["lodash"]["is_namespace"] and rows["lodash"]["is_dynamic"] and rows["lodash"]["symbols"] == ["cloneDeep"]
    assert rows["async-dep"]["is_dynamic"] and rows["@scope/x"]["is_namespace"]
    assert [(s["file"], s["line"]) for s in rows["yaml"]["sites"]] == [("main.js", 1), ("other.js", 1)]


def test_read_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("import a from 'b'")
    (tmp_path / "a.ts").write_text("import a from 'b'")
    (tmp_path / "a.txt").write_text("import a from 'c'")
    assert [r["path"].rsplit("/", 1)[1] for r in trees.read_tree(spark, str(tmp_path)).collect()] == ["a.ts"]


def test_verdicts_and_documents(spark):
    import json

    index = spark.createDataFrame([("target-lib", ["safeFunc"], False, False), ("dyn", [], True, False)], "pkg string, symbols array<string>, is_dynamic boolean, is_namespace boolean")
    rows = [
        ("V1", "target-lib", "1.0.0", ["exploitedFunction"], False, False), ("V2", "target-lib", "1.0.0", ["safeFunc"], False, False), ("V3", "target-lib", "1.0.0", ["x"], True, False),
        ("V4", "absent", "1.0.0", ["x"], False, True), ("V5", "absent", "1.0.0", None, None, None), ("V6", "dyn", "1.0.0", ["x"], False, False), ("V7", "dyn", "1.0.0", None, False, False),
    ]
    adv = spark.createDataFrame(rows, "vulnerability string, package string, version string, affected_symbols array<string>, has_install_hook boolean, is_transitive boolean")
    out = reachability.verdicts(adv, index)
    got = {r["vulnerability"]: (r["reachability"], r["confidence"]) for r in out.collect()}
    assert got == {"V1": ("NOT_REACHABLE", "HIGH"), "V2": ("REACHABLE", "HIGH"), "V3": ("REACHABLE_INSTALL", "HIGH"), "V4": ("NOT_REACHABLE", "MEDIUM"), "V5": ("NOT_REACHABLE", "HIGH"), "V6": ("UNKNOWN", "LOW"), "V7": ("REACHABLE", "LOW")}
    vex = json.loads(reachability.openvex(out.withColumn("project_id", F.lit("p")), ("project_id",)).first()["document"])
    status = {s["vulnerability"]["name"]: s["status"] for s in vex["statements"]}
    assert status["V1"] == "not_affected" and status["V3"] == "affected" and status["V4"] == "under_investigation"
    assert len(json.loads(reachability.cyclonedx_vex(out.withColumn("project_id", F.lit("p")), ("project_id",)).first()["document"])["vulnerabilities"]) == 7
    assert len(json.loads(reachability.cyclonedx_vex(out.withColumn("project_id", F.lit("p")), ("project_id",), compat_first_only=True).first()["document"])["vulnerabilities"]) == 1
    scores = spark.createDataFrame([("a", 50.0)], "name string, score double")
    bom = json.loads(reachability.sbom_export(spark.createDataFrame([("a", "p"), ("b", "p")], "name string, project_id string"), scores, ("project_id",)).first()["document"])
    assert [c["properties"][0]["value"] for c in bom["components"]] == ["50.0", "35.0"]


def test_cadence(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("p", t), ("p", t + timedelta(days=2)), ("p", t + timedelta(days=12)), ("q", t)], "package string, published_at timestamp")
    assert {r["package"]: r["cadence"] for r in fragility.cadence_telemetry(df).collect()} == {"p": 1.0, "q": 0.1}


def test_releases_are_not_dealt_by_publisher(spark):
    """Four publishers have nearly all releases, and those without one are a fifth; a join by publisher puts each into one task."""
    import re

    v = spark.createDataFrame([(f"p{i % 5}", str(i), datetime(2024, 1, 1 + i), "ann", 1, False, 5.0, "ATTESTED") for i in range(20)], "package string, version string, published_at timestamp, publisher string, size long, has_install_hook boolean, entropy double, provenance string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in ("compat", "point_in_time"):
            out = fragility.signals(v, mode=mode)
            assert not re.search(r"hashpartitioning\(publisher#\d+, ", out._jdf.queryExecution().executedPlan().toString())
            assert {r["publisher_portfolio_breadth"] for r in out.collect()} == {5.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
