import json
from datetime import datetime

from pyspark.sql import functions as F

from chainloom import api
from chainloom.operators import customer, graph, ingest, reports
from chainloom.plans import documents as D
from chainloom.sources import lockfiles
from chainloom.streaming import feed

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 31)


def packument(**more):
    doc = {
        "name": "my-tool", "maintainers": [{"name": "alice", "email": "Alice@Example.org"}], "repository": {"url": "https://github.com/own/my-tool.git"}, "time": {"1.0.0": "2023-05-01T00:00:00Z"},
        "versions": {"1.0.0": {"scripts": {"preinstall": "x"}, "dependencies": {"chalk": "^4.0.0"}, "devDependencies": {"z": "1"}, "files": ["a.node"], "_npmUser": {"name": "alice"}, "dist": {"unpackedSize": 5, "attestations": {"url": "u"}}}},
    }
    return json.dumps(doc | more)


def test_hydrate(spark):
    docs = spark.createDataFrame([(packument(), T1), (packument(maintainers=[{"name": "bob"}]), T2), ('{"no": "name"}', T1), (None, T1)], "content string, observed_at timestamp")
    out = api.hydrate(docs)
    v = out["versions"].first()
    assert v["has_install_hook"] and v["install_hook_kind"] == ["preinstall"] and v["has_native_binary"] and v["provenance"] == "ATTESTED" and v["published_at"] == datetime(2023, 5, 1)
    assert (out["packages"].first()["repo_owner"], out["packages"].first()["repo_name"]) == ("own", "my-tool")
    assert [(r["dependency"], r["range_class"]) for r in out["edges"].distinct().collect()] == [("chalk", "CARET")]
    assert [r["handle"] for r in out["current_maintainers"].collect()] == ["bob"]
    events = out["maintainer_events"].collect()
    assert {(r["event_type"], r["handle"]) for r in events} == {("ADDED", "alice"), ("ADDED", "bob"), ("REMOVED", "alice")}
    assert {r["observation_gap_seconds"] for r in events if r["observed_at"] == T2} == {2592000.0}
    assert out["maintainers"].where("handle = 'alice'").first()["email_domain"] == "example.org"


def test_sole_owner(spark):
    df = spark.createDataFrame([("p", T1, ["a", "b"]), ("p", T2, ["b"]), ("p", datetime(2024, 3, 1), ["b", "c"])], "package string, observed_at timestamp, handles array<string>")
    got = [(r["event_type"], r["handle"]) for r in ingest.maintainer_events(df).where("event_type LIKE 'SOLE%'").orderBy("observed_at").collect()]
    assert got == [("SOLE_OWNER_BEGIN", "b"), ("SOLE_OWNER_END", "b")]


def test_reconcile(spark):
    registry = spark.createDataFrame([("p", v) for v in ("1.0.0", "1.1.0", "1.2.0")] + [("new", "1.0.0")], "package string, version string")
    stored = spark.createDataFrame([("p", "1.0.0")], "package string, version string")
    assert [tuple(r) for r in ingest.reconcile(registry, stored).collect()] == [("p", ["1.1.0", "1.2.0"], 2)]


def test_upserts(spark):
    rows = [("p", 1, "P", 3, "u1"), ("p", 2, "Q", 1, None), ("p", 3, "R", 2, "u3"), ("p", 4, "S", 0, None)]
    df = spark.createDataFrame(rows, "key string, seq long, name string, poll_tier int, repo_url string")
    assert tuple(ingest.upsert(df, ["key"], ingest.PACKAGE_POLICY).select("name", "poll_tier", "repo_url").first()) == ("P", 0, "u3")
    versions = spark.createDataFrame([("p", "2.0.0", 1), ("p", "1.0.0", 2), ("p", "2.0.0-rc.1", 3)], "package string, version string, seq long")
    assert tuple(ingest.latest_written(versions).first()) == ("p", "2.0.0-rc.1", "2.0.0")


def test_blobs(spark, tmp_path):
    path = str(tmp_path / "blobs")
    docs = spark.createDataFrame([("x" * 40, T1), ("x" * 40, T2), ("y", T1)], "content string, observed_at timestamp")
    from chainloom.sources import packuments

    for _ in range(2):
        ingest.write_blobs(packuments.blobs(docs), path)
    assert spark.read.parquet(path).count() == 2
    sha = packuments.blobs(docs).where("size_bytes = 40").first()["sha256"]
    assert bytes(ingest.read_blob(spark, path, sha).first()["content"]) == b"x" * 40


def test_lockfiles(spark):
    for name, parser in (("npm", lockfiles.npm), ("cyclonedx", lockfiles.cyclonedx), ("spdx", lockfiles.spdx), ("yarn", lockfiles.yarn), ("pnpm", lockfiles.pnpm)):
        rows = parser(spark.createDataFrame(D.FILES[name], "project_id string, content string")).collect()
        got = {(r["project_id"], r["name"], r["version"], r["is_direct"], ", ".join(f"{k} {v}" for k, v in sorted(r["dependencies"].items())), r["integrity"]) for r in rows}
        assert got == set(D.EXPECTED[name]), name
    files = spark.createDataFrame([("a", "package-lock.json", json.dumps(D.NPM2)), ("b", "yarn.lock", D.YARN), ("c", "pnpm-lock.yaml", D.PNPM), ("d", None, D.PNPM)], "project_id string, filename string, content string")
    assert {r[0]: r[1] for r in lockfiles.parse_lockfiles(files).groupBy("project_id").count().collect()} == {"a": 2, "b": 2, "c": 3, "d": 3}


def test_solver_golden(spark):
    e = spark.createDataFrame([("p", "root", *x.split(">")) for x in "root>direct1 root>direct2 direct1>vuln1 direct1>vuln2 direct2>vuln3".split()], "project_id string, root string, src string, dst string")
    direct = spark.createDataFrame([("p", "direct1"), ("p", "direct2")], "project_id string, name string")
    risk = spark.createDataFrame([("p", "vuln1", 50.0), ("p", "vuln2", 40.0), ("p", "vuln3", 30.0)], "project_id string, name string, risk double")
    options = customer.candidates(direct, graph.dominated_sets(graph.immediate_dominators(e)), risk)
    (row,) = customer.plan(options, risk, 1.0).collect()
    assert (row["action"], row["target"], row["eliminated"], row["unresolved"], row["percentage"]) == ("PIN", "direct1", 90.0, ["vuln3"], 75.0)
    assert customer.overrides(customer.plan(options, risk, 1.0)).first()["overrides"] == {"vuln1": "latest-safe", "vuln2": "latest-safe"}


def test_load_and_scan(spark):
    files = spark.createDataFrame([("a", "package-lock.json", json.dumps(D.NPM2))], "project_id string, filename string, content string")
    parsed = lockfiles.parse_lockfiles(files)
    packages, edges = customer.load(parsed)
    assert {(r["name"], r["provenance"], r["is_direct"]) for r in packages.collect()} == {("express", "ATTESTED", True), ("chalk", "UNATTESTED", False)}
    assert {(r["src"], r["dst"], r["range_class"]) for r in edges.collect()} == {("root", "express", "CARET"), ("express", "chalk", "CARET")}
    scores = spark.createDataFrame([("chalk", 90.0)], "name string, score double")
    frag = spark.createDataFrame([("chalk", 10.0)], "name string, fragility double")
    got = {r["name"]: (r["consequence"], r["status"]) for r in api.scan(files, scores, frag).collect()}
    assert got == {"express": (35.0, "PASS"), "chalk": (90.0, "WARN")}
    assert api.solve(files, scores).first()["action"] in ("PIN", "OVERRIDE")


def test_diff_and_tiers(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "name string, version string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "name string, version string")
    scores = spark.createDataFrame([("w", 40.0), ("z", 10.0)], "name string, score double")
    got = {r["name"]: (r["change"], r["risk_delta"]) for r in reports.snapshot_diff(a, b, scores).collect()}
    assert got == {"y": ("CHANGED", 0.0), "z": ("REMOVED", -10.0), "w": ("ADDED", 40.0)}
    packages = spark.createDataFrame([(" X ", "npm", 3), ("x", "pypi", 3)], "name string, ecosystem string, poll_tier int")
    tiers = spark.createDataFrame([("x", 0)], "name string, tier int")
    assert sorted((r["ecosystem"], r["poll_tier"]) for r in ingest.apply_tiers(packages, tiers).collect()) == [("npm", 0), ("pypi", 3)]


def test_feed(spark, tmp_path):
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    (tmp_path / "land").mkdir()

    def write(name, rows):
        (tmp_path / "land" / name).write_text("\n".join(json.dumps(r) for r in rows))

    seen = []
    write("1.json", [{"seq": "5", "id": "a"}, {"seq": "6", "id": "b", "deleted": True}, {"seq": "x", "id": "c"}, {"seq": "5", "id": "a"}])
    feed.follow(feed.read_feed(spark, land), out, mark, lambda df: seen.append(df.count()))
    assert feed.offset(spark, out).first()[0] == 6 and seen == [2]
    write("2.json", [{"seq": "3", "id": "b"}, {"seq": "7", "id": ""}])
    feed.follow(feed.read_feed(spark, land), out, mark, lambda df: seen.append(df.count()))
    rows = spark.read.parquet(out)
    assert rows.count() == 5 and feed.offset(spark, out).first()[0] == 7
    state = {r["id"]: r["status"] for r in feed.last_write_wins(rows).collect()}
    assert state == {"a": "hydrated", "b": "marked_unpublished", "": "processed"}


def test_stateful_alerts_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("t", i, i % 3 != 0) for i in range(12)]
    spark.createDataFrame(rows, "tenant string, arrival long, eligible boolean").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("tenant string, arrival long, eligible boolean").json(str(tmp_path / "in"))
    q = feed.running_alerts(stream, 4).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["arrival"] for r in spark.sql("SELECT * FROM alerts WHERE alert").collect()}
    assert got == {1, 2, 4, 5}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "src string, dst string")
    n = spark.createDataFrame([], "name string")
    assert graph.closure(e, n).count() == 0 and graph.components(e, n).count() == 0 and graph.betweenness(e, n).count() == 0
    assert ingest.maintainer_events(spark.createDataFrame([], "package string, observed_at timestamp, handles array<string>")).count() == 0
    assert lockfiles.npm(spark.createDataFrame([], "project_id string, content string")).count() == 0
    assert F is not None
