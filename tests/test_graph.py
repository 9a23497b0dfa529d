import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import consequence, epochs, graph

SEED = (
    "chalk>ansi-styles chalk>ansi-styles chalk>supports-color chalk>supports-color ansi-styles>color-convert color-convert>color-name supports-color>has-flag express>accepts express>body-parser express>chalk "
    "api-gateway>express web-dashboard>express web-dashboard>chalk auth-service>express payment-api>api-gateway admin-portal>web-dashboard event-stream>flatmap-stream"
)
GOLDEN = {
    "color-name": (13.8832, 100.0, 0), "color-convert": (13.2401, 90.7, 0), "has-flag": (13.1401, 89.3, 1), "ansi-styles": (12.5305, 80.5, 1), "supports-color": (12.443, 79.2, 1), "accepts": (11.7614, 69.3, 1),
    "body-parser": (11.7614, 69.3, 2), "chalk": (11.3325, 63.1, 2), "express": (10.7849, 55.2, 2), "flatmap-stream": (9.1601, 31.7, 2), "api-gateway": (8.5226, 22.5, 2), "web-dashboard": (8.3112, 19.5, 3),
    "admin-portal": (6.9639, 0.0, 3), "auth-service": (6.9639, 0.0, 3), "event-stream": (6.9639, 0.0, 3), "payment-api": (6.9639, 0.0, 3), "xz-utils-embedded": (6.9639, 0.0, 3),
}


def edges(spark, text):
    return spark.createDataFrame([tuple(x.split(">")) for x in text.split()], "src string, dst string")


def test_traversal(spark):
    e = edges(spark, "A>B B>C C>D X>B")
    assert [r[0] for r in graph.direct_dependencies(e, "A").collect()] == ["B"]
    assert {r[0] for r in graph.direct_dependents(e, "B").collect()} == {"A", "X"}
    rows, cut = graph.blast_radius(e, "D")
    assert {r["node"]: r["depth"] for r in rows.collect()} == {"D": 0, "C": 1, "B": 2, "A": 3, "X": 3} and not cut
    rows, cut = graph.blast_radius(e, "D", max_depth=2)
    assert {r["node"] for r in rows.collect()} == {"D", "C", "B"} and cut
    rows, cut = graph.blast_radius(e, "D", max_nodes=2)
    assert rows.count() == 3 and cut
    assert graph.blast_radius(e, "unknown")[0].count() == 0


def test_components_and_condensation(spark):
    e = edges(spark, "1>2 2>3 3>1 3>4 4>5 5>4 6>6")
    scc = graph.components(e, graph.nodes_of(e))
    assert {r["name"]: r["scc"] for r in scc.collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "4", "6": "6"}
    assert [tuple(r) for r in graph.condensed(e, scc).collect()] == [("1", "4")]


def test_golden_scores(spark):
    e = edges(spark, SEED)
    nodes = graph.nodes_of(e, spark.createDataFrame([("xz-utils-embedded",)], "name string"))
    hooks = spark.createDataFrame([("flatmap-stream", True)], "name string, has_install_hook boolean")
    rated = graph.cut_lineage(consequence.scores(consequence.metrics(e, nodes, hooks)))
    tiers = {r["name"]: r["tier"] for r in consequence.poll_tiers(rated).collect()}
    got = {r["name"]: (r["raw"], r["score"], tiers[r["name"]]) for r in consequence.details(rated).collect()}
    assert got == GOLDEN
    top = consequence.watch_index(rated, nodes.withColumn("repo_owner", F.lit(None).cast("string")), hooks, 2).collect()
    assert [r["name"] for r in top] == ["color-name", "color-convert"]


def test_gated_simulation(spark):
    ranges = {("api-gateway", "express"): "^4.18.0", ("auth-service", "express"): "^4.17.0", ("web-dashboard", "express"): "4.18.2"}
    rows = [(s, d, ranges.get((s, d), "^1.0.0")) for s, d in (x.split(">") for x in SEED.split())]
    from chainloom.functions.semver import classify

    e = graph.cut_lineage(spark.createDataFrame(rows, "src string, dst string, range_raw string").withColumn("range_class", classify(F.col("range_raw"))))
    got = {r["name"]: round(r["probability"], 4) for r in graph.gated_reach(e, "express", "4.18.3", 0.6).collect()}
    assert got == {"express": 1.0, "api-gateway": 0.6, "auth-service": 0.6, "payment-api": 0.48}
    assert tuple(graph.simulate(e, "express", "4.18.3").first()) == (6, 4, 33.3)


def test_sketches(spark):
    a = spark.range(0, 500).select(F.lit("a").alias("dst"), F.concat(F.lit("pkg_"), "id").alias("src"))
    b = spark.range(400, 900).select(F.lit("b").alias("dst"), F.concat(F.lit("pkg_"), "id").alias("src"))
    none = spark.createDataFrame([], "name string")
    assert 800 <= graph.merged_estimate(graph.reach_sketches(a.union(b), none)).first()[0] <= 1000


def brute_dominated(root, edges):
    def reach(without):
        seen, stack = set(), [root] if without != root else []
        while stack:
            v = stack.pop()
            if v not in seen and v != without:
                seen.add(v)
                stack += [d for s, d in edges if s == v]
        return seen

    everyone = reach(None)
    return {(d, v) for d in everyone for v in everyone - reach(d) - {d} if d != root}


@pytest.mark.parametrize("seed", range(3))
def test_dominators_against_removal(spark, seed):
    draw = random.Random(seed)
    pairs = [("r", f"n{i}") for i in range(3)] + [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}") for _ in range(22)]
    e = spark.createDataFrame([("p", "r", s, d) for s, d in pairs], "project_id string, root string, src string, dst string")
    idoms = graph.immediate_dominators(e)
    got = {(r["node"], r["dominated"]) for r in graph.dominated_sets(idoms).collect() if r["node"] != "r"}
    assert got == brute_dominated("r", pairs)


def test_dominator_fixture(spark):
    e = spark.createDataFrame([("p", "app", *x.split(">")) for x in "app>libA app>libB libA>dep1 dep1>target libB>dep2".split()], "project_id string, root string, src string, dst string")
    got = {(r["node"], r["dominated"]) for r in graph.dominated_sets(graph.immediate_dominators(e)).collect()}
    assert {("libA", "dep1"), ("libA", "target")} <= got and ("libB", "target") not in got


def test_epochs(spark, tmp_path):
    e, path = edges(spark, "a>b b>a b>c"), str(tmp_path / "epochs")
    row = epochs.build(e, spark.createDataFrame([("z",)], "name string"), path, "e1").first()
    assert (row["num_nodes"], row["num_edges"], row["num_scc_components"]) == (4, 3, 3)
    epochs.build(edges(spark, "a>b"), spark.createDataFrame([], "name string"), path, "e2")
    epochs.promote(spark, path, "e1")
    assert epochs.active(spark, path).count() == 3
    with pytest.raises(KeyError):
        epochs.get(spark, path, "e2")


def test_random_graph_completes(spark):
    draw = random.Random(1)
    rows = [(f"p{draw.randrange(300)}", f"p{draw.randrange(300)}") for _ in range(1200)]
    e = spark.createDataFrame([r for r in rows if r[0] != r[1]], "src string, dst string")
    scc = {r["name"]: r["scc"] for r in graph.components(e, graph.nodes_of(e)).collect()}
    reach = {}
    for s, d in rows:
        if s != d:
            reach.setdefault(s, set()).add(d)

    def walk(v):
        seen, stack = set(), [v]
        while stack:
            for w in reach.get(stack.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    stack.append(w)
        return seen

    full = {v: walk(v) for v in scc}
    assert all(scc[v] == min([v, *(w for w in full[v] if v in full[w])]) for v in scc)


def test_components_are_never_left_over(spark):
    """A chain of cycles whose least names ascend takes a round for each."""
    e = edges(spark, "a>b b>a b>c c>d d>c d>e e>f f>e")
    assert {r["name"]: r["scc"] for r in graph.components(e, graph.nodes_of(e)).collect()} == dict(a="a", b="a", c="c", d="c", e="e", f="e")
    with pytest.raises(RuntimeError):
        graph.components(e, graph.nodes_of(e), max_rounds=1).collect()


def drawn_edges(spark, seed, nodes=24, n=30):
    draw = random.Random(seed)
    rows = [(f"p{draw.randrange(nodes)}", f"p{draw.randrange(nodes)}") for _ in range(n)]
    return spark.createDataFrame(rows, "src string, dst string").repartition(3)


@pytest.mark.parametrize("whole, part", [(200_000, 3), (9, 4_000)])
def test_walks_of_whole_components_equal_joins(spark, monkeypatch, whole, part):
    """Components in tasks, with their roots shared by several tasks, through joins, and both."""
    from chainloom.operators import islands

    monkeypatch.setattr(islands, "SLICE", part)
    monkeypatch.setattr(islands, "WHOLE", whole)
    e = drawn_edges(spark, 5)
    nodes = graph.cut_lineage(graph.nodes_of(e, spark.createDataFrame([("alone",)], "name string")))
    downloads = spark.createDataFrame([("p1", 7), ("p2", 0), ("alone", 5)], "name string, downloads long")
    e, rounded = graph.cut_lineage(e), lambda df, c: sorted((r["name"], round(r[c], 9)) for r in df.collect())
    want = graph.cut_lineage(graph.reach_summary(graph.closure(e, nodes, 4), downloads))
    got = graph.cut_lineage(graph.reach(e, nodes, downloads, 4))
    for c in ("reach", "mean_depth", "max_depth", "weighted_downloads"):
        assert rounded(got, c) == rounded(want, c)
    n = nodes.count()
    for k in (7, None):
        roots = graph.pivots(nodes, k or n).select("name")
        share = {r["name"]: r["share"] * n / (k or n) / ((n - 1) * (n - 2)) for r in graph._shares(e, roots).collect()}
        assert rounded(graph.betweenness(e, nodes, k), "betweenness") == sorted((r["name"], round(share.get(r["name"], 0.0), 9)) for r in nodes.collect())
    scc = {tuple(r) for r in graph.components(e, nodes).collect()}
    assert scc == {tuple(r) for r in graph.components(e, nodes, max_rounds=99).collect()}


def test_work_on_many_components_takes_few_jobs(spark):
    """Rounds and batches must not grow with the number of components and nodes; before, these took 137 jobs and more."""
    pairs = [(f"{c}-{i:02d}", f"{c}-{i + 1:02d}") for c in range(40) for i in range(14)]
    e = graph.cut_lineage(spark.createDataFrame(pairs + [(d, s) for s, d in pairs if s.endswith("07")], "src string, dst string"))
    nodes = graph.cut_lineage(graph.nodes_of(e))
    sc = spark.sparkContext
    for work in (lambda: graph.components(e, nodes).collect(), lambda: graph.reach(e, nodes, roots=100).collect()):
        group = f"few-{random.random()}"
        sc.setJobGroup(group, group)
        work()
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert jobs < 110


def test_detail_counts_paths_from_all_nodes(spark):
    """On a chain of 130 nodes, more than the pivots that other queries take."""
    from chainloom.plans.catalogue import ORACLE_SQL

    n = 130
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n - 1)], "src string, dst string")
    got = {r["name"]: r["betweenness"] for r in consequence.metrics(e, graph.nodes_of(e), k=None).collect()}
    assert all(abs(got[f"n{i}"] - i * (n - 1 - i) / ((n - 1) * (n - 2))) < 1e-12 for i in range(n))
    assert "LIMIT" not in ORACLE_SQL["consequence_detail"]
