"""Budgeted choice, parsers, imports and the feed against plain code."""

import json
import random

from chainloom.operators import customer, fragility, graph, reachability
from chainloom.sources import lockfiles, trees
from chainloom.streaming import feed


def plain_choice(options, risk, budget):
    """All options are looked at in each step; the first of equal ratios counts."""
    met, spent, taken = set(), 0.0, []
    while spent < budget:
        gains = [sum(risk[n] for n in set(what) - met) for _, what in options]
        fit = [i for i, (cost, _) in enumerate(options) if i not in taken and spent + cost <= budget and gains[i] > 0]
        if not fit:
            break
        best = max(fit, key=lambda i: (gains[i] / options[i][0], -i))
        taken.append(best)
        met |= set(options[best][1])
        spent += options[best][0]
    alone = [(sum(risk[n] for n in set(what)), -i) for i, (cost, what) in enumerate(options) if cost <= budget]
    if alone and max(alone)[0] > sum(risk[n] for n in met):
        return [-max(alone)[1]]
    return taken


def test_choice_equals_plain_code():
    draw = random.Random(12)
    for _ in range(400):
        risk = {f"p{i}": float(draw.randint(1, 9)) for i in range(draw.randint(1, 12))}
        options = [(draw.choice([1.0, 1.5, 2.0, 4.0]), draw.sample(sorted(risk), draw.randint(0, min(5, len(risk))))) for _ in range(draw.randint(0, 15))]
        budget = draw.choice([0.0, 1.0, 3.5, 10.0])
        assert customer.choose(options, risk, budget) == plain_choice(options, risk, budget)


def test_yarn_forms(spark):
    text = (
        '# yarn lockfile v1\r\n\r\n\r\n"@babel/core@^7.0.0", "@babel/core@^7.1.0":\r\n  version "7.2.0"\r\n  resolved "https://r/x.tgz#abc"\r\n  integrity sha512-z\r\n  dependencies:\r\n    "@babel/types" "^7.2.0"\r\n    debug "^4.1.0"\r\n'
        '  optionalDependencies:\r\n    fsevents "^1.0.0"\r\n\r\ndebug@^4.1.0:\r\n  version "4.1.1"\r\n\r\ndebug@^3.0.0:\r\n  version "3.0.0"\r\n\r\nbare:\r\n  version "1.0.0"\r\n'
    )
    rows = {r["name"]: (r["version"], r["is_direct"], r["dependencies"]) for r in lockfiles.yarn(spark.createDataFrame([("p", text), ("q", None), ("r", "")], "project_id string, content string")).collect()}
    assert rows == {"@babel/core": ("7.2.0", True, {"@babel/types": "^7.2.0", "debug": "^4.1.0"}), "debug": ("4.1.1", True, {})}


def test_pnpm_forms(spark):
    text = "importers:\n  .:\n    dependencies:\n      '@s/a': 1.0.0\n      b: 2.0.0\npackages:\n  /@s/a@1.0.0:\n    dependencies: {b: 2.0.0, n: 3}\n  b@2.0.0: {}\n  /b@2.1.0: null\n  c: {}\n"
    rows = {r["name"]: (r["version"], r["is_direct"], r["dependencies"]) for r in lockfiles.pnpm(spark.createDataFrame([("p", text), ("q", "- a\n- b"), ("r", None), ("s", "x: [")], "project_id string, content string")).collect()}
    assert rows == {"@s/a": ("1.0.0", True, {"b": "2.0.0", "n": "3"}), "b": ("2.1.0", True, {}), "c": ("0.0.0", False, {})}


def test_import_forms(spark):
    """One row for each import, with its line; the golden source and odd forms."""
    code = "\n    import { parse, stringify as str } from 'yaml';\n    import express from 'express';\n    const lodash = require('lodash');\n    const { cloneDeep } = require('lodash/fp');\n    import('./async-dep');\n"
    odd = "import a, {\n b as c,\n d\n} from \"@s/p/q\"\nlet {x, y} = require( '../up' )\nimport * as ns from 'ns'"
    rows = {(r["path"], r["pkg"]): r for r in reachability.merge_index(trees.index_files(spark.createDataFrame([("k", "a.js", code), ("k", "b.js", odd), ("k", "c.js", None)], "path_key string, path string, content string")).withColumnRenamed("path_key", "path")).collect()}
    got = {k: (r["symbols"], r["is_dynamic"], r["is_namespace"], sorted({(s["file"], s["line"]) for s in r["sites"]})) for (_, k), r in rows.items()}
    assert got == {
        "yaml": (["parse", "stringify"], False, False, [("a.js", 2)]), "express": (["default"], False, False, [("a.js", 3)]), "lodash": (["cloneDeep"], True, True, [("a.js", 4), ("a.js", 5)]),
        "async-dep": ([], True, False, [("a.js", 6)]), "@s/p": (["b", "d"], False, False, [("b.js", 1)]), "up": (["x", "y"], True, False, [("b.js", 5)]), "ns": ([], False, True, [("b.js", 6)]),
    }


def test_betweenness_on_cycles_and_parallel_edges(spark):
    """Against counting all shortest paths, on graphs with cycles, parallel edges and loops."""
    draw = random.Random(7)
    names = [f"n{i}" for i in range(9)]
    edges = [(draw.choice(names), draw.choice(names)) for _ in range(24)]
    got = {r["name"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    out = {}
    for s in names:
        depth, paths, level = {s: 0}, {s: 1.0}, [s]
        while level:
            following = {}
            for v in level:
                for a, b in edges:
                    if a == v and b not in depth:
                        following[b] = following.get(b, 0.0) + paths[v]
            for v in following:
                depth[v] = depth[level[0]] + 1
            paths |= following
            level = list(following)
        out[s] = depth, paths
    n = len(names)
    for v in names:
        share = sum(out[s][1][v] * out[v][1][t] / out[s][1][t] for s in names for t in names if len({s, v, t}) == 3 and v in out[s][0] and t in out[v][0] and out[s][0][v] + out[v][0][t] == out[s][0][t])
        assert abs(got[v] - share / ((n - 1) * (n - 2))) < 1e-12


def test_reach_in_batches(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")], "src string, dst string")
    nodes = graph.nodes_of(edges)
    one, many = (sorted(map(tuple, graph.reach(edges, nodes, roots=k).collect())) for k in (100, 2))
    assert one == many and {r[0]: r[1] for r in one} == {"a": 5, "b": 3, "c": 3, "d": 2, "e": 1}


def test_live_vector_without_sources(spark):
    packages = spark.createDataFrame([("p", True, "ATTESTED"), ("event-stream", None, None)], "package string, has_install_hook boolean, provenance string")
    rows = {r["package"]: r for r in fragility.live_vector(packages).collect()}
    assert rows["p"]["origin"] == "aggregates" and rows["p"]["features"]["new_install_hook"] == 1.0 and rows["p"]["features"]["bus_factor"] == 2.0
    from chainloom.sources import corpus

    known = {r["package"]: r for r in fragility.predict_live(fragility.live_vector(packages, corpus.incidents(spark))).collect()}
    assert known["event-stream"]["origin"] == "incident" and known["event-stream"]["fragility"] > 90


def test_feed_repeats_and_nameless_deletions(spark, tmp_path):
    land, out, mark = (str(tmp_path / x) for x in ("land", "out", "mark"))
    (tmp_path / "land").mkdir()
    for name, rows in (("1", [{"seq": "1", "id": "a"}, {"seq": "2", "id": "", "deleted": True}, {"seq": "3", "deleted": True}]), ("2", [{"seq": "1", "id": "a"}, {"seq": "2", "id": "", "deleted": True}, {"seq": "4", "id": "b", "deleted": True}])):
        (tmp_path / "land" / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
        feed.follow(feed.read_feed(spark, land), out, mark)
    rows = sorted((r["number"], r["id"], r["status"]) for r in spark.read.parquet(out).collect())
    assert [(n, s) for n, _, s in rows] == [(1, "processed"), (2, "processed"), (3, "processed"), (4, "marked_unpublished")]


def test_yaml_is_read_in_c_where_it_can_be():
    import yaml

    assert lockfiles.yaml_loader() is (yaml.CSafeLoader if yaml.__with_libyaml__ else yaml.SafeLoader)


def test_choice_holds_no_more_than_what_is_covered():
    """Bits of a number for each option took memory by options times names."""
    import tracemalloc

    n = 6_000
    risk = {f"p{i}": float(i) for i in range(n)}
    options = [(1.5, [p]) for p in risk]
    tracemalloc.start()
    taken = customer.choose(options, risk, 10.0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken == [n - 1, n - 2, n - 3, n - 4, n - 5, n - 6] and most < 2_000_000


def test_plan_of_a_large_project(spark):
    names = [f"p{i:05d}" for i in range(3_000)]
    at_risk = spark.createDataFrame([("a", p, float(i)) for i, p in enumerate(names)] + [("b", "q", 1.0)], "project_id string, name string, risk double")
    options = spark.createDataFrame([("a", "OVERRIDE", p, 1.5, [p], float(i)) for i, p in enumerate(names)] + [("a", "PIN", "p00000", 1.0, names[::2], 0.0)], "project_id string, action string, target string, cost double, covered array<string>, gain double")
    rows = customer.plan(options, at_risk, 3.0).orderBy("step").collect()
    assert [(r["action"], r["target"], len(r["covered"])) for r in rows] == [("PIN", "p00000", 1500), ("OVERRIDE", "p02999", 1)]
    assert {(r["cost_used"], r["eliminated"], len(r["unresolved"]), r["unresolved"][0]) for r in rows} == {(2.5, float(sum(range(0, 3000, 2)) + 2999), 1499, "p00001")}


def test_direct_packages_are_those_of_their_own_lockfile(spark):
    """Two texts of one project; no plan carries the list of direct names along with each package."""
    doc = lambda top: json.dumps({"lockfileVersion": 2, "packages": {"": {"dependencies": {top: "1"}}, "node_modules/a": {"version": "1.0.0"}, "node_modules/b": {"version": "1.0.0"}, "node_modules/b/node_modules/a": {"version": "2.0.0"}}})
    files = spark.createDataFrame([("p", doc("a")), ("q", doc("b")), (None, doc("b"))], "project_id string, content string")
    out = lockfiles.npm(files)
    assert {(r["project_id"], r["name"], r["version"], r["is_direct"]) for r in out.collect()} == {("p", "a", "2.0.0", False), ("p", "b", "1.0.0", False), ("q", "a", "2.0.0", False), ("q", "b", "1.0.0", True), (None, "a", "2.0.0", False), (None, "b", "1.0.0", True)}
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
