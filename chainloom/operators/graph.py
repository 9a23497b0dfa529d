"""Dependency-graph operators over ``edges(src, dst)``: src depends on dst.

Parallel edges are kept (they count in degrees and path counts) unless an
operator says otherwise.  Iterations run on DataFrames; each level is
checkpointed, so plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import islands

# The default budget of a traversal.
MAX_NODES = 100_000
MAX_DEPTH = 30
TIMEOUT_S = 30.0


def nodes_of(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct ``name`` of both ends and of an explicit list."""
    out = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    if names is not None:
        out = out.union(names.select("name"))
    return out.distinct()


def project_edges(dependencies: DataFrame, versions: DataFrame, packages: DataFrame) -> DataFrame:
    """Package graph from dependency_edge x package_version x package (twice): one edge for each version that declares it."""
    origin = packages.select(F.col("package_id").alias("from_id"), F.col("name").alias("src"))
    target = packages.select(F.col("package_id").alias("to_package_id"), F.col("name").alias("dst"))
    owner = versions.select(F.col("version_id").alias("from_version_id"), F.col("package_id").alias("from_id"))
    return dependencies.join(owner, "from_version_id").join(origin, "from_id").join(target, "to_package_id").select("src", "dst", "kind", "range_raw", "range_class")


def direct_dependents(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("dst") == name).select(F.col("src").alias("name"))


def direct_dependencies(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("src") == name).select(F.col("dst").alias("name"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, in_degree, out_degree; parallel edges count."""
    ends = edges.select(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("dst", F.lit(1), F.lit(0)))
    ends = ends.unionByName(nodes.select("name", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("name").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


#: Rows of two names and a number up to which a table is broadcast, and roots whose closures are kept at once.
FEW = 100_000
ROOTS = 50_000


def modest(df: DataFrame) -> DataFrame:
    """Broadcast what was counted and is small; else leave the join to the planner."""
    return F.broadcast(df) if df.count() <= FEW else df


def closure_levels(edges: DataFrame, roots: DataFrame, max_depth: int | None = MAX_DEPTH, reverse: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """Levels (root, node, depth, paths) from each root, nearest first, and the steps (node, next, ways) they took.

    The frontier meets the edges, rows already found are taken out by an anti
    join, and path counts are combined before the shuffle ends.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    ways = F.sum("ways") if "ways" in edges.columns else F.count("*").cast("double")
    steps = modest(cut_lineage(edges.groupBy(F.col(near).alias("node"), F.col(far).alias("next")).agg(ways.alias("ways"))))
    level = cut_lineage(roots.select(F.col("name").alias("root"), F.col("name").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths")).distinct())
    levels = [level]
    seen = level.select("root", "node")
    while max_depth is None or len(levels) <= max_depth:
        reached = level.join(steps, "node").groupBy("root", F.col("next").alias("node")).agg(F.sum(F.col("paths") * F.col("ways")).alias("paths"))
        level = cut_lineage(reached.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(len(levels)).alias("depth"), "paths"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionAll(level.select("root", "node"))
    return levels, steps


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = MAX_DEPTH, reverse: bool = True, with_self: bool = True) -> DataFrame:
    """(root, node, depth, paths): shortest depth and number of shortest paths from each root.

    ``reverse`` walks from a package to its dependents.  All pairs are what is
    asked for; ``reach`` needs only their sums.
    """
    levels, _ = closure_levels(edges, roots, max_depth, reverse)
    return reduce(DataFrame.unionAll, levels if with_self or len(levels) == 1 else levels[1:]).where("true" if with_self else "depth > 0")


def reach(edges: DataFrame, nodes: DataFrame, downloads: DataFrame | None = None, max_depth: int | None = MAX_DEPTH, roots: int = ROOTS, pieces: islands.Pieces | None = None, gamma: float = 0.8, default_downloads: int = 1000) -> DataFrame:
    """``reach_summary`` of all nodes.

    Weakly connected components are walked whole in tasks, which keep sums only.
    Of what is too large for that, ``roots`` nodes at a time go through joins, so
    pairs of one batch are all that is ever kept.  ``pieces``: the edges as
    ``islands.split`` gives them.
    """
    pieces = pieces or islands.split(edges)
    known = downloads.groupBy("name").agg(F.max("downloads").alias("weight")) if downloads is not None else None
    inner = pieces.inner if known is None else islands.weighed(pieces.inner, known)
    found = islands.reach(inner, max_depth, gamma, float(default_downloads))
    if pieces.outer is not None:
        far = cut_lineage(nodes_of(pieces.outer).join(nodes, "name", "left_semi"))
        batches = max(1, -(-far.count() // roots))
        for b in range(batches):
            mine = far.where(F.pmod(F.xxhash64("name"), F.lit(batches)) == b) if batches > 1 else far
            found = found.unionByName(cut_lineage(reach_summary(closure(pieces.outer, mine, max_depth), downloads, gamma, default_downloads)))
    everyone = nodes.select("name").distinct()
    if known is not None:
        everyone = everyone.join(known, "name", "left")
    alone = F.coalesce(F.col("weight") if known is not None else F.lit(None), F.lit(default_downloads)).cast("double")
    out = everyone.join(found, "name", "left")
    return out.select("name", F.coalesce("reach", F.lit(1)).cast("long").alias("reach"), F.coalesce("mean_depth", F.lit(0.0)).alias("mean_depth"), F.coalesce("max_depth", F.lit(0)).cast("int").alias("max_depth"), F.coalesce("weighted_downloads", alone).alias("weighted_downloads"))


def blast_radius(edges: DataFrame, name: str, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH, timeout_s: float = TIMEOUT_S) -> tuple[DataFrame, bool]:
    """(node, depth) of all that depends on ``name``, itself included, and whether a budget cut it short.

    Past ``max_nodes`` the nearest nodes are kept, by name where depth is equal.
    An unknown name gives no rows.
    """
    began, truncated = time.monotonic(), False
    level = cut_lineage(nodes_of(edges).where(F.col("name") == name).select(F.col("name").alias("node"), F.lit(0).alias("depth")))
    seen, count, depth = level, level.count(), 0
    while count:
        following = cut_lineage(edges.join(level.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(depth + 1).alias("depth")))
        n = following.count()
        if not n:
            break
        if depth == max_depth or time.monotonic() - began > timeout_s:
            truncated = True
            break
        level, seen, count, depth = following, seen.unionAll(following), count + n, depth + 1
        if count - 1 > max_nodes:
            truncated = True
            seen = seen.orderBy("depth", "node").limit(max_nodes + 1)
            break
    return seen, truncated


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(name, scc): strongly connected components, named by their least member.

    Weakly connected components that fit a task are solved there.  In larger ones,
    nodes without an incoming or outgoing edge are components of their own and
    are trimmed first.  Then labels spread forwards to a fixpoint; what reaches
    the node that gave its label, within the label, is that node's component.
    Each round finds one component at least, so rounds end by themselves; if
    ``max_rounds`` is given, all edges go through rounds, and edges that are left
    after them are an error.
    """
    done, rounds, left = None, 0, edges
    if max_rounds is None:
        pieces = islands.split(edges)
        done, left = cut_lineage(islands.strong(pieces.inner)), pieces.outer
    left = None if left is None else cut_lineage(left.where("src <> dst").select("src", "dst").distinct())
    while left is not None:
        while True:  # trim
            before = left.count()
            if not before:
                break
            heads, tails = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            left = cut_lineage(left.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
            if left.count() == before:
                break
        if left.isEmpty():
            break
        if rounds == max_rounds:
            raise RuntimeError(f"components are left after {max_rounds} rounds")
        rounds += 1
        label = cut_lineage(nodes_of(left).select("name", F.col("name").alias("label")))
        while True:
            sent = left.join(label, left["src"] == label["name"]).groupBy(F.col("dst").alias("name")).agg(F.min("label").alias("sent"))
            new = cut_lineage(label.join(sent, "name", "left").select("name", F.least("label", F.coalesce("sent", "label")).alias("label"), (F.col("sent") < F.col("label")).alias("moved")))
            stop = new.where("moved").isEmpty()
            label = new.drop("moved")
            if stop:
                break
        within = left.join(label.withColumnRenamed("name", "src"), "src").join(label.select(F.col("name").alias("dst"), F.col("label").alias("other")), "dst").where("label = other")
        within = cut_lineage(within.select("src", "dst", "label"))
        found = front = cut_lineage(label.where("name = label"))
        while True:
            back = within.join(front.select(F.col("name").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("name"), "label").distinct()
            front = cut_lineage(back.join(found, ["name", "label"], "left_anti"))
            if front.isEmpty():
                break
            found = found.unionAll(front)
        found = cut_lineage(found)
        done = found if done is None else done.unionAll(found)
        gone = found.select("name")
        left = cut_lineage(left.join(gone.withColumnRenamed("name", "src"), "src", "left_anti").join(gone.withColumnRenamed("name", "dst"), "dst", "left_anti").select("src", "dst"))
    everyone = nodes_of(edges, nodes)
    if done is None:
        return everyone.select("name", F.col("name").alias("scc"))
    least = done.join(done.groupBy("label").agg(F.min("name").alias("least")), "label").select("name", F.col("least").alias("scc"))
    return everyone.join(least, "name", "left").select("name", F.coalesce("scc", "name").alias("scc"))


def condensed(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(src, dst) between different components, without duplicates."""
    a = scc.select(F.col("name").alias("src"), F.col("scc").alias("a"))
    b = scc.select(F.col("name").alias("dst"), F.col("scc").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def pivots(nodes: DataFrame, k: int = 100) -> DataFrame:
    """All nodes up to ``k``, else the first ``k`` by a digest of the name."""
    return nodes.orderBy(F.md5("name"), "name").limit(k)


def betweenness(edges: DataFrame, nodes: DataFrame, k: int | None = 100, roots: int = ROOTS, pieces: islands.Pieces | None = None) -> DataFrame:
    """(name, betweenness): share of shortest forward paths, from the pivots, that pass each node; without ``k`` from all nodes.

    Weakly connected components are walked whole in tasks; ``_shares`` does the
    rest.  ``pieces``: the edges as ``islands.split`` gives them.
    """
    n = nodes.count()
    if n <= 1:
        return nodes.select("name", F.lit(0.0).alias("betweenness"))
    from_ = nodes.select("name") if k is None or k >= n else cut_lineage(pivots(nodes, k).select("name"))
    pieces = pieces or islands.split(edges)
    found = [islands.shares(islands.marked(pieces.inner, from_))]
    if pieces.outer is not None:
        far = cut_lineage(nodes_of(pieces.outer).join(from_, "name", "left_semi"))
        batches = max(1, -(-far.count() // roots))
        for b in range(batches):
            found.append(_shares(pieces.outer, far.where(F.pmod(F.xxhash64("name"), F.lit(batches)) == b)))
    scale = (n / min(k or n, n)) / max(1, (n - 1) * (n - 2))
    share = reduce(DataFrame.unionAll, found).groupBy("name").agg(F.sum("share").alias("share"))
    return nodes.join(share, "name", "left").select("name", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))


def _shares(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, share) of the roots' shortest paths, level by level.

    One closure from the roots gives depths and path counts.  Going back from the
    deepest level, a node hands what depends on it, and itself, to its
    predecessors in proportion to their paths; so a row for each root and node is
    all that is held.
    """
    levels, steps = closure_levels(edges, roots, None, reverse=False)
    below, found = None, []
    for level in reversed(levels[1:]):
        here = level.select("root", "node", "paths")
        here = here.withColumn("held", F.lit(0.0)) if below is None else here.join(below, ["root", "node"], "left").withColumn("held", F.coalesce("held", F.lit(0.0)))
        here = cut_lineage(here)
        found.append(here.select(F.col("node").alias("name"), F.col("held").alias("share")))
        handed = here.select("root", F.col("node").alias("next"), ((1 + F.col("held")) / F.col("paths")).alias("each"))
        above = levels[len(levels) - len(found) - 1].select("root", "node", F.col("paths").alias("own"))
        below = handed.join(steps, "next").select("root", "node", (F.col("each") * F.col("ways")).alias("part")).join(above, ["root", "node"]).groupBy("root", "node").agg(F.sum(F.col("own") * F.col("part")).alias("held"))
    if not found:
        return roots.select("name", F.lit(0.0).alias("share")).where("false")
    return cut_lineage(reduce(DataFrame.unionAll, found).groupBy("name").agg(F.sum("share").alias("share")))


def reach_summary(reached: DataFrame, downloads: DataFrame | None = None, gamma: float = 0.8, default_downloads: int = 1000) -> DataFrame:
    """name, reach, mean_depth, max_depth, weighted_downloads from a reverse closure."""
    rows = reached.withColumnRenamed("root", "name")
    if downloads is not None:
        rows = rows.join(downloads.select(F.col("name").alias("node"), "downloads"), "node", "left")
    else:
        rows = rows.withColumn("downloads", F.lit(None).cast("long"))
    weight = F.coalesce("downloads", F.lit(default_downloads)) * F.pow(F.lit(gamma), F.col("depth"))
    return rows.groupBy("name").agg(F.count("*").alias("reach"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"), F.sum(weight).alias("weighted_downloads"))


def reach_sketches(edges: DataFrame, nodes: DataFrame, lg_k: int = 10) -> DataFrame:
    """(name, sketch): mergeable sketch of a node and its direct dependents."""
    members = edges.select(F.col("dst").alias("name"), F.col("src").alias("member")).union(nodes.select("name", "name"))
    return members.groupBy("name").agg(F.hll_sketch_agg("member", lg_k).alias("sketch"))


def merged_estimate(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def gated_reach(edges: DataFrame, name: str, version: str, damping: float = 0.5, max_hops: int = 2, hop_factor: float = 0.8) -> DataFrame:
    """(name, probability): who takes up ``version`` of ``name``.

    ``edges`` has range_raw and range_class.  Direct consumers take it up if one
    of their ranges does, damped; further hops carry ``hop_factor`` of it to
    packages not met before.
    """
    from ..functions.semver import propagation

    seen = edges.sparkSession.createDataFrame([(name, 1.0)], "name string, probability double")
    p = propagation(F.col("range_raw"), F.col("range_class"), F.lit(version)) * damping
    level = edges.where((F.col("dst") == name) & (F.col("src") != name)).groupBy(F.col("src").alias("name")).agg(F.max(p).alias("probability")).where("probability > 0")
    level = cut_lineage(level)
    seen = seen.unionAll(level)
    for _ in range(max_hops - 1):
        carried = edges.join(level.withColumnRenamed("name", "dst"), "dst").groupBy(F.col("src").alias("name")).agg((F.max("probability") * hop_factor).alias("probability"))
        level = cut_lineage(carried.join(seen, "name", "left_anti"))
        seen = seen.unionAll(level)
    return seen


def simulate(edges: DataFrame, name: str, version: str, damping: float = 0.6, threshold: float = 0.1) -> DataFrame:
    """One row: naive and gated numbers of affected packages and the noise reduction in percent."""
    naive, _ = blast_radius(edges, name)
    gated = gated_reach(edges, name, version, damping)
    counts = naive.agg(F.count("*").alias("naive")).join(gated.agg(F.count_if(F.col("probability") >= threshold).alias("gated")))
    return counts.select("naive", "gated", F.round((1 - F.col("gated") / F.greatest(F.lit(1), F.col("naive"))) * 100, 1).alias("noise_reduction"))


def pruned(edges: DataFrame, name: str, version: str, damping: float = 0.6, threshold: float = 0.1) -> DataFrame:
    """Nodes in the naive radius that the gates rule out."""
    naive, _ = blast_radius(edges, name)
    gated = gated_reach(edges, name, version, damping).where(F.col("probability") >= threshold)
    return naive.select(F.col("node").alias("name")).join(gated, "name", "left_anti")


def immediate_dominators(edges: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, node, idom) of rooted graphs ``edges(key, src, dst)`` with root ``root``; unreachable nodes and the root have null.

    One graph fits a task by nature (a project's tree); there are many of them,
    so graphs are dealt over the cluster by key.  Dominators are found by the
    iterative two-finger method over reverse postorder.
    """
    kind = dict(edges.dtypes)[key]

    def solve(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        root = table["root"][0].as_py()
        whole = table.filter(pc.and_(pc.is_valid(table["src"]), pc.is_valid(table["dst"])))
        ends = [whole[c].combine_chunks() for c in ("src", "dst")]
        # Nodes are numbers by their names' order.
        names = sorted({root}.union(*(pc.unique(e).to_pylist() for e in ends)))
        among = pa.array(names, pa.string())
        src, dst = (pc.index_in(e, among).to_pylist() for e in ends)
        top, children = names.index(root), {}
        for s, d in zip(src, dst):
            children.setdefault(s, []).append(d)
        idom = dominators(top, children)
        above = [names[idom[i]] if i in idom and i != top else None for i in range(len(names))]
        return pa.table([pa.array([table[key][0].as_py()] * len(names), table.schema.field(key).type), among, pa.array(above, pa.string())], names=[key, "node", "idom"])

    return edges.select(key, "root", "src", "dst").groupBy(key).applyInArrow(solve, f"{key} {kind}, node string, idom string")


def dominators(root, children: dict) -> dict:
    """node -> immediate dominator of all nodes that ``root`` reaches (root maps to itself)."""
    order, stack, met = [], [(root, iter(children.get(root, ())))], {root}
    while stack:
        node, rest = stack[-1]
        for child in rest:
            if child not in met:
                met.add(child)
                stack.append((child, iter(children.get(child, ()))))
                break
        else:
            order.append(node)
            stack.pop()
    number = {v: i for i, v in enumerate(order)}
    parents: dict[str, list] = {}
    for s in order:
        for d in children.get(s, ()):
            parents.setdefault(d, []).append(s)
    idom = {root: root}
    changed = True
    while changed:
        changed = False
        for v in reversed(order[:-1]):
            best = None
            for p in parents.get(v, ()):
                if p in idom:
                    a, b = p, best if best is not None else p
                    while a != b:
                        while number[a] < number[b]:
                            a = idom[a]
                        while number[b] < number[a]:
                            b = idom[b]
                    best = a
            if best is not None and idom.get(v) != best:
                idom[v], changed = best, True
    return idom


def dominated_sets(idoms: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, node, dominated): every node strictly below another in the dominator tree."""
    up = cut_lineage(idoms.where("idom IS NOT NULL").select(key, F.col("idom").alias("node"), F.col("node").alias("dominated")))
    level, out = up, up
    parent = up.select(key, F.col("dominated").alias("node"), F.col("node").alias("above"))
    while True:
        level = cut_lineage(level.join(parent, [key, "node"]).select(key, F.col("above").alias("node"), "dominated"))
        if level.isEmpty():
            return out
        out = out.unionAll(level)


def links(edges: DataFrame) -> DataFrame:
    """Links of the graph export: source, target, range and its class, and how many versions declare it."""
    return edges.groupBy(F.col("src").alias("source"), F.col("dst").alias("target"), "range_raw", "range_class").agg(F.count("*").alias("n"))


def node_link(edges: DataFrame, nodes: DataFrame, scores: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes of the graph export: name, score, degrees, install hook, provenance."""
    return (
        degrees(edges, nodes)
        .join(scores.select("name", "score"), "name", "left")
        .join(facts.select("name", "has_install_hook", "provenance"), "name", "left")
        .select("name", F.coalesce("score", F.lit(0.0)).alias("score"), "in_degree", "out_degree", F.coalesce("has_install_hook", F.lit(False)).alias("has_install_hook"), F.coalesce("provenance", F.lit("UNKNOWN")).alias("provenance"))
    )
