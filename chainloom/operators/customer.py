"""Project trees: loading lockfiles as graphs, candidate interventions, the budgeted plan."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..functions.scoring import intervention_cost
from . import graph


def direct_of(parsed: DataFrame) -> DataFrame:
    """(project_id, name) of direct dependencies; where none is marked: those nobody needs, else the first five by name."""
    marked = parsed.where("is_direct").select("project_id", "name")
    bare = parsed.join(marked.select("project_id").distinct(), "project_id", "left_anti")
    needed = bare.select("project_id", F.explode(F.map_keys("dependencies")).alias("name")).distinct()
    free = bare.select("project_id", "name").join(needed, ["project_id", "name"], "left_anti")
    stuck = bare.join(free.select("project_id").distinct(), "project_id", "left_anti")
    five = stuck.groupBy("project_id").agg(F.slice(F.array_sort(F.collect_list("name")), 1, 5).alias("n")).select("project_id", F.explode("n").alias("name"))
    return marked.unionByName(free).unionByName(five)


def load(parsed: DataFrame, root: str = "root") -> tuple[DataFrame, DataFrame]:
    """(packages, edges) of parsed lockfiles.

    packages: project_id, name, version, provenance, is_direct; packages that are
    only needed come in at 1.0.0 and unattested.  edges: project_id, root, src,
    dst, range_raw, range_class; the root points to the direct dependencies.
    """
    parsed = graph.cut_lineage(parsed)  # read once, used by many joins
    direct = direct_of(parsed)
    sound = F.coalesce(F.col("integrity").contains("sha512") | F.col("integrity").contains("sha256"), F.lit(False))
    own = parsed.select("project_id", "name", "version", F.when(sound, "ATTESTED").otherwise("UNATTESTED").alias("provenance"))
    needs = parsed.select("project_id", F.col("name").alias("src"), F.explode("dependencies").alias("dst", "range_raw"))
    extra = needs.select("project_id", F.col("dst").alias("name")).distinct().join(own, ["project_id", "name"], "left_anti").select("project_id", "name", F.lit("1.0.0").alias("version"), F.lit("UNATTESTED").alias("provenance"))
    packages = own.unionByName(extra).join(direct.withColumn("is_direct", F.lit(True)), ["project_id", "name"], "left").withColumn("is_direct", F.coalesce("is_direct", F.lit(False)))
    links = direct.select("project_id", F.lit(root).alias("src"), F.col("name").alias("dst"), F.lit("*").alias("range_raw"), F.lit("CARET").alias("range_class"))
    edges = needs.withColumn("range_class", semver.classify(F.col("range_raw"))).unionByName(links)
    return packages, edges.select("project_id", F.lit(root).alias("root"), "src", "dst", "range_raw", "range_class")


def risks(packages: DataFrame, scores: DataFrame, threshold: float = 60.0, default: float = 40.0, fallback: float = 75.0) -> DataFrame:
    """(project_id, name, risk) of packages at or over the threshold, to one decimal; a project without any gets its last package at ``fallback``.

    The last one is that of the greatest ``at`` (place in the lockfile) if there
    is such a column, else by name.
    """
    rated = packages.join(scores.select("name", "score"), "name", "left").withColumn("risk", F.round(F.coalesce("score", F.lit(default)), 1))
    hot = rated.where(F.coalesce("score", F.lit(default)) >= threshold).select("project_id", "name", "risk")
    last = F.max_by("name", F.struct("at", "name")) if "at" in rated.columns else F.max("name")
    rest = rated.join(hot.select("project_id").distinct(), "project_id", "left_anti").groupBy("project_id").agg(last.alias("name")).withColumn("risk", F.lit(fallback))
    return hot.unionByName(rest)


def candidates(direct: DataFrame, dominated: DataFrame, at_risk: DataFrame) -> DataFrame:
    """(project_id, action, target, cost, covered, gain): what each action on a direct dependency would cover, and overrides."""
    reach = dominated.select("project_id", F.col("node").alias("target"), F.col("dominated").alias("name")).unionByName(direct.select("project_id", F.col("name").alias("target"), "name"))
    covered = reach.join(direct.select("project_id", F.col("name").alias("target")), ["project_id", "target"], "left_semi").join(at_risk, ["project_id", "name"])
    groups = covered.groupBy("project_id", "target").agg(F.array_sort(F.collect_set("name")).alias("covered"), F.sum("risk").alias("gain"))
    on_direct = groups.select("project_id", F.explode(F.array(F.lit("UPGRADE"), F.lit("PIN"), F.lit("REMOVE"))).alias("action"), "target", "covered", "gain")
    over = at_risk.join(direct, ["project_id", "name"], "left_anti").select("project_id", F.lit("OVERRIDE").alias("action"), F.col("name").alias("target"), F.array("name").alias("covered"), F.col("risk").alias("gain"))
    return on_direct.unionByName(over).withColumn("cost", intervention_cost(F.col("action"), F.lit(0), F.lit(0)))


PLAN = "project_id string, step int, action string, target string, cost double, covered array<string>, eliminated double, total double, percentage double, cost_used double, unresolved array<string>"
ACTION_ORDER = {"UPGRADE": 0, "PIN": 1, "REMOVE": 2, "OVERRIDE": 3}


def choose(options: Sequence[tuple], risk: Mapping, budget: float) -> list[int]:
    """Indices of chosen (cost, covered) options: by gain for cost within the budget, or the best single one if that gains more.

    What an option adds only falls as others are taken, so a heap of last known
    ratios suffices: only its top is worked out again.  What doesn't fit the money
    left never will.  What is held goes with the covered packages; sums don't
    depend on their order.
    """
    met: set = set()

    def worth(what) -> float:
        return math.fsum(risk[n] for n in set(what) if n not in met)

    costs, alone = [], []
    for cost, what in options:
        costs.append(cost)
        alone.append(worth(what) if cost <= budget else 0.0)
    heap = [(-alone[i] / cost, i) for i, cost in enumerate(costs) if cost <= budget]
    heapq.heapify(heap)
    best_alone = min((i for _, i in heap), key=lambda i: (-alone[i], i), default=None)
    taken, money = [], budget
    while heap and money > 0:
        stale, i = heap[0]
        fresh = -worth(options[i][1]) / costs[i] if costs[i] <= money else 0.0
        if fresh >= 0:
            heapq.heappop(heap)
        elif fresh > stale:
            heapq.heapreplace(heap, (fresh, i))
        else:
            heapq.heappop(heap)
            taken.append(i)
            met.update(options[i][1])
            money -= costs[i]
    return [best_alone] if best_alone is not None and alone[best_alone] > math.fsum(risk[n] for n in met) else taken


class Options(Sequence):
    """(cost, covered) of each row of a table, where covered are numbers; lists are made as they are asked for."""

    def __init__(self, costs, starts, flat):
        self.costs, self.starts, self.flat = costs, starts, flat

    def __len__(self):
        return len(self.costs)

    def __getitem__(self, i):
        if i >= len(self.costs):
            raise IndexError(i)
        return self.costs[i], self.flat[self.starts[i] : self.starts[i + 1]].tolist()


def plan(options: DataFrame, at_risk: DataFrame, budget: float = 10.0) -> DataFrame:
    """The chosen interventions of each project, in order, with totals.

    The choice is sequential within a project, so a project's candidates meet in
    one task, as Arrow columns; projects are dealt over the cluster.  Ties go to
    direct dependencies by name, upgrades before pins before removals, overrides last.
    """

    def solve(key, cands, rs):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not cands.num_rows:
            return made([])
        # The last risk of a name counts; names in order, so numbers are too.
        known = dict(zip(rs["name"].to_pylist(), rs["risk"].to_pylist()))
        names = sorted(known)
        risk = [known[n] for n in names]
        known = None
        order = pc.sort_indices(
            pa.table({"over": pc.equal(cands["action"], "OVERRIDE").cast(pa.int8()), "target": cands["target"], "rank": pc.index_in(cands["action"], pa.array(sorted(ACTION_ORDER, key=ACTION_ORDER.get)))}),
            [("over", "ascending"), ("target", "ascending"), ("rank", "ascending")],
        )
        rows = cands.select(["action", "target", "cost", "covered"]).take(order).combine_chunks()
        covered = rows["covered"].combine_chunks()
        covered = covered.chunk(0) if isinstance(covered, pa.ChunkedArray) else covered
        flat = pc.index_in(covered.flatten(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        starts = covered.offsets.to_numpy() - covered.offsets[0].as_py()
        choices = Options(rows["cost"].to_pylist(), starts.tolist(), flat)
        picked = choose(choices, risk, budget)
        gone = {p for i in picked for p in choices[i][1]}
        total, got = math.fsum(risk) or 1.0, math.fsum(risk[p] for p in gone)
        spent = sum(choices[i][0] for i in picked)
        left = [n for p, n in enumerate(names) if p not in gone]
        at = lambda c, i: rows[c][i].as_py()
        return made([(key[0].as_py(), k + 1, at("action", i), at("target", i), choices[i][0], [names[p] for p in sorted(choices[i][1])], round(got, 2), round(total, 2), round(got / total * 100, 1), spent, left) for k, i in enumerate(picked)])

    def made(out):
        import pyarrow as pa

        text = pa.string()
        types = (text, pa.int32(), text, text, pa.float64(), pa.list_(text), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(text))
        names = [f.split()[0] for f in PLAN.split(", ")]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    options = options.select("project_id", "action", "target", "cost", "covered")
    return options.groupBy("project_id").cogroup(at_risk.select("project_id", "name", "risk").groupBy("project_id")).applyInArrow(solve, PLAN)


def overrides(plans: DataFrame, placeholder: str = "latest-safe") -> DataFrame:
    """(project_id, overrides): map of eliminated packages to a placeholder version, for a manifest."""
    names = plans.select("project_id", F.explode("covered").alias("name")).distinct()
    return names.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.lit(placeholder).alias("v"))))).alias("overrides"))


def solve(parsed: DataFrame, scores: DataFrame, budget: float = 10.0, threshold: float = 60.0) -> DataFrame:
    """From parsed lockfiles and scores to plans."""
    packages, edges = load(parsed)
    packages = graph.cut_lineage(packages)
    at_risk = graph.cut_lineage(risks(packages, scores, threshold))
    direct = packages.where("is_direct").select("project_id", "name")
    below = graph.dominated_sets(graph.immediate_dominators(edges))
    return plan(candidates(direct, below, at_risk), at_risk, budget)
