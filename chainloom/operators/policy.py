"""Declarative policy: rules over component columns, compiled to Column expressions.

A rule's condition is a small expression language (names, numbers, strings,
lists, comparisons, in, not, and, or).  It is parsed and checked, never executed.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default rules, and the names that conditions may use.
DEFAULT_RULES = (
    {"id": "no-unmaintained-critical", "when": "consequence > 80 and maintainer_count == 1", "action": "warn", "message": "Single-maintainer dependency on critical path"},
    {"id": "block-new-install-hooks", "when": "has_install_hook and provenance != 'ATTESTED'", "action": "block", "message": "Unattested package with install-time execution script"},
    {"id": "provenance-required-critical", "when": "consequence > 70 and provenance == 'UNATTESTED'", "action": "warn", "message": "High consequence package lacking OIDC provenance attestation"},
    {"id": "block-active-exploitation", "when": "kev_listed and reachability in ['REACHABLE', 'REACHABLE_INSTALL']", "action": "block", "message": "Actively exploited vulnerability (CISA KEV) reachable in application code", "sla_hours": 24},
)
NAMES = ("consequence", "fragility", "maintainer_count", "has_install_hook", "provenance", "kev_listed", "reachability", "added")
DEFAULTS = {"consequence": 0.0, "fragility": 0.0, "maintainer_count": 1, "has_install_hook": False, "provenance": "UNKNOWN", "kev_listed": False, "reachability": "UNKNOWN", "added": False}

COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def load_rules(text: str | None = None) -> list[dict]:
    """Rules of a YAML policy, or the default ones."""
    if not text:
        return [dict(r) for r in DEFAULT_RULES]
    import yaml

    return list((yaml.safe_load(text) or {}).get("rules") or [])


def compile_condition(text: str) -> Column:
    """The condition as a Column; ValueError if it uses anything else than the language above."""

    def make(node) -> Column:
        if isinstance(node, ast.Expression):
            return make(node.body)
        if isinstance(node, ast.BoolOp):
            out = make(node.values[0])
            for v in node.values[1:]:
                out = out & make(v) if isinstance(node.op, ast.And) else out | make(v)
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~make(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return F.lit(-node.operand.value)
        if isinstance(node, ast.Compare):
            left, out = node.left, None
            for op, right in zip(node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)) and all(isinstance(e, ast.Constant) for e in right.elts):
                    test = make(left).isin(*[e.value for e in right.elts])
                    test = ~test if isinstance(op, ast.NotIn) else test
                elif type(op) in COMPARE:
                    test = getattr(make(left), COMPARE[type(op)])(make(right))
                else:
                    raise ValueError(text)
                out, left = test if out is None else out & test, right
            return out
        if isinstance(node, ast.Name) and node.id in NAMES:
            return F.col(node.id)
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
            return F.lit(node.value)
        raise ValueError(f"not allowed in a condition: {ast.dump(node)[:80]} in {text!r}")

    try:
        return make(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(text) from e


def violations(components: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Adds ``violations``: array of (rule_id, action, message, sla_hours).  A null or unreadable condition doesn't fire."""
    rows = components
    for name, value in DEFAULTS.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)) if name in rows.columns else F.lit(value))
    found = []
    for rule in rules if rules is not None else load_rules():
        try:
            fires = compile_condition(str(rule.get("when", "False")))
        except ValueError:
            continue
        sla = F.lit(rule.get("sla_hours")).cast("int")
        found.append(F.when(fires, F.struct(F.lit(rule.get("id", "unknown")).alias("rule_id"), F.lit(rule.get("action", "warn")).alias("action"), F.lit(rule.get("message", "")).alias("message"), sla.alias("sla_hours"))))
    if not found:
        return rows.withColumn("violations", F.expr("CAST(array() AS array<struct<rule_id:string,action:string,message:string,sla_hours:int>>)"))
    return rows.withColumn("violations", F.filter(F.array(*found), lambda v: v.isNotNull()))


def with_status(checked: DataFrame) -> DataFrame:
    """Adds status: BLOCKED, WARN or PASS."""
    has = lambda action: F.exists("violations", lambda v: v["action"] == action)
    return checked.withColumn("status", F.when(has("block"), "BLOCKED").when(F.size("violations") > 0, "WARN").otherwise("PASS"))


def sla_summary(spark, rules: list[dict] | None = None) -> DataFrame:
    """One row: reporting clocks and the number of rules that carry one."""
    rules = rules if rules is not None else load_rules()
    # Hours to early warning, hours to notification, days to the final report.
    return spark.createDataFrame([(24, 72, 14, sum(1 for r in rules if r.get("sla_hours")))], "early_warning_hours int, notification_hours int, final_report_days int, sla_rules int")


def gate_result(checked: DataFrame) -> DataFrame:
    """One row: components, those blocked, and the exit code of a gate."""
    return with_status(checked).agg(F.count("*").alias("components"), F.count_if(F.col("status") == "BLOCKED").alias("blocked")).withColumn("exit_code", F.when(F.col("blocked") > 0, 1).otherwise(0))
