"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Rule statistics come from the whole text.  For each rule and stratum (documents
by number of words) a cutoff is chosen on labelled documents.  A cutoff is safe
if the exact binomial (Clopper-Pearson) upper bound on the share of good documents
it rejects is at most its part of ``risk``.  Risk and error are shared out over the
rules, the error over strata too (Bonferroni), so all rules together reject at most
``risk`` of the good documents of each stratum, at confidence 1 - ``error``.  Within a rule the grid is tested in a fixed sequence from lax to
strict that stops at the first cutoff that isn't safe.  A rule without a safe
cutoff is off in that stratum.

Words are runs of characters other than blank and U+0009 to U+000D.

Defined results: a null or empty text has no words, all statistics 0, and fails
the base rules; repeated rows get equal verdicts; without good labelled documents
every rule is off and the base rules alone decide; statistics of very long texts
cover them whole; ids must be whole numbers; empty tables give no rows.
"""

from __future__ import annotations

from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, one_row_per_id

GAP = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Repeated windows that are looked up one by one.
SHORT = 40

#: Rule: (statistic, grid of cutoffs from strict to lax); a document above its cutoff is rejected.
RULES = {
    "symbols": ("100.0 * n_symbols / greatest(word_chars, 1)", (2, 3, 5, 8, 12, 20, 35)),
    "dup_lines": ("100.0 * n_dup_lines / greatest(n_lines, 1)", (10, 15, 20, 30, 40, 60, 80)),
    "repeats": ("100.0 * n_repeat_words / greatest(n_words, 1)", (5, 8, 12, 16, 20, 30, 40)),
    "long_words": ("1.0 * word_chars / greatest(n_words, 1)", (8, 9, 10, 12, 15, 20, 30)),
    "capitals": ("100.0 * n_capitals / greatest(word_chars, 1)", (5, 8, 12, 20, 30, 50, 80)),
}
STRATA = ((0, 200), (200, 600), (600, 1 << 62))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text, row by row and without a shuffle."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.array_remove(F.split(text, GAP), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"),
    )
    # A window of three words is its 64-bit hash; sorting puts equal ones side by side.
    n = F.size("words")
    windows = F.when(
        n >= 3,
        F.transform(
            F.arrays_zip(F.slice("words", 1, F.greatest(n - 2, F.lit(0))).alias("a"), F.slice("words", 2, F.greatest(n - 2, F.lit(0))).alias("b"), F.slice("words", 3, F.greatest(n - 2, F.lit(0))).alias("c")),
            lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("h", windows)
    base = base.withColumn("s", F.sort_array("h")).withColumn("twice", F.array_distinct(_repeated("s")))
    return base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered("h", "twice").cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_capitals"),
    )


def _repeated(name: str) -> Column:
    """Values of a sorted array that equal their successor."""
    return F.expr(f"filter({name}, (x, i) -> i + 1 < size({name}) AND x = {name}[i + 1])")


def _covered(hashes: str, twice: str) -> Column:
    """Words that lie in a window whose hash is in ``twice``.

    The windows' starts come from look-ups in ``twice`` where it is short, and
    from sorting (hash, start) where it is long, so long texts stay n log n.
    """
    looked_up = f"filter(sequence(0, size({hashes}) - 1), i -> array_contains({twice}, {hashes}[i]))"
    ordered = f"array_sort(transform({hashes}, (x, i) -> struct(x AS h, i AS i)))"
    paired = f"transform(array({ordered}), o -> transform(filter(sequence(0, size(o) - 1), k -> (k > 0 AND o[k].h = get(o, k - 1).h) OR (k + 1 < size(o) AND o[k].h = get(o, k + 1).h)), k -> o[k].i))[0]"
    starts = f"CASE WHEN size({twice}) <= {SHORT} THEN {looked_up} ELSE sort_array({paired}) END"
    walk = f"aggregate({starts}, named_struct('n', 0, 'e', 0), (a, i) -> named_struct('n', a.n + 3 - greatest(a.e - i, 0), 'e', i + 3), a -> a.n)"
    return F.expr(f"CASE WHEN size({twice}) = 0 THEN 0 ELSE {walk} END")


def _stratum() -> Column:
    out = F.lit(0)
    for k, (low, _) in enumerate(STRATA):
        out = F.when(F.col("n_words") >= low, k).otherwise(out)
    return out


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(Binomial(n, p) <= k)."""
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def risk_exceeds(rejected: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound on the rejection rate, at confidence 1 - error, is above ``risk``."""
    return n == 0 or rejected >= risk * n or _log_tail(rejected, n, risk) > log(error)


def fit_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> dict[tuple[int, str], float]:
    """(stratum, rule) -> cutoff, from counts over all good labelled documents.

    The counts are one row for each stratum, whatever the number of documents.
    """
    known = one_row_per_id(labels.select("doc_id", "quality"), "doc_id", "quality").where("quality = 1")
    good = stats.join(known.select("doc_id"), "doc_id", "left_semi").where(~base_failed())
    counts = [F.count("*").alias("n")]
    counts += [F.count_if(F.expr(f"{stat} > {c}")).alias(f"{rule}_{k}") for rule, (stat, grid) in RULES.items() for k, c in enumerate(grid)]
    each, part = error / (len(STRATA) * len(RULES)), risk / len(RULES)
    out = {}
    for row in good.groupBy(_stratum().alias("stratum")).agg(*counts).collect():
        for rule, (_, grid) in RULES.items():
            for k in range(len(grid) - 1, -1, -1):
                if risk_exceeds(row[f"{rule}_{k}"], row["n"], part, each):
                    break
                out[row["stratum"], rule] = grid[k]
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(stats: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """Adds base_failed, n_rules_failed and kept."""
    failed = [
        F.when((_stratum() == stratum) & F.expr(f"{RULES[rule][0]} > {c}"), 1).otherwise(0)
        for (stratum, rule), c in sorted(cutoffs.items())
    ]
    n_failed = sum(failed, F.lit(0))
    return stats.withColumn("base_failed", base_failed()).withColumn("n_rules_failed", n_failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_rules_failed") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """One row for each document: statistics, base_failed, kept.  Texts are read once."""
    stats = cut(rule_statistics(docs), "rules")
    return apply_rules(stats, fit_cutoffs(stats, labels, risk, error))
