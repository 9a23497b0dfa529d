"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, line_dedup, near_dedup, packing, pii, quality_model, quality_rules, toxicity, wavelet
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: numbers of lines taken out, and length and digest of the text that is left."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_exact", "n_near", F.length(text).cast("long").alias("n_chars_left"), F.md5(text).alias("text_md5"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.fit_languages(docs))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit_pii(docs))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_to_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_packing, op3_decontaminate, op4_quality, op5_near_dedup, op6_line_dedup, op7_language, op8_pii, op9_wavelet, op10_quality_rules)
}



def _rules_sql() -> str:
    """The rules, their cutoffs and the exact binomial tails, written for the second engine."""
    q = quality_rules
    stats = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{rule}' AS rule, {stat} AS x FROM s" for rule, (stat, _) in q.RULES.items())
    grid = ", ".join(f"('{rule}', {k}, {c})" for rule, (_, cutoffs) in q.RULES.items() for k, c in enumerate(cutoffs))
    stratum = "CASE " + " ".join(f"WHEN n_words >= {low} THEN {k}" for k, (low, _) in reversed(list(enumerate(q.STRATA)))) + " END"
    error, risk = 0.05 / (len(q.STRATA) * len(q.RULES)), 0.02 / len(q.RULES)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        cov AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, i + unnest(range(3)) AS i FROM rep) GROUP BY doc_id),
        c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
            (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g'))::BIGINT AS n_capitals FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
        s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {stratum} AS stratum FROM c),
        x AS ({stats}),
        grid(rule, k, cutoff) AS (VALUES {grid}),
        good AS (SELECT x.* FROM x WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
        met AS (SELECT stratum, rule, k, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS r FROM good JOIN grid USING (rule) GROUP BY ALL),
        term AS (SELECT stratum, rule, k, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}::DOUBLE) + (n - i) * ln(1 - {risk}::DOUBLE) AS v FROM (SELECT *, unnest(range(r + 1)) AS i FROM met WHERE r < {risk}::DOUBLE * n)),
        tail AS (SELECT stratum, rule, k, max(top) + ln(sum(exp(v - top))) AS v FROM (SELECT *, max(v) OVER (PARTITION BY stratum, rule, k) AS top FROM term) GROUP BY stratum, rule, k),
        safe AS (SELECT met.*, coalesce(tail.v <= ln({error}::DOUBLE), false) AS ok FROM met LEFT JOIN tail USING (stratum, rule, k)),
        chosen AS (SELECT stratum, rule, min_by(cutoff, k) AS cutoff FROM safe a WHERE ok AND NOT EXISTS (SELECT 1 FROM safe b WHERE b.stratum = a.stratum AND b.rule = a.rule AND b.k > a.k AND NOT b.ok) GROUP BY stratum, rule),
        failed AS (SELECT doc_id, count(*) AS n FROM x JOIN chosen USING (stratum, rule) WHERE x > cutoff GROUP BY doc_id)
        SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed, coalesce(failed.n, 0)::INT AS n_rules_failed, NOT base_failed AND failed.n IS NULL AS kept FROM s LEFT JOIN failed ON failed.doc_id = s.doc_id"""


#: Trained models (op1, op4, op7, op8), tokenizers (op2, op9) and edit distances within texts (op3) can't be expressed in SQL; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        u AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM d),
        l AS (SELECT doc_id, no, lines[no] AS raw, lower(trim(lines[no], ' ' || chr(9) || chr(13))) AS line FROM u),
        e AS (SELECT *, line <> '' AND row_number() OVER (PARTITION BY line ORDER BY doc_id, no) > 1 AS again FROM l),
        f AS (SELECT doc_id, no, line, length(line) AS n FROM e WHERE NOT again AND length(line) >= 20),
        p AS (SELECT a.line AS x, b.line AS y, b.doc_id, b.no FROM (SELECT *, unnest([n - 1, n, n + 1]) AS m FROM f) a JOIN f b ON a.m = b.n AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.no < b.no))
            WHERE left(a.line, a.n // 2) = left(b.line, a.n // 2) OR right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2)),
        near AS (SELECT DISTINCT doc_id, no FROM p WHERE list_bool_or(list_transform(range(0, length(x) + 1), lambda i: left(x, i) = left(y, i) AND (substr(x, i + 2) = substr(y, i + 2) OR substr(x, i + 1) = substr(y, i + 2) OR substr(x, i + 2) = substr(y, i + 1))))),
        g AS (SELECT e.*, near.no IS NOT NULL AS close FROM e LEFT JOIN near ON near.doc_id = e.doc_id AND near.no = e.no),
        t AS (SELECT doc_id, count(*) FILTER (again)::BIGINT AS n_exact, count(*) FILTER (close)::BIGINT AS n_near, coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT again AND NOT close), '') AS text FROM g GROUP BY doc_id)
        SELECT doc_id, n_exact, n_near, length(text)::BIGINT AS n_chars_left, md5(text) AS text_md5 FROM t""",
    "op10_quality_rules": _rules_sql(),
    "op5_near_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
        component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN component c ON c.doc_id = d.doc_id""",
}
