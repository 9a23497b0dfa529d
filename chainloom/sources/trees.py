"""Source trees: files to import indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import import_package

# File endings, folders that are left out, and the import patterns.
ENDINGS = r"\.(js|jsx|ts|tsx|mjs|cjs)$"
PRUNED = r"/(node_modules|\.git|dist|build|\.pytest_cache)/"
ESM = r"""import\s+(?:(?:\*\s+as\s+([A-Za-z0-9_$]+))|([A-Za-z0-9_$,\s{}*]+))\s+from\s+['"]([^'"]+)['"]"""
CJS = r"""(?:const|let|var)\s+([A-Za-z0-9_$,\s{}*]+)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)"""
DYNAMIC = r"""(?:import|require)\(\s*['"]([^'"]+)['"]\s*\)"""


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the JavaScript and TypeScript files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.where(F.col("path").rlike(ENDINGS) & ~F.col("path").rlike(PRUNED))


def named(binding: Column) -> Column:
    """Names that a binding in braces takes from a package, before any new name; an empty array without names."""
    listed = F.split(F.regexp_extract(binding, r"(?s)\{(.*)\}", 1), ",")
    return F.filter(F.transform(listed, lambda x: F.regexp_extract(x, r"(?s)^\s*(.*?)(?:\s+as\s.*|\s*:.*|\s*)$", 1)), lambda x: x != "")


def _lines(content: Column, pattern: str) -> Column:
    """Matches of a pattern, each with the number of the line it begins in."""
    every = F.lit("(?m)" + pattern)
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    matches = F.regexp_extract_all(content, every, F.lit(0))
    # Line feeds before a match: those of the gaps up to it and of the matches before it.
    gaps = F.transform(F.split(content, "(?m)" + pattern, -1), feeds)
    upto = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda x, y: x + y)
    return F.transform(matches, lambda m, i: F.struct(m.alias("text"), (1 + upto(gaps, i + 1) + upto(F.transform(matches, feeds), i)).cast("int").alias("line")))


INDEX = ("pkg", "symbols", "is_dynamic", "is_namespace", "sites")


def index_files(files: DataFrame) -> DataFrame:
    """One row for each import with its line; ``merge_index`` unites them.  Extra columns of ``files`` stay as keys.

    Column functions only; a null content has no import.
    """
    keys = [F.col(f"`{c}`") for c in files.columns if c not in ("path", "content")]
    kinds = []
    for pattern, kind in ((ESM, "esm"), (CJS, "cjs"), (DYNAMIC, "dynamic")):
        hit = files.select(*keys, "path", F.explode(_lines(F.col("content"), pattern)).alias("m"))
        part = lambda i, p=pattern: F.regexp_extract("m.text", p, i)
        none, no, yes = F.array().cast("array<string>"), F.lit(False), F.lit(True)
        braces = lambda i: part(i).contains("{")  # noqa: E731, B023
        pkg, symbols, dynamic, namespace = {
            "esm": (part(3), F.when(part(1) != "", none).when(braces(2), named(part(2))).otherwise(F.array(F.lit("default"))), no, part(1) != ""),
            "cjs": (part(2), F.when(braces(1), named(part(1))).otherwise(none), no, ~braces(1)),
            "dynamic": (part(1), none, yes, no),
        }[kind]
        site = F.array(F.struct(F.col("path").alias("file"), F.col("m.line").alias("line")))
        kinds.append(hit.select(*keys, import_package(pkg).alias("pkg"), symbols.alias("symbols"), dynamic.alias("is_dynamic"), namespace.alias("is_namespace"), site.alias("sites")))
    return reduce(DataFrame.unionAll, kinds)
