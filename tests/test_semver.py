import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainloom.functions import semver, text


def column(spark, rows, schema, **exprs):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[e.alias(k) for k, e in exprs.items()]).collect()]


def test_parse(spark):
    rows = column(spark, [("1.2.3-alpha.1+build.4",), (" v1 ",), ("x",), (None,)], "v string", p=semver.parse(F.col("v")))
    assert tuple(rows[0][0]) == (1, 2, 3, "alpha.1", "build.4")
    assert tuple(rows[1][0]) == (1, 0, 0, None, None)
    assert rows[2][0] is None and rows[3][0] is None


def test_order(spark):
    rows = [("2.0.0",), ("1.0.0",), ("1.2.4",), ("1.0.0-alpha",), ("1.2.3",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").orderBy(semver.sort_key(F.col("v"))).collect()]
    assert got == ["1.0.0-alpha", "1.0.0", "1.2.3", "1.2.4", "2.0.0"]


@pytest.mark.parametrize(
    "range_, want",
    [("1.2.3", "EXACT"), ("=1.2.3", "EXACT"), ("~1.2.0", "TILDE"), ("^1.2.0", "CARET"), ("*", "WILDCARD"), (">=1.0.0 <2.0.0", "RANGE"), ("npm:foo@^1.0.0", "ALIAS"), ("workspace:*", "WORKSPACE"), ("git+https://x", "GIT"), ("https://x/y.tgz", "URL"), ("", "WILDCARD"), (None, "WILDCARD"), ("latest", "WILDCARD"), ("beta", "RANGE")],
)
def test_classify(spark, range_, want):
    assert column(spark, [(range_,)], "r string", k=semver.classify(F.col("r"))) == [(want,)]


def test_satisfies(spark):
    cases = [
        ("1.2.3", "^1.2.0", True), ("1.9.9", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("9.9.9", "1.x", True), ("9.9.9", "1.0.0 - 2.0.0", True),
        ("1.5.0", "^1.0.0 || ^2.0.0", False), ("1.4.0", "~1", False), ("0.0.1", "^0", False), ("1.0.0-a", "*", False), ("1.5.0", ">=1.0.0 <2.0.0", True), ("2.0.0", ">=1.0.0 <2.0.0", False), ("x", "*", False),
    ]
    got = column(spark, [c[:2] for c in cases], "v string, r string", ok=semver.satisfies(F.col("v"), F.col("r")))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_propagation(spark):
    cases = [("1.2.3", "EXACT", "1.2.4", 0.0), ("^1.2.0", "CARET", "1.3.0", 1.0), ("^1.2.0", "CARET", "2.0.0", 0.0), ("*", "WILDCARD", "9.0.0", 1.0), ("git+x", "GIT", "1.0.0", 0.0)]
    got = column(spark, [c[:3] for c in cases], "r string, k string, v string", p=semver.propagation(F.col("r"), F.col("k"), F.col("v")))
    assert [g[0] for g in got] == [c[3] for c in cases]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 50)] * 3), min_size=1, max_size=20))
def test_a_version_satisfies_itself(spark, versions):
    rows = [(".".join(map(str, v)),) for v in versions]
    got = column(spark, rows, "v string", a=semver.satisfies(F.col("v"), F.concat(F.lit("="), "v")), b=semver.satisfies(F.col("v"), F.concat(F.lit("^"), "v")), c=semver.satisfies(F.col("v"), F.concat(F.lit("~"), "v")))
    assert all(all(r) for r in got)


def test_text_functions(spark):
    rows = column(
        spark, [("https://github.com/own/repo.git/", " A.b@Host.Org ", "../../@s/x/y", "node_modules/a/node_modules/b")], "u string, m string, i string, p string",
        repo=text.repository(F.col("u")), domain=text.email_domain(F.col("m")), pkg=text.import_package(F.col("i")), lock=text.lock_path_package(F.col("p")), purl=text.purl(F.lit("npm"), F.lit("x"), F.lit("1.0.0")),
    )
    assert tuple(rows[0][0]) == ("own", "repo") and rows[0][1:] == ("host.org", "@s/x", "b", "pkg:npm/x@1.0.0")
