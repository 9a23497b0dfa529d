"""Version algebra as Column functions: parse, order, classify ranges, match.

Matching keeps the established, partly lenient behaviour: tokens of a general
range that carry no comparison operator are ignored, alternatives are not
separated, and prerelease identifiers don't take part in comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import let

# The version pattern, and the names of the range classes in order of their numbers.
VERSION = r"^[vV]?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
RANGE_CLASSES = ("EXACT", "TILDE", "CARET", "WILDCARD", "RANGE", "URL", "GIT", "ALIAS", "WORKSPACE")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse(version: Column) -> Column:
    """struct(major, minor, patch, prerelease, build), or null."""

    def made(v: Column) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(v, VERSION, i), F.lit(""))
        number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0))
        fields = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), part(4).alias("prerelease"), part(5).alias("build"))
        return F.when(v.rlike(VERSION), fields)

    return let(strip(version), made)


def core(v: Column) -> Column:
    return F.struct(v["major"], v["minor"], v["patch"])


def sort_key(version: Column) -> Column:
    """Hex text that sorts like the versions: three numbers, final after prerelease, prerelease text."""

    def made(v: Column) -> Column:
        digits = lambda x: F.lpad(F.hex(x), 8, "0")
        tail = F.when(v["prerelease"].isNull(), F.lit("01")).otherwise(F.concat(F.lit("00"), F.hex(F.encode(F.left(v["prerelease"], F.lit(64)), "UTF-8")), F.lit("00")))
        other = F.concat(F.lit("0" * 26), F.hex(F.encode(F.left(version, F.lit(64)), "UTF-8")))
        return F.when(v.isNull(), other).otherwise(F.concat(digits(v["major"]), digits(v["minor"]), digits(v["patch"]), tail))

    return let(parse(version), made)


def order(version: Column) -> Column:
    """A struct that sorts like the versions; cheaper than the hex key."""
    return let(parse(version), lambda v: F.struct(v["major"], v["minor"], v["patch"], F.when(v["prerelease"].isNull(), 1).otherwise(0), F.coalesce(v["prerelease"], F.lit(""))))


def classify(range_: Column) -> Column:
    """Name of the class of a dependency range; null and empty are WILDCARD."""

    def made(s: Column) -> Column:
        starts = lambda *p: F.reduce(F.array(*[s.startswith(x) for x in p]), F.lit(False), lambda a, b: a | b)
        return (
            F.when(F.coalesce(s, F.lit("")) == "", "WILDCARD")
            .when(starts("workspace:"), "WORKSPACE")
            .when(starts("npm:"), "ALIAS")
            .when(starts("git+", "git://", "github:"), "GIT")
            .when(starts("http://", "https://", "file:"), "URL")
            .when(s.isin("*", "latest", "x", "X"), "WILDCARD")
            .when(starts("~"), "TILDE")
            .when(starts("^"), "CARET")
            .when(starts(">", "<") | s.contains("||") | s.contains(" "), "RANGE")
            .when(starts("=") | s.rlike(VERSION), "EXACT")
            .otherwise("RANGE")
        )

    return let(strip(range_), made)


def class_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in RANGE_CLASSES]), name) - 1


def satisfies(version: Column, range_: Column) -> Column:
    """Whether a version lies in a range; an unreadable version never does."""

    def bounded(v: Column, r: Column, same: Column) -> Column:
        pre_ok = v["prerelease"].isNull() | r["prerelease"].isNotNull()
        return F.coalesce(pre_ok & (core(v) >= core(r)) & same, F.lit(False))

    def caret(v: Column, r: Column) -> Column:
        same = (
            F.when(r["major"] > 0, v["major"] == r["major"])
            .when(r["minor"] > 0, (v["major"] == 0) & (v["minor"] == r["minor"]))
            .otherwise((v["major"] == 0) & (v["minor"] == 0) & (v["patch"] == r["patch"]))
        )
        return bounded(v, r, same)

    def tilde(v: Column, r: Column) -> Column:
        return bounded(v, r, (v["major"] == r["major"]) & (v["minor"] == r["minor"]))

    def exact(v: Column, r: Column) -> Column:
        return F.coalesce((core(v) == core(r)) & v["prerelease"].eqNullSafe(r["prerelease"]), F.lit(False))

    def token(v: Column, t: Column) -> Column:
        to = lambda n, test: let(parse(F.substr(t, F.lit(n))), lambda r: F.coalesce(test(core(v), core(r)) & r.isNotNull(), F.lit(False)))
        return (
            F.when(t.startswith(">="), to(3, lambda a, b: a >= b))
            .when(t.startswith(">"), to(2, lambda a, b: a > b))
            .when(t.startswith("<="), to(3, lambda a, b: a <= b))
            .when(t.startswith("<"), to(2, lambda a, b: a < b))
            .otherwise(True)
        )

    def target(s: Column, sign: str) -> Column:
        return parse(F.regexp_replace(s, f"^[{sign}]+", ""))

    def made(x: Column) -> Column:
        v, s, kind = x["v"], x["s"], x["kind"]
        return (
            F.when(v.isNull(), False)
            .when(kind == "WILDCARD", v["prerelease"].isNull())
            .when(kind == "EXACT", let(target(s, "="), lambda r: exact(v, r)))
            .when(kind == "CARET", let(target(s, "\\^"), lambda r: caret(v, r)))
            .when(kind == "TILDE", let(target(s, "~"), lambda r: tilde(v, r)))
            .otherwise(F.forall(F.split(s, r"\s+"), lambda t: token(v, t)))
        )

    return let(F.struct(parse(version).alias("v"), F.coalesce(strip(range_), F.lit("")).alias("s"), classify(range_).alias("kind")), made)


def propagation(range_: Column, range_class: Column, introduced: Column) -> Column:
    """Probability that a range takes up a newly introduced version."""
    return (
        F.when(range_class.isin("EXACT", "GIT", "URL"), 0.0)
        .when(range_class == "WILDCARD", 1.0)
        .otherwise(F.when(satisfies(introduced, range_), 1.0).otherwise(0.0))
    )
