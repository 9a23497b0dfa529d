"""Names, addresses and digests as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import let

# Names of dependency kinds and provenances.
KINDS = ("RUNTIME", "DEV", "PEER", "OPTIONAL")
PROVENANCES = ("ATTESTED", "UNATTESTED", "UNKNOWN")
# Script names that run at install time, and endings of native binaries.
HOOKS = ("preinstall", "install", "postinstall")
NATIVE = r"\.(node|so|dll|wasm)$"


def normal_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def purl(ecosystem: Column, name: Column, version: Column | None = None) -> Column:
    base = F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), name)
    return base if version is None else F.concat(base, F.lit("@"), version)


def email_hash(email: Column) -> Column:
    return F.sha2(normal_name(email), 256)


def email_domain(email: Column) -> Column:
    """What follows the last @ of the normalised address; empty without one."""
    return let(normal_name(email), lambda e: F.when(e.contains("@"), F.substring_index(e, "@", -1)).otherwise(""))


def repository(url: Column) -> Column:
    """struct(owner, repo) of a github address, else null."""

    def made(parts: Column) -> Column:
        return F.when(url.contains("github.com") & (F.size(parts) >= 2), F.struct(F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("repo")))

    return let(F.split(F.replace(F.regexp_replace(url, "/+$", ""), F.lit(".git"), F.lit("")), "/"), made)


def sponsor_url(owner: Column, name: Column) -> Column:
    return F.when(owner.isNotNull() & (owner != ""), F.concat(F.lit("https://github.com/sponsors/"), owner)).otherwise(F.concat(F.lit("https://opencollective.com/"), name))


def hooks_of(scripts: Column) -> Column:
    """Install-time script names among the keys of a map."""
    return F.array_intersect(F.array(*[F.lit(h) for h in HOOKS]), F.coalesce(F.map_keys(scripts), F.array().cast("array<string>")))


def has_native(gypfile: Column, files: Column) -> Column:
    return F.coalesce(gypfile, F.lit(False)) | F.coalesce(F.exists(files, lambda f: f.rlike(NATIVE)), F.lit(False))


def import_package(specifier: Column) -> Column:
    """Package of an import path: relative prefixes go, scopes keep two segments."""
    clean = F.regexp_replace(F.trim(specifier), r"^(\.{1,2}/)+", "")
    return let(clean, lambda s: F.when(s.startswith("@"), F.array_join(F.slice(F.split(s, "/"), 1, 2), "/")).otherwise(F.split(s, "/")[0]))


def lock_path_package(path: Column) -> Column:
    return F.element_at(F.split(path, "node_modules/"), -1)


def one_of(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    """The value if it is one of the names allowed, else the fallback."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def instant(text: Column, fallback: Column) -> Column:
    """ISO-8601 text as a timestamp, or the fallback."""
    return F.coalesce(F.try_to_timestamp(text), fallback)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)
