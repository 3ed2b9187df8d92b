"""Supply chain: manifests, advisories, licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a licence text must contain, in the order in which it is tried.
LICENSE_MARKS = (
    ("MIT", ("mit license",)),
    ("Apache-2.0", ("apache license", "version 2.0")),
    ("BSD-3-Clause", ("bsd", "3-clause")),
    ("BSD-2-Clause", ("bsd", "2-clause")),
    ("ISC", ("isc license",)),
    ("GPL-3.0", ("gnu general public license", "version 3")),
    ("GPL-2.0", ("gnu general public license", "version 2")),
    ("LGPL-3.0", ("gnu lesser general public license", "version 3")),
    ("LGPL-2.1", ("gnu lesser general public license", "version 2.1")),
    ("MPL-2.0", ("mozilla public license", "version 2.0")),
    ("AGPL-3.0", ("gnu affero general public license",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("creative commons zero",)),
)
# Category of each licence.
LICENSE_CATEGORIES = {
    "MIT": "permissive", "Apache-2.0": "permissive", "BSD-3-Clause": "permissive", "BSD-2-Clause": "permissive", "ISC": "permissive",
    "GPL-3.0": "strong_copyleft", "GPL-2.0": "strong_copyleft", "LGPL-3.0": "weak_copyleft", "LGPL-2.1": "weak_copyleft", "MPL-2.0": "weak_copyleft",
    "AGPL-3.0": "strong_copyleft", "Unlicense": "public_domain", "CC0-1.0": "public_domain",
}


def license_id(text: Column) -> Column:
    """The first licence whose marks are all in the text, whatever their case; null without any."""
    low, out = F.lower(text), None
    for name, marks in LICENSE_MARKS:
        fits = F.lit(True)
        for m in marks:
            fits = fits & F.contains(low, F.lit(m))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def license_category(spdx: Column) -> Column:
    from ..functions.severity import case

    return F.coalesce(case(spdx, LICENSE_CATEGORIES), F.lit("unknown"))


def license_allowed(spdx: Column, category: Column, allowed: Sequence[str] = (), denied: Sequence[str] = (), allowed_categories: Sequence[str] = (), denied_categories: Sequence[str] = (), allow_unknown: bool = False) -> Column:
    """Denials first, then allowances, then unknown licences; anything else is denied."""
    return (
        F.when(spdx.isin(*denied), False).when(category.isin(*denied_categories), False)
        .when(spdx.isin(*allowed), True).when(category.isin(*allowed_categories), True)
        .when(category == "unknown", allow_unknown).otherwise(False)
    )


def license_risk(spdx: Column, category: Column, denied: Sequence[str] = (), denied_categories: Sequence[str] = ()) -> Column:
    return F.when(spdx.isin(*denied), "critical").when(category.isin(*denied_categories), "high").when(category.isin("unknown", "strong_copyleft"), "medium").otherwise("low")


def dependencies(manifests: DataFrame) -> DataFrame:
    """``file_path, name, version, ecosystem`` of requirements.txt, package.json, go.mod and Cargo.toml texts.

    ``manifests`` has file_path and content. Block formats carry the last header down the lines.
    """
    name = F.element_at(F.split("file_path", "/"), -1)
    m = manifests.withColumn("_name", name)
    lines = m.where(F.col("_name").isin("requirements.txt", "go.mod", "Cargo.toml")).select("file_path", "_name", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    pip = lines.where("_name = 'requirements.txt' AND line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, '-')")
    req = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?=?\s*([0-9A-Za-z.*+!-]+))?"
    pip = pip.select("file_path", F.regexp_extract("line", req, 1).alias("name"), F.nullif(F.regexp_extract("line", req, 2), F.lit("")).alias("version"), F.lit("PyPI").alias("ecosystem")).where("name <> ''")
    w = Window.partitionBy("file_path").orderBy("pos")
    block = F.when(F.col("line").rlike(r"^require\s*\("), "require").when(F.col("line") == ")", "").when(F.col("line").rlike(r"^\["), F.regexp_extract("line", r"^\[([^\]]+)\]", 1))
    blocks = lines.where("_name <> 'requirements.txt'").withColumn("block", F.coalesce(F.last(block, ignorenulls=True).over(w), F.lit("")))
    go = r"^(?:require\s+)?([^\s()]+)\s+v([^\s]+)"
    gomod = blocks.where("_name = 'go.mod' AND (block = 'require' OR startswith(line, 'require '))").select("file_path", F.regexp_extract("line", go, 1).alias("name"), F.regexp_extract("line", go, 2).alias("version"), F.lit("Go").alias("ecosystem")).where("name <> ''")
    crate = r"""^([A-Za-z0-9_-]+)\s*=\s*(?:\{.*?version\s*=\s*)?"([^"]*)\""""
    cargo = blocks.where("_name = 'Cargo.toml' AND block IN ('dependencies', 'dev-dependencies')").select("file_path", F.regexp_extract("line", crate, 1).alias("name"), clean_version(F.regexp_extract("line", crate, 2)).alias("version"), F.lit("crates.io").alias("ecosystem")).where("name <> ''")
    schema = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    both = m.where("_name = 'package.json'").select("file_path", F.from_json("content", schema).alias("j"))
    npm = both.select("file_path", F.explode(F.concat(F.coalesce(F.map_entries("j.dependencies"), F.array()), F.coalesce(F.map_entries("j.devDependencies"), F.array()))).alias("e"))
    npm = npm.select("file_path", F.col("e.key").alias("name"), clean_version(F.col("e.value")).alias("version"), F.lit("npm").alias("ecosystem"))
    return pip.unionByName(gomod).unionByName(cargo).unionByName(npm)


def clean_version(version: Column) -> Column:
    """Without the range marks in front."""
    return F.regexp_replace(version, "^[~^]+", "")


def with_advisories(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each dependency with each advisory on its name, ecosystem and version."""
    return deps.join(advisories, ["name", "ecosystem", "version"])


def health_score(outdated: Column, vulnerable: Column, unlicensed: Column, total: Column) -> Column:
    """100 less 20, 40 and 30 times the shares of outdated, vulnerable and unlicensed dependencies."""
    return F.when(total > 0, F.greatest(F.lit(0.0), 100.0 - 20.0 * outdated / total - 40.0 * vulnerable / total - 30.0 * unlicensed / total)).otherwise(100.0)


def fix_text(versions: Column) -> Column:
    """Advice on an upgrade: the first three fixed versions."""
    return F.when(F.size(versions) > 0, F.concat(F.lit("Upgrade to version "), F.array_join(F.slice(versions, 1, 3), ", "))).otherwise("No fix available yet")
