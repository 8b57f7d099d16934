"""Conflicts between the occurrences of a dependency.

They work on ``dep_occurrences``: after deduplication each name has one row and nothing can differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions import versions
from forgelens.functions.scores import share
from forgelens.functions.sql import exprs
from forgelens.operators.shared import shared
from forgelens.operators.skew import join_hot
from forgelens.tables import per_repo


def _per_version(occurrences: DataFrame) -> DataFrame:
    """One row per name and version; NULL stands for all occurrences without one.

    Types and ecosystems are enumerations, so their sets are small. A hot name is spread by its versions.
    """
    version = f"CASE WHEN {versions.present('version')} THEN version END"
    keyed = occurrences.select("repo", *exprs(name="lower(name)", version=version), "dep_type", "source")
    return keyed.groupBy("repo", "name", "version").agg(
        *exprs(rows="count(*)", types="array_sort(collect_set(dep_type))", sources="array_sort(collect_set(source))")
    )


def _measures(per_version: DataFrame) -> DataFrame:
    """All that the conflict kinds compare, one row per name.

    The sets of a name's versions are collected as sets of sets, of which an enumeration has few.
    """
    major = f"double(nullif({versions.first_number('version')}, ''))"
    every = "array_sort(array_distinct(flatten(collect_set({}))))"
    return per_version.select("*", *exprs(major=major)).groupBy("repo", "name").agg(
        *exprs(
            n_versions="count(version)",
            types=every.format("types"),
            sources=every.format("sources"),
            majors="coalesce(sum(rows) FILTER (WHERE major IS NOT NULL), 0L)",
            high="max(major)",
            low="min(major)",
        )
    )


def conflict_measures(occurrences: DataFrame) -> DataFrame:
    """``(repo, name, n_versions, types, sources, majors, high, low)``, from one reading of the occurrences."""
    return _measures(_per_version(occurrences))


def version_conflicts(occurrences: DataFrame) -> DataFrame:
    """Names with several versions: ``(repo, name, n_versions)``."""
    return conflict_measures(occurrences).where("n_versions > 1").select("repo", "name", "n_versions")


def conflicting_versions(occurrences: DataFrame) -> DataFrame:
    """The versions of each version conflict, one row each; a name may have any number."""
    per_version = shared(_per_version(occurrences))
    found = _measures(per_version).where("n_versions > 1").select("repo", "name", "n_versions")
    listed = per_version.where("version IS NOT NULL").select("repo", "name", "version")
    return join_hot(listed, found, ["repo", "name"], ["version"], ways=8)


def type_conflicts(occurrences: DataFrame) -> DataFrame:
    return conflict_measures(occurrences).where("size(types) > 1").select("repo", "name", "types")


def ecosystem_shadowing(occurrences: DataFrame) -> DataFrame:
    shadowed = conflict_measures(occurrences).where("size(sources) > 1").select("repo", "name", "sources")
    return shadowed.withColumn("count", F.expr("bigint(size(sources))"))


def version_divergence(occurrences: DataFrame) -> DataFrame:
    """Spread of the major versions of a name, relative to the largest; 0.0 when all are zero."""
    divergence = exprs(divergence=share("high - low", "high"))
    return conflict_measures(occurrences).where("majors > 1").select("repo", "name", *divergence)


# The kinds of conflicts, each with the measure that must exceed one.
KINDS = {
    "version_conflict": "n_versions",
    "dependency_type_conflict": "bigint(size(types))",
    "ecosystem_shadowing": "bigint(size(sources))",
}


def conflicts(occurrences: DataFrame) -> DataFrame:
    """All conflicts with their number of differing values."""
    kinds = ", ".join(f"struct('{kind}' AS conflict_type, {size} AS n_values)" for kind, size in KINDS.items())
    unpivoted = conflict_measures(occurrences).selectExpr("repo", "name", f"inline(filter(array({kinds}), k -> k.n_values > 1))")
    return unpivoted.select("repo", "name", "conflict_type", "n_values")


def conflict_report(repos: DataFrame, occurrences: DataFrame) -> dict[str, DataFrame]:
    totals = conflicts(occurrences).groupBy("repo").agg(F.count("*").alias("total_conflicts"))
    return {
        "summary": per_repo(repos, totals, zeros={"total_conflicts": 0}),
        "version_conflicts": conflicting_versions(occurrences),
        "type_conflicts": type_conflicts(occurrences),
        "ecosystem_shadowing": ecosystem_shadowing(occurrences),
        "version_divergence": version_divergence(occurrences),
    }
