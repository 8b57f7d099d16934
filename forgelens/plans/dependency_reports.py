"""Dependency reports: a summary row per repository and the dependency rows beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.operators import dependencies as d
from forgelens.operators import graph
from forgelens.sources import manifests as m


def health_summary(repos: DataFrame, deps: DataFrame, sources: DataFrame) -> DataFrame:
    score = d.health_score("total", "vulnerable", "outdated")
    advice = d.recommendations("vulnerable", "outdated", "health_score")
    return (
        d.dependency_summary(repos, deps, sources)
        .withColumn("health_score", F.expr(score))
        .withColumn("recommendations", F.expr(advice))
    )


def dependency_report(
    repos: DataFrame,
    occurrences: DataFrame,
    sources: DataFrame,
    license_rules: Sequence[tuple[str, str]] = d.LICENSE_PREFIXES,
) -> dict[str, DataFrame]:
    deps = d.dependencies(occurrences, license_rules)
    return {"summary": health_summary(repos, deps, sources), "dependencies": deps}


def repository_dependency_report(
    repos: DataFrame,
    files: DataFrame,
    license_rules: Sequence[tuple[str, str]] = d.LICENSE_PREFIXES,
) -> dict[str, DataFrame]:
    """The report from file tables: discover, parse, merge, enrich, summarise.

    Each of its frames is one lazily planned reading of the contents: entries are folded in the manifest that holds them,
    and dependencies and ecosystems come from the same shuffle.
    """
    entries = m.merged_entries_of(m.parse_manifests(m.discover_manifests(files)))
    merged, sources = d.merge_with_sources(entries)
    deps = d.enrich(d.deduplicate(merged), license_rules)
    return {"summary": health_summary(repos, deps, sources), "dependencies": deps}


def graph_report(repos: DataFrame, deps: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    summary = health_summary(repos, deps, sources).join(graph.graph_size(repos, deps), "repo")
    return {
        "summary": summary,
        "freshness": d.freshness_summary(deps),
        "high_risk_dependencies": d.high_risk_nodes(deps),
    }


def explainability_report(deps: DataFrame) -> dict[str, DataFrame]:
    found = d.findings(deps)
    return {
        "finding_summary": d.findings_by_severity(found),
        "findings": found,
        "explanations": d.explanations(deps),
    }


def verbose_report(repos: DataFrame, deps: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    return {"summary": health_summary(repos, deps, sources), **explainability_report(deps)}


def insights(deps: DataFrame) -> dict[str, DataFrame]:
    return {
        "license_distribution": d.license_distribution(deps),
        "high_risk_dependencies": d.high_risk_dependencies(deps),
        "usage_profiles": d.usage_profiles(deps),
        "upgrade_impacts": d.upgrade_impacts(deps),
    }
