"""Dependencies: ordered merge, enrichment, per-dependency rules and per-repository counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.functions import versions
from forgelens.functions.sql import array_of, exprs, in_list, lit, map_of, present_only
from forgelens.operators.shared import shared
from forgelens.tables import DEPENDENCY_TYPES, per_repo

# License of name prefixes, in rule order, and the restrictive licenses.
LICENSE_PREFIXES = (
    ("django", "BSD"), ("flask", "BSD"), ("numpy", "BSD"), ("pandas", "BSD"), ("react", "MIT"),
    ("vue", "MIT"),
)
RESTRICTIVE_LICENSES = ("GPL", "Proprietary")
TOOLING_TYPES = ("development", "build")


# Merge


def _merge_in_order(rows: DataFrame, key: str, order: str, more: Sequence[Column] = ()) -> DataFrame:
    """Reduce the rows of a key to one: the first seen wins, gaps are filled from later rows.

    The version comes from the first row that has one and the type from the first row whose type
    is known. All of it is one aggregate, so rows combine on the map side before the shuffle.
    """
    has_version = versions.present("version")
    merged = rows.groupBy("repo", key).agg(
        *exprs(
            first=f"min_by(struct(name, version, source, dep_type), {order})",
            # A struct orders by its first field, so the least one is that of the first row.
            versioned=f"min(CASE WHEN {has_version} THEN struct({order} AS at, version) END)",
            typed=f"min(CASE WHEN dep_type <> 'unknown' THEN struct({order} AS at, dep_type) END)",
            ord=f"min({order})",
        ),
        *more,
    )
    carried = [c for c in merged.columns if c not in ("repo", key, "first", "versioned", "typed", "ord")]
    return merged.select(
        "repo",
        *([key] if key != "name" else []),
        *exprs(
            name="first.name",
            version="coalesce(versioned.version, first.version)",
            source="first.source",
            dep_type="coalesce(typed.dep_type, first.dep_type)",
        ),
        "ord",
        *carried,
    )


def entries_per_manifest(occurrences: DataFrame) -> DataFrame:
    """One row per name and manifest: the last entry's payload at the first entry's place."""
    return (
        occurrences.groupBy("repo", "file_seq", "name")
        .agg(
            *exprs(
                entry_seq="min(entry_seq)",
                last="max_by(struct(version, source, dep_type), entry_seq)",
            )
        )
        .select("repo", "file_seq", "entry_seq", "name", "last.*")
    )


def merge_entries(entries: DataFrame) -> DataFrame:
    """Merge manifests in file order, by the name as spelled; one row per name and manifest comes in."""
    return _merge_in_order(entries, "name", "struct(file_seq, entry_seq)")


def merge_dependencies(occurrences: DataFrame) -> DataFrame:
    """The same for dependency rows as they stand in the manifests."""
    return merge_entries(entries_per_manifest(occurrences))


def merge_with_sources(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged dependencies and the ecosystems of each repository, from one shuffle of the entries.

    ``entries`` also has ``failed``, and a row without a name for manifests without entries. The ecosystems of the
    manifests that parsed (seven at most) travel with the rows of each name.
    """
    parsed_sources = exprs(sources="array_sort(collect_set(CASE WHEN NOT failed THEN source END))")
    rows = shared(_merge_in_order(entries, "name", "struct(file_seq, entry_seq)", parsed_sources))
    found = rows.groupBy("repo").agg(F.expr("array_sort(array_distinct(flatten(collect_set(sources))))").alias("sources_detected"))
    return rows.where("name IS NOT NULL").drop("sources"), found.where("size(sources_detected) > 0")


def deduplicate(merged: DataFrame) -> DataFrame:
    """Merge names that differ only by case, in order of first appearance.

    This is a second step on purpose: a spelling is back-filled by its own later entries before
    another spelling can lend it a version.
    """
    return _merge_in_order(merged.withColumn("dep_key", F.lower("name")), "dep_key", "ord")


# Enrichment


def resolve_license(name: str = "name", rules: Sequence[tuple[str, str]] = LICENSE_PREFIXES) -> str:
    if not rules:
        return "'Unknown'"
    cases = " ".join(
        f"WHEN startswith(lower({name}), {lit(prefix)}) THEN {lit(value)}" for prefix, value in rules
    )
    return f"CASE {cases} ELSE 'Unknown' END"


def _vulnerability(prefix: str, severity: str, description: str, name: str) -> str:
    return (
        f"struct('{prefix}' || upper({name}) || '-001' AS identifier, '{severity}' AS severity, "
        f"'{description}' AS description, cast(NULL AS string) AS fixed_version)"
    )


def resolve_vulnerabilities(name: str = "name", version: str = "version") -> str:
    early = _vulnerability("PRE-", "medium", "Pre-release version detected", name)
    zero = _vulnerability("ZERO-", "high", "Major version zero dependency", name)
    return present_only(
        f"CASE WHEN {versions.contains_word(version, 'alpha', 'beta')} THEN {early} END",
        f"CASE WHEN {versions.starts_with_zero(version)} THEN {zero} END",
    )


def has_severe(vulnerabilities: str = "vulnerabilities") -> str:
    return f"exists({vulnerabilities}, v -> v.severity IN ('high', 'critical'))"


def enrich(
    deduplicated: DataFrame, license_rules: Sequence[tuple[str, str]] = LICENSE_PREFIXES
) -> DataFrame:
    """Add license, vulnerabilities and the vulnerable and outdated flags."""
    return deduplicated.select(
        "*",
        *exprs(
            license=resolve_license("name", license_rules),
            vulnerabilities=resolve_vulnerabilities(),
            is_outdated=versions.has_zero_major("version"),
        ),
    ).select("*", *exprs(is_vulnerable=has_severe()))


def dependencies(
    occurrences: DataFrame, license_rules: Sequence[tuple[str, str]] = LICENSE_PREFIXES
) -> DataFrame:
    """The ``deps`` table: merged, deduplicated and enriched."""
    return enrich(deduplicate(merge_dependencies(occurrences)), license_rules)


# Counts


def outdated_count(repos: DataFrame, deps: DataFrame) -> DataFrame:
    outdated = exprs(outdated=f"count_if({versions.has_zero_major('version')})")
    return per_repo(repos, deps.groupBy("repo").agg(*outdated), zeros={"outdated": 0})


def vulnerable_count(repos: DataFrame, deps: DataFrame) -> DataFrame:
    severe = exprs(vulnerable=f"count_if({has_severe(resolve_vulnerabilities())})")
    return per_repo(repos, deps.groupBy("repo").agg(*severe), zeros={"vulnerable": 0})


def dependency_summary(repos: DataFrame, deps: DataFrame, sources: DataFrame) -> DataFrame:
    """Totals per repository; ``sources (repo, sources_detected)`` comes from the manifests."""
    counts = {
        "total": "count(*)",
        "vulnerable": "count_if(is_vulnerable)",
        "outdated": "count_if(is_outdated)",
    }
    joined = per_repo(
        repos, deps.groupBy("repo").agg(*exprs(**counts)), sources, zeros=dict.fromkeys(counts, 0)
    )
    return joined.withColumn(
        "sources_detected", F.expr(f"coalesce(sources_detected, {array_of([])})")
    ).withColumn("sources", F.expr("bigint(size(sources_detected))"))


def sources_in(occurrences: DataFrame) -> DataFrame:
    """Ecosystems seen in dependency rows, for inputs that come without manifests."""
    found = exprs(sources_detected="array_sort(collect_set(source))")
    return occurrences.groupBy("repo").agg(*found)


def health_score(total: str, vulnerable: str, outdated: str) -> str:
    penalty = f"({vulnerable} / double({total}) * 0.6D + {outdated} / double({total}) * 0.4D)"
    return f"CASE WHEN {total} = 0 THEN 1.0D ELSE greatest(0.0D, round(1.0D - {penalty}, 3)) END"


def recommendations(vulnerable: str, outdated: str, health: str) -> str:
    found = present_only(
        f"CASE WHEN {vulnerable} > 0 THEN {vulnerable} || ' vulnerable dependencies detected' END",
        f"CASE WHEN {outdated} > 0 THEN {outdated} || ' outdated dependencies detected' END",
        f"CASE WHEN {health} < 0.7D THEN 'Dependency health score is below recommended threshold' END",
    )
    return f"if(size({found}) > 0, {found}, array('No major dependency issues detected'))"


def dependencies_by_type(repos: DataFrame, deps: DataFrame) -> DataFrame:
    """Members of each dependency type, one row each.

    Every repository has all six types; a type without members has one row with NULL name.
    """
    members = shared(deps.select("repo", "dep_type", "name"))
    present = members.groupBy("repo").agg(*exprs(present="collect_set(dep_type)"))
    absent = f"array_except({array_of(DEPENDENCY_TYPES)}, coalesce(present, {array_of([])}))"
    empty = repos.join(present, "repo", "left").selectExpr(
        "repo", f"explode({absent}) AS dep_type", "cast(NULL AS string) AS name"
    )
    return members.unionByName(empty)


def type_counts(repos: DataFrame, deps: DataFrame) -> DataFrame:
    """Number of dependencies of each of the six types, zeros included."""
    every_type = repos.selectExpr("repo", f"explode({array_of(DEPENDENCY_TYPES)}) AS dep_type")
    counts = deps.groupBy("repo", "dep_type").agg(*exprs(dependencies="count(*)"))
    return every_type.join(counts, ["repo", "dep_type"], "left").fillna(0, ["dependencies"])


def dependencies_by_source(deps: DataFrame) -> DataFrame:
    """Members of each ecosystem present, one row each."""
    return deps.select("repo", "source", "name")


def license_distribution(deps: DataFrame) -> DataFrame:
    return deps.groupBy("repo", "license").agg(*exprs(dependencies="count(*)"))


# Risk and freshness

IS_RESTRICTIVE = in_list("license", RESTRICTIVE_LICENSES)
IS_TOOLING = in_list("dep_type", TOOLING_TYPES)
IS_ZERO = versions.starts_with_zero("version")
IS_PRE_RELEASE = versions.is_pre_release("version")
IS_PINNED = versions.present("version")


def risk_score() -> str:
    score = (
        f"if(is_vulnerable, 0.5D, 0.0D) + if({IS_ZERO}, 0.2D, 0.0D) "
        f"+ if({IS_RESTRICTIVE}, 0.2D, 0.0D) - if(dep_type = 'optional', 0.1D, 0.0D)"
    )
    return f"least(1.0D, round({score}, 3))"


def with_risk(deps: DataFrame) -> DataFrame:
    return deps.withColumn("risk_score", F.expr(risk_score()))


def high_risk_nodes(deps: DataFrame, threshold: float = 0.5) -> DataFrame:
    return with_risk(deps).where(f"risk_score >= {threshold}D").select("repo", "name", "risk_score")


def high_risk_dependencies(deps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The insight report's own weighting; differs from ``risk_score``."""
    weight = (
        f"if(is_vulnerable, 0.4D, 0.0D) + if({IS_ZERO}, 0.2D, 0.0D) + if({IS_RESTRICTIVE}, 0.2D, 0.0D)"
    )
    return deps.where(f"{weight} >= {threshold}D").select("repo", "name")


def freshness() -> str:
    return (
        f"CASE WHEN NOT {IS_PINNED} THEN 'unknown' "
        f"WHEN {versions.contains_word('version', 'dev', 'alpha')} THEN 'experimental' "
        f"WHEN {IS_ZERO} THEN 'early' WHEN {versions.has_positive_major('version')} THEN 'stable' "
        "ELSE 'unknown' END"
    )


def freshness_summary(deps: DataFrame) -> DataFrame:
    grouped = deps.groupBy("repo", *exprs(freshness=freshness()))
    return grouped.agg(*exprs(dependencies="count(*)"))


# Policy


def evaluate_policy(
    deps: DataFrame,
    max_vulnerable: int = 0,
    disallowed_licenses: Iterable[str] = (),
    allow_pre_release: bool = False,
) -> DataFrame:
    """One row per violation: ``(repo, rule, name, message)``."""
    vulnerable = deps.groupBy("repo").agg(*exprs(n="count_if(is_vulnerable)"))
    over = vulnerable.where(f"n > {max_vulnerable}").selectExpr(
        "repo",
        "'vulnerable_limit' AS rule",
        "cast(NULL AS string) AS name",
        "'Vulnerable dependencies exceed limit (' || n || ')' AS message",
    )
    banned = (
        f"CASE WHEN {in_list('license', disallowed_licenses)} THEN struct('license' AS rule, "
        "'Disallowed license detected: ' || name || ' (' || license || ')' AS message) END"
    )
    early = (
        f"CASE WHEN {str(not allow_pre_release).lower()} AND {IS_PRE_RELEASE} THEN "
        "struct('pre_release' AS rule, 'Pre-release dependency detected: ' || name AS message) END"
    )
    each = deps.selectExpr("repo", "name", f"explode({present_only(banned, early)}) AS v")
    return over.unionByName(each.select("repo", "v.rule", "name", "v.message"))


# Confidence

# Condition, points lost and reason, in the order in which the points are subtracted.
CONFIDENCE_RULES = (
    (f"NOT {IS_PINNED}", 0.25, "missing_version"),
    (IS_PRE_RELEASE, 0.15, "pre_release_version"),
    ("source = 'python' AND startswith(name, '_')", 0.1, "private_python_package"),
    ("source = 'javascript' AND startswith(name, '@')", 0.05, "scoped_package"),
    ("source = 'jvm' AND contains(name, ':')", 0.05, "multi_artifact_coordinate"),
    ("license = 'Unknown'", 0.15, "unknown_license"),
)


def confidence(deps: DataFrame) -> DataFrame:
    lost = " ".join(f"- if({holds}, {points}D, 0.0D)" for holds, points, _ in CONFIDENCE_RULES)
    reasons = [f"CASE WHEN {holds} THEN '{reason}' END" for holds, _, reason in CONFIDENCE_RULES]
    return deps.select(
        "repo",
        "name",
        "source",
        *exprs(
            confidence_score=f"greatest(0.0D, round(1.0D {lost}, 3))", reasons=present_only(*reasons)
        ),
    )


def low_confidence(deps: DataFrame, below: float = 0.6) -> DataFrame:
    return confidence(deps).where(f"confidence_score < {below}D")


def confidence_summary(repos: DataFrame, deps: DataFrame, below: float = 0.6) -> DataFrame:
    # Scores have three decimals, so thousandths add up exactly in any order.
    thousandths = "sum(bigint(round(confidence_score * 1000)))"
    totals = confidence(deps).groupBy("repo").agg(
        *exprs(
            average_confidence=f"round({thousandths} / count(*) / 1000, 3)",
            low_confidence_dependencies=f"count_if(confidence_score < {below}D)",
        )
    )
    zeros = {"average_confidence": 1.0, "low_confidence_dependencies": 0}
    return per_repo(repos, totals, zeros=zeros)


# Findings and explanations


def _finding(severity: str, category: str, message: str, evidence: dict[str, str]) -> str:
    mapping = map_of(evidence) if evidence else "map()"
    return (
        f"struct({severity} AS severity, '{category}' AS category, {message} AS message, "
        f"cast({mapping} AS map<string,string>) AS evidence)"
    )


def findings(deps: DataFrame) -> DataFrame:
    """All findings, one row each, in order of ``position`` within a dependency."""
    version = {"version": "version"}
    known = _finding(
        "v.severity",
        "vulnerability",
        "'Vulnerability detected: ' || v.identifier",
        {**version, "description": "v.description"},
    )
    restrictive = "'Potentially restrictive license: ' || license"
    early = "'Pre-release dependency version detected'"
    rules = {
        IS_RESTRICTIVE: _finding("'medium'", "license", restrictive, {"license": "license"}),
        IS_ZERO: _finding("'medium'", "stability", "'Dependency uses major version zero'", version),
        IS_PRE_RELEASE: _finding("'low'", "stability", early, version),
        "dep_type = 'optional'": _finding("'info'", "classification", "'Optional dependency'", {}),
    }
    ruled = present_only(*[f"CASE WHEN {holds} THEN {f} END" for holds, f in rules.items()])
    listed = f"concat(transform(vulnerabilities, v -> {known}), {ruled})"
    exploded = deps.selectExpr("repo", "name", f"posexplode_outer({listed}) AS (position, f)")
    return exploded.where("f IS NOT NULL").select("repo", "name", "position", "f.*")


def findings_by_severity(all_findings: DataFrame) -> DataFrame:
    return all_findings.groupBy("repo", "severity").agg(*exprs(findings="count(*)"))


def risk_explanation() -> str:
    reasons = present_only(
        "CASE WHEN is_vulnerable THEN 'known vulnerabilities' END",
        f"CASE WHEN {IS_ZERO} THEN 'major version zero' END",
        f"CASE WHEN {IS_RESTRICTIVE} THEN 'restrictive license' END",
        f"CASE WHEN NOT {IS_PINNED} THEN 'missing version pin' END",
    )
    text = f"'Risk due to: ' || array_join({reasons}, ', ')"
    return f"if(size({reasons}) > 0, {text}, 'No significant risk factors identified')"


def explanations(deps: DataFrame) -> DataFrame:
    return deps.select("repo", "name", *exprs(explanation=risk_explanation()))


# Usage and upgrades


def usage_profiles(deps: DataFrame) -> DataFrame:
    reasons = present_only(
        f"CASE WHEN {IS_TOOLING} THEN 'development_or_build_dependency' END",
        "CASE WHEN dep_type = 'runtime' THEN 'runtime_dependency' END",
        "CASE WHEN is_vulnerable THEN 'has_known_vulnerabilities' END",
        f"CASE WHEN {IS_ZERO} THEN 'early_version_dependency' END",
        f"CASE WHEN {IS_RESTRICTIVE} THEN 'restrictive_license' END",
    )
    return deps.select(
        "repo",
        "name",
        *exprs(
            usage_type=f"CASE WHEN {IS_TOOLING} THEN 'tooling' WHEN dep_type = 'runtime' THEN 'runtime' ELSE 'direct' END",
            criticality=f"CASE WHEN is_vulnerable THEN 'high' WHEN {IS_TOOLING} THEN 'low' ELSE 'medium' END",
            reasoning=f"if(size({reasons}) > 0, {reasons}, array('no_special_risk_indicators'))",
        ),
    )


def upgrade_impacts(deps: DataFrame) -> DataFrame:
    zero, stable = versions.has_zero_major("version"), versions.has_positive_major("version")
    notes = present_only(
        f"CASE WHEN {zero} THEN 'unstable_major_version' END",
        f"CASE WHEN {stable} THEN 'semantic_versioning_applies' END",
        "CASE WHEN is_vulnerable THEN 'security_fix_recommended' END",
        f"CASE WHEN {IS_TOOLING} THEN 'tooling_dependency' END",
    )
    risk = f"CASE WHEN is_vulnerable OR {zero} THEN 'high' WHEN {stable} THEN 'medium' ELSE 'low' END"
    effort = f"CASE WHEN {IS_TOOLING} THEN 'low' WHEN {zero} OR {stable} THEN 'medium' ELSE 'low' END"
    return deps.select(
        "repo",
        "name",
        *exprs(
            current_version=f"CASE WHEN {IS_PINNED} THEN version END",
            risk_level=f"if({IS_PINNED}, {risk}, 'unknown')",
            estimated_effort=f"if({IS_PINNED}, {effort}, 'unknown')",
            notes=f"if({IS_PINNED}, {notes}, array('version_not_pinned'))",
        ),
    )
