"""Metrics reports: scores, flags and grades, one row per repository."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from forgelens.functions import scores
from forgelens.functions.sql import exprs, lit
from forgelens.operators import metrics as m
from forgelens.operators.files import ScanLimits
from forgelens.plans.file_reports import detailed_scan_report, quick_scan_report

SECTIONS = ("structure", "activity", "quality")


def metrics_report(metrics: DataFrame, preset: str = "relaxed") -> DataFrame:
    """All metrics with section scores, total score and risk flags under a preset."""
    chosen = m.find_preset(preset)
    flags = exprs(preset=lit(chosen.name), risk_flags=m.risk_flags(chosen.thresholds))
    return m.with_scores(metrics, chosen.weights).select("*", *flags)


def compact_metrics_report(metrics: DataFrame, preset: str = "relaxed") -> DataFrame:
    return m.with_scores(metrics, m.find_preset(preset).weights).selectExpr(
        "repo",
        "total_score AS score",
        "inactive",
        "bus_factor",
        "commits_per_day",
        "bigint(size(languages)) AS languages",
        "files_counted AS files",
    )


def evaluation_columns() -> dict[str, str]:
    """Grade, trend, stability and risk classes, and a sentence per section."""
    return {
        "overall_score": "total_score",
        "grade": scores.grade("total_score"),
        "activity_trend": scores.activity_trend("commits_per_day"),
        "churn_stability": scores.churn_stability("churn_average"),
        "bus_factor_risk": scores.bus_factor_risk("bus_factor"),
        **{f"{s}_explanation": scores.explain_component(s, f"{s}_score") for s in SECTIONS},
    }


def evaluation_summary(metrics: DataFrame, preset: str = "relaxed") -> DataFrame:
    scored = m.with_scores(metrics, m.find_preset(preset).weights)
    return scored.select("repo", *exprs(**evaluation_columns()))


def full_evaluation(metrics: DataFrame, preset: str = "relaxed") -> DataFrame:
    return metrics_report(metrics, preset).select("*", *exprs(**evaluation_columns()))


#: Depth up to which the raw detailed scan goes.
RAW_DEPTH = 10
RAW_ERRORS = 100


def metrics_with_raw(
    repos: DataFrame,
    files: DataFrame,
    dirs: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    max_commits: int | None = None,
    include_raw: bool = False,
) -> dict[str, DataFrame]:
    """The metrics and, on request, the scans beside them: the quick one, and the frames of the detailed one."""
    found = {"metrics": m.repository_metrics(repos, files, commits, commit_files, as_of, max_commits)}
    if include_raw:
        detailed = detailed_scan_report(repos, files, dirs, ScanLimits(max_depth=RAW_DEPTH), max_errors=RAW_ERRORS)
        found["filesystem_quick"] = quick_scan_report(repos, files, dirs)
        found |= {f"filesystem_detailed_{part}": frame for part, frame in detailed.items()}
    return found


def analyze_repositories(
    repos: DataFrame,
    files: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    preset: str = "relaxed",
    max_commits: int | None = None,
) -> DataFrame:
    """The flagship: the metrics report of every repository, straight from the base tables."""
    m.find_preset(preset)
    metrics = m.repository_metrics(repos, files, commits, commit_files, as_of, max_commits)
    return metrics_report(metrics, preset)


def analyze_repositories_compact(
    repos: DataFrame,
    files: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    preset: str = "relaxed",
    max_commits: int | None = None,
) -> DataFrame:
    m.find_preset(preset)
    metrics = m.repository_metrics(repos, files, commits, commit_files, as_of, max_commits)
    return compact_metrics_report(metrics, preset)
