"""Git history reports: a summary row per repository, with the long lists in tables beside it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions.sql import exprs
from forgelens.operators import history
from forgelens.tables import per_repo


def summary_columns(as_of: datetime) -> dict[str, str]:
    """Columns of the summary over ``history_totals``."""
    return {
        **history.frequency_columns(),
        **history.inactivity_columns(as_of),
        **history.message_columns(),
        **history.merge_columns(),
        "bus_factor": "coalesce(bus_factor, 0L)",
    }


def history_summary(
    repos: DataFrame, commits: DataFrame, as_of: datetime, *others: DataFrame
) -> DataFrame:
    """Frequency, inactivity, messages, merges, bus factor and score of normalised commits.

    ``others`` are further per-repository results to join in the same step.
    """
    kept = [c for other in others for c in other.columns if c != "repo"]
    return (
        per_repo(repos, history.history_totals(commits), *others)
        .select("repo", *exprs(**summary_columns(as_of)), *kept)
        .withColumn("score", F.expr(history.history_score()))
    )


BASIC = (
    "repo", "total_commits", "days_active", "commits_per_day", "bus_factor", "inactive",
    "days_since_last_commit", "total_messages", "meaningful_messages", "meaningful_ratio", "score",
)


def git_history_report(
    repos: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    max_commits: int | None = None,
) -> dict[str, DataFrame]:
    chosen = history.prepared(commits, max_commits)
    authors = history.author_contributions(history.attach_commit_stats(chosen, commit_files))
    return {
        "summary": history_summary(repos, chosen, as_of).select(*BASIC),
        "authors": authors,
        "dominant_authors": history.dominant_authors(authors),
    }


def extended_summary(
    repos: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    max_commits: int | None = None,
) -> DataFrame:
    """The summary with churn and merges."""
    chosen = history.prepared(commits, max_commits)
    churn = history.churn_totals(history.impact_of(commit_files, chosen, max_commits))
    zeros = {"files": 0, "high_churn_files": 0, "average_churn": 0.0}
    return history_summary(repos, chosen, as_of, churn).fillna(zeros)


def extended_git_history_report(
    repos: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    max_commits: int | None = None,
) -> dict[str, DataFrame]:
    report = git_history_report(repos, commits, commit_files, as_of, max_commits)
    chosen = history.prepared(commits, max_commits)
    report["summary"] = extended_summary(repos, commits, commit_files, as_of, max_commits)
    report["author_months"] = history.author_months(chosen)
    return report


def commit_activity_report(
    repos: DataFrame, commits: DataFrame, commit_files: DataFrame, max_commits: int | None = None
) -> dict[str, DataFrame]:
    chosen = history.prepared(commits, max_commits)
    with_stats = history.attach_commit_stats(chosen, commit_files)
    return {
        "authors": history.commits_per_author(chosen),
        "by_day": history.commits_per_day(chosen),
        "by_month": history.commits_per_month(chosen),
        "frequency": history.commit_frequency(repos, chosen),
        "changes": history.change_totals(repos, with_stats),
    }
