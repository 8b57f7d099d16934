"""Commit history: activity, authorship, change statistics and churn."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions.scores import share
from forgelens.functions.sql import expr_map, exprs, in_list
from forgelens.functions.text import strip
from forgelens.operators.skew import first_n, join_hot, row_numbers
from forgelens.tables import per_repo

# What makes a commit message meaningful.
MIN_MESSAGE_LENGTH = 10
LOW_QUALITY_MESSAGES = ("fix", "update", "changes", "stuff", "wip")


def normalize_authors(commits: DataFrame) -> DataFrame:
    names = ("author_name", "author_email")
    return commits.withColumns(expr_map({c: f"lower({strip(c)})" for c in names}))


def newest_commits(commits: DataFrame, max_commits: int | None) -> DataFrame:
    return commits if max_commits is None else first_n(commits, ["repo"], "seq", max_commits)


def prepared(commits: DataFrame, max_commits: int | None) -> DataFrame:
    """The newest commits with normalised authors."""
    return normalize_authors(newest_commits(commits, max_commits))


def is_meaningful(
    message: str = "message",
    min_length: int = MIN_MESSAGE_LENGTH,
    low_quality: Iterable[str] = LOW_QUALITY_MESSAGES,
) -> str:
    text = strip(message)
    poor = in_list(f"lower({text})", low_quality)
    return f"coalesce(length({text}) >= {min_length} AND NOT {poor}, false)"


def is_merge(message: str = "message") -> str:
    return f"startswith(lower({message}), 'merge')"


def day_of(ts: str = "authored_at") -> str:
    return f"left(cast({ts} AS string), 10)"


def month_of(ts: str = "authored_at") -> str:
    return f"left(cast({ts} AS string), 7)"


def moment(at: datetime) -> str:
    """A UTC point in time as a literal that no session time zone moves."""
    return f"timestamp_ntz '{at.isoformat(sep=' ')}'"


def whole_days(start: str, end: str) -> str:
    """Whole 24-hour periods from start to end, rounded down; independent of any time zone."""

    def time_of_day(ts: str) -> str:
        return f"({ts} - cast(cast({ts} AS date) AS timestamp_ntz))"

    early = f"if({time_of_day(end)} < {time_of_day(start)}, 1L, 0L)"
    return f"(datediff(cast({end} AS date), cast({start} AS date)) - {early})"


# Change statistics


def commit_stats(commit_files: DataFrame) -> DataFrame:
    sums = exprs(
        files_changed="count(*)", insertions="sum(insertions)", deletions="sum(deletions)"
    )
    return commit_files.groupBy("repo", "commit_hash").agg(*sums)


def attach_commit_stats(
    commits: DataFrame, commit_files: DataFrame, failed: DataFrame | None = None
) -> DataFrame:
    """Commits with their change counts.

    A commit without changed files has zeros. Commits named in ``failed (repo, commit_hash)``,
    whose statistics could not be read at export, have NULLs.
    """
    key = ["repo", "commit_hash"]
    columns = ("files_changed", "insertions", "deletions")
    filled = commits.join(commit_stats(commit_files), key, "left").fillna(0, list(columns))
    if failed is None:
        return filled
    marks = failed.select(*key).distinct().withColumn("_failed", F.lit(True))
    cleared = {c: f"CASE WHEN _failed IS NULL THEN {c} END" for c in columns}
    return filled.join(marks, key, "left").withColumns(expr_map(cleared)).drop("_failed")


def change_totals(repos: DataFrame, commits_with_stats: DataFrame) -> DataFrame:
    sums = {
        "files_changed": "sum(files_changed)",
        "total_insertions": "sum(insertions)",
        "total_deletions": "sum(deletions)",
    }
    totals = commits_with_stats.groupBy("repo").agg(*exprs(**sums))
    return per_repo(repos, totals, zeros=dict.fromkeys(sums, 0))


def _impact(rows: DataFrame, *keys: str) -> DataFrame:
    sums = exprs(commits="count(*)", insertions="sum(insertions)", deletions="sum(deletions)")
    return rows.groupBy(*keys).agg(*sums)


def commit_file_impact(commit_files: DataFrame) -> DataFrame:
    return _impact(commit_files, "repo", "commit_hash", "path")


def file_impact(commit_files: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Change totals per path, over all commits or over the given ones only."""
    if commits is not None:
        key = ["repo", "commit_hash"]
        commit_files = commit_files.join(commits.select(*key), key, "left_semi")
    return _impact(commit_files, "repo", "path")


def impact_of(commit_files: DataFrame, chosen: DataFrame, max_commits: int | None) -> DataFrame:
    """File impact of the chosen commits; without a limit no join is needed to choose them."""
    return file_impact(commit_files, None if max_commits is None else chosen)


def churn_against_mean(impacts: DataFrame) -> DataFrame:
    """Each file's churn beside the mean of its repository."""
    churn = impacts.selectExpr("repo", "path", "insertions + deletions AS churn")
    means = churn.groupBy("repo").agg(
        *exprs(files="count(*)", mean_churn="sum(churn) / count(*)")
    )
    return join_hot(churn, means, ["repo"], ["path"])


def churn(repos: DataFrame, impacts: DataFrame) -> DataFrame:
    """Files changed, files with more than twice the mean churn, and the mean."""
    return per_repo(
        repos,
        churn_totals(impacts),
        zeros={"files": 0, "high_churn_files": 0, "average_churn": 0.0},
    )


def churn_totals(impacts: DataFrame) -> DataFrame:
    """Churn figures from one reading of the impacts, for repositories that have any.

    Files are first counted per churn value. A repository has few distinct values (k of them need
    at least k(k-1)/2 changed lines), so its mean is a window over these counts and the files
    themselves are not joined with it.
    """
    levels = (
        impacts.selectExpr("repo", "insertions + deletions AS churn")
        .groupBy("repo", "churn")
        .agg(*exprs(n="count(*)"))
    )
    whole = "OVER (PARTITION BY repo)"
    means = levels.selectExpr("*", f"sum(churn * n) {whole} / sum(n) {whole} AS mean_churn")
    return means.groupBy("repo").agg(
        *exprs(
            files="sum(n)",
            high_churn_files="coalesce(sum(n) FILTER (WHERE churn > mean_churn * 2), 0L)",
            average_churn="round(sum(churn * n) / sum(n), 2)",
        )
    )


def average_churn(impacts: DataFrame) -> DataFrame:
    """The mean alone, without the distribution around it."""
    return impacts.groupBy("repo").agg(
        *exprs(average_churn="round(sum(insertions + deletions) / count(*), 2)")
    )


# Activity


ACTIVITY = {
    "total_commits": "count(*)",
    "first_commit_at": "min(authored_at)",
    "last_commit_at": "max(authored_at)",
    "meaningful_messages": f"count_if({is_meaningful()})",
    "merge_commits": f"count_if({is_merge()})",
}


def activity_totals(commits: DataFrame) -> DataFrame:
    """All plain counts of a repository's commits, in one pass and one shuffle."""
    return commits.groupBy("repo").agg(*exprs(**ACTIVITY))


def frequency_columns() -> dict[str, str]:
    days = f"greatest({whole_days('first_commit_at', 'last_commit_at')} + 1, 1L)"
    return {
        "total_commits": "coalesce(total_commits, 0L)",
        "days_active": f"if(first_commit_at IS NULL, 0L, {days})",
        "commits_per_day": share("total_commits", days),
    }


def inactivity_columns(as_of: datetime, inactive_days_threshold: int = 90) -> dict[str, str]:
    days = whole_days("last_commit_at", moment(as_of))
    return {
        "inactive": f"coalesce({days} >= {inactive_days_threshold}, true)",
        "days_since_last_commit": days,
    }


def message_columns() -> dict[str, str]:
    return {
        "total_messages": "coalesce(total_commits, 0L)",
        "meaningful_messages": "coalesce(meaningful_messages, 0L)",
        "meaningful_ratio": share("meaningful_messages", "total_commits"),
    }


def merge_columns() -> dict[str, str]:
    return {
        "merge_commits": "coalesce(merge_commits, 0L)",
        "merge_ratio": share("merge_commits", "total_commits"),
    }


def _activity(repos: DataFrame, commits: DataFrame, columns: dict[str, str]) -> DataFrame:
    return per_repo(repos, activity_totals(commits)).select("repo", *exprs(**columns))


def commit_frequency(repos: DataFrame, commits: DataFrame) -> DataFrame:
    return _activity(repos, commits, frequency_columns())


def inactivity(
    repos: DataFrame, commits: DataFrame, as_of: datetime, inactive_days_threshold: int = 90
) -> DataFrame:
    return _activity(repos, commits, inactivity_columns(as_of, inactive_days_threshold))


def message_quality(repos: DataFrame, commits: DataFrame) -> DataFrame:
    return _activity(repos, commits, message_columns())


def merge_commits(repos: DataFrame, commits: DataFrame) -> DataFrame:
    return _activity(repos, commits, merge_columns())


def commits_per_author(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", "author_email").agg(F.count("*").alias("commits"))


def commits_per_day(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", *exprs(day=day_of())).agg(F.count("*").alias("commits"))


def commits_per_month(commits: DataFrame) -> DataFrame:
    return commits.groupBy("repo", *exprs(month=month_of())).agg(F.count("*").alias("commits"))


def author_months(commits: DataFrame) -> DataFrame:
    keys = ("repo", "author_email", *exprs(month=month_of()))
    return commits.groupBy(*keys).agg(F.count("*").alias("commits"))


# Authorship


def author_contributions(commits_with_stats: DataFrame) -> DataFrame:
    """Commits and changed lines per author; ``first_seq`` is the author's first place in the log."""
    return commits_with_stats.groupBy("repo", "author_email").agg(
        *exprs(
            commits="count(*)",
            insertions="coalesce(sum(insertions), 0L)",
            deletions="coalesce(sum(deletions), 0L)",
            first_seq="min(seq)",
        )
    )


def author_ranks(commits: DataFrame) -> DataFrame:
    """The part of the contributions that the bus factor needs; no change statistics."""
    return commits.groupBy("repo", "author_email").agg(
        *exprs(commits="count(*)", first_seq="min(seq)")
    )


def commit_levels(
    contributions: DataFrame, threshold: float = 0.5, carried: dict[str, str] | None = None
) -> DataFrame:
    """How many authors of each commit count belong to the dominant group (``taken``).

    Authors are first counted per commit count. A repository has few distinct commit counts (k of
    them need at least k(k+1)/2 commits), so the running total over them is small even where the
    authors are many. Within one commit count ``c`` the j-th author is needed as long as
    ``(before + j * c) / total`` stays below the threshold. ``carried`` are further aggregates over
    the authors of a level.
    """
    earlier = "OVER (PARTITION BY repo ORDER BY commits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    guess = f"ceil(({threshold}D * total - before) / commits)"
    needed = (
        f"filter(sequence({guess} - 1, {guess} + 1), "
        f"j -> double(before + j * commits) / total >= {threshold}D)"
    )
    levels = contributions.groupBy("repo", "commits").agg(*exprs(authors="count(*)", **(carried or {})))
    return levels.select(
        "*",
        *exprs(
            before=f"coalesce(sum(commits * authors) {earlier}, 0L)",
            ahead=f"coalesce(sum(authors) {earlier}, 0L)",
            total="sum(commits * authors) OVER (PARTITION BY repo)",
        ),
    ).withColumn("taken", F.expr(f"least(authors, greatest(get({needed}, 0), int(before = 0)))"))


def history_totals(commits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Activity counts and bus factor of each repository from one scan of its commits.

    Commits are folded per author, authors per commit count, and commit counts per repository;
    every fold combines on the map side, and only the first moves more than a summary.
    """
    per_author = commits.groupBy("repo", "author_email").agg(
        *exprs(commits="count(*)", **{k: v for k, v in ACTIVITY.items() if k != "total_commits"})
    )
    refold = {
        "first_commit_at": "min(first_commit_at)",
        "last_commit_at": "max(last_commit_at)",
        "meaningful_messages": "sum(meaningful_messages)",
        "merge_commits": "sum(merge_commits)",
    }
    return commit_levels(per_author, threshold, refold).groupBy("repo").agg(
        *exprs(total_commits="sum(commits * authors)", **refold, bus_factor="sum(taken)")
    )


def bus_factor_totals(contributions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return commit_levels(contributions, threshold).groupBy("repo").agg(*exprs(bus_factor="sum(taken)"))


def bus_factor(repos: DataFrame, contributions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Number of most active authors who together reach the threshold share of commits."""
    return per_repo(repos, bus_factor_totals(contributions, threshold), zeros={"bus_factor": 0})


def dominant_authors(contributions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The authors behind the bus factor in order, ties by first appearance, one row each."""
    dominant = commit_levels(contributions, threshold).where("taken > 0")
    levels = dominant.select("repo", "commits", "ahead", "taken")
    members = join_hot(
        contributions.select("repo", "author_email", "commits", "first_seq"),
        levels,
        ["repo", "commits"],
        ["author_email"],
        ways=8,
    )
    return (
        row_numbers(members, ["repo", "commits"], "first_seq", "rn")
        .where("rn <= taken")
        .selectExpr("repo", "ahead + rn AS position", "author_email", "commits")
    )


# Score


def history_score() -> str:
    """Starts at 100 and loses points for inactivity, rare commits, few authors, poor messages."""
    lost = (
        "if(inactive, 30.0D, 0.0D)"
        " + CASE WHEN commits_per_day < 0.01D THEN 20.0D WHEN commits_per_day < 0.05D THEN 10.0D ELSE 0.0D END"
        " + if(bus_factor <= 1, 15.0D, 0.0D) + if(meaningful_ratio < 0.3D, 10.0D, 0.0D)"
    )
    return f"greatest(round(100.0D - ({lost}), 2), 0.0D)"
