"""Repository metrics: structure, activity and quality, their scores, flags and changes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions import scores
from forgelens.functions.paths import CATEGORIES, LANGUAGES
from forgelens.functions.sql import exprs, lit, present_only
from forgelens.operators import history
from forgelens.operators.files import file_features, listed
from forgelens.operators.skew import join_hot
from forgelens.tables import per_repo


@dataclass(frozen=True)
class Thresholds:
    min_commits_per_day: float = 0.01
    max_days_inactive: int = 120
    min_bus_factor: int = 2
    min_meaningful_commit_ratio: float = 0.3
    max_average_churn: float = 500.0
    max_merge_ratio: float = 0.5


DEFAULT_THRESHOLDS = Thresholds()
# Default weights and the presets.
DEFAULT_WEIGHTS = {"structure": 0.3, "activity": 0.3, "quality": 0.4}


@dataclass(frozen=True)
class Preset:
    name: str
    thresholds: Thresholds = DEFAULT_THRESHOLDS
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))


PRESETS = {
    "strict": Preset(
        "strict",
        Thresholds(0.05, 60, 3, 0.5, 300.0, 0.3),
        {"structure": 0.3, "activity": 0.35, "quality": 0.35},
    ),
    "relaxed": Preset("relaxed"),
    "research": Preset(
        "research",
        Thresholds(0.005, 180, 1, 0.2, 800.0, 0.6),
        {"structure": 0.25, "activity": 0.25, "quality": 0.5},
    ),
}


def find_preset(name: str) -> Preset:
    """Presets are a fixed table of three, looked up before anything is planned."""
    if name not in PRESETS:
        raise ValueError(f"unknown metrics preset: {name}")
    return PRESETS[name]


# Metrics


LINE_SUMS = ("total_lines", "blank_lines", "non_blank_lines")
# The maps of the structural metrics: their column of the file features and its known values.
FILE_MAPS = {
    "languages": ("language", sorted(set(LANGUAGES.values()))),
    "file_categories": ("category", sorted(CATEGORIES)),
}


def structural_totals(files: DataFrame) -> DataFrame:
    """Line totals and files per language and category.

    One narrow pass over the contents and one shuffle of partial counts: languages and categories
    are known in advance, so each is a conditional count of the same aggregate.
    """
    counts = {
        f"_{column}_{value}": f"count_if({column} = {lit(value)})"
        for column, values in FILE_MAPS.values()
        for value in values
    }
    sums = {c: f"sum({c})" for c in LINE_SUMS}
    return file_features(listed(files)).groupBy("repo").agg(
        *exprs(**sums, files_counted="count(*)", **counts)
    )


def structural_columns() -> dict[str, str]:
    """Columns over ``structural_totals``; the maps have sorted keys and no zero counts."""

    def counted(column: str, values: list[str]) -> str:
        pairs = ", ".join(f"{lit(v)}, coalesce(`_{column}_{v}`, 0L)" for v in values)
        return f"map_filter(map({pairs}), (k, n) -> n > 0)"

    plain = {c: f"coalesce({c}, 0L)" for c in (*LINE_SUMS, "files_counted")}
    return {**plain, **{name: counted(*kind) for name, kind in FILE_MAPS.items()}}


def structural_metrics(repos: DataFrame, files: DataFrame) -> DataFrame:
    totals = per_repo(repos, structural_totals(files))
    return totals.select("repo", *exprs(**structural_columns()))


def activity_columns(as_of: datetime) -> dict[str, str]:
    return {**history.frequency_columns(), **history.inactivity_columns(as_of)}


def activity_metrics(repos: DataFrame, commits: DataFrame, as_of: datetime) -> DataFrame:
    totals = per_repo(repos, history.activity_totals(commits))
    return totals.select("repo", *exprs(**activity_columns(as_of)))


def quality_columns() -> dict[str, str]:
    return {
        "bus_factor": "coalesce(bus_factor, 0L)",
        "meaningful_commit_ratio": history.message_columns()["meaningful_ratio"],
        "churn_average": "coalesce(average_churn, 0.0D)",
        "merge_ratio": history.merge_columns()["merge_ratio"],
    }


def _history_parts(
    commits: DataFrame, commit_files: DataFrame, max_commits: int | None
) -> tuple[DataFrame, DataFrame]:
    chosen = history.prepared(commits, max_commits)
    churn = history.average_churn(history.impact_of(commit_files, chosen, max_commits))
    return history.history_totals(chosen), churn


def history_metrics(
    repos: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    max_commits: int | None = None,
) -> DataFrame:
    """Activity metrics and quality signals from one reading of the history."""
    totals = per_repo(repos, *_history_parts(commits, commit_files, max_commits))
    return totals.select("repo", *exprs(**activity_columns(as_of), **quality_columns()))


def quality_signals(
    repos: DataFrame, commits: DataFrame, commit_files: DataFrame, max_commits: int | None = None
) -> DataFrame:
    totals = per_repo(repos, *_history_parts(commits, commit_files, max_commits))
    return totals.select("repo", *exprs(**quality_columns()))


def repository_metrics(
    repos: DataFrame,
    files: DataFrame,
    commits: DataFrame,
    commit_files: DataFrame,
    as_of: datetime,
    max_commits: int | None = None,
) -> DataFrame:
    """The ``repo_metrics`` table, flat: structure, activity and quality of every repository.

    Each base table is scanned once and folded to one row per repository before any join.
    """
    parts = (structural_totals(files), *_history_parts(commits, commit_files, max_commits))
    columns = {**structural_columns(), **activity_columns(as_of), **quality_columns()}
    return per_repo(repos, *parts).select(
        "repo", *exprs(**columns, generated_at=history.moment(as_of))
    )


# Scores


def structure_score() -> dict[str, str]:
    def part(category: str) -> str:
        return scores.ratio(f"coalesce(try_element_at(file_categories, '{category}'), 0L)", "files_counted")

    parts = {
        "language_diversity": scores.clamp("(size(languages) / 5.0D)"),
        "test_coverage_proxy": part("test"),
        "documentation_proxy": part("docs"),
    }
    return {**parts, "structure_score": scores.clamp(f"(({' + '.join(parts)}) / 3.0D)")}


def activity_score(thresholds: Thresholds = DEFAULT_THRESHOLDS) -> dict[str, str]:
    """Recency counts for inactive repositories only; an active one has 0 there."""
    recency = scores.inverse("days_since_last_commit", thresholds.max_days_inactive)
    return {
        "frequency": scores.ratio("commits_per_day", f"{thresholds.min_commits_per_day}D"),
        "recency": f"if(inactive AND days_since_last_commit IS NOT NULL, {recency}, 0.0D)",
        "activity_score": scores.clamp("((frequency + recency) / 2.0D)"),
    }


def quality_score(thresholds: Thresholds = DEFAULT_THRESHOLDS) -> dict[str, str]:
    parts = {
        "bus_factor_score": scores.ratio("bus_factor", str(thresholds.min_bus_factor)),
        "commit_messages": scores.clamp("meaningful_commit_ratio"),
        "churn": scores.inverse("churn_average", thresholds.max_average_churn),
        "merges": scores.inverse("merge_ratio", thresholds.max_merge_ratio),
    }
    return {**parts, "quality_score": scores.clamp(f"(({' + '.join(parts)}) / 4.0D)")}


def with_scores(
    metrics: DataFrame,
    weights: dict[str, float] | None = None,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
) -> DataFrame:
    """Add the section scores and the weighted total.

    Sections use the default thresholds whatever the preset, unless others are passed here.
    A later expression refers to an earlier one of its select by name.
    """
    sections = {**structure_score(), **activity_score(thresholds), **quality_score(thresholds)}
    scored = metrics.select("*", *exprs(**sections))
    return scored.withColumn("total_score", F.expr(total_score(weights)))


def total_score(weights: dict[str, float] | None = None) -> str:
    """Weighted total over the section scores."""
    w = weights or DEFAULT_WEIGHTS
    total = (
        f"structure_score * {w['structure']}D + activity_score * {w['activity']}D "
        f"+ quality_score * {w['quality']}D"
    )
    return f"round({scores.clamp(f'({total})')}, 3)"


def risk_flags(thresholds: Thresholds = DEFAULT_THRESHOLDS) -> str:
    t = thresholds
    rules = {
        "inactive_repository": "inactive",
        "low_bus_factor": f"bus_factor < {t.min_bus_factor}",
        "poor_commit_messages": f"meaningful_commit_ratio < {t.min_meaningful_commit_ratio}D",
        "high_churn": f"churn_average > {t.max_average_churn}D",
        "excessive_merges": f"merge_ratio > {t.max_merge_ratio}D",
    }
    return present_only(*[f"CASE WHEN {holds} THEN '{flag}' END" for flag, holds in rules.items()])


# Comparison


def compare_repositories(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences a - b for the pairs ``(a, b)`` of repository names that are given.

    Pairs are turned into two rows each, so the metrics are computed and joined once.
    """
    values = {
        "total_score_diff": "total_score",
        "commits_per_day_diff": "commits_per_day",
        "bus_factor_diff": "bus_factor",
        "meaningful_commit_ratio_diff": "meaningful_commit_ratio",
    }
    scored = with_scores(metrics).select("repo", *values.values())
    sides = pairs.distinct().selectExpr(
        "a", "b", "inline(array(struct(a AS repo, 1 AS sign), struct(b AS repo, -1 AS sign)))"
    )
    differences = exprs(**{k: f"sum(sign * {v})" for k, v in values.items()}, sides="count(*)")
    compared = join_hot(sides, scored, ["repo"], ["a", "b"], ways=8).groupBy("a", "b").agg(*differences)
    return compared.where("sides = 2").drop("sides")


DELTA_COLUMNS = (
    "commits_per_day", "days_active", "bus_factor", "meaningful_commit_ratio", "churn_average",
)


def metric_deltas(snapshots: DataFrame, columns: tuple[str, ...] = DELTA_COLUMNS) -> DataFrame:
    """Change of each metric since the previous snapshot of the repository; NULL for the first."""
    before = "OVER (PARTITION BY repo ORDER BY snapshot_at)"
    deltas = {f"{c}_delta": f"round(double({c}) - double(lag({c}) {before}), 4)" for c in columns}
    return snapshots.select("repo", "snapshot_at", *exprs(**deltas))
