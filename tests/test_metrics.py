from __future__ import annotations

from datetime import datetime

import pytest

from forgelens import tables
from forgelens.operators import metrics as m
from forgelens.plans import metrics_reports as reports

AS_OF = datetime(2024, 6, 1)


@pytest.fixture
def base(spark):
    """A repository with files and commits, one with files only, one with commits only, one empty."""
    files = spark.createDataFrame(
        [
            ("full", 1, "README.md", b"# t\n"), ("full", 2, "src/a.py", b"x = 1\n\n"), ("full", 3, "tests/test_a.py", b"pass\n"),
            ("files", 1, "a.go", b"package a\n"),
        ],
        "repo string, seq bigint, path string, content binary",
    ).selectExpr("*", "bigint(length(content)) AS size_bytes", "false AS is_symlink", "false AS is_executable")
    commits = spark.createDataFrame(
        [
            ("full", 1, "h2", "Dev", "dev@test.com", datetime(2024, 5, 2), "add proper feature"),
            ("full", 2, "h1", "Dev", "dev@test.com", datetime(2024, 5, 1), "fix"),
            ("commits", 1, "c1", "X", "x@test.com", datetime(2024, 1, 1), "Merge branch"),
        ],
        tables.COMMITS,
    )
    changes = spark.createDataFrame([("full", "h1", 1, "src/a.py", 10, 2), ("full", "h2", 1, "src/a.py", 1, 1)], tables.COMMIT_FILES)
    repos = spark.createDataFrame([(r,) for r in ("full", "files", "commits", "empty")], tables.REPOS)
    return repos, tables.with_file_defaults(files), commits, changes


@pytest.fixture
def metrics(base):
    return m.repository_metrics(*base, AS_OF)


def by_repo(df):
    return {r.repo: r for r in df.collect()}


def test_metrics_of_every_repository(metrics):
    found = by_repo(metrics)
    full = found["full"]
    assert (full.total_lines, full.files_counted, full.blank_lines) == (4, 3, 1)
    assert full.languages == {"markdown": 1, "python": 2}
    assert full.file_categories == {"docs": 1, "source": 1, "test": 1}
    assert (full.total_commits, full.days_active, full.commits_per_day, full.inactive) == (2, 2, 1.0, False)
    assert (full.bus_factor, full.meaningful_commit_ratio, full.churn_average, full.merge_ratio) == (1, 0.5, 14.0, 0.0)
    assert found["files"].languages == {"go": 1} and found["files"].inactive
    assert (found["commits"].merge_ratio, found["commits"].files_counted) == (1.0, 0)
    empty = found["empty"]
    assert (empty.total_commits, empty.commits_per_day, empty.bus_factor, empty.churn_average) == (0, 0.0, 0, 0.0)
    assert empty.inactive and empty.days_since_last_commit is None and empty.languages == {}


def test_parts_agree_with_the_whole(base, metrics):
    repos, files, commits, changes = base
    whole = by_repo(metrics)
    parts = (
        m.structural_metrics(repos, files),
        m.activity_metrics(repos, commits, AS_OF),
        m.quality_signals(repos, commits, changes),
        m.history_metrics(repos, commits, changes, AS_OF),
    )
    for part in parts:
        for row in part.collect():
            for name, value in row.asDict().items():
                assert value == whole[row.repo][name], (row.repo, name)


def test_scores(metrics):
    found = by_repo(m.with_scores(metrics))
    full = found["full"]
    assert full.structure_score == pytest.approx((0.4 + 1 / 3 + 1 / 3) / 3)
    assert (full.frequency, full.recency, full.activity_score) == (1.0, 0.0, 0.5)
    assert full.quality_score == pytest.approx((0.5 + 0.5 + (1 - 14 / 500) + 1.0) / 4)
    expected = full.structure_score * 0.3 + 0.5 * 0.3 + full.quality_score * 0.4
    assert full.total_score == round(expected, 3)
    stale = found["commits"]
    assert stale.days_since_last_commit == 152 and stale.recency == 0.0
    assert found["empty"].activity_score == 0.0


def test_flags_and_presets(metrics):
    relaxed = by_repo(reports.metrics_report(metrics))
    assert relaxed["full"].risk_flags == ["low_bus_factor"]
    assert relaxed["commits"].risk_flags == ["inactive_repository", "low_bus_factor", "excessive_merges"]
    assert relaxed["empty"].risk_flags == ["inactive_repository", "low_bus_factor", "poor_commit_messages"]
    research = by_repo(reports.metrics_report(metrics, "research"))
    assert research["full"].risk_flags == []
    with pytest.raises(ValueError):
        reports.metrics_report(metrics, "nonsense")


def test_evaluation(metrics):
    found = by_repo(reports.full_evaluation(metrics, "strict"))["full"]
    assert (found.activity_trend, found.churn_stability, found.bus_factor_risk) == ("high", "stable", "high")
    assert found.activity_explanation == "Activity score 0.5 (grade D)"
    assert found.overall_score == found.total_score
    summary = by_repo(reports.evaluation_summary(metrics, "strict"))["full"]
    assert summary.grade == found.grade
    compact = by_repo(reports.compact_metrics_report(metrics))["full"]
    assert (compact.languages, compact.files, compact.bus_factor) == (2, 3, 1)


def test_comparison(spark, metrics):
    pairs = spark.createDataFrame([("full", "empty"), ("empty", "full"), ("full", "missing")], "a string, b string")
    found = {(r.a, r.b): r for r in m.compare_repositories(metrics, pairs).collect()}
    assert set(found) == {("full", "empty"), ("empty", "full")}
    assert found["full", "empty"].bus_factor_diff == 1
    assert found["full", "empty"].commits_per_day_diff == 1.0
    assert found["full", "empty"].total_score_diff == -found["empty", "full"].total_score_diff


def test_deltas(spark):
    schema = (
        "repo string, snapshot_at string, commits_per_day double, days_active bigint, bus_factor bigint, "
        "meaningful_commit_ratio double, churn_average double"
    )
    snapshots = spark.createDataFrame(
        [("r", "2024-02", 0.3, 12, 2, 0.5, 9.0), ("r", "2024-01", 0.1, 10, 3, 0.25, 9.5), ("s", "2024-01", 1.0, 1, 1, 1.0, 1.0)], schema
    )
    found = {(r.repo, r.snapshot_at): r for r in m.metric_deltas(snapshots).collect()}
    assert found["r", "2024-01"].bus_factor_delta is None and found["s", "2024-01"].churn_average_delta is None
    later = found["r", "2024-02"]
    assert (later.commits_per_day_delta, later.days_active_delta, later.bus_factor_delta) == (0.2, 2.0, -1.0)
    assert (later.meaningful_commit_ratio_delta, later.churn_average_delta) == (0.25, -0.5)


def test_base_tables_are_scanned_once(base):
    plan = m.repository_metrics(*base, AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 4
