"""Queries over repository metrics: history from orders, structure from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions import scores
from forgelens.functions.sql import exprs
from forgelens.operators import metrics as m
from forgelens.operators.files import derive_dirs
from forgelens.plans import metrics_reports as reports
from forgelens.queries.common import AS_OF, query
from forgelens.queries.history import authors_normalized
from forgelens.sources.adapters import Inputs
from forgelens.tables import repos_of

REPO_OF_DOCUMENT = (
    "CASE seq % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' "
    "WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END"
)


def fleet_files(x: Inputs) -> DataFrame:
    """Documents spread over the repositories that have a history."""
    return x.files.withColumn("repo", F.expr(REPO_OF_DOCUMENT))


def metrics_of(x: Inputs) -> DataFrame:
    return m.repository_metrics(repos_of(x.commits), fleet_files(x), x.commits, x.commit_files, AS_OF)


METRICS = f""", ff AS (SELECT * REPLACE ({REPO_OF_DOCUMENT} AS repo) FROM fx),
  st AS (SELECT repo, CAST(sum(total_lines) AS BIGINT) AS total_lines, count(*) AS files_counted, CAST(sum(blank_lines) AS BIGINT) AS blank_lines,
           CAST(sum(total_lines - blank_lines) AS BIGINT) AS non_blank_lines, count(DISTINCT language) AS languages,
           count(*) FILTER (category = 'test') AS tests, count(*) FILTER (category = 'docs') AS docs FROM ff WHERE NOT excluded GROUP BY repo),
  mx AS (SELECT hist.*, st.* EXCLUDE (repo), average_churn AS churn_average FROM hist JOIN st USING (repo) JOIN churn USING (repo)),
  sc AS (SELECT *, least(1.0, languages / 5.0e0) AS language_diversity, tests / CAST(files_counted AS DOUBLE) AS test_coverage_proxy,
           docs / CAST(files_counted AS DOUBLE) AS documentation_proxy, least(1.0, commits_per_day / 0.01e0) AS frequency,
           CASE WHEN inactive THEN CASE WHEN days_since_last_commit <= 0 THEN 1.0e0 ELSE greatest(0.0, 1 - days_since_last_commit / 120.0e0) END ELSE 0.0e0 END AS recency,
           least(1.0, bus_factor / 2.0e0) AS bus_factor_score, meaningful_ratio AS commit_messages,
           CASE WHEN churn_average <= 0 THEN 1.0e0 ELSE greatest(0.0, 1 - churn_average / 500.0e0) END AS churn,
           CASE WHEN merge_ratio <= 0 THEN 1.0e0 ELSE greatest(0.0, 1 - merge_ratio / 0.5e0) END AS merges FROM mx),
  sec AS (SELECT *, (language_diversity + test_coverage_proxy + documentation_proxy) / 3.0e0 AS structure_score, (frequency + recency) / 2.0e0 AS activity_score,
           (bus_factor_score + commit_messages + churn + merges) / 4.0e0 AS quality_score FROM sc)
"""
USES = "fx hist churn"


def total(structure: str, activity: str, quality: str) -> str:
    return f"round(structure_score * {structure}e0 + activity_score * {activity}e0 + quality_score * {quality}e0, 3)"


RELAXED, STRICT, RESEARCH = total("0.3", "0.3", "0.4"), total("0.3", "0.35", "0.35"), total("0.25", "0.25", "0.5")


def flags(bus: int, messages: str, churn: str, merges: str) -> str:
    return f"""concat_ws(',', CASE WHEN inactive THEN 'inactive_repository' END, CASE WHEN bus_factor < {bus} THEN 'low_bus_factor' END,
      CASE WHEN meaningful_ratio < {messages} THEN 'poor_commit_messages' END, CASE WHEN churn_average > {churn} THEN 'high_churn' END,
      CASE WHEN merge_ratio > {merges} THEN 'excessive_merges' END)"""


# Scalars

@query(
    "scalar_scores",
    """SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, (l_quantity - 10) / 20.0e0)) AS clamped,
         CASE WHEN l_linenumber - 3 <= 0 THEN 0.5e0 ELSE least(1.0, greatest(0.0, l_quantity / (l_linenumber - 3))) END AS ratio,
         CASE WHEN l_quantity - 5 <= 0 THEN 1.0e0 ELSE least(1.0, greatest(0.0, 1 - (l_quantity - 5) / 30.0e0)) END AS inverse,
         CASE WHEN l_discount >= 0.1 THEN 'high' WHEN l_discount >= 0.01 THEN 'moderate' ELSE 'low' END AS trend,
         CASE WHEN l_quantity * 20 <= 200 THEN 'stable' WHEN l_quantity * 20 <= 600 THEN 'moderate' ELSE 'volatile' END AS stability,
         CASE WHEN l_linenumber >= 4 THEN 'low' WHEN l_linenumber >= 2 THEN 'medium' ELSE 'high' END AS risk,
         CASE WHEN l_quantity / 50 >= 0.85 THEN 'A' WHEN l_quantity / 50 >= 0.7 THEN 'B' WHEN l_quantity / 50 >= 0.55 THEN 'C' ELSE 'D' END AS grade
       FROM lineitem""",
)
def scalar_scores(x: Inputs) -> DataFrame:
    return x.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *exprs(
            clamped=scores.clamp("((l_quantity - 10) / 20.0D)"),
            ratio=scores.ratio("l_quantity", "(l_linenumber - 3)", default=0.5),
            inverse=scores.inverse("(l_quantity - 5)", 30),
            trend=scores.activity_trend("l_discount"),
            stability=scores.churn_stability("(l_quantity * 20)"),
            risk=scores.bus_factor_risk("l_linenumber"),
            grade=scores.grade("(l_quantity / 50)"),
        ),
    )


# Metrics

@query(
    "structural_metrics",
    METRICS + "SELECT repo, total_lines, files_counted, blank_lines, non_blank_lines, languages, tests, docs FROM st",
    USES,
)
def structural_metrics(x: Inputs) -> DataFrame:
    metrics = m.structural_metrics(repos_of(x.commits), fleet_files(x))
    categories = F.col("file_categories")
    return metrics.select(
        "repo",
        "total_lines",
        "files_counted",
        "blank_lines",
        "non_blank_lines",
        F.size("languages").cast("bigint").alias("languages"),
        F.coalesce(F.try_element_at(categories, F.lit("test")), F.lit(0)).alias("tests"),
        F.coalesce(F.try_element_at(categories, F.lit("docs")), F.lit(0)).alias("docs"),
    )


@query(
    "structural_maps",
    METRICS + """, l AS (SELECT repo, 'language' AS kind, language AS key, count(*) AS files FROM ff WHERE NOT excluded AND language IS NOT NULL GROUP BY 1, 3)
      SELECT * FROM l UNION ALL SELECT repo, 'category', category, count(*) FROM ff WHERE NOT excluded GROUP BY 1, 3""",
    USES,
)
def structural_maps(x: Inputs) -> DataFrame:
    metrics = m.structural_metrics(repos_of(x.commits), fleet_files(x))

    def rows(kind: str, column: str) -> DataFrame:
        return metrics.select("repo", F.lit(kind).alias("kind"), F.explode(column).alias("key", "files"))

    return rows("language", "languages").unionByName(rows("category", "file_categories"))


@query(
    "activity_metrics",
    "SELECT repo, total_commits, commits_per_day, days_active, inactive, days_since_last_commit FROM hist",
    "hist",
)
def activity_metrics(x: Inputs) -> DataFrame:
    return m.activity_metrics(repos_of(x.commits), authors_normalized(x), AS_OF)


@query(
    "quality_signals",
    "SELECT repo, bus_factor, meaningful_ratio AS meaningful_commit_ratio, average_churn AS churn_average, merge_ratio FROM hist JOIN churn USING (repo)",
    "hist churn",
)
def quality_signals(x: Inputs) -> DataFrame:
    return m.quality_signals(repos_of(x.commits), x.commits, x.commit_files)


@query(
    "section_scores",
    METRICS + """SELECT repo, round(language_diversity, 9) AS language_diversity, round(test_coverage_proxy, 9) AS test_coverage_proxy,
       round(documentation_proxy, 9) AS documentation_proxy, round(structure_score, 9) AS structure_score, round(frequency, 9) AS frequency,
       round(recency, 9) AS recency, round(activity_score, 9) AS activity_score, round(bus_factor_score, 9) AS bus_factor_score,
       round(commit_messages, 9) AS commit_messages, round(churn, 9) AS churn, round(merges, 9) AS merges, round(quality_score, 9) AS quality_score FROM sec""",
    USES,
)
def section_scores(x: Inputs) -> DataFrame:
    scored = m.with_scores(metrics_of(x))
    names = [*m.structure_score(), *m.activity_score(), *m.quality_score()]
    return scored.select("repo", *[F.round(n, 9).alias(n) for n in names])


@query(
    "composite_scores",
    METRICS + f"""SELECT repo, 'relaxed' AS preset, {RELAXED} AS total_score FROM sec UNION ALL SELECT repo, 'strict', {STRICT} FROM sec
                  UNION ALL SELECT repo, 'research', {RESEARCH} FROM sec""",
    USES,
)
def composite_scores(x: Inputs) -> DataFrame:
    totals = [f"struct('{p.name}' AS preset, {m.total_score(p.weights)} AS total_score)" for p in m.PRESETS.values()]
    return m.with_scores(metrics_of(x)).selectExpr("repo", f"inline(array({', '.join(totals)}))")


@query(
    "risk_flags",
    METRICS + f"""SELECT repo, {flags(2, "0.3", "500", "0.5")} AS relaxed, {flags(3, "0.5", "300", "0.3")} AS strict,
                  {flags(1, "0.2", "800", "0.6")} AS research FROM sec""",
    USES,
)
def risk_flags(x: Inputs) -> DataFrame:
    return metrics_of(x).select(
        "repo",
        *exprs(**{p.name: f"array_join({m.risk_flags(p.thresholds)}, ',')" for p in m.PRESETS.values()}),
    )


REPORT = (
    "repo", "total_lines", "files_counted", "blank_lines", "non_blank_lines", "languages", "total_commits",
    "commits_per_day", "days_active", "inactive", "days_since_last_commit", "bus_factor",
    "meaningful_commit_ratio", "churn_average", "merge_ratio", "preset", "total_score", "risk_flags",
)


def comparable(report: DataFrame) -> DataFrame:
    return report.withColumns(
        {
            "languages": F.size("languages").cast("bigint"),
            "risk_flags": F.array_join("risk_flags", ","),
        }
    ).select(*REPORT)


def report_sql(preset: str, score: str, flag_text: str) -> str:
    return METRICS + f"""SELECT repo, total_lines, files_counted, blank_lines, non_blank_lines, languages, total_commits, commits_per_day, days_active, inactive,
      days_since_last_commit, bus_factor, meaningful_ratio AS meaningful_commit_ratio, churn_average, merge_ratio, '{preset}' AS preset,
      {score} AS total_score, {flag_text} AS risk_flags FROM sec"""


@query("repository_metrics_report", report_sql("relaxed", RELAXED, flags(2, "0.3", "500", "0.5")), USES)
def repository_metrics_report(x: Inputs) -> DataFrame:
    repos = repos_of(x.commits)
    return comparable(
        reports.analyze_repositories(repos, fleet_files(x), x.commits, x.commit_files, AS_OF)
    )


@query("strict_metrics_report", report_sql("strict", STRICT, flags(3, "0.5", "300", "0.3")), USES)
def strict_metrics_report(x: Inputs) -> DataFrame:
    repos = repos_of(x.commits)
    return comparable(
        reports.analyze_repositories(repos, fleet_files(x), x.commits, x.commit_files, AS_OF, "strict")
    )


@query(
    "compact_metrics_report",
    METRICS + f"SELECT repo, {RELAXED} AS score, inactive, bus_factor, commits_per_day, languages, files_counted AS files FROM sec",
    USES,
)
def compact_metrics_report(x: Inputs) -> DataFrame:
    return reports.analyze_repositories_compact(
        repos_of(x.commits), fleet_files(x), x.commits, x.commit_files, AS_OF
    )


@query(
    "evaluation_summary",
    METRICS + f""", g AS (SELECT *, {RELAXED} AS overall_score FROM sec)
      SELECT repo, overall_score, CASE WHEN overall_score >= 0.85 THEN 'A' WHEN overall_score >= 0.7 THEN 'B' WHEN overall_score >= 0.55 THEN 'C' ELSE 'D' END AS grade,
        CASE WHEN commits_per_day >= 0.1 THEN 'high' WHEN commits_per_day >= 0.01 THEN 'moderate' ELSE 'low' END AS activity_trend,
        CASE WHEN churn_average <= 200 THEN 'stable' WHEN churn_average <= 600 THEN 'moderate' ELSE 'volatile' END AS churn_stability,
        CASE WHEN bus_factor >= 4 THEN 'low' WHEN bus_factor >= 2 THEN 'medium' ELSE 'high' END AS bus_factor_risk,
        'Structure score ' || structure_score || ' (grade ' || CASE WHEN structure_score >= 0.85 THEN 'A' WHEN structure_score >= 0.7 THEN 'B'
           WHEN structure_score >= 0.55 THEN 'C' ELSE 'D' END || ')' AS structure_explanation,
        'Activity score ' || activity_score || ' (grade ' || CASE WHEN activity_score >= 0.85 THEN 'A' WHEN activity_score >= 0.7 THEN 'B'
           WHEN activity_score >= 0.55 THEN 'C' ELSE 'D' END || ')' AS activity_explanation,
        'Quality score ' || quality_score || ' (grade ' || CASE WHEN quality_score >= 0.85 THEN 'A' WHEN quality_score >= 0.7 THEN 'B'
           WHEN quality_score >= 0.55 THEN 'C' ELSE 'D' END || ')' AS quality_explanation FROM g""",
    USES,
)
def evaluation_summary(x: Inputs) -> DataFrame:
    full = reports.full_evaluation(metrics_of(x))
    return full.select(
        "repo", "overall_score", "grade", "activity_trend", "churn_stability", "bus_factor_risk",
        "structure_explanation", "activity_explanation", "quality_explanation",
    )


@query(
    "metrics_raw_scans",
    """SELECT repo, 'quick' AS part, count(*) FILTER (NOT excluded) AS files, CAST(coalesce(sum(size_bytes) FILTER (NOT excluded), 0) AS BIGINT) AS bytes FROM lined GROUP BY repo
       UNION ALL SELECT repo, 'detailed', count(*) FILTER (NOT excluded AND NOT is_symlink),
         CAST(coalesce(sum(size_bytes) FILTER (NOT excluded AND NOT is_symlink), 0) AS BIGINT) FROM lined GROUP BY repo""",
    "lined",
)
def metrics_raw_scans(x: Inputs) -> DataFrame:
    """The scans that the metrics carry on request."""
    found = reports.metrics_with_raw(
        repos_of(x.files), x.files, derive_dirs(x.files), x.commits, x.commit_files, AS_OF, include_raw=True
    )

    def part(key: str, label: str) -> DataFrame:
        return found[key].selectExpr("repo", f"'{label}' AS part", "total_files AS files", "total_size_bytes AS bytes")

    return part("filesystem_quick", "quick").unionByName(part("filesystem_detailed_summary", "detailed"))


@query(
    "repository_comparison",
    METRICS + f""", t AS (SELECT *, {RELAXED} AS total_score FROM sec)
      SELECT a.repo AS a, b.repo AS b, round(a.total_score - b.total_score, 9) AS total_score_diff, round(a.commits_per_day - b.commits_per_day, 9) AS commits_per_day_diff,
        a.bus_factor - b.bus_factor AS bus_factor_diff, round(a.meaningful_ratio - b.meaningful_ratio, 9) AS meaningful_commit_ratio_diff
      FROM t a JOIN t b ON b.repo = '1-URGENT' AND a.repo <> b.repo""",
    USES,
)
def repository_comparison(x: Inputs) -> DataFrame:
    repos = repos_of(x.commits)
    pairs = repos.where("repo <> '1-URGENT'").select(F.col("repo").alias("a"), F.lit("1-URGENT").alias("b"))
    compared = m.compare_repositories(metrics_of(x), pairs)
    doubles = ("total_score_diff", "commits_per_day_diff", "meaningful_commit_ratio_diff")
    return compared.withColumns({c: F.round(c, 9) for c in doubles})


@query(
    "metric_deltas",
    """, mc AS (SELECT *, repo || '|' || strftime(authored_at, '%Y-%m') AS rm FROM c),
       sn AS (SELECT rm, repo, strftime(authored_at, '%Y-%m') AS snapshot_at,
            greatest(CAST(floor((epoch(max(authored_at)) - epoch(min(authored_at))) / 86400) AS BIGINT) + 1, 1) AS days_active,
            round(count(*) / CAST(greatest(CAST(floor((epoch(max(authored_at)) - epoch(min(authored_at))) / 86400) AS BIGINT) + 1, 1) AS DOUBLE), 3) AS commits_per_day,
            round(count(*) FILTER (length(trim(message)) >= 10) / CAST(count(*) AS DOUBLE), 3) AS meaningful_commit_ratio FROM mc GROUP BY 1, 2, 3),
       ac AS (SELECT rm, author_email, count(*) AS n, min(seq) AS fs FROM mc GROUP BY 1, 2),
       aw AS (SELECT *, sum(n) OVER (PARTITION BY rm ORDER BY n DESC, fs ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY rm) AS tot,
                row_number() OVER (PARTITION BY rm ORDER BY n DESC, fs) AS rn FROM ac),
       ab AS (SELECT rm, count(*) AS bus_factor FROM aw WHERE rn = 1 OR CAST(cum - n AS DOUBLE) / tot < 0.5 GROUP BY rm),
       fi AS (SELECT rm, path, sum(insertions + deletions) AS v FROM mc JOIN commit_files USING (repo, commit_hash) GROUP BY 1, 2),
       ch AS (SELECT rm, CAST((sum(v) * 200 + count(*)) // (2 * count(*)) AS BIGINT) / 100.0e0 AS churn_average FROM fi GROUP BY rm),
       al AS (SELECT sn.*, bus_factor, coalesce(churn_average, 0) AS churn_average FROM sn JOIN ab USING (rm) LEFT JOIN ch USING (rm))
       SELECT repo, snapshot_at, round(commits_per_day - lag(commits_per_day) OVER w, 4) AS commits_per_day_delta,
         CAST(days_active - lag(days_active) OVER w AS DOUBLE) AS days_active_delta, CAST(bus_factor - lag(bus_factor) OVER w AS DOUBLE) AS bus_factor_delta,
         round(meaningful_commit_ratio - lag(meaningful_commit_ratio) OVER w, 4) AS meaningful_commit_ratio_delta,
         round(churn_average - lag(churn_average) OVER w, 4) AS churn_average_delta
       FROM al WINDOW w AS (PARTITION BY repo ORDER BY snapshot_at)""",
    "c commit_files",
)
def metric_deltas(x: Inputs) -> DataFrame:
    """One snapshot per repository and month, each over the commits of that month."""
    month = F.substring(F.col("authored_at").cast("string"), 1, 7)
    keyed = x.commits.withColumn("_key", F.concat_ws("|", "repo", month))
    files = x.commit_files.join(keyed.select("repo", "commit_hash", "_key"), ["repo", "commit_hash"])
    commits = keyed.withColumn("repo", F.col("_key")).drop("_key")
    changes = files.withColumn("repo", F.col("_key")).drop("_key")
    monthly = m.history_metrics(repos_of(commits), commits, changes, AS_OF)
    snapshots = monthly.withColumns(
        {
            "snapshot_at": F.substring_index("repo", "|", -1),
            "repo": F.substring_index("repo", "|", 1),
        }
    )
    return m.metric_deltas(snapshots)
