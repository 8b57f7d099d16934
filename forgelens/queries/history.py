"""Queries over commit histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions.sql import exprs
from forgelens.operators import history as h
from forgelens.operators.skew import row_numbers
from forgelens.plans import history_reports as reports
from forgelens.queries.common import AS_OF, query
from forgelens.sources import commit_log
from forgelens.sources.adapters import Inputs
from forgelens.tables import repos_of


def authors_normalized(x: Inputs) -> DataFrame:
    return h.normalize_authors(x.commits)


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query(
    "parse_commit_log",
    """SELECT repo, seq, commit_hash, author_name, author_email, CAST(authored_at AS VARCHAR) AS authored_at,
              message || CASE WHEN seq % 3 = 0 THEN '|tail|' ELSE '' END AS message
       FROM commits WHERE seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0""",
    "commits",
)
def parse_commit_log(x: Inputs) -> DataFrame:
    at = F.col("authored_at")
    days = F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    good = F.concat_ws("|", "commit_hash", "author_name", "author_email", seconds.cast("string"), "message")
    line = (
        F.when(F.col("seq") % 11 == 0, F.concat_ws("|", "commit_hash", "author_name"))
        .when(F.col("seq") % 13 == 0, F.concat_ws("|", "commit_hash", "author_name", "author_email", F.lit("now"), "message"))
        .when(F.col("seq") % 17 == 0, F.concat_ws("|", "commit_hash", F.lit("A|B"), "author_email", seconds.cast("string"), "message"))
        .when(F.col("seq") % 3 == 0, F.concat(good, F.lit("|tail|")))
        .otherwise(good)
    )
    return stamped(commit_log.parse_log_lines(x.commits.select("repo", "seq", line.alias("line"))), "authored_at")


@query(
    "parse_numstat",
    """SELECT repo, commit_hash, path, CASE WHEN ordinal = 5 THEN 0 ELSE insertions END AS insertions,
              CASE WHEN ordinal = 5 THEN 0 ELSE deletions END AS deletions
       FROM commit_files WHERE ordinal <> 6""",
    "commit_files",
)
def parse_numstat(x: Inputs) -> DataFrame:
    binary, broken = F.col("ordinal") == 5, F.col("ordinal") == 6
    ins = F.when(binary, "-").otherwise(F.col("insertions").cast("string"))
    dels = F.when(binary, "-").otherwise(F.col("deletions").cast("string"))
    line = F.when(broken, F.col("path")).otherwise(F.concat_ws("\t", ins, dels, "path"))
    return commit_log.parse_numstat_lines(x.commit_files.select("repo", "commit_hash", line.alias("line")))


@query(
    "normalized_authors",
    "SELECT repo, seq, author_name, author_email FROM c",
    "c",
)
def normalized_authors(x: Inputs) -> DataFrame:
    return authors_normalized(x).select("repo", "seq", "author_name", "author_email")


@query(
    "newest_commits",
    """SELECT repo, seq, commit_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM commits)
       WHERE rn <= 100""",
    "commits",
)
def newest_commits(x: Inputs) -> DataFrame:
    return h.newest_commits(x.commits, 100).select("repo", "seq", "commit_hash")


@query(
    "commit_positions",
    "SELECT repo, seq, row_number() OVER (PARTITION BY repo ORDER BY seq) AS position FROM commits",
    "commits",
)
def commit_positions(x: Inputs) -> DataFrame:
    return row_numbers(x.commits.select("repo", "seq"), ["repo"], "seq", "position")


@query(
    "newest_commits_large",
    """SELECT repo, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq
       FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM commits)
       WHERE rn <= 20000 GROUP BY repo""",
    "commits",
)
def newest_commits_large(x: Inputs) -> DataFrame:
    return h.newest_commits(x.commits, 20_000).groupBy("repo").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


LOGGED = """SELECT o_orderpriority AS repo, o_orderkey AS k, o_custkey AS customer, o_orderstatus AS status
  FROM orders WHERE o_orderkey % 23 <> 0 AND o_orderkey % 19 <> 0"""


@query(
    "commits_of_logs",
    f"""SELECT repo, k - k % 65536 + row_number() OVER (PARTITION BY repo, k // 65536 ORDER BY k) - 1 AS seq, CAST(k AS VARCHAR) AS commit_hash,
               'Dev ' || (customer % 37) AS author_name, 'dev' || (customer % 37) || '@example.com' AS author_email,
               TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1000000000 + customer) AS authored_at,
               CASE WHEN k % 6 = 1 THEN 'Merge a | b' ELSE 'order ' || status END AS message FROM ({LOGGED})""",
)
def commits_of_logs(x: Inputs) -> DataFrame:
    """The table of commits from exported logs; damaged headers and times that do not parse are left out."""
    return commit_log.commits_of(x.log_records)


LOGGED_LINE = """CASE WHEN l_linenumber % 4 = 0 THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END || chr(9) || l_linenumber
  || CASE WHEN l_partkey % 11 = 0 THEN '' ELSE chr(9) || 'mod' || l_partkey || '.py' END"""


@query(
    "commit_files_of_logs",
    f"""SELECT repo, commit_hash, ordinal, path, insertions, deletions FROM (
          SELECT repo, CAST(k AS VARCHAR) AS commit_hash, CAST(row_number() OVER (PARTITION BY k ORDER BY l_linenumber, {LOGGED_LINE}) - 1 AS INTEGER) AS ordinal,
                 'mod' || l_partkey || '.py' AS path, CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS insertions,
                 CAST(l_linenumber AS BIGINT) AS deletions, l_partkey FROM ({LOGGED}) JOIN lineitem ON k = l_orderkey) WHERE l_partkey % 11 <> 0""",
)
def commit_files_of_logs(x: Inputs) -> DataFrame:
    """The changes of the same commits; a line without its three fields takes a place but is no row."""
    return commit_log.commit_files_of(x.log_records)


@query(
    "commits_by_author",
    "SELECT repo, author_email, count(*) AS commits FROM c GROUP BY repo, author_email",
    "c",
)
def commits_by_author(x: Inputs) -> DataFrame:
    return h.commits_per_author(authors_normalized(x))


@query(
    "author_contributions",
    "SELECT repo, author_email, commits, insertions, deletions, first_seq FROM contrib",
    "contrib",
)
def author_contributions(x: Inputs) -> DataFrame:
    return h.author_contributions(h.attach_commit_stats(authors_normalized(x), x.commit_files))


@query(
    "commit_stats",
    "SELECT repo, commit_hash, files_changed, insertions, deletions FROM stats",
    "stats",
)
def commit_stats(x: Inputs) -> DataFrame:
    return h.commit_stats(x.commit_files)


@query(
    "commits_with_stats",
    "SELECT repo, commit_hash, files_changed, insertions, deletions FROM cs",
    "cs",
)
def commits_with_stats(x: Inputs) -> DataFrame:
    attached = h.attach_commit_stats(authors_normalized(x), x.commit_files)
    return attached.select("repo", "commit_hash", "files_changed", "insertions", "deletions")


@query(
    "commits_with_failed_stats",
    """SELECT repo, commit_hash, CASE WHEN seq % 9 <> 0 THEN files_changed END AS files_changed,
              CASE WHEN seq % 9 <> 0 THEN insertions END AS insertions, CASE WHEN seq % 9 <> 0 THEN deletions END AS deletions
       FROM cs""",
    "cs",
)
def commits_with_failed_stats(x: Inputs) -> DataFrame:
    failed = x.commits.where(F.col("seq") % 9 == 0).select("repo", "commit_hash")
    attached = h.attach_commit_stats(authors_normalized(x), x.commit_files, failed)
    return attached.select("repo", "commit_hash", "files_changed", "insertions", "deletions")


@query(
    "change_totals",
    """SELECT repo, CAST(sum(files_changed) AS BIGINT) AS files_changed, CAST(sum(insertions) AS BIGINT) AS total_insertions,
              CAST(sum(deletions) AS BIGINT) AS total_deletions FROM cs GROUP BY repo""",
    "cs",
)
def change_totals(x: Inputs) -> DataFrame:
    attached = h.attach_commit_stats(authors_normalized(x), x.commit_files)
    return h.change_totals(repos_of(x.commits), attached)


@query(
    "commit_file_impact",
    """SELECT repo, commit_hash, path, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions,
              CAST(sum(deletions) AS BIGINT) AS deletions FROM commit_files GROUP BY repo, commit_hash, path""",
    "commit_files",
)
def commit_file_impact(x: Inputs) -> DataFrame:
    return h.commit_file_impact(x.commit_files)


@query("file_impact", "SELECT repo, path, commits, insertions, deletions FROM impact", "impact")
def file_impact(x: Inputs) -> DataFrame:
    return h.file_impact(x.commit_files)


@query(
    "churn_against_mean",
    """SELECT repo, path, insertions + deletions AS churn, round(avg(insertions + deletions) OVER (PARTITION BY repo), 6) AS mean_churn,
              count(*) OVER (PARTITION BY repo) AS files FROM impact""",
    "impact",
)
def churn_against_mean(x: Inputs) -> DataFrame:
    shares = h.churn_against_mean(h.file_impact(x.commit_files))
    return shares.withColumn("mean_churn", F.round("mean_churn", 6))


@query(
    "churn",
    """SELECT repo, coalesce(files, 0) AS files, coalesce(high_churn_files, 0) AS high_churn_files,
              coalesce(average_churn, 0) AS average_churn FROM repos LEFT JOIN churn USING (repo)""",
    "repos churn",
)
def churn(x: Inputs) -> DataFrame:
    return h.churn(repos_of(x.commits), h.file_impact(x.commit_files))


@query(
    "churn_of_large_changes",
    """, part_impact AS (SELECT repo, path || CASE WHEN insertions > 45 THEN '#large' ELSE '#small' END AS path, sum(insertions + deletions) AS v FROM commit_files GROUP BY 1, 2),
       m AS (SELECT repo, path, v, avg(v) OVER (PARTITION BY repo) AS m FROM part_impact)
       SELECT repo, count(*) AS files, count(*) FILTER (v > 2 * m) AS high_churn_files, round(any_value(m), 2) AS average_churn
       FROM m GROUP BY repo""",
    "commit_files",
)
def churn_of_large_changes(x: Inputs) -> DataFrame:
    """Large and small changes of a file apart, so churn is uneven; every change takes part."""
    size = F.when(F.col("insertions") > 45, "#large").otherwise("#small")
    return h.churn(repos_of(x.commits), h.file_impact(x.commit_files.withColumn("path", F.concat("path", size))))


@query(
    "commit_frequency",
    "SELECT repo, total_commits, days_active, commits_per_day FROM hist",
    "hist",
)
def commit_frequency(x: Inputs) -> DataFrame:
    return h.commit_frequency(repos_of(x.commits), authors_normalized(x))


@query("inactivity", "SELECT repo, inactive, days_since_last_commit FROM hist", "hist")
def inactivity(x: Inputs) -> DataFrame:
    return h.inactivity(repos_of(x.commits), authors_normalized(x), AS_OF)


@query(
    "message_quality",
    "SELECT repo, total_commits AS total_messages, meaningful_messages, meaningful_ratio FROM hist",
    "hist",
)
def message_quality(x: Inputs) -> DataFrame:
    return h.message_quality(repos_of(x.commits), authors_normalized(x))


@query(
    "meaningful_messages",
    "SELECT repo, seq, length(trim(message)) >= 10 AS meaningful, lower(message) LIKE 'merge%' AS merge FROM commits",
    "commits",
)
def meaningful_messages(x: Inputs) -> DataFrame:
    return x.commits.select("repo", "seq", *exprs(meaningful=h.is_meaningful(), merge=h.is_merge()))


@query("merge_commits", "SELECT repo, merge_commits, merge_ratio FROM hist", "hist")
def merge_commits(x: Inputs) -> DataFrame:
    return h.merge_commits(repos_of(x.commits), authors_normalized(x))


@query(
    "commits_per_day",
    "SELECT repo, strftime(authored_at, '%Y-%m-%d') AS day, count(*) AS commits FROM c GROUP BY 1, 2",
    "c",
)
def commits_per_day(x: Inputs) -> DataFrame:
    return h.commits_per_day(x.commits)


@query(
    "commits_per_month",
    "SELECT repo, strftime(authored_at, '%Y-%m') AS month, count(*) AS commits FROM c GROUP BY 1, 2",
    "c",
)
def commits_per_month(x: Inputs) -> DataFrame:
    return h.commits_per_month(x.commits)


@query(
    "author_months",
    "SELECT repo, author_email, strftime(authored_at, '%Y-%m') AS month, count(*) AS commits FROM c GROUP BY 1, 2, 3",
    "c",
)
def author_months(x: Inputs) -> DataFrame:
    return h.author_months(authors_normalized(x))


@query("bus_factor", "SELECT repo, bus_factor FROM repos JOIN bus USING (repo)", "repos bus")
def bus_factor(x: Inputs) -> DataFrame:
    return h.bus_factor(repos_of(x.commits), h.author_ranks(authors_normalized(x)))


@query(
    "bus_factor_at_90_percent",
    """SELECT repo, count(*) AS bus_factor FROM ranked
       WHERE position = 1 OR CAST(cum - commits AS DOUBLE) / total < 0.9 GROUP BY repo""",
    "ranked",
)
def bus_factor_at_90_percent(x: Inputs) -> DataFrame:
    return h.bus_factor(repos_of(x.commits), h.author_ranks(authors_normalized(x)), 0.9)


@query(
    "dominant_authors",
    """SELECT repo, position, author_email, commits FROM ranked
       WHERE position = 1 OR CAST(cum - commits AS DOUBLE) / total < 0.5""",
    "ranked",
)
def dominant_authors(x: Inputs) -> DataFrame:
    return h.dominant_authors(h.author_ranks(authors_normalized(x)))


@query(
    "dominant_customers_with_ties",
    """, t AS (SELECT repo, author_name AS author_email, count(*) AS commits, min(seq) AS first_seq FROM
               (SELECT o_orderpriority AS repo, CAST(o_custkey AS VARCHAR) AS author_name, o_orderkey AS seq FROM orders) GROUP BY 1, 2),
       r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commits DESC, first_seq) AS position,
                    sum(commits) OVER (PARTITION BY repo ORDER BY commits DESC, first_seq ROWS UNBOUNDED PRECEDING) AS cum,
                    sum(commits) OVER (PARTITION BY repo) AS total FROM t)
       SELECT repo, position, author_email, commits FROM r WHERE position = 1 OR CAST(cum - commits AS DOUBLE) / total < 0.5""",
    "commits",
)
def dominant_customers_with_ties(x: Inputs) -> DataFrame:
    by_customer = x.table("orders").select(
        F.col("o_orderpriority").alias("repo"),
        F.col("o_custkey").cast("string").alias("author_email"),
        F.col("o_orderkey").alias("seq"),
    )
    return h.dominant_authors(h.author_ranks(by_customer))


@query("history_score", "SELECT repo, score FROM scored", "scored")
def history_score(x: Inputs) -> DataFrame:
    repos = repos_of(x.commits)
    return reports.history_summary(repos, authors_normalized(x), AS_OF).select("repo", "score")


@query(
    "git_history_report",
    """SELECT repo, total_commits, days_active, commits_per_day, bus_factor, inactive, days_since_last_commit,
              total_commits AS total_messages, meaningful_messages, meaningful_ratio, score FROM scored""",
    "scored",
)
def git_history_report(x: Inputs) -> DataFrame:
    repos = repos_of(x.commits)
    return reports.git_history_report(repos, x.commits, x.commit_files, AS_OF)["summary"]


@query(
    "git_history_report_newest_500",
    """, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM c) WHERE rn <= 500)
       SELECT repo, author_email, count(*) AS commits, CAST(sum(coalesce(insertions, 0)) AS BIGINT) AS insertions,
              CAST(sum(coalesce(deletions, 0)) AS BIGINT) AS deletions, min(seq) AS first_seq
       FROM n LEFT JOIN stats USING (repo, commit_hash) GROUP BY repo, author_email""",
    "c stats",
)
def git_history_report_newest_500(x: Inputs) -> DataFrame:
    repos = repos_of(x.commits)
    return reports.git_history_report(repos, x.commits, x.commit_files, AS_OF, 500)["authors"]


@query(
    "extended_git_history_report",
    """SELECT repo, total_commits, days_active, commits_per_day, inactive, days_since_last_commit,
              total_commits AS total_messages, meaningful_messages, meaningful_ratio, merge_commits, merge_ratio,
              bus_factor, score, files, high_churn_files, average_churn FROM scored JOIN churn USING (repo)""",
    "scored churn",
)
def extended_git_history_report(x: Inputs) -> DataFrame:
    repos = repos_of(x.commits)
    return reports.extended_git_history_report(repos, x.commits, x.commit_files, AS_OF)["summary"]


@query(
    "extended_git_history_authors",
    """SELECT repo, 'total' AS part, author_email AS key, commits, insertions, deletions FROM contrib
       UNION ALL SELECT repo, strftime(authored_at, '%Y-%m'), author_email, count(*), NULL, NULL FROM c GROUP BY 1, 2, 3""",
    "contrib c",
)
def extended_git_history_authors(x: Inputs) -> DataFrame:
    """The authors and author months of the extended report."""
    report = reports.extended_git_history_report(repos_of(x.commits), x.commits, x.commit_files, AS_OF)
    none = "bigint(NULL)"
    months = report["author_months"].selectExpr("repo", "month AS part", "author_email AS key", "commits", f"{none} AS insertions", f"{none} AS deletions")
    totals = report["authors"].selectExpr("repo", "'total' AS part", "author_email AS key", "commits", "insertions", "deletions")
    return totals.unionByName(months)


@query(
    "commit_activity_report",
    """SELECT repo, 'author' AS part, author_email AS key, count(*) AS commits FROM c GROUP BY repo, author_email
       UNION ALL SELECT repo, 'day', strftime(authored_at, '%Y-%m-%d'), count(*) FROM c GROUP BY 1, 3
       UNION ALL SELECT repo, 'month', strftime(authored_at, '%Y-%m'), count(*) FROM c GROUP BY 1, 3
       UNION ALL SELECT repo, 'frequency', CAST(days_active AS VARCHAR), total_commits FROM hist
       UNION ALL SELECT repo, 'changes', CAST(sum(insertions) AS VARCHAR), CAST(sum(files_changed) AS BIGINT) FROM cs GROUP BY repo""",
    "c hist cs",
)
def commit_activity_report(x: Inputs) -> DataFrame:
    parts = reports.commit_activity_report(repos_of(x.commits), x.commits, x.commit_files)

    def rows(df: DataFrame, part: str, key: str, value: str) -> DataFrame:
        return df.select(
            "repo",
            F.lit(part).alias("part"),
            F.col(key).cast("string").alias("key"),
            F.col(value).alias("commits"),
        )

    return (
        rows(parts["authors"], "author", "author_email", "commits")
        .unionByName(rows(parts["by_day"], "day", "day", "commits"))
        .unionByName(rows(parts["by_month"], "month", "month", "commits"))
        .unionByName(rows(parts["frequency"], "frequency", "days_active", "total_commits"))
        .unionByName(rows(parts["changes"], "changes", "total_insertions", "files_changed"))
    )
