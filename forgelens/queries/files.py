"""Queries over file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions import paths
from forgelens.functions.sql import array_of, exprs
from forgelens.functions.text import content_hash, is_binary, read_text, safe_text
from forgelens.operators import analyzers as an
from forgelens.operators import files as f
from forgelens.operators import loc
from forgelens.plans import file_reports as reports
from forgelens.queries.common import DIR_NAMES, LINE_BREAKS, PY_SPACE, query
from forgelens.sources import ignore_rules, manifests
from forgelens.sources.adapters import Inputs
from forgelens.sources.json_sink import as_json
from forgelens.tables import per_repo, repos_of


def dirs(x: Inputs) -> DataFrame:
    return f.derive_dirs(x.files)


def with_errors(files: DataFrame) -> DataFrame:
    """Marks some entries unreadable, and some as failed at ingest."""
    return files.withColumns(
        {
            "readable": F.col("seq") % 10 != 3,
            "error": F.when(F.col("seq") % 9 == 4, F.concat(F.lit("cannot stat "), F.col("path"))),
        }
    )


def file_repos(x: Inputs) -> DataFrame:
    return repos_of(x.files)


# Scans

@query(
    "listed_files",
    f"SELECT repo, seq, path FROM named WHERE NOT regexp_matches('/' || dir || '/', '/({DIR_NAMES}|utils)/')",
    "named",
)
def listed_files(x: Inputs) -> DataFrame:
    return f.listed(x.files, ["utils"]).select("repo", "seq", "path")


@query(
    "scan_with_limits",
    """SELECT repo, seq, path, size_bytes, is_symlink, is_executable FROM
       (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM lined
        WHERE NOT excluded AND NOT is_symlink AND depth <= 2) WHERE rn <= 12""",
    "lined",
)
def scan_with_limits(x: Inputs) -> DataFrame:
    found = f.scan(x.files, dirs(x), f.ScanLimits(max_depth=2, max_files=12))
    return found.files.drop("last_modified")


@query(
    "scan_following_symlinks",
    "SELECT repo, seq, path, is_symlink FROM lined WHERE NOT excluded AND depth <= 3",
    "lined",
)
def scan_following_symlinks(x: Inputs) -> DataFrame:
    found = f.scan(x.files, dirs(x), f.ScanLimits(max_depth=3, follow_symlinks=True))
    return found.files.select("repo", "seq", "path", "is_symlink")


@query(
    "scan_guarded",
    """SELECT repo, seq, path FROM lined WHERE NOT excluded AND NOT is_symlink AND seq % 10 <> 3 AND seq % 9 <> 4""",
    "lined",
)
def scan_guarded(x: Inputs) -> DataFrame:
    return f.scan_guarded(with_errors(x.files), dirs(x)).files.select("repo", "seq", "path")


@query(
    "scan_best_effort",
    "SELECT repo, seq, path FROM lined WHERE NOT excluded AND depth <= 2 AND seq % 9 <> 4",
    "lined",
)
def scan_best_effort(x: Inputs) -> DataFrame:
    found = f.scan_best_effort(with_errors(x.files), dirs(x), f.ScanLimits(max_depth=2))
    return found.files.select("repo", "seq", "path")


@query(
    "scan_errors",
    """SELECT repo, seq, path, 'cannot stat ' || path AS error FROM
       (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM lined WHERE NOT excluded AND seq % 9 = 4)
       WHERE rn <= 3""",
    "lined",
)
def scan_errors(x: Inputs) -> DataFrame:
    return f.truncate_errors(f.scan(with_errors(x.files), dirs(x)).errors, 3)


@query(
    "scan_directories",
    "SELECT repo, path, depth FROM listed_dirs WHERE depth <= 1",
    "listed_dirs",
)
def scan_directories(x: Inputs) -> DataFrame:
    return f.scan(x.files, dirs(x), f.ScanLimits(max_depth=1)).dirs.drop("seq")


@query(
    "enforced_limits",
    """, found AS (SELECT repo, min(seq) * 4096 + any_value(depth) AS place, path FROM
          (SELECT n.repo, n.seq, d.path, d.depth FROM named n JOIN dirs d ON n.repo = d.repo AND starts_with(n.path, d.path || '/'))
        GROUP BY repo, path)
       SELECT repo, 'file' AS kind, path FROM
         (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM lined WHERE NOT excluded) WHERE rn <= 7
       UNION ALL
       SELECT repo, 'dir', path FROM (SELECT found.*, row_number() OVER (PARTITION BY repo ORDER BY place) AS rn
         FROM found SEMI JOIN listed_dirs USING (repo, path)) WHERE rn <= 2""",
    "lined listed_dirs",
)
def enforced_limits(x: Inputs) -> DataFrame:
    cut = f.enforce_limits(f.scan_best_effort(x.files, dirs(x)), max_files=7, max_directories=2)
    files = cut.files.select("repo", F.lit("file").alias("kind"), "path")
    return files.unionByName(cut.dirs.select("repo", F.lit("dir").alias("kind"), "path"))


@query(
    "scan_summary",
    """SELECT repo, coalesce(total_files, 0) AS total_files, coalesce(total_directories, 0) AS total_directories,
              coalesce(total_size_bytes, 0) AS total_size_bytes, coalesce(errors_count, 0) AS errors_count
       FROM file_repos
       LEFT JOIN (SELECT repo, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM lined
                  WHERE NOT excluded AND NOT is_symlink AND seq % 9 <> 4 GROUP BY repo) USING (repo)
       LEFT JOIN (SELECT repo, count(*) AS total_directories FROM listed_dirs GROUP BY repo) USING (repo)
       LEFT JOIN (SELECT repo, count(*) AS errors_count FROM lined WHERE NOT excluded AND seq % 9 = 4 GROUP BY repo) USING (repo)""",
    "file_repos lined listed_dirs",
)
def scan_summary(x: Inputs) -> DataFrame:
    return f.scan_summary(file_repos(x), f.scan(with_errors(x.files), dirs(x)))


@query(
    "quick_scan_report",
    """SELECT repo, coalesce(total_files, 0) AS total_files, coalesce(total_directories, 0) AS total_directories,
              coalesce(total_size_bytes, 0) AS total_size_bytes, 0::BIGINT AS errors
       FROM file_repos
       LEFT JOIN (SELECT repo, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM lined
                  WHERE NOT excluded GROUP BY repo) USING (repo)
       LEFT JOIN (SELECT repo, count(*) AS total_directories FROM listed_dirs GROUP BY repo) USING (repo)""",
    "file_repos lined listed_dirs",
)
def quick_scan_report(x: Inputs) -> DataFrame:
    report = reports.quick_scan_report(file_repos(x), x.files, dirs(x))
    return report.withColumn("errors", F.col("errors").cast("bigint"))


@query(
    "detailed_scan_directories",
    """SELECT d.repo, d.path, d.depth, count(n.path) AS total_files, CAST(coalesce(sum(n.size_bytes), 0) AS BIGINT) AS total_size_bytes
       FROM listed_dirs d LEFT JOIN (SELECT * FROM named WHERE NOT is_symlink) n ON n.repo = d.repo AND n.dir = d.path
       GROUP BY d.repo, d.path, d.depth""",
    "listed_dirs named",
)
def detailed_scan_directories(x: Inputs) -> DataFrame:
    return reports.detailed_scan_report(file_repos(x), x.files, dirs(x))["directories"]


GOOD_ENTRIES = "NOT excluded AND NOT is_symlink AND seq % 10 <> 3 AND seq % 9 <> 4"


@query(
    "detailed_scan_summary",
    f"""SELECT repo, count(*) FILTER ({GOOD_ENTRIES}) AS total_files, any_value(coalesce(n, 0)) AS total_directories,
              CAST(coalesce(sum(size_bytes) FILTER ({GOOD_ENTRIES}), 0) AS BIGINT) AS total_size_bytes,
              count(*) FILTER (NOT excluded AND seq % 9 = 4) AS errors_count
       FROM lined LEFT JOIN (SELECT repo, count(*) AS n FROM listed_dirs GROUP BY repo) USING (repo) GROUP BY repo""",
    "lined listed_dirs",
)
def detailed_scan_summary(x: Inputs) -> DataFrame:
    return reports.detailed_scan_report(file_repos(x), with_errors(x.files), dirs(x), max_errors=100)["summary"]


@query(
    "detailed_scan_files",
    f"SELECT repo, seq, path, size_bytes, is_symlink, is_executable FROM lined WHERE {GOOD_ENTRIES}",
    "lined",
)
def detailed_scan_files(x: Inputs) -> DataFrame:
    report = reports.detailed_scan_report(file_repos(x), with_errors(x.files), dirs(x))
    return report["files"].drop("last_modified")


@query(
    "detailed_scan_errors",
    """SELECT repo, seq, path, 'cannot stat ' || path AS error FROM
       (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS rn FROM lined WHERE NOT excluded AND seq % 9 = 4) WHERE rn <= 100""",
    "lined",
)
def detailed_scan_errors(x: Inputs) -> DataFrame:
    return reports.detailed_scan_report(file_repos(x), with_errors(x.files), dirs(x), max_errors=100)["errors"]


# Text, lines and hashes

def damaged(x: Inputs) -> DataFrame:
    """Every file with bytes that are no UTF-8 for each ``z`` and a genuine replacement character for each ``q``."""
    text = "replace(replace(cast(content AS string), 'q', '\ufffd'), 'z', cast(X'FF' AS string))"
    return x.files.selectExpr("repo", "path", f"cast({text} AS binary) AS content")


GENUINE = "replace(text, 'q', chr(65533))"
READ = f"replace(replace(replace({GENUINE}, 'z', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(
    "safe_text",
    f"""SELECT repo, path, length(CASE WHEN is_binary THEN '' ELSE whole END) AS characters, md5(CASE WHEN is_binary THEN '' ELSE whole END) AS digest,
               length(whole) AS unguarded_characters, md5(whole) AS unguarded_digest FROM (SELECT *, {READ} AS whole FROM lined)""",
    "lined",
)
def safe_text_of_files(x: Inputs) -> DataFrame:
    texts = damaged(x).select("repo", "path", *exprs(guarded=safe_text("content"), plain=read_text("content")))
    return texts.selectExpr(
        "repo",
        "path",
        "bigint(length(guarded)) AS characters",
        "md5(guarded) AS digest",
        "bigint(length(plain)) AS unguarded_characters",
        "md5(plain) AS unguarded_digest",
    )


@query(
    "safe_text_of_first_bytes",
    f"""SELECT repo, path, length(part) AS characters, md5(part) AS digest FROM
        (SELECT repo, path, CASE WHEN is_binary THEN '' ELSE replace(left(genuine, len(list_filter(range(1, 201), lambda i: strlen(left(genuine, i)) <= 200))), 'z', '') END AS part
         FROM (SELECT *, {GENUINE} AS genuine FROM lined))""",
    "lined",
)
def safe_text_of_first_bytes(x: Inputs) -> DataFrame:
    texts = damaged(x).select("repo", "path", *exprs(text=safe_text("content", 200)))
    return texts.selectExpr("repo", "path", "bigint(length(text)) AS characters", "md5(text) AS digest")


@query("file_hashes", "SELECT repo, path, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1 FROM files", "files")
def file_hashes(x: Inputs) -> DataFrame:
    hashed = {a: content_hash("content", a) for a in ("sha256", "md5", "sha1")}
    return x.files.select("repo", "path", *exprs(**hashed))


@query(
    "file_line_counts",
    "SELECT repo, path, total_lines, blank_lines, total_lines - blank_lines AS non_blank_lines FROM fx",
    "fx",
)
def file_line_counts(x: Inputs) -> DataFrame:
    counted = f.count_file_lines(x.files)
    return counted.select("repo", "path", "total_lines", "blank_lines", "non_blank_lines")


@query(
    "line_kinds",
    "SELECT repo, path, total_lines, code_lines, blank_lines, comment_lines FROM loc",
    "loc",
)
def line_kinds(x: Inputs) -> DataFrame:
    return f.line_kinds(x.files)


@query(
    "loc_report",
    """SELECT repo, coalesce(count(path), 0) AS files, CAST(coalesce(sum(total_lines), 0) AS BIGINT) AS total_lines,
              CAST(coalesce(sum(code_lines), 0) AS BIGINT) AS code_lines, CAST(coalesce(sum(blank_lines), 0) AS BIGINT) AS blank_lines,
              CAST(coalesce(sum(comment_lines), 0) AS BIGINT) AS comment_lines, avg(total_lines) AS mean_total_lines,
              median(total_lines) AS median_total_lines, avg(code_lines) AS mean_code_lines, median(code_lines) AS median_code_lines
       FROM file_repos LEFT JOIN loc USING (repo) GROUP BY repo""",
    "file_repos loc",
)
def loc_report(x: Inputs) -> DataFrame:
    return loc.loc_report(file_repos(x), x.files)["summary"]


@query("loc_report_files", "SELECT repo, path, total_lines, code_lines, blank_lines, comment_lines FROM loc", "loc")
def loc_report_files(x: Inputs) -> DataFrame:
    return loc.loc_report(file_repos(x), x.files)["files"]


@query(
    "loc_totals",
    """SELECT repo, CAST(coalesce(sum(code_lines), 0) AS BIGINT) AS code_lines,
              least(1.0, coalesce(sum(code_lines), 0) / 10000.0e0) AS score
       FROM file_repos LEFT JOIN loc USING (repo) GROUP BY repo""",
    "file_repos loc",
)
def loc_totals(x: Inputs) -> DataFrame:
    totals = loc.loc_totals(file_repos(x), f.line_kinds(x.files))
    return totals.select("repo", "code_lines", F.least(F.lit(1.0), F.col("code_lines") / 10000.0).alias("score"))


@query(
    "plain_loc_totals",
    f"""SELECT repo, count(t) AS files, CAST(coalesce(sum(t), 0) AS BIGINT) AS lines, CAST(coalesce(sum(t - b), 0) AS BIGINT) AS code_lines,
              CAST(coalesce(sum(b), 0) AS BIGINT) AS blank_lines
       FROM file_repos LEFT JOIN (SELECT repo, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS t,
         len(list_filter(parts, lambda l: regexp_full_match(l, '[\\s\\x0B\\x1F\\x{{A0}}]*'))) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS b
         FROM lined WHERE ext IN ('.py', '.js', '.ts', '.java', '.go', '.rs', '.cpp', '.c', '.h')) USING (repo) GROUP BY repo""",
    "file_repos lined",
)
def plain_loc_totals(x: Inputs) -> DataFrame:
    counted = f.plain_line_counts(x.files).groupBy("repo").agg(
        *exprs(
            files="count(*)", lines="sum(total_lines)", code_lines="sum(non_blank_lines)",
            blank_lines="sum(blank_lines)",
        )
    )
    return per_repo(file_repos(x), counted).fillna(0)


@query(
    "branch_tokens",
    """SELECT repo, path, CAST((length(text) - length(replace(text, 'if ', ''))) / 3 + (length(text) - length(replace(text, 'for ', ''))) / 4
              + (length(text) - length(replace(text, 'while ', ''))) / 6 + (length(text) - length(replace(text, 'case ', ''))) / 5
              + (length(text) - length(replace(text, 'except ', ''))) / 7 AS BIGINT) AS tokens
       FROM files WHERE path LIKE '%.py'""",
    "files",
)
def branch_tokens(x: Inputs) -> DataFrame:
    return f.branch_tokens(x.files)


# Classification

@query(
    "files_classified_by_whole_content",
    """SELECT repo, path, CASE WHEN seq % 5 = 0 THEN 'binary' ELSE category END AS category,
              CASE WHEN seq % 5 = 0 OR is_binary THEN 0 ELSE length(text) END AS bytes FROM (SELECT *, seq FROM fx)""",
    "fx",
)
def files_classified_by_whole_content(x: Inputs) -> DataFrame:
    """A NUL behind the usual probe makes a file binary where the whole content is looked at."""
    late = x.files.withColumn("content", F.expr("if(seq % 5 = 0, content || X'00', content)"))
    found = f.classify_files(late, sample_bytes=None)
    unread = safe_text("content", sample_bytes=None)
    return found.select("repo", "path", "category", *exprs(bytes=f"bigint(if({unread} = '', 0, length(cast(content AS string))))"))


@query("classified_files", "SELECT repo, path, language, category FROM fx", "fx")
def classified_files(x: Inputs) -> DataFrame:
    return f.classify_files(x.files).select("repo", "path", "language", "category")


@query(
    "classified_pages",
    r"""SELECT repo, path, regexp_extract(path, '[^/]*$') AS name,
              lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suffix,
              length(path) - length(replace(path, '/', '')) + 1 AS depth,
              CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent,
              contains(left(text, 1024), chr(0)) AS is_binary FROM page_files""",
    "page_files",
)
def classified_pages(x: Inputs) -> DataFrame:
    return x.page_files.select(
        "repo",
        "path",
        *exprs(
            name=paths.file_name(),
            suffix=paths.suffix(),
            depth=f"bigint({paths.depth()})",
            parent=paths.parent(),
            is_binary=is_binary("content"),
        ),
    )


@query(
    "file_index",
    r"""SELECT repo, path, regexp_matches(lower(path), 'test_|_test|/tests/|__tests__|\.spec\.|\.test\.') AS is_test,
              regexp_matches(path, '\.(py|js|ts|java|go|rs)$') AS is_source FROM files""",
    "files",
)
def file_index(x: Inputs) -> DataFrame:
    return f.index_files(x.files)


@query(
    "file_index_counts",
    r"""SELECT repo, count(*) AS total_files, count(*) FILTER (regexp_matches(lower(path), 'test_|_test|/tests/|__tests__|\.spec\.|\.test\.')) AS test_files,
              count(*) FILTER (regexp_matches(path, '\.(py|js|ts|java|go|rs)$')) AS source_files FROM files GROUP BY repo""",
    "files",
)
def file_index_counts(x: Inputs) -> DataFrame:
    return f.index_counts(file_repos(x), x.files)


@query(
    "loc_excluded_files",
    "SELECT repo, path FROM files WHERE contains(path, 'node_modules/') OR contains('/' || path, '/docs/')",
    "files",
)
def loc_excluded_files(x: Inputs) -> DataFrame:
    return x.files.where(paths.is_loc_excluded("path", ["docs"])).select("repo", "path")


@query("large_files", "SELECT repo, path, size_bytes FROM files WHERE size_bytes >= 2000", "files")
def large_files(x: Inputs) -> DataFrame:
    return f.large_files(x.files, 2000).select("repo", "path", "size_bytes")


@query("shallow_directories", "SELECT repo, path, depth FROM dirs WHERE depth <= 1", "dirs")
def shallow_directories(x: Inputs) -> DataFrame:
    return f.shallow_dirs(dirs(x), 1).select("repo", "path", "depth")


# Directories

@query("directories", "SELECT repo, path, depth FROM dirs", "dirs")
def directories(x: Inputs) -> DataFrame:
    return dirs(x).select("repo", "path", "depth")


DIRECTORY_TOTALS = """SELECT d.repo, d.path, d.depth, count(n.path) AS total_files,
       CAST(coalesce(sum(n.size_bytes), 0) AS BIGINT) AS total_size_bytes
FROM dirs d LEFT JOIN named n ON n.repo = d.repo AND n.dir = d.path GROUP BY d.repo, d.path, d.depth"""


@query("directory_totals", DIRECTORY_TOTALS, "dirs named")
def directory_totals(x: Inputs) -> DataFrame:
    return f.directory_totals(x.files, dirs(x))


@query(
    "nearest_directory_totals",
    """, top AS (SELECT * FROM dirs WHERE depth <= 1)
       SELECT d.repo, d.path, d.depth, count(n.path) AS total_files, CAST(coalesce(sum(n.size_bytes), 0) AS BIGINT) AS total_size_bytes
       FROM top d LEFT JOIN named n ON n.repo = d.repo AND starts_with(n.path, d.path || '/') GROUP BY d.repo, d.path, d.depth""",
    "dirs named",
)
def nearest_directory_totals(x: Inputs) -> DataFrame:
    return f.directory_totals(x.files, f.shallow_dirs(dirs(x), 1))


@query(
    "directories_by_size",
    DIRECTORY_TOTALS + " ORDER BY repo, total_size_bytes DESC, path",
    "dirs named",
)
def directories_by_size(x: Inputs) -> DataFrame:
    return f.dirs_by_size(f.directory_totals(x.files, dirs(x)))


@query("files_by_size", "SELECT repo, seq, path, size_bytes FROM files ORDER BY repo, size_bytes DESC, seq", "files")
def files_by_size(x: Inputs) -> DataFrame:
    return f.by_size(x.files.select("repo", "seq", "path", "size_bytes"))


# Counts

@query(
    "files_per_language",
    "SELECT repo, language, count(*) AS files FROM fx WHERE NOT excluded AND language IS NOT NULL GROUP BY repo, language ORDER BY repo, language",
    "fx",
)
def files_per_language(x: Inputs) -> DataFrame:
    return f.files_per_language(x.files).orderBy("repo", "language")


@query(
    "files_per_category",
    "SELECT repo, category, count(*) AS files FROM fx WHERE NOT excluded GROUP BY repo, category ORDER BY repo, category",
    "fx",
)
def files_per_category(x: Inputs) -> DataFrame:
    return f.files_per_category(x.files).orderBy("repo", "category")


@query(
    "depth_histogram",
    """SELECT repo, CAST(depth AS INTEGER) AS depth, count(*) AS entries FROM
       (SELECT repo, depth FROM lined WHERE NOT excluded UNION ALL SELECT repo, depth FROM listed_dirs) GROUP BY repo, depth""",
    "lined listed_dirs",
)
def depth_histogram(x: Inputs) -> DataFrame:
    return f.depth_histogram(x.files, dirs(x))


@query(
    "repository_lines",
    """SELECT repo, CAST(sum(total_lines) FILTER (NOT excluded) AS BIGINT) AS total_lines, CAST(sum(blank_lines) FILTER (NOT excluded) AS BIGINT) AS blank_lines,
              CAST(sum(total_lines - blank_lines) FILTER (NOT excluded) AS BIGINT) AS non_blank_lines, count(*) FILTER (NOT excluded) AS files_counted
       FROM fx GROUP BY repo""",
    "fx",
)
def repository_lines(x: Inputs) -> DataFrame:
    return f.repository_lines(file_repos(x), x.files)


@query(
    "directory_size",
    "SELECT repo, CAST(sum(size_bytes) FILTER (NOT excluded) AS BIGINT) AS total_size_bytes FROM lined GROUP BY repo",
    "lined",
)
def directory_size(x: Inputs) -> DataFrame:
    return f.directory_size(file_repos(x), x.files)


@query(
    "extension_histogram",
    "SELECT repo, CASE WHEN ext = '' THEN '<none>' ELSE ext END AS extension, count(*) AS files FROM named GROUP BY 1, 2 ORDER BY 1, 2",
    "named",
)
def extension_histogram(x: Inputs) -> DataFrame:
    return f.extension_histogram(x.files).orderBy("repo", "extension")


@query(
    "entry_counts",
    "SELECT repo, count(*) AS file_count FROM (SELECT repo FROM files UNION ALL SELECT repo FROM dirs) GROUP BY repo",
    "files dirs",
)
def entry_counts(x: Inputs) -> DataFrame:
    return f.entry_counts(file_repos(x), x.files, dirs(x))


@query("directory_names", "SELECT DISTINCT repo, regexp_extract(path, '[^/]*$') AS name FROM dirs", "dirs")
def directory_names(x: Inputs) -> DataFrame:
    return f.directory_names(dirs(x))


@query(
    "structure_findings",
    """, n AS (SELECT repo, count(*) AS n FROM (SELECT repo, path AS d FROM root_files UNION ALL
               SELECT DISTINCT repo, d FROM (SELECT repo, unnest(CASE WHEN path LIKE '.github%' THEN ['.github', '.github/workflows']
                 WHEN path LIKE 'src/%' THEN ['src'] WHEN path LIKE 'tests/%' THEN ['tests'] WHEN path LIKE 'other/%' THEN ['other'] ELSE [] END) AS d FROM root_files)) GROUP BY repo)
       SELECT repo, 'Repository contains ' || n || ' files (limit: 14)' AS message, 'high' AS severity, 'size_check' AS source FROM n WHERE n > 14
       UNION ALL SELECT repo, 'No tests directory detected', 'medium', 'structure_scan' FROM root_repos
         WHERE repo NOT IN (SELECT repo FROM root_files WHERE path LIKE 'tests/%')
       UNION ALL SELECT repo, 'No CI configuration detected', 'low', 'structure_scan' FROM root_repos
         WHERE repo NOT IN (SELECT repo FROM root_files WHERE path LIKE '.github/%')""",
    "root_files root_repos",
)
def structure_findings(x: Inputs) -> DataFrame:
    files = x.root_files
    return f.structure_findings(repos_of(files), files, f.derive_dirs(files), max_entries=14)


@query(
    "engine_summary",
    r"""SELECT repo, 'entries' AS part, '' AS key, CAST(count(*) AS VARCHAR) AS value FROM (SELECT repo FROM root_files UNION ALL
         SELECT repo FROM (SELECT DISTINCT repo, unnest(CASE WHEN path LIKE '.github/%' THEN ['.github', '.github/workflows'] WHEN contains(path, '/') THEN
           [split_part(path, '/', 1)] ELSE [] END) AS d FROM root_files)) GROUP BY repo
       UNION ALL SELECT DISTINCT repo, 'directory', unnest(CASE WHEN path LIKE '.github/%' THEN ['.github', 'workflows'] WHEN contains(path, '/') THEN
           [split_part(path, '/', 1)] ELSE [] END), '' FROM root_files
       UNION ALL SELECT repo, 'extension', ext, CAST(count(*) AS VARCHAR) FROM (SELECT repo, CASE WHEN regexp_matches(path, '[^/]\.[^./]+$')
           THEN lower(regexp_extract(path, '(\.[^./]+)$', 1)) ELSE '<none>' END AS ext FROM root_files) GROUP BY repo, ext
       UNION ALL SELECT repo, 'finding', 'No tests directory detected', 'medium' FROM root_repos WHERE repo NOT IN (SELECT repo FROM root_files WHERE path LIKE 'tests/%')
       UNION ALL SELECT repo, 'finding', 'No CI configuration detected', 'low' FROM root_repos WHERE repo NOT IN (SELECT repo FROM root_files WHERE path LIKE '.github/%')""",
    "root_files root_repos",
)
def engine_summary(x: Inputs) -> DataFrame:
    files = x.root_files
    parts = reports.engine_summary(repos_of(files), files, f.derive_dirs(files))
    return (
        parts["entries"].selectExpr("repo", "'entries' AS part", "'' AS key", "string(file_count) AS value")
        .unionByName(parts["directories"].selectExpr("repo", "'directory' AS part", "name AS key", "'' AS value"))
        .unionByName(parts["extensions"].selectExpr("repo", "'extension' AS part", "extension AS key", "string(files) AS value"))
        .unionByName(parts["findings"].selectExpr("repo", "'finding' AS part", "message AS key", "severity AS value"))
    )


# Ignore rules

RULE_LINE = """CASE doc_id % 8 WHEN 0 THEN '*.py' WHEN 1 THEN 'docs/f' || CAST(doc_id AS STRING) || '*' WHEN 2 THEN '# note'
  WHEN 3 THEN '   ' WHEN 4 THEN '  utils/f' || CAST(doc_id % 100 AS STRING) || ' ' WHEN 5 THEN '*' WHEN 6 THEN '*a*' ELSE '7.m' END"""
RULES = f"""
, parsed AS (SELECT repo, trim({RULE_LINE}) AS line FROM (SELECT source AS repo, doc_id FROM documents)),
rules AS (SELECT DISTINCT repo,
  CASE WHEN starts_with(line, '*') AND length(line) > 1 THEN 'suffix' WHEN ends_with(line, '*') AND length(line) > 1 THEN 'prefix'
       ELSE 'contains' END AS kind,
  CASE WHEN starts_with(line, '*') AND length(line) > 1 THEN line[2:] WHEN ends_with(line, '*') AND length(line) > 1 THEN line[:-2]
       ELSE line END AS pattern FROM parsed WHERE line <> '' AND NOT starts_with(line, '#'))
"""


def rules(x: Inputs) -> DataFrame:
    lines = x.table("documents").select(F.col("source").alias("repo"), F.expr(RULE_LINE).alias("line"))
    return ignore_rules.parse_ignore_lines(lines)


@query("ignore_rules", RULES + "SELECT repo, kind, pattern FROM rules", "files")
def ignore_rule_rows(x: Inputs) -> DataFrame:
    return rules(x)


STARRED = "replace(replace(cast(content AS string), 'e\\n', '*\\n'), '\\na', '\\n*')"
STARRED_SQL = "replace(replace(text, 'e' || chr(10), '*' || chr(10)), chr(10) || 'a', chr(10) || '*')"
IGNORED = """EXISTS (SELECT 1 FROM rules r WHERE r.repo = n.repo AND CASE kind WHEN 'prefix' THEN starts_with(n.path, r.pattern)
  WHEN 'suffix' THEN ends_with(n.path, r.pattern) ELSE contains(n.path, r.pattern) END)"""


@query("files_not_ignored", RULES + f"SELECT n.repo, n.path FROM files n WHERE NOT {IGNORED}", "files")
def files_not_ignored(x: Inputs) -> DataFrame:
    return f.drop_ignored(x.files.select("repo", "path"), rules(x))


KINDS = """CASE WHEN starts_with(line, '*') AND length(line) > 1 THEN 'suffix' WHEN ends_with(line, '*') AND length(line) > 1 THEN 'prefix' ELSE 'contains' END AS kind,
  CASE WHEN starts_with(line, '*') AND length(line) > 1 THEN line[2:] WHEN ends_with(line, '*') AND length(line) > 1 THEN line[:-2] ELSE line END AS pattern"""


@query(
    "standard_ignore_rules",
    f"""SELECT DISTINCT repo, {KINDS} FROM
        (SELECT repo, trim(unnest(string_split_regex(CASE WHEN contains(left(text, 1024), chr(0)) THEN '' ELSE {STARRED_SQL} END, {LINE_BREAKS})), {PY_SPACE}) AS line
         FROM root_files WHERE path = '.gitignore') WHERE line <> '' AND NOT starts_with(line, '#')""",
    "root_files",
)
def standard_ignore_rules(x: Inputs) -> DataFrame:
    """Rules of all kinds: some line ends and starts become stars."""
    return ignore_rules.standard_ignore_rules(x.root_files.withColumn("content", F.expr(f"cast({STARRED} AS binary)")))


@query(
    "file_inventory",
    RULES + f"""SELECT n.repo, n.path, n.size_bytes AS size, n.category, n.language, sha256(n.text) AS hash FROM fx n
               WHERE NOT n.excluded AND NOT {IGNORED}""",
    "fx",
)
def file_inventory(x: Inputs) -> DataFrame:
    return reports.file_inventory(x.files, rules(x), include_hashes=True)


@query(
    "inventory_languages",
    RULES + f"""SELECT n.repo, n.language, count(*) AS files FROM fx n WHERE NOT n.excluded AND n.language IS NOT NULL AND NOT {IGNORED}
               GROUP BY n.repo, n.language""",
    "fx",
)
def inventory_languages(x: Inputs) -> DataFrame:
    return reports.extended_repository_summary(file_repos(x), x.files, rules(x))["languages"]


@query(
    "repository_summary",
    """SELECT repo, 'size' AS part, '' AS key, CAST(sum(size_bytes) FILTER (NOT excluded) AS BIGINT) AS value FROM fx GROUP BY repo
       UNION ALL SELECT repo, 'language', language, count(*) FROM fx WHERE NOT excluded AND dir <> 'docs' AND language IS NOT NULL GROUP BY repo, language
       UNION ALL SELECT repo, 'category', category, count(*) FROM fx WHERE NOT excluded AND dir <> 'docs' GROUP BY repo, category
       UNION ALL SELECT repo, 'depth', CAST(depth AS VARCHAR), count(*) FROM
         (SELECT repo, depth FROM fx WHERE NOT excluded UNION ALL SELECT repo, depth FROM listed_dirs) GROUP BY repo, depth
       UNION ALL SELECT repo, 'lines', '', CAST(coalesce(sum(total_lines) FILTER (NOT excluded AND dir <> 'docs'), 0) AS BIGINT) FROM fx GROUP BY repo""",
    "fx listed_dirs",
)
def repository_summary(x: Inputs) -> DataFrame:
    parts = reports.repository_summary(file_repos(x), x.files, dirs(x), exclude_dirs=["docs"])

    def rows(df: DataFrame, part: str, key: str | None, value: str) -> DataFrame:
        label = F.lit("") if key is None else F.col(key).cast("string")
        return df.select("repo", F.lit(part).alias("part"), label.alias("key"), F.col(value).alias("value"))

    return (
        rows(parts["size"], "size", None, "total_size_bytes")
        .unionByName(rows(parts["languages"], "language", "language", "files"))
        .unionByName(rows(parts["categories"], "category", "category", "files"))
        .unionByName(rows(parts["depths"], "depth", "depth", "entries"))
        .unionByName(rows(parts["lines"], "lines", None, "total_lines"))
    )


# Analyzers

@query(
    "ci_analyzer",
    """SELECT repo, CASE WHEN count(p) > 0 THEN 1.0e0 ELSE 0.0e0 END AS score, string_agg(DISTINCT p, ',' ORDER BY p) AS ci_files
       FROM root_repos LEFT JOIN (SELECT repo, CASE WHEN path LIKE '.github/workflows/%' THEN '1:.github/workflows'
         WHEN path = '.gitlab-ci.yml' THEN '2:.gitlab-ci.yml' WHEN path = '.travis.yml' THEN '3:.travis.yml' ELSE '4:Jenkinsfile' END AS p FROM root_files
         WHERE path LIKE '.github/workflows/%' OR path IN ('.gitlab-ci.yml', '.travis.yml', 'Jenkinsfile')) USING (repo) GROUP BY repo""",
    "root_repos root_files",
)
def ci_analyzer(x: Inputs) -> DataFrame:
    found = "from_json(details, 'ci_files array<string>').ci_files"
    numbered = f"transform({found}, p -> array_position({array_of(an.CI_PATHS)}, p) || ':' || p)"
    text = f"CASE WHEN size({found}) > 0 THEN array_join({numbered}, ',') END"
    result = an.analyze(an.Tables(repos_of(x.root_files), x.root_files), ["ci"])
    return result.select("repo", "score", *exprs(ci_files=text))


def _root_lines(names: tuple[str, ...], full: str) -> str:
    columns = ", ".join(f"max(CASE WHEN path = '{n}' THEN n END) AS \"{n}\"" for n in names)
    wanted = ", ".join(f"'{n}'" for n in names)
    return f"""SELECT repo, least(1.0, coalesce(sum(n) FILTER (path IN ({wanted})), 0) / {full}) AS score, {columns} FROM
      (SELECT repo, path, CAST(len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM
        (SELECT repo, path, string_split_regex(text, {LINE_BREAKS}) AS p FROM root_files)) GROUP BY repo"""


def _root_file_scores(x: Inputs, key: str, names: tuple[str, ...]) -> DataFrame:
    tables = an.Tables(repos_of(x.root_files), x.root_files)
    fields = {n: f"try_element_at(from_json(details, 'map<string,bigint>'), '{n}')" for n in names}
    return an.analyze(tables, [key]).select("repo", "score", *exprs(**fields))


@query("documentation_analyzer", _root_lines(an.DOC_FILES, "300.0e0"), "root_files")
def documentation_analyzer(x: Inputs) -> DataFrame:
    return _root_file_scores(x, "documentation", an.DOC_FILES)


@query("manifest_size_analyzer", _root_lines(an.ROOT_MANIFESTS, "200.0e0"), "root_files")
def manifest_size_analyzer(x: Inputs) -> DataFrame:
    return _root_file_scores(x, "dependencies", an.ROOT_MANIFESTS)


TEST_RATIO = r"""SELECT repo, count(*) FILTER (t) AS test_files, count(*) FILTER (NOT t) AS source_files,
       count(*) FILTER (t) / CAST(greatest(1, count(*) FILTER (NOT t)) AS DOUBLE) AS ratio
FROM file_repos LEFT JOIN (SELECT repo, regexp_matches(lower(path), 'test_|_test|/tests/|__tests__|\.spec\.|\.test\.') AS t
  FROM files WHERE path LIKE '%.py') USING (repo) GROUP BY repo"""


@query("test_ratio", TEST_RATIO, "file_repos files")
def test_ratio(x: Inputs) -> DataFrame:
    result = an.analyze(an.Tables(file_repos(x), x.files), ["tests"])
    fields = "from_json(details, 'test_files bigint, source_files bigint, ratio double') AS d"
    return result.selectExpr("repo", fields).select("repo", "d.*")


@query(
    "complexity_analyzer",
    """SELECT repo, greatest(0.0, 1.0 - tokens / 5000.0e0) AS score, tokens AS complexity_tokens FROM
       (SELECT repo, CAST(coalesce(sum(len(regexp_extract_all(text, 'if |for |while |case |except '))), 0) AS BIGINT) AS tokens
        FROM file_repos LEFT JOIN (SELECT * FROM files WHERE path LIKE '%.py') USING (repo) GROUP BY repo)""",
    "file_repos files",
)
def complexity_analyzer(x: Inputs) -> DataFrame:
    tokens = F.from_json("details", "complexity_tokens bigint")["complexity_tokens"]
    result = an.analyze(an.Tables(file_repos(x), x.files), ["complexity"])
    return result.select("repo", "score", tokens.alias("complexity_tokens"))


@query(
    "analyzer_scores",
    r"""SELECT repo, name, round(score, 9) AS score FROM (
        SELECT repo, 'ci' AS name, 0.0e0 AS score FROM file_repos
        UNION ALL SELECT repo, 'documentation', 0.0e0 FROM file_repos
        UNION ALL SELECT repo, 'dependencies', 0.0e0 FROM file_repos
        UNION ALL SELECT repo, 'loc', least(1.0, coalesce(sum(code_lines), 0) / 10000.0e0) FROM file_repos LEFT JOIN loc USING (repo) GROUP BY repo
        UNION ALL SELECT repo, 'loc', least(1.0, coalesce(sum(total_lines_any - blank_any), 0) / 10000.0e0) FROM file_repos LEFT JOIN
          (SELECT repo, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS total_lines_any,
                  len(list_filter(parts, lambda l: trim(l) = '' )) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS blank_any
           FROM lined WHERE ext IN ('.py', '.js', '.java', '.go')) USING (repo) GROUP BY repo
        UNION ALL SELECT repo, 'tests', least(1.0, count(*) FILTER (t) / CAST(greatest(1, count(*) FILTER (NOT t)) AS DOUBLE))
          FROM file_repos LEFT JOIN (SELECT repo, regexp_matches(lower(path), 'test_|/tests/') AS t FROM files WHERE path LIKE '%.py') USING (repo) GROUP BY repo
        UNION ALL SELECT repo, 'complexity', greatest(0.0, 1.0 - coalesce(sum(len(regexp_extract_all(text, 'if |for |while |case |except '))), 0) / 5000.0e0)
          FROM file_repos LEFT JOIN (SELECT * FROM files WHERE path LIKE '%.py') USING (repo) GROUP BY repo)""",
    "file_repos files loc lined",
)
def analyzer_scores(x: Inputs) -> DataFrame:
    results = an.analyze(an.Tables(file_repos(x), x.files))
    return results.select("repo", "name", F.round("score", 9).alias("score"))


# Sinks and discovery

@query(
    "json_rows",
    """SELECT repo, '{"files":' || files || ',"language":"' || language || '","repo":"' || repo || '"}' AS report FROM
       (SELECT repo, language, count(*) AS files FROM fx WHERE NOT excluded AND language IS NOT NULL GROUP BY repo, language)""",
    "fx",
)
def json_rows(x: Inputs) -> DataFrame:
    return as_json(f.files_per_language(x.files))


@query(
    "manifest_discovery",
    """SELECT repo, path, path AS file_name,
              CASE path WHEN 'package.json' THEN 'javascript' WHEN 'pom.xml' THEN 'jvm' ELSE 'python' END AS source
       FROM root_files WHERE path IN ('requirements.txt', 'pyproject.toml', 'package.json', 'pom.xml')""",
    "root_files",
)
def manifest_discovery(x: Inputs) -> DataFrame:
    return manifests.discover_manifests(x.root_files).select("repo", "path", "file_name", "source")
