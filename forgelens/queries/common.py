"""Query registry and the common table expressions of the comparison SQL.

The comparison SQL is written apart from the operators and runs on another engine. It shares the
adapters of the input tables and the fixed values, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from forgelens.functions.paths import LANGUAGES
from forgelens.sources import adapters
from forgelens.sources.adapters import Inputs

AS_OF = datetime(2001, 9, 1)
LICENSE_RULES = (("red", "GPL"), ("small", "MIT"), ("large", "Proprietary"), ("blue", "BSD"))


@dataclass
class Query:
    build: Callable[[Inputs], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, body: str | None, uses: str = "") -> Callable:
    """Register a query. ``uses`` names the common table expressions its SQL needs."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = Query(build, None if body is None else with_tables(uses.split(), body))
        return build

    return register


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PY_SPACE = _sql_text("".join(chr(c) for c in range(0x3001) if chr(c).isspace()))
LINE_BREAKS = r"'\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
DIR_NAMES = r"\.git|\.hg|\.svn|__pycache__|node_modules|\.venv|venv|dist|build|\.idea|\.vscode"

_LANGUAGES = ", ".join(f"('{ext}', '{name}')" for ext, name in LANGUAGES.items())
_CONFIG = (
    "'pyproject.toml', 'setup.py', 'setup.cfg', 'requirements.txt', 'package.json', 'pom.xml', "
    "'build.gradle', 'gradle.properties', '.editorconfig', '.gitignore', '.gitattributes'"
)

# Each entry: the tables it needs itself, and its SELECT.
TABLES: dict[str, tuple[str, str]] = {
    "commits": ("", adapters.COMMITS_SQL),
    "commit_files": ("", adapters.COMMIT_FILES_SQL),
    "files": ("", adapters.DOCUMENT_FILES_SQL.format(bytes="strlen")),
    "root_files": ("", adapters.ROOT_FILES_SQL.format(bytes="strlen")),
    "root_repos": ("root_files", "SELECT DISTINCT repo FROM root_files"),
    "page_files": ("", adapters.PAGE_FILES_SQL.format(bytes="strlen")),
    "occ": ("", adapters.OCCURRENCES_SQL),
    "req": ("", adapters.REQUIREMENT_LINES_SQL),
    "c": (
        "commits",
        "SELECT repo, seq, commit_hash, lower(trim(author_name)) AS author_name, "
        "lower(trim(author_email)) AS author_email, authored_at, message FROM commits",
    ),
    "repos": ("commits", "SELECT DISTINCT repo FROM commits"),
    "file_repos": ("files", "SELECT DISTINCT repo FROM files"),
    "dep_repos": ("occ", "SELECT DISTINCT repo FROM occ"),
    "stats": (
        "commit_files",
        "SELECT repo, commit_hash, count(*) AS files_changed, CAST(sum(insertions) AS BIGINT) AS insertions, "
        "CAST(sum(deletions) AS BIGINT) AS deletions FROM commit_files GROUP BY repo, commit_hash",
    ),
    "cs": (
        "c stats",
        "SELECT c.*, coalesce(files_changed, 0) AS files_changed, coalesce(insertions, 0) AS insertions, "
        "coalesce(deletions, 0) AS deletions FROM c LEFT JOIN stats USING (repo, commit_hash)",
    ),
    "contrib": (
        "cs",
        "SELECT repo, author_email, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, "
        "CAST(sum(deletions) AS BIGINT) AS deletions, min(seq) AS first_seq FROM cs GROUP BY repo, author_email",
    ),
    "ranked": (
        "contrib",
        "SELECT repo, author_email, commits, "
        "row_number() OVER (PARTITION BY repo ORDER BY commits DESC, first_seq) AS position, "
        "sum(commits) OVER (PARTITION BY repo ORDER BY commits DESC, first_seq "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, "
        "sum(commits) OVER (PARTITION BY repo) AS total FROM contrib",
    ),
    "bus": (
        "ranked",
        "SELECT repo, count(*) AS bus_factor FROM ranked "
        "WHERE position = 1 OR CAST(cum - commits AS DOUBLE) / total < 0.5 GROUP BY repo",
    ),
    "freq": (
        "c",
        "SELECT repo, count(*) AS total_commits, "
        "greatest(CAST(floor((epoch(max(authored_at)) - epoch(min(authored_at))) / 86400) AS BIGINT) + 1, 1) AS days_active, "
        "CAST(floor((epoch(TIMESTAMP '2001-09-01') - epoch(max(authored_at))) / 86400) AS BIGINT) AS days_since_last_commit, "
        "count(*) FILTER (length(trim(message)) >= 10) AS meaningful_messages, "
        "count(*) FILTER (lower(message) LIKE 'merge%') AS merge_commits FROM c GROUP BY repo",
    ),
    "hist": (
        "freq bus",
        "SELECT repo, total_commits, days_active, round(total_commits / CAST(days_active AS DOUBLE), 3) AS commits_per_day, "
        "days_since_last_commit >= 90 AS inactive, days_since_last_commit, meaningful_messages, "
        "round(meaningful_messages / CAST(total_commits AS DOUBLE), 3) AS meaningful_ratio, merge_commits, "
        "round(merge_commits / CAST(total_commits AS DOUBLE), 3) AS merge_ratio, bus_factor FROM freq JOIN bus USING (repo)",
    ),
    "scored": (
        "hist",
        "SELECT *, greatest(round(100.0e0 - CASE WHEN inactive THEN 30 ELSE 0 END "
        "- CASE WHEN commits_per_day < 0.01 THEN 20 WHEN commits_per_day < 0.05 THEN 10 ELSE 0 END "
        "- CASE WHEN bus_factor <= 1 THEN 15 ELSE 0 END - CASE WHEN meaningful_ratio < 0.3 THEN 10 ELSE 0 END, 2), 0.0e0) AS score FROM hist",
    ),
    "impact": (
        "commit_files",
        "SELECT repo, path, count(*) AS commits, CAST(sum(insertions) AS BIGINT) AS insertions, "
        "CAST(sum(deletions) AS BIGINT) AS deletions FROM commit_files GROUP BY repo, path",
    ),
    "churn": (
        "impact",
        "SELECT repo, count(*) AS files, count(*) FILTER (v > 2 * m) AS high_churn_files, round(any_value(m), 2) AS average_churn "
        "FROM (SELECT repo, insertions + deletions AS v, avg(insertions + deletions) OVER (PARTITION BY repo) AS m FROM impact) "
        "GROUP BY repo",
    ),
    "langs": ("", f"SELECT * FROM (VALUES {_LANGUAGES}) t(ext, language)"),
    "named": (
        "files",
        "SELECT *, regexp_extract(path, '[^/]*$') AS name, "
        "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, "
        r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS ext, "
        "length(path) - length(replace(path, '/', '')) + 1 AS depth FROM files",
    ),
    "lined": (
        "named",
        f"SELECT *, regexp_matches('/' || dir || '/', '/({DIR_NAMES})/') AS excluded, "
        "contains(left(text, 1024), chr(0)) AS is_binary, "
        f"string_split_regex(text, {LINE_BREAKS}) AS parts FROM named",
    ),
    "fx": (
        "lined langs",
        "SELECT lined.*, language, CASE WHEN is_binary THEN 'binary' "
        r"WHEN regexp_matches('/' || lower(path), 'test_|_test|/tests/|/__tests__/|\.spec\.|\.test\.') THEN 'test' "
        f"WHEN name IN ({_CONFIG}) THEN 'config' WHEN ext IN ('.md', '.rst', '.txt', '.adoc') THEN 'docs' "
        "WHEN language IS NOT NULL THEN 'source' ELSE 'unknown' END AS category, "
        "CAST(CASE WHEN is_binary THEN 0 ELSE len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END END AS BIGINT) AS total_lines, "
        f"CAST(CASE WHEN is_binary THEN 0 ELSE len(list_filter(parts, lambda x: trim(x, {PY_SPACE}) = '')) "
        "- CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END END AS BIGINT) AS blank_lines "
        "FROM lined LEFT JOIN langs USING (ext)",
    ),
    "dirs": (
        "named",
        "SELECT DISTINCT repo, array_to_string(list_slice(p, 1, i), '/') AS path, CAST(i AS INTEGER) AS depth FROM "
        "(SELECT repo, string_split(dir, '/') AS p, unnest(range(1, depth)) AS i FROM named WHERE dir <> '')",
    ),
    "listed_dirs": (
        "dirs",
        f"SELECT * FROM dirs WHERE NOT regexp_matches('/' || path || '/', '/({DIR_NAMES})/')",
    ),
    "loc": (
        "fx",
        "SELECT repo, path, total_lines, total_lines - blank_lines - comment_lines AS code_lines, blank_lines, comment_lines "
        "FROM (SELECT repo, path, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS total_lines, "
        f"CAST(len(list_filter(parts, lambda x: trim(x, {PY_SPACE}) = '')) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS blank_lines, "
        f"CAST(len(list_filter(parts, lambda x: starts_with(ltrim(x, {PY_SPACE}), CASE WHEN ext = '.py' THEN '#' ELSE '//' END))) AS BIGINT) AS comment_lines "
        "FROM fx WHERE ext IN ('.py', '.js', '.ts', '.java') "
        r"AND NOT regexp_matches('/' || path || '/', '/(\.git|__pycache__|node_modules|\.venv|venv|dist|build)/'))",
    ),
    "entries": (
        "occ",
        "SELECT repo, file_seq, min(entry_seq) AS entry_seq, name, arg_max(struct_pack(v := version, s := source, t := dep_type), entry_seq) AS last "
        "FROM occ GROUP BY repo, file_seq, name",
    ),
    "merged": (
        "entries",
        "SELECT repo, name, CASE WHEN count(*) FILTER (last.v <> '') > 0 THEN arg_min(last.v, file_seq) FILTER (last.v <> '') "
        "ELSE arg_min(last, file_seq).v END AS version, arg_min(last, file_seq).s AS source, "
        "coalesce(arg_min(last.t, file_seq) FILTER (last.t <> 'unknown'), 'unknown') AS dep_type, "
        "min(file_seq) AS file_seq, arg_min(entry_seq, file_seq) AS entry_seq FROM entries GROUP BY repo, name",
    ),
    "placed": (
        "merged",
        "SELECT *, row_number() OVER (PARTITION BY repo, lower(name) ORDER BY file_seq, entry_seq) AS rn, "
        "row_number() OVER (PARTITION BY repo, lower(name), coalesce(version, '') <> '' ORDER BY file_seq, entry_seq) AS vn "
        "FROM merged",
    ),
    "dedup": (
        "placed",
        "SELECT repo, lower(name) AS dep_key, max(CASE WHEN rn = 1 THEN name END) AS name, "
        "coalesce(max(CASE WHEN vn = 1 AND coalesce(version, '') <> '' THEN version END), max(CASE WHEN rn = 1 THEN version END)) AS version, "
        "max(CASE WHEN rn = 1 THEN source END) AS source, max(CASE WHEN rn = 1 THEN dep_type END) AS dep_type "
        "FROM placed GROUP BY repo, lower(name)",
    ),
    "deps": (
        "dedup",
        "SELECT *, CASE WHEN starts_with(lower(name), 'red') THEN 'GPL' WHEN starts_with(lower(name), 'small') THEN 'MIT' "
        "WHEN starts_with(lower(name), 'large') THEN 'Proprietary' WHEN starts_with(lower(name), 'blue') THEN 'BSD' ELSE 'Unknown' END AS license, "
        "coalesce(starts_with(version, '0.'), false) AS is_zero, "
        "coalesce(contains(version, 'alpha') OR contains(version, 'beta'), false) AS is_alpha, "
        "coalesce(contains(version, 'alpha') OR contains(version, 'beta') OR contains(version, 'dev'), false) AS is_pre, "
        "coalesce(version, '') <> '' AS pinned, TRY_CAST(regexp_extract(version, '[0-9]+') AS BIGINT) AS major FROM dedup",
    ),
}


def with_tables(names: list[str], body: str) -> str:
    """The body under a WITH clause of the named tables and of those they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in TABLES[name][0].split():
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    body = body.strip()
    ctes = ",\n".join(f"{name} AS ({TABLES[name][1].strip()})" for name in order)
    if not ctes:
        return body
    return f"WITH {ctes}{body}" if body.startswith(",") else f"WITH {ctes}\n{body}"
