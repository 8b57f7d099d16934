"""Table contract of the engine and the helpers every operator shares.

Timestamps are ``TIMESTAMP_NTZ`` in UTC, so no result depends on the session time zone.
``seq`` columns are unique within a repository and give the order in which the producer
listed the rows (scan order, newest commit first). Directories derived from files share the ``seq`` of
their first file and are told apart by ``depth``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from forgelens.functions.sql import exprs

REPOS = "repo string"
FILES = (
    "repo string, seq bigint, path string, content binary, size_bytes bigint, is_symlink boolean, "
    "is_executable boolean, last_modified timestamp_ntz, readable boolean, error string"
)
DIRS = "repo string, seq bigint, path string, depth int, is_symlink boolean, readable boolean"
COMMITS = (
    "repo string, seq bigint, commit_hash string, author_name string, author_email string, "
    "authored_at timestamp_ntz, message string"
)
COMMIT_FILES = (
    "repo string, commit_hash string, ordinal int, path string, insertions bigint, deletions bigint"
)
IGNORE_RULES = "repo string, kind string, pattern string"
MANIFESTS = (
    "repo string, path string, file_seq string, file_name string, source string, content binary"
)
VULNERABILITIES = (
    "array<struct<identifier:string,severity:string,description:string,fixed_version:string>>"
)
OCCURRENCES = (
    "repo string, file_seq string, entry_seq int, name string, version string, source string, "
    "dep_type string"
)

FILE_DEFAULTS = {
    "content": "cast(NULL AS binary)",
    "last_modified": "cast(NULL AS timestamp_ntz)",
    "readable": "true",
    "error": "cast(NULL AS string)",
}

# The enumerations of the data model, as stored strings.
DEPENDENCY_TYPES = ("runtime", "development", "build", "optional", "peer", "unknown")
DEPENDENCY_SOURCES = ("python", "javascript", "go", "rust", "php", "ruby", "jvm", "unknown")
LICENSES = ("MIT", "Apache-2.0", "GPL", "BSD", "MPL", "Proprietary", "Unknown")
SEVERITIES = ("low", "medium", "high", "critical")


def repos_of(*frames: DataFrame) -> DataFrame:
    """Every repository named in any of the frames."""
    names = [frame.select("repo").distinct() for frame in frames]
    if len(names) == 1:
        return names[0]
    return reduce(DataFrame.unionByName, names).distinct()


def per_repo(repos: DataFrame, *parts: DataFrame, zeros: dict[str, object] | None = None) -> DataFrame:
    """One row per repository: left-joins per-repository results and fills the empty groups.

    Each part has at most one row per repository and is already partitioned by ``repo`` when it
    comes from a ``groupBy``, so the joins add no shuffle of their own.
    """
    joined = reduce(lambda left, right: left.join(right, "repo", "left"), parts, repos)
    return joined.fillna(zeros) if zeros else joined


def with_file_defaults(files: DataFrame) -> DataFrame:
    """Add the optional ingest columns to a file table that lacks them."""
    missing = {k: v for k, v in FILE_DEFAULTS.items() if k not in files.columns}
    return files.select("*", *exprs(**missing)) if missing else files
