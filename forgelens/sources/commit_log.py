"""Exported commit histories as the tables ``commits`` and ``commit_files``.

A repository's history is exported outside Spark, one file per repository, newest commit first::

    git log --numstat --format='%x1e%H|%an|%ae|%at|%s' > <root>/<repo>.log

Each record starts with the byte 0x1E, so a file splits safely across tasks. The repository is the path of its file
below the root without ``.log``: ``a/app.log`` and ``b/app.log`` are two repositories.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from forgelens.functions.sql import lit

RECORD_SEPARATOR = "\x1e"
# Years 1 to 9999; a time outside does not parse.
SECONDS_RANGE = (-62_135_596_800, 253_402_300_799)
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def parse_log_lines(records: DataFrame, line: str = "line") -> DataFrame:
    """Parse header lines into commit columns, dropping the lines that do not parse.

    A header has five fields; the message keeps any further ``|``.
    """
    kept = [c for c in records.columns if c != line]
    fields = records.selectExpr(*kept, f"split({line}, '[|]', 5) AS _f").where("size(_f) = 5")
    return (
        fields.selectExpr("*", "try_cast(trim(_f[3]) AS bigint) AS _seconds")
        .where("_seconds BETWEEN {} AND {}".format(*SECONDS_RANGE))
        .selectExpr(
            *kept,
            "_f[0] AS commit_hash",
            "_f[1] AS author_name",
            "_f[2] AS author_email",
            f"{EPOCH} + make_dt_interval(0, 0, 0, _seconds) AS authored_at",
            "_f[4] AS message",
        )
    )


def parse_numstat_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parse numstat lines; ``-`` (a binary file) counts 0 and other shapes are dropped."""
    kept = [c for c in lines.columns if c != line]
    fields = lines.selectExpr(*kept, f"split({line}, '\t') AS _f").where("size(_f) = 3")
    return fields.selectExpr(
        *kept,
        "_f[2] AS path",
        "coalesce(try_cast(_f[0] AS bigint), 0L) AS insertions",
        "coalesce(try_cast(_f[1] AS bigint), 0L) AS deletions",
    )


def _root_of(path: str) -> str:
    """The folder that repository names are relative to: of a file or a pattern, the folder above what varies."""
    parts = path.rstrip("/").split("/")
    fixed = next((i for i, part in enumerate(parts) if re.search(r"[*?\[{]", part)), len(parts))
    if fixed == len(parts) and parts[-1].endswith(".log"):
        fixed -= 1
    return "/".join(parts[:fixed])


def read_log_records(spark: SparkSession, path: str) -> DataFrame:
    """Records ``(repo, block, place, header, body)`` of exported histories.

    ``path`` is a folder, searched for ``*.log`` at any depth, a file, or a pattern. Large files are split into blocks;
    ``block`` (the byte at which it starts) and then ``place`` order the records of a file.
    """
    root = _root_of(path)
    # The metadata column holds an encoded URI; a plus sign is no space there.
    file_path = "url_decode(replace(_metadata.file_path, '+', '%2B'))"
    below = re.sub("^[a-z0-9]+:/*", "/", root) + "/"
    name = f"substring({file_path}, locate({lit(below)}, {file_path}) + {len(below)})"
    reader = spark.read.option("lineSep", RECORD_SEPARATOR)
    if root == path.rstrip("/"):
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log")
    return (
        reader.text(path)
        .where("value <> ''")
        .selectExpr(
            f"regexp_replace({name}, '[.]log$', '') AS repo",
            "_metadata.file_block_start AS block",
            "monotonically_increasing_id() AS place",
            "split(value, '\\r?\\n', 2) AS parts",
        )
        .selectExpr(
            "repo", "block", "place", "parts[0] AS header", "coalesce(get(parts, 1), '') AS body"
        )
    )


def commits_of(records: DataFrame) -> DataFrame:
    """The ``commits`` table, from one reading of the records.

    ``seq`` is the start of the record's block plus its place in the block. A record that is not empty takes two bytes at
    least, so the numbers of a block end before the next block starts: they are unique and follow the file without a
    count of what comes before. Only headers are moved to number them, never the change lists, and a block has a
    bounded size.
    """
    headers = parse_log_lines(records.selectExpr("repo", "block", "place", "header AS line"))
    kept = [c for c in headers.columns if c not in ("repo", "block", "place")]
    inside = "row_number() OVER (PARTITION BY repo, block ORDER BY place)"
    return headers.selectExpr("repo", f"block + {inside} - 1 AS seq", *kept)


def commit_files_of(records: DataFrame) -> DataFrame:
    """The ``commit_files`` table, without a shuffle."""
    parsed = parse_log_lines(records.selectExpr("repo", "header AS line", "body"))
    lines = "posexplode_outer(split(body, '\\r?\\n')) AS (ordinal, line)"
    return parse_numstat_lines(parsed.selectExpr("repo", "commit_hash", lines))
