"""Ignore rules from the ignore files at the root of each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame

from forgelens.functions.sql import in_list
from forgelens.functions.text import lines, safe_text, strip

# The ignore files that are read.
IGNORE_FILES = (".gitignore", ".ignore", ".repoignore")


def parse_ignore_lines(rules: DataFrame, line: str = "line") -> DataFrame:
    """``(repo, kind, pattern)`` of rule lines; blank lines and comments are dropped."""
    kind = (
        "CASE WHEN startswith(rule, '*') AND length(rule) > 1 THEN 'suffix' "
        "WHEN endswith(rule, '*') AND length(rule) > 1 THEN 'prefix' ELSE 'contains' END"
    )
    pattern = (
        "CASE kind WHEN 'suffix' THEN substring(rule, 2) "
        "WHEN 'prefix' THEN left(rule, length(rule) - 1) ELSE rule END"
    )
    return (
        rules.selectExpr("repo", f"{strip(line)} AS rule")
        .where("rule <> '' AND NOT startswith(rule, '#')")
        .selectExpr("repo", "rule", f"{kind} AS kind")
        .selectExpr("repo", "kind", f"{pattern} AS pattern")
        .distinct()
    )


def standard_ignore_rules(files: DataFrame) -> DataFrame:
    found = files.where(f"{in_list('path', IGNORE_FILES)} AND error IS NULL")
    return parse_ignore_lines(found.selectExpr("repo", f"explode({lines(safe_text('content'))}) AS line"))
