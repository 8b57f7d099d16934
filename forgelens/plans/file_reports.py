"""Scan reports, repository summaries and the file inventory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.operators import files as f


def perform_scan(
    files: DataFrame,
    dirs: DataFrame,
    limits: f.ScanLimits | None = None,
    exclude_dirs: Iterable[str] = (),
    check_permissions: bool = True,
    max_errors: int | None = None,
) -> f.Scan:
    """Scan, then directory totals, then the limits and, where wanted, the cut of the errors."""
    scan = f.scan_guarded if check_permissions else f.scan_best_effort
    found = scan(files, dirs, limits, exclude_dirs)
    errors = found.errors
    if max_errors is not None:
        errors = f.truncate_errors(errors, max_errors)
    return f.Scan(found.files, f.directory_totals(found.files, found.dirs), errors)


def quick_scan_report(
    repos: DataFrame, files: DataFrame, dirs: DataFrame, exclude_dirs: Iterable[str] = ()
) -> DataFrame:
    """Counts only, from the best-effort scan. Directory totals are not needed for them."""
    found = f.scan_best_effort(files, dirs, None, exclude_dirs)
    return f.scan_summary(repos, found).withColumnRenamed("errors_count", "errors")


def detailed_scan_report(
    repos: DataFrame,
    files: DataFrame,
    dirs: DataFrame,
    limits: f.ScanLimits | None = None,
    exclude_dirs: Iterable[str] = (),
    max_errors: int | None = None,
) -> dict[str, DataFrame]:
    """The summary counts all errors; ``max_errors`` cuts the listed ones only."""
    found = perform_scan(files, dirs, limits, exclude_dirs)
    listed = found.errors if max_errors is None else f.truncate_errors(found.errors, max_errors)
    return {
        "summary": f.scan_summary(repos, found),
        "files": found.files,
        "directories": found.dirs,
        "errors": listed,
    }


def quick_repository_summary(
    repos: DataFrame, files: DataFrame, exclude_dirs: Iterable[str] = ()
) -> dict[str, DataFrame]:
    return f.summary_parts(repos, f.summary_counts(files, exclude_dirs, with_lines=False))


def repository_summary(
    repos: DataFrame, files: DataFrame, dirs: DataFrame, exclude_dirs: Iterable[str] = ()
) -> dict[str, DataFrame]:
    """Extra exclusions reach the language, category and line counts only. All parts come from one pass over contents."""
    counts = f.summary_counts(files, exclude_dirs)
    return {**f.summary_parts(repos, counts), "depths": f.depths_of(counts, dirs)}


def engine_summary(
    repos: DataFrame, files: DataFrame, dirs: DataFrame, max_entries: int = 100_000
) -> dict[str, DataFrame]:
    """Entry count, directory names, extensions and findings of the whole tree, nothing excluded."""
    return {
        "entries": f.entry_counts(repos, files, dirs),
        "directories": f.directory_names(dirs),
        "extensions": f.extension_histogram(files),
        "findings": f.structure_findings(repos, files, dirs, max_entries),
    }


def file_inventory(
    files: DataFrame,
    rules: DataFrame,
    exclude_dirs: Iterable[str] = (),
    include_hashes: bool = False,
) -> DataFrame:
    """Size, category, language and optional hash of every file that is not ignored.

    Features are computed before the rules are applied, so the join carries no content.
    """
    found = f.classify_files(f.listed(files, exclude_dirs))
    columns = ["repo", "path", F.col("size_bytes").alias("size"), "category", "language"]
    if include_hashes:
        found = f.file_hashes(found)
        columns.append("hash")
    return f.drop_ignored(found.select(*columns), rules)


def extended_repository_summary(
    repos: DataFrame,
    files: DataFrame,
    rules: DataFrame,
    exclude_dirs: Iterable[str] = (),
    include_hashes: bool = False,
) -> dict[str, DataFrame]:
    """The total size leaves the ignore rules out of account."""
    inventory = file_inventory(files, rules, exclude_dirs, include_hashes)
    languages = inventory.where("language IS NOT NULL").groupBy("repo", "language")
    return {
        "size": f.directory_size(repos, files),
        "files": inventory,
        "languages": languages.agg(F.count("*").alias("files")),
    }
