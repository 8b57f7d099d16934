"""Lines of code per repository: totals, mean and median."""

from __future__ import annotations

from pyspark.sql import DataFrame

from forgelens.functions.sql import exprs
from forgelens.operators.files import line_kinds
from forgelens.tables import per_repo

LINE_KINDS = ("total_lines", "code_lines", "blank_lines", "comment_lines")


def loc_totals(repos: DataFrame, file_loc: DataFrame) -> DataFrame:
    totals = file_loc.groupBy("repo").agg(
        *exprs(files="count(*)", **{c: f"sum({c})" for c in LINE_KINDS})
    )
    return per_repo(repos, totals, zeros=dict.fromkeys(["files", *LINE_KINDS], 0))


def loc_summary(repos: DataFrame, file_loc: DataFrame) -> DataFrame:
    """Totals with mean and exact median of total and code lines, from one reading of the files.

    Files are first counted per measure and value. Sums, means and medians all follow from these
    counts, and the median sees distinct values with frequencies instead of one row per file.
    A repository without files has zero totals and NULL statistics.
    """
    measures = ", ".join(f"'{c}', {c}" for c in LINE_KINDS)
    counted = (
        file_loc.selectExpr("repo", f"explode(map({measures})) AS (measure, value)")
        .groupBy("repo", "measure", "value")
        .agg(*exprs(n="count(*)"))
        .groupBy("repo", "measure")
        .agg(
            *exprs(
                files="sum(n)",
                total="sum(value * n)",
                mean="sum(value * n) / sum(n)",
                median="percentile(value, 0.5D, n)",
            )
        )
    )

    def pick(stat: str, measure: str) -> str:
        return f"max(CASE WHEN measure = '{measure}' THEN {stat} END)"

    stats = {f"{s}_{m}": pick(s, m) for m in ("total_lines", "code_lines") for s in ("mean", "median")}
    totals = {"files": pick("files", "total_lines"), **{m: pick("total", m) for m in LINE_KINDS}}
    pivoted = counted.groupBy("repo").agg(*exprs(**totals, **stats))
    return per_repo(repos, pivoted, zeros=dict.fromkeys(totals, 0))


def loc_report(repos: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Summary with statistics per repository, and the per-file rows beside it."""
    file_loc = line_kinds(files)
    return {"summary": loc_summary(repos, file_loc), "files": file_loc}
