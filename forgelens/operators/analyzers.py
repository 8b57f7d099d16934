"""Analyzers: scores per repository as rows ``(repo, name, score, details)``.

The built-in analyzers are folds: aggregates over ``file_measures`` with a score and details on top.
All chosen folds run in one aggregate over one reading of the files. An analyzer of a user's own is
either another fold or any DataFrame function, registered by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from forgelens.functions import paths
from forgelens.functions.sql import array_of, exprs, in_list, lit, present_only
from forgelens.operators.files import file_measures
from forgelens.tables import per_repo

# The files the analyzers look for.
CI_PATHS = (".github/workflows", ".gitlab-ci.yml", ".travis.yml", "Jenkinsfile")
DOC_FILES = ("README.md", "CONTRIBUTING.md", "CHANGELOG.md")
ROOT_MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json", "pom.xml")


@dataclass
class Tables:
    repos: DataFrame
    files: DataFrame


@dataclass(frozen=True)
class Fold:
    """``aggregates`` over the file measures; ``score`` and ``details`` (a struct) over those."""

    name: str
    aggregates: dict[str, str]
    score: str
    details: str


FOLDS: dict[str, Fold] = {}
CUSTOM: dict[str, Callable[[Tables], DataFrame]] = {}


def register_fold(key: str, fold: Fold) -> None:
    FOLDS[key] = fold


def register(key: str, analyzer: Callable[[Tables], DataFrame]) -> None:
    """Add a DataFrame function that returns ``(repo, name, score, details)``."""
    CUSTOM[key] = analyzer


def folded(tables: Tables, keys: Iterable[str]) -> DataFrame:
    """The aggregates of the folds, one row per repository, from a single pass."""
    aggregates = {f"{k}_{a}": sql for k in keys for a, sql in FOLDS[k].aggregates.items()}
    measures = file_measures(tables.files, [*DOC_FILES, *ROOT_MANIFESTS])
    return per_repo(tables.repos, measures.groupBy("repo").agg(*exprs(**aggregates)))


def _row(key: str) -> str:
    fold = FOLDS[key]
    named = {a: f"`{key}_{a}`" for a in fold.aggregates}
    score, details = fold.score.format(**named), fold.details.format(**named)
    return f"struct({lit(fold.name)} AS name, double({score}) AS score, to_json({details}) AS details)"


def analyze(tables: Tables, keys: Iterable[str] | None = None) -> DataFrame:
    """Results of the chosen analyzers, all of them by default."""
    chosen = [*FOLDS, *CUSTOM] if keys is None else list(keys)
    folds = [k for k in chosen if k in FOLDS]
    results = [CUSTOM[k](tables) for k in chosen if k not in FOLDS]
    if folds:
        rows = ", ".join(_row(k) for k in folds)
        results.append(folded(tables, folds).selectExpr("repo", f"inline(array({rows}))"))
    return reduce(DataFrame.unionByName, results)


def _sum(value: str, condition: str = "true") -> str:
    return f"coalesce(sum({value}) FILTER (WHERE {condition}), 0)"


def _zero(name: str) -> str:
    return f"coalesce({{{name}}}, 0L)"


def _zeros(*names: str) -> str:
    return ", ".join(f"{_zero(n)} AS {n}" for n in names)


# Lines of nine code suffixes: comments count as code and nothing is excluded.
register_fold(
    "loc",
    Fold(
        "loc",
        {
            "files": "count_if(is_code)",
            "lines": _sum("lines", "is_code"),
            "code_lines": _sum("lines - blank_lines", "is_code"),
            "blank_lines": _sum("blank_lines", "is_code"),
        },
        f"least(1.0D, {_zero('code_lines')} / 10000.0D)",
        f"struct({_zeros('files', 'lines', 'code_lines', 'blank_lines')})",
    ),
)

# Lines of four suffixes with comments apart. The median keeps a count per distinct value.
_KINDS = {
    "total_lines": "lines",
    "code_lines": "lines - blank_lines - comment_lines",
    "blank_lines": "blank_lines",
    "comment_lines": "comment_lines",
}
_STATS = {
    f"{stat}_{kind}": f"{function}(CASE WHEN has_comments THEN {_KINDS[kind]} END)"
    for kind in ("total_lines", "code_lines")
    for stat, function in (("mean", "avg"), ("median", "median"))
}
register_fold(
    "loc_detailed",
    Fold(
        "loc",
        {
            "files": "count_if(has_comments)",
            **{kind: _sum(value, "has_comments") for kind, value in _KINDS.items()},
            **_STATS,
        },
        f"least(1.0D, {_zero('code_lines')} / 10000.0D)",
        f"struct(struct({_zeros('files', *_KINDS)}) AS summary, "
        f"struct({', '.join(f'{{{s}}} AS {s}' for s in _STATS)}) AS statistics)",
    ),
)

register_fold(
    "complexity",
    Fold(
        "complexity",
        {"complexity_tokens": _sum("tokens")},
        f"greatest(0.0D, 1.0D - {_zero('complexity_tokens')} / 5000.0D)",
        f"struct({_zeros('complexity_tokens')})",
    ),
)

_PYTHON = f"{paths.raw_suffix()} = '.py'"
_RATIO = f"{_zero('test_files')} / double(greatest(1L, {_zero('source_files')}))"
register_fold(
    "tests",
    Fold(
        "tests",
        {
            "test_files": f"count_if({_PYTHON} AND {paths.is_index_test_path()})",
            "source_files": f"count_if({_PYTHON} AND NOT {paths.is_index_test_path()})",
        },
        f"least(1.0D, {_RATIO})",
        f"struct({_zeros('test_files', 'source_files')}, {_RATIO} AS ratio)",
    ),
)


def _root_file_fold(name: str, files: tuple[str, ...], full: float) -> Fold:
    """Lines of named root files; details name the files that exist."""
    aggregates = {f"f{i}": f"max(lines) FILTER (WHERE path = {lit(f)})" for i, f in enumerate(files)}
    total = " + ".join(_zero(a) for a in aggregates)
    found = present_only(
        *[f"if({{f{i}}} IS NULL, NULL, struct({lit(f)} AS k, {{f{i}}} AS v))" for i, f in enumerate(files)]
    )
    return Fold(name, aggregates, f"least(1.0D, ({total}) / {full}D)", f"map_from_entries({found})")


register_fold("documentation", _root_file_fold("documentation", DOC_FILES, 300.0))
register_fold("dependencies", _root_file_fold("dependencies", ROOT_MANIFESTS, 200.0))

_CI = {f"p{i}": f"path = {lit(p)} OR startswith(path, {lit(p + '/')})" for i, p in enumerate(CI_PATHS)}
_CI_FOUND = present_only(*[f"CASE WHEN {{p{i}}} THEN {lit(p)} END" for i, p in enumerate(CI_PATHS)])
register_fold(
    "ci",
    Fold(
        "ci",
        {name: f"bool_or({condition})" for name, condition in _CI.items()},
        f"if(size({_CI_FOUND}) > 0, 1.0D, 0.0D)",
        f"struct({_CI_FOUND} AS ci_files)",
    ),
)
