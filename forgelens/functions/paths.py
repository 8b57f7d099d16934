"""Path expressions and path predicates. Paths are relative to the repository, with ``/``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from forgelens.functions.sql import in_list, lit, map_of

# Name lists and markers that decide how a file is classified.
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", "dist", "build",
    ".idea", ".vscode",
)
LOC_EXCLUDED_NAMES = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build")
TEST_MARKERS = ("test_", "_test", "/tests/", "/__tests__/", ".spec.", ".test.")
INDEX_TEST_MARKERS = ("test_", "_test", "/tests/", "__tests__", ".spec.", ".test.")
CONFIG_FILES = (
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "package.json", "pom.xml",
    "build.gradle", "gradle.properties", ".editorconfig", ".gitignore", ".gitattributes",
)
DOC_SUFFIXES = (".md", ".rst", ".txt", ".adoc")
INDEX_SOURCE_SUFFIXES = (".py", ".js", ".ts", ".java", ".go", ".rs")
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go",
    ".rs": "rust", ".cpp": "cpp", ".c": "c", ".h": "c_header", ".cs": "csharp", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "shell",
    ".ps1": "powershell", ".sql": "sql", ".html": "html", ".css": "css", ".md": "markdown",
    ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".xml": "xml",
}
CATEGORIES = ("binary", "config", "docs", "source", "test", "unknown")


def file_name(path: str = "path") -> str:
    return f"substring_index({path}, '/', -1)"


def parent(path: str = "path") -> str:
    """Directory part; the empty string for an entry at the root."""
    return f"left({path}, length({path}) - length({file_name(path)}) - 1)"


def depth(path: str = "path") -> str:
    return f"(length({path}) - length(replace({path}, '/', '')) + 1)"


def ancestors(directory: str) -> str:
    """The directory itself and all directories above it, outermost first."""
    parts = f"split({directory}, '/')"
    return f"transform(sequence(1, size({parts})), n -> array_join(slice({parts}, 1, n), '/'))"


def raw_suffix(path: str = "path") -> str:
    """Last extension of the file name with its dot; empty when there is none."""
    pattern = lit(r"(?s)^.+(\.[^.]+)$")
    return f"regexp_extract({file_name(path)}, {pattern}, 1)"


def suffix(path: str = "path") -> str:
    return f"lower({raw_suffix(path)})"


def language(path: str = "path") -> str:
    names = map_of({ext: lit(name) for ext, name in LANGUAGES.items()})
    return f"try_element_at({names}, {suffix(path)})"


def _names(names: Iterable[str]) -> str:
    return "|".join(re.escape(n) for n in sorted(set(names)))


def in_excluded_dir(path: str = "path", extra: Iterable[str] = ()) -> str:
    """True when a directory above the file carries an excluded name."""
    pattern = lit(f"(^|/)({_names([*EXCLUDED_DIRS, *extra])})/")
    return f"rlike({path}, {pattern})"


def has_excluded_name(path: str, names: Iterable[str]) -> str:
    """True when any component of the path, the last one included, carries one of the names."""
    pattern = lit(f"(^|/)({_names(names)})(/|$)")
    return f"rlike({path}, {pattern})"


def is_loc_excluded(path: str = "path", extra: Iterable[str] = ()) -> str:
    return has_excluded_name(path, [*LOC_EXCLUDED_NAMES, *extra])


def is_test_path(path: str = "path") -> str:
    return f"rlike(lower('/' || {path}), {lit(_names(TEST_MARKERS))})"


def is_index_test_path(path: str = "path") -> str:
    return f"rlike(lower({path}), {lit(_names(INDEX_TEST_MARKERS))})"


def is_index_source_path(path: str = "path") -> str:
    pattern = lit(f"({_names(INDEX_SOURCE_SUFFIXES)})$")
    return f"rlike({path}, {pattern})"


def is_config_path(path: str = "path") -> str:
    return in_list(file_name(path), CONFIG_FILES)


def is_doc_path(path: str = "path") -> str:
    return in_list(suffix(path), DOC_SUFFIXES)


def category(binary: str, path: str = "path") -> str:
    """The first class that holds, in this order."""
    return (
        f"CASE WHEN {binary} THEN 'binary' WHEN {is_test_path(path)} THEN 'test' "
        f"WHEN {is_config_path(path)} THEN 'config' WHEN {is_doc_path(path)} THEN 'docs' "
        f"WHEN {in_list(suffix(path), LANGUAGES)} THEN 'source' ELSE 'unknown' END"
    )
