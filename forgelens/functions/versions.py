"""Dependency names and versions."""

from __future__ import annotations

from forgelens.functions.sql import lit
from forgelens.functions.text import strip

# Specification operators in the order they are tried, the characters of a version
# and the words of a pre-release.
SPEC_SEPARATORS = ("==", ">=", "<=", "~=", ">", "<", "^")
VERSION_CHARACTERS = r"[0-9a-zA-Z.\-+]+"
PRE_RELEASE_WORDS = ("alpha", "beta", "dev")


def present(version: str) -> str:
    return f"coalesce({version} <> '', false)"


def normalize_version(version: str) -> str:
    """The first run of version characters, which leaves out the operator before it.

    Text without such a run is only stripped; NULL and empty text give NULL.
    """
    run = f"regexp_extract({version}, {lit(VERSION_CHARACTERS)}, 0)"
    return f"CASE WHEN {version} <> '' THEN if({run} <> '', {run}, {strip(version)}) END"


def split_specs(raw_lines: str) -> str:
    """Array of ``struct(name, version)`` for an array of specifications such as ``lib>=1.0``.

    The separators are tried in order and the first one contained splits at its first place.
    """
    tried = ", ".join(f"CASE WHEN contains(r, {lit(s)}) THEN {lit(s)} END" for s in SPEC_SEPARATORS)
    marked = f"transform({raw_lines}, r -> struct(r AS raw, coalesce({tried}) AS sep))"
    parts = (
        f"transform({marked}, m -> struct("
        f"{strip('if(m.sep IS NULL, m.raw, substring_index(m.raw, m.sep, 1))')} AS name, "
        f"substring(m.raw, instr(m.raw, m.sep) + length(m.sep)) AS rest))"
    )
    version = normalize_version("p.rest")
    return f"transform({parts}, p -> struct(p.name AS name, {version} AS version))"


def first_number(version: str) -> str:
    """The first run of digits as text; empty without one."""
    return f"regexp_extract({version}, '([0-9]+)', 1)"


def has_zero_major(version: str) -> str:
    """First number is zero, wherever it stands."""
    return f"coalesce(rlike({version}, {lit(r'^[^0-9]*0+([^0-9]|$)')}), false)"


def has_positive_major(version: str) -> str:
    return f"coalesce(rlike({version}, '^[^0-9]*0*[1-9]'), false)"


def starts_with_zero(version: str) -> str:
    return f"coalesce(startswith({version}, '0.'), false)"


def contains_word(version: str, *words: str) -> str:
    return f"coalesce(rlike({version}, {lit('|'.join(words))}), false)"


def is_pre_release(version: str) -> str:
    return contains_word(version, *PRE_RELEASE_WORDS)
