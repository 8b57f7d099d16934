"""Dependency manifests: discovery in the file table and parsing into ``dep_occurrences``."""

from __future__ import annotations

import sys
import tomllib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions import paths
from forgelens.functions.sql import exprs, in_list, lit, map_of
from forgelens.functions.text import lines, strip
from forgelens.functions.versions import normalize_version, split_specs

# Functions of this module travel to the Python workers by value, so that the workers need no copy
# of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Manifest names with their ecosystem, and the sections of a package file.
MANIFEST_SOURCES = {
    "requirements.txt": "python", "pyproject.toml": "python", "setup.py": "python",
    "setup.cfg": "python", "Pipfile": "python", "poetry.lock": "python",
    "package.json": "javascript", "yarn.lock": "javascript", "pnpm-lock.yaml": "javascript",
    "go.mod": "go", "Cargo.toml": "rust", "composer.json": "php", "Gemfile": "ruby",
    "pom.xml": "jvm", "build.gradle": "jvm",
}
PACKAGE_SECTIONS = {
    "dependencies": "runtime",
    "devDependencies": "development",
    "peerDependencies": "peer",
    "optionalDependencies": "optional",
}
COMPOSER_SECTIONS = {"require": "runtime"}
JSON_FORMATS = ("package.json", "composer.json")
TOML_FORMATS = ("pyproject.toml", "Cargo.toml")
PARSED = ("requirements.txt", "setup.cfg", "go.mod", *JSON_FORMATS, *TOML_FORMATS)

ENTRIES = "array<struct<name:string,version:string,dep_type:string>>"
NO_ENTRIES = f"cast(array() AS {ENTRIES})"
KEYS = ("repo", "file_seq", "file_name", "source")


def discover_manifests(files: DataFrame) -> DataFrame:
    """Files with a manifest name, anywhere in the tree. ``file_seq`` orders by depth and path."""
    sources = map_of({name: lit(source) for name, source in MANIFEST_SOURCES.items()})
    name = paths.file_name()
    return files.where(f"{in_list(name, MANIFEST_SOURCES)} AND error IS NULL").select(
        "repo",
        "path",
        *exprs(
            file_seq=f"format_string('%05d/%s', {paths.depth()}, path)",
            file_name=name,
            source=f"element_at({sources}, {name})",
        ),
        "content",
    )


# Line formats


def _runtime(pairs: str) -> str:
    return f"transform({pairs}, e -> struct(e.name AS name, e.version AS version, 'runtime' AS dep_type))"


def _requirements(text: str) -> str:
    stripped = f"transform({lines(text)}, l -> {strip('l')})"
    kept = f"filter({stripped}, l -> l <> '' AND NOT startswith(l, '#'))"
    return _runtime(split_specs(kept))


def _settings(text: str) -> str:
    kept = f"filter({lines(text)}, l -> contains(l, '=') AND NOT startswith({strip('l')}, '['))"
    halves = f"transform({kept}, l -> split(l, '=', 2))"
    pair = f"struct({strip('h[0]')} AS name, {normalize_version('h[1]')} AS version)"
    return _runtime(f"transform({halves}, h -> {pair})")


GO_BLOCK = lit(r"(?m)^\s*require\s*\(([^)]*)\)")


def _modules(text: str) -> str:
    """One-line ``require m v`` and the lines of ``require ( ... )`` blocks."""
    plain = f"regexp_replace({text}, '//[^\\\\n]*', '')"
    outside = f"transform(split(regexp_replace({plain}, {GO_BLOCK}, ''), '\\\\n'), l -> {strip('l')})"
    single = f"transform(filter({outside}, l -> startswith(l, 'require')), l -> replace(l, 'require', ''))"
    blocks = f"split(array_join(regexp_extract_all({plain}, {GO_BLOCK}, 1), '\\n'), '\\\\n')"
    words = f"transform(concat({single}, {blocks}), l -> split({strip('l')}, '\\\\s+'))"
    pair = f"struct(w[0] AS name, {normalize_version('w[1]')} AS version)"
    return _runtime(f"transform(filter({words}, w -> size(w) >= 2), w -> {pair})")


# JSON formats: values are variants, so a value of the wrong type is told from text.

EMPTY_JSON = lit(r'^(null|false|-?0(\.0*)?([eE].*)?|""|\[\]|\{\})$')


def _json_section(section: str, dep_type: str) -> str:
    """Entries of a section. Empty values (null, false, 0, "", [], {}) mean no version."""
    items = f"coalesce(map_entries(_json.`{section}`), array())"
    named = (
        f"transform({items}, e -> struct(e.key AS name, "
        f"if(startswith(to_json(e.value), '\"'), try_variant_get(e.value, '$', 'string'), NULL) AS raw))"
    )
    version = normalize_version("e.raw")
    return f"transform({named}, e -> struct(e.name AS name, {version} AS version, '{dep_type}' AS dep_type))"


def _json_section_fails(section: str) -> str:
    """The section is no object, or holds a value that is neither text nor empty."""
    items = f"coalesce(map_entries(_json.`{section}`), array())"
    wrong = (
        f"exists({items}, e -> NOT startswith(coalesce(to_json(e.value), 'null'), '\"') "
        f"AND NOT rlike(coalesce(to_json(e.value), 'null'), {EMPTY_JSON}))"
    )
    no_object = f"coalesce(map_contains_key(_top, '{section}'), false) AND _json.`{section}` IS NULL"
    return f"({wrong} OR ({no_object}))"


def _json_entries(sections: dict[str, str]) -> str:
    return f"concat({', '.join(_json_section(s, t) for s, t in sections.items())})"


def _json_fails(sections: dict[str, str]) -> str:
    parts = ["_json IS NULL", "_json._bad IS NOT NULL", *map(_json_section_fails, sections)]
    return f"coalesce({' OR '.join(parts)}, true)"


# TOML formats: Spark has no reader, so each text is parsed where it lies.


def _toml_pairs(table: object, dep_type: str) -> list[dict[str, object]]:
    """Entries of one TOML dependency table, or of a list of specifications."""
    pairs = [(None, table)] if isinstance(table, list) else list(table.items())
    entries = []
    for name, value in pairs:
        specs = value if isinstance(value, list) else None
        rows = [(s, None, True) for s in specs] if specs is not None else [(name, value, False)]
        entries += [dict(name=n, version=v, dep_type=dep_type, is_spec=s) for n, v, s in rows]
    return entries


def _toml_entries(file_name: str, text: str) -> list[dict[str, object]]:
    data = tomllib.loads(text)
    if file_name == "Cargo.toml":
        crates = data.get("dependencies", {}).items()
        plain = {n: m if isinstance(m, str) else m.get("version") for n, m in crates}
        entries = _toml_pairs(plain, "runtime")
    else:
        project = data.get("project", {})
        entries = _toml_pairs(project.get("dependencies", {}), "runtime")
        entries += _toml_pairs(project.get("optional-dependencies", {}), "optional")
    for entry in entries:
        entry["version"] = entry["version"] or None
        if not isinstance(entry["version"] or "", str):
            raise TypeError("a version is not a string")
    return entries


TOML_TYPE = "failed boolean, raw array<struct<name:string,version:string,dep_type:string,is_spec:boolean>>"


def _read_toml(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = []
    for name, text in zip(names, texts):
        try:
            rows.append((False, _toml_entries(name, text) if text is not None else []))
        except Exception:
            rows.append((True, []))
    return pd.DataFrame(rows, columns=["failed", "raw"])


def _toml_versions() -> str:
    parts = f"transform(_toml.raw, t -> struct(t AS t, {split_specs('array(t.name)')}[0] AS s))"
    return (
        f"transform({parts}, p -> struct(if(p.t.is_spec, p.s.name, p.t.name) AS name, "
        f"if(p.t.is_spec, p.s.version, {normalize_version('p.t.version')}) AS version, "
        "p.t.dep_type AS dep_type))"
    )


# All formats


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """``(repo, file_seq, file_name, source, failed, entries)``, one row per manifest.

    One pass over the manifests, without a shuffle: the text goes to the parser of its format.
    Known manifests without a parser have no entries and never fail, as they are never opened.
    """
    def text_of(*names: str) -> str:
        return f"CASE WHEN {in_list('file_name', names)} THEN _text END"

    sections = {**PACKAGE_SECTIONS, **COMPOSER_SECTIONS}
    schema = ", ".join(f"`{s}` map<string,variant>" for s in sections) + ", _bad string"
    corrupt = "map('columnNameOfCorruptRecord', '_bad')"
    read_toml = F.pandas_udf(_read_toml, TOML_TYPE)
    texts = manifests.select(
        *KEYS,
        *exprs(
            _text=f"CASE WHEN {in_list('file_name', PARSED)} AND is_valid_utf8(cast(content AS string)) "
            "THEN cast(content AS string) END"
        ),
    )
    read = texts.withColumns(
        {
            "_json": F.expr(f"from_json({text_of(*JSON_FORMATS)}, {lit(schema)}, {corrupt})"),
            "_top": F.expr(f"from_json({text_of(*JSON_FORMATS)}, 'map<string,string>')"),
            "_toml": read_toml("file_name", F.expr(text_of(*TOML_FORMATS))),
        }
    )
    failed = (
        f"CASE WHEN NOT {in_list('file_name', PARSED)} THEN false WHEN _text IS NULL THEN true "
        f"WHEN file_name = 'package.json' THEN {_json_fails(PACKAGE_SECTIONS)} "
        f"WHEN file_name = 'composer.json' THEN {_json_fails(COMPOSER_SECTIONS)} "
        "ELSE _toml.failed END"
    )
    entries = {
        "requirements.txt": _requirements("_text"),
        "setup.cfg": _settings("_text"),
        "go.mod": _modules("_text"),
        "package.json": _json_entries(PACKAGE_SECTIONS),
        "composer.json": _json_entries(COMPOSER_SECTIONS),
        "pyproject.toml": _toml_versions(),
        "Cargo.toml": _toml_versions(),
    }
    cases = " ".join(f"WHEN {lit(name)} THEN cast({e} AS {ENTRIES})" for name, e in entries.items())
    return read.withColumn("failed", F.expr(failed)).select(
        *KEYS,
        "failed",
        F.expr(f"CASE WHEN failed OR _text IS NULL THEN {NO_ENTRIES} ELSE CASE file_name {cases} END END AS entries"),
    )


def folded(entries: str, payload: tuple[str, ...] = ("version", "dep_type")) -> str:
    """One entry per name, as a dictionary would hold them: the last entry's payload at the first entry's place.

    The entries of a manifest are sorted by name and place, so that runs of a name stand together, and each run gives its
    first place and its last payload. The result is in order of those places, as ``at``.
    """
    values = ", ".join(f"e.{c} AS {c}" for c in payload)
    ordered = f"array_sort(transform({entries}, (e, i) -> struct(e.name AS name, i AS at, {values})))"
    firsts = "filter(s, (e, i) -> i = 0 OR s[i - 1].name <> e.name)"
    lasts = "filter(s, (e, i) -> i = size(s) - 1 OR s[i + 1].name <> e.name)"
    kept = ", ".join(f"l.{c} AS {c}" for c in payload)
    merged = f"array_sort(zip_with({firsts}, {lasts}, (f, l) -> struct(f.at AS at, l.name AS name, {kept})))"
    return f"transform(array({ordered}), s -> {merged})[0]"


def merged_entries_of(parsed: DataFrame) -> DataFrame:
    """One row per name and manifest, and one without a name for a manifest that has none: ``failed`` and ``source``
    of every manifest reach whoever reads the rows, so dependencies and ecosystems come from one frame.
    """
    fold = folded("entries")
    exploded = parsed.selectExpr("repo", "file_seq", "source", "failed", f"explode_outer({fold}) AS e")
    return exploded.selectExpr(
        "repo", "file_seq", "e.at AS entry_seq", "e.name AS name", "e.version AS version", "source",
        "e.dep_type AS dep_type", "failed",
    )


def occurrences_of(parsed: DataFrame) -> DataFrame:
    """One row per dependency entry of the manifests that parsed; the others have no entries.

    The outer form keeps Spark from inferring a filter on the entries, which would parse every
    manifest a second time.
    """
    exploded = parsed.selectExpr(
        "repo", "file_seq", "source", "posexplode_outer(entries) AS (entry_seq, e)"
    ).where("e IS NOT NULL")
    return exploded.select(
        "repo", "file_seq", "entry_seq", "e.name", "e.version", "source", "e.dep_type"
    )


def detected_sources(parsed: DataFrame) -> DataFrame:
    """Ecosystems of the manifests that parsed, per repository (at most seven values)."""
    grouped = parsed.where("NOT failed").groupBy("repo")
    return grouped.agg(*exprs(sources_detected="array_sort(collect_set(source))"))
