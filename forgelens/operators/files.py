"""File operators: features, filters, scans with limits, and per-repository counts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.functions import paths, text
from forgelens.functions.sql import array_of, expr_map, exprs, in_list, lit, map_of, present_only
from forgelens.operators.shared import shared
from forgelens.operators.skew import first_n, join_hot
from forgelens.tables import per_repo

# Tokens counted as branches, code suffixes of the two line counters, and the
# comment prefix of each suffix of the second one.
BRANCH_TOKENS = ("if ", "for ", "while ", "case ", "except ")
LOC_SUFFIXES = (".py", ".js", ".ts", ".java", ".go", ".rs", ".cpp", ".c", ".h")
COMMENT_PREFIXES = {".py": "#", ".js": "//", ".ts": "//", ".java": "//"}


def classify_files(files: DataFrame, sample_bytes: int | None = text.BINARY_PROBE_BYTES) -> DataFrame:
    """Add ``language`` and ``category``; only the binary probe looks at the content."""
    binary = text.is_binary("content", sample_bytes)
    return files.withColumns(expr_map({"language": paths.language(), "category": paths.category(binary)}))


def _with_pieces(files: DataFrame, content_text: str) -> DataFrame:
    """Split the text once; the counts that follow read the pieces."""
    return files.withColumn("_pieces", F.expr(text.line_parts(content_text)))


LINE_COUNTS = {
    "total_lines": text.line_count("_pieces"),
    "blank_lines": text.blank_count("_pieces"),
    "non_blank_lines": f"{text.line_count('_pieces')} - {text.blank_count('_pieces')}",
}


def count_file_lines(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Add line counts of the safe text: none for binary or missing content."""
    body = "content" if max_bytes is None else f"substring(content, 1, {max_bytes})"
    safe = f"if({text.is_binary('content')}, '', {text.decode_lenient(body)})"
    pieces = _with_pieces(files, safe)
    totals = expr_map({k: LINE_COUNTS[k] for k in ("total_lines", "blank_lines")})
    counted = pieces.withColumns(totals).drop("_pieces")
    return counted.withColumn("non_blank_lines", F.expr("total_lines - blank_lines"))


def file_features(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Everything the reports need of each file, computed in one narrow pass.

    The content is read here and dropped here, so it never takes part in a shuffle.
    """
    return count_file_lines(classify_files(files), max_bytes).drop("content")


def _comment_count(pieces: str, suffix: str) -> str:
    """Lines that start with the comment prefix of the suffix; none where it has no prefix."""
    prefix = f"try_element_at({map_of({k: lit(v) for k, v in COMMENT_PREFIXES.items()})}, {suffix})"
    marked = f"filter({pieces}, l -> startswith({text.lstrip('l')}, {prefix}))"
    return f"bigint(if({in_list(suffix, COMMENT_PREFIXES)}, size({marked}), 0))"


def line_kinds(files: DataFrame) -> DataFrame:
    """Per-file total, code, blank and comment lines of the files the counter knows."""
    known = in_list("_suffix", COMMENT_PREFIXES)
    wanted = files.withColumn("_suffix", F.expr(paths.suffix())).where(
        f"{known} AND NOT {paths.is_loc_excluded()}"
    )
    return (
        _with_pieces(wanted, text.decode_lenient("content"))
        .select(
            "repo",
            "path",
            *exprs(
                total_lines=text.line_count("_pieces"),
                blank_lines=text.blank_count("_pieces"),
                comment_lines=_comment_count("_pieces", "_suffix"),
            ),
        )
        .selectExpr(
            "repo",
            "path",
            "total_lines",
            "total_lines - blank_lines - comment_lines AS code_lines",
            "blank_lines",
            "comment_lines",
        )
    )


def plain_line_counts(files: DataFrame) -> DataFrame:
    """Per-file lines of the nine code suffixes, read without a binary guard."""
    known = files.where(in_list(paths.suffix(), LOC_SUFFIXES))
    pieces = _with_pieces(known, text.decode_lenient("content"))
    counted = pieces.select(
        "repo", "path", *exprs(total_lines=LINE_COUNTS["total_lines"], blank_lines=LINE_COUNTS["blank_lines"])
    )
    return counted.withColumn("non_blank_lines", F.expr("total_lines - blank_lines"))


def _token_count(content_text: str) -> str:
    """Occurrences of the branch tokens as plain substrings."""
    return "bigint(" + " + ".join(f"regexp_count({content_text}, {lit(t)})" for t in BRANCH_TOKENS) + ")"


def branch_tokens(files: DataFrame) -> DataFrame:
    """Per-file count of branch tokens in Python files."""
    python = files.where("endswith(path, '.py')")
    with_text = python.withColumn("_text", F.expr(text.decode_lenient("content")))
    return with_text.select("repo", "path", *exprs(tokens=_token_count("_text")))


def file_measures(files: DataFrame, whole_root_files: Iterable[str] = ()) -> DataFrame:
    """All numbers the analyzers need of each file, from one reading of its content.

    Only code files and the named root files are decoded and split. ``lines`` and ``blank_lines``
    are plain counts, ``comment_lines`` and ``tokens`` are 0 where they are not defined.
    """
    code = in_list("_suffix", LOC_SUFFIXES)
    python = "endswith(path, '.py')"
    needed = f"{code} OR {python} OR {in_list('path', whole_root_files)}"
    decoded = files.withColumn("_suffix", F.expr(paths.suffix())).select(
        "repo",
        "path",
        "_suffix",
        *exprs(_text=f"CASE WHEN {needed} THEN {text.decode_lenient('content')} ELSE '' END"),
    )
    return _with_pieces(decoded, "_text").select(
        "repo",
        "path",
        *exprs(
            is_code=code,
            has_comments=f"{in_list('_suffix', COMMENT_PREFIXES)} AND NOT {paths.is_loc_excluded()}",
            lines=text.line_count("_pieces"),
            blank_lines=text.blank_count("_pieces"),
            comment_lines=_comment_count("_pieces", "_suffix"),
            tokens=f"if({python}, {_token_count('_text')}, 0L)",
        ),
    )


def file_hashes(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    return files.withColumn("hash", F.expr(text.content_hash("content", algorithm)))


# Filters


def listed(files: DataFrame, exclude_dirs: Iterable[str] = ()) -> DataFrame:
    """Files outside the excluded directories."""
    return files.where(f"NOT {paths.in_excluded_dir('path', exclude_dirs)}")


def listed_dirs(dirs: DataFrame, exclude_dirs: Iterable[str] = ()) -> DataFrame:
    """Directories that are neither excluded nor below an excluded one."""
    names = [*paths.EXCLUDED_DIRS, *exclude_dirs]
    return dirs.where(f"NOT {paths.has_excluded_name('path', names)}")


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``(repo, path)`` of the files that an ignore rule of their repository matches.

    Patterns are looked up, not tried: each path is spelled out once into its prefixes, suffixes and substrings of the
    lengths that occur among its repository's patterns, and those keys are joined with the patterns by equality. So the
    work follows the length of a path and the number of different lengths, not the number of rules.
    """
    patterns = rules.select("repo", "kind", F.col("pattern").alias("key")).where("key IS NOT NULL").distinct()
    lengths = patterns.selectExpr("repo", "kind", "length(key) AS n").distinct()
    spelled = join_hot(files.select("repo", "path"), lengths, ["repo"], ["path"]).where("n <= length(path)")
    keys = (
        "CASE kind WHEN 'prefix' THEN array(left(path, n)) WHEN 'suffix' THEN array(right(path, n)) "
        "ELSE array_distinct(transform(sequence(1, length(path) - n + 1), i -> substring(path, i, n))) END"
    )
    exploded = spelled.selectExpr("repo", "path", "kind", f"explode({keys}) AS key")
    hits = join_hot(exploded, patterns, ["repo", "kind", "key"], ["path"], "left_semi", ways=8)
    return hits.select("repo", "path").distinct()


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no ignore rule of their repository matches."""
    return files.join(ignored_paths(files, rules), ["repo", "path"], "left_anti")


def large_files(files: DataFrame, min_size_bytes: int) -> DataFrame:
    return files.where(f"size_bytes >= {min_size_bytes}")


def shallow_dirs(dirs: DataFrame, max_depth: int) -> DataFrame:
    return dirs.where(f"depth <= {max_depth}")


# Directories


def derive_dirs(files: DataFrame) -> DataFrame:
    """All directories above the files, for file tables that come without directory rows.

    Parents are reduced to distinct ones before exploding. ``seq`` is that of the first file below a
    directory; the directories that one file brings are ordered by their depth.
    """
    parents = (
        files.groupBy("repo", *exprs(dir=paths.parent()))
        .agg(F.min("seq").alias("first_seq"))
        .where("dir <> ''")
    )
    return (
        parents.selectExpr("repo", "first_seq", f"explode({paths.ancestors('dir')}) AS path")
        .groupBy("repo", "path")
        .agg(F.min("first_seq").alias("seq"))
        .select(
            "repo",
            *exprs(
                seq="seq",
                path="path",
                depth=f"int({paths.depth()})",
                is_symlink="false",
                readable="true",
            ),
        )
    )


def directory_totals(files: DataFrame, dirs: DataFrame, include_root: bool = False) -> DataFrame:
    """Files and bytes directly in each listed directory, empty directories included.

    A file belongs to the nearest listed directory above it. Files are summed per parent directory first. Parents and
    listed directories are then one table of paths, in which a parent that is listed is settled at once; the others are
    matched with the listed directories above them. Files at the root belong to no directory unless ``include_root``
    adds the row ``''``.
    """
    parents = files.groupBy("repo", *exprs(path=paths.parent())).agg(
        *exprs(total_files="count(*)", total_size_bytes="sum(size_bytes)")
    )
    known = dirs.select("repo", "path", "depth")
    if include_root:
        known = known.unionByName(parents.select("repo").distinct().selectExpr("repo", "'' AS path", "0 AS depth"))
    else:
        parents = parents.where("path <> ''")
    listed_rows = known.selectExpr("*", "0L AS total_files", "0L AS total_size_bytes")
    parent_rows = parents.selectExpr("repo", "path", "int(NULL) AS depth", "total_files", "total_size_bytes")
    nodes = listed_rows.unionByName(parent_rows).groupBy("repo", "path").agg(
        *exprs(depth="max(depth)", total_files="sum(total_files)", total_size_bytes="sum(total_size_bytes)")
    )
    nodes = shared(nodes)
    direct = nodes.where("depth IS NOT NULL")
    farther = _nearest_above(nodes.where("depth IS NULL"), direct.select("repo", "path", "depth"), include_root)
    return direct.unionByName(farther).groupBy("repo", "path").agg(
        *exprs(depth="max(depth)", total_files="sum(total_files)", total_size_bytes="sum(total_size_bytes)")
    )


def _nearest_above(parents: DataFrame, known: DataFrame, include_root: bool) -> DataFrame:
    """The sums of parents that are not listed, under the deepest listed directory above each.

    Many of them may share one ancestor, so they are spread.
    """
    above = f"slice({paths.ancestors('path')}, 1, size(split(path, '/')) - 1)"
    if include_root:
        above = f"concat(array(''), {above})"
    candidates = parents.selectExpr("repo", "path AS dir", "total_files", "total_size_bytes", f"explode({above}) AS path")
    found = join_hot(candidates, known, ["repo", "path"], ["dir"], ways=8)
    nearest = found.groupBy("repo", "dir").agg(
        *exprs(
            best="max(struct(depth, path))",
            total_files="any_value(total_files)",
            total_size_bytes="any_value(total_size_bytes)",
        )
    )
    settled = nearest.selectExpr("repo", "best.path AS path", "best.depth AS depth", "total_files", "total_size_bytes")
    return settled


# Scans


@dataclass
class ScanLimits:
    max_depth: int | None = None
    max_files: int | None = None
    follow_symlinks: bool = False


@dataclass
class Scan:
    files: DataFrame
    dirs: DataFrame
    errors: DataFrame


SCAN_COLUMNS = ("repo", "seq", "path", "size_bytes", "is_symlink", "is_executable", "last_modified")


def _scan(
    files: DataFrame,
    dirs: DataFrame,
    limits: ScanLimits,
    exclude_dirs: Iterable[str],
    keep_file: str,
    keep_dir: str,
) -> Scan:
    inside = listed(files, exclude_dirs)
    good = inside.where(f"error IS NULL AND {keep_file}")
    found_dirs = listed_dirs(dirs, exclude_dirs).where(keep_dir)
    if limits.max_depth is not None:
        good = good.where(f"{paths.depth()} <= {limits.max_depth}")
        found_dirs = shallow_dirs(found_dirs, limits.max_depth)
    good = good.select(*SCAN_COLUMNS)
    if limits.max_files is not None:
        good = first_n(good, ["repo"], "seq", limits.max_files)
    errors = inside.where("error IS NOT NULL").select("repo", "seq", "path", "error")
    return Scan(good, found_dirs.select("repo", "seq", "path", "depth"), errors)


def scan(
    files: DataFrame, dirs: DataFrame, limits: ScanLimits | None = None, exclude_dirs: Iterable[str] = ()
) -> Scan:
    """Metadata scan: symlinked files are left out unless symlinks are followed."""
    limits = limits or ScanLimits()
    keep = "true" if limits.follow_symlinks else "NOT is_symlink"
    return _scan(files, dirs, limits, exclude_dirs, keep, "true")


def scan_guarded(
    files: DataFrame, dirs: DataFrame, limits: ScanLimits | None = None, exclude_dirs: Iterable[str] = ()
) -> Scan:
    """Scan without unreadable entries, and without symlinks unless they are followed."""
    limits = limits or ScanLimits()
    safe = "readable" if limits.follow_symlinks else "readable AND NOT is_symlink"
    return _scan(files, dirs, limits, exclude_dirs, safe, safe)


def scan_best_effort(
    files: DataFrame, dirs: DataFrame, limits: ScanLimits | None = None, exclude_dirs: Iterable[str] = ()
) -> Scan:
    """Scan that keeps every entry, symlinked files included."""
    return _scan(files, dirs, limits or ScanLimits(), exclude_dirs, "true", "true")


def truncate_errors(errors: DataFrame, max_errors: int) -> DataFrame:
    return first_n(errors, ["repo"], "seq", max_errors)


def enforce_limits(
    result: Scan, max_files: int | None = None, max_directories: int | None = None
) -> Scan:
    """Limits applied after a scan, in scan order."""
    files, dirs = result.files, result.dirs
    if max_files is not None:
        files = first_n(files, ["repo"], "seq", max_files)
    if max_directories is not None:
        dirs = first_n(dirs, ["repo"], "seq", max_directories, ["depth"])
    return Scan(files, dirs, result.errors)


def scan_summary(repos: DataFrame, result: Scan) -> DataFrame:
    """Counts and bytes per repository, zeros included."""
    zeros = ("total_files", "total_directories", "total_size_bytes", "errors_count")
    sums = exprs(total_files="count(*)", total_size_bytes="sum(size_bytes)")
    return per_repo(
        repos,
        result.files.groupBy("repo").agg(*sums),
        result.dirs.groupBy("repo").agg(F.count("*").alias("total_directories")),
        result.errors.groupBy("repo").agg(F.count("*").alias("errors_count")),
        zeros=dict.fromkeys(zeros, 0),
    )


# Counts


def files_per_language(files: DataFrame, exclude_dirs: Iterable[str] = ()) -> DataFrame:
    named = listed(files, exclude_dirs).select("repo", *exprs(language=paths.language()))
    counted = named.where("language IS NOT NULL").groupBy("repo", "language")
    return counted.agg(F.count("*").alias("files"))


def files_per_category(files: DataFrame, exclude_dirs: Iterable[str] = ()) -> DataFrame:
    classified = classify_files(listed(files, exclude_dirs)).select("repo", "category")
    return classified.groupBy("repo", "category").agg(F.count("*").alias("files"))


def depth_histogram(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Entries per depth, directories included."""
    entries = listed(files).select("repo", *exprs(depth=f"int({paths.depth()})"))
    both = entries.unionByName(listed_dirs(dirs).select("repo", "depth"))
    return both.groupBy("repo", "depth").agg(F.count("*").alias("entries"))


def repository_lines(
    repos: DataFrame,
    files: DataFrame,
    exclude_dirs: Iterable[str] = (),
    max_bytes_per_file: int | None = None,
) -> DataFrame:
    sums = ("total_lines", "blank_lines", "non_blank_lines")
    counted = count_file_lines(listed(files, exclude_dirs), max_bytes_per_file)
    totals = counted.groupBy("repo").agg(
        *exprs(**{c: f"sum({c})" for c in sums}, files_counted="count(*)")
    )
    return per_repo(repos, totals, zeros=dict.fromkeys([*sums, "files_counted"], 0))


def directory_size(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of all files outside the standard excluded directories."""
    total = listed(files).groupBy("repo").agg(F.sum("size_bytes").alias("total_size_bytes"))
    return per_repo(repos, total, zeros={"total_size_bytes": 0})


# Fixed value: the sums of lines that a content pass gives.
LINE_SUMS = ("total_lines", "blank_lines", "non_blank_lines")


def summary_counts(files: DataFrame, exclude_dirs: Iterable[str] = (), with_lines: bool = True) -> DataFrame:
    """Counts and sums of the listed files by language, category, depth and extra exclusion.

    One projection looks at each content; what leaves it is a small table from which several reports are folded. The
    table is shared, so a plan that uses more than one of them reads the contents once.
    """
    extra = list(exclude_dirs)
    classified = classify_files(listed(files))
    features = count_file_lines(classified) if with_lines else classified
    keys = exprs(is_excluded=paths.in_excluded_dir("path", extra) if extra else "false", depth=f"int({paths.depth()})")
    sums = {"files": "count(*)", "size_bytes": "sum(size_bytes)"}
    if with_lines:
        sums |= {c: f"sum({c})" for c in LINE_SUMS}
    return shared(features.groupBy("repo", "language", "category", *keys).agg(*exprs(**sums)))


def summary_parts(repos: DataFrame, counts: DataFrame) -> dict[str, DataFrame]:
    """Size, languages, categories and, where they were counted, lines, each folded from the shared counts.

    Extra exclusions do not reach the size.
    """
    kept = counts.where("NOT is_excluded")

    def files_by(key: str) -> DataFrame:
        return kept.where(f"{key} IS NOT NULL").groupBy("repo", key).agg(F.sum("files").alias("files"))

    size = counts.groupBy("repo").agg(F.sum("size_bytes").alias("total_size_bytes"))
    parts = {
        "size": per_repo(repos, size, zeros={"total_size_bytes": 0}),
        "languages": files_by("language"),
        "categories": files_by("category"),
    }
    if "total_lines" in counts.columns:
        sums = {**{c: f"sum({c})" for c in LINE_SUMS}, "files_counted": "sum(files)"}
        parts["lines"] = per_repo(repos, kept.groupBy("repo").agg(*exprs(**sums)), zeros=dict.fromkeys(sums, 0))
    return parts


def depths_of(counts: DataFrame, dirs: DataFrame) -> DataFrame:
    """Entries per depth from the shared counts, directories included."""
    both = counts.select("repo", "depth", F.col("files").alias("n")).unionByName(
        listed_dirs(dirs).selectExpr("repo", "depth", "1L AS n")
    )
    return both.groupBy("repo", "depth").agg(F.sum("n").alias("entries"))


def extension_histogram(files: DataFrame) -> DataFrame:
    named = exprs(extension=f"coalesce(nullif({paths.suffix()}, ''), '<none>')")
    return files.groupBy("repo", *named).agg(F.count("*").alias("files"))


def index_files(files: DataFrame) -> DataFrame:
    return files.select(
        "repo",
        "path",
        *exprs(is_test=paths.is_index_test_path(), is_source=paths.is_index_source_path()),
    )


def index_counts(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Total, test and source files of the plain file index, without exclusions."""
    counts = {
        "total_files": "count(*)",
        "test_files": "count_if(is_test)",
        "source_files": "count_if(is_source)",
    }
    grouped = index_files(files).groupBy("repo").agg(*exprs(**counts))
    return per_repo(repos, grouped, zeros=dict.fromkeys(counts, 0))


def entry_counts(repos: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Files and directories together, per repository."""
    entries = files.select("repo").unionByName(dirs.select("repo"))
    counts = entries.groupBy("repo").agg(F.count("*").alias("file_count"))
    return per_repo(repos, counts, zeros={"file_count": 0})


def directory_names(dirs: DataFrame) -> DataFrame:
    """Distinct directory names per repository, one row each."""
    return dirs.select("repo", *exprs(name=paths.file_name())).distinct()


# Directories whose absence is a finding, with message and severity.
WANTED_DIRECTORIES = {
    "tests": ("No tests directory detected", "medium"),
    ".github": ("No CI configuration detected", "low"),
}


def structure_findings(
    repos: DataFrame, files: DataFrame, dirs: DataFrame, max_entries: int = 100_000
) -> DataFrame:
    """Findings on repository size and on missing test and CI directories."""
    too_many = (
        entry_counts(repos, files, dirs)
        .where(f"file_count > {max_entries}")
        .select(
            "repo",
            *exprs(
                message=f"'Repository contains ' || file_count || ' files (limit: {max_entries})'",
                severity="'high'",
                source="'size_check'",
            ),
        )
    )
    name = paths.file_name()
    present = (
        dirs.where(in_list(name, WANTED_DIRECTORIES))
        .groupBy("repo")
        .agg(F.expr(f"collect_set({name}) AS _names"))
    )
    findings = present_only(
        *[
            f"CASE WHEN NOT array_contains(coalesce(_names, {array_of([])}), {lit(wanted)}) "
            f"THEN struct({lit(message)} AS message, {lit(severity)} AS severity) END"
            for wanted, (message, severity) in WANTED_DIRECTORIES.items()
        ]
    )
    missing = (
        repos.join(present, "repo", "left")
        .selectExpr("repo", f"explode({findings}) AS f")
        .selectExpr("repo", "f.message", "f.severity", "'structure_scan' AS source")
    )
    return too_many.unionByName(missing)


# Orders


def by_size(files: DataFrame, descending: bool = True) -> DataFrame:
    size = F.desc("size_bytes") if descending else F.asc("size_bytes")
    return files.orderBy("repo", size, "seq")


def dirs_by_size(totals: DataFrame, descending: bool = True) -> DataFrame:
    size = F.desc("total_size_bytes") if descending else F.asc("total_size_bytes")
    return totals.orderBy("repo", size, "path")
