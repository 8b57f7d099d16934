"""Checked-out trees as rows of ``files`` and ``dirs``.

Spark's own file sources hide names that start with ``.`` or ``_``, which would lose CI, test and package files, so trees
are walked here, on the executors::

    tree = read_trees(spark, "/data/checkouts")
    files, dirs = files_of(tree), dirs_of(tree)

Every directory directly below ``root`` is one repository (or ``root`` itself with ``layout="single"``). The root must be
mounted on all executors.

1. The directories to list are a table, the frontier. In each round it is dealt out evenly; a task lists a bounded number
   of entries below each of its directories and hands the directories it did not reach to the next round. So rounds follow
   the depth of the tree and the size of its parts, tasks follow the entries, and the driver sees counts only.
2. The names of all rounds are sorted once by range, which numbers them in the order of a walk from the top.
3. The numbered names are dealt out again to be examined and read: one huge directory is spread over all tasks.

An entry that cannot be listed, named or examined becomes a row with an ``error``; nothing ends the scan.
"""

from __future__ import annotations

import os
import stat
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.functions.paths import EXCLUDED_DIRS

# Functions of this module travel to the Python workers by value, so that the workers need no copy
# of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = (
    "repo string, seq bigint, path string, kind string, content binary, size_bytes bigint, "
    "is_symlink boolean, is_executable boolean, last_modified timestamp_ntz, readable boolean, "
    "error string"
)
# A directory to list has a NULL name; ``level`` is 0 for the folder of all repositories.
LISTING = (
    "repo string, base string, level int, dir string, name string, is_dir boolean, to_list boolean, "
    "error string"
)
NUMBERED = "repo string, seq bigint, base string, path string, is_dir boolean, error string"
EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class TreeLimits:
    entries_per_listing: int = 5_000  # below one directory of the frontier, before the rest goes back
    rows_per_task: int = 20_000  # entries that one task examines and reads
    batch_rows: int = 1_000
    batch_bytes: int = 16 << 20  # contents held at once; a larger file is a batch of its own
    content_bytes: int = 1 << 30  # larger files have no content, as a cell holds 2 GB


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_batches(rows: Iterable[tuple], schema: pa.Schema, limits: TreeLimits, size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Arrow batches bounded by rows and by bytes."""
    held, held_bytes = [], 0
    for row in rows:
        more = size(row)
        if held and (len(held) == limits.batch_rows or held_bytes + more > limits.batch_bytes):
            yield _batch(held, schema)
            held, held_bytes = [], 0
        held.append(row)
        held_bytes += more
    if held:
        yield _batch(held, schema)


def _joined(directory: str, name: str) -> str:
    return f"{directory}/{name}" if directory else name


def _shown(raw: bytes) -> tuple[str, str | None]:
    """The name as text, and what is wrong with it."""
    try:
        return raw.decode(), None
    except UnicodeDecodeError:
        shown = raw.decode("utf-8", "backslashreplace")
        return shown, f"name is not UTF-8: {shown}"


def list_directory(repo: str, base: str, level: int, directory: str, excluded: frozenset) -> Iterator[tuple]:
    """Rows of ``LISTING`` for the entries of one directory, and for the directories to list next.

    Names that are not UTF-8 are errors and are not entered, nor are symbolic links and excluded directories.
    """
    try:
        with os.scandir(os.fsencode(os.path.join(base, directory))) as entries:
            for entry in entries:
                name, wrong = _shown(entry.name)
                try:
                    is_dir, enter = entry.is_dir(), entry.is_dir(follow_symlinks=False)
                except OSError:
                    is_dir = enter = False
                if level == 0:  # the folder of all repositories
                    if wrong:
                        yield name, base, 1, "", None, True, False, wrong
                    elif enter:
                        yield name, os.path.join(base, name), 1, "", None, True, True, None
                elif not (is_dir and name in excluded):
                    yield repo, base, level, directory, name, is_dir, False, wrong
                    if enter and not wrong:
                        yield repo, base, level + 1, _joined(directory, name), None, True, True, None
    except OSError as exc:
        yield repo, base, level, directory, None, True, False, f"cannot list {directory or base}: {exc.strerror or exc}"


def expand(repo: str, base: str, level: int, directory: str, excluded: frozenset, limits: TreeLimits) -> Iterator[tuple]:
    """Lists a directory and what lies below it until the limit is reached; the rest stays to be listed."""
    open_dirs, listed = [(repo, base, level, directory)], 0
    while open_dirs and listed < limits.entries_per_listing:
        for row in list_directory(*open_dirs.pop(), excluded):
            listed += 1
            if row[6]:
                open_dirs.append(row[:4])
            else:
                yield row
    for left in open_dirs:
        yield *left, None, True, True, None


def _listed(spark: SparkSession, frontier: DataFrame, folder: str, excluded: frozenset, limits: TreeLimits) -> DataFrame:
    schema = pa.schema([("repo", pa.string()), ("base", pa.string()), ("level", pa.int32()), ("dir", pa.string()), ("name", pa.string()),
                        ("is_dir", pa.bool_()), ("to_list", pa.bool_()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("repo", "base", "level", "dir")), strict=True))
        yield from _in_batches((found for row in wanted for found in expand(*row, excluded, limits)), schema, limits)

    done, number = [], 0
    while True:
        path = f"{folder}/round-{number}"
        ways = _ways(spark)
        # The rows of a round are few and unlike in work, so they are dealt out one by one.
        frontier.repartition(ways).mapInArrow(run, LISTING).write.parquet(path)
        done.append(path)
        frontier = spark.read.schema(LISTING).parquet(path).where("to_list")
        number += 1
        if frontier.isEmpty():
            return spark.read.schema(LISTING).parquet(*done).where("NOT to_list")


def _ways(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _numbered(listing: DataFrame, folder: str, limits: TreeLimits) -> DataFrame:
    """Numbers the entries of each repository as a walk from the top meets them: directories before files, by name.

    ``seq`` counts from the first row of the repository: its place in its range partition plus the rows of earlier ones.
    """
    spark = listing.sparkSession
    # NUL sorts before every character of a name, so a directory comes right before what lies below it.
    keyed = listing.selectExpr(
        "repo", "base", "is_dir", "error",
        "replace(dir, '/', '\\0') AS walk", "coalesce(name, '') AS name",
        "if(name IS NULL, dir, if(dir = '', name, dir || '/' || name)) AS path",
    )
    order = ["repo", "walk", F.desc("is_dir"), "name"]
    ranged = keyed.repartitionByRange(_ways(spark), *order).sortWithinPartitions(*order)
    placed = ranged.selectExpr("repo", "base", "path", "is_dir", "error", "spark_partition_id() AS part", "monotonically_increasing_id() AS place")
    path = f"{folder}/ordered"
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    counts = rows.groupBy("repo", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = "coalesce(sum(n) OVER (PARTITION BY repo ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    offsets = counts.selectExpr("repo", "part", f"bigint({earlier}) - first + 1 AS shift")
    return rows.join(offsets, ["repo", "part"]).selectExpr("repo", "place + shift AS seq", "base", "path", "is_dir", "error")


def _content(full: bytes) -> bytes | None:
    try:
        with open(full, "rb") as handle:
            return handle.read()
    except OSError:
        return None


def entry_row(repo: str, seq: int, base: str, path: str, limits: TreeLimits, with_content: bool = True) -> tuple:
    """The row of ``SCHEMA`` of one entry. Size, mode and time are those of a link's target; a broken link is no file."""
    full = os.fsencode(os.path.join(base, path))
    link = os.path.islink(full)
    try:
        info = os.stat(full)
        is_dir = stat.S_ISDIR(info.st_mode)
        if not is_dir and not stat.S_ISREG(info.st_mode):
            return repo, seq, path, "other", None, 0, link, False, None, False, None
        modified = EPOCH + timedelta(seconds=info.st_mtime_ns // 1_000_000_000, microseconds=info.st_mtime_ns // 1000 % 1_000_000)
    except OSError as exc:
        kind, error = ("other", None) if link else ("file", f"cannot stat {path}: {exc.strerror or exc}")
        return repo, seq, path, kind, None, 0, link, False, None, False, error
    except OverflowError:
        return repo, seq, path, "file", None, 0, link, False, None, False, f"modification time of {path} is out of range"
    readable = os.access(full, os.R_OK | os.X_OK if is_dir else os.R_OK)
    content = _content(full) if with_content and readable and not is_dir and info.st_size <= limits.content_bytes else None
    size = 0 if is_dir else info.st_size
    return repo, seq, path, "dir" if is_dir else "file", content, size, link, bool(info.st_mode & stat.S_IXUSR), modified, readable, None


def _examined(numbered: DataFrame, tasks: int, limits: TreeLimits, with_content: bool) -> DataFrame:
    schema = pa.schema([("repo", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("content", pa.binary()),
                        ("size_bytes", pa.int64()), ("is_symlink", pa.bool_()), ("is_executable", pa.bool_()), ("last_modified", pa.timestamp("us")),
                        ("readable", pa.bool_()), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("repo", "seq", "base", "path", "error"))
            for repo, seq, base, path, error in zip(*columns, strict=True):
                if error is not None:
                    yield repo, seq, path, "file", None, 0, False, False, None, False, error
                else:
                    yield entry_row(repo, seq, base, path, limits, with_content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(rows(batches), schema, limits, lambda row: len(row[4] or b""))

    return numbered.repartition(tasks).mapInArrow(run, SCHEMA)


def work_folder(spark: SparkSession, work_dir: str | None) -> str:
    folder = work_dir or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("name a folder that all executors share: work_dir, or the setting spark.checkpoint.dir")
    return f"{folder.rstrip('/')}/trees-{uuid.uuid4().hex}"


def read_trees(
    spark: SparkSession,
    root: str,
    layout: str = "fleet",
    exclude: Iterable[str] = (),
    prune: bool = True,
    content: bool = True,
    work_dir: str | None = None,
    limits: TreeLimits = TreeLimits(),
) -> DataFrame:
    """All entries below ``root`` as rows of ``SCHEMA``.

    ``exclude`` names directories to prune besides the standard ones, ``prune=False`` reads excluded directories too,
    ``content=False`` leaves file contents out. Names are listed at once and kept as Parquet below ``work_dir``
    (default: ``spark.checkpoint.dir``); entries are examined and read when the result is. Write it as Parquet once.
    """
    if layout not in ("fleet", "single"):
        raise ValueError(f"unknown layout: {layout}")
    folder = work_folder(spark, work_dir)
    excluded = frozenset({*EXCLUDED_DIRS, *exclude} if prune else ())
    root = os.path.normpath(root)
    start = ("", root, 0, "") if layout == "fleet" else (os.path.basename(root), root, 1, "")
    frontier = spark.createDataFrame([start], "repo string, base string, level int, dir string")
    listing = _listed(spark, frontier, folder, excluded, limits)
    tasks = max(_ways(spark), -(-listing.count() // limits.rows_per_task))
    return _examined(_numbered(listing, folder, limits), tasks, limits, content)


def files_of(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("kind") == "file").drop("kind")


def dirs_of(tree: DataFrame) -> DataFrame:
    depth = F.size(F.split("path", "/"))
    return tree.where(F.col("kind") == "dir").select(
        "repo", "seq", "path", depth.alias("depth"), "is_symlink", "readable"
    )
