from __future__ import annotations

import os
import random
from datetime import datetime
from pathlib import Path

import pytest

from forgelens import tables
from forgelens.operators import analyzers as an
from forgelens.operators import files as f
from forgelens.operators import loc
from forgelens.plans import file_reports as reports
from forgelens.sources import ignore_rules
from forgelens.sources.json_sink import as_json, write_json
from forgelens.sources.repo_tree import TreeLimits, dirs_of, entry_row, files_of, list_directory, read_trees


@pytest.fixture
def files(spark):
    def build(*entries, repo="r"):
        """Entries are (path, text or bytes) or (path, text, overrides)."""
        data = []
        for i, entry in enumerate(entries, 1):
            path, body, *rest = entry
            more = {"repo": repo, **(rest[0] if rest else {})}
            content = body.encode() if isinstance(body, str) else body
            data.append(
                (more["repo"], i, path, content, len(content or b""), more.get("link", False), more.get("exe", False),
                 datetime(2024, 1, 1), more.get("readable", True), more.get("error"))
            )
        return spark.createDataFrame(data, tables.FILES)

    return build


@pytest.fixture
def tree(files):
    return files(
        ("README.md", "# Title\n"), ("src/main.py", "print(1)\n"), ("src/deep/util.py", "x = 1\n\n# note\n"),
        ("tests/test_main.py", "def test():\n    pass\n"),
    )


@pytest.fixture
def repos(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], tables.REPOS)


def one(df):
    return df.head().asDict()


def test_directories_and_totals(tree, rows):
    dirs = f.derive_dirs(tree)
    assert rows(dirs, "path", "depth") == [("src", 1), ("src/deep", 2), ("tests", 1)]
    totals = rows(f.directory_totals(tree, dirs), "path", "total_files", "total_size_bytes")
    assert totals == [("src", 1, 9), ("src/deep", 1, 14), ("tests", 1, 21)]
    with_root = f.directory_totals(tree, dirs, include_root=True)
    assert ("", 1, 8) in rows(with_root, "path", "total_files", "total_size_bytes")


def test_nearest_listed_directory(tree, rows):
    top = f.shallow_dirs(f.derive_dirs(tree), 1)
    assert rows(f.directory_totals(tree, top), "path", "total_files") == [("src", 2), ("tests", 1)]


def test_directory_totals_against_brute_force(files, rows):
    rng = random.Random(11)
    entries = []
    for i in range(400):
        parts = [rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 3, 4]))]
        entries.append(("/".join([*parts, f"f{i}"]), "x" * rng.randrange(9), {"repo": rng.choice(["hot", "hot", "s"])}))
    frame = files(*entries)
    listed = f.derive_dirs(frame).where("hash(path) % 3 <> 0")
    known = {(r.repo, r.path): [0, 0] for r in listed.collect()}
    for path, body, more in entries:
        parent = path.rpartition("/")[0]
        while parent and (more["repo"], parent) not in known:
            parent = parent.rpartition("/")[0]
        if parent:
            known[(more["repo"], parent)][0] += 1
            known[(more["repo"], parent)][1] += len(body)
    found = f.directory_totals(frame, listed).collect()
    assert {(r.repo, r.path): [r.total_files, r.total_size_bytes] for r in found} == known
    whole = f.directory_totals(frame, listed, include_root=True).collect()
    sums = {(r.repo, r.path): [r.total_files, r.total_size_bytes, r.depth] for r in whole}
    for repo in ("hot", "s"):
        own = [(path, body) for path, body, more in entries if more["repo"] == repo]
        settled = [v for (r, _), v in known.items() if r == repo]
        assert sums.pop((repo, "")) == [len(own) - sum(n for n, _ in settled), sum(len(b) for _, b in own) - sum(b for _, b in settled), 0]
    assert {k: v[:2] for k, v in sums.items()} == known


def test_directory_totals_read_the_files_twice_at_most(spark, tmp_path, files):
    files(("a/b/c", "x"), ("a/d", "y")).write.parquet(str(tmp_path / "files"))
    t = spark.read.parquet(str(tmp_path / "files"))
    totals = f.directory_totals(t, f.derive_dirs(t))
    totals.collect()
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet") <= 2


def test_scan_limits_and_symlinks(files, rows):
    t = files(("real.txt", "a"), ("link.txt", "a", {"link": True}), ("d/deep.txt", "b"), ("z.txt", "c"), ("bad", None, {"error": "denied"}))
    dirs = f.derive_dirs(t)
    assert rows(f.scan(t, dirs).files, "path") == [("d/deep.txt",), ("real.txt",), ("z.txt",)]
    follow = f.ScanLimits(follow_symlinks=True, max_depth=1)
    assert rows(f.scan(t, dirs, follow).files, "path") == [("link.txt",), ("real.txt",), ("z.txt",)]
    assert rows(f.scan(t, dirs, f.ScanLimits(max_files=2)).files, "path") == [("d/deep.txt",), ("real.txt",)]
    assert rows(f.scan_best_effort(t, dirs).files, "path") == [("d/deep.txt",), ("link.txt",), ("real.txt",), ("z.txt",)]
    assert rows(f.scan(t, dirs, f.ScanLimits(max_depth=0)).dirs) == []
    assert rows(f.scan(t, dirs).errors, "path", "error") == [("bad", "denied")]


def test_guarded_scan_drops_unreadable_entries(files, rows):
    t = files(("a", "1"), ("b", "2", {"readable": False}), ("c", "3", {"link": True}))
    dirs = f.derive_dirs(t)
    assert rows(f.scan_guarded(t, dirs).files, "path") == [("a",)]
    assert rows(f.scan_guarded(t, dirs, f.ScanLimits(follow_symlinks=True)).files, "path") == [("a",), ("c",)]


def test_errors_are_cut(files):
    t = files(*[(f"f{i}", None, {"error": f"error {i}"}) for i in range(200)])
    assert f.truncate_errors(f.scan(t, f.derive_dirs(t)).errors, 25).count() == 25


def test_empty_tree(files, repos):
    t = files()
    dirs, r = f.derive_dirs(t), repos("empty")
    assert one(f.scan_summary(r, f.scan(t, dirs))) == {
        "repo": "empty", "total_files": 0, "total_size_bytes": 0, "total_directories": 0, "errors_count": 0
    }
    assert one(f.repository_lines(r, t))["files_counted"] == 0
    assert one(f.directory_size(r, t))["total_size_bytes"] == 0
    assert one(f.index_counts(r, t))["total_files"] == 0
    summary = one(loc.loc_report(r, t)["summary"])
    assert summary["files"] == 0 and summary["median_total_lines"] is None
    found = {x.name: x.score for x in an.analyze(an.Tables(r, t)).collect()}
    assert found == {"ci": 0.0, "loc": 0.0, "complexity": 1.0, "tests": 0.0, "documentation": 0.0, "dependencies": 0.0}


def test_line_kinds(files, rows):
    t = files(
        ("a.py", "# c\n\nx = 1  # y\n  # d\n"), ("b.js", "// c\n/* d */\n"), ("c.go", "// not counted\n"),
        ("build/d.py", "x\n"), ("e.PY", "#\n"), ("bin.java", b"\x00//\n//x"),
    )
    assert rows(f.line_kinds(t), "path", "total_lines", "code_lines", "blank_lines", "comment_lines") == [
        ("a.py", 4, 1, 1, 2), ("b.js", 2, 1, 0, 1), ("bin.java", 2, 1, 0, 1), ("e.PY", 1, 0, 0, 1),
    ]


def test_loc_statistics_average_the_middle_two(files, repos):
    t = files(*[(f"f{n}.py", "x\n" * n) for n in (1, 2, 3, 4)])
    summary = one(loc.loc_report(repos("r"), t)["summary"])
    assert (summary["files"], summary["total_lines"], summary["mean_total_lines"]) == (4, 10, 2.5)
    assert (summary["median_total_lines"], summary["median_code_lines"]) == (2.5, 2.5)


def test_branch_tokens_are_substrings(files, rows):
    t = files(("a.py", "elif x: if y\nfor for \nexcept E\n"), ("b.txt", "if "))
    assert rows(f.branch_tokens(t), "path", "tokens") == [("a.py", 5)]


def test_binary_files_count_without_lines(files, repos):
    t = files(("a.bin", b"\x00\n\n"), ("b.py", "x\n"))
    found = one(f.repository_lines(repos("r"), t))
    assert (found["total_lines"], found["files_counted"]) == (1, 2)


def test_analyzers(files, repos):
    t = files(
        ("README.md", "line\n" * 150), ("requirements.txt", "a\nb\n"), (".github/workflows/ci.yml", "on: push\n"),
        ("tests/test_a.py", "if x:\n    pass\n"), ("src/a.py", "# c\nx = 1\n\n"), ("Jenkinsfile", ""),
    )
    found = {(x.name, i): x for i, x in enumerate(an.analyze(an.Tables(repos("r"), t)).collect())}
    by_name = {name: x for (name, _), x in found.items() if name != "loc"}
    assert by_name["documentation"].score == 0.5
    assert by_name["documentation"].details == '{"README.md":150}'
    assert by_name["dependencies"].score == 0.01
    assert by_name["ci"].details == '{"ci_files":[".github/workflows","Jenkinsfile"]}'
    assert by_name["tests"].details == '{"test_files":1,"source_files":1,"ratio":1.0}'
    assert by_name["complexity"].score == 1 - 1 / 5000
    locs = sorted(x.details for (name, _), x in found.items() if name == "loc")
    assert '{"files":2,"lines":5,"code_lines":4,"blank_lines":1}' in locs


def test_own_analyzer(files, repos, monkeypatch):
    monkeypatch.setitem(
        an.CUSTOM, "size", lambda t: t.repos.selectExpr("repo", "'size' AS name", "0.5D AS score", "'{}' AS details")
    )
    found = an.analyze(an.Tables(repos("r"), files(("a.py", "x\n"))), ["size", "tests"])
    assert {x.name for x in found.collect()} == {"size", "tests"}


def test_ignore_rules(spark, files, rows):
    lines = spark.createDataFrame([("r", x) for x in ("node_modules", "*.log", "docs*", "# c", "  ", "*", " a* ", "*b*")], "repo string, line string")
    rules = ignore_rules.parse_ignore_lines(lines)
    assert rows(rules, "kind", "pattern") == [
        ("contains", "*"), ("contains", "node_modules"), ("prefix", "a"), ("prefix", "docs"), ("suffix", ".log"), ("suffix", "b*")
    ]
    kept = f.drop_ignored(
        files(("node_modules/x.js", ""), ("error.log", ""), ("main.py", ""), ("docs/x", ""), ("x/docs", ""), ("a.py", "")).select("repo", "path"), rules
    )
    assert rows(kept, "path") == [("main.py",), ("x/docs",)]


def test_ignore_rules_against_brute_force(spark, files, rows):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab/é.") for _ in range(n))
    entries = [(f"{word(rng.randint(0, 9))}{i}", "", {"repo": rng.choice(["hot", "hot", "s", "free"])}) for i in range(300)]
    rules = [(rng.choice(["hot", "s"]), rng.choice(["prefix", "suffix", "contains"]), word(rng.randint(0, 4)) or "3") for _ in range(25)]
    rules += [("s", "contains", ""), ("none", "contains", "a"), ("hot", "prefix", None)]

    def ignored(path, repo):
        tests = {"prefix": path.startswith, "suffix": path.endswith, "contains": path.__contains__}
        return any(r == repo and p is not None and tests[kind](p) for r, kind, p in rules)

    kept = f.drop_ignored(files(*entries).select("repo", "path"), spark.createDataFrame(rules, "repo string, kind string, pattern string"))
    assert rows(kept, "path") == sorted([(p,) for p, _, more in entries if not ignored(p, more["repo"])], key=repr)


def test_ignore_rules_are_looked_up_by_equality(spark, files):
    rules = spark.createDataFrame([("r", "contains", "a")], "repo string, kind string, pattern string")
    plan = f.drop_ignored(files(("a", "")).select("repo", "path"), rules)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_derived_directories_keep_their_order_at_any_depth(files, rows):
    deep = "/".join(["d"] * 5_000)
    t = files((f"{deep}/x", ""), ("a/y", ""))
    dirs = f.derive_dirs(t)
    assert dirs.selectExpr("count(*)", "count(DISTINCT seq, depth)").head() == (5_001, 5_001)
    cut = f.enforce_limits(f.scan_best_effort(t, dirs), max_directories=4_999)
    assert cut.dirs.selectExpr("max(depth)", "count(*)").head() == (4_999, 4_999)


def test_standard_ignore_files_are_root_only(files, rows):
    t = files((".gitignore", "*.log\r\nbuild\n"), ("sub/.gitignore", "never\n"), (".ignore", "x*"))
    assert rows(ignore_rules.standard_ignore_rules(t), "kind", "pattern") == [("contains", "build"), ("prefix", "x"), ("suffix", ".log")]


def test_inventory(files, rows):
    t = files((".gitignore", "*.log\n"), ("a.log", "x"), ("src/a.py", "x\n"), ("venv/b.py", "y"))
    found = reports.file_inventory(t, ignore_rules.standard_ignore_rules(t), include_hashes=True)
    assert rows(found, "path", "size", "category", "language") == [(".gitignore", 6, "config", None), ("src/a.py", 2, "source", "python")]


def test_structure_findings(files, repos, rows):
    t = files(("src/a.py", ""), ("b", ""), (".github/x.yml", ""))
    found = f.structure_findings(repos("r", "none"), t, f.derive_dirs(t), max_entries=4)
    assert rows(found, "repo", "severity", "message") == [
        ("none", "low", "No CI configuration detected"), ("none", "medium", "No tests directory detected"),
        ("r", "high", "Repository contains 5 files (limit: 4)"), ("r", "medium", "No tests directory detected"),
    ]


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([("r", 2, None)], "repo string, b int, a string")
    assert as_json(df).head().report == '{"a":null,"b":2,"repo":"r"}'
    target = str(tmp_path / "out")
    write_json(df, target)
    assert spark.read.text(target).head().value == '{"a":null,"b":2,"repo":"r"}'


def make_tree(root: Path) -> None:
    for path, body in {
        "one/README.md": b"# t\n", "one/pkg/__init__.py": b"", "one/.gitignore": b"*.log\n", "one/.github/workflows/ci.yml": b"on\n",
        "one/__tests__/x.js": b"//\n", "one/node_modules/m/i.js": b"x", "one/pkg/deep/a.bin": b"\x00\x01", "two/only.txt": b"\xff",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    (root / "one/pkg/empty").mkdir()
    (root / "one/run.sh").write_bytes(b"#!")
    os.chmod(root / "one/run.sh", 0o755)
    os.symlink(root / "one/README.md", root / "one/link.md")
    os.symlink(root / "one/pkg", root / "one/linked")
    os.symlink(root / "nowhere", root / "one/broken")


WALK = ["README.md", "pkg/__init__.py", ".gitignore", ".github/workflows/ci.yml", "__tests__/x.js", "pkg/deep/a.bin", "run.sh", "link.md"]
SMALL_STEPS = TreeLimits(entries_per_listing=1, rows_per_task=2, batch_rows=2, batch_bytes=3)


@pytest.fixture
def trees(spark, tmp_path_factory):
    """A tree reader that stages into a folder of its own."""

    def read(root, **options):
        return read_trees(spark, str(root), work_dir=f"file://{tmp_path_factory.mktemp('work')}", **options)

    return read


@pytest.mark.parametrize("limits", [TreeLimits(), SMALL_STEPS])
def test_tree_source(trees, tmp_path, rows, limits):
    make_tree(tmp_path)
    tree = trees(tmp_path, limits=limits)
    found = files_of(tree)
    assert rows(found.where("repo = 'one'"), "path") == sorted([(p,) for p in WALK], key=repr)
    assert rows(found.where("is_symlink"), "path") == [("link.md",)]
    assert rows(found.where("is_executable"), "path") == [("run.sh",)]
    assert bytes(found.where("repo = 'two'").head().content) == b"\xff"
    dirs = dirs_of(tree)
    assert rows(dirs, "repo", "path", "depth") == [
        ("one", ".github", 1), ("one", ".github/workflows", 2), ("one", "__tests__", 1), ("one", "linked", 1),
        ("one", "pkg", 1), ("one", "pkg/deep", 2), ("one", "pkg/empty", 2),
    ]
    unpruned = files_of(trees(tmp_path / "one", layout="single", prune=False, content=False, limits=limits))
    assert ("node_modules/m/i.js",) in rows(unpruned, "path")
    assert unpruned.where("content IS NOT NULL").count() == 0
    assert {r.repo for r in unpruned.collect()} == {"one"}


def walked(root):
    """Entries as a walk from the top meets them, directories first, by name."""
    out = []

    def visit(directory):
        names = os.listdir(root / directory)
        is_dir = {n: (root / directory / n).is_dir() for n in names}
        own = sorted(names, key=lambda n: (not is_dir[n], n))
        own = [n for n in own if not (is_dir[n] and n in ("node_modules", ".git"))]
        out.extend(os.path.join(directory, n) for n in own)
        for n in own:
            if is_dir[n] and not (root / directory / n).is_symlink():
                visit(os.path.join(directory, n))

    visit("")
    return out


@pytest.mark.parametrize("limits", [TreeLimits(), SMALL_STEPS])
def test_entries_are_numbered_in_the_order_of_the_walk(trees, tmp_path, limits):
    rng = random.Random(8)
    for _ in range(150):
        parts = [rng.choice(["a", "a-b", "a.b", "b", "c c", "é"]) for _ in range(rng.randint(0, 5))]
        (tmp_path / "r" / "/".join(parts)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / "/".join(parts) / f"f{rng.randint(0, 9)}").write_bytes(b"x" * rng.randint(0, 9))
    tree = trees(tmp_path, limits=limits)
    found = sorted((r.seq, r.path) for r in tree.collect())
    assert [p for _, p in found] == walked(tmp_path / "r")
    assert [s for s, _ in found] == list(range(1, len(found) + 1))


def test_partitions_do_not_follow_the_number_of_repositories(spark, trees, tmp_path):
    for k in range(60):
        (tmp_path / f"repo{k}" / "src").mkdir(parents=True)
        (tmp_path / f"repo{k}" / "src" / "a.py").write_bytes(b"a")
    tree = trees(tmp_path)
    assert files_of(tree).count() == 60 and dirs_of(tree).count() == 60
    assert tree.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_one_huge_directory_is_spread(trees, tmp_path):
    (tmp_path / "r" / "huge").mkdir(parents=True)
    for k in range(1_500):
        (tmp_path / "r" / "huge" / f"f{k}").write_bytes(b"z")
    tree = trees(tmp_path, limits=TreeLimits(rows_per_task=100))
    tasks = [n for n in tree.rdd.glom().map(len).collect() if n]
    assert sum(tasks) == 1_501 and len(tasks) == 16 and max(tasks) < 200


def test_bad_entries_are_errors(trees, tmp_path, rows):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "good.py").write_bytes(b"1")
    os.mkdir(os.fsencode(tmp_path) + b"/r/bad\xffdir")
    with open(os.fsencode(tmp_path) + b"/r/bad\xff.py", "wb") as handle:
        handle.write(b"2")
    os.mkdir(os.fsencode(tmp_path) + b"/repo\xfe")
    found = files_of(trees(tmp_path, limits=SMALL_STEPS))
    assert rows(found.where("error IS NULL"), "repo", "path") == [("r", "good.py")]
    assert rows(found.where("error IS NOT NULL"), "repo", "path", "error") == [
        ("r", "bad\\xff.py", "name is not UTF-8: bad\\xff.py"), ("r", "bad\\xffdir", "name is not UTF-8: bad\\xffdir"),
        ("repo\\xfe", "", "name is not UTF-8: repo\\xfe"),
    ]
    result = f.scan(found, f.derive_dirs(found.where("error IS NULL")))
    assert result.files.count() == 1 and result.errors.count() == 3


def test_roots_that_cannot_be_listed_are_errors(trees, tmp_path, monkeypatch):
    missing = files_of(trees(tmp_path / "nowhere")).collect()
    assert [(r.repo, r.path, r.error is not None) for r in missing] == [("", "", True)]
    single = files_of(trees(tmp_path / "nowhere", layout="single")).collect()
    assert [(r.repo, r.path, "cannot list" in r.error) for r in single] == [("nowhere", "", True)]

    def denied(path):
        raise PermissionError(13, "Permission denied")

    monkeypatch.setattr(os, "scandir", denied)
    assert [r[4:] for r in list_directory("r", "/x", 1, "sub", frozenset())] == [(None, True, False, "cannot list sub: Permission denied")]


def test_times_out_of_range_and_vanished_files_are_errors(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"abc")
    assert entry_row("r", 1, str(tmp_path), "a", TreeLimits())[4] == b"abc"
    assert entry_row("r", 1, str(tmp_path), "a", TreeLimits(content_bytes=2))[4:6] == (None, 3)
    assert "cannot stat gone" in entry_row("r", 1, str(tmp_path), "gone", TreeLimits())[-1]
    real = os.stat

    class Late:
        def __init__(self, info):
            self.st_mode, self.st_size, self.st_mtime_ns = info.st_mode, info.st_size, 10**21

    monkeypatch.setattr(os, "stat", lambda path, **more: Late(real(path, **more)))
    assert entry_row("r", 1, str(tmp_path), "a", TreeLimits())[-1] == "modification time of a is out of range"


def test_tree_needs_a_shared_folder(spark, tmp_path):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="all executors share"):
            read_trees(spark, str(tmp_path))


def test_detailed_scan_report(trees, tmp_path, rows):
    make_tree(tmp_path)
    tree = trees(tmp_path)
    repos = tables.repos_of(files_of(tree))
    report = reports.detailed_scan_report(repos, files_of(tree), dirs_of(tree))
    found = {r.repo: r for r in report["summary"].collect()}
    assert (found["one"].total_files, found["one"].total_directories) == (7, 6)
    quick = {r.repo: r for r in reports.quick_scan_report(repos, files_of(tree), dirs_of(tree)).collect()}
    assert (quick["one"].total_files, quick["one"].total_directories) == (8, 7)


def test_detailed_report_counts_all_errors(files, repos):
    t = files(*[(f"f{i}", None, {"error": f"error {i}"}) for i in range(150)])
    report = reports.detailed_scan_report(repos("r"), t, f.derive_dirs(t), max_errors=100)
    assert report["errors"].count() == 100
    assert one(report["summary"])["errors_count"] == 150
    whole = reports.detailed_scan_report(repos("r"), t, f.derive_dirs(t))
    assert whole["errors"].count() == 150


def test_repository_summary_reads_contents_once(spark, tmp_path, files, repos, rows):
    entries = [("src/a.py", "x\n\n"), ("docs/b.md", "t\n"), ("node_modules/c.js", "y"), ("bin", b"\x00")]
    files(*entries).write.parquet(str(tmp_path / "files"))
    t = spark.read.parquet(str(tmp_path / "files"))
    parts = reports.repository_summary(repos("r", "none"), t, f.derive_dirs(t), exclude_dirs=["docs"])
    assert rows(parts["size"]) == [("none", 0), ("r", 6)]
    assert rows(parts["languages"]) == [("r", "python", 1)]
    assert rows(parts["categories"]) == [("r", "binary", 1), ("r", "source", 1)]
    assert rows(parts["lines"]) == [("none", 0, 0, 0, 0), ("r", 2, 1, 1, 2)]
    assert rows(parts["depths"]) == [("r", 1, 3), ("r", 2, 2)]
    expected = f.depth_histogram(t, f.derive_dirs(t))
    assert rows(parts["depths"]) == rows(expected) and rows(parts["lines"]) == rows(f.repository_lines(repos("r", "none"), t, ["docs"]))
    both = parts["size"].selectExpr("repo", "total_size_bytes AS n").unionByName(parts["categories"].selectExpr("repo", "files AS n"))
    both = both.unionByName(parts["lines"].selectExpr("repo", "total_lines AS n")).unionByName(parts["languages"].selectExpr("repo", "files AS n"))
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("content" in line for line in plan.splitlines() if "FileScan" in line) == 1
    quick = reports.quick_repository_summary(repos("r"), t)
    assert sorted(quick) == ["categories", "languages", "size"] and rows(quick["size"]) == [("r", 6)]


def test_engine_summary(tree, repos, rows):
    parts = reports.engine_summary(repos("r"), tree, f.derive_dirs(tree), max_entries=3)
    assert rows(parts["entries"]) == [("r", 7)]
    assert rows(parts["directories"]) == [("r", "deep"), ("r", "src"), ("r", "tests")]
    assert rows(parts["extensions"]) == [("r", ".md", 1), ("r", ".py", 3)]
    assert rows(parts["findings"], "severity") == [("high",), ("low",)]


def test_metrics_carry_raw_scans_on_request(spark, tree, repos):
    from forgelens.plans.metrics_reports import metrics_with_raw

    commits = spark.createDataFrame([("r", 1, "h", "n", "e", datetime(2024, 1, 1), "add a file")], tables.COMMITS)
    changes = spark.createDataFrame([("r", "h", 1, "a", 1, 0)], tables.COMMIT_FILES)
    arguments = (repos("r"), tree, f.derive_dirs(tree), commits, changes, datetime(2024, 2, 1))
    assert list(metrics_with_raw(*arguments)) == ["metrics"]
    found = metrics_with_raw(*arguments, include_raw=True)
    assert one(found["metrics"])["total_commits"] == 1
    assert one(found["filesystem_quick"])["total_files"] == 4
    assert found["filesystem_detailed_files"].count() == 4 and found["filesystem_detailed_errors"].count() == 0
