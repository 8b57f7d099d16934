from __future__ import annotations

import random

import pytest

from forgelens import tables
from forgelens.operators import conflicts as cf
from forgelens.operators import dependencies as d
from forgelens.operators import graph as g
from forgelens.plans import dependency_reports as reports
from forgelens.sources import manifests as m


@pytest.fixture
def manifests(spark):
    def build(*entries, repo="r"):
        data = [
            (repo, path, b.encode() if isinstance(b, str) else b, None) for path, b in entries
        ]
        return spark.createDataFrame(data, "repo string, path string, content binary, error string")

    return build


@pytest.fixture
def occurrences(spark):
    return lambda *rows_: spark.createDataFrame(list(rows_), tables.OCCURRENCES)


@pytest.fixture
def repos(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], tables.REPOS)


def parsed(manifests_frame):
    return m.parse_manifests(m.discover_manifests(manifests_frame))


def entries(files):
    found = m.occurrences_of(parsed(files)).orderBy("file_seq", "entry_seq").collect()
    return [(r.name, r.version, r.source, r.dep_type) for r in found]


def failed(files):
    return {r.file_name: r.failed for r in parsed(files).collect()}


def test_small_repository(manifests, repos):
    files = manifests(
        ("requirements.txt", "requests==2.31.0\nflask==0.12.0\n"),
        ("package.json", '{"dependencies": {"react": "^18.0.0"}, "devDependencies": {"jest": "^29.0.0"}}'),
    )
    report = reports.repository_dependency_report(repos("r", "none"), files)
    found = {r.repo: r for r in report["summary"].collect()}
    assert (found["r"].total, found["r"].vulnerable, found["r"].outdated, found["r"].sources) == (4, 1, 1, 2)
    assert found["r"].health_score == 0.75
    assert found["r"].sources_detected == ["javascript", "python"]
    assert (found["none"].total, found["none"].health_score) == (0, 1.0)
    assert found["none"].recommendations == ["No major dependency issues detected"]
    licenses = {r.name: r.license for r in report["dependencies"].collect()}
    assert licenses == {"requests": "Unknown", "flask": "BSD", "react": "MIT", "jest": "Unknown"}


def test_comments_and_blanks(manifests):
    assert entries(manifests(("requirements.txt", "  # c\n\n requests==2.31.0 \r\nflask>=1.0\n-r other.txt\n"))) == [
        ("requests", "2.31.0", "python", "runtime"), ("flask", "1.0", "python", "runtime"), ("-r other.txt", None, "python", "runtime"),
    ]


def test_setup_cfg_over_matches(manifests):
    assert entries(manifests(("setup.cfg", "[metadata]\nname = x\n  [opt=1]\ninstall>=2.0\nplain\n"))) == [
        ("name", "x", "python", "runtime"), ("install>", "2.0", "python", "runtime"),
    ]


def test_package_json_sections_and_values(manifests):
    text = """{"dependencies": {"a": "1", "n": null, "f": false, "e": "", "a": "2"}, "peerDependencies": {"a": ">=3"},
              "optionalDependencies": {"fsevents": "^2.3.2"}, "name": {"x": [1]}}"""
    files = manifests(("package.json", text))
    assert entries(files) == [
        ("a", "1", "javascript", "runtime"), ("n", None, "javascript", "runtime"), ("f", None, "javascript", "runtime"),
        ("e", None, "javascript", "runtime"), ("a", "2", "javascript", "runtime"), ("a", "3", "javascript", "peer"),
        ("fsevents", "2.3.2", "javascript", "optional"),
    ]
    merged = d.entries_per_manifest(m.occurrences_of(parsed(files))).where("name = 'a'").collect()
    assert [(r.entry_seq, r.version, r.dep_type) for r in merged] == [(0, "3", "peer")]


@pytest.mark.parametrize(
    ("text", "is_failed"),
    [
        ("{}", False), ("{bad", True), ("[]", True), ("null", True), ("", True), ('{"dependencies": null}', True),
        ('{"dependencies": [1]}', True), ('{"dependencies": {"a": 1}}', True), ('{"dependencies": {"a": 0}}', False),
        ('{"dependencies": {"a": {"v": "1"}}}', True), ('{"dependencies": {"a": {}}}', False), ('{"require": {"a": 1}}', False),
        ('{"dependencies": {"a": "{x}"}}', False), (b"{\xff}", True), ('{"dependencies": {}}', False),
    ],
)
def test_package_json_failures(manifests, text, is_failed):
    assert failed(manifests(("package.json", text))) == {"package.json": is_failed}


def test_go_mod(manifests):
    text = "module m\nrequire a v0.1.0\n// require no v1\nrequire (\n\tb v1.2 // indirect\n\tc v2\n)\nrequire (\n d v3\n)\nreplace x => y v1\n"
    assert sorted(entries(manifests(("go.mod", text)))) == [
        ("a", "v0.1.0", "go", "runtime"), ("b", "v1.2", "go", "runtime"), ("c", "v2", "go", "runtime"), ("d", "v3", "go", "runtime"),
    ]


def test_toml_manifests(manifests):
    cargo = '[dependencies]\na = "1.0"\nb = { version = "0.2", features = ["x"] }\nc = { path = ".." }\n[dev-dependencies]\nz = "1"\n'
    tables_form = '[project.dependencies]\nx = ">=1"\n[project.optional-dependencies]\ny = "2"\n'
    lists_form = '[project]\ndependencies = ["x>=1", "w"]\n[project.optional-dependencies]\nt = ["y==2"]\n'
    assert entries(manifests(("Cargo.toml", cargo))) == [("a", "1.0", "rust", "runtime"), ("b", "0.2", "rust", "runtime"), ("c", None, "rust", "runtime")]
    assert entries(manifests(("pyproject.toml", tables_form))) == [("x", "1", "python", "runtime"), ("y", "2", "python", "optional")]
    assert entries(manifests(("pyproject.toml", lists_form))) == [
        ("x", "1", "python", "runtime"), ("w", None, "python", "runtime"), ("y", "2", "python", "optional"),
    ]
    assert failed(manifests(("Cargo.toml", "[dependencies\n"), ("pyproject.toml", "[project]\nname='x'\n"))) == {
        "Cargo.toml": True, "pyproject.toml": False,
    }


def test_unparsed_manifests_count_as_sources(manifests, rows):
    files = manifests(("a/Gemfile", b"\xff"), ("pom.xml", "<x/>"), ("Cargo.toml", "["), ("x.py", ""), ("composer.json", '{"require": {"php": ">=8"}}'))
    assert rows(m.detected_sources(parsed(files))) == [("r", ["jvm", "php", "ruby"])]
    assert entries(files) == [("php", "8", "php", "runtime")]


def test_file_order_is_depth_then_path(manifests, rows):
    files = manifests(("b/requirements.txt", "x==2"), ("requirements.txt", "x"), ("a/b/requirements.txt", "x==9"), ("a/requirements.txt", "x==1"))
    assert rows(d.merge_dependencies(m.occurrences_of(parsed(files))), "name", "version") == [("x", "1")]


def brute_merge(rows_):
    """The ordered dict fold: entries overwrite inside a file, files fill gaps, then case folds."""
    files: dict = {}
    for repo, file_seq, entry_seq, name, version, source, dep_type in sorted(rows_, key=lambda r: r[:3]):
        files.setdefault((repo, file_seq), {})[name] = [name, version, source, dep_type]

    def fold(into, key, dep):
        if key not in into:
            into[key] = dep
            return
        current = into[key]
        if not current[1] and dep[1]:
            current[1] = dep[1]
        if current[3] == "unknown":
            current[3] = dep[3]

    merged: dict = {}
    for (repo, _), names in sorted(files.items()):
        for name, dep in names.items():
            fold(merged.setdefault(repo, {}), name, list(dep))
    result = []
    for repo, names in merged.items():
        keyed: dict = {}
        for name, dep in names.items():
            fold(keyed, name.lower(), dep)
        result += [(repo, key, *dep) for key, dep in keyed.items()]
    return sorted(result, key=repr)


def test_merge_against_brute_force(occurrences, rows):
    rng = random.Random(13)
    data = []
    for repo in ("hot", "hot2", "s"):
        for file_seq in range(12):
            for entry_seq in range(rng.randrange(14)):
                name = rng.choice(["a", "A", "b", "B", "c", "Cc", "cC", "d"])
                version = rng.choice([None, "", "1.0", "2.0", "0.3-alpha"])
                kind = rng.choice(["unknown", "unknown", "runtime", "peer"])
                data.append((repo, f"{file_seq:03}", entry_seq, name, version, rng.choice(["python", "go"]), kind))
    shuffled = rng.sample(data, len(data))
    found = d.deduplicate(d.merge_dependencies(occurrences(*shuffled).repartition(5))).drop("ord")
    columns = ("repo", "dep_key", "name", "version", "source", "dep_type")
    assert rows(found, *columns) == brute_merge(data)


def test_two_stage_merge(occurrences, rows):
    o = occurrences(
        ("r", "1", 0, "A", None, "python", "runtime"), ("r", "1", 1, "a", "1", "python", "runtime"), ("r", "2", 0, "A", "2", "python", "runtime"),
    )
    assert rows(d.deduplicate(d.merge_dependencies(o)), "name", "version") == [("A", "2")]


def dep(name, version="1.0", source="python", kind="runtime", repo="r"):
    return (repo, "1", hash(name) % 100, name, version, source, kind)


RULES = (("gpl", "GPL"), ("prop", "Proprietary"), ("mit", "MIT"))


def deps_of(occurrences, *rows_):
    return d.dependencies(occurrences(*rows_), RULES)


def test_vulnerabilities(occurrences):
    found = {r.name: r for r in deps_of(occurrences, dep("a", "0.1-beta"), dep("b", None), dep("c", "1.0-alpha"), dep("v", "v0.1")).collect()}
    assert [(v.identifier, v.severity) for v in found["a"].vulnerabilities] == [("PRE-A-001", "medium"), ("ZERO-A-001", "high")]
    assert found["b"].vulnerabilities == [] and not found["b"].is_vulnerable
    assert not found["c"].is_vulnerable
    assert found["v"].is_outdated and not found["v"].is_vulnerable


def test_health_score(value):
    expr = d.health_score("t", "v", "o")
    assert value(expr, "t bigint, v bigint, o bigint", 0, 0, 0) == 1.0
    assert value(expr, "t bigint, v bigint, o bigint", 10, 0, 0) == 1.0
    assert value(expr, "t bigint, v bigint, o bigint", 5, 5, 5) == 0.0
    assert value(expr, "t bigint, v bigint, o bigint", 3, 1, 0) == 0.8


def test_risk_scores(occurrences, rows):
    deps = deps_of(
        occurrences, dep("gpl-x", "0.1"), dep("opt", "1.0", kind="optional"), dep("plain", "2.0"), dep("mit-z", "0.1"), dep("prop", "1.0"),
    )
    assert rows(d.with_risk(deps), "name", "risk_score") == [
        ("gpl-x", 0.9), ("mit-z", 0.7), ("opt", -0.1), ("plain", 0.0), ("prop", 0.2),
    ]
    assert rows(d.high_risk_dependencies(deps), "name") == [("gpl-x",), ("mit-z",)]
    assert rows(d.high_risk_dependencies(deps, 0.2), "name") == [("gpl-x",), ("mit-z",), ("prop",)]


@pytest.mark.parametrize(
    ("version", "expected"),
    [(None, "unknown"), ("", "unknown"), ("1.0-dev", "experimental"), ("0.1", "early"), ("1.0-beta", "stable"), ("v0.1", "unknown"), ("x", "unknown")],
)
def test_freshness(value, version, expected):
    assert value(d.freshness(), "version string", version) == expected


def test_policy(occurrences, rows):
    deps = deps_of(occurrences, dep("gpl-x", "0.1-beta"), dep("ok", "1.0"), dep("old", "0.2"))
    found = d.evaluate_policy(deps, max_vulnerable=1, disallowed_licenses=["GPL"])
    assert rows(found, "message") == [
        ("Disallowed license detected: gpl-x (GPL)",), ("Pre-release dependency detected: gpl-x",), ("Vulnerable dependencies exceed limit (2)",),
    ]
    assert rows(d.evaluate_policy(deps, max_vulnerable=2, allow_pre_release=True)) == []


def test_confidence(occurrences, repos, rows):
    deps = deps_of(
        occurrences, dep("_priv", None), dep("@s/x", "1.0-dev", "javascript"), dep("g:a", "1", "jvm"), dep("mit", "1.0"), dep("_js", "1", "javascript"),
    )
    assert rows(d.confidence(deps), "name", "confidence_score", "reasons") == [
        ("@s/x", 0.65, ["pre_release_version", "scoped_package", "unknown_license"]),
        ("_js", 0.85, ["unknown_license"]),
        ("_priv", 0.5, ["missing_version", "private_python_package", "unknown_license"]),
        ("g:a", 0.8, ["multi_artifact_coordinate", "unknown_license"]),
        ("mit", 1.0, []),
    ]
    assert rows(d.confidence_summary(repos("r", "none"), deps)) == [("none", 1.0, 0), ("r", 0.76, 1)]


def test_conflicts(occurrences, repos, rows):
    o = occurrences(
        dep("pkg", "1.0.0"), dep("PKG", "2.0.0"), dep("x", "1", "python", "runtime"), dep("X", "1", "go", "peer"), dep("one", "1"),
        dep("zero", "0.1"), dep("Zero", "0.2"), dep("v", None), dep("V", ""),
    )
    assert rows(cf.version_conflicts(o)) == [("r", "pkg", 2), ("r", "zero", 2)]
    assert rows(cf.conflicting_versions(o), "name", "version") == [("pkg", "1.0.0"), ("pkg", "2.0.0"), ("zero", "0.1"), ("zero", "0.2")]
    assert rows(cf.type_conflicts(o)) == [("r", "x", ["peer", "runtime"])]
    assert rows(cf.ecosystem_shadowing(o)) == [("r", "x", ["go", "python"], 2)]
    assert rows(cf.version_divergence(o)) == [("r", "pkg", 0.5), ("r", "x", 0.0), ("r", "zero", 0.0)]
    assert rows(cf.conflict_report(repos("r", "none"), o)["summary"]) == [("none", 0), ("r", 4)]


def test_graph_counts_equal_the_pairs(occurrences, repos, rows):
    kinds = ["runtime", "development", "peer", "optional", "runtime", "build"]
    data = [dep(f"d{i}", "1", kind=kinds[i % 6], repo=f"r{i % 2}") for i in range(30)] + [dep("solo", "1", repo="solo")]
    deps = deps_of(occurrences, *data)
    nodes = {(r.repo, r.name): r for r in g.graph_nodes(deps).collect()}
    edges = {
        (a[0], a[3], b[3]) for a in data for b in data if a[0] == b[0] and a[6] == "runtime" and b[6] != "runtime"
    }
    for (repo, name), node in nodes.items():
        assert node.dependencies == sum(e[:2] == (repo, name) for e in edges)
        assert node.dependents == sum((e[0], e[2]) == (repo, name) for e in edges)
    sizes = {r.repo: r.edges for r in g.graph_size(repos("r0", "r1", "solo", "none"), deps).collect()}
    assert sizes == {r: sum(e[0] == r for e in edges) for r in ("r0", "r1", "solo", "none")}
    assert rows(g.leaves(g.graph_nodes(deps)).where("repo = 'solo'")) == rows(g.roots(g.graph_nodes(deps)).where("repo = 'solo'"))
    assert {r.name for r in g.dependencies_of(deps, "r0", "d0").collect()} == {e[2] for e in edges if e[:2] == ("r0", "d0")}
    assert g.dependencies_of(deps, "r0", "d2").count() == 0
    assert {r.name for r in g.dependents_of(deps, "r0", "d2").collect()} == {e[1] for e in edges if (e[0], e[2]) == ("r0", "d2")}


def test_findings_in_order(occurrences, rows):
    deps = deps_of(occurrences, dep("gpl", "0.1-alpha", kind="optional"), dep("ok", "1"))
    found = d.findings(deps).orderBy("position").collect()
    assert [(r.severity, r.category) for r in found] == [
        ("medium", "vulnerability"), ("high", "vulnerability"), ("medium", "license"), ("medium", "stability"), ("low", "stability"), ("info", "classification"),
    ]
    assert found[0].evidence == {"version": "0.1-alpha", "description": "Pre-release version detected"}
    assert found[5].evidence == {}
    assert rows(d.explanations(deps), "name", "explanation") == [
        ("gpl", "Risk due to: known vulnerabilities, major version zero, restrictive license"), ("ok", "No significant risk factors identified"),
    ]


def test_usage_and_upgrades(occurrences, rows):
    deps = deps_of(
        occurrences, dep("dev", "0.1", kind="development"), dep("peer", "1.0", kind="peer"), dep("none", None), dep("text", "latest"), dep("run", "2"),
    )
    assert rows(d.usage_profiles(deps), "name", "usage_type", "criticality", "reasoning") == [
        ("dev", "tooling", "high", ["development_or_build_dependency", "has_known_vulnerabilities", "early_version_dependency"]),
        ("none", "runtime", "medium", ["runtime_dependency"]),
        ("peer", "direct", "medium", ["no_special_risk_indicators"]),
        ("run", "runtime", "medium", ["runtime_dependency"]),
        ("text", "runtime", "medium", ["runtime_dependency"]),
    ]
    assert rows(d.upgrade_impacts(deps), "name", "current_version", "risk_level", "estimated_effort", "notes") == [
        ("dev", "0.1", "high", "low", ["unstable_major_version", "security_fix_recommended", "tooling_dependency"]),
        ("none", None, "unknown", "unknown", ["version_not_pinned"]),
        ("peer", "1.0", "medium", "medium", ["semantic_versioning_applies"]),
        ("run", "2", "medium", "medium", ["semantic_versioning_applies"]),
        ("text", "latest", "low", "low", []),
    ]


def test_all_six_types_are_kept(occurrences, repos, rows):
    deps = deps_of(occurrences, dep("a"), dep("b", kind="peer"))
    assert rows(d.type_counts(repos("r"), deps), "dep_type", "dependencies") == [
        ("build", 0), ("development", 0), ("optional", 0), ("peer", 1), ("runtime", 1), ("unknown", 0),
    ]
    listed = rows(d.dependencies_by_type(repos("r", "none"), deps))
    assert len(listed) == 6 + 6
    assert ("r", "peer", "b") in listed and ("none", "peer", None) in listed


def test_multi_ecosystem_insights(manifests, repos):
    files = manifests(
        ("requirements.txt", "requests==2.31.0\nnumpy==1.26.0\n"), ("package.json", '{"dependencies": {"react": "18"}, "devDependencies": {"eslint": "8"}}')
    )
    report = reports.repository_dependency_report(repos("r"), files)
    assert report["summary"].head().total == 4
    insights = reports.insights(report["dependencies"])
    assert {r.license: r.dependencies for r in insights["license_distribution"].collect()} == {"BSD": 1, "MIT": 1, "Unknown": 2}
    assert insights["usage_profiles"].count() == insights["upgrade_impacts"].count() == 4
    assert reports.verbose_report(repos("r"), report["dependencies"], report["summary"].select("repo", "sources_detected"))["summary"].count() == 1


def scans(df):
    """File scans of the plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.fixture
def stored(spark, tmp_path):
    """A frame read back from Parquet, so that scans can be counted."""

    def store(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return store


def test_entries_fold_like_a_dictionary(spark, rows):
    rng = random.Random(2)
    manifests, expected = [], []
    for k in range(60):
        entries = [(rng.choice("abcde"), rng.choice(["1", "2", None, ""]), rng.choice(["runtime", "peer"])) for _ in range(rng.randint(0, 12))]
        manifests.append(("r", f"f{k:02}", "s", False, entries))
        kept = {}
        for at, (name, *payload) in enumerate(entries):
            kept[name] = (kept[name][0] if name in kept else at, *payload)
        expected += [("r", f"f{k:02}", at, n, v, "s", t, False) for n, (at, v, t) in kept.items()]
        expected += [("r", f"f{k:02}", None, None, None, "s", None, False)] if not entries else []
    frame = spark.createDataFrame(manifests, f"repo string, file_seq string, source string, failed boolean, entries {m.ENTRIES}")
    assert rows(m.merged_entries_of(frame)) == sorted(expected, key=repr)
    merged, sources = d.merge_with_sources(m.merged_entries_of(frame))
    plain = d.merge_dependencies(m.occurrences_of(frame))
    assert rows(merged, "name", "version", "dep_type", "ord") == rows(plain, "name", "version", "dep_type", "ord")
    assert rows(sources) == [("r", ["s"])]


def test_ecosystems_of_empty_and_failed_manifests(spark, rows):
    data = [("r", "1", "python", False, []), ("r", "2", "go", True, []), ("s", "1", "rust", True, []), ("r", "3", "php", False, [("x", "1", "runtime")])]
    frame = spark.createDataFrame(data, f"repo string, file_seq string, source string, failed boolean, entries {m.ENTRIES}")
    merged, sources = d.merge_with_sources(m.merged_entries_of(frame))
    assert rows(merged, "repo", "name") == [("r", "x")]
    assert rows(sources) == rows(m.detected_sources(frame)) == [("r", ["php", "python"])]


def test_conflicts_read_the_occurrences_once(occurrences, repos, stored):
    o = stored(occurrences(("r", "1", 0, "a", "1", "python", "runtime"), ("r", "2", 0, "A", "2", "go", "peer")))
    report = cf.conflict_report(repos("r"), o)
    assert {k: scans(v) for k, v in report.items()} == dict.fromkeys(report, 1)


def test_conflicts_of_a_name_with_many_versions(spark, repos, rows):
    many = spark.range(20_000).selectExpr("'r' AS repo", "string(id) AS file_seq", "0 AS entry_seq", "'Hot' AS name", "string(id % 7000) || '.0' AS version",
                                          "if(id % 2 = 0, 'python', 'go') AS source", "'runtime' AS dep_type")
    assert rows(cf.conflicts(many)) == [("r", "hot", "ecosystem_shadowing", 2), ("r", "hot", "version_conflict", 7000)]
    assert cf.conflicting_versions(many).count() == 7000
    assert rows(cf.version_divergence(many)) == [("r", "hot", 1.0)]


def test_types_read_the_dependencies_once(occurrences, repos, rows, stored):
    o = stored(occurrences(("r", "1", 0, "a", "1", "python", "runtime"), ("r", "1", 1, "b", None, "python", "peer")))
    found = d.dependencies_by_type(repos("r"), d.dependencies(o))
    assert scans(found) == 1
    assert ("r", "runtime", "a") in rows(found) and ("r", "build", None) in rows(found) and len(rows(found)) == 6


def test_dependency_report_plans_without_a_job(spark, repos, stored):
    content = spark.sql("SELECT 'r' AS repo, 'requirements.txt' AS path, cast('a==1\nA==0.2\na==0.3' AS binary) AS content, string(NULL) AS error")
    files = stored(content)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    report = reports.repository_dependency_report(repos("r"), files)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert scans(report["summary"]) == 1
    assert [(r.name, r.version) for r in report["dependencies"].collect()] == [("a", "0.3")]
