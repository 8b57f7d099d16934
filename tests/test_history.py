from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from forgelens import tables
from forgelens.operators import history as h
from forgelens.plans import history_reports as reports
from forgelens.sources import commit_log

AS_OF = datetime(2024, 6, 1)


def commit(repo, seq, email="dev@test.com", at=datetime(2024, 5, 1), message="add proper feature implementation"):
    return (repo, seq, f"{repo}-{seq}", "Dev", email, at, message)


@pytest.fixture
def commits(spark):
    return lambda *rows: spark.createDataFrame(list(rows), tables.COMMITS)


@pytest.fixture
def changes(spark):
    return lambda *rows: spark.createDataFrame(list(rows), tables.COMMIT_FILES)


@pytest.fixture
def repos(spark):
    return lambda *names: spark.createDataFrame([(n,) for n in names], tables.REPOS)


def one(df):
    return df.head().asDict()


def test_log_lines(spark, rows):
    lines = [
        ("abc123|John Doe|john@example.com|1700000000|commit message",),
        ("h|n|e|1|with | pipes|",),
        ("invalid|line",),
        ("h|n|e|not-a-time|m",),
        ("h|a|b|e|1|m",),
        ("h|n|e|99999999999999|m",),
        ("h|n|e|0|",),
    ]
    parsed = commit_log.parse_log_lines(spark.createDataFrame(lines, "line string"))
    assert rows(parsed) == sorted(
        [
            ("abc123", "John Doe", "john@example.com", datetime(2023, 11, 14, 22, 13, 20), "commit message"),
            ("h", "n", "e", datetime(1970, 1, 1, 0, 0, 1), "with | pipes|"),
            ("h", "n", "e", datetime(1970, 1, 1), ""),
        ],
        key=repr,
    )


def test_numstat_lines(spark, rows):
    lines = [("3\t1\ta.txt",), ("-\t-\timg.png",), ("x\t2\tb",), ("3\t1",), ("",), ("1\t2\ta\tb",)]
    parsed = commit_log.parse_numstat_lines(spark.createDataFrame(lines, "line string"))
    assert rows(parsed) == [("a.txt", 3, 1), ("b", 0, 2), ("img.png", 0, 0)]


def test_log_file_keeps_its_order_across_blocks(spark, tmp_path):
    records = [
        f"\x1eh{i}|n|e@x|{1_700_000_000 - i}|message {i} {'x' * (i % 50)}\n\n1\t{i}\tf{i}.py\n-\t-\tlogo.png\n" for i in range(3000)
    ]
    (tmp_path / "alpha.log").write_text("".join(records))
    (tmp_path / "beta.log").write_text("\x1eb1|n|e|5|only\n\n2\t0\tz.py\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16384")
    try:
        raw = commit_log.read_log_records(spark, str(tmp_path))
        found = commit_log.commits_of(raw).where("repo = 'alpha'").orderBy("seq").collect()
        assert [r.commit_hash for r in found] == [f"h{i}" for i in range(3000)]
        assert len({r.seq for r in found}) == 3000
        files = commit_log.commit_files_of(raw)
        assert files.where("repo = 'alpha'").count() == 6000
        assert files.where("commit_hash = 'b1'").head().path == "z.py"
    finally:
        spark.conf.set(key, before)


def test_repositories_are_paths_below_the_root(spark, tmp_path, rows):
    for name in ("a/app", "b/app", "b/x y+z%41", "top"):
        target = tmp_path / "logs" / f"{name}.log"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"\x1eh1|n|{name}@x|2|first\n\n1\t2\tf.py\n\x1eh2|n|e@x|1|second\n")
    (tmp_path / "logs" / "notes.txt").write_text("\x1eno|n|e|1|log\n")
    root = str(tmp_path / "logs")
    expected = [(repo, k) for repo in ("a/app", "b/app", "b/x y+z%41", "top") for k in (0, 1)]
    for path in (root, root + "/", f"file://{root}"):
        found = commit_log.commits_of(commit_log.read_log_records(spark, path))
        assert rows(found, "repo", "seq") == expected
    one_file = commit_log.commits_of(commit_log.read_log_records(spark, f"{root}/a/app.log"))
    assert rows(one_file, "repo", "commit_hash") == [("app", "h1"), ("app", "h2")]
    several = commit_log.commit_files_of(commit_log.read_log_records(spark, f"{root}/*/app.log"))
    assert rows(several, "repo", "path", "deletions") == [("a/app", "f.py", 2), ("b/app", "f.py", 2)]


def test_block_numbers_do_not_meet(spark, rows):
    """Records of the least size fill a block with fewer numbers than it has bytes."""
    records = spark.createDataFrame(
        [("r", b, p, f"h{b}-{p}|n|e|{p}|m", "") for b, n in ((0, 40), (4096, 30), (8192, 1)) for p in range(n)],
        "repo string, block long, place long, header string, body string",
    )
    found = rows(commit_log.commits_of(records), "seq", "commit_hash")
    assert found == sorted([(b + p, f"h{b}-{p}") for b, n in ((0, 40), (4096, 30), (8192, 1)) for p in range(n)], key=repr)


def test_small_history(commits, changes, repos, rows):
    c = commits(
        commit("r", 1, message="add new file"), commit("r", 2, message="add second line"), commit("r", 3, message="initial commit")
    )
    f = changes(("r", "r-1", 1, "b.txt", 1, 0), ("r", "r-2", 1, "a.txt", 1, 0), ("r", "r-3", 1, "a.txt", 1, 0))
    with_stats = h.attach_commit_stats(c, f)
    assert rows(h.author_contributions(with_stats)) == [("r", "dev@test.com", 3, 3, 0, 1)]
    assert rows(h.file_impact(f)) == [("r", "a.txt", 2, 2, 0), ("r", "b.txt", 1, 1, 0)]
    assert one(h.change_totals(repos("r"), with_stats))["files_changed"] == 3
    assert one(h.bus_factor(repos("r"), h.author_ranks(c)))["bus_factor"] == 1


def test_empty_repository_has_its_defined_answers(commits, changes, repos):
    r, c, f = repos("empty"), commits(), changes()
    assert one(h.commit_frequency(r, c)) == {"repo": "empty", "total_commits": 0, "days_active": 0, "commits_per_day": 0.0}
    assert one(h.inactivity(r, c, AS_OF)) == {"repo": "empty", "inactive": True, "days_since_last_commit": None}
    assert one(h.message_quality(r, c)) == {"repo": "empty", "total_messages": 0, "meaningful_messages": 0, "meaningful_ratio": 0.0}
    assert one(h.merge_commits(r, c)) == {"repo": "empty", "merge_commits": 0, "merge_ratio": 0.0}
    assert one(h.bus_factor(r, h.author_ranks(c))) == {"repo": "empty", "bus_factor": 0}
    assert one(h.churn(r, h.file_impact(f))) == {"repo": "empty", "files": 0, "high_churn_files": 0, "average_churn": 0.0}
    summary = one(reports.extended_summary(r, c, f, AS_OF))
    assert summary["score"] == 100 - 30 - 20 - 15 - 10
    assert summary["average_churn"] == 0.0 and summary["files"] == 0


def test_days_are_whole_periods(commits, repos):
    c = commits(
        commit("a", 1, at=datetime(2024, 1, 2, 1)), commit("a", 2, at=datetime(2024, 1, 1, 23)),
        commit("b", 1, at=datetime(2024, 1, 3, 23, 0, 1)), commit("b", 2, at=datetime(2024, 1, 1, 23)),
    )
    found = {r.repo: r for r in h.commit_frequency(repos("a", "b"), c).collect()}
    assert (found["a"].days_active, found["a"].commits_per_day) == (1, 2.0)
    assert (found["b"].days_active, found["b"].commits_per_day) == (3, 0.667)


@pytest.mark.parametrize(
    ("at", "days", "inactive"),
    [
        (AS_OF - timedelta(days=90), 90, True),
        (AS_OF - timedelta(days=90) + timedelta(seconds=1), 89, False),
        (AS_OF + timedelta(hours=1), -1, False),
        (AS_OF, 0, False),
        (datetime(2024, 3, 10, 2, 30), 82, False),
    ],
)
def test_inactivity(commits, repos, at, days, inactive):
    found = one(h.inactivity(repos("r"), commits(commit("r", 1, at=at)), AS_OF))
    assert (found["days_since_last_commit"], found["inactive"]) == (days, inactive)


@pytest.mark.parametrize(
    ("message", "meaningful", "merge"),
    [("fix", False, False), ("  short   ", False, False), ("add proper feature", True, False), ("Merged stuff here", True, True),
     (" merge x y z long", True, False), ("", False, False), ("1234567890", True, False), ("\t123456789\n", False, False)],
)
def test_messages(value, message, meaningful, merge):
    assert value(h.is_meaningful("x"), "x string", message) is meaningful
    assert value(h.is_merge("x"), "x string", message) is merge


def test_authors_are_normalised_once(commits, rows):
    once = h.normalize_authors(commits(commit("r", 1, " DEV@Test.com\t"), commit("r", 2, "dev@test.com")))
    assert rows(h.normalize_authors(once)) == rows(once)
    assert rows(h.commits_per_author(once)) == [("r", "dev@test.com", 2)]


def brute_bus_factor(counts, threshold):
    """(email, commits) in first-seen order."""
    total = sum(n for _, n in counts)
    taken, cumulative = [], 0
    for email, n in sorted(counts, key=lambda item: item[1], reverse=True):
        cumulative += n
        taken.append(email)
        if cumulative / total >= threshold:
            break
    return taken


@pytest.mark.parametrize("threshold", [0.5, 0.1, 0.9, 1.0, 0.3333333333333333])
def test_bus_factor_against_brute_force(spark, repos, threshold):
    rng = random.Random(7)
    data, expected = [], {}
    for r in range(25):
        emails = [f"e{i}" for i in range(rng.choice([1, 2, 3, 5, 40]))]
        log = [rng.choice(emails[: rng.choice([1, 3, 50])]) for _ in range(rng.choice([1, 3, 10, 60]))]
        first = {}
        for seq, email in enumerate(log, 1):
            data.append((f"r{r}", email, seq))
            first.setdefault(email, 0)
            first[email] += 1
        expected[f"r{r}"] = brute_bus_factor(list(first.items()), threshold)
    c = spark.createDataFrame(data, "repo string, author_email string, seq bigint")
    ranks = h.author_ranks(c)
    found = {r.repo: r.bus_factor for r in h.bus_factor(tables.repos_of(c), ranks, threshold).collect()}
    assert found == {repo: len(names) for repo, names in expected.items()}
    listed: dict[str, list] = {}
    for r in h.dominant_authors(ranks, threshold).orderBy("repo", "position").collect():
        listed.setdefault(r.repo, []).append(r.author_email)
    assert listed == expected


def test_ties_go_to_the_author_seen_first(commits, rows):
    c = commits(commit("r", 1, "b"), commit("r", 2, "a"), commit("r", 3, "a"), commit("r", 4, "b"))
    assert rows(h.dominant_authors(h.author_ranks(c))) == [("r", 1, "b", 2)]


def test_churn_is_strict_and_uses_the_unrounded_mean(changes, repos):
    f = changes(("r", "c", 1, "a", 1, 0), ("r", "c", 2, "b", 1, 0), ("r", "c", 3, "c", 4, 0))
    assert one(h.churn(repos("r"), h.file_impact(f))) == {
        "repo": "r", "files": 3, "high_churn_files": 0, "average_churn": 2.0
    }
    f = f.union(changes(("r", "d", 1, "c", 0, 3)))
    assert one(h.churn(repos("r"), h.file_impact(f)))["high_churn_files"] == 1


def test_merge_ratio_above_zero(commits, repos):
    c = commits(commit("r", 1, message="Merge a"), commit("r", 2), commit("r", 3))
    assert one(h.merge_commits(repos("r"), c)) == {"repo": "r", "merge_commits": 1, "merge_ratio": 0.333}


def test_counts_are_conserved_and_order_does_not_matter(commits, repos, rows):
    rng = random.Random(3)
    data = [
        commit(f"r{rng.randrange(3)}", i, f"e{rng.randrange(9)}", datetime(2024, 1, 1) + timedelta(hours=rng.randrange(9000)))
        for i in range(500)
    ]
    straight = commits(*data)
    shuffled = commits(*rng.sample(data, len(data))).repartition(7)
    for part in (h.commits_per_author, h.commits_per_day, h.commits_per_month, h.author_months):
        found = rows(part(straight))
        assert sum(r[-1] for r in found) == 500
        assert found == rows(part(shuffled))
    assert rows(h.history_totals(straight)) == rows(h.history_totals(shuffled))


def test_one_scan_totals_equal_the_separate_operators(commits, rows):
    c = commits(*[commit(f"r{i % 2}", i, f"e{i % 5}", AS_OF - timedelta(days=i), "merge x" if i % 3 else "fix") for i in range(60)])
    totals = h.history_totals(c)
    assert rows(totals.drop("bus_factor")) == rows(h.activity_totals(c))
    assert rows(totals.select("repo", "bus_factor")) == rows(h.bus_factor_totals(h.author_ranks(c)))


def test_commits_and_files_without_each_other(commits, changes, rows):
    c = commits(commit("r", 1))
    f = changes(("other", "x", 1, "a", 5, 5))
    assert rows(h.attach_commit_stats(c, f), "repo", "files_changed", "insertions") == [("r", 0, 0)]


def test_newest_commits_limit_reaches_every_part(commits, changes, repos):
    c = commits(commit("r", 1, "new@x"), commit("r", 2, "old@x"), commit("s", 1, "s@x"))
    f = changes(("r", "r-1", 1, "a", 1, 0), ("r", "r-2", 1, "b", 9, 0))
    report = reports.extended_git_history_report(repos("r", "s"), c, f, AS_OF, max_commits=1)
    found = {r.repo: r for r in report["summary"].collect()}
    assert (found["r"].total_commits, found["r"].files, found["r"].average_churn) == (1, 1, 1.0)
    assert {r.author_email for r in report["authors"].collect()} == {"new@x", "s@x"}
