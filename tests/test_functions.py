from __future__ import annotations

import random
from pathlib import PurePosixPath

import pytest

from forgelens.functions import paths, scores, text, versions
from forgelens.functions.sql import lit

TRICKY = [
    "", "a", "a\n", "a\n\nb\n", "\n", "\r\n", "a\r\nb\rc", "x\x0by\x0cz", "a\x1cb\x1dc\x1ed", "a\x85b c ",
    "  pad  ", "\t\x1fx\xa0", "a\r\n", "　x ", "end\x1c", "  \n\t\n x",
]


def random_texts(seed: int, n: int) -> list[str]:
    alphabet = "ab #/=\n\r\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　é"
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_lines_and_strip_follow_python(spark):
    texts = TRICKY + random_texts(1, 400)
    pieces = spark.createDataFrame([(t,) for t in texts], "x string").selectExpr(
        "x", f"{text.line_parts('x')} AS p"
    )
    frame = pieces.selectExpr(
        "x", f"{text.lines('x')} AS lines", f"{text.strip('x')} AS strip", f"{text.lstrip('x')} AS lstrip",
        f"{text.line_count('p')} AS total", f"{text.blank_count('p')} AS blank",
    )
    for row in frame.collect():
        expected = row.x.splitlines()
        assert row.lines == expected
        assert row.strip == row.x.strip()
        assert row.lstrip == row.x.lstrip()
        assert row.total == len(expected)
        assert row.blank == sum(not line.strip() for line in expected)


def test_line_counts_of_the_known_text(value):
    assert value(f"array({text.line_count('p')}, {text.blank_count('p')})", "p array<string>", ["a", "", "b", ""]) == [3, 1]


def test_lenient_decoding_follows_python(spark):
    rng = random.Random(2)
    data = [bytes(rng.randrange(256) for _ in range(rng.randrange(10))) for _ in range(300)]
    data += [b"a\xffb", "é".encode()[:1], b"\xe2\x82", "ok é".encode(), b"", "� kept".encode()]
    frame = spark.createDataFrame([(d,) for d in data], "b binary").selectExpr(
        "b", f"{text.decode_lenient('b')} AS t", f"{text.is_binary('b')} AS nul"
    )
    for row in frame.collect():
        assert row.t == bytes(row.b).decode("utf-8", errors="ignore")
        assert row.nul == (b"\x00" in bytes(row.b))


def test_genuine_replacement_characters_stay(value):
    for raw in (b"a\xef\xbf\xbdb\xff", "\x01r\ufffd\x01m\x01".encode() + b"\xc3", b"\xf0\xef\xbf\xbd", b"\x01\xffr", b"\xef\xbf", b"\xed\xa0\x80\xc0\x80x"):
        assert value(text.decode_lenient("x"), "x binary", raw) == raw.decode("utf-8", errors="ignore")


def test_line_ends_of_whole_files_are_line_feeds(value):
    raw = b"a\r\nb\rc\n\r\r\n\xff"
    assert value(text.read_text("x"), "x binary", raw) == "a\nb\nc\n\n\n"
    assert value(text.safe_text("x"), "x binary", raw) == "a\nb\nc\n\n\n"
    assert value(text.safe_text("x", 4), "x binary", raw) == "a\r\nb"


def test_binary_probe_of_the_whole_content(value):
    late = b"a" * 5_000 + b"\x00"
    assert value(text.is_binary("x"), "x binary", late) is False
    assert value(text.is_binary("x", None), "x binary", late) is True
    assert value(text.safe_text("x", sample_bytes=None), "x binary", late) == ""


def test_binary_probe_and_safe_text(value):
    assert value(text.safe_text("x"), "x binary", b"\x00\x01\x02") == ""
    assert value(text.safe_text("x"), "x binary", b"a" * 1024 + b"\x00") == "a" * 1024 + "\x00"
    assert value(text.is_binary("x"), "x binary", None) is False
    assert value(text.safe_text("x", 3), "x binary", "aéé".encode()) == "aé"
    assert value(text.safe_text("x", 2), "x binary", "aéé".encode()) == "a"


def test_hashes(value):
    assert value(text.content_hash("x"), "x binary", b"abc") == (
        "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    )
    with pytest.raises(ValueError):
        text.content_hash("x", "crc32")


PATHS = [
    "a.py", "src/main.PY", ".gitignore", "noext", "foo.", "x.tar.GZ", "a/b.c/d", "..a", "a/.hidden.md", "a/b/c.d.e",
    "build/x", "sub/build/x.c", "build", "tests/x.py", "sub/tests/x.py", "latest_news.py", "test_a.js", "a.spec.ts",
    "setup.py", "tests/setup.py", "pkg/requirements.txt", "README.md", "node_modules/m/index.js", "x/__tests__/y.js",
]


def test_path_parts_follow_pathlib(spark):
    frame = spark.createDataFrame([(p,) for p in PATHS], "path string").selectExpr(
        "path", f"{paths.suffix()} AS suffix", f"{paths.file_name()} AS name", f"{paths.depth()} AS depth",
        f"{paths.parent()} AS parent", f"{paths.in_excluded_dir()} AS excluded", f"{paths.is_loc_excluded()} AS loc_excluded",
    )
    for row in frame.collect():
        pure = PurePosixPath(row.path)
        assert row.suffix == ("" if row.path.endswith(".") else pure.suffix.lower())
        assert row.name == pure.name
        assert row.depth == len(pure.parts)
        assert row.parent == ("" if str(pure.parent) == "." else str(pure.parent))
        assert row.excluded == any(p in paths.EXCLUDED_DIRS for p in pure.parts[:-1])
        assert row.loc_excluded == any(p in paths.LOC_EXCLUDED_NAMES for p in pure.parts)


@pytest.mark.parametrize(
    ("path", "binary", "category"),
    [
        ("main.py", False, "source"),
        ("tests/test_main.py", True, "binary"),
        ("tests/setup.py", False, "test"),
        ("tests/x.py", False, "test"),
        ("requirements.txt", False, "config"),
        ("notes.txt", False, "docs"),
        ("data.bin", False, "unknown"),
        ("Setup.py", False, "source"),
        (".gitignore", False, "config"),
    ],
)
def test_category(value, path, binary, category):
    assert value(paths.category("b", "p"), "p string, b boolean", path, binary) == category


def test_index_markers_differ_at_the_root(value):
    assert value(paths.is_index_test_path("x"), "x string", "tests/x.py") is False
    assert value(paths.is_index_test_path("x"), "x string", "a/tests/x.py") is True
    assert value(paths.is_index_source_path("x"), "x string", "A.PY") is False


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("^18.0.0", "18.0.0"), ("*", "*"), (" * ", "*"), (">=1.0,<2", "1.0"), ("v0.1.0", "v0.1.0"), ("", None), (None, None),
        ("~= 2.1", "2.1"), ("  ", ""), ("!=1.5", "1.5"), ("1.0-beta+x", "1.0-beta+x"),
    ],
)
def test_normalize_version(value, raw, expected):
    assert value(versions.normalize_version("x"), "x string", raw) == expected


@pytest.mark.parametrize(
    ("raw", "name", "version"),
    [
        ("requests==2.31.0", "requests", "2.31.0"),
        ("pkg>=1,==2", "pkg>=1,", "2"),
        ("lib < 3", "lib", "3"),
        ("a~=1.4", "a", "1.4"),
        ("plain", "plain", None),
        ("x[extra]>=1", "x[extra]", "1"),
        ("a!=1", "a!=1", None),
        ("caret^2", "caret", "2"),
    ],
)
def test_split_spec(value, raw, name, version):
    spec = value(f"{versions.split_specs('array(x)')}[0]", "x string", raw)
    assert (spec.name, spec.version) == (name, version)


@pytest.mark.parametrize(
    ("version", "zero", "positive"),
    [("0.1", True, False), ("v0.9", True, False), ("00", True, False), ("01.2", False, True), ("10.0", False, True),
     ("x", False, False), (None, False, False), ("0", True, False), ("a1", False, True)],
)
def test_major_numbers(value, version, zero, positive):
    assert value(versions.has_zero_major("x"), "x string", version) is zero
    assert value(versions.has_positive_major("x"), "x string", version) is positive


def test_clamp_ratio_inverse(value):
    assert value(scores.clamp("x"), "x double", 2.0) == 1.0
    assert value(scores.clamp("x"), "x double", -1.0) == 0.0
    assert value(scores.clamp("x"), "x double", None) is None
    assert value(scores.ratio("x", "y"), "x double, y double", 5.0, 10.0) == 0.5
    assert value(scores.ratio("x", "y", 0.7), "x double, y double", 5.0, 0.0) == 0.7
    assert value(scores.inverse("x", 10), "x double", 0.0) == 1.0
    assert value(scores.inverse("x", 10), "x double", 5.0) == 0.5
    assert value(scores.inverse("x", 10), "x double", 50.0) == 0.0


def test_ladders(value):
    cases = {
        scores.grade("x"): [(0.9, "A"), (0.85, "A"), (0.7, "B"), (0.55, "C"), (0.54, "D")],
        scores.activity_trend("x"): [(0.1, "high"), (0.01, "moderate"), (0.009, "low")],
        scores.churn_stability("x"): [(200.0, "stable"), (600.0, "moderate"), (600.1, "volatile")],
        scores.bus_factor_risk("x"): [(4.0, "low"), (2.0, "medium"), (1.0, "high")],
    }
    for expr, pairs in cases.items():
        for number, expected in pairs:
            assert value(expr, "x double", number) == expected


def test_literals_are_escaped(value):
    for raw in ("it's", "back\\slash", "new\nline", 'say "x"', "a\\'b"):
        assert value(lit(raw)) == raw
