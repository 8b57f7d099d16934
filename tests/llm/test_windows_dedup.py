"""Substring dedup and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from forgelens.llm import suffix_dedup
from forgelens.llm.repeats import Rule
from forgelens.llm.substring_dedup import WORD_RULE, remove_repeated_words
from forgelens.llm.suffix_dedup import BYTE_RULE, remove_earlier_bytes

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SMALL = Rule(unit="word", width=7, period=7, cover=(1, 2, 4), smaller_only=False, chunk_bytes=64)
SMALL_BYTES = Rule(unit="byte", width=9, period=7, cover=(1, 2, 4), smaller_only=True, anchor_passes=3, window_passes=2, chunk_bytes=64)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def brute_words(rows, width):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for i, w in docs if i is not None for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept).encode())))
    return sorted(out, key=repr)


def brute_bytes(rows, width):
    docs = [(i, (t or "").encode()) for i, t in rows]
    least = defaultdict(lambda: 1 << 62)
    for i, b in docs:
        for k in range(len(b) - width + 1):
            if i is not None:
                least[b[k : k + width]] = min(least[b[k : k + width]], i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if i is not None and least[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for k, x in enumerate(b) if not gone[k]))))
    return sorted(out, key=repr)


def random_rows(seed, separator=" "):
    rng = random.Random(seed)
    passages = [[rng.choice("abé") for _ in range(rng.randint(3, 25))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 20))]
        rows.append((i, separator.join(words)))
    hot = " ".join("hot passage which a third of all of the documents hold".split())
    rows += [(200 + i, f"{i} {hot} {i * 7}") for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "x" * 400), (1004, "ab " * 300), (None, hot), (None, None), (1004, "ab " * 300), (3, "ab " * 30), (1005, "a b c"), (-5, hot)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, rows, seed):
    data = random_rows(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in data], "doc_id long, text string, places string, n_words long").repartition(3)
    got = rows(remove_repeated_words(df, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_words(data, 7)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, rows, seed):
    data = random_rows(seed, "")
    df = spark.createDataFrame([(i, t, "x", i) for i, t in data], "doc_id long, text string, tag string, whole long").repartition(3)
    got = rows(remove_earlier_bytes(df, SMALL_BYTES), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(data, 9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_words(df).count() == 0
    assert remove_earlier_bytes(df).count() == 0


def test_production_rules_on_the_tables(spark, rows):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    data = [tuple(r) for r in df.collect()]
    assert rows(remove_repeated_words(df, WORD_RULE), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(data, 35)
    assert rows(remove_earlier_bytes(df, BYTE_RULE), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(data, 50)


def test_kept_text_and_bytes(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "z a b c d e f g y")], "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in remove_repeated_words(df, SMALL).collect()}
    assert kept == {1: "", 2: "z y"}
    left = {r.doc_id: bytes(r.kept_bytes) for r in remove_earlier_bytes(df, SMALL_BYTES).collect()}
    assert left == {1: b"a b c d e f g", 2: b"z  y"}


def test_rule_must_be_a_cover():
    with pytest.raises(ValueError):
        Rule(unit="word", width=9, period=8, cover=(0, 1), smaller_only=False)


def test_long_and_short_texts_of_one_id(spark, rows):
    """Rows of one id are told apart by their number, so no two can be taken for each other."""
    rng = random.Random(6)
    data = [(5, " ".join(rng.choice("abc") for _ in range(rng.choice([2, 30, 400])))) for _ in range(300)] + [(4, "a b c a b c a b c"), (5, None), (5, ""), (6, "a b c a b c a b c")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(remove_repeated_words(df, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(data, 7)
    assert rows(remove_earlier_bytes(df, SMALL_BYTES), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(data, 9)


def test_stretches_hold_every_string_once_and_are_few():
    """Strings are dealt by a seed that depends on them alone, and about eleven of them travel together."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (3000, 49, 50, 0, 500)]
    texts.append(np.concatenate([texts[4][100:300], texts[0][7:400]]))
    bounds = np.cumsum([0] + [len(t) for t in texts])
    data = np.concatenate(texts)
    start, size, seed, _ = suffix_dedup.stretches(data, bounds, BYTE_RULE)
    places = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    assert places.tolist() == [k for a, b in zip(bounds, bounds[1:]) for k in range(a, b - 49)]
    assert len(start) * 8 < size.sum()
    # Blocks are the high bits of a seed: each half of them gets its share.
    assert 0.4 < np.mean(seed >> np.uint64(63)) < 0.6
    seeds = {}
    for place, s in zip(places.tolist(), np.repeat(seed, size).tolist()):
        assert seeds.setdefault(data[place : place + 50].tobytes(), s) == s


def test_copies_in_other_surroundings_match_brute_force(spark, rows):
    """Passages that begin and end at any place, so that stretches agree in part only; one pass and several."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé") for _ in range(rng.randint(45, 160))) for _ in range(5)]
    data = [(rng.randint(0, 60), "".join(rng.choice([p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)], "zq" * rng.randint(0, 40)]) for p in rng.choices(passages, k=4))) for _ in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for rule in (BYTE_RULE, Rule(unit="byte", width=50, period=21, cover=BYTE_RULE.cover, smaller_only=True, anchor_passes=2, window_passes=2, chunk_bytes=300)):
        for crowd in (4096, 2):
            assert rows(remove_earlier_bytes(df, rule, crowd=crowd), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(data, 50)
