"""SimHash near-dedup against all pairs of small tables."""

from __future__ import annotations

import os
import random
import re

import pytest
import xxhash

from forgelens.llm import simhash_dedup as sd
from forgelens.llm.queries import op11_simhash_dedup

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    return brute_of([(i, plain_print(t)) for i, t in rows])


def brute_of(prints):
    known = [(i, p) for i, p in prints if i is not None]
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            if (known[a][1] ^ known[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(known):
        least[find(k)] = min(i, least.get(find(k), i))
    out = [(i, f"{p:016x}", least[find(k)]) for k, (i, p) in enumerate(known)]
    return sorted(out + [(None, f"{p:016x}", None) for i, p in prints if i is None], key=repr)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_cover_meets_every_four_positions():
    assert len(set(sd.COVER)) == 20
    assert all(any(set(t) <= set(q) for t in sd.COVER) for q in sd.QUADS)


def test_whole_table_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(op11_simhash_dedup(spark, SF)) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One two\x0bTHREE"), (5, "one two three"), (6, "one two three four"),
        (7, "ONE TWO one"), (8, "Ünï ünï Ünï ünï"), (9, long), (9, long + " end"), (9, "other text under one id"), (None, "one two three"),
        (None, None), (10, "a b c d " * 30), (11, "a b c d " * 30), (-5, "a b c d " * 31), (12, "x" * 100_000),
    ]
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, list int, print string, component_id long")
    expected = brute(rows)
    assert answer(sd.near_duplicates(df)) == expected
    assert answer(sd.near_duplicates(df, sd.SimHash(chunk_shingles=7))) == expected
    assert sd.near_duplicates(df).columns == ["doc_id", "fingerprint", "component_id"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.near_duplicates(empty).collect() == []


def families(seed, centres, size):
    """Fingerprints around a few centres, with chains that drift away from them, and others at random."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(centres):
        here = rng.getrandbits(64)
        for _ in range(size):
            out.append(here)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
                here ^= 1 << rng.randrange(64)
            if rng.random() < 0.4:
                here = out[-rng.randint(1, min(size, len(out)))]
    return out


@pytest.mark.parametrize("crowd", [512, 12, 3, 1])
def test_crowded_lists_lose_no_link(spark, monkeypatch, crowd):
    prints = families(crowd, 3, 60)
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    monkeypatch.setattr(sd, "fingerprints", lambda documents, how: spark.createDataFrame(signed, "doc_id long, print long"))
    assert answer(sd.near_duplicates(None, sd.SimHash(crowd=crowd))) == brute_of(rows)
