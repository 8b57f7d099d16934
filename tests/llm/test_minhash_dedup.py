"""MinHash near-dedup against all pairs of a small table."""

from __future__ import annotations

import os
import random
import re

from pyspark.sql import functions as F

from forgelens.llm import minhash_dedup as mh
from forgelens.llm.components import components
from forgelens.llm.minhash_dedup import NearDup, near_duplicates

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(data):
    sets = [(i, shingles(t)) for i, t in data]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, s) in enumerate(sets):
        component = None if i is None else least[find(k)]
        out.append((i, len(s), component, i is None or i == component))
    return sorted(out, key=repr)


def chain_rows(seed):
    """Families whose neighbours are near the threshold, copies, and edge cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, at = [], 0
    for _ in range(12):
        words = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 9)):
            rows.append((at, " ".join(words)))
            at += rng.randint(1, 3)
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(60)]
    for k in range(80):  # one large group of near copies
        w = list(base)
        w[rng.randrange(60)] = word()
        rows.append((5000 + k, " ".join(w)))
    rows += [(7000 + k, "the very same copy of a text in many rows") for k in range(50)]
    rows += [(8000, None), (8001, ""), (8002, "\t \n"), (8003, "a b"), (8004, "A  B"), (8005, "a b c"), (8006, "é É"), (8007, "é é"), (None, "a b"), (None, None), (8003, "a b"), (8003, "another text under the same id as a b"), (8010, "x " * 5000)]
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark, rows):
    data = chain_rows(3)
    df = spark.createDataFrame([(i, t, "n", 1, None) for i, t in data], "doc_id long, text string, node string, root int, halves string").repartition(3)
    assert rows(near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute(data)
    for how in (NearDup(crowd=3), NearDup(leading_rounds=0, best_rounds=0, crowd=7)):
        assert rows(near_duplicates(df, how), "doc_id", "n_shingles", "component_id", "kept") == brute(data)


def test_tables_match_all_pairs(spark, rows):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    data = [tuple(r) for r in df.collect()]
    assert rows(near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute(data)


def test_alike_texts_that_are_no_links_are_not_paired(spark):
    """Texts with too many words of their own fall out by the count of common shingles, before any pair of them is made."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for d in range(120):
        w = list(base)
        for k in rng.sample(range(100), 8):
            w[k] = f"own{d}x{k}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = NearDup()
    signed = mh.signatures(df, how)
    nodes = signed.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", "halves", "sketch")))
    members = mh.crowded(mh.table_keys(nodes, how))
    texts = signed.select("node", "doc_id").join(df, "doc_id").select("node", "text")
    assert members.select("node").distinct().count() > 100
    assert mh.candidates(mh.postings(mh.with_common(members, texts, how), nodes, how), how).count() < 20
    assert near_duplicates(df).where("kept").count() == sum(r[3] for r in brute(rows))


def test_alike_texts_with_common_words_leave_no_table_of_pairs(spark, rows, monkeypatch):
    """Every shingle is in half of the texts, so the count of common ones tells nothing; pairs must not become rows."""
    rng = random.Random(9)
    data = []
    for d in range(300):
        w = [f"b{k}" for k in range(100)]
        for k in range(3, 99, 6):
            w[k] = f"{rng.choice('xy')}{k}"
        data.append((d, " ".join(w)))
    for d in range(300, 320):  # some links
        w = data[d - 300][1].split()
        w[3] = f"z{d % 2}"
        data.append((d, " ".join(w)))
    sizes, staged = {}, mh.staged

    def counted(frame, label):
        out = staged(frame, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(mh, "staged", counted)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    how = NearDup()
    assert rows(near_duplicates(df, how), "doc_id", "n_shingles", "component_id", "kept") == brute(data)
    after = {k: n for k, n in sizes.items() if k not in ("keys", "members")}
    assert max(after.values()) <= len(data) * how.bands, after
    how = NearDup(leading_rounds=0, best_rounds=0, crowd_shingles=5000)
    assert rows(near_duplicates(df, how), "doc_id", "n_shingles", "component_id", "kept") == brute(data)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 400)
    edges = [(names[k], names[k + 1]) for k in range(199)] + [(names[200], names[k]) for k in range(201, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 400
    assert len({got[x] for x in names[:200]}) == 1 and len({got[x] for x in names[200:]}) == 1 and got[names[0]] != got[names[200]]


def test_roots_that_name_each_other_get_one_label(spark):
    """A star, two roots that name each other, and a chain: labels join connected roots only, and the first two wholly."""
    named = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "f"), ("f", "e"), ("p", "q"), ("q", "r")]
    got = {r.root: r.label for r in mh.merged(spark.createDataFrame(named, "root string, other_root string")).collect()}
    assert len(got) == len(named)
    assert len({got[x] for x in "abcd"}) == 1 and got["e"] == got["f"] and got["p"] == got["q"]
    assert set(got["e"]) <= set("ef") and set(got["p"]) <= set("pqr") and set(got["a"]) <= set("abcd")


def test_components_are_made_once(spark, rows, monkeypatch):
    """The leading rounds label what they join; only all links together go through the rounds of the components."""
    calls = []
    monkeypatch.setattr(mh, "components", lambda edges: calls.append(1) or components(edges))
    data = chain_rows(5)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == brute(data)
    assert len(calls) == 1
