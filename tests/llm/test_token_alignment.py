"""Token alignment against plain loops over the tokens of small tables."""

from __future__ import annotations

import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from forgelens.llm import token_alignment as ta
from forgelens.llm.queries import BYTE_MODEL, PIECE_MODEL, op12_token_alignment

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = [c.split(" ")[0] for c in ta.RESULT.split(", ")]


@pytest.fixture(scope="module")
def models():
    first = tokenizers.Tokenizer.from_file(BYTE_MODEL)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def brute(models, rows):
    first, second = models
    names = {i: t for t, i in first.get_vocab(with_added_tokens=True).items()}
    decoder = ta.byte_symbols()

    def spans(ids, size):
        at, out = 0, []
        for i in ids:
            out.append((at, at + size(i), i))
            at += size(i)
        return out

    def raw_a(i):
        return bytes(decoder[c] for c in names[i])

    def raw_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for doc, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            ia, ib = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            if b"".join(map(raw_a, ia)) == (" " + text).encode() == b"".join(map(raw_b, ib)):
                a, b = spans(ia, lambda i: len(raw_a(i))), spans(ib, lambda i: len(raw_b(i)))
        for s, e, i in a:
            links += [(i, j) for t, f, j in b if t < e and s < f]
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < high) for side in (a, b)))
        counts.update(links)
        docs.append((doc, a, b, links, groups))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for doc, a, b, links, groups in docs:
        best, total = sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def answer(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = [
    None, "", " ", "a", "hello  world\n\n  x", "<|endoftext|> and <s></s><unk>", "tab\tand\x00nul\x0bvt", "naïve café 東京 🙂🙂",
    "under▁bar", "▁", "﻿bom", "é  nbsp 　wide", "\r\n\r\n", "it's we'll I'm 12345 !!!???", "hello  world\n\n  x",
    "x" * 3000, " ".join(f"word{k} Zug" for k in range(4000)), "ab" * 2000 + " " + "é" * 500,
]


def test_whole_table_equals_plain_loops(spark, models):
    data = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    short = [(r.doc_id, r.text) for r in data.collect()]
    found = answer(op12_token_alignment(spark, SF))
    assert [r[0] for r in found] == [r[0] for r in brute(models, [(i, None) for i, _ in short])]
    few = [(i, t) for i, t in short if t is None or len(t) < 1500]
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert answer(ta.align_documents(df, BYTE_MODEL, PIECE_MODEL)) == brute(models, few)


def test_edge_texts(spark, models):
    rows = [(k // 2, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (7, "no id"), (3, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, pair string")
    expected = brute(models, rows)
    assert answer(ta.align_documents(df, BYTE_MODEL, PIECE_MODEL)) == expected
    small = ta.Alignment(block_bytes=300, chunk_bytes=100, part_chars=50)
    assert answer(ta.align_documents(df, BYTE_MODEL, PIECE_MODEL, small)) == expected


def test_text_that_is_no_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert answer(ta.align_documents(df, BYTE_MODEL, PIECE_MODEL)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align_documents(empty, BYTE_MODEL, PIECE_MODEL).collect() == []


def test_parts_give_the_ids_of_the_whole(models):
    first, second = models
    with open(PIECE_MODEL, "rb") as f:
        encoders = ta.Encoders(json.dumps(json.load(open(BYTE_MODEL))), f.read())
    assert encoders.splits
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "the ", " ", "  ", "\n", "\t", "Foo", "'s", "1", "é", "🙂", "▁", "　", "\x1c", "."]) for _ in range(120))
        assert encoders.encode([text.encode()], 20) == ([first.encode(" " + text, add_special_tokens=False).ids], [second.encode(text)])
        found = ta.align(encoders, [None, text.encode(), b"", b"ok", b"\xff"], 20)
        assert (found.n_a[1] == 0) == ("▁" in text) and found.n_a[3] == found.n_b[3] == 1 and not found.n_a[[0, 2, 4]].any()


def test_ranks_and_merges_give_the_same_ids(spark, models):
    """Both ways of the byte-level encoder, over the table, over characters of all kinds and over random texts."""
    first, _ = models
    with open(PIECE_MODEL, "rb") as f:
        encoders = ta.Encoders(open(BYTE_MODEL).read(), f.read())
    assert encoders.ranked is not None
    rng = random.Random(8)
    texts = [" " + r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    texts += [f" a{c}a1{c}1 {c} .{c}. {c}\n{c} x" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 41)])]
    kinds = ["aeiou", "the ing tion", "0123456789", "  \n\t", "'s't'll", ".,;:!?-_", "éèüñß", "東京的是", "🙂👍🏽", "приветмир", "\x00\x7f\x85\xa0"]
    texts += [" " + "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 300))) for _ in range(3_000)]
    texts += [" " + "ab" * 600, " " + " " * 900 + "x", " " + "x" * 20_000 + " tail", " \n" * 800]
    plain = [x.ids for k in range(0, len(texts), 5_000) for x in first.encode_batch(texts[k : k + 5_000], add_special_tokens=False)]
    assert encoders.first_ids(texts) == plain
    model = json.load(open(BYTE_MODEL))
    model["model"]["merges"][0], model["model"]["merges"][1] = model["model"]["merges"][1], model["model"]["merges"][0]
    assert ta._ranked(json.dumps(model), encoders.first_bytes) is None


def test_coalescing_of_overlapping_intervals():
    start, end, kind = (np.array(x) for x in ([0, 3, 5, 0, 2, 5], [3, 5, 9, 2, 5, 9], [0, 0, 0, 1, 1, 1]))
    order, group = ta.coalesced(start, end, kind)
    assert order.tolist() == [0, 3, 4, 1, 2, 5] and group.tolist() == [0, 0, 0, 0, 1, 1]
    at_a, at_b = ta.overlaps(start[:3], end[:3], start[3:], end[3:])
    assert list(zip(at_a.tolist(), at_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
