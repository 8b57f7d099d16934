"""Language-model scores: base against plain counts, attention against a plain loop, and held-out gain."""

from __future__ import annotations

import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from forgelens.llm import arrays
from forgelens.llm.language_model import Fit, Scorer, cross, exponentials, id_counts, id_type, product, score_documents, step, train_attention, word_counts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(data):
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter(w for i, t in data if learns(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in data:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out.append((repr(i), i is not None and not learns(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)))
    return sorted(out)


def test_base_matches_plain_counts(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    data = [tuple(r) for r in df.collect()] + [(None, "the a"), (7001, None), (7002, ""), (7003, "\t "), (7004, "x" * 5000), (3, "The THE the"), (3, "The THE the")]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in data], "doc_id long, text string, row int, word string").repartition(3)
    for fit in (Fit(steps=20), Fit(steps=20, head_words=50, chunk_bytes=20_000)):
        got = score_documents(df, MODEL, fit).collect()
        assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(data)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_windows_score_each_piece_once():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 40).astype(float)
    fit = Fit(width=8, window=6, classes=10, steps=30, batch=16)
    model = train_attention([rng.integers(0, 39, 300)], counts, fit)
    scorer, w = Scorer(model), model.weights
    sequences = [rng.integers(0, 39, n) for n in (0, 1, 5, 6, 7, 23, 40)]

    def plain(seq):
        line, wanted = [40, *seq], [*seq, 39]
        total = 0.0
        for t in range(len(line)):
            start = 0 if t < 6 else ((t - 6) // 3 + 1) * 3
            x = w["e"][line[start : t + 1]].astype(float)
            s = x @ w["k"].T.T @ (x[-1] @ w["q"]) / 8**0.5 + w["r"][::-1][-len(x) :]
            a = np.exp(s - s.max())
            h = x[-1] + (a / a.sum()) @ (x @ w["v"])
            z = h @ w["c"] + w["b"]
            total += z[model.group[wanted[t]]] - np.log(np.exp(z).sum()) + model.within[wanted[t]]
        return total / math.log(10)

    assert np.allclose(scorer.score(sequences), [plain(s) for s in sequences], atol=1e-3)
    z = np.array([scorer.score([np.array([k])])[0] for k in range(39)])
    one = sum(10 ** (scorer.score([np.array([k, j])])[0]) for k in range(3) for j in range(39))
    assert 0 < one < 1 and (z < 0).all()


def test_attention_learns_order():
    rng = random.Random(4)
    line = [rng.randrange(5) for _ in range(3)]
    for _ in range(6000):
        line.append((line[-1] + line[-2]) % 5 if rng.random() < 0.9 else rng.randrange(5))
    counts = np.array([line.count(k) for k in range(5)] + [1.0])
    seq = np.array(line)
    few, many = (Scorer(train_attention([seq[:5000]], counts, Fit(steps=s, classes=12))).score([seq[5000:]])[0] for s in (0, 600))
    assert many > few + 50


def test_every_training_document_trains_the_weights(spark):
    # Documents of two kinds; the start sees one document only, so it can't know the order of words of both.
    kinds = ("red blue green " * 60, "tree house river " * 60)
    learns = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(400) if i not in set(learns)][:2]
    rows = [(i, kinds[k % 2]) for k, i in enumerate(learns)] + [(i, kinds[k]) for k, i in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    fit = Fit(sample_documents=1, steps=0, pass_batch=16)
    got = {r.doc_id: r.score / (r.n_pieces + 1) for r in score_documents(df, MODEL, fit).where("held_out").collect()}
    # Frequencies alone give six words about log10(1/6) = -0.78 each.
    assert all(got[i] > -0.3 for i in held), got


@pytest.mark.parametrize("rows", [[], [(2, None)]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert score_documents(df, MODEL, Fit(steps=5)).count() == len(rows)


def test_words_of_a_batch_are_counted_piece_by_piece(spark):
    given = {}
    chain = SimpleNamespace(groupBy=lambda *_: SimpleNamespace(agg=lambda *_: None))
    frame = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: given.update(run=run) or chain))
    word_counts(frame, Fit())
    batch = pa.RecordBatch.from_arrays([pa.array(["The cat sat on a mat " * 200] * 3000 + [None, "", "cat"])], names=["text"])
    arrays._Tables.get()
    tracemalloc.start()
    out = list(given["run"](iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sorted(n for o in out for n in o.column("n").to_pylist()) == [600_000] * 5 + [600_001]
    assert peak < 110, peak


@pytest.mark.parametrize("rows", [0, 5, 256, 700])
def test_products_in_blocks(rows):
    rng = np.random.default_rng(rows)
    x, y, z = rng.normal(size=(rows, 16)), rng.normal(size=(rows, 7)), rng.normal(size=(7, 16)).T
    assert np.allclose(product(x, z), x @ z) and np.allclose(cross(x, y), x.T @ y)


def test_exponentials_at_the_ends_of_the_range():
    x = np.array([[0, 1, -1], [500, 499, -500], [-300, -301, -1e9], [80, -80, 0]], np.float32)
    for part in (x, x[:1], x[:0]):
        e, sums, off = exponentials(part.copy(), part.copy)
        assert np.isfinite(e).all() and np.allclose(e.sum(axis=1), sums)
        assert np.allclose(np.log(sums) + off, [math.log(sum(math.exp(v - max(r)) for v in r)) + max(r) for r in part.tolist()])


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    m, n, d, classes = 20, 16, 4, 6
    group = rng.integers(0, classes, 12).astype(np.int32)
    shapes = {"e": (13, d), "q": (d, d), "k": (d, d), "v": (d, d), "r": (n,), "c": (d, classes), "b": (classes,)}
    w = {name: rng.normal(0, 0.7, shape) for name, shape in shapes.items()}
    ids, target = rng.integers(0, 13, (m, n)), rng.integers(0, 13, (m, n))  # 12 is the begin, no target

    def loss(w):
        x = w["e"][ids]
        back = np.arange(n)[:, None] - np.arange(n)
        s = (x @ w["q"]) @ (x @ w["k"]).transpose(0, 2, 1) / d**0.5 + np.where(back >= 0, w["r"][np.maximum(back, 0)], -np.inf)
        a = np.exp(s - s.max(axis=-1, keepdims=True))
        h = x + a / a.sum(axis=-1, keepdims=True) @ (x @ w["v"])
        z = h @ w["c"] + w["b"]
        z -= np.log(np.exp(z).sum(axis=-1, keepdims=True))
        real = target < 12
        return -z[real][np.arange(real.sum()), group[target[real]]].sum() / real.sum()

    now = {name: x.astype(np.float32) for name, x in w.items()}
    seen = {name: np.zeros(x.shape, np.float32) for name, x in w.items()}
    with np.errstate(invalid="ignore"):  # slopes of 0
        step(now, seen, group, ids, target, 0.5)
    for name, x in w.items():
        for at in list(np.ndindex(x.shape))[:: max(1, x.size // 12)]:
            near = [loss({**w, name: np.where(np.arange(x.size).reshape(x.shape) == np.ravel_multi_index(at, x.shape), x + e, x)}) for e in (1e-5, -1e-5)]
            slope = (near[0] - near[1]) / 2e-5
            assert math.isclose(np.sqrt(seen[name][at]), abs(slope), rel_tol=2e-2, abs_tol=2e-5), (name, at)
            assert abs(slope) < 1e-4 or (now[name][at] < x[at]) == (slope > 0), (name, at)


@pytest.mark.parametrize("symbols", [300, 70_000])
def test_staged_ids_are_counted(spark, symbols):
    rows = [[5, 5, symbols - 1], [], [0, 5]]
    df = spark.createDataFrame([(bytearray(np.array(r, id_type(symbols)).tobytes()),) for r in rows], "ids binary").repartition(2)
    counts = id_counts(df, symbols)
    assert {i: int(counts[i]) for i in np.flatnonzero(counts)} == {0: 1, 5: 3, symbols - 1: 1}
