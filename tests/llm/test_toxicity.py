"""Toxicity scores: held-out accuracy, calibration on unseen rows and edge cases."""

from __future__ import annotations

import os
import random
import tracemalloc
import zlib

from forgelens.llm.toxicity import Fit, Lengths, fit_model, score_toxicity, train, windows, without_toxic

MEASURE = os.environ.get("TEST_FIT_DIR", "/root/testdata/sf0.1")


def invented(seed, n):
    rng = random.Random(seed)
    syllables = ["ta", "ren", "os", "il", "mu", "ka", "ster", "ed"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        words = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(3 * y):
            words.insert(rng.randrange(len(words)), rng.choice(["Zwonk,", "grubvar", "hib", "plozzish"]))
        rows.append((" ".join(words), y))
    return rows


def test_unseen_rows_are_told_apart():
    from forgelens.llm.toxicity import Scorer

    model = fit_model(invented(1, 900), Fit())
    rows = invented(2, 400)
    scores = Scorer(model).score([t for t, _ in rows])
    wrong = sum((s >= 0.7) != bool(y) for s, (_, y) in zip(scores, rows, strict=True))
    assert wrong <= 8
    assert all(0 <= s <= 1 for s in scores) and Scorer(model).score(["", None])[0] < 0.5
    assert Lengths(b" grubvar ").of([b"grubvar"])[0] < Lengths(b" other words ").of([b"grubvar"])[0]


def test_long_runs_are_windowed_whole():
    run = "".join(f"{chr(0x4E00 + k)}é{chr(0x1D100 + k)}a" for k in range(60))
    found = [w.decode() for w in windows("ab " + run + " cd", 64)]
    assert found[0] == "ab" and found[-1] == "cd" and all(len(w.encode()) <= 64 for w in found)
    covered = 0
    for w in (w for w in found if len(w) > 8):
        assert run.index(w) <= covered
        covered = max(covered, run.index(w) + len(w))
    assert covered == len(run) and {run[k : k + 3] for k in range(len(run) - 2)} <= set(found)


def test_toxic_words_in_text_without_blanks():
    from forgelens.llm.toxicity import Scorer

    def unspaced(seed, n):
        rng = random.Random(seed)
        signs = [chr(0x4E00 + k) for k in range(200)]
        out = []
        for _ in range(n):
            y = int(rng.random() < 0.3)
            text = [rng.choice(signs) for _ in range(rng.randint(100, 150))]
            for _ in range(3 * y):
                # Behind the first 64 bytes of the run.
                text.insert(rng.randrange(30, len(text)), rng.choice(["毒骂恶", "贱滚蠢"]))
            out.append(("".join(text), y))
        return out

    model = fit_model(unspaced(1, 300), Fit())
    rows = unspaced(2, 100)
    scores = Scorer(model).score([t for t, _ in rows])
    assert sum((s >= 0.7) != bool(y) for s, (_, y) in zip(scores, rows, strict=True)) <= 4
    latin = fit_model(invented(1, 900), Fit())
    clean, glued = Scorer(latin).score(["tarenosil" * 20, "tarenosil" * 8 + "grubvar" + "mukaster" * 4 + "plozzish" + "grubvar" + "edosil"])
    assert clean < 0.5 and glued >= 0.7


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{MEASURE}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    scored = score_toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in scored)
    assert hit >= 0.8 * sum(r.toxic for r in scored)
    assert sum(r.predicted and not r.toxic for r in scored) <= 0.02 * sum(not r.toxic for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)


def test_edge_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "grubvar", 3.0), (2, "x" * 200_000, 4.0), (5, "hib " * 9, 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert train(docs, labels) is None
    assert [r.score for r in score_toxicity(docs, None).collect()] == [0.0] * 5
    model = fit_model(invented(3, 600), Fit())
    assert len(score_toxicity(docs, model).collect()) == 5
    kept = without_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.score for r in kept.collect()) == [1.0, 2.0, 3.0, 4.0]
    assert score_toxicity(docs.limit(0), model).count() == 0 and without_toxic(docs.limit(0), model).count() == 0


def test_repeated_windows_take_little_memory(monkeypatch):
    from forgelens.llm import toxicity

    scorer = toxicity.Scorer(fit_model(invented(1, 300), Fit()))
    texts = [t for t, _ in invented(2, 3)] * 1000
    tracemalloc.start()
    scores = scorer.score(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 15, peak
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    assert scores[:30] == scorer.score(texts[:30])
