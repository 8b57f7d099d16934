"""Streaming Viterbi against the whole lattice, and exact round trips."""

from __future__ import annotations

import os
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from forgelens.llm import arrays, sentencepiece_codec
from forgelens.llm.sentencepiece_codec import _SEGMENT, ColumnEncoder, Encoder, StreamingViterbi, decode, encode, read_vocabulary, segment_starts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
TEXTS = ["", " ", "a", "the cat", "  two  spaces \n\n line", "▁ literal", "é́ 漢字 😀\x00\t", "x" * 700, " " * 100, "thisisoneverylongwordwithoutanyblank" * 8, "\r\n"]


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(MODEL)


def lattice(vocabulary, text):
    """Ids of the best path over the whole text at once."""
    best, back = [0] + [None] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(end - 1, max(0, end - vocabulary.max_piece) - 1, -1):
            piece = vocabulary.pieces.get(text[start:end])
            cost = piece[1] if piece else vocabulary.byte_score * len(text[start:end].encode()) if end - start == 1 else None
            if cost is not None and (best[end] is None or best[start] + cost >= best[end]):
                best[end], back[end] = best[start] + cost, start
    out, at = [], len(text)
    while at:
        part = text[back[at] : at]
        own = [vocabulary.pieces[part][0]] if part in vocabulary.pieces else [vocabulary.byte_ids[b] for b in part.encode()]
        out, at = own + out, back[at]
    return out


def test_same_as_the_whole_lattice(vocabulary):
    rng, encoder = random.Random(6), Encoder(vocabulary)
    words = [p.strip() for p in rng.sample(list(vocabulary.pieces), 300)]
    texts = TEXTS + ["".join(rng.choice(words + [" ", " ", "\n", "▁", "ß"]) for _ in range(40)) for _ in range(60)]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        ids = ids.tolist()
        assert ids == (lattice(vocabulary, " " + text) if text else [])
        assert encoder.decode(ids) == text


def test_ids_are_given_out_early_and_the_window_stays_small(vocabulary):
    rng, search, widest = random.Random(8), StreamingViterbi(vocabulary), 0
    words = [p.strip() for p in rng.sample(list(vocabulary.pieces), 300)]
    text, given = "".join(rng.choice(words) for _ in range(1500)), []
    for k in range(0, len(text), 37):
        given += search.push(text[k : k + 37])
        widest = max(widest, len(search.chars))
    early = len(given)
    given += search.finish()
    assert given == lattice(vocabulary, text)
    assert early > 0.95 * len(given) and widest <= 12 * vocabulary.max_piece


def test_round_trip_of_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = encode(df, MODEL)
    assert out.where("not round_trip").count() == 0 and out.count() == df.count()
    back = decode(out, MODEL).withColumnRenamed("text", "again")
    assert back.join(df, "doc_id").where("text = again").count() == df.count()


def test_edge_rows(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "a", ""), (99, None, ""), (1, " ", "")], "doc_id long, text string, ids string")
    got = encode(df, MODEL).collect()
    assert len(got) == len(TEXTS) + 3
    assert all(r.round_trip for r in got if r.doc_id != 99)
    assert [(r.ids, r.n_ids, r.round_trip) for r in got if r.doc_id == 99] == [(None, None, None)]
    assert encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_kept_words_stay_few(vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "CACHE_WORDS", 100)
    encoder, plain = Encoder(vocabulary), Encoder(vocabulary)
    for k in range(6):
        texts = [" ".join(f"word{j}" for j in range(60 * k, 60 * k + 90))]
        got = encoder.encode_all(texts)[0].tolist()
        plain.clear()
        assert got == plain.encode_all(texts)[0].tolist() == lattice(vocabulary, " " + texts[0])
        assert len(encoder) <= 100


def test_a_batch_is_split_into_words_piece_by_piece(spark):
    given = {}
    frame = SimpleNamespace(sparkSession=spark, select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: given.update(run=run)))
    encode(frame, MODEL)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(["the cat sat on a mat " * 150] * 1500)], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in given["run"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 1500 and peak < 75, peak


def odd_texts(rng, n):
    words = ["the", "a", ".", ",", "b.c,d", "12.5", "x1.y", "é.", "ß,", "ɏ.z", "ɐ.z", "×.q", "漢.", "字", "😀.", "\t", "\x00", "▁", "Zq" * 40, "İ", "_.", "...", " ", "  ", "\n", "\r\n", "�"]
    return ["".join(rng.choice(words) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_segments_of_bytes_are_those_of_texts():
    texts = [" " + t for t in TEXTS + odd_texts(random.Random(2), 400) if t]
    rows = np.cumsum([0] + [len(t.encode()) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = segment_starts(data, rows[:-1]).tolist()
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert got == [w for t in texts for w in _SEGMENT.findall(t)]


@pytest.mark.parametrize("most", [1 << 19, 50])
def test_columns_are_encoded_like_texts(vocabulary, monkeypatch, most):
    monkeypatch.setattr(sentencepiece_codec, "COLUMN_WORDS", most)
    texts = TEXTS + [None] + odd_texts(random.Random(3), 300)
    plain, columns = Encoder(vocabulary), ColumnEncoder(vocabulary)
    for part in (texts, texts[7:150], [None, ""], [], texts[100:]):
        ids, bounds = columns.encode(pa.array(["skipped", *part], pa.string()).slice(1))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x.tolist() for x in plain.encode_all([t or "" for t in part])]


def test_a_word_is_searched_for_once(vocabulary, monkeypatch):
    searched, own = [], Encoder.paths
    monkeypatch.setattr(Encoder, "paths", lambda self, chars: searched.append(chars.shape[1]) or own(self, chars))
    encoder = ColumnEncoder(vocabulary)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(150_000)]  # more than ``CACHE_WORDS``
    for _ in range(2):
        for first in range(0, len(words), 50_000):
            encoder.encode(pa.array([" ".join(words[first : first + 50_000])]))
    assert sum(searched) <= len(set(words))


def test_places_of_keys():
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    rng.shuffle(keys)
    keys[0] = 0
    places = arrays.Places()
    assert places.find(keys[:5]).tolist() == [-1] * 5
    for first in range(0, 10_000, 700):
        last = min(first + 700, 10_000)
        places.add(keys[first:last], np.arange(first, last, dtype=np.int32))
    assert (places.find(keys[:10_000]) == np.arange(10_000)).all() and (places.find(keys[10_000:]) == -1).all()
    places.add(keys[:0], np.zeros(0, np.int32))
    assert len(places.find(keys[:0])) == 0
