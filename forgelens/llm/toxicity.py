"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary text.

Each window (a word with its blanks, set between a head that both dictionaries hold and a fixed tail, so that it clears
the least gain of a block and the bytes at a block's end that are never matched) is compressed with either dictionary.
A window counts when it is short with the toxic dictionary and shorter than with the ordinary one; both thresholds are
calibrated on fit rows that the dictionaries have not seen, and so is the logistic score of a text's count.

The toxic dictionary takes the fit texts' windows that are far more frequent in toxic than in ordinary texts
(likelihood ratio above 1.5 times the logarithm of the number of distinct windows), the ordinary one the most frequent
windows of ordinary texts. Wider windows separate worse here: the distance of single words drowns in their neighbours.

A run of letters above the longest window (text without blanks, glued words) is no single word. It gives overlapping
windows of that length, and a window for every piece of a few characters in it, since words can begin anywhere.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm import arrays

HEAD, TAIL = b"<0a1b2c3d4e5f6g7h8i9j>", b"|#%&~^=+"
_WINDOW = re.compile(rb"[a-z\x80-\xff]+")
CUT = 0.7
#: Characters of the pieces of long runs; words of languages without blanks are of two to eight.
PIECE_CHARS = range(2, 9)
#: Windows whose lengths are computed at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Fit:
    """Bounds of the fit sample; everything else reads all rows."""

    toxic_rows: int = 1500
    ordinary_rows: int = 6000
    ordinary_windows: int = 20_000
    longest_window: int = 64


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    most_toxic: int  # largest length over the empty window's with the toxic dictionary
    least_gain: int  # least advantage over the ordinary dictionary
    weights: tuple[float, float, float]
    longest_window: int


def windows(text: str | None, longest: int) -> Iterator[bytes]:
    """Runs of letters; of a run above ``longest`` bytes all parts, cut between characters."""
    for m in _WINDOW.finditer((text or "").encode("utf-8", "surrogatepass").lower()):
        if m.end() - m.start() <= longest:
            yield m[0]
        else:
            yield from _parts_of_run(m[0], longest)


def _parts_of_run(run: bytes, longest: int) -> Iterator[bytes]:
    starts = [k for k, c in enumerate(run) if c & 0xC0 != 0x80] + [len(run)]
    first, count = 0, len(starts) - 1
    while first < count:
        last = max(first + 1, bisect.bisect_right(starts, starts[first] + longest) - 1)
        yield run[starts[first] : starts[last]]
        if last == count:
            break
        first = max(first + 1, (first + last) // 2)
    for size in PIECE_CHARS:
        for k in range(count - size + 1):
            yield run[starts[k] : starts[k + size]]


class Lengths:
    """Compressed lengths of windows with one dictionary, over that of an empty window."""

    def __init__(self, dictionary: bytes) -> None:
        import zstandard as z

        data = z.ZstdCompressionDict(dictionary + HEAD, dict_type=z.DICT_TYPE_RAWCONTENT)
        how = z.ZstdCompressionParameters(
            compression_level=3, strategy=z.STRATEGY_LAZY2, window_log=19, hash_log=17, chain_log=17, search_log=4, min_match=4, target_length=16, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        self.compressor, self.segments = z.ZstdCompressor(dict_data=data, compression_params=how), z.BufferWithSegments
        self.base = 0
        self.base = int(self.of([b""])[0])

    def of(self, found: list[bytes]) -> np.ndarray:
        if not found:
            return np.zeros(0, np.int64)
        framed = [HEAD + b" " + w + b" " + TAIL for w in found]
        sizes = np.array([len(f) for f in framed], dtype=np.uint64)
        places = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1)
        out = self.compressor.multi_compress_to_buffer(self.segments(b"".join(framed), places.tobytes()), threads=0)
        return np.array([len(out[k]) for k in range(len(out))]) - self.base


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.toxic, self.ordinary = Lengths(model.toxic), Lengths(model.ordinary)

    def lengths(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        toxic = self.toxic.of(found)
        return toxic, self.ordinary.of(found) - toxic

    def score(self, texts: list[str | None]) -> list[float]:
        hits, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        every = ((k, w) for k, t in enumerate(texts) for w in windows(t, self.model.longest_window))
        while True:
            names: dict[bytes, int] = {}  # each window once; the others are two numbers
            row, name = array("i"), array("i")
            for k, w in itertools.islice(every, BLOCK):
                row.append(k)
                name.append(names.setdefault(w, len(names)))
            if not row:
                break
            toxic, gain = self.lengths(list(names))
            good = (toxic <= self.model.most_toxic) & (gain >= self.model.least_gain)
            row, name = np.array(row), np.array(name)
            sizes += np.bincount(row, minlength=len(texts))
            hits += np.bincount(row[good[name]], minlength=len(texts))
        return logistic(features(hits, sizes), np.array(self.model.weights)).tolist()


def features(hits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Constant, number of counted windows (by steps that get smaller), and how many chances a text had."""
    return np.stack([np.ones(len(hits)), np.log1p(hits), np.log1p(sizes) / 10 * (hits > 0)], axis=1)


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def fitted_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps with a small ridge; the weights and the mean log loss."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = logistic(x, w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
        w += np.clip(step, -3, 3)
    p = np.clip(logistic(x, w), 1e-6, 1 - 1e-6)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def contrast(toxic: Counter, ordinary: Counter, p: int, n: int) -> list[bytes]:
    """Windows of toxic texts by rising frequency, as far as they stand out."""
    least = 1.5 * math.log(2 + len(toxic.keys() | ordinary.keys()))
    kept = []
    for w, a in toxic.items():
        b = ordinary.get(w, 0)
        if a * n > 10 * b * p:
            share = (a + b) / (p + n)
            ratio = 2 * (a * math.log(a / p / share) + (b * math.log(b / n / share) if b else 0.0))
            if ratio > least:
                kept.append((a, w))
    return [w for _, w in sorted(kept)]


def _joined(found: list[bytes]) -> bytes:
    return b"".join(b" " + w + b" " for w in found)


def fit_model(rows: list[tuple[str | None, int]], fit: Fit) -> Model | None:
    """None without rows of both labels. Thresholds come from dictionaries of two thirds of the rows, applied to the rest;
    the dictionaries of the model then take all."""
    rows = [(list(windows(t, fit.longest_window)), y) for t, y in rows]
    toxic, ordinary = [w for w, y in rows if y], [w for w, y in rows if not y]
    if len(toxic) < 2 or len(ordinary) < 2:
        return None
    scorer = Scorer(_dictionaries([x for i, x in enumerate(toxic) if i % 3 < 2], [x for i, x in enumerate(ordinary) if i % 3 < 2], fit))
    unseen = [(ws, y) for y, x in ((1.0, toxic), (0.0, ordinary)) for i, ws in enumerate(x) if i % 3 == 2 or len(x) < 3]
    names = sorted(set().union(*(ws for ws, _ in unseen)))
    lengths, gains = scorer.lengths(names)
    place = {w: i for i, w in enumerate(names)}
    at = [np.array([place[w] for w in ws], dtype=np.int64) for ws, _ in unseen]
    y, sizes = np.array([y for _, y in unseen]), np.array([len(ws) for ws, _ in unseen])
    best = None
    for most in range(1, 7):
        for least in range(1, 5):
            good = (lengths <= most) & (gains >= least)
            x = features(np.array([good[a].sum() for a in at]), sizes)
            w, loss = fitted_weights(x, y)
            if best is None or loss < best[0] - 1e-9:
                best = (loss, most, least, tuple(w.tolist()))
    return replace(_dictionaries(toxic, ordinary, fit), most_toxic=best[1], least_gain=best[2], weights=best[3])


def _dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], fit: Fit) -> Model:
    seen = [Counter(w for ws in x for w in set(ws)) for x in (toxic, ordinary)]
    common = sorted(seen[1], key=lambda w: (-seen[1][w], w))[: fit.ordinary_windows]
    return Model(_joined(contrast(*seen, len(toxic), len(ordinary))), _joined(common[::-1]), 0, 0, (0.0, 0.0, 0.0), fit.longest_window)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model | None:
    """Learns from labelled documents outside the held-out third, from a sample bounded by ``fit``."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = known.where("y = 1").orderBy(order).limit(fit.toxic_rows).unionByName(known.where("y = 0").orderBy(order).limit(fit.ordinary_rows))
    # At most toxic_rows + ordinary_rows ids are broadcast.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    found = sorted((r["doc_id"], r["text"], r["y"]) for r in rows.where("text is not null").collect())
    return fit_model([(t, y) for _, t, y in found], fit)


def score_toxicity(documents: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``CUT`` on).

    A null text is scored like an empty one; without a model every score is 0. held_out is false for a null id. Rows
    are independent, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
    scorer = Scorer(model) if model else None
    for batch in batches:
        _, bounds = arrays.utf8(batch.column("text"))
        for first, last in arrays.chunks(bounds, 8 << 20):
            part = batch.slice(first, last - first)
            yield part, scorer.score(part.column("text").to_pylist()) if scorer else [0.0] * part.num_rows


def without_toxic(documents: DataFrame, model: Model | None) -> DataFrame:
    """The same columns, without the rows whose score reaches ``CUT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _scored(batches, model):
            yield part.filter(pa.array([s < CUT for s in scores], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
