"""Scores of a small causal self-attention model over subword ids, beside a unigram base over words.

Texts are encoded once (A-Z in lower case) and staged. Counts of pieces and of words cover all training documents. The
model gives the class of the next piece from up to ``window`` pieces before it: one attention head with relative
positions over learned embeddings. Its weights start from a short run over a sample on the driver; then each task goes
on from there over every piece of its training documents, and the weights of the tasks are averaged by the pieces they
have seen. The piece within its class follows the counts of all training documents, so the whole is a probability of
the piece sequence and its end.
Long texts are scored in overlapping windows: every piece once, with at least half a window before it.

The base needs the count of every word: the ``head_words`` most frequent ones are broadcast, the rest are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm import arrays
from forgelens.llm.sentencepiece_codec import CHUNK_BYTES, ColumnEncoder, Vocabulary, read_vocabulary
from forgelens.llm.staging import staged


@dataclass(frozen=True)
class Fit:
    sample_documents: int = 400  # bound of the documents that start the attention weights; all documents train them after that
    sample_pieces: int = 400_000  # and of their pieces: an equal share of each document, from a place given by its hash
    head_words: int = 1 << 16
    width: int = 16
    window: int = 16
    classes: int = 64
    steps: int = 500
    batch: int = 64
    pass_batch: int = 256  # windows of a step in the pass over all documents
    rate: float = 0.08
    chunk_bytes: int = 2 << 20  # of text whose words are found at once: bounds a worker's memory


@dataclass
class Attention:
    """Weights by name, the class of every symbol, and its log probability within the class."""

    weights: dict[str, np.ndarray]
    group: np.ndarray
    within: np.ndarray
    window: int


# Symbols: the ids of the vocabulary, then the end, then the begin (never predicted).


def grouped(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Half of the classes hold one frequent symbol each, the others equal shares of the rest; add-one within."""
    order = np.argsort(-counts, kind="stable")
    group = np.empty(len(counts), dtype=np.int32)
    single = min(classes // 2, len(counts))
    group[order[:single]] = np.arange(single)
    rest = order[single:]
    mass = np.cumsum(counts[rest] + 1.0)
    if len(rest):
        group[rest] = single + np.minimum((mass - counts[rest] - 1) / mass[-1] * (classes - single), classes - single - 1).astype(np.int32)
    total = np.bincount(group, counts + 1.0, minlength=classes)
    return group, np.log((counts + 1.0) / total[group]).astype(np.float64)


def relative_mask(bias: np.ndarray) -> np.ndarray:
    n = len(bias)
    back = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(back >= 0, bias[np.maximum(back, 0)], np.float32(-1e9)).astype(np.float32)


def exponentials(x: np.ndarray, again: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of ``x``, in place, less a number for each row, their sums by row, and those numbers.

    The numbers are 0 unless a sum nears the ends of the range; then they are the largest of the rows, which cost more
    to find than all else, and ``again`` makes ``x`` anew."""
    ones, off = np.ones(x.shape[-1], x.dtype), np.zeros(x.shape[:-1], x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        sums = np.exp(x, out=x) @ ones
    if sums.size and not (sums.min() > 1e-30 and sums.max() < 1e30):
        x = again()
        off = x.max(axis=-1)
        x -= off[..., None]
        sums = np.exp(x, out=x) @ ones
    return x, sums, off


def plus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In place, for a fresh product: no second array of its size."""
    x += y
    return x


BLOCK_ROWS = 256  # of a long factor: products of this size take half the time of one over all rows


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y`` for many rows of ``x`` and a small ``y``, block by block."""
    y = np.ascontiguousarray(y)
    whole = len(x) // BLOCK_ROWS * BLOCK_ROWS
    out = np.empty((len(x), y.shape[1]), np.result_type(x, y))
    np.matmul(x[:whole].reshape(-1, BLOCK_ROWS, x.shape[1]), y, out=out[:whole].reshape(-1, BLOCK_ROWS, y.shape[1]))
    np.matmul(x[whole:], y, out=out[whole:])
    return out


def cross(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` for many rows, block by block."""
    whole = len(x) // BLOCK_ROWS * BLOCK_ROWS
    blocks = (m[:whole].reshape(-1, BLOCK_ROWS, m.shape[1]) for m in (x, y))
    return (next(blocks).transpose(0, 2, 1) @ next(blocks)).sum(axis=0) + x[whole:].T @ y[whole:]


def sorted_places(ids: np.ndarray, symbols: int) -> np.ndarray:
    """Stable order of the ids; 16 bits are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if symbols <= 1 << 16 else ids, axis=None, kind="stable")


def step(w: dict[str, np.ndarray], seen: dict[str, np.ndarray], group: np.ndarray, ids: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of AdaGrad in place, over windows of symbols and the symbols after them; the begin is no target."""
    n, d = len(w["r"]), w["e"].shape[1]
    back = np.arange(n)[:, None] - np.arange(n)[None, :]
    lower = back >= 0
    real = (target != len(group)).reshape(-1)
    wanted = group[np.where(real, target.reshape(-1), 0)]
    share = real / np.float32(max(1, real.sum()))
    flat = lambda m: m.reshape(-1, m.shape[-1])
    # Scores are x (q k') x' and values (a x) v: fewer products than with the vectors q, k and v of every symbol.
    root = np.float32(d**0.5)
    pair = w["q"] @ w["k"].T / root
    x = w["e"].take(ids, axis=0)
    turned = np.ascontiguousarray(x.transpose(0, 2, 1))
    y = product(flat(x), pair).reshape(x.shape)
    mask = relative_mask(w["r"])
    likeness = lambda: plus(y @ turned, mask)
    a, sums, _ = exponentials(likeness(), likeness)
    a /= sums[..., None]
    z = a @ x
    h = plus(product(flat(z), w["v"]), flat(x))
    logits = lambda: plus(product(h, w["c"]), w["b"])
    p, sums, _ = exponentials(logits(), logits)
    scale = (share / sums)[:, None]  # of the rows of p, put on narrower factors
    p.reshape(-1)[np.arange(len(p)) * p.shape[1] + wanted] -= sums
    dh = product(p, w["c"].T)
    dh *= scale
    dz = product(dh, w["v"].T).reshape(x.shape)
    ds = dz @ turned
    ds -= np.einsum("wij,wij->wi", ds, a)[..., None]
    ds *= a
    dy = ds @ x
    dx = plus(plus(plus(product(flat(dy), pair.T), dh), flat(ds.transpose(0, 2, 1) @ y)), flat(a.transpose(0, 2, 1) @ dz))
    dpair = cross(flat(x), flat(dy)) / root
    h *= scale
    slopes = {
        "q": dpair @ w["k"],
        "k": dpair.T @ w["q"],
        "v": cross(flat(z), dh),
        "c": cross(h, p),
        "b": scale[:, 0] @ p,
        "r": np.bincount(back[lower], ds.sum(axis=0)[lower], minlength=n),
    }
    for name, slope in slopes.items():
        slope = slope.astype(np.float32)
        seen[name] += slope * slope
        w[name] -= np.float32(rate) * slope / np.sqrt(seen[name])
    order = sorted_places(ids, len(w["e"]))
    sorted_ids = ids.reshape(-1)[order]
    first = np.flatnonzero(np.append(True, sorted_ids[1:] != sorted_ids[:-1]))
    own, slope = sorted_ids[first], np.add.reduceat(dx.take(order, axis=0), first, axis=0)
    squares = plus(seen["e"].take(own, axis=0), slope * slope)
    seen["e"][own] = squares
    w["e"][own] -= np.float32(rate) * slope / np.sqrt(squares)


def stream_of(sequences: list[np.ndarray], symbols: int) -> np.ndarray:
    """Each sequence between the begin and the end, one after the other."""
    end, begin = symbols - 2, symbols - 1
    return np.concatenate([np.concatenate([[begin], s, [end]]) for s in sequences]) if sequences else np.zeros(0, np.int64)


@dataclass
class Training:
    """An attention model together with the squared slopes that scale its next steps."""

    model: Attention
    seen: dict[str, np.ndarray]


def start_attention(sequences: list[np.ndarray], counts: np.ndarray, fit: Fit) -> Training:
    """``sequences``: symbols of sample documents; ``counts``: of every symbol but the begin, over all training documents."""
    rng = np.random.default_rng(11)
    group, within = grouped(counts, fit.classes)
    symbols, d, n = len(counts) + 1, fit.width, fit.window
    w = {
        "e": rng.normal(0, 0.1, (symbols, d)),
        "q": rng.normal(0, d**-0.5, (d, d)),
        "k": rng.normal(0, d**-0.5, (d, d)),
        "v": rng.normal(0, d**-0.5, (d, d)),
        "r": np.zeros(n),
        "c": rng.normal(0, 0.1, (d, fit.classes)),
        "b": np.log(np.bincount(group, counts + 1.0, minlength=fit.classes) / (counts + 1.0).sum() + 1e-12),
    }
    w = {name: x.astype(np.float32) for name, x in w.items()}
    seen = {name: np.full(x.shape, 1e-3, np.float32) for name, x in w.items()}
    stream = stream_of(sequences, symbols)
    if len(stream) > n + 1:
        for _ in range(fit.steps):
            at = rng.integers(0, len(stream) - n, fit.batch)[:, None] + np.arange(n + 1)
            step(w, seen, group, stream[at[:, :-1]], stream[at[:, 1:]], fit.rate)
    return Training(Attention(w, group, within, n), seen)


def train_attention(sequences: list[np.ndarray], counts: np.ndarray, fit: Fit) -> Attention:
    return start_attention(sequences, counts, fit).model


def train_on_all(w: dict[str, np.ndarray], seen: dict[str, np.ndarray], group: np.ndarray, sequences: list[np.ndarray], fit: Fit, rng: np.random.Generator) -> np.ndarray:
    """Steps in place in which every symbol of the sequences, and every end, is a target once; returns the inputs."""
    n, begin = len(w["r"]), len(group)
    stream = stream_of(sequences, begin + 1)
    inputs, targets = stream[:-1], stream[1:]
    pad = -len(inputs) % n
    ids, wanted = (np.append(x, np.full(pad, begin)).reshape(-1, n) for x in (inputs, targets))
    order = rng.permutation(len(ids))
    for at in range(0, len(order), fit.pass_batch):
        rows = order[at : at + fit.pass_batch]
        step(w, seen, group, ids[rows], wanted[rows], fit.rate)
    return inputs


def id_type(symbols: int) -> np.dtype:
    """Of the numbers in which ids are staged, as bytes: a list column costs more time than the ids take to find."""
    return np.dtype("<u2" if symbols <= 1 << 16 else "<i4")


def staged_ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a batch and the bounds of the rows."""
    data, bounds = arrays.utf8(column)
    return data.view(kind), bounds // kind.itemsize


def id_counts(learning: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs; each task gives at most one row an id."""
    kind = id_type(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            total += np.bincount(staged_ids(batch.column("ids"), kind)[0], minlength=symbols)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["id", "n"])

    counts = np.zeros(symbols)
    for r in learning.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


_DENSE = ("q", "k", "v", "c", "b", "r")


def _dense_rows(w: dict[str, np.ndarray]) -> np.ndarray:
    """All weights but the embeddings, in rows of the width of those."""
    d = w["e"].shape[1]
    flat = np.concatenate([w[name].reshape(-1) for name in _DENSE]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % d)).reshape(-1, d)


def train_over_documents(learning: DataFrame, start, fit: Fit) -> Attention:
    """Goes on from ``start`` (a broadcast Training) over the ids of all documents, in each task apart, and averages: an
    embedding by the times its symbol was read, other weights by the pieces read. What reaches the driver is one row for
    each symbol and each ``width`` other weights, however many tasks there are."""
    d = fit.width
    names = ["key", "mass", *(f"v{k}" for k in range(d))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = start.value
        group = first.model.group
        w, seen = ({name: x.copy() for name, x in given.items()} for given in (first.model.weights, first.seen))
        rng, reads = np.random.default_rng(11), np.zeros(len(w["e"]), np.int64)
        for batch in batches:
            values, edges = staged_ids(batch.column("ids"), id_type(len(w["e"])))
            for at in range(0, batch.num_rows, 500):
                own = [values[a:b] for a, b in zip(edges[at : at + 500], edges[at + 1 : at + 501])]
                reads += np.bincount(train_on_all(w, seen, group, own, fit, rng), minlength=len(reads))
        own, dense = np.flatnonzero(reads), _dense_rows(w)
        if len(own):
            mass = np.append(reads[own], np.full(len(dense), reads.sum())).astype(np.float64)
            rows = np.concatenate([w["e"][own].astype(np.float64), dense]) * mass[:, None]
            keys = np.append(own, len(reads) + np.arange(len(dense)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(mass), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(d))], names=names)

    schema = "key long, mass double, " + ", ".join(f"v{k} double" for k in range(d))
    sums = learning.select("ids").mapInArrow(run, schema).groupBy("key").agg(F.sum("mass"), *(F.sum(f"v{k}") for k in range(d))).collect()
    model = start.value.model
    weights, dense = {name: x.copy() for name, x in model.weights.items()}, _dense_rows(model.weights)
    symbols = len(weights["e"])
    for key, mass, *row in sums:
        target = weights["e"] if key < symbols else dense
        target[key if key < symbols else key - symbols] = np.array(row) / mass
    at, flat = 0, dense.reshape(-1)
    for name in _DENSE:
        size = weights[name].size
        weights[name] = flat[at : at + size].reshape(weights[name].shape).astype(np.float32)
        at += size
    return Attention(weights, model.group, model.within, model.window)


class Scorer:
    """Log10 probabilities of symbol sequences."""

    def __init__(self, model: Attention) -> None:
        w = model.weights
        self.model, self.mask = model, relative_mask(w["r"])
        self.e, self.v = w["e"], w["v"]
        self.y = w["e"] @ (w["q"] @ w["k"].T / np.float32(w["e"].shape[1] ** 0.5))
        self.c, self.b = w["c"], w["b"]

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Sums over each sequence and its end."""
        end, begin = len(self.model.group) - 1, len(self.model.group)
        out = np.zeros(len(sequences))
        n, half = self.model.window, self.model.window // 2
        sizes = np.array([len(s) + 1 for s in sequences], dtype=np.int64)
        if not len(sizes):
            return out
        offsets = np.cumsum(sizes) - sizes
        inputs, targets = np.full(sizes.sum() + n, end, np.int64), np.empty(sizes.sum(), np.int64)
        for s, o in zip(sequences, offsets, strict=True):
            inputs[o], inputs[o + 1 : o + len(s) + 1] = begin, s
            targets[o : o + len(s)], targets[o + len(s)] = s, end
        wanted, gained = self.model.group[targets], self.model.within[targets]
        later = np.maximum(0, -(-(sizes - n) // (n - half)))  # windows after the first
        row = np.repeat(np.arange(len(sizes)), later)
        step = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later) + 1
        ends = offsets + sizes
        for starts, last, first in ((offsets, ends, 0), (offsets[row] + step * (n - half), ends[row], half)):
            for at in range(0, len(starts), 512):
                self._windows(starts[at : at + 512], last[at : at + 512], first, inputs, wanted, gained)
        return np.add.reduceat(gained, offsets) / np.log(10)

    def _windows(self, starts: np.ndarray, ends: np.ndarray, first: int, inputs: np.ndarray, wanted: np.ndarray, gained: np.ndarray) -> None:
        """Adds what the positions of each window from ``first`` on gain by their classes."""
        n, d = self.model.window, self.e.shape[1]
        places = starts[:, None] + np.arange(n)
        ids = inputs[places]
        x = self.e.take(ids, axis=0)
        y, turned = self.y.take(ids[:, first:], axis=0), np.ascontiguousarray(x.transpose(0, 2, 1))
        likeness = lambda: plus(y @ turned, self.mask[first:])
        a, sums, _ = exponentials(likeness(), likeness)
        a /= sums[..., None]
        z = a @ x
        places = places[:, first:]
        good = np.flatnonzero(places < ends[:, None])
        at = places.reshape(-1)[good]
        h = plus(product(z.reshape(-1, d).take(good, axis=0), self.v), x[:, first:].reshape(-1, d).take(good, axis=0))
        logits = lambda: plus(product(h, self.c), self.b)
        all_ = logits()
        own = all_.reshape(-1)[np.arange(len(at)) * all_.shape[1] + wanted[at]]
        _, sums, off = exponentials(all_, logits)
        gained[at] += own - (np.log(sums) + off)


def summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once, with the sum of its counts."""
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else order
    return words[first], np.add.reduceat(counts, first) if len(words) else counts


def word_counts(documents: DataFrame, fit: Fit) -> DataFrame:
    """(word, n) over the documents: words by their hashes, counted in each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = arrays.utf8(batch.column("text"))
            found = []
            for first, last in arrays.chunks(bounds, fit.chunk_bytes):
                own = bounds[first : last + 1]
                _, _, hashes, _ = arrays.words_of(data[own[0] : own[-1]], own - own[0], lower=True)
                found.append(np.unique(hashes, return_counts=True))
            if found:
                words, counts = summed(np.concatenate([w for w, _ in found]), np.concatenate([n for _, n in found]))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    return documents.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rest(at: np.ndarray, logs: np.ndarray, words: np.ndarray, before: np.ndarray) -> list[pa.Array]:
    """By row: number of words, words and log10 sums of the head, and the other words with their numbers. ``at``: the
    place of each word in the head, or -1."""
    rows = len(before) - 1
    row = np.repeat(np.arange(rows), np.diff(before))
    known = at >= 0
    sums = np.bincount(row[known], logs[at[known]], minlength=rows)
    hits = np.bincount(row[known], minlength=rows)
    rest_row, rest_word = row[~known], words[~known]
    order = np.lexsort((rest_word, rest_row))
    rest_row, rest_word = rest_row[order], rest_word[order]
    new = np.flatnonzero(np.concatenate([[True], (rest_row[1:] != rest_row[:-1]) | (rest_word[1:] != rest_word[:-1])])) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(order)))
    edges = pa.array(np.searchsorted(rest_row[new], np.arange(rows + 1)).astype(np.int32))
    lists = (pa.ListArray.from_arrays(edges, pa.array(x)) for x in (rest_word[new], times))
    return [pa.array(np.diff(before)), pa.array(hits), pa.array(sums.astype(np.float64)), *lists]


_PREPARED = "doc_id long, held_out boolean, learns boolean, ids binary, n_words long, hits long, sums double, words array<long>, times array<long>"


def _prepared(documents: DataFrame, vocabulary, head) -> DataFrame:
    """Piece ids of each text in lower case, and what its words give for the base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = ColumnEncoder(vocabulary.value), id_type(len(vocabulary.value.texts) + 2)
        names, logs = head.value
        places = arrays.Places()
        places.add(names.view(np.uint64), np.arange(len(names), dtype=np.int32))
        for batch in batches:
            for first, last in arrays.chunks(arrays.utf8(batch.column("text"))[1], CHUNK_BYTES):
                part = batch.slice(first, last - first)
                ids, bounds = encoder.encode(pc.ascii_lower(part.column("text")))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * kind.itemsize), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                _, _, hashes, before = arrays.words_of(*arrays.utf8(part.column("text")), lower=True)
                base = _rest(places.find(hashes), logs, hashes.view(np.int64), before)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "held_out", "learns")), packed, *base],
                    names=["doc_id", "held_out", "learns", "ids", "n_words", "hits", "sums", "words", "times"],
                )

    return documents.select("doc_id", "held_out", "learns", "text").mapInArrow(run, _PREPARED)


def score_documents(documents: DataFrame, model_path: str, fit: Fit = Fit()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_pieces.

    Training documents are those whose crc32 of the id (as text) modulo 7 is not 2. A null text is an empty one: its
    only token is the end. Rows without an id are scored, not learnt from, and not held out. Repeated rows count and are
    scored each. Without any training document all counts are 0. Other columns are ignored.
    """
    spark = documents.sparkSession
    vocabulary: Vocabulary = read_vocabulary(model_path)
    shared = spark.sparkContext.broadcast(vocabulary)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    marked = documents.select("doc_id", held.alias("held_out"), (F.col("doc_id").isNotNull() & ~held).alias("learns"), "text")

    words = staged(word_counts(marked.where("learns"), fit), "words")
    trained = marked.where("learns").count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    total, distinct = total + trained, distinct + (trained > 0)
    top = sorted((r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(fit.head_words).collect())
    head = spark.sparkContext.broadcast((np.array([w for w, _ in top], np.int64), np.log10(np.array([n for _, n in top], np.float64) + 1)))

    # Rows are numbered as they are written: all later steps read those numbers.
    parts = staged(_prepared(marked, shared, head).withColumn("row", F.monotonically_increasing_id()), "pieces")
    learning = parts.where("learns")
    kind = id_type(len(vocabulary.texts) + 2)
    counts = id_counts(learning, len(vocabulary.texts) + 2)[:-1]
    counts[-1] = trained
    chosen = learning.select("row", "doc_id").orderBy(F.xxhash64("doc_id"), "row").limit(fit.sample_documents).select("row")
    share = max(fit.window + 1, fit.sample_pieces // fit.sample_documents)
    n_ids = (F.octet_length("ids") / kind.itemsize).cast("int")
    place = F.pmod(F.xxhash64("row"), F.greatest(n_ids - share + 1, F.lit(1))).cast("int")
    part = F.substr("ids", place * kind.itemsize + 1, F.lit(share * kind.itemsize))
    sample = [np.frombuffer(r["ids"], kind).astype(np.int64) for r in learning.join(F.broadcast(chosen), "row").orderBy("row").select(part.alias("ids")).toLocalIterator()]
    start = spark.sparkContext.broadcast(start_attention(sample, counts, fit))
    model = spark.sparkContext.broadcast(train_over_documents(learning, start, fit))

    rest = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times").withColumnRenamed("words", "word")
    tail = rest.join(words, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("sum"))

    kept = ("row", "doc_id", "held_out", "n_words", "hits", "sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            values, edges = staged_ids(batch.column("ids"), kind)
            for first in range(0, batch.num_rows, 500):
                last = min(first + 500, batch.num_rows)
                own = [values[a:b] for a, b in zip(edges[first:last], edges[first + 1 : last + 1], strict=True)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array([len(x) for x in own], pa.int64()), pa.array(scorer.score(own))],
                    names=[*kept, "n_pieces", "score"],
                )

    scored = parts.select(*kept, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_words long, hits long, sums double, n_pieces long, score double")
    out = scored.join(tail, "row", "left")
    tokens, known = F.col("n_words") + 1, F.col("hits") + F.coalesce("more", F.lit(0)) + int(trained > 0)
    base = F.col("sums") + F.coalesce("sum", F.lit(0.0)) + float(np.log10(trained + 1)) - tokens * float(np.log10(total + distinct + 1))
    return out.select("doc_id", "held_out", tokens.alias("n_tokens"), known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_pieces")
