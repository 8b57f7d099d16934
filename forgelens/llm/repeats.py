"""Repeated windows found through difference-cover anchors, for words (substring dedup) and bytes (suffix blocks).

A window is ``width`` consecutive units of one document. Positions of a document whose number modulo ``period`` is in
the cover are hashed as anchors of ``width - period + 1`` units. For any two equal windows some shift below the period
puts both on cover positions, so they share an aligned anchor: a window without a shared anchor repeats nowhere. Only
windows around shared anchors are then named as wholes and compared by name.

Both comparisons go through ``_matched``: each task joins what it can in its own chunk first (a value that is common in
the chunk leaves it once), so a passage in a third of all documents costs a block one entry for each chunk, not for each
occurrence. Entries travel as packed arrays, dealt by value blocks; blocks can be handled in several passes, one range
of blocks at a time, so that no more than one pass is on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm import arrays
from forgelens.llm.staging import shuffle_partitions, staged
from forgelens.operators.skew import row_numbers

#: Bytes of a name that travel, besides the bits of its block (8 at least): anchors only select, windows are kept whole.
ANCHOR_BYTES, WINDOW_BYTES = 5, 7
_PACKED = "block int, solved boolean, values binary, docs binary, places binary, shared binary"
_PLACES = "doc_id long, tag int, places binary"


@dataclass(frozen=True)
class Rule:
    """What counts as a repeat: any other occurrence, or one in a document with a smaller id."""

    unit: str  # "word" or "byte"
    width: int
    period: int
    cover: tuple[int, ...]
    smaller_only: bool
    anchor_passes: int = 1
    window_passes: int = 1
    chunk_bytes: int = 3 << 20

    def __post_init__(self) -> None:
        differences = {(a - b) % self.period for a in self.cover for b in self.cover}
        if differences != set(range(self.period)) or self.width < self.period:
            raise ValueError("not a difference cover of the period, or the period exceeds the width")

    @property
    def anchor(self) -> int:
        return self.width - self.period + 1


def tagged(documents: DataFrame) -> DataFrame:
    """(doc_id, text, tag): the tag numbers the rows that carry one id, from 1; 0 where an id has one row.

    Rows of one id are numbered in blocks of bounded size, however many they are, from a table that is written once.
    """
    rows = documents.select("doc_id", "text")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if several.isEmpty():
        return rows.withColumn("tag", F.lit(0))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    repeated = rows.select("doc_id", "row").join(several, "doc_id", "left_semi")
    numbers = staged(row_numbers(repeated, ["doc_id"], "row", "number").select("row", F.col("number").cast("int").alias("number")), "numbers")
    return rows.join(numbers, "row", "left").select("doc_id", "text", F.coalesce("number", F.lit(0)).alias("tag"))


def units_of(data: np.ndarray, bounds: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The unit values of some rows and the number of units before each row."""
    if unit == "word":
        _, _, values, before = arrays.words_of(data, bounds)
        return values, before
    return arrays.BYTE_VALUES[data], bounds


def _chunks(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, bounds = arrays.utf8(batch.column("text"))
    for first, last in arrays.chunks(bounds, rule.chunk_bytes):
        own = bounds[first : last + 1]
        yield first, last, *units_of(data[own[0] : own[-1]], own - own[0], rule.unit)


def anchors_of(rule: Rule, blocks: int, part: int) -> Callable:
    """Packed anchors of every document long enough to hold a window."""
    cover = np.zeros(rule.period, dtype=bool)
    cover[list(rule.cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (np.asarray(batch.column(c)) for c in ("doc_id", "tag"))
            for first, _, values, before in _chunks(batch, rule):
                size = np.diff(before)
                row = np.repeat(np.arange(len(size), dtype=np.int32), size)
                place = (np.arange(len(values), dtype=np.int64) - before[:-1][row]).astype(np.int32)
                good = cover[place % rule.period]
                good &= place + rule.anchor <= size[row]
                good &= (size >= rule.width)[row]
                at = np.flatnonzero(good)
                names = arrays.window_hashes(values, rule.anchor, at) if len(at) else np.zeros(0, np.uint64)
                yield from _pack(names, ids[first + row[at]], place[at], tags[first + row[at]], False, blocks, rule.anchor_passes, part, ANCHOR_BYTES)

    return run


def windows_of(rule: Rule, blocks: int, part: int) -> Callable:
    """Packed names of the whole windows that hold a shared anchor (column ``places``: anchors of the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (np.asarray(batch.column(c)) for c in ("doc_id", "tag"))
            found = batch.column("places")
            for first, last, values, before in _chunks(batch, rule):
                edge = np.zeros(len(values) + 1, dtype=np.int32)
                for i in range(first, last):
                    at = _places(found[i].as_py()) + before[i - first]
                    low = np.maximum(at - (rule.width - rule.anchor), before[i - first])
                    high = np.minimum(at, before[i - first + 1] - rule.width)
                    low, high = low[low <= high], high[low <= high]
                    np.add.at(edge, low, 1)
                    np.add.at(edge, high + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                names = arrays.window_hashes(values, rule.width, at) if len(at) else np.zeros(0, np.uint64)
                row = np.searchsorted(before, at, side="right") - 1
                yield from _pack(names, ids[first + row], (at - before[row]).astype(np.int32), tags[first + row], rule.smaller_only, blocks, rule.window_passes, part, WINDOW_BYTES)

    return run


def _places(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(b, np.int32) for b in blobs]).astype(np.int64)


def _repeats(order: np.ndarray, values: np.ndarray, docs: np.ndarray, smaller: bool, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by value: which are repeats for certain, and which must still stand for their value."""
    v, d = values[order], docs[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    if smaller:
        least = np.minimum.reduceat(d, starts)[group]
        return d > least, d == least
    many = np.diff(np.append(starts, len(v)))[group] > 1
    if shared is not None:
        many |= np.maximum.reduceat(shared[order], starts)[group] > 0
    return many, new


def _pack(names: np.ndarray, docs: np.ndarray, places: np.ndarray, tags: np.ndarray, smaller: bool, blocks: int, passes: int, part: int, width: int) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(64 - blocks.bit_length() + 1)
    block = (names >> shift).astype(np.int32)
    if passes > 1:
        own = block % passes == part
        names, docs, places, tags, block = names[own], docs[own], places[own], tags[own], block[own]
    if not len(names):
        return
    packed = places.astype(np.int64) | (tags.astype(np.int64) << 32)
    order = np.argsort(names)
    repeat, stands = _repeats(order, names, docs, smaller)
    rows: list[tuple] = []
    solved = np.sort(order[repeat])
    if len(solved):
        rows.append((int(block[solved[0]]), True, b"", arrays.packed_steps(docs[solved]), arrays.split_bytes(packed[solved], 8), b""))
    sent = order[stands]
    shared = repeat[stands].astype(np.uint8)
    edges = np.flatnonzero(np.diff(block[sent])) + 1
    for own, flags in zip(np.split(sent, edges), np.split(shared, edges), strict=True):
        if len(own):
            back = np.argsort(own)  # by document and place: small differences
            own, flags = own[back], flags[back]
            rows.append((int(block[own[0]]), False, arrays.split_bytes(names[own], width), arrays.packed_steps(docs[own]), arrays.split_bytes(packed[own], 8), np.packbits(flags).tobytes()))
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "solved", "values", "docs", "places", "shared"])


def _resolve(smaller: bool, blocks: int, width: int) -> Callable:
    """Reads the blocks of one partition and gives the places of repeats, by document."""

    kept = min(8 * width, 64 - blocks.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, docs, places, shared, done_docs, done_places = [], [], [], [], [], []
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                d, p = arrays.from_steps(row["docs"]), arrays.joined_bytes(row["places"], 8).view(np.int64)
                if row["solved"]:
                    done_docs.append(d)
                    done_places.append(p)
                else:
                    # The block holds the high bits; what a name keeps beyond both is dropped for anchors only.
                    value = arrays.joined_bytes(row["values"], width) & np.uint64((1 << kept) - 1)
                    values.append(value | np.uint64(row["block"] << kept))
                    docs.append(d)
                    places.append(p)
                    shared.append(np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=len(d)))
        if values:
            v, d, p, s = (np.concatenate(x) for x in (values, docs, places, shared))
            values.clear()
            order = np.argsort(v)
            repeat, _ = _repeats(order, v, d, smaller, s)
            hit = order[repeat]
            done_docs.append(d[hit])
            done_places.append(p[hit])
        if done_docs:
            d, p = np.concatenate(done_docs), np.concatenate(done_places)
            order = np.lexsort((p, d))
            d, p = d[order], p[order]
            tag, place = (p >> 32).astype(np.int32), (p & 0xFFFFFFFF).astype(np.int32)
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])])) if len(d) else np.zeros(0, np.int64)
            for k in range(0, len(new), 4096):
                own = new[k : k + 4096]
                ends = np.append(new[k + 1 : k + 4097], len(d))[: len(own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[own], pa.int64()), pa.array(tag[own], pa.int32()), pa.array([place[a:b].tobytes() for a, b in zip(own, ends, strict=True)], pa.binary())],
                    names=["doc_id", "tag", "places"],
                )

    return run


def _matched(rows: DataFrame, pack: Callable[[int, int], Callable], passes: int, smaller: bool, label: str, width: int) -> DataFrame:
    """(doc_id, tag, places) of repeats among what ``pack`` makes of the rows, one staged pass after another."""
    blocks = 1 << max(8, (4 * shuffle_partitions(rows.sparkSession) * passes - 1).bit_length())
    out = None
    for part in range(passes):
        packed = rows.mapInArrow(pack(blocks, part), _PACKED)
        # Many small partitions: a task holds its entries at once.
        found = packed.repartition(4 * shuffle_partitions(rows.sparkSession), "block").mapInArrow(_resolve(smaller, blocks, width), _PLACES)
        if passes > 1:
            found = staged(found, label)
        out = found if out is None else out.unionByName(found)
    return out


def _gathered(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id", "tag").agg(F.collect_list("places").alias("places"))


def repeated_windows(rows: DataFrame, rule: Rule, left_out: DataFrame | None = None) -> DataFrame:
    """(doc_id, tag, places): the starts of repeated windows, as lists of packed arrays of 4-byte numbers.

    ``rows``: (doc_id, text, tag). ``left_out``: (doc_id, tag) of documents whose windows are settled already. Documents without an id take no part.
    """
    texts = rows.where("doc_id is not null and text is not null")
    anchors = staged(_gathered(_matched(texts, lambda b, k: anchors_of(rule, b, k), rule.anchor_passes, False, "anchors", ANCHOR_BYTES)), "anchors")
    if left_out is not None:
        anchors = anchors.join(left_out, ["doc_id", "tag"], "left_anti")
    near = texts.join(anchors, ["doc_id", "tag"])
    if rule.window_passes > 1:
        near = staged(near, "near")
    windows = _matched(near, lambda b, k: windows_of(rule, b, k), rule.window_passes, rule.smaller_only, "windows", WINDOW_BYTES)
    return staged(_gathered(windows), "windows")
