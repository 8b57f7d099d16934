"""SimHash near-dedup by an inverted index over byte positions.

A fingerprint is eight positional bytes. Two fingerprints with at most four differing bits differ in at most four bytes,
so they share at least four positional bytes. Postings are kept for sets of positions: ``COVER`` has 20 triples so that
any four positions contain one of them, hence every such pair meets in some posting list. There the shared positional
bytes of each pair are tallied, pairs below the guaranteed count are dropped, and the others are verified by their
differing bits. Only distinct fingerprints are posted, so exact copies never meet.

A list with more than ``crowd`` fingerprints is not paired. It is split by a fourth position (its pairs share one more
byte), and where that leaves lists that are still crowded, their fingerprints are posted under all points within two bits:
fingerprints at most four bits apart share such a point, and all that share one are linked with each other, so each is
linked with the least one of the point. A point has 2,081 fingerprints at most, whatever the data, and the work is
proportional to the fingerprints. All three ways are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm.components import components
from forgelens.llm.staging import shuffle_partitions, staged

POSITIONS = 8
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _cover() -> tuple[tuple[int, ...], ...]:
    """Triples of positions, one of which lies in any four positions: Turan's construction on a circle of three groups."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for k in range(3):
        out += [(*pair, other) for pair in combinations(groups[k], 2) for other in groups[(k + 1) % 3]]
    return tuple(tuple(sorted(t)) for t in out)


COVER = _cover()
QUADS = tuple(combinations(range(POSITIONS), 4))


@dataclass(frozen=True)
class SimHash:
    width: int = 4  # words of a shingle
    seed: int = 42
    differ: int = 4  # links: at most so many differing bits; the cover of positions belongs to four
    crowd: int = 512  # posting lists above this size are split further instead of being paired
    chunk_shingles: int = 1 << 17  # hashes tallied at once


def fingerprints_of(texts: list[bytes | None], how: SimHash) -> np.ndarray:
    """The fingerprint of each text; hashes are tallied in bounded chunks, so a text may be of any length."""
    digest, seed, width = xxhash.xxh64_intdigest, how.seed, how.width
    sizes = np.zeros(len(texts), dtype=np.int64)
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    hashes: list[int] = []
    rows: list[int] = []
    starts: list[int] = []

    def tally() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, np.array(rows), np.add.reduceat(bits, np.array(starts), axis=0, dtype=np.int64))
            hashes.clear(), rows.clear(), starts.clear()

    for row, text in enumerate(texts):
        words = text.translate(LOWER).split() if text else []
        if not words:
            continue
        data = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        width_here = min(width, len(words))
        n = sizes[row] = len(words) - width_here + 1
        begins = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
        stops = ends[width_here - 1 :].tolist()
        for first in range(0, n, how.chunk_shingles):
            rows.append(row), starts.append(len(hashes))
            hashes += [digest(data[a:b], seed) for a, b in zip(begins[first : first + how.chunk_shingles], stops[first : first + how.chunk_shingles], strict=True)]
            if len(hashes) >= how.chunk_shingles:
                tally()
    tally()
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def fingerprints(documents: DataFrame, how: SimHash) -> DataFrame:
    """(doc_id, print) of every row, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for first in range(0, batch.num_rows, 500):
                found = fingerprints_of(texts.slice(first, 500).to_pylist(), how)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, 500), pa.array(found, pa.int64())], names=["doc_id", "print"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, print long")


def postings(prints: DataFrame, sets: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(list, print): each fingerprint under the bytes it has at every set of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy()
            parts = own.astype("<i8").view(np.uint8).reshape(-1, POSITIONS).astype(np.int64)
            for number, places in enumerate(sets):
                key = np.full(len(own), number, dtype=np.int64)
                for place in places:
                    key = key << 8 | parts[:, place]
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("print")], names=["list", "print"])

    return prints.select("print").mapInArrow(run, "list long, print long")


def crowded_lists(posted: DataFrame, how: SimHash) -> DataFrame:
    return posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > how.crowd).select("list")


def _tallied(sets: tuple[tuple[int, ...], ...], how: SimHash):
    """Pairs of a posting list that share enough positional bytes and are close enough, from rows in order of the list."""
    least_shared = POSITIONS - how.differ
    # A pair meets in every set that lies within its shared positions; the first such set reports it.
    first_set = np.full(1 << POSITIONS, -1, dtype=np.int64)
    for mask in range(1 << POSITIONS):
        inside = (k for k, places in enumerate(sets) if all(mask >> p & 1 for p in places))
        first_set[mask] = next(inside, -1)
    shift = 8 * len(sets[0])
    weight = (1 << np.arange(POSITIONS)).astype(np.int64)

    def near(lists: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        step, at = 1, np.arange(max(len(lists) - 1, 0))
        while len(at := at[at + step < len(lists)]):
            at = at[lists[at] == lists[at + step]]
            a, b = prints[at], prints[at + step]
            mixed = a ^ b
            same = mixed.astype("<i8").view(np.uint8).reshape(-1, POSITIONS) == 0
            good = same.sum(axis=1) >= least_shared  # the tally of shared positional bytes
            good &= np.bitwise_count(mixed.view(np.uint64)) <= how.differ
            good &= first_set[same @ weight] == lists[at] >> shift
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[good]), pa.array(np.maximum(a, b)[good])], names=["a", "b"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            lists = np.concatenate([lists, batch.column("list").to_numpy()])
            prints = np.concatenate([prints, batch.column("print").to_numpy()])
            whole = int(np.searchsorted(lists, lists[-1])) if len(lists) else 0  # the last list may go on in the next batch
            yield from near(lists[:whole], prints[:whole])
            lists, prints = lists[whole:], prints[whole:]
        yield from near(lists, prints)

    return run


def paired(posted: DataFrame, sets: tuple[tuple[int, ...], ...], how: SimHash) -> DataFrame:
    """The links (a, b) within posting lists, none of which is crowded."""
    dealt = posted.repartition(shuffle_partitions(posted.sparkSession), "list").sortWithinPartitions("list")
    return dealt.mapInArrow(_tallied(sets, how), "a long, b long")


def around(prints: DataFrame) -> DataFrame:
    """The links of fingerprints with the least one of every point within two bits of them."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    two = [bits[i] | bits[j] for i, j in combinations(range(64), 2)]
    flips = np.concatenate([[np.uint64(0)], bits, np.array(two, dtype=np.uint64)]).view(np.int64)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy()
            for first in range(0, len(own), 64):
                part = own[first : first + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel()), pa.array(np.repeat(part, len(flips)))], names=["point", "print"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, least = None, None
        for batch in batches:
            where, own = batch.column("point").to_numpy(), batch.column("print").to_numpy()
            if not len(own):
                continue
            begins = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            heads = own[begins]
            if point == where[0]:
                heads[0] = least
            head = np.repeat(heads, np.diff(np.append(begins, len(own))))
            point, least = where[-1], head[-1]
            links = np.unique(np.stack([head, own], axis=1)[head != own], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    spread = prints.mapInArrow(points, "point long, print long")
    dealt = spread.repartition(shuffle_partitions(prints.sparkSession), "point").sortWithinPartitions("point", "print")
    return dealt.mapInArrow(stars, "a long, b long")


def links(prints: DataFrame, how: SimHash) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough of them to connect all that are at most ``differ`` bits apart."""
    triples = postings(prints, COVER)
    crowded = staged(crowded_lists(triples, how), "crowded")
    if crowded.isEmpty():
        return staged(paired(triples, COVER, how), "links")
    found = paired(triples.join(crowded, "list", "left_anti"), COVER, how)
    # Pairs of a crowded list share a fourth position too; the lists of all quadruples hold them.
    members = staged(triples.join(crowded, "list", "left_semi").select("print").distinct(), "members")
    quads = postings(members, QUADS)
    dense = staged(crowded_lists(quads, how), "dense")
    found = found.unionByName(paired(quads.join(dense, "list", "left_anti"), QUADS, how))
    if not dense.isEmpty():
        found = found.unionByName(around(quads.join(dense, "list", "left_semi").select("print").distinct()))
    return staged(found, "links")


def near_duplicates(documents: DataFrame, how: SimHash = SimHash()) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Words: A-Z in lower case, split at the six ASCII spaces; shingles with repeats; a text with fewer words is one
    shingle. A bit is set if more than half of the shingle hashes have it (a tie gives 0). Null and empty texts have
    fingerprint zero and are linked like any other. component_id is the least doc_id reachable over links. Rows without
    a doc_id take no part: their component_id is null. Rows that share a doc_id count each on their own. Bytes that are
    no UTF-8 are hashed as they are. Other columns are ignored.
    """
    rows = staged(fingerprints(documents, how), "prints")
    nodes = staged(rows.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, how)).withColumnRenamed("node", "print")
    placed = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    final = placed.join(placed.groupBy("root").agg(F.min("least").alias("component")), "root").select("print", "component")
    out = rows.join(final, "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), own.alias("component_id"))
