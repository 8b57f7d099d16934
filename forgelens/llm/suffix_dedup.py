"""Suffix-array dedup over bytes: what an earlier document holds already is removed.

Every string of ``width`` bytes is dealt by the least (by hash) of the ``period`` shorter strings in it, its seed, so
equal strings have the same seed at the same place. Neighbours with one seed travel as one stretch: a stretch of k
strings holds width + k - 1 bytes, and there is one for about eleven strings. First only the names of seeds and
stretches are sent: whole stretches that an earlier document has too are settled so, and a seed of one document is done.
Of the rest, the bytes of each distinct stretch of a seed are sent once, for its least document, and their suffixes are
sorted by content, block by block: neighbours that agree in ``width`` bytes are one run of the array, whose least document
keeps its bytes. Strings of a seed with very many stretches are dealt to blocks one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm import arrays
from forgelens.llm.repeats import Rule, tagged
from forgelens.llm.staging import shuffle_partitions, staged

#: Seeds are the least of 21 strings of 30 bytes in each 50. The cover is not used here.
BYTE_RULE = Rule(unit="byte", width=50, period=21, cover=(0, 1, 4, 14, 16), smaller_only=True, chunk_bytes=1 << 20)

_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string"
#: Stretches of one seed that are compared by one task; strings of a more common seed are dealt by their own names.
CROWD = 4096
#: Bytes of the names that travel: of a seed, besides the bits of its block (8 at least), and of a stretch of that seed.
_SEED_BYTES, _STRETCH_BYTES = 7, 7
_NAMED = "block int, solved boolean, seeds binary, names binary, docs binary, places binary, sizes binary"
_RUNS = "doc_id long, tag int, open boolean, runs binary"
_BYTES = "block int, seeds binary, docs binary, places binary, sizes binary, text binary"
_RUN = np.dtype([("place", "<i4"), ("size", "<i4")])
_OPEN = np.dtype([("seed", "<u8"), ("place", "<i4"), ("size", "<i4"), ("crowded", "?")])


def stretches(data: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, hash of the seed and hash of the bytes of each stretch; none crosses a row."""
    none = np.zeros(0, np.int64)
    if len(data) < rule.width:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    names = arrays.window_hashes(arrays.BYTE_VALUES[data], rule.anchor)
    value, place, length = names, np.arange(len(names), dtype=np.int32), 1
    while length < rule.period:
        step = min(length, rule.period - length)
        later = value[step:] < value[:-step]  # of equals the first
        place = np.where(later, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        length += step
    low, high = bounds[:-1], bounds[1:] - rule.width + 1
    edge = np.zeros(len(place) + 1, dtype=np.int32)
    np.add.at(edge, low[low < high], 1)
    np.add.at(edge, high[low < high], -1)
    place = np.where(np.cumsum(edge[:-1]) > 0, place, -1)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    size = np.diff(np.append(first, len(place)))
    good = place[first] >= 0
    first, size = first[good], size[good]
    # Least hashes are small numbers: mixed again, they spread over all blocks.
    return first, size, arrays.mixed(names[place[first]]), arrays._span_hashes(data, first, first + size + rule.width - 1)


def _first_of(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _blocks(df: DataFrame, passes: int) -> int:
    return 1 << max(8, (4 * shuffle_partitions(df.sparkSession) * passes - 1).bit_length())


def _block_of(seeds: np.ndarray, blocks: int) -> np.ndarray:
    return (seeds >> np.uint64(64 - blocks.bit_length() + 1)).astype(np.int32)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [field.split(" ") for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), names, strict=True)], names=[name for name, _ in names])


def named_stretches(rule: Rule, blocks: int, part: int) -> Callable:
    """Packed names of all stretches, by block. Those that the chunk has in an earlier document are solved here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (np.asarray(batch.column(c)) for c in ("doc_id", "tag"))
            data, bounds = arrays.utf8(batch.column("text"))
            for first, last in arrays.chunks(bounds, rule.chunk_bytes):
                own = bounds[first : last + 1] - bounds[first]
                start, size, seed, name = stretches(data[bounds[first] : bounds[last]], own, rule)
                if rule.anchor_passes > 1:
                    mine = _block_of(seed, blocks) % rule.anchor_passes == part
                    start, size, seed, name = start[mine], size[mine], seed[mine], name[mine]
                if not len(start):
                    continue
                row = np.searchsorted(own, start, side="right") - 1
                docs, places = ids[first + row], (start - own[row]) | (tags[first + row].astype(np.int64) << 32)
                order = np.lexsort((name, seed))
                new = _first_of(seed[order], name[order])
                least = np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
                solved = docs[order] > least
                # By block, then by document and place: small differences.
                rows = []
                for chosen, done in ((np.sort(order[solved]), True), (np.sort(order[~solved]), False)):
                    block = np.zeros(len(chosen), np.int32) if done else _block_of(seed[chosen], blocks)
                    by = np.argsort(block, kind="stable")
                    chosen, block = chosen[by], block[by]
                    for at in np.split(np.arange(len(chosen)), np.flatnonzero(np.diff(block)) + 1):
                        if len(at):
                            k = chosen[at]
                            keys = (b"", b"") if done else (arrays.split_bytes(seed[k], _SEED_BYTES), arrays.split_bytes(name[k], _STRETCH_BYTES))
                            target = _block_of(seed[k[:1]], blocks)[0] if done else block[at[0]]
                            rows.append((int(target), done, *keys, arrays.packed_steps(docs[k]), arrays.split_bytes(places[k], 8), arrays.split_bytes(size[k], 2)))
                yield _batch(rows, _NAMED)

    return run


def _by_document(docs: np.ndarray, places: np.ndarray, records: np.ndarray, flag: bool) -> Iterator[pa.RecordBatch]:
    """Records, whose places are set here, gathered for each document of this task."""
    order = np.lexsort((places, docs))
    d, p, records = docs[order], places[order], records[order]
    tag, records["place"] = (p >> 32).astype(np.int32), (p & 0xFFFFFFFF).astype(np.int32)
    new = np.flatnonzero(_first_of(d, tag)) if len(d) else np.zeros(0, np.int64)
    for k in range(0, len(new), 4096):
        own, ends = new[k : k + 4096], np.append(new, len(d))[k + 1 : k + 4097]
        yield _batch([(int(d[a]), int(tag[a]), flag, records[a:b].tobytes()) for a, b in zip(own, ends, strict=True)], _RUNS)


def _records(kind: np.dtype, **columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(next(iter(columns.values()))), kind)
    for name, values in columns.items():
        out[name] = values
    return out


def settle_names(blocks: int, crowd: int) -> Callable:
    """Runs of strings that an earlier document has for certain, and, marked as open, the stretches to be compared by content."""
    kept = np.uint64(64 - blocks.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, left = [], []
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                d, p, n = arrays.from_steps(row["docs"]), arrays.joined_bytes(row["places"], 8).view(np.int64), arrays.joined_bytes(row["sizes"], 2).astype(np.int32)
                if row["solved"]:
                    done.append((d, p, n))
                else:
                    seed = (arrays.joined_bytes(row["seeds"], _SEED_BYTES) & np.uint64((1 << int(kept)) - 1)) | (np.uint64(row["block"]) << kept)
                    left.append((d, p, n, seed, arrays.joined_bytes(row["names"], _STRETCH_BYTES)))
        if left:
            d, p, n, seed, name = (np.concatenate(x) for x in zip(*left, strict=True))
            left.clear()
            order = np.lexsort((name, seed))
            d, p, n, seed, name = d[order], p[order], n[order], seed[order], name[order]
            new = _first_of(seed, name)
            solved = d > np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
            done.append((d[solved], p[solved], n[solved]))
            # What is left of a seed are least documents of distinct stretches; those of one document have nothing to lose.
            first = _first_of(seed)
            starts, group = np.flatnonzero(first), np.cumsum(first) - 1
            several = (np.add.reduceat(new, starts, dtype=np.int64) > 1) & (np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts))
            still = several[group] & ~solved
            crowded = np.bincount(group[still], minlength=len(starts))[group[still]] > crowd
            yield from _by_document(d[still], p[still], _records(_OPEN, seed=seed[still], size=n[still], crowded=crowded), True)
        if done:
            d, p, n = (np.concatenate(x) for x in zip(*done, strict=True))
            yield from _by_document(d, p, _records(_RUN, size=n), False)

    return run


def open_bytes(rule: Rule, blocks: int, part: int) -> Callable:
    """The bytes of the open stretches (column ``runs``: records of the row), by block.

    Strings of crowded seeds go one by one, under their own names; those that the chunk has in an earlier document are
    solved here (no seeds, no text).
    """

    def packed(seed: np.ndarray, docs: np.ndarray, places: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray | None) -> Iterator[tuple]:
        block = _block_of(seed, blocks)
        chosen = np.argsort(block, kind="stable")
        if rule.window_passes > 1:
            chosen = chosen[block[chosen] % rule.window_passes == part]
        for k in np.split(chosen, np.flatnonzero(np.diff(block[chosen])) + 1) if len(chosen) else []:
            seeds, text = b"", b""
            if data is not None:
                length = size[k] + rule.width - 1
                at = np.repeat(begin[k] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                seeds, text = seed[k].tobytes(), data[at].tobytes()
            yield int(block[k[0]]), seeds, arrays.packed_steps(docs[k]), arrays.split_bytes(places[k], 8), arrays.split_bytes(size[k], 2), text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, found = np.asarray(batch.column("doc_id")), np.asarray(batch.column("tag")), batch.column("runs")
            data, bounds = arrays.utf8(batch.column("text"))
            for first, last in arrays.chunks(bounds, rule.chunk_bytes):
                records = [np.frombuffer(b"".join(found[i].as_py()), _OPEN) for i in range(first, last)]
                row = np.repeat(np.arange(first, last), [len(x) for x in records])
                record = np.concatenate(records)
                begin, size = bounds[row] + record["place"], record["size"].astype(np.int64)
                plain = np.flatnonzero(~record["crowded"])
                places = record["place"].astype(np.int64) | (tags[row].astype(np.int64) << 32)
                rows = list(packed(record["seed"][plain], ids[row[plain]], places[plain], size[plain], begin[plain], data))
                crowded = np.flatnonzero(record["crowded"])
                if len(crowded):
                    begin, size = begin[crowded], size[crowded]
                    at = np.sort(np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum()))
                    own, near = data[bounds[first] : bounds[last]], at - bounds[first]
                    name = arrays.window_hashes(arrays.BYTE_VALUES[own], rule.width, near)
                    again = arrays._span_hashes(own, near, near + rule.width)
                    of = np.searchsorted(bounds, at, side="right") - 1
                    docs, places = ids[of], (at - bounds[of]) | (tags[of].astype(np.int64) << 32)
                    order = np.lexsort((again, name))
                    new = _first_of(name[order], again[order])
                    solved = docs[order] > np.minimum.reduceat(docs[order], np.flatnonzero(new))[np.cumsum(new) - 1]
                    for k, source in ((np.sort(order[solved]), None), (np.sort(order[~solved]), data)):
                        rows += packed(name[k], docs[k], places[k], np.ones(len(k), np.int64), at[k], source)
                if rows:
                    yield _batch(rows, _BYTES)

    return run


def sort_suffixes(width: int) -> Callable:
    """Runs of strings that an earlier document has too: the suffixes of the stretches of one block, sorted by content."""

    def solved_rows(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        docs, places = (np.concatenate(x) for x in zip(*((arrays.from_steps(r["docs"]), arrays.joined_bytes(r["places"], 8).view(np.int64)) for r in rows), strict=True))
        yield from _by_document(docs, places, _records(_RUN, size=np.ones(len(docs), np.int32)), False)

    def sorted_block(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if solved := [r for r in rows if not r["seeds"]]:
            yield from solved_rows(solved)
            rows = [r for r in rows if r["seeds"]]
        if not rows:
            return
        docs = np.concatenate([arrays.from_steps(r["docs"]) for r in rows])
        places = np.concatenate([arrays.joined_bytes(r["places"], 8).view(np.int64) for r in rows])
        size = np.concatenate([arrays.joined_bytes(r["sizes"], 2).astype(np.int64) for r in rows])
        seeds = np.concatenate([np.frombuffer(r["seeds"], np.uint64) for r in rows])
        text = np.frombuffer(b"".join(r["text"] for r in rows) + bytes(8), np.uint8)
        length = size + width - 1
        owner = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        at = (np.cumsum(length) - length)[owner] + within
        # Eight bytes at each place as one number, most significant first; the last column overlaps the one before it.
        eights = np.zeros(len(text) - 7, np.uint64)
        for k in range(8):
            eights = (eights << np.uint64(8)) | text[k : k + len(eights)]
        if width < 8:
            eights >>= np.uint64(64 - 8 * width)
        columns = [eights[at + k] for k in [*range(0, width - 8, 8), max(0, width - 8)]]
        order = np.lexsort((*columns[::-1], seeds[owner]))
        new = _first_of(seeds[owner][order], *(c[order] for c in columns))
        d = docs[owner]
        least = np.minimum.reduceat(d[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = np.zeros(len(owner), dtype=bool)
        gone[order] = d[order] > least
        begins = np.flatnonzero(gone & np.append(True, ~gone[:-1] | (owner[1:] != owner[:-1])))
        ends = np.flatnonzero(gone & np.append(~gone[1:] | (owner[1:] != owner[:-1]), True))
        yield from _by_document(d[begins], places[owner[begins]] + within[begins], _records(_RUN, size=ends - begins + 1), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                if held and held[-1]["block"] != row["block"]:
                    yield from sorted_block(held)
                    held = []
                held.append(row)
        if held:
            yield from sorted_block(held)

    return run


def later_copies(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, tag) of documents of ``width`` bytes or more whose whole text has a smaller id."""
    digests = (
        texts.where(F.octet_length("text") >= width)
        .where("doc_id is not null")
        .select("doc_id", "tag", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"))
    )
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"))
    return digests.join(least, "digest").where("doc_id > least").select("doc_id", "tag").distinct()


def earlier_strings(rows: DataFrame, rule: Rule, copies: DataFrame, crowd: int) -> DataFrame:
    """(doc_id, tag, runs): starts of strings that an earlier document has, as lists of packed (place, number of starts).

    ``rows``: (doc_id, text, tag). ``copies``: (doc_id, tag) of documents that need no runs. Documents without an id take
    no part.
    """
    texts = rows.where("doc_id is not null and text is not null").where(F.octet_length("text") >= rule.width)
    parts = 4 * shuffle_partitions(rows.sparkSession)  # many small partitions: a task holds its entries at once
    blocks = _blocks(rows, rule.anchor_passes)
    passes = (texts.mapInArrow(named_stretches(rule, blocks, k), _NAMED).repartition(parts, "block").mapInArrow(settle_names(blocks, crowd), _RUNS) for k in range(rule.anchor_passes))
    named = None
    for found in passes:
        one = staged(found, "named")
        named = one if named is None else named.unionByName(one)
    gathered = named.where("open").groupBy("doc_id", "tag").agg(F.collect_list("runs").alias("runs"))
    near = texts.join(gathered, ["doc_id", "tag"])
    blocks = _blocks(rows, rule.window_passes)
    if rule.window_passes > 1:
        near = staged(near, "near")
    runs = named.where("not open")
    for k in range(rule.window_passes):
        dealt = near.mapInArrow(open_bytes(rule, blocks, k), _BYTES).repartition(parts, "block").sortWithinPartitions("block")
        runs = runs.unionByName(staged(dealt.mapInArrow(sort_suffixes(rule.width), _RUNS), "sorted"))
    return runs.join(copies, ["doc_id", "tag"], "left_anti").groupBy("doc_id", "tag").agg(F.collect_list("runs").alias("runs"))


def remove_earlier_bytes(documents: DataFrame, rule: Rule = BYTE_RULE, with_bytes: bool = True, crowd: int = CROWD) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_bytes (unless ``with_bytes`` is off), its SHA-256.

    A byte of the UTF-8 text goes when a string of ``rule.width`` bytes that covers it also starts in a document with a
    smaller id; strings are judged on the input. Null texts are empty. Rows without a ``doc_id`` take no part and keep
    their bytes; rows that share an id don't remove each other's bytes. Other columns are ignored.
    """
    texts = tagged(documents)
    copies = staged(later_copies(texts, rule.width), "copies")
    found = earlier_strings(texts, rule, copies, crowd)
    width = rule.width

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, whole = batch.column("runs").to_pylist(), batch.column("whole").to_pylist()
            data, bounds = arrays.utf8(batch.column("text"))
            removed, spans, kept, digests = [], [], [], []
            for i, blobs in enumerate(runs):
                own = data[bounds[i] : bounds[i + 1]]
                size, rest = len(own), own.tobytes()
                if whole[i]:
                    removed.append(size)
                    spans.append(1)
                    rest = b""
                elif blobs:
                    run = np.frombuffer(b"".join(blobs), _RUN)
                    edge = np.zeros(size + 1, dtype=np.int64)
                    np.add.at(edge, run["place"], 1)
                    np.add.at(edge, run["place"] + run["size"] + width - 1, -1)
                    gone = np.cumsum(edge)[:size] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    rest = own[~gone].tobytes()
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(rest if with_bytes else None)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_sha256"],
            )

    marks = found.unionByName(copies.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    rows = texts.join(marks, ["doc_id", "tag"], "left")
    out = rows.select("doc_id", "text", "runs", F.coalesce("whole", F.lit(False)).alias("whole")).mapInArrow(finish, _RESULT)
    return out if with_bytes else out.drop("kept_bytes")
