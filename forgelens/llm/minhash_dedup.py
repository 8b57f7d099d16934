"""MinHash near-dedup with tensored banding.

``bands`` half keys of ``rows`` minhashes each are made for either side; a table key is one left with one right half
key, so bands * bands tables cost only 2 * bands * rows minhashes. A pair of similarity s misses every table with
probability below 2 * (1 - s ** rows) ** bands: 4e-6 at 0.75 with the defaults, 4e-9 at 0.85.

Documents with one shingle set are one node from the start. A half key that one node has alone can't be part of a
shared table key, so only shared halves are combined. In the leading rounds every component is compared with the one
pivot that it shares most buckets with, on the full shingle sets; pivots differ from round to round. That joins large
groups of near copies at few comparisons; until all links are known, labels stand for the components (``merged``).
What buckets of several components are left with is paired once: nodes meet
under their left half keys, and a pair counts if it shares a right one too, is not of one component, and may be a link.
Three exact bounds and one of known risk say so: the sizes of the sets; the number of shingles that a member of another
component has too, of which a link needs nearly all; and the agreement of 30 of the 64 minhashes (a pair at 0.75 is lost
so with 4e-7). In a large group of texts that are alike but not linked the second bound leaves few pairs. Pairs are made
and tested where their nodes meet, in tiles of bounded size: once to find the nodes that have any, then, with the full
sets of those nodes beside them, to compare the sets, the best pair of each component first. Pairs of one component need
no comparison, and only links that join two components leave a tile, so no table holds pairs. No bucket is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.llm import arrays
from forgelens.llm.components import components
from forgelens.llm.staging import shuffle_partitions, staged

_TEXT_HASH = "xxhash64(text) AS text_hash"
_HASH = "_hash_of_text"


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    num: int = 75  # links: den * intersection >= num * union
    den: int = 100
    bands: int = 16
    rows: int = 2
    agree: int = 30  # of all minhashes; fewer agree in a pair at 0.75 with the probability that the module names
    leading_rounds: int = 2  # rounds in which every component is compared with its most shared pivot only
    best_rounds: int = 2  # rounds in which every component of a list is compared with the candidate that most minhashes share
    crowd: int = 2048  # members that one task compares with each other; larger lists are cut into tiles
    crowd_shingles: int = 4 << 20  # and shingles of those members
    chunk_bytes: int = 4 << 20


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than the width are one shingle."""
    _, _, words, before = arrays.words_of(data, bounds, lower=True)
    whole = arrays.window_hashes(words, width)
    for first, last in zip(before[:-1], before[1:], strict=True):
        n = int(last - first)
        if n >= width:
            yield np.unique(whole[first : last - width + 1])
        elif n:
            yield arrays.mixed(arrays.window_hashes(words[first:last], n) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def signatures(documents: DataFrame, how: NearDup) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, halves, sketch): node is the digest of the set, halves the left and then the right half keys, sketch a byte of every minhash."""
    hashes = 2 * how.bands * how.rows
    values = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (2, hashes), dtype=np.uint64)
    flip, times = values[0], values[1] * np.uint64(2) + np.uint64(1)
    slots = arrays.mixed(np.arange(1, 2 * how.bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = arrays.utf8(batch.column("text"))
            for first, last in arrays.chunks(bounds, how.chunk_bytes):
                own = bounds[first : last + 1]
                sets = list(shingle_sets(data[own[0] : own[-1]], own - own[0], how.shingle))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                halves: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                if len(full):
                    joined = np.concatenate(sets)
                    starts = np.cumsum(sizes)[full] - sizes[full]
                    keys = np.zeros((len(full), 2 * how.bands), dtype=np.uint64)
                    sketch = np.zeros((len(full), hashes), dtype=np.uint8)
                    for k in range(hashes):
                        least = np.minimum.reduceat((joined ^ flip[k]) * times[k], starts)
                        sketch[:, k] = least & np.uint64(255)
                        keys[:, k // how.rows] = arrays.mixed(keys[:, k // how.rows] + least)
                    keys = arrays.mixed(keys ^ slots).view(np.int64)
                    for i, row, low in zip(full, keys, sketch, strict=True):
                        halves[i], sketches[i] = row, low.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("text_hash").slice(first, last - first),
                        pa.array(sizes),
                        pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(halves, pa.list_(pa.int64())),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "node", "halves", "sketch"],
                )

    return documents.selectExpr("doc_id", _TEXT_HASH, "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node binary, halves array<long>, sketch binary")


def table_keys(nodes: DataFrame, how: NearDup) -> DataFrame:
    """(bucket, node, n_shingles, common, root) of the table keys whose two halves other nodes have too; all shingles may be common."""
    halves = nodes.select("node", "n_shingles", F.posexplode("halves").alias("slot", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    side = F.filter("found", lambda x: x["slot"] < how.bands), F.filter("found", lambda x: x["slot"] >= how.bands)
    tables = F.flatten(F.transform(side[0], lambda x: F.transform(side[1], lambda y: F.xxhash64(x["half"], y["half"]))))
    found = halves.join(shared, "half").groupBy("node", "n_shingles").agg(F.collect_list(F.struct("slot", "half")).alias("found"))
    return found.select(F.explode(tables).alias("bucket"), "node", "n_shingles", F.col("n_shingles").alias("common"), F.col("node").alias("root"))


def crowded(members: DataFrame, number: int = 0) -> DataFrame:
    """The members of buckets that hold several components, with a pivot for each bucket that differs from round to round."""
    pivot = F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("order"), "node", "root", "n_shingles", "common")).alias("pivot")
    live = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), pivot).where("low <> high")
    return members.join(live.select("bucket", "pivot"), "bucket")


def _fits(how: NearDup) -> Column:
    """What a link needs: the smaller set has num / den of the larger one's shingles, and neither has too few common ones.

    The intersection holds common shingles only. It makes up num / den of the union if and only if it makes up
    num / (num + den) of the two sizes together.
    """
    sizes = how.den * F.least("n_shingles", "other_n_shingles") >= how.num * F.greatest("n_shingles", "other_n_shingles")
    return sizes & ((how.num + how.den) * F.least("common", "other_common") >= how.num * (F.col("n_shingles") + F.col("other_n_shingles")))


_MEMBER = ("node", "root", "n_shingles", "common")


def _other() -> list[Column]:
    return [F.col(f"pivot.{c}").alias(f"other_{c}") for c in _MEMBER]


def _pair() -> list[Column]:
    return [F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")]


def leading(members: DataFrame, how: NearDup) -> DataFrame:
    """(a, b, low_root, low_other_root, high_root, high_other_root): for every component the one pair with a pivot of another component that most buckets share, and whose pair it is."""
    pairs = members.select(*_MEMBER, *_other()).where("root <> other_root").where(_fits(how))
    counts = pairs.groupBy("root", "node", "other_node", "other_root").agg(F.count("*").alias("n"))
    best = counts.groupBy("root").agg(F.max(F.struct("n", "node", "other_node", "other_root")).alias("best")).select("root", "best.*")
    # Two components may name the same pair: it is compared once.
    ways = F.struct("root", "other_root")
    return best.select(*_pair(), ways.alias("way")).groupBy("a", "b").agg(F.min("way").alias("low"), F.max("way").alias("high")).select("a", "b", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("low", "high") for c in ("root", "other_root")))


def merged(named: DataFrame) -> DataFrame:
    """(root, label) from (root, other_root), at most one row a root: roots of one label are connected.

    Everybody goes two steps along the rows and takes the lesser of the place reached and the next one. That makes one
    label of everything within two steps of two roots that name each other. Longer chains get several labels; a label
    only spares comparisons, the links themselves decide the components in the end.
    """
    other = named.select(F.col("root").alias("at"), F.col("other_root").alias("next"))

    def step(found: DataFrame, at: str, to: str) -> DataFrame:
        return found.join(other.select(F.col("at").alias(at), F.col("next").alias(to)), at, "left").withColumn(to, F.coalesce(to, at))

    return step(step(named.withColumnRenamed("other_root", "one"), "one", "two"), "two", "three").select("root", F.least("two", "three").alias("label"))


def postings(members: DataFrame, nodes: DataFrame, how: NearDup) -> DataFrame:
    """(list, tile, chunk, slot, node, home, n_shingles, common, halves, sketch): every live node under each of its left half keys.

    A list that holds more than ``crowd`` nodes, or sets of more than ``crowd_shingles`` in all, is cut into
    chunks, and its nodes go to one tile for each pair of chunks, so that no task meets more than two chunks.
    """
    live = members.select(*_MEMBER).dropDuplicates(["node"]).join(nodes.select("node", "halves", "sketch"), "node")
    posted = live.select("*", F.posexplode(F.slice("halves", 1, how.bands)).alias("slot", "half"))
    sizes = posted.groupBy("half").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")).where("size > 1")
    ways = F.greatest(F.ceil(F.col("size") / how.crowd), F.ceil(F.col("shingles") / how.crowd_shingles)).cast("int")
    cut = posted.join(sizes.select("half", ways.alias("ways")), "half")
    chunked = cut.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("ways")).cast("int"))
    tiled = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    # The list of a half key also names the two chunks that meet.
    key = F.xxhash64("half", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return tiled.select(key.alias("list"), (F.col("chunk") != F.col("other")).alias("tile"), "chunk", "slot", "node", F.xxhash64("root").alias("home"), "n_shingles", "common", "halves", "sketch")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one partition, sorted by list, in tables that cut no list."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        lists = batch.column("list").to_numpy()
        last = int(np.searchsorted(lists, lists[-1])) if len(lists) else 0
        if last or (held and len(lists) and held[-1].column("list")[-1].as_py() != lists[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(table: pa.Table, how: NearDup) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i and j of one list that may be linked, with the number of minhashes that agree.

    A table key is a left with a right half key, so nodes that meet under a left half must share a right one too. Of the
    left halves that a pair shares, the first reports it. Pairs that fail ``_fits`` or whose minhashes agree in fewer than
    ``agree`` places are dropped.
    """
    bands, n = how.bands, table.num_rows
    if n < 2:
        return
    lists, chunk, slot, home, size, common = (table.column(c).to_numpy() for c in ("list", "chunk", "slot", "home", "n_shingles", "common"))
    tile = np.asarray(table.column("tile"))
    halves = table.column("halves").combine_chunks().flatten().to_numpy().reshape(n, -1)
    sketch = arrays.utf8(table.column("sketch"))[0].reshape(n, -1)
    step, at = 1, np.arange(n)
    while len(at := at[at + step < n]):
        at = at[lists[at] == lists[at + step]]
        for k in range(0, len(at), 100_000):
            i = at[k : k + 100_000]
            j = i + step
            good = (home[i] != home[j]) & (~tile[i] | (chunk[i] != chunk[j]))
            good &= how.den * np.minimum(size[i], size[j]) >= how.num * np.maximum(size[i], size[j])
            good &= (how.num + how.den) * np.minimum(common[i], common[j]) >= how.num * (size[i] + size[j])
            i, j = i[good], j[good]
            same = halves[i] == halves[j]
            good = same[:, bands:].any(axis=1) & (same[:, :bands].argmax(axis=1) == slot[i])
            i, j = i[good], j[good]
            agree = (sketch[i] == sketch[j]).sum(axis=1)
            good = agree >= how.agree
            if good.any():
                yield i[good].astype(np.int32), j[good].astype(np.int32), agree[good].astype(np.int16)
        step += 1


def _dealt(posted: DataFrame) -> DataFrame:
    return posted.repartition(shuffle_partitions(posted.sparkSession), "list").sortWithinPartitions("list")


def candidates(posted: DataFrame, how: NearDup) -> DataFrame:
    """The rows of ``postings`` whose node meets a node of another component there that it may be linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            met = np.zeros(table.num_rows, dtype=bool)
            for i, j, _ in _pairs(table, how):
                met[i], met[j] = True, True
            if met.any():
                yield from table.filter(pa.array(met)).to_batches(max_chunksize=10_000)

    return _dealt(posted).mapInArrow(run, posted.schema)


def settled(met: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """(a, b): links between nodes of ``candidates``, on their full sets, that join their components where they meet.

    The pairs never leave the task. It compares the pair of most agreeing minhashes of each component first, for
    ``best_rounds`` rounds, then the others; pairs that lie in one component by then need no comparison. So a list of
    k nodes gives at most k - 1 rows, however many pairs it holds.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [x.tobytes() for x in shingle_sets(*arrays.utf8(part.column("text")), how.shingle)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_lists(batches):
            found = list(zip(*_pairs(table, how), strict=True))
            if found:
                i, j, agree = (np.concatenate(x) for x in found)
                order = np.argsort(-agree, kind="stable")
                a, b = joined(table, i[order], j[order])
                nodes = table.column("node").combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])

    def joined(table: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
        data, bounds = arrays.utf8(table.column("shingles"))
        group = np.unique(table.column("home").to_numpy(), return_inverse=True)[1]
        out: tuple[list[int], list[int]] = ([], [])

        def shingles(k: int) -> np.ndarray:
            return np.frombuffer(data[bounds[k] : bounds[k + 1]].tobytes(), np.uint64)

        def compare(one: int, others: np.ndarray) -> None:
            own, sets = shingles(one), [shingles(k) for k in others]
            sizes = np.array([len(x) for x in sets])
            whole = np.concatenate(sets)
            hit = own[np.minimum(np.searchsorted(own, whole), len(own) - 1)] == whole
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for other in others[how.den * both >= how.num * (len(own) + sizes - both)]:
                if group[one] != group[other]:
                    group[group == group[other]] = group[one]
                    out[0].append(int(one))
                    out[1].append(int(other))

        for _ in range(how.best_rounds):
            left = group[i] != group[j]
            i, j = i[left], j[left]
            if not len(i):
                break
            best = np.unique(np.unique(np.stack([group[i], group[j]], axis=1), return_index=True)[1] // 2)
            for one, other in zip(i[best], j[best], strict=True):
                if group[one] != group[other]:
                    compare(one, np.array([other]))
            i, j = np.delete(i, best), np.delete(j, best)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for others in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
            one = i[others[0]]
            for first in range(0, len(others), 256):
                near = j[others[first : first + 256]]
                near = near[group[near] != group[one]]
                if len(near):
                    compare(one, near)
        return out

    wanted = texts.join(met.select("node").distinct(), "node", "left_semi")
    sets = wanted.select("node", "text").mapInArrow(sets_of, "node binary, shingles binary")
    return _dealt(met.join(sets, "node")).mapInArrow(run, "a binary, b binary")


def with_common(members: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """The members with the number of their shingles that a member of another component has too, as ``common``.

    A link between components holds no other shingles, so whoever has too few of them is linked with nobody and goes. In
    a large group of alike texts, most of what is left after the pivots are texts with too many words of their own; they
    are told by this count instead of by comparing each with all of the group.
    """
    live = members.select("node", "root").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = list(shingle_sets(*arrays.utf8(part.column("text")), how.shingle))
                sizes = [len(x) for x in sets]
                own = (pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("place", "home"))
                shingles = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shingles), *own], names=["shingle", "place", "home"])

    # Nodes and components go by 64 bits here: two that are taken for one could only lose a shingle if both were in a group.
    placed = texts.join(live, "node").select("text", F.xxhash64("node").alias("place"), F.xxhash64("root").alias("home"))
    shingles = placed.mapInArrow(run, "shingle long, place long, home long")
    shared = shingles.groupBy("shingle").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("shingle")
    counts = staged(shingles.join(shared, "shingle", "left_semi").groupBy("place").agg(F.count("*").alias("common")), "common")
    found = members.drop("common").withColumn("place", F.xxhash64("node")).join(counts, "place").drop("place")
    return found.where(how.den * F.col("common") >= how.num * F.col("n_shingles"))


def linked(pairs: DataFrame, texts: DataFrame, how: NearDup) -> DataFrame:
    """The rows of ``pairs`` whose nodes a and b have full shingle sets that are similar enough."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [list(shingle_sets(*arrays.utf8(part.column(c)), how.shingle)) for c in ("ta", "tb")]
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(how.den * both >= how.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns], names=columns).filter(pa.array(good, pa.bool_()))

    ta, tb = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(ta, "a").join(tb, "b").select(*columns, "ta", "tb").mapInArrow(run, pairs.schema)


def links(nodes: DataFrame, documents: DataFrame, how: NearDup) -> DataFrame | None:
    """(node, root) of the nodes that are linked with another; ``nodes``: node, owner, n_shingles, halves, sketch."""
    members = staged(crowded(staged(table_keys(nodes, how), "keys")), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "owner.doc_id", "owner.text_hash"), "node")
    texts = documents.selectExpr("doc_id", "text", _TEXT_HASH).join(wanted, ["doc_id", "text_hash"])
    texts = staged(texts.groupBy("node").agg(F.max("text").alias("text")), "texts")

    edges = None
    for number in range(how.leading_rounds):
        if members.isEmpty():
            break
        found = staged(linked(leading(members, how), texts, how), "links")
        left = members.select("bucket", "node", "n_shingles", "common", "root")
        if not found.isEmpty():
            pairs = found.select("a", "b")
            edges = pairs if edges is None else edges.unionByName(pairs)
            ways = [F.struct(F.col(f"{x}_root").alias("root"), F.col(f"{x}_other_root").alias("other_root")) for x in ("low", "high")]
            labels = staged(merged(found.select(F.explode(F.array_distinct(F.array(*ways))).alias("way")).select("way.*")), "labels")
            left = left.join(labels, "root", "left").withColumn("root", F.coalesce("label", "root")).drop("label")
        members = staged(crowded(left, number + 1), "members")
    if not members.isEmpty():
        met = staged(candidates(postings(with_common(members, texts, how), nodes, how), how), "met")
        found = staged(settled(met, texts, how), "links")
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
    return None if edges is None else components(edges)


def grouped(documents: DataFrame, how: NearDup) -> DataFrame:
    """Every row as (doc_id, text_hash, n_shingles, root, component): the group it is in and the least doc_id there.

    Both are null for rows without an id or without words.
    """
    rows = staged(signatures(documents, how), "signatures")
    named = rows.where("doc_id is not null and node is not null")
    nodes = staged(named.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("owner"), F.first("n_shingles").alias("n_shingles"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch")), "nodes")
    roots = links(nodes, documents, how)
    if roots is None:
        final = nodes.select("node", F.col("node").alias("root"), F.col("owner.doc_id").alias("component"))
    else:
        placed = nodes.select("node", F.col("owner.doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = placed.groupBy("root").agg(F.min("least").alias("component"))
        final = placed.join(least, "root").select("node", "root", "component")
    known = F.col("doc_id").isNotNull()
    out = rows.join(final, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", *(F.when(known, F.col(c)).alias(c) for c in ("root", "component")))


def near_duplicates(documents: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words: A-Z in lower case, split at the six ASCII spaces. component_id is the least doc_id reachable over links, kept
    says that it is the row's own. Null and empty texts have an empty set and are linked with nothing. Rows without a
    doc_id take no part: component_id is null and kept is true. Rows that share a doc_id are nodes of their own.
    Other columns are ignored.
    """
    out = grouped(documents, how)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """The documents with one row of every group: one that carries its least doc_id, the one of least text hash if several do.

    Rows without a doc_id and rows without words all stay. Equal rows of one text are one.
    """
    found = staged(grouped(documents, how), "groups")
    chosen = found.where("root is not null and doc_id = component").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    hashed = documents.withColumn(_HASH, F.expr(_TEXT_HASH.split(" AS ")[0]))
    best = chosen.select("best.doc_id", F.col("best.text_hash").alias(_HASH)).distinct()
    named = hashed.join(best, ["doc_id", _HASH], "left_semi").dropDuplicates(["doc_id", _HASH])
    plain = found.where("doc_id is not null and n_shingles = 0").select("doc_id", F.col("text_hash").alias(_HASH)).distinct()
    wordless = hashed.join(plain, ["doc_id", _HASH], "left_semi")
    rest = hashed.where("doc_id is null")
    return named.unionByName(wordless).unionByName(rest).select(documents.columns)
