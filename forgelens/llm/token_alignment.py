"""Alignment of two tokenizers' tokens by interval coalescing.

Tokens of both tokenizers are byte intervals over the same text. All of them are sorted by start, the running maximum of
their ends is taken, and a group breaks where a start reaches that maximum: there tokens of both kinds end. Within a group
the overlapping token pairs are expanded from two binary searches. Texts of a chunk are laid end to end, so one pass of
array operations serves many documents.

Documents travel in blocks of bounded text. A block carries the distinct id pairs of its links once and each document's
pairs as places in that list, so what is counted over the corpus, and what is given back, are pairs of a block and not links.
The two vocabulary files are read on the driver and broadcast; their size does not depend on the data.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm import arrays
from forgelens.llm.staging import staged

#: An id pair as one number: the A id above these bits, the B id in them.
PAIR_BITS = 24
#: A space between two other characters: no token of either kind goes on across it, so a text can be encoded in parts.
_GAP = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_ACROSS = re.compile(r"[^\s▁] ")
_DOC_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = (
    "block string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, sizes array<long>, places binary, times binary, pair array<long>, links array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class Alignment:
    block_bytes: int = 8 << 20  # text of a block; a longer document is a block of its own
    chunk_bytes: int = 1 << 18  # text encoded at once
    part_chars: int = 1 << 16  # longer texts are encoded in parts


def byte_symbols() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable characters stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_PIECE = 500
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_PIECE)


def _has_long_piece(text: str) -> bool:
    return len(text) > LONG_PIECE and (max(map(len, text.split()), default=0) > LONG_PIECE or _LONG_BLANK.search(text) is not None)


def _ranked(byte_file: str, texts: list[bytes]):
    """An encoder that merges by rank, if the file is of the usual kind and its ids are in the order of its merges."""
    import tiktoken

    model, cut = json.loads(byte_file), {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    own, added = model["model"], {x["id"] for x in model["added_tokens"]}
    merges = [m if isinstance(m, str) else " ".join(m) for m in own.get("merges", [])]
    plain = model.get("normalizer") is None and cut.items() <= (model.get("pre_tokenizer") or {}).items()
    odd = any(own.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    in_order = all(own["vocab"].get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges))
    if not (plain and in_order) or odd or own.get("type") != "BPE" or len(own["vocab"].keys() - {x["content"] for x in model["added_tokens"]}) != 256 + len(merges):
        return None
    return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks={t: i for i, t in enumerate(texts) if i not in added}, special_tokens={})


@dataclass(frozen=True)
class Pieces:
    """The bytes of all tokens of one kind end to end."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Pieces:
        size = np.array([len(x) for x in texts], dtype=np.int64)
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = self.start[ids] - (np.cumsum(size) - size)
        return self.data[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Encoders:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, byte_file: str, piece_file: bytes) -> None:
        import sentencepiece
        import tokenizers

        self.first = tokenizers.Tokenizer.from_str(byte_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        symbols = byte_symbols()
        entries = self.first.get_vocab(with_added_tokens=True)
        self.first_bytes = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.first_bytes[number] = bytes(symbols[c] for c in entry)
        self.ranked = _ranked(byte_file, self.first_bytes)
        self.second_bytes = [self._piece(i) for i in range(self.second.vocab_size())]
        self.first_table, self.second_table = Pieces.of(self.first_bytes), Pieces.of(self.second_bytes)
        self.splits = not any(_ACROSS.search(x.decode("utf-8", "replace")) for x in (*self.first_bytes, *self.second_bytes))
        # The text of an id with what follows it: within a group's kind, between its kinds, between groups.
        ids = [str(i).encode() for i in range(max(len(self.first_bytes), len(self.second_bytes)))]
        self.written = [x + mark for x in ids for mark in (b",", b"|", b";")]

    def _piece(self, number: int) -> bytes:
        piece = self.second.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(number) else piece.replace("▁", " ").encode()

    def first_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of the byte-level tokenizer.

        Where ids are in the order of the merges, merging by rank gives the same ids several times as fast; its time grows
        with the square of a piece, so texts that hold a long one go through the merges themselves.
        """
        if self.ranked is None:
            return [x.ids for x in self.first.encode_batch_fast(texts, add_special_tokens=False)]
        out: list = [None if _has_long_piece(t) else self.ranked.encode_ordinary(t) for t in texts]
        long = [k for k, ids in enumerate(out) if ids is None]
        if long:
            for k, found in zip(long, self.first.encode_batch_fast([texts[k] for k in long], add_special_tokens=False), strict=True):
                out[k] = found.ids
        return out

    def parts(self, text: str, size: int) -> list[str]:
        """The text cut at gaps, each part about ``size`` characters; the space of a gap is dropped, as each part gets one in front."""
        if len(text) <= size or not self.splits:
            return [text]
        out, first = [], 0
        while (gap := _GAP.search(text, first + size)) is not None:
            out.append(text[first : gap.start()])
            first = gap.end()
        return [*out, text[first:]]

    def encode(self, texts: list[bytes | None], part_chars: int) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both kinds of every text; none for texts that are null, empty or not UTF-8."""
        parts, owners = [], []
        for row, raw in enumerate(texts):
            try:
                text = (raw or b"").decode()
            except UnicodeDecodeError:
                continue
            if text:
                own = self.parts(text, part_chars)
                parts += own
                owners += [row] * len(own)
        first: list[list[int]] = [[] for _ in texts]
        second: list[list[int]] = [[] for _ in texts]
        if parts:
            for row, a, b in zip(owners, self.first_ids([" " + p for p in parts]), self.second.encode(parts, num_threads=1), strict=True):
                first[row] += a
                second[row] += b
        return first, second

    def same(self, texts: list[bytes | None], tokens: list[tuple[Pieces, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether the joined tokens of either kind are the text with a space in front; ``tokens`` has ids and their rows."""
        wanted = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        fits = np.ones(len(texts), dtype=bool)
        for pieces, ids, row in tokens:
            fits &= np.bincount(row, weights=pieces.size[ids], minlength=len(texts)) == wanted
        data = np.frombuffer(b"".join(b" " + t for t, fit in zip(texts, fits, strict=True) if fit and t), np.uint8)
        ends = np.cumsum(np.where(fits, wanted, 0))
        good = fits.copy()
        for pieces, ids, row in tokens:
            differ = np.flatnonzero(pieces.joined(ids[fits[row]]) != data)
            good[np.searchsorted(ends, differ, side="right")] = False
        return good


@dataclass
class Aligned:
    """What one chunk of documents gives: per document counts, digests, and distinct id pairs with their number of links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups_sha256: list[str]
    sizes: np.ndarray  # distinct pairs of each document
    pair: np.ndarray  # ascending within a document
    times: np.ndarray


def coalesced(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the tokens by start, and the group of each token in that order."""
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    breaks = start[order][1:] >= reach[:-1]
    return order, np.concatenate([[0], np.cumsum(breaks)]) if len(order) else np.zeros(0, np.int64)


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of every overlapping pair; both lists are in order and without gaps."""
    low = np.searchsorted(end_b, start_a, side="right")
    count = np.searchsorted(start_b, end_a, side="left") - low
    skipped = np.cumsum(count) - count
    return np.repeat(np.arange(len(start_a)), count), np.arange(int(count.sum())) + np.repeat(low - skipped, count)


def align(encoders: Encoders, texts: list[bytes | None], part_chars: int) -> Aligned:
    lists = encoders.encode(texts, part_chars)
    rows = np.arange(len(texts))
    n_a, n_b = (np.array([len(x) for x in own], dtype=np.int64) for own in lists)
    a, b = (np.fromiter(chain.from_iterable(own), np.int64, int(n.sum())) for own, n in zip(lists, (n_a, n_b), strict=True))
    row_a, row_b = np.repeat(rows, n_a), np.repeat(rows, n_b)
    good = encoders.same(texts, [(encoders.first_table, a, row_a), (encoders.second_table, b, row_b)])
    if not good.all():
        a, row_a, b, row_b = a[good[row_a]], row_a[good[row_a]], b[good[row_b]], row_b[good[row_b]]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    size_a, size_b = encoders.first_table.size[a], encoders.second_table.size[b]
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start_a, start_b = end_a - size_a, end_b - size_b

    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    kind = np.repeat([0, 1], [len(a), len(b)])
    order, group = coalesced(start, end, kind)
    token_row = np.concatenate([row_a, row_b])[order]
    n_groups = np.bincount(token_row[np.flatnonzero(np.diff(group, prepend=-1))], minlength=len(texts))

    # Tokens in order of group, kind and start, each written with the mark that follows it.
    within = np.argsort(2 * group + kind[order], kind="stable")
    placed_kind, placed_group = kind[order][within], group[within]
    mark = np.full(len(within), 2)
    mark[:-1] = np.where(placed_group[1:] != placed_group[:-1], 2, placed_kind[1:] != placed_kind[:-1])
    codes = (3 * np.concatenate([a, b])[order][within] + mark).tolist()
    digests, first_code = [], 0
    for count in (n_a + n_b).tolist():
        text = b"".join(map(encoders.written.__getitem__, codes[first_code : first_code + count]))[:-1]
        digests.append(hashlib.sha256(text).hexdigest() if count else "")
        first_code += count

    at_a, at_b = overlaps(start_a, end_a, start_b, end_b)
    link_row = row_a[at_a]
    pair = a[at_a] << PAIR_BITS | b[at_b]
    by_row = np.lexsort((pair, link_row))
    pair, link_row = pair[by_row], link_row[by_row]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (link_row[1:] != link_row[:-1])])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(pair)))
    return Aligned(n_a, n_b, n_groups, np.bincount(link_row, minlength=len(texts)), digests, np.bincount(link_row[new], minlength=len(texts)), pair[new], times)


def _pressed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(arrays.packed_steps(values))


def _unpressed(data: bytes) -> np.ndarray:
    return arrays.from_steps(zstandard.ZstdDecompressor().decompress(data))


def _block(ids: pa.Array, parts: list[Aligned]) -> pa.RecordBatch:
    pair = np.concatenate([p.pair for p in parts])
    times = np.concatenate([p.times for p in parts])
    distinct, places = np.unique(pair, return_inverse=True)
    totals = np.bincount(places, weights=times, minlength=len(distinct)).astype(np.int64)
    lists = [np.concatenate([getattr(p, c) for p in parts]) for c in (*_DOC_COLUMNS, "sizes")]
    digests = [d for p in parts for d in p.groups_sha256]
    columns = [[uuid.uuid4().hex], [ids], *([x] for x in lists[:4]), [digests], [lists[4]], [_pressed(places)], [_pressed(times)], [distinct], [totals]]
    whole, text = pa.list_(pa.int64()), pa.list_(pa.string())
    kinds = [pa.string(), whole, whole, whole, whole, whole, text, whole, pa.binary(), pa.binary(), whole, whole]
    names = [c.split(" ")[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


@dataclass
class _Open:
    """Documents of a block that is not full yet."""

    ids: list = field(default_factory=list)
    parts: list[Aligned] = field(default_factory=list)
    size: int = 0

    def taken(self) -> pa.RecordBatch:
        out = _block(pa.concat_arrays(self.ids), self.parts)
        self.ids, self.parts, self.size = [], [], 0
        return out


def aligned_blocks(documents: DataFrame, byte_path: str, piece_path: str, how: Alignment) -> DataFrame:
    """One row per block of documents, see ``BLOCKS``."""
    with open(byte_path, encoding="utf-8") as first, open(piece_path, "rb") as second:
        files = documents.sparkSession.sparkContext.broadcast((first.read(), second.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoders, block = Encoders(*files.value), _Open()
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            _, bounds = arrays.utf8(texts)
            for first, last in arrays.chunks(bounds, how.chunk_bytes):
                size = int(bounds[last] - bounds[first])
                if block.ids and block.size + size > how.block_bytes:
                    yield block.taken()
                block.ids.append(batch.column("doc_id").slice(first, last - first))
                block.parts.append(align(encoders, texts.slice(first, last - first).to_pylist(), how.part_chars))
                block.size += size
        if block.ids:
            yield block.taken()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)


def _scored(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one block; ``counted`` holds its distinct pairs with their counts over the corpus."""
    row = docs.slice(0, 1).to_pylist()[0]
    sizes = np.array(row["sizes"], dtype=np.int64)
    places, times = _unpressed(row["places"]), _unpressed(row["times"])
    n = np.zeros(len(row["pair"]), dtype=np.int64)
    best = np.zeros(len(n), dtype=np.int64)
    at = counted.column("place").to_numpy()
    n[at], best[at] = counted.column("n").to_numpy(), counted.column("best").to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros((2, len(sizes)), dtype=np.int64)
    np.add.at(sums[0], owner, times * best[places])
    np.add.at(sums[1], owner, times * n[places])
    columns = [row["doc_id"], *(row[c] for c in _DOC_COLUMNS), sums[0], sums[1], row["groups_sha256"]]
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return pa.table([pa.array(x, pa.string() if c == "groups_sha256" else pa.int64()) for x, c in zip(columns, names, strict=True)], names=names)


def align_documents(documents: DataFrame, byte_path: str, piece_path: str, how: Alignment = Alignment()) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is encoded with one space in front by the byte-level tokenizer (A) and by the piece tokenizer (B). Texts that
    are null, empty, not UTF-8, or that either tokenizer does not give back byte for byte have no tokens: zeros and an
    empty digest. A link is a pair of an A and a B token that share a byte; n_best counts the links whose id pair has the
    highest corpus count of its B id (ties included), count_sum adds up the corpus counts of all links. Rows that repeat
    a doc_id or lack one are documents of their own. Other columns are ignored.
    """
    blocks = staged(aligned_blocks(documents, byte_path, piece_path, how), "blocks")
    second = F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    listed = blocks.select(F.explode(F.arrays_zip("pair", "links")).alias("x")).select("x.*")
    counts = staged(listed.groupBy("pair").agg(F.sum("links").alias("n")), "counts")
    highest = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    rated = counts.withColumn("second", second).join(F.broadcast(highest), "second").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    places = blocks.select(F.col("block").alias("of_block"), F.posexplode("pair").alias("place", "pair"))
    counted = places.join(rated, "pair").select("of_block", "place", "n", "best")
    return blocks.drop("links").groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(_scored, RESULT)
