"""SentencePiece encoding and decoding with a streaming Viterbi search.

The vocabulary comes from a published model file, read on the driver and broadcast (its size is that of the model). The
file holds a merge order and no piece probabilities, so a piece's score is the logarithm of a Zipf estimate from its
rank; sums of scores are integers (millionths), so ties are exact: the longer last piece wins. Characters outside the
vocabulary become UTF-8 byte pieces. As in the model, a text is encoded with one space in front.

The search keeps backpointers for at most ``max_piece`` open positions beyond the committed ones: a later piece can't
start earlier. When the best paths of all open positions pass one boundary, everything before it is final and its ids
are given out. No piece of the vocabulary goes on with a space after another character, with a comma or full stop
after a letter, or crosses a line feed, so every such place is a boundary of all paths: words can be encoded apart, and
equal words share the work. Only a run
without any blank can hold two paths that never meet (a short unit repeated); it is then kept until it ends.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from forgelens.llm import arrays

UNIT = 1_000_000
#: Words whose ids are kept, and the UTF-8 bytes of texts that are split into words at once: they bound a worker's memory.
CACHE_WORDS = 100_000
#: The same of ``ColumnEncoder``, which holds them in arrays of about 50 bytes a word.
COLUMN_WORDS = 1 << 19
CHUNK_BYTES = 1 << 20
LONGEST_WORD = 64
_NEVER = -(1 << 60)
#: Places inside a text that no piece crosses: before a space, around a line feed, between a letter and , or .
_SEGMENT = re.compile(r" *[^ \n.,]+(?<=[A-Za-zÀ-ɏ])(?=[.,])| *[^ \n]+| +|\n")
_CROSSING = re.compile(r"[^ ] |.\n|\n.|[A-Za-zÀ-ɏ][.,]")


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, tuple[int, int]]  # text -> (id, score)
    byte_ids: tuple[int, ...]
    byte_score: int
    texts: tuple[bytes, ...]  # UTF-8 of every id; empty for control ids

    @property
    def max_piece(self) -> int:
        return max(map(len, self.pieces))


def read_vocabulary(model_path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, byte_ids, texts, rank = {}, [0] * 256, [], 0
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            texts.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            rank += 1
            text = piece.replace("▁", " ")
            pieces[text] = (i, -round(UNIT * math.log(rank + 2.7)))
            texts.append(text.encode())
    total = round(UNIT * math.log(sum(1 / (r + 2.7) for r in range(1, rank + 1))))
    pieces = {t: (i, s - total) for t, (i, s) in pieces.items()}
    if any(_CROSSING.search(t) for t in pieces):
        raise ValueError("words of this vocabulary can't be encoded apart")
    return Vocabulary(pieces, tuple(byte_ids), min(s for _, s in pieces.values()) - 10 * UNIT, tuple(texts))


def automaton_of(vocabulary: Vocabulary):
    """Finds all pieces that end at a place, the longest first."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, (number, score) in vocabulary.pieces.items():
        automaton.add_word(text, (len(text), score, number))
    automaton.make_automaton()
    return automaton


class StreamingViterbi:
    """Feed characters, take ids: ``push`` gives the ids that are final so far, ``finish`` the rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.pieces, self.reach = vocabulary.pieces, vocabulary.max_piece
        self.byte_ids, self.byte_score = vocabulary.byte_ids, vocabulary.byte_score
        self.single = {t for t in vocabulary.pieces if len(t) == 1}
        self.automaton = automaton_of(vocabulary)
        self._clear()

    def _clear(self) -> None:
        # Position 0 is the last committed boundary; chars[k] lies between positions k and k + 1.
        self.chars: list[str] = []
        self.scores: list[int] = [0]
        self.back: list[int] = [0]
        self.checked = 0
        self.tail = ""

    def push(self, text: str) -> Iterator[int]:
        """Takes the text in steps of the longest piece, each with as many characters before it."""
        for first in range(0, len(text), self.reach):
            part = text[first : first + self.reach]
            context = self.tail
            base = len(self.chars) - len(context)
            self.chars.extend(part)
            self.scores.extend([None] * len(part))
            self.back.extend([0] * len(part))
            scores, back = self.scores, self.back
            at = base + len(context)
            for end, (length, score, _) in self.automaton.iter(context + part):
                end += base + 1
                if end > at:
                    self._unknown(at, end - 1)
                    at = end
                if end > base + len(context) and end - length >= 0:
                    total = scores[end - length] + score
                    if scores[end] is None or total > scores[end]:
                        scores[end], back[end] = total, end - length
            self._unknown(at, len(self.chars))
            self.tail = (context + part)[1 - self.reach :] if self.reach > 1 else ""
            yield from self._commit(self._meeting(len(self.chars)))

    def _unknown(self, first: int, last: int) -> None:
        """Bytes for the characters behind the positions up to ``last`` that no piece reaches."""
        for end in range(first, last + 1):
            if self.scores[end] is None:
                self.scores[end] = self.scores[end - 1] + self.byte_score * len(self.chars[end - 1].encode("utf-8", "surrogatepass"))
                self.back[end] = end - 1

    def _meeting(self, end: int) -> int:
        """The last boundary on the best paths of all open positions."""
        open_ = set(range(max(0, end - self.reach + 1), end + 1))
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(self.back[last])
        return open_.pop()

    def _commit(self, at: int) -> Iterator[int]:
        if at > 0:
            yield from self._ids(at)
            base = self.scores[at]
            self.chars = self.chars[at:]
            self.scores = [s - base for s in self.scores[at:]]
            self.back = [max(0, b - at) for b in self.back[at:]]
            self.tail = self.tail[-len(self.chars) :] if self.chars else ""

    def _ids(self, at: int) -> list[int]:
        out = []
        while at > 0:
            start = self.back[at]
            text = "".join(self.chars[start:at])
            piece = self.pieces.get(text)
            if piece is not None:
                out.append(piece[0])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text.encode("utf-8", "surrogatepass")))
            at = start
        return out[::-1]

    def finish(self) -> Iterator[int]:
        yield from self._ids(len(self.chars))
        self._clear()


class PieceTable:
    """Pieces by the hash of their characters, looked up for whole arrays (open addressing)."""

    BITS = 20
    BASE = np.uint64(0xD1342543DE82EF95)

    def __init__(self, vocabulary: Vocabulary) -> None:
        size = 1 << self.BITS
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        texts = list(vocabulary.pieces)
        self.ids = np.array([vocabulary.pieces[t][0] for t in texts], np.int32)
        self.scores = np.array([vocabulary.pieces[t][1] for t in texts] + [_NEVER], np.int64)
        sizes = np.array([len(t) for t in texts])
        hashes = np.zeros(len(texts), np.uint64)
        for length in np.unique(sizes):
            own = np.flatnonzero(sizes == length)
            chars = np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
            for k in range(length):
                hashes[own] = self.step(hashes[own], chars[:, k].astype(np.uint64))
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        for row, slot in enumerate(self.slots(hashes).tolist()):
            while self.rows[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.rows[slot] = hashes[row], row
        self.taken = self.rows >= 0

    def step(self, hashes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(29))) * self.BASE + chars + np.uint64(1)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each piece, -1 for what is none (which has the score of never). Most are none, and most of those meet
        an empty slot."""
        out = np.full(hashes.size, -1, np.int32)
        slot = self.slots(hashes.reshape(-1))
        at = np.flatnonzero(self.taken[slot])
        slot, keys = slot[at], hashes.reshape(-1)[at]
        while len(at):
            rows, same = self.rows[slot], self.keys[slot] == keys
            out[at[same]] = rows[same]
            left = ~same & (rows >= 0)
            at, slot, keys = at[left], (slot[left] + 1) % (1 << self.BITS), keys[left]
        return out.reshape(hashes.shape)


class Encoder(dict):
    """Ids of words as packed 4-byte numbers. New words of a batch go through the search together, by length.

    A word up to ``LONGEST_WORD`` fits one window, so nothing is committed before its end and the step over its
    positions is the same for all words of a length. Longer words and unknown characters take ``StreamingViterbi``.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.search = StreamingViterbi(vocabulary)
        self.table = PieceTable(vocabulary)
        self.texts = vocabulary.texts

    def __missing__(self, word: str) -> bytes:
        return array("i", [*self.search.push(word), *self.search.finish()]).tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > CACHE_WORDS:
            kept = {w: self[w] for w in words.intersection(self)}
            self.clear()
            self.update(kept)
        by_length: dict[int, list[str]] = {}
        for word in words.difference(self):
            if len(word) <= LONGEST_WORD:
                by_length.setdefault(len(word), []).append(word)
        for length, own in by_length.items():
            for k in range(0, len(own), 20_000):
                self._solve(own[k : k + 20_000], length)

    def _solve(self, words: list[str], length: int) -> None:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
        out, count, good = self.paths(chars.T.astype(np.uint64))
        packed = out.tobytes()
        for i, (word, n, ok) in enumerate(zip(words, count.tolist(), good.tolist(), strict=True)):
            self[word] = packed[4 * ((i + 1) * length - n) : 4 * (i + 1) * length] if ok else self.__missing__(word)

    def paths(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words in columns of characters: a row of ids for each, flush right, their number, and whether pieces alone
        make up the word."""
        length, m = chars.shape
        reach = self.search.reach
        scores = np.zeros((length + 1, m), np.int64)
        back, rows = np.zeros((length + 1, m), np.int16), np.zeros((length + 1, m), np.int32)
        hashes = np.zeros((length, m), np.uint64)
        lines = np.arange(m)
        for end in range(1, length + 1):
            low = max(0, end - reach)
            hashes[low:end] = self.table.step(hashes[low:end], chars[end - 1])
            found = self.table.find(hashes[low:end])
            total = scores[low:end] + self.table.scores[found]
            best = np.argmax(total, axis=0)  # the first of equals: the longest piece
            scores[end] = np.maximum(total[best, lines], _NEVER)
            back[end] = best + low
            rows[end] = found[best, lines]
        out, count = np.zeros((m, length), np.int32), np.zeros(m, np.int64)
        at, good = np.full(m, length), scores[length] > _NEVER // 2
        live = lines
        for step in range(1, length + 1):
            out[live, length - step] = self.table.ids[rows[at[live], live]]
            count[live] += 1
            at[live] = back[at[live], live]
            live = live[at[live] > 0]
            if not len(live):
                break
        return out, count, good

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        parts = [_SEGMENT.findall(" " + t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        return [np.frombuffer(b"".join([self[w] for w in p]), "<i4") for p in parts]

    def decode(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.texts.__getitem__, ids))
        return data[1:].decode("utf-8", "surrogatepass")


class ColumnEncoder:
    """Ids of whole string columns: words are found as arrays of places and looked up by their 64-bit hashes (names, not
    confirmed by the letters); only new ones are searched for. At most ``COLUMN_WORDS`` are kept, or one column's."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.encoder = Encoder(vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.known, self.pool = arrays.Places(), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the bounds of the rows; a null has none."""
        data, bounds = arrays.utf8(column)
        full = bounds[1:] > bounds[:-1]
        data = np.insert(data, bounds[:-1][full], 32)
        bounds = bounds + np.append(0, np.cumsum(full))
        if not len(data):
            return np.zeros(0, np.int32), bounds
        first = segment_starts(data, bounds[:-1][full])
        last = np.append(first[1:], len(data))
        names = arrays._span_hashes(data, first, last)
        word = self.known.find(names)
        if (word < 0).any():
            self._learn(data, first, last, names, word)
        sizes = self.sizes[word]
        before = np.append(0, np.cumsum(sizes))
        ids = self.pool[np.repeat(self.starts[word] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.searchsorted(first, bounds)]

    def _learn(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, names: np.ndarray, word: np.ndarray) -> None:
        """Fills the gaps in ``word``."""
        new = np.flatnonzero(word < 0)
        own, at, back = np.unique(names[new], return_index=True, return_inverse=True)
        if len(self.starts) + len(own) > COLUMN_WORDS:
            self._clear()
            new = np.arange(len(names))
            own, at, back = np.unique(names, return_index=True, return_inverse=True)
        word[new] = len(self.starts) + back
        self.known.add(own, np.arange(len(self.starts), len(self.starts) + len(own), dtype=np.int32))
        sizes, pool = self._search(data, first[new[at]], last[new[at]])
        self.starts = np.append(self.starts, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32))
        self.sizes = np.append(self.sizes, sizes.astype(np.int32))
        self.pool = np.append(self.pool, pool)

    def _search(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and the ids. Words of a length are searched together, as in ``Encoder``."""
        size = last - first
        own = data[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        chars = np.frombuffer(own.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.add.reduceat((own & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        begin = np.cumsum(length) - length
        sizes, parts, other = np.zeros(len(first), np.int64), [], [np.flatnonzero(length > LONGEST_WORD)]
        for n in np.unique(length[length <= LONGEST_WORD]).tolist():
            same = np.flatnonzero(length == n)
            for k in range(0, len(same), 20_000):
                at = same[k : k + 20_000]
                out, count, good = self.encoder.paths(chars[begin[at] + np.arange(n)[:, None]].astype(np.uint64))
                other.append(at[~good])
                sizes[at] = count * good
                parts.append((at[good], out[(np.arange(n) >= n - count[:, None]) & good[:, None]]))
        for i in np.concatenate(other).tolist():
            found = np.frombuffer(self.encoder[chars[begin[i] : begin[i] + length[i]].tobytes().decode("utf-32-le", "surrogatepass")], "<i4")
            sizes[i] = len(found)
            parts.append((np.array([i]), found))
        pool, starts = np.zeros(sizes.sum(), np.int32), np.cumsum(sizes) - sizes
        for at, ids in parts:
            n = sizes[at]
            pool[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return sizes, pool


def segment_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the words of ``_SEGMENT`` begin in UTF-8 texts that stand one after the other from ``rows`` on, each with a
    space in front."""
    space, line = data == 32, data == 10
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins |= line
    begins[1:] |= line[:-1]
    begins[rows] = True
    # Of a word that goes on after , or . the first such place counts, if a letter up to U+024F is before it.
    stop = np.flatnonzero((data == 44) | (data == 46))
    word = np.searchsorted(np.flatnonzero(begins), stop, side="right")
    stop = stop[np.append(True, word[1:] != word[:-1])] if len(stop) else stop
    before, lead = data[stop - 1], data[np.maximum(stop - 2, 0)]
    latin = ((before | 32) >= 97) & ((before | 32) <= 122)
    latin |= (before >= 0x80) & (before < 0xC0) & (((lead >= 0xC3) & (lead <= 0xC8)) | ((lead == 0xC9) & (before <= 0x8F)))
    begins[stop[latin]] = True
    return np.flatnonzero(begins)


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """One row per document: doc_id, ids, n_ids, round_trip (the ids decode to the very text).

    A null text has null ids, an empty one none. Rows are independent: repeated rows and rows without an id are treated
    like any other. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for first, last in arrays.chunks(arrays.utf8(batch.column("text"))[1], CHUNK_BYTES):
                part = batch.slice(first, last - first)
                texts = part.column("text").to_pylist()
                parts = encoder.encode_all([t or "" for t in texts])
                counts = [None if t is None else len(ids) for t, ids in zip(texts, parts, strict=True)]
                same = [None if t is None else encoder.decode(ids.tolist()) == t for t, ids in zip(texts, parts, strict=True)]
                # A null text has a null list of no ids.
                bounds = np.cumsum([0] + [c or 0 for c in counts]).astype(np.int32)
                values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)), mask=pa.array([c is None for c in counts], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(counts, pa.int32()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids int, round_trip boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the inverse of ``encode``. Null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
