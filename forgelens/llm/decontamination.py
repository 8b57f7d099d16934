"""Benchmark decontamination: pigeonhole pieces found exactly, then verified by bit-parallel edit distance.

An item of m characters may differ from a passage by ``m // chars_per_error`` edits. Split into one piece more than
that, at least one piece survives every allowed edit, so it occurs exactly. All pieces are sought at once; around each
hit, Myers' bit-parallel algorithm gives the least distance between the whole item and any substring.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EditMatch:
    chars_per_error: int = 20  # error budget of an item: its length over this
    least_chars: int = 24  # shorter items are sought as they are, between characters that go on no word
    block_chars: int = 4_000_000  # items are sought in blocks of about so many characters


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length with their offsets."""
    edges = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any substring of the text, and the first end that attains it."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, at = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (full & ~(xh | vp))
        hn = vp & xh
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        vp = hn | (full & ~(xv | hp))
        vn = hp & xv
        if score < best:
            best, at = score, j
    return best, at


def stands_alone(text: str, start: int, end: int) -> bool:
    """No word goes on across the start or the end of a passage."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    return not before and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


def matches(text: str, automaton, items: dict[int, tuple[str, int, bool]]) -> Iterator[tuple[int, int, int, int]]:
    """(item number, start, end, distance) of the best match around each cluster of piece hits."""
    starts = defaultdict(set)
    for end, values in automaton.iter(text):
        for number, offset, length in values:
            starts[number].add(end + 1 - length - offset)
    for number, found in starts.items():
        item, errors, short = items[number]
        if short:  # one piece, the item itself: every hit is exact
            yield from ((number, s, s + len(item), 0) for s in sorted(found) if stands_alone(text, s, s + len(item)))
            continue
        clusters: list[list[int]] = []
        for s in sorted(found):
            if clusters and s - clusters[-1][1] <= 2 * errors:
                clusters[-1][1] = s
            else:
                clusters.append([s, s])
        for low, high in clusters:
            if low >= 0 and text.startswith(item, low):
                yield number, low, low + len(item), 0
                continue
            origin = max(0, low - errors)
            window = text[origin : high + len(item) + errors]
            distance, end = myers(item, window)
            if distance <= errors:
                _, back = myers(item[::-1], window[:end][::-1])
                yield number, origin + end - back, origin + end, distance


def contaminated(documents: DataFrame, benchmark: DataFrame, how: EditMatch = EditMatch()) -> DataFrame:
    """(doc_id, item_id, start_char, end_char, distance): passages of documents within the error budget of an item.

    Positions count characters of the normalised text (lower case, single spaces). Items below ``least_chars`` are found
    without errors and as whole words only; null and empty items and texts match nothing. Every item is sought in every document, by blocks of items; a repeated row gives its
    matches again, and a row without an id gives them with a null id. Other columns are ignored.
    """
    texts = documents.select("doc_id", "text").where("text is not null")
    out = None
    for rows in _blocks(benchmark, how):
        found = texts.mapInArrow(_seeker(rows, how), "doc_id long, item_id long, start_char long, end_char long, distance int")
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(documents: DataFrame, benchmark: DataFrame, how: EditMatch = EditMatch()) -> DataFrame:
    """The same columns, without the rows that hold a passage of an item; null texts stay."""
    for rows in _blocks(benchmark, how):
        documents = documents.mapInArrow(_seeker(rows, how, True), documents.schema)
    return documents


def _blocks(benchmark: DataFrame, how: EditMatch) -> Iterator[list[tuple]]:
    """The items, block by block."""
    given = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = given.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = total // how.block_chars + 1
    for block in range(blocks):
        yield [tuple(r) for r in given.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]


def _seeker(rows: list[tuple], how: EditMatch, drop: bool = False):
    """Matches of the batches' rows, or with ``drop`` the rows that have none."""
    items: dict[int, tuple[str, int, bool]] = {}
    for number, (_, text) in enumerate(rows):
        item = normal(text)
        if item:
            short = len(item) < how.least_chars
            items[number] = (item, 0 if short else len(item) // how.chars_per_error, short)
    names = [r[0] for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_piece = defaultdict(list)
        for number, (item, errors, _) in items.items():
            for offset, piece in pieces(item, errors):
                by_piece[piece].append((number, offset, len(piece)))
        automaton = ahocorasick.Automaton()
        for piece, values in by_piece.items():
            automaton.add_word(piece, values)
        if not by_piece:
            yield from batches if drop else ()
            return
        automaton.make_automaton()
        for batch in batches:
            if drop:
                texts = (normal(cell.as_py()) for cell in batch.column("text"))
                yield batch.filter(pa.array([next(matches(t, automaton, items), None) is None for t in texts], pa.bool_()))
                continue
            found = []
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for number, start, end, distance in matches(normal(cell.as_py()), automaton, items):
                    found.append((doc_id, names[number], start, end, distance))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start_char", "end_char", "distance"])

    return run
