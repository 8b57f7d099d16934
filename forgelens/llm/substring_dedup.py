"""Substring dedup over words: runs that repeat anywhere are removed, by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from forgelens.llm import arrays
from forgelens.llm.repeats import Rule, _places, repeated_windows, tagged

#: A perfect difference cover of 21: five anchors in 21 positions, 15 words each for windows of 35.
WORD_RULE = Rule(unit="word", width=35, period=21, cover=(0, 1, 4, 14, 16), smaller_only=False, chunk_bytes=8 << 20)

_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def remove_repeated_words(documents: DataFrame, rule: Rule = WORD_RULE, with_text: bool = True) -> DataFrame:
    """One row per document: n_words, n_removed, kept_text (unless ``with_text`` is off) and its SHA-256.

    Words are runs of other bytes than the six ASCII spaces. A word goes when a window of ``rule.width`` words that
    covers it starts at any other place too, in the same or another row. Null texts have no words (hash of the empty
    text). Repeated rows are copies like any other. Rows without a ``doc_id`` take no part and keep all their words.
    Columns other than doc_id and text are ignored.
    """
    texts = tagged(documents)
    found = repeated_windows(texts, rule)
    width = rule.width

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places").to_pylist()
            totals, removed, kept, digests = [], [], [], []
            for text, blobs in zip(batch.column("text"), places, strict=True):
                raw = text.as_py()
                words = raw.encode().split() if raw else []
                totals.append(len(words))
                if blobs:
                    gone = arrays.covered(np.unique(_places(blobs)), width, len(words))
                    words = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
                removed.append(totals[-1] - len(words))
                rest = b" ".join(words)
                kept.append(rest.decode() if with_text else None)
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    rows = texts.join(found, ["doc_id", "tag"], "left")
    out = rows.select("doc_id", "text", "places").mapInArrow(finish, _RESULT)
    return out if with_text else out.drop("kept_text")
