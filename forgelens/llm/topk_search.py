"""Exact top-k inner products over norm-sorted vectors, pruned by Cauchy-Schwarz bounds on SVD-rotated partial sums.

Components are turned into integers floor(scale * x), so scores are exact. Vectors are dealt by descending length and
sorted so inside each partition; the rotation comes from the SVD of a bounded sample and only decides how early bounds
bite. Queries are handled in blocks of bounded size that are broadcast; each starts from the scores against the
``seeds`` longest vectors. A partition is left when length alone can't reach the k-th score any more; before that, the
partial sums of the leading rotated components plus the product of the residual lengths exclude most vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forgelens.llm.staging import shuffle_partitions


@dataclass(frozen=True)
class Search:
    k: int = 5
    scale: float = 256.0
    query_block: int = 2048
    seeds: int = 2048
    sample: int = 4096
    rows: int = 512  # vectors of a step


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, ints, norm) of the vectors without null or non-finite components."""
    good = vectors.where("vec_id is not null and embedding is not null").where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))))
    scaled = lambda x: F.lit(scale) * x.cast("double")
    # From 2^52 on every double is whole, and further on too large for a bigint.
    ints = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < float(1 << 52), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    rows = good.select("vec_id", ints.alias("ints"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(lists: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, values in enumerate(lists):
        out[i, : len(values)] = values
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers, clipped to 64 bits where they don't fit."""
    most = (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in q], dtype=object) @ np.array([[int(v) for v in row] for row in x], dtype=object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best (score, vec_id) of every query, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.rotated = q @ rotation
        self.lead = max(1, q.shape[1] // 4)
        self.norm = np.linalg.norm(q, axis=1)
        self.rest = np.linalg.norm(self.rotated[:, self.lead :], axis=1)
        self.scores = np.full((len(q), k), np.iinfo(np.int64).min)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.filled = np.zeros(len(q), np.int64)

    def floor(self) -> np.ndarray:
        """What a vector must reach: the k-th score so far, or anything."""
        return np.where(self.filled >= self.k, self.scores[:, -1].astype(np.float64), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, rotation: np.ndarray) -> bool:
        """Takes vectors sorted by descending length; False if none of them or of any shorter one matters."""
        floor = self.floor()
        slack = 1e-9 * self.norm * norms[0] + 1e-3
        active = np.flatnonzero(self.norm * norms[0] + slack >= floor)
        # A query with a negative floor stays: a shorter vector may score higher.
        if not len(active):
            return False
        turned = x @ rotation
        rest = np.linalg.norm(turned[:, self.lead :], axis=1)
        bound = self.rotated[active, : self.lead] @ turned[:, : self.lead].T + np.outer(self.rest[active], rest) + slack[active, None]
        open_ = (bound >= floor[active, None]) & (self.ids[active, None] != ids[None, :])
        columns = np.flatnonzero(open_.any(axis=0))
        lines = np.flatnonzero(open_.any(axis=1))
        if len(columns):
            scores = _products(self.q[active[lines]], x[columns])
            for line, row in zip(lines, scores, strict=True):
                q, own = active[line], open_[line, columns]
                values, names = np.append(self.scores[q, : self.filled[q]], row[own]), np.append(self.found[q, : self.filled[q]], ids[columns][own])
                order = np.lexsort((names, -values.astype(object) if values.min(initial=0) == np.iinfo(np.int64).min else -values))[: self.k]
                self.filled[q] = len(order)
                self.scores[q, : len(order)], self.found[q, : len(order)] = values[order], names[order]
        return True


def top_k(vectors: DataFrame, every: int = 50, how: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of each vector whose id is divisible by ``every``.

    Candidates are all rows that don't carry the query's id. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; a shorter vector counts as filled up with zeros. Of rows that
    repeat a query's id the greatest vector asks; repeated candidates all count. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, how.scale)
    asking = rows.where(F.col("vec_id") % every == 0)
    width, total = rows.agg(F.max(F.size("ints"))).head()[0] or 0, asking.count()
    blocks = total // how.query_block + 1
    sample = _matrix([r[0] for r in rows.orderBy(F.xxhash64("vec_id")).limit(how.sample).select("ints").collect()], width)
    rotation = np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) and width else np.eye(max(width, 1))[:width, :width]
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(how.seeds).collect()
    seeds = (np.array([r["vec_id"] for r in longest], np.int64), _matrix([r["ints"] for r in longest], width), np.array([r["norm"] for r in longest]))
    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    schema = "query_id long, vec_id long, score long"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        own = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).groupBy("vec_id").agg(F.max("ints").alias("ints")).orderBy("vec_id").collect()
        if own:
            ids, q = np.array([r["vec_id"] for r in own], np.int64), _matrix([r["ints"] for r in own], width)
            first = Best(ids, q, rotation, how.k)
            for k in range(0, len(seeds[0]), how.rows):
                part = slice(k, k + how.rows)
                if not first.add(*(s[part] for s in seeds), rotation):
                    break
            task = _searcher(spark.sparkContext.broadcast((ids, q, rotation, first.floor())), width, how)
            out = out.unionByName(dealt.mapInArrow(task, schema))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, width: int, how: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, rotation, floor = shared.value
        best = Best(ids, q, rotation, how.k)
        own = best.floor
        best.floor = lambda: np.maximum(own(), floor)
        more = True
        for batch in batches:
            for k in range(0, batch.num_rows if more else 0, how.rows):
                part = batch.slice(k, how.rows)
                names, norms = (np.asarray(part.column(c)) for c in ("vec_id", "norm"))
                more = best.add(names, _matrix(part.column("ints").to_pylist(), width), norms, rotation)
                if not more:
                    break
            if not more:
                break
        for line in range(0, len(ids), 4096):
            at = [(i, n) for i in range(line, min(line + 4096, len(ids))) for n in range(best.filled[i])]
            if at:
                i, n = np.array(at).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(best.found[i, n]), pa.array(best.scores[i, n])], names=["query_id", "vec_id", "score"])

    return run
