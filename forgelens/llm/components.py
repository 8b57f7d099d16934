"""Connected components of an edge table by contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm.staging import staged


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: every node but the least of its component there, with that least one."""
    above: dict = {}

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for k in range(0, len(nodes), 10_000):
        own = nodes[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([top(x) for x in own], kind.field("a").type), pa.array(own, kind.field("b").type)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (columns a, b); equal roots mean one component.

    In each round every partition turns its edges into stars, which leaves no more edges than it has nodes; then every
    node gives way to the least of itself and its neighbours. Nodes should be random values, such as digests: a round
    then removes a constant share of them, so rounds grow as the logarithm of the longest path at most.
    """
    kinds = dict(edges.dtypes)

    def reduced(found: DataFrame) -> DataFrame:
        return staged(found.where("a <> b").distinct().mapInArrow(_stars, f"a {kinds['a']}, b {kinds['b']}"), "edges")

    left = reduced(edges.select("a", "b"))
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "parents")
        if roots is None:
            roots = parents
        else:
            above = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = staged(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
        first, second = (parents.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        left = reduced(left.join(first, "a").join(second, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
