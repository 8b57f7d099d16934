"""Joins, ranks and limits that stay balanced when one group holds a large part of the rows.

A window partitioned by ``repo`` sends a whole repository to one task. The helpers below give
the same answers from groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN_WAYS = 32
LEVEL_BITS = 16  # 65,536 values in a block, and blocks in a block of blocks
LEVELS = 64 // LEVEL_BITS


def salt_of(*columns: str, ways: int = JOIN_WAYS) -> Column:
    return F.expr(f"int(pmod(xxhash64({', '.join(columns)}), {ways}))")


def salts(ways: int = JOIN_WAYS) -> Column:
    return F.expr(f"sequence(0, {ways - 1})")


def join_hot(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    ways: int = JOIN_WAYS,
) -> DataFrame:
    """Equi-join whose left side may hold very many rows of one key.

    Left rows of a key are spread over ``ways`` partitions by other columns; the right side, a
    much smaller aggregate, is repeated once per way. Spark still broadcasts the right side by
    itself when its measured size allows.
    """
    salted = left.withColumn("_salt", salt_of(*salt_by, ways=ways))
    repeated = right.withColumn("_salt", F.explode(salts(ways)))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def _blocks_below(df: DataFrame, keys: Sequence[str], seq: str, limit: int | None) -> DataFrame:
    """``(*keys, _block1, _earlier)``: the blocks of ``seq`` values with the number of rows before each.

    A bigint has four digits of ``LEVEL_BITS`` bits. Rows are counted per block of the values that
    share all digits but the last; counts are summed per block of blocks, and so on. Then running totals
    go down the tree: each is taken within one parent, so over 65,536 counts at most, however the values lie.
    With a limit, blocks that begin beyond it are dropped on the way down.
    """
    counts = {1: df.groupBy(*keys, F.expr(f"shiftright(bigint({seq}), {LEVEL_BITS})").alias("_block1")).agg(F.count("*").alias("_rows"))}
    for level in range(2, LEVELS):
        parent = F.expr(f"shiftright(_block{level - 1}, {LEVEL_BITS})").alias(f"_block{level}")
        counts[level] = counts[level - 1].groupBy(*keys, parent).agg(F.sum("_rows").alias("_rows"))
    above = None
    for level in reversed(range(1, LEVELS)):
        own, parents = counts[level], list(keys)
        if above is not None:
            own = own.withColumn(f"_block{level + 1}", F.expr(f"shiftright(_block{level}, {LEVEL_BITS})"))
            parents = [*keys, f"_block{level + 1}"]
            own = own.join(above.withColumnRenamed("_earlier", "_base"), parents)
        before = (
            f"sum(_rows) OVER (PARTITION BY {', '.join(parents)} ORDER BY _block{level} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        )
        base = "0L" if above is None else "_base"
        above = own.selectExpr(*keys, f"_block{level}", f"{base} + coalesce({before}, 0L) AS _earlier")
        if limit is not None:
            above = above.where(F.col("_earlier") < limit)
    return above


def row_numbers(
    df: DataFrame, keys: Sequence[str], seq: str, name: str = "rn", ties: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Row number per key in ``seq`` order, for groups of any size and any values of ``seq``.

    ``seq`` is unique per key, or rows that share a value are few and ordered by ``ties``. Rows are numbered
    inside their block of 65,536 values and moved by the rows before the block. With a limit only the rows up
    to it are returned.
    """
    blocked = df.withColumn("_block1", F.expr(f"shiftright(bigint({seq}), {LEVEL_BITS})"))
    by, order = ", ".join([*keys, "_block1"]), ", ".join([seq, *ties])
    inside = f"row_number() OVER (PARTITION BY {by} ORDER BY {order})"
    placed = blocked.join(_blocks_below(df, keys, seq, limit), [*keys, "_block1"])
    numbered = placed.withColumn(name, F.expr(f"_earlier + {inside}")).drop("_block1", "_earlier")
    return numbered if limit is None else numbered.where(F.col(name) <= limit)


def first_n(df: DataFrame, keys: Sequence[str], seq: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows per key in ``seq`` order, one way for every ``n``."""
    return row_numbers(df, keys, seq, "_rn", ties, n).drop("_rn").select(df.columns)
