"""The balanced joins, ranks and limits against brute force, with one group of many rows."""

from __future__ import annotations

import random

import pytest

from forgelens.operators import skew


@pytest.fixture
def frame(spark):
    rng = random.Random(5)
    data = []
    for repo, n in (("hot", 5000), ("b", 40), ("c", 1), ("d", 700)):
        data += [(repo, s) for s in rng.sample(range(-2000, 10_000_000, 97), n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "repo string, seq bigint"), data


def first(data, n):
    expected = []
    for repo in {r for r, _ in data}:
        expected += [(repo, s) for s in sorted(s for r, s in data if r == repo)[:n]]
    return sorted(expected, key=repr)


def test_row_numbers(frame, rows):
    df, data = frame
    expected = []
    for repo in {r for r, _ in data}:
        expected += [(repo, s, i) for i, s in enumerate(sorted(s for r, s in data if r == repo), 1)]
    assert rows(skew.row_numbers(df, ["repo"], "seq")) == sorted(expected, key=repr)


@pytest.mark.parametrize("n", [0, 1, 39, 600, 650, 10_000])
def test_first_n(frame, rows, n):
    df, data = frame
    assert rows(skew.first_n(df, ["repo"], "seq", n)) == first(data, n)


@pytest.fixture
def wide(spark):
    """Values over the whole range of a bigint, dense in some places and sparse in others."""
    rng = random.Random(9)
    values = {-(2**63), 2**63 - 1, 0, -1, 1, 65_535, 65_536, -65_536, 2**32, 2**48 - 1, -(2**48)}
    values |= {rng.randrange(-(2**63), 2**63) for _ in range(3_000)}
    for start in (-(2**40), 2**62, 5 * 2**32 - 300):
        values |= set(range(start, start + 700))
    data = [("a", v) for v in values] + [("b", v) for v in rng.sample(sorted(values), 900)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "repo string, seq bigint"), data


def test_row_numbers_over_the_range_of_a_bigint(wide, rows):
    df, data = wide
    expected = []
    for repo in ("a", "b"):
        expected += [(repo, s, i) for i, s in enumerate(sorted(s for r, s in data if r == repo), 1)]
    assert rows(skew.row_numbers(df, ["repo"], "seq")) == sorted(expected, key=repr)


@pytest.mark.parametrize("n", [0, 1, 899, 2_500, 10**6])
def test_first_n_over_the_range_of_a_bigint(wide, rows, n):
    df, data = wide
    assert rows(skew.first_n(df, ["repo"], "seq", n)) == first(data, n)


def test_no_window_sees_more_than_a_block(spark):
    """Every running total is taken within one parent block; the counts of a level share its digits."""
    df = spark.range(0, 3_000_000, 1, 8).selectExpr("'r' AS repo", "id * 7 AS seq")
    blocks = skew._blocks_below(df, ["repo"], "seq", None)
    sizes = df.selectExpr("shiftright(seq, 16) AS b").groupBy("b").count()
    assert sizes.selectExpr("max(`count`)").head()[0] <= 65_536
    assert blocks.count() == sizes.count() == 3_000_000 * 7 // 65_536 + 1
    top = blocks.selectExpr("max(_earlier)").head()[0]
    assert top == 3_000_000 - df.where(f"seq >= {(sizes.count() - 1) << 16}").count()


def test_ties_are_ordered_by_the_next_columns(spark, rows):
    data = [("r", 5, d) for d in range(4)] + [("r", 3, 9), ("r", 70_000, 0)]
    df = spark.createDataFrame(data, "repo string, seq bigint, depth int")
    assert rows(skew.first_n(df, ["repo"], "seq", 3, ["depth"])) == [("r", 3, 9), ("r", 5, 0), ("r", 5, 1)]


def test_join_hot_equals_join(spark, frame, rows):
    df, _ = frame
    totals = df.groupBy("repo").count()
    assert rows(skew.join_hot(df, totals, ["repo"], ["seq"])) == rows(df.join(totals, "repo"))
    partial = totals.where("repo <> 'hot'")
    assert rows(skew.join_hot(df, partial, ["repo"], ["seq"], "left")) == rows(df.join(partial, "repo", "left"))
