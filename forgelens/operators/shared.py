"""One intermediate result for several parts of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shared(df: DataFrame) -> DataFrame:
    """The same rows, behind a condition that always holds but that the optimizer neither evaluates nor passes.

    Where a frame that ends in a grouping is read in several places, each place would otherwise be given the filters and
    columns that it needs, and differing plans are computed one by one. Behind the condition they stay equal, so Spark
    runs the shuffle below once and reuses it. Nothing is written and no job runs while the plan is built.
    """
    columns = ", ".join(f"`{c}`" for c in df.columns)
    return df.where(f"bigint(hash({columns})) + spark_partition_id() >= -4294967296L")
