"""Report rows as JSON with sorted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def as_json(df: DataFrame, key: str = "repo") -> DataFrame:
    return df.select(key, sorted_json(df).alias("report"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, keys sorted, NULL fields kept."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)
