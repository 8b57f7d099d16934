from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Not UTC on purpose: no result may depend on the session time zone.
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of a frame as sorted tuples, columns in the frame's order."""

    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in chosen.collect()), key=repr)

    return collect


@pytest.fixture
def value(spark):
    """One SQL expression over named text or other literal columns."""

    def evaluate(expr: str, schema: str = "", *data):
        fields = [f.split(" ", 1) for f in schema.split(", ")] if data else []
        inputs = ", ".join(f"cast(:{name} AS {kind}) AS {name}" for name, kind in fields) or "1 AS one"
        args = {name: F.array(*map(F.lit, v)) if isinstance(v, list) else v for (name, _), v in zip(fields, data)}
        return spark.sql(f"SELECT {expr} AS v FROM (SELECT {inputs})", args=args or None).head()["v"]

    return evaluate
