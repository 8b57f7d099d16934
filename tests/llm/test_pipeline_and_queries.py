"""The pipeline against its parts, and every query's columns; comparison SQL where there is any."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from forgelens.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registered():
    assert set(queries.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


def test_topk_sql(spark):
    name = "op6_topk_search"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, SF).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


def test_stages_one_by_one(spark, tmp_path):
    from forgelens.llm.decontamination import contaminated
    from forgelens.llm.minhash_dedup import near_duplicates
    from forgelens.llm.secret_scan import scan_secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        before, after = docs.count(), out.count()
        if number < 4:
            assert out.columns == docs.columns
        if number == 1:
            near = near_duplicates(docs)
            assert after == near.where("kept").count() < before
        if number == 2:
            bad = {r.doc_id for r in contaminated(docs, bench).collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
        if number == 3:
            assert after == before and scan_secrets(out).where("spans <> ''").count() == 0
        docs = out
    assert docs.where("not round_trip").count() == 0
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(docs.select("doc_id").collect())


def test_rows_of_one_id_with_other_texts_stay(spark):
    """One row of each group stays, also where rows of different groups carry one id."""
    first, second = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    rows = [(7, first), (7, second), (7, second), (7, second + " more"), (9, first), (3, "alone at last here now"), (7, ""), (7, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    kept_second = [t for i, t in found if i == 7 and t and t.startswith(second)]
    assert len(kept_second) == 1 and out.columns == docs.columns
    rest = [x for x in found if x[1] not in kept_second]
    assert rest == sorted([(7, first), (3, "alone at last here now"), (7, ""), (7, None), (8, None)], key=repr)


@pytest.mark.parametrize("case", ["edge", "empty"])
def test_stages_take_edge_rows(spark, case):
    rows = [] if case == "empty" else [(1, None, "en", "s", None), (2, "", "en", None, 0), (None, "password=abcdef1 x", None, "s", 3), (None, None, None, None, None), (4, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "s", 11), (5, "z" * 100_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        counts.append(docs.count())
    assert counts == ([0] * 5 if case == "empty" else [7, 6, 6, 6, 6])
