"""License scan: families, unknown wording, clean paragraphs and edge cases."""

from __future__ import annotations

import os
import re

from forgelens.llm.license_scan import TEMPLATES, scan, train

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")


def test_families_and_clean_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = train(docs)
    assert len(model.anchors) < 200
    found = {(r.doc_id, r.paragraph): r for r in scan(docs, model).collect()}
    lines = {(i, k): line for i, t in docs.collect() for k, line in enumerate((t or "").split("\n"))}
    known = {t: f for f, texts in TEMPLATES.items() for t in texts}
    assert {k for k, line in lines.items() if line in known} <= set(found)
    for key, r in found.items():
        assert r.body == lines[key]
        if lines[key] in known:
            assert r.family == known[lines[key]] and r.confirmed, r
        else:
            assert re.search("(?i)licen|copyright|rights|permi|gnu|domain|distribut", lines[key]), r
    cases = [
        (1, "x\nlicensed under the APACHE license version 2.0\n\nAll rights reserved"),
        (2, "Licensed under the Quux Public Licence of the moon, a license of its own terms."),
        (3, None), (4, ""), (5, "\n\n \n"), (None, "Released under the MIT License."), (6, "the and of the work is in this"),
        (7, "word " * 30_000 + "\nReleased under the MIT License."), (7, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(i, t, "f", 1.0) for i, t in cases], "doc_id long, text string, family string, p double")
    got = sorted(((r.doc_id or 0, r.paragraph, r.family) for r in scan(df, model).collect()))
    assert [x for x in got if x[0] != 2] == [(0, 0, "mit"), (1, 1, "apache-2.0"), (1, 3, "proprietary"), (7, 0, "mit"), (7, 1, "mit")]
    assert [x[2] for x in got if x[0] == 2] in ([], ["unknown"])
    plan = scan(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_notices_wrapped_over_lines(spark):
    model = train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    cases = [(1, "A file\n\n" + mit, 2, "mit"), (2, gpl.format(3), 1, "gpl-3.0"), (3, "x\n\n" + gpl.format(2), 3, "gpl-2.0"), (4, mit.replace("a copy\nof", "a copy\n\nof"), None, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")
    got = [(r.doc_id, r.paragraph, r.family) for r in scan(df, model).where("confirmed").collect()]
    assert sorted(got) == [(i, k, f) for i, _, k, f in cases if f], got


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan(docs, train(docs)).count() == 0
