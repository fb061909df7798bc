"""The corpus pipeline's stages, one after the other, held against plain checks of each."""

import re

import pytest

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.test_packing import check
from tests.llm.test_pii import brute as pii_spans
from tests.llm.test_quality import brute as statistics


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], sf).cache()
        if name != "pack":
            assert out.columns == columns
        seen.append(out)
    rows = [{r.doc_id: r for r in df.collect()} for df in seen[:4]]
    # what the base rules reject is gone, and most clean documents stay
    clean = {i for i, r in rows[0].items() if not statistics(r.text)[5]}
    assert set(rows[1]) <= clean and len(rows[1]) >= 0.9 * len(clean)
    # what is left has no two equal texts
    assert len({r.text.lower() for r in rows[2].values()}) == len(rows[2]) and set(rows[2]) <= set(rows[1])
    for i, r in rows[3].items():
        assert pii_spans(r.text) == "" and r.n_chars == len(r.text)
        assert (r.text == rows[2][i].text) == (not re.search(r"\[(EMAIL|IP|CARD|PHONE|IBAN|SECRET|SSN|LOCAL_PHONE)\]", r.text))
    copies = seen[4].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.n for r in copies} <= {1, 2} and {r.doc_id for r in copies} <= set(rows[3])
    packed = seen[5].collect()
    check(packed, 2048)
    assert {r.doc_id for r in packed} == {r.doc_id for r in copies}


def test_run_and_edges(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"thing{i}" for i in range(80)) + " mail a@b.cd"
    rows = [(1, good, "en", "s", 5, "x"), (1, good, "en", "s", 5, "x"), (None, other, None, None, None, None), (2, None, "en", "s", 0, "x"), (3, other, "en", "t", 1, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, kept string"
    folder = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = cp.run(spark, folder).collect()
    assert {r.doc_id for r in out} <= {1, 3, None} and out
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert cp.run(spark, folder).count() == 0


NAMES = ["q_text", "q_words", "kept", "_kept", "place", "row", "p_text", "p_base", "clean", "_id", "_copy", "times", "m_rank", "size", "col"]


@pytest.mark.parametrize("name, stage", cp.STAGES[:-1])
def test_columns_of_any_name_pass_through(spark, sf, name, stage):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + " a@b.cd", "en", "s", 5) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in NAMES})
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c} of {r.doc_id}" for r in got for c in NAMES)
