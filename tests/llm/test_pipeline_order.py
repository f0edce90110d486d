"""The mixture's order in the rows that the pipeline gives."""

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_has_the_schedule(spark):
    import corpus_pipeline as cp
    from juristrata.llm import mixing

    got = {r["doc_id"]: (r["slot"], r["place"]) for r in cp.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IS NOT NULL")
    left = docs.join(spark.createDataFrame([(k,) for k in got], "doc_id long"), "doc_id", "left_semi")
    want = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.mix(left, power=cp.MIX_POWER).collect()}
    assert got == want and len(set(got.values())) == len(got)
    # The stage before writes its rows in this very order.
    order = [r["doc_id"] for r in mixing.in_mixture_order(left, power=cp.MIX_POWER).collect()]
    assert order == sorted(got, key=got.get)
