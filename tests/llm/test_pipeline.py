"""The pipeline, stage by stage, on the smallest documents; and its guard."""

import importlib.util
import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline as cp
    from juristrata.llm import exact_dedup, minhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert after.columns == columns
        tables[name], docs = (docs, after), after
    ids = lambda df: [r[0] for r in df.select("doc_id").collect()]
    before, after = tables["exact_dedup"]
    kept = {r["doc_id"] for r in exact_dedup.exact_dedup(before).where("kept").collect()}
    assert set(ids(after)) == kept
    before, after = tables["near_dedup"]
    found = minhash.near_dedup(before).collect()
    assert sorted(ids(after)) == sorted({r["component_id"] for r in found})
    before, after = tables["mixing"]
    assert sorted(ids(before)) == sorted(ids(after)) and ids(before) != ids(after)
    before, after = tables["bpe"]
    assert sorted(ids(before)) == sorted(ids(after))
    before, after = tables["language_id"]
    assert set(ids(after)) <= set(ids(before))
    assert sorted(ids(cp.run(spark, SF))) == sorted(ids(tables["bpe"][1]))


def test_registration():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and importlib.util.find_spec("corpus_pipeline")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_minhash", "op3_line_dedup", "op4_exact_dedup", "op5_mixing"])
def test_sql(spark, name):
    import duckdb

    from juristrata.llm import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cursor = db.execute(queries.SQL[name])
    columns = sorted(df.columns)
    want = [dict(zip([d[0] for d in cursor.description], r, strict=True)) for r in cursor.fetchall()]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[c] for c in columns]) for r in want)
