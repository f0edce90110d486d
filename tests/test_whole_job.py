"""Queries over all of their input, on fixtures with rows that a cut would miss."""

import datetime

import duckdb
import numpy as np

from juristrata.operators import extract, search
from juristrata.plans import catalog


def test_concept_browse_sees_every_edge(spark, tmp_path):
    spark.createDataFrame([(1, "x", "ECONOMY"), (2, "y", "SMALL")], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    day = datetime.date(2020, 1, 1)
    lines = [(day + datetime.timedelta(k), k, 1 + k % 2, "RAN"[k % 3], 0.1) for k in range(14)] * 2
    spark.createDataFrame(lines, "l_shipdate date, l_suppkey long, l_partkey long, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.QUERIES["concept_browse"](spark, str(tmp_path)).collect()]
    links = [tuple(r) for r in catalog.QUERIES["concept_links"](spark, str(tmp_path)).collect()]
    action = {"R": "REPEALS", "A": "AMENDS", "N": "CITES"}
    want = {(c, str(s), action[f]) for p, c in links for _, s, part, f, _ in lines if p == part}
    assert len({s for _, s, _ in want}) == 14 and len(got) == len(want) and set(got) == want


def nearest(vectors, ids, k):
    """(query_id, pos, rank) by brute force over similarities rounded as the query's."""
    s = np.round(vectors[ids] @ vectors.T, 4)
    return {(q, int(p), r) for q, row in zip(ids, s, strict=True) for r, p in enumerate(np.lexsort((np.arange(len(row)), -row))[:k], 1)}


def test_topk_per_query_has_every_twentieth_row(spark, tmp_path):
    vectors = np.random.default_rng(3).normal(size=(130, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["topk_per_query"](spark, str(tmp_path)).collect()
    want = nearest(vectors, list(range(0, 130, 20)), 5)
    assert len(got) == len(want) and {(r["query_id"], r["pos"], r["rank"]) for r in got} == want
    blocks = search.batch_top_k(table, table.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q"), 5, pos="vec_id", query_rows=3)
    assert {(r["query_id"], r["pos"], r["rank"]) for r in blocks.collect()} == want


def test_topk_keeps_k_rows_a_query_and_task(spark):
    """However many Arrow batches a task reads, it hands on k rows a query."""
    vectors = np.random.default_rng(4).integers(-2, 3, size=(90, 4)) / 4.0  # many ties
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert search._block_top_k(table.coalesce(1), queries.toPandas(), 5, "vec_id", "embedding").count() == 5 * 5
        got = search.batch_top_k(table, queries, 5, pos="vec_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(r["query_id"], r["pos"], r["rank"]) for r in got} == nearest(vectors, list(range(0, 90, 20)), 5)


def test_best_of_tiles_equals_a_sort():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, k, m, level = (int(r.integers(1, x)) for x in (6, 7, 40, 12))
        s, ids = search._ordered(np.where(r.random((n, m)) < 0.05, np.nan, r.integers(-level, level + 1, (n, m)) / 10)), r.permutation(1000)[:m]
        best, split = search.Best(n, k, ids.dtype), int(r.integers(0, n + 1))
        for tile in np.array_split(r.permutation(m), r.integers(1, 5)):
            tile = tile[np.argsort(ids[tile])]
            for a, z in ((0, split), (split, n)):
                if a < z and len(tile):
                    best.add(a, s[a:z][:, tile], ids[tile])
        for q in range(n):
            order = np.lexsort((ids, -s[q]))[:k]
            assert best.held[q] == len(order) and (best.ids[q, : len(order)] == ids[order]).all() and (best.s[q, : len(order)] == s[q][order]).all()


def test_processable_caselaw_trims_as_its_sql(spark, tmp_path):
    inner = "x" * 48
    lines = [f"{inner}{end}" for end in ("xx", "xv", "x\x0b", "x\u00a0", "x ", "x\t", "x\x0c", "xvx")] + [f"v {inner}x", f"\x0b{inner}x", f"| TEXT:{inner}vv", f"{inner}xx| TEXT: short", ""]
    spark.createDataFrame([(5, "\n".join(lines)), (6, "x" * 60), (10, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(tuple(r) for r in catalog.QUERIES["processable_caselaw"](spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(catalog.SQL["processable_caselaw"]).fetchall()) and 0 < len(got) < len(lines)
    # The operator strips white space and no letter.
    chunks = spark.createDataFrame([("a", "judgment", "| TEXT: " + inner + "xv"), ("b", "judgment", "| TEXT: " + inner + "x\x0b")], "id string, source string, content string")
    assert [r["id"] for r in extract.processable(chunks).collect()] == ["a"]
