"""Helpers that the operators share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from juristrata.llm import common


def test_folding_in_levels(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN_IN", 3)
    rows = [(b, t, bytes([t % 7])) for b in range(4) for t in range(50)]
    got = common.folded(spark.createDataFrame(rows, "block long, task long, part binary"), lambda pieces: (bytes([max(p[0][0] for p in pieces)]),), 50)
    assert sorted((r["block"], bytes(r["part"])) for r in got.collect()) == [(b, b"\x06") for b in range(4)]


def test_bitmap_filter_loses_nothing(spark):
    keys = spark.range(0, 3000, 7).select(F.xxhash64("id").alias("h"))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    bitmap = common.Bitmap(keys, "h")
    got = {r["id"] for r in bitmap.keep(rows, F.col("h")).collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 1000
    clear, doubted = bitmap.split(rows, F.col("h"))
    assert {r["id"] for r in doubted.collect()} == got and clear.count() == 3000 - len(got)


def test_filters_follow_the_number_of_keys_up_to_a_bound():
    assert common.filter_words(0) == 1 << 12 and common.filter_words(10**6) * 64 >= 16 * 10**6 and common.filter_words(10**12) == common.FILTER_WORDS


def test_hot_keys_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    rows = spark.createDataFrame([(0 if i < 500 else i % 40, i) for i in range(900)], "k long, i long")
    unique = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    met = common.meet(rows, unique, "k", "n", "i").cache()
    assert sorted((r["k"], r["i"]) for r in met.collect()) == sorted((r["k"], r["i"]) for r in rows.collect())
    assert met.where("k = 0").groupBy("n").count().collect()[0]["count"] == met.where("k = 0").first()["n"]


def test_scratch_tables_are_deleted(spark):
    scratch = common.Scratch(spark)
    a, b = scratch.table(spark.range(3), "a"), scratch.table(spark.range(4), "b")
    path = a.inputFiles()[0].rpartition("/")[0].removeprefix("file://").removeprefix("file:")
    import os

    assert os.path.isdir(path)
    scratch.close(b)
    assert not os.path.isdir(path) and b.count() == 4


def test_gathering_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(n))], names=["a"]) for n in (3, 3, 1, 5, 2)]
    assert [b.num_rows for b in common.gathered(iter(batches), 5)] == [6, 6, 2]


def test_held_out_follows_crc32(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", common.held_out(5, 0).alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
