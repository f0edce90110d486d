"""op6 and op8 as registered, beside plain versions of their scores."""

import math
import os
import zlib

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from juristrata.llm import language_id, quality, queries
from juristrata.llm.common import held_out

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rest(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, ~held_out(5, 0))
    texts = dict(docs.select("doc_id", "text").collect())
    size = lambda t, d: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(t))
    got = queries.QUERIES["op6_quality"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        data, x = (texts[r["doc_id"]] or "").encode(), [0.0, 0.0, 0.0]
        if data and model.good:
            good, bad = size(data, model.good), size(data, model.bad)
            x = [(bad - good) / (bad + good), (bad - good) / len(data), math.log(min(good, bad) / len(data))]
        z = sum(w * v for w, v in zip(model.weights, [*x, 1.0], strict=True))
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert abs(r["score"] - p) < 1e-9 and r["held_out"] == (rest(r["doc_id"], 5) == 0) and r["predicted"] == int(p >= 0.3)


def grams(text):
    """Features counted one gram at a time."""
    data, counts = b" " + text.lower().encode() + b" ", np.zeros(language_id.DIM)
    m = 1 << 32
    for at in range(len(data)):
        h = 0
        for k in range(min(4, len(data) - at)):
            h = data[at] * 2654435761 % m if k == 0 else (h ^ (data[at + k] + k * 977)) * 16777619 % m
            counts[(h ^ (h >> 15)) % language_id.DIM] += 1
    x = np.sqrt(counts)
    return x / np.sqrt(x @ x)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, ~held_out(3, 1))
    texts = dict(docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) < 4000).collect())
    got = queries.QUERIES["op8_language_id"](spark, SF).collect()
    assert len(got) == docs.count()
    sure = lambda m, c: 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] * m + c[1]))))
    for r in got:
        assert r["held_out"] == (rest(r["doc_id"], 3) == 1)
        if r["doc_id"] not in texts:
            continue
        text = texts[r["doc_id"]]
        if not text or not regex.search(r"\p{L}", text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        v = grams(text)
        chances = [sure(float(w[:-1] @ v + w[-1]), c) for w, c in zip(model.family_w, model.family_p, strict=True)]
        best = max(range(len(chances)), key=chances.__getitem__)
        a, b = model.languages[model.families[best]]  # two languages a family in these tables
        w, c = model.pair_w[model.families[best], a, b]
        p = sure(float(w[:-1] @ v + w[-1]), c)
        assert r["lang_pred"] == (a if p >= 0.5 else b)
        assert abs(r["score"] - chances[best] / max(sum(chances), 1.0) * max(p, 1 - p)) < 1e-9
