"""Quality classification by compression.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text is compressed
with each; the difference of the compressed sizes is normalised by their sum and by the text's size, and a logistic
curve over these and the logarithm of the compression ratio (repetitive texts compress well with either dictionary,
so their difference says less), fitted on labelled rows that did not feed the dictionaries, turns them into a
probability. Inputs are texts only.

Learning: at most PER_CLASS labelled ids a class, those with the smallest hashes, and of these, in that order, whole
texts up to CLASS_BYTES a class (a bounded, documented sample); a text of more than a 64th of that is passed over.
Texts alternate between the dictionaries and the curve.

Defined cases: a null or empty text has all features 0, as a text of equal, uncompressed sizes has; rows without a label are scored like all
others; where a class has no labelled row, every score is the share of good rows (0.5 if there are none); repeated
labels of a document count once each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import class_sample, discard, materialize, small_batches

PER_CLASS = 2500
CLASS_BYTES = 12_000_000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3


FEATURES = 3


class Model:
    """good, bad: dictionaries, or None; weights: of the logistic curve, its offset last."""

    def __init__(self, good: bytes | None, bad: bytes | None, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights

    def __getstate__(self):
        return self.good, self.bad, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def ready(self) -> None:
        """Make the compressors, which cannot be pickled."""

        def make(dictionary: bytes) -> zstandard.ZstdCompressor:
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)

        self.tools = (make(self.good), make(self.bad)) if self.good else None

    def features(self, text: str | None) -> list[float]:
        if not text or not self.tools:
            return [0.0] * FEATURES
        data = text.encode("utf-8", "replace")
        good, bad = (len(t.compress(data)) for t in self.tools)
        return [(bad - good) / (bad + good), (bad - good) / len(data), math.log(min(good, bad) / len(data))]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, [*self.features(text), 1.0], strict=True))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton's method on standardised features, lightly regularised."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w)), z.T @ (p - y) + 1e-3 * w)
        w -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
    slopes = w[:-1] / scale
    return [*map(float, slopes), float(w[-1] - slopes @ mean)]


def fit(rows: list[tuple[int, str]]) -> Model:
    """rows: (label, text) in a fixed order; odd ones make the dictionaries, even ones the curve."""
    by = {q: [t for label, t in rows if label == q and t] for q in (0, 1)}
    n = {q: sum(label == q for label, _ in rows) for q in (0, 1)}
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(map(len, by.values())) < 16:
        return Model(None, None, [0.0] * FEATURES + [prior])
    dictionaries = {}
    for q in (0, 1):
        samples = [t.encode("utf-8", "replace") for t in by[q][1::2]]
        try:
            dictionaries[q] = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to choose from: the text itself is the dictionary
            dictionaries[q] = b"".join(samples)[-DICTIONARY_BYTES:]
    model = Model(dictionaries[1], dictionaries[0], [])
    model.ready()
    x = np.array([model.features(t) for q in (0, 1) for t in by[q][::2]])
    y = np.array([float(q) for q in (0, 1) for _ in by[q][::2]])
    return Model(model.good, model.bad, curve(x, y))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows where `learn` (a condition on doc_id) holds."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(learn & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    marked = marked.select("doc_id", "label", F.xxhash64("doc_id", F.lit(6)).alias("h"))
    picked = materialize(class_sample(marked, "label", "h", PER_CLASS).distinct(), "quality-sample")  # at most 2 PER_CLASS rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    # Of rows that share an id one text counts, so repeated rows are not learnt from twice.
    rows = materialize(rows.groupBy("label", "h").agg(F.min("text").alias("text")), "quality-texts")
    sizes = rows.select("label", "h", F.octet_length("text").alias("size")).collect()
    chosen = affordable([(r[0], r[1], r[2]) for r in sizes])
    wanted = docs.sparkSession.createDataFrame(chosen or [(None, None)], "label int, h long")
    got = rows.join(F.broadcast(wanted), ["label", "h"]).collect()
    discard(docs.sparkSession, picked)
    discard(docs.sparkSession, rows)
    return fit([(r["label"], r["text"]) for r in sorted(got, key=lambda r: (r["h"], r["label"]))])


def affordable(sizes: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(label, h) of the texts, in the order of h, that CLASS_BYTES a class has room for. A text that is longer than a
    64th of that, or that does not fit any more, is passed over and ends nothing."""
    left, chosen = {0: CLASS_BYTES, 1: CLASS_BYTES}, []
    for label, h, size in sorted(sizes, key=lambda r: (r[1], r[0])):
        if size <= min(CLASS_BYTES // 64, left[label]):
            left[label] -= size
            chosen.append((label, h))
    return chosen


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, score."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        m.ready()
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([m.score(t) for t in rb.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return narrow.mapInArrow(run, f"doc_id {kind}, score double")
