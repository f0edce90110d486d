"""Language identification by hierarchical discrimination.

First a one-versus-rest linear support vector machine over language families, then, inside the predicted family,
one-versus-one linear support vector machines that vote between its closely related languages.

Features: counts of byte 1- to 4-grams of the lower-cased text, hashed into DIM buckets, square rooted and scaled to
length 1; the whole text is read, by numpy, in bounded blocks.
Learning: at most PER_LANGUAGE labelled ids of each language, those with the smallest hashes (a bounded, documented
sample; only its sparse features reach the driver). A third of them calibrates margins into probabilities (Platt's
method).

Defined cases: rows without an id are not learnt from, and of rows that share one a single text is; a null text, an empty one, or one without any letter is `und` with score 0; with no labelled rows at
all every text is `und`; with a single language that language is predicted for every text that has a letter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juristrata.llm.common import class_limits, release, small_batches

DIM = 1 << 13
PER_LANGUAGE = 500
BLOCK = 1 << 18
LETTER = regex.compile(r"\p{L}")

# Families of ISO 639-1 codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "cy", "gd", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "tk", "ky"],
    "indic": ["hi", "bn", "mr", "ne", "pa", "gu", "ur", "si"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "semitic": ["ar", "he", "mt", "am"],
    "austronesian": ["id", "ms", "tl", "jv", "mg"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(text: str) -> np.ndarray:
    """Dense hashed features of a whole text, scaled to length 1."""
    data = text.lower().encode("utf-8", "replace")
    counts = np.zeros(DIM)
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(b" " + data[at : at + BLOCK + 3] + b" ", np.uint8).astype(np.uint32)
        h = b * np.uint32(2654435761)
        word, grams = h, [h]
        for k in (1, 2, 3):
            word = (word[:-1] ^ (b[k:] + np.uint32(k * 977))) * np.uint32(16777619)
            grams.append(word)
        for g in grams:
            counts += np.bincount((g ^ (g >> np.uint32(15))) % np.uint32(DIM), minlength=DIM)
    x = np.sqrt(counts)
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """A linear SVM with squared hinge loss by dual coordinate descent on some rows of x, which is not copied; y is +1 or
    -1 for each of them, the last weight is the bias."""
    w, bias, a, order = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    q = np.array([float(x[r] @ x[r]) for r in rows]) + 1 + 0.5 / c
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            v = x[rows[i]]
            new = max(0.0, a[i] - (y[i] * (w @ v + bias) - 1 + a[i] * 0.5 / c) / q[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w += step * v
                bias += step
                a[i] = new
    return np.append(w, bias)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by Newton's method on softened targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    if not pos or not neg:
        return 4.0, 0.0
    t, z = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.column_stack([margin, np.ones(len(margin))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad, hess = z.T @ (p - t) + 1e-4 * w, (z * (p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return float(w[0]), float(w[1])


class Model:
    """families: names; languages of each family; weights of family machines and of pairs inside a family."""

    def __init__(self, x: np.ndarray, lang: list[str], calibrate: np.ndarray):
        lang_of = np.array(lang)
        family = np.array([FAMILY.get(v, f"only {v}") for v in lang])
        self.families = sorted(set(family))
        self.languages = {f: sorted(set(lang_of[family == f])) for f in self.families}
        fit = ~calibrate
        self.family_w, self.family_p, self.pair_w = np.zeros((len(self.families), DIM + 1)), [], {}

        def machine(rows: np.ndarray, y: np.ndarray):
            train, test = rows & fit, rows & calibrate
            if len(set(y[train])) < 2:
                train, test = rows, rows
            w = svm(x, np.flatnonzero(train), y[train])
            return w, platt((x @ w[:-1].astype(x.dtype))[test] + w[-1], y[test])

        everything = np.ones(len(lang), bool)
        if len(self.families) > 1:
            for k, f in enumerate(self.families):
                self.family_w[k], curve = machine(everything, np.where(family == f, 1.0, -1.0))
                self.family_p.append(curve)
        for f, langs in self.languages.items():
            for a, b in combinations(langs, 2):
                rows = (lang_of == a) | (lang_of == b)
                self.pair_w[f, a, b] = machine(rows, np.where(lang_of == a, 1.0, -1.0))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        chance = lambda m, curve: float(1 / (1 + np.exp(-np.clip(curve[0] * m + curve[1], -30, 30))))
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            p = np.array([chance(m, c) for m, c in zip(self.family_w[:, :-1] @ v + self.family_w[:, -1], self.family_p, strict=True)])
            family, sure = self.families[int(p.argmax())], float(p.max() / max(p.sum(), 1.0))
        langs = self.languages[family]
        if len(langs) == 1:
            return langs[0], sure
        votes, support = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            w, curve = self.pair_w[family, a, b]
            p = chance(float(w[:-1] @ v + w[-1]), curve)
            votes[a if p >= 0.5 else b] += 1
            support[a] += p
            support[b] += 1 - p
        best = max(langs, key=lambda v: (votes[v], support[v]))
        return best, sure * support[best] / (len(langs) - 1)


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on rows where `learn` holds, whose id, language and text are not null."""
    small_batches(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(8)).alias("h"), F.col(text_col).alias("text"))
    limits = class_limits(rows, "lang", "h", per_language)  # one row a language
    near = rows.join(F.broadcast(limits), "lang").where("upto IS NULL OR h <= upto")
    # Of rows that share an id one text counts, so repeated rows are not learnt from twice.
    picked = near.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        for rb in batches:
            out = []
            for t in rb.column(1).to_pylist():
                v = features(t).astype(np.float32)
                at = np.flatnonzero(v)
                out.append((at.astype("<u2").tobytes(), v[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary()), rb.column(2)], names=["lang", "at", "v", "h"])

    kind = "lang string, at binary, v binary, h long"
    got = sorted(tuple(r) for r in picked.select("lang", "text", F.xxhash64("h", F.lit(9)).alias("h")).mapInArrow(run, kind).collect())
    if not got:
        return None
    x = np.zeros((len(got), DIM), np.float32)
    for i, (_, at, v, _) in enumerate(got):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f4")
    model = Model(x, [g[0] for g in got], np.array([g[3] % 3 == 0 for g in got]))
    del got, x
    release()
    return model


def judge(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """A struct (lang_pred, score) for a text column; only the text goes to the workers."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = [m.predict(features(t)) if m and t and LETTER.search(t) else ("und", 0.0) for t in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return run(text)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, lang_pred, score."""
    judged = docs.select(F.col(id_col).alias("doc_id"), judge(docs.sparkSession, model, F.col(text_col)).alias("_lang"))
    return judged.select("doc_id", "_lang.lang_pred", "_lang.score")
