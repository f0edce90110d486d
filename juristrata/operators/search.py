"""Vector index and search: exact cosine top-k, single query or many, hits joined to chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juristrata.functions.text import body, clean_heading, embedding_text
from juristrata.functions.vectors import dot, unit

THRESHOLD = 0.25


def build_index(chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]], size: int = 512) -> DataFrame:
    """(pos, node_id, doc_title, section, source, text, embedding): unit vectors of all chunks long enough.

    Positions are dealt in the order of seq, without one task holding all rows: counts of seq ranges first.
    """
    rows = chunks.withColumn("body", embedding_text(F.col("content"), size)).where("body IS NOT NULL")
    ranges = rows.withColumn("range", F.expr("seq div 100000"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("start", before).drop("n")
    pos = F.row_number().over(Window.partitionBy("range").orderBy("seq")) - 1
    numbered = ranges.withColumn("inside", pos).join(starts, "range").withColumn("pos", (F.col("inside") + F.col("start")).cast("int"))

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder(texts.tolist()))

    encoded = numbered.select("pos", F.col("id").alias("node_id"), "doc_title", "section", "source", F.left("body", F.lit(600)).alias("text"), encode("body").alias("embedding"))
    return encoded.withColumn("embedding", unit(F.col("embedding")))


def hashing_encoder(width: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model: signed hashed words."""
    import hashlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % width] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return encode


def top_k(index: DataFrame, query: list[float], k: int = 5, threshold: float | None = None, pos: str = "pos", vector: str = "embedding") -> DataFrame:
    """The k rows of the largest inner product with the query, ties to the smaller position (a bounded heap a task)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = index.withColumn("similarity", F.round(dot(F.col(vector), q), 4)).orderBy(F.desc("similarity"), pos).limit(k)
    return hits if threshold is None else hits.where(F.col("similarity") >= threshold)


CELLS = 1 << 20
"""Similarities that a task holds at once."""


def batch_top_k(index: DataFrame, queries: DataFrame, k: int = 5, pos: str = "pos", vector: str = "embedding", query_rows: int = 4096) -> DataFrame:
    """(query_id, pos, similarity, rank) for many queries (query_id, q) against all rows of the index.

    Queries come in blocks of at most query_rows (checked by a count), so each pass broadcasts a bounded table. The index
    is dealt to tasks by position; a task computes similarities in tiles of at most CELLS, keeps the k best of each query
    over all that it reads, and only these are shuffled."""
    total = queries.count()
    blocks = max(1, -(-total // query_rows))
    parts = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]
    dealt = index.select(pos, vector).repartition(2 * index.sparkSession.sparkContext.defaultParallelism, pos)
    found = None
    for part in parts:
        got = part.select("query_id", "q").toPandas()
        hits = _block_top_k(dealt, got, k, pos, vector)
        found = hits if found is None else found.unionAll(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "pos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _block_top_k(index: DataFrame, queries: pd.DataFrame, k: int, pos: str, vector: str) -> DataFrame:
    import numpy as np

    shared = index.sparkSession.sparkContext.broadcast((queries["query_id"].to_numpy(), np.array(queries["q"].tolist(), float)))
    kind = index.schema[pos].dataType.simpleString()

    def run(frames):
        names, q = shared.value
        best = None
        for frame in frames:
            if not len(frame) or not len(q):
                continue
            frame = frame.sort_values(pos)
            rows, ids = np.array(frame[vector].tolist(), float), frame[pos].to_numpy()
            best = best or Best(len(q), k, ids.dtype)
            wide = max(1, min(len(ids), CELLS // 256))
            tall = max(1, CELLS // wide)
            for a in range(0, len(q), tall):
                for b in range(0, len(ids), wide):
                    best.add(a, _ordered(np.round(q[a : a + tall] @ rows[b : b + wide].T, 4)), ids[b : b + wide])
        if best is not None:
            at, place = np.nonzero(np.arange(k) < best.held[:, None])
            yield pd.DataFrame({"query_id": names[at], "pos": best.ids[at, place], "similarity": _plain(best.s[at, place])})

    return index.select(pos, vector).mapInPandas(run, f"query_id bigint, pos {kind}, similarity double")


LARGEST = 1.7976931348623157e308


def _ordered(s):
    """Similarities with NaN as the greatest value, as in SQL: it becomes infinite, and what is infinite the largest number."""
    import numpy as np

    return s if np.isfinite(s).all() else np.where(np.isnan(s), np.inf, np.where(s == np.inf, LARGEST, s))


def _plain(s):
    """What _ordered changed, as it was."""
    import numpy as np

    return np.where(s == np.inf, np.nan, np.where(s == LARGEST, np.inf, s))


class Best:
    """The k best (similarity, id) of each query so far, best first, ties to the smaller id; held: how many there are."""

    def __init__(self, queries: int, k: int, kind):
        import numpy as np

        self.s, self.ids, self.held = np.full((queries, k), -np.inf), np.zeros((queries, k), kind), np.zeros(queries, int)

    def add(self, start: int, s, ids) -> None:
        """Similarities of the queries from start on to rows of ascending ids."""
        import numpy as np

        (n, m), k = s.shape, self.s.shape[1]
        span = slice(start, start + n)
        worst, last, held = self.s[span, -1:], self.ids[span, -1:], self.held[span]
        if m > k and (held < k).any():  # no row that is worse than the k-th of this tile can be among the k best
            worst = np.maximum(worst, np.partition(s, m - k, axis=1)[:, m - k, None])
        full = (held == k)[:, None]
        row, col = np.nonzero((s > worst) | ((s == worst) & (~full | (ids < last) | (worst > self.s[span, -1:]))))
        if not len(row):
            return
        touched = np.unique(row)
        old_row, old_col = np.nonzero((np.arange(k) < held[:, None]) & np.isin(np.arange(n), touched)[:, None])
        every = np.concatenate([old_row, row])
        value = np.concatenate([self.s[span][old_row, old_col], s[row, col]])
        name = np.concatenate([self.ids[span][old_row, old_col], ids[col]])
        order = np.lexsort((name, -value, every))
        every, value, name = every[order], value[order], name[order]
        place = np.arange(len(every)) - np.searchsorted(every, every)
        keep = place < k
        every, place = every[keep], place[keep]
        self.s[start + every, place], self.ids[start + every, place] = value[keep], name[keep]
        np.maximum.at(self.held, start + every, place + 1)


def semantic_search(index: DataFrame, chunks: DataFrame, query: list[float], k: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """The k nearest rows above the threshold with their chunk's title, heading and text (the last chunk of an id)."""
    hits = top_k(index, query, k, threshold)
    last = chunks.join(F.broadcast(hits.select(F.col("node_id").alias("id"))), "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("doc_title", "heading", "content"), "seq").alias("c"))
    found = hits.select("pos", F.col("node_id").alias("id"), "similarity").join(last, "id", "left")
    return found.select("pos", "id", "similarity", "c.doc_title", F.coalesce(clean_heading(F.col("c.heading")), F.lit("")).alias("heading"), F.left(F.coalesce(body(F.col("c.content")), F.lit("")), F.lit(500)).alias("text"))


def save_index(index: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """Write an index sorted by position inside its files, so that a lookup by position skips row groups."""
    index.sortWithinPartitions("pos").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
