"""Approximate nearest neighbours with learned partitions.

Learning: a bounded sample of SAMPLE vectors (those with the smallest hashes of the id) is brought to the driver; its
neighbour graph is cut into balanced parts by a capacity-bounded label propagation that keeps neighbours together, and a
small two-layer network learns to predict a vector's part. The number of parts grows with the square root of the rows,
as far as the sample has SAMPLED vectors for each.
Index: the network puts every vector into its most probable part. Search: it routes a query to its most probable parts,
until their chances add up to MASS; these are reranked by the exact distance on the original vectors. A part that holds
very many vectors (or copies of one) is cut into chunks by a hash of the row, and queries meet each chunk of a part on
its own, so no task holds a part; each gives its best k and a last step merges them.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a vector of another
length than most is compared with all vectors of its own length, and only with them; with fewer candidates than k all are
returned; equal distances rank by the smaller id; a query's own row is left out, but neither copies of its vector nor
other rows with its id; every row of a repeated query is a query; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristrata.llm.common import class_sample, materialize

SAMPLE = 8192
PARTS, ROWS_OF_PARTS, SAMPLED = 16, 50_000, 64
"""Parts of a table of up to ROWS_OF_PARTS rows; sampled vectors that each part needs at least."""
MASS = 0.96
"""A query goes to its most probable parts until their chances add up to this: few parts where the space has structure."""
CHUNK_ROWS, QUERY_ROWS = 25_000, 10_000
"""Candidates, and queries, of a part that meet in one task."""
AT_ONCE = 32
HIDDEN = 128


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ok & F.exists(vector, lambda x: x != 0)


def neighbour_graph(x: np.ndarray, neighbours: int = 10) -> np.ndarray:
    """The nearest other rows of each row."""
    n = len(x)
    near = np.empty((n, min(neighbours, n - 1)), np.int64)
    square = (x * x).sum(1)
    for at in range(0, n, 512):
        d = square[at : at + 512, None] + square - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near[at : at + 512] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Parts of at most 1.05 n / parts rows that cut few edges of the neighbour graph."""
    n, room = len(x), int(np.ceil(1.05 * len(x) / parts))
    rng = np.random.default_rng(seed)
    # Start: centres far from one another, rows dealt to the nearest centre with room, surest rows first.
    centres = [int(rng.integers(n))]
    far = ((x - x[centres[0]]) ** 2).sum(1)
    while len(centres) < parts:
        centres.append(int(rng.choice(n, p=far / far.sum())) if far.sum() else int(rng.integers(n)))
        far = np.minimum(far, ((x - x[centres[-1]]) ** 2).sum(1))
    means = x[centres].copy()
    for _ in range(4):
        d = (means * means).sum(1) - 2 * x @ means.T
        two = np.partition(d, 1, axis=1)
        part, load = np.full(n, -1), np.zeros(parts, int)
        for i in np.argsort(two[:, 0] - two[:, 1]):
            for p in np.argsort(d[i]):
                if load[p] < room:
                    part[i], load[p] = p, load[p] + 1
                    break
        for p in range(parts):
            if load[p]:
                means[p] = x[part == p].mean(0)
    # Refinement: a row moves to the part of most of its neighbours (both directions) while there is room.
    back = [[] for _ in range(n)]
    for i, row in enumerate(near):
        for j in row:
            back[j].append(i)
    around = [np.concatenate([near[i], np.array(back[i][: 4 * near.shape[1]], np.int64)]) for i in range(n)]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[around[i]], minlength=parts).astype(float)
            votes[load >= room] = -1
            votes[part[i]] = np.count_nonzero(part[around[i]] == part[i])
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                load[part[i]] -= 1
                load[best] += 1
                part[i], moved = best, moved + 1
        if not moved:
            break
    return part


class Router:
    """A two-layer network from vectors to the chances that a neighbour lies in each part."""

    def __init__(self, x: np.ndarray, target: np.ndarray, epochs: int = 15, seed: int = 5):
        parts = target.shape[1]
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() + 1e-9
        z = (x - self.mean) / self.scale
        self.w = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), 128):
                rows = order[at : at + 128]
                a = z[rows] @ self.w[0] + self.w[1]
                h = np.maximum(a, 0)
                out = h @ self.w[2] + self.w[3]
                p = np.exp(out - out.max(1, keepdims=True))
                g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
                gh = (g @ self.w[2].T) * (a > 0)
                grads, t = [z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0)], t + 1
                for i, gr in enumerate(grads):
                    gr = gr + 1e-4 * self.w[i]
                    m[i], v[i] = 0.9 * m[i] + 0.1 * gr, 0.999 * v[i] + 0.001 * gr * gr
                    self.w[i] = self.w[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def chances(self, x: np.ndarray) -> np.ndarray:
        out = np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        p = np.exp(out - out.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def part_shares(part: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """For each row the shares of its neighbours, and of itself, in the parts."""
    target = np.eye(parts)[part] * 2
    for column in near.T:
        target += np.eye(parts)[part[column]]
    return target / target.sum(1, keepdims=True)


def parts_of(rows: int, sample: int) -> int:
    return max(1, min(round(PARTS * max(1.0, rows / ROWS_OF_PARTS) ** 0.5), max(PARTS, sample // SAMPLED)))


def learn(vectors: DataFrame, sample: int = SAMPLE, parts: int | None = None) -> Router | None:
    """Fit a router on the sample; vectors has vec_id and the usable vector v. Of rows that share an id one counts."""
    rows = vectors.select(F.lit(0).alias("all"), F.xxhash64("vec_id", F.lit(10)).alias("h"), "v")
    picked = class_sample(rows, "all", "h", sample).groupBy("h").agg(F.min("v").alias("v")).collect()
    if not picked:
        return None
    picked = sorted(picked, key=lambda r: r["h"])
    width = pd.Series([len(r["v"]) for r in picked]).mode()[0]
    # Copies of one vector say nothing new about the space.
    x = np.unique(np.array([r["v"] for r in picked if len(r["v"]) == width], float), axis=0)
    parts = max(1, min(parts or parts_of(vectors.count(), sample), len(x) // 8))
    if parts == 1:
        return Router(x, np.ones((len(x), 1)))
    near = neighbour_graph(x)
    part = balanced_parts(x, near, parts)
    return Router(x, part_shares(part, near, parts))


FOUND = {"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"}


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, mass: float = MASS, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int | None = None) -> DataFrame:
    """For each query its k nearest found: query_id, rank, vec_id, score (Euclidean distance in double precision)."""
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    router = learn(good, sample, parts)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared, width = spark.sparkContext.broadcast(router), len(router.mean)

    def route(frames):
        r = shared.value
        for f in frames:
            visits = [[-len(v)] for v in f["v"]]  # vectors of another length have a part of their own
            usual = np.flatnonzero([p == [-width] for p in visits])
            if len(usual):
                p = r.chances(np.stack(f["v"].to_numpy()[usual]))
                order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
                upto = (np.cumsum(np.take_along_axis(p, order, 1), 1) < mass).sum(1) + 1
                for i, o, u in zip(usual, order, upto, strict=True):
                    visits[i] = o[: u if f["asked"].iloc[i] else 1].tolist()
            yield f.assign(parts=visits)

    numbered = good.withColumn("rid", F.monotonically_increasing_id())
    routed = materialize(numbered.mapInPandas(route, "vec_id long, v array<double>, asked boolean, rid long, parts array<int>"), "routed")
    index = routed.select("rid", "vec_id", "v", F.col("parts")[0].alias("part"))
    asked = routed.where("asked").select(F.col("rid").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("parts").alias("part"))
    sizes = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).cast("int").alias("chunks"))
    loads = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("shares"))
    plan = F.broadcast(materialize(sizes.join(loads, "part"), "part-plan"))  # one row a part or length of vectors
    candidates = index.join(plan, "part").select("part", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "rid", "vec_id", "v")
    questions = asked.join(plan, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query"), F.col("shares")).cast("int").alias("share"), "query", "query_id", "q")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("vec_id", kind="stable")
            ids, rows, y = right["vec_id"].to_numpy(), right["rid"].to_numpy(), np.stack(right["v"].to_numpy())
            square, asked_rows, asked_ids = (y * y).sum(1), left["query"].to_numpy(), left["query_id"].to_numpy()
            for at in range(0, len(left), AT_ONCE):
                qs = np.stack(left["q"].to_numpy()[at : at + AT_ONCE]).astype(float)
                # The expanded form picks (with a margin for its rounding), the exact one decides.
                rough = square - 2 * (qs @ y.T)
                for i, q in enumerate(qs):
                    near = np.arange(len(ids))
                    if len(ids) > k + 1:
                        limit = np.partition(rough[i], k)[k]
                        near = np.flatnonzero(rough[i] <= limit + 1e-9 * (1 + abs(limit) + q @ q))
                    near = near[rows[near] != asked_rows[at + i]]
                    d = np.sqrt(((y[near] - q) ** 2).sum(1))
                    top = np.argsort(d, kind="stable")[:k]
                    found.append(pd.DataFrame({"query": asked_rows[at + i], "query_id": asked_ids[at + i], "vec_id": ids[near[top]], "score": d[top]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in FOUND}).astype(FOUND)

    keys = ["part", "chunk", "share"]
    partial = questions.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(best, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
