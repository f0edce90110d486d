"""Near-duplicate documents by min-max hashing.

Every document's set of word shingles is hashed under PERMUTATIONS permutations, and both the minimum and the maximum
under each are kept, so 64 evaluations give 128 unbiased signature values. A band is two permutations with their
minima and maxima (4 values): at similarity 0.8 two sets miss all 32 bands with probability below 1e-6.

1. Equal sets fall into one class first (map-side pre-aggregation by set digest); only class representatives go on.
2. In each bucket of a band every member is paired with the smallest one, its hub: links, not all pairs.
3. Pairs are confirmed on the full sets: a hub's text and its members' texts meet in hub order, in salted parts.
4. Connected components of the confirmed links. The members of buckets that still hold several components are not
   given up: every two of them that no component joins yet are compared on their full sets inside grouped tasks, in
   bounded parts of the bucket, so no candidate link between different texts is lost. The tasks give only links that
   join components, so families of texts just below the threshold make no rows, whatever their size.

Defined cases: a null text, an empty one or one without words has no shingle and no link; fewer words than a shingle
are one shingle; rows with equal sets are linked; repeated rows share a component; component_id is the smallest
doc_id (null ids do not count); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import Bitmap, Scratch, meet, release, rows_that_stay, small_batches
from juristrata.llm.components import connected_components

PERMUTATIONS = 64
BANDS = 32
SALTED = 1000
"""Members of a hub that one part confirms."""
PART_ROWS, PART_SHINGLES = 1000, 400_000
"""Members of an open bucket that meet another part of it in one task, and shingles that they have."""
ROWS_AT_ONCE, PAIRS, WIDTH = 128, 1 << 14, 32
"""Rows of a part whose pairs are listed at once; pairs that are counted at once; words of bits counted at once."""
WORDS = 150_000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8").lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    span = min(size, len(h))
    s = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        s = s * _P + h[k : len(h) - span + 1 + k]
    return np.unique(mix(s))


def band_keys(s: np.ndarray) -> np.ndarray:
    """BANDS keys from the minima and maxima of all permutations."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(x), 2048):
        y = np.multiply.outer(_A, x[at : at + 2048])
        y += _B[:, None]
        low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
    per = PERMUTATIONS // BANDS
    values = np.column_stack([low.reshape(BANDS, per), high.reshape(BANDS, per)]).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in values.T:
        key = mix(key * _P + column)
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(rid, doc_id, th, n_shingles, set_key, bands) for each row; th is a hash of the text, rid numbers the rows."""
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("rid"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for rb in batches:
            sets = [shingles(t, size) for t in rb.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [band_keys(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rb.column(3), rb.column(0), rb.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "th", "n_shingles", "set_key", "bands"],
            )
        forget()

    return narrow.mapInArrow(run, f"rid long, doc_id {kind}, th long, n_shingles long, set_key binary, bands array<long>")


def texts_of(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(rid, text) of the rows of needed (rid, nid, nth). Only these texts, and a few more, leave the scan: a bitmap of
    their hashes picks them."""
    found = Bitmap(needed, "nth").keep(docs.select("doc_id", "text", F.xxhash64("text").alias("th")), F.col("th"))
    return found.join(needed, (F.col("th") == F.col("nth")) & F.col("doc_id").eqNullSafe(F.col("nid"))).select("rid", "text").dropDuplicates(["rid"])


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, roots: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(r, i) for i, r in enumerate(roots)]

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def labels(self) -> np.ndarray:
        return np.array([self.top(i) for i in range(len(self.up))])


def similar(sets: list[np.ndarray], candidates, share: tuple[int, int]):
    """Of the pairs of positions in sets that candidates yields, as arrays (i, j), those that are similar enough.

    Shingles that only one set has are no column; the others become bits, counted for WIDTH words of columns at a time,
    and a pair goes as soon as what is left of the smaller set cannot reach the threshold any more."""
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    ok = times[column] > 1
    row, column = row[ok], rank[column[ok]]
    words = -(-int((times > 1).sum()) // 64)
    words = max(WIDTH, -(-words // WIDTH) * WIDTH)
    bits = np.zeros((len(sets), words), np.uint64)
    np.bitwise_or.at(bits, (row, column >> 6), np.left_shift(np.uint64(1), (column & 63).astype(np.uint64)))
    each = np.bitwise_count(bits).reshape(len(sets), -1, WIDTH).sum(2, dtype=np.int64)
    behind = np.cumsum(each[:, ::-1], 1)[:, ::-1]  # the row's bits from a block on
    numerator, denominator = share
    for i, j in candidates:
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            needs = -(-numerator * (n[a] + n[b]) // (numerator + denominator))
            have = np.zeros(len(a), np.int64)
            for block in range(words // WIDTH):
                able = have + np.minimum(behind[a, block], behind[b, block]) >= needs
                a, b, needs, have = a[able], b[able], needs[able], have[able]
                if not len(a):
                    break
                part = slice(block * WIDTH, (block + 1) * WIDTH)
                have += np.bitwise_count(bits[a, part] & bits[b, part]).sum(1, dtype=np.int64)
            able = have >= needs
            yield a[able], b[able]


def links_inside(open_rows: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, share: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Links (u, v) between members of different components of the same open bucket; open_rows has key, node, size, root.

    A bucket is cut into parts of at most about PART_ROWS members and PART_SHINGLES shingles, and every two of its parts
    meet in a task of their own, which compares full sets. A pair that shares several buckets is compared in that of the
    lowest band only. A task gives the links that join components, so fewer than it has members, and never pairs."""
    info = open_rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    needed = nodes.join(open_rows.select(F.col("node").alias("rid"), "root").distinct(), "rid").select("rid", F.col("doc_id").alias("nid"), F.col("th").alias("nth"), "root", "bands")
    needed = scratch.table(needed, "open-nodes")
    texts = scratch.table(texts_of(needed.select("rid", "nid", "nth"), docs).join(needed.select(F.col("rid").alias("node"), "root", "bands"), F.col("rid") == F.col("node")).drop("rid"), "open-texts")
    dealt = meet(open_rows.select("key", "node"), info, "key", "n", "node").withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    blocks = dealt.select("key", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = blocks.select("key", "node", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        key, inside = table.column("key")[0].as_py(), table.column("low")[0] == table.column("high")[0]
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        sets = [shingles(t, size) for t in table.column("text").to_pylist()]
        n, forest = np.array([len(s) for s in sets]), Forest(table.column("root").to_pylist())
        band = int((bands == key).all(0).argmax())
        numerator, denominator = share

        def candidates():
            for at in range(0, len(sets), ROWS_AT_ONCE):
                i = np.arange(at, min(at + ROWS_AT_ONCE, len(sets)))
                label = forest.labels()
                ok = (label[i][:, None] != label) & (np.minimum.outer(n[i], n) * denominator >= np.maximum.outer(n[i], n) * numerator) & (i[:, None] < np.arange(len(sets)))
                if not inside:
                    ok &= part[i][:, None] != part
                for lower in bands[:, :band].T:
                    ok &= lower[i][:, None] != lower
                a, b = np.nonzero(ok)
                yield i[a], b

        us, vs = [], []
        for a, b in similar(sets, candidates(), share):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if forest.join(i, j):
                    us.append(int(node[i])), vs.append(int(node[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return blocks.join(texts, "node").groupBy("key", "low", "high").applyInArrow(compare, "u long, v long")


def forget() -> None:
    """Drop what a worker keeps beside its task."""
    _words.clear()
    release()


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, share: tuple[int, int], scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    pairs = scratch.table(pairs.select("u", "v").distinct(), "pairs")
    needed = nodes.join(pairs.select(F.col("u").alias("rid")).union(pairs.select(F.col("v").alias("rid"))).distinct(), "rid", "left_semi").select("rid", F.col("doc_id").alias("nid"), F.col("th").alias("nth"))
    texts = texts_of(scratch.table(needed, "pair-nodes"), docs)
    hubs = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("parts"))
    members = meet(pairs, hubs, "v", "n", "u").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")).select(F.col("u").alias("rid"), "v", "part", F.lit(1).alias("role"))
    firsts = hubs.select(F.col("v").alias("rid"), "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    rows = members.unionByName(firsts).join(texts, "rid").select("v", "part", "role", F.col("rid").alias("u"), "text")
    dealt = rows.repartition("v", "part").sortWithinPartitions("v", "part", "role")
    numerator, denominator = share

    def run(batches):
        hub, base = None, None
        for rb in batches:
            us, vs = [], []
            for v, role, u, text in zip(*(rb.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                s = shingles(text, size)
                if role == 0:
                    hub, base = v, s
                elif hub == v:
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    if denominator * both >= numerator * (len(base) + len(s) - both):
                        us.append(u), vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        forget()

    return dealt.mapInArrow(run, "u long, v long").distinct()


def near_dedup(docs: DataFrame, shingle_words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept, and first_row (true for one row of each component)."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.table(signatures(docs, shingle_words), "signatures")
    classes = scratch.table(rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("_first"), F.count(F.lit(1)).alias("n")).select("set_key", "node", "low_id", F.col("_first.rid").alias("first_rid"), "n"), "classes")
    # One row of each class represents it. The others are few, so they are what is looked up; the bands stay in place.
    worded = rows.where("n_shingles > 0")
    others = meet(worded.select("set_key", "rid"), classes.where("n > 1").select("set_key", "node", "n"), "set_key", "n", "rid").where("rid <> node").select(F.xxhash64("rid").alias("h"), F.col("rid").alias("other"))
    others = scratch.table(others, "represented")
    clear, doubted = Bitmap(others, "h").split(worded, F.xxhash64("rid"))
    nodes = clear.unionByName(doubted.join(others, doubted["rid"] == others["other"], "left_anti"))
    buckets = nodes.select(F.col("rid").alias("node"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    shared = scratch.table(buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    # Most keys are alone: a bitmap of the shared ones keeps the rest out of the join's shuffle.
    members = scratch.table(meet(Bitmap(shared, "key").keep(buckets, F.col("key")), shared, "key", "n", "node"), "members")
    tested = members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    links = scratch.table(confirm(tested, nodes, docs, shingle_words, share, scratch), "links")
    roots = connected_components(links)
    # Members, other than hubs, of buckets of more than two that still hold several components.
    labelled = members.where("n > 2 AND node <> hub").join(roots, "node", "left").select("key", "node", "size", "n", F.coalesce("root", "node").alias("root"))
    labelled = scratch.table(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("n").alias("n")).where("low < high").select("key", "n")
    left = scratch.table(meet(labelled.drop("n"), open_keys, "key", "n", "node").drop("n"), "open")
    if not left.isEmpty():
        more = links_inside(left, nodes, docs, shingle_words, share, scratch)
        stars = roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        roots = connected_components(scratch.table(stars.union(more), "links"))
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min("low_id").alias("component_id"), F.min(F.struct(F.col("low_id").isNull(), "low_id", "first_rid")).alias("_first"))
    placed = scratch.table(placed.join(best, "root").select("set_key", "component_id", F.col("_first.first_rid").alias("first_rid"), "n"), "placed")
    scratch.close(rows, placed)
    found = meet(worded.drop("bands"), placed, "set_key", "n", "rid")
    columns = lambda component, first: ["doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first_row"), F.col("th").alias("text_hash")]
    alone = rows.where("n_shingles = 0").select(*columns(F.col("doc_id"), F.lit(True)))
    return alone.unionByName(found.select(*columns(F.col("component_id"), F.col("rid") == F.col("first_rid"))))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs without near-duplicates: one row of each component stays, with all its columns."""
    return rows_that_stay(docs, near_dedup(docs, shingle_words, share).withColumnRenamed("first_row", "stays"))
