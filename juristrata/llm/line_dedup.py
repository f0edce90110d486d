"""Line deduplication with two Bloom filters.

Pass 1: every partition notes the hashes of its documents' distinct lines in a once-seen filter and, from the second
document on, in a twice-seen filter. Filters are cut into blocks, and blocks of all partitions are merged: a bit is
twice-seen if it is so anywhere, or once-seen in two partitions. No line that occurs in two documents escapes.
Pass 2: only lines whose hash the twice-seen filter holds (suspected repeats) leave their partition, as 16-byte
digests with a document count pre-aggregated in the task and their first place; the sum is the exact confirmation.
Pass 3: the confirmed lines are dropped. They are broadcast as sorted digests while they are at most BROADCAST_LINES;
beyond that the places to drop are found by a join on the digest and joined to the documents by row.

Defined cases: a null or empty text is one empty line; a line's key is the line without ASCII white space at its ends
and with A-Z in lower case; keys shorter than min_chars code points are always kept; a row is one document, even if
its id or text occurs again; with keep_first, the first line (by id, then place) of a key stays.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import folded, materialize, small_batches

BLOCK_BYTES = 1 << 16
MAX_BITS = 1 << 27
"""A filter has at most this many bits (16 MB). A fuller one lets more lines through to the exact count, no fewer."""
BROADCAST_LINES = 1 << 20
HELD = 1 << 18
"""Digests that a task counts before it hands them on."""
SPACE = b" \t\n\x0b\x0c\r"


def keys(text: str | None) -> list[bytes]:
    return [line.strip(SPACE).lower() for line in (text or "").encode("utf-8").split(b"\n")]


def counted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8")) >= min_chars)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(bits - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def get(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def put(field: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(field, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def filters(docs: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """The merged twice-seen filter as (block, twice); at most bits / 8 / BLOCK_BYTES rows."""

    def note(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for rb in batches:
            for text in rb.column(0).to_pylist():
                found = {k for k in keys(text) if counted(k, min_chars)}
                if not found:
                    continue
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
                a, b = positions(h, bits)
                seen = (get(once, a) & get(once, b)).astype(bool)
                put(twice, a[seen]), put(twice, b[seen])
                put(once, a), put(once, b)
        task = TaskContext.get().partitionId()
        for block in range(0, bits // 8, BLOCK_BYTES):
            o, t = once[block : block + BLOCK_BYTES], twice[block : block + BLOCK_BYTES]
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK_BYTES], pa.int64()), pa.array([task], pa.int64()), pa.array([zlib.compress(o.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(t.tobytes(), 1)], pa.binary())], names=["block", "task", "once", "twice"])

    def merge(pieces: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        once = twice = np.zeros(BLOCK_BYTES, np.uint8)
        for piece in pieces:
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in piece)
            once, twice = once | o, twice | t | (once & o)
        return zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1)

    texts = docs.select("text")
    blocks = texts.mapInArrow(note, "block long, task long, once binary, twice binary")
    return folded(blocks, merge, texts.rdd.getNumPartitions()).select("block", "twice")


def suspects(docs: DataFrame, field, bits: int, min_chars: int) -> DataFrame:
    """(digest, n_docs, doc_id, line): suspected repeats, counted inside the task; doc_id and line are the first place."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        twice, held = np.frombuffer(zlib.decompress(field.value), np.uint8), {}

        def handed():
            rows = [(d, n, *first) for d, (n, first) in held.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], arrow_id), pa.array(columns[3], pa.int64())], names=["digest", "n_docs", "doc_id", "line"])

        arrow_id = None
        for rb in batches:
            arrow_id = rb.column(0).type
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                found: dict[bytes, int] = {}
                for i, k in enumerate(keys(text)):
                    if counted(k, min_chars) and k not in found:
                        found[k] = i
                if not found:
                    continue
                names = list(found)
                a, b = positions(np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)), bits)
                for i in np.flatnonzero(get(twice, a) & get(twice, b)):
                    d, place = digest(names[i]), (doc_id, found[names[i]])
                    n, first = held.get(d, (0, place))
                    held[d] = (n + 1, min(first, place, key=lambda p: (p[0] is not None, p)))
            if len(held) > HELD:
                yield handed()
        if held:
            yield handed()

    return docs.select("doc_id", "text").mapInArrow(run, f"digest binary, n_docs long, doc_id {kind.simpleString()}, line long")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """For each row: doc_id, text (the lines that stay, joined by newlines), n_lines, n_dropped."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = min(MAX_BITS, max(8 * BLOCK_BYTES, 1 << int(np.ceil(np.log2(12 * lines)))))
    merged = np.zeros(bits // 8, np.uint8)
    for block, twice in filters(docs, bits, min_chars).toLocalIterator():
        merged[block * BLOCK_BYTES : (block + 1) * BLOCK_BYTES] = np.frombuffer(zlib.decompress(twice), np.uint8)
    field = spark.sparkContext.broadcast(zlib.compress(merged.tobytes(), 1))
    counts = suspects(docs, field, bits, min_chars).groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("first"))
    frequent = materialize(counts.where(F.col("n_docs") >= min_docs).select("digest", "first.doc_id", "first.line"), "frequent-lines")
    if frequent.count() <= broadcast_lines:
        return _drop_by_broadcast(docs, frequent, min_chars, keep_first)
    return _drop_by_join(docs, frequent, min_chars, keep_first)


def _drop_by_broadcast(docs: DataFrame, frequent: DataFrame, min_chars: int, keep_first: bool) -> DataFrame:
    """At most BROADCAST_LINES digests of 16 bytes reach every task, with their first places."""
    rows = sorted((bytes(r[0]), r[1], r[2]) for r in frequent.toLocalIterator()) if not keep_first else sorted(((bytes(r[0]), r[1], r[2]) for r in frequent.toLocalIterator()), key=lambda r: r[0])
    shared = docs.sparkSession.sparkContext.broadcast((b"".join(r[0] for r in rows), [r[1:] for r in rows] if keep_first else None))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        packed, firsts = shared.value
        order = [packed[i : i + 16] for i in range(0, len(packed), 16)]
        known = {d: i for i, d in enumerate(order)}
        for rb in batches:
            out = []
            for doc_id, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                lines, stay = (text or "").split("\n"), []
                for i, (line, key) in enumerate(zip(lines, keys(text), strict=True)):
                    at = known.get(digest(key)) if counted(key, min_chars) else None
                    if at is None or (firsts and firsts[at] == (doc_id, i)):
                        stay.append(line)
                out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return docs.mapInArrow(run, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def _drop_by_join(docs: DataFrame, frequent: DataFrame, min_chars: int, keep_first: bool) -> DataFrame:
    """No bound on the confirmed lines: the digests of all lines meet them in a shuffle join; hot digests are split by
    adaptive execution. Rows are numbered once, in a table, so that the numbers hold when a task runs again."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.withColumn("rid", F.monotonically_increasing_id()), "line-rows")

    def cut(batches):
        for rb in batches:
            for rid, doc_id, text in zip(rb.column(0), rb.column(1), rb.column(2).to_pylist(), strict=True):
                found = [(i, digest(k)) for i, k in enumerate(keys(text)) if counted(k, min_chars)]
                yield pa.RecordBatch.from_arrays([pa.array([rid.as_py()] * len(found), pa.int64()), pa.array([doc_id.as_py()] * len(found), rb.column(1).type), pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["rid", "doc_id", "line", "digest"])

    marks = rows.select("rid", "doc_id", "text").mapInArrow(cut, f"rid long, doc_id {kind}, line long, digest binary")
    hit = marks.join(frequent.select("digest", F.col("doc_id").alias("first_id"), F.col("line").alias("first_line")), "digest")
    if keep_first:
        hit = hit.where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line"))))
    gone = hit.groupBy("rid").agg(F.collect_set("line").alias("gone"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("gone", i.cast("long")), F.lit(False)))
    return rows.join(gone, "rid", "left").select("doc_id", F.concat_ws("\n", kept).alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
