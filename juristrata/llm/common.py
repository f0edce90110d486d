"""What the training-data operators share: scratch tables, hash splits and id helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristrata.scratch import materialize

ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the scratch table that materialize() returned, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Scratch tables of one run of an operator. What the operator's result does not read is dropped at the end; what it
    reads stays under spark.checkpoint.dir and belongs to the caller, who deletes that folder as usual."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.tables.append(materialize(df, name, **options))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self.tables = [t for t in self.tables if t is not df]
            discard(self.spark, df)

    def close(self, *keep: DataFrame) -> None:
        self.drop(*[t for t in self.tables if not any(t is k for k in keep)])


FAN_IN = 64


def folded(blocks: DataFrame, merge: Callable[[list[tuple]], tuple], partitions: int) -> DataFrame:
    """Merge pieces (block, task, parts...) of many tasks into one row for each block.

    merge takes the parts of several pieces and gives those of one. At most FAN_IN pieces meet in a group, level by
    level, so no task holds all pieces of a block however many tasks there were."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def fold(table: pa.Table) -> pa.Table:
        rows = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
        one = (*rows[0][:2], *merge([r[2:] for r in rows]))
        return pa.table([pa.array([v], t) for v, t in zip(one, table.schema.types, strict=True)], names=table.column_names)

    while True:
        blocks = blocks.withColumn("task", F.expr(f"task div {FAN_IN}")).groupBy("block", "task").applyInArrow(fold, schema)
        partitions = -(-partitions // FAN_IN)
        if partitions <= 1:
            return blocks


BATCH_ROWS, BATCH_BYTES = "512", "8m"


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in Arrow batches of a few megabytes. The defaults (10,000 rows, 64 MB) cost each
    task several hundred megabytes outside the heap where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """At the end of a task: give free memory of a worker back. Workers outlive their tasks, and a later stage of another
    kind needs it more than they do."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def gathered(batches, rows: int):
    """Arrow batches joined until they have at least so many rows."""
    held, n = [], 0
    for rb in batches:
        held.append(rb)
        n += rb.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def bucket_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the split into learning and held-out rows. Null for a null id."""
    return F.pmod(F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")), F.lit(modulus))


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether a row is held out; a null id is never held out."""
    return F.coalesce(bucket_of(doc_id, modulus) == remainder, F.lit(False))


LEVEL_BITS, LEVELS = 10, 3


def class_limits(rows: DataFrame, by: str, h: str, n: int) -> DataFrame:
    """(by, upto): for each class, a bound of the hash h at or below which it has at most n distinct hashes, and nearly n
    if it has more; null (no bound) where it has at most n.

    Hashes are counted in LEVELS levels of 1 << LEVEL_BITS ranges, pre-aggregated in each task; each level splits only the
    range of the one before in which the n-th hash lies. A window sees one row a range, so no task holds or ranks the rows
    of a class."""
    hashes = rows.select(by, F.col(h).alias("h")).distinct()
    at = _crossing(hashes.select(by, F.lit(n).cast("long").alias("room"), F.shiftright("h", 64 - LEVEL_BITS).alias("range")), by)
    for level in range(2, LEVELS + 1):
        at = materialize(at, "class-ranges")
        outer, inner = F.shiftright("h", 64 - (level - 1) * LEVEL_BITS), F.shiftright("h", 64 - level * LEVEL_BITS)
        inside = hashes.join(F.broadcast(at.where("range IS NOT NULL")), by).where(outer == F.col("range")).select(by, "room", inner.alias("range"))
        at = at.select(by).join(_crossing(inside, by), by, "left")
    return materialize(at.select(by, (F.shiftleft("range", 64 - LEVELS * LEVEL_BITS) - 1).alias("upto")), "class-limits")


def _crossing(hashes: DataFrame, by: str) -> DataFrame:
    """(by, range, room): the first range up to which a class has more rows than its room, and the room left before it;
    null where the room is enough for all."""
    sizes = hashes.groupBy(by, "room", "range").agg(F.count(F.lit(1)).alias("size"))
    upto = sizes.withColumn("upto", F.sum("size").over(Window.partitionBy(by).orderBy("range")))
    at = F.min(F.when(F.col("upto") > F.col("room"), F.struct("range", (F.col("room") - F.col("upto") + F.col("size")).alias("room"))))
    return upto.groupBy(by).agg(at.alias("at")).select(by, "at.range", "at.room")


def class_sample(rows: DataFrame, by: str, h: str, n: int) -> DataFrame:
    """The rows of each class with its smallest hashes, at most n distinct ones; n is a documented bound of a sample."""
    limits = class_limits(rows, by, h, n)  # one row a class
    return rows.join(F.broadcast(limits), by).where(F.col("upto").isNull() | (F.col(h) <= F.col("upto"))).drop("upto")


FILTER_WORDS = 1 << 19
"""64-bit words of a bitmap filter: at most this many (word, bits) rows of 12 bytes are broadcast, whatever the input."""


def filter_words(keys: int) -> int:
    """Words of a filter for so many keys: 16 bits a key, between 1 << 12 and FILTER_WORDS. A fuller filter lets more
    rows through to the join behind it, and never fewer."""
    return max(1 << 12, min(FILTER_WORDS, 1 << (max(keys, 1) * 16 // 64).bit_length()))


class Bitmap:
    """A one-hash Bloom filter over a long column, as broadcast rows (word, bits)."""

    def __init__(self, keys: DataFrame, key: str, count: int | None = None):
        self.words = filter_words(keys.count() if count is None else count)
        slots = keys.select(F.pmod(F.col(key), F.lit(self.words * 64)).alias("slot"))
        self.rows = slots.groupBy(F.expr("cast(slot div 64 AS int)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("_bits"))

    @classmethod
    def of(cls, words: int, rows: DataFrame) -> Bitmap:
        """A filter of so many words from its rows (_word, _bits)."""
        made = cls.__new__(cls)
        made.words, made.rows = words, rows
        return made

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with a boolean column: whether the filter may hold the key (false for a null one)."""
        slotted = rows.withColumn("_slot", F.pmod(key, F.lit(self.words * 64))).withColumn("_word", F.expr("cast(_slot div 64 AS int)"))
        marked = slotted.join(F.broadcast(self.rows), "_word", "left")
        hit = F.coalesce(F.expr("getbit(_bits, cast(_slot % 64 AS int)) = 1"), F.lit(False))
        return marked.select(*[rows[c] for c in rows.columns], hit.alias(name))

    def keep(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows whose key the filter may hold: all that match and a few more, picked before any shuffle."""
        return self.mark(rows, key, "_held").where("_held").drop("_held")

    def split(self, rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """The rows whose key the filter does not hold, and those whose key it may hold."""
        marked = self.mark(rows, key, "_held")
        return marked.where("NOT _held").drop("_held"), marked.where("_held").drop("_held")


HOT = 1000
"""Rows of a key from which on a join deals them to several tasks."""


def meet(rows: DataFrame, unique: DataFrame, key: str, n: str, spread: str) -> DataFrame:
    """rows joined to unique, which has one row for each key; n is the number of rows that meet it. The rows of a hot key
    are dealt, by a hash of the column spread, to as many tasks as a shuffle has, and its row of unique is sent to each."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = unique.where(F.col(n) > HOT).select(F.xxhash64(key).alias("h"))
    bitmap = Bitmap(hot, "h")
    left = bitmap.mark(rows, F.xxhash64(rows[key]), "_hot").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = bitmap.mark(unique, F.xxhash64(unique[key]), "_hot")
    right = right.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def rows_that_stay(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, more) that judged (doc_id, text_hash, stays; one row for each) lets stay.

    Rows are found again by id and text. Only those that a fixed-size bitmap may count among the leaving ones are
    shuffled; all others pass straight through. Of rows that occur again with the same id and text one stays."""
    found = judged.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.bool_or("stays").alias("_stays"), F.count(F.lit(1)).alias("_n"))
    found = materialize(found.where("NOT _stays OR _n > 1"), "leaving")
    clear, doubted = Bitmap(found, "_th").split(docs, F.xxhash64(docs["text"]))
    same = (F.xxhash64(doubted["text"]) == found["_th"]) & doubted["doc_id"].eqNullSafe(found["_id"])
    kept = clear.unionByName(doubted.join(found, same, "left_anti"))
    again = found.where("_stays")
    if again.isEmpty():
        return kept
    return kept.unionByName(doubted.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
