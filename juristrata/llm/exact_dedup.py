"""Exact deduplication through a log-structured merge index of text digests, with DataFrame functions only.

Flush: every input partition is one memtable. It is sorted by digest and written, without a shuffle, as one run of level 0.
Filters: each run has a filter of its digests, in which a bit knows whether one or several entries of the run set it.
Compaction: FAN_IN runs of a level become one run of the next, until one is left. The filters of the runs that meet are
probed for each entry: an entry whose bit no other entry set is alone and passes on as it is; only the others (hits, and a
few more) are shuffled by digest and merged, with map-side pre-aggregation, so a digest that a third of all rows share
costs one row a task. The entry of the longest original text stays, then the smallest doc_id, then the earliest row.
Byte verification: the digests with more than one row bring their normalised text, of which the smallest and largest of a
digest must be the same bytes. Where they differ (a digest collision), the group is split by the bytes themselves.

Filters have a bounded size (common.FILTER_WORDS); fuller ones send more entries through the shuffle, and lose none.

Defined cases: a null text counts as empty; empty texts are equal to one another; a null doc_id sorts before all
others; of repeated rows (same id, same text) exactly one is kept; an empty table gives an empty result; only the two
named columns are read, so further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import ASCII_SPACE, Bitmap, Scratch, filter_words, meet, rows_that_stay

FAN_IN = 64
"""Runs that one compaction merges."""


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def flush(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """Write the memtables as sorted runs and return their entries; one run for each partition of the input."""
    entries = docs.select(
        F.col(id_col).alias("doc_id"),
        digest(normalized(F.col(text_col))).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("rid"),
        F.xxhash64(text_col).alias("text_hash"),
        F.spark_partition_id().alias("run"),
    )
    return scratch.table(entries.sortWithinPartitions("digest"), "lsm-runs")


def run_filters(entries: DataFrame, words: int) -> DataFrame:
    """(run, word, once, many): the bits that entries of each run set, and those that several of them set. Digests of
    runs that will not meet have nothing to do with one another, so the bit depends on the group of runs as well."""
    slots = entries.groupBy("run", F.pmod(F.xxhash64("digest", "to"), F.lit(words * 64)).alias("slot")).agg(F.first("to").alias("to"), F.sum("size").alias("n"))
    bit = "shiftleft(1L, cast(slot % 64 AS int))"
    return slots.groupBy("run", F.expr("cast(slot div 64 AS int)").alias("word")).agg(F.first("to").alias("to"), F.expr(f"bit_or({bit})").alias("once"), F.expr(f"bit_or(IF(n > 1, {bit}, 0L))").alias("many"))


def meeting_bits(filters: DataFrame) -> DataFrame:
    """(_word, _bits): the bits that several entries of runs that meet have set."""
    # At most FAN_IN filters of runs meet in a group, so the list is bounded.
    folded = """aggregate(collect_list(struct(once, many)), named_struct('once', 0L, 'many', 0L),
        (a, f) -> named_struct('once', a.once | f.once, 'many', a.many | f.many | (a.once & f.once))).many"""
    return filters.groupBy("to", "word").agg(F.expr(folded).alias("many")).groupBy(F.col("word").alias("_word")).agg(F.expr("bit_or(many)").alias("_bits")).where("_bits <> 0")


def compact(entries: DataFrame, scratch: Scratch, count: int) -> DataFrame:
    """One level: every FAN_IN runs become one, with one entry for each digest. Entries have digest, best, size, run."""
    entries = entries.withColumn("to", F.expr(f"run div {FAN_IN}").cast("int"))
    bitmap = Bitmap.of(filter_words(count), meeting_bits(scratch.table(run_filters(entries, filter_words(count)), "lsm-filters")))
    alone, hits = bitmap.split(entries, F.xxhash64("digest", "to"))
    merged = hits.groupBy("digest", "to").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    columns = ["digest", "best", "size", F.col("to").alias("run")]
    return scratch.table(alone.select(*columns).unionByName(merged.select(*columns)).sortWithinPartitions("run", "digest"), "lsm-level")


def compacted(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """(digest, keep_id, keep_rid, group_size): the one run that is left of all."""
    entries = runs.select("digest", F.struct((-F.col("n_chars")).alias("shorter"), "doc_id", "rid").alias("best"), F.lit(1).cast("long").alias("size"), "run")
    last, count = runs.agg(F.max("run"), F.count(F.lit(1))).first()
    level, last = compact(entries, scratch, count), (last or 0) // FAN_IN
    while last:
        above = compact(level, scratch, count)
        scratch.drop(level)
        level, last = above, last // FAN_IN
    return level.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), F.col("size").alias("group_size"))


def collisions(docs: DataFrame, doubted: DataFrame, hits: DataFrame, text_col: str, digest) -> DataFrame:
    """Digests whose rows are not all the same bytes: the byte verification of every hit. doubted has the text_hash of all
    rows whose digest is a hit, by which their texts are found."""
    texts = Bitmap(doubted, "text_hash").keep(docs.select(text_col), F.xxhash64(text_col))
    rows = texts.select(normalized(F.col(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm")))
    passed = Bitmap(hits.select(F.xxhash64("digest").alias("h")), "h").keep(rows, F.xxhash64("digest"))
    spans = passed.groupBy("digest").agg(F.min(F.encode("norm", "UTF-8")).alias("low"), F.max(F.encode("norm", "UTF-8")).alias("high"), F.count(F.lit(1)).alias("n"))
    return spans.where((F.col("n") > 1) & (F.col("low") != F.col("high"))).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, digest, text_hash.

    digest maps the normalised text to a string; a weak one only costs more byte comparisons, never a wrong group.
    """
    scratch = Scratch(docs.sparkSession)
    runs = flush(docs, scratch, id_col, text_col, digest)
    found = _judged(runs, scratch)
    bad = scratch.table(collisions(docs, found.doubted, found.hits, text_col, digest), "lsm-collisions")
    out = found.rows
    # A collided digest is refined by its text's bytes; with SHA-256 there is none, and this branch reads nothing.
    if not bad.isEmpty():
        refined = lambda norm: F.concat(digest(norm), F.lit("/"), F.hex(F.encode(norm, "UTF-8")))
        split = docs.withColumn("_digest", digest(normalized(F.col(text_col)))).join(bad.withColumnRenamed("digest", "_digest"), "_digest", "left_semi")
        again = _judged(flush(split.drop("_digest"), scratch, id_col, text_col, refined), scratch)
        out = out.join(bad, "digest", "left_anti").unionByName(again.rows)
        scratch.close(runs, found.hits, found.doubted, bad, *again.tables)
    else:
        scratch.close(runs, *found.tables)
    return out.withColumn("digest", F.split_part("digest", F.lit("/"), F.lit(1)))


class _judged:
    """hits: (digest, keep_id, keep_rid, group_size) of digests with several rows; doubted: the rows of runs that may have
    such a digest; rows: the result. tables: what rows reads, apart from the runs."""

    def __init__(self, runs: DataFrame, scratch: Scratch):
        hits = scratch.table(compacted(runs, scratch).where("group_size > 1"), "lsm-hits")
        clear, doubted = Bitmap(hits.select(F.xxhash64("digest").alias("h")), "h").split(runs, F.xxhash64("digest"))
        self.hits, self.doubted = hits, scratch.table(doubted, "lsm-hit-rows")
        columns = lambda keep, size, kept: ["doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "digest", "text_hash"]
        alone = columns(F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))
        several = meet(self.doubted, hits.withColumn("n", F.col("group_size")), "digest", "n", "rid")
        other = self.doubted.join(hits.select("digest"), "digest", "left_anti")
        self.rows = clear.select(*alone).unionByName(other.select(*alone)).unionByName(several.select(*columns(F.col("keep_id"), F.col("group_size"), F.col("rid") == F.col("keep_rid"))))
        self.tables = [hits, self.doubted, runs]


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    return rows_that_stay(docs, exact_dedup(docs).withColumnRenamed("kept", "stays"))
