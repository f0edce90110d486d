"""The chunk table: union of sources, notes, abbreviations, titles, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juristrata.functions.text import body, id_prefix
from juristrata.scratch import materialize


HEAD = 10
"""Characters of a file's name that group files when they are numbered: type and year, as in ukpga_2024."""


def union_sources(*sources: DataFrame) -> DataFrame:
    """Chunks of all sources in one order: source by source, file by file, in document order. The chunks
    are computed when this is called, and stay in a scratch table that the result reads."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s, allowMissingColumns=True)
    # The counts and the numbering both read the chunks, which are dear to parse: they are written once, to scratch.
    every = materialize(every, "corpus-union")
    # Numbers are dealt by file: a running total over the files, then positions inside each file. The total is taken in
    # two levels, over the first characters of the names and inside each such group, so no task ranks all files.
    per_file = every.groupBy("_rank", "file").agg(F.count(F.lit(1)).alias("n")).withColumn("_head", F.left("file", F.lit(HEAD)))
    per_head = per_file.groupBy("_rank", "_head").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = per_head.select("_rank", "_head", before(Window.partitionBy(F.lit(1)).orderBy("_rank", "_head")).alias("_base"))
    starts = per_file.join(heads, ["_rank", "_head"]).withColumn("start", F.col("_base") + before(Window.partitionBy("_rank", "_head").orderBy("file"))).select("_rank", "file", "start")
    inside = F.row_number().over(Window.partitionBy("_rank", "file").orderBy("ord")) - 1
    return every.withColumn("inside", inside).join(starts, ["_rank", "file"]).withColumn("seq", (F.col("start") + F.col("inside")).cast("long")).drop("_rank", "file", "ord", "inside", "start")


def attach_notes(chunks: DataFrame, notes: DataFrame, size: int = 500) -> DataFrame:
    """Chunks with notes_text: the first note of their document, in note order, whose key holds the section."""
    keyed = chunks.withColumn("_prefix", id_prefix(F.col("id")))
    match = keyed.where("coalesce(section, '') <> ''").join(notes, F.col("_prefix") == F.col("prefix")).where(F.col("note_key").contains(F.col("section")))
    first = match.groupBy("seq").agg(F.left(F.min_by("note_text", "note_ord"), F.lit(size)).alias("notes_text"))
    return keyed.drop("_prefix").join(first, "seq", "left")


# Fixed value: how a text defines an abbreviation of an act.
ABBREVIATION = r"""((?:the\s+)?[A-Z][A-Za-z\s,'-]+?Act\s+\d{4})\s*\(\s*["“]\s*((?:the\s+)?[A-Z][A-Za-z\s]+?\d{4})\s*["”]\s*\)"""


def abbreviations(chunks: DataFrame) -> DataFrame:
    """(short, full, place): terms first, then definitions in texts; the last definition of a short form wins, its first
    place stays. A short form must be shorter than what it stands for."""
    terms = chunks.select(F.lit(0).alias("pass"), "seq", F.posexplode(F.map_entries("defined_terms")).alias("pos", "e")).select("pass", "seq", "pos", F.col("e.key").alias("short"), F.col("e.value").alias("full"))
    pair = F.arrays_zip(F.regexp_extract_all("content", F.lit(ABBREVIATION), 2).alias("short"), F.regexp_extract_all("content", F.lit(ABBREVIATION), 1).alias("full"))
    found = chunks.select(F.lit(1).alias("pass"), "seq", F.posexplode(pair).alias("pos", "e")).select("pass", "seq", "pos", F.trim("e.short").alias("short"), F.trim("e.full").alias("full"))
    every = terms.unionAll(found).where("short <> '' AND length(short) < length(full)").withColumn("at", F.struct("pass", "seq", "pos"))
    return every.groupBy("short").agg(F.max_by("full", "at").alias("full"), F.min("at").alias("place"))


def titles(chunks: DataFrame) -> DataFrame:
    """(prefix, title): the first title of each document."""
    return chunks.groupBy(id_prefix(F.col("id")).alias("prefix")).agg(F.min_by("doc_title", "seq").alias("title")).where("prefix <> ''")


def with_titles(triples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Triples with doc_title, the title of the document that their source_id belongs to; null where there is none."""
    named = titles(chunks).select(F.col("prefix").alias("_prefix"), F.col("title").alias("doc_title"))
    return triples.withColumn("_prefix", id_prefix(F.col("source_id"))).join(named, "_prefix", "left").drop("_prefix")


def lookup(chunks: DataFrame, ids: list[str], size: int = 800) -> DataFrame:
    """(pos, id, doc_title, text) of the chunks with the given ids, in their order, repeats included; the last chunk of
    an id counts."""
    asked = chunks.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    wanted = chunks.where(F.col("id").isin(list(dict.fromkeys(ids)))) if ids else chunks.limit(0)
    last = wanted.groupBy("id").agg(F.max_by(F.struct("doc_title", "content"), "seq").alias("c"))
    return asked.join(last, "id").select("pos", "id", "c.doc_title", F.left(F.coalesce(body(F.col("c.content")), F.lit("")), F.lit(size)).alias("text"))


def first_by_key(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def resume(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks whose id is not among the done ids."""
    return chunks.join(done.select(F.col("id")).distinct(), "id", "left_anti")


def cut_after_misses(probes: DataFrame, group: str, misses: int) -> DataFrame:
    """Probes of each group, in order of n, up to and including the miss that makes `misses` in a row."""
    w = Window.partitionBy(group).orderBy("n")
    island = probes.withColumn("hits", F.sum(F.col("hit").cast("int")).over(w))
    run = island.withColumn("run", F.when(F.col("hit"), 0).otherwise(F.row_number().over(Window.partitionBy(group, "hits").orderBy("n")) - F.when(F.col("hits") > 0, 1).otherwise(0)))
    stop = run.where(F.col("run") >= misses).groupBy(group).agg(F.min("n").alias("stop"))
    return run.join(stop, group, "left").where(F.col("stop").isNull() | (F.col("n") <= F.col("stop"))).drop("hits", "run", "stop")
