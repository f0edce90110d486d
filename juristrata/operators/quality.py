"""Data-quality reports over chunks, triples and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristrata.functions.lexicon import CANONICAL_ACTIONS
from juristrata.functions.text import id_prefix


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def counts_by(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, percent) of rows that have each field, in one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(filled(f)).alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])
    return one.select("total", F.explode(pairs).alias("p")).select("p.field", "p.n", F.round(100.0 * F.col("p.n") / F.greatest("total", F.lit(1)), 0).alias("percent"))


def chunk_report(chunks: DataFrame, short: int = 30) -> DataFrame:
    """Totals, duplicate ids and short contents in one row."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), (F.count("id") - F.count_distinct("id")).alias("duplicate_ids"), F.count_if(F.length("content") < short).alias("short"), F.count_distinct(id_prefix(F.col("id"))).alias("documents")
    )


def triple_report(triples: DataFrame) -> DataFrame:
    """Canonical and other actions, self-amendments, dated, detailed, missing ends."""
    return triples.agg(
        F.count(F.lit(1)).alias("triples"), F.count_if(F.col("action").isin(CANONICAL_ACTIONS)).alias("canonical"), F.count_if(~F.coalesce(F.col("action").isin(CANONICAL_ACTIONS), F.lit(False))).alias("other"),
        F.count_if("is_self_amendment").alias("self_amendments"), F.count_if(filled("effective_date")).alias("dated"), F.count_if(filled("detail_text")).alias("detailed"),
        F.count_if(~filled("target_citation")).alias("no_target"), F.count_if(~filled("source_id")).alias("no_source"),
    )


def top(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties by name."""
    return counts_by(rows, key).orderBy(F.desc("n"), key).limit(n)


def length_stats(rows: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return rows.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.floor(F.avg(n)).alias("mean"), F.median(n).alias("median"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    n = counts_by(rows, key)
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # one row a value


def coverage(**stores: DataFrame) -> DataFrame:
    """How the distinct ids of several stores overlap: (combination, ids), in one pass; each store has a column id."""
    marked = None
    for name, df in stores.items():
        rows = df.select("id").where("id IS NOT NULL").distinct().withColumn("store", F.lit(name))
        marked = rows if marked is None else marked.unionAll(rows)
    sets = marked.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("store")), "+").alias("combination"))
    return sets.groupBy("combination").agg(F.count(F.lit(1)).alias("ids"))


def missing(have: DataFrame, of: DataFrame) -> DataFrame:
    """Distinct ids of `of` that `have` lacks."""
    return of.select("id").distinct().join(have.select("id").distinct(), "id", "left_anti")


def largest(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.agg(F.max_by(key, F.struct(F.length(text), -F.col(key))).alias(key), F.max(F.length(text)).alias("length"))


def vague(triples: DataFrame, citation: str, least: int = 15) -> DataFrame:
    """How many citations are too short to name an act, by citation."""
    return triples.where(F.length(citation) < least).groupBy(citation).agg(F.count(F.lit(1)).alias("n"))


def vague_report(triples: DataFrame, citation: str, least: int = 15, samples: int = 5) -> DataFrame:
    """(n, samples): how many triples have such a citation, and those of the first few by seq."""
    rows = triples.where(F.length(citation) < least)
    first = rows.orderBy("seq", citation).limit(samples).agg(F.sort_array(F.collect_list(F.struct("seq", citation))).alias("first"))
    return rows.agg(F.count(F.lit(1)).alias("n")).join(first, how="cross").select("n", F.transform("first", lambda x: x[citation]).alias("samples"))  # one row on either side


def budget(chunks: DataFrame, size: int = 5000) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).select("chunks", (F.lit(size) - F.col("chunks")).alias("left"))


def size_stats(files: DataFrame, by: str, size: str = "size") -> DataFrame:
    """Files and their sizes of each kind: number, total, smallest, largest, mean."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total"), F.min(size).alias("smallest"), F.max(size).alias("largest"), F.round(F.avg(size), 3).alias("mean"))


def xml_report(files: DataFrame, errors: DataFrame, by: str) -> DataFrame:
    """Valid and broken files of each folder, and their bytes; files: (file, content, folder), errors: (file, error)."""
    marked = files.select("file", by, F.octet_length("content").alias("bytes")).join(errors.select("file", F.lit(True).alias("broken")), "file", "left")
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.count_if("broken").alias("broken"), F.sum("bytes").alias("bytes"))


def throughput(done: DataFrame, total: int, hour: str = "1 hour") -> DataFrame:
    """Items done in each window of time, the running total, and how many windows the rest would take at that pace."""
    per = done.groupBy(F.window("ts", hour).getField("start").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("start"))  # one row a window
    return per.withColumn("upto", upto).withColumn("windows_left", F.ceil((F.lit(total) - F.col("upto")) / F.col("n")))


def sample_per_value(rows: DataFrame, key: str, order: str, seed: int = 42, n: int = 1) -> DataFrame:
    """n pseudo-random rows of each value, the same ones each time."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string"))), order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
