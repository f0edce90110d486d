"""The corpus pipeline: from raw documents to token ids, each stage by one operator of juristrata.llm.

1. language_id: a model is learnt from the labelled rows of the stage's input; documents go that have no letter (no
   language can be told: `und`) or whose language is less sure than MIN_SURE (with two families of two languages none
   is: the score is at least 0.25).
2. exact_dedup: of documents with equal texts (white space aside) the longest, then the smallest id, stays.
3. near_dedup: min-max hashing over five-word shingles at similarity 0.8; one document of each component stays.
4. mixing: the documents in the order of a Pfair schedule in which each source's weight is the square root of its
   rows, so the hot source does not fill the front of the stream. All documents stay; the order of rows is the
   decision. Row groups and files keep it, but a reader may take files in another order.
5. bpe: token ids of every document and what they decode to, as counts and digests; and each document's slot and place
   in the mixture, which follow from the ids and sources of the rows alone. By (slot, place) the rows are the mixture.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristrata.llm import exact_dedup as copies
from juristrata.llm import language_id as language
from juristrata.llm import minhash, mixing, queries
from juristrata.llm.common import held_out, materialize

MIN_SURE = 0.2
MIX_POWER = 0.5
BPE_CACHE = 70_000
"""Pieces of text that a worker keeps in the last stage; it shares the executors with what earlier stages left."""

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs, ~held_out(3, 1))
    found = language.judge(spark, model, F.col("text"))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= MIN_SURE))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixture_order(docs, power=MIX_POWER)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    digests = materialize(queries.bpe_digests(docs, cache=BPE_CACHE, keep=["source"]), "bpe-digests")
    found = [c for c in digests.columns if c not in ("doc_id", "source")]
    mixed = mixing.mix(digests, power=MIX_POWER, keep=found)
    return mixed.select("doc_id", *[f"row.{c}" for c in found], "slot", "place")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
