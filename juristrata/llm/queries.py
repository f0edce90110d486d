"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristrata.llm import bpe, exact_dedup, hmm, language_id, line_dedup, minhash, mixing, neighbours, quality, url_filter
from juristrata.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    found = quality.predict(docs, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame, cache: int | None = None, keep: list[str] | None = None) -> DataFrame:
    found = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), cache=cache, keep=keep)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(keep or []))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_dedup(table(spark, sf_dir, "documents"), shingle_words=4, share=(80, 100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.score_corpus(table(spark, sf_dir, "documents"), ~held_out(10, 0))
    return found.select("doc_id", held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


MIX_POWER = 0.5
"""Target weight of a source in op5: its number of rows to this power."""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), power=MIX_POWER)


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~held_out(3, 1))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_hmm": op2_hmm,
    "op3_line_dedup": op3_line_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_neighbours": op10_neighbours,
}

SQL = {
    "op1_minhash": r"""
        WITH RECURSIVE w AS MATERIALIZED (
          SELECT doc_id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
          FROM documents),
        s AS MATERIALIZED (
          SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle
          FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS i FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_of AS MATERIALIZED (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
          FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (
          SELECT a, b FROM both_of JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
        u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach(doc_id, other) AS (
          SELECT doc_id, doc_id FROM documents
          UNION SELECT r.doc_id, u.b FROM reach r JOIN u ON u.a = r.other)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n""",
    "op3_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, line, pos,
                 translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
        f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN f ON l.key = f.key GROUP BY doc_id""",
    "op4_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM n
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)""",
    "op5_mixing": r"""
        WITH RECURSIVE n AS (SELECT coalesce('=' || source, 'null') AS key, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
        -- a slot for each block of 8 rows, between 1,000 and 16,000 and by the work of a frame; the tables have fewer than 256 sources
        q AS MATERIALIZED (SELECT greatest(1000, least(sum((n + 7) // 8), 16000, 1500000 // count(*)))::BIGINT AS q, count(*) AS lanes, sum(w) AS w FROM n),
        b0 AS (SELECT key, n.n, greatest(q.q * n.w / q.w - 1, 0) AS beyond, q.q - q.lanes AS free FROM n, q),
        i AS (SELECT key, n, free, round(free * beyond / sum(beyond) OVER (), 9) AS ideal FROM b0),
        p AS MATERIALIZED (
          SELECT key, n, 1 + floor(ideal)::BIGINT + (row_number() OVER (ORDER BY round(ideal - floor(ideal), 9) DESC, key)
                                     <= free - sum(floor(ideal)::BIGINT) OVER ())::BIGINT AS p
          FROM i),
        -- one frame: at every slot the released block with the earliest deadline
        f(t, had, pick) AS (
          SELECT -1::BIGINT, (SELECT map_from_entries(list({'k': key, 'v': 0::BIGINT} ORDER BY key)) FROM p), NULL::VARCHAR
          UNION ALL
          SELECT t + 1,
                 map_from_entries(list_transform(map_entries(had), lambda e: {'k': e.key, 'v': e.value + (e.key = x.k)::BIGINT})), x.k
          FROM f, q, LATERAL (
            SELECT p.key AS k FROM p, q AS q1
            WHERE f.had[p.key] < p.p AND f.had[p.key] * q1.q // p.p <= f.t + 1
            ORDER BY ((f.had[p.key] + 1) * q1.q + p.p - 1) // p.p, p.key LIMIT 1) x
          WHERE t < q.q - 1),
        slots AS (SELECT pick AS key, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS i FROM f WHERE t >= 0),
        h AS (SELECT min(n // 8 * q // p) AS horizon FROM p, q),
        d AS (
          SELECT doc_id, source, coalesce('=' || source, 'null') AS key,
                 row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS seq
          FROM documents),
        b AS (SELECT doc_id, source, p, key, seq // 8 AS block, seq % 8 AS place FROM d JOIN p USING (key))
        SELECT doc_id, source, block, place, block // p * q + slot AS slot, block * q // p AS release,
               ((block + 1) * q + p - 1) // p AS deadline, block // p * q + slot < horizon AS within
        FROM b JOIN slots ON slots.key = b.key AND slots.i = b.block % b.p, h, q""",
}
