"""The property graph as tables: order-aware upsert by one aggregation a table, incremental merge, pattern queries.

Every first-wins or last-wins rule is decided by `seq`, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristrata.functions.text import clean_heading, display_label, id_prefix, node_type, normalize_action, snippet, strip
from juristrata.scratch import materialize

EDGE_KEY = ["source_id", "action_type", "target"]


def latest(value: str, seq: str = "seq") -> Column:
    """The value of the last row where it is not null."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq)))


def earliest(value: str, seq: str = "seq") -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col(seq)))


def noisy_or(confidence: Column) -> Column:
    """1 - (1-c1)(1-c2)...; a null confidence counts as 1."""
    return F.lit(1.0) - F.product(F.lit(1.0) - F.coalesce(confidence, F.lit(1.0)))


def valid_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples that can be ingested, and the skipped ones (no source, or a null or blank target)."""
    bad = F.col("source_id").isNull() | F.col("target_citation").isNull() | (strip(F.col("target_citation")) == "")
    known = triples.withColumn("action_type", F.coalesce(normalize_action(F.col("action")), F.lit("CITES")))
    return known.where(~bad).withColumn("target", F.col("target_citation")), triples.where(bad)


def edges(triples: DataFrame, mode: str = "accumulate", by: str = "provision") -> DataFrame:
    """One edge for each (source, action, target), folded in the order of seq.

    mode 'last' overwrites instead of accumulating confidence; by 'chunk' keys edges by chunk_id as well.
    """
    key = EDGE_KEY + (["chunk_id"] if by == "chunk" else [])
    confidence = noisy_or(F.col("confidence")) if mode == "accumulate" else F.coalesce(F.max_by("confidence", "seq"), F.lit(1.0))
    return triples.groupBy(*key).agg(
        confidence.alias("confidence"), F.count(F.lit(1)).alias("times_seen"), latest("detail").alias("detail"), latest("date").alias("date"),
        F.min_by(F.coalesce("provenance", F.lit("llm_extracted")), "seq").alias("provenance"),
    ).withColumn("source_ids", F.array("source_id"))


STATE = (
    "source_id string, action_type string, target string, doubt double, times_seen bigint, detail string, detail_seq bigint,"
    " date string, date_seq bigint, provenance string, first_seq bigint"
)


def edge_state(triples: DataFrame) -> DataFrame:
    """Edges with all that a later merge needs: the parts of the fold and the seq that decided each."""
    at = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("seq")))
    return triples.groupBy(*EDGE_KEY).agg(
        F.product(F.lit(1.0) - F.coalesce("confidence", F.lit(1.0))).alias("doubt"), F.count(F.lit(1)).alias("times_seen"), latest("detail").alias("detail"), at("detail").alias("detail_seq"),
        latest("date").alias("date"), at("date").alias("date_seq"), F.min_by(F.coalesce("provenance", F.lit("llm_extracted")), "seq").alias("provenance"), F.min("seq").alias("first_seq"),
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """Fold states of disjoint sets of triples into one; the order of merging does not matter."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy(*EDGE_KEY).agg(
        F.product("doubt").alias("doubt"), F.sum("times_seen").alias("times_seen"), F.max_by("detail", "detail_seq").alias("detail"), F.max("detail_seq").alias("detail_seq"),
        F.max_by("date", "date_seq").alias("date"), F.max("date_seq").alias("date_seq"), F.min_by("provenance", "first_seq").alias("provenance"), F.min("first_seq").alias("first_seq"),
    )


def state_edges(state: DataFrame) -> DataFrame:
    return state.select(*EDGE_KEY, (1 - F.col("doubt")).alias("confidence"), "times_seen", "detail", "date", "provenance")


def last_chunks(chunks: DataFrame, prefer: str = "last") -> DataFrame:
    """One chunk an id: the last one; with prefer 'heading', the last that has a heading if any does."""
    rank = F.struct(F.col("heading").isNotNull(), "seq") if prefer == "heading" else F.col("seq")
    row = F.struct(*[c for c in chunks.columns if c != "id"])
    return chunks.groupBy("id").agg(F.max_by(row, rank).alias("row")).select("id", "row.*")


def enrich(triples: DataFrame, chunks: DataFrame, prefer: str = "last") -> DataFrame:
    """Triples with their chunk's heading, part and text snippet."""
    picked = last_chunks(chunks.select("id", "seq", "heading", "part", "content"), prefer)
    found = picked.select(F.col("id").alias("source_id"), clean_heading(F.col("heading")).alias("heading"), "part", snippet(F.col("content")).alias("content_snippet"))
    return triples.join(found, "source_id", "left")


def source_nodes(enriched: DataFrame) -> DataFrame:
    """One node a source id: type, first title, last heading, part and snippet."""
    return enriched.groupBy(F.col("source_id").alias("id")).agg(
        F.coalesce(earliest("source_title"), F.first("source_id")).alias("title"), latest("heading").alias("heading"), latest("part").alias("part"), latest("content_snippet").alias("content_snippet")
    ).select("id", node_type(F.col("id")).alias("type"), "title", "heading", "part", "content_snippet")


def target_nodes(triples: DataFrame) -> DataFrame:
    """One node a target citation, with the first known act name."""
    return triples.groupBy(F.col("target").alias("citation")).agg(F.coalesce(earliest("act_name"), F.first("target")).alias("act_name"))


def nodes(enriched: DataFrame) -> DataFrame:
    """Both kinds of nodes in one table; the key spaces of ids and citations never meet."""
    s, t = source_nodes(enriched), target_nodes(enriched)
    left = s.select(F.concat(F.lit("id:"), "id").alias("node_key"), F.lit("LegalDoc").alias("label"), "id", F.lit(None).cast("string").alias("citation"), "type", "title", F.lit(None).cast("string").alias("act_name"), "heading", "part", "content_snippet")
    null = lambda n: F.lit(None).cast("string").alias(n)
    right = t.select(F.concat(F.lit("citation:"), "citation").alias("node_key"), F.lit("LegalDoc").alias("label"), null("id"), "citation", null("type"), null("title"), "act_name", null("heading"), null("part"), null("content_snippet"))
    return left.unionByName(right)


def outgoing(edge_rows: DataFrame, prefix: str) -> DataFrame:
    """Edges whose source id starts with an act's id."""
    return edge_rows.where(F.col("source_id").startswith(prefix))


def incoming(edge_rows: DataFrame, text: str) -> DataFrame:
    """Edges whose target holds a text (case-sensitive)."""
    return edge_rows.where(F.col("target").contains(text))


def with_nodes(edge_rows: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The pattern (source)-[edge]->(target) with both ends' properties."""
    s = sources.select(F.col("id").alias("source_id"), F.col("type").alias("source_type"), F.col("title").alias("source_title"))
    t = targets.select(F.col("citation").alias("target"), F.col("act_name").alias("target_act"))
    return edge_rows.join(s, "source_id").join(t, "target")


def from_doc(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, doc_id): a chunk belongs to the document whose id its own id starts with; an equi-join on the prefix."""
    return chunks.select(F.col("id").alias("chunk_id"), id_prefix(F.col("id")).alias("doc_id")).join(documents.select("doc_id").distinct(), "doc_id")


def concept_links(docs: DataFrame, key: str, fields: list[str], concepts: list[tuple[str, list[str]]]) -> DataFrame:
    """(key, concept): a document is linked when any field holds any keyword, case aside. One pass, one test a
    concept: the keywords become conditions of a projection, not a join."""
    holds = lambda words: F.exists(F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]), lambda v: _any(v, words))
    hits = F.array(*[F.when(holds(words), F.lit(name)) for name, words in concepts])
    return docs.select(key, F.explode(F.array_compact(hits)).alias("concept")).distinct()


def _any(value: Column, words: list[str]) -> Column:
    test = value.contains(words[0])
    for w in words[1:]:
        test = test | value.contains(w)
    return test


def concept_counts(links: DataFrame, names: DataFrame) -> DataFrame:
    """Documents of each concept, concepts without any included."""
    n = links.groupBy("concept").agg(F.count(F.lit(1)).alias("docs"))
    return names.join(n, "concept", "left").select("concept", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"))


def chains(edge_rows: DataFrame, acts: DataFrame) -> DataFrame:
    """Two-step chains through titles: a source modifies an act whose own provisions modify another.

    acts: (source_id, title, act_name of the target)."""
    first = acts.select(F.col("source_id").alias("start"), F.col("act_name").alias("through")).distinct()
    second = acts.select(F.col("title").alias("through"), F.col("act_name").alias("finish")).distinct()
    return first.join(second, "through").where("through <> finish").select("start", "through", "finish").distinct()


def conflicts(edge_rows: DataFrame) -> DataFrame:
    """(target, amending, repealing): targets that one act amends and another repeals, with the numbers of such acts."""
    by = edge_rows.where(F.col("action_type").isin("AMENDS", "REPEALS")).select("target", "action_type", id_prefix(F.col("source_id")).alias("act"))
    # One row an act first, so a target that very many edges have is pre-aggregated.
    acts = by.groupBy("target", "act").agg(F.bool_or(F.col("action_type") == "AMENDS").alias("amends"), F.bool_or(F.col("action_type") == "REPEALS").alias("repeals"))
    found = acts.groupBy("target").agg(F.count_if("amends").alias("amending"), F.count_if("repeals").alias("repealing"), F.count(F.lit(1)).alias("acts"))
    return found.where("amending > 0 AND repealing > 0 AND acts > 1").drop("acts")


def label_counts(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by label and type, and edges by action."""
    nodes_by = node_rows.groupBy(F.concat_ws(" ", "label", F.coalesce("type", F.lit("cited"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    edges_by = edge_rows.groupBy(F.col("action_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes_by.select(F.lit("node").alias("kind"), "name", "n").unionByName(edges_by.select(F.lit("edge").alias("kind"), "name", "n"))


def display_nodes(edge_rows: DataFrame) -> DataFrame:
    """(name, role, degree) for drawing."""
    ends = edge_rows.select(F.col("source_id").alias("name"), F.lit("source").alias("role")).unionAll(edge_rows.select("target", F.lit("target")))
    return ends.groupBy("name", "role").agg(F.count(F.lit(1)).alias("degree"))


def display_edges(edge_rows: DataFrame) -> DataFrame:
    """(source, target, action_type, weight) with shortened labels, for drawing."""
    return edge_rows.select(display_label(F.col("source_id")).alias("source"), display_label(F.col("target")).alias("target"), "action_type", F.round("confidence", 2).alias("weight"))


def save_edges(edge_rows: DataFrame, path: str) -> None:
    """Write edges so that both kinds of lookup skip data: files ranged by source, rows sorted by source and target, and a
    Bloom filter on targets."""
    ranged = edge_rows.repartitionByRange("source_id").sortWithinPartitions("source_id", "target")
    ranged.write.mode("overwrite").option("parquet.bloom.filter.enabled#target", "true").parquet(path)


def schema_profile(node_rows: DataFrame, edge_rows: DataFrame, links: DataFrame) -> DataFrame:
    """What the graph holds, in long form (kind, name, value)."""
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(kind).alias("kind"), F.lit("all").alias("name"), "value")
    by = lambda df, c, kind: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("value")).select(F.lit(kind).alias("kind"), "name", "value")
    return one(node_rows, "nodes").unionAll(one(edge_rows, "edges")).unionAll(by(edge_rows, "action_type", "action")).unionAll(by(links, "concept", "concept"))


def run_query(spark, sql: str, most: int = 100) -> str:
    """The free-form query tool: one read-only statement over the registered views, as a JSON list, or a warning."""
    import json
    import re

    text = sql.strip().rstrip(";")
    if ";" in text or not re.match(r"(?i)(select|with|from)\b", text):
        return "⚠️ Only a single read-only statement is allowed."
    try:
        rows = spark.sql(text).limit(most).toJSON().collect()
    except Exception as e:  # the message goes back to the model
        return f"⚠️ Query failed: {str(e).splitlines()[0][:300]}"
    return json.dumps([json.loads(r) for r in rows], ensure_ascii=False) if rows else "⚠️ The query gave no rows."


# Fixed value: how a text names an act.
NAMED_ACT = r"([A-Z][A-Za-z\s\(\)]+(?:Act|Order|Regulations?)\s+\d{4})"


def chunk_context(chunks: DataFrame, edge_rows: DataFrame, acts: int = 5, lines: int = 15, detail: int = 80) -> DataFrame:
    """(id, context) of chunks (id, content, doc_title): one line for each edge whose source title or target holds an act
    that the chunk names, in the order of the names (the chunk's own title is the last), then of the edges; repeated
    lines once. Chunks without such edges are left out.

    An act's name starts with a capital and ends with a year, so the parts of a title or target that could hold it are
    few, and the containment is an equi-join on them; titles of another shape must equal the whole. Edges are ranked
    before chunks meet them, so a much-named act brings `lines` edges to each list of names and no more. The answers of
    the lists are computed when this is called, and stay in a scratch table that the result reads: where it is small, it
    is broadcast, and the chunks' lines are never shuffled."""
    own = F.filter(F.array(strip(F.col("doc_title"))), lambda t: t != "")
    names = F.array_distinct(F.concat(F.transform(F.regexp_extract_all("content", F.lit(NAMED_ACT), 1), strip), F.coalesce(own, F.array().cast("array<string>"))))
    placed = F.transform(F.slice(names, 1, acts), lambda name, p: F.struct((p + 1).alias("p"), name.alias("name")))
    some = chunks.select("id", placed.alias("named")).where(F.size("named") > 0)
    # Rows of one id meet before anything is looked up: only names are shuffled.
    by_id = some.repartition("id").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("named")))).alias("named"))
    both = edge_rows.withColumn("line", F.concat(F.lit("["), "action_type", F.lit("] "), "source_id", F.lit(" -> "), "target", F.coalesce(F.concat(F.lit(" | "), F.left("detail", F.lit(detail))), F.lit(""))))
    held = both.withColumn("name", F.explode(F.array_distinct(F.concat(_holdable(F.col("source_title")), _holdable(F.col("target"))))))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("source_id", "action_type", "target", "line"))
    first = held.select("name", "line", rank.alias("k")).where(F.col("k") <= lines)
    told = first.groupBy("name").agg(F.collect_list(F.struct("k", "line")).alias("told"))
    # Each list of names is answered once, however many chunks have it.
    met = by_id.select("named").distinct().select("named", F.explode("named").alias("at")).select("named", "at.p", "at.name").join(told, "name")
    every = F.sort_array(F.flatten(F.collect_list(F.transform("told", lambda t: F.struct(F.col("p").alias("p"), t["k"].alias("k"), t["line"].alias("line"))))))
    shown = F.slice(F.array_distinct(F.transform(every, lambda t: t["line"])), 1, lines)
    answers = materialize(met.groupBy("named").agg(F.array_join(shown, "\n").alias("context")), "chunk-context")
    return by_id.join(answers, "named").select("id", "context")


def _holdable(text: Column) -> Column:
    """The names that a text can hold: from each capital to each year that ends an act's name, and the whole text."""
    whole = F.coalesce(text, F.lit(""))
    place = F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)))
    capitals = F.filter(place, lambda i: F.substring(whole, i, F.lit(1)).rlike("[A-Z]"))
    ends = F.filter(place, lambda i: F.substring(whole, F.lit(1), i).rlike(r"(?s)(Act|Order|Regulations?)\s+\d{4}$"))
    cut = F.flatten(F.transform(capitals, lambda a: F.transform(ends, lambda b: F.substring(whole, a, b - a + 1))))
    return F.filter(F.concat(cut, F.array(whole)), lambda n: n != "")
