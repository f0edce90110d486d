"""The graph's folds, merges and patterns."""

import json
import random

import pytest
from pyspark.sql import functions as F

from juristrata.operators import agent, corpus, evaluate, extract, graph, quality, search
from juristrata.streaming import accumulate

TRIPLE = "seq long, source_id string, source_title string, action string, target_citation string, act_name string, confidence double, detail string, date string, provenance string"


def triples(spark, rows):
    return spark.createDataFrame(rows, TRIPLE)


ROWS = [
    (1, "a.xml_1", None, "amends", "X Act 2000 s.1", None, 0.8, "one", None, None),
    (2, "a.xml_1", "A", "AMENDED", "X Act 2000 s.1", "X Act 2000", 0.6, None, "2020-01-01", "effects_api"),
    (3, "a.xml_1", "B", "amends", "X Act 2000 s.1", "Y", 0.7, "three", None, None),
    (4, "a.xml_1", "B", "nonsense", "X Act 2000 s.1", "Y", None, None, None, None),
    (5, "a.xml_1", "B", "cites", "   ", "Y", 0.5, None, None, None),
    (6, None, "B", "cites", "Z", "Y", 0.5, None, None, None),
]


def test_edge_fold(spark):
    good, bad = graph.valid_triples(triples(spark, ROWS))
    assert bad.count() == 2
    got = {r["action_type"]: r for r in graph.edges(good).collect()}
    e = got["AMENDS"]
    assert (round(e["confidence"], 6), e["times_seen"], e["detail"], e["date"], e["provenance"], e["source_ids"]) == (0.976, 3, "three", "2020-01-01", "llm_extracted", ["a.xml_1"])
    assert got["CITES"]["confidence"] == 1.0


def test_fold_does_not_depend_on_partitions_or_order(spark):
    r = random.Random(1)
    rows = [(i, f"s{r.randrange(4)}", None, "amends", f"t{r.randrange(3)}", None, r.choice([None, 0.3, 0.5]), r.choice([None, f"d{i}"]), r.choice([None, f"x{i}"]), r.choice([None, "p"])) for i in range(200)]
    want = None
    for n in (1, 3, 7):
        r.shuffle(rows)
        good, _ = graph.valid_triples(triples(spark, rows).repartition(n))
        parts = [graph.edge_state(good.where(F.col("seq") % n == k)) for k in range(n)]
        for got in (graph.edges(good).drop("source_ids"), graph.state_edges(graph.merge_states(*parts))):
            now = sorted((x["source_id"], x["action_type"], x["target"], round(x["confidence"], 9), x["times_seen"], x["detail"], x["date"], x["provenance"]) for x in got.collect())
            want = want or now
            assert now == want


def test_nodes_first_and_last_wins(spark):
    good, _ = graph.valid_triples(triples(spark, ROWS))
    chunks = spark.createDataFrame([(1, "a.xml_1", "H1", "P1", "x | TEXT: first"), (2, "a.xml_1", None, None, "x | TEXT: second")], "seq long, id string, heading string, part string, content string")
    last = graph.enrich(good, chunks)
    node = graph.source_nodes(last).first()
    assert (node["title"], node["heading"], node["part"], node["content_snippet"], node["type"]) == ("A", None, None, "second", "legislation")
    assert graph.source_nodes(graph.enrich(good, chunks, prefer="heading")).first()["heading"] == "H1"
    assert graph.target_nodes(good).first()["act_name"] == "X Act 2000"
    assert graph.nodes(last).count() == 2


def test_stream_equals_batch_and_replays_do_not_count_twice(spark, tmp_path):
    good, _ = graph.valid_triples(triples(spark, [(i, f"s{i % 3}", None, "amends", f"t{i % 2}", None, 0.5, None, None, None) for i in range(40)]))
    good.select("seq", "source_id", "action_type", "target", "confidence", "detail", "date", "provenance").repartition(5).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    store = accumulate.EdgeStore(spark, str(tmp_path / "store"))
    accumulate.accumulate(live, store, str(tmp_path / "mark")).awaitTermination()
    key = lambda df: sorted((r["source_id"], r["target"], r["times_seen"], round(r["confidence"], 9)) for r in df.collect())
    assert key(graph.state_edges(store.read())) == key(graph.edges(rows))
    versions = store.versions()
    assert len(versions) == 2
    before = key(graph.state_edges(store.read()))
    last = rows.where("seq < 0")
    store.fold(last, versions[-1] + 1)
    assert key(graph.state_edges(store.read())) == before


def test_lookup_keeps_order_and_repeats(spark):
    chunks = spark.createDataFrame([(1, "a", "T", "x | TEXT: one"), (2, "a", "T", "x | TEXT: two"), (3, "b", "U", "none")], "seq long, id string, doc_title string, content string")
    got = [(r["pos"], r["id"], r["text"]) for r in corpus.lookup(chunks, ["b", "a", "zz", "a"]).orderBy("pos").collect()]
    assert got == [(0, "b", ""), (1, "a", "two"), (3, "a", "two")]
    assert corpus.lookup(chunks, []).count() == 0


def test_misses(spark):
    rows = [("g", n, h) for n, h in enumerate([True, False, True, False, False, True], 1)] + [("k", 1, False), ("k", 2, False), ("k", 3, True)]
    got = corpus.cut_after_misses(spark.createDataFrame(rows, "g string, n int, hit boolean"), "g", 2)
    assert sorted((r["g"], r["n"]) for r in got.collect()) == [("g", 1), ("g", 2), ("g", 3), ("g", 4), ("g", 5), ("k", 1), ("k", 2)]


def test_abbreviations(spark):
    rows = [(1, {"LTA": "Landlord and Tenant Act 1985", "too long a name": "x"}, ""), (2, None, 'see the Leasehold Reform Act 1967 ("the LRA 1967") and the Land Act 1925 ("LTA 1925")'), (3, None, 'the Land Reform Act 1967 (“the LRA 1967”)')]
    got = {r["short"]: r["full"] for r in corpus.abbreviations(spark.createDataFrame(rows, "seq long, defined_terms map<string,string>, content string")).collect()}
    assert got == {"LTA": "Landlord and Tenant Act 1985", "the LRA 1967": "the Land Reform Act 1967", "LTA 1925": "the Land Act 1925"}


def test_smart_batch(spark):
    rows = [(i, "judgment" if i == 9 else "legislation", "will repeal" if i in (4, 7) else "plain") for i in range(10)]
    chunks = spark.createDataFrame(rows, "seq long, source string, content string")
    assert [r["seq"] for r in extract.smart_batch(chunks, 5).collect()] == [0, 1, 4, 7, 9]
    assert [r["seq"] for r in extract.smart_batch(chunks, 2).collect()] == [4, 7]


def test_extract_with_injected_model(spark):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(5)], "id string, prompt string")

    def model(batch):
        if "p3" in batch:
            raise TimeoutError
        return ['[{"action": "amends", "target_citation": "X Act 2000 section 1"}]' for _ in batch]

    out = extract.extract(prompts, model, workers=2, batch=1, wait=0.0)
    got = extract.validated(extract.parsed(out)).collect()
    assert sorted(r["id"] for r in got) == ["0", "1", "2", "4"] and got[0]["target_citation"] == "X Act 2000 s.1"
    assert out.where("output IS NULL").count() == 1


def test_extract_tries_again_and_goes_on(spark, tmp_path):
    """Timeouts are tried again; another error costs the one prompt its items; what has an output is not asked again."""
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(6)], "id string, prompt string")
    marks = str(tmp_path)

    def model(batch):
        import os

        if "p5" in batch:
            raise ValueError("no such prompt")
        if "p3" in batch and not os.path.exists(f"{marks}/tried"):
            open(f"{marks}/tried", "w").close()
            raise RuntimeError("Request timeout")
        if "p1" in batch:
            raise ConnectionError
        return [f"[{p}]" for p in batch]

    got = {r["id"]: r["output"] for r in extract.extract(prompts, model, workers=1, batch=2, wait=0.0).collect()}
    assert got == {"0": None, "1": None, "2": "[p2]", "3": "[p3]", "4": "[p4]", "5": "[]"}
    done = spark.createDataFrame(list(got.items()), "id string, output string")
    again = extract.extract(prompts, lambda batch: ["[]"] * len(batch), workers=1, wait=0.0, done=done)
    assert sorted(r["id"] for r in again.collect()) == ["0", "1"]


def test_sampling_confidence_is_over_successful_runs(spark):
    samples = spark.createDataFrame([("c", 0, 1, "CITES", "X Act 2000", None), ("c", 2, 1, "CITES", "X Act 2000", "d"), ("c", 2, 2, "CITES", "Y Act 2001", None), ("d", 0, 1, "CITES", "X Act 2000", None)], "chunk string, run int, ord int, action string, citation string, detail string")
    runs = spark.createDataFrame([("c", 0), ("c", 1), ("c", 2), ("d", 0), ("d", 1)], "chunk string, run int")
    got = {(r["chunk"], r["citation"]): (r["confidence"], r["detail"]) for r in extract.sampling_confidence(samples, runs).collect()}
    assert got == {("c", "X Act 2000"): (0.67, "d"), ("d", "X Act 2000"): (0.5, None)}


def test_prompts_and_processable_texts(spark):
    body = "x" * 50
    rows = spark.createDataFrame([(1, "judgment", f"CASE: a | TEXT: {body}"), (2, "judgment", f"CASE: {body} | TEXT: short"), (3, "legislation", f"ACT: a | TEXT: {body}")], "seq long, source string, content string")
    assert [r["seq"] for r in extract.processable(rows).collect()] == [1]
    prompts = {r["seq"]: r["p"] for r in rows.select("seq", extract.system_prompt(F.col("source")).alias("p")).collect()}
    assert prompts[1] == prompts[2] != prompts[3] and all("target_citation" in p and "JSON array" in p for p in prompts.values())
    assert [r["seq"] for r in extract.from_offset(rows, 2).collect()] == [2, 3]


def test_conflicts_need_an_amending_and_another_repealing_act(spark):
    rows = [("a.xml_1", "AMENDS", "both"), ("b.xml_1", "REPEALS", "both"), ("b.xml_2", "REPEALS", "both"), ("a.xml_1", "AMENDS", "same act"), ("a.xml_2", "REPEALS", "same act"), ("a.xml_1", "AMENDS", "cited"), ("b.xml_1", "CITES", "cited"), ("c.xml_1", "INSERTS", "cited")]
    got = graph.conflicts(spark.createDataFrame(rows, "source_id string, action_type string, target string")).collect()
    assert [tuple(r) for r in got] == [("both", 1, 1)]


def test_concepts(spark):
    docs = spark.createDataFrame([(1, "Soil and OIL", None), (2, None, None), (3, "Taxi rules", "police")], "k int, title string, act string")
    links = graph.concept_links(docs, "k", ["title", "act"], [("Energy", ["oil", "gas"]), ("Road", ["taxi"]), ("Crime", ["police"])])
    assert sorted(map(tuple, links.collect())) == [(1, "Energy"), (3, "Crime"), (3, "Road")]


def test_batch_search_equals_single(spark):
    r = random.Random(2)
    v = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(99, [0.0] * 8)]
    index = spark.createDataFrame(v, "pos int, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, v[i][1]) for i in range(5)], "query_id long, q array<double>")
    many = {}
    for x in search.batch_top_k(index, queries, 3, query_rows=2).collect():
        many.setdefault(x["query_id"], []).append((x["rank"], x["pos"]))
    for i in range(5):
        assert [p for _, p in sorted(many[i])] == [x["pos"] for x in search.top_k(index, v[i][1], 3).collect()]


@pytest.fixture
def tools(spark):
    chunks = spark.createDataFrame([(1, "a.xml_1", "T", "1", "legislation", None, "ACT: T | TEXT: taxi licences are required in towns")], "seq long, id string, doc_title string, section string, source string, heading string, content string")
    encoder = search.hashing_encoder()
    return agent.Tools(search.build_index(chunks, encoder), chunks, encoder)


def test_agent(tools):
    script = iter(["ANSWER: too soon", "hm", 'ACTION: semantic_search("ACT: T | TEXT: taxi licences are required in towns", top_k=1)', 'ACTION: lookup_corpus("a.xml_1")', "ANSWER: yes (ukpga_2023_55.xml_63)"])
    a = agent.Agent(lambda text: next(script), tools)
    assert a.ask("q") == "yes" and a.called == ["semantic_search", "lookup_corpus"]
    assert "MUST call semantic_search" in a.conversation and "must respond with ACTION" in a.conversation


def test_agent_without_data_or_end(tools):
    script = iter(['ACTION: semantic_search("zzz")', "ANSWER: maybe"])
    assert agent.Agent(lambda text: next(script), tools).ask("q").startswith("⚠️")
    assert agent.Agent(lambda text: "ACTION: fly(1)", tools, max_steps=2).ask("q").startswith("❌")
    assert agent.argument('run_query(SELECT f(1) FROM t) and more)', "run_query") == "SELECT f(1) FROM t"


def test_query_tool_is_read_only(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert len(json.loads(graph.run_query(spark, "SELECT id FROM numbers"))) == 3
    for sql in ("DROP VIEW numbers", "SELECT 1; SELECT 2", "SELECT id FROM numbers WHERE id > 9", "SELECT nothing FROM numbers"):
        assert graph.run_query(spark, sql).startswith("⚠️")


def test_evaluation_and_trace(spark):
    rows = [("q", "d", "It AMENDS it", 1.0, ["AMENDS", "CITES"], None), ("n", "d", "⚠️ none", 3.0, [], None), ("e", "d", "❌ failed", 2.0, ["CITES"], "x")]
    scored = evaluate.score_answers(spark.createDataFrame(rows, "question string, domain string, answer string, elapsed_seconds double, expected_actions array<string>, error string"))
    assert evaluate.summary(scored).first().asDict() == {"questions": 3, "answered": 2, "grounded": 2, "succeeded": 2, "mean_seconds": 2.0}
    spans = [("tool", "TOOL", 5, 9, "t", {"query": "a\nb", "result_preview": "x" * 120}), ("agent", "CHAIN", 1, 20, "t", {"question": "why", "answer": "so"}), ("chat x", "?", 3, 4, "t", {"llm.input_messages": "hi", "output.value": "ho"})]
    got = evaluate.timeline(spark.createDataFrame(spans, "name string, span_kind string, start_time bigint, end_time bigint, trace_id string, attributes map<string,string>")).orderBy("step").collect()
    assert [(r["step"], r["role"], r["duration"], r["input"]) for r in got] == [(1, "agent", 19, "why"), (2, "llm", 1, "hi"), (3, "tool", 4, "a b")]
    assert got[2]["output"] == "x" * 100 + "..."


def test_quality(spark):
    rows = spark.createDataFrame([("a", "x" * 40, None), ("a", "short", "h"), ("b", "y" * 30, "")], "id string, content string, heading string")
    assert quality.chunk_report(rows).first().asDict() == {"chunks": 3, "duplicate_ids": 1, "short": 1, "documents": 2}
    assert {r["field"]: (r["n"], r["percent"]) for r in quality.completeness(rows, ["heading", "id"]).collect()} == {"heading": (1, 33.0), "id": (3, 100.0)}
    one, two = rows.select("id"), spark.createDataFrame([("b",), ("c",)], "id string")
    assert {r["combination"]: r["ids"] for r in quality.coverage(one=one, two=two).collect()} == {"one": 1, "one+two": 1, "two": 1}
