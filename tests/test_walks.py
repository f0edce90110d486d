"""Walks along stored feed pages, numbering over many files, and what the graph says about a chunk's acts."""

from pyspark.sql import functions as F

from juristrata.operators import corpus, graph
from juristrata.sources import files, xml


def walked(links, start, most):
    out, page, known = [], start, {p for p, _ in links}
    while page in known and page not in out and len(out) < most:
        out.append(page)
        page = dict(links)[page]
    return out


def test_follow_equals_a_walk(spark):
    links = [(f"a{k}", f"a{k + 1}" if k < 10 else None) for k in range(11)] + [("b0", "b1"), ("b1", "b0"), ("c0", "gone"), ("d0", "d0")]
    table = spark.createDataFrame(links, "page string, next string").repartition(3)
    starts = spark.createDataFrame([(p, p) for p in ("a0", "a5", "b0", "c0", "d0")], "feed string, page string")
    for most in (1, 5, 12):
        got = {}
        for r in files.follow(table, starts, most).orderBy("step").collect():
            got.setdefault(r["feed"], []).append(r["page"])
        assert got == {s: walked(links, s, most) for s in ("a0", "a5", "b0", "c0", "d0")}
    assert files.follow(table.limit(0), starts.limit(0), 5).count() == 0


def test_numbers_of_many_files(spark):
    rows = [(f"{kind}_{2000 + y}_{n}", o) for kind in ("ukpga", "uksi", "x") for y in range(5) for n in range(4) for o in (7, 0, 3)]
    table = spark.createDataFrame(rows, "file string, ord long").withColumn("key", F.concat_ws("|", "file", "ord")).repartition(5)
    other = spark.createDataFrame([("a", 0, "last")], "file string, ord long, key string")
    got = {r["key"]: r["seq"] for r in corpus.union_sources(table, other).collect()}
    assert got == {k: i for i, k in enumerate([f"{f}|{o}" for f, o in sorted(rows)] + ["last"])}


def test_union_reads_its_sources_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    table = spark.createDataFrame([(f"ukpga_2000_{k % 7}", k) for k in range(50)], "file string, ord long").mapInPandas(run, "file string, ord long").withColumn("key", F.concat_ws("|", "file", "ord"))
    assert corpus.union_sources(table.where("file < 'ukpga_2000_3'"), table.where("file >= 'ukpga_2000_3'")).select("key", "seq").collect()[0] is not None
    assert seen.value == 100  # two sources of 50 rows each


def test_context_of_odd_rows(spark):
    edges = spark.createDataFrame(
        [("s1", "Rent Act 1977", "AMENDS", "Housing Act 1985 s.1", "d" * 100), ("s2", None, "CITES", "the Housing Act 1985", None), ("s3", "A v B", "CITES", None, None), ("s1", "Rent Act 1977", "AMENDS", "Housing Act 1985 s.1", "d" * 100)],
        "source_id string, source_title string, action_type string, target string, detail string",
    )
    chunks = spark.createDataFrame([(1, "see 1 Housing Act 1985, 2 Housing Act 1985", "A v B"), (2, None, None), (3, "nothing", ""), (4, "in 5 Rent Act 1977 (", None), (5, "the Act 1985", "A v")], "id long, content string, doc_title string")
    got = {r["id"]: r["context"].split("\n") for r in graph.chunk_context(chunks, edges).where("context IS NOT NULL").collect()}
    assert got == {1: ["[AMENDS] s1 -> Housing Act 1985 s.1 | " + "d" * 80, "[CITES] s2 -> the Housing Act 1985"], 4: ["[AMENDS] s1 -> Housing Act 1985 s.1 | " + "d" * 80]}


def test_validity_counts_bytes(spark):
    table = spark.createDataFrame([("p_1", b"<a/>"), ("p_2", b"<a>"), ("q_1", b"<b></b>")], "file string, content binary")
    got = {r["folder"]: tuple(r)[1:] for r in xml.validity(table, F.left("file", F.lit(1))).collect()}
    assert got == {"p": (2, 1, 1, 7), "q": (1, 1, 0, 7)}


def test_context_shuffles_names_and_not_lines(spark):
    edges = spark.createDataFrame([(f"s{k:02}", f"Rent Act {1970 + k % 3}", "CITES", f"Housing Act {1980 + k % 2} s.{k}", None) for k in range(60)], "source_id string, source_title string, action_type string, target string, detail string")
    texts = ["1 Rent Act 1970, 2 Housing Act 1981", "1 Housing Act 1981, 2 Rent Act 1970", "1 Rent Act 1999", "1 Rent Act 1999, 2 Rent Act 1971", ""]
    chunks = spark.createDataFrame([(k, texts[k % 5], None) for k in range(40)] + [(0, "1 Rent Act 1972", "Housing Act 1980")], "id long, content string, doc_title string").repartition(4)
    found = graph.chunk_context(chunks, edges)
    assert "line" not in found._jdf.queryExecution().executedPlan().toString()

    def first(name):
        return [f"[CITES] s{k:02} -> Housing Act {1980 + k % 2} s.{k}" for k in range(60) if name in (f"Rent Act {1970 + k % 3}", f"Housing Act {1980 + k % 2}")][:15]

    def context(named):
        placed = sorted((p, k, line) for p, name in named for k, line in enumerate(first(name)))
        return list(dict.fromkeys(line for *_, line in placed))[:15]

    lists = {0: [(1, "Rent Act 1970"), (2, "Housing Act 1981")], 1: [(1, "Housing Act 1981"), (2, "Rent Act 1970")], 3: [(1, "Rent Act 1999"), (2, "Rent Act 1971")]}
    want = {k: context(lists[k % 5]) for k in range(40) if k % 5 in lists} | {0: context(lists[0] + [(1, "Rent Act 1972"), (2, "Housing Act 1980")])}
    assert {r["id"]: r["context"].split("\n") for r in found.collect()} == want
