"""Registry, discovery, JSON and stored tables."""

from juristrata.operators import graph, search
from juristrata.sources import files


def test_registry_keeps_the_first_of_each_uri(spark):
    schema = "seq long, uri string, title string, type string, year int, number int"
    seeds = spark.createDataFrame([(5, "/ukpga/2020/1", "seed", "ukpga", 2020, 1)], schema)
    found = spark.createDataFrame([(1, "/ukpga/2020/1", "found", "ukpga", 2020, 1), (2, "/uksi/2020/2", "x", "uksi", 2020, 2), (3, "/eur/2020/2", "y", "eur", 2020, 2)], schema)
    reg = files.registry(seeds, found)
    assert {r["uri"]: r["title"] for r in reg.collect()} == {"/ukpga/2020/1": "seed", "/uksi/2020/2": "x", "/eur/2020/2": "y"}
    one = files.manifest(reg, cases=4).first()
    assert (one["cases"], one["total"], one["acts"], one["instruments"], len(one["items"])) == (4, 3, 1, 1, 3)
    have = spark.createDataFrame([("uksi_2020_2",)], "file string")
    assert sorted(r["file"] for r in files.new_documents(reg, have).collect()) == ["eur_2020_2", "ukpga_2020_1"]


def test_missing_json_is_empty(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "some.json").write_text('[{"a": 1}, {"a": 2, "b": 3}]')
    assert sorted(r["a"] for r in files.read_json(spark, str(tmp_path / "some.json"), "a int").collect()) == [1, 2]
    files.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_fetching_retries_and_gives_up(spark):
    def fetcher(url):
        if url == "gone":
            return None
        if url == "down":
            raise OSError
        return url.encode()

    got = files.fetch(spark.createDataFrame([("a",), ("gone",), ("down",)], "url string"), fetcher, wait=0.0)
    assert {r["url"]: r["content"] and bytes(r["content"]) for r in got.collect()} == {"a": b"a", "gone": None, "down": None}


def test_feed_walk_ends(spark):
    pages = {"p1": ([{"n": 1}], "p2"), "p2": ([{"n": 2}], "p1")}
    assert files.walk_feed("p1", pages.__getitem__) == [{"n": 1}, {"n": 2}]
    assert files.walk_feed("p1", lambda u: ([{"n": u}], u + "x"), most=3) == [{"n": "p1"}, {"n": "p1x"}, {"n": "p1xx"}]
    assert len(files.discovery_urls("http://h")) == 13 + 21 + 4 * 37


def test_case_probes(spark):
    probes = files.case_probes(spark, ["ewca_civ"], [2020], 2)
    hits = probes.withColumn("hit", probes["n"] == 2)
    assert {r["n"]: r["uri"] for r in files.attempts_won(hits).collect()} == {1: None, 2: "/ewca_civ/2020/2"}


def test_stored_index_and_edges(spark, tmp_path):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (0, [0.0, 1.0])], "pos int, embedding array<double>")
    search.save_index(index, str(tmp_path / "index"))
    assert search.top_k(search.load_index(spark, str(tmp_path / "index")), [1.0, 0.1], 1).first()["pos"] == 1
    edges = spark.createDataFrame([("b", "x", "AMENDS", 0.5), ("a", "y", "CITES", 0.5)], "source_id string, target string, action_type string, confidence double")
    graph.save_edges(edges, str(tmp_path / "edges"))
    assert graph.outgoing(spark.read.parquet(str(tmp_path / "edges")), "a").count() == 1


def test_document_sink_keeps_xml_and_skips_what_is_stored(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [("ukpga_2020_1", "ukpga", b" \n<a/>"), ("uksi_2020_2", "uksi", b"<b/>"), ("ukpga_2020_3", "ukpga", b"Not found"), ("ukpga_2020_4", "ukpga", None), ("ukpga_2020_5", "ukpga", b"")]
    schema = "file string, type string, content binary"
    files.save_documents(spark.createDataFrame(rows, schema), path)
    files.save_documents(spark.createDataFrame([("ukpga_2020_1", "ukpga", b"<changed/>"), ("ukpga_2020_6", "ukpga", b"<new/>")], schema), path)
    files.save_effects(spark.createDataFrame(rows[:2], schema), path)
    got = sorted((r["file"], r["kind"], bytes(r["content"])) for r in files.stored_documents(spark, path).collect())
    assert got == [("ukpga_2020_1", "act", b" \n<a/>"), ("ukpga_2020_1_effects", "effects", b" \n<a/>"), ("ukpga_2020_6", "act", b"<new/>"), ("uksi_2020_2", "other", b"<b/>"), ("uksi_2020_2_effects", "effects", b"<b/>")]


def test_seeds_come_first(spark):
    found = spark.createDataFrame([(0, "/ukpga/2024/3", "found", "ukpga", 2024, 3), (1, "/ukpga/1999/9", "other", "ukpga", 1999, 9)], "seq long, uri string, title string, type string, year int, number int")
    reg = {r["uri"]: r["title"] for r in files.registry(files.seeds(spark), found).collect()}
    assert len(reg) == 22 and reg["/ukpga/2024/3"] == "Automated Vehicles Act 2024"
