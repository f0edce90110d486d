"""XML sources on small documents of the same shapes."""

import pytest
from pyspark.sql import functions as F

from juristrata.operators import corpus
from juristrata.plans.catalog import QUERIES
from juristrata.sources import xml

LEG = 'xmlns="http://www.legislation.gov.uk/namespaces/legislation" xmlns:ukm="http://www.legislation.gov.uk/namespaces/metadata"'
ACT = f"""<Legislation {LEG}><ukm:Metadata><ukm:Number Value="2"/></ukm:Metadata><Primary>
<PrimaryPrelims><Title>Widgets  Act 2024</Title><Number>2024 CHAPTER 2</Number><DateOfEnactment><DateText>[25th January 2024]</DateText></DateOfEnactment></PrimaryPrelims>
<Body><Part><Title>General</Title><Pblock><P1group RestrictExtent="E+W" RestrictStartDate="2024-02-01"><Title>Meaning</Title>
<P1 id="section-1"><Pnumber>1</Pnumber><P1para><Text>In the Gadgets Act 1999 ("<Term>the 1999 Act</Term>") see <InternalLink>section 2</InternalLink> for more.</Text></P1para></P1></P1group></Pblock></Part>
<P1 id="section-9"><Text>short</Text></P1><P1 id="section-3"><Text>A provision without number of its own.</Text></P1></Body>
<Schedules><Schedule RestrictExtent="S"><Number>SCHEDULE 1</Number><P1><Pnumber>1</Pnumber><Text>First paragraph of the schedule.</Text><InlineAmendment>new words</InlineAmendment></P1></Schedule></Schedules></Primary></Legislation>"""
CASE = """<akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><judgment><meta><FRBRname value="A v B"/></meta>
<paragraph><p>Too short.</p></paragraph><paragraph eId="para_x"><p>This paragraph is certainly long enough.</p></paragraph><paragraph><p>And this one is long enough as well, numbered by place.</p></paragraph></judgment></akomaNtoso>"""
EFFECTS = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:ukm="http://www.legislation.gov.uk/namespaces/metadata"><entry><content>
<ukm:Effect Type="coming into force" AffectedProvisions="s. 1" AffectingProvisions="reg. 2"><ukm:AffectedTitle>X Act 2022</ukm:AffectedTitle><ukm:AffectingTitle>Y Order 2023</ukm:AffectingTitle><ukm:InForceDates><ukm:InForce Date="2023-04-01"/><ukm:InForce Date="2024-04-01"/></ukm:InForceDates></ukm:Effect>
<ukm:Effect Type="omitted"><ukm:AffectedTitle>X Act 2022</ukm:AffectedTitle><ukm:AffectingTitle>Y</ukm:AffectingTitle></ukm:Effect>
<ukm:Effect Type="revoked"><ukm:AffectedTitle>X Act 2022</ukm:AffectedTitle></ukm:Effect></content></entry></feed>"""
NOTES = f"""<N {LEG}><Comment Type="section-12">An explanation of section twelve.</Comment><Comment Type="section-12">A later explanation of section twelve.</Comment>
<Block id="section-12"><P>An added paragraph that is long enough to count.</P></Block><Commentary id="c1">short</Commentary></N>"""
FEED = """<feed xmlns="http://www.w3.org/2005/Atom"><link rel="next" href="http://h/ukpga/2020?page=2"/><entry><id>http://h/ukpga/2020/1</id><title>One</title></entry><entry><id>http://h/id/other</id><title>No</title></entry></feed>"""


@pytest.fixture
def folder(tmp_path):
    def write(**named):
        for name, content in named.items():
            (tmp_path / f"{name}.xml").write_text(content, encoding="utf-8")
        return str(tmp_path)

    return write


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("file", "ord").select(*columns).collect()]


def test_legislation(spark, folder):
    files = xml.read_files(spark, folder(ukpga_2024_2=ACT))
    chunks = xml.legislation_chunks(files)
    assert rows(chunks, "id", "heading", "part", "extent", "in_force_date") == [
        ("ukpga_2024_2.xml_1", "Meaning", "General", "E+W", "2024-02-01"), ("ukpga_2024_2.xml_1", None, "General", None, "2024-01-25"), ("ukpga_2024_2.xml_3", None, None, None, "2024-01-25"),
        ("ukpga_2024_2.xml_1", None, None, None, "2024-01-25"), ("ukpga_2024_2.xml_SCHEDULE 1_1", None, "SCHEDULE 1", "S", "2024-01-25"),
    ]
    first = chunks.orderBy("ord").first()
    assert (first["doc_title"], first["year"], first["internal_refs"], first["inline_amendments"], first["defined_terms"]) == ("Widgets  Act 2024", "2024", ["section 2"], None, None)
    assert first["content"].startswith("ACT: Widgets  Act 2024 (2024) | SECTION: 1 | PART: General | HEADING: Meaning | TEXT: Meaning 1 In the Gadgets")
    qualified = xml.legislation_chunks(files, qualify_schedule_ids=True)
    assert qualified.count() == 4 and qualified.where("id = 'ukpga_2024_2.xml_1'").count() == 2


def test_terms_need_their_definition_in_the_parent(spark, folder):
    text = ACT.replace("<Term>the 1999 Act</Term>\")", "<Term>the 1999 Act</Term>\")").replace('Act 1999 ("<Term>', 'Act 1999 ("<Term>')
    doc = xml.Doc(text.encode())
    # The joined text has a space after the quote, so the pattern does not match.
    assert xml._terms(doc) == {}


def test_judgment(spark, folder):
    files = xml.read_files(spark, folder(ewhc_admin_2022_3=CASE, uksc_2020_1="<j><p>" + "word " * 20 + "</p></j>"))
    got = rows(xml.judgment_chunks(files), "id", "doc_title", "year", "court_level")
    assert got == [("ewhc_admin_2022_3.xml_para_x", "A v B", "2022", "High Court"), ("ewhc_admin_2022_3.xml_3", "A v B", "2022", "High Court"), ("uksc_2020_1.xml_full", "uksc_2020_1", "2020", "Supreme Court")]


def test_effects(spark, folder):
    got = xml.effect_triples(xml.read_files(spark, folder(e=EFFECTS))).collect()
    assert [(r["source_id"], r["action"], r["target_citation"], r["effective_date"], r["detail_text"]) for r in got] == [("effects_Y Order 2023", "COMMENCES", "X Act 2022 s. 1", "2023-04-01", "coming into force by Y Order 2023 reg. 2")]


def test_notes_and_their_chunks(spark, folder):
    found = xml.notes(xml.read_files(spark, folder(d_notes=NOTES)))
    assert [tuple(r) for r in found.collect()] == [("d", 0, "section-12", "A later explanation of section twelve. An added paragraph that is long enough to count.")]
    chunks = spark.createDataFrame([(1, "d.xml_1", "1"), (2, "d.xml_7", "7"), (3, "e.xml_1", "1")], "seq long, id string, section string")
    assert {r["seq"]: (r["notes_text"] or "")[:7] for r in corpus.attach_notes(chunks, found).collect()} == {1: "A later", 2: "", 3: ""}


def test_feed(spark, folder):
    got = xml.feed_entries(xml.read_files(spark, folder(page=FEED))).collect()
    assert [(r["uri"], r["type"], r["year"], r["number"], r["next"]) for r in got] == [("/ukpga/2020/1", "ukpga", 2020, 1, "http://h/ukpga/2020?page=2/data.feed")]


def test_broken_and_missing_files(spark, folder):
    path = folder(bad="<a><b></a>", good=ACT)
    files = xml.read_files(spark, path)
    assert [r["file"] for r in xml.parse_errors(files).collect()] == ["bad"]
    assert xml.legislation_chunks(files).select("file").distinct().count() == 1
    assert xml.read_files(spark, path + "/none").count() == 0


def test_union_numbers_sources_in_order(spark, folder):
    path = folder(ukpga_2024_2=ACT, ewhc_1=CASE)
    files = xml.read_files(spark, path)
    laws = xml.legislation_chunks(files.where("file LIKE 'ukpga%'"))
    cases = xml.judgment_chunks(files.where("file LIKE 'ewhc%'"))
    got = corpus.union_sources(laws.repartition(3), cases).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(7)) and [r["source"] for r in got] == ["legislation"] * 5 + ["judgment"] * 2


def test_first_corpus(spark, folder):
    files = xml.read_files(spark, folder(ukpga_2024_2=ACT, ewhc_1=CASE))
    got = {r["id"]: r["content"][:15] for r in xml.first_corpus(files).collect()}
    assert got["ukpga_2024_2.xml_s1"] == "In the Gadgets " and "ewhc_1.xml_s2" in got and "ewhc_1.xml_s1" not in got


def test_odd_encodings_are_error_rows(spark):
    contents = [("a", '<?xml version="1.0" encoding="shift_jis"?><a/>'.encode()), ("b", '<?xml version="1.0" encoding="no-such"?><a/>'.encode()), ("c", b"<a/>")]
    got = {r["file"] for r in xml.parse_errors(spark.createDataFrame(contents, "file string, content binary")).collect()}
    assert got == {"a", "b"}


def test_files_of_one_table_file_go_to_all_tasks(spark, tmp_path):
    spark.createDataFrame([(k, "n", "b", "t", k) for k in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("xml_legislation", "xml_qualified_schedules", "xml_errors"):
        parts = QUERIES[name](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count()
        assert parts > 1, name


def test_qualified_schedules_take_one_parse_and_no_join(spark, folder):
    nested = ACT.replace('<P1 id="section-3"><Text>A provision without number of its own.', '<P1 id="section-3"><Text>1 First paragraph of the schedule. new words')
    files = xml.read_files(spark, folder(ukpga_2024_2=nested, ukpga_2024_3=ACT))
    chunks = xml.legislation_chunks(files, qualify_schedule_ids=True)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan
    # A text of a schedule drops every provision of its own file that has it, and none of another file.
    got = [(r["file"], r["id"].split("_")[-1], r["part"]) for r in chunks.orderBy("file", "ord").collect()]
    assert got == [(f, *row) for f, rest in (("ukpga_2024_2", []), ("ukpga_2024_3", [("3", None)])) for row in [("1", "General"), ("1", "General"), *rest, ("1", "SCHEDULE 1")]]
