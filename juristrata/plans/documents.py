"""Queries over XML files: files are put together from the driver's tables, parsed by the sources and compared with SQL
that derives the same chunks, triples and notes from the tables, without any XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristrata.operators import corpus, extract, graph
from juristrata.plans.registry import query
from juristrata.sources import files, xml

SPACE = "http://www.legislation.gov.uk/namespaces"


def _files(rows: DataFrame, file: str, content: str) -> DataFrame:
    """(file, content) by SQL expressions."""
    return rows.selectExpr(f"{file} AS file", f"encode({content}, 'UTF-8') AS content")


def _safe(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# Acts and instruments: one file a part. Every 11th is cut off, every 5th has no preliminaries, every 13th no schedule.

_ACT_FILE = "concat(CASE WHEN k % 4 = 3 THEN 'uksi' ELSE 'ukpga' END, '_', 2000 + k % 25, '_', k)"
_ACT = f"""concat('<Legislation xmlns="{SPACE}/legislation"><Primary>',
    CASE WHEN k % 5 <> 0 THEN concat('<PrimaryPrelims><Title>', p_name, '  Act ', 2000 + k % 25, '</Title>', CASE WHEN k % 3 <> 0 THEN concat('<Number>', 2001 + k % 25, ' CHAPTER ', k, '</Number>') ELSE '' END,
        '<DateOfEnactment><DateText>', CASE WHEN k % 4 = 0 THEN 'on some day' ELSE concat('[', 1 + k % 28, 'th January ', 2000 + k % 25, ']') END, '</DateText></DateOfEnactment></PrimaryPrelims>') ELSE '' END,
    '<Body>', CASE WHEN k % 2 = 0 THEN concat('<Part><Title>Part on ', p_name, '</Title>') ELSE concat('<Part><Title>Outer ', p_brand, '</Title><Pblock>') END,
    '<P1group RestrictExtent="E+W" RestrictStartDate="', CASE WHEN k % 7 = 0 THEN '' ELSE concat('2024-02-0', 1 + k % 9) END, '"><Title> Heading of <Emphasis>', p_brand, '</Emphasis> </Title>',
    '<P1 id="section-', k, '"><Pnumber>', p_size, '</Pnumber><P1para><Text>The Gadgets Act 1999 ("G', k, '") is called <Term>G', k, '</Term>; see <InternalLink>section ', p_size + 1, '</InternalLink> for more.</Text></P1para></P1></P1group>',
    CASE WHEN k % 2 = 0 THEN '</Part>' ELSE '</Pblock></Part>' END,
    '<P1 id="section-', k, 'A"><Text>No number of its own, ', p_type, '.</Text></P1><P1><Text>No number and no id at all.</Text></P1><P1 id="section-x"><Text>short</Text></P1></Body>',
    CASE WHEN k % 13 <> 0 THEN concat('<Schedules><Schedule RestrictExtent="S"><Number>SCHEDULE ', 1 + k % 3, '</Number><P1 id="schedule-', 1 + k % 3, '"><Pnumber>1</Pnumber><Text>First paragraph of ', p_brand,
        '.</Text><InlineAmendment>new words ', k, '</InlineAmendment></P1></Schedule></Schedules>') ELSE '' END, CASE WHEN k % 11 = 10 THEN '' ELSE '</Primary></Legislation>' END)"""


def _acts(i) -> DataFrame:
    return _files(i.dealt("part", "p_partkey").selectExpr("*", "p_partkey AS k"), _ACT_FILE, _ACT)


_ACT_ROWS = """d AS (SELECT p_partkey AS k, p_brand AS br, p_type AS ty, p_size::BIGINT AS sz, CASE WHEN k % 4 = 3 THEN 'uksi' ELSE 'ukpga' END || '_' || (2000 + k % 25)::VARCHAR || '_' || k::VARCHAR AS file,
      CASE WHEN k % 2 = 0 THEN 'Part on ' || p_name ELSE 'Outer ' || p_brand END AS above, CASE WHEN k % 5 <> 0 THEN p_name || '  Act ' || (2000 + k % 25)::VARCHAR ELSE above END AS doc_title,
      CASE WHEN k % 5 <> 0 AND k % 3 <> 0 THEN (2001 + k % 25)::VARCHAR WHEN k % 13 <> 0 THEN 'unknown' ELSE (2000 + k % 25)::VARCHAR END AS year,
      CASE WHEN k % 5 <> 0 AND k % 4 <> 0 THEN strftime(make_date(2000 + k % 25, 1, 1 + k % 28), '%Y-%m-%d') END AS enacted,
      sz::VARCHAR || ' The Gadgets Act 1999 ("G' || k::VARCHAR || '") is called G' || k::VARCHAR || ' ; see section ' || (sz + 1)::VARCHAR || ' for more.' AS main,
      'G' || k::VARCHAR || '=The Gadgets Act 1999' AS terms, 'SCHEDULE ' || (1 + k % 3)::VARCHAR AS sched FROM part WHERE k % 11 <> 10),
    r AS (SELECT d.*, 0 AS ord, sz::VARCHAR AS section, above AS part, 'Heading of ' || br AS heading, 'E+W' AS extent, CASE WHEN k % 7 = 0 THEN enacted ELSE '2024-02-0' || (1 + k % 9)::VARCHAR END AS force, 'section ' || (sz + 1)::VARCHAR AS refs, NULL AS amendments, 'Heading of ' || br || ' ' || main AS text FROM d
      UNION ALL SELECT d.*, 1, sz::VARCHAR, above, NULL, NULL, enacted, 'section ' || (sz + 1)::VARCHAR, NULL, main FROM d
      UNION ALL SELECT d.*, 2, k::VARCHAR || 'A', NULL, NULL, NULL, enacted, NULL, NULL, 'No number of its own, ' || ty || '.' FROM d
      UNION ALL SELECT d.*, 5, '1', NULL, NULL, NULL, enacted, NULL, 'new words ' || k::VARCHAR, '1 First paragraph of ' || br || '. new words ' || k::VARCHAR FROM d WHERE k % 13 <> 0
      UNION ALL SELECT d.*, 6, sched || '_1', sched, NULL, 'S', enacted, NULL, 'new words ' || k::VARCHAR, '1 First paragraph of ' || br || '. new words ' || k::VARCHAR FROM d WHERE k % 13 <> 0)"""
_ACT_CONTENT = "'ACT: ' || doc_title || ' (' || year || ') | SECTION: ' || section || CASE WHEN part IS NOT NULL AND ord < 6 THEN ' | PART: ' || part ELSE '' END || coalesce(' | HEADING: ' || heading, '') || ' | TEXT: ' || text"


@query(f"WITH {_ACT_ROWS} SELECT file, ord, file || '.xml_' || section AS id, doc_title, year, section, part, heading, extent, force AS in_force_date, refs, amendments, terms, {_ACT_CONTENT} AS content FROM r")
def xml_legislation(i):
    """Every provision of every file, with its title, year, part, heading, dates, links, amendments and terms."""
    rows = xml.legislation_chunks(_acts(i))
    flat = [F.array_join("internal_refs", "|").alias("refs"), F.array_join("inline_amendments", "|").alias("amendments")]
    terms = F.array_join(F.transform(F.map_entries("defined_terms"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("terms")
    return rows.select("file", "ord", "id", "doc_title", "year", "section", "part", "heading", "extent", "in_force_date", *flat, terms, "content")


@query(f"WITH {_ACT_ROWS} SELECT file, ord, file || '.xml_' || section AS id FROM r WHERE ord <> 5")
def xml_qualified_schedules(i):
    """The same chunks where provisions of schedules come up once, under the schedule's id."""
    return xml.legislation_chunks(_acts(i), qualify_schedule_ids=True).select("file", "ord", "id")


@query("""SELECT split_part(file, '_', 1) AS folder, count(*) AS files, count(*) FILTER (k % 11 = 10) AS broken, count(*) FILTER (k % 11 <> 10) AS valid FROM
    (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN 'uksi' ELSE 'ukpga' END AS file FROM part) GROUP BY 1""")
def xml_validity(i):
    return xml.validity(_acts(i), F.substring_index("file", "_", 1)).select("folder", "files", "broken", "valid")


@query("""SELECT CASE WHEN p_partkey % 4 = 3 THEN 'uksi' ELSE 'ukpga' END || '_' || (2000 + p_partkey % 25)::VARCHAR || '_' || p_partkey::VARCHAR AS file, true AS told FROM part WHERE p_partkey % 11 = 10""")
def xml_errors(i):
    return xml.parse_errors(_acts(i)).select("file", (F.length("error") > 0).alias("told"))


# Judgments: one file a conversation, a paragraph a turn. Every 9th has no paragraphs.

_CASE_FILE = "concat(element_at(array('uksc_', 'ewca_civ_', 'ewhc_', 'other_'), cast(conv_id % 4 + 1 AS int)), 2000 + conv_id % 25, '_', conv_id)"
_CASE_NAME = """CASE conv_id % 5 WHEN 0 THEN concat('<dc:title>Case ', conv_id, '</dc:title>') WHEN 1 THEN concat('<FRBRname value="A v ', conv_id, '"/>') WHEN 2 THEN concat('<FRBRname> Re ', conv_id, ' </FRBRname>') ELSE '' END"""
_CASE = f"""concat('<akomaNtoso xmlns:dc="http://purl.org/dc/elements/1.1/"><meta>', {_CASE_NAME}, '</meta>', array_join(transform(turns, t -> t.x), ' '), '</akomaNtoso>')"""
_TURN = f"""CASE WHEN conv_id % 9 = 0 THEN concat('<p>', {_safe("text")}, '</p>')
    ELSE concat('<paragraph', CASE turn % 3 WHEN 0 THEN concat(' Number="N', turn, '"') WHEN 1 THEN concat(' eId="para_', turn, '"') ELSE '' END, '><b>', turn, '</b> <p>', {_safe("text")}, '</p></paragraph>') END"""


def _cases(i) -> DataFrame:
    turns = i.table("conversations").selectExpr("conv_id", "turn", f"{_TURN} AS x")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "x"))).alias("turns"))
    return _files(whole, _CASE_FILE, _CASE)


_CASE_ROWS = r"""c AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
      list_value('uksc_', 'ewca_civ_', 'ewhc_', 'other_')[conv_id % 4 + 1] || (2000 + conv_id % 25)::VARCHAR || '_' || conv_id::VARCHAR AS file, (2000 + conv_id % 25)::VARCHAR AS year,
      CASE conv_id % 5 WHEN 0 THEN 'Case ' || conv_id::VARCHAR WHEN 1 THEN 'A v ' || conv_id::VARCHAR WHEN 2 THEN 'Re ' || conv_id::VARCHAR END AS name, coalesce(name, file) AS doc_title,
      list_value('Supreme Court', 'Court of Appeal', 'High Court', 'Unknown')[conv_id % 4 + 1] AS court_level FROM conversations),
    j AS (SELECT conv_id, file, doc_title, year, court_level, place - 1 AS ord, CASE turn % 3 WHEN 0 THEN 'N' || turn::VARCHAR WHEN 1 THEN 'para_' || turn::VARCHAR ELSE place::VARCHAR END AS section, turn::VARCHAR || coalesce(' ' || nullif(text, ''), '') AS text FROM c WHERE conv_id % 9 <> 0 AND length(turn::VARCHAR || coalesce(' ' || nullif(text, ''), '')) >= 30
      UNION ALL SELECT * FROM (SELECT conv_id, file, doc_title, year, court_level, 0, 'full', concat_ws(' ', CASE WHEN conv_id % 5 IN (0, 2) THEN name END, string_agg(nullif(text, ''), ' ' ORDER BY turn)) AS text FROM c WHERE conv_id % 9 = 0 GROUP BY conv_id, file, name, doc_title, year, court_level) WHERE length(text) > 50)"""


@query(f"""WITH {_CASE_ROWS} SELECT file, ord, file || '.xml_' || section AS id, doc_title, year, section, court_level,
    'CASE: ' || doc_title || ' (' || year || ') | COURT: ' || court_level || CASE WHEN section <> 'full' THEN ' | PARA: ' || section ELSE '' END || ' | TEXT: ' || text AS content FROM j""")
def xml_judgments(i):
    """Every paragraph of every judgment, or its whole text, with name, year, court and number."""
    return xml.judgment_chunks(_cases(i)).select("file", "ord", "id", "doc_title", "year", "section", "court_level", "content")


@query(f"""WITH {_ACT_ROWS}, {_CASE_ROWS}, u AS (SELECT starts_with(file, 'uksi')::INT AS rank, file, ord, file || '.xml_' || section AS id, 'legislation' AS source FROM r UNION ALL SELECT 2, file, ord, file || '.xml_' || section, 'judgment' FROM j)
    SELECT row_number() OVER (ORDER BY rank, file, ord) - 1 AS seq, id, source FROM u""")
def corpus_union(i):
    """Acts, then instruments, then judgments, numbered in one order."""
    # Files are told apart before they are parsed, so each is parsed once.
    laws = [xml.legislation_chunks(_acts(i).where(f"file LIKE '{kind}%'")) for kind in ("ukpga", "uksi")]
    return corpus.union_sources(*(s.select("file", "ord", "id", "source") for s in (*laws, xml.judgment_chunks(_cases(i))))).select("seq", "id", "source")


@query(f"""WITH {_CASE_ROWS} SELECT file || '.xml_' || section AS id, length(text) AS length FROM j WHERE length(text) >= 50""")
def xml_processable(i):
    """Judgment chunks of at least 50 characters of their own."""
    rows = extract.processable(xml.judgment_chunks(_cases(i)))
    return rows.select("id", F.length(F.substring_index("content", "| TEXT: ", -1)).alias("length"))


# Change feeds: twenty effects a file.

_KIND = "CASE event_type WHEN 'click' THEN 'Coming into force' WHEN 'view' THEN 'words inserted (temp.)' WHEN 'purchase' THEN ' Repealed ' WHEN 'signup' THEN 'unheard of' ELSE 'text amended' END"
_EFFECT = f"""concat('<ukm:Effect Type="', {_KIND}, '"', CASE WHEN event_id % 4 > 0 THEN concat(' AffectedProvisions="s. ', event_id % 50, '"') ELSE '' END, CASE WHEN event_id % 3 > 0 THEN concat(' AffectingProvisions="reg. ', event_id % 9, '"') ELSE '' END, '><ukm:AffectedTitle>X Act ',
    1990 + user_id % 30, '</ukm:AffectedTitle>', CASE WHEN event_id % 7 > 0 THEN concat('<ukm:AffectingTitle>Y Order ', 2000 + user_id % 20, '</ukm:AffectingTitle>') ELSE '' END,
    CASE WHEN event_id % 3 = 1 THEN concat('<ukm:InForceDates><ukm:InForce Date="', date_format(ts, 'yyyy-MM-dd'), '"/><ukm:InForce Date="2030-01-01"/></ukm:InForceDates>') ELSE '' END, '</ukm:Effect>')"""


@query("""WITH e AS (SELECT event_id, event_id // 20 AS page, CASE event_type WHEN 'click' THEN 'Coming into force' WHEN 'view' THEN 'words inserted (temp.)' WHEN 'purchase' THEN ' Repealed ' ELSE 'text amended' END AS kind,
      CASE event_type WHEN 'click' THEN 'COMMENCES' WHEN 'view' THEN 'INSERTS' WHEN 'purchase' THEN 'REPEALS' ELSE 'AMENDS' END AS action, 'X Act ' || (1990 + user_id % 30)::VARCHAR AS affected, 'Y Order ' || (2000 + user_id % 20)::VARCHAR AS affecting,
      CASE WHEN event_id % 4 > 0 THEN 's. ' || (event_id % 50)::VARCHAR END AS spot, CASE WHEN event_id % 3 > 0 THEN 'reg. ' || (event_id % 9)::VARCHAR END AS by_at, CASE WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') END AS date
      FROM events WHERE event_type <> 'signup' AND event_id % 7 > 0)
    SELECT 'feed_' || page::VARCHAR AS file, event_id % 20 AS ord, 'effects_' || affecting AS source_id, affecting AS source_title, coalesce(by_at, '') AS source_section, action, concat_ws(' ', affected, spot) AS target_citation, affected AS target_act_name,
      kind || ' by ' || concat_ws(' ', affecting, by_at) AS detail_text, date AS effective_date, 1.0::DOUBLE AS confidence, 'effects_api' AS provenance FROM e""")
def xml_effects(i):
    """Ground-truth triples of change feeds."""
    effects = i.table("events").selectExpr("event_id DIV 20 AS page", "event_id", f"{_EFFECT} AS x")
    pages = effects.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("event_id", "x"))).alias("all"))
    return xml.effect_triples(_files(pages, "concat('feed_', page)", f"""concat('<feed xmlns:ukm="{SPACE}/metadata">', array_join(transform(all, e -> e.x), ' '), '</feed>')"""))


# Explanatory notes: one file a labelled document.

_NOTE = f"""concat('<N xmlns="{SPACE}/legislation"><Comment Type="section-', doc_id % 10, '">First words on section ', doc_id % 10, '.</Comment><Comment Type="section-', doc_id % 10, '">Later <i>words</i> on section ', doc_id % 10, '.</Comment>',
    '<Comment Type="section-99">short</Comment><Commentary id="c', quality, '">A commentary on quality ', quality, '.</Commentary><Block id="section-', doc_id % 10, '"><P>An added paragraph that is long enough.</P><P>short</P></Block>',
    '<Block about="c2"><P>Another paragraph, number ', doc_id, ', under its own key.</P></Block><Block><P>A paragraph whose parent has no key at all.</P></Block></N>')"""


@query("""SELECT 'doc' || doc_id::VARCHAR AS prefix, 0 AS note_ord, 'section-' || (doc_id % 10)::VARCHAR AS note_key, 'Later words on section ' || (doc_id % 10)::VARCHAR || '. An added paragraph that is long enough.' AS note_text FROM labels
    UNION ALL SELECT 'doc' || doc_id::VARCHAR, 2, 'c' || quality::VARCHAR, 'A commentary on quality ' || quality::VARCHAR || '.' FROM labels
    UNION ALL SELECT 'doc' || doc_id::VARCHAR, 4, 'c2', 'Another paragraph, number ' || doc_id::VARCHAR || ', under its own key.' FROM labels""")
def xml_notes(i):
    return xml.notes(_files(i.dealt("labels", "doc_id"), "concat('doc', doc_id, '_notes')", _NOTE))


# Discovery feeds: ten entries a page, eight pages a feed.

_ENTRY = """concat('<entry><id>http://h', CASE WHEN p_partkey % 9 = 4 THEN '/id/' ELSE '/' END, CASE WHEN p_partkey % 4 = 3 THEN 'uksi' ELSE 'ukpga' END, '/', 2000 + p_partkey % 25, '/', p_partkey, '</id><title>', p_name, '</title></entry>')"""
_NEXT = """CASE WHEN page % 8 < 7 THEN concat('<link rel="next" href="http://h/', page + 1, '/"/>') ELSE '<link rel="self" href="x"/>' END"""


def _pages(i) -> DataFrame:
    entries = i.table("part").selectExpr("p_partkey DIV 10 AS page", "p_partkey", f"{_ENTRY} AS x")
    pages = entries.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "x"))).alias("all"))
    return _files(pages, "cast(page AS string)", f"""concat('<feed xmlns="http://www.w3.org/2005/Atom">', {_NEXT}, array_join(transform(all, e -> e.x), ''), '</feed>')""")


@query("""SELECT (p_partkey // 10)::VARCHAR AS file, p_partkey % 10 AS ord, CASE WHEN p_partkey // 10 % 8 < 7 THEN 'http://h/' || (p_partkey // 10 + 1)::VARCHAR || '/data.feed' END AS "next",
    '/' || type || '/' || year::VARCHAR || '/' || p_partkey::VARCHAR AS uri, p_name AS title, type, year, p_partkey::INT AS number FROM (SELECT *, CASE WHEN p_partkey % 4 = 3 THEN 'uksi' ELSE 'ukpga' END AS type, (2000 + p_partkey % 25)::INT AS year FROM part) WHERE p_partkey % 9 <> 4""")
def xml_feed(i):
    return xml.feed_entries(_pages(i))


@query("""SELECT (n // 8 * 8)::VARCHAR AS feed, 'http://h/' || n::VARCHAR || '/data.feed' AS page, n % 8 AS step FROM (SELECT DISTINCT p_partkey // 10 AS n FROM part) WHERE n % 8 < 5""")
def xml_feed_pages(i):
    """Pages of each feed that a walk of at most five pages sees."""
    links = xml.page_links(_pages(i)).select(F.concat(F.lit("http://h/"), "file", F.lit("/data.feed")).alias("page"), "next")
    number = F.regexp_extract("page", r"(\d+)/data", 1).cast("long")
    starts = links.where(number % 8 == 0).select(number.cast("string").alias("feed"), "page")
    return files.follow(links, starts, 5).select("feed", "page", F.col("step").cast("long").alias("step"))


# What the graph already says about the acts that a chunk names

_CITED = r"'([A-Z][A-Za-z\s\(\)]+(?:Act|Order|Regulations?)\s+\d{4})'"


@query(rf"""WITH g AS (SELECT 'ukpga_' || (user_id % 12)::VARCHAR AS source_id, 'Housing Act ' || (1980 + user_id % 12)::VARCHAR AS source_title, CASE WHEN event_id % 2 = 0 THEN 'AMENDS' ELSE 'CITES' END AS action_type,
      'The Rent Act ' || (1970 + user_id % 9)::VARCHAR || ' s.' || (event_id % 40)::VARCHAR AS target, CASE WHEN event_id % 40 = 3 THEN 'detail of three' END AS detail FROM events),
    e AS (SELECT DISTINCT source_id, source_title, action_type, target, detail, '[' || action_type || '] ' || source_id || ' -> ' || target || coalesce(' | ' || detail, '') AS line FROM g),
    c AS (SELECT o_orderkey AS id, list_value('Rent Act ' || (1970 + o_custkey % 11)::VARCHAR, 'Housing Act ' || (1980 + o_orderkey % 14)::VARCHAR, 'Rent Act ' || (1970 + o_orderkey % 7)::VARCHAR) AS names FROM orders),
    n AS (SELECT id, name, min(p) AS p FROM (SELECT id, unnest(names) AS name, generate_subscripts(names, 1) AS p FROM c) GROUP BY ALL),
    u AS (SELECT name, source_id, action_type, target, line, row_number() OVER (PARTITION BY name ORDER BY source_id, action_type, target, line) AS k FROM (SELECT DISTINCT name FROM n) JOIN e ON contains(e.source_title, name) OR contains(e.target, name)),
    h AS (SELECT id, line, min(p * 100 + k) AS place FROM n JOIN u USING (name) WHERE k <= 15 GROUP BY ALL)
    SELECT id, string_agg(line, chr(10) ORDER BY place) AS context FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) <= 15) GROUP BY id""")
def chunk_context(i):
    """For every chunk the lines of up to 15 edges, of the first five acts that it names."""
    edges = i.table("events").selectExpr(
        "concat('ukpga_', user_id % 12) AS source_id", "concat('Housing Act ', 1980 + user_id % 12) AS source_title", "CASE WHEN event_id % 2 = 0 THEN 'AMENDS' ELSE 'CITES' END AS action_type",
        "concat('The Rent Act ', 1970 + user_id % 9, ' s.', event_id % 40) AS target", "CASE WHEN event_id % 40 = 3 THEN 'detail of three' END AS detail").distinct()
    chunks = i.table("orders").selectExpr("o_orderkey AS id", "concat('Under Rent Act ', 1970 + o_custkey % 11, ', and 7 Housing Act ', 1980 + o_orderkey % 14, ', 8 Rent Act ', 1970 + o_orderkey % 7, '.') AS content", "cast(NULL AS string) AS doc_title")
    chunks = chunks.withColumn("content", F.replace("content", F.lit("Under "), F.lit("1. ")))
    return graph.chunk_context(chunks, edges)
