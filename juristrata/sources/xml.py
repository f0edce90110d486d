"""Chunks, change effects, notes and feed entries from XML files.

Python walks the trees (recursive mixed text has no SQL form) and yields plain fields; ids, dates, titles and contents
are put together from them by DataFrame expressions. A file is parsed whole, in one pass with one parent map.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juristrata.functions.lexicon import COURTS
from juristrata.functions.text import blank_to_null, effect_action, strip, uri_parts, uri_path


# Namespaces whose names are told apart from those of the documents themselves.
PREFIXES = {"http://www.legislation.gov.uk/namespaces/metadata": "ukm:", "http://purl.org/dc/elements/1.1/": "dc:"}


@lru_cache(4096)
def _plain(tag: str) -> str:
    space, _, name = tag.rpartition("}")
    return PREFIXES.get(space.lstrip("{"), "") + name


def local(node: ET.Element) -> str:
    """A node's name without its namespace, but with a prefix for metadata."""
    return _plain(node.tag) if isinstance(node.tag, str) else ""


class Doc:
    """A parsed file with its parents and the text of each node."""

    def __init__(self, content: bytes):
        self.root = ET.fromstring(content)
        self.parent = {child: node for node in self.root.iter() for child in node}

    @staticmethod
    def text(node: ET.Element | None) -> str:
        """All text below a node: each piece stripped, blanks dropped, joined by one space."""
        if node is None:
            return ""
        pieces = (p.strip() for p in node.itertext())
        return " ".join(p for p in pieces if p)

    def all(self, *names: str, below: ET.Element | None = None) -> Iterator[ET.Element]:
        return (n for n in (self.root if below is None else below).iter() if local(n) in names)

    def first(self, name: str, below: ET.Element | None = None) -> ET.Element | None:
        start = self.root if below is None else below
        return next((n for n in self.all(name, below=start) if n is not start), None)

    def child(self, node: ET.Element, name: str) -> ET.Element | None:
        return next((n for n in node if local(n) == name), None)

    def up(self, node: ET.Element | None) -> Iterator[ET.Element]:
        while node is not None:
            yield node
            node = self.parent.get(node)


# Fixed value: how an act's full name precedes its defined term.
DEFINITION = re.compile(r"(?:the\s+)?([A-Z][A-Za-z\s,()]+?Act\s+\d{4})\s*\(\s*[\"“]")


def _terms(doc: Doc) -> dict[str, str]:
    found = {}
    for term in doc.all("Term"):
        name, around = doc.text(term), doc.text(doc.parent.get(term))
        full = next((m[1] for m in DEFINITION.finditer(around) if around.startswith(name, m.end())), None) if name else None
        if full is not None:
            found[name] = full.strip()
    return found


def _provision(doc: Doc, node: ET.Element) -> dict:
    number = doc.first("Pnumber", node)
    titled = (doc.child(n, "Title") for n in doc.up(node) if local(n) in ("Pblock", "Part"))
    part = next((t for t in titled if t is not None), None)
    title = doc.child(node, "Title")
    return {
        "number": doc.text(number), "node_id": node.get("id", ""), "heading": doc.text(title) if title is not None else None,
        "part": doc.text(part) if part is not None else None, "extent": node.get("RestrictExtent"), "restrict_date": node.get("RestrictStartDate"),
        "internal_refs": [t for n in doc.all("InternalLink", below=node) if (t := doc.text(n))],
        "inline_amendments": [t for n in doc.all("InlineAmendment", below=node) if (t := doc.text(n))], "text": doc.text(node),
    }


def legislation_rows(doc: Doc) -> Iterator[dict]:
    """Provisions in document order, then the provisions of schedules once more; again marks provisions whose text comes
    up once more."""
    prelims = next((t for p in doc.all("PrimaryPrelims") if (t := doc.child(p, "Title")) is not None), None)
    title = prelims if prelims is not None else doc.first("Title")
    number, enacted = doc.first("Number"), next((t for d in doc.all("DateOfEnactment") if (t := doc.child(d, "DateText")) is not None), None)
    shared = {"title": doc.text(title) if title is not None else None, "number_text": doc.text(number) if number is not None else None, "enacted": doc.text(enacted), "terms": _terms(doc)}
    schedules = [(s, n, _provision(doc, n)) for s in doc.all("Schedule") for n in doc.all("P1", below=s)]
    twice = {row["text"] for *_, row in schedules}
    for node in doc.all("P1", "P1group"):
        row = _provision(doc, node)
        yield shared | {"kind": "provision", "again": row["text"] in twice} | row
    for schedule, group in groupby(schedules, lambda s: s[0]):
        number = doc.child(schedule, "Number")
        name = doc.text(number) if number is not None else "SCHEDULE"
        for _, node, row in group:
            row |= {"heading": None, "part": name, "extent": node.get("RestrictExtent", schedule.get("RestrictExtent")), "restrict_date": node.get("RestrictStartDate", schedule.get("RestrictStartDate"))}
            yield shared | {"kind": "schedule", "again": False} | row


LEGISLATION = (
    "title string, number_text string, enacted string, terms map<string,string>, kind string, again boolean, number string, node_id string, heading string,"
    " part string, extent string, restrict_date string, internal_refs array<string>, inline_amendments array<string>, text string"
)


def judgment_rows(doc: Doc) -> Iterator[dict]:
    """Paragraphs with their positions, or the whole text if there are none."""
    named = doc.first("dc:title")
    alias = doc.first("FRBRname")
    name = doc.text(named) or (alias.get("value") or doc.text(alias) if alias is not None else "")
    paragraphs = list(doc.all("paragraph")) or list(doc.all("Paragraph"))
    for place, node in enumerate(paragraphs, 1):
        yield {"name": name, "kind": "paragraph", "label": node.get("Number", node.get("eId", str(place))), "text": doc.text(node)}
    if not paragraphs:
        yield {"name": name, "kind": "full", "label": "full", "text": doc.text(doc.root)}


JUDGMENT = "name string, kind string, label string, text string"


def effect_rows(doc: Doc) -> Iterator[dict]:
    for node in doc.all("ukm:Effect"):
        dates = doc.child(node, "ukm:InForceDates")
        force = doc.child(dates, "ukm:InForce") if dates is not None else None
        yield {
            "type": node.get("Type", ""), "affected": doc.text(doc.child(node, "ukm:AffectedTitle")), "affecting": doc.text(doc.child(node, "ukm:AffectingTitle")),
            "affected_at": node.get("AffectedProvisions", ""), "affecting_at": node.get("AffectingProvisions", ""), "date": force.get("Date") if force is not None else None,
        }


EFFECT = "type string, affected string, affecting string, affected_at string, affecting_at string, date string"


def note_rows(doc: Doc) -> Iterator[dict]:
    """Comments and commentaries replace a key's text (mode set), paragraphs are added to their parent's (mode add)."""
    for name, key in (("Comment", "Type"), ("Commentary", "id")):
        for node in doc.all(name):
            if len(text := doc.text(node)) > 20:
                yield {"mode": "set", "key": node.get(key, ""), "text": text}
    for node in doc.all("P"):
        above = doc.parent.get(node)
        if len(text := doc.text(node)) > 30 and above is not None and (key := above.get("id") or above.get("about")):
            yield {"mode": "add", "key": key, "text": text}


NOTE = "mode string, key string, text string"


def entry_rows(doc: Doc) -> Iterator[dict]:
    """Entries of a discovery feed page, each with the page's next link."""
    link = next((n.get("href") for n in doc.all("link") if n.get("rel") == "next"), None)
    if link and "data.feed" not in link:
        link = link.rstrip("/") + "/data.feed"
    entries = [(doc.text(doc.child(e, "id")), doc.text(doc.child(e, "title"))) for e in doc.all("entry")]
    for uri, title in entries or [(None, None)]:
        yield {"next": link, "uri": uri, "title": title}


ENTRY = "next string, uri string, title string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, content) of the XML files of a folder; a missing folder gives no rows."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not glob.getFileSystem(spark._jsc.hadoopConfiguration()).exists(glob):
        return spark.createDataFrame([], "path string, file string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return files.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.xml$", "").alias("file"), "content")


def parse(files: DataFrame, rows: Callable[[Doc], Iterator[dict]], schema: str) -> DataFrame:
    """Fields of each file's rows, with file, ord (from 0) and error (null, or why the file gave no rows)."""
    names = ["file", "ord", "error", *(f.strip().split()[0] for f in re.sub(r"<[^>]*>", "", schema).split(","))]

    blank = dict.fromkeys(names)

    def run(frames):
        for frame in frames:
            out = []
            for file, content in zip(frame["file"], frame["content"], strict=True):
                try:
                    out += [blank | {"file": file, "ord": i} | row for i, row in enumerate(rows(Doc(bytes(content))))]
                except (ET.ParseError, ValueError, LookupError) as e:  # the last two for encodings that the parser lacks
                    out.append(blank | {"file": file, "ord": -1, "error": str(e)})
                if len(out) >= 1000:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
            yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("file", "content").mapInPandas(run, f"file string, ord bigint, error string, {schema}")


def parse_errors(files: DataFrame) -> DataFrame:
    """(file, error) of files that are no XML."""
    return parse(files, lambda doc: iter(()), "none string").where("error IS NOT NULL").select("file", "error")


def _year(text: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(text, r"(?U)(\d{4})", 1)), F.lit("unknown"))


def enactment_date(text: Column) -> Column:
    """The date of a phrase such as '[25th January 2024]', as an ISO string."""
    shape = r"(\d{1,2})\w*\s+(\w+)\s+(\d{4})"
    part = lambda i: F.regexp_extract(text, shape, i)
    return F.date_format(F.try_to_date(F.concat_ws(" ", part(1), part(2), part(3)), "d MMMM yyyy"), "yyyy-MM-dd")


def legislation_chunks(files: DataFrame, qualify_schedule_ids: bool = False) -> DataFrame:
    """One chunk for each provision of at least 20 characters, before numbering. With qualify_schedule_ids, provisions
    inside schedules no longer share ids with sections."""
    raw = parse(files, legislation_rows, LEGISLATION).where("error IS NULL")
    title, year = F.coalesce("title", "file"), _year(F.coalesce("number_text", "file"))
    plain = F.replace(F.replace("node_id", F.lit("section-"), F.lit("")), F.lit("schedule-"), F.lit("SCHEDULE "))
    inside = F.concat("part", F.when(F.col("number") != "", F.concat(F.lit("_"), F.col("number"))).otherwise(F.lit("")))
    section = F.when(F.col("kind") == "schedule", inside).otherwise(F.coalesce(blank_to_null(F.col("number")), blank_to_null(plain)))
    chunks = raw.withColumns({"doc_title": title, "year": year, "section": section}).where("section IS NOT NULL AND length(text) >= 20")
    if qualify_schedule_ids:
        chunks = chunks.where("NOT again")
    optional = lambda name, label: F.when((F.coalesce(name, F.lit("")) != "") & (F.col("kind") == "provision"), F.concat(F.lit(f"{label}: "), F.col(name)))
    content = F.concat_ws(" | ", F.format_string("ACT: %s (%s)", "doc_title", "year"), F.concat(F.lit("SECTION: "), F.col("section")), optional("part", "PART"), optional("heading", "HEADING"), F.concat(F.lit("TEXT: "), F.col("text")))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return chunks.select(
        "file", "ord", F.concat("file", F.lit(".xml_"), "section").alias("id"), F.lit("legislation").alias("source"), "doc_title", "year", "section", "part", "heading", "extent",
        F.coalesce(blank_to_null(F.col("restrict_date")), enactment_date(F.col("enacted"))).alias("in_force_date"), F.lit(None).cast("string").alias("court_level"),
        some("internal_refs").alias("internal_refs"), some("inline_amendments").alias("inline_amendments"), some("terms").alias("defined_terms"), content.alias("content"),
    )


def first_corpus_rows(doc: Doc) -> Iterator[dict]:
    """The older corpus: one row for each P1 with the text of its paragraphs, numbered in the file; or each judgment
    paragraph; with the date of the judgment."""
    date = doc.first("FRBRdate")
    shared = {"title": doc.text(doc.first("Title")) or None, "date": date.get("date") if date is not None else None}
    for node in doc.all("P1", "paragraph"):
        inner = [doc.text(n) for n in doc.all("P1para", below=node)]
        yield shared | {"text": " ".join(t for t in inner if t) or doc.text(node)}


FIRST_CORPUS = "title string, date string, text string"


def first_corpus(files: DataFrame, least: int = 20) -> DataFrame:
    """(id, doc_title, date, content) in the older form, with ids file.xml_s1, file.xml_s2, ..."""
    raw = parse(files, first_corpus_rows, FIRST_CORPUS).where("error IS NULL").where(F.length("text") >= least)
    return raw.select(F.concat("file", F.lit(".xml_s"), (F.col("ord") + 1).cast("string")).alias("id"), F.coalesce("title", "file").alias("doc_title"), "date", F.col("text").alias("content"))


def judgment_chunks(files: DataFrame) -> DataFrame:
    """One chunk for each paragraph of at least 30 characters, or one of the whole text if that is over 50."""
    raw = parse(files, judgment_rows, JUDGMENT).where("error IS NULL").where("(kind = 'paragraph' AND length(text) >= 30) OR (kind = 'full' AND length(text) > 50)")
    court = F.lit("Unknown")
    for mark, name in reversed(COURTS):
        court = F.when(F.col("file").contains(mark + "_"), name).otherwise(court)
    rows = raw.withColumns({"doc_title": F.coalesce(blank_to_null(F.col("name")), F.col("file")), "year": _year(F.col("file")), "court_level": court})
    content = F.concat_ws(" | ", F.format_string("CASE: %s (%s)", "doc_title", "year"), F.concat(F.lit("COURT: "), F.col("court_level")), F.when(F.col("kind") == "paragraph", F.concat(F.lit("PARA: "), F.col("label"))), F.concat(F.lit("TEXT: "), F.col("text")))
    null = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    return rows.select(
        "file", "ord", F.concat("file", F.lit(".xml_"), "label").alias("id"), F.lit("judgment").alias("source"), "doc_title", "year", F.col("label").alias("section"),
        null("part"), null("heading"), null("extent"), null("in_force_date"), "court_level", null("internal_refs", "array<string>"), null("inline_amendments", "array<string>"), null("defined_terms", "map<string,string>"), content.alias("content"),
    )


def effect_triples(files: DataFrame) -> DataFrame:
    """Ground-truth triples of change feeds; effects of unknown type or without both titles are dropped."""
    raw = parse(files, effect_rows, EFFECT).where("error IS NULL").withColumn("action", effect_action(F.col("type")))
    rows = raw.where("action IS NOT NULL AND affected <> '' AND affecting <> ''")
    at = lambda title, place: F.when(F.col(place) != "", F.concat(F.col(title), F.lit(" "), F.col(place))).otherwise(F.col(title))
    return rows.select(
        "file", "ord", F.concat(F.lit("effects_"), "affecting").alias("source_id"), F.col("affecting").alias("source_title"), F.col("affecting_at").alias("source_section"), "action",
        strip(at("affected", "affected_at")).alias("target_citation"), F.col("affected").alias("target_act_name"), F.concat("type", F.lit(" by "), at("affecting", "affecting_at")).alias("detail_text"),
        F.col("date").alias("effective_date"), F.lit(1.0).alias("confidence"), F.lit("effects_api").alias("provenance"),
    )


def notes(files: DataFrame) -> DataFrame:
    """(prefix, note_ord, note_key, note_text): a later comment replaces a key's text, paragraphs are added to it."""
    raw = parse(files, note_rows, NOTE).where("error IS NULL")
    set_at = F.max(F.when(F.col("mode") == "set", F.col("ord")))
    last = raw.groupBy("file", "key").agg(F.min("ord").alias("note_ord"), set_at.alias("set_at"))
    kept = raw.join(last, ["file", "key"]).where("mode = 'add' OR ord = set_at")
    folded = kept.groupBy("file", "key", "note_ord").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    prefix = F.regexp_replace("file", "_notes|_ExplanatoryNotes", "")
    return folded.select(prefix.alias("prefix"), "note_ord", F.col("key").alias("note_key"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("note_text"))


def feed_entries(files: DataFrame) -> DataFrame:
    """Registry rows of feed pages: (file, ord, next, uri, title, type, year, number); other ids are left out."""
    raw = parse(files, entry_rows, ENTRY).where("error IS NULL").withColumn("uri", uri_path(F.col("uri")))
    rows = raw.select("file", "ord", "next", "uri", "title", *(c.alias(n) for n, c in uri_parts(F.col("uri")).items()))
    return rows.where("type IS NOT NULL")


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, title, links, chars) of HTML pages, by the standard library's tolerant parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.title, self.pieces, self.links = "", "", [], 0

        def handle_starttag(self, tag, attrs):
            self.inside = tag
            self.links += tag == "a"

        def handle_endtag(self, tag):
            self.inside = ""

        def handle_data(self, data):
            if self.inside == "title":
                self.title += data
            elif self.inside not in ("script", "style") and data.strip():
                self.pieces.append(data.strip())

    def run(frames):
        for frame in frames:
            out = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                reader = Reader()
                reader.feed(html or "")
                out.append((page_id, reader.title.strip(), reader.links, len(" ".join(reader.pieces))))
            yield pd.DataFrame(out, columns=["page_id", "title", "links", "chars"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, title string, links bigint, chars bigint")


def page_links(files: DataFrame) -> DataFrame:
    """(file, next) of feed pages; next is null on the last page."""
    return parse(files, entry_rows, ENTRY).where("error IS NULL AND ord = 0").select("file", "next")


def validity(files: DataFrame, folder: Column) -> DataFrame:
    """(folder, files, valid, broken, bytes): how many files of each folder are XML, and their sizes."""
    told = parse(files, lambda doc: iter([{"none": None}]), "none string").select("file", F.col("error").isNotNull().alias("bad"))
    sizes = files.select("file", F.octet_length("content").alias("size")).join(told, "file")
    return sizes.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("bad")).alias("valid"), F.count_if("bad").alias("broken"), F.sum("size").alias("bytes"))
