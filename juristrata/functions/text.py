"""Scalar functions over text columns: actions, citations, ids, snippets, model output. All run inside the JVM.

Python's notion of white space and digits is Unicode-wide; the patterns switch Java's to the same with (?U).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from juristrata.functions.lexicon import ACTION_OF, CANONICAL_ACTIONS, CASE_MARKS, EFFECT_TYPES, TITLE_PATTERN


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_of(rules: list[tuple[Column, Column]]) -> Column:
    """The value of the first rule whose condition holds, else null; rules keep their order."""
    return reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def normalize_action(raw: Column) -> Column:
    """The relation type of a raw action: by variant, else the first type that contains it or is contained in it.

    Null and empty give null; a blank string is contained in every type, so it gives the first one.
    """
    every = F.array(*[F.lit(a) for a in CANONICAL_ACTIONS])
    near = lambda clean: F.get(F.filter(every, lambda a: clean.contains(a) | a.contains(clean)), F.lit(0))
    return F.when(raw != "", let(strip(F.upper(raw)), lambda clean: F.coalesce(lookup(clean, ACTION_OF), near(clean))))


def effect_action(kind: Column) -> Column:
    """The relation type of a change feed's effect type: exact, else the first type it contains, else null."""
    first = lambda clean: first_of([(clean.contains(k), F.lit(a)) for k, a in EFFECT_TYPES])
    return let(F.lower(strip(kind)), lambda clean: F.coalesce(lookup(clean, dict(EFFECT_TYPES)), first(clean)))


# Reference words after the year, and their short forms, in the order they are rewritten.
REFERENCES = [
    ("section", "s."), ("sections", "ss."), ("schedule", "Sch."), ("paragraph", "para."), ("paragraphs", "paras."),
    ("regulation", "reg."), ("regulations", "regs."), ("article", "art."),
]


def normalize_citation(raw: Column, abbreviations: Column | None = None) -> Column:
    """A citation in one form: abbreviations spelt out one after another, references after the first year shortened.

    abbreviations: array of structs (short, full) in their order of definition.
    """
    c = strip(raw)
    if abbreviations is not None:
        c = F.aggregate(abbreviations, c, lambda acc, a: F.replace(acc, a["short"], a["full"]))

    def rewritten(tail: Column) -> Column:
        for word, short in REFERENCES:
            tail = F.regexp_replace(tail, rf"(?iU)\b{word}\s+", short)
        return tail

    year = r"(?sU)^(.*?\d{4})(.*)$"
    parts = lambda c: F.when(c.rlike(year), F.concat(F.regexp_extract(c, year, 1), rewritten(F.regexp_extract(c, year, 2)))).otherwise(c)
    return F.when(raw != "", strip(let(c, parts)))


def extract_act_name(citation: Column) -> Column:
    """The act's or case's name inside a citation, else the citation itself."""
    act = F.regexp_extract(citation, r"(?U)^(.*?(?:Act|Bill|Order|Regulations?|Rules?)\s+\d{4})", 1)
    case = F.regexp_extract(citation, r"(?U)^(\[\d{4}\]\s+\w+\s+\d+)", 1)
    return F.when(citation != "", strip(F.coalesce(blank_to_null(act), blank_to_null(case), citation)))


def id_prefix(chunk_id: Column) -> Column:
    """The document part of a chunk id: up to the last '.xml_', else the whole id."""
    return F.regexp_replace(chunk_id, r"(?s)^(.*)\.xml_.*$", "$1")


def is_caselaw(chunk_id: Column) -> Column:
    return chunk_id.rlike("|".join(CASE_MARKS))


def node_type(chunk_id: Column) -> Column:
    return F.when(is_caselaw(chunk_id), "judgment").otherwise("legislation")


def body(content: Column) -> Column:
    """What follows the first '| TEXT:', stripped; null without the mark or text."""
    at = F.instr(content, "| TEXT:")
    return F.when(at > 0, blank_to_null(strip(F.substring(content, at + 7, F.length(content)))))


def snippet(content: Column, size: int = 500) -> Column:
    return F.left(body(content), F.lit(size))


def last_body(content: Column) -> Column:
    """What follows the last '| TEXT:', stripped."""
    return strip(F.substring_index(content, "| TEXT:", -1))


def clean_heading(heading: Column) -> Column:
    """Null for headings of dots and white space only."""
    return F.when(~heading.rlike(r"(?U)^[\s.]+$"), heading)


def self_amendment(source_title: Column, act_name: Column) -> Column:
    known = (F.coalesce(source_title, F.lit("")) != "") & (F.coalesce(act_name, F.lit("")) != "")
    return known & F.coalesce(F.lower(act_name).contains(F.lower(source_title)), F.lit(False))


def title_matches(title: Column) -> Column:
    return title.rlike(TITLE_PATTERN)


def uri_path(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^https?://[^/]+", "")


def uri_parts(path: Column) -> dict[str, Column]:
    """type, year, number of a /type/year/number path; null where it is none."""
    shape = r"^/([a-z]+)/(\d+)/(\d+)$"
    part = lambda i: blank_to_null(F.regexp_extract(path, shape, i))
    return {"type": part(1), "year": part(2).try_cast("int"), "number": part(3).try_cast("int")}


def prompt(chunk: dict[str, Column], first_amendments: int = 5) -> Column:
    """The extraction prompt's chunk part: known metadata, one line each, then the text."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    amendments = F.slice(chunk["inline_amendments"], 1, first_amendments)
    return F.concat_ws(
        "\n",
        line("Document", chunk["doc_title"]), line("Section", chunk["section"]), line("Part", chunk["part"]), line("Heading", chunk["heading"]),
        line("Extent", chunk["extent"]), line("In force", chunk["in_force_date"]),
        F.when(F.size(amendments) > 0, F.concat(F.lit("Amendments: "), F.array_join(amendments, " | "))),
        F.when(F.size(chunk["defined_terms"]) > 0, F.concat(F.lit("Terms: "), F.to_json(chunk["defined_terms"]))),
        line("Text", chunk["content"]),
    )


def embedding_text(content: Column, size: int = 512, least: int = 20) -> Column:
    """The text that is embedded; null for what is too short."""
    return F.when(F.length(content) >= least, F.left(content, F.lit(size)))


def id_list(argument: Column, most: int = 10) -> Column:
    """Ids of a comma list, without quotes and blanks, the first few."""
    ids = F.transform(F.split(argument, ","), lambda x: F.regexp_replace(strip(x), "^[\"'`]+|[\"'`]+$", ""))
    return F.slice(F.filter(ids, lambda x: x != ""), 1, most)


def first_action(output: Column) -> Column:
    """The first ACTION segment of a model's output, stripped; null if there is none."""
    return F.when(output.contains("ACTION:"), strip(F.split_part(output, F.lit("ACTION:"), F.lit(2))))


def last_answer(output: Column) -> Column:
    return F.when(output.contains("ANSWER:"), strip(F.split_part(output, F.lit("ANSWER:"), F.lit(-1))))


def quoted_argument(action: Column) -> Column:
    """The quoted string that is a tool call's first argument."""
    return blank_to_null(F.regexp_extract(action, "\\w+\\(\\s*([\"'`])(.*?)\\1", 2))


def tool_name(action: Column) -> Column:
    return first_of([(action.contains(t + "("), F.lit(t)) for t in ("semantic_search", "run_query", "lookup_corpus")])


def top_k(action: Column, default: int = 5) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(action, r"top_k\s*=\s*(\d+)", 1)).try_cast("int"), F.lit(default))


# What is removed from answers, in order (pattern, replacement).
ANSWER_NOISE = [
    (r"(?s)THOUGHT:.*?(?=\n\n|\z)", ""),
    (r"\((?:ukpga|uksi|ewca|uksc|ewhc|ukut)_\d{4}_\d+\.xml_\w+\)", ""),
    (r"(?:ukpga|uksi|ewca|uksc|ewhc|ukut)_[\w]+_\d{4}_?\d*\.xml_[\w]+", ""),
    (r"\(\s*\)", ""),
    (r"  +", " "),
    (r"\n{3,}", "\n\n"),
]


def clean_answer(answer: Column) -> Column:
    for i, (pattern, by) in enumerate(ANSWER_NOISE):
        answer = F.regexp_replace(answer, pattern, by)
        if i == 0:
            answer = strip(answer)
    return strip(answer)


def nonempty_result(result: Column) -> Column:
    """Whether a tool's result is a non-empty JSON list or object, and no warning."""
    size = F.coalesce(F.json_array_length(result), F.size(F.json_object_keys(result)), F.lit(0))
    return F.coalesce(~result.startswith("⚠️") & (size > 0), F.lit(False))


def preview(c: Column, size: int = 100) -> Column:
    flat = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > size, F.concat(F.left(flat, F.lit(size)), F.lit("..."))).otherwise(flat)


def model_items(output: Column) -> Column:
    """The list of items in a model's output, as an array of variants; null if it holds none.

    Tried in turn: the output as JSON, then its widest bracketed part. An object gives the list under mutations,
    relationships, results or data, or itself if it has an action.
    """
    whole = F.try_parse_json(output)
    inner = F.try_parse_json(blank_to_null(F.regexp_extract(output, r"(?s)\[.*\]", 0)))

    def unwrap(v: Column) -> Column:
        lists = [F.try_variant_get(v, path, "array<variant>") for path in ("$", "$.mutations", "$.relationships", "$.results", "$.data")]
        alone = F.when(F.try_variant_get(v, "$.action", "string").isNotNull(), F.array(v))
        return F.coalesce(*lists, alone)

    return F.coalesce(unwrap(whole), unwrap(inner))


def unique(values: Column) -> Column:
    """An array without repeats, in the order of first occurrence."""
    return F.array_distinct(values)


def display_label(name: Column, size: int = 25) -> Column:
    """A short label for drawing: without the file mark, cut with an ellipsis."""
    plain = F.replace(name, F.lit(".xml_"), F.lit(" s."))
    return F.when(F.length(plain) > size, F.concat(F.left(plain, F.lit(size - 3)), F.lit("..."))).otherwise(plain)


def titled_embedding_text(title: Column, section: Column, content: Column, size: int = 512) -> Column:
    """The older form of the embedded text: title, section and the last body, as far as they are known."""
    return F.left(F.concat_ws(" ", blank_to_null(title), blank_to_null(section), blank_to_null(last_body(content))), F.lit(size))
