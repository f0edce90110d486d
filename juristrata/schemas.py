"""Schemas of the tables, as DDL strings."""

CHUNK = (
    "seq bigint, id string, source string, doc_title string, year string, section string, part string, heading string,"
    " extent string, in_force_date string, court_level string, internal_refs array<string>, inline_amendments array<string>,"
    " defined_terms map<string,string>, content string"
)
TRIPLE = (
    "seq bigint, source_id string, source_title string, source_section string, action string, target_citation string,"
    " target_act_name string, detail_text string, effective_date string, in_force_date string, extent string,"
    " is_self_amendment boolean, chunk_id string, confidence double, provenance string"
)
REGISTRY = "seq bigint, uri string, title string, type string, year int, number int"
SPAN = "name string, span_kind string, start_time bigint, end_time bigint, trace_id string, attributes map<string,string>"
