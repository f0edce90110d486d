"""Scalar functions against their expected values."""

import pytest
from pyspark.sql import functions as F

from juristrata.functions import text as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [(" amended ", "AMENDS"), ("omit", "REPEALS"), ("SET_ASIDE", "OVERRULES"), ("disapplies", "APPLIES"), ("s", "AMENDS"), ("", None), ("   ", "AMENDS"), ("xyz", None), (None, None)])
def test_action(spark, raw, want):
    assert value(spark, P.normalize_action(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [
    ("Housing Act 1985 section 5", "Housing Act 1985 s.5"), ("Section 5 Housing Act 1985", "Section 5 Housing Act 1985"), ("X Act 2000 SCHEDULE 2", "X Act 2000 Sch.2"),
    ("X Act 2000 sections 1 and 2", "X Act 2000 ss.1 and 2"), ("  a 12345 section 1", "a 12345 s.1"), ("", None), (None, None),
])
def test_citation(spark, raw, want):
    assert value(spark, P.normalize_citation(F.lit(raw).cast("string"))) == want


def test_citation_spells_out_abbreviations_in_order(spark):
    table = F.array(F.struct(F.lit("LRA 1967").alias("short"), F.lit("Leasehold Reform Act 1967").alias("full")), F.struct(F.lit("Reform").alias("short"), F.lit("(R)").alias("full")))
    assert value(spark, P.normalize_citation(F.lit("LRA 1967 section 2"), table)) == "Leasehold (R) Act 1967 s.2"


@pytest.mark.parametrize("raw, want", [("Housing Act 1996 s.122", "Housing Act 1996"), ("[2023] UKSC 1", "[2023] UKSC 1"), ("[2023] UKSC 1 at 5", "[2023] UKSC 1"), ("Foo s.1", "Foo s.1"), (" The Rules 2001 r.4", "The Rules 2001")])
def test_act_name(spark, raw, want):
    assert value(spark, P.extract_act_name(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("Words Substituted", "SUBSTITUTES"), ("inserted (temp.)", "INSERTS"), ("disapplied", "APPLIES"), ("word omitted", None), ("excluded", None), ("coming into force", "COMMENCES")])
def test_effect(spark, raw, want):
    assert value(spark, P.effect_action(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("see (ukpga_2023_55.xml_63) there", "see there"), ("id ukpga_2023_55.xml_63", "id ukpga_2023_55.xml_63"), ("as ewca_civ_2023_1.xml_5 says", "as says"), ("THOUGHT: no\n\nyes", "yes")])
def test_clean_answer(spark, raw, want):
    assert value(spark, P.clean_answer(F.lit(raw))) == want


def test_ids_and_snippets(spark):
    assert value(spark, P.is_caselaw(F.lit("xx_uksc_1"))) is True
    assert value(spark, P.id_prefix(F.lit("a.xml_b.xml_c"))) == "a.xml_b"
    assert value(spark, P.snippet(F.lit("A | TEXT:  hi | TEXT: ho "))) == "hi | TEXT: ho"
    assert value(spark, P.last_body(F.lit("A | TEXT:  hi | TEXT: ho "))) == "ho"
    assert value(spark, P.snippet(F.lit("no mark"))) is None
    assert value(spark, P.clean_heading(F.lit(" . . ."))) is None
    assert value(spark, P.id_list(F.lit(" 'a', \"b\",, c "))) == ["a", "b", "c"]


@pytest.mark.parametrize("raw, want", [
    ('[{"action": "cites"}]', 1), ('```json\n[{"action": "a"}, {"action": "b"}]\n```', 2), ('{"relationships": [{"action": "a"}]}', 1), ('{"action": "a"}', 1), ("garbage", None), ('{"x": 1}', None), ("", None),
])
def test_model_items(spark, raw, want):
    assert value(spark, F.when(P.model_items(F.lit(raw)).isNotNull(), F.size(P.model_items(F.lit(raw))))) == want


def test_nonempty_result(spark):
    for raw, want in [("[]", False), ("[1]", True), ("{}", False), ('{"a": 1}', True), ("⚠️ [1]", False), ("text", False), (None, False)]:
        assert value(spark, P.nonempty_result(F.lit(raw).cast("string"))) is want


def test_self_amendment(spark):
    for title, act, want in [("Housing Act 1985", "The HOUSING ACT 1985", True), ("", "x", False), (None, "x", False), ("a", None, False)]:
        assert value(spark, P.self_amendment(F.lit(title).cast("string"), F.lit(act).cast("string"))) is want


def test_prompt_leaves_out_what_is_missing(spark):
    row = spark.createDataFrame([("T", None, "", "H", None, None, ["a", "b", "c", "d", "e", "f"], {"x": "y"}, "body")], "doc_title string, section string, part string, heading string, extent string, in_force_date string, inline_amendments array<string>, defined_terms map<string,string>, content string")
    text = row.select(P.prompt({c: F.col(c) for c in row.columns}).alias("v")).first()["v"]
    assert text == 'Document: T\nHeading: H\nAmendments: a | b | c | d | e\nTerms: {"x":"y"}\nText: body'
