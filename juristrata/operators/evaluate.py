"""Scoring of answers, and timelines of traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juristrata.functions.text import blank_to_null, preview


def score_answers(answers: DataFrame, by_prefix: bool = False) -> DataFrame:
    """answers: question, domain, answer, elapsed_seconds, expected_actions, error. Adds the flags of the evaluation.

    by_prefix: the older rule for grounding, by the answer's very beginning."""
    answer = F.coalesce("answer", F.lit(""))
    warned = answer.startswith("⚠️ UNGROUNDED") if by_prefix else F.left(answer, F.lit(50)).contains("⚠️")
    found = F.filter("expected_actions", lambda a: F.lower(answer).contains(F.lower(a)))
    return answers.withColumns({
        "answer_length": F.length(answer), "has_answer": (answer != "") & ~answer.startswith("❌"), "has_grounding": (answer != "") & ~warned,
        "actions_found": found, "is_negative_test": F.size("expected_actions") == 0, "succeeded": F.col("error").isNull(),
    })


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("has_answer").alias("answered"), F.count_if("has_grounding").alias("grounded"), F.count_if("succeeded").alias("succeeded"), F.round(F.avg("elapsed_seconds"), 3).alias("mean_seconds")
    )


def timeline(spans: DataFrame, size: int = 100) -> DataFrame:
    """One row a span in order of start within its trace: step, name, kind, duration, role, input and output previews."""
    a = lambda key: blank_to_null(F.col("attributes")[key])
    role = F.when(a("question").isNotNull(), "agent").when((F.col("span_kind") == "LLM") | F.lower("name").contains("chat"), "llm").otherwise("tool")
    given = F.when(role == "agent", a("question")).when(role == "llm", a("llm.input_messages")).otherwise(F.coalesce(a("cypher_query"), a("query"), a("input.value")))
    got = F.when(role == "agent", a("answer")).when(role == "llm", F.coalesce(a("llm.output_messages"), a("output.value"))).otherwise(F.coalesce(a("result_preview"), a("output.value")))
    step = F.row_number().over(Window.partitionBy("trace_id").orderBy("start_time", "name"))
    return spans.select(
        "trace_id", step.alias("step"), F.upper("name").alias("name"), "span_kind", (F.col("end_time") - F.col("start_time")).alias("duration"), role.alias("role"), preview(given, size).alias("input"), preview(got, size).alias("output")
    )
