"""From chunks to triples: batches, prompts, model output, validation, sampling."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristrata.functions.lexicon import CANONICAL_ACTIONS
from juristrata.functions.text import extract_act_name, last_body, model_items, normalize_action, normalize_citation, self_amendment, strip
from juristrata.operators.corpus import first_by_key


def hot(content: Column, source: Column) -> Column:
    return F.lower(content).rlike("repeal|omit|amend|substitut") | (source == "judgment")


def smart_batch(chunks: DataFrame, n: int) -> DataFrame:
    """The first n, by seq, of all hot chunks and as many cold legislation chunks as leave room."""
    rows = chunks.withColumn("_hot", hot(F.col("content"), F.col("source")))
    room = n - rows.where("_hot").count()
    cold = rows.where("NOT _hot AND source = 'legislation'").orderBy("seq").limit(max(room, 0))
    return rows.where("_hot").unionByName(cold).orderBy("seq").limit(n).drop("_hot")


def processable(chunks: DataFrame, least: int = 50, blank: str | None = None) -> DataFrame:
    """Judgment chunks whose text, without the head before it, has at least so many characters, those of blank (all
    white space, if None) at both ends aside."""
    text = last_body(F.col("content")) if blank is None else F.btrim(F.substring_index("content", "| TEXT:", -1), F.lit(blank))
    return chunks.where((F.col("source") == "judgment") & (F.length(text) >= least))


def system_prompt(source: Column) -> Column:
    """The prompt that fixes what a model must answer, by the kind of document."""
    return F.when(source == "judgment", F.lit(JUDGMENT_PROMPT)).otherwise(F.lit(LEGISLATION_PROMPT))


ANSWER = (
    "Answer with a JSON array only, and with [] if there is none. Each item is an object with the fields action,"
    " target_citation, detail_text and effective_date (null where the text gives none), and names one target: if a"
    f" provision concerns several, give an item for each. The actions are {', '.join(CANONICAL_ACTIONS)}."
)
LEGISLATION_PROMPT = f"You read one provision of legislation and list how it changes, or refers to, other legislation. {ANSWER}"
JUDGMENT_PROMPT = f"You read one paragraph of a judgment and list the legislation and the cases that it applies, interprets or cites, by their full names. {ANSWER}"

NOTHING = "[]"


def extract(prompts: DataFrame, extractor: Callable[[list[str]], list[str | None]], workers: int = 8, batch: int = 32, attempts: int = 3, wait: float = 5.0, done: DataFrame | None = None) -> DataFrame:
    """(id, output) from an injected model: prompts (id, prompt) are dealt to `workers` partitions, and the extractor is
    called with lists of prompts.

    Timeouts and lost connections are tried again, after wait, twice wait, ... seconds; what still fails is null, so a
    later run takes it up again. After any other error a list goes through prompt by prompt, and a prompt that fails
    alone gives no items. Ids in done (a table of earlier outputs) that have an output are left out: with `done` read
    from where the outputs are appended, a run that was cut off goes on where it stopped."""

    def ask(part: list[str]) -> list[str | None]:
        for k in range(attempts):
            try:
                return list(extractor(part))
            except Exception as e:  # whatever the injected model raises
                passing = isinstance(e, ConnectionError | TimeoutError) or any(w in str(e).lower() for w in ("timeout", "connection"))
                if not passing:
                    return [NOTHING] if len(part) == 1 else [x for p in part for x in ask([p])]
                time.sleep(wait * (k + 1))
        return [None] * len(part)

    def run(frames):
        for frame in frames:
            out = [x for at in range(0, len(frame), batch) for x in ask(frame["prompt"].iloc[at : at + batch].tolist())]
            yield pd.DataFrame({"id": frame["id"], "output": pd.Series(out, index=frame.index, dtype=object)})

    if done is not None:
        prompts = prompts.join(done.where("output IS NOT NULL").select("id"), "id", "left_anti")
    return prompts.select("id", "prompt").repartition(workers).mapInPandas(run, "id string, output string")


def from_offset(chunks: DataFrame, offset: int) -> DataFrame:
    """The chunks from a position on, to resume by hand."""
    return chunks.where(F.col("seq") >= offset)


def parsed(outputs: DataFrame, output: str = "output") -> DataFrame:
    """One row for each item of a model's output, with its fields."""
    items = outputs.withColumn("item", F.explode(model_items(F.col(output))))
    field = lambda name: F.try_variant_get("item", f"$.{name}", "string").alias(name)
    return items.select(*[c for c in outputs.columns if c != output], field("action"), field("target_citation"), field("detail_text"), field("effective_date"))


def validated(items: DataFrame, abbreviations: Column | None = None) -> DataFrame:
    """Items with a known action and a citation of at least three characters, normalised."""
    rows = items.withColumns({"action": normalize_action(F.col("action")), "target_citation": normalize_citation(F.col("target_citation"), abbreviations)})
    rows = rows.where("action IS NOT NULL AND length(target_citation) >= 3")
    return rows.withColumn("target_act_name", extract_act_name(F.col("target_citation")))


# Targets that name nothing, and detail texts that say nothing.
VAGUE = ["the act", "this act", "the 1989 act", "the 1996 act", "the act of 1989", "the statute", "the provision"]
EMPTY = ["null", "none", "n/a", ""]


def caselaw_cleanup(items: DataFrame) -> DataFrame:
    """Case-law items without vague targets and bare section references; empty details and odd dates become null."""
    rows = items.where(~F.lower(strip(F.col("target_citation"))).isin(VAGUE))
    rows = validated(rows).where(~(F.col("target_citation").rlike(r"^s\.\d+") & ~F.col("target_citation").rlike(r"Act|Order|Rules?\s+\d{4}")))
    detail, date = strip(F.col("detail_text")), strip(F.col("effective_date"))
    return rows.withColumns({
        "detail_text": F.when(~F.lower(detail).isin(EMPTY) & (F.length(detail) >= 5), detail),
        "effective_date": F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date),
        "is_self_amendment": F.coalesce(F.lower(strip(F.col("source_title"))) == F.lower(strip(F.col("target_act_name"))), F.lit(False)),
    })


def post_process(triples: DataFrame) -> DataFrame:
    """First-wins dedup on the raw key, then normalisation (equal keys may come up again, as the graph's fold expects)."""
    once = first_by_key(triples, ["source_id", "action", "target_citation"])
    rows = validated(once)
    return rows.withColumn("is_self_amendment", self_amendment(F.col("source_title"), F.col("target_act_name")))


def sampling_confidence(samples: DataFrame, runs: DataFrame, least: float = 0.4) -> DataFrame:
    """How often (action, citation) occurs over the runs on a chunk that succeeded; samples: chunk, run, ord, action,
    citation, detail; runs: (chunk, run) of every run that gave an answer, an empty one included.

    A record with a detail is preferred, then the earliest."""
    grouped = samples.groupBy("chunk", "action", "citation").agg(F.count_distinct("run").alias("seen"), F.min_by("detail", F.struct(F.col("detail").isNull(), "run", "ord")).alias("detail"))
    won = runs.groupBy("chunk").agg(F.count_distinct("run").alias("runs"))
    share = F.col("seen") / F.col("runs")
    return grouped.join(won, "chunk").where(share >= least).withColumn("confidence", F.round(share, 2)).drop("seen", "runs")
