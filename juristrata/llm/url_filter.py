"""URL filtering: a rule list, and association rules mined from labelled URLs, with DataFrame functions only.

A URL's tokens are the parts of its host and the words of its path and query, numbers folded into one token.
Labelled URLs become baskets of tokens plus their label (by default those that the rule list decides, with its verdict as
their label; what no rule decides is what the mined rules judge, and teaches nothing); Spark's
FP-growth finds the frequent itemsets; those with the block label give rules tokens -> block, pruned by support,
confidence and lift, and by simpler rules at least as sure. An inverted index holds each rule under its rarest token,
so a URL meets only rules that share such a token, and all other tokens are then checked.

Defined cases: a null URL or one without :// has an empty host and path, no token and verdict allow, unless a rule
fits; repeated rows are judged alike; with no labelled URL nothing is mined and the method allows; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import lower_ascii, materialize

Rule = tuple[str, str]
BLOCKED, ALLOWED = "=block", "=allow"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. A rule is (verdict, 'host/path')."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: h: for host parts, p: for words of the path, q: for words of the query; numbers are #."""

    def words(text: Column, mark: str) -> Column:
        parts = F.filter(F.split(lower_ascii(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda x: x != "")
        return F.transform(parts, lambda x: F.concat(F.lit(mark), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))

    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:"), words(query, "q:")))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float, min_urls: int = 1) -> DataFrame:
    """(tokens, support, confidence, lift) of rules tokens -> block; labelled has tokens and the boolean blocked."""
    total, blocked = labelled.agg(F.count(F.lit(1)), F.sum(F.col("blocked").cast("long"))).first()
    empty = "tokens array<string>, support double, confidence double, lift double"
    if not total or not blocked:
        return labelled.sparkSession.createDataFrame([], empty)
    min_support = max(min_support, min_urls / total)
    # Only tokens that are frequent among blocked URLs can be in a rule: others need not enter the trees.
    least = min_support * total
    frequent = labelled.where("blocked").select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    names = [r["token"] for r in frequent.orderBy("token").collect()]  # at most (tokens of a URL) / min_support names
    useful = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    baskets = labelled.select(F.concat(F.array_intersect(F.col("tokens"), useful), F.array(F.when(F.col("blocked"), F.lit(BLOCKED)).otherwise(F.lit(ALLOWED)))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_block = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("both"))
    rules = with_block.join(sets, "items").select(
        F.col("items").alias("tokens"), (F.col("both") / total).alias("support"), (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.col("freq") / (blocked / total)).alias("lift")
    ).where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    rules = materialize(rules, "rules")
    # A rule is redundant if leaving one token out gives a rule at least as sure.
    shorter = rules.select("tokens", "confidence", F.explode("tokens").alias("out")).select("tokens", "confidence", F.array_remove("tokens", F.col("out")).alias("less"))
    known = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("known"))
    redundant = shorter.join(known, "less").where("known >= confidence").select("tokens").distinct()
    return rules.join(redundant, "tokens", "left_anti")


def match(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, confidence, matched): the surest rule of each row of pages that has one, by inverted index."""
    freq = pages.select(F.explode("tokens").alias("token")).groupBy("token").count()
    weighed = rules.withColumn("rule_id", F.xxhash64("tokens")).select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(freq, "token", "left")
    index = weighed.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"), F.first("tokens").alias("needs"), F.first("confidence").alias("confidence"))
    terms = pages.select(key, "tokens", F.explode("tokens").alias("token"))
    hits = terms.join(index, "token").where(F.size(F.array_except("needs", "tokens")) == 0)
    return hits.groupBy(key).agg(F.max("confidence").alias("confidence"), F.max_by(F.concat_ws(" ", "needs"), F.struct("confidence", "rule_id")).alias("matched"))


def url_filter(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, min_support: float = 0.002, min_confidence: float = 0.8, min_lift: float = 1.2, min_urls: int = 5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: page_id, host, path, rule, verdict, confidence, matched.

    A mined rule holds for at least min_support of the labelled URLs, and for min_urls of them.
    labels: (page_id, blocked boolean); null: the verdicts of the rule list on the URLs that it decides are the labels.
    """
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parts = narrow.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn("rule", name).withColumn("ruled", verdict).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("rid", F.monotonically_increasing_id()).drop("url")
    judged = materialize(judged, "urls")
    if labels is None:
        labelled = judged.where("rule IS NOT NULL").select("tokens", (F.col("ruled") == "block").alias("blocked"))
    else:
        labelled = judged.join(labels.select(F.col(id_col).alias("page_id"), "blocked").where("blocked IS NOT NULL").groupBy("page_id").agg(F.bool_or("blocked").alias("blocked")), "page_id").select("tokens", "blocked")
    found = match(judged.where("rule IS NULL").select("rid", "tokens"), mine(labelled, min_support, min_confidence, min_lift, min_urls), "rid")
    method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(found, "rid", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"), F.when(F.col("rule").isNull(), F.col("matched")).alias("matched"))
