"""Tables from files and feeds: JSON arrays, the document registry, discovery, manifests, traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juristrata.functions.lexicon import ACT_TYPES, ENUMERATED_TYPES, ENUMERATED_YEARS, INSTRUMENT_TYPES, SUBJECTS, TITLE_KEYWORDS
from juristrata.functions.text import title_matches
from juristrata.operators.corpus import first_by_key


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file (or a folder of them); a missing one gives no rows."""
    return spark.read.schema(schema).json(path, multiLine=True) if exists(spark, path) else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def registry(*found: DataFrame) -> DataFrame:
    """(seq, uri, title, type, year, number): the first row of each uri; earlier inputs (seeds) come before later ones."""
    every = None
    for i, df in enumerate(found):
        rows = df.select((F.col("seq") + F.lit(i * (1 << 40))).alias("seq"), "uri", "title", "type", "year", "number")
        every = rows if every is None else every.unionByName(rows)
    return first_by_key(every, ["uri"])


def family(type_col: str = "type"):
    """act, instrument, or null for other types."""
    return F.when(F.col(type_col).isin(ACT_TYPES), "act").when(F.col(type_col).isin(INSTRUMENT_TYPES), "instrument")


def enumerate_years(spark: SparkSession) -> DataFrame:
    """(type, year) of all feeds that enumeration visits."""
    pairs = [(t, y) for t in ENUMERATED_TYPES for y in ENUMERATED_YEARS]
    return spark.createDataFrame(pairs, "type string, year int")


def discovery_urls(base: str) -> list[str]:
    """Feeds to walk: by subject, by title keyword, by type and year."""
    from urllib.parse import quote

    by_subject = [f"{base}/all/{s}/data.feed" for s in SUBJECTS]
    by_title = [f"{base}/title/{quote(k)}/data.feed" for k in TITLE_KEYWORDS]
    return by_subject + by_title + [f"{base}/{t}/{y}/data.feed" for t in ENUMERATED_TYPES for y in ENUMERATED_YEARS]


def by_title(entries: DataFrame) -> DataFrame:
    return entries.where(title_matches(F.col("title")))


def fetch(urls: DataFrame, fetcher: Callable[[str], bytes | None], partitions: int = 2, attempts: int = 3, wait: float = 0.4) -> DataFrame:
    """(url, content) by an injected fetcher, which returns None for what does not exist; other failures are retried with
    growing waits, then give null. Partitions bound the number of requests at a time."""
    import time

    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for url in frame["url"]:
                content = None
                for k in range(attempts):
                    try:
                        content = fetcher(url)
                        break
                    except OSError:
                        time.sleep(wait * 2**k)
                out.append(content)
                time.sleep(wait)
            yield pd.DataFrame({"url": frame["url"], "content": pd.Series(out, index=frame.index, dtype=object)})

    return urls.select("url").repartition(partitions).mapInPandas(run, "url string, content binary")


def walk_feed(start: str, page: Callable[[str], tuple[list[dict], str | None]], most: int = 300) -> list[dict]:
    """Entries of a feed's pages until there is no next link, or the page cap; the number of pages is small."""
    found, url, seen = [], start, set()
    while url and url not in seen and len(seen) < most:
        seen.add(url)
        entries, url = page(url)
        found += entries
    return found


def new_documents(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Registry rows whose file is not there yet."""
    name = F.concat_ws("_", "type", F.col("year").cast("string"), F.col("number").cast("string"))
    return wanted.withColumn("file", name).join(have.select("file"), "file", "left_anti")


def well_formed(contents: DataFrame) -> DataFrame:
    """Contents (bytes) that begin with '<', white space aside; null contents are none."""
    blanks = F.encode(F.lit(" \t\n\r\x0b\x0c"), "UTF-8")
    return contents.where(F.startswith(F.btrim("content", blanks), F.encode(F.lit("<"), "UTF-8")))


DOCUMENT = "file string, content binary, kind string"


def save_documents(fetched: DataFrame, path: str, kind: Column | None = None) -> None:
    """Append fetched documents (file, type, content) to the stored ones: acts under kind=act, all others under kind=other,
    or as the column kind says. What is stored already is skipped, and so is content that is no XML."""
    spark = fetched.sparkSession
    rows = well_formed(fetched).withColumn("kind", F.when(F.col("type") == "ukpga", "act").otherwise("other") if kind is None else kind)
    new = rows.join(stored_documents(spark, path).select("file", "kind"), ["file", "kind"], "left_anti")
    new.select("file", "content", "kind").dropDuplicates(["file", "kind"]).write.mode("append").partitionBy("kind").parquet(path)


def save_effects(fetched: DataFrame, path: str) -> None:
    """The same for change feeds, which are named after the document that they affect."""
    save_documents(fetched.withColumn("file", F.concat("file", F.lit("_effects"))), path, F.lit("effects"))


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, content, kind) of all stored documents, as parse() reads them; a missing folder gives no rows."""
    return spark.read.schema(DOCUMENT).parquet(path) if exists(spark, path) else spark.createDataFrame([], DOCUMENT)


# Documents that every registry begins with, whatever discovery finds: type, year, number, title.
SEEDS = [
    ("ukpga", 2024, 3, "Automated Vehicles Act 2024"),
    ("ukpga", 2024, 2, "Pedicabs (London) Act 2024"),
    ("ukpga", 1988, 52, "Road Traffic Act 1988"),
    ("ukpga", 1988, 53, "Road Traffic Offenders Act 1988"),
    ("ukpga", 1984, 27, "Road Traffic Regulation Act 1984"),
    ("ukpga", 2006, 49, "Road Safety Act 2006"),
    ("ukpga", 2000, 38, "Transport Act 2000"),
    ("ukpga", 1993, 43, "Railways Act 1993"),
    ("ukpga", 2005, 14, "Railways Act 2005"),
    ("ukpga", 2021, 12, "Air Traffic Management and Unmanned Aircraft Act 2021"),
    ("ukpga", 2012, 19, "Civil Aviation Act 2012"),
    ("ukpga", 2018, 18, "Automated and Electric Vehicles Act 2018"),
    ("ukpga", 2022, 14, "Taxis and Private Hire Vehicles Act 2022"),
    ("ukpga", 1980, 34, "Highways Act 1980"),
    ("ukpga", 2023, 32, "Energy Act 2023"),
    ("uksi", 2024, 566, "Goods Vehicles (International Road Transport) Regs 2024"),
    ("uksi", 2024, 615, "Motor Vehicles (Driving Licences) (Amendment) Regs 2024"),
    ("uksi", 2024, 305, "Road Vehicles (Registration and Licensing) Regs 2024"),
    ("uksi", 2023, 980, "Traffic Signs (Amendment) Regulations 2023"),
    ("uksi", 2023, 695, "Drivers' Hours and Tachographs (Amendment) Regs 2023"),
    ("uksi", 2023, 903, "Railways (Access, Management) (Amendment) Regs 2023"),
]


def seeds(spark: SparkSession) -> DataFrame:
    """Registry rows of SEEDS, to come before what was discovered: registry(seeds(spark), found)."""
    rows = [(i, f"/{kind}/{year}/{number}", title, kind, year, number) for i, (kind, year, number, title) in enumerate(SEEDS)]
    return spark.createDataFrame(rows, "seq long, uri string, title string, type string, year int, number int")


def case_probes(spark: SparkSession, courts: list[str], years: list[int], upto: int = 10) -> DataFrame:
    """(court, year, n, attempt, uri) of all case-law addresses to try; the first attempt that succeeds counts."""
    rows = [(c, y, n, a, u) for c in courts for y in years for n in range(1, upto + 1) for a, u in enumerate((f"/{c}/{y}/{n}", f"/{c.replace('_', '/')}/{y}/{n}"))]
    return spark.createDataFrame(rows, "court string, year int, n int, attempt int, uri string")


def manifest(reg: DataFrame, **counts: int) -> DataFrame:
    """One row: how many registry rows of each family, further counts, and the items."""
    one = reg.agg(F.count(F.lit(1)).alias("total"), F.count_if(family() == "act").alias("acts"), F.count_if(family() == "instrument").alias("instruments"), F.sort_array(F.collect_list(F.struct("uri", "title", "type", "year", "number"))).alias("items"))
    return one.select(*[F.lit(v).alias(k) for k, v in counts.items()], "total", "acts", "instruments", "items")


def spans(spark: SparkSession, path: str, schema: str, trace_id: str | None = None) -> DataFrame:
    rows = read_json(spark, path, schema)
    return rows.where(F.col("trace_id") == trace_id) if trace_id else rows


def new_notes(wanted: DataFrame, contents: DataFrame, least: int = 500) -> DataFrame:
    """Explanatory notes worth keeping: those of acts, of more than `least` bytes."""
    return wanted.where(family() == "act").join(contents.where(F.octet_length("content") > least), "uri")


def attempts_won(probes: DataFrame) -> DataFrame:
    """The first successful attempt of each probed case: probes with a boolean hit."""
    won = probes.where("hit").groupBy("court", "year", "n").agg(F.min_by("uri", "attempt").alias("uri"))
    return probes.select("court", "year", "n").distinct().join(won, ["court", "year", "n"], "left")


def follow(links: DataFrame, starts: DataFrame, most: int = 300) -> DataFrame:
    """(feed, page, step) of the stored pages that a walk along next links meets, at most `most` a feed; links: page, next,
    best a stored table, as each step reads it; starts: feed, page. A walk ends where a page has no link, where its
    target is not stored or was met before, or after `most` pages."""
    to = links.where("next IS NOT NULL").join(links.select(F.col("page").alias("next")), "next").select("page", "next")
    return links.sparkSession.sql(
        """WITH RECURSIVE walk(feed, page, step) MAX RECURSION LEVEL {levels} AS (SELECT feed, page, 0 FROM {starts}
            UNION ALL SELECT feed, next, step + 1 FROM walk JOIN {links} l ON l.page = walk.page WHERE step + 1 < {most})
        SELECT feed, page, min(step) AS step FROM walk GROUP BY feed, page""",
        levels=most + 1, starts=starts, links=to, most=most,
    )
