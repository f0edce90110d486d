"""The legal tables, derived from the driver's tables by the same expressions in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristrata.functions.lexicon import ACTION_OF, CANONICAL_ACTIONS
from juristrata.operators import extract, graph


class Inputs:
    """Derived tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table dealt by its key to as many tasks as a shuffle has, before Python works on each row: a table in one
        file, or one row group, would keep one core at work."""
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return self.table(name).repartition(tasks, key)

    @cached_property
    def t_raw(self) -> DataFrame:
        """Raw triples in arrival order, one an event."""
        return self.table("events").selectExpr(
            "event_id AS seq",
            "concat(element_at(array('uksc','ukpga','uksi','ewca'), cast(user_id % 4 + 1 AS int)), '_', 2020 + user_id % 5, '_', user_id % 8, '.xml_', event_id % 3) AS source_id",
            "concat('Housing Act ', 1980 + user_id % 10) AS source_title",
            "CASE event_type WHEN 'click' THEN 'cites' WHEN 'view' THEN ' Referred ' WHEN 'purchase' THEN 'AMENDED' WHEN 'signup' THEN 'inserting' ELSE 'unknown' END AS action",
            "concat('Housing Act ', 1980 + cast(get_json_object(props, '$.k') AS bigint) % 10, ' section ', event_id % 4) AS target_citation",
            "(3 + event_id % 7) / 10.0D AS confidence",
            "CASE WHEN event_id % 3 = 0 THEN concat('detail ', event_id) END AS detail_text",
            "CASE WHEN event_id % 4 = 1 THEN date_format(ts, 'yyyy-MM-dd') END AS effective_date",
            "CASE WHEN event_id % 5 = 0 THEN 'ground_truth' END AS provenance",
        )

    @cached_property
    def t(self) -> DataFrame:
        """Validated triples with the graph's column names."""
        rows = extract.validated(self.t_raw)
        return rows.select("seq", "source_id", "source_title", F.col("action").alias("action_type"), F.col("target_citation").alias("target"), F.col("target_act_name").alias("act_name"), "confidence", F.col("detail_text").alias("detail"), F.col("effective_date").alias("date"), "provenance")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.t).drop("source_ids").withColumn("confidence", F.round("confidence", 6))

    @cached_property
    def chunks(self) -> DataFrame:
        """One chunk a line of a document."""
        lines = self.table("documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
        return lines.selectExpr(
            "doc_id * 100000 + pos AS seq", "doc_id", "concat('doc', doc_id, '.xml_', pos) AS id",
            "CASE WHEN doc_id % 5 = 0 THEN 'judgment' ELSE 'legislation' END AS source", "concat('Document ', doc_id) AS doc_title", "cast(pos AS string) AS section",
            "CASE pos % 4 WHEN 0 THEN '. . .' WHEN 1 THEN concat('Heading ', pos) END AS heading", "CASE WHEN pos % 2 = 0 THEN 'Part 1' END AS part",
            "concat('ACT: Document ', doc_id, ' | TEXT: ', line) AS content", "line",
        )

    @cached_property
    def own_chunks(self) -> DataFrame:
        """Chunks under the ids of the triples' sources, several an id."""
        return self.table("orders").selectExpr(
            "o_orderkey AS seq",
            "concat(element_at(array('uksc','ukpga','uksi','ewca'), cast(o_custkey % 4 + 1 AS int)), '_', 2020 + o_custkey % 5, '_', o_custkey % 8, '.xml_', o_orderkey % 3) AS id",
            "concat('Title ', o_custkey % 8) AS doc_title", "cast(o_orderkey % 3 AS string) AS section", "CASE WHEN o_orderkey % 2 = 0 THEN ' ... ' ELSE concat('Heading ', o_orderkey) END AS heading",
            "CASE WHEN o_orderkey % 3 > 0 THEN concat('Part ', o_orderkey % 7) END AS part", "concat('ACT: x | TEXT:  text of ', o_orderkey, ' ') AS content",
        )

    @cached_property
    def titles(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey",
            "concat(p_name, CASE p_type WHEN 'ECONOMY' THEN ' Road Traffic' WHEN 'SMALL' THEN ' Police Court' WHEN 'MEDIUM' THEN ' Gas Supply' WHEN 'PROMO' THEN ' Housing Tax' WHEN 'LARGE' THEN ' Soil' ELSE '' END) AS title",
        )

    @cached_property
    def e_li(self) -> DataFrame:
        """Many edges with repeated keys: supplier to part."""
        return self.table("lineitem").selectExpr(
            "cast(date_format(l_shipdate, 'yyyyMMdd') AS bigint) AS seq", "cast(l_suppkey AS string) AS source_id", "cast(l_partkey AS string) AS target",
            "CASE l_returnflag WHEN 'R' THEN 'REPEALS' WHEN 'A' THEN 'AMENDS' ELSE 'CITES' END AS action_type", "l_discount / 7.0D AS confidence", "cast(NULL AS string) AS detail", "date_format(l_shipdate, 'yyyy-MM-dd') AS date", "cast(NULL AS string) AS provenance",
        )

    @cached_property
    def titled(self) -> DataFrame:
        """Triples' acts, for chains: the act that a source stands for, and the act it modifies."""
        return self.t.select("source_id", F.col("source_title").alias("title"), "act_name", "action_type").distinct()


def values(pairs, columns: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, p)) + ")" for p in pairs) + f") AS {columns}"


def action_sql(c: str) -> str:
    """normalize_action in SQL."""
    clean = f"trim(upper({c}))"
    exact = "CASE " + clean + " " + " ".join(f"WHEN '{v}' THEN '{a}'" for v, a in ACTION_OF.items()) + " END"
    near = "CASE " + " ".join(f"WHEN contains({clean}, '{a}') OR contains('{a}', {clean}) THEN '{a}'" for a in CANONICAL_ACTIONS) + " END"
    return f"CASE WHEN {c} <> '' THEN coalesce({exact}, {near}) END"


def citation_sql(c: str) -> str:
    """normalize_citation in SQL, without abbreviations."""
    head, tail = rf"regexp_extract(trim({c}), '(?s)^(.*?\d{{4}})', 1)", rf"substr(trim({c}), length(regexp_extract(trim({c}), '(?s)^(.*?\d{{4}})', 1)) + 1)"
    for word, short in [("section", "s."), ("sections", "ss."), ("schedule", "Sch."), ("paragraph", "para."), ("paragraphs", "paras."), ("regulation", "reg."), ("regulations", "regs."), ("article", "art.")]:
        tail = rf"regexp_replace({tail}, '(?i)\b{word}\s+', '{short}', 'g')"
    return f"CASE WHEN {c} <> '' THEN trim(CASE WHEN {head} = '' THEN trim({c}) ELSE {head} || {tail} END) END"


def act_sql(c: str) -> str:
    """extract_act_name in SQL."""
    return rf"CASE WHEN {c} <> '' THEN trim(coalesce(nullif(regexp_extract({c}, '^(.*?(?:Act|Bill|Order|Regulations?|Rules?)\s+\d{{4}})', 1), ''), nullif(regexp_extract({c}, '^(\[\d{{4}}\]\s+\w+\s+\d+)', 1), ''), {c})) END"


_SOURCE = "list_value('uksc','ukpga','uksi','ewca')[{0} % 4 + 1] || '_' || (2020 + {0} % 5)::VARCHAR || '_' || ({0} % 8)::VARCHAR || '.xml_' || ({1} % 3)::VARCHAR"

CTE = {
    "t_raw": f"""SELECT event_id AS seq, {_SOURCE.format("user_id", "event_id")} AS source_id, 'Housing Act ' || (1980 + user_id % 10)::VARCHAR AS source_title,
        CASE event_type WHEN 'click' THEN 'cites' WHEN 'view' THEN ' Referred ' WHEN 'purchase' THEN 'AMENDED' WHEN 'signup' THEN 'inserting' ELSE 'unknown' END AS action,
        'Housing Act ' || (1980 + regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT % 10)::VARCHAR || ' section ' || (event_id % 4)::VARCHAR AS target_citation,
        (3 + event_id % 7) / 10.0::DOUBLE AS confidence, CASE WHEN event_id % 3 = 0 THEN 'detail ' || event_id::VARCHAR END AS detail_text,
        CASE WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m-%d') END AS effective_date, CASE WHEN event_id % 5 = 0 THEN 'ground_truth' END AS provenance FROM events""",
    "t_norm": f"SELECT * EXCLUDE (action, target_citation), {action_sql('action')} AS action_type, {citation_sql('target_citation')} AS target FROM t_raw",
    "t": f"SELECT seq, source_id, source_title, action_type, target, {act_sql('target')} AS act_name, confidence, detail_text AS detail, effective_date AS date, provenance FROM t_norm WHERE action_type IS NOT NULL AND length(target) >= 3",
    "edges": """SELECT source_id, action_type, target, round(1 - product(1 - coalesce(confidence, 1.0)), 6) AS confidence, count(*) AS times_seen,
        arg_max(detail, seq) FILTER (detail IS NOT NULL) AS detail, arg_max(date, seq) FILTER (date IS NOT NULL) AS date, arg_min(coalesce(provenance, 'llm_extracted'), seq) AS provenance FROM t GROUP BY ALL""",
    "chunks": """SELECT doc_id * 100000 + pos AS seq, doc_id, 'doc' || doc_id::VARCHAR || '.xml_' || pos::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'judgment' ELSE 'legislation' END AS source,
        'Document ' || doc_id::VARCHAR AS doc_title, pos::VARCHAR AS section, CASE pos % 4 WHEN 0 THEN '. . .' WHEN 1 THEN 'Heading ' || pos::VARCHAR END AS heading, CASE WHEN pos % 2 = 0 THEN 'Part 1' END AS part,
        'ACT: Document ' || doc_id::VARCHAR || ' | TEXT: ' || line AS content, line
        FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))""",
    "own_chunks": f"""SELECT o_orderkey AS seq, {_SOURCE.format("o_custkey", "o_orderkey")} AS id, 'Title ' || (o_custkey % 8)::VARCHAR AS doc_title, (o_orderkey % 3)::VARCHAR AS section,
        CASE WHEN o_orderkey % 2 = 0 THEN ' ... ' ELSE 'Heading ' || o_orderkey::VARCHAR END AS heading, CASE WHEN o_orderkey % 3 > 0 THEN 'Part ' || (o_orderkey % 7)::VARCHAR END AS part,
        'ACT: x | TEXT:  text of ' || o_orderkey::VARCHAR || ' ' AS content FROM orders""",
    "last_own": "SELECT id, arg_max(heading, seq) AS heading, arg_max(coalesce(part, chr(0)), seq) AS part, arg_max(content, seq) AS content FROM own_chunks GROUP BY id",
    "enriched": r"""SELECT t.*, CASE WHEN NOT regexp_full_match(c.heading, '[\s.]+') THEN c.heading END AS heading, nullif(c.part, chr(0)) AS part,
        nullif(trim(substr(c.content, instr(c.content, '| TEXT:') + 7)), '')[:500] AS content_snippet FROM t LEFT JOIN last_own c ON c.id = t.source_id""",
    "titles": """SELECT p_partkey, p_name || CASE p_type WHEN 'ECONOMY' THEN ' Road Traffic' WHEN 'SMALL' THEN ' Police Court' WHEN 'MEDIUM' THEN ' Gas Supply' WHEN 'PROMO' THEN ' Housing Tax' WHEN 'LARGE' THEN ' Soil' ELSE '' END AS title FROM part""",
    "e_li": """SELECT strftime(l_shipdate, '%Y%m%d')::BIGINT AS seq, l_suppkey::VARCHAR AS source_id, l_partkey::VARCHAR AS target, CASE l_returnflag WHEN 'R' THEN 'REPEALS' WHEN 'A' THEN 'AMENDS' ELSE 'CITES' END AS action_type,
        l_discount / 7.0::DOUBLE AS confidence, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem""",
    "titled": "SELECT DISTINCT source_id, source_title AS title, act_name, action_type FROM t",
}
NEEDS = {"t_norm": ["t_raw"], "t": ["t_norm"], "edges": ["t"], "last_own": ["own_chunks"], "enriched": ["t", "last_own"], "titled": ["t"]}


def sql_with(body: str, *names: str, recursive: bool = False) -> str:
    """body with the derived tables it names, and those that they need, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if order else body
