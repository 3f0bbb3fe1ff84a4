"""A market catalogue seen through the shared tables: one SQL text a table, read by Spark and DuckDB alike.

Faults are part of it (dangling keys, repeated names, words outside the vocabulary), by the remainder of a
key, so that every check has something to find and something to pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketweave.functions.scratch import written

TABLES: dict[str, str] = {
    "providers": """SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 25 = 3 THEN 'SUPPLIER ' || (s_suppkey - 1) ELSE 'Supplier ' || s_suppkey END AS name,
  CASE WHEN s_suppkey % 40 = 39 THEN 'shop' WHEN s_suppkey % 5 = 0 THEN 'aggregator' WHEN s_suppkey % 5 = 1 THEN 'cloud' WHEN s_suppkey % 5 = 2 THEN 'fund' ELSE 'vendor' END AS kind,
  'https://www.s' || s_suppkey || '.com' AS url, CAST(floor(s_acctbal) AS BIGINT) AS raised, s_nationkey AS nation FROM {supplier}
UNION ALL SELECT 'n' || n_nationkey, 'Idle ' || n_name, 'vendor', 'https://www.n' || n_nationkey || '.com', CAST(0 AS BIGINT), n_nationkey FROM {nation}""",
    "entities": """SELECT 'e' || p_partkey AS id,
  CASE WHEN p_partkey % 50 = 7 THEN 'bundle' WHEN p_partkey % 10 = 1 THEN 'subscription' WHEN p_partkey % 10 = 2 THEN 'tool' WHEN p_partkey % 10 = 3 THEN 'agent' ELSE 'model' END AS register,
  CASE WHEN p_partkey % 199 = 3 THEN '混元' WHEN p_partkey % 97 = 5 THEN 'vendor/' || p_name || ' ' || p_partkey WHEN p_partkey % 89 = 4 THEN p_name || ': ' || p_partkey
       WHEN p_partkey % 83 = 9 THEN ' ' || p_name || ' ' || p_partkey WHEN p_partkey % 31 = 2 THEN upper(p_name) || ' ' || (p_partkey % 40) ELSE p_name || ' ' || (p_partkey % 250) || CASE WHEN p_partkey % 7 = 0 THEN '-TEE' ELSE '' END END AS name,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 61 = 1 THEN 's' || (1000000 + p_partkey) ELSE 's' || (p_partkey % 10) END AS maker,
  CASE WHEN p_partkey % 10 = 1 THEN 'e' || (p_partkey + CASE WHEN p_partkey % 30 = 1 THEN 10000000 ELSE 3 END) END AS derived_from,
  CASE p_size % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'text + image' WHEN 2 THEN 'audio' ELSE 'a sound' END AS input_kind,
  CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'text + code' WHEN 3 THEN 'audio' ELSE 'video' END AS output_kind,
  CASE p_partkey % 6 WHEN 0 THEN 'chat' WHEN 1 THEN 'image' WHEN 2 THEN 'code,reasoning' WHEN 3 THEN 'speak,music' WHEN 4 THEN 'video' END AS tasks,
  CASE p_size % 6 WHEN 0 THEN 'mit' WHEN 1 THEN 'apache-2.0' WHEN 2 THEN 'proprietary' WHEN 3 THEN 'CC-BY-NC-4.0' WHEN 4 THEN 'llama3' END AS license,
  p_size % 4 = 2 OR p_size % 6 < 2 AS open_weights,
  CASE WHEN p_partkey % 8 <> 0 THEN '20' || (20 + p_size % 5) || '-06-01' END AS released, CASE WHEN p_partkey % 9 <> 0 THEN '20' || (19 + p_partkey % 5) || '-01-01' END AS knowledge,
  CASE WHEN p_size % 7 <> 0 THEN CAST(p_size * p_size AS DOUBLE) / 2 END AS params, CASE WHEN p_partkey % 4 <> 1 THEN 'some a day' ELSE '' END AS limits,
  CASE WHEN p_partkey % 70 = 2 THEN 'licenze' WHEN p_partkey % 70 = 3 THEN 'colour' ELSE 'license' END AS attribute, p_brand AS family, p_size AS size FROM {part}
UNION ALL SELECT 'v' || p_partkey, 'model', p_name || ' ' || (p_partkey % 250) || ' Preview', 's1', NULL, 'text', 'text', 'chat', 'mit', true, NULL, NULL, NULL, '', 'license', p_brand, p_size FROM {part} WHERE p_partkey % 47 = 11""",
    "aliases": """SELECT 'feed' || (p_partkey % 3) AS source, CASE WHEN p_partkey % 3 = 0 THEN 'vendor/' || replace(lower(p_name), ' ', '-') ELSE p_name || ' ' || p_partkey END
  || CASE p_partkey % 11 WHEN 0 THEN ':batch' WHEN 1 THEN '-fast' ELSE '' END AS alias, 'e' || CASE WHEN p_partkey % 57 = 2 THEN 10000000 + p_partkey ELSE p_partkey END AS entity_id FROM {part}
UNION ALL SELECT 'feed9', p_name || ' ' || (p_partkey % 250) || '-Preview', 'e' || p_partkey FROM {part} WHERE p_partkey % 47 = 11""",
    "offerings": """SELECT l_partkey * 100000 + l_suppkey AS id, 'e' || CASE WHEN l_partkey % 333 = 1 THEN 10000000 + l_partkey ELSE l_partkey END AS entity_id, 's' || l_suppkey AS provider_id,
  CASE WHEN l_suppkey % 47 = 5 THEN 'barter' WHEN l_suppkey % 4 = 0 THEN 'api' WHEN l_suppkey % 4 = 1 THEN 'aggregator' WHEN l_suppkey % 4 = 2 THEN 'cloud' ELSE 'local' END AS way,
  CASE (l_partkey + l_suppkey) % 9 WHEN 0 THEN 'free' WHEN 1 THEN 'batch' ELSE '' END AS variant, CASE (l_partkey + l_suppkey) % 7 WHEN 0 THEN 'stale' ELSE 'live' END AS status,
  CASE WHEN l_partkey % 2 = 0 THEN 'rpd' ELSE '' END AS allowance, CAST(l_partkey % 90 AS BIGINT) AS rpd, min(CAST(l_shipdate AS DATE)) AS first_seen, max(CAST(l_shipdate AS DATE)) AS last_seen FROM {lineitem} GROUP BY l_partkey, l_suppkey
UNION ALL SELECT -p_partkey, 'e' || p_partkey, 's1', 'api', '', 'live', '', CAST(0 AS BIGINT), DATE '1996-01-01', DATE '1996-01-01' FROM {part} WHERE p_partkey % 40 = 9""",
    "prices": """SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey * 100000 + l_suppkey AS offering_id, CASE l_linestatus WHEN 'O' THEN 'mtok_in' ELSE 'mtok_out' END AS dimension,
  CAST(round(CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN 0 WHEN l_quantity = 49 AND l_tax = 0 THEN l_extendedprice * 40000 ELSE l_extendedprice * 20 END) AS BIGINT) AS micros,
  CASE l_returnflag WHEN 'A' THEN 'https://docs.s' || l_suppkey || '.com/rates' WHEN 'N' THEN 'https://feed.org/a' ELSE 'https://list.net/b' END AS source_url, CAST(l_shipdate AS DATE) AS taken_at FROM {lineitem}""",
    "benchmarks": """SELECT event_id AS seq, 'e' || user_id AS entity_id, event_type AS suite, CASE WHEN event_id % 7 = 0 THEN 'score of all' ELSE 'score' END AS metric, round(value / 10) AS value,
  CASE WHEN event_id % 17 <> 0 THEN 1 + event_id % 100 END AS rank, CASE WHEN event_id % 19 <> 0 THEN CAST(100 AS BIGINT) END AS out_of, CAST(ts AS DATE) AS taken_at FROM {events}""",
    "suites": """SELECT event_type AS id, 'The ' || event_type || ' board' AS name, CASE WHEN event_type = 'click' THEN '' ELSE 'Lab' END AS measurer, 'https://boards.org/' || event_type AS url,
  event_type = 'error' AS lower_is_better FROM {events} GROUP BY event_type""",
    "docs": """SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN 'e' || (doc_id % 700) ELSE 's' || (doc_id % 90) END AS subject, CASE WHEN doc_id % 5 = 0 THEN 'article' ELSE 'description' END AS kind,
  text, CASE WHEN doc_id % 3 = 0 THEN 'https://www.s' || (doc_id % 10) || '.com/about' ELSE 'https://pedia.org/' || doc_id END AS source_url,
  '2024-0' || (1 + doc_id % 9) || '-11' AS taken_at FROM {documents}""",
    "investments": """SELECT DISTINCT 's' || (c_custkey % 60) AS fund_id, 's' || c_nationkey AS company_id FROM {customer}""",
    "candidates": """SELECT 'e' || CASE WHEN p_partkey % 40 = 6 THEN p_partkey ELSE 10000000 + p_partkey END AS id, CASE WHEN p_size % 3 = 0 THEN 'company' ELSE 'model' END AS kind, p_name AS name,
  CASE p_size % 2 WHEN 0 THEN 'unvetted seller' ELSE 'no maker' END AS why, CAST(p_size AS BIGINT) AS sellers FROM {part}""",
    "sessions": """SELECT conv_id, turn, role, text FROM {conversations}""",
}
_BASE = ("supplier", "part", "lineitem", "events", "documents", "customer", "conversations", "nation")

#: The same tables for DuckDB, to begin a query with.
LENS_SQL = "WITH " + ",\n".join(f"{name} AS ({sql.format(**{b: b for b in _BASE})})" for name, sql in TABLES.items()) + "\n"


class Catalogue:
    """The lens over one folder of shared tables; a table is planned when it is asked for, and reads only the columns that are used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def keep(self, *names: str, **columns: tuple[str, ...]) -> Catalogue:
        """The same catalogue with these tables written, for what reads a derived one many times; columns names those with only some of their columns."""
        for name in names:
            setattr(self, name, written(getattr(self, name), name))
        for name, some in columns.items():
            setattr(self, name, written(getattr(self, name).select(*some), name))
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        used = {b: self.spark.read.parquet(f"{self.sf_dir}/{b}.parquet") for b in _BASE if "{" + b + "}" in TABLES[name]}
        return self.spark.sql(TABLES[name], **used)
