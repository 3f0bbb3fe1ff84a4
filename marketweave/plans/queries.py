"""Catalogue operators over the shared tables, with the same results as DuckDB SQL.

The lens: lineitem with part is a table of prices (entity = brand, seller = supplier, dimension = line
status, source = return flag), events one of metrics, documents one of descriptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.operators import boards, facts, history, joins, quality, reports, text, upserts
from marketweave.sources import rate_cards
from marketweave.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEY = ["entity", "seller", "dimension"]
SEQ = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_SEQ = ", ".join(SEQ)
_DESC = ", ".join(f"{c} DESC" for c in SEQ)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _WITH + sql
        return f

    return add


_WITH = """WITH prices AS (SELECT p_brand AS entity, l_suppkey AS seller, l_linestatus AS dimension, l_returnflag AS source,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS micros, CAST(l_shipdate AS DATE) AS taken_at, l.* FROM lineitem l JOIN part ON l_partkey = p_partkey),
metrics AS (SELECT event_type AS suite, user_id AS entity, value, floor(value / 50) AS step, CAST(ts AS DATE) AS taken_at, ts, event_id FROM events)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity")), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    return rows.withColumns({"seller": F.col("l_suppkey"), "dimension": F.col("l_linestatus"), "source": F.col("l_returnflag"), "micros": F.round(F.col("l_extendedprice") * 100).cast("long"), "taken_at": F.to_date("l_shipdate")})


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("suite"), F.col("user_id").alias("entity"), "value", F.floor(F.col("value") / 50).alias("step"), F.to_date("ts").alias("taken_at"), "ts", "event_id")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.rank_board(metrics(spark, sf_dir), "suite", "value", ["event_id"])


_RANKED = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY value DESC NULLS LAST, event_id) AS rank, count(*) OVER (PARTITION BY suite) AS out_of FROM metrics)
"""
_CURRENT = f""", m AS (SELECT *, max(taken_at) OVER (PARTITION BY entity, seller, dimension) AS newest FROM prices),
current AS (SELECT *, source = 'A' AND taken_at >= newest - INTERVAL 45 DAY AS own_page FROM m
  QUALIFY row_number() OVER (PARTITION BY entity, seller, dimension ORDER BY (source = 'A' AND taken_at >= newest - INTERVAL 45 DAY) DESC, taken_at DESC, {_DESC}) = 1)
"""


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.current_price(prices(spark, sf_dir), KEY, F.col("source") == "A", "taken_at", SEQ)


@query(_CURRENT + "SELECT entity, seller, dimension, micros, source, taken_at::DATE::VARCHAR AS taken_at, own_page FROM current")
def current_price(spark, sf_dir):
    return current(spark, sf_dir).select(*KEY, "micros", "source", F.col("taken_at").cast("string").alias("taken_at"), "own_page")


@query(_CURRENT + "SELECT entity, dimension, min(micros) AS lowest FROM current WHERE micros > 0 GROUP BY ALL")
def cheapest_rate(spark, sf_dir):
    return facts.cheapest(current(spark, sf_dir), ["entity", "dimension"], "micros")


@query(_CURRENT + "SELECT entity, min(micros) FILTER (dimension = 'O' AND micros > 0) AS first, min(micros) FILTER (dimension = 'F' AND micros > 0) AS second, (first + 3 * second) / 4 AS blended FROM current GROUP BY 1 HAVING first IS NOT NULL AND second IS NOT NULL")
def blended_cost(spark, sf_dir):
    return facts.blended(facts.unit_pair(current(spark, sf_dir), ["entity"], "dimension", "micros", "O", "F"))


@query(f"SELECT entity, seller, dimension, source, micros FROM prices QUALIFY row_number() OVER (PARTITION BY entity, seller, dimension, source ORDER BY taken_at DESC, {_DESC}) = 1")
def latest_per_source(spark, sf_dir):
    return history.latest(prices(spark, sf_dir), [*KEY, "source"], ["taken_at", *SEQ]).select(*KEY, "source", "micros")


@query("SELECT suite, entity, value, event_id FROM metrics QUALIFY row_number() OVER (PARTITION BY suite, entity ORDER BY ts DESC, event_id DESC) = 1")
def current_metric(spark, sf_dir):
    return history.latest(metrics(spark, sf_dir), ["suite", "entity"], ["ts", "event_id"]).select("suite", "entity", "value", "event_id")


@query(_RANKED + "SELECT suite, entity, taken_at::DATE::VARCHAR AS taken_at, rank, out_of, event_id FROM ranked QUALIFY row_number() OVER (PARTITION BY suite, entity ORDER BY taken_at DESC, rank NULLS LAST, event_id DESC) = 1")
def current_standing(spark, sf_dir):
    return history.current_standing(ranked(spark, sf_dir), ["suite", "entity"], "taken_at", "rank", ["event_id"]).select("suite", "entity", F.col("taken_at").cast("string").alias("taken_at"), "rank", "out_of", "event_id")


@query("SELECT suite, entity, step::BIGINT AS step, event_id FROM metrics WINDOW w AS (PARTITION BY suite, entity ORDER BY ts, event_id) QUALIFY lag(step) OVER w IS DISTINCT FROM step OR row_number() OVER w = 1")
def price_changes(spark, sf_dir):
    return history.changes(metrics(spark, sf_dir), ["suite", "entity"], ["ts", "event_id"], ["step"]).select("suite", "entity", "step", "event_id")


@query("SELECT suite, entity, step::BIGINT AS step, taken_at::DATE::VARCHAR AS taken_at, event_id FROM metrics WINDOW w AS (PARTITION BY suite, entity ORDER BY ts, event_id) QUALIFY lag(step) OVER w IS DISTINCT FROM step OR lag(metrics.taken_at) OVER w IS DISTINCT FROM metrics.taken_at OR row_number() OVER w = 1")
def standing_changes(spark, sf_dir):
    return history.changes(metrics(spark, sf_dir), ["suite", "entity"], ["ts", "event_id"], ["step", "taken_at"]).select("suite", "entity", "step", F.col("taken_at").cast("string").alias("taken_at"), "event_id")


@query(f", f AS (SELECT *, first_value(micros) OVER (PARTITION BY entity, seller, dimension ORDER BY taken_at, {_SEQ}) AS f FROM prices) SELECT entity, seller, dimension, any_value(f) AS micros, count(*) FILTER (micros <> f) AS clashes FROM f GROUP BY 1, 2, 3")
def first_writer_wins(spark, sf_dir):
    return history.first_writer(prices(spark, sf_dir), KEY, ["taken_at", *SEQ], "micros")


_HEARD = f""", heard AS (SELECT l_partkey, l_suppkey, l_returnflag, micros, taken_at, {", ".join(c for c in SEQ if c not in ("l_partkey", "l_suppkey", "l_returnflag"))} FROM prices
  QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY taken_at DESC, {_DESC}) = 1)
"""
_ORDER = ["taken_at", *(c for c in SEQ if c not in ("l_partkey", "l_suppkey", "l_returnflag"))]


@query(_HEARD + "SELECT l_partkey, l_suppkey, min(micros) AS low, max(micros) AS high, count(DISTINCT micros) AS figures, count(*) AS sources, max(micros) / nullif(min(micros), 0) AS ratio FROM heard GROUP BY 1, 2 HAVING count(DISTINCT micros) > 1")
def disputed_rates(spark, sf_dir):
    return history.disputed(prices(spark, sf_dir), ["l_partkey", "l_suppkey"], "l_returnflag", _ORDER, "micros")


@query(_HEARD + f", top AS (SELECT l_partkey, l_suppkey, micros FROM heard QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {', '.join(c + ' DESC' for c in _ORDER)}, micros DESC) = 1) SELECT t.l_partkey, t.l_suppkey, t.micros, count(*) AS spoke, count(*) FILTER (h.micros = t.micros) AS agreed FROM top t JOIN heard h USING (l_partkey, l_suppkey) GROUP BY 1, 2, 3")
def agreement(spark, sf_dir):
    return history.agreement(prices(spark, sf_dir), ["l_partkey", "l_suppkey"], "l_returnflag", _ORDER, "micros")


@query("SELECT l_orderkey, l_linenumber, any_value(micros) AS micros FROM prices GROUP BY 1, 2 HAVING count(DISTINCT micros) = 1")
def unambiguous_prices(spark, sf_dir):
    return history.unambiguous(prices(spark, sf_dir), ["l_orderkey", "l_linenumber"], "micros")


@query(", m AS (SELECT suite, avg(value) AS mean, count(*) AS n FROM metrics GROUP BY 1) SELECT event_id, suite, value, round(mean, 6) AS mean FROM metrics JOIN m USING (suite) WHERE n > 20 AND value > 1.5 * mean")
def outlier_rates(spark, sf_dir):
    return history.outliers(metrics(spark, sf_dir), ["suite"], "value", times=1.5).select("event_id", "suite", "value", F.round("mean", 6).alias("mean"))


@query(_RANKED + "SELECT suite, event_id, rank, out_of FROM ranked")
def rank_board(spark, sf_dir):
    return ranked(spark, sf_dir).select("suite", "event_id", "rank", "out_of")


@query(_RANKED + "SELECT suite, entity, rank, event_id FROM ranked QUALIFY row_number() OVER (PARTITION BY suite, entity ORDER BY rank) = 1")
def best_config(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("effort", F.when(F.col("event_id") % 2 == 0, "low").otherwise("high"))
    return boards.best_config(rows, ["suite", "entity"], "rank", "effort", ["low", "medium", "high"]).select("suite", "entity", "rank", "event_id")


@query(", n AS (SELECT source AS suite, lang AS metric, count(DISTINCT doc_id) AS entities FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT suite, metric, entities FROM n QUALIFY row_number() OVER (PARTITION BY suite ORDER BY entities DESC, metric) = 1")
def headline_metric(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("lang is not null").select(F.col("source").alias("suite"), F.col("lang").alias("metric"), F.col("doc_id").alias("entity"))
    return boards.headline_metric(docs, "suite", "metric", "entity")


@query(", p AS (SELECT suite, value, row_number() OVER (PARTITION BY suite ORDER BY value) AS k, count(*) OVER (PARTITION BY suite) AS n FROM metrics) SELECT suite, any_value(n) AS n, round((max(value) - max(value) FILTER (k = n - greatest(n // 10, 1))) / nullif(max(value) - min(value), 0), 6) AS spread, coalesce((max(value) - max(value) FILTER (k = n - greatest(n // 10, 1))) / nullif(max(value) - min(value), 0) >= 0.05 AND any_value(n) >= 8, false) AS separates FROM p GROUP BY 1")
def board_separates(spark, sf_dir):
    return boards.separates(metrics(spark, sf_dir), "suite", "value").withColumn("spread", F.round("spread", 6))


@query(_RANKED + ", s AS (SELECT *, 1 - (rank - 1) / (out_of - 1) AS share FROM ranked WHERE out_of > 1) SELECT entity, round(avg(share), 6) AS mean_share, count(*) AS boards, round(max(share), 6) AS best_share FROM s GROUP BY 1")
def percentile_standing(spark, sf_dir):
    out = boards.percentile_standing(ranked(spark, sf_dir), "entity", "suite", "rank", "out_of")
    return out.select("entity", F.round("mean_share", 6).alias("mean_share"), "boards", F.round("best_share", 6).alias("best_share"))


@query(_RANKED + "SELECT entity, round((out_of - rank) / (out_of - 1), 6) AS share, out_of, suite FROM ranked WHERE out_of > 1 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY (out_of - rank) / (out_of - 1) DESC, out_of DESC, suite DESC) = 1")
def best_standing(spark, sf_dir):
    return facts.best_standing(ranked(spark, sf_dir), "entity", "suite", "rank", "out_of").withColumn("share", F.round("share", 6))


@query("SELECT event_id, round(greatest(least((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) * 100, 100), 2), 6) AS bar FROM metrics WINDOW w AS (PARTITION BY suite)")
def score_bar(spark, sf_dir):
    return boards.score_bar(metrics(spark, sf_dir), "suite", "value").select("event_id", F.round("bar", 6).alias("bar"))


@query(", m AS (SELECT suite, bool_or(value > 1.5) AND bool_or(value <= 1) AS mixed FROM metrics GROUP BY 1) SELECT event_id, CASE WHEN mixed AND value <= 1 THEN round(value * 100, 3) ELSE value END AS value, mixed AND value <= 1 AS lifted FROM metrics JOIN m USING (suite)")
def mixed_scale_lift(spark, sf_dir):
    return boards.mixed_scale_lift(metrics(spark, sf_dir), "suite", "value").select("event_id", "value", "lifted")


@query("SELECT suite, value AS median FROM metrics QUALIFY row_number() OVER (PARTITION BY suite ORDER BY value) = count(*) OVER (PARTITION BY suite) // 2 + 1")
def upper_median(spark, sf_dir):
    return boards.upper_median(metrics(spark, sf_dir), ["suite"], "value")


@query("SELECT suite, event_id, value, row_number() OVER (PARTITION BY suite ORDER BY value DESC, event_id) AS place FROM metrics QUALIFY place <= 3")
def top3_per_category(spark, sf_dir):
    return boards.top_k(metrics(spark, sf_dir), ["suite"], [F.desc("value"), "event_id"], 3).select("suite", "event_id", "value", "place")


@query("SELECT entity, count(DISTINCT seller) AS sellers FROM prices GROUP BY 1 ORDER BY sellers DESC, entity LIMIT 40")
def widest_sold(spark, sf_dir):
    return prices(spark, sf_dir).groupBy("entity").agg(F.countDistinct("seller").alias("sellers")).orderBy(F.desc("sellers"), "entity").limit(40)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 20 OFFSET 20")
def hub_page(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey").offset(20).limit(20)


@query(_CURRENT + ", e AS (SELECT entity, dimension, count(DISTINCT seller) AS sellers, min((micros, seller)) AS low, max((micros, -seller)) AS high FROM current GROUP BY 1, 2) SELECT entity, dimension AS unit, sellers, low[1] AS low, low[2] AS cheapest, high[1] AS high, -high[2] AS dearest FROM e QUALIFY row_number() OVER (PARTITION BY entity ORDER BY sellers DESC, CASE dimension WHEN 'O' THEN 1 ELSE 2 END) = 1")
def dominant_unit(spark, sf_dir):
    return facts.dominant_unit(current(spark, sf_dir), "entity", "dimension", "seller", "micros", ["O", "F"])


@query(_CURRENT + "SELECT entity, seller, min(micros) AS low, max(micros) AS high, count(*) AS ways FROM current GROUP BY 1, 2")
def seller_queue(spark, sf_dir):
    return facts.seller_queue(current(spark, sf_dir), "entity", "seller", "micros")


@query("SELECT d.source, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no, count(*) FILTER (quality = 1) > count(*) FILTER (quality = 0) AS verdict FROM labels JOIN documents d USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (quality = 1) <> count(*) FILTER (quality = 0)")
def majority_vote(spark, sf_dir):
    votes = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("vote", F.col("quality") == 1)
    return facts.majority_vote(votes, ["source"], "vote")


@query(", n AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS spoke FROM n) SELECT source, lang, n, spoke::BIGINT AS spoke FROM t WHERE n * 2 > spoke")
def settle_fact(spark, sf_dir):
    return facts.strict_majority(read(spark, sf_dir, "documents"), ["source"], "lang")


@query(", n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, max(n) OVER (PARTITION BY l_suppkey) AS top FROM n) SELECT l_suppkey, n, min(l_returnflag) AS l_returnflag FROM t WHERE n = top GROUP BY 1, 2 HAVING count(*) = 1")
def brand_majority(spark, sf_dir):
    return facts.spelling_majority(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN ('STANDARD', 'SMALL') AND p_type IS NOT NULL GROUP BY 1")
def distinct_fields(spark, sf_dir):
    return facts.outside(read(spark, sf_dir, "part"), "p_type", ["STANDARD", "SMALL"])


@query("SELECT min(taken_at)::DATE::VARCHAR AS first, max(taken_at)::DATE::VARCHAR AS last FROM (SELECT taken_at FROM prices UNION ALL SELECT taken_at FROM metrics)")
def read_span(spark, sf_dir):
    return prices(spark, sf_dir).select("taken_at").union(metrics(spark, sf_dir).select("taken_at")).agg(F.min("taken_at").cast("string").alias("first"), F.max("taken_at").cast("string").alias("last"))


@query("SELECT c_mktsegment, sum(r)::BIGINT AS total FROM (SELECT DISTINCT c_mktsegment, c_custkey, CAST(round(o_totalprice / 1000) AS BIGINT) AS r FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def rounds_total(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "c_custkey", F.round(F.col("o_totalprice") / 1000).cast("long").alias("r")).distinct()
    return rows.groupBy("c_mktsegment").agg(F.sum("r").alias("total"))


@query("SELECT w AS task, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def explode_count(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("task")).groupBy("task").agg(F.count("*").alias("n"))


@query(", s AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE))::VARCHAR AS first_seen, max(CAST(o_orderdate AS DATE))::VARCHAR AS last_seen FROM orders GROUP BY 1) SELECT * FROM s")
def upsert_sighting(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("first_seen"), F.to_date("o_orderdate").alias("last_seen"))
    seen = upserts.upsert_sighting(o.where("first_seen < '1997-01-01'"), o.where("first_seen >= '1997-01-01'"), ["o_custkey"])
    return seen.select("o_custkey", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def upsert_rows(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return upserts.upsert(s, s.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"])


@query(", old AS (SELECT * FROM metrics WHERE event_id % 2 = 0), tail AS (SELECT suite, entity, step FROM old QUALIFY row_number() OVER (PARTITION BY suite, entity ORDER BY ts DESC, event_id DESC) = 1) SELECT n.event_id, n.suite, n.entity, n.step::BIGINT AS step FROM metrics n LEFT JOIN tail t ON n.suite = t.suite AND n.entity = t.entity WHERE n.event_id % 2 = 1 AND (t.suite IS NULL OR n.step IS DISTINCT FROM t.step)")
def append_if_changed(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return upserts.append_if_changed(m.where("event_id % 2 = 0"), m.where("event_id % 2 = 1"), ["suite", "entity"], ["ts", "event_id"], "step").select("event_id", "suite", "entity", "step")


@query("SELECT event_id, suite FROM metrics WHERE suite <> 'click' UNION ALL SELECT event_id, suite FROM metrics WHERE suite = 'click' AND event_id % 2 = 0")
def replace_partition(spark, sf_dir):
    m = metrics(spark, sf_dir).select("event_id", "suite")
    return upserts.replace_by_key(m, m.where("suite = 'click' and event_id % 2 = 0"), ["suite"])


@query("SELECT s_suppkey, s_name FROM supplier")
def insert_if_absent(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return upserts.insert_if_absent(s.where("s_suppkey % 2 = 0"), s, ["s_suppkey"])


@query("SELECT doc_id, source FROM documents WHERE NOT (source IN ('src1', 'src2') AND doc_id % 3 <> 0) OR source IS NULL")
def prune_queue(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return upserts.prune(d, d.where("source in ('src1', 'src2') and doc_id % 3 = 0"), "source", ["doc_id"])


@query("SELECT event_id FROM metrics WHERE taken_at >= (SELECT max(taken_at) FROM metrics) - INTERVAL 10 DAY")
def expire_rows(spark, sf_dir):
    m = metrics(spark, sf_dir)
    return upserts.expire(m.join(F.broadcast(m.agg(F.max("taken_at").alias("today")))), "taken_at", F.col("today"), 10).select("event_id")


@query(", o AS (SELECT entity, seller, max(taken_at) AS last FROM prices GROUP BY 1, 2), t AS (SELECT max(last) AS today FROM o), w AS (SELECT seller, max(last) AS seen FROM o GROUP BY 1) SELECT entity, o.seller, CASE WHEN last < today - INTERVAL 60 DAY AND seen >= today - INTERVAL 40 DAY THEN 'stale' ELSE 'live' END AS status FROM o JOIN w USING (seller), t")
def retire_offerings(spark, sf_dir):
    o = prices(spark, sf_dir).groupBy("entity", "seller").agg(F.max("taken_at").alias("last"))
    o = o.join(F.broadcast(o.agg(F.max("last").alias("today"))))
    return upserts.retire(o, ["seller"], "last", F.col("today"), 60, 40).select("entity", "seller", "status")


@query("SELECT regexp_replace(replace(lower(p_name), '+', 'plus'), '[^a-z0-9]', '', 'g') AS form, count(DISTINCT p_partkey) AS n_claims, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING form <> ''")
def key_index(spark, sf_dir):
    return joins.key_index(read(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) GROUP BY 1")
def unresolved_report(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    return joins.unresolved(read(spark, sf_dir, "customer"), s, "c_nationkey")


@query(_CURRENT + ", s AS (SELECT entity, seller, list_sort(list(DISTINCT (dimension, micros // 1000000))) AS r FROM current GROUP BY 1, 2), f AS (SELECT entity, r, min(seller) AS first FROM s GROUP BY 1, 2) SELECT s.entity, first, seller FROM s JOIN f ON s.entity = f.entity AND s.r = f.r WHERE seller > first")
def twin_offerings(spark, sf_dir):
    rows = current(spark, sf_dir).withColumn("micros", F.expr("micros div 1000000"))
    return joins.twins(rows, "seller", ["entity"], "dimension", "micros")


@query("SELECT entity FROM prices GROUP BY 1 HAVING NOT bool_or(l_suppkey % 10 = 0 AND l_quantity > 49 AND l_discount > 0.09)")
def only_unvetted(spark, sf_dir):
    return joins.only_unvetted(prices(spark, sf_dir).withColumn("vetted", F.expr("l_suppkey % 10 = 0 and l_quantity > 49 and l_discount > 0.09")), "entity", "vetted")


@query("SELECT p_name, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1 HAVING n > 1")
def one_name_two_entities(spark, sf_dir):
    return quality.claimed_twice(read(spark, sf_dir, "part"), ["p_name"], "p_partkey")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def orphans(spark, sf_dir):
    return quality.orphans(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").where("p_size > 10"), "l_partkey", "p_partkey").select("l_orderkey", "l_partkey")


_TITLE = "trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1))"


@query(rf""", p AS (SELECT url, coalesce(html, '') AS h, {_TITLE} AS title, regexp_extract(coalesce(html, ''), '(?is)<meta\s[^>]*name="description"[^>]*content="([^"]*)"', 1) AS d FROM pages)
SELECT rule, count(*) AS pages FROM (
SELECT 'no title' AS rule FROM p WHERE title = '' UNION ALL SELECT 'no description' FROM p WHERE d = ''
UNION ALL SELECT 'no canonical address' FROM p WHERE NOT regexp_matches(h, '(?i)<link\s[^>]*rel="canonical"')
UNION ALL SELECT 'canonical address of another page' FROM p WHERE regexp_extract(h, '(?is)<link\s[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) <> '' AND NOT ends_with(regexp_extract(h, '(?is)<link\s[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1))
UNION ALL SELECT 'not exactly one h1' FROM p WHERE len(regexp_extract_all(h, '(?i)<h1[\s>]')) <> 1
UNION ALL SELECT 'escaped markup' FROM p WHERE regexp_matches(h, '&lt;(span|div|a|b|p)\b')
UNION ALL SELECT 'empty heading' FROM p WHERE regexp_matches(h, '(?i)<h[1-6][^>]*>\s*</h[1-6]>')
UNION ALL SELECT 'long title' FROM p WHERE length(title) > 70
UNION ALL SELECT 'short or long description' FROM p WHERE d <> '' AND (length(d) < 60 OR length(d) > 320)
UNION ALL SELECT 'heavy page' FROM p WHERE octet_length(encode(h)) > 60000) GROUP BY 1""")
def page_audit(spark, sf_dir):
    return quality.audit_pages(read(spark, sf_dir, "pages")).groupBy("rule").agg(F.count("*").alias("pages"))


@query(f"SELECT {_TITLE} AS title, count(*) AS pages FROM pages GROUP BY 1 HAVING title <> '' AND count(*) > 1")
def repeated_titles(spark, sf_dir):
    return quality.repeated_titles(read(spark, sf_dir, "pages"))


@query("""SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(html, ''), 'href="(/[^"#?]*)', 1)) AS target FROM pages) GROUP BY 1""")
def link_counts(spark, sf_dir):
    return quality.links(read(spark, sf_dir, "pages")).groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '\\.\\s+', '.' || chr(1), 'g'), chr(1))) AS n FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


@query(", q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0) SELECT query, vec_id, score, place FROM (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS place FROM q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id) WHERE place <= 5")
def cosine_topk(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return text.cosine_topk(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", "label", 5)


@query(", q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0) SELECT query, vec_id, score, place FROM (SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS place FROM q JOIN embeddings e ON q.vec_id <> e.vec_id) WHERE place <= 5")
def cosine_topk_all(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return text.cosine_topk(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", None, 5)


@query("SELECT page_id, array_to_string(list_reverse(list_reverse(string_split(lower(string_split(regexp_replace(url, '^(https?://)*(www\\.)*', ''), '/')[1]), '.'))[1:2]), '.') AS host FROM pages WHERE url IS NOT NULL")
def host_of(spark, sf_dir):
    return read(spark, sf_dir, "pages").where("url is not null").select("page_id", X.host_of(F.col("url")).alias("host"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(replace(replace(lower(p_brand || ' & ' || p_name), '+', 'plus'), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN p_size < 3 THEN 'nano' WHEN p_size < 10 THEN 'xs' WHEN p_size < 30 THEN 's' WHEN p_size < 100 THEN 'm' ELSE 'l' END AS band, round(p_size * 0.65 + 1, 1) AS gb FROM part")
def slugs_and_bands(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat_ws(" & ", "p_brand", "p_name")).alias("slug"), X.size_band(F.col("p_size")).alias("band"), X.memory_gb(F.col("p_size").cast("double")).alias("gb"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((CAST(l_quantity AS HUGEINT) * CAST(round(l_extendedprice * 100) AS HUGEINT) + 500000) // 1000000) AS BIGINT) AS cost FROM lineitem")
def cost_micros(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", X.cost_micros(F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cost"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: lower(regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'))), lambda x: regexp_matches(x, '[0-9@]')))), ' ') AS identifiers FROM documents WHERE text IS NOT NULL")
def identifiers(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(X.extract_identifiers(F.col("text")), " ").alias("identifiers"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def set_operations(spark, sf_dir):
    keys = read(spark, sf_dir, "nation").select("n_nationkey")
    bought = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return keys.intersect(bought).subtract(read(spark, sf_dir, "supplier").where("s_acctbal > 7000").select(F.col("s_nationkey").alias("n_nationkey")))


@query("SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT CASE WHEN s_acctbal < 0 THEN s_suppkey END) AS in_debt FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def coverage_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(read(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("nations"), F.countDistinct("s_suppkey").alias("suppliers"), F.countDistinct(F.when(F.col("s_acctbal") < 0, F.col("s_suppkey"))).alias("in_debt"))


def by_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current prices with the seller in the part of the entity, which also stands on boards."""
    return current(spark, sf_dir).select(F.col("entity").alias("brand"), F.col("seller").alias("entity"), "dimension", "micros", "taken_at")


@query(
    _CURRENT
    + _RANKED
    + """SELECT p.seller AS entity, lead_rate, out_rate, dearest, sellers, freshest, best_place, coalesce(boards, 0) AS boards FROM
  (SELECT seller, min(micros) FILTER (dimension = 'O') AS lead_rate, min(micros) FILTER (dimension = 'F') AS out_rate, max(micros) AS dearest, count(DISTINCT entity) AS sellers, max(taken_at)::DATE::VARCHAR AS freshest FROM current WHERE micros > 0 GROUP BY 1) p
  LEFT JOIN (SELECT entity, min(rank) AS best_place, count(DISTINCT suite) AS boards FROM ranked WHERE out_of > 1 GROUP BY 1) r ON r.entity = p.seller"""
)
def find_index(spark, sf_dir):
    found = reports.find_index(by_seller(spark, sf_dir), ranked(spark, sf_dir), "entity", "brand", "dimension", "micros", "taken_at", "O", "F")
    return found.withColumn("freshest", F.col("freshest").cast("string"))


@query("""SELECT suite, entity, value, lifted, round(greatest(least(coalesce((value - min(value) OVER s) / nullif(max(value) OVER s - min(value) OVER s, 0), 1) * 100, 100), 2), 6) AS bar,
  row_number() OVER (PARTITION BY suite ORDER BY value DESC NULLS LAST, entity) AS rank, count(*) OVER s AS out_of
FROM (SELECT suite, entity, CASE WHEN lifted THEN round(value * 100, 3) ELSE value END AS value, lifted FROM
  (SELECT *, max(value) OVER (PARTITION BY suite) > 1.5 AND min(value) OVER (PARTITION BY suite) <= 1 AND value <= 1 AS lifted FROM
    (SELECT suite, entity, value FROM metrics QUALIFY row_number() OVER (PARTITION BY suite, entity ORDER BY ts DESC, event_id DESC) = 1)))
WINDOW s AS (PARTITION BY suite)""")
def board_report(spark, sf_dir):
    found = reports.board_report(current_metric(spark, sf_dir).drop("event_id"), "suite", "entity", "value")
    return found.select("suite", "entity", "value", "lifted", F.round("bar", 6).alias("bar"), "rank", "out_of")


@query("SELECT key, max(d)::DATE::VARCHAR AS newest FROM (SELECT seller AS key, max(taken_at) AS d FROM prices GROUP BY 1 UNION ALL SELECT entity, max(taken_at) FROM metrics GROUP BY 1) GROUP BY 1")
def address_dates(spark, sf_dir):
    found = reports.newest_dates([(prices(spark, sf_dir), "seller", "taken_at"), (metrics(spark, sf_dir), "entity", "taken_at")])
    return found.withColumn("newest", F.col("newest").cast("string"))


@query("""SELECT alias, '' AS variant, dimension, micros FROM (
  SELECT l_orderkey || '-' || l_linenumber AS alias, unnest(['mtok_in', 'mtok_out', 'mtok_cache_read']) AS dimension,
    unnest([CAST(round(l_discount::DOUBLE * 1e6) AS BIGINT), CAST(round(l_tax::DOUBLE * 1e6) AS BIGINT), CAST(round(l_quantity::DOUBLE * 1e6) AS BIGINT)]) AS micros FROM lineitem) WHERE micros > 0""")
def rate_card(spark, sf_dir):
    rates = F.struct(F.col("l_discount").cast("double").alias("prompt"), F.col("l_tax").cast("double").alias("completion"), F.col("l_quantity").cast("double").alias("input_cache_read"))
    model = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), rates.alias("pricing"))
    bodies = read(spark, sf_dir, "lineitem").select(F.to_json(F.struct(F.array(model).alias("data"))).alias("body"))
    return rate_cards.unpivot(rate_cards.flatten_rate_card(bodies, rate_cards.CARDS["chutes"])).drop("payload")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that the table may be one file
    return e.select(F.col("event_type").alias("suite"), F.col("user_id").alias("entity"), F.floor(F.col("value") / 50).alias("step"), "ts", "event_id")


@query("SELECT suite, entity, step::BIGINT AS step, event_id FROM metrics WINDOW w AS (PARTITION BY suite, entity ORDER BY ts, event_id) QUALIFY lag(step) OVER w IS DISTINCT FROM step OR row_number() OVER w = 1")
def change_capture_stream(spark, sf_dir):
    return changes.capture_changes(event_stream(spark, sf_dir), "changes", ["suite", "entity"], ["ts", "event_id"], ["step"]).drop("ts")


@query("SELECT DISTINCT sha256(suite || ' ' || entity || ' ' || step::BIGINT) AS hash FROM metrics")
def evidence_stream(spark, sf_dir):
    quotes = event_stream(spark, sf_dir).select(F.concat_ws(" ", "suite", "entity", "step").alias("quote"), F.to_timestamp("ts").alias("at"))
    return changes.drain(changes.evidence(quotes, "quote", "at", "400 days"), "evidence").select("hash")
