"""Queries of how things enter the catalogue that the lens shows, and of its upkeep, each with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions.patch import merge_patch
from marketweave.functions.scratch import scratch_root, written
from marketweave.operators import entries, tags, upkeep
from marketweave.plans.lens import LENS_SQL, Catalogue
from marketweave.streaming import delivery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of the catalogue under its name, with its SQL."""

    def add(f: Callable[[Catalogue], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        ORACLE_SQL[f.__name__] = LENS_SQL + sql
        return f

    return add


def _seen_as(t, sql: str) -> DataFrame:
    """A part of a query that both engines read, over the shared tables."""
    return t.spark.sql(sql, **{b: t.spark.read.parquet(f"{t.sf_dir}/{b}.parquet") for b in ("part", "supplier", "customer", "lineitem", "events") if "{" + b + "}" in sql})


def _own(sql: str) -> str:
    return sql.format(**{b: b for b in ("part", "supplier", "customer", "lineitem", "events")})


_QUEUE = """SELECT 'feed' || (p_partkey % 2) AS source, CASE p_partkey % 6 WHEN 0 THEN 'meta-llama/' || p_name || ' ' || (p_partkey % 90) WHEN 1 THEN 'Org ' || (p_partkey % 7) || '/x/' || p_name || '_' || (p_partkey % 90) WHEN 2 THEN '/' || p_name WHEN 3 THEN 'lab/--' || p_partkey % 3 || '.' WHEN 4 THEN 'odd/!' || repeat('!', p_partkey % 30) ELSE p_name || ' ' || p_partkey END AS alias,
  CASE p_size % 4 WHEN 0 THEN '{{"name":"N ' || p_size || '","kind":"text-to-image","context_length":' || p_size || '}}' WHEN 1 THEN '{{"input_modalities":["text","image"],"output_modalities":["audio"],"context_length":0}}' WHEN 2 THEN '{{"name":"","input_modalities":["text"]}}' ELSE 'no json' END AS payload FROM {part}"""
_HELD = "SELECT DISTINCT 'ent_' || replace(p_name, ' ', '-') || '-' || (p_partkey % 90) AS id FROM {part} WHERE p_partkey % 4 = 0"
_SLUG = lambda c: f"trim(lower(regexp_replace({c}, '[^A-Za-z0-9.]+', '-', 'g')), '-.')"
_ABSORB = f""", queue AS ({_own(_QUEUE)}), held AS ({_own(_HELD)}),
q AS (SELECT alias, min(payload) AS payload, string_split(alias, '/')[-1] AS last, CASE WHEN contains(alias, '/') THEN nullif(string_split(alias, '/')[1], '') END AS org FROM queue WHERE source = 'feed0' GROUP BY 1),
r AS (SELECT *, 'ent_' || {_SLUG('last')} AS id, CASE org WHEN 'meta-llama' THEN 'prov_meta' ELSE 'prov_' || {_SLUG('org')} END AS maker, CASE WHEN payload = 'no json' THEN NULL ELSE payload::JSON END AS j FROM q),
minted AS (SELECT * FROM r WHERE id <> 'ent_' AND id NOT IN (SELECT id FROM held) QUALIFY row_number() OVER (PARTITION BY id ORDER BY alias) = 1)
"""


@query(_ABSORB + """SELECT id, coalesce(nullif(j->>'name', ''), last) AS name, maker, CASE WHEN len(j->'$.input_modalities[*]') > 0 AND len(j->'$.output_modalities[*]') > 0 THEN 'text + image' ELSE 'text' END AS input_kind,
  CASE WHEN len(j->'$.output_modalities[*]') > 0 THEN 'audio' WHEN j->>'kind' = 'text-to-image' THEN 'image' ELSE 'text' END AS output_kind, CASE WHEN (j->>'context_length')::BIGINT > 0 THEN '{"context":' || (j->>'context_length') || '}' ELSE '{}' END AS attrs FROM minted""")
def absorb_minted(t):
    """What a queue mints: an id once, whichever task sees it."""
    return entries.absorb_queue(_seen_as(t, _QUEUE), _seen_as(t, _HELD), t.providers, "feed0")["entities"].drop("register")


@query(_ABSORB + """, bound AS (SELECT alias, id FROM r WHERE id <> 'ent_')
SELECT 'first' AS run, (SELECT count(*) FROM minted) AS minted, (SELECT count(*) FROM bound) AS bound, (SELECT count(DISTINCT maker) FROM minted WHERE org IS NOT NULL AND org <> 'meta-llama') AS opened, (SELECT count(*) FROM r WHERE id = 'ent_') AS skipped
UNION ALL SELECT 'again', 0, (SELECT count(*) FROM bound), 0, (SELECT count(*) FROM r WHERE id = 'ent_')""")
def absorb_counters(t):
    """The counters of a run, and of the same run repeated on what the first one left: it mints and opens nothing."""
    queue, held = _seen_as(t, _QUEUE), _seen_as(t, _HELD)
    first = entries.absorb_queue(queue, held, t.providers, "feed0")
    again = entries.absorb_queue(queue, held.union(first["entities"].select("id")), t.providers.select("id").union(first["providers"].select("id")), "feed0")
    return first["counters"].withColumn("run", F.lit("first")).union(again["counters"].withColumn("run", F.lit("again")))


_BLOB = """SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN '{{"architecture":{{"input_modalities":["Text","PDF","img","smell"],"output_modalities":["speech"]}},"context_length":' || p_size || '}}'
  WHEN 1 THEN '{{"modalities":{{"input":["image","img","text"],"output":[]}},"limit":{{"context":' || (p_size * 2) || '}},"open_weights":true}}' WHEN 2 THEN '{{"release_date":"2024-05-06T07:08","open_weights":false,"context_length":0}}' WHEN 3 THEN '{{"modalities":{{"output":["embedding","text"]}}}}' ELSE '{{}}' END AS blob FROM {part}"""


@query(f""", b AS ({_own(_BLOB)}) SELECT id, CASE size % 5 WHEN 0 THEN 'text + file + image' WHEN 1 THEN 'image + text' ELSE 'text' END AS input_kind, CASE size % 5 WHEN 0 THEN 'audio' WHEN 3 THEN 'embedding + text' ELSE 'text' END AS output_kind,
  CASE size % 5 WHEN 0 THEN nullif(size, 0) WHEN 1 THEN size * 2 END::BIGINT AS context, CASE WHEN size % 5 = 1 THEN true END AS open_weights, CASE WHEN size % 5 = 2 THEN '2024-05-06' END AS released FROM b JOIN (SELECT p_partkey AS id, p_size AS size FROM part) USING (id)""")
def new_model_facts(t):
    return entries.new_model_facts(_seen_as(t, _BLOB)).drop("blob")


_PATCH = """SELECT p_partkey AS id, '{{"family":"' || p_brand || '","size":' || p_size || ',"facts":{{"license":"mit","context":' || p_partkey || ',"old":[1,2]}},"tags":["a","b"]}}' AS attrs,
  CASE p_partkey % 6 WHEN 0 THEN '{{"facts":{{"context":null,"max":{{"in":' || p_size || ',"out":null}}}}}}' WHEN 1 THEN '{{"tags":["c"],"size":null,"none":null}}' WHEN 2 THEN '{{"family":{{"x":{{"y":null,"z":1.5}}}}}}' WHEN 3 THEN '[1]' WHEN 4 THEN '{{}}' ELSE '{{"facts":7,"é":"ü"}}' END AS patch FROM {part}"""


@query(f""", p AS ({_own(_PATCH)}), m AS (SELECT id, json_merge_patch(attrs::JSON, patch::JSON) AS j FROM p)
SELECT id, j->>'family' AS family, j->>'size' AS size, (j->'facts')->>'license' AS license, (j->'facts')->>'context' AS context, ((j->'facts')->'max')->>'in' AS most, (((j->'family')->'x')->>'z') AS z, j->>'é' AS other,
  array_to_string(list_sort(coalesce(json_keys(j), [])), ',') AS members, array_to_string(list_sort(coalesce(json_keys(j, '$.facts'), [])), ',') AS facts, json_type(j) = 'ARRAY' AS replaced FROM m""")
def edit_attributes(t):
    """Open-ended attributes under a merge patch, told by their members."""
    rows = _seen_as(t, _PATCH).select("id", merge_patch(F.col("attrs"), F.col("patch")).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    keys = lambda c: F.coalesce(F.array_join(F.array_sort(F.json_object_keys(c)), ","), F.lit(""))
    return rows.select("id", at("$.family").alias("family"), at("$.size").alias("size"), at("$.facts.license").alias("license"), at("$.facts.context").alias("context"), at("$.facts.max.in").alias("most"), at("$.family.x.z").alias("z"), at("$.é").alias("other"), keys(F.col("j")).alias("members"), keys(at("$.facts")).alias("facts"), F.col("j").startswith("[").alias("replaced"))


_WRONG = """SELECT id, CASE size % 9 WHEN 4 THEN name || ' (Deep' WHEN 5 THEN name || ' –' WHEN 6 THEN '(' || name WHEN 7 THEN name || ' (x)' ELSE name END AS name, maker, CASE WHEN size % 11 = 3 THEN 'text' ELSE output_kind END AS output_kind,
  CASE size % 11 WHEN 3 THEN 'embedding' WHEN 4 THEN 'embedding,rerank' ELSE tasks END AS tasks, released, knowledge FROM {entities}"""
_RULES = f""", w AS ({_WRONG.format(entities="entities")}), own AS (SELECT DISTINCT maker FROM offerings JOIN entities e ON e.id = entity_id WHERE way = 'api' AND maker = provider_id),
a AS (SELECT *, output_kind = 'text' AND list_contains(string_split(tasks, ','), 'embedding') AND NOT list_contains(string_split(tasks, ','), 'rerank') AS r0, contains(name, '(') AND NOT contains(name, ')') AS r1, rtrim(string_split(name, '(')[1]) AS cut, maker IN (SELECT id FROM providers WHERE kind IN ('aggregator', 'cloud')) AND maker NOT IN (SELECT maker FROM own) AS r4, released < knowledge AS r5 FROM w),
b AS (SELECT *, CASE WHEN r1 AND length(cut) > 2 THEN cut ELSE name END AS n1 FROM a), c AS (SELECT *, contains(n1, '/') AS r2, replace(n1, '/', ' ') AS n2, trim(replace(n1, '/', ' '), ' -–—:|/(') AS cut2 FROM b),
d AS (SELECT *, cut2 <> n2 AS r3, CASE WHEN length(cut2) > 2 THEN cut2 ELSE n2 END AS n3 FROM c)
"""


def _wrong(t) -> DataFrame:
    return t.spark.sql(_WRONG, entities=t.entities).withColumn("tasks", F.split("tasks", ","))


@query(_RULES + """SELECT id, n3 AS name, CASE WHEN r4 THEN NULL ELSE maker END AS maker, CASE WHEN r0 THEN 'embedding' ELSE output_kind END AS output_kind, CASE WHEN r5 THEN NULL ELSE released END AS released,
  coalesce(r0, false)::INT + coalesce(r1, false)::INT + coalesce(r2, false)::INT + coalesce(r3, false)::INT + coalesce(r4, false)::INT + coalesce(r5, false)::INT AS broken FROM d WHERE r0 OR r1 OR r2 OR r3 OR r4 OR r5""")
def normalise_rules(t):
    """The rows that any rule of upkeep changes or finds, with how many did."""
    rows, _ = upkeep.normalise_rules(_wrong(t), t.providers, t.offerings)
    return rows.where(F.size("broken") > 0).select("id", "name", "maker", "output_kind", "released", F.size("broken").alias("broken"))


@query(_RULES + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) FILTER (r{i}) AS n FROM d" for i, r in enumerate(upkeep.RULES)))
def normalise_counts(t):
    """How many rows each rule finds, observed while the repaired table is written."""
    rows, counts = upkeep.normalise_rules(_wrong(t), t.providers, t.offerings)
    written(rows, "repaired")
    return t.spark.createDataFrame(list(counts.get.items()), "rule string, n long")


_TAGGED = """SELECT id, CASE size % 8 WHEN 0 THEN name || ' Embed' WHEN 1 THEN name || ' Coder' WHEN 2 THEN name || ' Thinking' ELSE name END AS name, register, CASE size % 5 WHEN 0 THEN 'audio' ELSE input_kind END AS input_kind,
  CASE size % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'audio + video' WHEN 2 THEN 'audio' WHEN 3 THEN 'text + image' WHEN 4 THEN 'embedding' ELSE output_kind END AS output_kind,
  CASE size % 13 WHEN 0 THEN 'Writes a Soundtrack' WHEN 1 THEN 'OCR of pages' WHEN 2 THEN 'moderation and web search' WHEN 3 THEN 'a reranker' WHEN 4 THEN 'transcription' WHEN 5 THEN 'lip-sync' WHEN 6 THEN 'crawl, parse and trace' WHEN 7 THEN 'run code in a sandbox, translates' END AS said FROM {entities}"""


@query(f""", e AS ({_TAGGED.format(entities="entities")}), st AS (SELECT entity_id AS id, list_contains(list(suite), 'error') AS hard, list_contains(list(suite), 'signup') AS coded, list_contains(list(suite), 'view') AS acts FROM benchmarks GROUP BY 1),
x AS (SELECT e.id, lower(name) AS n, lower(name) || ' ' || lower(coalesce(said, '')) AS b, input_kind AS ink, output_kind AS outk, register, contains(output_kind, 'text') OR contains(output_kind, 'code') AS prose, coalesce(hard, false) AS hard, coalesce(coded, false) AS coded, coalesce(acts, false) AS acts FROM e LEFT JOIN st USING (id)),
y AS (SELECT *, prose AND (contains(b, 'ocr')) AS ocr FROM x),
z AS (SELECT id, register, prose, list_distinct(list_filter([
  CASE WHEN outk = 'embedding' OR contains(n, 'embed') THEN CASE WHEN contains(b, 'rerank') THEN 'rerank' ELSE 'embedding' END END, CASE WHEN contains(n, 'rerank') THEN 'rerank' END, CASE WHEN contains(ink, 'audio') AND contains(outk, 'text') AND (ink = 'audio' OR contains(b, 'transcri')) THEN 'transcribe' END,
  CASE WHEN contains(outk, 'audio') AND NOT contains(outk, 'video') THEN CASE WHEN contains(b, 'soundtrack') THEN 'music' ELSE 'speak' END END, CASE WHEN contains(outk, 'image') AND NOT ocr THEN 'image' END, CASE WHEN contains(outk, 'video') THEN CASE WHEN contains(b, 'lip-sync') THEN 'avatar' ELSE 'video' END END,
  CASE WHEN ocr THEN 'ocr' END, CASE WHEN prose AND (contains(outk, 'code') OR contains(n, 'code')) OR prose AND coded THEN 'code' END, CASE WHEN prose AND contains(b, 'translat') THEN 'translate' END, CASE WHEN prose AND contains(b, 'moderation') THEN 'guard' END, CASE WHEN prose AND contains(b, 'web search') THEN 'search' END,
  CASE WHEN prose AND contains(b, 'crawl') THEN 'crawl' END, CASE WHEN prose AND contains(b, 'parse') THEN 'extract' END, CASE WHEN prose AND contains(b, 'sandbox') THEN 'sandbox' END, CASE WHEN prose AND contains(b, 'trace') THEN 'evaluate' END, CASE WHEN prose AND (contains(n, 'thinking') OR hard) THEN 'reasoning' END, CASE WHEN prose AND acts THEN 'agents' END], lambda v: v IS NOT NULL)) AS tags FROM y)
SELECT id, array_to_string(list_sort(CASE WHEN len(tags) = 0 THEN ['chat'] ELSE tags END), ',') AS tags FROM z WHERE len(tags) > 0 OR (prose AND register IN ('model', 'agent'))""")
def task_tags(t):
    """Tags of everything, in alphabetical order; boards of the lens stand in for the ones that the rules name."""
    e = t.spark.sql(_TAGGED, entities=t.entities)
    stands = F.create_map(F.lit("error"), F.lit("hle"), F.lit("signup"), F.lit("swe_rebench"), F.lit("view"), F.lit("gaia"))[F.col("suite")]
    docs = e.where("said is not null").select(F.col("id").alias("subject"), F.lit("description").alias("kind"), F.lit(1).alias("seq"), F.col("said").alias("text"))
    got = tags.tag_entities(e, docs, t.benchmarks.select("entity_id", F.coalesce(stands, "suite").alias("suite")))
    return got.select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


_A_SLUG = lambda c: f"trim(regexp_replace(replace(replace(lower({c}), '+', ' plus '), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')"
_PAGES = lambda n, hub: f"(SELECT p, CASE WHEN p = 1 THEN '/index/{hub}' ELSE '/index/{hub}/' || p END AS a FROM (SELECT unnest(range(1, greatest(ceil({n} / 100.0), 1)::INT + 1)) AS p))"
_FAMILY_OF = "CASE WHEN license IN ('apache-2.0', 'mit', 'cc-by-4.0', 'bsd-3-clause', 'openmdw-1.1') THEN 'open' WHEN license ILIKE 'cc-by-nc%' THEN 'noncommercial' WHEN license = 'proprietary' THEN license WHEN license IS NOT NULL THEN 'open-with-conditions' END"
_AFTER = ["/index/waiting", "/index/free", "/index/free/models", "/index/free/tools", "/index/free/agents", "/index/free/subscriptions", "/index/top", "/index/top/chat", "/index/lists", "/index/coverage"]
_ADDRESSES = f""", busy AS (SELECT provider_id AS id FROM offerings UNION SELECT maker FROM entities WHERE maker IS NOT NULL), told AS (SELECT subject AS id FROM docs WHERE kind = 'description' UNION SELECT fund_id FROM investments UNION SELECT company_id FROM investments),
tg AS (SELECT id, unnest(string_split(tasks, ',')) AS tag, {_FAMILY_OF} AS fam, license, params FROM entities), dev(i, d, gb) AS (VALUES {", ".join(f"({i}, '{d}', {gb})" for i, (d, gb) in enumerate(upkeep.DEVICES.items()))}),
fo(f, i) AS (VALUES ('open', 1), ('open-with-conditions', 2), ('noncommercial', 3), ('proprietary', 4)), fit AS (SELECT dev.i, d, tag FROM tg JOIN dev ON params * 1e9 <= round(greatest(gb * 0.7 - 1, 0) / 0.65 * 1e9) WHERE license <> 'proprietary'), fits AS (SELECT dev.i, d FROM entities JOIN dev ON params * 1e9 <= round(greatest(gb * 0.7 - 1, 0) / 0.65 * 1e9) WHERE license <> 'proprietary'),
every AS (SELECT 0 AS part, printf('%03d', i) AS k, a FROM (SELECT unnest(range(5)) AS i, unnest([{", ".join(f"'{a}'" for a in upkeep.BEFORE)}]) AS a)
UNION ALL SELECT 1, event_type, '/index/tech/' || event_type FROM (SELECT DISTINCT event_type FROM events)
{" ".join(f"UNION ALL SELECT {2 + i}, printf('%012d', p), a FROM {_PAGES(f'''(SELECT count(*) FROM entities WHERE register = '{r}')''', h)}" for i, (r, h) in enumerate(upkeep.HUBS.items()))}
UNION ALL SELECT 6, printf('%012d', p), a FROM {_PAGES("(SELECT count(*) FROM providers WHERE id IN (SELECT id FROM busy))", "providers")}
UNION ALL SELECT 7, id, '/index/' || {_A_SLUG('name')} FROM providers WHERE id IN (SELECT id FROM busy) OR id IN (SELECT id FROM told) OR kind = 'fund' OR raised > 0
UNION ALL SELECT 8, e.name || chr(1) || e.id, '/index/' || coalesce({_A_SLUG('p.name')}, 'commons') || '/' || coalesce(nullif({_A_SLUG('e.name')}, ''), {_A_SLUG('e.id')}) FROM entities e LEFT JOIN providers p ON p.id = e.maker
UNION ALL SELECT 9, suite, '/index/board/' || {_A_SLUG('suite')} FROM benchmarks UNION ALL SELECT 10, license, '/index/licence/' || {_A_SLUG('license')} FROM entities WHERE license IS NOT NULL UNION ALL SELECT 11, tag, '/index/for/' || {_A_SLUG('tag')} FROM tg WHERE tag IS NOT NULL
UNION ALL SELECT 12, printf('%015d %s %s', 100000000000000 - c, input_kind, output_kind), '/index/does/' || {_A_SLUG('input_kind')} || '-to-' || {_A_SLUG('output_kind')} FROM (SELECT input_kind, output_kind, count(*) AS c FROM entities GROUP BY 1, 2)
UNION ALL SELECT 13, i::VARCHAR, '/index/licence/' || f FROM fo WHERE f IN (SELECT {_FAMILY_OF} FROM entities) UNION ALL SELECT 14, tag || chr(1) || i, '/index/for/' || {_A_SLUG('tag')} || '/licence/' || f FROM tg JOIN fo ON f = fam WHERE tag IS NOT NULL
UNION ALL SELECT 15, printf('%02d', i), '/index/local/' || d FROM fits UNION ALL SELECT 15, printf('%02d', i) || ' ' || tag, '/index/local/' || d || '/for/' || {_A_SLUG('tag')} FROM fit WHERE tag IS NOT NULL
UNION ALL SELECT 16, printf('%03d', i), a FROM (SELECT unnest(range({len(_AFTER)})) AS i, unnest([{", ".join(f"'{a}'" for a in _AFTER)}]) AS a)),
first AS (SELECT a, min((part, k)) AS f FROM every GROUP BY 1)
SELECT row_number() OVER (ORDER BY f, a) AS place, a AS address FROM first"""


@query(_ADDRESSES)
def site_addresses(t):
    """Every address once, numbered in the order of the list."""
    held = SimpleNamespace(entities=t.entities.withColumn("tasks", F.split("tasks", ",")), offerings=t.offerings, benchmarks=t.benchmarks, docs=t.docs, investments=t.investments)
    held.providers = t.providers.withColumns({"notes": F.when(F.col("kind") == "fund", "why"), "backing": F.lit(None).cast("string"), "raised": F.when(F.col("raised") > 0, F.col("raised"))})
    terms = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.col("event_type").alias("slug")).distinct()
    return upkeep.addresses(held, terms, ["chat"])


# A curated document: the lens as JSON, dealt to several files, on top of a catalogue that holds part of it already.

#: Remainders by which documents come in order, as in the SQL, and keys of a remainder that one document has: there are more documents as there are more keys, not longer ones.
_FILES, _KEYS = 16, 256
_OLD_PRICE = "l_linenumber = 1"
_CURATED_SQL = """, docs_in AS (SELECT * FROM (SELECT seq % 16 AS file, *, CASE WHEN kind = 'article' THEN 'fact' ELSE kind END AS k2, CASE WHEN kind = 'article' THEN CASE seq % 3 WHEN 0 THEN 'context' WHEN 1 THEN 'input_kind' ELSE 'note' END ELSE '' END AS field FROM docs)),
li AS (SELECT *, 'e' || l_partkey AS entity_id, 's' || l_suppkey AS provider_id, CASE l_linestatus WHEN 'O' THEN 'mtok_in' ELSE 'mtok_out' END AS dimension, CASE l_returnflag WHEN 'A' THEN 'https://a.org' ELSE 'https://b.org' END AS source_url, CAST(round(l_extendedprice * 100) / 1000 AS BIGINT) AS micros FROM lineitem),
offers AS (SELECT entity_id, provider_id, list((l_orderkey, l_linenumber) ORDER BY l_orderkey, l_linenumber) AS lines, l_partkey % 16 AS file FROM li WHERE l_linenumber > 1 GROUP BY ALL),
comp AS (SELECT li.*, true AS fresh FROM li WHERE l_linenumber > 1 UNION ALL SELECT li.*, false FROM li WHERE l_linenumber = 1),
moved AS (SELECT *, lag(micros) OVER (PARTITION BY entity_id, provider_id, dimension, source_url ORDER BY fresh, l_orderkey, l_linenumber) AS was FROM comp),
scores AS (SELECT b.*, e.event_id % 3 <> 0 AS bound FROM benchmarks b JOIN events e ON e.event_id = b.seq),
st AS (SELECT *, lag((value, rank, out_of)) OVER (PARTITION BY entity_id, suite, metric ORDER BY seq % 16, seq) AS was FROM scores WHERE bound),
facts AS (SELECT 'ent_' || subject AS id, arg_max(length(text), (file, seq)) FILTER (field = 'context') AS context, arg_max(seq % 4, (file, seq)) FILTER (field = 'input_kind') AS kind FROM docs_in WHERE k2 = 'fact' AND subject LIKE 'e%' GROUP BY 1),
told AS (SELECT e.id FROM (SELECT 'ent_' || id AS id, CASE input_kind WHEN 'a sound' THEN 'audio' ELSE input_kind END AS input_kind FROM entities) e JOIN facts f ON f.id = e.id WHERE f.context IS NOT NULL OR (f.kind IS NOT NULL AND CASE f.kind WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' ELSE 'video' END <> e.input_kind)),
n AS (SELECT (SELECT count(*) FROM entities WHERE size % 2 = 1) AS minted, (SELECT count(*) FROM entities WHERE size % 2 = 0) AS kept, (SELECT count(*) FROM offers) AS offerings, (SELECT count(*) FROM moved WHERE fresh AND micros IS DISTINCT FROM was) AS appended, (SELECT count(*) FROM moved WHERE fresh AND micros IS NOT DISTINCT FROM was) AS unchanged,
  (SELECT count(*) FROM st) AS scored, (SELECT count(*) FROM st WHERE was IS NULL OR (value, rank, out_of) IS DISTINCT FROM was) AS moved, (SELECT count(*) FROM scores WHERE NOT bound) AS held, (SELECT count(*) FROM docs_in) AS texts, (SELECT count(*) FROM told) AS described)
"""


def _documents(t) -> DataFrame:
    """(file, body): the lens as curated documents, each of a bounded number of keys."""
    li = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")

    def dealt(df: DataFrame, by, order: list, name: str, *cols) -> DataFrame:
        rows = df.select(F.struct((by % _FILES).alias("of"), F.floor(by / (_FILES * _KEYS)).alias("nth")).alias("file"), F.struct(*order).alias("o"), F.struct(*cols).alias("r"))
        return rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias(name))

    said = F.when(F.col("kind") == "article", F.when(F.col("seq") % 3 == 0, F.length("text").cast("string")).when(F.col("seq") % 3 == 1, F.element_at(F.array(*map(F.lit, ("text", "image", "audio", "video"))), (F.col("seq") % 4 + 1).cast("int"))).otherwise(F.col("text"))).otherwise(F.col("text"))
    d = t.docs.withColumns({"said": said, "field": F.when(F.col("kind") == "article", F.when(F.col("seq") % 3 == 0, "context").when(F.col("seq") % 3 == 1, "input_kind").otherwise("note")), "subject": F.when(F.col("subject").startswith("e"), F.concat(F.lit("ent_"), "subject")).otherwise(F.col("subject"))})
    priced = li.where("l_linenumber > 1").select(F.concat(F.lit("e"), "l_partkey").alias("entity"), F.concat(F.lit("s"), "l_suppkey").alias("provider"), F.col("l_partkey").alias("p"), F.struct("l_orderkey", "l_linenumber").alias("o"),
        F.struct(F.when(F.col("l_linestatus") == "O", "mtok_in").otherwise("mtok_out").alias("dimension"), F.bround(F.round(F.col("l_extendedprice") * 100) / 1000).cast("long").alias("micros_per_unit"), F.when(F.col("l_returnflag") == "A", "https://a.org").otherwise("https://b.org").alias("source_url"), F.lit("2024-02-03").alias("taken_at")).alias("c"))
    offers = priced.groupBy("entity", "provider", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]).alias("components"))
    number = F.substring("id", 2, 20).cast("long")
    parts = [
        dealt(t.providers, number, ["id"], "providers", "id", "name", "url", "kind"), dealt(t.entities, number, ["id"], "entities", F.concat(F.lit("ent_"), "id").alias("id"), "register", "name", "input_kind", "output_kind", "maker"),
        dealt(offers, F.col("p"), ["entity", "provider"], "offerings", "entity", "provider", F.lit("api").alias("way"), "components"), dealt(t.suites, F.length("id"), ["id"], "suites", "id", "name", "measurer", "url", "lower_is_better"),
        dealt(t.benchmarks.withColumn("model_as_printed", F.concat_ws("-", "entity_id", F.col("seq") % 3)), F.col("seq"), ["seq"], "benchmarks", "suite", "model_as_printed", "metric", "value", "rank", "out_of", F.lit("https://c.org").alias("source_url"), F.col("taken_at").cast("string").alias("taken_at")),
        dealt(d, F.col("seq"), ["seq"], "docs", "subject", F.when(F.col("kind") == "article", "fact").otherwise(F.col("kind")).alias("kind"), "field", F.col("said").alias("text"), "source_url", "taken_at"),
        dealt(t.benchmarks.select("suite", "entity_id").distinct().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))), F.substring("entity_id", 2, 20).cast("long"), ["suite", "entity_id", "n"], "aliases", F.concat(F.lit("bench_"), "suite").alias("source"), F.concat_ws("-", "entity_id", "n").alias("alias"), F.col("entity_id").alias("entity")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.join(p, "file", "full")
    return rows.select("file", F.to_json(F.struct(*(c for c in rows.columns if c != "file"))).alias("body"))


def _imported(t) -> dict[str, DataFrame]:
    spark, li = t.spark, t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").where(_OLD_PRICE)
    none = lambda schema: spark.createDataFrame([], schema)
    offering = "entity_id string, provider_id string, way string, variant string, "
    prices = li.select(F.concat(F.lit("e"), "l_partkey").alias("entity_id"), F.concat(F.lit("s"), "l_suppkey").alias("provider_id"), F.lit("api").alias("way"), F.lit("").alias("variant"), F.when(F.col("l_linestatus") == "O", "mtok_in").otherwise("mtok_out").alias("dimension"),
        F.bround(F.round(F.col("l_extendedprice") * 100) / 1000).cast("long").alias("micros"), F.when(F.col("l_returnflag") == "A", "https://a.org").otherwise("https://b.org").alias("source_url"), F.lit("2024-01-01").cast("date").alias("taken_at"), F.col("l_orderkey").alias("seq"))
    old = t.entities.where("size % 2 = 0").select(F.concat(F.lit("ent_"), "id").alias("id"), "register", "name", F.when(F.col("input_kind") == "a sound", "audio").otherwise(F.col("input_kind")).alias("input_kind"), "output_kind", F.lit("old").alias("maker"), F.lit("{}").alias("attrs"))
    held = {
        "providers": none("id string, name string, url string, kind string, notes string"), "entities": old, "aliases": none("source string, alias string, entity_id string"), "queue": none("source string, alias string, payload string"), "prices": prices,
        "offerings": none(offering + "first_seen date, last_seen date"), "metrics": none(offering + "metric string, value double, source_url string, taken_at date, seq long"), "suites": none("id string, name string, measurer string, url string, metric string, subject string, lower_is_better boolean, updated string"),
        "benchmarks": none("entity_id string, suite string, metric string, value double, rank long, out_of long, source_url string, taken_at date, seq long"), "docs": none("subject string, kind string, field string, text string, source_url string, taken_at string"),
    }
    return entries.import_curated(_documents(t), held)


_COUNTED = ("minted", "kept", "offerings", "appended", "unchanged", "scored", "moved", "held", "texts", "described")


@query(_CURATED_SQL + " UNION ALL ".join(f"SELECT '{c}' AS what, {c} AS n FROM n" for c in _COUNTED))
def import_counters(t):
    """The counters of an import of the whole lens."""
    one = _imported(t)["counters"]
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in _COUNTED))))


@query(_CURATED_SQL + """SELECT 'ent_' || e.id AS id, name, CASE WHEN size % 2 = 0 THEN 'old' ELSE maker END AS maker, coalesce(CASE f.kind WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'video' END, CASE input_kind WHEN 'a sound' THEN 'audio' ELSE input_kind END) AS input_kind,
  CASE WHEN f.context IS NOT NULL THEN '{"context":' || f.context || '}' ELSE '{}' END AS attrs FROM entities e LEFT JOIN facts f ON f.id = 'ent_' || e.id""")
def import_entities(t):
    """Things after the import: rows that were held stay, facts are theirs."""
    return _imported(t)["entities"].select("id", "name", "maker", "input_kind", "attrs")


_PLANS = """SELECT 'Plan+' || p_name || ' ' || p_partkey AS plan, 's' || (p_partkey % 300) AS maker, 'Seller ' || (p_partkey % 300) AS maker_name, 'https://s' || (p_partkey % 300) || '.com' AS maker_url, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) / 4 END AS usd,
  CASE WHEN p_size % 3 = 0 THEN 'T' || (p_partkey - 1) END AS grants, CASE WHEN p_size % 5 <> 0 THEN p_size || ' a day' END AS limits, 'https://plans.org' AS source_url FROM {part} WHERE p_size < 25"""
_PLANNED = f""", plans AS ({_own(_PLANS)}), p AS (SELECT *, 'sub_' || trim(regexp_replace(replace(lower(plan), '+', ' plus '), '[^a-z0-9]+', '-', 'g'), '-') AS id, CASE WHEN coalesce(usd, 0) = 0 THEN 'free' ELSE '' END AS variant FROM plans),
held AS (SELECT 'e' || p_partkey AS id, 'T' || p_partkey AS name FROM part)
"""


def _planned(t) -> dict[str, DataFrame]:
    part = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    plans = _seen_as(t, _PLANS).withColumn("includes", F.lit(None).cast("array<string>"))
    things = part.select(F.concat(F.lit("e"), "p_partkey").alias("id"), F.lit("model").alias("register"), F.concat(F.lit("T"), "p_partkey").alias("name"), F.lit("m").alias("maker"), F.lit("text").alias("input_kind"), F.lit("text").alias("output_kind"), F.lit(None).cast("string").alias("derived_from"), F.lit("{}").alias("attrs"))
    known = plans.where("usd = 1").select(entries.plan_id(F.col("plan")).alias("id"), F.lit("subscription").alias("register"), F.lit("old").alias("name"), F.lit("old").alias("maker"), F.lit("").alias("input_kind"), F.lit("").alias("output_kind"), F.lit(None).cast("string").alias("derived_from"), F.lit("{}").alias("attrs"))
    hung = part.where("p_size = 9").select(F.concat(F.lit("e"), "p_partkey").alias("entity_id"), F.lit("s1").alias("provider_id"), F.lit("subscription").alias("way"), F.lit("").alias("variant"))
    stay = part.where("p_size = 10").select(F.concat(F.lit("e"), "p_partkey").alias("entity_id"), F.lit("s1").alias("provider_id"), F.lit("api").alias("way"), F.lit("").alias("variant"))
    day = F.lit("2024-01-01").cast("date")
    offerings = hung.union(stay).withColumns({"limits": F.lit("x"), "status": F.lit("live"), "first_seen": day, "last_seen": day})
    prices = hung.union(stay).withColumns({"dimension": F.lit("month"), "micros": F.lit(5).cast("long"), "source_url": F.lit("u"), "taken_at": day})
    return entries.apply_plans(plans, {"providers": t.providers.select("id", "name", "url", "kind"), "entities": things.union(known), "offerings": offerings, "prices": prices}, "2024-02-03")


@query(_PLANNED + """SELECT id AS entity_id, maker AS provider_id, 'subscription' AS way, variant, CAST(round(coalesce(usd, 0) * 1e6) AS BIGINT) AS micros, coalesce(limits, '') AS limits FROM p
UNION ALL SELECT 'e' || p_partkey, 's1', 'api', '', 5, 'x' FROM part WHERE p_size = 10""")
def plan_prices(t):
    """What is sold by the month after the plans are applied: what hung on other things is gone."""
    got = _planned(t)
    return got["prices"].join(got["offerings"], ["entity_id", "provider_id", "way", "variant"]).select("entity_id", "provider_id", "way", "variant", "micros", "limits")


@query(_PLANNED + """SELECT p.id, plan AS name, maker, h.id AS derived_from, '{"limits":"' || coalesce(limits, '') || '","includes":[]}' AS attrs FROM p LEFT JOIN held h ON h.name = grants""")
def plan_entities(t):
    return _planned(t)["entities"].where("register = 'subscription'").select("id", "name", "maker", "derived_from", "attrs")


_FIRMS = """SELECT c_custkey AS k, 'Firm & Co ' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN 's' || (c_custkey % 150) END AS held, CASE WHEN c_custkey % 5 = 0 THEN 'Was ' || c_custkey END AS was, CASE WHEN c_custkey % 7 = 0 THEN 'Buyer' END AS acquired_by,
  CASE WHEN c_custkey % 3 = 0 THEN 'Too short.' ELSE 'It makes   things of the kind ' || c_mktsegment || ' for those who need them.' END AS text FROM {customer}"""
_COMPANY = f""", firms AS ({_own(_FIRMS)}), f AS (SELECT *, coalesce(held, 'prov_' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')) AS id FROM firms),
port AS (SELECT id, min((name, held IS NULL, was, acquired_by)) AS f FROM f WHERE k % 2 = 0 GROUP BY 1), portf AS (SELECT id, f[1] AS name, f[2] AS added, f[3] AS was, f[4] AS acq FROM port),
batch AS (SELECT id, min((held IS NOT NULL, name, 'B' || (k % 3), text)) AS f FROM f WHERE k % 2 = 1 GROUP BY 1), p0 AS (SELECT id, name, url, kind, CASE WHEN nation = 1 THEN 'mark' END AS backing, CAST(NULL AS VARCHAR) AS status, raised FROM providers),
p1 AS (SELECT p0.id, p0.name, p0.url, p0.kind, coalesce(backing, CASE WHEN q.id IS NOT NULL THEN 'Fund' END) AS backing, CASE WHEN NOT added AND acq IS NOT NULL THEN 'Acquired' ELSE status END AS status, raised FROM p0 LEFT JOIN portf q USING (id)
  UNION ALL SELECT id, name, '', 'vendor', 'Fund', CASE WHEN acq IS NOT NULL THEN 'Acquired' ELSE 'Active' END, NULL FROM portf WHERE id NOT IN (SELECT id FROM p0) UNION ALL SELECT 'fund', 'Fund', 'https://fund.vc', 'fund', NULL, NULL, NULL),
p2 AS (SELECT p1.id, p1.name, url, kind, CASE WHEN p1.backing IS NULL AND b.f[1] THEN b.f[3] ELSE p1.backing END AS backing, CASE WHEN p1.backing IS NULL AND b.f[1] THEN 'On' ELSE status END AS status, raised FROM p1 LEFT JOIN batch b ON b.id = p1.id
  UNION ALL SELECT id, f[2], 'https://' || id, 'vendor', f[3], 'On', NULL FROM batch WHERE NOT f[1] AND id NOT IN (SELECT id FROM p1))
"""


def _told(t) -> dict[str, DataFrame]:
    rows = _seen_as(t, _FIRMS)
    providers = t.providers.select("id", "name", "url", "kind", F.when(F.col("nation") == 1, "mark").alias("backing"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("boolean").alias("listed"), "raised", F.lit(None).cast("long").alias("rounds"), F.lit(None).cast("string").alias("raised_source"))
    docs = t.docs.select("subject", "kind", F.lit("").alias("field"), "text", "source_url", "taken_at")
    edges = t.investments.select("fund_id", "company_id", F.lit("u").alias("source_url"))
    batch = rows.where("k % 2 = 1").select("name", "held", F.concat(F.lit("B"), F.col("k") % 3).alias("backing"), F.lit("On").alias("status"), F.concat(F.lit("https://"), entries.company_id(F.col("name"))).alias("url"), "text", F.lit("https://dir.org").alias("page"))
    facts = {"portfolio": rows.where("k % 2 = 0").select("name", "held", "was", "acquired_by"), "batch": batch}
    return entries.apply_company_facts(providers, docs, edges, facts, ("fund", "Fund", "https://fund.vc"), "https://fund.vc/list", "2024-02-03")


@query(_COMPANY + "SELECT id, name, url, kind, backing, status, raised FROM p2")
def company_facts(t):
    """Companies after a fund's portfolio and a directory's batch: what was known stays where the policy says so."""
    return _told(t)["providers"].select("id", "name", "url", "kind", "backing", "status", "raised")


@query(_COMPANY + """SELECT 'fact' AS part, id AS subject, 'formerly' AS what, was AS text FROM portf WHERE was IS NOT NULL UNION ALL SELECT 'fact', id, 'acquired_by', acq FROM portf WHERE acq IS NOT NULL
UNION ALL SELECT 'description', id, '', regexp_replace(f[4], '\\s+', ' ', 'g') FROM batch WHERE NOT f[1] AND id NOT IN (SELECT id FROM p1) AND length(regexp_replace(f[4], '\\s+', ' ', 'g')) >= 40 UNION ALL SELECT 'edge', 'fund', id, '' FROM portf""")
def company_evidence(t):
    """The facts, descriptions and investments that came with them."""
    got = _told(t)
    docs = got["docs"].where("source_url in ('https://fund.vc/list', 'https://dir.org')").select(F.col("kind").alias("part"), "subject", F.col("field").alias("what"), "text")
    return docs.union(got["investments"].where("fund_id = 'fund'").select(F.lit("edge"), "fund_id", "company_id", F.lit("")))


# Deliveries.

@query("SELECT kind, count(*) AS rows, count(DISTINCT event_id % 5) AS batches FROM (SELECT event_type AS kind, event_id FROM events) WHERE event_id % 5 <> 3 GROUP BY 1")
def atomic_delivery(t):
    """Five batches of a table a kind of event; the fourth is cut short after its first table, and shows nothing."""
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select("event_type", "event_id")
    kinds = ("click", "view", "purchase", "signup", "error")
    root = f"{scratch_root(t.spark)}/{t.spark.sparkContext.applicationId}/delivery-{uuid.uuid4().hex}"
    delivery.create(t.spark, root, {k: "event_id long" for k in kinds})
    for b in range(5):
        rows = written(events.where(F.col("event_id") % 5 == b), "batch")
        tables = {k: rows.where(F.col("event_type") == k).select("event_id") for k in kinds}
        if b == 3:
            delivery.stage(root, "b3", {"click": tables["click"]})
        else:
            delivery.deliver(t.spark, root, f"b{b}", tables)
    seen = [delivery.read(t.spark, root, k, "event_id long").select(F.lit(k).alias("kind"), "batch") for k in kinds]
    return reduce(DataFrame.union, seen).groupBy("kind").agg(F.count("*").alias("rows"), F.countDistinct("batch").alias("batches"))
