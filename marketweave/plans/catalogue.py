"""Queries of the market catalogue as the lens shows it, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.functions import names
from marketweave.operators import checks, facts, joins, maintenance, market, passages, prose, quality
from marketweave.plans.lens import LENS_SQL, Catalogue
from marketweave.sources import price_files, rate_cards, scores
from marketweave.streaming import changes, findings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the catalogue under its name."""

    def add(f: Callable[[Catalogue], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            recursive = sql.startswith("RECURSIVE")
            ORACLE_SQL[f.__name__] = (LENS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + _MARKET + sql.removeprefix("RECURSIVE")) if recursive else LENS_SQL + sql
        return f

    return add


def _norm_sql(c: str) -> str:
    return f"regexp_replace(replace(lower({c}), '+', 'plus'), '[^a-z0-9]', '', 'g')"


_GENERIC = "(" + ", ".join(f"'{w}'" for w in names.TOO_GENERIC) + ")"
_VENDOR = "(?i)^(" + "|".join(names.VENDORS) + ")[-_/ ]"


def _forms_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '{_VENDOR}', '')"
    nought = lambda x: rf"regexp_replace({x}, '(\d)\.0($|\D)', '\1\2', 'g')"
    return f"list_distinct([{_norm_sql(c)}, {_norm_sql(bare)}, {_norm_sql(nought(c))}, {_norm_sql(nought(bare))}])"


#: Keys of entities by name alone, and by name or alias.
_KEYS = f""", named AS (SELECT f AS form, count(DISTINCT id) AS n_claims, min(id) AS entity_id FROM (SELECT id, unnest({_forms_sql('name')}) AS f FROM entities) WHERE f <> '' AND f NOT IN {_GENERIC} GROUP BY 1),
keys AS (SELECT f AS form, count(DISTINCT id) AS n_claims, min(id) AS entity_id FROM (SELECT id, unnest({_forms_sql('name')}) AS f FROM entities UNION ALL SELECT entity_id, unnest({_forms_sql('alias')}) FROM aliases) WHERE f <> '' AND f NOT IN {_GENERIC} GROUP BY 1)
"""


@query(_KEYS + "SELECT form, n_claims, entity_id FROM keys")
def name_keys(t):
    return joins.build_key_index(t.entities, t.aliases)


@query(_KEYS + f"SELECT a.source, a.alias, n.entity_id FROM aliases a LEFT JOIN (SELECT * FROM named WHERE n_claims = 1) n ON n.form = {_norm_sql('a.alias')}")
def resolve_names(t):
    return joins.resolve(t.aliases.select("source", "alias"), joins.build_key_index(t.entities), "alias").select("source", "alias", "entity_id")


#: Names as sellers print them, by the remainder of the part's key: layers that come off before a name is a thing's own.
_PRINTED = """SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 250) AS plain, CASE p_partkey % 9 WHEN 0 THEN 'us.amazon.' || replace(p_name, ' ', '-') || '-' || (p_partkey % 250) || '-20251202-v1:0' WHEN 1 THEN 'meta-llama/' || replace(p_name, ' ', '-') || '-' || (p_partkey % 250) WHEN 2 THEN replace(p_name, ' ', '-') || '-' || (p_partkey % 250) || '-high'
  WHEN 3 THEN 'openai-' || replace(p_name, ' ', '-') || '-' || (p_partkey % 250) || '-max-2026-07-30' WHEN 4 THEN replace(p_name, ' ', '_') || '_' || (p_partkey % 250) || '_120K' WHEN 5 THEN 'Anthropic: ' || upper(p_name) || ' ' || (p_partkey % 250) || ' (high)' WHEN 6 THEN 'google/' || p_name || ' ' || (p_partkey % 250) || ' Model'
  WHEN 7 THEN 'global.' || replace(p_name, ' ', '-') || '-' || (p_partkey % 250) || ':free' ELSE 'nobody/' || p_name || ' of none ' || p_partkey END AS name FROM {part}"""


@query(_KEYS + f""", printed AS ({_PRINTED.format(part="part")}) SELECT p.id, p.name, n.entity_id FROM printed p LEFT JOIN (SELECT * FROM named WHERE n_claims = 1) n ON n.form = {_norm_sql('p.plain')} AND p.id % 9 <> 8""")
def resolve_printed(t):
    """Printed names bound to things: region, vendor, date, version, setting, context, label and channel come off."""
    rows = t.spark.sql(_PRINTED, part=t.spark.read.parquet(f"{t.sf_dir}/part.parquet"))
    return joins.resolve(rows, joins.build_key_index(t.entities)).select("id", "name", "entity_id")


@query(_KEYS + f"""SELECT DISTINCT a.alias, a.entity_id AS filed_on, v.entity_id AS names FROM aliases a JOIN named v ON v.form = {_norm_sql('a.alias')} AND v.n_claims = 1 AND v.entity_id <> a.entity_id
JOIN named e ON e.form = {_norm_sql("regexp_replace(a.alias, '-Preview$', '')")} AND e.n_claims = 1 AND e.entity_id = a.entity_id WHERE a.alias LIKE '%-Preview'""")
def misfiled_aliases(t):
    return joins.misfiled_aliases(t.entities, t.aliases)


@query(_KEYS + f"SELECT a.source, a.alias, a.entity_id AS filed_on, n.entity_id FROM aliases a JOIN named n ON n.form = {_norm_sql('a.alias')} WHERE n.n_claims = 1 AND n.entity_id <> a.entity_id")
def rehome_aliases(t):
    return joins.rehome_aliases(t.entities, t.aliases)


@query(""", one AS (SELECT source, alias, min(entity_id) AS entity_id FROM aliases GROUP BY 1, 2) SELECT source, alias, CASE WHEN own THEN b ELSE entity_id END AS entity_id, CASE WHEN own THEN lane ELSE '' END AS variant FROM (
  SELECT x.source, x.alias, x.entity_id, x.lane, e.b, x.lane <> '' AND e.b IS NOT NULL AND (x.entity_id IS NULL OR x.entity_id = e.b) AS own FROM (
    SELECT *, CASE WHEN ends_with(alias, ':batch') THEN 'batch' WHEN ends_with(alias, '-fast') THEN 'fast' ELSE '' END AS lane, regexp_replace(alias, '(:batch|-fast)$', '') AS base FROM one) x
  LEFT JOIN (SELECT source AS s, alias AS al, entity_id AS b FROM one) e ON e.s = x.source AND e.al = x.base)""")
def bind_aliases(t):
    one = t.aliases.groupBy("source", "alias").agg(F.min("entity_id").alias("entity_id"))
    return joins.bind_alias(one.select("source", "alias"), one).select("source", "alias", "entity_id", "variant")


@query(r"""SELECT a.id AS company, b.id AS other FROM (SELECT id, regexp_extract_all(lower(name), '[a-z0-9]+') AS w FROM providers) a JOIN (SELECT c_custkey AS id, regexp_extract_all(lower(n), '[a-z0-9]+') AS w FROM
  (SELECT c_custkey, 'Supplier ' || (c_custkey % 400) || CASE c_custkey % 3 WHEN 0 THEN ' Labs, Inc.' WHEN 1 THEN ' Robotics' ELSE '' END AS n FROM customer)) b
ON a.w = b.w OR (len(b.w) > len(a.w) AND b.w[1 : len(a.w)] = a.w AND len(list_filter(b.w[len(a.w) + 1 :], lambda x: x NOT IN ('inc', 'labs'))) = 0)""")
def same_company(t):
    other = t.spark.read.parquet(f"{t.sf_dir}/customer.parquet").select(F.col("c_custkey").alias("other"), F.concat(F.lit("Supplier "), F.col("c_custkey") % 400, F.when(F.col("c_custkey") % 3 == 0, " Labs, Inc.").when(F.col("c_custkey") % 3 == 1, " Robotics").otherwise("")).alias("called"))
    return joins.same_company(t.providers.select(F.col("id").alias("company"), "name"), other, "name", "called").select("company", "other")


@query("SELECT DISTINCT derived_from AS entity_id, id AS plan FROM entities WHERE register = 'subscription' AND derived_from IN (SELECT id FROM entities)")
def plans_for(t):
    return joins.plans_for(t.entities)


@query("SELECT m.id, m.name, min(p.id) AS sibling FROM entities m LEFT JOIN entities p ON lower(p.name) = regexp_replace(lower(m.name), '-tee$', '') AND NOT ends_with(lower(p.name), '-tee') WHERE ends_with(lower(m.name), '-tee') GROUP BY 1, 2")
def suffix_sibling(t):
    return joins.suffix_sibling(t.entities)


@query("""SELECT coalesce(b.id, p.id) AS id, b.backers, p.portfolio FROM (SELECT company_id AS id, string_agg(name, '|' ORDER BY lower(name), name, fund_id) AS backers FROM investments JOIN providers f ON f.id = fund_id GROUP BY 1) b
FULL JOIN (SELECT fund_id AS id, string_agg(name, '|' ORDER BY lower(name), name, company_id) AS portfolio FROM investments JOIN providers c ON c.id = company_id GROUP BY 1) p ON b.id = p.id""")
def money_edges(t):
    got = joins.money_edges(t.investments, t.providers)
    return got.select("id", F.array_join("backers", "|").alias("backers"), F.array_join("portfolio", "|").alias("portfolio"))


@query(r"""SELECT c_custkey AS id, e.id AS model FROM (SELECT c_custkey, 's' || (c_custkey % 12) AS owner, lower(replace(p_name, ' ', '-')) || '-' || (p_partkey % 250) AS leaf FROM customer JOIN part ON p_partkey = c_custkey) r
JOIN entities e ON regexp_replace(lower(e.name), '[^a-z0-9]', '', 'g') = regexp_replace(leaf, '[^a-z0-9]', '', 'g') WHERE e.maker IS NOT NULL AND (owner = e.maker OR (length(e.maker) >= 4 AND contains(owner, e.maker)))""")
def licence_match(t):
    read = lambda n: t.spark.read.parquet(f"{t.sf_dir}/{n}.parquet")
    leaf = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-"), F.col("p_partkey") % 250)
    repos = read("customer").join(read("part"), F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_custkey") % 12, F.lit("/"), leaf).alias("repo"))
    return joins.licence_match(repos, t.entities.select(F.col("id").alias("model"), "name", "maker")).select("id", "model")


@query(r"""SELECT id, CASE WHEN params < 0 THEN NULL WHEN params < 3 THEN 'nano' WHEN params < 10 THEN 'xs' WHEN params < 30 THEN 's' WHEN params < 100 THEN 'm' WHEN params < 300 THEN 'l' WHEN params < 1000 THEN 'xl' WHEN params IS NOT NULL THEN 'frontier' END AS band,
  round(greatest(size * 0.7 - 1, 0) / 0.65, 6) AS fits, CASE WHEN license IN ('apache-2.0', 'mit', 'cc-by-4.0', 'bsd-3-clause', 'openmdw-1.1') THEN 'open' WHEN license ILIKE 'cc-by-nc%' THEN 'noncommercial' WHEN license = 'proprietary' THEN license WHEN license IS NOT NULL THEN 'open-with-conditions' END AS licence,
  regexp_matches(lower(family || ' ' || CASE size % 4 WHEN 0 THEN 'error rate' WHEN 1 THEN 'perplexity' ELSE 'score' END), 'rate|error|latency|cost|price|perplex|wer|loss|hallucinat') AS lower, nullif(regexp_extract(name, '^([A-Za-z]+)', 1), '') AS brand,
  regexp_matches(name, '^[a-z0-9][a-z0-9._-]*$') AS slug, (CASE WHEN contains(name, ' ') THEN 2 ELSE 0 END) + (CASE WHEN contains(name, '/') THEN 0 ELSE 2 END) + (CASE WHEN regexp_matches(name, '[-_]') THEN 0 ELSE 1 END) + (CASE WHEN regexp_matches(name, '^[A-Z]') THEN 1 ELSE 0 END) AS written FROM entities""")
def entity_facts(t):
    metric = F.concat_ws(" ", "family", F.when(F.col("size") % 4 == 0, "error rate").when(F.col("size") % 4 == 1, "perplexity").otherwise("score"))
    return t.entities.select(
        "id", X.size_band(F.col("params")).alias("band"), F.round(X.fits_billions(F.col("size")), 6).alias("fits"), X.licence_family(F.col("license")).alias("licence"), X.lower_is_better(metric).alias("lower"),
        X.brand_of(F.col("name")).alias("brand"), X.is_slug(F.col("name")).alias("slug"), X.looks_written(F.col("name")).alias("written"),
    )


@query(r"""SELECT id, coalesce(head, 'commons') AS head, coalesce(nullif(tail, ''), regexp_replace(lower(id), '^ent_', '')) AS tail FROM (SELECT e.id, trim(regexp_replace(replace(replace(lower(e.name), '+', ' plus '), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS tail,
  trim(regexp_replace(replace(replace(lower(p.name), '+', ' plus '), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS head FROM entities e LEFT JOIN providers p ON p.id = e.maker)""")
def entity_address(t):
    head, tail = X.entity_address(F.col("name"), F.col("id"), F.col("maker_name"))
    makers = t.providers.select(F.col("id").alias("maker"), F.col("name").alias("maker_name"))
    return t.entities.join(makers, "maker", "left").select("id", head.alias("head"), tail.alias("tail"))


@query("SELECT id, CASE way WHEN 'api' THEN 'per Mtok in' WHEN 'cloud' THEN 'per call' ELSE '' END AS label, CASE way WHEN 'api' THEN 'per million tokens' WHEN 'cloud' THEN 'a call' ELSE '' END AS phrase, CASE variant WHEN 'batch' THEN 'batch' WHEN 'free' THEN 'separately routed' END AS lane FROM offerings")
def lanes_and_units(t):
    unit = F.when(F.col("way") == "api", "mtok_in").when(F.col("way") == "cloud", "call").otherwise("other")
    return t.offerings.select("id", X.unit_label(unit).alias("label"), X.unit_phrase(unit).alias("phrase"), X.lane_family(F.col("variant")).alias("lane"))


@query("""SELECT id, CASE input_kind WHEN 'a sound' THEN 'audio' ELSE input_kind END AS input_kind, output_kind, input_kind = 'a sound' AS changed FROM entities""")
def tidy_kinds(t):
    new = [X.normalise_kind(F.col(c)) for c in ("input_kind", "output_kind")]
    return t.entities.select("id", new[0].alias("input_kind"), new[1].alias("output_kind"), (~new[0].eqNullSafe(F.col("input_kind")) | ~new[1].eqNullSafe(F.col("output_kind"))).alias("changed"))


def _check_sql() -> str:
    sold = "JOIN offerings o ON o.id = x.offering_id JOIN entities e ON e.id = o.entity_id JOIN providers p ON p.id = o.provider_id"
    slug = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"
    counts = {
        "one model string, two entities": "SELECT alias FROM aliases WHERE alias LIKE '%/%' AND alias NOT LIKE '% %' GROUP BY 1 HAVING count(DISTINCT entity_id) > 1",
        "one name, two entities under one maker": "SELECT 1 FROM entities GROUP BY maker, lower(name) HAVING count(*) > 1",
        "a row that contradicts itself about the weights": "SELECT 1 FROM entities WHERE license = 'proprietary' AND open_weights",
        "a thing whose maker is gone": "SELECT 1 FROM entities WHERE maker IS NOT NULL AND maker NOT IN (SELECT id FROM providers)",
        "two descriptions for one thing": "SELECT subject FROM docs WHERE kind = 'description' GROUP BY 1 HAVING count(*) > 1",
        "a description that says nothing": "SELECT 1 FROM docs WHERE kind = 'description' AND length(trim(text)) < 40",
        "published before its own training data": "SELECT 1 FROM entities WHERE released < knowledge",
        "a seller credited as the maker": "SELECT 1 FROM entities e JOIN providers p ON p.id = e.maker WHERE p.kind IN ('aggregator', 'cloud') AND NOT EXISTS (SELECT 1 FROM offerings o JOIN entities x ON x.id = o.entity_id WHERE o.provider_id = p.id AND x.maker = p.id AND o.way = 'api')",
        "one lane written twice at one price": "SELECT 1 FROM sets a WHERE variant = '' AND EXISTS (SELECT 1 FROM sets b WHERE b.entity_id = a.entity_id AND b.provider_id = a.provider_id AND b.way = a.way AND b.r = a.r AND b.id > a.id)",
        "one name, two providers": "SELECT 1 FROM providers GROUP BY lower(name) HAVING count(*) > 1",
        "one standing under two labels": "SELECT 1 FROM latest_b GROUP BY entity_id, suite, round(value, 1) HAVING count(*) > 1",
        "a price of nought": f"SELECT 1 FROM prices x {sold} WHERE micros = 0 AND o.variant <> 'free'",
        "a resale recorded as the maker's own counter": "SELECT 1 FROM offerings o JOIN providers p ON p.id = o.provider_id JOIN entities e ON e.id = o.entity_id WHERE o.way = 'api' AND p.kind = 'aggregator' AND coalesce(e.maker, '') <> p.id",
        "a name still shaped like a seller's id": "SELECT 1 FROM entities WHERE name LIKE '%/%' OR name LIKE '%: %' OR name LIKE '%@%'",
        "a live offering nobody has confirmed in a week": "SELECT 1 FROM offerings o JOIN entities e ON e.id = o.entity_id JOIN providers p ON p.id = o.provider_id, (SELECT max(taken_at) AS today FROM prices) WHERE o.status = 'live' AND o.way IN ('api', 'aggregator', 'cloud') AND o.last_seen < today - INTERVAL 7 DAY AND EXISTS (SELECT 1 FROM offerings z WHERE z.provider_id = o.provider_id AND z.way = o.way AND z.last_seen >= today - INTERVAL 2 DAY)",
        "a rate far outside its dimension's range": f"SELECT 1 FROM (SELECT *, avg(micros) OVER (PARTITION BY dimension) AS m, count(*) OVER (PARTITION BY dimension) AS n FROM latest_p) x {sold} WHERE n > 20 AND micros > 150 * m",
        "two sources, two prices for the same thing": f"SELECT 1 FROM (SELECT offering_id, dimension FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY offering_id, dimension, source_url ORDER BY seq DESC, taken_at DESC, micros DESC) = 1) GROUP BY 1, 2 HAVING count(DISTINCT micros) > 1) x {sold}",
        "a plan that grants nothing you can find": "SELECT 1 FROM entities WHERE register = 'subscription' AND derived_from IS NOT NULL AND derived_from NOT IN (SELECT id FROM entities)",
        "a plan that never says what it allows": "SELECT 1 FROM entities WHERE register = 'subscription' AND limits = ''",
        "something given away with no allowance beside it": "SELECT 1 FROM offerings o JOIN entities e ON e.id = o.entity_id JOIN providers p ON p.id = o.provider_id WHERE variant = 'free' AND allowance = ''",
        "a free price outside the free lane": "SELECT 1 FROM prices x JOIN offerings o ON o.id = x.offering_id JOIN entities e ON e.id = o.entity_id WHERE micros = 0 AND o.variant <> 'free'",
        "a thing no list will ever show": "SELECT 1 FROM entities WHERE register NOT IN ('model', 'tool', 'agent', 'subscription')",
        "a card that says nothing": "SELECT 1 FROM entities e WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.subject = e.id AND d.kind = 'description') AND NOT EXISTS (SELECT 1 FROM benchmarks b WHERE b.entity_id = e.id) AND NOT EXISTS (SELECT 1 FROM offerings o JOIN prices x ON x.offering_id = o.id WHERE o.entity_id = e.id) AND NOT EXISTS (SELECT 1 FROM entities s JOIN offerings o ON o.entity_id = s.id JOIN prices x ON x.offering_id = o.id WHERE s.register = 'subscription' AND s.derived_from = e.id)",
        "an offering with no price": "SELECT 1 FROM offerings o JOIN entities e ON e.id = o.entity_id JOIN providers p ON p.id = o.provider_id WHERE way <> 'local' AND NOT EXISTS (SELECT 1 FROM prices x WHERE x.offering_id = o.id)",
        "a standing with no place in a field": "SELECT 1 FROM latest_b WHERE rank IS NULL OR out_of IS NULL",
        "a board that does not say who runs it": "SELECT 1 FROM suites WHERE measurer = '' OR url = ''",
        "a figure nobody has re-read in a while": f"SELECT DISTINCT o.id FROM latest_p x {sold}, (SELECT max(taken_at) AS today FROM prices) WHERE x.taken_at < today - INTERVAL 45 DAY",
        "a fact filed under a name nothing reads": "SELECT 1 FROM entities WHERE attribute <> 'license'",
        "held in the pen and in the catalogue at once": "SELECT 1 FROM (SELECT id FROM providers UNION ALL SELECT id FROM entities) WHERE id IN (SELECT id FROM candidates)",
        "one maker spelling its own brand two ways": "SELECT 1 FROM (SELECT regexp_extract(trim(name), '^([A-Za-z]+)', 1) AS b, coalesce(maker, '') AS m FROM entities WHERE NOT regexp_matches(trim(name), '^[a-z0-9][a-z0-9._-]*$')) WHERE b <> '' GROUP BY lower(b), m HAVING count(DISTINCT b) > 1",
        "one address, two things": f"SELECT 1 FROM (SELECT row_number() OVER (PARTITION BY coalesce({slug('p.name')}, 'commons'), {slug('e.name')} ORDER BY e.id) AS k FROM entities e LEFT JOIN providers p ON p.id = e.maker) WHERE k > 1 UNION ALL SELECT 1 FROM providers GROUP BY {slug('name')} HAVING count(*) > 1",
        "a company that would shadow a reserved address": f"SELECT 1 FROM providers WHERE {slug('name')} IN ('board', 'task', 'top', 'free', 'search')",
        "a name that cannot be addressed": "SELECT 1 FROM (SELECT name FROM entities UNION ALL SELECT name FROM providers) WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = ''",
        "two rows one name would reach": "SELECT 1 FROM keys WHERE n_claims > 1",
        "a word outside the vocabulary": "SELECT DISTINCT 'k', kind FROM providers WHERE kind = 'shop' UNION ALL SELECT DISTINCT 'w', way FROM offerings WHERE way = 'barter' UNION ALL SELECT DISTINCT 'r', register FROM entities WHERE register = 'bundle' UNION ALL SELECT DISTINCT 'i', input_kind FROM entities WHERE register <> 'subscription' AND input_kind = 'a sound'",
        "a row pointing at nothing": "SELECT 1 FROM offerings WHERE entity_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 1 FROM prices WHERE offering_id NOT IN (SELECT id FROM offerings) UNION ALL SELECT 1 FROM benchmarks WHERE entity_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 1 FROM aliases WHERE entity_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 1 FROM offerings WHERE provider_id NOT IN (SELECT id FROM providers)",
        "a product with no maker": "SELECT 1 FROM entities WHERE maker IS NULL",
        "a tag that contradicts the modality": "SELECT 1 FROM (SELECT output_kind, unnest(string_split(tasks, ',')) AS tag FROM entities) WHERE (tag = 'image' AND NOT contains(output_kind, 'image')) OR (tag = 'video' AND NOT contains(output_kind, 'video')) OR (tag IN ('speak', 'music') AND NOT contains(output_kind, 'audio'))",
        "a name with whitespace stuck to it": "SELECT 1 FROM entities WHERE name <> trim(name) UNION ALL SELECT 1 FROM providers WHERE name <> trim(name) UNION ALL SELECT 1 FROM aliases WHERE alias <> trim(alias)",
    }
    assert counts.keys() == checks.RULES.keys()
    quoted = lambda s: s.replace("'", "''")
    rows = (f"SELECT '{quoted(name)}' AS \"check\", {str(checks.RULES[name][1]).lower()} AS blocking, (SELECT count(*) FROM ({sql})) AS findings" for name, sql in counts.items())
    return _KEYS + """, latest_p AS (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY offering_id, dimension ORDER BY seq DESC, micros DESC, taken_at DESC) = 1),
latest_b AS (SELECT * FROM benchmarks QUALIFY row_number() OVER (PARTITION BY entity_id, suite, metric ORDER BY seq DESC) = 1),
sets AS (SELECT o.id, any_value(entity_id) AS entity_id, any_value(provider_id) AS provider_id, any_value(way) AS way, any_value(variant) AS variant, list_sort(list(DISTINCT (dimension, micros))) AS r FROM offerings o JOIN prices ON offering_id = o.id GROUP BY 1)
""" + "\nUNION ALL ".join(rows)


@query(_check_sql())
def run_checks(t):
    return checks.run_checks(t.keep("suites")).drop("sample")


# Reports on the market.

_MARKET = """, mx AS (SELECT x.*, source_url LIKE 'https://docs.%' AS own, max(taken_at) OVER (PARTITION BY offering_id, dimension) AS newest FROM prices x),
cur AS (SELECT * FROM mx QUALIFY row_number() OVER (PARTITION BY offering_id, dimension ORDER BY (own AND taken_at >= newest - INTERVAL 45 DAY) DESC, taken_at DESC, seq DESC, micros DESC) = 1),
sold AS (SELECT o.entity_id, o.provider_id, c.offering_id, c.dimension, c.micros FROM cur c JOIN offerings o ON o.id = c.offering_id WHERE o.status = 'live' AND o.variant = '' AND c.micros > 0),
rates AS (SELECT entity_id, min(micros) FILTER (dimension = 'mtok_in') AS in_rate, min(micros) FILTER (dimension = 'mtok_out') AS out_rate FROM sold GROUP BY 1),
fam AS (SELECT *, CASE WHEN license IN ('apache-2.0', 'mit') THEN 'open' WHEN license ILIKE 'cc-by-nc%' THEN 'noncommercial' WHEN license = 'proprietary' THEN license WHEN license IS NOT NULL THEN 'open-with-conditions' END AS lf FROM entities)
"""
NICHES = [market.Niche("all", ("click", "view", "purchase", "signup", "error")), market.Niche("chat", ("click", "view"), task="chat"), market.Niche("one", ("purchase",), unit="mtok_in"), market.Niche("open", ("click", "signup", "error"), half="open"), market.Niche("closed", ("view", "signup", "error"), half="proprietary")]
_NICHES = "(VALUES " + ", ".join(f"('{n.key}', '{b}', {len(n.boards)})" for n in NICHES for b in n.boards) + ") AS listed(niche, suite, n)"
_STANDS = f""", headline AS (SELECT suite, metric FROM (SELECT suite, metric, count(DISTINCT entity_id) AS c FROM benchmarks GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY suite ORDER BY c DESC, metric) = 1),
last AS (SELECT b.* FROM benchmarks b JOIN headline USING (suite, metric) QUALIFY row_number() OVER (PARTITION BY suite, entity_id ORDER BY seq DESC) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY suite ORDER BY value) AS k, count(*) OVER (PARTITION BY suite) AS n FROM last),
spread AS (SELECT suite, any_value(n) AS n, coalesce((max(value) - max(value) FILTER (k = n - greatest(n // 10, 1))) / nullif(max(value) - min(value), 0) < 0.05, true) AS crowded FROM placed GROUP BY 1 HAVING any_value(n) >= 8),
shares AS (SELECT l.suite, l.entity_id, crowded, n, CASE WHEN out_of > 1 AND rank >= 1 THEN rank ELSE row_number() OVER (PARTITION BY l.suite ORDER BY CASE WHEN lower_is_better THEN value ELSE -value END, l.entity_id) END AS place, CASE WHEN out_of > 1 AND rank >= 1 THEN out_of ELSE n END AS field
  FROM last l JOIN spread USING (suite) JOIN suites s ON s.id = l.suite),
stands AS (SELECT niche, entity_id, avg(1 - (place - 1) / (field - 1)) AS cap, count(*) AS boards FROM shares JOIN {_NICHES} USING (suite) WHERE field >= 2 AND (NOT crowded OR listed.n = 1) GROUP BY 1, 2),
used AS (SELECT niche, count(DISTINCT suite) AS used FROM shares JOIN {_NICHES} USING (suite) WHERE field >= 2 AND (NOT crowded OR listed.n = 1) GROUP BY 1)
"""
_POOL = """, pool AS (SELECT s.*, used, CASE WHEN niche = 'one' THEN in_rate / 1e6 ELSE (in_rate + 3 * out_rate) / 4 / 1e6 END AS cost, f.license, coalesce(f.lf = 'open', false) OR coalesce(f.open_weights, false) AS open
  FROM stands s JOIN used USING (niche) JOIN rates USING (entity_id) JOIN fam f ON f.id = entity_id WHERE (niche = 'one' AND in_rate IS NOT NULL OR out_rate IS NOT NULL AND in_rate IS NOT NULL) AND (used < 4 OR boards >= 2)
    AND (niche <> 'chat' OR list_contains(string_split(tasks, ','), 'chat')) AND (niche <> 'open' OR coalesce(f.lf = 'open', false) OR coalesce(f.open_weights, false)) AND (niche <> 'closed' OR f.license = 'proprietary')),
med AS (SELECT niche, count(*) AS eligible, list_sort(list(cost))[count(*) // 2 + 1] AS mc, list_sort(list(cap))[count(*) // 2 + 1] AS mp FROM pool GROUP BY 1 HAVING count(*) >= 4),
cells AS (SELECT p.*, eligible, cell FROM pool p JOIN med USING (niche), (VALUES ('value'), ('frontier'), ('open'), ('cheapest')) AS c(cell)
  WHERE CASE cell WHEN 'value' THEN cost <= mc WHEN 'frontier' THEN true WHEN 'open' THEN p.open AND niche NOT IN ('open', 'closed') AND cap >= mp ELSE cap >= mp END)
"""


@query(_MARKET + _STANDS + _POOL + "SELECT niche, cell, entity_id, round(cost, 6) AS cost, round(cap, 6) AS cap, eligible FROM cells QUALIFY row_number() OVER (PARTITION BY niche, cell ORDER BY CASE WHEN cell = 'cheapest' THEN cost ELSE -cap END, entity_id) = 1")
def top_picks(t):
    return market.top_picks(t.keep("offerings", "suites"), NICHES).select("niche", "cell", "entity_id", F.round("cost", 6).alias("cost"), F.round("cap", 6).alias("cap"), "eligible")


@query(
    _MARKET
    + _STANDS
    + """, r AS (SELECT niche, entity_id, cap, out_rate, params FROM stands JOIN rates USING (entity_id) JOIN entities e ON e.id = entity_id WHERE in_rate IS NOT NULL AND out_rate < 400000 AND (niche <> 'chat' OR list_contains(string_split(tasks, ','), 'chat')))
SELECT niche, row_number() OVER (PARTITION BY niche ORDER BY cap DESC, entity_id) AS place, entity_id, round(cap, 6) AS cap, out_rate, params, max(params) OVER (PARTITION BY niche) AS most_params, count(*) OVER (PARTITION BY niche) AS eligible FROM r QUALIFY place <= 3"""
)
def bang_report(t):
    return market.bang_report(t, NICHES, under=0.4).withColumn("cap", F.round("cap", 6))


FAMILIES = {"clicks": ("click", "view"), "buys": ("purchase", "signup"), "errors": ("error",)}
_FAMILY = """, cheap AS (SELECT entity_id, min(micros) AS out_rate FROM sold WHERE dimension = 'mtok_out' AND micros < 600000 GROUP BY 1),
fp AS (SELECT p.family, p.entity_id, share, out_rate, params FROM (SELECT family, entity_id, min(rank::DOUBLE / out_of) AS share FROM benchmarks JOIN (VALUES ('clicks', 'click'), ('clicks', 'view'), ('buys', 'purchase'), ('buys', 'signup'), ('errors', 'error')) AS l(family, suite) USING (suite) WHERE rank IS NOT NULL AND out_of > 1 GROUP BY 1, 2) p
  JOIN cheap USING (entity_id) JOIN entities e ON e.id = p.entity_id WHERE register = 'model'),
top AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY share, out_rate, entity_id) AS place FROM fp QUALIFY place <= 3),
near AS (SELECT t.family, t.entity_id, k.params AS v, row_number() OVER (PARTITION BY t.family, t.entity_id ORDER BY abs(k.share - t.share), k.params) AS i FROM top t JOIN fp k ON k.family = t.family AND k.params IS NOT NULL WHERE t.params IS NULL),
est AS (SELECT family, entity_id, list_sort(list(v))[count(*) // 2 + 1] AS estimate FROM near WHERE i <= 3 GROUP BY 1, 2),
alls AS (SELECT list_sort(list(params))[count(*) // 2 + 1] AS fallback FROM (SELECT DISTINCT entity_id, params FROM fp WHERE params IS NOT NULL)),
picks AS (SELECT family, place, t.entity_id, share, out_rate, coalesce(params, estimate, fallback) AS params, params IS NULL AND coalesce(estimate, fallback) IS NOT NULL AS estimated FROM top t LEFT JOIN est USING (family, entity_id), alls)
"""


@query(_MARKET + _FAMILY + "SELECT family, place, entity_id, round(share, 6) AS share, out_rate, params, estimated FROM picks")
def dollar_by_family(t):
    return market.dollar_by_family(t, FAMILIES, 600_000).withColumn("share", F.round("share", 6))


@query(_MARKET + _FAMILY + """SELECT family, count(*) AS models, round(avg(params), 4) AS params, round(avg(out_rate), 4) AS out_rate FROM picks WHERE params IS NOT NULL GROUP BY 1
UNION ALL SELECT 'Overall', count(*), round(avg(params), 4), round(avg(out_rate), 4) FROM (SELECT * FROM picks WHERE params IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY family) = 1) HAVING count(*) > 0""")
def family_averages(t):
    got = market.family_averages(market.dollar_by_family(t, FAMILIES, 600_000))
    return got.select("family", "models", F.round("params", 4).alias("params"), F.round("out_rate", 4).alias("out_rate"))


@query(_MARKET + """SELECT c.entity_id, c.out_rate, in_rate, sellers, boards, round(share, 6) AS share FROM (SELECT entity_id, min(micros) AS out_rate, count(DISTINCT provider_id) AS sellers FROM sold WHERE dimension = 'mtok_out' AND micros < 400000 GROUP BY 1) c
JOIN (SELECT entity_id, count(DISTINCT suite) AS boards, min(rank::DOUBLE / out_of) AS share FROM benchmarks WHERE rank IS NOT NULL AND out_of > 1 GROUP BY 1) b USING (entity_id) JOIN entities e ON e.id = c.entity_id LEFT JOIN (SELECT entity_id, min(micros) AS in_rate FROM sold WHERE dimension = 'mtok_in' GROUP BY 1) i USING (entity_id) WHERE register = 'model'""")
def dollar_models(t):
    return market.dollar_models(t, 400_000).withColumn("share", F.round("share", 6))


@query(_MARKET + """SELECT id AS entity_id, name, params, license, CASE WHEN params < 3 THEN 'nano' WHEN params < 10 THEN 'xs' WHEN params < 30 THEN 's' WHEN params < 100 THEN 'm' WHEN params < 300 THEN 'l' WHEN params < 1000 THEN 'xl' ELSE 'frontier' END AS band, round(params * 0.65 + 1, 1) AS gb,
  coalesce(sellers, 0) AS sellers, coalesce(boards, 0) AS boards, in_rate, out_rate FROM entities LEFT JOIN (SELECT entity_id AS id, count(DISTINCT provider_id) AS sellers FROM offerings GROUP BY 1) USING (id) LEFT JOIN (SELECT entity_id AS id, count(DISTINCT suite) AS boards FROM benchmarks GROUP BY 1) USING (id)
  LEFT JOIN rates ON rates.entity_id = id WHERE register = 'model' AND params IS NOT NULL""")
def sized_models(t):
    return market.sized_models(t)


@query(_MARKET + """SELECT s.*, a.in_rate, b.in_rate AS sibling_rate FROM (SELECT m.id, m.name, min(p.id) AS sibling FROM entities m LEFT JOIN entities p ON lower(p.name) = regexp_replace(lower(m.name), '-tee$', '') AND NOT ends_with(lower(p.name), '-tee') WHERE ends_with(lower(m.name), '-tee') GROUP BY 1, 2) s LEFT JOIN rates a ON a.entity_id = s.id LEFT JOIN rates b ON b.entity_id = s.sibling""")
def tee_models(t):
    return market.tee_models(t)


@query(_MARKET + """SELECT 'called' AS part, entity_id, count(DISTINCT provider_id) AS sellers, CAST(sum(rpd) FILTER (allowance <> '') AS BIGINT) AS a_day, count(*) FILTER (allowance <> '') AS stated, any_value(params) AS params, any_value(license) AS license FROM offerings JOIN entities e ON e.id = entity_id WHERE variant = 'free' GROUP BY entity_id
UNION ALL SELECT 'run', id, NULL, NULL, NULL, params, license FROM fam WHERE register = 'model' AND lf = 'open' UNION ALL SELECT 'research', id, NULL, NULL, NULL, params, license FROM fam WHERE lf = 'noncommercial'""")
def free_report(t):
    return market.free_report(t)


@query("""SELECT part, row_number() OVER (PARTITION BY part ORDER BY f, t, name, id) AS place, id, name, makes, said FROM (
SELECT 'company' AS part, p.id, p.name, makes, said, CASE WHEN nation % 4 = 1 THEN 0 ELSE 1 END AS f, -(makes + said) AS t FROM (SELECT p.*, (SELECT count(*) FROM entities e WHERE e.maker = p.id) AS makes, (SELECT count(DISTINCT source_url) FROM docs d WHERE d.subject = p.id) AS said FROM providers p) p WHERE p.id NOT IN (SELECT provider_id FROM offerings)
UNION ALL SELECT 'unbound', source, alias, 0, 0, 0, -(DATE '2024-01-01' - DATE '1970-01-01' + length(alias)) FROM aliases WHERE entity_id NOT IN (SELECT id FROM entities)
UNION ALL SELECT 'bare', id, name, 0, 0, 0, 0 FROM entities WHERE id NOT IN (SELECT entity_id FROM offerings JOIN prices ON offering_id = id) AND id NOT IN (SELECT entity_id FROM benchmarks))""")
def waiting_report(t):
    held = SimpleNamespace(**{n: getattr(t, n) for n in ("entities", "docs", "offerings", "prices", "benchmarks")})
    held.providers = t.providers.withColumn("notes", F.when(F.col("nation") % 4 == 1, "known"))
    lost = t.aliases.join(t.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    held.queue = lost.select("source", "alias", F.expr("date_add(date'2024-01-01', length(alias))").alias("last_seen"))
    return market.waiting_report(held)


_TOTALS = "UNION ALL ".join(f"SELECT 'total' AS kind, '{n}' AS value, count(*) AS n FROM {n} " for n in ("providers", "entities", "aliases", "offerings", "prices", "benchmarks", "suites", "docs"))


@query(_MARKET + _TOTALS + """UNION ALL SELECT 'register', register, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'way', way, count(*) FROM offerings GROUP BY 2 UNION ALL SELECT 'provider kind', kind, count(*) FROM providers GROUP BY 2
UNION ALL SELECT 'licence', lf, count(*) FROM fam WHERE lf IS NOT NULL GROUP BY 2 UNION ALL SELECT 'dimension', dimension, count(*) FROM prices GROUP BY 2 UNION ALL SELECT 'task', task, count(*) FROM (SELECT unnest(string_split(tasks, ',')) AS task FROM entities) GROUP BY 2
UNION ALL SELECT 'gap', 'offering without price', count(*) FROM offerings WHERE id NOT IN (SELECT offering_id FROM prices) UNION ALL SELECT 'gap', 'entity without offering', count(*) FROM entities WHERE id NOT IN (SELECT entity_id FROM offerings)
UNION ALL SELECT 'gap', 'entity without standing', count(*) FROM entities WHERE id NOT IN (SELECT entity_id FROM benchmarks) UNION ALL SELECT 'gap', 'entity without description', count(*) FROM entities WHERE id NOT IN (SELECT subject FROM docs WHERE kind = 'description')
UNION ALL SELECT 'gap', 'provider without offering', count(*) FROM providers WHERE id NOT IN (SELECT provider_id FROM offerings)""")
def coverage_report(t):
    return market.coverage_report(t)


@query("""SELECT id, name, raised, (SELECT count(DISTINCT entity_id) FROM offerings WHERE provider_id = p.id) AS sells, (SELECT count(*) FROM entities e WHERE e.maker = p.id) AS makes,
  (SELECT arg_min(text, seq) FROM docs d WHERE d.subject = p.id AND kind = 'description' AND text IS NOT NULL AND seq = (SELECT min(seq) FROM docs x WHERE x.subject = p.id AND kind = 'description')) AS what FROM providers p WHERE raised > 0""")
def startups_report(t):
    return market.startups_report(t)


@query("SELECT person, count(*) AS places, count(DISTINCT company) AS companies FROM (SELECT DISTINCT conv_id % 50 AS company, role, trim(unnest(string_split(text, ', '))) AS person FROM sessions) WHERE person <> '' GROUP BY 1")
def people_report(t):
    return market.people_report(t.sessions.withColumn("company", F.col("conv_id") % 50), "company", "role", "text")


@query("""SELECT p.id, coalesce(makes, 0) AS makes, coalesce(resells, 0) AS resells, coalesce(sells, 0) AS sells, coalesce(backers, 0) AS backers, coalesce(holds, 0) AS holds, coalesce(makes, 0) + coalesce(sells, 0) + coalesce(backers, 0) + coalesce(holds, 0) > 0 OR raised > 0 AS page FROM providers p
LEFT JOIN (SELECT maker AS id, count(*) AS makes FROM entities GROUP BY 1) USING (id)
LEFT JOIN (SELECT provider_id AS id, count(*) AS sells, count(*) FILTER (coalesce(maker, '') <> provider_id) AS resells FROM (SELECT DISTINCT provider_id, entity_id FROM offerings) JOIN entities e ON e.id = entity_id GROUP BY 1) USING (id)
LEFT JOIN (SELECT company_id AS id, count(*) AS backers FROM investments WHERE fund_id IN (SELECT id FROM providers) GROUP BY 1) USING (id) LEFT JOIN (SELECT fund_id AS id, count(*) AS holds FROM investments WHERE company_id IN (SELECT id FROM providers) GROUP BY 1) USING (id)""")
def provider_report(t):
    return market.provider_report(t)


@query(_MARKET + """, r AS (SELECT DISTINCT id, unnest(string_split(coalesce(tasks, 'none'), ',')) AS task, coalesce(lf, 'unread') AS licence, register, CASE WHEN coalesce(open_weights AND params <= (64 * 0.7 - 1) / 0.65, false) THEN 'true' ELSE 'false' END AS local, id IN (SELECT entity_id FROM offerings) AS is_sold FROM fam)
SELECT coalesce(task, '') AS task, coalesce(licence, '') AS licence, coalesce(register, '') AS register, coalesce(local, '') AS local, count(DISTINCT id) AS n, count(DISTINCT id) FILTER (is_sold) AS sold FROM r GROUP BY CUBE (task, licence, register, local)""")
def list_report(t):
    return market.list_report(t)


@query(_MARKET + """, each AS (SELECT entity_id, dimension, count(DISTINCT provider_id) AS sellers, min((micros, provider_id)) AS low, min((-micros, provider_id)) AS high FROM sold GROUP BY 1, 2),
best AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY sellers DESC, CASE dimension WHEN 'mtok_in' THEN 1 ELSE 2 END) = 1)
SELECT entity_id, dimension AS unit, sellers, low[1] AS low, low[2] AS cheapest, -high[1] AS high, high[2] AS dearest, lanes FROM best LEFT JOIN (SELECT entity_id, string_agg(DISTINCT CASE variant WHEN 'batch' THEN 'batch' ELSE 'separately routed' END, ',' ORDER BY CASE variant WHEN 'batch' THEN 'batch' ELSE 'separately routed' END) AS lanes FROM offerings WHERE status = 'live' AND variant <> '' GROUP BY 1) USING (entity_id)""")
def spread_report(t):
    return market.spread_report(t)


@query("SELECT why, kind, count(*) AS n, CAST(sum(sellers) AS BIGINT) AS sellers FROM candidates GROUP BY 1, 2")
def pen_report(t):
    return market.pen_report(t)


@query(_MARKET + """, l AS (SELECT entity_id, provider_id, p.name AS seller, p.kind = 'aggregator' AS folds, CASE WHEN p.kind <> 'aggregator' THEN variant END AS lane, coalesce(min(micros) FILTER (variant = ''), min(micros)) AS low, coalesce(max(micros) FILTER (variant = ''), max(micros)) AS high, count(*) AS ways
FROM cur c JOIN offerings o ON o.id = c.offering_id JOIN providers p ON p.id = o.provider_id WHERE o.status = 'live' AND micros > 0 AND dimension = 'mtok_in' GROUP BY ALL)
SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY folds, low, seller, provider_id, lane) AS INT) AS line, seller, lane, low, high, ways FROM l""")
def seller_lines(t):
    return market.seller_queue(t)


@query(r""", h AS (SELECT x.*, o.entity_id, x.source_url LIKE 'https://docs.%' AS own FROM (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY offering_id, dimension, source_url ORDER BY seq DESC, taken_at DESC, micros DESC) = 1) x JOIN offerings o ON o.id = x.offering_id JOIN providers p ON p.id = o.provider_id WHERE o.status = 'live' AND o.variant = ''),
k AS (SELECT *, max(taken_at) OVER w AS newest, count(*) OVER w AS spoke FROM h WINDOW w AS (PARTITION BY offering_id, dimension)),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY offering_id, dimension ORDER BY (own AND newest - taken_at <= 45) DESC, taken_at DESC, seq DESC) = 1),
a AS (SELECT s.*, (SELECT count(*) FROM h WHERE h.offering_id = s.offering_id AND h.dimension = s.dimension AND h.micros = s.micros) AS agreed FROM s),
e AS (SELECT entity_id, dimension, min((micros, offering_id, agreed, spoke)) AS low, max(micros) AS dearest, max(taken_at) AS fresh FROM a GROUP BY 1, 2),
r AS (SELECT entity_id AS id, min((CASE dimension WHEN 'mtok_in' THEN 1 ELSE 2 END, low[1], dimension, low, dearest)) AS l, min(low[1]) FILTER (dimension = 'mtok_out') AS o, max(fresh) AS fresh FROM e GROUP BY 1),
b AS (SELECT entity_id AS id, max(((out_of - rank) / (out_of - 1), out_of, -rank)) AS s FROM (SELECT * FROM benchmarks QUALIFY row_number() OVER (PARTITION BY entity_id, suite, metric ORDER BY seq DESC) = 1) WHERE rank IS NOT NULL AND out_of > 1 GROUP BY 1)
SELECT id, '/index/' || coalesce(trim(regexp_replace(replace(replace(lower(pname), '+', ' plus '), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-'), 'commons') || '/' || coalesce(nullif(trim(regexp_replace(replace(replace(lower(x.name), '+', ' plus '), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-'), ''), trim(regexp_replace(replace(replace(lower(id), '+', ' plus '), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')) AS address, register, coalesce(pname, '') AS maker, coalesce(n, 0) AS sellers, l[3] AS unit, l[2] AS low, CASE WHEN l[3] = 'mtok_in' THEN o END AS out_rate, l[5] AS dearest, CAST(fresh AS VARCHAR) AS fresh, l[4][3] AS agreed, l[4][4] AS spoke,
  -b.s[3] AS rank, b.s[2] AS out_of, coalesce(boards, 0) AS boards FROM entities x LEFT JOIN (SELECT id AS pid, name AS pname FROM providers) ON pid = x.maker LEFT JOIN r USING (id) LEFT JOIN b USING (id) LEFT JOIN (SELECT entity_id AS id, count(DISTINCT suite) AS boards FROM benchmarks GROUP BY 1) USING (id) LEFT JOIN (SELECT entity_id AS id, count(DISTINCT provider_id) AS n FROM offerings GROUP BY 1) USING (id)""")
def list_index(t):
    return market.find_index(t.keep(offerings=("id", "entity_id", "provider_id", "status", "variant"))).withColumn("fresh", F.col("fresh").cast("string"))


@query("SELECT input_kind, output_kind, count(DISTINCT e.id) AS n, count(DISTINCT suite) AS boards FROM entities e LEFT JOIN benchmarks ON entity_id = e.id GROUP BY 1, 2")
def modality_pairs(t):
    return market.modality_pairs(t)


@query("""SELECT round(coalesce(sum(rpd) FILTER (allowance <> '' AND rpd % 3 = 0), 0) + coalesce(sum(rpd / 30) FILTER (allowance <> '' AND rpd % 3 = 1), 0), 6) AS requests, coalesce(sum(rpd * 10.0) FILTER (allowance <> '' AND rpd % 3 = 0), 0)::DOUBLE AS tokens, round(coalesce(sum(rpd / 30) FILTER (allowance <> '' AND rpd % 3 = 2), 0), 6) AS dollars,
  coalesce(sum(5.0) FILTER (allowance <> '' AND rpd % 3 = 2), 0)::DOUBLE AS dollars_once, count(*) FILTER (allowance <> '') AS stated, count(*) FILTER (allowance <> '' AND rpd % 3 > 0 AND rpd > 0) AS monthly, count(*) FILTER (allowance = '') AS unstated FROM offerings WHERE variant = 'free'""")
def free_total(t):
    n = F.col("rpd").cast("double")
    given = F.when(F.col("rpd") % 3 == 0, F.create_map(F.lit("rpd"), n, F.lit("tpd"), n * 10)).when(F.col("rpd") % 3 == 1, F.create_map(F.lit("calls_month"), n)).otherwise(F.create_map(F.lit("usd_month"), n, F.lit("usd_once"), F.lit(5.0)))
    offers = t.offerings.where("variant = 'free'").select(F.when(F.col("allowance") != "", given).otherwise(F.create_map().cast("map<string,double>")).alias("allowance"))
    got = facts.free_daily_total(offers)
    return got.select(F.round("requests", 6).alias("requests"), "tokens", F.round("dollars", 6).alias("dollars"), "dollars_once", "stated", "monthly", "unstated")


_SPELT = """, w AS (SELECT id, CASE WHEN size % 3 = 0 THEN upper(name) WHEN size % 7 = 1 THEN upper(left(name, 1)) || substr(name, 2) ELSE name END AS name, coalesce(maker, '') AS maker FROM entities), b AS (SELECT *, trim(name) AS t FROM w),
r AS (SELECT id, name, maker, regexp_extract(t, '^([A-Za-z]+)', 1) AS had FROM b WHERE NOT regexp_matches(t, '^[a-z0-9][a-z0-9._-]*$')), n AS (SELECT lower(had) AS brand, maker, had, count(*) AS n FROM r WHERE had <> '' GROUP BY ALL),
p AS (SELECT id AS maker, CASE WHEN nation % 2 = 0 THEN 'LARGE' ELSE 'Red' END AS own FROM providers), g AS (SELECT brand, maker, count(*) AS ways, max(n) AS most, max(CASE WHEN had = own THEN had END) AS own, list(had ORDER BY had) AS hads, list(n ORDER BY had) AS ns FROM n LEFT JOIN p USING (maker) GROUP BY 1, 2 HAVING count(*) > 1),
x AS (SELECT *, coalesce(own, CASE WHEN len(list_filter(ns, lambda v: v = most)) = 1 THEN hads[list_position(ns, most)] END) AS want FROM g)
"""


def _spelt(t):
    e = t.entities.withColumn("name", F.when(F.col("size") % 3 == 0, F.upper("name")).when(F.col("size") % 7 == 1, F.concat(F.upper(F.substring("name", 1, 1)), F.substr("name", F.lit(2)))).otherwise(F.col("name")))
    return facts.one_spelling(e, t.providers.select("id", F.when(F.col("nation") % 2 == 0, "LARGE Labs").otherwise("Red Co").alias("name")))


@query(_SPELT + "SELECT id, name AS was, want || substr(name, length(had) + 1) AS now, CASE WHEN own IS NOT NULL THEN 'the maker''s own name' ELSE 'the spelling most of its rows use' END AS why FROM r JOIN x ON x.brand = lower(had) AND x.maker = r.maker WHERE had <> want")
def spelling_mends(t):
    """Names put into one spelling a brand and maker."""
    return _spelt(t)[0]


@query(_SPELT + "SELECT brand, maker, array_to_string(hads, '|') AS spellings FROM x WHERE want IS NULL")
def spelling_ties(t):
    return _spelt(t)[1].select("brand", "maker", F.array_join(F.transform("spellings", lambda s: s["had"]), "|").alias("spellings"))


@query("""SELECT 'one title on several pages' AS rule, title AS words, count(*) AS pages, min(url) AS first, coalesce(min(url) FILTER (url > low), min(url)) AS other FROM (SELECT url, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, min(url) OVER (PARTITION BY trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1))) AS low FROM pages) WHERE title <> '' GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'one description on several pages', d, count(*), min(url), coalesce(min(url) FILTER (url > low), min(url)) FROM (SELECT url, d, min(url) OVER (PARTITION BY d) AS low FROM (SELECT url, 'page of day ' || (page_id % 60) AS d FROM pages)) GROUP BY 2 HAVING count(*) > 1""")
def shared_words(t):
    """Titles and descriptions of several pages; the shared pages are given a description."""
    p = t.spark.read.parquet(f"{t.sf_dir}/pages.parquet")
    meta = F.concat(F.lit('<meta name="description" content="page of day '), F.col("page_id") % 60, F.lit('">'), F.coalesce("html", F.lit("")))
    return quality.shared_words(p.select("url", meta.alias("html")))


@query("""SELECT id, 'company' AS kind, name, 'a company we have not looked at' AS why FROM providers p WHERE nation <> 3 AND id NOT IN (SELECT maker FROM entities WHERE maker IS NOT NULL) AND id NOT IN (SELECT fund_id FROM investments UNION SELECT company_id FROM investments)
AND id NOT IN (SELECT provider_id FROM offerings WHERE entity_id NOT IN (SELECT entity_id FROM offerings GROUP BY 1 HAVING count(DISTINCT provider_id) < 4))""")
def hold_companies(t):
    few = t.offerings.groupBy("entity_id").agg(F.countDistinct("provider_id").alias("n")).where("n < 4").select(F.col("entity_id").alias("id"))
    return maintenance.hold_companies(t.providers, t.providers.where("nation = 3"), t.offerings, t.entities, t.investments, few)


@query("""SELECT n AS name, CAST(round(o_totalprice) AS BIGINT) AS raised, CAST(1 AS BIGINT) AS rounds, 'https://x.org/' || k AS url, n || ' makes things. It raised $' || format('{:,}', CAST(round(o_totalprice) AS BIGINT)) || ' in a round.' AS text
FROM (SELECT 'Firm ' || o_orderkey AS n, o_orderkey AS k, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND round(o_totalprice) >= 100000)""")
def discover_companies(t):
    o = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet")
    name = F.concat(F.lit("Firm "), "o_orderkey")
    said = F.concat(name, F.lit(" makes  things.\nIt raised $"), F.format_number(F.round("o_totalprice"), 0), F.lit(" in a round.\n\nMuch later: nothing."))
    articles = o.select(name.alias("title"), said.alias("text"), (F.col("o_orderkey") % 3 != 0).alias("is_company"), (F.col("o_orderkey") % 5 == 0).alias("is_public"), F.concat(F.lit("https://x.org/"), "o_orderkey").alias("url"))
    listed = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(name, F.lit(" (company)"))).otherwise(name).alias("name"))
    return prose.discover(listed, o.where("o_orderkey % 11 = 0").select(F.upper(name).alias("name")), articles)


# Upkeep.


@query(f""", k AS (SELECT id, register, coalesce(maker, '') AS m, {_norm_sql('name')} AS form, name FROM entities), w AS (SELECT id, sum(n) AS n FROM (SELECT entity_id AS id, count(*) AS n FROM offerings o JOIN prices ON offering_id = o.id GROUP BY 1 UNION ALL SELECT entity_id, count(*) FROM benchmarks GROUP BY 1) GROUP BY 1),
r AS (SELECT k.*, row_number() OVER v AS place, first_value(k.id) OVER v AS keep, count(*) OVER (PARTITION BY register, m, form) AS size FROM k LEFT JOIN w USING (id) WHERE form <> '' AND form NOT IN {_GENERIC}
  WINDOW v AS (PARTITION BY register, m, form ORDER BY coalesce(n, 0) DESC, (CASE WHEN contains(name, ' ') THEN 2 ELSE 0 END) + (CASE WHEN contains(name, '/') THEN 0 ELSE 2 END) + (CASE WHEN regexp_matches(name, '[-_]') THEN 0 ELSE 1 END) + (CASE WHEN regexp_matches(name, '^[A-Z]') THEN 1 ELSE 0 END) DESC, k.id))
SELECT id, keep FROM r WHERE place > 1""")
def fold_groups(t):
    attached = t.offerings.select(F.col("id").alias("offering_id"), F.col("entity_id").alias("id")).join(t.prices.select("offering_id"), "offering_id").select("id").union(t.benchmarks.select("entity_id"))
    return maintenance.fold_groups(t.entities, attached.groupBy("id").agg(F.count("*").alias("n")))


@query(""", m AS (SELECT m.id AS loser, min(p.id) AS survivor FROM entities m JOIN entities p ON lower(p.name) = regexp_replace(lower(m.name), '-tee$', '') AND NOT ends_with(lower(p.name), '-tee') WHERE ends_with(lower(m.name), '-tee') GROUP BY 1),
o AS (SELECT o.id, coalesce(survivor, entity_id) AS entity_id, provider_id, way, variant, survivor IS NOT NULL AS moved FROM offerings o LEFT JOIN m ON loser = entity_id),
taken AS (SELECT DISTINCT entity_id, provider_id, way, variant, true AS taken FROM offerings)
SELECT o.id, o.entity_id, CASE WHEN moved AND taken THEN trim(variant || ' tee') ELSE variant END AS variant FROM o LEFT JOIN taken USING (entity_id, provider_id, way, variant)""")
def merge_entities(t):
    pairs = joins.suffix_sibling(t.entities).where("sibling is not null").select(F.col("id").alias("loser"), F.col("sibling").alias("survivor"), F.lit("tee").alias("hint"))
    merged = maintenance.merge_entities({n: getattr(t, n) for n in ("entities", "offerings", "aliases", "benchmarks", "docs")}, pairs)
    return merged["offerings"].select("id", "entity_id", "variant")


@query("SELECT id FROM offerings WHERE way = 'local' OR id IN (SELECT offering_id FROM prices)")
def drop_empty_offerings(t):
    return maintenance.drop_empty_offerings(t.offerings, t.prices).select("id")


@query("SELECT id, coalesce(params, size) AS params, params IS NULL AS filled FROM entities")
def fill_sizes(t):
    rows = maintenance.fill_sizes(t.entities.withColumn("name", F.concat("name", F.lit(" "), "size", F.lit("B"))))
    return rows.select("id", "params", F.col("read_from").isNotNull().alias("filled"))


@query("SELECT subject, seq, source_url FROM docs d LEFT JOIN providers p ON p.id = subject WHERE d.kind = 'description' AND length(trim(text)) >= 40 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY coalesce(regexp_extract(source_url, '(s[0-9]+[.]com|pedia.org)', 1) = regexp_extract(url, '(s[0-9]+[.]com)', 1), false) DESC, taken_at DESC, source_url, seq) = 1")
def one_description(t):
    return maintenance.one_description(t.docs, t.providers.select(F.col("id").alias("subject"), F.col("url").alias("home"))).select("subject", "seq", "source_url")


@query(""", v AS (SELECT id FROM providers WHERE nation = 3), s AS (SELECT entity_id, provider_id, id FROM offerings WHERE entity_id NOT IN (SELECT entity_id FROM offerings WHERE provider_id IN (SELECT id FROM v)))
SELECT entity_id AS id, count(DISTINCT provider_id) AS sellers, coalesce(min(micros) FILTER (dimension = 'mtok_in' AND micros > 0), min(micros) FILTER (dimension = 'mtok_out' AND micros > 0)) AS low, CAST(count(DISTINCT (provider_id, dimension, micros)) FILTER (micros IS NOT NULL) AS INT) AS rates FROM s JOIN entities e ON e.id = entity_id LEFT JOIN prices ON offering_id = s.id GROUP BY 1""")
def hold_unvetted(t):
    vetted = t.providers.where("nation = 3").select("id")
    return maintenance.hold_unvetted(t.entities, t.offerings, t.prices, vetted, ["mtok_in", "mtok_out"]).select("id", "sellers", "low", F.size("body").alias("rates"))


@query("SELECT 's' || (sellers * 7) AS id, kind, name FROM candidates WHERE kind <> 'company' OR 's' || (sellers * 7) NOT IN (SELECT id FROM providers)")
def release_arrived(t):
    held = t.candidates.withColumn("id", F.concat(F.lit("s"), F.col("sellers") * 7))
    return maintenance.release_arrived(held, t.providers).select("id", "kind", "name")


@query()
def find_new_models(t):
    """No SQL: markers of serving come off in rounds."""
    priced = t.aliases.select(F.col("alias").alias("name"), F.col("source").alias("seller"))
    return maintenance.find_new_models(priced, joins.build_key_index(t.entities), t.providers, t.candidates)


@query("SELECT id, CASE WHEN size % 2 = 0 AND size % 3 <> 0 THEN 'video' ELSE input_kind END AS input_kind, CASE WHEN size % 2 = 0 THEN 'code' ELSE output_kind END AS output_kind FROM entities")
def sync_facts(t):
    said = t.entities.where("size % 2 = 0").select("id", F.when(F.col("size") % 3 != 0, "video").alias("input_kind"), F.lit("code").alias("output_kind"))
    return maintenance.sync_facts(t.entities, said, ["input_kind", "output_kind"]).select("id", "input_kind", "output_kind")


_HEARD = """, heard AS (SELECT entity_id, CASE suite WHEN 'click' THEN 'released' WHEN 'view' THEN 'context' WHEN 'purchase' THEN 'max_output' WHEN 'signup' THEN 'reasoning' ELSE 'tool_call' END AS fact,
  CASE suite WHEN 'click' THEN CAST(taken_at AS VARCHAR) WHEN 'view' THEN CAST(seq AS VARCHAR) WHEN 'purchase' THEN CAST(seq AS VARCHAR) WHEN 'signup' THEN CASE WHEN seq % 3 = 0 THEN 'no' ELSE 'yes' END ELSE CAST(seq % 4 AS VARCHAR) END AS value FROM benchmarks)
"""


@query(_HEARD + """SELECT entity_id, fact, min(value) AS value FROM heard WHERE fact = 'released' AND value >= '2024-01-04' GROUP BY 1, 2 UNION ALL SELECT entity_id, fact, CAST(max(CAST(value AS BIGINT)) AS VARCHAR) FROM heard WHERE fact IN ('context', 'max_output') AND CAST(value AS BIGINT) > 0 GROUP BY 1, 2
UNION ALL SELECT entity_id, fact, value FROM (SELECT entity_id, fact, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY entity_id, fact) AS spoke FROM heard WHERE fact IN ('reasoning', 'tool_call') GROUP BY 1, 2, 3) WHERE 2 * n > spoke""")
def settle_facts(t):
    fact = F.when(F.col("suite") == "click", "released").when(F.col("suite") == "view", "context").when(F.col("suite") == "purchase", "max_output").when(F.col("suite") == "signup", "reasoning").otherwise("tool_call")
    value = F.when(F.col("suite") == "click", F.col("taken_at").cast("string")).when(F.col("suite").isin("view", "purchase"), F.col("seq").cast("string")).when(F.col("suite") == "signup", F.when(F.col("seq") % 3 == 0, "no").otherwise("yes")).otherwise((F.col("seq") % 4).cast("string"))
    heard = t.benchmarks.select("entity_id", fact.alias("fact"), value.alias("value"))
    return maintenance.settle_facts(heard, floors=t.benchmarks.select("entity_id").distinct().withColumn("floor", F.lit("2024-01-04")))


@query("SELECT id, CASE WHEN nation % 2 = 0 THEN 'known' END AS why FROM providers WHERE id NOT IN (SELECT provider_id FROM offerings) AND id NOT IN (SELECT maker FROM entities WHERE maker IS NOT NULL) AND id NOT IN (SELECT fund_id FROM investments)")
def justify_companies(t):
    reasons = t.providers.where("nation % 2 = 0").select("id", F.lit("known").alias("why"))
    return maintenance.justify_companies(t.providers, reasons, t.offerings, t.entities, t.investments)


@query("SELECT id FROM offerings WHERE NOT (provider_id = 's2' AND variant = 'free') UNION ALL SELECT id FROM offerings WHERE provider_id = 's2' AND variant = 'free' AND rpd > 40")
def free_lane_replace(t):
    return maintenance.free_lane_replace(t.offerings, t.offerings.where("provider_id = 's2' and variant = 'free' and rpd > 40"), "s2").select("id")


@query(_KEYS + """, p AS (SELECT suite, e.name, b.value, b.seq, row_number() OVER (PARTITION BY suite ORDER BY CASE WHEN lower_is_better THEN value ELSE -value END, seq, e.name) AS rank, count(*) OVER (PARTITION BY suite) AS out_of FROM benchmarks b JOIN entities e ON e.id = b.entity_id JOIN suites s ON s.id = suite)
SELECT n.entity_id, suite, min(rank) AS rank, any_value(out_of) AS out_of FROM p JOIN named n ON n.form = """ + _norm_sql("p.name") + " WHERE n.n_claims = 1 GROUP BY 1, 2")
def apply_boards(t):
    placements = t.benchmarks.join(t.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("suite", "metric", "name", "value", F.col("seq").alias("ord"))
    lower = t.suites.select(F.col("id").alias("suite"), "lower_is_better")
    bound, _ = maintenance.apply_boards(placements, joins.build_key_index(t.entities), lower, ["", "low", "medium", "high"])
    return bound.select("entity_id", "suite", "rank", "out_of")


@query("""SELECT e.id, (SELECT count(*) FROM offerings o WHERE o.entity_id = e.id) AS offers, (SELECT count(*) FROM offerings o JOIN prices ON offering_id = o.id WHERE o.entity_id = e.id) AS rates, (SELECT count(*) FROM aliases a WHERE a.entity_id = e.id) AS aliases,
  (SELECT count(*) FROM benchmarks b WHERE b.entity_id = e.id) AS standings, (SELECT count(*) FROM docs d WHERE d.subject = e.id) AS docs FROM entities e""")
def export_nested(t):
    rows = maintenance.export_nested(t)
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(size(c)).alias(c)
    rates = F.coalesce(F.aggregate("offerings", F.lit(0), lambda s, o: s + F.when(o["rates"].isNull(), 0).otherwise(F.size(o["rates"]))), F.lit(0))
    return rows.select("id", F.when(F.col("offerings").isNull(), 0).otherwise(size("offerings")).alias("offers"), rates.alias("rates"), n("aliases"), n("standings"), n("docs"))


_SENTENCES = """, each AS (SELECT entity_id AS id, dimension, min((micros, p.name)) AS low, list(DISTINCT p.name) AS sellers FROM cur c JOIN offerings o ON o.id = c.offering_id JOIN providers p ON p.id = o.provider_id WHERE o.status = 'live' AND o.variant = '' GROUP BY 1, 2),
told AS (SELECT id, dimension, sellers, 'The cheapest is $' || CASE WHEN low[1] / 1e6 >= 100 THEN printf('%.0f', low[1] / 1e6) WHEN low[1] / 1e6 >= 1 THEN printf('%.2f', low[1] / 1e6) ELSE regexp_replace(printf('%.8f', low[1] / 1e6), '[.]?0+$', '') END
  || CASE dimension WHEN 'mtok_in' THEN ' per million tokens in' ELSE ' per million tokens out' END || ', at ' || low[2] || '.' AS said FROM each),
rated AS (SELECT id, list_sort(list_distinct(flatten(list(sellers)))) AS sellers, string_agg(said, ' ' ORDER BY dimension) AS rates FROM told GROUP BY 1),
best_place AS (SELECT entity_id AS id, min((rank / out_of, rank, out_of, s.name)) AS s FROM benchmarks b JOIN suites s ON s.id = suite WHERE rank IS NOT NULL AND out_of > 1 GROUP BY 1),
titles(register, document, title, intro) AS (VALUES TITLES),
thing AS (SELECT t.document, t.title, t.intro, lower(e.name) AS srt, e.id AS thn, '## ' || e.name || chr(10) || chr(10) || concat_ws(' ', e.name || ' is a ' || e.register || coalesce(' made by ' || p.name || ',', '') || ' which takes ' || coalesce(nullif(input_kind, ''), 'text') || ' and returns ' || coalesce(nullif(output_kind, ''), 'text') || '.',
  'Its context window is ' || format('{:,}', size * 1000) || ' tokens.', 'It was published on ' || released || '.', CASE WHEN license IS NOT NULL THEN 'Its licence is ' || license || '.' WHEN open_weights THEN 'Its weights are published.' END,
  CASE WHEN tasks <> '' THEN 'The catalogue files it under ' || replace(tasks, ',', ', ') || '.' END, 'What the plan allows: ' || limits || '.',
  CASE WHEN sellers IS NULL THEN 'Nobody in the catalogue publishes a price for it.' ELSE len(sellers) || CASE WHEN len(sellers) = 1 THEN ' company sells' ELSE ' companies sell' END || ' it: ' || array_to_string(sellers, ', ') || '.' END, rates, 'Its best placing is ' || s[2] || ' of ' || s[3] || ' on ' || s[4] || '.',
  'Page: https://example.org/index — search for ' || e.name || '.') || chr(10) AS text FROM entities e JOIN titles t ON t.register = e.register LEFT JOIN providers p ON p.id = e.maker LEFT JOIN rated r ON r.id = e.id LEFT JOIN best_place b ON b.id = e.id),
firms AS (SELECT p.*, (SELECT count(*) FROM entities WHERE maker = p.id) AS makes, (SELECT count(DISTINCT entity_id) FROM offerings WHERE provider_id = p.id) AS sells, nation % 3 AS rounds FROM providers p),
what AS (SELECT subject, arg_min(text, seq) AS what FROM docs WHERE kind = 'description' GROUP BY 1),
backed AS (SELECT company_id AS id, string_agg(f.name, ', ' ORDER BY f.name) AS names FROM investments JOIN providers f ON f.id = fund_id GROUP BY 1),
holding AS (SELECT fund_id AS id, count(*) AS n, string_agg(c.name, ', ' ORDER BY c.name) AS names FROM investments JOIN providers c ON c.id = company_id GROUP BY 1),
firm AS (SELECT t.document, t.title, t.intro, lower(p.name) AS srt, p.id AS thn, '## ' || p.name || chr(10) || chr(10) || concat_ws(' ', p.name || ' is filed as a ' || kind || ' and its site is ' || url || '.', what, CASE WHEN makes > 0 THEN 'It makes ' || makes || CASE WHEN makes = 1 THEN ' thing' ELSE ' things' END || ' in the catalogue.' END,
  CASE WHEN sells > 0 THEN 'It sells ' || sells || CASE WHEN sells = 1 THEN ' thing.' ELSE ' things.' END END, CASE WHEN raised <> 0 THEN 'It has raised at least $' || format('{:,}', raised) || ' across ' || rounds || CASE WHEN rounds = 1 THEN ' round' ELSE ' rounds' END || ' that we could read.' END,
  'Its investors are ' || b.names || '.', 'As an investor it has backed ' || h.n || ' companies: ' || h.names || '.') || chr(10) AS text FROM firms p JOIN titles t ON t.register = 'companies' LEFT JOIN what ON subject = p.id LEFT JOIN backed b ON b.id = p.id LEFT JOIN holding h ON h.id = p.id),
places AS (SELECT b.suite, e.name, b.rank, b.out_of, b.value, row_number() OVER (PARTITION BY b.suite ORDER BY b.rank, b.seq) AS n FROM benchmarks b JOIN entities e ON e.id = b.entity_id WHERE b.rank IS NOT NULL QUALIFY n <= 40),
lines AS (SELECT suite, max(coalesce(out_of, 0)) AS field, count(*) AS n, string_agg(rank || '. ' || name || ' (' || CAST(value AS BIGINT) || ')', '; ' ORDER BY n) AS lines FROM places GROUP BY 1),
board AS (SELECT t.document, t.title, t.intro, lower(s.name) AS srt, s.id AS thn, '## ' || s.name || chr(10) || chr(10) || s.name || ' is run by ' || CASE measurer WHEN '' THEN 'its own authors' ELSE measurer END || ' and scores models on its own metric. It has ranked ' || field || ' models; the catalogue holds ' || n || ' of them. Source: ' || url || '. The standings, best first: ' || lines || '.' || chr(10) AS text
  FROM suites s JOIN titles t ON t.register = 'boards' JOIN lines l ON l.suite = s.id),
sections AS (SELECT * FROM thing UNION ALL SELECT * FROM firm UNION ALL SELECT * FROM board),
cut AS (SELECT document, '# ' || title AS lead, srt, thn, unnest(string_split(text, chr(10) || '## ')) AS x, unnest(range(len(string_split(text, chr(10) || '## ')))) AS i FROM sections),
all_blocks AS (SELECT document, lead, srt, thn, i, CASE i WHEN 0 THEN x ELSE '## ' || x END AS text FROM cut UNION ALL SELECT DISTINCT document, '# ' || title, '', '', -1, '# ' || title || chr(10) || chr(10) || intro || chr(10) FROM sections),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY i >= 0, srt, thn, i) - 1 AS k FROM all_blocks),
packed(document, k, part, size) AS (SELECT document, k, 1, length(text) FROM numbered WHERE k = 0 UNION ALL SELECT n.document, n.k, p.part + CASE WHEN p.size + length(n.text) > 40960 THEN 1 ELSE 0 END, CASE WHEN p.size + length(n.text) > 40960 THEN length(n.lead) ELSE p.size END + 2 + length(n.text) FROM packed p JOIN numbered n ON n.document = p.document AND n.k = p.k + 1),
files AS (SELECT n.document, p.part, CASE WHEN p.part > 1 THEN any_value(lead) || chr(10) || chr(10) ELSE '' END || string_agg(text, chr(10) || chr(10) ORDER BY n.k) AS text FROM packed p JOIN numbered n ON n.document = p.document AND n.k = p.k GROUP BY 1, 2)
SELECT document, CAST(part AS BIGINT) AS part, document || CASE WHEN max(part) OVER (PARTITION BY document) > 1 THEN '-' || printf('%02d', part) ELSE '' END || '.md' AS file, text FROM files""".replace("TITLES", ", ".join("('" + "', '".join(x.replace("'", "''") for x in (key, *row)) + "')" for key, row in (*passages.REGISTERS.items(), ("companies", passages.COMPANIES), ("boards", passages.BOARDS))))


@query("RECURSIVE" + _SENTENCES)
def export_passages(t):
    held = SimpleNamespace(**{n: getattr(t, n) for n in ("offerings", "prices", "benchmarks", "docs", "investments")})
    held.entities = t.entities.withColumn("context", F.col("size") * 1000)
    held.providers = t.providers.withColumns({"rounds": F.col("nation") % 3, "backing": F.lit(None).cast("string")})
    held.suites = t.suites.withColumn("metric", F.lit(None).cast("string"))
    sections = [passages.things(held, r, "https://example.org") for r in passages.REGISTERS] + [passages.companies(held), passages.boards(held)]
    return passages.export_passages(reduce(DataFrame.unionByName, sections))


@query(""", one AS (SELECT source, alias, min(entity_id) AS entity_id FROM aliases WHERE source = 'feed1' GROUP BY 1, 2), l AS (SELECT DISTINCT alias, 1000 + length(entity_id || alias) * 37 % 1000 AS micros, length(alias) * 100000 + CAST(substr(entity_id, 2) AS BIGINT) AS ord FROM aliases WHERE source IN ('feed1', 'feed2')),
x AS (SELECT *, CASE WHEN ends_with(alias, ':batch') THEN 'batch' WHEN ends_with(alias, '-fast') THEN 'fast' ELSE '' END AS lane, regexp_replace(alias, '(:batch|-fast)$', '') AS base FROM l),
b AS (SELECT x.*, CASE WHEN lane <> '' AND e.entity_id IS NOT NULL AND (d.entity_id IS NULL OR d.entity_id = e.entity_id) THEN e.entity_id ELSE d.entity_id END AS entity_id, CASE WHEN lane <> '' AND e.entity_id IS NOT NULL AND (d.entity_id IS NULL OR d.entity_id = e.entity_id) THEN lane ELSE '' END AS variant FROM x LEFT JOIN one d ON d.alias = x.alias LEFT JOIN one e ON e.alias = x.base),
f AS (SELECT entity_id, variant, arg_min(micros, ord) AS micros FROM b WHERE entity_id IS NOT NULL GROUP BY 1, 2)
SELECT (SELECT count(DISTINCT alias) FROM l) AS read, (SELECT count(DISTINCT alias) FROM b WHERE entity_id IS NOT NULL) AS bound, CAST((SELECT count(*) FROM b JOIN f USING (entity_id, variant) WHERE b.micros <> f.micros) AS BIGINT) AS clashes, (SELECT count(*) FROM f) AS written""")
def apply_listings(t):
    """The counters of one source's listings."""
    one = t.aliases.groupBy("source", "alias").agg(F.min("entity_id").alias("entity_id")).where("source = 'feed1'")
    micros, order = F.expr("1000L + length(entity_id || alias) * 37 % 1000"), F.expr("length(alias) * 100000L + cast(substring(entity_id, 2) as bigint)")
    listings = t.aliases.where("source in ('feed1', 'feed2')").select("alias", F.lit("").alias("variant"), F.lit("mtok_in").alias("dimension"), micros.alias("micros"), order.alias("ord")).distinct()
    empty_prices = t.spark.createDataFrame([], "entity_id string, provider_id string, way string, variant string, dimension string, micros long, taken_at date")
    offerings = t.offerings.select(*maintenance.OFFERING, "first_seen", "last_seen").where("false")
    queue = t.aliases.where("source = 'feed1'").select("source", "alias").where("false")
    return maintenance.apply_listings(listings, one, offerings, empty_prices, queue, "feed1", "api", "2024-02-01")["counters"]


# Feeds.

_CARDS = {
    "sambanova": ("struct(k as id, struct(cast(a / 1e6 as string) as prompt, cast(b / 1e6 as string) as completion) as pricing)", ("mtok_in", "mtok_out"), (1e6, 1e6)),
    "electronhub": ("struct(k as id, struct(cast(a as string) as input, cast(b as string) as output) as pricing)", ("mtok_in", "mtok_out"), (1e6, 1e6)),
    "ppinfra": ("struct(k as id, struct(struct(cast(a as string) as price_per_m_decimal) as prompt, struct(cast(b as string) as price_per_m_decimal) as completion) as pricing)", ("mtok_in", "mtok_out"), (1e6, 1e6)),
    "huggingface": ("struct(k as id, array(struct('x' as provider, 'live' as status, struct(a as input, b as output) as pricing), struct('y' as provider, 'down' as status, struct(a as input, b as output) as pricing)) as providers)", ("mtok_in", "mtok_out"), (1e6, 1e6)),
    "nebius": ("struct(k as name, 'ok' as status, array(struct(k as model_id, 'cheap' as label, a as input_price_per_million_tokens, b as output_price_per_million_tokens)) as flavors)", ("mtok_in", "mtok_out"), (1e6, 1e6)),
    "deepinfra": ("struct(k as model_name, struct('tokens' as type, a as cents_per_input_token, b as cents_per_output_token) as pricing)", ("mtok_in", "mtok_out"), (1e10, 1e10)),
}


@query("SELECT card, alias, dimension, micros FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS card, l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey AS alias, unnest(['{d[0]}', '{d[1]}']) AS dimension, unnest([CAST(round(l_discount * {s[0]}) AS BIGINT), CAST(round(l_tax * {s[1]}) AS BIGINT)]) AS micros FROM lineitem" for c, (_, d, s) in _CARDS.items()) + ") WHERE micros > 0")
def seller_cards(t):
    li = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").alias("k"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))

    def card(name: str, model: str) -> DataFrame:
        whole = F.array(F.expr(model)) if rate_cards.CARDS[name].root == "" else F.struct(F.array(F.expr(model)).alias("data"))
        bodies = li.select(F.to_json(whole).alias("body"))
        return rate_cards.listed_rates(bodies, rate_cards.CARDS[name]).select(F.lit(name).alias("card"), "alias", "dimension", "micros")

    parts = [card(name, model) for name, (model, _, _) in _CARDS.items()]
    return reduce(DataFrame.union, parts)


@query("""SELECT k AS key, 'seller' || (l_suppkey % 7) AS seller, lane, dimension, micros FROM (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey AS k, l_suppkey, unnest(['', 'batch', '']) AS lane, unnest(['mtok_in', 'mtok_in', 'second_out']) AS dimension,
  unnest([CAST(round(l_tax * 1e6) AS BIGINT), CAST(round(l_discount * 1e6) AS BIGINT), CASE WHEN l_linenumber % 2 = 0 THEN CAST(round(l_quantity * 1e6) AS BIGINT) ELSE 0 END]) AS micros FROM lineitem) WHERE micros > 0 AND l_suppkey % 7 < 4""")
def price_file(t):
    li = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    mode = F.when(F.col("l_linenumber") % 2 == 0, "audio_speech").otherwise("chat")
    fields = F.struct(F.concat(F.lit("p"), F.col("l_suppkey") % 7).alias("litellm_provider"), mode.alias("mode"), (F.col("l_tax") / 1e6).alias("input_cost_per_token"), (F.col("l_discount") / 1e6).alias("input_cost_per_token_batches"), F.col("l_quantity").alias("output_cost_per_second"))
    bodies = li.select(F.to_json(F.create_map(key, fields)).alias("body"))
    sellers = t.spark.createDataFrame([(f"p{i}", f"seller{i}") for i in range(4)], "key string, seller string")
    rows = price_files.chosen_sellers(price_files.flatten_price_file(bodies), sellers, "seller_key")
    return rows.select("key", "seller", "lane", "dimension", "micros")


@query("""SELECT 'gpt ' || (l_partkey % 300) AS alias, CASE WHEN l_linenumber % 2 = 0 THEN 'batch' ELSE '' END AS variant, CASE WHEN l_linestatus = 'O' THEN 'mtok_out' ELSE 'mtok_in' END || CASE l_returnflag WHEN 'A' THEN '_audio' ELSE '' END AS dimension, min(CAST(round(price * 1e6) AS BIGINT)) AS micros
FROM (SELECT *, l_partkey % 300 + 1 + CASE WHEN l_partkey % 300 < 50 THEN l_tax ELSE 0 END AS price FROM lineitem) WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3 HAVING count(DISTINCT round(price * 1e6)) = 1""")
def meters(t):
    li = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet")
    sku = F.concat_ws(" ", F.lit("gpt"), F.col("l_partkey") % 300, F.when(F.col("l_linenumber") % 2 == 0, "Batch"), F.when(F.col("l_returnflag") == "A", "aud"), F.when(F.col("l_linestatus") == "O", "Outp").otherwise("Inp"), F.when(F.col("l_returnflag") == "R", "regnl").otherwise("glbl"))
    return price_files.classify_meters(li.select(sku.alias("skuName"), F.lit("1M").alias("unitOfMeasure"), (F.col("l_partkey") % 300 + 1 + F.when(F.col("l_partkey") % 300 < 50, F.col("l_tax")).otherwise(0)).alias("retailPrice")))


#: Rows of a printed board that the lens puts on one page, about.
_ON_A_PAGE = 400


@query(f"SELECT suite || '/' || (seq // {_ON_A_PAGE}) AS key, 'Model ' || entity_id AS name, value, seq AS ord FROM benchmarks JOIN (SELECT suite, seq // {_ON_A_PAGE} AS p FROM benchmarks GROUP BY 1, 2 HAVING count(*) >= 8) w USING (suite) WHERE seq // {_ON_A_PAGE} = p")
def html_tables(t):
    url = F.concat_ws("/", "suite", F.expr(f"seq div {_ON_A_PAGE}"))
    cell = F.concat(F.lit("<tr><td>Model <b>"), "entity_id", F.lit("</b></td><td>"), F.col("value").cast("string"), F.lit(" &plusmn;5</td></tr>"))
    rows = t.benchmarks.groupBy(url.alias("url")).agg(F.array_sort(F.collect_list(F.struct("seq", cell.alias("c")))).alias("r"))
    page = F.concat(F.lit("<table><tr><td>x</td></tr></table><table><tr><th>Model</th><th>Score now</th></tr>"), F.array_join(F.transform("r", lambda x: x["c"]), ""), F.lit("</table>"))
    got = scores.extract_html_table(rows.select("url", page.alias("html")), "Model", "Score")
    order = t.benchmarks.select(url.alias("key"), "seq", F.row_number().over(W.partitionBy(url).orderBy("seq")).cast("long").alias("ord"))
    return got.join(order, ["key", "ord"]).select("key", "name", "value", F.col("seq").alias("ord"))


@query("""SELECT 'b_' || suite || '_' || CAST(taken_at AS VARCHAR) AS suite, entity_id AS name, CASE WHEN value BETWEEN 0 AND 1 THEN value * 100 ELSE value END AS value, count(*) AS n FROM benchmarks JOIN (SELECT suite, taken_at FROM benchmarks GROUP BY 1, 2 HAVING count(*) >= 8) USING (suite, taken_at) GROUP BY 1, 2, 3""")
def score_csvs(t):
    line = F.concat_ws(",", "entity_id", "value")
    files = t.benchmarks.groupBy(F.concat_ws("_", "suite", "taken_at").alias("stem")).agg(F.concat(F.lit("Model,Score\n"), F.array_join(F.collect_list(line), "\n")).alias("body"))
    got = scores.read_score_csvs(files.select(F.concat("stem", F.lit(".csv")).alias("path"), "body"), prefix="b_")
    return got.groupBy("suite", "name", "value").agg(F.count("*").alias("n"))


@query("""SELECT target, count(*) AS pages FROM (SELECT DISTINCT url, unnest(regexp_extract_all(coalesce(html, ''), 'href="(/[^"#?]*)', 1)) AS target FROM pages) WHERE target NOT IN (SELECT regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) FROM pages) GROUP BY 1""")
def dead_links(t):
    return quality.dead_links(t.spark.read.parquet(f"{t.sf_dir}/pages.parquet"))


# Text.


@query(r"""SELECT url, left(title, 160) AS title, CASE WHEN length(d) < 25 THEN '' ELSE left(d, 600) END AS description FROM (SELECT url, trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
  regexp_extract(coalesce(html, ''), '(?is)<meta[^>]+name=[\x22\x27]description[\x22\x27][^>]+content=[\x22\x27](.*?)[\x22\x27]', 1) AS d FROM pages) WHERE title <> '' OR length(d) >= 25""")
def page_meta(t):
    return prose.page_meta(t.spark.read.parquet(f"{t.sf_dir}/pages.parquet"))


#: Sentences in which an amount is told, by the remainder of the order's key, and what they say was raised: the amount, so many times the amount, or nothing.
_TOLD = [
    ("It plans to raise $900 million in a round. The firm secured ${} in seed funding at a $5 billion valuation. Revenue came to $7 million.", 1),
    ("In May the company, which is small, raised €2 million (${}) in a Series B round led by others.", 1),
    ("The company was valued at ${} in a funding round. It will close a seed round of ${}.", 0),
    ("It announced a financing of US${}, a contract worth $8 million and a fine of $9 million. It is in talks to raise ${} in a round.", 0),
    ("The round closed at £{}. A contract worth ${} was secured in a round.", 0),
    ("Acme completed a pre-seed round: £3 million first, then ${} in all; it had obtained funding before. Later it received an investment of ${} again.", 1),
]


@query(f"SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders WHERE round(o_totalprice) >= 100000 AND o_orderkey % {len(_TOLD)} IN ({', '.join(str(i) for i, (_, n) in enumerate(_TOLD) if n)})")
def funding_rounds(t):
    o = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet")
    amount, said = F.format_number(F.round("o_totalprice"), 0), F.lit("")
    for i, (sentence, _) in enumerate(_TOLD):
        said = F.when(F.col("o_orderkey") % len(_TOLD) == i, F.replace(F.lit(sentence), F.lit("{}"), amount)).otherwise(said)
    return prose.funding_rounds(o.select(F.col("o_orderkey").alias("id"), said.alias("text"))).select("id", "amount")


@query("""SELECT id, fund FROM (SELECT o_orderkey AS id, unnest(CASE o_orderkey % 5 WHEN 0 THEN ['Fund' || (o_custkey % 40) || ' Capital', 'Index Ventures'] WHEN 1 THEN ['Fund' || (o_custkey % 40) || ' Partners'] WHEN 2 THEN ['Angel' || (o_custkey % 40) || ' Holdings', 'SoftBank', 'Crédit du Fund'] WHEN 3 THEN []
  ELSE ['B' || (o_custkey % 40) || ' Equity'] END) AS fund FROM orders) WHERE fund <> 'Crédit du Fund'""")
def investor_names(t):
    o = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet")
    n = (F.col("o_custkey") % 40).cast("string")
    said = F.element_at(F.array(
        F.concat(F.lit("The round was led by Fund"), n, F.lit(" Capital and others, with participation from Index Ventures and Somebody.")),
        F.concat(F.lit("In 2023, Fund"), n, F.lit(" Partners committed a further sum to its funding. Existing Investors led a round; The Capital took part.")),
        F.concat(F.lit("It is backed by Angel"), n, F.lit(" Holdings ($2 billion), SoftBank (a stake) & the Fund which is new. It raised $5 million from SoftBank at a price, Accel.")),
        F.concat(F.lit("Nobody"), n, F.lit(" was led by anyone. A fund is not a name, and Series Capital is none.")),
        F.concat(F.lit("Investors including A, and investment from B"), n, F.lit(" Equity; co-led by B"), n, F.lit(" EQUITY. funded by (a16z Growth), of late")),
    ), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return prose.investors(o.select(F.col("o_orderkey").alias("id"), said.alias("text")))


@query("SELECT seq, length(trim(text)) >= 30 AND contains(regexp_replace(lower(text || source_url), '[^a-z0-9]', '', 'g'), 'the') AS keep FROM docs WHERE text IS NOT NULL")
def keep_description(t):
    return t.docs.where("text is not null").select("seq", prose.keep_description(F.lit("The"), F.col("text"), F.col("source_url")).alias("keep"))


@query("SELECT conv_id % 50 AS company, role, array_to_string(list_sort(list(DISTINCT (turn, text)))[1:6].list_transform(lambda x: x[2]), '|') AS people FROM sessions WHERE turn % 3 <> 0 AND text IS NOT NULL GROUP BY 1, 2")
def current_people(t):
    claims = t.sessions.where("text is not null").select((F.col("conv_id") % 50).alias("company"), "role", F.col("text").alias("person"), (F.col("turn") % 3 == 0).alias("deprecated"), F.lit(None).cast("string").alias("ended"), F.col("turn").alias("ord"))
    return prose.current_people(claims).select("company", "role", F.array_join("people", "|").alias("people"))


@query("SELECT p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'Old ' || p_size END AS was, CASE WHEN p_size % 2 = 0 THEN p_brand END AS acquired_by FROM part")
def parse_portfolio(t):
    p = t.spark.read.parquet(f"{t.sf_dir}/part.parquet")
    printed = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" (ex-Old "), "p_size", F.lit(")"))).otherwise(" (an aside)"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" (acquired by "), "p_brand", F.lit(")"))).otherwise(""))
    return prose.parse_portfolio(p.select(printed.alias("printed")))


@query()
def hashed_embeddings(t):
    """(doc_id, length): how long each text's hashed vector is, 1 where there is a word. No SQL: 64-bit hashes wrap round."""
    d = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet").select("doc_id", "text")
    return prose.embed(d, "text").select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("length"))


@query("SELECT min(n) AS name FROM (SELECT c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (company)' ELSE '' END AS p, c_name AS n FROM customer) WHERE regexp_replace(lower(n), '[^a-z0-9]', '', 'g') NOT IN (SELECT regexp_replace(lower(replace(s_name, 'Supplier', 'Customer')), '[^a-z0-9]', '', 'g') FROM supplier) GROUP BY regexp_replace(lower(n), '[^a-z0-9]', '', 'g')")
def unheard_companies(t):
    read = lambda n: t.spark.read.parquet(f"{t.sf_dir}/{n}.parquet")
    listed = read("customer").select(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, " (company)").otherwise("")).alias("name"))
    return prose.unheard(listed, read("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name")))


# Findings and streams.


@query("""SELECT goes_to, count(*) AS n FROM (SELECT CASE WHEN size % 4 = 0 THEN CASE WHEN one AND p.id IS NOT NULL THEN 'prices' WHEN one THEN 'evidence' ELSE 'dropped' END WHEN size % 4 = 1 THEN CASE WHEN one THEN 'standings' ELSE 'dropped' END
  WHEN size % 4 = 2 THEN CASE WHEN p.id IS NULL THEN 'dropped' WHEN one THEN 'already_held' ELSE 'candidates' END ELSE CASE WHEN one THEN 'evidence' ELSE 'dropped' END END AS goes_to
  FROM (SELECT e.*, count(*) OVER (PARTITION BY regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) = 1 AS one FROM entities e WHERE regexp_matches(name, '^[a-z]+ [a-z]+ [0-9]+$')) LEFT JOIN (SELECT min(id) AS id, name FROM providers GROUP BY 2) p ON p.name = 'Supplier ' || (size * 3)) GROUP BY 1""")
def route_findings(t):
    e = t.entities.where(F.col("name").rlike("^[a-z]+ [a-z]+ [0-9]+$"))
    kind = F.when(F.col("size") % 4 == 0, "price").when(F.col("size") % 4 == 1, "standing").when(F.col("size") % 4 == 2, "mention").otherwise("event")
    says = F.when(F.col("size") % 4 == 0, "$2.50 per 1M tokens").otherwise("3 of 50 on Some Board — Score 81.5 %")
    who = F.concat(F.lit("Supplier "), F.col("size") * 3)
    line = F.to_json(F.struct(kind.alias("what"), "name", says.alias("says"), F.lit("https://x.org").alias("source"), F.lit("2024-05-06T01:00:00").alias("read_at"), who.alias("seller"), who.alias("maker")))
    files = e.groupBy(F.expr("cast(substring(id, 2) as bigint) div 50").cast("string").alias("file")).agg(F.array_join(F.collect_list(line), "\n").cast("binary").alias("content"))
    new = findings.unseen_files(files, t.spark.createDataFrame([], "file string, hash string"))
    routed = findings.route_findings(findings.read_findings(new), joins.build_key_index(e), t.providers)
    return findings.deliver(lambda name, rows: None, routed, new, dry=True)


@query(""", m AS (SELECT *, max(d) OVER (PARTITION BY suite, entity) AS newest FROM (SELECT event_type AS suite, user_id AS entity, CAST(ts AS DATE) AS d, event_id, value, event_id % 3 = 0 AS own FROM events))
SELECT suite, entity, CAST(d AS VARCHAR) AS taken_at, value, own AND d >= newest - INTERVAL 5 DAY AS own_page FROM m QUALIFY row_number() OVER (PARTITION BY suite, entity ORDER BY (own AND d >= newest - INTERVAL 5 DAY) DESC, d DESC, event_id DESC) = 1""")
def price_refresh_stream(t):
    shape = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    e = t.spark.readStream.schema(shape).parquet(f"{t.sf_dir}/events.parque[t]")
    rows = e.select(F.col("event_type").alias("suite"), F.col("user_id").alias("entity"), F.to_date("ts").alias("taken_at"), "event_id", "value", (F.col("event_id") % 3 == 0).alias("own_source"))
    newest = findings.newest_prices(rows, ["suite", "entity"], "own_source", "taken_at", ["event_id"], ["value"])
    got = findings.fresh_price(changes.drain_latest(newest, "refresh", ["suite", "entity"]), ["suite", "entity"], "taken_at", ["value"], 5)
    return got.withColumn("taken_at", F.col("taken_at").cast("string"))
