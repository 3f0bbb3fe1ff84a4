"""Rules that put a catalogue's rows right, all in one pass, and the order in which its addresses are listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.functions import ordered

# Rules of upkeep, characters that are left at a name's ends, and how long what is left must be.
RULES = (
    "an embedding model that says it returns text", "a name that stops inside a bracket", "two names written as one with a slash", "a name ending in punctuation left behind", "a seller standing in for the maker", "published before its own training data",
)
LEFT_BEHIND, SHORTEST = r" \-–—:|/(", 2


def normalise_rules(entities: DataFrame, providers: DataFrame, offerings: DataFrame) -> tuple[DataFrame, Observation]:
    """Entities with all rules of upkeep applied, one after another, and broken, the array of the rules that found them; and what counts each rule's finds while the rows go by.

    entities has id, name, maker, output_kind, tasks (an array), released and knowledge. A name is cut only if something is left;
    the find counts all the same. A maker goes if it is an aggregator or a cloud that sells nothing that it made through an interface of its own.
    Later rules see what earlier ones left. Nulls break no rule.
    """
    own = offerings.where("way = 'api'").select(F.col("entity_id").alias("id"), "provider_id").join(entities.select("id", "maker"), "id").where("maker = provider_id").select(F.col("maker")).distinct()
    sellers = providers.where(F.col("kind").isin("aggregator", "cloud")).select(F.col("id").alias("maker")).join(own, "maker", "left_anti").withColumn("_seller", F.lit(True))
    rows = entities.join(sellers, "maker", "left")
    found: dict[str, Column] = {}
    name, tags = F.col("name"), F.coalesce("tasks", F.array().cast("array<string>"))
    found[RULES[0]] = (F.col("output_kind") == "text") & F.array_contains(tags, "embedding") & ~F.array_contains(tags, "rerank")
    found[RULES[1]] = name.contains("(") & ~name.contains(")")
    cut = F.rtrim(F.split_part(name, F.lit("("), F.lit(1)))
    name = F.when(found[RULES[1]] & (F.char_length(cut) > SHORTEST), cut).otherwise(name)
    found[RULES[2]] = name.contains("/")
    name = F.replace(name, F.lit("/"), F.lit(" "))
    trimmed = F.regexp_replace(name, f"^[{LEFT_BEHIND}]+|[{LEFT_BEHIND}]+$", "")
    found[RULES[3]] = trimmed != name
    name = F.when(F.char_length(trimmed) > SHORTEST, trimmed).otherwise(name)
    found[RULES[4]] = F.col("_seller").isNotNull()
    found[RULES[5]] = F.col("released") < F.col("knowledge")
    hits = {f"_r{i}": F.coalesce(found[r], F.lit(False)) for i, r in enumerate(RULES)}
    rows = rows.withColumns({**hits, "_name": name})
    counts = Observation()
    rows = rows.observe(counts, *(F.count(F.when(F.col(f"_r{i}"), 1)).alias(r) for i, r in enumerate(RULES)))
    new = {"name": F.col("_name"), "output_kind": F.when(F.col("_r0"), "embedding").otherwise(F.col("output_kind")), "maker": F.when(~F.col("_r4"), F.col("maker")), "released": F.when(~F.col("_r5"), F.col("released"))}
    broken = F.array_compact(F.array(*(F.when(F.col(f"_r{i}"), r) for i, r in enumerate(RULES))))
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in entities.columns), broken.alias("broken")), counts


# The site's own addresses before and after the others, its hubs by register, rows a page, families of licences and memory that devices have, in their order.
BEFORE = ("/index", "/index/1dollar", "/index/tech", "/index/startups", "/index/sizes")
HUBS = {"model": "models", "tool": "tools", "agent": "agents", "subscription": "subscriptions"}
A_PAGE = 100
FAMILIES = ("open", "open-with-conditions", "noncommercial", "proprietary")
DEVICES = {"8gb": 8.0, "16gb": 16.0, "24gb": 24.0, "32gb": 32.0, "36gb": 36.0, "64gb": 64.0, "96gb": 96.0, "128gb": 128.0, "256gb": 256.0}


def _pages(n: DataFrame, hub: Column) -> DataFrame:
    """(by, address): the pages of a hub of n things, one at least."""
    page = F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n") / A_PAGE), F.lit(1)).cast("int")))
    return n.withColumn("hub", hub).withColumn("page", page).select(F.format_string("%012d", "page").alias("by"), F.concat(F.lit("/index/"), "hub", F.when(F.col("page") > 1, F.concat(F.lit("/"), F.col("page").cast("string"))).otherwise("")).alias("address"))


def addresses(t, terms: DataFrame, niches: list[str]) -> DataFrame:
    """(place, address): every address of the site, each once, where it comes first, numbered in their order over all partitions.

    A company that neither makes nor sells has one only with a note, a mark, money, a description or an investment. Lists have one if they have a member. t has entities(id, name, register, maker,
    tasks as an array, license, params in billions, input_kind, output_kind), providers(id, name, notes, backing, raised), offerings, benchmarks, docs and investments; terms has slug.
    Within a part: companies by id, things by name, other parts by their words, modality pairs by size.
    """
    spark = t.entities.sparkSession
    word = lambda *rows: spark.createDataFrame([(f"{i:03}", a) for i, a in enumerate(rows)], "by string, address string")
    one = lambda df, by, *address: df.select(by.cast("string").alias("by"), F.concat(*(F.lit(a) if isinstance(a, str) else a for a in address)).alias("address"))
    slug = X.address_slug
    e, p = t.entities, t.providers
    busy = t.offerings.select(F.col("provider_id").alias("id")).union(e.where("maker is not null").select("maker")).distinct()
    told = t.docs.where("kind = 'description'").select(F.col("subject").alias("id")).union(t.investments.select("fund_id")).union(t.investments.select("company_id")).distinct()
    filled = p.join(busy.withColumn("_busy", F.lit(True)), "id", "left").join(told.withColumn("_told", F.lit(True)), "id", "left")
    justified = F.col("_busy") | F.col("_told") | (F.coalesce("notes", F.lit("")) != "") | F.col("backing").isNotNull() | F.col("raised").isNotNull()
    head, tail = X.entity_address(F.col("name"), F.col("id"), F.col("_maker"))
    things = e.join(p.select(F.col("id").alias("maker"), F.col("name").alias("_maker")), "maker", "left")
    family = X.licence_family(F.col("license"))
    tagged = e.select(F.explode("tasks").alias("tag"), family.alias("family"), "license", "params")
    tag, family_at = slug(F.col("tag")), F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("string")
    fits = F.explode(F.filter(F.array(*(F.struct(F.lit(f"{i:02}").alias("by"), F.lit(d).alias("device"), F.round(X.fits_billions(F.lit(gb)) * 1e9).alias("most")) for i, (d, gb) in enumerate(DEVICES.items()))), lambda d: F.col("params") * 1e9 <= d["most"]))
    closed = F.coalesce(F.col("license") != X.CLOSED, F.lit(False))
    device = e.where(closed).select(fits.alias("d")).select("d.*").distinct()
    lent = tagged.where(closed).select("tag", fits.alias("d")).select("tag", "d.*").distinct()
    local = one(device, F.col("by"), "/index/local/", F.col("device")).unionByName(one(lent, F.concat("by", F.lit(" "), "tag"), "/index/local/", F.col("device"), "/for/", tag))
    count = lambda df: df.agg(F.count("*").alias("n"))
    parts = [
        word(*BEFORE), one(terms, F.col("slug"), "/index/tech/", F.col("slug")), *(_pages(count(e.where(F.col("register") == r)), F.lit(h)) for r, h in HUBS.items()), _pages(count(p.join(busy, "id", "left_semi")), F.lit("providers")),
        one(filled.where(justified), F.col("id"), "/index/", slug(F.col("name"))), one(things, F.concat("name", F.lit("\x01"), "id"), "/index/", head, "/", tail),
        one(t.benchmarks.select("suite").distinct(), F.col("suite"), "/index/board/", slug(F.col("suite"))), one(e.where("license is not null").select("license").distinct(), F.col("license"), "/index/licence/", slug(F.col("license"))),
        one(tagged.select("tag").distinct(), F.col("tag"), "/index/for/", tag),
        one(e.groupBy("input_kind", "output_kind").count(), F.format_string("%015d %s %s", F.lit(10**14) - F.col("count"), "input_kind", "output_kind"), "/index/does/", slug(F.col("input_kind")), "-to-", slug(F.col("output_kind"))),
        one(e.where(family.isNotNull()).select(family.alias("family")).distinct(), family_at, "/index/licence/", F.col("family")), one(tagged.where("family is not null").select("tag", "family").distinct(), F.concat("tag", F.lit("\x01"), family_at), "/index/for/", tag, "/licence/", F.col("family")),
        local, word("/index/waiting", "/index/free", *(f"/index/free/{h}" for h in HUBS.values()), "/index/top", *(f"/index/top/{n}" for n in niches), "/index/lists", "/index/coverage"),
    ]
    every = reduce(DataFrame.unionByName, (df.withColumn("part", F.lit(i)) for i, df in enumerate(parts)))
    first = every.where("address is not null").groupBy("address").agg(F.min(F.struct("part", "by")).alias("f")).select("address", "f.part", "f.by")
    return ordered.placed(first, [], [F.col("part"), F.col("by"), F.col("address")]).select("place", "address")
