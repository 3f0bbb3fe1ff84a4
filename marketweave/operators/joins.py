"""Joins that bind names to entities and companies to each other; blocking keys, never a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions import names
from marketweave.functions.expressions import norm

# Suffixes by which a source sells the same thing another way, and the lanes they stand for.
LANES = {":batch": "batch", ":thinking": "thinking", ":extended": "extended", ":online": "online", "-fast": "fast", "-preview": "preview", " Latency Optimized": "latency-optimized"}
# Words that a company adds to its own name.
CORPORATE = ("ai", "inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "plc", "group", "lab", "labs", "technologies", "technology", "systems", "company", "co", "holdings", "sa", "gmbh", "bv", "oy", "ab")


def bind_alias(listings: DataFrame, aliases: DataFrame, source: str = "source", alias: str = "alias", variant: str | None = None, lanes: dict[str, str] = LANES) -> DataFrame:
    """Adds entity_id and variant: the lane of a suffix where the alias without it names the same entity, or the whole names none; else the exact alias and the listing's own variant."""
    lane, suffix = F.lit(""), F.lit("")
    for end, name in lanes.items():
        lane, suffix = F.when(F.col(alias).endswith(end), name).otherwise(lane), F.when(F.col(alias).endswith(end), end).otherwise(suffix)
    rows = listings.withColumns({"_lane": lane, "_own": F.col(variant) if variant else F.lit("")})
    rows = rows.withColumn("_base", F.col(alias).substr(F.lit(1), F.length(alias) - F.length(suffix)))
    direct = aliases.select(F.col(source), F.col(alias), F.col("entity_id").alias("_direct"))
    base = aliases.select(F.col(source), F.col(alias).alias("_base"), F.col("entity_id").alias("_of_base"))
    rows = rows.join(direct, [source, alias], "left").join(base, [source, "_base"], "left")
    by_lane = (F.col("_lane") != "") & F.col("_of_base").isNotNull() & (F.col("_direct").isNull() | (F.col("_direct") == F.col("_of_base")))
    entity = F.when(by_lane, F.col("_of_base")).otherwise(F.col("_direct"))
    kept = [c for c in listings.columns if c != "variant"]
    return rows.select(*kept, entity.alias("entity_id"), F.when(by_lane, F.col("_lane")).otherwise(F.col("_own")).alias("variant"))


def key_index(names: DataFrame, entity: str, name: str) -> DataFrame:
    """Normal form of a name, how many entities claim it, and the least of them."""
    return names.select(norm(F.col(name)).alias("form"), entity).where("form <> ''").groupBy("form").agg(F.countDistinct(entity).alias("n_claims"), F.min(entity).alias(entity))


def resolve_forms(names: DataFrame, forms: Column, index: DataFrame, entity: str, name: str = "name") -> DataFrame:
    """The nearest form that the index knows decides; an ambiguous one gives no entity. Distinct names are resolved once."""
    tried = names.select(name).distinct().select(name, F.posexplode(forms).alias("pos", "form"))
    hit = tried.join(index, "form").groupBy(name).agg(F.min(F.struct("pos", "n_claims", entity, "form")).alias("_h"))
    found = hit.select(name, F.when(F.col("_h.n_claims") == 1, F.col("_h")[entity]).alias(entity), F.col("_h.form").alias("form"))
    return names.join(found, name, "left")


def unresolved(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Names without a match, with their counts."""
    return names.join(known, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def same_company(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Pairs of names that are one company's. Blocked on the first word, or on the words before the corporate ones at the end."""
    a, b = left.withColumn("_block", company_block(F.col(left_name))), right.withColumn("_block", company_block(F.col(right_name)))
    return a.join(b, "_block").where(one_company(F.col(left_name), F.col(right_name))).drop("_block")


def company_block(name: Column) -> Column:
    """The words of a name without the corporate ones at its end: equal for all names of one company, but the first word always stays."""
    words = company_words(name)
    kept = F.aggregate(words, F.struct(F.lit(0).alias("i"), F.lit(1).alias("last")), lambda s, w: F.struct((s["i"] + 1).alias("i"), F.when(w.isin(*CORPORATE), s["last"]).otherwise(s["i"] + 1).alias("last")))["last"]
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, F.lit(1), kept), " "))


def twins(rates: DataFrame, offering: str, group: list[str], dimension: str, value: str) -> DataFrame:
    """Offerings of one group whose whole rate sets are equal to an earlier one's: (group, first, offering)."""
    sets = rates.groupBy(*group, offering).agg(F.sort_array(F.collect_set(F.struct(dimension, value))).alias("_rates"))
    first = sets.groupBy(*group, "_rates").agg(F.min(offering).alias("first"))
    return sets.join(first, [*group, "_rates"]).where(F.col(offering) > F.col("first")).select(*group, "first", offering)


def only_unvetted(sold: DataFrame, entity: str, vetted: str) -> DataFrame:
    return sold.groupBy(entity).agg(F.max(vetted).alias("_any")).where(~F.col("_any")).select(entity)


def build_key_index(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(form, n_claims, entity_id): every key that entities answer to by name or alias, how many claim it, and the least of those."""
    said = entities.select(F.col("id").alias("entity_id"), "name", F.lit(False).alias("whole"))
    if aliases is not None:
        said = said.union(aliases.select("entity_id", F.col("alias"), F.lit(True)))
    own = F.array_union(names.index_forms(F.col("name")), F.when(F.col("whole"), F.array(norm(F.col("name")))).otherwise(F.array().cast("array<string>")))
    forms = said.select("entity_id", F.explode(own).alias("form")).where((F.col("form") != "") & ~names.generic(F.col("form")))
    return forms.groupBy("form").agg(F.countDistinct("entity_id").alias("n_claims"), F.min("entity_id").alias("entity_id"))


def tried_forms(rows: DataFrame, name: str) -> DataFrame:
    """(name, pos, form) of every distinct name's forms, nearest first, words too common to be a key left out."""
    return rows.select(name).distinct().select(name, F.posexplode(names.forms(F.col(name))).alias("pos", "form")).where(~names.generic(F.col("form")))


def resolve(rows: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """Adds entity_id: what the nearest form that the index knows names, nothing if several entities claim that form. Names are resolved once each."""
    hit = tried_forms(rows, name).join(index, "form").groupBy(name).agg(F.min(F.struct("pos", "n_claims", "entity_id")).alias("_h"))
    return rows.join(hit.select(name, F.when(F.col("_h.n_claims") == 1, F.col("_h.entity_id")).alias("entity_id")), name, "left")


def misfiled_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, filed_on, names): aliases of which a nearer form names another entity than the one they are filed on, which a farther form names."""
    one = build_key_index(entities).where("n_claims = 1").select("form", F.col("entity_id").alias("hit"))
    tried = tried_forms(aliases.where("alias <> ''"), "alias").join(one, "form")
    met = aliases.select("alias", F.col("entity_id").alias("filed_on")).distinct().join(tried, "alias")
    own = F.col("hit") == F.col("filed_on")
    first = met.groupBy("alias", "filed_on").agg(F.min(F.when(own, F.col("pos"))).alias("mine"), F.min(F.when(~own, F.struct("pos", "hit"))).alias("other"))
    return first.where("other.pos < mine").select("alias", "filed_on", F.col("other.hit").alias("names"))


def rehome_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(source, alias, filed_on, entity_id): aliases that are exactly another entity's unique name."""
    one = build_key_index(entities).where("n_claims = 1").select("form", "entity_id")
    rows = aliases.select("source", "alias", F.col("entity_id").alias("filed_on"), norm(F.col("alias")).alias("form"))
    return rows.join(one, "form").where("filed_on <> entity_id").drop("form")


# Words that a fund adds to its own name.
FUND_WORDS = ("capital", "venture", "ventures", "partner", "partners", "fund", "funds", "management", "associates", "investment", "investments", "equity", "collective", "group", "lab", "labs", "ai")


def fold_funds(funds: DataFrame, investments: DataFrame) -> DataFrame:
    """(id, keep): funds whose names are another's with one fund word behind it, and the one of them that stays: the most invested, then the longest name.

    A group is a bare name that stands alone with all names one word longer, so it meets in an equi-join on that name.
    """
    bare = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    n = investments.groupBy(F.col("fund_id").alias("id")).agg(F.count("*").alias("n"))
    rows = funds.select("id", "name", bare.alias("bare")).join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    words = [F.when(F.col("bare").endswith(w) & (F.length("bare") > len(w)), F.expr(f"substring(bare, 1, length(bare) - {len(w)})")) for w in FUND_WORDS]
    roots = rows.withColumn("root", F.explode(F.array_distinct(F.array_compact(F.array(F.col("bare"), *words)))))
    alone = rows.select(F.col("bare").alias("root")).distinct()
    grouped = roots.join(alone, "root").groupBy("id", "name", "n").agg(F.min(F.struct(F.length("root"), "root")).getField("root").alias("root"))
    best = grouped.groupBy("root").agg(F.max(F.struct("n", F.length("name").alias("l"), "id")).getField("id").alias("keep"))
    return grouped.join(best, "root").where("id <> keep").select("id", "keep")


def plans_for(entities: DataFrame, includes: str | None = None) -> DataFrame:
    """(entity_id, plan): the subscriptions derived from a thing or that include it."""
    plans = entities.where("register = 'subscription'")
    derived = plans.where("derived_from is not null").select(F.col("derived_from").alias("entity_id"), F.col("id").alias("plan"))
    if includes:
        derived = derived.union(plans.select(F.explode(includes).alias("entity_id"), F.col("id").alias("plan")))
    return derived.distinct().join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def suffix_sibling(entities: DataFrame, suffix: str = "-TEE") -> DataFrame:
    """(id, name, sibling): things with the suffix and, if there is one, the thing of the plain name; letters of any case, the least id of several."""
    end = F.lower("name").endswith(suffix.lower())
    plain = entities.where(~end).groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("sibling"))
    marked = entities.where(end).select("id", "name", F.expr(f"substring(lower(name), 1, length(name) - {len(suffix)})").alias("key"))
    return marked.join(plain, "key", "left").select("id", "name", "sibling")


def money_edges(investments: DataFrame, providers: DataFrame) -> DataFrame:
    """(id, backers, portfolio): names at both ends of the investment edges of every company, in order."""
    named = providers.select(F.col("id").alias("other"), F.col("name").alias("other_name"))

    def side(mine: str, theirs: str, out: str) -> DataFrame:
        rows = investments.select(F.col(mine).alias("id"), F.col(theirs).alias("other")).distinct().join(named, "other")
        return rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("other_name"), "other_name", "other"))), lambda s: s["other_name"]).alias(out))

    return side("company_id", "fund_id", "backers").join(side("fund_id", "company_id", "portfolio"), "id", "full_outer")


def licence_match(repositories: DataFrame, models: DataFrame) -> DataFrame:
    """Pairs of repository (repo) and model (name, maker) of one name whose owner is the maker: equal, containing it, or the same company."""
    owner = norm(F.split_part("repo", F.lit("/"), F.lit(1)))
    leaf = F.element_at(F.split("repo", "/"), -1)
    rows = repositories.withColumn("_key", F.explode(F.array_distinct(F.array(norm(leaf), norm(F.replace("repo", F.lit("/"), F.lit("")))))))
    met = rows.join(models.withColumn("_key", norm(F.col("name"))), "_key").where(norm(F.col("maker")) != "")
    maker = norm(F.col("maker"))
    own = (owner == maker) | ((F.length(maker) >= 4) & owner.contains(maker)) | one_company(F.split_part("repo", F.lit("/"), F.lit(1)), F.col("maker"))
    return met.where(own).drop("_key").distinct()


def company_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")


def one_company(a: Column, b: Column) -> Column:
    """Whether one name begins with the other's words and every further word is one that companies add."""
    x, y = company_words(a), company_words(b)
    n = F.least(F.size(x), F.size(y))
    longer = F.when(F.size(x) > F.size(y), x).otherwise(y)
    extra = F.slice(longer, n + 1, F.size(longer))
    return (F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n)) & F.forall(extra, lambda w: w.isin(*CORPORATE)) & ((n > 0) | (F.size(longer) == 0))
