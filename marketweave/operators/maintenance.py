"""Composite upkeep of a catalogue as pure functions: merges, folds, repairs, and feeds applied to tables.

Nothing is written in place: every function returns new tables, or the rows to change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.functions import names
from marketweave.functions.scratch import written
from marketweave.operators import boards, history, joins, upserts


def smallest_label(links: DataFrame, node: str, key: str) -> DataFrame:
    """(node, label): the least node that can be reached over shared keys, by rounds of minima that are written in between."""
    links = written(links.select(node, key).distinct(), "links")
    labels = links.select(node).distinct().withColumn("label", F.col(node))
    while True:
        least = links.join(labels, node).groupBy(key).agg(F.min("label").alias("least"))
        new = written(links.join(least, key).groupBy(node).agg(F.min("least").alias("new")).join(labels, node), "labels")
        if new.where("new < label").isEmpty():
            return labels
        labels = new.select(node, F.col("new").alias("label"))


def fold_groups(entities: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, keep): things that one maker has twice in one register, by any name form, and the one that stays: most attached, then most like a written name, then least id.

    Forms take a version on either side of the word beside it. weights(id, n) counts what is attached.
    """
    forms = F.array_union(names.index_forms(F.col("name")), names.index_forms(names.swap_version(F.col("name"))))
    keyed = entities.select("id", "register", F.coalesce("maker", F.lit("")).alias("maker"), F.explode(forms).alias("form")).where(~names.generic(F.col("form")))
    keyed = keyed.select("id", F.concat_ws("\x01", "register", "maker", "form").alias("key"))
    shared = keyed.groupBy("key").agg(F.countDistinct("id").alias("n")).where("n > 1").select("key")
    labels = smallest_label(keyed.join(shared, "key", "left_semi"), "id", "key")
    rows = labels.join(entities.select("id", X.looks_written(F.col("name")).alias("written")), "id").join(weights, "id", "left")
    best = rows.groupBy("label").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), (-F.col("written")).alias("w"), "id")).getField("id").alias("keep"))
    return rows.join(best, "label").where("id <> keep").select("id", "keep")


def merge_entities(tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """The tables with every loser of pairs(loser, survivor, hint) folded into its survivor.

    Offerings, aliases, benchmarks, docs and children move; an offering whose place is taken gets the hint behind its lane; a moved
    text replaces the survivor's of the same kind and source; the losers go. Pairs whose ends do not both exist do nothing.
    """
    known = tables["entities"].select("id")
    pairs = pairs.where("loser <> survivor").join(known.withColumnRenamed("id", "loser"), "loser", "left_semi").join(known.withColumnRenamed("id", "survivor"), "survivor", "left_semi")

    def moved(df: DataFrame, column: str) -> DataFrame:
        return df.join(pairs.select(F.col("loser").alias(column), "survivor", "hint"), column, "left").withColumn("_moved", F.col("survivor").isNotNull()).withColumn(column, F.coalesce("survivor", column)).drop("survivor")

    out = dict(tables)
    o = tables["offerings"]
    key = ["entity_id", "provider_id", "way", "variant"]
    taken = o.select(*key).distinct().withColumn("_taken", F.lit(True))
    rows = moved(o, "entity_id").join(taken, key, "left")
    hinted = F.when(F.col("_moved") & F.col("_taken").isNotNull(), F.trim(F.concat_ws(" ", "variant", "hint"))).otherwise(F.col("variant"))
    out["offerings"] = rows.withColumn("variant", hinted).select(*o.columns)
    for name in ("aliases", "benchmarks"):
        out[name] = moved(tables[name], "entity_id").select(*tables[name].columns)
    d = tables["docs"]
    key = ["subject", "kind", "source_url"]
    rows = moved(d, "subject")
    replaced = rows.where("_moved").select(*key).distinct()
    out["docs"] = rows.where("not _moved").join(replaced, key, "left_anti").select(*d.columns).union(rows.where("_moved").select(*d.columns))
    e = tables["entities"]
    children = moved(e, "derived_from").select(*e.columns)
    out["entities"] = children.join(pairs.select(F.col("loser").alias("id")), "id", "left_anti").select(*e.columns)
    return out


def drop_empty_offerings(offerings: DataFrame, prices: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Offerings with a price or a metric, and those that are run locally."""
    held = prices.select(F.col("offering_id").alias("id"))
    held = held if metrics is None else held.union(metrics.select("offering_id"))
    return offerings.where("way = 'local'").unionByName(offerings.where("way <> 'local'").join(held, "id", "left_semi").select(*offerings.columns))


#: Billions that a size read from a name may have.
SIZES = (0.0, 100_000.0)


def fill_sizes(entities: DataFrame) -> DataFrame:
    """Entities with an unstated size read from the name, and read_from telling so."""
    found = X.read_size(F.col("name"))
    found = F.when((found > SIZES[0]) & (found <= SIZES[1]), found)
    return entities.withColumn("read_from", F.when(F.col("params").isNull() & found.isNotNull(), "its own name")).withColumn("params", F.coalesce("params", found))


def one_description(docs: DataFrame, homes: DataFrame, least: int = 40) -> DataFrame:
    """The description that stays of every subject: from its own host (homes: subject, home), then the newest, then the first address; those too short go."""
    rows = docs.where((F.col("kind") == "description") & (F.length(F.trim("text")) >= least)).join(homes, "subject", "left")
    rows = rows.withColumn("_own", X.authority(F.col("source_url"), F.coalesce("home", F.lit(""))))
    rest = [c for c in docs.columns if c not in ("subject", "taken_at", "source_url")]
    best = rows.groupBy("subject").agg(F.max(F.struct("_own", "taken_at")).alias("_top"), F.count("*").alias("_n"))
    rows = rows.join(best, "subject").where((F.col("_own") == F.col("_top._own")) & F.col("taken_at").eqNullSafe(F.col("_top.taken_at")))
    first = rows.groupBy("subject").agg(F.min(F.struct("source_url", "seq", *[c for c in rest if c != "seq"], "taken_at")).alias("_f"))
    return first.select("subject", *[F.col("_f")[c].alias(c) for c in docs.columns if c != "subject"])


def hold_unvetted(entities: DataFrame, offerings: DataFrame, prices: DataFrame, vetted: DataFrame, dimensions: list[str]) -> DataFrame:
    """(id, kind, name, sellers, low, dimension, body): things that only unvetted sellers sell, with the cheapest rate in the first dimension that has one, and their offers nested."""
    sold = offerings.select(F.col("id").alias("offering_id"), "entity_id", "provider_id").join(vetted.select(F.col("id").alias("provider_id"), F.lit(True).alias("_vetted")), "provider_id", "left").withColumn("_vetted", F.coalesce("_vetted", F.lit(False)))
    held = joins.only_unvetted(sold, "entity_id", "_vetted")
    rows = sold.join(held, "entity_id", "left_semi").join(prices.select("offering_id", "dimension", "micros"), "offering_id", "left")
    at = F.array_position(F.array(*map(F.lit, dimensions)), F.col("dimension"))
    body = F.array_sort(F.collect_set(F.when(F.col("micros").isNotNull(), F.struct("provider_id", "dimension", "micros"))))
    best = rows.groupBy("entity_id").agg(F.countDistinct("provider_id").alias("sellers"), F.min(F.when((at > 0) & (F.col("micros") > 0), F.struct(at.alias("at"), F.col("micros").alias("low"), "dimension"))).alias("b"), body.alias("body"))
    return best.join(entities.select(F.col("id").alias("entity_id"), "register", "name"), "entity_id").select(F.col("entity_id").alias("id"), F.col("register").alias("kind"), "name", "sellers", "b.low", "b.dimension", "body")


def hold_companies(providers: DataFrame, vetted: DataFrame, offerings: DataFrame, entities: DataFrame, investments: DataFrame, held: DataFrame) -> DataFrame:
    """(id, kind, name, why): unvetted companies that make nothing, are at no end of an investment, and sell nothing but what is held(id) now."""
    ids = lambda df, c: df.select(F.col(c).alias("id"))
    left = offerings.select("provider_id", F.col("entity_id").alias("id")).join(held.select("id"), "id", "left_anti")
    rows = providers.select("id", "name").join(vetted.select("id"), "id", "left_anti")
    for kept in (ids(entities.where("maker is not null"), "maker"), ids(investments, "company_id"), ids(investments, "fund_id"), ids(left, "provider_id")):
        rows = rows.join(kept.distinct(), "id", "left_anti")  # an id of many rows leaves each task once
    return rows.select("id", F.lit("company").alias("kind"), "name", F.lit("a company we have not looked at").alias("why"))


def release_arrived(candidates: DataFrame, providers: DataFrame) -> DataFrame:
    """Candidates that are still to be held: companies that the catalogue has by now go."""
    companies = candidates.where("kind = 'company'").join(providers.select("id"), "id", "left_anti").select(*candidates.columns)
    return candidates.where("kind <> 'company'").unionByName(companies)


def find_new_models(priced: DataFrame, index: DataFrame, companies: DataFrame, held: DataFrame, least: int = 1) -> DataFrame:
    """(key, name, sellers): names of priced(name, seller) that nothing answers to once markers of serving are off, no company's and no router, most sellers first by count.

    index has the catalogue's keys (form), companies and held have a name; a key's printed name is its least bare form.
    """
    bare = priced.select("name").distinct().withColumn("bare", names.strip_serving(F.col("name"))).withColumn("key", X.norm(F.col("bare")))
    bare = bare.where((F.col("key") != "") & ~F.col("name").rlike(r"(?i)\b(router|auto\s*router|routing)\b")).join(index.select(F.col("form").alias("key")), "key", "left_anti")
    known = companies.select(X.norm(F.col("name")).alias("key")).union(held.select(X.norm(names.strip_serving(F.col("name")))))
    rows = bare.join(known, "key", "left_anti").join(priced, "name")
    return rows.groupBy("key").agg(F.min("bare").alias("name"), F.countDistinct("seller").alias("sellers")).where(F.col("sellers") >= least)


def sync_facts(entities: DataFrame, said: DataFrame, facts: list[str]) -> DataFrame:
    """Entities with the facts that said(id, ...) has; silence changes nothing."""
    new = said.select("id", *(F.col(f).alias(f"_new_{f}") for f in facts))
    rows = entities.join(new, "id", "left")
    return rows.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in facts else F.col(c) for c in entities.columns))


def settle_facts(heard: DataFrame, entity: str = "entity_id", floors: DataFrame | None = None) -> DataFrame:
    """(entity, fact, value) of heard(entity, fact, value): released is the earliest date not before the knowledge date (floors: entity, floor), context and max_output the greatest number, others what more than all the rest say."""
    rows = heard if floors is None else heard.join(floors, entity, "left")
    floor = F.coalesce("floor", F.lit("")) if floors is not None else F.lit("")
    dates = rows.where((F.col("fact") == "released") & (F.col("value") >= floor)).groupBy(entity, "fact").agg(F.min("value").alias("value"))
    number = F.col("value").try_cast("double")
    sizes = heard.where(F.col("fact").isin("context", "max_output") & (number > 0)).groupBy(entity, "fact").agg(F.max(number).cast("long").cast("string").alias("value"))
    votes = heard.where(~F.col("fact").isin("released", "context", "max_output")).groupBy(entity, "fact", "value").agg(F.count("*").alias("n"))
    top = votes.groupBy(entity, "fact").agg(F.max(F.struct("n", "value")).alias("t"), F.sum("n").alias("spoke")).where("2 * t.n > spoke")
    return dates.union(sizes).union(top.select(entity, "fact", F.col("t.value").alias("value")))


def justify_companies(providers: DataFrame, reasons: DataFrame, offerings: DataFrame, entities: DataFrame, investments: DataFrame) -> DataFrame:
    """(id, why): companies that neither sell, make nor invest, with the reason a curated list gives them; null where it gives none."""
    idle = providers.select("id")
    for busy in (offerings.select(F.col("provider_id").alias("id")), entities.select(F.col("maker").alias("id")), investments.select(F.col("fund_id").alias("id"))):
        idle = idle.join(busy.distinct(), "id", "left_anti")  # an id of many rows leaves each task once
    return idle.join(reasons.select("id", "why"), "id", "left")


def free_lane_replace(offerings: DataFrame, given: DataFrame, provider: str) -> DataFrame:
    """Offerings with the provider's whole free lane replaced by given (same columns); an empty reading changes nothing."""
    heard = F.broadcast(given.agg(F.count("*").alias("_n")))  # one row
    free = (F.col("provider_id") == provider) & (F.col("variant") == "free")
    kept = offerings.crossJoin(heard).where(~free | (F.col("_n") == 0)).select(*offerings.columns)
    return kept.unionByName(given.select(*offerings.columns))


OFFERING = ["entity_id", "provider_id", "way", "variant"]


def apply_listings(listings: DataFrame, aliases: DataFrame, offerings: DataFrame, prices: DataFrame, queue: DataFrame, source: str, way: str, today: str) -> dict[str, DataFrame]:
    """One source's listings(alias, variant, dimension, micros, ord) applied: bound by alias, sightings moved, first figures kept, prices appended where they moved, the rest queued, the queue pruned.

    Returns offerings(entity_id, provider_id, way, variant, first_seen, last_seen), prices(offering key, dimension, micros, taken_at) to append, the
    queue(source, alias), and counters (read, bound, clashes, written). Applying the same listings again appends nothing.
    """
    bound = joins.bind_alias(listings.withColumn("source", F.lit(source)), aliases, variant="variant")
    hit = bound.where("entity_id is not null").withColumns({"provider_id": F.lit(source), "way": F.lit(way)})
    day = F.lit(today).cast("date")
    seen = hit.select(*OFFERING).distinct().select(*OFFERING, day.alias("first_seen"), day.alias("last_seen"))
    first = history.first_writer(hit, [*OFFERING, "dimension"], ["ord"], "micros")
    fresh = first.withColumn("taken_at", day)
    moved = upserts.append_if_changed(prices, fresh.select(*OFFERING, "dimension", "micros", "taken_at"), [*OFFERING, "dimension"], ["taken_at"], "micros")
    missed = bound.where("entity_id is null").select("source", "alias").distinct()
    kept = upserts.prune(queue, listings.select(F.lit(source).alias("source"), "alias").distinct(), "source", ["alias"]).join(bound.where("entity_id is not null").select("source", "alias"), ["source", "alias"], "left_anti")
    counters = listings.agg(F.countDistinct("alias").alias("read")).crossJoin(hit.agg(F.countDistinct("alias").alias("bound"))).crossJoin(first.agg(F.coalesce(F.sum("clashes"), F.lit(0)).alias("clashes"))).crossJoin(moved.agg(F.count("*").alias("written")))  # one row each
    return {"offerings": upserts.upsert_sighting(offerings, seen, OFFERING), "prices": moved, "queue": kept.unionByName(missed).distinct(), "counters": counters}


def write_observations(observations: DataFrame, index: DataFrame, offerings: DataFrame, prices: DataFrame, way: str, today: str) -> dict[str, DataFrame]:
    """observations(subject, seller, source_url, dimension, micros, ord) applied: resolved by name, sightings moved, first figures kept, and each offering and dimension's figures from that source replaced."""
    hit = joins.resolve(observations, index, "subject").where("entity_id is not null").withColumns({"provider_id": F.col("seller"), "way": F.lit(way), "variant": F.lit("")})
    day = F.lit(today).cast("date")
    seen = hit.select(*OFFERING).distinct().select(*OFFERING, day.alias("first_seen"), day.alias("last_seen"))
    key = [*OFFERING, "dimension", "source_url"]
    first = history.first_writer(hit, key, ["ord"], "micros").select(*key, "micros", day.alias("taken_at"))
    return {"offerings": upserts.upsert_sighting(offerings, seen, OFFERING), "prices": upserts.replace_by_key(prices, first, key)}


def apply_price_files(offers: DataFrame, sellers: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers(seller_key, name, lane, dimension, micros) of chosen sellers bound by name: (entity_id, seller, lane, dimension, micros) with the lowest figure of each, and one row of counts (matched, unmatched names, sellers left out)."""
    chosen = offers.join(sellers.select(F.col("key").alias("seller_key"), "seller"), "seller_key", "left")
    found = joins.resolve(chosen.where("seller is not null"), index)
    rates = found.where("entity_id is not null").groupBy("entity_id", "seller", "lane", "dimension").agg(F.min("micros").alias("micros"))
    names_in = lambda when: F.countDistinct(F.when(when, F.col("name")))
    counts = found.agg(names_in(F.col("entity_id").isNotNull()).alias("matched"), names_in(F.col("entity_id").isNull()).alias("unmatched"))
    return rates, counts.crossJoin(chosen.agg(F.countDistinct(F.when(F.col("seller").isNull(), F.col("seller_key"))).alias("left_out")))


def apply_boards(placements: DataFrame, index: DataFrame, lower: DataFrame, efforts: list[str]) -> tuple[DataFrame, DataFrame]:
    """placements(suite, metric, name, value, ord) as standings: ranked over the whole published field of each suite, bound by name, the best configuration of each thing kept; and the names that did not bind with their counts.

    lower(suite, lower_is_better) gives the direction. A name's setting decides between equal ranks, cheapest first.
    """
    flagged = placements.join(lower.select("suite", "lower_is_better"), "suite", "left").withColumn("_by", F.when(F.col("lower_is_better"), F.col("value")).otherwise(-F.col("value")))
    ranked = boards.rank_board(flagged, "suite", "_by", ["ord", "name"], lower=True).drop("_by")
    found = joins.resolve(ranked, index).withColumn("effort", F.coalesce(names.effort_of(F.col("name")), F.lit("")))
    best = boards.best_config(found.where("entity_id is not null"), ["entity_id", "suite"], "rank", "effort", efforts)
    missed = found.where("entity_id is null").groupBy("name").agg(F.count("*").alias("n"))
    return best.select("entity_id", "suite", "metric", "value", "rank", "out_of", "effort"), missed


def export_nested(tables) -> DataFrame:
    """One row per thing with its offerings (each with its rates), aliases, standings and texts nested, each list in order."""
    nest = lambda df, key, cols, out: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(out))
    rates = tables.prices.groupBy("offering_id").agg(F.array_sort(F.collect_list(F.struct("dimension", "micros", "taken_at"))).alias("rates"))
    offers = tables.offerings.withColumnRenamed("id", "offering_id").join(rates, "offering_id", "left")
    rows = tables.entities.select("id", "name", "register", "maker")
    for child in (nest(offers, "entity_id", ["offering_id", "provider_id", "way", "variant", "rates"], "offerings"), nest(tables.aliases, "entity_id", ["source", "alias"], "aliases"), nest(tables.benchmarks, "entity_id", ["suite", "metric", "seq", "value", "rank", "out_of"], "standings"), nest(tables.docs, "subject", ["kind", "source_url", "text"], "docs")):
        rows = rows.join(child, "id", "left")
    return rows


def run_ledger(ledger: DataFrame, run: DataFrame) -> DataFrame:
    """The ledger with a run's rows; a second run of one source on one day replaces the first."""
    return upserts.upsert(ledger, run, ["source", "ran_at"])

