"""How new things enter a catalogue: from a queue of names, from feeds, from a curated document, from a list of plans, from what is learnt of companies.

Every function takes tables and returns new ones, or the rows to add. Ids come from names alone, so a run that
is repeated, or cut short and repeated, mints nothing twice, and no task needs to know of another's ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.functions import ordered
from marketweave.functions.patch import merge_patch
from marketweave.functions.scratch import written
from marketweave.operators import maintenance, upserts

# Makers that the catalogue knows under an id of its own, by what listings call them.
KNOWN_MAKERS = {
    "anthropic": "prov_anthropic", "openai": "prov_openai", "meta-llama": "prov_meta", "meta": "prov_meta", "google": "prov_google", "qwen": "prov_qwen", "alibaba-nlp": "prov_qwen",
    "deepseek-ai": "prov_deepseek", "deepseek": "prov_deepseek", "zai-org": "prov_zhipu", "z-ai": "prov_zhipu", "thudm": "prov_zhipu", "moonshotai": "prov_moonshot", "mistralai": "prov_mistral",
    "nvidia": "prov_nvidia", "microsoft": "prov_microsoft", "black-forest-labs": "prov_bfl", "minimaxai": "prov_minimax", "bytedance": "prov_bytedance", "bytedance-seed": "prov_bytedance",
    "stabilityai": "prov_stability", "ibm-granite": "prov_ibm", "cohere": "prov_cohere", "cohereforai": "prov_cohere", "nousresearch": "prov_nous", "allenai": "prov_allenai",
    "thinkingmachines": "prov_thinking-machines", "xai": "prov_xai", "x-ai": "prov_xai", "canopylabs": "prov_canopy", "hexgrad": "prov_hexgrad", "intfloat": "prov_intfloat",
    "perplexity": "prov_perplexity", "writer": "prov_writer", "baidu": "prov_baidu", "tencent": "prov_tencent", "upstage": "prov_upstage", "stepfun-ai": "prov_stepfun",
    "inclusionai": "prov_inclusionai", "meituan-longcat": "prov_meituan", "xiaomimimo": "prov_xiaomi", "kwaipilot": "prov_kuaishou",
}
# Modalities that a feed's facts may name, and other words for them.
MODALITIES = ("text", "image", "audio", "video", "file", "embedding")
SAME_MODALITY = {"pdf": "file", "document": "file", "img": "image", "speech": "audio"}

PAYLOAD = "struct<name: string, kind: string, context_length: bigint, input_modalities: array<string>, output_modalities: array<string>>"
FEED = "struct<architecture: struct<input_modalities: array<string>, output_modalities: array<string>>, modalities: struct<input: array<string>, output: array<string>>, context_length: bigint, limit: struct<context: bigint>, open_weights: boolean, release_date: string>"


def name_slug(name: Column) -> Column:
    """Letters and digits in lower case and stops; whatever else is between them is one dash."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, "[^A-Za-z0-9.]+", "-")), "^[-.]+|[-.]+$", "")


def maker_id(org: Column) -> Column:
    """The id of the company that a listing names before its slash; null without a name."""
    own = F.concat(F.lit("prov_"), name_slug(org))
    return F.when(F.coalesce(org, F.lit("")) != "", F.coalesce(F.nullif(X.looked_up(F.lower(org), KNOWN_MAKERS), F.lit("")), own))


def company_id(name: Column) -> Column:
    """The id of a company that an article or a directory names."""
    return F.concat(F.lit("prov_"), X.slug(name, plus="", ampersand=""))


def absorb_queue(queue: DataFrame, entities: DataFrame, providers: DataFrame, source: str, limit: int = 0) -> dict[str, DataFrame]:
    """A source's queue(source, alias, payload) taken in: entities and providers to add, aliases to bind, the queue that is left, and counters (minted, bound, opened, skipped).

    The id is the alias's last segment as a slug; a name that has none stays in the queue. Of several
    aliases with one id the first by name mints it, and its part before the slash is the maker; a maker that is neither known nor held is opened, by the first
    alias that names it. limit takes the first so many aliases by name, 0 all. What is held by now is only bound,
    so a second run mints nothing. Nulls in payload say nothing; repeated rows count once.
    """
    rows = queue.where(F.col("source") == source).groupBy("alias").agg(F.min("payload").alias("payload"))
    if limit:
        rows = rows.orderBy("alias").limit(limit)
    last = F.element_at(F.split("alias", "/", -1), -1)
    rows = rows.withColumns({"p": F.from_json("payload", PAYLOAD), "last": last, "id": F.concat(F.lit("ent_"), name_slug(last)), "org": F.when(F.col("alias").contains("/"), F.nullif(F.split_part("alias", F.lit("/"), F.lit(1)), F.lit("")))})
    rows = written(rows.withColumn("maker", maker_id(F.col("org"))), "queue")
    named = rows.where("id <> 'ent_'")
    first = named.groupBy("id").agg(F.min(F.struct("alias", "last", "org", "maker", "p")).alias("f")).select("id", "f.*")
    first = written(first.join(entities.select("id"), "id", "left_anti"), "minted")
    takes, returns = X.kinds_of(F.col("p.input_modalities"), F.col("p.output_modalities"), F.coalesce("p.kind", F.lit("")))
    context = F.when(F.col("p.context_length") > 0, F.col("p.context_length"))
    minted = first.select("id", F.lit("model").alias("register"), F.coalesce(F.nullif("p.name", F.lit("")), "last").alias("name"), "maker", takes.alias("input_kind"), returns.alias("output_kind"), F.to_json(F.struct(context.alias("context"))).alias("attrs"))
    # known makers are taken to be held
    opened = first.where(F.col("maker").isNotNull() & ~F.lower("org").isin(*KNOWN_MAKERS)).groupBy(F.col("maker").alias("id")).agg(F.min(F.struct("alias", "org")).getField("org").alias("name"))
    opened = opened.join(providers.select("id"), "id", "left_anti").select("id", "name", F.lit("vendor").alias("kind"))
    bound = named.select(F.lit(source).alias("source"), "alias", F.col("id").alias("entity_id"))
    left = queue.join(bound.select("source", "alias"), ["source", "alias"], "left_anti").select(*queue.columns)
    counts = first.agg(F.count("*").alias("minted")).crossJoin(rows.agg(F.count(F.when(F.col("id") != "ent_", 1)).alias("bound"), F.count(F.when(F.col("id") == "ent_", 1)).alias("skipped"))).crossJoin(opened.agg(F.count("*").alias("opened")))  # one row each
    return {"entities": minted, "providers": opened, "aliases": bound, "queue": left, "counters": counts.select("minted", "bound", "opened", "skipped")}


def _modalities(said: Column) -> Column:
    """Known modalities of a list, each once, in its order."""
    words = F.transform(said, lambda w: F.coalesce(F.nullif(X.looked_up(F.lower(w), SAME_MODALITY), F.lit("")), F.lower(w)))
    return F.array_join(F.array_distinct(F.filter(words, lambda w: w.isin(*MODALITIES))), " + ")


def new_model_facts(feed: DataFrame, blob: str = "blob") -> DataFrame:
    """feed with what its JSON says of a model, in the catalogue's fields: input_kind, output_kind, context, open_weights, released; text where no modality is known, null where nothing is said."""
    b = F.from_json(blob, FEED)
    kind = lambda one, other: F.coalesce(F.nullif(_modalities(one), F.lit("")), F.nullif(_modalities(other), F.lit("")), F.lit("text"))
    context = F.coalesce(b["context_length"], b["limit"]["context"])
    return feed.withColumns({
        "input_kind": kind(b["architecture"]["input_modalities"], b["modalities"]["input"]), "output_kind": kind(b["architecture"]["output_modalities"], b["modalities"]["output"]),
        "context": F.when(context > 0, context), "open_weights": F.when(b["open_weights"], True), "released": F.substring(b["release_date"], 1, 10),
    })


CURATED = """struct<providers: array<struct<id: string, name: string, url: string, kind: string, notes: string>>,
entities: array<struct<id: string, register: string, name: string, input_kind: string, output_kind: string, maker: string, family: string, version: string, derived_from: string, attrs: string>>,
aliases: array<struct<source: string, alias: string, entity: string>>,
offerings: array<struct<entity: string, provider: string, way: string, variant: string, components: array<struct<dimension: string, micros_per_unit: bigint, usd_per_unit: double, source_url: string, taken_at: string>>, metrics: array<struct<metric: string, value: double, source_url: string, taken_at: string>>>>,
suites: array<struct<id: string, name: string, measurer: string, url: string, metric: string, subject: string, lower_is_better: boolean, updated: string>>,
benchmarks: array<struct<suite: string, model_as_printed: string, metric: string, value: double, rank: bigint, out_of: bigint, source_url: string, taken_at: string>>,
docs: array<struct<subject: string, kind: string, field: string, text: string, source_url: string, taken_at: string>>>"""
# What a row of each part cannot be without.
NEEDED = {
    "providers": ("id", "name"), "entities": ("id", "register", "name", "input_kind", "output_kind"), "aliases": ("source", "alias", "entity"), "offerings": ("entity", "provider", "way"), "suites": ("id", "name"),
    "benchmarks": ("suite", "model_as_printed", "metric", "value", "source_url", "taken_at"), "docs": ("subject", "kind", "text", "source_url", "taken_at"),
}


def _checked(rows: DataFrame, part: str, needed: tuple[str, ...]) -> DataFrame:
    """rows, failing on the first that lacks a needed field."""
    return rows.withColumns({c: F.coalesce(c, F.raise_error(F.concat(F.lit(f'{part} needs "{c}": '), F.to_json(F.struct(*(F.col(x) for x in rows.columns if x != "ord")))))) for c in needed})


def _moved(current: DataFrame, delta: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of delta, in the order of ord, whose value differs from the one before of their key, the last of current (by seq) to begin with."""
    last = current.groupBy(*key).agg(F.max_by(value, "seq").alias(value)).withColumn("ord", F.lit(-1).cast("long"))
    both = delta.select(*delta.columns, F.lit(True).alias("_new")).unionByName(last.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    was = F.lag(value).over(W.partitionBy(*key).orderBy("ord"))
    return both.withColumn("_was", was).where(F.col("_new") & ~F.coalesce(F.col("_was").eqNullSafe(F.col(value)), F.lit(False))).select(*delta.columns)


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "ord").alias("_l")).select(*key, *(F.col("_l")[c].alias(c) for c in rest)).select(*rows.columns)


def import_curated(bodies: DataFrame, tables: dict[str, DataFrame], body: str = "body") -> dict[str, DataFrame]:
    """A curated JSON document (or several, in the order of file) applied to tables: new providers, entities, aliases, queue, offerings, prices, metrics, suites, benchmarks and docs, and counters.

    The documents are parsed once and written; seven parts come from that. Providers, suites, aliases and docs take the last of a key,
    an entity that exists keeps its row, figures are appended where they differ from the last of their own source, a printed name goes through the aliases of
    `bench_<suite>` and waits in the queue if it has none, facts on a thing's kinds and context are its own too. Offerings without figures go. A row without a
    needed field, an offering without components or a component without a figure fails the import. tables has entities with attrs, prices, metrics and benchmarks with seq.
    """
    parsed = written(bodies.select(F.col("file").alias("_name"), F.from_json(body, CURATED).alias("d")), "curated")
    numbers = written(ordered.placed(parsed.select("_name").distinct(), [], [F.col("_name").asc_nulls_first()], "file").withColumnRenamed("_name", "_file"), "files")

    def numbered(rows: DataFrame) -> DataFrame:
        """rows(_name, r: an array) with a row an element; ord is the file's number and, in its last 31 bits, the element's: a text has fewer than 2**31 characters."""
        rows = rows.join(numbers, rows["_name"].eqNullSafe(numbers["_file"])).select("file", F.posexplode("r").alias("i", "r"))
        return rows.select((F.col("file") * 2**31 + F.col("i")).alias("ord"), "r.*")

    def part(name: str) -> DataFrame:
        return _checked(numbered(parsed.select("_name", F.col("d")[name].alias("r"))), name, NEEDED[name])

    out = dict(tables)
    out["providers"] = upserts.upsert(tables["providers"], _last(part("providers"), ["id"]).drop("ord"), ["id"])

    given = part("entities").withColumns({"input_kind": X.normalise_kind(F.col("input_kind")), "output_kind": X.normalise_kind(F.col("output_kind")), "attrs": F.when(F.col("attrs").startswith("{"), F.col("attrs")).otherwise("{}")})
    rest = [c for c in given.columns if c not in ("id", "ord")]
    first = given.groupBy("id").agg(F.min_by(F.struct(*rest), "ord").alias("f")).select("id", "f.*")
    minted = written(first.join(tables["entities"].select("id"), "id", "left_anti").select(*tables["entities"].columns), "minted")

    aliases = _last(part("aliases").withColumnRenamed("entity", "entity_id"), ["source", "alias"]).drop("ord")
    out["aliases"] = written(upserts.upsert(tables["aliases"], aliases, ["source", "alias"]), "aliases")
    queue = tables["queue"].join(aliases.select("source", "alias"), ["source", "alias"], "left_anti").select(*tables["queue"].columns)

    key = maintenance.OFFERING
    offers = part("offerings").withColumnsRenamed({"entity": "entity_id", "provider": "provider_id"}).withColumn("variant", F.coalesce("variant", F.lit("")))
    offers = written(offers.withColumn("components", F.when(F.size("components") > 0, F.col("components")).otherwise(F.raise_error(F.lit("offering needs components")).cast(offers.schema["components"].dataType))), "offers")

    def each(what: str) -> DataFrame:
        inner = lambda o: F.coalesce(F.transform(o[what], lambda c: F.struct(o["entity"].alias("entity_id"), o["provider"].alias("provider_id"), o["way"].alias("way"), F.coalesce(o["variant"], F.lit("")).alias("variant"), c.alias("c"))), F.array())
        return numbered(parsed.select("_name", F.flatten(F.transform("d.offerings", inner)).alias("r"))).select(*key, "ord", "c.*")

    figures = _checked(each("components"), "component", ("dimension", "source_url", "taken_at"))
    micros = F.coalesce("micros_per_unit", F.round(F.col("usd_per_unit") * 1e6).cast("long"), F.raise_error(F.lit("component needs micros_per_unit or usd_per_unit")).cast("long"))
    figures = figures.withColumn("micros", micros).drop("micros_per_unit", "usd_per_unit")
    measures = _checked(each("metrics"), "metric", ("metric", "value", "source_url", "taken_at"))
    day = F.col("taken_at").cast("date")
    seen = figures.groupBy(*key).agg(F.max(day).alias("last_seen")).select(*key, F.col("last_seen").alias("first_seen"), "last_seen")
    prices = written(_moved(tables["prices"], figures, [*key, "dimension", "source_url"], "micros").withColumn("taken_at", day), "prices")
    metrics = written(_moved(tables["metrics"], measures, [*key, "metric", "source_url"], "value").withColumn("taken_at", day), "metrics")
    stamped = lambda df, like: df.withColumnRenamed("ord", "seq").select(*like.columns)
    out["prices"], out["metrics"] = (tables[n].unionByName(stamped(df, tables[n])) for n, df in (("prices", prices), ("metrics", metrics)))
    held = out["prices"].select(*key).union(out["metrics"].select(*key)).distinct()
    sighted = upserts.upsert_sighting(tables["offerings"], seen, key)
    out["offerings"] = sighted.where("way = 'local'").unionByName(sighted.where("way <> 'local'").join(held, key, "left_semi").select(*sighted.columns))

    out["suites"] = upserts.upsert(tables["suites"], _last(part("suites").withColumn("lower_is_better", F.coalesce("lower_is_better", F.lit(False))), ["id"]).drop("ord"), ["id"])
    scores = part("benchmarks").withColumn("source", F.concat(F.lit("bench_"), "suite")).withColumnRenamed("model_as_printed", "alias")
    scores = written(scores.join(out["aliases"], ["source", "alias"], "left"), "scores")
    bound = scores.where("entity_id is not null").drop("source", "alias").withColumn("taken_at", day)
    standing = F.struct("value", "rank", "out_of")
    moved = _moved(tables["benchmarks"].withColumn("_s", standing), bound.withColumn("_s", standing), ["entity_id", "suite", "metric", "source_url"], "_s").drop("_s")
    moved = written(moved, "standings")
    out["benchmarks"] = tables["benchmarks"].unionByName(stamped(moved, tables["benchmarks"]))
    missed = _last(scores.where("entity_id is null").select("source", "alias", "ord", F.to_json(F.struct("suite", F.col("alias").alias("model_as_printed"), "metric", "value", "rank", "out_of", "source_url", "taken_at")).alias("payload")), ["source", "alias"]).drop("ord")
    out["queue"] = upserts.upsert(queue, missed, ["source", "alias"])

    texts = written(part("docs").withColumn("field", F.coalesce("field", F.lit(""))), "texts")
    out["docs"] = upserts.upsert(tables["docs"], _last(texts, ["subject", "kind", "field", "source_url"]).drop("ord"), ["subject", "kind", "field", "source_url"])
    said = lambda f, c: F.max_by(F.when(F.col("field") == f, c), F.when((F.col("field") == f) & c.isNotNull(), F.col("ord")))
    facts = texts.where("kind = 'fact' and subject like 'ent\\\\_%'").groupBy(F.col("subject").alias("id")).agg(said("input_kind", X.normalise_kind(F.col("text"))).alias("_in"), said("output_kind", X.normalise_kind(F.col("text"))).alias("_out"), said("context", F.col("text").try_cast("long")).alias("_context"))
    every = tables["entities"].unionByName(minted).join(facts, "id", "left")
    patched = F.when(F.col("_context").isNotNull(), merge_patch(F.coalesce("attrs", F.lit("{}")), F.to_json(F.struct(F.col("_context").alias("context"))))).otherwise(F.col("attrs"))
    told = every.withColumns({"_i": F.coalesce("_in", "input_kind"), "_o": F.coalesce("_out", "output_kind"), "_a": patched, "_was": F.get_json_object("attrs", "$.context").try_cast("long")})
    told = told.withColumn("described", ~F.col("_i").eqNullSafe(F.col("input_kind")) | ~F.col("_o").eqNullSafe(F.col("output_kind")) | (F.col("_context").isNotNull() & ~F.col("_context").eqNullSafe(F.col("_was"))))
    told = written(told.withColumns({"input_kind": F.col("_i"), "output_kind": F.col("_o"), "attrs": F.col("_a")}).select(*tables["entities"].columns, "described"), "entities")
    out["entities"] = told.drop("described")

    count = lambda df, name: df.agg(F.count("*").alias(name))
    totals = [count(given, "given"), count(minted, "minted"), count(offers, "offerings"), count(figures, "figures"), count(measures, "measures"), count(prices, "prices"), count(metrics, "metrics"), count(scores.where("entity_id is not null"), "scored"), count(moved, "moved"), count(scores.where("entity_id is null"), "held"), count(texts, "texts"), count(told.where("described"), "described")]
    one = totals[0]
    for df in totals[1:]:
        one = one.crossJoin(df)  # one row each
    out["counters"] = one.select("minted", (F.col("given") - F.col("minted")).alias("kept"), "offerings", (F.col("prices") + F.col("metrics")).alias("appended"), (F.col("figures") + F.col("measures") - F.col("prices") - F.col("metrics")).alias("unchanged"), "scored", "moved", "held", "texts", "described")
    return out


def plan_id(plan: Column) -> Column:
    return F.concat(F.lit("sub_"), X.slug(plan, plus=" plus ", ampersand=""))


def apply_plans(plans: DataFrame, tables: dict[str, DataFrame], today: str) -> dict[str, DataFrame]:
    """plans(plan, maker, maker_name, maker_url, usd, grants, includes, limits, source_url) as things of their own: new providers, entities, offerings and prices, and counters (plans, free, made).

    A plan's thing is found by its name and takes the list's word for all but its id; it derives from the thing that `grants` names. Its
    offering is on the free lane if it costs nothing; its figure for a month replaces the ones before. Plans that hang on other things as a way of buying them go, with their prices.
    plan names are unique; offerings and prices are keyed by (entity_id, provider_id, way, variant). A null price is nothing; of things of one name the last id is granted.
    """
    day = F.lit(today).cast("date")
    rows = plans.withColumns({"id": plan_id(F.col("plan")), "usd": F.coalesce("usd", F.lit(0.0)), "limits": F.coalesce("limits", F.lit(""))})
    grants = tables["entities"].groupBy(F.col("name").alias("grants")).agg(F.max("id").alias("derived_from"))
    rows = written(rows.join(grants, "grants", "left").withColumn("variant", F.when(F.col("usd") == 0, "free").otherwise("")), "plans")
    out = dict(tables)
    makers = rows.groupBy(F.col("maker").alias("id")).agg(F.min(F.struct("plan", "maker_name", "maker_url")).alias("f")).select("id", F.col("f.maker_name").alias("name"), F.col("f.maker_url").alias("url"), F.lit("vendor").alias("kind"))
    out["providers"] = tables["providers"].unionByName(makers.join(tables["providers"].select("id"), "id", "left_anti"), allowMissingColumns=True).select(*tables["providers"].columns)
    attrs = F.to_json(F.struct("limits", F.coalesce("includes", F.array().cast("array<string>")).alias("includes")))
    things = rows.select("id", F.lit("subscription").alias("register"), F.col("plan").alias("name"), "maker", F.lit("").alias("input_kind"), F.lit("").alias("output_kind"), "derived_from", attrs.alias("attrs"))
    e = tables["entities"]
    known = e.join(things.select("id", F.col("name").alias("_n"), F.col("maker").alias("_m"), F.col("derived_from").alias("_d"), F.col("attrs").alias("_a")), "id", "left")
    new = {"name": "_n", "maker": "_m", "derived_from": "_d", "attrs": "_a"}
    kept = known.select(*(F.when(F.col("_a").isNotNull(), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in e.columns))
    made = things.join(e.select("id"), "id", "left_anti")
    out["entities"] = kept.unionByName(made, allowMissingColumns=True).select(*e.columns)
    others = out["entities"].where("register <> 'subscription'").select(F.col("id").alias("entity_id"))
    hanging = lambda df: df.where("way <> 'subscription'").unionByName(df.where("way = 'subscription'").join(others, "entity_id", "left_anti").select(*df.columns))
    o, p = hanging(tables["offerings"]), hanging(tables["prices"])
    bought = rows.select(F.col("id").alias("entity_id"), F.col("maker").alias("provider_id"), "variant", F.col("limits").alias("_limits"), "usd", "source_url")
    key = ["entity_id", "provider_id", "variant"]
    seen = o.join(bought.drop("usd", "source_url"), key, "left")
    seen = seen.withColumns({"last_seen": F.when(F.col("_limits").isNotNull(), day).otherwise(F.col("last_seen")), "limits": F.coalesce("_limits", "limits")}).select(*o.columns)
    fresh = bought.join(o.select(*key).distinct(), key, "left_anti").select("entity_id", "provider_id", F.lit("subscription").alias("way"), "variant", F.col("_limits").alias("limits"), F.lit("live").alias("status"), day.alias("first_seen"), day.alias("last_seen"))
    out["offerings"] = seen.unionByName(fresh, allowMissingColumns=True).select(*o.columns)
    ways = out["offerings"].groupBy(*key).agg(F.min("way").alias("way"))
    month = bought.join(ways, key).select("entity_id", "provider_id", "way", "variant", F.lit("month").alias("dimension"), F.round(F.col("usd") * 1e6).cast("long").alias("micros"), "source_url", day.alias("taken_at"))
    out["prices"] = upserts.replace_by_key(p, month.select(*p.columns), [*maintenance.OFFERING, "dimension"])
    out["counters"] = rows.agg(F.count("*").alias("plans"), F.count(F.when(F.col("usd") == 0, 1)).alias("free")).crossJoin(made.agg(F.count("*").alias("made")))  # one row each
    return out


def merge_columns(current: DataFrame, delta: DataFrame, policy: dict[str, str], key: str = "id") -> DataFrame:
    """current with delta's rows, a policy a column: `set` takes delta's value, `unset` only where current has none, `new` only for rows that current lacks; other columns stay, and are null in new rows.

    A null in delta says nothing. delta has one row a key.
    """
    new = delta.select(key, *(F.col(c).alias(f"_new_{c}") for c in policy)).withColumn("_said", F.lit(True))
    rows = current.withColumn("_held", F.lit(True)).join(new, key, "full")

    def value(c: str) -> Column:
        said = F.col(f"_new_{c}")
        return {"set": F.coalesce(said, c), "unset": F.coalesce(c, said), "new": F.when(F.col("_held"), F.col(c)).otherwise(said)}[policy[c]].alias(c)

    return rows.select(*(value(c) if c in policy else F.col(c) for c in current.columns))


#: Characters that a description must have and may have.
LEAST_SAID, MOST_SAID = 40, 900
FACT = ["subject", "kind", "field", "source_url"]


def _described(docs: DataFrame, said: DataFrame, today: str) -> DataFrame:
    """docs with the description of each subject replaced by said(subject, text, source_url)'s, with single spaces and cut at MOST_SAID, where it is long enough."""
    tidy = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = said.withColumn("text", tidy).where(F.char_length("text") >= LEAST_SAID)
    rows = rows.select("subject", F.lit("description").alias("kind"), F.lit("").alias("field"), F.substring("text", 1, MOST_SAID).alias("text"), "source_url", F.lit(today).alias("taken_at"))
    return upserts.replace_by_key(docs, rows.select(*docs.columns), ["subject", "kind"])


def apply_company_facts(providers: DataFrame, docs: DataFrame, investments: DataFrame, facts: dict[str, DataFrame], fund: tuple[str, str, str], source: str, today: str) -> dict[str, DataFrame]:
    """What was read of companies, merged into providers, docs and investments; facts may have any of these, and applying them again changes nothing.

    portfolio(name, held, was, acquired_by): companies of `fund` (id, name, url); held is their id where the catalogue has them, others are added. The fund's mark is set where a company has none,
    who was bought is marked Acquired, former names and buyers are facts, each an investment. batch(name, held, backing, status, url, text, page): a mark and status only where there is no mark; others are added with their description.
    rounds(id, raised, rounds, url): replace what was known. unheard(name, url, raised, rounds, text): added if their id is free. people(id, role, names, source_url): replace all facts of their role.
    Repeated rows count once; of rows that differ the first by its values is taken. providers has id, name, url, kind, backing, status, listed, raised, rounds, raised_source; docs has subject, kind, field, text, source_url, taken_at.
    """
    new_row = {"name": "new", "url": "new", "kind": "new", "listed": "new"}

    def one(df: DataFrame, key: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_f")).select(key, *(F.col("_f")[c].alias(c) for c in rest))

    fresh = lambda df, url: df.withColumns({"kind": F.lit("vendor"), "listed": F.lit(False), "url": url})
    if "portfolio" in facts:
        fund_id, fund_name, fund_url = fund
        own = providers.sparkSession.createDataFrame([(fund_id, fund_name, fund_url, "fund")], "id string, name string, url string, kind string")
        providers = merge_columns(providers, own, {"name": "new", "url": "set", "kind": "set"})
        rows = one(facts["portfolio"].select(F.coalesce("held", company_id(F.col("name"))).alias("id"), "name", F.col("held").isNull().alias("added"), "was", "acquired_by"), "id")
        status = F.when(F.col("acquired_by").isNotNull(), "Acquired")
        rows = written(fresh(rows, F.lit("")).withColumns({"backing": F.lit(fund_name), "bought": status, "status": F.coalesce(status, F.lit("Active"))}), "portfolio")
        providers = merge_columns(providers, rows, {**new_row, "backing": "unset", "status": "new"})
        providers = merge_columns(providers, rows.where("not added and bought is not null").select("id", F.col("bought").alias("status")), {"status": "set"})
        said = F.explode(F.array(F.struct(F.lit("formerly").alias("field"), F.col("was").alias("text")), F.struct(F.lit("acquired_by").alias("field"), F.col("acquired_by").alias("text"))))
        told = rows.select(F.col("id").alias("subject"), said.alias("s")).where("s.text is not null").select("subject", F.lit("fact").alias("kind"), "s.field", "s.text", F.lit(source).alias("source_url"), F.lit(today).alias("taken_at"))
        docs = upserts.insert_if_absent(docs, told.select(*docs.columns), FACT)
        edges = rows.select(F.lit(fund_id).alias("fund_id"), F.col("id").alias("company_id"), F.lit(source).alias("source_url"))
        investments = upserts.insert_if_absent(investments, edges.select(*investments.columns), ["fund_id", "company_id"])
    if "batch" in facts:
        rows = written(one(facts["batch"].select(F.coalesce("held", company_id(F.col("name"))).alias("id"), F.col("held").isNotNull().alias("known"), "name", "backing", "status", "url", "text", "page"), "id"), "batch")
        before = providers.select("id", F.col("backing").alias("_mark"))
        marked = rows.where("known").join(before, "id").where("_mark is null").select("id", "backing", "status")
        added = written(rows.where("not known").join(before, "id", "left_anti"), "added")
        providers = merge_columns(providers, marked, {"backing": "set", "status": "set"})
        providers = merge_columns(providers, fresh(added, F.coalesce("url", F.lit(""))), {**new_row, "backing": "new", "status": "new"})
        docs = _described(docs, added.select(F.col("id").alias("subject"), "text", F.col("page").alias("source_url")), today)
    if "rounds" in facts:
        rows = one(facts["rounds"], "id").join(providers.select("id"), "id", "left_semi").select("id", "raised", "rounds", F.col("url").alias("raised_source"), F.lit(False).alias("listed"))
        providers = merge_columns(providers, rows, {"raised": "set", "rounds": "set", "raised_source": "set", "listed": "set"})
    if "unheard" in facts:
        rows = one(facts["unheard"].withColumn("id", company_id(F.col("name"))), "id")
        rows = written(rows.join(providers.select("id"), "id", "left_anti"), "unheard")
        providers = merge_columns(providers, fresh(rows, F.col("url")).withColumn("raised_source", F.col("url")), {**new_row, "raised": "new", "rounds": "new", "raised_source": "new"})
        docs = _described(docs, rows.select(F.col("id").alias("subject"), "text", F.col("url").alias("source_url")), today)
    if "people" in facts:
        rows = facts["people"].distinct().select(F.col("id").alias("subject"), F.lit("fact").alias("kind"), F.col("role").alias("field"), F.col("names").alias("text"), "source_url", F.lit(today).alias("taken_at"))
        docs = upserts.replace_by_key(docs, rows.select(*docs.columns), ["subject", "kind", "field"])
    return {"providers": providers, "docs": docs, "investments": investments}
