"""Price files that hold many sellers at once: keyed maps, offer files with terms, and metered word soups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions.expressions import looked_up
from marketweave.operators.history import unambiguous

# Published fields, the lane and dimension of each, and the micros of one printed dollar.
PRICE_FIELDS = (
    ("input_cost_per_token", "", "mtok_in", 1e12), ("output_cost_per_token", "", "mtok_out", 1e12), ("cache_read_input_token_cost", "", "mtok_cache_read", 1e12), ("cache_creation_input_token_cost", "", "mtok_cache_write", 1e12),
    ("input_cost_per_audio_token", "", "mtok_in_audio", 1e12), ("output_cost_per_audio_token", "", "mtok_out_audio", 1e12), ("output_cost_per_reasoning_token", "", "mtok_out_reasoning", 1e12),
    ("output_cost_per_image", "", "image", 1e6), ("input_cost_per_image", "", "image_in", 1e6), ("input_cost_per_second", "", "second_in", 1e6), ("output_cost_per_second", "", "second_out", 1e6),
    ("input_cost_per_token_batches", "batch", "mtok_in", 1e12), ("output_cost_per_token_batches", "batch", "mtok_out", 1e12), ("input_cost_per_token_priority", "priority", "mtok_in", 1e12), ("output_cost_per_token_priority", "priority", "mtok_out", 1e12),
    ("cache_read_input_token_cost_priority", "priority", "mtok_cache_read", 1e12), ("input_cost_per_token_flex", "flex", "mtok_in", 1e12), ("output_cost_per_token_flex", "flex", "mtok_out", 1e12),
    ("input_cost_per_token_above_200k_tokens", "long-context", "mtok_in", 1e12), ("output_cost_per_token_above_200k_tokens", "long-context", "mtok_out", 1e12), ("cache_read_input_token_cost_above_200k_tokens", "long-context", "mtok_cache_read", 1e12),
)
# Modes whose rates a second count, the row that only describes the file, and what marks a commitment.
BY_THE_SECOND = ("audio_transcription", "audio_speech", "video_generation", "realtime")
SAMPLE, COMMITMENT = "sample_spec", "-commitment/"


def chosen_sellers(rows: DataFrame, sellers: DataFrame, key: str) -> DataFrame:
    """Rows whose seller key is in the curated list, with the seller's columns; sellers(key, seller, ...) is a short list."""
    return rows.join(sellers.withColumnRenamed("key", key), key)


def flatten_price_file(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(key, name, seller_key, lane, dimension, micros) of a JSON map from printed keys to fields; rates not above zero, rates a second of other modes and commitments go."""
    rows = bodies.select(F.explode(F.from_json(body, "map<string, map<string, string>>")).alias("key", "v")).where((F.col("key") != SAMPLE) & ~F.contains("key", F.lit(COMMITMENT)) & F.col("v").isNotNull())
    value = lambda f: F.try_element_at("v", F.lit(f))
    rates = F.array(*(F.struct(F.lit(lane).alias("lane"), F.lit(dim).alias("dimension"), (value(f).try_cast("double") * scale).alias("rate")) for f, lane, dim, scale in PRICE_FIELDS))
    rows = rows.select("key", F.element_at(F.split("key", "/"), -1).alias("name"), value("litellm_provider").alias("seller_key"), F.coalesce(value("mode"), F.lit("")).alias("mode"), F.inline(rates)).where("rate > 0 and seller_key is not null")
    rows = rows.where(~F.col("dimension").isin("second_in", "second_out") | F.col("mode").isin(*BY_THE_SECOND))
    return rows.select("key", "name", "seller_key", "lane", "dimension", F.round("rate").cast("long").alias("micros"))


def flatten_provider_models(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(seller_key, key, name, dimension, micros) of a JSON map from sellers to maps of models with dollars a million."""
    cost = "struct<input: double, output: double, cache_read: double, cache_write: double>"
    rows = bodies.select(F.explode(F.from_json(body, f"map<string, struct<models: map<string, struct<name: string, cost: {cost}>>>>")).alias("seller_key", "s"))
    rows = rows.select("seller_key", F.explode("s.models").alias("key", "m"))
    rates = F.array(*(F.struct(F.lit(dim).alias("dimension"), F.col("m.cost")[f].alias("rate")) for f, dim in (("input", "mtok_in"), ("output", "mtok_out"), ("cache_read", "mtok_cache_read"), ("cache_write", "mtok_cache_write"))))
    rows = rows.select("seller_key", "key", F.coalesce("m.name", "key").alias("name"), F.inline(rates)).where("rate > 0")
    return rows.select("seller_key", "key", "name", "dimension", F.round(F.col("rate") * 1e6).cast("long").alias("micros"))


# Features of an offer file that are sold by use, its kinds of tokens, and tokens of a printed unit.
FEATURES = ("On-demand Inference", "Batch Inference")
INFERENCE = {
    "Input tokens": ("mtok_in", "in-region"), "Output tokens": ("mtok_out", "in-region"), "input tokens batch": ("mtok_in", "in-region batch"), "output tokens batch": ("mtok_out", "in-region batch"),
    "Prompt cache read input tokens": ("mtok_cache_read", "in-region"), "Prompt cache write input tokens": ("mtok_cache_write", "in-region"),
}
PER_MILLION = {"1K tokens": 1e3, "1M tokens": 1.0}


def flatten_offer_file(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(alias, variant, dimension, micros, maker) of products joined to their terms by sku; a dimension that one model and lane has at two rates goes."""
    attributes = "struct<attributes: struct<feature: string, model: string, provider: string, inferenceType: string>>"
    term = "map<string, struct<priceDimensions: map<string, struct<unit: string, pricePerUnit: struct<USD: string>>>>>"
    offer = bodies.select(F.from_json(body, f"struct<products: map<string, {attributes}>, terms: struct<OnDemand: map<string, {term}>>>").alias("o"))
    products = offer.select(F.explode("o.products").alias("sku", "p")).select("sku", "p.attributes.*").where(F.col("feature").isin(*FEATURES) & (F.col("model") != ""))
    terms = offer.select(F.explode("o.terms.OnDemand").alias("sku", "t")).select("sku", F.get(F.map_values(F.get(F.map_values("t"), F.lit(0))["priceDimensions"]), F.lit(0)).alias("d"))
    rows = products.join(terms, "sku")
    kind = lambda i: looked_up(F.col("inferenceType"), {k: v[i] for k, v in INFERENCE.items()})
    scale = F.when(F.col("d.unit") == "1K tokens", PER_MILLION["1K tokens"]).when(F.col("d.unit") == "1M tokens", PER_MILLION["1M tokens"])
    rows = rows.select(F.col("model").alias("alias"), kind(1).alias("variant"), kind(0).alias("dimension"), F.round(F.col("d.pricePerUnit.USD").try_cast("double") * scale * 1e6).cast("long").alias("micros"), "provider").where("dimension <> '' and micros > 0")
    makers = rows.groupBy("alias").agg(F.max("provider").alias("maker"))
    return unambiguous(rows, ["alias", "variant", "dimension"], "micros").join(makers, "alias")


# Words of a meter's name by what they say, and tokens of a printed unit.
METER_WORDS = {
    "in": "inp inpt input in", "out": "outp output out opt", "cached": "cchd cached cd", "batch": "batch", "global": "glbl gl global", "other": "regnl regn rgnl dzone dzn dz datazone",
    "priority": "pp", "long-context": "longco l", "plain": "shortco std tokens 1m 1k",
}
MODALITIES = {"txt": "text", "text": "text", "aud": "audio", "audio": "audio", "img": "image", "image": "image"}
NATIVE_AUDIO = "aud|audio|trscb|tcrb|tts|realtime|realtimeprvw|rtime|rt"
METER_UNITS = {"1K": 1e3, "1M": 1e6}
_KINDS = {w: kind for kind, ws in METER_WORDS.items() for w in ws.split()}


def classify_meters(meters: DataFrame, name: str = "skuName", unit: str = "unitOfMeasure", price: str = "retailPrice") -> DataFrame:
    """(alias, variant, dimension, micros) of meters named by word soups: words that say direction, cache, batch, tier, lane and modality are consumed, what is left is the model.

    Only global meters count. The modality is the word next to the direction, across words that say something else; then the word behind a realtime
    one, then a hyphenated ending, then what the model's own name says. A dimension that one model and lane has at two rates goes.
    """
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    seen = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"), looked_up(F.lower(w), _KINDS).alias("kind"), looked_up(F.lower(w), MODALITIES).alias("modality")))
    printed = meters.select(F.col(name).alias("sku"), F.col(price).cast("double").alias("usd"), looked_up(F.col(unit), {k: str(v) for k, v in METER_UNITS.items()}).try_cast("double").alias("per")).where("usd > 0 and per > 0")
    rows = meters.select(F.col(name).alias("sku"), seen.alias("seen")).dropDuplicates(["sku"])  # words are read once a name
    direction = F.get(F.filter("seen", lambda s: s["kind"].isin("in", "out")), F.lit(0))
    has = lambda kind: F.exists("seen", lambda s: s["kind"] == kind)
    rows = rows.withColumn("dir", direction).where(F.col("dir").isNotNull() & has("global") & ~has("other"))
    stops = lambda side: F.filter("seen", lambda s: side(s["i"]) & s["kind"].isin("", "in", "out"))
    left, right = F.try_element_at(stops(lambda i: i < F.col("dir.i")), F.lit(-1)), F.get(stops(lambda i: i > F.col("dir.i")), F.lit(0))
    beside = F.when(left["modality"] != "", left).when(right["modality"] != "", right)
    rows = rows.withColumn("beside", beside)
    names = F.filter("seen", lambda s: (s["kind"] == "") & ~s["i"].eqNullSafe(F.col("beside.i")))
    rows = rows.withColumn("alias", F.array_join(F.transform(names, lambda s: s["w"]), " "))
    realtime, ending = r"(?i)(?<![^\s-])(rt|rtime|realtime)([\s-])(txt|text|aud|audio|img|image)(?![^\s-])", r"(?i)(\S)-(txt|aud|img)\d*(?=\s|$)"
    by_name = [(F.regexp_extract("alias", realtime, 3), F.regexp_replace("alias", realtime, "$1")), (F.regexp_extract("alias", ending, 2), F.regexp_replace("alias", ending, "$1"))]
    native = F.when(F.col("alias").rlike(rf"(?i)(?<![a-z0-9])({NATIVE_AUDIO})(?![a-z0-9])"), "audio").when(F.col("alias").rlike(r"(?i)(?<![a-z0-9])(img|image)(?![a-z0-9])"), "image").otherwise("text")
    modality, alias = native, F.col("alias")
    for found, left_over in reversed(by_name):
        modality, alias = F.when(found != "", looked_up(F.lower(found), MODALITIES)).otherwise(modality), F.when(found != "", left_over).otherwise(alias)
    modality, alias = F.when(F.col("beside").isNotNull(), F.col("beside.modality")).otherwise(modality), F.when(F.col("beside").isNotNull(), F.col("alias")).otherwise(alias)
    cached = has("cached")
    base = F.when((F.col("dir.kind") == "in") & cached, "mtok_cache_read").when(F.col("dir.kind") == "in", "mtok_in").when(~cached, "mtok_out")
    lane = F.try_element_at(F.filter("seen", lambda s: s["kind"].isin("priority", "long-context")), F.lit(-1))["kind"]
    variant = F.concat_ws(" ", lane, F.when(has("batch"), "batch"))
    rows = rows.where("alias <> ''").select("sku", alias.alias("alias"), variant.alias("variant"), F.concat(base, F.when(modality == "text", "").otherwise(F.concat(F.lit("_"), modality))).alias("dimension"))
    rates = rows.where("dimension is not null").join(printed, "sku").select("alias", "variant", "dimension", F.round(F.col("usd") * 1e6 / F.col("per") * 1e6).cast("long").alias("micros"))
    return unambiguous(rates, ["alias", "variant", "dimension"], "micros")


def facts_feed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(name, id, fact, value) that a feed of providers and their models says of six facts; empty words are not said."""
    model = "struct<name: string, release_date: string, knowledge: string, reasoning: string, tool_call: string, limit: struct<context: string, output: string>>"
    rows = bodies.select(F.explode(F.from_json(body, f"map<string, struct<models: map<string, {model}>>>")).alias("seller", "s")).select(F.explode("s.models").alias("id", "m"))
    facts = {"released": "m.release_date", "context": "m.limit.context", "max_output": "m.limit.output", "knowledge": "m.knowledge", "reasoning": "m.reasoning", "tool_call": "m.tool_call"}
    said = F.array(*(F.struct(F.lit(k).alias("fact"), F.col(v).alias("value")) for k, v in facts.items()))
    return rows.select(F.coalesce("m.name", "id").alias("name"), "id", F.inline(said)).where("value is not null and value <> ''")

