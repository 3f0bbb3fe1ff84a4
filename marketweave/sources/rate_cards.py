"""Sellers' JSON rate cards as listings: (alias, variant, components, payload), one row per printed model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RateCard:
    """Where a card prints what. Paths are SQL over m, one printed model with the given schema."""

    schema: str
    rates: tuple[tuple[str, str, float], ...]  # path, dimension, micros of one printed dollar
    payload: tuple[tuple[str, str], ...] = ()  # name, path
    alias: str = "m.id"
    variant: str = "''"
    where: str = "true"
    root: str = "data"  # the key of the list of models; empty where the body is the list
    each: str = ""  # a list of m, one listing each as p
    bare: bool = True  # whether a listing without a rate stays


#: Micros of a dollar by what the price is printed for.
TOKEN, MILLION, UNIT = 1e12, 1e6, 1e6

_MODALITIES = (("input_modalities", "m.input_modalities"), ("output_modalities", "m.output_modalities"))

# The fields of each seller's card, its dimensions and units.
CARDS = {
    "openrouter": RateCard(
        "struct<id: string, name: string, description: string, context_length: bigint, pricing: struct<prompt: string, completion: string, input_cache_read: string, input_cache_write: string, request: string, image: string>, architecture: struct<input_modalities: array<string>, output_modalities: array<string>>>",
        (("m.pricing.prompt", "mtok_in", TOKEN), ("m.pricing.completion", "mtok_out", TOKEN), ("m.pricing.input_cache_read", "mtok_cache_read", TOKEN), ("m.pricing.input_cache_write", "mtok_cache_write", TOKEN), ("m.pricing.request", "call", UNIT), ("m.pricing.image", "image", UNIT)),
        (("name", "m.name"), ("context_length", "m.context_length"), ("input_modalities", "m.architecture.input_modalities"), ("output_modalities", "m.architecture.output_modalities"), ("description", "m.description")),
    ),
    "novita": RateCard(
        "struct<id: string, display_name: string, description: string, context_size: bigint, input_modalities: array<string>, output_modalities: array<string>, pricing: struct<prompt: struct<price_per_m_decimal: string>, completion: struct<price_per_m_decimal: string>, input_cache_read: struct<price_per_m_decimal: string>, input_cache_write: struct<price_per_m_decimal: string>>>",
        (("m.pricing.prompt.price_per_m_decimal", "mtok_in", MILLION), ("m.pricing.completion.price_per_m_decimal", "mtok_out", MILLION), ("m.pricing.input_cache_read.price_per_m_decimal", "mtok_cache_read", MILLION), ("m.pricing.input_cache_write.price_per_m_decimal", "mtok_cache_write", MILLION)),
        (("name", "m.display_name"), ("context_length", "m.context_size"), *_MODALITIES, ("description", "m.description")),
    ),
    "chutes": RateCard(
        "struct<id: string, context_length: bigint, input_modalities: array<string>, output_modalities: array<string>, pricing: struct<prompt: double, completion: double, input_cache_read: double>>",
        (("m.pricing.prompt", "mtok_in", MILLION), ("m.pricing.completion", "mtok_out", MILLION), ("m.pricing.input_cache_read", "mtok_cache_read", MILLION)),
        (("name", "m.id"), ("context_length", "m.context_length"), *_MODALITIES),
    ),
    "requesty": RateCard(
        "struct<id: string, description: string, context_window: bigint, input_price: double, output_price: double, cached_price: double>",
        (("m.input_price", "mtok_in", TOKEN), ("m.output_price", "mtok_out", TOKEN), ("m.cached_price", "mtok_cache_read", TOKEN)),
        (("name", "m.id"), ("context_length", "m.context_window"), ("description", "m.description")),
        variant="if(contains(m.id, '/'), split_part(m.id, '/', 1), '')",
    ),
}


_FOUR = (("prompt", "mtok_in"), ("completion", "mtok_out"), ("input_cache_read", "mtok_cache_read"), ("input_cache_write", "mtok_cache_write"))


def _texts(names) -> str:
    return ", ".join(f"{n}: string" for n in names)


def _flat(names: tuple[tuple[str, str], ...], scale: float) -> RateCard:
    """A list of models with one flat set of rates in one unit, printed as numbers or text."""
    return RateCard(f"struct<id: string, pricing: struct<{_texts(n for n, _ in names)}>>", tuple((f"m.pricing.{n}", d, scale) for n, d in names), (("id", "m.id"),), where="m.pricing is not null", bare=False)


#: Micros of a cent by what the price is printed for, as it is in dollars above.
CENT_A_TOKEN, CENT_A_UNIT = 1e10, 1e4

# More sellers' cards. A rate that has a fourth part counts only where that holds.
CARDS |= {
    "openrouter_endpoints": RateCard(
        f"struct<id: string, name: string, endpoints: array<struct<status: bigint, tag: string, provider_name: string, context_length: bigint, pricing: struct<{_texts(n for n, _ in _FOUR)}>>>>",
        tuple((f"p.pricing.{n}", d, TOKEN) for n, d in _FOUR), (("name", "m.name"), ("context_length", "p.context_length")),
        variant="lower(coalesce(p.tag, p.provider_name, ''))", where="coalesce(p.status, 0) >= 0 and coalesce(p.tag, p.provider_name, '') <> ''", root="one", each="m.endpoints", bare=False,
    ),
    "deepinfra": RateCard(
        "struct<model_name: string, type: string, description: string, max_tokens: bigint, deprecated: string, pricing: struct<type: string, cents_per_input_token: double, cents_per_output_token: double, cents_per_image_unit: double, cents_per_output_sec: double, cents_per_input_sec: double, cents_per_sec: double, cents_per_input_chars: double>>",
        (
            ("if(m.pricing.type in ('tokens', 'input_tokens'), m.pricing.cents_per_input_token, null)", "mtok_in", CENT_A_TOKEN), ("if(m.pricing.type = 'tokens', m.pricing.cents_per_output_token, null)", "mtok_out", CENT_A_TOKEN),
            ("if(m.pricing.type = 'image_units', m.pricing.cents_per_image_unit, null)", "image", CENT_A_UNIT), ("if(m.pricing.type = 'output_length', m.pricing.cents_per_output_sec, null)", "second", CENT_A_UNIT),
            ("if(m.pricing.type = 'input_length', m.pricing.cents_per_input_sec, null)", "second", CENT_A_UNIT), ("if(m.pricing.type = 'time', m.pricing.cents_per_sec, null)", "second", CENT_A_UNIT),
            ("if(m.pricing.type = 'input_character_length', m.pricing.cents_per_input_chars, null)", "character", CENT_A_UNIT),
        ),
        (("name", "m.model_name"), ("context_length", "m.max_tokens"), ("kind", "m.type"), ("description", "m.description")), alias="m.model_name", where="m.deprecated is null", root="",
    ),
    "sambanova": RateCard("struct<id: string, context_length: bigint, pricing: struct<prompt: string, completion: string>>", (("m.pricing.prompt", "mtok_in", TOKEN), ("m.pricing.completion", "mtok_out", TOKEN)), (("name", "m.id"), ("context_length", "m.context_length"))),
    "vercel": RateCard(
        "struct<id: string, name: string, description: string, context_window: bigint, modalities: struct<input: array<string>, output: array<string>>, pricing: struct<input: string, output: string, input_cache_read: string, input_cache_write: string>>",
        (("m.pricing.input", "mtok_in", TOKEN), ("m.pricing.output", "mtok_out", TOKEN), ("m.pricing.input_cache_read", "mtok_cache_read", TOKEN), ("m.pricing.input_cache_write", "mtok_cache_write", TOKEN)),
        (("name", "m.name"), ("description", "m.description"), ("context_length", "m.context_window"), ("input_modalities", "m.modalities.input"), ("output_modalities", "m.modalities.output")),
    ),
    "nebius": RateCard(
        "struct<name: string, description: string, status: string, flavors: array<struct<model_id: string, label: string, max_model_len: bigint, input_price_per_million_tokens: double, output_price_per_million_tokens: double, cached_input_price_per_million_tokens: double>>>",
        (("p.input_price_per_million_tokens", "mtok_in", MILLION), ("p.output_price_per_million_tokens", "mtok_out", MILLION), ("p.cached_input_price_per_million_tokens", "mtok_cache_read", MILLION)),
        (("name", "m.name"), ("description", "m.description"), ("context_length", "p.max_model_len")), alias="p.model_id", variant="if(p.label = 'cheap', '', coalesce(p.label, ''))", where="coalesce(m.status, '') <> 'inactive'", root="", each="m.flavors",
    ),
    "huggingface": RateCard(
        "struct<id: string, architecture: struct<input_modalities: array<string>, output_modalities: array<string>>, providers: array<struct<provider: string, status: string, context_length: bigint, pricing: struct<input: double, output: double>>>>",
        (("p.pricing.input", "mtok_in", MILLION), ("p.pricing.output", "mtok_out", MILLION)),
        (("name", "m.id"), ("context_length", "p.context_length"), ("input_modalities", "m.architecture.input_modalities"), ("output_modalities", "m.architecture.output_modalities")), variant="p.provider", where="p.status = 'live' and p.provider is not null", each="m.providers",
    ),
    "electronhub": _flat((("input", "mtok_in"), ("output", "mtok_out")), MILLION),
    "inference-net": _flat((("prompt", "mtok_in"), ("completion", "mtok_out"), ("input_cache_read", "mtok_cache_read")), TOKEN),
    "avian": _flat((("input_per_million", "mtok_in"), ("output_per_million", "mtok_out"), ("cache_read_per_million", "mtok_cache_read")), MILLION),
    "ppinfra": RateCard(
        "struct<id: string, pricing: struct<prompt: struct<price_per_m_decimal: string>, completion: struct<price_per_m_decimal: string>>>",
        (("m.pricing.prompt.price_per_m_decimal", "mtok_in", MILLION), ("m.pricing.completion.price_per_m_decimal", "mtok_out", MILLION)), (("id", "m.id"),), bare=False,
    ),
}


def _listings(bodies: DataFrame, card: RateCard, body: str) -> DataFrame:
    """Every named model of the bodies as m, with p where the card lists under it."""
    if card.root == "":
        models = F.from_json(body, f"array<{card.schema}>")
    elif card.root == "one":
        models = F.array(F.from_json(body, f"struct<data: {card.schema}>")["data"])
    else:
        models = F.from_json(body, f"struct<{card.root}: array<{card.schema}>>")[card.root]
    rows = bodies.select(F.explode(models).alias("m")).where("m is not null")
    if card.each:
        rows = rows.select("m", F.explode(F.expr(card.each)).alias("p"))
    return rows.where(f"{card.alias} is not null and {card.where}")


def _printed(card: RateCard) -> list[Column]:
    """Every rate that the card may print, as (dimension, micros); micros is null where it prints none."""
    return [F.struct(F.lit(dimension).alias("dimension"), F.round(F.expr(f"try_cast({path} as double)") * scale).cast("long").alias("micros")) for path, dimension, scale in card.rates]


def _payload(card: RateCard) -> Column:
    return F.to_json(F.struct(*(F.expr(path).alias(name) for name, path in card.payload))).alias("payload")


def flatten_rate_card(bodies: DataFrame, card: RateCard, body: str = "body") -> DataFrame:
    """Listings of every card in a JSON text column; models without a name go, as do rates that are not above zero in whole micros.

    A null or broken body gives no row; a model without a rate keeps its listing with no components, unless the card says otherwise.
    """
    rows = _listings(bodies, card, body)
    rows = rows.select(F.expr(card.alias).alias("alias"), F.expr(card.variant).alias("variant"), F.filter(F.array(*_printed(card)), lambda r: r["micros"] > 0).alias("components"), _payload(card))
    return rows if card.bare else rows.where(F.size("components") > 0)


def listed_rates(bodies: DataFrame, card: RateCard, body: str = "body") -> DataFrame:
    """What unpivot gives of flatten_rate_card, each rate worked out once and in generated code: no lambda goes over the rates and no filter asks for them again."""
    rows = _listings(bodies, card, body)
    return rows.select(F.expr(card.alias).alias("alias"), F.expr(card.variant).alias("variant"), F.inline(F.array(*_printed(card))), _payload(card)).where("micros > 0")


def unpivot(listings: DataFrame) -> DataFrame:
    """One row per listing and rate."""
    return listings.select("alias", "variant", F.inline("components"), "payload")


def free_feed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(id, name, expires) of the models that a feed declares free by name and prices at nought both ways."""
    m = "struct<id: string, name: string, expiration_date: string, pricing: struct<prompt: string, completion: string>>"
    rows = bodies.select(F.explode(F.from_json(body, f"struct<data: array<{m}>>")["data"]).alias("m")).where("endswith(m.id, ':free')")
    rows = rows.where("try_cast(m.pricing.prompt as double) = 0 and try_cast(m.pricing.completion as double) = 0")
    return rows.select("m.id", F.coalesce("m.name", "m.id").alias("name"), F.col("m.expiration_date").alias("expires"))
