"""Scalar expressions of the catalogue: Column to Column, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The last two labels of a url's host, lower-cased; a url may lack its scheme. Null counts as empty."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:https?://)*(?:www\.)*", "")
    labels = F.split(F.lower(F.split_part(bare, F.lit("/"), F.lit(1))), r"\.", -1)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def authority(source: Column, home: Column) -> Column:
    """2 where a figure comes from the seller's own host, else 0."""
    return F.when((F.coalesce(home, F.lit("")) != "") & (host_of(source) == host_of(home)), 2).otherwise(0)


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days, never below zero."""
    return F.greatest(F.datediff(later, earlier), F.lit(0))


def norm(name: Column) -> Column:
    """Lower case, a plus spelt out, letters and digits only."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit("+"), F.lit("plus")), "[^a-z0-9]", "")


def slug(name: Column, keep: str = "", joiner: str = "-", plus: str = "plus", ampersand: str = "and") -> Column:
    """Lower-case words joined by one character; further characters may be kept, plus and ampersand are spelt."""
    spelt = F.lower(name)
    if plus:
        spelt = F.replace(spelt, F.lit("+"), F.lit(plus))
    if ampersand:
        spelt = F.replace(spelt, F.lit("&"), F.lit(ampersand))
    kept = "".join("\\" + c for c in keep)
    return F.regexp_replace(F.regexp_replace(spelt, f"[^a-z0-9{kept}]+", joiner), f"^{joiner}+|{joiner}+$", "")


def fact_date(value: Column) -> Column:
    """A date from epoch seconds above 1e9 or from the front of an ISO date; else null."""
    seconds = value.try_cast("double")
    iso = F.substring(value, 1, 10).try_cast("date")
    return F.when(seconds > 1e9, F.to_date(F.timestamp_seconds(seconds))).otherwise(iso)


_NUMBER = r"(\d+(?:\.\d+)?)"


def read_size(name: Column) -> Column:
    """Billions of parameters in a name: the total of a mixture ("30B-A3B") first, else the largest "nB"; null without one."""
    total = F.regexp_extract(name, rf"{_NUMBER}\s*[bB][\s-]*[aA]{_NUMBER}\s*[bB]", 1).try_cast("double")
    sizes = F.regexp_extract_all(name, F.lit(rf"(?<![a-zA-Z0-9.]){_NUMBER}\s*[bB](?![a-zA-Z0-9])"), F.lit(1))
    return F.coalesce(total, F.array_max(F.transform(sizes, lambda x: x.cast("double"))))


# Gigabytes of a billion parameters at four bits, gigabytes kept for the run, share of a device's memory that a model may take.
GB_A_BILLION, GB_BESIDE, SHARE_OF_DEVICE = 0.65, 1.0, 0.7

# Size bands and the billions at which each begins; a band ends where the next begins.
SIZE_BANDS = (("nano", 0.0), ("xs", 3.0), ("s", 10.0), ("m", 30.0), ("l", 100.0), ("xl", 300.0), ("frontier", 1000.0))


def memory_gb(billions: Column) -> Column:
    return F.round(billions * GB_A_BILLION + GB_BESIDE, 1)


def fits_billions(device_gb: Column) -> Column:
    """Billions of parameters that a device of so many gigabytes holds."""
    return F.greatest(device_gb * SHARE_OF_DEVICE - GB_BESIDE, F.lit(0.0)) / GB_A_BILLION


def size_band(billions: Column) -> Column:
    """The band a size falls in; null for null or a negative size."""
    out = F.lit(None).cast("string")
    for name, begin in SIZE_BANDS:
        out = F.when(billions >= begin, F.lit(name)).otherwise(out)
    return out


# Licences that allow commercial use, the beginning of those for research only, and the word for closed weights.
OPEN_LICENCES = ("apache-2.0", "mit", "cc-by-4.0", "bsd-3-clause", "openmdw-1.1")
RESEARCH_PREFIX, CLOSED = "cc-by-nc", "proprietary"


def licence_family(licence: Column) -> Column:
    """open, noncommercial, proprietary, or open-with-conditions for any other licence; null for null."""
    known = F.when(licence.isin(*OPEN_LICENCES), "open").when(licence.ilike(RESEARCH_PREFIX + "%"), "noncommercial").when(licence == CLOSED, CLOSED)
    return F.when(licence.isNotNull(), F.coalesce(known, F.lit("open-with-conditions")))


# Parts of a metric's name that say that less is better.
LOWER_WORDS = ("rate", "error", "latency", "cost", "price", "perplex", "wer", "loss", "hallucinat")


def lower_is_better(metric: Column) -> Column:
    return F.lower(metric).rlike("|".join(LOWER_WORDS))


# Kinds of serving lanes and what a lane's name has in it, in order of precedence.
LANE_FAMILIES = (("batch", "batch"), ("flex", "flex"), ("faster", "fast|priority"), ("regional", "/|region| eu| us|global"))


def lane_family(variant: Column) -> Column:
    """The kind of a serving lane; the standard lane, which has no name, has none."""
    out = F.lit("separately routed")
    for family, words in reversed(LANE_FAMILIES):
        out = F.when(F.lower(variant).rlike(words), family).otherwise(out)
    return F.when(variant != "", out)


# How a unit of price is said beside a figure, and in a sentence.
UNIT_LABELS = {
    "mtok_in": "per Mtok in", "mtok_out": "per Mtok out", "mtok": "per Mtok", "mtok_cache_read": "per Mtok cached", "mtok_cache_write": "per Mtok cache write",
    "mtok_in_audio": "per Mtok in, audio", "mtok_out_audio": "per Mtok out, audio", "mtok_in_image": "per Mtok in, image", "mtok_out_image": "per Mtok out, image",
    "mtok_cache_read_audio": "per Mtok cached, audio", "mtok_cache_read_image": "per Mtok cached, image", "mtok_out_reasoning": "per Mtok out, reasoning",
    "image": "per image", "image_in": "per image in", "second": "per second", "second_in": "per second in", "second_out": "per second out", "minute": "per minute",
    "call": "per call", "character": "per character", "page": "per page", "result": "per result", "month": "per month",
}
UNIT_PHRASES = {
    "mtok_in": "per million tokens", "mtok": "per million tokens", "mtok_out": "per million tokens", "mtok_cache_read": "per million tokens cached",
    "mtok_in_audio": "per million audio tokens", "mtok_out_audio": "per million audio tokens", "month": "a month", "image": "an image", "image_in": "an image",
    "second": "a second", "second_in": "a second", "second_out": "a second", "minute": "a minute", "character": "a character", "page": "a page", "call": "a call", "result": "a result",
}


def looked_up(key: Column, table: dict[str, str], default: str = "") -> Column:
    """A small constant table as a map literal."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def unit_label(dimension: Column) -> Column:
    return looked_up(dimension, UNIT_LABELS)


def unit_phrase(dimension: Column) -> Column:
    return looked_up(dimension, UNIT_PHRASES)


# The vocabulary of what a thing takes or returns, in its order, words that name each, and words that do so only in short values.
KINDS = ("text", "code", "image", "audio", "video", "file", "embedding")
KIND_WORDS = {
    "text": "text|prompt|markdown|string|transcription|transcript|caption", "code": "code", "image": "image|picture|photo|img",
    "audio": "audio|speech|sound|music", "video": "video|clip", "file": "pdf|document", "embedding": "embedding",
}
SHORT_KIND_WORDS = {"file": "file|files|doc", "embedding": "vector"}
SHORT = 40


def normalise_kind(raw: Column) -> Column:
    """Words for what a thing takes or returns, as kinds of the vocabulary in its order joined by " + ".

    A plural counts as its word. A short value without a known word is kept in lower case, a long one is text; null and blank are empty.
    """
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    short = F.octet_length(low) <= SHORT
    word = lambda words: low.rlike(rf"(?<![a-z0-9])(?:{words})(?:es|s)?(?![a-z0-9])")
    found = [F.when(word(KIND_WORDS[k]) | (short & word(SHORT_KIND_WORDS[k]) if k in SHORT_KIND_WORDS else F.lit(False)), k) for k in KINDS]
    said = F.array_join(F.array_compact(F.array(*found)), " + ")
    return F.when(said != "", said).when(short, low).otherwise("text")


# What a thing of each task takes and returns where its source does not say.
TASK_KINDS = {
    "text-to-image": ("text", "image"), "image-to-image": ("image", "image"), "text-to-video": ("text", "video"), "image-to-video": ("image", "video"),
    "text-to-speech": ("text", "audio"), "automatic-speech-recognition": ("audio", "text"), "embeddings": ("text", "embedding"), "text-to-embedding": ("text", "embedding"),
    "zero-shot-image-classification": ("image", "text"), "object-detection": ("image", "text"), "text-classification": ("text", "text"),
}


def kinds_of(takes: Column, returns: Column, task: Column) -> tuple[Column, Column]:
    """(input, output) kinds: both lists of modalities if the source has both, else the task's, else text."""
    said = lambda c: normalise_kind(F.array_join(c, " + "))
    both = (F.size(takes) > 0) & (F.size(returns) > 0)
    by = [looked_up(task, {k: v[i] for k, v in TASK_KINDS.items()}, "text") for i in (0, 1)]
    return F.when(both, said(takes)).otherwise(by[0]), F.when(both, said(returns)).otherwise(by[1])


def brand_of(name: Column) -> Column:
    """The letters a name begins with; null without any."""
    return F.nullif(F.regexp_extract(name, "^([A-Za-z]+)", 1), F.lit(""))


def is_slug(name: Column) -> Column:
    """Whether a name is a seller's id rather than a name."""
    return name.rlike(r"^[a-z0-9][a-z0-9._-]*$")


def looks_written(name: Column) -> Column:
    """From 0 to 6, how much a name looks like a person's rather than a repository's."""
    point = lambda when, n: F.when(when, n).otherwise(0)
    return point(name.contains(" "), 2) + point(~name.contains("/"), 2) + point(~name.rlike("[-_]"), 1) + point(name.rlike(r"^\p{Lu}"), 1)


# Words of a model's name that are written in their own way.
WRITTEN = {"gpt": "GPT", "oss": "OSS", "glm": "GLM", "ai": "AI", "nvfp4": "NVFP4", "deepseek": "DeepSeek", "minimax": "MiniMax"}


def display_name(model: Column) -> Column:
    """A routing id as a name: its last segment, p between digits as a stop, words capitalised, parameter counts upper-cased."""
    tail = F.regexp_replace(F.element_at(F.split(model, "/", -1), -1), r"(?<=\d)p(?=\d)", ".")

    def word(w: Column) -> Column:
        low = F.lower(w)
        out = F.concat(F.upper(w.substr(F.lit(1), F.lit(1))), w.substr(F.lit(2), F.length(w)))
        out = F.when(low.rlike("^[0-9]"), w).otherwise(out)
        out = F.when(low.rlike("^a*[0-9]+b$"), F.upper(low)).otherwise(out)
        out = F.when(low.startswith("gpt"), F.regexp_replace(w, "^(.*?)gpt", "$1GPT")).otherwise(out)
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WRITTEN.items() for x in kv)), low), out)

    return F.array_join(F.transform(F.split(tail, "-", -1), word), " ")


# Router names that are written in their own way.
ROUTES = {"openrouter": "OpenRouter", "fireworks": "Fireworks", "accounts": "Fireworks", "openai": "OpenAI", "anthropic": "Anthropic"}


def provider_label(route: Column) -> Column:
    """Who served a route: the first part of its last segment without remarks; null if that is empty."""
    served = F.split_part(F.trim(F.element_at(F.split(route, ", ", -1), -1)), F.lit(" ("), F.lit(1))
    low = F.lower(F.trim(F.split_part(served, F.lit("/"), F.lit(1))))
    named = looked_up(low, ROUTES)
    return F.when(low != "", F.when(named != "", named).otherwise(F.concat(F.upper(low.substr(F.lit(1), F.lit(1))), low.substr(F.lit(2), F.length(low)))))


def entity_address(name: Column, entity_id: Column, maker_name: Column) -> tuple[Column, Column]:
    """The two parts of a thing's address: its maker's slug, or commons without one, and its own, or its id's if that is empty."""
    own = F.coalesce(F.nullif(address_slug(name), F.lit("")), address_slug(F.regexp_replace(entity_id, "^ent_", "")))
    return F.coalesce(address_slug(maker_name), F.lit("commons")), own


def address_slug(name: Column) -> Column:
    """A slug with plus and ampersand spelt out as words of their own."""
    return slug(name, plus=" plus ", ampersand=" and ")


def money(micros: Column) -> Column:
    """Dollars as a reader says them: none above a hundred, two places above one, else two significant figures."""
    d = micros / 1e6
    small = F.least(F.lit(1) - F.floor(F.log10(d)), F.lit(8)).cast("int")
    places = F.when(d >= 100, 0).when(d >= 1, 2).otherwise(small)
    text = F.element_at(F.array(*(F.format_string(f"%.{k}f", d) for k in range(9))), places + 1)
    text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(micros <= 0, "$0").otherwise(F.concat(F.lit("$"), text))


def grouped(n: Column) -> Column:
    """A whole number with separators."""
    return F.format_number(n, 0)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, and th for the rest and the teens."""
    one = F.when((n % 100).isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), one)


def cost_micros(units: Column, micros_per_million: Column) -> Column:
    """Price of so many units, half up, in whole micros."""
    return F.floor((units.cast("decimal(38,0)") * micros_per_million.cast("decimal(38,0)") + F.lit(500_000).cast("decimal(38,0)")) / F.lit(1_000_000).cast("decimal(38,0)")).cast("long")


def extract_identifiers(text: Column) -> Column:
    """Distinct sorted words that carry a digit or an at sign, in lower case and without punctuation at their ends."""
    trimmed = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda w: w.rlike("[0-9@]"))))


# The shapes of a printed price, and what each unit means in the catalogue's units; other units are no rates.
PRICE = r"(?i)\$\s?([\d][\d,]*(?:\.\d+)?)\s*([kKmM]\b)?\s*(?:/|per\s+)?\s*(mo\b|month|1M tokens|million tokens|1k req|1000 req|call|request|year|yr\b|annual)"
PRICE_UNITS = {"mo": ("month", 1.0), "month": ("month", 1.0), "1m tokens": ("mtok_in", 1.0), "million tokens": ("mtok_in", 1.0), "1k req": ("call", 1e-3), "1000 req": ("call", 1e-3), "call": ("call", 1.0), "request": ("call", 1.0)}


def parse_price(text: Column) -> Column:
    """struct(dimension, micros) read from a phrase such as "$3.50 per 1M tokens"; null where another unit or none is named."""
    part = lambda i: F.lower(F.regexp_extract(text, PRICE, i))
    dollars = F.replace(part(1), F.lit(","), F.lit("")).try_cast("double") * F.when(part(2) == "k", 1e3).when(part(2) == "m", 1e6).otherwise(1.0)
    dimension, share = F.lit(None).cast("string"), F.lit(None).cast("double")
    for unit, (name, of) in PRICE_UNITS.items():
        dimension, share = F.when(part(3) == unit, name).otherwise(dimension), F.when(part(3) == unit, of).otherwise(share)
    return F.when(dollars.isNotNull() & dimension.isNotNull(), F.struct(dimension.alias("dimension"), F.round(dollars * share * 1e6, 3).cast("long").alias("micros")))


# Fixed value: the shape of a printed standing.
STANDING = r"^(\d+) of (\d+) on (.+?) — (.+?) ([\d.]+)\s*%?\s*$"


def parse_standing(text: Column) -> Column:
    """struct(rank, out_of, board, metric, value) of "1 of 105 on Board — Metric 1.8 %"; null for any other text."""
    part = lambda i: F.trim(F.regexp_extract(text, STANDING, i))
    got = F.struct(part(1).try_cast("long").alias("rank"), part(2).try_cast("long").alias("out_of"), part(3).alias("board"), part(4).alias("metric"), part(5).try_cast("double").alias("value"))
    return F.when(got["rank"].isNotNull() & got["out_of"].isNotNull() & got["value"].isNotNull(), got)
