"""The catalogue as documents for a reader that takes so many characters at once: a section a thing, packed whole in their order."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.functions import ordered
from marketweave.functions.scratch import written
from marketweave.operators import market

#: Characters that a document may have, and documents' worth of blocks that one task cuts at once.
LIMIT, CELL = 40 * 1024, 64
#: Placings of a board that are told.
TOLD = 40

# How a unit follows its figure in a sentence, and the documents' names, titles and first lines.
UNITS = {
    "mtok_in": "per million tokens in", "mtok_out": "per million tokens out", "mtok_cache_read": "per million tokens cached", "month": "a month", "image": "an image", "image_in": "an image sent in", "second": "a second",
    "second_in": "a second of audio in", "second_out": "a second of audio out", "minute": "a minute", "call": "a call", "character": "a character", "page": "a page", "result": "a result",
}
REGISTERS = {
    "model": ("models", "Models in the AI market, with prices", "Every model the catalogue holds: who made it, what it takes and returns, what it costs and at which company, and where it places."),
    "tool": ("tools", "AI tools, with prices", "Tools sold in the AI market and what each costs."),
    "agent": ("agents", "AI agents, with prices", "Agents sold in the AI market and what each costs."),
    "subscription": ("subscriptions", "AI subscriptions and what they allow", "Plans bought by the month, their price and their allowance."),
}
COMPANIES = ("companies", "Companies in the AI market", "Every company the catalogue holds: what it is, what it sells or builds, whether it has taken venture money, and who backed it.")
BOARDS = ("boards", "Leaderboards the catalogue reads", "Every board, who runs it, what it measures, and how the models we hold placed on it.")
VOCABULARY = ("vocabulary", "The vocabulary of the AI market", "What the words mean, in the terms a buyer needs them.")


def dollars(micros: Column) -> Column:
    """A figure in a sentence: none of its places above a hundred dollars, two above one, else up to eight without noughts behind.

    A half is decided as printf does it, by the double that stands for the dollars, and where that is the half itself, to the even
    digit; format_string would round the shortest decimal that names the double, and every half upwards.
    """
    d = micros / 1e6
    small = F.regexp_replace(F.format_string("%.8f", d), r"\.?0+$", "")
    # 25 d less an eighth of the odd number of half cents, in exact parts: at a half its sign tells where the double lies
    high = d.cast("float").cast("double")
    beyond = (25 * high - F.floor(micros / 5000) / 8) + 25 * (d - high)
    cents, rest = F.floor(micros / 10_000), micros % 10_000
    cents = cents + F.when((rest > 5000) | ((rest == 5000) & ((beyond > 0) | ((beyond == 0) & (cents % 2 == 1)))), 1).otherwise(0)
    whole, rest = F.floor(micros / 1_000_000), micros % 1_000_000
    whole = whole + F.when((rest > 500_000) | ((rest == 500_000) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.lit("$"), F.when(d >= 100, whole.cast("string")).when(d >= 1, F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)).otherwise(small))


def six_figures(v: Column) -> Column:
    """A number with six significant figures, without noughts behind, and with an exponent beyond a million or below a hundred-thousandth."""
    exponent = F.floor(F.log10(F.abs(v))).cast("int")
    fixed = F.element_at(F.array(*(F.format_string(f"%.{k}f", v) for k in range(11))), F.least(F.greatest(5 - exponent, F.lit(0)), F.lit(10)) + 1)
    bare = lambda s: F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    raw = F.format_string("%.5e", v)
    return F.when(v == 0, "0").when(exponent.between(-5, 5), bare(fixed)).otherwise(F.concat(bare(F.regexp_extract(raw, r"^([^e]*)e", 1)), F.regexp_extract(raw, r"(e.*)$", 1)))


def _told(text: str, column: str, when: Column | None = None) -> Column:
    """The sentence with the column in place of {}; null, and so left out, where the column is or `when` fails."""
    before, after = text.split("{}")
    said = F.when(F.col(column).isNotNull(), F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after)))
    return said if when is None else F.when(when, said)


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def _section(document: tuple[str, str, str], name: Column, body: Column, order: list[Column]) -> list[Column]:
    """(document, title, intro, by, then, text): a section and its place, by its name in lower case."""
    return [*(F.lit(x).alias(n) for x, n in zip(document, ("document", "title", "intro"), strict=True)), F.lower(name).alias("by"), F.concat_ws("\x01", *order).alias("then"), F.concat(F.lit("## "), name, F.lit("\n\n"), body, F.lit("\n")).alias("text")]


def things(t, register: str, site: str) -> DataFrame:
    """A section for each thing of the register: what it is, takes and returns, who sells it for how much, and its best placing.

    t has entities(id, register, name, maker, input_kind, output_kind, context, released, license, open_weights, tasks, limits), providers,
    offerings, benchmarks, suites and prices. Of equal figures the first company by name is told.
    """
    live = t.offerings.where("status = 'live' and coalesce(variant, '') = ''").select(F.col("id").alias("offering_id"), F.col("entity_id").alias("id"), "provider_id")
    sold = market.current_prices(t).join(live, "offering_id").join(t.providers.select(F.col("id").alias("provider_id"), F.col("name").alias("seller")), "provider_id").where("dimension is not null")
    each = sold.groupBy("id", "dimension").agg(F.min(F.struct("micros", "seller")).alias("low"), F.collect_set("seller").alias("sellers"))
    unit = F.coalesce(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.col("dimension")], F.concat(F.lit("per "), F.col("dimension")))
    said = F.concat(F.lit("The cheapest is "), dollars(F.col("low.micros")), F.lit(" "), unit, F.lit(", at "), F.col("low.seller"), F.lit("."))
    rates = each.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sellers")))).alias("sellers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension", said.alias("said")))), lambda x: x["said"]), " ").alias("rates"))
    suites = t.suites.select(F.col("id").alias("suite"), F.col("name").alias("board"))
    stands = t.benchmarks.where("rank is not null and out_of > 1").join(suites, "suite", "left").groupBy(F.col("entity_id").alias("id")).agg(F.min(F.struct((F.col("rank") / F.col("out_of")).alias("share"), "rank", "out_of", F.coalesce("board", "suite").alias("board"))).alias("s"))
    made = t.providers.select(F.col("id").alias("maker"), F.col("name").alias("made_by"))
    rows = t.entities.where(F.col("register") == register).join(made, "maker", "left").join(rates, "id", "left").join(stands, "id", "left")
    kind = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("text"))
    n = F.size("sellers")
    rows = rows.withColumns({"context_said": X.grouped(F.col("context")), "tasks_said": F.array_join(F.split("tasks", ","), ", "), "sellers_said": F.array_join("sellers", ", ")})
    body = F.concat_ws(
        " ",
        F.concat(F.col("name"), F.lit(f" is a {register}"), F.coalesce(F.concat(F.lit(" made by "), F.nullif("made_by", F.lit("")), F.lit(",")), F.lit("")), F.lit(" which takes "), kind("input_kind"), F.lit(" and returns "), kind("output_kind"), F.lit(".")),
        _told("Its context window is {} tokens.", "context_said"), _told("It was published on {}.", "released"),
        F.coalesce(_told("Its licence is {}.", "license"), F.when(F.col("open_weights"), F.lit("Its weights are published."))),
        _told("The catalogue files it under {}.", "tasks_said", F.col("tasks") != ""), _told("What the plan allows: {}.", "limits"),
        F.when(F.col("sellers").isNull(), "Nobody in the catalogue publishes a price for it.").otherwise(F.concat(n.cast("string"), F.lit(" "), _counted(n, "company", "companies"), F.lit(" "), _counted(n, "sells", "sell"), F.lit(" it: "), F.col("sellers_said"), F.lit("."))),
        F.col("rates"), F.concat(F.lit("Its best placing is "), F.col("s.rank").cast("string"), F.lit(" of "), F.col("s.out_of").cast("string"), F.lit(" on "), F.col("s.board"), F.lit(".")),
        F.concat(F.lit(f"Page: {site}/index — search for "), F.col("name"), F.lit(".")),
    )
    return rows.select(*_section(REGISTERS[register], F.col("name"), body, [F.col("id")]))


def companies(t) -> DataFrame:
    """A section for each company: what it is, its first description, what it makes and sells, its money, its backers and its investments.

    providers has id, name, url, kind, raised, rounds and backing; docs has seq, which tells the first description.
    """
    count = lambda df, key, what, out: df.groupBy(F.col(key).alias("id")).agg(what.alias(out))
    edges = t.investments.select("fund_id", "company_id").distinct()
    named = t.providers.select("id", "name")
    listed = lambda key, other, out: edges.join(named.withColumnRenamed("id", other), other).groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list("name")).alias(out))
    rows = t.providers.join(count(t.entities.where("maker is not null"), "maker", F.count("*"), "makes"), "id", "left").join(count(t.offerings, "provider_id", F.countDistinct("entity_id"), "sells"), "id", "left")
    what = t.docs.where("kind = 'description'").groupBy(F.col("subject").alias("id")).agg(F.min(F.struct("seq", "text")).getField("text").alias("what"))
    rows = rows.join(what, "id", "left").join(listed("company_id", "fund_id", "backers"), "id", "left").join(listed("fund_id", "company_id", "holds"), "id", "left")
    rows = rows.withColumns({"backers_said": F.array_join("backers", ", "), "rounds": F.coalesce("rounds", F.lit(0))})
    raised = F.concat(F.lit("It has raised at least $"), X.grouped(F.col("raised")), F.lit(" across "), F.col("rounds").cast("string"), _counted(F.col("rounds"), " round", " rounds"), F.lit(" that we could read."))
    body = F.concat_ws(
        " ",
        F.concat(F.col("name"), F.lit(" is filed as a "), F.coalesce("kind", F.lit("vendor")), F.coalesce(F.concat(F.lit(" and its site is "), F.nullif("url", F.lit(""))), F.lit("")), F.lit(".")), F.col("what"),
        F.when(F.col("makes") > 0, F.concat(F.lit("It makes "), F.col("makes").cast("string"), _counted(F.col("makes"), " thing in the catalogue.", " things in the catalogue."))),
        F.when(F.col("sells") > 0, F.concat(F.lit("It sells "), F.col("sells").cast("string"), _counted(F.col("sells"), " thing.", " things."))),
        F.when(F.coalesce("raised", F.lit(0)) != 0, raised).otherwise(F.concat(F.lit("It is venture-backed: "), F.nullif("backing", F.lit("")), F.lit("."))),
        _told("Its investors are {}.", "backers_said"), F.concat(F.lit("As an investor it has backed "), F.size("holds").cast("string"), F.lit(" companies: "), F.array_join("holds", ", "), F.lit(".")),
    )
    return rows.select(*_section(COMPANIES, F.col("name"), body, [F.col("id")]))


def boards(t, order: str = "seq") -> DataFrame:
    """A section for each board on which something we hold has a rank: who runs it, what it measures, and its first TOLD placings, ties by `order`."""
    ranked = t.benchmarks.where("rank is not null").join(t.entities.select(F.col("id").alias("entity_id"), F.col("name").alias("thing")), "entity_id")
    told = ranked.withColumn("_n", F.row_number().over(W.partitionBy("suite").orderBy("rank", order))).where(F.col("_n") <= TOLD)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("thing"), F.lit(" ("), six_figures(F.col("value").cast("double")), F.lit(")"))
    told = told.groupBy(F.col("suite").alias("id")).agg(F.max(F.coalesce("out_of", F.lit(0))).alias("field"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "; ").alias("lines"))
    or_own = lambda c, own: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(own))
    body = F.concat(
        F.col("name"), F.lit(" is run by "), or_own("measurer", "its own authors"), F.lit(" and scores models on "), or_own("metric", "its own metric"), F.lit(". It has ranked "), F.col("field").cast("string"), F.lit(" models; the catalogue holds "), F.col("n").cast("string"), F.lit(" of them."),
        F.coalesce(F.concat(F.lit(" Source: "), F.nullif("url", F.lit("")), F.lit(".")), F.lit("")), F.lit(" The standings, best first: "), F.col("lines"), F.lit("."),
    )
    return t.suites.join(told, "id").select(*_section(BOARDS, F.col("name"), body, [F.col("id")]))


def vocabulary(terms: DataFrame, site: str) -> DataFrame:
    """A section for each of terms(term, kind, short, body, also): also is a JSON list of other words for it."""
    also = F.array_join(F.from_json(F.coalesce("also", F.lit("[]")), "array<string>"), ", ")
    body = F.concat_ws(" ", F.concat(F.col("short"), F.lit(" ("), F.col("kind"), F.lit(".) "), F.col("body")), F.when(also != "", F.concat(F.lit("Also called: "), also, F.lit("."))), F.lit(f"Page: {site}/index/tech."))
    return terms.select(*_section(VOCABULARY, F.col("term"), body, [F.col("term")]))


def _searched(limit: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """For each block of a cell, the block that begins the next document if one begins here (-1: none), and where that chain leaves the cell."""
    cell_size = CELL * limit

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", ignore_index=True)
        k, at, size, of = (rows[c].to_numpy(np.int64) for c in ("k", "at", "length", "blocks"))
        own = np.flatnonzero(rows["own"].to_numpy())
        found = np.maximum(np.searchsorted(at + size, rows["reach"].to_numpy(np.int64)[own], side="right"), own + 1)
        inside = found < len(k)
        clipped = np.minimum(found, len(k) - 1)
        follows = (own + 1 == len(k)) & (k[own] + 1 < of[own])  # the next block lies beyond what a cell looks at, so it is the next
        then = np.where(inside, k[clipped], np.where(follows, k[own] + 1, -1))
        then_at = np.where(inside, at[clipped], np.where(follows, at[own] + size[own] + 2, -1))
        leaves, leaves_at = then.copy(), then_at.copy()
        last = own[-1] if len(own) else -1
        for i in range(len(own) - 1, -1, -1):
            if then[i] >= 0 and inside[i] and found[i] <= last:
                leaves[i], leaves_at[i] = leaves[found[i] - own[0]], leaves_at[found[i] - own[0]]
        return pd.DataFrame({"document": key[0], "cell": key[1], "k": k[own], "then": then, "leaves": leaves, "leaves_cell": np.where(leaves >= 0, leaves_at // cell_size, -1), "enters": (at[own] < key[1] * cell_size + limit + 8) | (own == own[0] if len(own) else False)})

    return run


def _walked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Each block of a cell with the block that begins its document; null for those that belong to what began before the cell."""
    rows = rows.sort_values("k", ignore_index=True)
    k, then = rows["k"].to_numpy(np.int64), rows["then"].to_numpy(np.int64)
    first = np.full(len(k), -1, np.int64)
    entry = rows["entry"].iloc[0]
    at = -1 if pd.isna(entry) else int(entry)
    while 0 <= at <= k[-1]:
        first[at - k[0] :] = at
        at = then[at - k[0]]
    return pd.DataFrame({"document": key[0], "cell": key[1], "k": k, "first": pd.arrays.IntegerArray(first, first < 0)})


def greedy_cuts(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """blocks(document, by, then, length, lead, ...) with k, their place from 0, and part, from 1: the document that each goes to.

    Blocks go to the open document in their order, joined by two characters, until the next would bring it above limit; that
    one begins another, behind the lead and two characters. The first block is the head and has no lead. Whoever is longer than
    limit stays whole, in a document of its own. Where a document ends depends on where it began, so every block is given the one that would come
    after it, by running sums of lengths: in cells of CELL documents, as none reaches further. Chains through a cell are followed inside it, and from
    cell to cell by steps that double.
    """
    size = CELL * limit
    rows = ordered.running(blocks.withColumn("_joined", F.col("length") + 2), ["document"], [F.col("by"), F.col("then")], {"_joined": "_end"}, "_k")
    rows = rows.select(*blocks.columns, (F.col("_k") - 1).alias("k"), (F.col("_end") - F.col("length") - 2).alias("at"))
    rows = written(rows.withColumn("cell", F.floor(F.col("at") / size)), "blocks")
    reach = F.col("at") + limit - F.when(F.col("k") == 0, -2).otherwise(F.col("lead"))
    of = rows.groupBy("document").agg(F.count("*").alias("blocks"))
    near = F.when((F.col("cell") > 0) & (F.col("at") - F.col("cell") * size < limit + 8), F.array(F.struct("cell", F.lit(True).alias("own")), F.struct((F.col("cell") - 1).alias("cell"), F.lit(False).alias("own")))).otherwise(F.array(F.struct("cell", F.lit(True).alias("own"))))
    seen = rows.join(of, "document").select("document", "k", "at", "length", "blocks", reach.alias("reach"), F.inline(near))
    found = written(seen.groupBy("document", "cell").applyInPandas(_searched(limit), "document string, cell long, k long, then long, leaves long, leaves_cell long, enters boolean"), "cuts")

    hops = found.where("enters and leaves >= 0").select("document", "k", F.col("leaves").alias("to"), F.col("leaves_cell").alias("to_cell"))
    reached = rows.where("k = 0").select("document", "k", "cell")
    while True:
        further = written(reached.join(hops, ["document", "k"]).select("document", F.col("to").alias("k"), F.col("to_cell").alias("cell")), "further")
        if further.isEmpty():
            break
        reached = written(reached.union(further), "reached")
        hops = written(hops.join(hops.select("document", F.col("k").alias("to"), F.col("to").alias("_to"), F.col("to_cell").alias("_cell")), ["document", "to"]).select("document", "k", F.col("_to").alias("to"), F.col("_cell").alias("to_cell")), "hops")
    entries = reached.select("document", "cell", F.col("k").alias("entry"))
    walked = written(found.select("document", "cell", "k", "then").join(entries, ["document", "cell"], "left").groupBy("document", "cell").applyInPandas(_walked, "document string, cell long, k long, first long"), "walked")
    # a cell's first blocks may belong to what began in a cell before; as many rows as cells
    before = F.last("begun", True).over(W.partitionBy("document").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    begun = walked.groupBy("document", "cell").agg(F.max("first").alias("begun")).select("document", "cell", before.alias("before"))
    firsts = walked.join(begun, ["document", "cell"]).select("document", "k", F.coalesce("first", "before").alias("first"))
    parts = ordered.placed(firsts.where("k = first").select("document", "first"), ["document"], [F.col("first")], "part")
    return rows.drop("at", "cell").join(firsts.join(parts, ["document", "first"]).select("document", "k", "part"), ["document", "k"])


def export_passages(sections: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(document, part, file, text) of sections(document, title, intro, by, then, text): every document cut before its headings into files of at most limit characters.

    A file after the first begins with the title again. A section with headings of its own may be cut there; what has no heading
    to cut at stays whole. A document of one file has no number in its name.
    """
    lead = F.concat(F.lit("# "), F.col("title"))
    heads = sections.select("document", lead.alias("lead"), F.concat(lead, F.lit("\n\n"), F.col("intro"), F.lit("\n")).alias("text")).distinct()
    cut = F.posexplode(F.split("text", "\n## "))
    rest = sections.select("document", lead.alias("lead"), "by", "then", cut.alias("_i", "_t"))
    rest = rest.select("document", "lead", F.concat(F.lit("1"), F.col("by")).alias("by"), F.concat("then", F.lit("\x01"), F.format_string("%09d", "_i")).alias("then"), F.when(F.col("_i") == 0, F.col("_t")).otherwise(F.concat(F.lit("## "), F.col("_t"))).alias("text"))
    blocks = heads.select("document", "lead", F.lit("0").alias("by"), F.lit("").alias("then"), "text").unionByName(rest)
    blocks = written(blocks.withColumn("length", F.char_length("text").cast("long")), "sections")
    parts = greedy_cuts(blocks.select("document", "by", "then", "length", F.char_length("lead").cast("long").alias("lead")), limit).select("document", "by", "then", "k", "part")
    whole = blocks.join(parts, ["document", "by", "then"]).groupBy("document", "part").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("b"), F.first("lead").alias("lead"))
    body = F.array_join(F.transform("b", lambda x: x["text"]), "\n\n")
    of = parts.groupBy("document").agg(F.max("part").alias("of"))
    name = F.concat(F.col("document"), F.when(F.col("of") > 1, F.concat(F.lit("-"), F.format_string("%02d", "part"))).otherwise(F.lit("")), F.lit(".md"))
    return whole.join(of, "document").select("document", "part", name.alias("file"), F.when(F.col("part") == 1, body).otherwise(F.concat("lead", F.lit("\n\n"), body)).alias("text"))
