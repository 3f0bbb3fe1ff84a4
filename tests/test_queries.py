"""Every catalogue query against DuckDB, and the rules that shared tables do not show on small rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.functions import names
from marketweave.operators import boards, history, joins, quality, upserts
from marketweave.plans import catalogue
from marketweave.plans import queries as shared

QUERIES, ORACLE_SQL = shared.QUERIES | catalogue.QUERIES, shared.ORACLE_SQL | catalogue.ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(df: pd.DataFrame) -> list[str]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        # Whole numbers come as floats where a column has nulls.
        return round(float(v), 6) if type(v).__name__.startswith(("int", "uint", "float")) else str(v)

    return sorted(repr([one(v) for v in row]) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_current_price_prefers_fresh_own_page(spark):
    rows = [("o", "2024-01-01", 1, "own", 10), ("o", "2024-02-01", 2, "other", 20), ("p", "2024-01-01", 3, "own", 10), ("p", "2024-03-01", 4, "other", 20)]
    df = spark.createDataFrame(rows, "k string, d string, seq long, src string, v long").withColumn("d", F.to_date("d"))
    got = {r.k: (r.v, r.own_page) for r in history.current_price(df, ["k"], F.col("src") == "own", "d", ["seq"]).collect()}
    assert got == {"o": (10, True), "p": (20, False)}


def test_changes_and_first_writer(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("a", 4, 5), ("b", 1, None)], "k string, s long, v long")
    assert sorted((r.k, r.s) for r in history.changes(df, ["k"], ["s"], ["v"]).collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 1)]
    got = history.first_writer(df.where("k = 'a' and v is not null").unionByName(spark.createDataFrame([("a", 9, 7)], df.schema)), ["k"], ["s"], "v").collect()
    assert [(r.k, r.v, r.clashes) for r in got] == [("a", 5, 1)]


def test_upserts_are_idempotent(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = upserts.upsert(cur, new, ["id"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upserts.upsert(once, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    empty = new.limit(0)
    assert upserts.prune(cur, empty.withColumn("id", F.col("id")), "v", ["id"]).count() == 2


def test_lane_suffix_binds_only_to_one_entity(spark):
    listings = spark.createDataFrame([("f", "m:batch", ""), ("f", "n-fast", "own"), ("f", "x", ""), ("f", "m", "own")], "source string, alias string, variant string")
    aliases = spark.createDataFrame([("f", "m", "M"), ("f", "n", "N"), ("f", "n-fast", "Q")], "source string, alias string, entity_id string")
    got = {r.alias: (r.entity_id, r.variant) for r in joins.bind_alias(listings, aliases, variant="variant").collect()}
    assert got == {"m:batch": ("M", "batch"), "n-fast": ("Q", "own"), "x": (None, ""), "m": ("M", "own")}


def test_nearest_form_fails_closed(spark):
    index = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B")], "form string, n_claims long, entity string")
    names = spark.createDataFrame([("a|b",), ("b|a",), ("z",)], "name string")
    got = {r.name: r.entity for r in joins.resolve_forms(names, F.split("name", r"\|"), index, "entity").collect()}
    assert got == {"a|b": "A", "b|a": None, "z": None}


def test_same_company(spark):
    a = spark.createDataFrame([("Acme",), ("Acme Robotics",)], "x string")
    b = spark.createDataFrame([("ACME Inc",), ("Acme Labs Ltd",), ("Other",), ("Acme Group Robotics",), ("Acme Technology Holdings plc",)], "y string")
    assert sorted(map(tuple, joins.same_company(a, b, "x", "y").collect())) == [("Acme", "ACME Inc"), ("Acme", "Acme Labs Ltd"), ("Acme", "Acme Technology Holdings plc")]


def test_report_counts_and_samples(spark):
    df = spark.createDataFrame([(" a",), ("b",)], "name string")
    rows = quality.report({"padded": (quality.padded(df, "name"), True), "none": (df.where("false"), False)}).collect()
    assert {r.check: (r.findings, r["sample"]) for r in rows} == {"padded": (1, " a"), "none": (0, "")}


def expressions():
    return [
        (X.host_of(F.lit("https://www.A.b.Example.com/x")), "example.com"), (X.host_of(F.lit("raw.code.org/y")), "code.org"), (X.host_of(F.lit("localhost")), "localhost"),
        (X.read_size(F.lit("Qwen3 30B-A3B")), 30.0), (X.read_size(F.lit("Llama 4 Scout 17B 16E")), 17.0), (X.read_size(F.lit("mix 1.5b and 70 B")), 70.0), (X.read_size(F.lit("k2b5 turbo")), None), (X.read_size(F.lit("8x7b")), None),
        (X.size_band(F.lit(3.0)), "xs"), (X.size_band(F.lit(2.9)), "nano"), (X.size_band(F.lit(1e4)), "frontier"), (F.round(X.fits_billions(F.lit(16.0)), 4), 15.6923), (X.fits_billions(F.lit(1.0)), 0.0), (X.memory_gb(F.lit(10.0)), 7.5),
        (X.licence_family(F.lit("mit")), "open"), (X.licence_family(F.lit("CC-BY-NC-4.0")), "noncommercial"), (X.licence_family(F.lit("llama3")), "open-with-conditions"), (X.licence_family(F.lit("proprietary")), "proprietary"), (X.licence_family(F.lit(None).cast("string")), None),
        (X.lower_is_better(F.lit("Hallucination Rate")), True), (X.lower_is_better(F.lit("time")), False),
        (X.lane_family(F.lit("google-vertex/global")), "regional"), (X.lane_family(F.lit("bedrock eu-west-3")), "regional"), (X.lane_family(F.lit("Batch/us")), "batch"), (X.lane_family(F.lit("turbo")), "separately routed"), (X.lane_family(F.lit("priority")), "faster"),
        (X.parse_price(F.lit("Team plan is $30 / mo")), ("month", 30_000_000)), (X.parse_price(F.lit("$0.25 per 1M tokens")), ("mtok_in", 250_000)), (X.parse_price(F.lit("Enterprise from $18,000 per year")), None), (X.parse_price(F.lit("$1/1k req")), ("call", 1_000)),
        (X.parse_price(F.lit("+$184K / mo")), ("month", 184_000_000_000)), (X.parse_price(F.lit("¥12 per thousand tokens")), None), (X.parse_price(F.lit("Contact sales for pricing")), None),
        (X.parse_standing(F.lit("1 of 105 on Vectara Hallucination Leaderboard — Hallucination Rate 1.8 %")), (1, 105, "Vectara Hallucination Leaderboard", "Hallucination Rate", 1.8)), (X.parse_standing(F.lit("ranked #3 of 120 on Some Board")), None),
        (X.fact_date(F.lit("1700000000")).cast("string"), "2023-11-14"), (X.norm(F.lit("Command R+")), "commandrplus"), (X.days_between(F.lit("2024-03-01").cast("date"), F.lit("2024-02-01").cast("date")), 0),
        (X.authority(F.lit("https://docs.fireworks.ai/p"), F.lit("https://fireworks.ai")), 2), (X.authority(F.lit("https://x.com"), F.lit("")), 0),
        (X.normalise_kind(F.lit("Synthesized speech audio; the API curl example writes a WAV file")), "audio"), (X.normalise_kind(F.lit("text+images")), "text + image"), (X.normalise_kind(F.lit("Files, vector")), "file + embedding"), (X.normalise_kind(F.lit("smell")), "smell"), (X.normalise_kind(F.lit("x" * 50)), "text"), (X.normalise_kind(F.lit(None).cast("string")), ""),
        (X.kinds_of(F.array(F.lit("text"), F.lit("image")), F.array(F.lit("text")), F.lit("x"))[0], "text + image"), (X.kinds_of(F.lit(None).cast("array<string>"), F.array(F.lit("text")), F.lit("text-to-speech"))[1], "audio"), (X.kinds_of(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"))[0], "text"),
        (X.display_name(F.lit("accounts/fireworks/models/gpt-oss-120b")), "GPT OSS 120B"), (X.display_name(F.lit("accounts/fireworks/models/kimi-k2p6")), "Kimi K2.6"), (X.display_name(F.lit("deepseek/deepseek-v4-flash")), "DeepSeek V4 Flash"), (X.display_name(F.lit("nvidia/nemotron-nvfp4")), "Nemotron NVFP4"), (X.display_name(F.lit("anthropic/claude-opus-5")), "Claude Opus 5"),
        (X.provider_label(F.lit("openrouter/deepseek/deepseek-v4")), "OpenRouter"), (X.provider_label(F.lit("x/y, accounts/fireworks/models/x (stream)")), "Fireworks"), (X.provider_label(F.lit("")), None),
        (X.money(F.lit(250_000)), "$0.25"), (X.money(F.lit(0)), "$0"), (X.money(F.lit(123_456_789)), "$123"), (X.money(F.lit(2_500_000)), "$2.5"), (X.money(F.lit(1_234)), "$0.0012"), (X.grouped(F.lit(13401)), "13,401"), (X.ordinal(F.lit(11)), "11th"), (X.ordinal(F.lit(102)), "102nd"),
        (F.array_join(X.extract_identifiers(F.lit("Mail Bob@X.org, v2.1! and (A4) word")), "|"), "a4|bob@x.org|v2.1"), (X.address_slug(F.lit("R+ & D 2.0")), "r-plus-and-d-2-0"), (names.swap_version(F.lit("Claude 4.1 Opus")), "Claude Opus 4.1"),
    ]


def test_expressions(spark):
    """Values of the rules' own examples."""
    found = expressions()
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(found))).first()
    plain_row = [tuple(v) if isinstance(v, tuple) else v for v in row]
    assert plain_row == [want for _, want in found]


def test_names():
    assert [names.lanes_off(n)[0] for n in ("openai-gpt-5-6-luna-max-2026-07-30", "claude-opus-4-5-20251101-thinking-32k", "claude-opus-4-6_120K", "Kimi K2.5 Thinking", "gpt-5-high")] == ["openai-gpt-5-6-luna", "claude-opus-4-5-thinking", "claude-opus-4-6", "Kimi K2.5 Thinking", "gpt-5"]
    assert names.lanes_off("gpt-5-high")[1] == "high"
    whole = names.forms_of("ERNIE-5.0-high")
    assert whole.index("ernie50high") < whole.index("ernie50")
    assert "ernie50thinking" in names.forms_of("ERNIE-5.0-Thinking") and "ernie50" not in names.forms_of("ERNIE-5.0-Thinking")
    assert "nova2pro" in names.forms_of("us.amazon.nova-2-pro-preview-20251202-v1:0") and "claudeopus41" in names.forms_of("Claude 4.1 Opus") and "imagen4ultra" in names.forms_of("Imagen 4.0 Ultra")
    assert "imagen4ultra" in names.index_forms_of("Imagen 4.0 Ultra") and names.index_forms_of("Qwen3 Max Thinking") == ["qwen3maxthinking"] and "large" not in names.index_forms_of("Mistral Large")
    assert "extract" not in names.forms_of("acme/extract") and names.forms_of(None) == names.index_forms_of("") == []
    assert [names.served_off(n) for n in ("Qwen: QvQ Max", "Gemma 4 26B (DeepInfra)", "DeepSeek R1 Fast", "org/model-7b-fp8", "GLM 4.5 (20250728)", None)] == ["QvQ Max", "Gemma 4 26B", "DeepSeek R1", "model-7b", "GLM 4.5", ""]


def test_resolve_fails_closed(spark):
    entities = spark.createDataFrame([("a", "Claude Opus 4.1"), ("b", "Nova 2 Pro"), ("c", "Twin"), ("d", "TWIN"), ("e", "Nova 2 Pro Preview")], "id string, name string")
    index = joins.build_key_index(entities, spark.createDataFrame([("f", "vendor/nova", "b")], "source string, alias string, entity_id string"))
    rows = spark.createDataFrame([("Claude 4.1 Opus",), ("us.amazon.nova-2-pro-preview-20251202-v1:0",), ("twin",), ("nobody",), ("Vendor/Nova",), (None,)], "name string")
    assert {r.name: r.entity_id for r in joins.resolve(rows, index).collect()} == {"Claude 4.1 Opus": "a", "us.amazon.nova-2-pro-preview-20251202-v1:0": "b", "twin": None, "nobody": None, "Vendor/Nova": "b", None: None}
    aliases = spark.createDataFrame([("f", "openai/Nova 2 Pro", "a"), ("f", "Claude Opus 4.1", "b"), ("f", "Nova-2-Pro-Preview", "b")], "source string, alias string, entity_id string")
    assert sorted(tuple(r) for r in joins.rehome_aliases(entities, aliases).collect()) == [("f", "Claude Opus 4.1", "b", "a"), ("f", "Nova-2-Pro-Preview", "b", "e")]
    assert [tuple(r) for r in joins.misfiled_aliases(entities, aliases).collect()] == [("Nova-2-Pro-Preview", "b", "e")]


def test_funds_fold_into_the_most_invested(spark):
    funds = spark.createDataFrame([("1", "Sequoia"), ("2", "Sequoia Capital"), ("3", "Sequoia Heritage"), ("4", "Index Ventures")], "id string, name string")
    bets = spark.createDataFrame([("2", "x"), ("2", "y"), ("1", "x")], "fund_id string, company_id string")
    assert [tuple(r) for r in joins.fold_funds(funds, bets).collect()] == [("1", "2")]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", None)], "k string, v long")
    assert [(r.k, r.median) for r in boards.upper_median(df, ["k"], "v").collect()] == [("a", 3)]
