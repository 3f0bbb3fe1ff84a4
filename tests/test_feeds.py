"""Feeds as sellers and boards print them, on bodies that show each rule."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marketweave.operators import maintenance
from marketweave.sources import price_files, rate_cards, scores


def body(spark, value):
    return spark.createDataFrame([(value if isinstance(value, str) or value is None else json.dumps(value),) for value in (value, None, "{")], "body string")


def rates(rows):
    return {(r.alias, r.variant, r.dimension): r.micros for r in rows.collect()}


CARDS = {
    "openrouter_endpoints": (
        {"data": {"id": "a/b", "name": "B", "endpoints": [{"tag": "Up/FP8", "pricing": {"prompt": "0.0000005", "completion": "0"}}, {"status": -1, "tag": "down", "pricing": {"prompt": "1"}}, {"provider_name": "Other", "pricing": {"completion": "0.000001"}}, {"pricing": {"prompt": "1"}}, {"tag": "free", "pricing": {"prompt": "0"}}]}},
        {("a/b", "up/fp8", "mtok_in"): 500_000, ("a/b", "other", "mtok_out"): 1_000_000},
    ),
    "deepinfra": (
        [{"model_name": "t", "pricing": {"type": "tokens", "cents_per_input_token": 0.00001, "cents_per_output_token": 0.00002, "cents_per_sec": 9}}, {"model_name": "e", "pricing": {"type": "input_tokens", "cents_per_input_token": 0.000001, "cents_per_output_token": 5}}, {"model_name": "i", "pricing": {"type": "image_units", "cents_per_image_unit": 2}}, {"model_name": "s", "pricing": {"type": "time", "cents_per_sec": 0.5}}, {"model_name": "old", "deprecated": "1", "pricing": {"type": "time", "cents_per_sec": 1}}],
        {("t", "", "mtok_in"): 100_000, ("t", "", "mtok_out"): 200_000, ("e", "", "mtok_in"): 10_000, ("i", "", "image"): 20_000, ("s", "", "second"): 5_000},
    ),
    "sambanova": ({"data": [{"id": "m", "pricing": {"prompt": "0.0000001", "completion": "x"}}]}, {("m", "", "mtok_in"): 100_000}),
    "vercel": ({"data": [{"id": "m", "pricing": {"input": "0.0000001", "input_cache_write": "0.000002"}}]}, {("m", "", "mtok_in"): 100_000, ("m", "", "mtok_cache_write"): 2_000_000}),
    "nebius": ([{"name": "N", "flavors": [{"model_id": "m", "label": "cheap", "input_price_per_million_tokens": 0.1}, {"model_id": "m", "label": "fast", "output_price_per_million_tokens": 2}]}, {"status": "inactive", "flavors": [{"model_id": "z", "input_price_per_million_tokens": 1}]}], {("m", "", "mtok_in"): 100_000, ("m", "fast", "mtok_out"): 2_000_000}),
    "huggingface": ({"data": [{"id": "m", "providers": [{"provider": "p", "status": "live", "pricing": {"input": 0.5, "output": 1}}, {"provider": "q", "status": "error", "pricing": {"input": 1}}]}]}, {("m", "p", "mtok_in"): 500_000, ("m", "p", "mtok_out"): 1_000_000}),
    "electronhub": ({"data": [{"id": "a/b", "pricing": {"input": 1.5, "output": "3"}}, {"id": "c/d", "pricing": {"input": 0, "output": None}}, {"id": "e/f"}]}, {("a/b", "", "mtok_in"): 1_500_000, ("a/b", "", "mtok_out"): 3_000_000}),
    "inference-net": ({"data": [{"id": "x", "pricing": {"prompt": "0.0000015"}}]}, {("x", "", "mtok_in"): 1_500_000}),
    "ppinfra": ({"data": [{"id": "m", "pricing": {"prompt": {"price_per_m": 200000, "price_per_m_decimal": "0.2"}, "completion": {"price_per_m_decimal": "0.8"}}}]}, {("m", "", "mtok_in"): 200_000, ("m", "", "mtok_out"): 800_000}),
}


@pytest.mark.parametrize("card", sorted(CARDS))
def test_cards(spark, card):
    printed, want = CARDS[card]
    assert rates(rate_cards.unpivot(rate_cards.flatten_rate_card(body(spark, printed), rate_cards.CARDS[card]))) == want


def test_free_by_name_and_price(spark):
    models = [{"id": "a:free", "pricing": {"prompt": "0", "completion": "0"}, "expiration_date": "2026-01-01"}, {"id": "b:free", "pricing": {"prompt": "0", "completion": "1"}}, {"id": "c", "pricing": {"prompt": "0", "completion": "0"}}, {"id": "d:free"}]
    assert [tuple(r) for r in rate_cards.free_feed(body(spark, {"data": models})).collect()] == [("a:free", "a:free", "2026-01-01")]


def test_offer_file(spark):
    product = lambda feature, kind: {"attributes": {"feature": feature, "model": "Claude 3 Haiku", "provider": "Anthropic", "inferenceType": kind}}
    term = lambda sku, unit, usd: {f"{sku}.X": {"priceDimensions": {"a": {"unit": unit, "pricePerUnit": {"USD": usd}}}}}
    offer = {
        "products": {"S1": product("On-demand Inference", "Input tokens"), "S2": product("On-demand Inference", "Output tokens"), "S3": product("Batch Inference", "input tokens batch"), "S4": product("On-demand Inference", "Input tokens priority"), "S5": product("Provisioned Throughput Inference - 1 month", "Input tokens")},
        "terms": {"OnDemand": {"S1": term("S1", "1K tokens", "0.00025"), "S2": term("S2", "1K tokens", "0.00125"), "S3": term("S3", "1M tokens", "0.125"), "S4": term("S4", "1K tokens", "0.001"), "S5": term("S5", "1K tokens", "9.0")}},
    }
    assert rates(price_files.flatten_offer_file(body(spark, offer))) == {("Claude 3 Haiku", "in-region", "mtok_in"): 250_000, ("Claude 3 Haiku", "in-region", "mtok_out"): 1_250_000, ("Claude 3 Haiku", "in-region batch", "mtok_in"): 125_000}


METERS = [
    ("gpt 4.1 Inp glbl", 0.002, "1K", ("gpt 4.1", "", "mtok_in"), 2_000_000), ("gpt 4.1 cached Inp glbl", 0.0005, "1K", ("gpt 4.1", "", "mtok_cache_read"), 500_000), ("5.4 nano Batch cd Inp Gl 1M Tokens", 0.01, "1M", ("5.4 nano", "batch", "mtok_cache_read"), 10_000),
    ("gpt 4.1 Inp regnl", 0.0022, "1K", None, None), ("gpt 4o 0513 Input Data Zone", 0.0055, "1K", None, None), ("Code-Interpreter-global Session", 0.03, "1", None, None),
    ("gpt aud 0828 Inp glbl", 0.04, "1K", ("gpt aud 0828", "", "mtok_in_audio"), 40_000_000), ("gpt aud 0828 txt Outp glbl", 0.01, "1K", ("gpt aud 0828", "", "mtok_out"), 10_000_000), ("gpt4o realtime cached audio inp glbl", 0.02, "1K", ("gpt4o realtime", "", "mtok_cache_read_audio"), 20_000_000),
    ("Image 2 img Inp glbl", 0.008, "1K", ("Image 2", "", "mtok_in_image"), 8_000_000), ("Image 2 txt Inp glbl", 0.005, "1K", ("Image 2", "", "mtok_in"), 5_000_000), ("gpt img 1.5 out img gl", 32.0, "1M", ("gpt img 1.5", "", "mtok_out_image"), 32_000_000), ("gpt img 1.5 in cd txt gl", 1.25, "1M", ("gpt img 1.5", "", "mtok_cache_read"), 1_250_000),
    ("gpt rt aud mini Inp glbl", 0.02, "1K", ("gpt rt mini", "", "mtok_in_audio"), 20_000_000), ("gpt rt txt mini Inp glbl", 0.001, "1K", ("gpt rt mini", "", "mtok_in"), 1_000_000), ("gpt rt img mini Inp glbl", 0.003, "1K", ("gpt rt mini", "", "mtok_in_image"), 3_000_000),
    ("gpt-4o-aud-0603-txt Inp glbl", 0.005, "1K", ("gpt-4o-aud-0603", "", "mtok_in"), 5_000_000), ("gpt-4o-aud-0603 Inp glbl", 0.1, "1K", ("gpt-4o-aud-0603", "", "mtok_in_audio"), 100_000_000),
    ("5.6 sol ShortCo Std Inp glbl", 4.0, "1M", ("5.6 sol", "", "mtok_in"), 4_000_000), ("5.6 sol LongCo Std Inp glbl", 8.0, "1M", ("5.6 sol", "long-context", "mtok_in"), 8_000_000), ("5.6 sol ShortCo PP Inp glbl", 6.0, "1M", ("5.6 sol", "priority", "mtok_in"), 6_000_000),
]


def test_meters(spark):
    rows = spark.createDataFrame([m[:3] for m in METERS], "skuName string, retailPrice double, unitOfMeasure string")
    assert rates(price_files.classify_meters(rows)) == {m[3]: m[4] for m in METERS if m[3]}


def test_price_files(spark):
    listed = {"sample_spec": {"litellm_provider": "p", "input_cost_per_token": 1}, "p/m": {"litellm_provider": "p", "mode": "chat", "input_cost_per_token": 1e-6, "output_cost_per_token_batches": 2e-6, "output_cost_per_second": 1, "output_cost_per_image": 0}, "p/1-month-commitment/m": {"litellm_provider": "p", "input_cost_per_token": 1}, "v": {"litellm_provider": "q", "mode": "video_generation", "output_cost_per_second": 0.5}}
    rows = price_files.flatten_price_file(body(spark, listed))
    assert {(r.name, r.seller_key, r.lane, r.dimension): r.micros for r in rows.collect()} == {("m", "p", "", "mtok_in"): 1_000_000, ("m", "p", "batch", "mtok_out"): 2_000_000, ("v", "q", "", "second_out"): 500_000}
    models = {"p": {"models": {"m": {"name": "M", "cost": {"input": 1.5, "output": 0}}, "n": {"cost": {"cache_read": 0.1}}}}}
    assert {(r.seller_key, r.name, r.dimension): r.micros for r in price_files.flatten_provider_models(body(spark, models)).collect()} == {("p", "M", "mtok_in"): 1_500_000, ("p", "n", "mtok_cache_read"): 100_000}
    facts = {"p": {"models": {"m": {"name": "M", "release_date": "2025-01-02", "reasoning": True, "limit": {"context": 8192}, "knowledge": ""}}}}
    assert {(r.name, r.fact): r.value for r in price_files.facts_feed(body(spark, facts)).collect()} == {("M", "released"): "2025-01-02", ("M", "reasoning"): "true", ("M", "context"): "8192"}


def test_names_and_numbers_in_cells(spark):
    cells = ["claude-fable-5 Anthropic · Proprietary", "Fable 5 [high] Model", "Junie Agent"]
    got = spark.range(1).select(*(scores.clean_name(F.lit(c)).alias(f"c{i}") for i, c in enumerate(cells))).first()
    assert list(got) == ["claude-fable-5", "Fable 5 (high)", "Junie"]
    row = "<tr><td>{}</td><td>x</td><td>{}</td></tr>"
    page = "<table><tr><td>small</td></tr></table><table><tr><td>t</td></tr><tr><th>model</th><th>x</th><th>Best <i>Score</i></th></tr>" + "".join(row.format(n, v) for n, v in [("A", "1508 ±5"), ("B", "$1.80"), ("C", "1,234.5"), ("D", "—"), ("", "1"), *((f"n{i}", i) for i in range(6))]) + "</table>"
    pages = spark.createDataFrame([("u", page), ("few", page.replace("n", "")[:200]), ("none", None)], "url string, html string")
    found = {r.name: r.value for r in scores.extract_html_table(pages, "Model", "score").collect()}
    assert found == {"A": 1508.0, "B": 1.8, "C": 1234.5, **{f"n{i}": float(i) for i in range(6)}}


def test_boards(spark):
    arc = [{"datasetId": "v1_Semi_Private", "score": 0.12345, "displayLabel": "m (High)", "modelId": "x"}, {"datasetId": "v1_Semi_Private", "score": 0.5, "displayLabel": " ", "modelId": "gpt-5-low"}, {"datasetId": "other", "score": 1, "modelId": "z"}, {"datasetId": "v2_Public_Eval", "modelId": "z"}]
    assert [tuple(r) for r in scores.dataset_board(body(spark, arc)).orderBy("ord").collect()] == [("arc_agi_1", "v1_Semi_Private", "Score (%) (high)", "m (High)", 12.35, 0), ("arc_agi_1", "v1_Semi_Private", "Score (%) (low)", "gpt-5-low", 50.0, 1)]
    rated = {"rows": [{"name": "a", "elo": 1500}, {"name": "b", "elo": 1, "suspended": True}, {"name": "c"}]}
    assert [(r.name, r.value) for r in scores.elo_board(body(spark, rated), "s", "S").collect()] == [("a", 1500.0)]
    feed = {"data": [{"id": "m", "benchmarks": {"artificial_analysis": {"coding_index": 40}, "design_arena": [{"elo": 1200, "category": "UI Design", "arena": "Models"}, {"elo": 1, "category": ""}, {"category": "x"}]}}]}
    assert sorted((r.suite, r.board, r.value) for r in scores.riding_boards(body(spark, feed)).collect()) == [("aa_coding_index", "aa_coding_index", 40.0), ("design_arena_ui_design", "UI Design (Models)", 1200.0)]
    csv = "Model,Score\n" + "\n".join(f"m{i}-high,0.{i}" for i in range(1, 9)) + "\nbad,x\n"
    files = spark.createDataFrame([("d/one_two_external.csv", csv), ("few.csv", "Model,Score\na,1\n"), ("none.csv", "a,b\n" * 9)], "path string, body string")
    got = scores.read_score_csvs(files, "epoch_").orderBy("ord").collect()
    assert len(got) == 8 and (got[0].suite, got[0].metric, got[0].name, got[0].value) == ("epoch_one_two", "Score (high)", "m1-high", 10.0)


def test_applying_listings_twice_writes_nothing_more(spark):
    aliases = spark.createDataFrame([("s", "m", "M"), ("s", "n", "N")], "source string, alias string, entity_id string")
    listings = spark.createDataFrame([("m", "", "mtok_in", 5, 0), ("m", "", "mtok_in", 6, 1), ("m:batch", "", "mtok_in", 2, 2), ("lost", "", "mtok_in", 1, 3)], "alias string, variant string, dimension string, micros long, ord long")
    offerings = spark.createDataFrame([], "entity_id string, provider_id string, way string, variant string, first_seen date, last_seen date")
    prices = spark.createDataFrame([], "entity_id string, provider_id string, way string, variant string, dimension string, micros long, taken_at date")
    queue = spark.createDataFrame([("s", "gone"), ("s", "n"), ("t", "kept")], "source string, alias string")
    once = maintenance.apply_listings(listings, aliases, offerings, prices, queue, "s", "api", "2026-01-01")
    assert once["counters"].first() == (3, 2, 1, 2)
    assert sorted((r.entity_id, r.variant, r.micros) for r in once["prices"].collect()) == [("M", "", 5), ("M", "batch", 2)]
    assert sorted(map(tuple, once["queue"].collect())) == [("s", "lost"), ("t", "kept")]
    twice = maintenance.apply_listings(listings, aliases, once["offerings"], prices.unionByName(once["prices"]), once["queue"], "s", "api", "2026-01-02")
    assert twice["prices"].count() == 0 and {str(r.first_seen) for r in twice["offerings"].collect()} == {"2026-01-01"}
    silent = maintenance.apply_listings(listings.where("false"), aliases, offerings, prices, queue, "s", "api", "2026-01-02")
    assert silent["queue"].count() == 3
