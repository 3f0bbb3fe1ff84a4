"""What must not grow faster than the input: plans of queries over the shared tables, and that their results stay."""

from __future__ import annotations

import json
from types import SimpleNamespace

from marketweave.operators import checks, market
from marketweave.plans import catalogue
from marketweave.sources import rate_cards
from tests.test_feeds import CARDS

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rates_are_worked_out_once(spark):
    """A card's rates as unpivot gives them, on bodies that are whole, null, broken or of another shape, and without a lambda in the plan."""
    for card, (printed, _) in CARDS.items():
        bodies = spark.createDataFrame([(b,) for b in (printed if isinstance(printed, str) else json.dumps(printed), None, "{", "[]", '{"data": null}', '{"data": [{"id": null}, {"id": 7}]}')], "body string")
        rows = rate_cards.listed_rates(bodies, rate_cards.CARDS[card])
        want = rate_cards.unpivot(rate_cards.flatten_rate_card(bodies, rate_cards.CARDS[card]))
        assert rows.columns == want.columns and sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect())) != []
    assert "lambdafunction" not in plan_of(catalogue.QUERIES["seller_cards"](spark, SF))


def read_from(plan: str, table: str) -> int:
    return plan.count(f"/{table}.parquet")


def test_pool_of_families_is_made_once(spark):
    """The picks read the pool of cheap placed models from where it was written, not prices again for each use of it."""
    assert read_from(plan_of(catalogue.QUERIES["family_averages"](spark, SF)), "lineitem") == 0


def test_checks_meet_prices_once(spark):
    """Prices and offerings are read once, into the written table of offers, and none of the rules goes back to them."""
    assert read_from(plan_of(catalogue.QUERIES["run_checks"](spark, SF)), "lineitem") == 0


def test_rules_of_offers(spark):
    """Noughts and prices without an offering count row by row, sources by their newest figures, and things that are gone have no names."""
    t = checks.Settled(SimpleNamespace(
        offerings=spark.createDataFrame([(1, "e1", "s1", "api", ""), (2, "e1", "s1", "api", ""), (3, "gone", "s1", "api", ""), (4, "e1", "gone", "api", "")], "id long, entity_id string, provider_id string, way string, variant string").selectExpr("*", "'live' as status", "'' as allowance", "date'2024-01-01' as last_seen"),
        entities=spark.createDataFrame([("e1", "E", "s1")], "id string, name string, maker string"), providers=spark.createDataFrame([("s1", "S", "vendor")], "id string, name string, kind string"),
        prices=spark.createDataFrame([(1, 1, "x", 0, "a"), (2, 1, "x", 0, "a"), (3, 1, "x", 5, "b"), (4, 2, "x", 5, "b"), (5, 2, "x", 0, "a"), (6, 3, "x", 0, "a"), (7, 9, "x", 1, "a"), (8, 9, "x", 1, "a"), (9, 4, "x", 0, "a"), (10, 4, "y", 7, "a")], "seq long, offering_id long, dimension string, micros long, source_url string").selectExpr("*", "date_add(date'2024-01-01', if(seq = 10, 90, int(seq))) as taken_at"),
        benchmarks=spark.createDataFrame([], "entity_id string"), aliases=spark.createDataFrame([], "entity_id string"),
    ))
    found = lambda name: sorted((r.a, r.b) for r in checks.RULES[name][0](t).collect())
    assert found("a price of nought") == [("E at S", "x")] * 3
    assert found("a free price outside the free lane") == [("E", "x")] * 4
    assert found("two sources, two prices for the same thing") == [("E at S x", "0.0 against 0.0")] * 2
    assert found("one lane written twice at one price") == [("e1 at s1", "1")]
    assert found("a figure nobody has re-read in a while") == [("E", "2024-01-04"), ("E", "2024-01-06")]
    assert found("a row pointing at nothing") == [("offering with no entity", "gone"), ("offering with no provider", "gone"), ("price with no offering", "9"), ("price with no offering", "9")]


def test_list_index_groups_prices_in_place(spark, monkeypatch):
    """What was heard of an offering is read once: it is not written to be joined with sums of itself."""
    kept, real = [], market.written
    monkeypatch.setattr(market, "written", lambda df, name: kept.append(name) or real(df, name))
    plan = plan_of(catalogue.QUERIES["list_index"](spark, SF))
    assert kept == [] and read_from(plan, "lineitem") == 1
