"""What articles say, on the rules' own examples, and deliveries of findings."""

from __future__ import annotations

import json
import random
import tracemalloc

import pandas as pd
from pyspark.sql import functions as F

from marketweave.operators import joins, prose, quality
from marketweave.sources import catalogue
from marketweave.streaming import findings

ROUNDS = {
    "The company raised $110,000,000 in a funding round.": 110e6, "OpenAI raised $110 billion in a funding round at a $730 billion valuation.": 110e9, "The company was valued at $14 billion in a funding round.": 0,
    "The company raised new funding at a $35 billion valuation.": 0, "The startup plans to raise $500 million in a new round.": 0, "It is in talks to raise $2 billion in funding.": 0,
    "Mistral raised €600 million in a Series B round.": 0, "Mistral raised €600 million ($645 million) in a Series B round.": 645e6, "It raised $50 in seed funding.": 0,
}


MORE_ROUNDS = {
    "Acme secured US$2.5bn in financing, having seen talk of a contract worth $9 billion.": 2.5e9, "Acme will close a seed round of $3 million.": None, "Twill closed a seed round of $3 million.": 3e6, "Revenue of $7 million came before it raised $3 million in a round.": None,
    "It raised £5 million and then $8 million in a round.": 8e6, "It raised £5 million (about 6) and later on, after a very long while indeed, $8 million in a round.": 8e6, "It completed a Series C round worth $40 million.": None, "The round closed at a valuation of $3 billion, with $500 million raised.": None,
    "It raised $500 million in a round at a valuation of $3B.": 500e6, "It raised $1,250,000 in seed funding" + " x" * 300: None, "Nothing was raised in the round.": None, "Società raised $4 m in a round.": 4e6,
}


def test_rounds_and_investors(spark):
    want = {**{s: v or None for s, v in ROUNDS.items()}, **MORE_ROUNDS}
    rows = spark.createDataFrame([(s,) for s in want], "s string").select("s", prose.round_amount(F.col("s")).alias("amount")).collect()
    assert {r.s: r.amount for r in rows} == want
    named = {
        "The round was led by Bessemer Venture Partners and General Catalyst, with participation from Index Ventures.": ["Bessemer Venture Partners", "General Catalyst", "Index Ventures"],
        "In 2023, Microsoft announced an additional $10 billion investment in OpenAI.": ["Microsoft"],
        "Backed by Amazon ($50 billion), SoftBank ($30 billion) and others; led by nobody. Funded by Sequoia": ["Amazon", "SoftBank", "Sequoia"],
        "It was led by the Founders Fund, joined by Crédit Capital & Seed Partners at a price, Accel.": ["Crédit Capital"],
        "Existing Investors led a round.": [], "": [],
    }
    rows = spark.createDataFrame([(s,) for s in named], "s string").select("s", prose.named_investors(F.col("s")).alias("funds")).collect()
    assert {r.s: r.funds for r in rows} == named


def test_company_rounds(spark):
    ai = "Acme is an artificial intelligence company. "
    rows = [("Acme (company)", ai + "It raised $20 million in a seed round. It raised $20 million in a seed round led by Spark Capital."), ("Acme", ai + "In May it secured $5,000,000 in funding."), ("Acme Five", ai + "It raised $9 million in a round."), ("Other", "A mountain. It raised $7 million in a round."), ("Acme", None)]
    articles = spark.createDataFrame(rows, "title string, text string")
    companies = spark.createDataFrame([("a", "Acme Inc"), ("o", "Other")], "id string, name string")
    assert [tuple(r) for r in prose.company_rounds(articles, companies).collect()] == [("a", 25_000_000, 2)]
    edges = prose.investment_edges(articles.select(F.col("title").alias("id"), "text"))
    assert [tuple(r) for r in edges.collect()] == [("Spark Capital", "Acme (company)")]


def fnv(feature):
    h = 0xCBF29CE484222325
    for b in feature.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h % prose.DIMENSIONS


def test_embeddings(spark):
    texts = ["what is the refund policy", "What is the refund POLICY?", "", "Betriebstemperatur", "Temperatur", "mountain range", "über über__x über", "a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, said string")
    got = {r.id: r.embedding for r in prose.embed(rows, "said").collect()}
    assert got[0] == got[1] and got[2] == got[8] == [0.0] * prose.DIMENSIONS
    near = lambda a, b: sum(p * q for p, q in zip(got[a], got[b], strict=True))
    assert near(3, 4) > 0.3 > near(0, 5) and all(abs(near(i, i) - 1) < 1e-6 for i in (0, 3, 6, 7))
    want = [0.0] * prose.DIMENSIONS
    for feature, weight in [("über", 6), ("x", 2), ("übe", 3), ("ber", 3), ("über über", 2), ("über x", 2), ("x über", 2)]:
        want[fnv(feature)] += weight
    size = sum(x * x for x in want) ** 0.5
    assert all(abs(x / size - y) < 1e-6 for x, y in zip(want, got[6], strict=True))


def test_embedding_memory(monkeypatch):
    """The memory of a batch goes with a slice of its texts, not with all of them."""
    monkeypatch.setattr(prose, "SLICE", 20_000, raising=False)
    draw = random.Random(1)
    texts = pd.Series([" ".join("".join(draw.choices("abcdefghij", k=9)) for _ in range(200)) for _ in range(300)])
    tracemalloc.start()
    whole = prose._embedded(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6 and len(whole) == 300
    assert all((whole[i] == prose._embedded(texts[i : i + 1]).iloc[0]).all() for i in (0, 9, 10, 299))


def test_rounds_are_read_once(spark):
    """The pattern of raised money is in the plan once, and so is the split of an article."""
    rows = spark.createDataFrame([("a", "It raised $2 million in a round. It raised $900,000 in a seed round. It raised £1 million ($1.2 million) in a round.")], "id string, text string")
    found = prose.funding_rounds(rows)
    assert {(r.amount, r.sentence[:12]) for r in found.collect()} == {(2_000_000, "It raised $2"), (900_000, "It raised $9"), (1_200_000, "It raised £1")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?!in talks)") == 1 and plan.count("split(") == 1


def test_pages(spark):
    rows = [("https://a.com/x", "<title> A\n b </title><meta name='description' content='A long enough description of it.'><a href=\"/y\"><a href=\"/gone\">"), ("https://a.com/y", "<title></title><meta name='description' content='Home page'>"), ("https://a.com/z", '<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{a</script>'), ("q", None)]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert [tuple(r) for r in prose.page_meta(pages).collect()] == [("https://a.com/x", "A b", "A long enough description of it.")]
    assert [(r.target, r.pages) for r in quality.dead_links(pages).collect()] == [("/gone", 1)]
    assert [r.url for r in quality.broken_data(pages).collect()] == ["https://a.com/z"]
    page = '<title>t</title><link rel="canonical" href="https://a.com{}"><h1>h</h1>&lt;span x'
    shown = spark.createDataFrame([("https://a.com/x?q", page.format("/x")), ("https://a.com/y", page.format("/x"))], "url string, html string")
    rules = {(r.url[-3:], r.rule) for r in quality.audit_pages(shown).collect()}
    assert rules == {("x?q", "no description"), ("m/y", "no description"), ("x?q", "escaped markup"), ("m/y", "escaped markup"), ("m/y", "canonical address of another page")}
    listed = spark.createDataFrame([("/x",), ("/y",), ("/w",)], "path string")
    assert sorted(map(tuple, quality.unlisted_pages(pages, listed).collect())) == [("linked, not listed", "/gone"), ("listed, no page", "/w")]


def test_findings(spark):
    line = lambda **d: json.dumps({"source": "u", **d})
    first = "\n".join([line(what="price", name="Nova 2", says="$1 per 1M tokens", seller="Shop", read_at="2026-01-05"), line(what="price", name="nova-2", says="call us", seller="Shop"), "{broken", line(what="standing", name="Nova 2", says="1 of 9 on B — M 2 %"), line(what="standing", name="Nova 2", says="first"), line(what="mention", name="New", maker="shop"), line(what="mention", name="Nova 2", maker="Shop"), line(what="mention", name="New", maker="who"), line(what="event", name="nobody"), line(what="watch", name="Nova 2", says="x"), line(what="price", says="$1 per call")])
    files = spark.createDataFrame([("a.jsonl", first.encode()), ("b.jsonl", b"")], "file string, content binary")
    ledger = spark.createDataFrame([], "file string, hash string")
    new = findings.unseen_files(files, ledger)
    index = joins.build_key_index(spark.createDataFrame([("e", "Nova 2")], "id string, name string"))
    routed = findings.route_findings(findings.read_findings(new), index, spark.createDataFrame([("p", "Shop")], "id string, name string"))
    written = {}
    counts = {r.goes_to: r.n for r in findings.deliver(lambda name, df: written.update({name: df.collect()}), routed, new).collect()}
    assert counts == {"prices": 1, "evidence": 2, "standings": 1, "candidates": 1, "already_held": 1, "dropped": 4} and list(written)[-1] == "ledger"
    assert {str(r.taken_at) for r in routed.collect()} == {"2026-01-05"}
    seen = spark.createDataFrame(written["ledger"])
    assert findings.unseen_files(files, seen).count() == 0
    assert findings.unseen_files(files.where("file = 'a.jsonl'").withColumn("content", F.lit(b"{}")), seen).count() == 1
    beat = findings.heartbeat(spark.createDataFrame([("s",), ("s",)], "source string"), spark.createDataFrame([("s",), ("t",)], "source string"))
    assert sorted(map(tuple, beat.collect())) == [("s", 2, False), ("t", 0, True)]


def test_stored_catalogue(spark, tmp_path):
    spark.createDataFrame([("b", "tool", "B"), ("a", "tool", "A"), ("c", "model", "C")], "id string, register string, name string").write.parquet(str(tmp_path / "entities"))
    t = catalogue.read_catalogue(spark, str(tmp_path))
    assert [r.id for r in t.of_register("tool").collect()] == ["a", "b"] and t.entities.first().attrs is None
    assert len(catalogue.SCHEMAS) == 16
