"""Feeds, ledgers and composites on small tables, with what each does to rows that are there already."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from marketweave.functions import ordered
from marketweave.functions.patch import merge_patch
from marketweave.operators import entries, facts, joins, maintenance, passages, prose, quality, tags, upkeep
from marketweave.plans import entering
from marketweave.plans.lens import Catalogue
from marketweave.sources import scores

#: Target, patch and result, as the merge patch's own standard prints them.
PATCHES = [
    ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":"b","b":"c"}', '{"a":null}', '{"b":"c"}'), ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"c"}', '{"a":["b"]}', '{"a":["b"]}'),
    ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('{"a":[{"b":"c"}]}', '{"a":[1]}', '{"a":[1]}'), ('["a","b"]', '["c","d"]', '["c","d"]'), ('{"a":"b"}', '["c"]', '["c"]'), ('{"a":"foo"}', "null", "null"), ('{"a":"foo"}', '"bar"', '"bar"'),
    ('{"e":null}', '{"a":1}', '{"a":1,"e":null}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'), ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'), ('{"a":1}', None, '{"a":1}'), (None, '{"a":1,"b":null}', '{"a":1}'), ('{"a":1}', "{broken", '{"a":1}'), (None, None, None),
]


def test_merge_patches(spark):
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(PATCHES)], "i int, t string, p string")
    assert [r.m for r in rows.select("i", merge_patch(F.col("t"), F.col("p")).alias("m")).orderBy("i").collect()] == [w for *_, w in PATCHES]
    deep = '{"a":' * 14 + "1" + "}" * 14
    with pytest.raises(Exception, match="within each other"):
        spark.createDataFrame([("{}", deep)], "t string, p string").select(merge_patch(F.col("t"), F.col("p"))).collect()


def plain_cuts(lengths, lead, limit):
    part, size, out = 1, lengths[0], [1]
    for n in lengths[1:]:
        if size + n > limit:
            part, size = part + 1, lead
        size += 2 + n
        out.append(part)
    return out


def test_greedy_cuts_over_cells(spark, monkeypatch):
    """Documents of several cells, blocks longer than a cell, at a limit's very edge, and of no length."""
    monkeypatch.setattr(passages, "CELL", 2)
    import random

    draw = random.Random(2)
    docs = {"a": [12, *(draw.choice([1, 5, 20, 49, 50]) for _ in range(300))], "b": [60, *(draw.choice([3, 300, 7]) for _ in range(80))], "c": [9], "d": [9] + [0] * 40, "e": [10] + [20, 16] * 30}
    rows = [(d, f"{i:05}", "", n, 4) for d, ns in docs.items() for i, n in enumerate(ns)]
    blocks = spark.createDataFrame(rows, "document string, by string, then string, length long, lead long").repartition(5)
    got = {d: [] for d in docs}
    for r in passages.greedy_cuts(blocks, limit=50).orderBy("document", "k").collect():
        got[r.document].append(r.part)
    assert got == {d: plain_cuts(ns, 4, 50) for d, ns in docs.items()}


def test_passages(spark):
    rows = [("d", "T", "Intro", "b", "", "## b\n\n" + "x" * 30 + "\n## inner\ny\n"), ("d", "T", "Intro", "a", "", "## a\n\nfirst\n")]
    sections = spark.createDataFrame(rows, "document string, title string, intro string, by string, then string, text string")
    whole = passages.export_passages(sections).collect()
    assert [(r.file, r.text) for r in whole] == [("d.md", "# T\n\nIntro\n\n\n## a\n\nfirst\n\n\n## b\n\n" + "x" * 30 + "\n\n## inner\ny\n")]
    parts = {r.file: r.text for r in passages.export_passages(sections, 50).collect()}
    assert parts == {"d-01.md": "# T\n\nIntro\n\n\n## a\n\nfirst\n", "d-02.md": "# T\n\n## b\n\n" + "x" * 30, "d-03.md": "# T\n\n## inner\ny\n"}
    terms = spark.createDataFrame([("Token", "unit", "A piece.", "Text is cut.", '["piece","bit"]'), ("agent", "thing", "Acts.", "On its own.", None)], "term string, kind string, short string, body string, also string")
    texts = [r.text for r in passages.vocabulary(terms, "s").orderBy("by").collect()]
    assert texts == ["## agent\n\nActs. (thing.) On its own. Page: s/index/tech.\n", "## Token\n\nA piece. (unit.) Text is cut. Also called: piece, bit. Page: s/index/tech.\n"]
    figures = {4.06143: "4.06143", 17.0: "17", 0.0: "0", 1234567.0: "1.23457e+06", 0.00001234: "0.00001234", 0.000001: "1e-06", 100000.0: "100000", 81.5: "81.5", -2.25: "-2.25"}
    got = spark.createDataFrame([(k,) for k in figures], "v double").select("v", passages.six_figures(F.col("v")).alias("s")).collect()
    assert {r.v: r.s for r in got} == figures


def test_dollars_at_halves(spark):
    """Half cents and half dollars as printf rounds them: by the double itself, halves of it to the even digit."""
    micros = [5_000 * i for i in range(200, 20_000)] + [500_000 * i for i in range(200, 4_000)] + [1_004_999, 1_005_001, 99_994_999, 99_995_000, 100_499_999, 2**52 * 5_000 // 10**7, 1_801_500_000, 250, 0]
    got = spark.createDataFrame([(m,) for m in micros], "m long").select("m", passages.dollars(F.col("m")).alias("s")).collect()
    plain = lambda d: f"{d:.0f}" if d >= 100 else f"{d:.2f}" if d >= 1 else f"{d:.8f}".rstrip("0").rstrip(".")
    assert {r.m: r.s for r in got} == {m: "$" + plain(m / 1e6) for m in micros}


def test_places_over_ranges(spark):
    rows = [("a", i % 7, i) for i in range(200)] + [(None, 1, 500), (None, 0, 501), ("b", 3, 600)]
    df = spark.createDataFrame(rows, "k string, v int, id long")
    got = {r.id: (r.place, r.total) for r in ordered.running(df, ["k"], [F.col("v"), F.col("id")], {"v": "total"}, "place").collect()}
    for k in ("a", None, "b"):
        total = 0
        for place, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1):
            total += v
            assert got[i] == (place, total)
    medians = {r.k: (r.v, r.id) for r in ordered.upper_median(df, ["k"], ["v", "id"]).collect()}
    assert medians == {"a": (3, 100), None: (1, 501), "b": (3, 600)}


def test_absorbing_twice_mints_nothing(spark):
    queue = spark.createDataFrame([("s", "Meta-Llama/Big One", '{"name":"Big","context_length":5}'), ("s", "other/big-one", None), ("s", "new co/x/Small_1.5", "{}"), ("s", "bare", None), ("s", "x/!!", None), ("t", "kept", None)], "source string, alias string, payload string")
    none = spark.createDataFrame([("ent_bare",)], "id string")
    first = entries.absorb_queue(queue, none, spark.createDataFrame([], "id string"), "s")
    minted = {r.id: (r.name, r.maker, r.attrs) for r in first["entities"].collect()}
    assert minted == {"ent_big-one": ("Big", "prov_meta", '{"context":5}'), "ent_small-1.5": ("Small_1.5", "prov_new-co", "{}")}
    assert [tuple(r) for r in first["providers"].collect()] == [("prov_new-co", "new co", "vendor")]
    assert tuple(first["counters"].first()) == (2, 4, 1, 1) and {(r.source, r.alias) for r in first["queue"].collect()} == {("s", "x/!!"), ("t", "kept")}
    again = entries.absorb_queue(queue, none.union(first["entities"].select("id")), first["providers"].select("id"), "s")
    assert tuple(again["counters"].first()) == (0, 4, 0, 1)
    assert tuple(entries.absorb_queue(queue, none, none, "s", limit=1)["counters"].first()) == (1, 1, 0, 0)


def test_import_of_many_documents(spark):
    """As many documents as there are keys: none grows with the table, and their order holds beyond ten thousand of them."""
    part = spark.range(40_000).select(F.col("id").alias("seq"), F.lit("s1").alias("subject"), F.lit("description").alias("kind"), F.lit("t").alias("text"), F.lit("u").alias("source_url"), F.lit("d").alias("taken_at"))
    lens = Catalogue(spark, "/root/testdata/sf0.001")
    lens.docs = part
    rows = entering._documents(lens).select(F.size(F.from_json("body", entries.CURATED).getField("docs")).alias("n"), "file").collect()
    assert max(r.n for r in rows) <= entering._KEYS and sum(max(r.n, 0) for r in rows) == 40_000

    tables = {
        "providers": "id string, name string, url string, kind string, notes string", "entities": "id string, register string, name string, input_kind string, output_kind string, maker string, attrs string", "aliases": "source string, alias string, entity_id string", "queue": "source string, alias string, payload string",
        "offerings": "entity_id string, provider_id string, way string, variant string, first_seen date, last_seen date", "prices": "entity_id string, provider_id string, way string, variant string, dimension string, micros long, source_url string, taken_at date, seq long",
        "metrics": "entity_id string, provider_id string, way string, variant string, metric string, value double, source_url string, taken_at date, seq long", "suites": "id string, name string, measurer string, url string, metric string, subject string, lower_is_better boolean, updated string",
        "benchmarks": "entity_id string, suite string, metric string, value double, rank long, out_of long, source_url string, taken_at date, seq long", "docs": "subject string, kind string, field string, text string, source_url string, taken_at string",
    }
    held = {n: spark.createDataFrame([], s) for n, s in tables.items()}
    figure = lambda n: F.struct(F.lit("month").alias("dimension"), n.alias("micros_per_unit"), F.lit("u").alias("source_url"), F.lit("2024-01-02").alias("taken_at"))
    offer = F.struct(F.lit("e").alias("entity"), F.lit("p").alias("provider"), F.lit("api").alias("way"), F.array(figure(F.col("id")), figure(-F.col("id"))).alias("components"))
    bodies = spark.range(12_000).where("id > 11990 or id < 3 or id = 9300").select(F.col("id").alias("file"), F.to_json(F.struct(F.array(offer, offer).alias("offerings"))).alias("body"))
    bodies = bodies.unionByName(spark.range(3, 9_300).select(F.col("id").alias("file"), F.lit("{}").alias("body")))
    out = entries.import_curated(bodies, held)
    want = [m for n in (0, 1, 2, 9300, *range(11_991, 12_000)) for m in ((n, -n, n, -n) if n else (0,))]
    assert [r.micros for r in out["prices"].orderBy("seq").collect()] == want


def test_import_fails_without_a_needed_field(spark):
    tables = {
        "providers": "id string, name string, url string, kind string, notes string", "entities": "id string, register string, name string, input_kind string, output_kind string, maker string, attrs string", "aliases": "source string, alias string, entity_id string", "queue": "source string, alias string, payload string",
        "offerings": "entity_id string, provider_id string, way string, variant string, first_seen date, last_seen date", "prices": "entity_id string, provider_id string, way string, variant string, dimension string, micros long, source_url string, taken_at date, seq long",
        "metrics": "entity_id string, provider_id string, way string, variant string, metric string, value double, source_url string, taken_at date, seq long", "suites": "id string, name string, measurer string, url string, metric string, subject string, lower_is_better boolean, updated string",
        "benchmarks": "entity_id string, suite string, metric string, value double, rank long, out_of long, source_url string, taken_at date, seq long", "docs": "subject string, kind string, field string, text string, source_url string, taken_at string",
    }
    held = {n: spark.createDataFrame([], s) for n, s in tables.items()}
    price = {"dimension": "month", "usd_per_unit": 2.5, "source_url": "u", "taken_at": "2024-01-02"}
    good = {"providers": [{"id": "p", "name": "P"}, {"id": "p", "name": "Q"}], "entities": [{"id": "ent_e", "register": "model", "name": "E", "input_kind": "Text", "output_kind": "images", "attrs": {"x": 1}}], "offerings": [{"entity": "ent_e", "provider": "p", "way": "api", "components": [price, price, {**price, "micros_per_unit": 7}]}], "docs": [{"subject": "ent_e", "kind": "fact", "field": "context", "text": "9", "source_url": "u", "taken_at": "d"}]}
    bodies = lambda *docs: spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "file int, body string")
    out = entries.import_curated(bodies(good), held)
    assert [r.name for r in out["providers"].collect()] == ["Q"] and [(r.output_kind, r.attrs) for r in out["entities"].collect()] == [("image", '{"context":9,"x":1}')]
    assert sorted(r.micros for r in out["prices"].collect()) == [7, 2_500_000] and out["counters"].first().unchanged == 1
    assert out["offerings"].first().last_seen == datetime.date(2024, 1, 2)
    again = entries.import_curated(bodies(good), {n: out[n] for n in tables})
    assert (again["counters"].first().minted, again["counters"].first().appended) == (0, 2)  # the first figure differs from the last one held
    with pytest.raises(Exception, match="needs"):
        entries.import_curated(bodies({"entities": [{"id": "ent_x", "name": "X"}]}), held)["entities"].collect()
    with pytest.raises(Exception, match="offering needs components"):
        entries.import_curated(bodies({"offerings": [{"entity": "e", "provider": "p", "way": "api"}]}), held)["offerings"].collect()


def test_company_facts_twice(spark):
    providers = spark.createDataFrame([("prov_a", "A", "u", "vendor", None, None, None, 5, None, None), ("prov_b", "B", "u", "vendor", "mark", "Active", True, None, None, None)], "id string, name string, url string, kind string, backing string, status string, listed boolean, raised long, rounds long, raised_source string")
    docs = spark.createDataFrame([("prov_a", "fact", "ceo", "Old", "x", "d"), ("prov_a", "description", "", "what it was", "x", "d")], "subject string, kind string, field string, text string, source_url string, taken_at string")
    edges = spark.createDataFrame([], "fund_id string, company_id string, source_url string")
    one = lambda row, schema: spark.createDataFrame([row], schema)
    facts_ = {
        "portfolio": spark.createDataFrame([("A", "prov_a", "Olda", None), ("New Co", None, None, "Big")], "name string, held string, was string, acquired_by string"), "batch": spark.createDataFrame([("B", "prov_b", "B1", "Gone", "", "", ""), ("C+", None, "B1", "On", "c.org", "It makes   things for all those who want such things.", "dir")], "name string, held string, backing string, status string, url string, text string, page string"),
        "rounds": one(("prov_a", 7, 2, "w"), "id string, raised long, rounds long, url string"), "unheard": one(("D", "d.org", 9, 1, "short"), "name string, url string, raised long, rounds long, text string"), "people": one(("prov_a", "ceo", "New, Newer", "q"), "id string, role string, names string, source_url string"),
    }
    fund = ("fund", "Fund", "f.vc")
    out = entries.apply_company_facts(providers, docs, edges, facts_, fund, "f.vc/list", "2024-01-01")
    rows = {r.id: (r.name, r.backing, r.status, r.raised, r.rounds) for r in out["providers"].collect()}
    assert rows == {"prov_a": ("A", "Fund", None, 7, 2), "prov_b": ("B", "mark", "Active", None, None), "prov_new-co": ("New Co", "Fund", "Acquired", None, None), "prov_c": ("C+", "B1", "On", None, None), "prov_d": ("D", None, None, 9, 1), "fund": ("Fund", None, None, None, None)}
    texts = {(r.subject, r.field): r.text for r in out["docs"].collect()}
    assert texts == {("prov_a", "ceo"): "New, Newer", ("prov_a", ""): "what it was", ("prov_a", "formerly"): "Olda", ("prov_new-co", "acquired_by"): "Big", ("prov_c", ""): "It makes things for all those who want such things."}
    again = entries.apply_company_facts(out["providers"], out["docs"], out["investments"], facts_, fund, "f.vc/list", "2024-01-01")
    for name, df in out.items():
        assert sorted(map(str, again[name].collect())) == sorted(map(str, df.collect()))


def test_tags(spark):
    rows = [
        ("Whisper", "turns speech into text", "audio", "text", "model", None, ["transcribe"]), ("Omni", "chats", "text + audio", "text + audio", "model", None, ["speak"]), ("Veo", None, "text", "audio + video", "model", None, ["video"]), ("Lyria", "Makes SONGS", "text", "audio", "model", None, ["music"]),
        ("Rerank 3", "reranker", "text", "embedding", "model", None, ["rerank"]), ("Text Embedder", None, "text", "text", "model", None, ["embedding"]), ("Scan", "OCR of documents", "image", "text + image", "tool", None, ["ocr"]), ("Devstral", None, "text", "text", "model", ["gaia", "hle"], ["code", "reasoning", "agents"]),
        ("Plain", None, "text", "text", "agent", [], ["chat"]), ("Plain", None, "text", "text", "tool", [], []), (None, None, None, None, "model", None, []), ("x", "avatar", "text", "video", "model", ["livecodebench"], ["avatar"]),
    ]
    df = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(rows)], "i int, name string, said string, takes string, returns string, register string, boards array<string>")
    got = df.select("i", tags.task_tags(*(F.col(c) for c in ("name", "said", "takes", "returns", "register", "boards"))).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [r[6] for r in rows]


def test_rules_of_upkeep_see_what_earlier_ones_left(spark):
    e = spark.createDataFrame([("a", "Name (Deep/", "m", "text", ["embedding"], "2024", "2025"), ("b", "x/y -", None, "text", None, None, None), ("c", "(", "s", "text", ["embedding", "rerank"], "2", "1")], "id string, name string, maker string, output_kind string, tasks array<string>, released string, knowledge string")
    p, o = spark.createDataFrame([("m", "aggregator"), ("s", "vendor")], "id string, kind string"), spark.createDataFrame([("c", "m", "api")], "entity_id string, provider_id string, way string")
    rows, counts = upkeep.normalise_rules(e, p, o)
    got = {r.id: (r.name, r.maker, r.output_kind, r.released, len(r.broken)) for r in rows.collect()}
    assert got == {"a": ("Name", None, "embedding", None, 4), "b": ("x y", None, "text", None, 2), "c": ("(", "s", "text", "2", 2)}
    assert list(counts.get.values()) == [1, 2, 1, 2, 1, 1]


def test_feeds_and_ledgers(spark):
    news = spark.createDataFrame([("f1", "2", "a"), ("f2", "5", "b"), ("f3", "1", "c"), ("f3", "9", "d")], "file string, read_at string, x string")
    assert [r.x for r in prose.news_feed(news, 2).collect()] == ["d", "b"]
    lists = [spark.createDataFrame([("1", "Acme", True), ("2", "Gone", False)], "id string, name string, active boolean"), spark.createDataFrame([("1", "Acme two", False), ("3", "Beta Labs, Inc.", True)], "id string, name string, active boolean")]
    active, inactive = prose.directory_union(lists)
    assert sorted(r.name for r in active.collect()) == ["Acme", "Beta Labs, Inc."] and [r.name for r in inactive.collect()] == ["Gone"]
    known, fresh = prose.directory_matches(active, spark.createDataFrame([("p9", "Beta"), ("p8", "Other")], "id string, name string"))
    assert [(r.id, r.held) for r in known.collect()] == [("3", "p9")] and [r.id for r in fresh.collect()] == ["1"]
    ledger = spark.createDataFrame([("s", "d1", 1), ("t", "d1", 2)], "source string, ran_at string, n int")
    got = maintenance.run_ledger(ledger, spark.createDataFrame([("s", "d1", 5), ("s", "d2", 6)], "source string, ran_at string, n int"))
    assert sorted(map(tuple, got.collect())) == [("s", "d1", 5), ("s", "d2", 6), ("t", "d1", 2)]
    subjects = spark.createDataFrame([("a", "Acme"), ("b", "Beta")], "id string, name string")
    said = lambda *rows: spark.createDataFrame(rows, "id string, said string, address string")
    long = "Acme is a maker of things that people use every day."
    blurbs = prose.best_blurb(subjects, [("own", said(("a", "Buy this domain now from those who sell it, Acme", "acme.com"), ("b", "short", ""))), ("wiki", said(("a", long, "w")))])
    assert {r.id: (r.said, r.source) for r in blurbs.collect()} == {"a": (long, "wiki"), "b": (None, None)}
    top = quality.top_findings(spark.createDataFrame([("r", i) for i in range(9)] + [("q", 1)], "rule string, x int"), "rule", ["x"], 2)
    assert sorted((r.rule, r.x, r.place) for r in top.collect()) == [("q", 1, 1), ("r", 0, 1), ("r", 1, 2)]
    pages = spark.createDataFrame([("https://a.org/index/coverage", "read 2024-05-06"), ("https://b.org/index/coverage?x", "read lately"), ("https://a.org/", None)], "url string, html string")
    assert [r.url for r in quality.undated_status(pages).collect()] == ["https://b.org/index/coverage?x"]


def test_observations_and_price_files(spark):
    index = joins.build_key_index(spark.createDataFrame([("e", "Nova 2"), ("f", "Nova 3")], "id string, name string"))
    key = "entity_id string, provider_id string, way string, variant string"
    offerings = spark.createDataFrame([("e", "p", "api", "", datetime.date(2024, 1, 1), datetime.date(2024, 1, 1))], key + ", first_seen date, last_seen date")
    prices = spark.createDataFrame([("e", "p", "api", "", "mtok_in", "u", 1, datetime.date(2024, 1, 1)), ("e", "p", "api", "", "mtok_in", "v", 2, datetime.date(2024, 1, 1))], key + ", dimension string, source_url string, micros long, taken_at date")
    seen = spark.createDataFrame([("nova-2", "p", "u", "mtok_in", 5, 1), ("Nova 2", "p", "u", "mtok_in", 6, 2), ("Nova 3", "q", "u", "mtok_out", 7, 3), ("nobody", "q", "u", "mtok_in", 8, 4)], "subject string, seller string, source_url string, dimension string, micros long, ord long")
    out = maintenance.write_observations(seen, index, offerings, prices, "api", "2024-02-01")
    assert sorted((r.entity_id, r.source_url, r.micros) for r in out["prices"].collect()) == [("e", "u", 5), ("e", "v", 2), ("f", "u", 7)]
    assert sorted((r.entity_id, str(r.first_seen), str(r.last_seen)) for r in out["offerings"].collect()) == [("e", "2024-01-01", "2024-02-01"), ("f", "2024-02-01", "2024-02-01")]
    offers = spark.createDataFrame([("k", "Nova 2", "", "mtok_in", 5), ("k", "NOVA-2", "", "mtok_in", 4), ("k", "who", "", "mtok_in", 1), ("z", "Nova 3", "", "mtok_in", 1)], "seller_key string, name string, lane string, dimension string, micros long")
    rates, counts = maintenance.apply_price_files(offers, spark.createDataFrame([("k", "s")], "key string, seller string"), index)
    assert [tuple(r) for r in rates.collect()] == [("e", "s", "", "mtok_in", 4)] and tuple(counts.first()) == (2, 1, 1)


def test_score_files_with_quotes(spark):
    lines = ["x,Model,Score", *(f'{i},"M, ""{i}""\nnew",0.{i}' for i in range(1, 9)), "", "a,b,c,d", "9,  ,5", "10,last,none", "11,late,50"]
    files = spark.createDataFrame([("d/board_a_external.csv", "\r\n".join(lines)), ("few.csv", "Model,Score\na,1\n"), ("other.csv", "a,b\n" * 20), ("empty.csv", "")], "path string, body string")
    got = {r.name: r.value for r in scores.read_score_csvs(files).collect()}
    assert got == {**{f'M, "{i}"\nnew': 10.0 * i for i in range(1, 9)}, "late": 50.0}


def test_one_spelling(spark):
    e = spark.createDataFrame([("1", "GPT 1", "o"), ("2", "Gpt 2", "o"), ("3", "gpt-3", "o"), ("4", "LLama 2", "m"), ("5", "Llama 3", "m"), ("6", "Llama 4", "m"), ("7", "Aa x", None), ("8", "AA y", None)], "id string, name string, maker string")
    mends, ties = facts.one_spelling(e, spark.createDataFrame([("o", "Gpt Inc"), ("m", "Meta")], "id string, name string"))
    assert sorted((r.id, r.now, r.why) for r in mends.collect()) == [("1", "Gpt 1", "the maker's own name"), ("4", "Llama 2", "the spelling most of its rows use")]
    assert [(r.brand, r.maker) for r in ties.collect()] == [("aa", "")]
