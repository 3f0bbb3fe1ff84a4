"""Rate cards on printed bodies, and streams over several micro-batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marketweave.functions import ordered
from marketweave.sources.rate_cards import CARDS, flatten_rate_card, unpivot
from marketweave.streaming import changes, delivery


def rates(spark, card, *models):
    bodies = spark.createDataFrame([(json.dumps({"data": list(models)}),), (None,), ("{",), ('{"data": []}',)], "body string")
    found = flatten_rate_card(bodies, CARDS[card])
    return {(r.alias, r.variant, r.dimension): r.micros for r in unpivot(found).collect()}, found


def test_prices_a_token_are_text_and_noughts_go(spark):
    got, found = rates(spark, "openrouter", {"id": "a/b", "pricing": {"prompt": "0.0000005", "completion": "0", "request": "0.01", "image": "0.000000375"}}, {"id": "bare"}, {"name": "no id"})
    assert got == {("a/b", "", "mtok_in"): 500_000, ("a/b", "", "call"): 10_000}
    assert sorted(r.alias for r in found.collect()) == ["a/b", "bare"]


def test_prices_a_million_tokens(spark):
    got, _ = rates(spark, "novita", {"id": "n", "pricing": {"prompt": {"price_per_m_decimal": "0.27"}, "completion": {"price_per_m_decimal": "x"}}})
    assert got == {("n", "", "mtok_in"): 270_000}
    got, _ = rates(spark, "chutes", {"id": "c", "pricing": {"prompt": 0.1, "completion": -1, "input_cache_read": 0.05}})
    assert got == {("c", "", "mtok_in"): 100_000, ("c", "", "mtok_cache_read"): 50_000}


def test_the_upstream_is_the_variant(spark):
    got, _ = rates(spark, "requesty", {"id": "up/m", "input_price": 1e-6}, {"id": "m", "output_price": 2e-6})
    assert got == {("up/m", "up", "mtok_in"): 1_000_000, ("m", "", "mtok_out"): 2_000_000}


def test_changes_across_micro_batches(spark, tmp_path):
    rows = [("a", 1, 5), ("a", 2, 5), ("b", 1, None), ("a", 3, None), ("a", 4, None), ("b", 2, None), ("a", 5, 5), ("b", 3, 7)]
    for i, part in enumerate((rows[:3], rows[3:6], rows[6:])):
        spark.createDataFrame(part, "k string, s long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema("k string, s long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    got = changes.capture_changes(stream, "t", ["k"], ["s"], ["v"])
    assert sorted((r.k, r.s, r.v) for r in got.collect()) == [("a", 1, 5), ("a", 3, None), ("a", 5, 5), ("b", 1, None), ("b", 3, 7)]


def test_evidence_is_kept_once(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("x",), (None,), ("",)], "quote string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "q"))
    got = changes.drain(changes.evidence(spark.readStream.schema(df.schema).parquet(str(tmp_path / "q")), "quote", "at", "1 day"), "e")
    assert got.count() == 2


def test_state_is_written_anew(spark, tmp_path, monkeypatch):
    """More micro-batches than lie between two whole states, keys that rest for long, a null key."""
    monkeypatch.setattr(changes, "COMPACT", 3)
    rows = [[("a", 10 * i, i // 4), (None, 10 * i + 1, 7)] + ([("rests", 10 * i + 2, 1)] if i in (0, 9) else []) for i in range(11)]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k string, s long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={i:02}"))
    stream = spark.readStream.schema("k string, s long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    got = changes.capture_changes(stream, "t", ["k"], ["s"], ["v"])
    assert sorted(((r.k or "", r.s, r.v) for r in got.collect())) == [("", 1, 7), ("a", 0, 0), ("a", 40, 1), ("a", 80, 2), ("rests", 2, 1)]


def test_one_key_of_many_rows_lies_in_many_partitions(spark):
    df = spark.range(60_000).select(F.lit("hot").alias("k"), F.col("id").alias("s"), (F.col("id") / 1000).cast("long").cast("string").alias("v"))
    got = ordered.previous(df, ["k"], [F.col("s")], "v", "was")
    assert ordered.dealt(df, ["k"], [F.col("s")]).groupBy("_part").count().count() > 1
    assert got.where("was is null or was <> v").count() == 60


def test_a_delivery_is_seen_whole_or_not_at_all(spark, tmp_path):
    root, schema = str(tmp_path / "store"), "n long"
    delivery.create(spark, root, {"prices": schema, "ledger": schema})
    one = lambda n: {"prices": spark.createDataFrame([(n,)], schema), "ledger": spark.createDataFrame([(-n,)], schema)}
    rows = lambda name: sorted(r.n for r in delivery.read(spark, root, name, schema).collect())
    assert rows("prices") == rows("ledger") == []
    assert delivery.deliver(spark, root, "b1", one(1))

    def breaks(root, batch, tables):
        delivery.stage(root, batch, {"prices": tables["prices"]})
        raise OSError("lost between two tables")

    with pytest.raises(OSError):
        delivery.deliver(spark, root, "b2", one(2), breaks)
    assert (rows("prices"), rows("ledger")) == ([1], [-1])
    assert delivery.deliver(spark, root, "b2", one(3)) and not delivery.deliver(spark, root, "b2", one(4))
    assert (rows("prices"), rows("ledger")) == ([1, 3], [-3, -1])
    delivery.create(spark, root, {"prices": schema})
    assert rows("prices") == [1, 3]


def test_a_stream_is_delivered_once(spark, tmp_path):
    for i in range(3):
        spark.range(4 * i, 4 * i + 4).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    root = str(tmp_path / "store")
    delivery.create(spark, root, {"even": "id long", "odd": "id long"})
    split = lambda df: {"even": df.where("id % 2 = 0"), "odd": df.where("id % 2 = 1")}
    for state in ("first", "again"):  # a lost checkpoint replays everything
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
        delivery.deliver_stream(stream, root, str(tmp_path / state), split)
        got = {n: sorted(r.id for r in delivery.read(spark, root, n, "id long").collect()) for n in ("even", "odd")}
        assert got == {"even": [0, 2, 4, 6, 8, 10], "odd": [1, 3, 5, 7, 9, 11]}
