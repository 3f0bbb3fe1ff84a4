"""Deliveries of findings: files picked up once by content, lines routed by kind, and prices kept current from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions import expressions as X
from marketweave.operators import joins

FINDING = "struct<what: string, name: string, says: string, source: string, read_at: string, maker: string, seller: string>"


def unseen_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files(file, content) with their hash whose (file, hash) the ledger does not have: a changed file of a known name counts as new."""
    hashed = files.select("file", "content", F.sha2("content", 256).alias("hash"))
    return hashed.join(ledger.select("file", "hash"), ["file", "hash"], "left_anti")


def read_findings(files: DataFrame) -> DataFrame:
    """The JSON lines of files(file, content, ...): one row a finding with its file and the date it was read; broken lines go.

    A finding without a date has the newest of its delivery, so a late file does not beat a fresher price.
    """
    lines = files.select("file", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line"))
    rows = lines.select("file", F.from_json("line", FINDING).alias("d")).where("d is not null and (d.what is not null or d.name is not null or d.source is not null)").select("file", "d.*")
    day = F.substring("read_at", 1, 10).try_cast("date")
    newest = rows.groupBy("file").agg(F.max(day).alias("newest"))
    return rows.join(newest, "file").withColumn("taken_at", F.coalesce(day, "newest")).drop("newest", "read_at")


def route_findings(findings: DataFrame, index: DataFrame, providers: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Every finding with where it goes: prices, standings, evidence, candidates, already_held or dropped, and what was read from it.

    A price needs a readable rate, a known thing and a known seller, else it is evidence of the thing; a standing needs a
    readable place of a known thing; a mention of something unknown by a known maker is a candidate; events, watches and snapshots are evidence.
    """
    known = providers.groupBy(X.norm(F.col("name")).alias("key")).agg(F.min("id").alias("provider_id")).where("key <> ''")
    party = F.when(F.col("what") == "mention", F.col("maker")).otherwise(F.col("seller"))
    rows = joins.resolve(findings, index).withColumns({"key": X.norm(F.coalesce(party, F.lit(""))), "rate": X.parse_price(F.col("says")), "place": X.parse_standing(F.col("says"))})
    rows = rows.join(known, "key", "left").drop("key")
    thing, who = F.col("entity_id").isNotNull(), F.col("provider_id").isNotNull()
    named = (F.coalesce("name", F.lit("")) != "") & (F.coalesce("source", F.lit("")) != "")
    if held is not None:
        rows = rows.join(held.select(F.col("name"), F.lit(True).alias("_held")).distinct(), "name", "left")
    inside = F.coalesce("_held", F.lit(False)) if held is not None else F.lit(False)
    mention = F.when(~who, "dropped").when(thing | inside, "already_held").otherwise("candidates")
    to = (
        F.when(~named, "dropped")
        .when(F.col("what") == "price", F.when(thing & who & F.col("rate").isNotNull(), "prices").when(thing, "evidence").otherwise("dropped"))
        .when(F.col("what") == "standing", F.when(thing & F.col("place").isNotNull(), "standings").otherwise("dropped"))
        .when(F.col("what") == "mention", mention)
        .when(F.col("what").isin("event", "watch", "snapshot"), F.when(thing, "evidence").otherwise("dropped"))
    )
    return rows.withColumn("goes_to", F.coalesce(to, F.lit("dropped"))).drop("_held")


def deliver(write: Callable[[str, DataFrame], None], routed: DataFrame, files: DataFrame, dry: bool = False) -> DataFrame:
    """Writes what was routed, one table after another, and the ledger last, so that a delivery cut short is read again; counts of every destination. A dry run writes nothing."""
    counts = routed.groupBy("goes_to").agg(F.count("*").alias("n"))
    if not dry:
        for name in ("prices", "standings", "evidence", "candidates"):
            write(name, routed.where(F.col("goes_to") == name))
        write("ledger", files.select("file", "hash"))
    return counts


def heartbeat(read: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, rows, silent): how much each source returned; one that returned nothing is silent, which is not the same as empty."""
    n = read.groupBy("source").agg(F.count("*").alias("rows"))
    return sources.select("source").distinct().join(n, "source", "left").select("source", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("rows").isNull().alias("silent"))


def newest_prices(stream: DataFrame, keys: list[str], own: str, taken_at: str, seq: list[str], value: list[str]) -> DataFrame:
    """A stream's newest figure of any source and of the seller's own by key: two structs of state a key, whatever comes late."""
    row = F.struct(taken_at, *seq, *value)
    return stream.groupBy(*keys).agg(F.max(row).alias("any"), F.max(F.when(F.col(own), row)).alias("own"))


def fresh_price(newest: DataFrame, keys: list[str], taken_at: str, value: list[str], days: int = 45) -> DataFrame:
    """The current figure from newest_prices: the own one while it is within so many days of the newest word."""
    fresh = F.coalesce(F.col("own")[taken_at] >= F.date_sub(F.col("any")[taken_at], days), F.lit(False))
    row = F.when(fresh, F.col("own")).otherwise(F.col("any"))
    return newest.select(*keys, row[taken_at].alias(taken_at), *(row[v].alias(v) for v in value), fresh.alias("own_page"))
