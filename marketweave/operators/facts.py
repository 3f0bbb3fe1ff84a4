"""Counting and settling: votes, majorities, cheapest sellers and dominant units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions import expressions as X


def cheapest(prices: DataFrame, entity: list[str], value: str) -> DataFrame:
    return prices.where(F.col(value) > 0).groupBy(*entity).agg(F.min(value).alias("lowest"))


def unit_pair(prices: DataFrame, entity: list[str], dimension: str, value: str, first: str, second: str) -> DataFrame:
    """Lowest figure in each of two units in one pass; entities that lack one are left out."""
    low = lambda d: F.min(F.when((F.col(dimension) == d) & (F.col(value) > 0), F.col(value)))
    return prices.groupBy(*entity).agg(low(first).alias("first"), low(second).alias("second")).where("first is not null and second is not null")


def blended(pairs: DataFrame) -> DataFrame:
    """One part in and three parts out."""
    return pairs.withColumn("blended", (F.col("first") + 3 * F.col("second")) / 4)


def majority_vote(votes: DataFrame, key: list[str], vote: str) -> DataFrame:
    """yes, no and the verdict of a boolean; a tie gives no row."""
    out = votes.where(F.col(vote).isNotNull()).groupBy(*key).agg(F.count(F.when(F.col(vote), 1)).alias("yes"), F.count(F.when(~F.col(vote), 1)).alias("no"))
    return out.where("yes <> no").withColumn("verdict", F.col("yes") > F.col("no"))


def strict_majority(said: DataFrame, key: list[str], value: str) -> DataFrame:
    """The value that more than half of a key's speakers gave, with both counts."""
    n = said.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    top = n.groupBy(*key).agg(F.max(F.struct("n", value)).alias("_t"), F.sum("n").alias("spoke"))
    return top.where(F.col("_t.n") * 2 > F.col("spoke")).select(*key, F.col("_t")[value].alias(value), F.col("_t.n").alias("n"), "spoke")


def dominant_unit(prices: DataFrame, entity: str, dimension: str, seller: str, value: str, order: list[str]) -> DataFrame:
    """The unit that most sellers quote, the given order breaking ties, with the cheapest and dearest seller in it."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(dimension))
    row = F.struct(F.col(value).alias("v"), F.col(seller).alias("s"))
    each = prices.groupBy(entity, dimension).agg(F.countDistinct(seller).alias("sellers"), F.min(row).alias("low"), F.max(F.struct(F.col(value).alias("v"), (-F.col(seller)).alias("s"))).alias("high"))
    best = each.groupBy(entity).agg(F.max(F.struct("sellers", (-place).alias("p"), dimension, "low", "high")).alias("_b"))
    b = F.col("_b")
    return best.select(entity, b[dimension].alias("unit"), b["sellers"].alias("sellers"), b["low"]["v"].alias("low"), b["low"]["s"].alias("cheapest"), b["high"]["v"].alias("high"), (-b["high"]["s"]).alias("dearest"))


def best_standing(df: DataFrame, entity: str, suite: str, rank: str, out_of: str) -> DataFrame:
    """The highest share beaten; the larger field, then the suite's name, breaks ties. Rows without a rank are skipped."""
    share = (F.col(out_of) - F.col(rank)) / (F.col(out_of) - 1)
    best = df.where(F.col(rank).isNotNull() & (F.col(out_of) > 1)).groupBy(entity).agg(F.max(F.struct(share.alias("share"), out_of, suite)).alias("_b"))
    return best.select(entity, F.col("_b.share").alias("share"), F.col("_b")[out_of].alias(out_of), F.col("_b")[suite].alias(suite))


def seller_queue(prices: DataFrame, entity: str, seller: str, value: str) -> DataFrame:
    """One line per entity and seller: low, high and the number of ways."""
    return prices.groupBy(entity, seller).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("ways"))


def spelling_majority(df: DataFrame, key: list[str], spelling: str) -> DataFrame:
    """The commonest spelling of a key; a tie for the first place gives no row."""
    n = df.groupBy(*key, spelling).agg(F.count("*").alias("n"))
    top = n.groupBy(*key).agg(F.max("n").alias("n"))
    return n.join(top, [*key, "n"]).groupBy(*key, "n").agg(F.count("*").alias("_ties"), F.min(spelling).alias(spelling)).where("_ties = 1").drop("_ties")


def one_spelling(entities: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to call the things of a brand that one maker spells in several ways: (id, was, now, why), and the ties that nothing decides (brand, maker, spellings).

    A brand is the letters a written name begins with, whatever their case. The maker's own spelling stands where one of its things has it, else the commonest.
    """
    trimmed = F.trim("name")
    rows = entities.where(~X.is_slug(trimmed)).select("id", "name", trimmed.alias("t"), F.coalesce("maker", F.lit("")).alias("maker"), X.brand_of(trimmed).alias("had")).where("had is not null").withColumn("brand", F.lower("had"))
    key = ["brand", "maker"]
    n = rows.groupBy(*key, "had").agg(F.count("*").alias("n"))
    own = providers.select(F.col("id").alias("maker"), X.brand_of(F.trim("name")).alias("own"))
    split = n.join(own, "maker", "left").groupBy(*key).agg(F.count("*").alias("ways"), F.max("n").alias("most"), F.max(F.when(F.col("had") == F.col("own"), F.col("had"))).alias("own"), F.array_sort(F.collect_list(F.struct("had", "n"))).alias("spellings")).where("ways > 1")
    first = F.filter("spellings", lambda x: x["n"] == F.col("most"))
    want = F.coalesce("own", F.when(F.size(first) == 1, first[0]["had"]))
    split = split.withColumns({"want": want, "why": F.when(F.col("own").isNotNull(), "the maker's own name").otherwise("the spelling most of its rows use")})
    mends = rows.join(split.where("want is not null").select(*key, "want", "why"), key).where("had <> want")
    mends = mends.select("id", F.col("name").alias("was"), F.concat("want", F.substr("name", F.length("had") + 1)).alias("now"), "why")
    return mends, split.where("want is null").select("brand", "maker", "spellings")


def free_daily_total(offers: DataFrame, allowance: str = "allowance") -> DataFrame:
    """One row of what is given away a day over all offers: requests, tokens, neurons, credits and dollars, a month's by its thirtieth; what is given once; and how many offers say so, say so by the month, or do not say.

    allowance is a map of figures by name. An offer with an empty or null map is unstated, not nothing.
    """
    figure = lambda k: F.coalesce(F.try_element_at(F.col(allowance), F.lit(k)), F.lit(0.0))
    stated = F.coalesce(F.size(allowance) > 0, F.lit(False))
    total = lambda *parts: F.coalesce(F.sum(F.when(stated, sum(parts[1:], parts[0]))), F.lit(0.0))
    monthly = stated & ((figure("calls_month") > 0) | (figure("credits_month") > 0) | (figure("usd_month") > 0))
    count = lambda when: F.count(F.when(when, 1))
    return offers.agg(
        total(figure("rpd"), figure("calls_month") / 30).alias("requests"), total(figure("tpd")).alias("tokens"), total(figure("neurons_day")).alias("neurons"), total(figure("credits_month") / 30).alias("credits"), total(figure("usd_month") / 30).alias("dollars"),
        total(figure("credits_once")).alias("credits_once"), total(figure("usd_once")).alias("dollars_once"), count(stated).alias("stated"), count(monthly).alias("monthly"), count(~stated).alias("unstated"),
    )


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Distinct values that a vocabulary does not have, with their counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy(column).agg(F.count("*").alias("n"))
