"""Checks of tables and pages; each finds rows and a report counts them with a bounded sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def claimed_twice(df: DataFrame, key: list[str], entity: str) -> DataFrame:
    """Keys that more than one entity claims."""
    return df.groupBy(*key).agg(F.countDistinct(entity).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def padded(df: DataFrame, name: str) -> DataFrame:
    """Names with white space at an end."""
    return df.where(F.col(name) != F.expr(f"trim(BOTH ' \t\n\r' FROM `{name}`)"))


#: Parts that findings are dealt to for a sample.
PARTS = 64


def report(findings: dict[str, tuple[DataFrame, bool]], sample: int = 5) -> DataFrame:
    """One row per check: findings, whether it blocks, and a few of them. findings maps a name to (rows of one string column, blocking).

    All are counted in one pass: each part of a check's findings keeps a count and its least one, and a sample is the first few of these.
    """
    rows = reduce(DataFrame.union, (df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("string").alias("a")) for name, (df, _) in findings.items()))
    parts = rows.groupBy("check", F.pmod(F.xxhash64("a"), F.lit(PARTS))).agg(F.count("*").alias("n"), F.min("a").alias("one"))
    counted = parts.groupBy("check").agg(F.sum("n").alias("findings"), F.array_join(F.slice(F.array_sort(F.collect_list("one")), 1, sample), "|").alias("sample"))
    every = rows.sparkSession.createDataFrame([(name, blocking) for name, (_, blocking) in findings.items()], "check string, blocking boolean")
    return every.join(counted, "check", "left").select("check", "blocking", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("sample", F.lit("")).alias("sample"))


# Lengths of a good title and description, and the heaviest page, in characters and bytes.
TITLE_MOST, DESCRIPTION_LEAST, DESCRIPTION_MOST, PAGE_MOST = 70, 60, 320, 60_000
# Fixed value: a tag that reached the reader as text.
ESCAPED = r"&lt;(span|div|a|b|p)\b"


def audit_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(rule, url) for every broken rule that one page shows by itself."""
    c = F.coalesce(F.col(html), F.lit(""))
    title = F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))
    description = F.regexp_extract(c, r"""(?is)<meta\s[^>]*name="description"[^>]*content="([^"]*)\"""", 1)
    canonical = F.regexp_extract(c, r"""(?is)<link\s[^>]*rel="canonical"[^>]*href="([^"]*)\"""", 1)
    rules = {
        "canonical address of another page": (canonical != "") & ~F.endswith(canonical, path_of(F.col(url))),
        "no title": title == "",
        "no description": description == "",
        "no canonical address": ~c.rlike(r"""(?i)<link\s[^>]*rel="canonical\""""),
        "not exactly one h1": F.size(F.regexp_extract_all(c, F.lit(r"(?i)<h1[\s>]"), F.lit(0))) != 1,
        "escaped markup": c.rlike(ESCAPED),
        "empty heading": c.rlike(r"(?i)<h[1-6][^>]*>\s*</h[1-6]>"),
        "long title": F.char_length(title) > TITLE_MOST,
        "short or long description": (description != "") & ((F.char_length(description) < DESCRIPTION_LEAST) | (F.char_length(description) > DESCRIPTION_MOST)),
        "heavy page": F.octet_length(c) > PAGE_MOST,
    }
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return pages.select(F.col(url).alias("url"), F.explode(broken).alias("rule"))


def repeated_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    title = F.trim(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select(title.alias("title")).where("title <> ''").groupBy("title").agg(F.count("*").alias("pages")).where("pages > 1")


def shared_words(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(rule, words, pages, first, other): titles and descriptions that several pages have, with the first two of them by address."""
    c = F.coalesce(F.col(html), F.lit(""))
    title = F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))
    description = F.regexp_extract(c, r"""(?is)<meta\s[^>]*name="description"[^>]*content="([^"]*)\"""", 1)
    said = F.inline(F.array(F.struct(F.lit("one title on several pages").alias("rule"), title.alias("words")), F.struct(F.lit("one description on several pages").alias("rule"), description.alias("words"))))
    rows = pages.select(F.col(url).alias("url"), said).where("words <> ''")
    shared = rows.groupBy("rule", "words").agg(F.count("*").alias("pages"), F.min("url").alias("first")).where("pages > 1")
    other = rows.join(shared, ["rule", "words"]).groupBy("rule", "words", "pages", "first").agg(F.min(F.when(F.col("url") > F.col("first"), F.col("url"))).alias("other"))
    return other.select("rule", "words", "pages", "first", F.coalesce("other", "first").alias("other"))


# Fixed value: the page that tells how fresh all is, which has a date.
STATUS_PAGE, DATED = "/index/coverage", r"\b20\d\d-\d\d-\d\d\b"


def undated_status(pages: DataFrame, path: str = STATUS_PAGE, url: str = "url", html: str = "html") -> DataFrame:
    """(url) of pages at the status page's path that have no date on them."""
    return pages.where((path_of(F.col(url)) == path) & ~F.coalesce(html, F.lit("")).rlike(DATED)).select(F.col(url).alias("url"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target) of every href that begins with a slash."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""href="(/[^"#?]*)"""), F.lit(1))
    return pages.select(F.col(url).alias("url"), F.explode(found).alias("target"))


def top_findings(df: DataFrame, rule: str, order: list[str], k: int = 5) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(rule).orderBy(*order))).where(F.col("place") <= k)


# Fixed value: how a page carries structured data.
STRUCTURED = r"""(?s)<script type="application/ld\+json">(.*?)</script>"""


def broken_data(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, data) of structured data that is not JSON."""
    found = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(STRUCTURED), F.lit(1))).alias("data"))
    return found.where(F.try_parse_json("data").isNull())


def path_of(url: Column) -> Column:
    """The path of a url; a url without a host is its own path."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:.*?://[^/?#]*)?([^?#]*)", 1)


def dead_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(target, pages) of links to addresses that no page has, with the number of pages that have them."""
    have = pages.select(path_of(F.col(url)).alias("target")).distinct()
    return links(pages, url, html).distinct().join(have, "target", "left_anti").groupBy("target").agg(F.count("*").alias("pages"))


def unlisted_pages(pages: DataFrame, listed: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(rule, target): linked addresses that are not listed(path), and listed ones without a page."""
    linked = links(pages, url, html).select("target").distinct().join(listed.select(F.col("path").alias("target")), "target", "left_anti")
    missing = listed.select(F.col("path").alias("target")).distinct().join(pages.select(path_of(F.col(url)).alias("target")), "target", "left_anti")
    return linked.select(F.lit("linked, not listed").alias("rule"), "target").union(missing.select(F.lit("listed, no page"), "target"))
