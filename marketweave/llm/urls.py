"""URL filters: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weight at which terms reject a url. A strict term has it alone; soft terms need several different ones, one of them with at least the weight of a subject.
REJECT, SUBJECT = 4, 2

#: Terms that reject a url by themselves, in English, German, French and Spanish.
STRICT = (
    "casino casinos roulette blackjack baccarat jackpot jackpots sportsbook bookmaker free-bets poker-online spielautomaten wettbonus tragaperras apuestas-online "
    "porn porno pornos pornhub xxx sexcam sexcams camgirl camgirls hentai milf nudes striptease webcam-sex adult-chat sexkontakte plan-cul "
    "viagra cialis levitra tramadol xanax cheap-pills no-prescription rezeptfrei-kaufen sans-ordonnance sin-receta "
    "warez keygen keygens torrents nulled cracked-software free-movies-online telecharger-gratuit "
    "spam-farm link-farm linkfarm seo-links buy-backlinks buy-followers essay-mill payday-loan payday-loans get-rich-quick"
).split()
#: Terms that reject a url only together, and their weights: of subjects, and of lures, which say nothing by themselves.
SOFT = {
    3: "adult sex sexy gambling lottery replica counterfeit escorts torrent crack serial slots betting erotik sexe loteria".split(),
    2: (
        "bet bets bingo poker bonus win winner prize prizes crypto forex loan loans pills pharmacy pill drugs dating singles cams nude spam clickbait backlinks followers popunder iptv apk hack cheats proxy "
        "wetten gluecksspiel kredit kredite rencontres paris-sportifs apuestas casadeapuestas prestamo prestamos citas"
    ).split(),
    SUBJECT - 1: (
        "free best now online live vip slim detox offer offers gift gifts instant fast secret tricks watch cash earn money rich cheap cheapest discount coupon deal deals sale buy order hot girls chat download mp3 investment trading "
        "gratis kostenlos billig kaufen sofort gewinnen gratuit gratuits acheter gagner barato comprar ganar dinero rapido"
    ).split(),
}

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def weights(strict: list[str] = STRICT, soft: dict[int, list[str]] = SOFT) -> dict[str, int]:
    """Every term's weight; a strict one has that of a rejection."""
    return {t: w for w, terms in soft.items() for t in terms} | dict.fromkeys(strict, REJECT)


def vocabulary(terms: dict[str, int]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term, weight in terms.items():
        made.add_word(term, (term, weight))
    made.make_automaton()
    return made


def judged(url: str, automaton: ahocorasick.Automaton) -> bool:
    """True to reject: the weights of the different terms between boundaries, where no letter or digit touches them, reach REJECT, and not by lures alone.

    Percent-encoded bytes are read as what they stand for.
    """
    low, met = unquote(url).lower(), {}
    for end, (term, weight) in automaton.iter(low):
        begin = end - len(term)
        if (begin < 0 or not low[begin].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
            if weight >= REJECT:
                return True
            met[term] = weight
    return sum(met.values()) >= REJECT and max(met.values()) >= SUBJECT


def _verdicts(terms: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary(terms)
        for b in batches:
            bad = [bool(u) and judged(u, automaton) for u in b.column(1).to_pylist()]
            cols = [b.column(0), b.column(2), b.column(3), b.column(4), pc.if_else(pa.array(bad, pa.bool_()), "block", "allow")]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "said"])

    return run


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filter_urls(pages: DataFrame, rules=RULES, terms: dict[str, int] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (host
    and path together, then the longer host) wins. Without a rule, one strict term or distinct soft ones whose
    weights sum to REJECT, one of them a subject, block, all between boundaries; terms gives each its weight. A null url, or one without "://", has empty host and path; a
    null url is allowed. Repeated rows are judged alike; an empty table gives an empty result; other
    columns are ignored. Rules are a small constant list, compiled into the plan.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    rule = F.lit(None).cast("string")
    for of, start, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((F.col("host") == of) | F.col("host").endswith("." + of)) & F.col("path").startswith(start)
        rule = F.when(fits, F.lit(of + start)).otherwise(rule)
    by_rule = F.lit(None).cast("string")
    for of, start, what in rules:
        by_rule = F.when(F.col("rule") == of + start, F.lit(what)).otherwise(by_rule)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"))
    rows = rows.mapInArrow(_verdicts(weights() if terms is None else terms), "page_id long, host string, path string, rule string, said string")
    return rows.select("page_id", "host", "path", "rule", F.coalesce(by_rule, "said").alias("verdict"))
