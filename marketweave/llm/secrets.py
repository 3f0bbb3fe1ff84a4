"""Secret scans with built-in functions only: base patterns, and weak parts linked by an interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import materialise

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Prefixes of weak identifiers.
ID_PREFIXES = ("ASIA", "AIDA", "AROA", "ANPA")

#: Weak parts by role; alone they are too common to report.
WEAK = {
    "weak_id": r"(?<![A-Za-z0-9])(?:" + "|".join(ID_PREFIXES) + r")[A-Z0-9]{12,}(?![A-Za-z0-9])",
    "weak_secret": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"https?://[A-Za-z0-9][A-Za-z0-9.:-]*",
}
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}

#: Code points between two parts of one credential at most.
SCOPE = 256

#: Matches that one fold adds up; longer lists are made of several.
CHUNK = 128

_SPAN = "array<struct<start:long,kind_no:int,end:long,kind:string>>"


def _spans(text: Column, kind: str, number: int, pattern: str, least: int, when: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind_no, end, kind); those with a shorter group are dropped.

    split() gives the text between the matches, so running lengths give the places; only texts with a match
    get that far. when is a cheap test that every text with a match passes, made before the pattern runs.
    """
    hits = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("own"),
    )
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["own"] >= least, F.concat(acc["got"], F.array(span))).otherwise(acc["got"]).alias("got"))

    def begins(chunks: Column) -> Column:
        """Where each chunk begins."""
        grow = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["got"], F.array(acc["at"])).alias("got"))
        return F.aggregate(chunks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("got")), grow)["got"]

    def moved(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), s["kind_no"].alias("kind_no"), (s["end"] + by).alias("end"), s["kind"].alias("kind"))

    def placed(chunks: Column) -> Column:
        both = F.arrays_zip(chunks.alias("chunk"), begins(chunks).alias("by"))
        return F.flatten(F.transform(both, lambda b: F.transform(b["chunk"]["got"], lambda s: moved(s, b["by"]))))

    # Matches are added up within chunks and chunks are then moved to their places: a list grows by at most CHUNK appends.
    local = lambda h: F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(h, i * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).cast("long").alias("at"), none.alias("got")), step))
    return F.when(when & text.rlike(pattern), _let(_let(hits, local), placed)).otherwise(none)


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans are the whole matches, leftmost and non-overlapping per kind, as code points with an
    exclusive end: assign with a value of 6 or more characters, access of 20 or more, hex of 24 or
    more. Weak identifiers, weak secrets and endpoints are added to spans only where complementary
    parts lie within scope: an identifier near a secret, a secret near an identifier, an endpoint near
    both. A null text counts as empty; a document without finds has zero counts, the SHA-256 of the
    empty string and empty spans. Repeated rows get equal results, ties in start go by kind. An empty
    table gives an empty result; other columns are ignored. Weak parts meet in an equi-join on the blocks
    of the scope's length that each reaches, so no document's parts are all paired.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(
        F.concat(
            _spans(text, "assign", 0, ASSIGN, 6, text.contains("=") | text.contains(":"), 2),
            # A run begins at its first character, so a shorter run never hides a longer one.
            _spans(text, "access", 1, ACCESS[:-1] + "{16,}", 20, text.contains("AKIA")),
            _spans(text, "hex", 2, HEX[:-1] + "{24,}", 24, F.lit(True)),
        )
    )
    # A weak secret or an endpoint counts only beside an identifier, so texts without one are not searched for them.
    named = F.lit(False)
    for prefix in ("AKIA", *ID_PREFIXES):
        named = named | text.contains(prefix)
    weak = F.concat(*(_spans(text, kind, 3 + i, pattern, 1, named) for i, (kind, pattern) in enumerate(WEAK.items())))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), base.alias("base"), weak.alias("weak"), text.alias("text"))
    # Rows of one id and text are one to the join; the name is 128 bits of both.
    name = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")))
    found = materialise(found.withColumn("h", F.when(F.size("weak") > 0, name)).drop("text"), "secrets")

    parts = found.where("h is not null").dropDuplicates(["h"]).select("h", F.explode(F.concat("base", "weak")).alias("p")).select("h", "p.*")
    role = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))
    parts = parts.withColumn("role", role[F.col("kind")])
    # Both sides lie in all blocks they reach, so any pair within scope shares one; it meets in the first of these only.
    blocks = lambda low, high: F.sequence(F.floor(low / scope), F.floor(high / scope))
    near = parts.select("h", F.col("role").alias("by"), F.col("start").alias("s"), F.col("end").alias("e"), blocks(F.col("start") - scope, F.col("end") + scope).alias("n"))
    near = near.select("*", F.col("n")[0].alias("near_from"), F.explode("n").alias("block")).drop("n")
    asks = parts.where(F.col("kind").isin(*WEAK)).withColumn("a", blocks(F.col("start"), F.col("end")))
    asks = asks.select("*", F.col("a")[0].alias("ask_from"), F.explode("a").alias("block")).drop("a")
    met = asks.join(near, ["h", "block"]).where("block = greatest(ask_from, near_from)")
    met = met.where("role <> by and start <= e + %d and s <= end + %d" % (scope, scope))
    by = F.collect_set("by")
    linked = met.groupBy("h", "start", "kind_no", "end", "kind", "role").agg(by.alias("by"))
    linked = linked.where(F.when(F.col("role") == "endpoint", F.size("by") == 2).otherwise(F.exists("by", lambda x: x != "endpoint")))
    added = linked.groupBy("h").agg(F.collect_list(F.struct("start", "kind_no", "end", "kind")).alias("linked"))

    out = found.join(added, "h", "left")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"))
