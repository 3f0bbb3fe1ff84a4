"""How the sources of a language differ in their words: smoothed shares compared by row accumulation over a term-major index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketweave.llm.common import BROADCAST_ROWS, materialise, slices

#: Distinct terms of groups that a task counts before it hands the counts on, and bytes of long texts, whose terms may be long, that it goes through before.
HELD, LONG, HELD_LONG = 400_000, 1_000_000, 64_000_000
#: Bytes of accumulators that a task holds before it hands them on, and postings scattered at once.
ACCUMULATED, AT_ONCE = 64_000_000, 1_000_000
#: Shares are whole numbers of this fraction.
SCALE = 1_000_000_000

#: Bytes of UTF-8 to those of terms: A-Z in lower case, a-z and all bytes of characters beyond ASCII as they are, and white space for the rest.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents), added up in the task by group."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = long = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in seen.items():
            cols = [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), pa.array(n.keys(), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(df.__getitem__, n), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "df"])
        seen.clear()

    for batch in slices(batches):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            n, df = seen.setdefault((lang, source), (Counter(), Counter()))
            data = text.as_py().translate(_TO_TERMS)
            words = data.split()
            before = len(n)
            n.update(words)
            df.update(set(words))
            held += len(n) - before
            long += len(data) if len(data) > LONG else 0
            if held >= HELD or long >= HELD_LONG:
                yield from counted()
                held = long = 0
    yield from counted()


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) in whole numbers; shares are at most SCALE + 1, so the square fits in 64 bits."""
    d = p - q
    return d * d // (p + q)


class Accumulator:
    """Rows of one value a peer, dense, for the groups of several languages."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int], np.ndarray] = {}
        self.bytes = 0

    def row(self, lang: str, group: int, peers: int) -> np.ndarray:
        if (lang, group) not in self.rows:
            self.rows[lang, group] = np.zeros(peers, np.int64)
            self.bytes += 8 * peers
        return self.rows[lang, group]

    def handed_on(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        for (lang, group), row in self.rows.items():
            peer = np.arange(len(row)) if whole else np.nonzero(row)[0]
            cols = [pa.array([lang] * len(peer), pa.string()), pa.array(np.full(len(peer), group, np.int32)), pa.array(peer, pa.int32()), pa.array(row[peer])]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "value"])
        self.rows, self.bytes = {}, 0


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms that two groups share add to the sum of their zero baselines.

    The rows of a block are the term-major index: a term's postings have the group, its share p of the term and its share p0 of a
    term it lacks. Each group goes through its own terms and adds, to the accumulator of every peer posted there,
    the distance of the shares less both distances to the other's baseline, which the baselines counted already.
    """
    held = Accumulator()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in dict.fromkeys(langs):
            rows = batch.filter(pa.array([x == lang for x in langs])) if len(set(langs)) > 1 else batch
            postings = rows.column(1)
            begin = postings.offsets.to_numpy().astype(np.int64)
            of, p, p0 = (postings.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            sizes = np.diff(begin)
            of, p, p0 = (x[begin[0] : begin[-1]] for x in (of, p, p0))
            begin = begin - begin[0]
            term = np.repeat(np.arange(len(sizes)), sizes)
            peers = rows.column(2)[0].as_py()
            by_group = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.diff(of[by_group], prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = by_group[lo:hi]
                row = held.row(lang, int(of[own[0]]), peers)
                room = np.cumsum(sizes[term[own]])
                for part in np.split(own, np.flatnonzero(np.diff(room // AT_ONCE)) + 1):
                    n = sizes[term[part]]
                    each = np.repeat(part, n)  # the group's posting beside every posting of the same term
                    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[term[part]], n)
                    got = distance(p[each], p[other]) - distance(p[each], p0[other]) - distance(p0[each], p[other]) + distance(p0[each], p0[other])
                    np.add.at(row, of[other], got)
                if held.bytes >= ACCUMULATED:
                    yield from held.handed_on()
    yield from held.handed_on()


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group, what its sums with all peers are as if no term were shared, in two halves that add up when mirrored.

    A group's own terms come as its distinct shares and how many terms have each: each counts by its distance to the peer's share of a
    term it lacks, beyond that of both lacking it. The latter, times all kept terms, goes with the lower group of a pair.
    """
    held = Accumulator()
    for batch in batches:
        for lang, group, own, kept, shares, peers in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            p0 = np.asarray(peers, np.int64)
            row, none = held.row(lang, group, len(p0)), distance(np.int64(own), p0)
            row[group + 1 :] += kept * none[group + 1 :]
            for s in shares or ():
                row += s["terms"] * (distance(np.int64(s["p"]), p0) - none)
            if held.bytes >= ACCUMULATED:
                yield from held.handed_on(whole=True)
    yield from held.handed_on(whole=True)


def _share(n: str, total: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 2) / (total + 2 * kept)) in decimals, so that no count overflows; null without kept terms."""
    return f"1 + (cast({SCALE} AS decimal(10, 0)) * cast({n} + 2 AS decimal(20, 0))) div nullif(cast({total} + 2 * kept AS decimal(20, 0)), 0)"


def divergence(docs: DataFrame, least_documents: int = 10, ranks: int = 10) -> DataFrame:
    """How every source of a language differs from its other sources and from the language: lang, source, part, item, value, rank.

    Terms are runs of letters (ASCII letters in lower case, and all characters beyond ASCII); a language keeps those of
    least_documents of its rows. A group's share of a kept term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)). Part `pair` has
    floor((p - q)^2 / (p + q)) summed over all kept terms for each other source, all ranks; part `term` has it, q being the language's,
    for the group's own terms with p > q, the first `ranks`. Ranks go by value from high to low, then by the item's bytes.

    A pair's sum starts from zero baselines, as if no term were shared: the distances of each one's terms to the other's
    share of a term it lacks, and of both baselines for all other terms. Shared terms correct it, scattered into one
    dense accumulator a group. Tasks hold blocks of terms and give sums, never pairs of postings.

    Nulls in text, lang and source are ''. A group without terms is listed too; a language without kept terms has pairs of value 0.
    Repeated rows count each; whole texts are read; an empty table gives an empty result; other columns are never read.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = materialise(rows.select("lang", "source").distinct(), "groups")
    # counted in the tasks first; dealt by term, so that one shuffle serves both the groups' and the language's sums
    counts = rows.mapInArrow(_terms, "lang string, source string, term string, n long, df long").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    index = counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("postings")).where(F.col("df") >= least_documents)
    index = materialise(index.select("lang", "term", "whole", "postings"), "index")

    langs = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("whole").alias("whole_total"))
    flat = index.select("lang", "term", "whole", F.inline("postings"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "whole_total"])
    numbered = numbered.withColumn("g", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("int")).withColumn("p0", F.expr(f"coalesce({_share('0', 'total')}, 1)"))
    numbered = materialise(numbered, "numbered")
    small = F.broadcast if numbered.count() <= BROADCAST_ROWS else lambda df: df  # groups, and so the vectors of a number a group
    peers = small(materialise(numbered.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "p0"))), lambda x: x.p0).alias("peers")), "peers"))

    known = flat.join(small(numbered), ["lang", "source"]).withColumn("p", F.expr(_share("n", "total")))
    shares = known.groupBy("lang", "g", "p").agg(F.count("*").alias("terms")).groupBy("lang", "g").agg(F.collect_list(F.struct("p", "terms")).alias("shares"))
    own = numbered.join(shares, ["lang", "g"], "left").join(peers, "lang")
    base = own.select("lang", "g", "p0", "kept", "shares", "peers").mapInArrow(_baselines, "lang string, a int, b int, value long")
    posted = known.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("postings")).join(peers, "lang")
    shared = posted.select("lang", "postings", F.size("peers").alias("n_peers")).mapInArrow(_scatter, "lang string, a int, b int, value long")

    mirrored = base.select("lang", F.explode(F.expr("array(struct(a, b, value), struct(b AS a, a AS b, value))")).alias("s")).select("lang", "s.*")
    sums = mirrored.unionByName(shared).where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    left, right = (small(numbered.select("lang", F.col("source").alias(name), F.col("g").alias(k))) for name, k in (("source", "a"), ("item", "b")))
    pair = sums.join(left, ["lang", "a"]).join(right, ["lang", "b"])
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    term = known.withColumn("q", F.expr(_share("whole", "whole_total"))).where("p > q")
    term = term.selectExpr("lang", "source", "'term' AS part", "term AS item", "(p - q) * (p - q) div (p + q) AS value")
    return pair.unionByName(term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks))
