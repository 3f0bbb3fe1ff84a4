"""Spelling variants of words: pivotal bigrams looked up among the rare bigrams of other words, verified in the join."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import materialise, sized_broadcast, slices

#: Distinct words and their code points that a task counts before it hands the counts on.
HELD, HELD_LETTERS = 200_000, 8_000_000
#: One document in so many of a word's, by checksum, has a letter of it left out.
DAMAGED = 199
#: Bigrams of a word's prefix: one edit touches two overlapping ones at most, so one of any three is untouched, and two of three are disjoint.
PREFIX = 3

_RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def lower(run: str) -> str:
    """The run with A-Z in lower case, other letters as they are."""
    return run.lower() if run.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def damaged(doc_id: int | None, run: str) -> str:
    """The run without one code point where the checksum of document and run says so; a null id is an empty one."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % DAMAGED else run[: h % len(run)] + run[h % len(run) + 1 :]


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, letters = Counter(), 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found, n in Counter(_RUNS.findall(text.as_py() or "")).items():
                    if len(found) >= least:
                        word = damaged(doc_id, lower(found))
                        letters += 0 if word in seen else len(word)
                        seen[word] += n
                if len(seen) >= HELD or letters >= HELD_LETTERS:
                    yield counted()
                    seen, letters = Counter(), 0
        yield counted()

    return run


def words_of(docs: DataFrame, least_letters: int, least_count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of so many code points and occurrences; counted in the tasks before anything is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_runs(least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least_count) & (F.char_length("word") >= least_letters))


def prefix(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(place in the order, position) of the word's rarest bigrams, PREFIX of them and those equal to the last."""
    grams = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = grams[min(PREFIX, len(grams)) - 1][0]
    return [g for g in grams if g[0] <= last]


def pivots(grams: list[tuple[int, int]], weight: list[int]) -> set[int]:
    """Positions of two disjoint bigrams of least total weight, by dynamic programming over the positions; weight is by place in the order.

    cheapest is the best single bigram that ends before the one at hand; with no two disjoint ones all are given.
    """
    best, pair, cheapest, waiting = None, None, None, []
    for place, at in sorted(grams, key=lambda g: g[1]):
        waiting.append((weight[place], at))
        while waiting and waiting[0][1] + 2 <= at:
            one = waiting.pop(0)
            cheapest = min(cheapest or one, one)
        if cheapest and (best is None or cheapest[0] + weight[place] < best):
            best, pair = cheapest[0] + weight[place], {cheapest[1], at}
    return pair or {at for _, at in grams}


def _keys(order: dict[str, int], weight: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = prefix(word, order)
                chosen, last, mask = pivots(grams, weight), max(grams)[0], 0
                for c in word:
                    mask |= 1 << ord(c) % 63
                for _, at in grams:
                    out.append((word, n, len(word), last, mask, at in chosen, 0, word[: at + 2]))
                    out.append((word, n, len(word), last, mask, at in chosen, 1, word[at:]))
            names = ("word", "n", "length", "last", "letters", "pivot", "side", "intact")
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], list(names))

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, of all pairs of words(word, n) that differ by one code point; words have four code points at least.

    Of two words one edit apart, the one whose prefix ends first in the order of rarity has a pivot that the
    edit leaves alone, and it is in the other's prefix. The edit is wholly after that bigram, and both words are equal up to
    its end, or wholly before it, and they are equal from its begin on: these are the position limits of the
    join's key, beside the lengths. What shares a key is verified inside the join; only links leave it.
    """
    grams = words.select(F.explode(F.array_distinct(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))"))).alias("gram")).groupBy("gram").count()
    ranked = sorted(grams.collect(), key=lambda r: (r["count"], r.gram))  # at most the square of the alphabet
    order, weight = {r.gram: i for i, r in enumerate(ranked)}, [r["count"] for r in ranked]
    keys = materialise(words.select("word", "n").mapInArrow(_keys(order, weight), "word string, n long, length int, last int, letters long, pivot boolean, side int, intact string"), "grams")
    a = keys.where("pivot").select(*(F.col(c).alias(f"a_{c}") for c in keys.columns))
    b = keys.withColumn("fits", F.explode(F.expr("array(length - 1, length, length + 1)"))).select(*(F.col(c).alias(f"b_{c}") for c in (*keys.columns, "fits")))
    likely = (F.col("a_last") <= F.col("b_last")) & (F.col("a_word") != F.col("b_word")) & (F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2)
    key = (F.col("a_side") == F.col("b_side")) & (F.col("a_length") == F.col("b_fits")) & (F.col("a_intact") == F.col("b_intact"))
    found = a.join(b, key & likely & (F.levenshtein("a_word", "b_word", 1) == 1))
    low = F.col("a_word") < F.col("b_word")
    once = found.select(*(F.when(low, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in ("word", "n")), *(F.when(low, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"other_{c}") for c in ("word", "n"))).distinct()
    both = F.explode(F.array(F.struct("word", "n", F.col("other_word").alias("other"), "other_n"), F.struct(F.col("other_word").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return once.select(both.alias("r")).select("r.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) where forms(word, root) leads in the end; steps double with every round. A form occurs five times as often, so there are no circles."""
    at = materialise(forms, "roots")
    while True:
        then = sized_broadcast(at.select(F.col("word").alias("via"), F.col("root").alias("next")))
        longer = at.join(then, at.root == then.via, "left")
        if longer.where("next is not null").isEmpty():
            return at
        at = materialise(longer.select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, times: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, of least_letters code points
    and least_count occurrences in all documents; occurrences that the checksum of `<id>:<run>` picks lose a letter first.
    form is the near word (one code point inserted, deleted or replaced) that occurs most, the smallest in code-point
    order among equals, if it occurs `times` times as often, else null, as form_n; root is where forms lead, the word itself without one.
    Null texts have no words, a null id is an empty one in the checksum; repeated rows count each; texts and words of any length
    are read whole; an empty table gives an empty result; other columns are never read.
    """
    if least_letters < 4 or times < 2:
        raise ValueError("words need four code points for two disjoint bigrams among three, forms need to be commoner")
    words = materialise(words_of(docs, least_letters, least_count, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left").withColumn("far", -F.col("best.less") >= times * F.col("n"))
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("far"), F.col("best.other")).alias("form"), F.when(F.col("far"), -F.col("best.less")).alias("form_n")), "known")
    roots = _roots(known.where("form is not null").select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
