"""Best-fit packing: combinations that fill a gap exactly first, best fit for what is left."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketweave.llm.common import materialise, trim
from marketweave.llm.tokens import REMEMBERED, encoder


def _pieces(capacity: int, end_id: int, path: str | None, remembered: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, remembered)
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for doc, coded in zip(ids, coder.ids_of([r or b"" for r in raws]), strict=True):
                coded += end
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return run


class Plan:
    """How many sequences hold which lengths, from the count of pieces of each length alone.

    A plan has at most a few entries a length, however many pieces there are.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        #: Index of the sums of two and of three available lengths. Counts only fall, so it never misses one; entries that have gone stale are struck out when met.
        self.pairs, self.triples = np.zeros(capacity + 1, bool), np.zeros(capacity + 1, bool)
        have = np.flatnonzero(self.left)
        for a in have:
            self.pairs[a + have[have <= capacity - a]] = True
        for a in have:
            self.triples[a:] |= self.pairs[: capacity + 1 - a]
        self._exact()
        self._best_fit()

    def _pair(self, total: int, used: int = 0) -> tuple[int, int] | None:
        """Two available lengths of that sum, the larger first and as large as can be; used is one length already taken once."""
        if total < 2:
            return None
        have = self.left[1:total].copy()
        if 0 < used < total:
            have[used - 1] -= 1
        ok = (have > 0) & (have[::-1] > 0)
        if total % 2 == 0 and have[total // 2 - 1] < 2:
            ok[total // 2 - 1] = False
        found = np.flatnonzero(ok)
        return (int(found[-1]) + 1, total - int(found[-1]) - 1) if len(found) else None

    def _fill(self, length: int, gap: int) -> tuple[int, ...] | None:
        """Available lengths, one, two or three, that sum to the gap beside one piece of the given length."""
        if gap == 0:
            return ()
        self.left[length] -= 1
        try:
            if self.left[gap] > 0:
                return (gap,)
            if pair := self._pair(gap):
                return pair
            if not self.triples[gap]:
                return None
            have, stale = np.flatnonzero(self.left[1:gap] > 0) + 1, True
            for c in map(int, have[self.pairs[gap - have]][::-1]):
                if pair := self._pair(gap - c, c):
                    return (c, *pair)
                if self._pair(gap - c):
                    stale = False  # c is there too few times beside the pair, or the one length already taken
                else:
                    self.pairs[gap - c] = False
            if stale and self.left[length] >= 3:
                self.triples[gap] = False
            return None
        finally:
            self.left[length] += 1

    def _exact(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                rest = self._fill(length, self.capacity - length)
                if rest is None:
                    break
                pattern = (length, *rest)
                need = {x: pattern.count(x) for x in pattern}
                times = min(int(self.left[x]) // n for x, n in need.items())
                for x, n in need.items():
                    self.left[x] -= n * times
                self.patterns.append((pattern, times))

    def _best_fit(self) -> None:
        open_: dict[int, list[list]] = {}  # gap -> [[pattern, sequences], ...]
        gaps: list[int] = []

        def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append([pattern, n])

        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                at = bisect_left(gaps, length)
                if at == len(gaps):
                    each = self.capacity // length
                    whole, rest = divmod(n, each)
                    if whole:
                        put(self.capacity - each * length, (length,) * each, whole)
                    if rest:
                        put(self.capacity - rest * length, (length,) * rest, 1)
                    self.left[length] = 0
                    break
                gap = gaps[at]
                pattern, held = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
                each = gap // length
                whole = min(held, n // each)
                if whole:
                    put(gap - each * length, pattern + (length,) * each, whole)
                    rest = 0
                else:
                    rest = n
                    put(gap - rest * length, pattern + (length,) * rest, 1)
                    whole, each = 1, rest
                self.left[length] -= whole * each
                if held > whole:
                    put(gap, pattern, held - whole)
        for entries in open_.values():
            self.patterns += [(tuple(p), n) for p, n in entries]

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, count, first sequence, offset): the pieces of a length with these ranks go there in order."""
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, times in self.patterns:
            at = 0
            for length in pattern:
                rank = taken.get(length, 0)
                rows.append((length, rank, times, sequence, at))
                taken[length] = rank + times
                at += length
            sequence += times
        return rows


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, vocabulary: str | None = None, remembered: int = REMEMBERED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text, then end_id; a null or empty text is end_id alone. Only
    documents longer than the capacity are cut. Rows that repeat an id are packed each; a null id is
    carried along; an empty table gives an empty result; other columns are ignored.

    Only the count of pieces of each length, at most capacity rows, reaches the driver, which plans from
    it; remembered bounds the chunks in a worker's memory and not the result. Pieces then take the places of their length in the order of (doc_id, piece). Ranks come from
    sorted ranges of all pieces and their counts, so a very common length is spread over many tasks.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialise(texts.mapInArrow(_pieces(capacity, end_id, vocabulary, remembered), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Plan(counts, capacity).slots()

    part = F.spark_partition_id()
    ordered = materialise(pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece").withColumn("part", part), "ordered")
    before = ordered.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    in_part = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "start")) - 1
    ranked = ordered.withColumn("in_part", in_part).join(before.select("length", "part", "base"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("in_part"))

    # Places of one length are consecutive ranges of ranks: the range of a rank is the last that begins at or before it.
    first = F.col("first")
    places = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, offset long")
    of_length = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct(first, "n", "sequence", "offset"))).alias("places"))
    ranked = ranked.join(F.broadcast(of_length), "length")
    place = F.element_at(F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["first"] + p["n"])), 1)
    ranked = ranked.withColumn("place", place)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place.sequence") + F.col("rank") - F.col("place.first")).alias("sequence_id"), F.col("place.offset").alias("offset"))
