"""Exact dedup: counting quotient filters find repeated fingerprints, bytes confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import WHITE_SPACE, materialise, release_state, sized_broadcast

#: Expected fingerprints in one block of the merged filter; the number of blocks grows with the rows.
BLOCK_ROWS = 1 << 16


class QuotientFilter:
    """Counting quotient filter of 64-bit fingerprints: runs of sorted remainders under their quotients.

    Quotient and remainder together are the whole fingerprint, so merging two filters adds the counts
    of equal remainders within equal quotients and loses nothing.
    """

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.quotients, self.runs, self.remainders, self.counts, self.bits = quotients, runs, remainders, counts, bits

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = 16) -> QuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        return cls._of_sorted(fingerprints[order], np.ones(len(order), np.int64) if counts is None else counts[order], bits)

    @classmethod
    def _of_sorted(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        keys, totals = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        shift = np.uint64(64 - bits)
        quotients, runs = np.unique(keys >> shift, return_counts=True)
        return cls(quotients.astype(np.uint32), runs.astype(np.uint32), keys & ((np.uint64(1) << shift) - np.uint64(1)), totals, bits)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients.astype(np.uint64), self.runs) << np.uint64(64 - self.bits)) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' runs interleaved: remainders stay sorted under their quotients and equal ones add up."""
        mine, theirs = self.fingerprints(), other.fingerprints()
        at = np.searchsorted(mine, theirs)
        return QuotientFilter._of_sorted(np.insert(mine, at, theirs), np.insert(self.counts, at, other.counts), self.bits)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """All of them, two by two."""
        while len(filters) > 1:
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) & ~1 :]
        return filters[0]

    def parts(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.quotients.tobytes(), self.runs.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def from_parts(cls, quotients: bytes, runs: bytes, remainders: bytes, counts: bytes, bits: int = 16) -> QuotientFilter:
        return cls(np.frombuffer(quotients, np.uint32), np.frombuffer(runs, np.uint32), np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64), bits)


def normal_bytes(text: str | None) -> bytes:
    """The text in UTF-8 without white space; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(None, WHITE_SPACE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_state()
    for b in batches:
        raw = [(x or b"").translate(None, WHITE_SPACE) for x in b.column(1).cast(pa.binary()).to_pylist()]
        prints = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)).view(np.int64)
        sha = [hashlib.sha256(x).hexdigest() for x in raw]
        points = pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints), pa.array(sha, pa.string()), points], ["doc_id", "fp", "sha", "points"])


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release_state()
    for b in batches:
        raw = [(x or b"").translate(None, WHITE_SPACE) for x in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "norm"])


def _filters(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = [b.column(0).to_numpy().view(np.uint64) for b in batches]
        keys = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        blocks = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        rows = []
        for block in np.unique(blocks):
            rows.append((int(block), *QuotientFilter.of(keys[blocks == block] << np.uint64(bits)).parts()))
        names = ["block", "quotients", "runs", "remainders", "counts"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return build


def _merge(bits: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        whole = QuotientFilter.merged([QuotientFilter.from_parts(r["quotients"], r["runs"], r["remainders"], r["counts"]) for r in rows])
        again = whole.counts > 1
        keys = whole.fingerprints()[again] >> np.uint64(bits)
        if bits:
            keys |= np.uint64(rows[0]["block"]) << np.uint64(64 - bits)
        return pa.table({"fp": keys.view(np.int64), "n": whole.counts[again]})

    return merge


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the 64-bit fingerprints in column fp that occur more than once among so many rows.

    Every partition builds its filter in blocks of high bits, so a hot fingerprint leaves a partition
    as one counter; a block is merged in one task and has about BLOCK_ROWS fingerprints at any scale.
    """
    bits = max(0, int(rows / BLOCK_ROWS).bit_length())
    built = prints.select("fp").mapInArrow(_filters(bits), "block long, quotients binary, runs binary, remainders binary, counts binary")
    return built.groupBy("block").applyInArrow(_merge(bits), "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is deleted. Of equal texts the row with the most
    code points, then the smallest id, stays. A null text counts as empty, and all empty texts are
    equal. Rows that repeat an id are rows of their own: each counts, and both are kept if their id
    stays. A null id is never the one that stays unless the whole group has none. An empty table gives
    an empty result; other columns are ignored. Fingerprints are 64-bit xxh3 values of normalised
    bytes; those counted more than once go on to byte verification, which fails loudly if two
    different texts share fingerprint and SHA-256.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = materialise(texts.mapInArrow(_digests, "doc_id long, fp long, sha string, points long"), "digests")
    again = materialise(repeated_fingerprints(seen, seen.count()), "repeated")
    routed = materialise(seen.join(sized_broadcast(again.select("fp")), "fp", "left_semi"), "routed")
    best = F.max(F.struct(F.col("doc_id").isNotNull(), "points", (-F.col("doc_id")).alias("neg"))).alias("best")
    groups = routed.groupBy("fp", "sha").agg(best, F.count("*").alias("size"))
    named = texts.join(sized_broadcast(routed.select("doc_id").where("doc_id is not null").distinct()), "doc_id", "left_semi")
    bytes_of = named.unionByName(texts.where("doc_id is null")).mapInArrow(_norms, "doc_id long, norm binary")
    proof = bytes_of.groupBy(F.lower(F.sha2("norm", 256)).alias("sha")).agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    same = F.when(F.coalesce(F.col("low") == F.col("high"), F.lit(True)), True).otherwise(F.raise_error(F.lit("different texts share a SHA-256 value")))
    held = groups.join(proof.select("sha", same.alias("same")), "sha", "left").where(F.coalesce("same", F.lit(True)))
    held = materialise(held.select("fp", "sha", (-F.col("best.neg")).alias("keep_id"), "size"), "groups")
    out = seen.join(sized_broadcast(held), ["fp", "sha"], "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"), F.col("sha").alias("text_sha256"))
