"""Near-duplicate documents: MinHash bands propose links, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.functions import ordered
from marketweave.llm.common import materialise, release_state, sized_broadcast
from marketweave.llm.components import components

#: Bands and rows a band. A pair of similarity 0.8 shares no band with probability (1 - 0.8^6)^48, under 1e-6.
BANDS, ROWS = 48, 6
#: Kept low bytes of the minima agree by chance in one place of 256; a pair of similarity 0.8 falls this far below it once in 1e9.
SLACK = 0.16
#: Pairs of one leader, shingles of one block of strays, and rows that one task holds against a block, about.
PAIRS_A_TASK, BLOCK_SHINGLES, ROWS_A_TASK = 10_000, 2_000_000, 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def universal_hashes(n: int, seed: int = 20_259) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (a, b) of n multiply-shift functions h(x) = (a x + b mod 2^64) >> 32, a odd."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_set(raw: bytes | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words the whole sequence is one shingle."""
    found = (raw or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every hash function over the set, whatever its size, in blocks that fit the cache."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _digest(shingles: bytes) -> bytes:
    """What tells a whole set from others."""
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        a, b = universal_hashes(BANDS * ROWS)
        band = np.arange(1, BANDS + 1, dtype=np.uint64)
        for batch in batches:
            sizes, digests, keys, low = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(raw, words)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), keys.append(None), low.append(None)
                    continue
                sig = signature(s, a, b)
                key = band.copy()
                for k in range(ROWS):
                    key = (key ^ sig[k::ROWS]) * _MIX
                    key ^= key >> np.uint64(31)
                digests.append(_digest(s.tobytes()))
                keys.append(key.view(np.int64))
                low.append(sig.astype(np.uint8).tobytes())
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "keys", "low"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        for batch in batches:
            sets = [shingle_set(raw, words).tobytes() for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "shingles"])

    return run


def _likely(percent: int):
    floor = BANDS * ROWS * ((percent / 100 - SLACK) * 255 + 1) / 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low_a, low_b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4))
            yield batch.select([0, 1, 2]).filter(pa.array((low_a == low_b).sum(axis=1) >= floor))

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class Strays:
    """An inverted index of a block of shingle sets that gives the overlap of any set with each of them.

    Shingles that most sets of the block have are its core. A set is held as what it lacks of the core and what
    it has beyond it, and the index is over these: near copies of one text differ by few shingles, so lists
    stay short where the sets themselves are nearly equal.
    """

    def __init__(self, ids: list[int], of: list[int], sets: list[np.ndarray]):
        self.ids, self.of = np.array(ids, np.int64), np.array(of, np.int64)
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        shingles, counts = np.unique(np.concatenate(sets), return_counts=True)
        self.core = shingles[2 * counts > len(sets)]
        lacks, beyond = zip(*map(self._split, sets), strict=True)
        self.in_core = len(self.core) - np.fromiter(map(len, lacks), np.int64, len(sets))
        self.lists = [self._index(lacks), self._index(beyond)]

    def _split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.setdiff1d(self.core, s, assume_unique=True), np.setdiff1d(s, self.core, assume_unique=True)

    @staticmethod
    def _index(parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(np.arange(len(parts)), list(map(len, parts)))[order]

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Sizes of the intersections: the core less what either lacks, plus what both lack and what both have beyond it."""
        parts = self._split(s)
        out = self.in_core - len(parts[0])
        for part, (values, places) in zip(parts, self.lists, strict=True):
            low, high = np.searchsorted(values, part), np.searchsorted(values, part, "right")
            n = high - low
            if total := int(n.sum()):
                at = np.arange(total) + np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)
                out = out + np.bincount(places[at], minlength=len(out))
        return out


def _links(percent: int):
    """Streams (main, block, part, tag, id, component, shingles) in that order: the strays of a block (tag 0), then all rows of its crowd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_state()
        at, ids, of, sets, index = None, [], [], [], None
        for batch in batches:
            u: list[int] = []
            v: list[int] = []
            for main, block, part, tag, own, component, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if at != (main, block, part):
                    at, ids, of, sets, index = (main, block, part), [], [], [], None
                if tag == 0:
                    ids.append(own), of.append(component), sets.append(s)
                    continue
                if not ids:
                    continue  # strays are dealt by hash, and none came to this block
                index = index or Strays(ids, of, sets)
                common = index.overlaps(s)
                found = (100 * common >= percent * (index.sizes + len(s) - common)) & (index.of != component)
                if found.any():  # one link to each component tells all
                    _, first = np.unique(index.of[found], return_index=True)
                    u += index.ids[found][first].tolist()
                    v += [own] * len(first)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _crowds(still: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of open buckets, from still(key, id, n, component, main).

    Two members of a bucket both belong to the crowd of its main component, as members of it or strays.
    The strays of a crowd are a query set: blocks of them, bounded by their shingles, become an inverted index
    through which the crowd streams, itself dealt to several tasks. So a crowd's sets move once a block, and only links leave.
    """
    crowd = materialise(still.select("main", "id", "n", "component").distinct(), "crowd")
    deal = crowd.groupBy("main").agg(F.expr(f"1 + sum(if(component <> main, n, 0)) div {BLOCK_SHINGLES}").alias("blocks"), F.expr(f"1 + count(*) div {ROWS_A_TASK}").alias("parts"))
    deal = sized_broadcast(materialise(deal, "deal"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    share = lambda c: F.pmod(F.xxhash64("id"), c)
    held = crowd.join(sets.dropDuplicates(["id"]), "id").join(deal, "main")
    blocks = held.where("component <> main").withColumn("block", share("blocks")).withColumn("part", upto("parts")).withColumn("tag", F.lit(0))
    rows = held.withColumn("part", share("parts")).withColumn("block", upto("blocks")).withColumn("tag", F.lit(1))
    cols = ["main", "block", "part", "tag", "id", "component", "shingles"]
    stream = blocks.select(cols).union(rows.select(cols)).repartition("main", "block", "part").sortWithinPartitions("main", "block", "part", "tag")
    return stream.mapInArrow(_links(percent), "u long, v long").distinct()


def _numbered(named: DataFrame) -> DataFrame | None:
    """(doc_id, digest, node): a number for each set of each id, rising with the ids; None where no id has several sets, as ids are numbers enough then."""
    sets = named.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    if sets.where("low <> high").isEmpty():
        return None
    return materialise(ordered.placed(named.select("doc_id", "digest").distinct(), [], [F.col("doc_id"), F.col("digest")], "node"), "numbers")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets
    (A-Z lower-cased, words split at ASCII white space); component_id is the least id reachable and
    kept tells whether it is the row's own. A null or wordless text has an empty set and no links. Rows
    with one id are one document with the links of all of them. A row without id is linked with nothing, has a null
    component and is kept. An empty table gives an empty result; other columns are ignored.

    Equal sets are folded to their least id first. Then members are compared with one leader of their buckets,
    and where a bucket's members do not all fall in one component, with the bucket's own. These pairs must pass
    the signatures and then the whole sets. What is still open after that is searched crowd by crowd with the whole sets (_crowds),
    so no bucket is capped and no link between its members is lost. Sets are 64-bit hashes of shingles.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = materialise(texts.mapInArrow(_sketches(words), "doc_id long, n_shingles long, digest binary, keys array<long>, low binary"), "sketches")
    named = base.where("digest is not null and doc_id is not null")
    numbers = _numbered(named)
    if numbers is None:
        base = base.withColumn("node", F.col("doc_id"))
    else:
        base = materialise(base.join(numbers, ["doc_id", "digest"], "left"), "sketches")
    named = base.where("digest is not null and doc_id is not null")
    alike = named.groupBy("digest").agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    alike = materialise(alike, "alike")
    folded = named.join(sized_broadcast(alike), "digest", "left")
    nodes = folded.where("rep is null or rep = node").select(F.col("node").alias("id"), F.col("n_shingles").alias("n"), "keys", "low")

    rows = nodes.select("id", "n", F.explode("keys").alias("key"))
    of_bucket = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("l"), F.max("id").alias("last")).where("l.id < last")
    shared = materialise(of_bucket.select("key", F.col("l.id").alias("lead"), F.col("l.n").alias("lead_n")), "shared")
    live = materialise(rows.join(sized_broadcast(shared), "key"), "live")
    ids = materialise(live.select("id").distinct(), "candidates")
    low = materialise(nodes.select("id", "low").join(sized_broadcast(ids), "id", "left_semi").dropDuplicates(["id"]), "signatures")
    sought = ids.withColumnRenamed("id", "doc_id") if numbers is None else materialise(numbers.join(ids, numbers.node == ids.id, "left_semi").select("doc_id").distinct(), "sought")
    sets = texts.join(sized_broadcast(sought), "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, digest binary, shingles binary")
    sets = sets.select(F.col("doc_id").alias("id"), "shingles") if numbers is None else sets.join(numbers, ["doc_id", "digest"]).join(ids.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("id"), "shingles").dropDuplicates(["id"])
    sets = materialise(sets, "sets")
    #: Sets of such different sizes are not alike whatever they hold.
    comparable = F.expr(f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs(u, v), those that pass signatures and sets. A leader met by many rows is dealt to several tasks."""
        pairs = materialise(pairs, "pairs")
        hot = pairs.groupBy("u").agg(F.expr(f"1 + count(*) div {PAIRS_A_TASK}").alias("salts")).where("salts > 1")
        hot = materialise(hot.withColumnRenamed("u", "id"), "hot")
        salted = pairs.join(sized_broadcast(hot.withColumnRenamed("id", "u")), "u", "left")
        salted = salted.select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), "salts"), F.lit(0)).cast("long").alias("salt"))

        def both(col: str, of: DataFrame, p: DataFrame) -> DataFrame:
            spread = of.join(sized_broadcast(hot), "id", "left").select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.col(col).alias("x"))
            p = p.join(spread, ["u", "salt"])
            return p.join(of.select(F.col("id").alias("v"), F.col(col).alias("y")), "v").select("u", "v", "salt", "x", "y")

        likely = materialise(both("low", low, salted).mapInArrow(_likely(percent), "u long, v long, salt long"), "likely")
        return both("shingles", sets, likely).mapInArrow(_confirmed(percent), "u long, v long").distinct()

    def labelled(edges: DataFrame) -> DataFrame:
        """The rows of buckets whose members lie in several components, with the component that has most of them."""
        got = materialise(components(edges), "labels")
        with_label = live.join(sized_broadcast(got), "id", "left").withColumn("component", F.coalesce("component", "id"))
        crowd = with_label.groupBy("key", "component").agg(F.count("*").alias("n_in"))
        crowd = crowd.groupBy("key").agg(F.max_by("component", F.struct("n_in", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        return materialise(with_label.join(crowd.select("key", "main"), "key"), "open")

    first = live.where(comparable & (F.col("id") != F.col("lead"))).groupBy("id").agg(F.min("lead").alias("lead"))
    first = materialise(first.select(F.col("lead").alias("u"), F.col("id").alias("v")), "first")
    edges = materialise(linked(first), "edges")
    still = labelled(edges)
    if not still.isEmpty():
        names = still.select("id", "component").distinct().select(F.col("id").alias("lead"), F.col("component").alias("lead_component"))
        more = still.where(comparable).select("id", "component", "lead").distinct().join(names, "lead").where("component <> lead_component")
        more = more.select(F.col("lead").alias("u"), F.col("id").alias("v")).join(first, ["u", "v"], "left_anti")
        edges = materialise(edges.union(linked(more)), "edges")
        still = labelled(edges)
    if not still.isEmpty():
        edges = materialise(edges.union(_crowds(still, sets, percent)), "edges")

    if numbers is not None:  # the sets of one id are one document's
        same = numbers.join(sized_broadcast(alike), "digest", "left").select("doc_id", F.coalesce("rep", "node").alias("v"))
        first = same.groupBy("doc_id").agg(F.min("v").alias("u"), F.max("v").alias("last")).where("u < last").select("doc_id", "u")
        edges = edges.union(same.join(first, "doc_id").where("u < v").select("u", "v"))
    labels = materialise(components(edges), "labels")
    out = base.select("doc_id", "node", "n_shingles", "digest").join(sized_broadcast(alike), "digest", "left")
    out = out.withColumn("id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("rep")), "node")).join(sized_broadcast(labels), "id", "left")
    out = out.withColumn("component", F.coalesce("component", "id"))
    if numbers is not None:  # numbers rise with the ids, so the least number of a component is of its least id
        out = out.drop("id").join(numbers.select(F.col("node").alias("component"), F.col("doc_id").alias("id")), "component", "left").withColumn("component", F.col("id"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
