"""Substring dedup: recurring passages become sharded Aho-Corasick automata that find every occurrence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import forget, materialise, materialise_by, sized_broadcast
from marketweave.llm.wordcodes import FEW, SIZE, Crowd, WordCodes, equal_before, equal_from

#: Words of an anchor. Equal windows have equal anchors: the least hash of so many consecutive words in the window.
ANCHOR = 6
#: Recurring windows in one automaton, and routed segments that one task streams through it, about.
SHARD_WINDOWS, STREAM_ROWS = 50_000, 8_000
#: Words hashed together, and bytes of lists that are broadcast at most.
AT_ONCE, BROADCAST_BYTES = 250_000, 8_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPANS = "array<struct<start:long,end:long>>"


def _portions(raws: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]], np.ndarray, np.ndarray]]:
    """The texts in turn, some AT_ONCE words together: (place of the first, words of each, hashes of all, text of each word)."""
    words: list[list[bytes]] = []
    first = n = 0
    for i, raw in enumerate(raws, 1):
        words.append((raw or b"").split())
        n += len(words[-1])
        if n >= AT_ONCE or i == len(raws):
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, n)
            yield first, words, h, np.repeat(np.arange(len(words)), list(map(len, words)))
            words, first, n = [], i, 0


def _whole(text: np.ndarray, size: int) -> np.ndarray:
    """Whether the run of so many words from each place lies in one text."""
    return text[: max(0, len(text) - size + 1)] == text[size - 1 :]


def _begins(words: list[list[bytes]]) -> np.ndarray:
    return np.r_[0, np.cumsum(list(map(len, words)))]


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of so many consecutive words."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(32)
    return out


def _window_anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the window at each place."""
    size = min(ANCHOR, window)
    runs, n = _runs(h, size), len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = runs[:n].copy()
    for k in range(1, window - size + 1):
        np.minimum(least, runs[k : k + n], out=least)
    return least


def _ranges(mask: np.ndarray) -> np.ndarray:
    """[begin, end) of the runs of true values."""
    return np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0])).reshape(-1, 2)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, h, text in _portions(batch.column(1).cast(pa.binary()).to_pylist()):
                found, kept = _window_anchors(h, window), _whole(text, window)
                kept[1:] &= (found[1:] != found[:-1]) | (text[1 : len(kept)] != text[: len(kept) - 1])
                ends = np.r_[0, np.cumsum(np.bincount(text[: len(kept)][kept], minlength=len(words)))]
                cols = [
                    batch.column(0).slice(at, len(words)),
                    pa.array(list(map(len, words)), pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[kept].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "digest", "anchors"])

    return run


def _segments(window: int):
    """Stretches of a text whose windows have one of its shared anchors: (doc_id, start, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, words, h, text in _portions(batch.column(1).cast(pa.binary()).to_pylist()):
                # An anchor that one of these texts shares is a shared one for all of them.
                shared = np.unique(batch.column(2).slice(at, len(words)).flatten().to_numpy().view(np.uint64))
                out: list[list] = [[], [], []]
                if len(shared) and len(h) >= window:
                    begin = _begins(words)
                    for a, b in _ranges(_among(_window_anchors(h, window), shared) & _whole(text, window)).tolist():
                        i = int(text[a])
                        start = a - int(begin[i])
                        out[0].append(docs[at + i]), out[1].append(start), out[2].append(b" ".join(words[i][start : start + b - a + window - 1]))
                cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "text"])

    return run


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted others."""
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy()
            for at, _, h, text in _portions(batch.column(2).cast(pa.binary()).to_pylist()):
                whole = _whole(text, window)
                yield pa.RecordBatch.from_arrays([pa.array(_runs(h, window)[whole].view(np.int64)), pa.array(docs[at + text[: len(whole)][whole]])], ["w", "doc_id"])

    return run


def _passages(window: int):
    """The recurring passages of the documents in which they come first: (shard, start, doc_id, text)."""

    def owned(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return (windows ^ (docs.view(np.uint64) * _MIX)) * _MIX

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, docs, starts = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.zeros(0, int)  # a document's segments mostly follow each other
            own = batch.column(4).take(pa.array(new))
            known = np.sort(owned(own.flatten().to_numpy().view(np.uint64), np.repeat(docs[new], own.value_lengths().to_numpy())))
            out: list[list] = [[], [], [], []]
            for at, words, h, text in _portions(batch.column(3).cast(pa.binary()).to_pylist()):
                if not len(known) or len(h) < window:
                    continue
                begin, whole = _begins(words), _whole(text, window)
                first = _among(owned(_runs(h, window), docs[at + text[: len(whole)]]), known) & whole
                for a, b in _ranges(first).tolist():
                    i = int(text[a])
                    start = a - int(begin[i])
                    for col, v in zip(out, (int(shards[at + i]), int(docs[at + i]), int(starts[at + i]) + start, b" ".join(words[i][start : start + b - a + window - 1])), strict=True):
                        col.append(v)
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "doc_id", "start", "text"])

    return run


class PassageAutomaton:
    """Finds every occurrence of windows of recurring passages by phrases that lie at regular places in them.

    A window of so many words holds a whole phrase at a multiple of the phrase's length whatever its
    place in the passage, so each common window is met through a phrase and grown word by word to the whole
    common stretch. That needs a small part of the nodes that all windows would.
    """

    def __init__(self, window: int):
        self.window, self.phrase = window, (window + 1) // 2
        self.codes = WordCodes()
        self.passages: list[tuple[str, int]] = []
        self.places: dict[str, list[tuple[int, int]]] = {}
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, words: list[bytes], owner: int) -> None:
        coded = self.codes.learned(words)
        for at in range(0, len(words) - self.phrase + 1, self.phrase):
            self.places.setdefault(coded[SIZE * at : SIZE * (at + self.phrase)], []).append((len(self.passages), at))
        self.passages.append((coded, owner))

    def find(self, words: list[bytes], doc: int) -> list[tuple[int, int]]:
        """Stretches of the words that windows cover which passages of documents with smaller ids have too.

        Stretches that touch are joined. Where a stretch is known already, only phrases near its ends are followed,
        and only to passages that reach beyond it, so a text that repeats itself costs no more than its length for
        each passage.
        """
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            coded = [c for c, _ in self.passages]
            for phrase, places in self.places.items():
                self.automaton.add_word(phrase, places if len(places) <= FEW else Crowd(places, coded, self.phrase, self.window))
            if self.places:
                self.automaton.make_automaton()
        if not self.places:
            return []
        text = self.codes.of(words)
        n, phrase, window = len(words), self.phrase, self.window
        seen: dict[tuple[int, int], int] = {}
        out: list[tuple[int, int]] = []
        begin = end = 0  # the last stretch found, grown by what touches it
        for last, places in self.automaton.iter(text):
            if (last + 1) % SIZE:
                continue  # it begins inside a word's code
            first = (last + 1) // SIZE - phrase
            if begin + window <= first <= end - window:
                continue  # all that goes beyond the stretch has a phrase nearer to one of its ends
            covered = begin + window <= first < end  # nothing new to the left
            for passage, at in places if isinstance(places, list) else places.met(text, first):
                coded, owner = self.passages[passage]
                shift = at - first
                top = min(n, len(coded) // SIZE - shift)
                if owner >= doc or ((covered or begin <= max(0, -shift)) and top <= end):
                    continue  # no earlier document's, or within the stretch however far it goes
                line = (passage, -shift)
                if seen.get(line, 0) > first:
                    continue
                low = first - equal_before(text, first, coded, at, min(first, at, window if covered else n))
                if begin <= low and top <= end:
                    continue
                high = first + equal_from(text, first, coded, at, top - first)
                seen[line] = high
                if high - low < window:
                    continue
                if out and low <= end:
                    begin, end = min(begin, low), max(end, high)
                    out[-1] = (begin, end)
                else:
                    begin, end = low, high
                    out.append((low, high))
        return out


def _locate(window: int):
    """Streams (shard, salt, tag, doc_id, start, text) in that order: passages (tag 0), then segments (tag 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton = None, PassageAutomaton(window)
        for batch in batches:
            ids, spans = [], []
            for shard, salt, tag, doc, start, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5).cast(pa.binary()).to_pylist(), strict=True):
                if at != (shard, salt):
                    at, automaton = (shard, salt), PassageAutomaton(window)
                if tag == 0:
                    automaton.add(raw.split(), doc)
                elif found := automaton.find(raw.split(), doc):
                    ids.append(doc)
                    spans.append([{"start": start + a, "end": start + b} for a, b in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind)], ["doc_id", "spans"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, removed, kept, texts = [], [], [], []
        for raw, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (raw or b"").split()
            keep = np.ones(len(words), bool)
            for s in spans:
                keep[s["start"] : s["end"]] = False
            left = b" ".join([w for w, k in zip(words, keep, strict=True) if k])
            digests.append(hashlib.sha256(b" ".join(words)).digest())
            removed.append(int(len(words) - keep.sum()))
            kept.append(hashlib.sha256(left).hexdigest())
            texts.append(left)
        cols = [batch.column(0), pa.array(digests, pa.binary()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "n_removed", "kept_sha256", "kept"])


def _bytes_of_lists(df: DataFrame, col: str, each: int) -> int:
    """Size of a materialised table of ids and lists, about."""
    r = df.agg(F.count("*").alias("rows"), F.sum(F.size(col)).alias("entries")).first()
    return 40 * r.rows + each * (r.entries or 0)


def repeated_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, str]:
    """(documents, whole copies, spans, candidates, table): what repeats words of documents with smaller ids.

    documents has doc_id, n_words and the SHA-256 digest of the words joined by spaces; whole copies has
    the digests that repeat, with the first id; spans has, by document that is no whole copy, the ranges
    of words to remove; candidates are the texts that may have spans, bucketed by document so that the join with
    spans moves no text again, and table is their name in the catalogue, for forget(). Windows are looked up by anchors first, which are a quarter as many; only
    documents that share an anchor are read again, only their windows around shared anchors are counted, and only
    their segments are streamed, through the automata of the documents in which their windows come
    first: other text has no recurring window, and whole copies go by their digests. A much-visited automaton is streamed by several tasks.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = materialise(texts.mapInArrow(_anchors(window), "doc_id long, n_words long, digest binary, anchors array<long>"), "anchors")
    long_enough = base.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    copies = materialise(long_enough.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "copies")
    single = long_enough.join(sized_broadcast(copies), "digest", "left").where("first is null or first = doc_id")

    anchors = single.select("doc_id", F.explode("anchors").alias("a"))
    shared = materialise(anchors.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a"), "shared")
    sharing = materialise(anchors.join(sized_broadcast(shared), "a").groupBy("doc_id").agg(F.collect_set("a").alias("shared")), "sharing")
    if _bytes_of_lists(sharing, "shared", 8) <= BROADCAST_BYTES:
        candidates = texts.join(F.broadcast(sharing), "doc_id").repartition("doc_id")
    else:
        candidates = texts.join(sharing.hint("merge"), "doc_id")
    candidates, table = materialise_by(candidates, "candidates", "doc_id")
    segments, stretches = materialise_by(candidates.select("doc_id", "text", "shared").mapInArrow(_segments(window), "doc_id long, start long, text string"), "segments", "doc_id")

    try:
        windows = segments.mapInArrow(_windows(window), "w long, doc_id long")
        repeated = materialise(windows.groupBy("w").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").select("w", "owner"), "repeated")
        own = F.collect_set(F.when(F.col("doc_id") == F.col("owner"), F.col("w"))).alias("own")
        routes = materialise(windows.join(sized_broadcast(repeated), "w").groupBy("doc_id", "owner").agg(own), "routes")

        shards = 1 + repeated.count() // SHARD_WINDOWS
        shard = F.pmod(F.xxhash64("owner"), F.lit(shards))
        owners = routes.where("doc_id = owner").select("doc_id", shard.alias("shard"), "own")
        passages = owners.join(segments, "doc_id").select("shard", "doc_id", "start", "text", "own").mapInArrow(_passages(window), "shard long, doc_id long, start long, text string")
        visits = routes.where("doc_id > owner").select("doc_id", shard.alias("shard")).distinct()
        visits = materialise(visits.join(segments, "doc_id"), "visits")
        salts = materialise(visits.groupBy("shard").agg(F.expr(f"1 + count(*) div {STREAM_ROWS}").alias("salts")), "salts")
        salts = sized_broadcast(salts)
        patterns = passages.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("tag"), "doc_id", "start", "text")
        streams = visits.join(salts, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).alias("salt"), F.lit(1).alias("tag"), "doc_id", "start", "text")
        stream = patterns.union(streams).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "tag")
        found = stream.mapInArrow(_locate(window), f"doc_id long, spans {_SPANS}")
        spans = materialise(found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    except BaseException:
        forget(docs.sparkSession, table)
        raise
    finally:
        forget(docs.sparkSession, stretches)
    return base.select("doc_id", "n_words", "digest"), copies, spans, candidates, table


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Words are what stands between ASCII white space. A word goes if a window of so many consecutive words that covers
    it also starts in a document with a smaller id, judged on the input. A null text has no words; one
    shorter than a window loses nothing. Rows with one id are one document for this and each gives a
    row; a row without id is neither compared nor changed. An empty table gives an empty result; other
    columns are ignored. Anchors and windows are compared by 64-bit hashes, then passages word by word.
    """
    base, copies, spans, candidates, table = repeated_spans(docs, window, id_col, text_col)
    try:
        spans = F.broadcast(spans) if _bytes_of_lists(spans, "spans", 40) <= BROADCAST_BYTES else spans
        changed = candidates.select("doc_id", "text").join(spans, "doc_id").mapInArrow(_kept, "doc_id long, digest binary, n_removed long, kept_sha256 string, kept string")
        changed = materialise(changed.drop("kept").dropDuplicates(["doc_id", "digest"]), "changed")
    finally:
        forget(docs.sparkSession, table)
    out = base.join(sized_broadcast(copies), "digest", "left").join(sized_broadcast(changed), ["doc_id", "digest"], "left")
    copy = F.col("first") < F.col("doc_id")
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long")
    kept = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))
