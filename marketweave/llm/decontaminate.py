"""Benchmark decontamination: one Aho-Corasick automaton over the words of the test items, grown to their windows."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import materialise, sized_broadcast, slices, worker_state
from marketweave.llm.wordcodes import FEW, SIZE, Crowd, WordCodes, equal_before, equal_from

#: Characters of test items in one automaton, about 100 MB of a worker; a larger benchmark is scanned for in blocks of about this size.
BLOCK_CHARS = 2_000_000

#: Bytes to normalised bytes, one to one: A-Z lower-cased, ASCII other than 0-9 and a-z to a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split(b" ")


class ItemAutomaton:
    """Finds the windows of test items in a text's words.

    A window holds a whole phrase of half its length that lies at a multiple of that length in the item, so the phrases of
    an item, which have each of its words once, are enough to meet every window; what is met is grown word by word
    to the whole common stretch. An item shorter than a window is one pattern.
    """

    def __init__(self, rows: list[tuple[str, str | None]], window: int):
        self.window, self.phrase = window, (window + 1) // 2
        self.codes = WordCodes()
        self.items: list[tuple[str, str]] = []
        places: dict[str, tuple[int, list[tuple[int, int]]]] = {}
        for item, text in rows:
            words = [w for w in words_of(text) if w]
            coded, size = self.codes.learned(words), self.phrase if len(words) >= window else len(words)
            for at in range(0, len(words) - size + 1, size) if size else ():
                places.setdefault(coded[SIZE * at : SIZE * (at + size)], (size, []))[1].append((len(self.items), at))
            self.items.append((item, coded))
        self.automaton = ahocorasick.Automaton()
        coded = [c for _, c in self.items]
        for pattern, (size, of) in places.items():
            crowded = len(of) > FEW and size == self.phrase < window  # where a pattern is a whole item, all that have it are met
            self.automaton.add_word(pattern, (size, Crowd([p for p in of if len(coded[p[0]]) >= SIZE * window], coded, size, window), [p for p in of if len(coded[p[0]]) < SIZE * window]) if crowded else (size, None, of))
        if places:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Begins and ends, in turn, of stretches of the words that windows cover, and the items that have those windows."""
        ranges: list[int] = []
        found: set[str] = set()
        if not len(self.automaton) or not words:
            return ranges, found
        text = self.codes.of(words)
        n, window = len(words), self.window
        seen: dict[tuple[int, int], int] = {}
        begin = end = 0  # the last stretch found, grown by what touches it
        for last, (size, crowd, places) in self.automaton.iter(text):
            if (last + 1) % SIZE:
                continue  # it begins inside a word's code
            first = (last + 1) // SIZE - size
            covered = begin + window <= first < end  # nothing new to the left
            for number, at in places if crowd is None else places + crowd.met(text, first):
                item, coded = self.items[number]
                shift, length = at - first, len(coded) // SIZE
                top, met = min(n, length - shift), item in found
                if met and (covered or begin <= max(0, -shift)) and top <= end:
                    continue  # known, and within the stretch however far it goes
                if seen.get((number, shift), 0) > first:
                    continue
                low = first - equal_before(text, first, coded, at, min(first, at, window if covered else n))
                if met and begin <= low and top <= end:
                    continue
                high = first + equal_from(text, first, coded, at, top - first)
                seen[number, shift] = high
                if high - low < min(window, length):
                    continue
                found.add(item)
                if ranges and low <= end:
                    begin, end = min(begin, low), max(end, high)
                    ranges[-2:] = begin, end
                else:
                    begin, end = low, high
                    ranges += low, high
        return ranges, found


def _merged(ranges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of words, with their places in the text, joined where they touch."""
    out: list[tuple[int, int, int, int]] = []
    for r in sorted(ranges):
        if out and r[0] <= out[-1][1]:
            out[-1] = max(out[-1], (out[-1][0], r[1], out[-1][2], r[3]), key=lambda x: x[1])
        else:
            out.append(r)
    return out


_HIT = pa.list_(pa.list_(pa.int64()))


def _key(doc_id: int | None, raw: bytes | None) -> bytes:
    """What tells rows apart that are judged differently."""
    return hashlib.blake2b(b"%s\x00" % str(doc_id).encode() + (raw if raw is not None else b""), digest_size=16).digest()


def _scan(shared, token: str, window: int, only_hits: bool):
    """(doc_id, key, n_words, ranges, items) of each text; of those with hits alone where other blocks are scanned for too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = worker_state(token, lambda: ItemAutomaton(shared.value, window)) if shared else None
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                spaced = (raw or b"").translate(NORMAL)
                words = [w for w in spaced.split(b" ") if w]
                found, items = automaton.find(words) if automaton else ([], set())
                if only_hits and not items:
                    continue
                ranges: list[tuple[int, int, int, int]] = []
                if found:
                    places = [m.span() for m in re.finditer("[^ ]+", spaced.decode())]
                    ranges = [(i, j, places[i][0], places[j - 1][1]) for i, j in zip(found[::2], found[1::2], strict=True)]
                row = (doc_id, _key(doc_id, raw), len(words), [list(r) for r in _merged(ranges)], sorted(items))
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            types = [pa.int64(), pa.binary(), pa.int64(), _HIT, pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "key", "n_words", "ranges", "items"])

    return run


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for ranges, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            spans, items = _merged([tuple(r) for r in ranges or ()]), sorted(set(items or ()))
            n_hit = sum(r[1] - r[0] for r in spans)
            row = (n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, items, [{"start": r[2], "end": r[3]} for r in spans])
            for col, v in zip(out, row, strict=True):
                col.append(v)
        types = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_FOUND = ["doc_id", "n_words", "ranges", "items"]
_JUDGED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
_SCANNED = "doc_id long, key binary, n_words long, ranges array<array<long>>, items array<string>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    Words are runs of 0-9, a-z and characters beyond ASCII after A-Z are lower-cased. An item's windows
    are its runs of so many consecutive words; a shorter item that has words is one window. A word in
    any occurrence of a window is hit; spans are the runs of hit words as code point offsets in the
    original text, end exclusive. Null or wordless texts have no words and no hits; null or empty items
    have no windows; an item without an id counts for hits under the id "". Repeated rows are judged each
    on their own, repeated items are one. Empty tables give empty or hitless results. A benchmark of more than
    BLOCK_CHARS characters is scanned for in blocks, so that a worker holds one automaton at a time and that is bounded, but for one item longer than a
    block: each block reads the documents and gives the ranges and items of those it hits, by a key of the row; texts are never written.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
    blocks = 1 + int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(k: int) -> Scan:
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct().collect()
        return _scan(spark.sparkContext.broadcast([(r.item, r.text) for r in block]), uuid.uuid4().hex, window, blocks > 1)

    if blocks == 1:
        whole = scan(0)  # scanned and judged by one worker, as a second one a task would stay beside it
        return rows.mapInArrow(lambda batches: _judged(b.select(_FOUND) for b in whole(batches)), _JUDGED)
    hits = [materialise(rows.mapInArrow(scan(k), _SCANNED).select("key", "ranges", "items").dropDuplicates(["key"]), "hits") for k in range(blocks)]
    every = reduce(DataFrame.union, hits).groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))
    counted = materialise(rows.mapInArrow(_scan(None, "", window, False), _SCANNED).drop("ranges", "items"), "counted")
    return counted.join(sized_broadcast(materialise(every, "hits")), "key", "left").select(_FOUND).mapInArrow(_judged, _JUDGED)
