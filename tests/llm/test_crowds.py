"""Hot phrases, blocks without strays, ids with several texts, and benchmarks of several blocks."""

from __future__ import annotations

import random
import time

import pyarrow as pa

from marketweave.llm import decontaminate, minhash, substrings

RNG = random.Random(7)


def words(prefix, n):
    return [f"{prefix}{RNG.randrange(10**9)}" for _ in range(n)]


def test_block_without_strays():
    """Strays are dealt to blocks by hash, so a block may get none."""
    sets = [sorted({i, i + 1, i + 2}) for i in range(3)]
    raw = [pa.array(s, pa.uint64()).buffers()[1].to_pybytes()[: 8 * len(s)] for s in sets]
    names = ["main", "block", "part", "tag", "id", "component", "shingles"]
    batch = pa.RecordBatch.from_pylist([{"main": 1, "block": 0, "part": 0, "tag": 1, "id": 5, "component": 1, "shingles": raw[0]}, {"main": 1, "block": 1, "part": 0, "tag": 0, "id": 6, "component": 6, "shingles": raw[0]}, {"main": 1, "block": 1, "part": 0, "tag": 1, "id": 5, "component": 1, "shingles": raw[0]}])
    got = [r for b in minhash._links(80)(iter([batch.select(names)])) for r in b.to_pylist()]
    assert got == [{"u": 6, "v": 5}]


def test_crowd_of_several_blocks(spark, monkeypatch):
    """One stray larger than a block: the block it is not dealt to stays empty."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 50)
    sets = spark.createDataFrame([(i, bytearray(pa.array(sorted(range(i, 200 + i)), pa.uint64()).buffers()[1].to_pybytes()[:1600])) for i in range(4)], "id long, shingles binary")
    still = spark.createDataFrame([(1, i, 200, 0 if i < 3 else 3, 0) for i in range(4)], "key long, id long, n long, component long, main long")
    assert {(r.u, r.v) for r in minhash._crowds(still, sets, 80).collect()} >= {(3, 2)}


def test_ids_with_several_texts(spark):
    """Rows of one id are one document with the links of all its texts."""
    a, b, c = (" ".join(words(x, 120)) for x in "abc")
    rows = [(9, a), (9, b), (4, a + " more"), (6, b), (3, c), (2, c + " more"), (9, ""), (None, a), (9, a), (1, "alone here"), (1, "alone there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=2).collect()}
    assert got == {(9, 119): (4, False), (4, 120): (4, True), (6, 119): (4, False), (3, 119): (2, False), (2, 120): (2, True), (9, 0): (9, True), (None, 119): (None, True), (1, 1): (1, True)}


def test_many_items_that_share_a_preamble():
    head = words("p", 7)
    items = [(f"i{k}", " ".join(head + words("q", 6))) for k in range(2_000)]
    text = [w for _ in range(2_000) for w in head + words("t", 3)] + items[5][1].split()
    began = time.time()
    ranges, found = decontaminate.ItemAutomaton(items, 10).find([w.encode() for w in text])
    assert time.time() - began < 4
    assert found == {"i5"} and ranges == [20_000, 20_013]


def test_many_passages_that_begin_alike():
    head = words("p", 7)
    automaton = substrings.PassageAutomaton(13)
    passages = [head + words("q", 9) for _ in range(5_000)]
    began = time.time()
    for k, p in enumerate(passages):
        automaton.add([w.encode() for w in p], k)
    text = [w for _ in range(2_000) for w in head + words("t", 3)] + passages[17] + passages[4_000]
    found = automaton.find([w.encode() for w in text], 4_000)
    assert time.time() - began < 6
    assert found == [(20_000, 20_016)]


def test_benchmark_of_several_blocks_writes_no_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    written = []
    monkeypatch.setattr(decontaminate, "materialise", lambda df, name, put=decontaminate.materialise: written.append(df.columns) or put(df, name))
    items = [(k, " ".join(words("i", 12))) for k in range(12)]
    texts = [items[0][1] + " x " + items[7][1], "none of it", items[3][1][:-3] + " é " + items[3][1], None, items[0][1] + " x " + items[7][1]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[2])], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontaminate.decontaminate(docs, bench).collect(), key=str)
    assert written and not any("text" in c for c in written)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10**6)
    assert got == sorted(decontaminate.decontaminate(docs, bench).collect(), key=str) and len(got) == 7
    one = next(r for r in got if r.doc_id == 0)
    assert (one.n_words, one.n_hit, one.items) == (25, 24, ["0", "7"]) and [texts[0][s.start : s.end] for s in one.spans] == [items[0][1], items[7][1]]


def test_places_are_joined_where_they_touch():
    assert decontaminate._merged([(5, 9, 50, 90), (0, 5, 0, 49), (20, 30, 200, 300), (21, 25, 210, 250)]) == [(0, 9, 0, 90), (20, 30, 200, 300)]
