"""Every stage of the corpus pipeline against a plain version of its rule, on what the stage before it kept."""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from marketweave.llm.common import materialise

RNG = np.random.default_rng(11)
WORDS = {"en": "the quick brown fox jumps over lazy dog while many people walk along river and watch birds fly home".split(), "fr": "le renard brun saute par dessus chien paresseux pendant que beaucoup de gens marchent vers la riviere tranquille".split()}


def prose(lang, n):
    return " ".join(RNG.choice(WORDS[lang], n))


ITEM = prose("en", 14)
BASE = prose("en", 200).split()
NEAR = [*BASE[:100], "changed", *BASE[101:]]
FAR = [w if i % 4 else "other" for i, w in enumerate(BASE)]
JUNK = "".join(RNG.choice(list("qxzjkvw"), 400))
TEXTS = [
    *(prose(("en", "fr")[i % 2], 60) for i in range(30)), None, "", "12 34 !?", JUNK, " ".join(BASE), " ".join(NEAR), " ".join(FAR), "  ".join(BASE) + "\n", prose("en", 40) + " " + ITEM + " " + prose("en", 40), prose("en", 6000), "the fox",
]
REJECTED = {30, 31, 32, 33}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, ("en", "fr")[i % 2] if i < 30 else None, "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w]


def kept_by(name, rows):
    """Ids that the rule of a stage keeps of rows {id: text}."""
    if name == "language_id":
        return rows.keys() - REJECTED
    if name == "exact_dedup":
        groups: dict = {}
        for i, t in rows.items():
            groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append(i)
        return {min(g, key=lambda i: (-len(rows[i] or ""), i)) for g in groups.values()}
    if name == "minhash_near_dedup":
        sets = {i: {tuple(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} for i, t in rows.items()}
        label = {i: i for i in rows}
        for a, b in combinations(rows, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
        return {i for i in rows if label[i] == i}
    windows = {tuple(words(ITEM)[k : k + 10]) for k in range(len(words(ITEM)) - 9)}
    return {i for i, t in rows.items() if not any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t)) - 9))}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("keep_id", F.lit("clash"))
    columns, dropped = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        rows = {r.doc_id: r.text for r in docs.collect()}
        docs = materialise(stage(spark, docs, folder), "stage")
        got = {r.doc_id for r in docs.collect()}
        assert got == set(kept_by(name, rows)), name
        assert docs.columns == columns and docs.count() == len(got)
        dropped[name] = rows.keys() - got
    assert dropped == {"language_id": REJECTED, "exact_dedup": {34}, "minhash_near_dedup": {37}, "benchmark_decontamination": {38}}
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: [*coder.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    places: dict = {}
    pieces = pipeline.STAGES[-1][1](spark, docs, folder).orderBy("sequence_id", "offset").collect()
    for r in pieces:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert sum(r.length for r in pieces) == sum(map(len, ids.values())) and max(places.values()) <= 4096 and len(places) <= -(-sum(map(len, ids.values())) // 4096) + 1
    assert sorted(map(tuple, pipeline.run(spark, folder).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in pieces)


def test_empty_and_repeated_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
    odd = docs.where("doc_id in (0, 2)").union(docs.where("doc_id = 0")).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in pipeline.STAGES[1:-1]:
        assert stage(spark, odd, folder).where("doc_id is null").count() == 1, name
        assert stage(spark, odd, folder).where("doc_id = 0").count() == 2, name
