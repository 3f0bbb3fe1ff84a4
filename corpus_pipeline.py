"""A corpus pipeline over documents: language, exact copies, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of
documents; the last returns the packed pieces. doc_id names a document: rows that share one are kept
or dropped together, and rows without one are never dropped. Empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketweave.llm import langid
from marketweave.llm.common import materialise, sized_broadcast
from marketweave.llm.decontaminate import decontaminate
from marketweave.llm.exact import exact_dedup
from marketweave.llm.minhash import near_duplicates
from marketweave.llm.packing import pack

#: Documents whose predicted language has a lower probability are rejected, as are those without a letter.
LEAST_SCORE = 0.5
#: Bytes of chunks that packing remembers in a worker: fewer than by itself, as the executors have run the other stages before.
REMEMBERED = 50_000_000
#: Documents of less evidence for their language are rejected too: on average a letter is that many nats less likely than in the language's own texts.
#: Sentences of a few words beside a key or an address come to -2; letters at random in no language come below this.
LEAST_EVIDENCE = -2.5


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows of these ids; the ids are written first, so a decision is made once."""
    dropped = materialise(dropped.select("doc_id").where("doc_id is not null").distinct(), "dropped")
    return docs.join(sized_broadcast(dropped), "doc_id", "left_anti").select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach. Null, empty and letterless texts go, as do letters that fit no language; without labelled documents nothing can be told and all go."""
    found = langid.identify(docs, langid.train(langid.learnable(docs)))
    return _without(docs, found.where((found.lang_pred == langid.UNDETERMINED) | (found.score < LEAST_SCORE) | (found.evidence < LEAST_EVIDENCE)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the longest with its white space, the least id among equals. Rows that repeat the id that stays all stay."""
    found = exact_dedup(docs)
    return _without(docs, found.where("not kept and doc_id <> keep_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id; texts without words are no copies of anything."""
    return _without(docs, near_duplicates(docs, words=5, percent=80).where("not kept"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null items and an empty benchmark have none."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return _without(docs, found.where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text is one end token, repeated rows are packed each."""
    return pack(docs, capacity=4096, end_id=1, remembered=REMEMBERED)


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("minhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark_passages), ("best_fit_packing", packing)]

#: Language identification is not SQL, so run() has none; tests/llm/test_pipeline.py holds each stage against a plain version of its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
