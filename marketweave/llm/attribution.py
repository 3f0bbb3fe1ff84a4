"""Token counts of fields or sections of whole texts, by the offsets of one encoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import slices
from marketweave.llm.tokens import encoder

RULES = ("start", "most", "share")


def allocate(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Sections are in order and do not overlap; tokens outside all of them count nowhere.

    start: a token belongs to the section of its first character; most: to the one that holds most of
    its characters, the earlier of equals; share: to each in proportion to its characters.
    """
    counts = np.zeros(len(starts), np.float64)
    if not len(starts) or not len(tokens):
        return counts
    first = np.maximum(np.searchsorted(starts, tokens[:, 0], "right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, tokens[:, 1] - 1, "right") - 1, 0)
    simple = first == last
    if rule == "start":
        simple[:] = True
    inside = simple & (tokens[:, 0] < ends[first]) & ((tokens[:, 0] >= starts[first]) if rule == "start" else (tokens[:, 1] > starts[first]))
    a, b, at = tokens[inside, 0], tokens[inside, 1], first[inside]
    held = (np.minimum(b, ends[at]) - np.maximum(a, starts[at])) / np.maximum(b - a, 1) if rule == "share" else 1  # part of a token may lie in no section
    np.add.at(counts, at, held)
    for (a, b), i, j in zip(tokens[~simple], first[~simple], last[~simple], strict=True):
        held = np.minimum(b, ends[i : j + 1]) - np.maximum(a, starts[i : j + 1])
        held = np.maximum(held, 0)
        if held.sum():
            counts[i : j + 1] += held / (b - a) if rule == "share" else np.arange(j - i + 1) == held.argmax()
    return counts


def lines_of(raw: bytes) -> np.ndarray:
    """First and end code points of the lines of a text in UTF-8, without the line ends; an empty text has one empty line."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    points = len(data)
    if not raw.isascii():
        before = np.cumsum((data & 0xC0) != 0x80)
        points, ends = int(before[-1]), before[ends] - 1
    return np.stack([np.r_[0, ends + 1], np.r_[ends, points]], axis=1).astype(np.int64)


def _counts(rule: str, path: str | None, lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in slices(batches):
            raws = [r or b"" for r in batch.column(1).cast(pa.binary()).to_pylist()]
            if lines:
                bounds = map(lines_of, raws)
            else:
                bounds = [sorted((x["start"], x["end"]) for x in s or () if x and x["start"] is not None and x["end"] is not None) for s in batch.column(2).to_pylist()]
            ids, number, begin, end, n, crossing = ([] for _ in range(6))
            for doc, tokens, own in zip(batch.column(0).to_pylist(), coder.spans_of(raws), bounds, strict=True):
                if not len(own):
                    continue
                own = np.array(own, np.int64)
                got = allocate(tokens, own[:, 0], own[:, 1], rule)
                cut = np.searchsorted(tokens[:, 0], own[:, 0]) - np.searchsorted(tokens[:, 1], own[:, 0], "right")
                ids += [doc] * len(own)
                number += range(len(own))
                begin += own[:, 0].tolist()
                end += own[:, 1].tolist()
                n += got.tolist()
                crossing += (cut > 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.float64()), pa.array(crossing, pa.bool_())],
                ["doc_id", "section", "start", "end", "n_tokens", "starts_inside_token"],
            )

    return run


def token_counts(docs: DataFrame, sections=None, rule: str = "start", vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and section: doc_id, section (from 0), start, end, n_tokens, starts_inside_token.

    Every whole text is encoded once, without special tokens. sections is a column of
    array<struct<start,end>>, spans of code points that do not overlap, in any order; by default the
    text's lines. A token across a boundary goes by the rule: "start" to the section of its first
    character, "most" to the one that holds most of it, "share" in proportion. Tokens outside all
    sections count nowhere. A null text is empty, a null or empty list of sections gives no rows, a
    span with a null end is left out. Repeated rows are counted each; an empty table gives an empty
    result; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    own = F.lit(None) if sections is None else sections
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), own.cast("array<struct<start:long,end:long>>").alias("sections"))
    return rows.mapInArrow(_counts(rule, vocabulary, sections is None), "doc_id long, section int, start long, end long, n_tokens double, starts_inside_token boolean")
