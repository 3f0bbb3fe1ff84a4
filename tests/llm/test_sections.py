"""Token counts of random sections of random texts, wide characters among them, against the offsets of one whole encoding."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketweave.llm.attribution import RULES, token_counts

RNG = random.Random(8)
PARTS = ["unbelievable", "ness", "é", "ß", "日本", "😀", " ", "  ", "\n", "x", "12", "-", "Über", "ção", "ing", "\t", "👩‍👩‍👧", "Ⅷ"]


def sections_of(n):
    """Spans in any order that leave some of the text out and may be empty or reach beyond it."""
    edges = sorted(RNG.sample(range(n + 5), min(n + 5, 2 * RNG.randrange(1, 6))))
    spans = [(edges[i], edges[i + 1]) for i in range(0, len(edges) - 1, 2)]
    if RNG.random() < 0.5:  # some that touch
        spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False)]
    RNG.shuffle(spans)
    return spans


def counted(tokens, spans, rule):
    out = []
    for c, d in sorted(spans):
        total = 0.0
        for a, b in tokens:
            held = [max(0, min(b, y) - max(a, x)) for x, y in sorted(spans)]
            mine = max(0, min(b, d) - max(a, c))
            if rule == "start":
                total += c <= a < d
            elif rule == "share":
                total += mine / (b - a)
            else:
                total += bool(mine) and sorted(spans).index((c, d)) == held.index(max(held))
        out.append(total)
    return out


def test_random_sections(spark):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(RNG.choice(PARTS) for _ in range(RNG.randrange(1, 40))) for _ in range(60)]
    rows = [(i, t, [{"start": a, "end": b} for a, b in sections_of(len(t))]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own array<struct<start:long,end:long>>").repartition(3)
    for rule in RULES:
        got: dict = {}
        for r in token_counts(df, F.col("own"), rule).orderBy("doc_id", "section").collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t, own in rows:
            spans = [(s["start"], s["end"]) for s in own]
            tokens = [(a, b) for a, b in coder.encode(t, add_special_tokens=False).offsets if b > a]
            assert [(r.start, r.end) for r in got[i]] == sorted(spans)
            assert np.allclose([r.n_tokens for r in got[i]], counted(tokens, spans, rule)), (rule, t, spans)
