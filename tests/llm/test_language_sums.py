"""Predictions of the language operator against sums over all segmentations, one word and one language at a time."""

from __future__ import annotations

import math
import random
import zlib

from marketweave.llm import langid

RNG = random.Random(13)
PARTS = {"en": ["the", "tion", "ing", "er", "an", "st"], "fr": ["eau", "tion", "ère", "le", "qu", "ment"], "de": ["ung", "sch", "der", "ein", "ä", "st"]}


def prose(lang, n):
    return " ".join("".join(RNG.choice(PARTS[lang]) for _ in range(RNG.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def log_sum(word, pieces, p):
    """log of the summed probability of all segmentations of a word."""
    marked, n = "▁" + word, len(pieces)
    alpha = [1.0] + [0.0] * len(marked)
    for end in range(1, len(marked) + 1):
        for begin in range(end):
            piece = marked[begin:end]
            at = pieces.get(piece, n if len(piece) == 1 else None)
            alpha[end] += alpha[begin] * (p[at] if at is not None else 0.0)
    return math.log(alpha[-1])


def test_predictions_by_plain_sums(spark):
    rows = [(i, prose(lang, 30), lang) for i, lang in enumerate(["en", "fr", "de"] * 12)] + [(i, prose(RNG.choice(list(PARTS)), n), None) for i, n in enumerate((1, 1, 2, 3, 40, 1), 100)]
    rows += [(200, "12 ... ", "en"), (201, None, "fr"), (202, "tion", None), (203, "tion Tion TION", "de"), (202, "tion", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.learnable(docs))
    assert model.languages == ["de", "en", "fr"]
    pieces = langid.vocabulary()
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        words = langid.words_of(texts[r.doc_id])
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sums = [sum(log_sum(w, pieces, model.probability[:, k]) for w in words) for k in range(3)]
        best = max(range(3), key=sums.__getitem__)
        assert r.lang_pred == model.languages[best]
        assert abs(r.score - 1 / sum(math.exp(s - sums[best]) for s in sums)) < 1e-9
    right = [r.lang_pred == lang for r in got for i, _, lang in rows if i == r.doc_id and lang and i < 100 and r.held_out]
    assert right and all(right)
