"""Links of weak parts against a linker that compares all pairs, at all places of the blocks."""

from __future__ import annotations

import re

from marketweave.llm import secrets
from marketweave.llm.secrets import find_secrets

SECRET, KEY, WEAK_ID = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "AKIA" + "ABCD1234" * 2, "ASIA" + "WXYZ" * 3


def brute_spans(text):
    """Every part of the text, the weak ones only where they are linked."""
    kinds = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX} | secrets.WEAK
    least = {"assign": 6, "access": 20, "hex": 24}
    parts = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, text) if len(m.group(2 if kind == "assign" else 0)) >= least.get(kind, 1)]
    kept = []
    for s, n, e, kind in parts:
        by = {secrets.ROLE[k] for a, _, b, k in parts if s <= b + secrets.SCOPE and a <= e + secrets.SCOPE} - {secrets.ROLE[kind]}
        if kind not in secrets.WEAK or (by >= {"id", "secret"} if kind == "endpoint" else by - {"endpoint"}):
            kept.append((s, n, e, kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(kept))


def test_every_link_within_scope(spark):
    far = "https://" + "a" * 700 + ".example.com"
    pairs = [(SECRET, KEY), (KEY, SECRET), (SECRET, WEAK_ID), ("ASIA" + "WXYZ" * 200, SECRET), (SECRET, "ASIA" + "WXYZ" * 200)]
    texts = [" " * (1600 + at) + a + " " * gap + b for a, b in pairs for at in range(0, 256) for gap in (1, 217, 255, 256, 257)]
    texts += [" " * at + far + " " * gap + SECRET + " " + KEY for at in range(0, 256, 5) for gap in (200, 256, 257)]
    texts += [" " * at + SECRET + " " + KEY + " " * gap + far for at in range(0, 256, 5) for gap in (200, 256, 257)]
    texts += [" " * 1791 + SECRET + " " * 217 + KEY]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in find_secrets(rows).collect()}
    wrong = [i for i, t in enumerate(texts) if got[i] != brute_spans(t)]
    assert not wrong, (len(wrong), got[wrong[0]], brute_spans(texts[wrong[0]]))
