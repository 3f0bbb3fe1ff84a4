"""Source divergence, quality scores and spelling variants against brute force, on nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import divergence, quality, variants

RNG = np.random.default_rng(21)
SCHEMA = "doc_id long, text string, lang string, source string, term string, word string, g int, n long"
SYLLABLES = ["an", "er", "on", "th", "ça", "ing", "lé", "st", "zz"]
WORDS = ["".join(RNG.choice(SYLLABLES, k)) for k in RNG.integers(1, 6, 60)]


def edited(word):
    at = int(RNG.integers(0, len(word)))
    return [word[:at] + word[at + 1 :], word[:at] + "xéÿ"[at % 3] + word[at:], word[:at] + "k" + word[at + 1 :]][int(RNG.integers(0, 3))]


def prose(n):
    return " ".join(edited(w) if RNG.random() < 0.04 else w for w in RNG.choice(WORDS, n, p=np.arange(1, 61) / 1830))


TEXTS = [prose(int(n)) for n in RNG.integers(1, 200, 120)]
ROWS = [(i, t, ("en", "de")[i % 3 == 0], f"s{i % 4}") for i, t in enumerate(TEXTS)]
ROWS += [(200, None, "en", "empty"), (201, "", None, None), (202, " 12 !", "it", "a"), (203, "x y", "it", "b"), (204, prose(30_000), "en", "s1"), (None, TEXTS[0], "en", "s0"), (3, TEXTS[3], "de", "s3"), (3, TEXTS[3], "de", "s3")]
ROWS += [(205, "a" * 3000 + " " + ("THETHETHE thethethé " * 40), "en", "s1"), (206, "日本 " + "ÀÉé×÷ " * 9, "en", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "c", "c", 1, 2) for r in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def plain_divergence(rows, least, ranks):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        groups[lang or ""].add(source or "")
        terms = [low(t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        counts[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("least, ranks", [(10, 10), (1, 3), (500, 10)])
def test_divergence(docs, least, ranks):
    got = [tuple(r) for r in divergence.divergence(docs, least, ranks).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(ROWS, least, ranks)


def test_divergence_in_portions(docs, empty, monkeypatch):
    """The scatter hands accumulators on whenever they are full and takes few postings at once; sums stay the same."""
    assert divergence.divergence(empty).count() == 0
    batches = [b for b in docs.select(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).toArrow().to_batches()]
    whole = Counter()
    for batch in divergence._terms(iter(batches)):
        for r in batch.to_pylist():
            whole[r["lang"], r["source"], r["term"]] += r["n"]
    monkeypatch.setattr(divergence, "HELD", 7)
    parts = Counter()
    for batch in divergence._terms(iter(batches)):
        for r in batch.to_pylist():
            parts[r["lang"], r["source"], r["term"]] += r["n"]
    assert parts == whole and len(whole) > 100


def test_scatter_equals_all_pairs(monkeypatch):
    import pyarrow as pa

    p0 = RNG.integers(1, 50, 6)
    terms = [[(g, int(RNG.integers(50, 10**9))) for g in range(6) if RNG.random() < 0.5] for _ in range(40)]
    want = np.zeros((6, 6), np.int64)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for t in terms:
        for a, p in t:
            for b, q in t:
                want[a, b] += f(p, q) - f(p, int(p0[b])) - f(int(p0[a]), q) + f(int(p0[a]), int(p0[b]))
    postings = pa.array([[{"g": g, "p": p, "p0": int(p0[g])} for g, p in t] for t in terms], pa.list_(pa.struct([("g", pa.int32()), ("p", pa.int64()), ("p0", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 40), postings, pa.array([6] * 40, pa.int32())], ["lang", "postings", "n_peers"])
    for at_once, held in ((10**6, 10**6), (5, 1)):
        monkeypatch.setattr(divergence, "AT_ONCE", at_once)
        monkeypatch.setattr(divergence, "ACCUMULATED", held)
        got = np.zeros((6, 6), np.int64)
        for part in divergence._scatter(iter([batch.slice(0, 15), batch.slice(15, 25)])):
            for r in part.to_pylist():
                got[r["a"], r["b"]] += r["value"]
        assert (got == want).all()


def plain_variants(rows, least_letters=6, least_count=5, times=5):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: k for w, k in n.items() if k >= least_count and len(w) >= least_letters}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in words:
        found = sorted((-words[o], o) for o in words if near(w, o))
        form[w] = found[0][1] if found and -found[0][0] >= times * words[w] else None
        out[w] = [form[w], words[w], len(found), words.get(form[w])]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].append(root)
    return out


@pytest.mark.parametrize("letters, count, times", [(6, 5, 5), (4, 1, 2)])
def test_spelling_variants(docs, empty, letters, count, times):
    got = {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in variants.spelling_variants(docs, letters, count, times).collect()}
    want = plain_variants(ROWS, letters, count, times)
    assert got == want
    assert any(v[0] for v in want.values()) and any(v[2] > 1 for v in want.values())
    assert variants.spelling_variants(empty).count() == 0


def test_pivots_are_disjoint_and_cheapest():
    order = {a + b: i for i, (a, b) in enumerate((a, b) for a in "abcd" for b in "dcba")}
    weight = [int(x) for x in RNG.integers(1, 99, 16)]
    for _ in range(300):
        word = "".join(RNG.choice(list("abcd"), int(RNG.integers(4, 12))))
        grams = variants.prefix(word, order)
        last = sorted(order[word[i : i + 2]] for i in range(len(word) - 1))[2]
        assert sorted(grams) == sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1) if order[word[i : i + 2]] <= last)
        chosen = sorted(variants.pivots(grams, weight))
        cost = {at: weight[place] for place, at in grams}
        assert chosen[1] - chosen[0] >= 2
        assert sum(cost[c] for c in chosen) == min(cost[i] + cost[j] for i in cost for j in cost if j - i >= 2)


def test_near_words_loses_no_link(spark):
    """Words of few letters, where bigrams repeat and shift, and words of one letter over and over."""
    words = sorted({"".join(RNG.choice(list("aab"), int(n))) for n in RNG.integers(4, 9, 150)} | {"aaaaaa", "aaaaaaa", "a" * 400, "a" * 401, "b" + "a" * 400})
    got = {(r.word, r.other) for r in variants.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()}
    shorter = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words}
    want = {(a, b) for a in words for b in words if a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or a in shorter[b] or b in shorter[a])}
    assert got == want


def test_long_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("x", "w03"), ("y", "z")], "word string, root string")
    assert {r.word: r.root for r in variants._roots(forms).collect()} == {**{f"w{i:02}": "w21" for i in range(21)}, "x": "w21", "y": "z"}


def marked(i):
    words = RNG.choice(WORDS, int(RNG.integers(5, 150)))
    return (" ".join(w + "#%"[len(w) % 2] for w in words) if i % 6 == 0 else " ".join(words) + ".", int(i % 6 != 0))


def test_quality_scores_on_held_out_labels(spark, empty):
    made = [(i, *marked(i)) for i in range(700)]
    rows = [(i, t, None, None, None, None, None, None) for i, t, _ in made] + [(900, None, *[None] * 6), (901, "", *[None] * 6), (None, "one two", *[None] * 6), (5, made[5][1], *[None] * 6), (902, "long " * 500_000, *[None] * 6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in made] + [(1, 1, "x"), (1, None, "x"), (None, 0, "x"), (5000, 1, "x")], "doc_id long, quality int, text string")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: q for i, _, q in made}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, turned).collect()}
    assert all(again[r.doc_id] == r.score for r in got)  # held-out labels teach nothing, and sums do not depend on the order of rows
    assert {r.score for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    one = quality.quality_scores(docs, labels.where("quality = 1")).collect()
    assert all(r.predicted == 1 for r in one)
    assert quality.quality_scores(empty, labels).count() == 0


def test_normal_equations_sum_in_any_split(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [([float(x) for x in draw.normal(size=len(quality.STATISTICS))], int(draw.integers(1, 5)), int(draw.integers(0, 3)), 1) for _ in range(300)]
    frame = spark.createDataFrame(rows, "statistics array<float>, fold int, bad long, good long")
    features = quality.Features(np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    z = features.of(np.array([r[0] for r in rows], np.float32).astype(float))
    want = np.zeros((4, quality.FEATURES + 1, quality.FEATURES + 2))
    for f, (_, fold, bad, good) in zip(z, rows, strict=True):
        want[fold - 1] += np.outer(f, np.append(f * (bad + good), quality.STEPS * good))
    monkeypatch.setattr(quality, "SUMMED", 3)
    for tasks in (1, 12):
        got = quality._summed(frame.repartition(tasks).mapInArrow(quality._equations(features), "sums binary"), tasks)
        assert (got == want).all()
    kernel = z[:, :-1] @ z[:, :-1].T * 2 / quality.FEATURES / quality.STEPS**2
    x = np.clip(np.array([r[0] for r in rows]), -quality.FARTHEST, quality.FARTHEST)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2 * len(quality.STATISTICS)))
    assert np.abs(kernel - exact).mean() < 0.08


def test_isotonic_is_the_best_rising_fit():
    x = np.arange(60.0)
    n = RNG.integers(1, 9, 60).astype(float)
    good = np.minimum(n, RNG.integers(0, 9, 60)).astype(float)
    at, level = quality.isotonic(x, good, n)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()
    # the greatest of the least means, for every point
    best = [max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    assert np.allclose(sorted(set(np.round(best, 9))), level)


def test_statistics_do_not_depend_on_portions(monkeypatch):
    texts = [TEXTS[0], "a\n\nb b b\nB!\nb b b 12 \U0001f600", "x" * 500, " ", "\ud800 a"]
    whole = [quality.statistics(t) for t in texts]
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    assert all(np.array_equal(a, quality.statistics(t)) for a, t in zip(whole, texts, strict=True))
    assert not quality.statistics(None).any() and not quality.statistics("").any()
