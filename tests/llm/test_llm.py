"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import time
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketweave.llm import html, langid, minhash, substrings, urls
from marketweave.llm.attribution import token_counts
from marketweave.llm.components import components
from marketweave.llm.decontaminate import decontaminate
from marketweave.llm.exact import QuotientFilter, exact_dedup
from marketweave.llm.minhash import near_duplicates
from marketweave.llm.packing import Plan, pack
from marketweave.llm.secrets import find_secrets

SCHEMA = "doc_id long, text string, lang string, keep_id string, id long, rep string, h string, size int"
RNG = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(RNG.choice(WORDS, 9000))
BASE = list(RNG.choice(WORDS, 120))


def near(k):
    words = list(BASE)
    for i in range(k):
        words[7 * i] = f"x{k}{i}"
    return " ".join(words)


PASSAGE = " ".join(RNG.choice(WORDS, 60))
TEXTS = [
    None, "", " \t\n", "one", "One", "one two", "b  a", "b a", "ba", " ".join(BASE), " ".join(BASE), near(1), near(2), near(5), near(9), LONG, LONG + " end",
    "start " + PASSAGE + " stop", PASSAGE, "é ü " + PASSAGE + " ß", " ".join(PASSAGE.split()[5:18]), " ".join(PASSAGE.split()[5:17]), "the the the " * 30, "the the the " * 20,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "c", 1, "c", "c", 1) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 9), (7, 7), (None, 1), (3, 1), *((i, i + 1) for i in range(20, 60))]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, **{i: 20 for i in range(20, 61)}}


def test_exact_dedup(spark, docs, empty):
    norm = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in ROWS}
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    for i, t in ROWS:
        group = [j for j in norm if norm[j] == norm[i]]
        keep = max(group, key=lambda j: (len(dict(ROWS)[j] or ""), -j))
        assert tuple(got[i]) == (i, keep, len(group), i == keep, hashlib.sha256(norm[i].encode()).hexdigest())
    assert exact_dedup(empty).count() == 0
    twice = exact_dedup(docs.where("doc_id = 3").union(docs.where("doc_id = 3")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in twice) == [("3", 3, 3), ("3", 3, 3), ("None", 3, 3)]


def test_quotient_filters_merge_without_loss():
    keys = RNG.integers(0, 2**63, 500, dtype=np.uint64)
    all_keys = np.concatenate([keys, keys[:200], keys[:50]])
    merged = QuotientFilter.merged([QuotientFilter.of(p) for p in np.array_split(all_keys, 7)])
    want = dict(zip(*np.unique(all_keys, return_counts=True), strict=True))
    assert dict(zip(merged.fingerprints(), merged.counts, strict=True)) == want
    assert QuotientFilter.of(np.zeros(0, np.uint64)).fingerprints().size == 0


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, empty, words):
    sets = {}
    for i, t in ROWS:
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=words).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert near_duplicates(empty).count() == 0


def test_strays_overlap():
    """Overlaps by what sets lack of the common shingles and have beyond them, against intersections."""
    base = RNG.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([RNG.choice(base, 150 + i, replace=False), RNG.integers(0, 500, 20 * (i % 3), dtype=np.uint64)])) for i in range(30)] + [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint64)]
    index = minhash.Strays(list(range(len(sets))), [0] * len(sets), sets)
    for s in [*sets, base, np.sort(base), np.array([3], np.uint64)]:
        assert index.overlaps(np.unique(s)).tolist() == [len(np.intersect1d(s, x)) for x in sets]


def test_near_copies_of_one_text(spark):
    """A crowd whose members are copies of one text with edits of many sizes: links are found whoever leads the buckets."""
    rows = []
    for i in range(150):
        words = list(BASE)
        for at in RNG.choice(len(BASE), int(RNG.integers(1, 16)), replace=False):
            words[at] = f"e{RNG.integers(0, 30)}"
        rows.append((1000 - i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in rows}
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in found} == label and 1 < len(set(label.values())) < 150


def test_remove_repeats(docs, empty):
    split = {i: [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for i, t in ROWS}
    first: dict = {}
    for i in sorted(split):
        for k in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][k : k + 13]), i)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs).collect()}
    for i, words in split.items():
        gone = {k + d for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < i for d in range(13)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert got[i] == (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i
    assert substrings.remove_repeats(empty).count() == 0
    assert not [t.name for t in docs.sparkSession.catalog.listTables() if t.name.startswith(("candidates_", "segments_"))]


def test_texts_that_repeat_themselves(spark):
    """Words removed where passages and texts are runs of few words, against windows compared one by one."""
    texts = ["a " * 40, "b " + "a " * 60 + "c", "a b " * 30, "b a " * 20 + "c " * 20, "a b a " * 15, "x " * 5 + "a b a " * 9 + "a " * 14, "a " * 12]
    split = [t.split() for t in texts]
    first: dict = {}
    for i, words in enumerate(split):
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), i)
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, words in enumerate(split):
        gone = {k + d for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < i for d in range(13)}
        assert got[i] == len(gone), i


def test_a_repeated_word_costs_its_length():
    made = substrings.PassageAutomaton(13)
    made.add([b"the"] * 16_000, 1)
    begun = time.process_time()
    assert made.find([b"x", *[b"the"] * 16_000], 2) == [(1, 16_001)] and time.process_time() - begun < 2


def test_pack(docs, empty):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*coder.encode(t or "", add_special_tokens=False).ids, 1] for i, t in ROWS}
    rows = pack(docs, capacity=512).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows) == sum(-(-len(x) // 512) for x in ids.values())
    for (i, k), r in pieces.items():
        own = ids[i][512 * k : 512 * k + 512]
        assert (r.start, r.length, r.ids_crc32) == (512 * k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    places: dict = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 512 and len(places) <= -(-sum(map(len, ids.values())) // 512) + 1
    assert pack(empty).count() == 0


def test_plan_holds_every_piece_once():
    counts = {int(k): int(n) for k, n in zip(*np.unique(RNG.integers(1, 65, 3000), return_counts=True), strict=True)}
    plan, seen = Plan(counts, 64), dict.fromkeys(counts, 0)
    for pattern, times in plan.patterns:
        assert sum(pattern) <= 64
        for x in pattern:
            seen[x] += times
    assert seen == counts


def test_decontaminate(spark, docs, empty):
    items = [("a", PASSAGE.upper()), ("b", "one"), ("c", None), ("d", "?!"), ("e", " ".join(BASE[3:14])), ("b", "one"), (None, "two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    got = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    for i, t in ROWS:
        words, hit, found = norm(t), set(), set()
        for item, text in items:
            w = norm(text)
            n = min(10, len(w))
            windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
            for k in range(len(words) - n + 1 if n else 0):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item or "")
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert sum(len(norm(t[s.start : s.end])) for s in r.spans) == len(hit)
    assert decontaminate(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_in_blocks(spark, docs, monkeypatch):
    """Items in many automata, written in between, and an item that repeats itself against a text that does."""
    items = [(str(i), " ".join(RNG.choice(WORDS, 40))) for i in range(300)] + [("p", PASSAGE), ("t", "the " * 3000), ("s", LONG[2000:2600])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(900, "x " + "the " * 20_000)], "doc_id long, text string"))
    cols = ["doc_id", "n_hit", "n_items", "items_sha256"]
    whole = sorted(map(tuple, decontaminate(rows, bench).select(cols).collect()))
    monkeypatch.setattr("marketweave.llm.decontaminate.BLOCK_CHARS", 20_000)
    assert sorted(map(tuple, decontaminate(rows, bench).select(cols).collect())) == whole
    got = {r[0]: r for r in whole}
    assert got[18][1] == 60 and got[900][1:3] == (20_000, 1) and got[22][1:3] == (90, 1) and got[15][2] == 1


def test_urls(spark):
    cases = {
        "https://www.example.com/en/x": ("www.example.com/en/", "allow"), "https://a.Example.COM/en/x?q": ("example.com/en/", "block"), "http://x.com": (None, "allow"), "http://x.com/": ("com/", "allow"), "http://q.net/fr/": ("net/fr/", "block"),
        "http://x.org/casino/": (None, "block"), "http://x.org/casinoist/": (None, "allow"), "http://x.org/free-bonus": (None, "allow"), "http://x.org/free-bonus/win": (None, "block"), "http://x.org/bonus/win": (None, "block"), "http://x.org/free/free/bonus/bonus": (None, "allow"), "http://x.org/a%20casino%2Fb": (None, "block"), "http://x.org/20casino": (None, "allow"),
        "http://free-bets.example.org/": (None, "block"), "http://casino.x.org": (None, "block"), "http://mycasino.org": (None, "allow"), "http://x.org/CASINO": (None, "block"), "http://x.org/" + "a" * 100_000 + "/casino": (None, "block"), "http://x.org/best%": (None, "allow"), "nothing": (None, "allow"), None: (None, "allow"), "": (None, "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.filter_urls(df.limit(0)).count() == 0
    only = {r.page_id: r.verdict for r in urls.filter_urls(df, rules=(), terms={"nothing": urls.REJECT}).collect()}
    assert [k for k, v in only.items() if v == "block"] == [list(cases).index("nothing")]


def test_language(spark):
    rows = [(i, ("the quick brown fox and the dog " if i % 2 else "le renard brun et le chien ") * (1 + i % 4), "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 !?", None), (102, "the dog", None), (103, "a" * 5000, None), (None, "le chien", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(df, langid.train(langid.learnable(df))).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") and 0 <= got[i].score <= 1 for i in range(60))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(60))
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "en" and got[None].lang_pred == "fr" and got[None].held_out is False
    assert got[100].evidence is None and abs(got[1].evidence) < 0.5 and got[103].evidence < got[1].evidence
    nobody = df.where("lang is null")
    assert {r.lang_pred for r in langid.identify(nobody, langid.train(langid.learnable(nobody))).collect()} == {"und"}
    assert langid.identify(df.limit(0), langid.train(langid.learnable(df))).count() == 0


def test_lattice_sums_all_segmentations():
    names = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab"])}
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.25], [langid.UNKNOWN], [0.0]])
    lattice = langid.Lattice(["ab", "az"], langid.Pieces(names))
    want = [0.1 * 0.3 * 0.05 + 0.1 * 0.15 + 0.2 * 0.05 + 0.25, (0.1 * 0.3 + 0.2) * langid.UNKNOWN]
    assert np.allclose(np.exp(lattice.log_likelihood(p))[:, 0], want)
    counts, likelihood = lattice.expected(p[:, 0], np.array([1.0, 0.0]))
    assert np.isclose(counts[5], 0.25 / want[0]) and np.isclose(likelihood, np.log(want[0]))


@pytest.mark.parametrize("length", [1, 30, 3000])
def test_words_of_any_length_are_segmented_whole(length):
    names = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "aab"])}
    p = np.array([[0.1, 0.01], [0.2, 0.001], [0.1, 0.3], [0.3, 0.1], [0.05, 0.2], [0.02, 0.01], [langid.UNKNOWN] * 2, [0.0, 0.0]])
    word = "".join(RNG.choice(list("abz"), length, p=[0.6, 0.3, 0.1]))
    marked, best = "▁" + word, []
    for col in range(2):  # logarithms of the sums over all segmentations of each prefix
        logs = [0.0]
        for end in range(1, len(marked) + 1):
            terms = [logs[end - len(x)] + np.log(p[i, col]) for x, i in names.items() if marked.endswith(x, 0, end)]
            terms += [logs[end - 1] + np.log(langid.UNKNOWN)] * (marked[end - 1] == "z")
            logs.append(np.logaddexp.reduce(terms))
        best.append(logs[-1])
    lattice = langid.Lattice([word, "a"], langid.Pieces(names))
    assert np.allclose(lattice.log_likelihood(p)[0], best)
    counts, likelihood = lattice.expected(p[:, 0], np.array([1.0, 0.0]))
    sizes = np.array([*map(len, names), 1, 0])
    assert np.isclose(likelihood, best[0]) and np.isclose(counts @ sizes, len(marked))


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav>menu</nav><div class="ad">buy</div><article><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>\n text<br>next<p>Two<div class="comments"><p>hi</p></div><p>Shared line</p>{}</article><footer>f</footer>'
    pages = [(i, f"http://h.org/{i}", page.format(f"<p>own {i}")) for i in range(6)]
    pages += [(10, None, None), (11, "http://h.org/e", ""), (12, "x", "plain <b>text"), (13, "y", "<p>a</p><ul><li><a href=x>link</a></li></ul><p>b &lt; c"), (13, "y", "<p>a</p><ul><li><a href=x>link</a></li></ul><p>b &lt; c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract_text(df).collect()}
    assert all(got[i] == f"Head & more\n\nOne bold text next\n\nTwo\n\nShared line\n\nown {i}" for i in range(6))
    assert got[10] == got[11] == "" and got[12] == "plain text" and got[13] == "a\n\nb < c"
    assert html.extract_text(df).count() == len(pages) and html.extract_text(df.limit(0)).count() == 0


def test_html_of_the_shared_pages(spark):
    """Against a reading of their one shape: the article cut at its block tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search("(?s)<article[^>]*>(.*?)</article>", r.html or "")
        parts = re.split(r"</?(?:h[1-6]|p|div|ul|ol|li|table|tr|blockquote|pre|section)(?:\s[^>]*)?>", re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>", "", article[1] if article else ""))
        blocks = [" ".join(html_lib.unescape(re.sub("<[^>]*>", lambda m: " " if m[0][:3] in ("<br", "<td", "<th") else "", p)).split()) for p in parts]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want)), r.page_id


def test_template_keeps_its_order():
    assert html.in_order([2, None, 0, 1, None, 5, 3]) in ({2, 3, 5}, {2, 3, 6}) and html.in_order([]) == html.in_order([None]) == set()
    assert [b[1] for b in html.blocks_of("<p title='1 > 0'>a</p><p title=\"x>y\" id=z>b<p title='broken>c")] == ["a", "b", "c"]


def test_token_counts(spark, docs, empty):
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "alpha beta\ngamma"), (2, None), (3, "é\nxx  \n"), (4, "unbelievableness")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in token_counts(df).collect()}
    for i, t in rows:
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            assert got[i, k] == (at, at + len(line), len(coder.encode(line, add_special_tokens=False).ids))
            at += len(line) + 1
    halves = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(2).alias("start"), F.lit(40).alias("end")))
    n = len(coder.encode("unbelievableness", add_special_tokens=False).ids)
    for rule in ("start", "most", "share"):
        parts = token_counts(df.where("doc_id = 4"), halves, rule).orderBy("section").collect()
        assert np.isclose(sum(p.n_tokens for p in parts), n)
    assert token_counts(empty).count() == 0
    lines = spark.createDataFrame([(1, "é x\n" * 64_000)], "doc_id long, text string")
    assert token_counts(lines).agg(F.count("*"), F.sum("n_tokens"), F.max("end")).first() == (64_001, 128_000.0, 256_000)
    own = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 7), (7, 12), (12, 16))))
    spans = coder.encode("unbelievableness", add_special_tokens=False).offsets
    held = [[max(0, min(b, d) - max(a, c)) for a, b in spans] for c, d in ((0, 7), (7, 12), (12, 16))]
    parts = {rule: [p.n_tokens for p in token_counts(df.where("doc_id = 4"), own, rule).orderBy("section").collect()] for rule in ("start", "most", "share")}
    assert parts["start"] == [sum(c <= a < d for a, _ in spans) for c, d in ((0, 7), (7, 12), (12, 16))]
    assert parts["most"] == [sum(max(range(3), key=lambda i: held[i][k]) == j for k in range(len(spans))) for j in range(3)]
    assert np.allclose(parts["share"], [sum(h / (b - a) for h, (a, b) in zip(row, spans, strict=True)) for row in held])


def brute_secrets(text):
    t, spans = text or "", []
    for k, (kind, pattern, least, group) in enumerate((("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0))):
        for m in re.finditer(pattern, t, re.I | re.A if kind == "assign" else 0):
            if len(m.group(group)) >= least:
                spans.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_secrets(spark):
    key, weak = "AKIA" + "ABCD1234" * 2, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    many = " ".join("secret=ab%06d" % i for i in range(16_000))
    texts = [None, "", "é PassWord = 'abcdef12' x", "token=ab token=abcdefg", "token=token:abcdefgh", "x" + key + " y " + key, "ab" * 30 + "g" + "f" * 23, "api_key: " + "0a" * 20 + " 😀 secret:zzzzzz", f"{weak} alone", f"id {key} secret {weak} at https://s3.example.com", f"{weak} " + "x " * 400 + key, "secret=aaaaaa " * 300, many]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[9])], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("h", F.lit("clash"))
    rows = find_secrets(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        base = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), r
        assert set(base.split(",")) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k) for k in ("assign:", "access:", "hex:"))
    spans = {r.doc_id: r.spans for r in rows}
    assert "weak_secret" in spans[9] and "endpoint" in spans[9] and "weak_secret" not in spans[8] + spans[10]
    assert find_secrets(df.limit(0)).count() == 0
