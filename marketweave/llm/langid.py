"""Language identification by piece unigrams, summed over all segmentations of every word."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from marketweave.llm.common import materialise, slices, worker_state

#: The vocabulary file that is meant where none is named.
VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents a language that the piece probabilities are fitted on at most, by hash of the id, and rounds of re-estimation.
SAMPLE_PER_LANGUAGE, ROUNDS = 400, 2
#: Words remembered by one worker, and the longest that is; others are segmented again.
REMEMBERED, LONGEST = 250_000, 64
#: Probability of a letter that no piece covers, and pieces added to every count.
UNKNOWN, SMOOTHING = 1e-7, 0.05
#: Words, and letters of words, segmented at once.
AT_ONCE, LETTERS_AT_ONCE = 2000, 100_000
#: Sums that fall below the first are multiplied by the second, and how often is kept beside them; a word may be of any length.
TINY, HUGE = 1e-200, 1e200
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters of the whole text."""
    return _LETTERS.findall((text or "").lower())


def _portions(words: list[str]) -> Iterator[list[str]]:
    """The words by length, in lists that are segmented at once."""
    part: list[str] = []
    for w in sorted(words, key=len):
        if part and (len(part) == AT_ONCE or (len(part) + 1) * len(w) > LETTERS_AT_ONCE):
            yield part
            part = []
        part.append(w)
    if part:
        yield part


class Pieces:
    """The vocabulary as sorted hashes of its pieces, to find all pieces in many words at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        prints = np.array([self._print(p) for p in pieces], np.uint64)
        order = np.argsort(prints)
        self.prints, self.number = prints[order], np.fromiter(pieces.values(), np.int64, self.n)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[prints >> np.uint64(44)] = True

    def _print(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c)) % 2**64
        return h

    def find(self, prints: np.ndarray, none: int) -> np.ndarray:
        out = np.full(prints.shape, none, np.int32)
        maybe = np.nonzero(self.seen[prints >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.prints, prints[maybe]), self.n - 1)
        out[maybe] = np.where(self.prints[at] == prints[maybe], self.number[at], none)
        return out


class Lattice:
    """All segmentations of a list of words into pieces of the vocabulary.

    ids[l][end] has, for every word, the piece of l + 1 characters that ends there. Row n of the
    probabilities stands for a letter that no piece covers, row n + 1 for no piece.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        marked = np.array(["▁" + w for w in words])
        self.words = len(words)
        codes = np.ascontiguousarray(marked.view(np.uint32).reshape(self.words, -1).T).astype(np.uint64)
        self.length = np.fromiter((len(w) + 1 for w in words), np.int64, self.words)
        self.most = len(codes)
        h = np.zeros_like(codes)
        self.ids = []
        for size in range(1, min(pieces.longest, self.most) + 1):
            h = h[: self.most - size + 1] * pieces.BASE + codes[size - 1 :]
            self.ids.append(pieces.find(h, pieces.n if size == 1 else pieces.n + 1))

    def _edges(self, end: int):
        for size in range(1, min(end, len(self.ids)) + 1):
            yield end - size, self.ids[size - 1][end - size]

    def forward(self, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum over the segmentations of each prefix, and how often HUGE was multiplied to it; probability has a row a piece and a column a language."""
        alpha = np.zeros((self.most + 1, self.words, probability.shape[1]))
        level = np.zeros(alpha.shape, np.int32)
        alpha[0] = 1
        for end in range(1, self.most + 1):
            for begin, piece in self._edges(end):
                alpha[end] += alpha[begin] * probability[piece]
            level[end] = level[end - 1]
            low = alpha[end] < TINY
            if low.any():
                since = max(0, end + 1 - len(self.ids))
                alpha[since : end + 1] = np.where(low, alpha[since : end + 1] * HUGE, alpha[since : end + 1])
                level[since : end + 1] += low
        return alpha, level

    def log_likelihood(self, probability: np.ndarray) -> np.ndarray:
        alpha, level = self.forward(probability)
        whole = self.length, np.arange(self.words)
        return np.log(alpha[whole]) - level[whole] * np.log(HUGE)

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts of the pieces over all segmentations in one language, each word having a weight, and the words' log likelihood."""
        alpha, level = (x[:, :, 0] for x in self.forward(probability[:, None]))
        beta, now = np.zeros_like(alpha), np.zeros(self.words, np.int32)
        each = np.arange(self.words)
        beta[self.length, each] = 1
        counts = np.zeros(len(probability))
        with np.errstate(divide="ignore"):
            log_alpha, log_p = np.log(alpha) - level * np.log(HUGE), np.log(probability)
            total = log_alpha[self.length, each]
            for end in range(self.most, 0, -1):
                low = (beta[end] < TINY) & (beta[end] > 0)
                if low.any():
                    since = max(0, end - len(self.ids))
                    beta[since : end + 1] = np.where(low, beta[since : end + 1] * HUGE, beta[since : end + 1])
                    now += low
                log_beta = np.log(beta[end]) - now * np.log(HUGE) - total
                for begin, piece in self._edges(end):
                    counts += np.bincount(piece, np.exp(log_alpha[begin] + log_p[piece] + log_beta) * weight, len(probability))
                    beta[begin] += probability[piece] * beta[end]
        return counts, float(total @ weight)


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces made of letters, with or without the mark of a word's begin, and their numbers."""
    model = SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    kept = sorted({p for p in found if p == "▁" or _LETTERS.fullmatch(p.lstrip("▁")) and p.lower() == p})
    return {p: i for i, p in enumerate(kept)}


def _expected(languages: list[str], shared, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, probability = Pieces(vocabulary(path)), np.asarray(shared.value)
        number = {x: i for i, x in enumerate(languages)}
        total = np.zeros((len(probability) + 2, len(languages)))  # the last rows: log likelihood and letters
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[lang].update(words_of(text))
            for lang, seen in counts.items():
                col = number[lang]
                for part in _portions(list(seen)):
                    weight = np.fromiter((seen[w] for w in part), np.float64, len(part))
                    got, likelihood = Lattice(part, pieces).expected(np.ascontiguousarray(probability[:, col]), weight)
                    total[:-2, col] += got
                    total[-2:, col] += likelihood, weight @ np.fromiter((len(w) + 1 for w in part), np.float64, len(part))
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    return run


class Model:
    """Languages, the probability of every piece in each, and the mean log likelihood of a letter of its own texts."""

    def __init__(self, languages: list[str], probability: np.ndarray, typical: np.ndarray, path: str | None = None):
        self.languages, self.probability, self.typical, self.path = languages, probability, typical, path


def train(labelled: DataFrame, path: str | None = None, per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Fit piece probabilities on labelled(id, text, lang): at most per_language documents of each language, whole texts.

    Which ones goes by a hash of the id. Counts are expected counts over all segmentations, starting from
    equal pieces. Rows without text or language are left out; without any there are no languages.
    """
    spark = labelled.sparkSession
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = labelled.where("text is not null and lang is not null").select("id", "lang", F.row_number().over(order).alias("place")).where(F.col("place") <= per_language)
    rows = materialise(labelled.where("text is not null and lang is not null").join(F.broadcast(chosen.select("id", "lang")), ["id", "lang"], "left_semi").repartition(12), "lang_sample")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    n = len(vocabulary(path))
    probability = np.full((n + 2, len(languages)), 1 / n)
    probability[n], probability[n + 1] = UNKNOWN, 0
    typical = np.zeros(len(languages))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probability)
        counts = rows.select("lang", "text").mapInArrow(_expected(languages, shared, path), "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got = counts.toPandas()
        total = np.full((n, len(languages)), SMOOTHING)
        at = got.piece.to_numpy() < n
        np.add.at(total, (got.piece[at].to_numpy(), got.lang[at].to_numpy()), got.n[at].to_numpy())
        ends = np.zeros((2, len(languages)))
        last = got.piece.to_numpy() - (n + 2)
        ends[last[last >= 0], got.lang[last >= 0]] = got.n[last >= 0]
        typical = ends[0] / np.maximum(ends[1], 1)
        probability = np.vstack([total / total.sum(axis=0), np.full(len(languages), UNKNOWN), np.zeros(len(languages))])
    return Model(languages, probability, typical, path)


class Scorer:
    """Log likelihoods of words in every language, remembered up to a bound."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(vocabulary(model.path))
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))

    def batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """Sum of the log likelihoods of each text's words, and their letters; None without a letter."""
        split = [words_of(t) for t in texts]
        if len(self.places) > REMEMBERED:
            self.places, self.table = {}, self.table[:0]
        new = sorted({w for words in split for w in words if w not in self.places}, key=len)
        kept = len(self.table) + sum(len(w) <= LONGEST for w in new)  # the longest come last
        self.places.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.vstack([self.table, *(Lattice(p, self.pieces).log_likelihood(self.model.probability) for p in _portions(new))])
        place = self.places.__getitem__
        out = [(self.table[np.fromiter(map(place, words), np.int64, len(words))].sum(axis=0), sum(map(len, words)) + len(words)) if words else None for words in split]
        for w in new[::-1][: len(self.table) - kept]:
            del self.places[w]
        self.table = self.table[:kept]
        return out


def _predict(shared, token: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(token, lambda: Scorer(shared.value))
        for batch in slices(batches):
            texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            named, scores, evidence = [], [], []
            for at in range(0, len(texts), 2000):
                for got in scorer.batch(texts[at : at + 2000]):
                    if got is None or not len(got[0]):
                        named.append(UNDETERMINED), scores.append(0.0), evidence.append(None)
                    else:
                        x, letters = got
                        best, share = int(x.argmax()), np.exp(x - x.max())
                        named.append(scorer.model.languages[best]), scores.append(float(1 / share.sum()))
                        evidence.append(float(x[best] / letters - scorer.model.typical[best]))
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
            cols = [batch.column(0), pa.array(held, pa.bool_()), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "lang_pred", "score", "evidence"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id as text is 2 modulo 4), lang_pred, score, evidence.

    score is the probability of the predicted language given the whole text, all languages being equally
    likely before. evidence is the mean log likelihood of a letter less that of the language's own texts: about 0 for a
    text in it, however long, and far below for letters at random. A text that is null or has no letter is "und" with score 0 and no evidence, as is every text of a
    model without languages; a row without id is not held out. Ties go to the first language by name.
    Words of any length are segmented whole, in time that grows with the length. Repeated rows are predicted each; an
    empty table gives an empty result; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(shared, uuid.uuid4().hex), "doc_id long, held_out boolean, lang_pred string, score double, evidence double")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text, lang) of the labelled documents outside the held-out quarter."""
    rows = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    return rows.select(F.col(id_col).cast("long").alias("id"), "text", "lang")
