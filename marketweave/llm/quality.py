"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import materialise, sized_broadcast, slices

STATISTICS = ("words", "word_length", "word_spread", "letters", "upper", "digits", "stops", "symbols", "distinct", "commonest", "entropy", "lines", "repeated_lines", "repeated_phrases", "marked_words", "bare_words", "short_words")
#: Random features, width of the kernel in standard deviations a statistic, ridge weight a labelled row, seed of the features.
FEATURES, WIDTH, RIDGE, SEED = 192, 1.0, 1e-3, 20
#: Statistics are cut off at so many standard deviations; features are whole multiples of 1 / STEPS, so that their sums are exact in any order.
FARTHEST, STEPS = 4.0, 4096
#: Labelled rows that a task of the fit takes, and matrices that a task of its sum takes.
ROWS_A_TASK, SUMMED = 20_000, 16
#: Raw scores are calibrated on a grid: so many steps a unit, from -1 to 2. Weight of the raw score, so that it orders what the calibration holds equal.
GRID, TIE = 1024, 0.01
#: Code points handled at once, and words of a phrase.
AT_ONCE, PHRASE = 1_000_000, 5

_STOPS = ".,;:?!'\"-()"
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Kind of each code point below U+10000: 0 other letter, 1 upper case, 2 digit, 3 white space, 4 common mark, 5 symbol."""
    global _kinds
    if _kinds is None:
        kind = {"Lu": 1, "Nd": 2}
        chars = list(map(chr, range(65536)))
        _kinds = np.array([3 if c.isspace() else 4 if c in _STOPS else kind.get(g := unicodedata.category(c), 0 if g[0] in "LM" else 5) for c in chars], np.uint8)
    return _kinds


def _portions(text: str) -> Iterator[str]:
    """The text in portions that end before white space; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + AT_ONCE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def statistics(text: str | None) -> np.ndarray:
    """STATISTICS of the whole text; all 0 for a null or empty one."""
    text = text or ""
    chars, seen, hashes = np.zeros(6), Counter(), []
    n = total = squares = marked = bare = short = 0
    for part in _portions(text):
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars += np.bincount(kinds()[np.minimum(codes, 65535)], minlength=6)
        seen.update(words := part.split())
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
    for word, k in seen.items():
        size = len(word)
        n, total, squares = n + k, total + k * size, squares + k * size * size
        marked += 0 if word[-1:].isalnum() or word[-2:-1].isalnum() and word[-1] in _STOPS else k
        bare += 0 if any(map(str.isalpha, word)) else k
        short += k if size == 1 else 0
    if not n:
        return np.zeros(len(STATISTICS), np.float32)
    lines = [x for x in text.split("\n") if x.strip()]
    h = np.concatenate(hashes).view(np.uint64)
    phrases = np.zeros(max(0, n - PHRASE + 1), np.uint64)
    for k in range(PHRASE if len(phrases) else 0):
        phrases = phrases * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(phrases)]
    often = np.fromiter(seen.values(), np.float64, len(seen)) / n
    mean, letters = total / n, chars[0] + chars[1]
    found = (
        np.log1p(n), mean, max(0.0, squares / n - mean * mean) ** 0.5, letters / len(text), chars[1] / max(letters, 1), chars[2] / len(text), chars[4] / n, chars[5] / n, len(seen) / n, often.max(), -(often * np.log(often)).sum(),
        np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), 1 - len(np.unique(phrases)) / max(len(phrases), 1), marked / n, bare / n, short / n,
    )
    return np.array(found, np.float32)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1, len(STATISTICS))
        offsets = np.arange(0, rows.size + 1, len(STATISTICS), np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, rows.ravel())], ["doc_id", "statistics"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics) of every row; the texts are read once and go no further."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_measure, "doc_id long, statistics array<float>")


class Features:
    """Standardised statistics to whole-numbered random features: cosines at random frequencies, whose products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.frequency = draw.normal(0, 1 / (WIDTH * len(mean) ** 0.5), (len(mean), FEATURES))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)

    def of(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -FARTHEST, FARTHEST)
        return np.hstack([np.rint(np.cos(z @ self.frequency + self.phase) * STEPS), np.full((len(rows), 1), float(STEPS))])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(STATISTICS))


def _equations(features: Features):
    """One row a task: the sums of z z' and z y of its labelled rows, a matrix a fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, FEATURES + 1, FEATURES + 2), np.int64)
        for batch in slices(batches, ROWS_A_TASK):
            fold, bad, good = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            z = features.of(_rows(batch.column(0)))
            for f in range(4):
                at = fold == f + 1
                weighted = np.hstack([z[at] * (bad + good)[at, None], (STEPS * good[at])[:, None]])
                total[f] += (z[at].T @ weighted).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(4 * (FEATURES + 1) * (FEATURES + 2), np.int64)
    for batch in batches:
        for row in batch.column(0):
            total += np.frombuffer(row.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _summed(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of the tasks' matrices, level by level, so that neither a task nor the driver takes many."""
    while tasks > SUMMED:
        tasks = -(-tasks // SUMMED)
        parts = parts.repartition(tasks).mapInArrow(_added, "sums binary")
    rows = [np.frombuffer(r.sums, np.int64) for r in parts.collect()]
    return sum(rows, np.zeros(4 * (FEATURES + 1) * (FEATURES + 2), np.int64)).reshape(4, FEATURES + 1, FEATURES + 2)


def _solved(sums: np.ndarray) -> np.ndarray:
    """Ridge weights of the normal equations; the last feature is the constant, which is not held small."""
    scaled = sums.astype(np.float64) / STEPS**2
    a, b = scaled[:, :-1], scaled[:, -1]
    hold = np.full(len(a), RIDGE * a[-1, -1] + 1.0)
    hold[-1] = 1e-9
    return np.linalg.solve(a + np.diag(hold), b)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising calibration of sorted places x by pooling adjacent violators: middle and level of every pool."""
    pools: list[list[float]] = []
    for at, g, w in zip(x, good, n, strict=True):
        pools.append([at * w, g, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    found = np.array(pools).reshape(-1, 3)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


class Model:
    """Features, the weights of the whole fit, and the calibration; without labelled rows every score is a half."""

    def __init__(self, features: Features | None = None, weights: np.ndarray | None = None, places: np.ndarray | None = None, levels: np.ndarray | None = None):
        self.features, self.weights, self.places, self.levels = features, weights, places, levels

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(rows), 0.5)
        raw = self.features.of(rows) @ self.weights / STEPS
        return (1 - TIE) * np.interp(raw, self.places, self.levels) + TIE * np.clip((raw + 1) / 3, 0, 1)


def _out_of_fold(features: Features, weights: np.ndarray):
    """(place on the grid, good, all) of labelled rows, each scored by the fit that left its fold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_A_TASK):
            fold, bad, good = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            raw = np.einsum("ij,ij->i", features.of(_rows(batch.column(0))), weights[fold - 1]) / STEPS
            place = np.rint(np.clip(raw, -1, 2) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(good), pa.array(bad + good)], ["place", "good", "n"])

    return run


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """The model of labels(doc_id, quality) on measured documents, from ids whose crc32 as text is not 0 modulo 5.

    All such labels count: rows of labels that share an id are added up before they meet the documents. A null
    quality or id is no label. The four other remainders are the folds: the calibration is fitted on what each fold scores under the
    equations of the other three.
    """
    spark = measured.sparkSession
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & (fold != 0))
    marks = materialise(marks.groupBy("doc_id").agg(F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")), "marks")
    rows = materialise(measured.join(sized_broadcast(marks), "doc_id").select("statistics", fold.alias("fold"), "bad", "good"), "labelled")
    n, each = F.col("bad") + F.col("good"), range(len(STATISTICS))
    sums = rows.agg(F.count("*").alias("rows"), F.sum(n).alias("n"), *(F.sum(n * F.col("statistics")[k]).alias(f"s{k}") for k in each), *(F.sum(n * F.col("statistics")[k] * F.col("statistics")[k].cast("double")).alias(f"q{k}") for k in each)).first()
    if not sums.rows:
        return Model()
    mean = np.array([sums[f"s{k}"] for k in each]) / sums.n
    spread = np.sqrt(np.maximum(np.array([sums[f"q{k}"] for k in each]) / sums.n - mean**2, 0))
    features = Features(np.round(mean, 6), np.round(np.where(spread < 1e-6, 1.0, spread), 6))
    tasks = -(-sums.rows // ROWS_A_TASK)
    equations = _summed(rows.repartition(tasks).mapInArrow(_equations(features), "sums binary"), tasks)
    whole = equations.sum(axis=0)
    weights = np.array([_solved(whole - part) for part in equations])
    places = rows.mapInArrow(_out_of_fold(features, weights), "place long, good long, n long").groupBy("place").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    got = places.toPandas().sort_values("place")  # at most a row a step of the grid
    at, level = isotonic(got.place.to_numpy() / GRID, got.good.to_numpy(np.float64), got.n.to_numpy(np.float64))
    return Model(features, _solved(whole), at, level)


def _score(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_A_TASK):
            score = shared.value.scores(_rows(batch.column(1)))
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    score is the calibrated probability of label 1 by statistics of the whole text alone; predicted is 1 from `least` on. held_out says that the
    crc32 of the id as text is 0 modulo 5: such labels teach nothing. Null and empty texts have statistics of 0 and a score like
    any other; a null id is not held out and has no label; repeated rows are scored each; without labels every score is 0.5; an empty
    table gives an empty result; other columns are never read.
    """
    measured = materialise(measure(docs, id_col, text_col), "measured")
    shared = docs.sparkSession.sparkContext.broadcast(fit(measured, labels))
    return measured.mapInArrow(_score(shared, least), "doc_id long, held_out boolean, score double, predicted int")
