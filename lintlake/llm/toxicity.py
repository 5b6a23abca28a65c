"""Toxic passages as maximal-scoring segments of token log-odds, calibrated by extreme-value statistics.

Learning counts in how many texts of either label a word or word beginning occurs, takes its log-odds under a Dirichlet
prior of the labels' overall shares, and keeps the significant ones. Scoring adds a word's log-odds and a
constant negative drift along the text and finds all maximal segments in one linear scan. How high the best segment of a
clean text of that length gets by chance follows an extreme-value law, whose parameters come from clean labelled texts; the
excess of the segments over it becomes a probability by a logistic fit on labelled rows kept out of the counts.

Counts are pre-aggregated in the tasks before they are shuffled. Only significant features and the labelled sample, both
bounded by ``max_labelled``, reach the driver; scoring itself is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import sliced, texts_of

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
CACHE_WORDS = 200_000


@dataclass(frozen=True)
class ToxicModel:
    """Features with their log-odds, and the calibration of segment scores."""

    weights: dict[str, float]
    drift: float
    rate: float  # lambda of the extreme-value law
    log_k: float
    logistic: tuple[float, float, float]  # of the best segment's excess, of all excess, constant
    significant: float


class _Scores(dict):
    """Score of a word: that of the longest known beginning, less the drift."""

    def __init__(self, weights: dict[str, float], drift: float) -> None:
        self.weights, self.drift = weights, drift

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self.weights.get(f"{word}$")
        for n in reversed(PREFIXES):
            if found is not None:
                break
            found = self.weights.get(word[:n]) if len(word) >= n else None
        value = self[word] = (found or 0.0) - self.drift
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in text order, in linear time.

    Every segment knows the nearest one before it that starts at a lower total, so a search that passes it also passes all between.
    """
    ahead = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, place of a lower start
    for at in np.nonzero(scores > 0)[0].tolist():
        first, end, low, high = at, at + 1, ahead[at], ahead[at + 1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                break
            first, low, lower = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = lower
        stack.append((first, end, low, high, j))
    return [(first, end, high - low) for first, end, low, high, _ in stack]


def features_of(text: str) -> set[str]:
    """The distinct words ("word$") and word beginnings of a text."""
    words = set(WORD.findall(text.lower()))
    found = {f"{w}$" for w in words}
    for n in PREFIXES:
        found.update(w[:n] for w in words if len(w) >= n)
    return found


def _count_features(rows: DataFrame) -> DataFrame:
    """feature, clean, toxic: texts that have it, by label. Each task adds up before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in seen]],
                names=["feature", "clean", "toxic"])
            for c in seen:
                c.clear()
            return out

        for batch in sliced(batches):
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(features_of(text))
            if len(seen[0]) + len(seen[1]) > CACHE_WORDS:
                yield flush()
        yield flush()

    return rows.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def significant_features(rows: DataFrame, prior: float = 4.0, least_z: float = 3.5) -> dict[str, float]:
    """Log-odds of the words and word beginnings whose share of toxic texts differs by ``least_z`` deviations.

    The Dirichlet prior of a feature is the labels' overall shares, worth ``prior`` texts.
    """
    totals = rows.agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).collect()[0]
    if not totals["clean"] or not totals["toxic"]:
        return {}
    share = totals["toxic"] / (totals["clean"] + totals["toxic"])
    toxic, clean = F.col("toxic") + prior * share, F.col("clean") + prior * (1 - share)
    scored = _count_features(rows).select(
        "feature", (F.log(toxic) - F.log(clean) - float(np.log(share / (1 - share)))).alias("weight"),
        F.sqrt(1 / toxic + 1 / clean).alias("deviation"))
    kept = scored.where(F.abs("weight") >= least_z * F.col("deviation")).select("feature", "weight").collect()
    return {r["feature"]: r["weight"] for r in kept}


def token_scores(words: list[str], known: _Scores) -> np.ndarray:
    """Scores of a text's words in order; a word right after itself adds nothing but the drift."""
    scores = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
    for at in np.nonzero(scores > 0)[0].tolist():
        if at and words[at] == words[at - 1]:
            scores[at] = -known.drift
    return scores


def _segment_rows(rows: DataFrame, weights: dict[str, float], drift: float) -> DataFrame:
    """toxic, n tokens, scores of the maximal segments, for labelled rows; and the histogram of their token scores."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(shared.value, drift)
        for batch in sliced(batches):
            out = []
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                scores = token_scores(words, known)
                bins, counts = np.unique(np.round(scores * 20), return_counts=True)
                out.append((toxic, len(words), [s for _, _, s in maximal_segments(scores)],
                            dict(zip(bins.astype(int).tolist(), counts.tolist(), strict=True))))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.float64())),
                 pa.array([list(m.items()) for m in columns[3]], pa.map_(pa.int32(), pa.int64()))],
                names=["toxic", "n", "segments", "bins"])

    return rows.select("text", "toxic").mapInArrow(scan, "toxic int, n long, segments array<double>, bins map<int,long>")


def _rate(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum(p * exp(rate * value)) = 1; the mean value is negative."""
    share = counts / counts.sum()
    if values.max(initial=-1.0) <= 0 or (share * values).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (share * np.exp(high * values)).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(middle * values)).sum() < 1 else (low, middle)
    return high


def excess_of(segments: list[float], n: int, rate: float, log_k: float) -> tuple[float, float]:
    """The best segment's excess over what chance gives in n tokens, and the logarithm of the sum of all excesses."""
    chance = np.log(max(n, 1)) + log_k
    over = [rate * s - chance for s in segments]
    return max(over, default=-chance), float(np.log1p(sum(x for x in over if x > 0)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(y))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def learn(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 200_000, drift: float = 0.5, prior: float = 4.0,
    least_z: float = 3.5, significant: float = 0.0,
) -> ToxicModel:
    """Fit on labelled rows: three quarters of them give the log-odds, one quarter the calibration.

    ``labels`` has doc_id and toxic; null or other labels are ignored, of repeated ids the largest label counts. At most
    about ``max_labelled`` labelled ids are used, picked by a hash of the id: that is the bound of everything that
    reaches the driver or is broadcast. Without both labels the model knows no words and scores every text alike.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = usable.count()
    share = min(1.0, max_labelled / max(count, 1))
    usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("pick")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(usable.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")), "doc_id")  # <= max_labelled rows
    quarter = F.pmod(F.xxhash64("doc_id", F.lit("quarter")), F.lit(4))
    weights = significant_features(rows.where(quarter != 0), prior, least_z)
    if not weights:
        return ToxicModel({}, drift, 1.0, 0.0, (0.0, 0.0, -2.0), significant)
    held = _segment_rows(rows.where(quarter == 0), weights, drift).persist()
    bins = held.where("toxic = 0").select(F.explode("bins").alias("bin", "count")).groupBy("bin").agg(F.sum("count").alias("count")).collect()
    rate = _rate(np.array([r["bin"] / 20 for r in bins]), np.array([r["count"] for r in bins], np.float64))
    found = [(r["toxic"], r["n"], list(r["segments"])) for r in held.select("toxic", "n", "segments").toLocalIterator()]
    held.unpersist()
    clean = [rate * max(s, default=0.0) - np.log(max(n, 1)) for toxic, n, s in found if not toxic]
    log_k = float(np.mean(clean) - np.euler_gamma) if clean else 0.0  # mean of the extreme-value law
    x = np.array([excess_of(s, n, rate, log_k) for _, n, s in found]).reshape(-1, 2)
    logistic = _fit_logistic(x, np.array([t for t, _, _ in found], np.float64)) if found else (0.0, 0.0, -2.0)
    return ToxicModel(weights, drift, rate, log_k, logistic, significant)


def held_out(column: str = "doc_id") -> Column:
    """True for the fifth of the ids that no label may be learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out("doc_id"))


def score_documents(docs: DataFrame, model: ToxicModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted, passages (first word, end word, score, excess) and the ``carry`` columns.

    Whole texts are scanned; a null or empty text has no passage and gets the score of a text without any. Every
    passage above chance for its text's length is returned. Repeated rows are scored alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = _Scores(m.weights, m.drift)
        for batch in sliced(batches):
            scores, passages = [], []
            for text in texts_of(batch, "_text"):
                words = WORD.findall(text.lower())
                segments = maximal_segments(token_scores(words, known))
                best, total = excess_of([s for _, _, s in segments], len(words), m.rate, m.log_k)
                a, b, c = m.logistic
                scores.append(1 / (1 + np.exp(-np.clip(a * best + b * total + c, -40, 40))))
                chance = np.log(max(len(words), 1)) + m.log_k
                passages.append([{"first": f, "end": e, "score": s, "excess": m.rate * s - chance}
                                 for f, e, s in segments if m.rate * s - chance > m.significant])
            kept = [batch.column(n) for n in batch.schema.names if n != "_text"]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("excess", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)],
                names=[*[n for n in batch.schema.names if n != "_text"], "score", "predicted", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("text").cast("string").alias("_text"))
    passage = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()),
                            T.StructField("score", T.DoubleType()), T.StructField("excess", T.DoubleType())])
    return rows.mapInArrow(scan, T.StructType([
        *[f for f in rows.schema if f.name != "_text"], T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("passages", T.ArrayType(passage))]))
