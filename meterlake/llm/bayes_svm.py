"""Quality classifier: naive Bayes support vectors.

A text is the set of its hashed n-grams of bytes, and of indicators of how much of it repeats
runs of three words. Each indicator is scaled by the logarithm of the ratio of its smoothed
frequency among good and among bad rows, each text is scaled to length one, and a linear model
with hinge loss is fitted by dual coordinate descent. A logistic curve, fitted on rows set aside,
turns the margin into a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.store import kept
from meterlake.llm.text import LOWER, gram_hashes, lists, mix, texts, word_hashes

FEATURES = 1 << 17
GRAM_SIZES = (3, 4)
#: Indicators of the share of repeated runs of three words, in tenths: at least 0.1, 0.2, ...
LEVELS = 9
PIECE = 1 << 20

#: Bound of the sample of labelled rows that the model is fitted on: those with the least hash.
FIT_ROWS = 5000
THRESHOLD = 0.3


def indicators(text: bytes | None) -> np.ndarray:
    """Sorted indices of the n-grams that a text has; a null text has none."""
    text = text or b""
    there = np.zeros(FEATURES, dtype=bool)
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    for low in range(0, data.size, PIECE):
        part = data[low : low + PIECE + max(GRAM_SIZES) - 1]
        for n in GRAM_SIZES:
            if part.size >= n:
                code = np.full(part.size - n + 1, np.uint64(n), dtype=np.uint64)
                for k in range(n):
                    code = (code << np.uint64(8)) | part[k : part.size - n + 1 + k]
                there[(mix(code) % np.uint64(FEATURES - LEVELS)).astype(np.int64)] = True
    runs = gram_hashes(word_hashes(text.translate(LOWER)), 3)
    if runs.size:
        repeated = 1 - np.unique(runs).size / runs.size
        there[FEATURES - LEVELS : FEATURES - LEVELS + int(10 * repeated)] = True
    return np.flatnonzero(there).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of an indicator, ratio times coefficient
    squares: np.ndarray  # of the ratio
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(self.squares[found].sum()))
        return (float(self.weights[found].sum()) / length if length > 0 else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def log_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = [np.ones(FEATURES), np.ones(FEATURES)]
    for found, label in zip(rows, good, strict=True):
        counts[int(label)][found] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def hinge_fit(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, costs: np.ndarray, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Minimum of |w|^2 / 2 + sum of cost * max(0, 1 - sign * (w x + b)), one dual variable at a
    time; b is the weight of a constant input of 1."""
    weights, bias, dual = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (float(values[i] @ weights[rows[i]]) + bias) - 1
            after = min(max(dual[i] - gradient / norms[i], 0.0), costs[i])
            step = (after - dual[i]) * sign[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                dual[i] = after
        if moved < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, good: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with targets drawn in from 0 and 1. Each
    row stands for `times` rows."""
    n1, n0 = times[good].sum(), times[~good].sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(margins.size)])
    beta = np.array([2.0, float(np.log((n1 + 1) / (n0 + 1)))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (times * (target - p)) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit(rows: list[np.ndarray], good: np.ndarray, times: np.ndarray | None = None) -> Model:
    """Model of labelled indicator sets; each stands for `times` sets of its class. Without rows of
    both classes every text gets the share of good rows as its score, or one half without rows."""
    good = np.asarray(good, dtype=bool)
    times = np.ones(len(rows)) if times is None else times
    if len(rows) == 0 or good.all() or not good.any():
        share = (times[good].sum() + 1) / (times.sum() + 2)
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(rows)) % 4 == 3
    if min(good[aside].sum(), (~good[aside]).sum(), good[~aside].sum(), (~good[~aside]).sum()) < 5:
        aside = np.zeros(len(rows), dtype=bool)  # too few rows: the curve is fitted on all
    own = np.flatnonzero(~aside)
    ratios = log_ratios([rows[i] for i in own], good[own])
    values = []
    for found in rows:
        v = ratios[found]
        length = np.sqrt(v @ v)
        values.append((v / length if length > 0 else v).astype(np.float32))
    share = good[own].mean()
    costs = np.where(good[own], 0.5 / share, 0.5 / (1 - share))
    weights, bias = hinge_fit([rows[i] for i in own], [values[i] for i in own], np.where(good[own], 1.0, -1.0), costs)
    model = Model((weights * ratios).astype(np.float32), (ratios**2).astype(np.float32), bias, 1.0, 0.0)
    of_curve = np.flatnonzero(aside) if aside.any() else np.arange(len(rows))
    slope, offset = logistic_curve(np.array([model.margin(rows[i]) for i in of_curve]), good[of_curve], times[of_curve])
    return Model(model.weights, model.squares, bias, slope, offset)


def held_out(parts: int, at: int):
    """True for rows whose CRC of doc_id as text leaves the remainder `at`; a null id is '' here."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == at


def _indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists([indicators(t) for t in texts(batch.column(2))], pa.int32())], ["at", "good", "found"])


def class_sizes(totals: dict[bool, int], rows: int) -> dict[bool, int]:
    """Rows of each class in a sample: all of the rarer class up to one half, the other fills up."""
    rare = min((False, True), key=lambda c: totals.get(c, 0))
    few = min(totals.get(rare, 0), rows // 2)
    return {rare: few, not rare: min(totals.get(not rare, 0), rows - few)}


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits on at most `rows` labelled documents that are not held out: of each class those with the
    least hash of doc_id, of the rarer class as many as there are up to one half. The score's curve
    counts a row as often as its class was thinned. Null labels and ids, and ids with both labels,
    are not used; of the rows of one id the one with the least text is."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(5, 0)).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    known = kept(known.where("low = high").select("doc_id", (F.col("low") > 0).alias("good"), F.xxhash64("doc_id", F.lit(9)).alias("at")), "classifier-labels")
    totals = {r.good: r["count"] for r in known.groupBy("good").count().collect()}  # two classes
    sizes = class_sizes(totals, rows)
    sample = reduce(DataFrame.union, [known.where(F.col("good") == c).orderBy("at").limit(n) for c, n in sizes.items()])
    # the sample has a fixed bound of 17 bytes a row, so it can go to every task
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("at", "good").agg(F.min("text").alias("text"))
    found = chosen.mapInArrow(_indicator_rows, "at long, good boolean, found array<int>").orderBy("at").toArrow()
    lists_ = found.column("found").combine_chunks()
    flat, ends = lists_.values.to_numpy(), lists_.offsets.to_numpy()
    good = np.array(found.column("good").to_pylist(), dtype=bool)
    thinned = {c: totals.get(c, 0) / n if n else 1.0 for c, n in sizes.items()}
    return fit([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], good, np.where(good, thinned[True], thinned[False]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of (doc_id, text), learnt from the labels
    (doc_id, quality) of rows that are not held out. Null and empty texts get the score of a text
    without n-grams; equal texts get equal scores; other columns are ignored."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(indicators(t)) for t in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns. It learns from the labelled
    rows of `learn_from` (doc_id, text), or else of docs. Where an earlier step has taken out the bad
    rows, docs holds one class only, and a model of one class would accept every text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs if learn_from is None else learn_from, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.value.score(indicators(t)) >= THRESHOLD for t in texts(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
