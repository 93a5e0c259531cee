"""Operator 2, quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score). The score is one weight vector over hashed features of the text, shared by
all grades; the thresholds are kept in order. Expected grade and tail probabilities select documents.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textbytes as T

BITS = 16
MARKS = ~T.byte_table("".join(map(chr, range(33, 48))) + "".join(map(chr, range(58, 65))) + "".join(map(chr, range(91, 97))) + "{|}~")


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document, and their borders: lower-cased words and runs of punctuation."""
    data = T.lower(data)
    slots, owner = [], []
    for seed, table in ((0, T.LETTERS_AND_DIGITS), (1, MARKS)):
        start, end, first = T.words(data, offsets, table)
        slots.append((T.fingerprints(data, start, end, seed) >> T.U(64 - bits)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(offsets) - 1), np.diff(first)))
    key = np.unique(np.concatenate(owner) << bits | np.concatenate(slots))
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(offsets)))


def _sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[borders[1:]] - total[borders[:-1]]


def _scale(borders: np.ndarray) -> np.ndarray:
    return 1.0 / np.sqrt(np.maximum(np.diff(borders), 1))


class Ordinal:
    """weights, ordered thresholds, and the grades they separate."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def tails(self, slots: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """(documents, grades - 1): P(grade > k)."""
        score = _sums(self.weights[slots], borders) * _scale(borders)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(slots: np.ndarray, borders: np.ndarray, grade: np.ndarray, bits: int = BITS, rounds: int = 300, rate: float = 0.3, decay: float = 1e-5) -> Ordinal:
    """Full-batch Adam on the negative log likelihood, grades weighted by the square root of their rarity."""
    names = np.unique(grade).tolist()
    level = np.searchsorted(names, grade)
    k = len(names)
    share = np.bincount(level, minlength=k) / max(1, len(level))
    cut = np.clip(np.cumsum(share)[:-1], 1e-3, 1 - 1e-3)
    # thresholds as a first one and the logarithms of the gaps keeps them in order
    start = np.log(cut / (1 - cut))
    param = np.concatenate([np.zeros(1 << bits), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    if k < 2:
        return Ordinal(param[:1 << bits], np.zeros(0), names)
    owner, scale = np.repeat(np.arange(len(level)), np.diff(borders)), _scale(borders)
    weight = (1 / np.sqrt(share))[level]
    weight /= weight.sum()
    m, v = np.zeros_like(param), np.zeros_like(param)
    for t in range(1, rounds + 1):
        w, theta = param[:1 << bits], np.cumsum(np.concatenate([param[1 << bits:(1 << bits) + 1], np.exp(param[(1 << bits) + 1:])]))
        score = _sums(w[slots], borders) * scale
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = 1 / (1 + np.exp(-np.clip(edge[level + 1] - score, -60, 60))), 1 / (1 + np.exp(-np.clip(edge[level] - score, -60, 60)))
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_score = weight * (d_hi - d_lo)
        grad = np.bincount(slots, (by_score * scale)[owner], 1 << bits) + decay * w
        by_theta = np.array([-(weight * d_hi)[level == j].sum() + (weight * d_lo)[level == j + 1].sum() for j in range(k - 1)])
        gaps = np.array([by_theta[j:].sum() for j in range(k - 1)]) * np.concatenate([[1.0], np.exp(param[(1 << bits) + 1:])])
        grad = np.concatenate([grad, gaps])
        m, v = .9 * m + .1 * grad, .999 * v + .001 * grad * grad
        param -= rate * (m / (1 - .9 ** t)) / (np.sqrt(v / (1 - .999 ** t)) + 1e-8) * (1 - .9 * t / rounds)
    theta = np.cumsum(np.concatenate([param[1 << bits:(1 << bits) + 1], np.exp(param[(1 << bits) + 1:])]))
    return Ordinal(param[:1 << bits], theta, names)


def _hash(batches):
    for batch in batches:
        data, offsets = T.batch_of(batch.column("text"))
        slots, borders = features(data, offsets)
        raw = [slots[a:b].astype(np.int32).tobytes() for a, b in zip(borders[:-1], borders[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(raw, pa.binary())], ["grade", "slots"])


def learn(docs: DataFrame, ratings: DataFrame, rows: int = 8_000, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> Ordinal:
    """Fit on at most `rows` rated documents, those with the smallest hash of their id (the documented bound of the
    sample). Ratings without id or grade and documents without text do not count; of several ratings the lowest does."""
    rated = ratings.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).where("doc_id is not null and grade is not null") \
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    got = own.join(F.broadcast(some), "doc_id").select("grade", "text").mapInArrow(_hash, "grade int, slots binary").orderBy("grade", F.xxhash64("slots"), "slots").collect()
    if not got:
        return Ordinal(np.zeros(1 << BITS), np.zeros(0), [])
    each = [np.frombuffer(r["slots"], np.int32) for r in got]
    return fit(np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])]), np.array([r["grade"] for r in got]))


def rate(docs: DataFrame, model: Ordinal, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: expected_grade and tails, P(grade > g) for every grade g but the last.

    NULL and empty texts have no features and get the score 0 of the thresholds alone; without any rating expected_grade is NULL;
    equal rows get equal results; other columns are not looked at.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 weights

    def run(batches):
        model = sent.value
        step = np.diff(model.grades).astype(float) if model.grades else np.zeros(0)
        for batch in batches:
            data, offsets = T.batch_of(batch.column("text"))
            for a, b in T.slices(offsets, B.SLICE):
                tails = model.tails(*features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
                grade = pa.array(model.grades[0] + tails @ step) if model.grades else pa.nulls(b - a, pa.float64())
                edge = np.arange(b - a + 1, dtype=np.int32) * tails.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), grade, pa.ListArray.from_arrays(pa.array(edge), pa.array(tails.reshape(-1)))],
                                                 ["doc_id", "expected_grade", "tails"])
    return own.mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Grades from the given labels: 0 toxic, 1 low quality, 2 good. A document is kept if it is more likely good than not."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    graded = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))
    found = rate(docs, learn(docs, graded))
    above = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    good = F.coalesce(F.get("tails", F.size("tails") - 1), F.lit(1.0))
    return found.select("doc_id", "expected_grade", above.alias("p_not_lowest"), good.alias("p_good"), (good >= 0.5).alias("kept"))
