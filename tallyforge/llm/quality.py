"""Quality selection by ordinal cumulative-link regression on graded ratings.

A text becomes the set of its hashed features: its words, its runs of punctuation, and its shape (share of capitals, of
punctuation, of repeated words, in steps). All grades share one weight for each feature; ordered thresholds cut the score
into grades, P(grade > k) = sigmoid(score - threshold_k). Expected grade and tail probability serve the selection.

The model is fitted on a bounded sample of the rated documents, at most about `rated_rows`, chosen by a hash of the id;
everything else is done for every row. A null or empty text has shape features only. Without rated documents, or with
ratings of one grade only, the thresholds stay infinite: every document has that grade (0 if there is none) with certainty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pytext import memory, tidied

#: Documents that the model is fitted on, at most in expectation; hashed features; least documents of a feature.
RATED_ROWS, FEATURES, LEAST_DOCS = 20_000, 1 << 18, 4
ROUNDS, RATE, RIDGE = 300, 0.15, 5e-5
#: Features that may pass the score test by chance, over all of them: most words say nothing about the grade.
BY_CHANCE = 0.1
#: Least probability of the top grade for a document to be selected.
LEAST_TAIL = 0.7
PIECES = re.compile(r"\w+|[^\w\s]+").findall
KEPT = 200_000


class Places(dict):
    """Place of a word's or punctuation run's feature, remembered while there is room."""

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        at = self[piece] = xxhash.xxh64_intdigest(piece) % FEATURES
        return at


_PLACES = memory(Places())


def shape(text: str, pieces: list[str], distinct: int) -> list[str]:
    """Features of form, as shares in steps."""
    n = len(text)
    marks = len(pieces) - sum(map(str.isalnum, pieces))
    words = max(1, len(pieces) - marks)
    capitals = sum(1 for p in pieces if p.isupper() and len(p) > 1)
    repeated = sum(1 for a, b in zip(pieces, pieces[1:], strict=False) if a.lower() == b.lower())
    steps = {"length": min(12, n.bit_length()), "marks": int(10 * marks / max(1, len(pieces))), "capitals": int(10 * capitals / words), "repeats": int(10 * repeated / max(1, len(pieces))), "distinct": int(10 * distinct / max(1, len(pieces)))}
    return [f"\x00{k}={v}" for k, v in steps.items()]


def features(text: str | None) -> np.ndarray:
    """The distinct places of a text's features, ascending."""
    text = text or ""
    pieces = PIECES(text)
    distinct = set(map(str.lower, pieces))
    return np.unique(np.fromiter(map(_PLACES.__getitem__, [*distinct, *shape(text, pieces, len(distinct))]), np.int32))


@dataclass
class Ordinal:
    """weights of the features and ascending thresholds; grade k of 0..len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def _parts(rows: list[np.ndarray], size: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and row numbers of some rows at a time."""
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        yield np.concatenate(part), np.repeat(np.arange(at, at + len(part)), [len(r) for r in part])


def likelihood(theta: np.ndarray, cuts: int, rank: np.ndarray, of: np.ndarray, column: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood less the ridge, and its gradient.

    theta: the first threshold, the logarithms of the gaps to the others, the weights. Row of[i] has the feature column[i].
    """
    n, w = len(rank), theta[cuts:]
    t = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:cuts]))])
    z = np.bincount(of, weights=w[column], minlength=n)
    upper = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -40, 40))), np.zeros((n, 1))], axis=1)
    slope = upper * (1 - upper)
    i = np.arange(n)
    p = np.maximum(upper[i, rank] - upper[i, rank + 1], 1e-12)
    dz = (slope[i, rank] - slope[i, rank + 1]) / p
    dt = np.zeros((n, cuts + 2))
    dt[i, rank] -= slope[i, rank] / p
    dt[i, rank + 1] += slope[i, rank + 1] / p
    dt = dt[:, 1:-1].sum(axis=0)
    grad = np.concatenate([[dt.sum()], [dt[k:].sum() * np.exp(theta[k]) for k in range(1, cuts)], np.bincount(column, weights=dz[of], minlength=len(w))]) / n
    grad[cuts:] -= ridge * w
    return float(np.log(p).mean() - ridge / 2 * (w @ w)), grad


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE, least: int = LEAST_DOCS, by_chance: float = BY_CHANCE) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam over all rows. Features of fewer than `least` rows, and those that do not pass a score test against thresholds alone, get no weight; about `by_chance` of all pass without cause."""
    present = sorted(set(grades.tolist()))
    if len(present) < 2:
        grade = present[0] if present else 0
        return Ordinal(np.zeros(FEATURES, np.float32), np.where(np.arange(top) < grade, -np.inf, np.inf))
    n, rank = len(rows), np.searchsorted(present, grades)  # grades that do not occur are no threshold
    cuts = len(present) - 1
    share = np.array([(rank > k).mean() for k in range(cuts)])
    above = np.concatenate([[1.0], share, [0.0]])
    residual = (1 - above[rank] - above[rank + 1])  # of the score, when thresholds are all there is
    residual = residual - residual.mean()
    times, moved = np.zeros(FEATURES), np.zeros(FEATURES)
    for part, of in _parts(rows):
        times += np.bincount(part, minlength=FEATURES)
        moved += np.bincount(part, weights=residual[of], minlength=FEATURES)
    used = times >= least
    screen = NormalDist().inv_cdf(1 - by_chance / max(1, used.sum()))
    used &= np.abs(moved) >= screen * np.sqrt(np.maximum(times * (1 - times / n), 1e-9) * residual.var())
    kept = [(part[used[part]], of[used[part]]) for part, of in _parts(rows)]
    place, of = (np.concatenate([x[k] for x in kept]) if kept else np.empty(0, np.int64) for k in (0, 1))
    names, column = np.unique(place, return_inverse=True)
    w = np.zeros(len(names))
    low, gaps = np.log((1 - share[0]) / share[0]), np.log(np.maximum(1e-3, np.diff(np.log((1 - share) / share))))
    theta = np.concatenate([[low], gaps, w])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        _, grad = likelihood(theta, cuts, rank, of, column, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    t = theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:cuts]))])
    weights = np.zeros(FEATURES, np.float32)
    weights[names] = theta[cuts:]
    # a threshold between grades that occur stands for all the thresholds up to the next grade that does
    whole = np.array([-np.inf if k < present[0] else np.inf if k >= present[-1] else t[np.searchsorted(present, k, side="right") - 1] for k in range(top)])
    return Ordinal(weights, whole)


def rated_sample(docs: DataFrame, ratings: DataFrame, rated_rows: int = RATED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(grade, text) of about `rated_rows` rated documents at most. ratings: the id and `grade`; null grades are left out."""
    rated = ratings.where("grade is not null").where(F.col(id_col).isNotNull())
    n = rated.count()
    if n > rated_rows:
        rated = rated.where(F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 60)) < int(rated_rows / n * (1 << 60)))
    return docs.select(id_col, text_col).join(F.broadcast(rated.select(id_col, "grade")), id_col).select("grade", F.col(text_col).alias("text"))  # rated_rows rows


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array([features(x.as_py()) for x in batch.column("text")], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("grade"), rows], names=["grade", "places"])


def train(docs: DataFrame, ratings: DataFrame, top: int, rated_rows: int = RATED_ROWS, **ids) -> Ordinal:
    """The model for grades 0..top."""
    found = rated_sample(docs, ratings.withColumn("grade", F.col("grade").cast("int")), rated_rows, **ids).mapInArrow(tidied(_featured), "grade int, places array<int>").toArrow()
    places = found.column("places").combine_chunks()
    values, ends = places.values.to_numpy(), places.offsets.to_numpy()
    order = np.lexsort([[xxhash.xxh64_intdigest(values[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)], found.column("grade").to_numpy()]) if len(places) else []
    return fit([values[ends[i] : ends[i + 1]] for i in order], found.column("grade").to_numpy()[order] if len(places) else np.empty(0, int), top)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows with expected_grade and tail, the probability of the top grade; columns of these names are replaced."""
    docs = docs.drop("expected_grade", "tail")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for batch in batches:
            z = np.array([weights[features(x.as_py())].sum() for x in batch.column(text_col)], np.float64)
            tails = shared.value.tails(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1].copy())], names=[*batch.schema.names, "expected_grade", "tail"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    out = StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail", DoubleType())])
    return docs.mapInArrow(tidied(graded), out)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade 0, 1 or 2: a point for quality and one for not being toxic. Of a doc_id's labels the lowest holds."""
    both = F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")
    return labels.select("doc_id", both.alias("grade")).where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
