"""Operator 1, quality classifier: regularised quadratic discriminant analysis.

A document becomes FEATURES transformed statistics. For each class the covariance of the labelled
rows is drawn to the pooled one, then to a multiple of the identity. How far, and by how much log odds are
softened, is what predicts best (log loss) over the inner folds of the labelled rows, by crc32 of doc_id.
The Cholesky factor of each class is cached in the model, so a score is two triangular solves
(Mahalanobis distances), a difference of log densities and a sigmoid.

Defined results: a null text counts as empty; a null doc_id is scored, held_out is false and it is
never learned from; labels other than 0 and 1 are ignored; a doc_id labelled twice counts with its
lowest label; one with several texts counts once, with the lowest statistics; without labels of one class the score
is the share of label 1 (no labels: 0.5); repeated rows are each scored alike; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

FEATURES = 17
#: Labelled rows that a model is fitted on, at most: those with the lowest hash of doc_id.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
#: What is tried: shares of the pooled covariance and of the identity, and divisors of the log odds. Of equals the first is taken.
TO_POOLED, TO_IDENTITY, TEMPERATURES = (0.9, 0.7, 0.5, 0.3, 0.1), (0.2, 0.05, 0.01), (8.0, 4.0, 2.0, 1.0)
THRESHOLD = 0.3

_EPS = 1e-3
_BYTES = np.zeros((8, 256))
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"!?", b".,;:'\"()-", b"|", b" \t\n\r\x0b\x0c")):
    _BYTES[_row, list(_chars)] = 1


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    text = text or ""
    out = np.zeros(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, lower, digits, symbols, shouts, points, bars, blanks = _BYTES @ counts
    solid = max(1.0, len(raw) - blanks)
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    repeats = sum(map(str.__eq__, words, words[1:]))
    triples = max(1, n - 2)
    fresh = len(set(zip(words, words[1:], words[2:]))) if n > 2 else triples
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    known = len(set(lines))
    out[:] = (
        math.log1p(n),
        math.log1p(lengths.mean() if n else 0),
        math.log1p(lengths.std() if n else 0),
        math.log(_EPS + upper / max(1.0, upper + lower)),
        math.log(_EPS + digits / solid),
        math.log(_EPS + symbols / solid),
        math.log(_EPS + shouts / solid),
        math.log(_EPS + points / solid),
        math.log(_EPS + bars / solid),
        math.log(_EPS + counts[128:].sum() / solid),
        math.log(_EPS + distinct / max(1, n)),
        math.log(_EPS + repeats / max(1, n)),
        math.log(_EPS + 1 - fresh / triples),
        math.log(_EPS + 1 - known / max(1, len(lines))),
        math.log1p(n / max(1, len(lines))),
        (lengths <= 3).mean() if n else 0,
        math.log1p(len(lines)),
    )
    return out


@dataclass(frozen=True)
class Model:
    """Class means, Cholesky factors and log determinants on standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]
    log_odds: float
    constant: float | None = None
    pooled: float = 0.0
    identity: float = 0.0
    temperature: float = 1.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [-0.5 * (solve_lower(f, z - m) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return density[1] - density[0] + self.log_odds

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 0.5 * (1 + np.tanh(self.odds(x) / self.temperature / 2))


def solve_lower(low: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """y with low y = row for each row, by forward substitution."""
    out = np.empty_like(rows)
    for j in range(len(low)):
        out[:, j] = (rows[:, j] - out[:, :j] @ low[j, :j]) / low[j, j]
    return out


def discriminant(x: np.ndarray, y: np.ndarray, pooled: float, identity: float, temperature: float = 1.0) -> Model:
    """The model of rows of both classes."""
    centre, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6))
    z = (x - centre) / scale
    own = [z[y == k] for k in (0, 1)]
    means = [r.mean(0) for r in own]
    scatter = [(r - m).T @ (r - m) for r, m in zip(own, means)]
    both, factors, log_dets = sum(scatter) / len(x), [], []
    for r, s in zip(own, scatter):
        # few rows lean more on the pooled covariance
        a = max(pooled, FEATURES / (FEATURES + len(r)))
        cov = (1 - a) * s / len(r) + a * both
        cov = (1 - identity) * cov + (identity * np.trace(cov) / FEATURES + 1e-6) * np.eye(FEATURES)
        factors.append(np.linalg.cholesky(cov))
        log_dets.append(2 * float(np.log(np.diag(factors[-1])).sum()))
    return Model(centre, scale, tuple(means), tuple(factors), tuple(log_dets), math.log(len(own[1]) / len(own[0])), None, pooled, identity, temperature)


def fit_rows(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Model:
    """The model of labelled rows; its shrinkage and temperature have the least log loss over the folds."""
    zero = np.zeros(FEATURES)
    if len(np.unique(y)) < 2:
        return Model(zero, zero + 1, (), (), (), 0.0, float(y.mean()) if len(y) else 0.5)
    loss: dict[tuple[float, float, float], float] = {}
    for pooled in TO_POOLED:
        for identity in TO_IDENTITY:
            for k in np.unique(fold):
                rest = fold != k
                if len(np.unique(y[rest])) < 2:
                    continue
                odds = discriminant(x[rest], y[rest], pooled, identity).odds(x[~rest])
                for t in TEMPERATURES:
                    key = (pooled, identity, t)
                    loss[key] = loss.get(key, 0.0) + float(np.logaddexp(0, np.where(y[~rest] == 1, -odds, odds) / t).sum())
    best = min(loss, key=lambda k: round(loss[k], 6)) if loss else (TO_POOLED[0], TO_IDENTITY[0], TEMPERATURES[0])
    return discriminant(x, y, *best)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False)) if isinstance(doc_id, str) else F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sample_of(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` rows (doc_id, label) outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    one = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the labelled documents. The sample is bounded by `rows`, so it may be broadcast, and its statistics reach the driver."""
    joined = docs.select("doc_id", "text").join(F.broadcast(sample_of(labels, rows)), "doc_id").select(F.col("doc_id").cast("long"), "text", "label")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [statistics(t).tolist() for t in batch["text"]]})

    found = joined.mapInPandas(partial, "doc_id long, label int, x array<double>")
    one = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x"))
    known = sorted(one.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % FOLDS).collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in known]).reshape(-1, FEATURES)
    return fit_rows(x, np.array([r["label"] for r in known], int), np.array([r["fold"] for r in known], int))


def scorer(model: Model):
    """A pandas UDF text -> score."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            x = np.stack([statistics(t) for t in batch]) if len(batch) else np.zeros((0, FEATURES))
            yield pd.Series(model.scores(x))

    return score


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    scored = docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns."""
    return docs.where(scorer(model)(docs["text"]) >= threshold)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
