"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class of labelled documents gets a mean and a covariance of the statistics. The covariances are shrunk
towards the pooled one and towards a multiple of the identity, factored once (Cholesky), and a document's
score is the difference of the two Gaussian log-densities, put on a 0-1 scale by a fitted logistic line.

Defined cases: a null text counts as empty, and an empty text has all-zero statistics and is scored like any
other. Labels that are null, and labels of unknown documents, are not used. A document with several labels
counts once for each. Rows with a null ``doc_id`` are scored and never used to fit. Without rows of both
classes the score is the share of class 1 (1.0 without any label). Other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text

#: The statistics, in the order of the feature vector. They see the text alone.
STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "upper", "digits", "marks", "symbols", "bars", "bangs",
    "breaks", "wide_bytes", "repeats", "near_repeats",
)
N = len(STATISTICS)
#: Log-odds count up to MOST_ODDS to either side for the logistic line, in so many bins for each 1.
MOST_ODDS, BINS = 200, 20

_KIND = np.zeros(256, dtype=np.int64)
for _kind, _members in enumerate(("", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-?", "#$%&*@^~<>{}[]=+_\\/`", "|", "!", "\n")):
    _KIND[list(_members.encode())] = _kind
_KIND[0x80:] = 8
_KINDS = 9


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text, all of it read."""
    parts = []
    for first, end, data, offs in text.chunks(column):
        n = end - first
        size = np.diff(offs).astype(float)
        kinds = np.bincount(np.repeat(np.arange(n) * _KINDS, np.diff(offs)) + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
        starts, ends, row = text.spans(data, offs, text.NOT_SPACE)
        h = text.word_hashes(data, starts, ends)
        words = np.bincount(row, minlength=n).astype(float)

        def share(mask: np.ndarray, row: np.ndarray = row, n: int = n, words: np.ndarray = words) -> np.ndarray:
            return np.bincount(row[: len(mask)][mask], minlength=n) / np.maximum(words, 1)

        again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        near = np.zeros(max(len(h) - 1, 0), dtype=bool)
        for lag in range(1, 9):
            if len(h) > lag:
                near[: len(h) - lag] |= (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        per_char = kinds / np.maximum(size, 1)[:, None]
        parts.append(
            np.column_stack(
                [
                    np.log1p(size), np.log1p(words), np.log1p(np.bincount(row, ends - starts, minlength=n) / np.maximum(words, 1)), np.sqrt(share(ends - starts > 20)),
                    *(np.arcsin(np.sqrt(per_char[:, k])) for k in (1, 2, 3, 4, 5, 6, 7, 8)), np.sqrt(share(again)), np.sqrt(share(near)),
                ]
            )
        )
    return np.concatenate(parts) if parts else np.zeros((0, N))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the statistics as an array; the texts stay on the executors."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = statistics(b.column(len(keep)))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], values], names=[*keep, "x"])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(batches, f"{kinds}, x array<double>")


def forward(factor: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Solves ``factor @ z = d`` for a lower triangular factor, row after row, all columns of d at once."""
    z = np.empty_like(d)
    for i in range(len(factor)):
        z[i] = (d[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass(frozen=True)
class Discriminant:
    """Means and Cholesky factors of both classes (0, then 1), the log prior odds and the logistic line."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    odds: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            z = forward(factor, (x - mean).T)
            density.append(-0.5 * (np.einsum("ij,ij->j", z, z) + log_det))
        return density[1] - density[0] + self.odds

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(x) + self.shift, -500, 500)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products by class, from rows (y, x): summed in each task, then by Spark."""

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + N + N * N))
        for pdf in it:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                for y in (0, 1):
                    own = x[pdf["y"].to_numpy() == y]
                    total[y] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"y": np.repeat([0, 1], total.shape[1]), "i": np.tile(np.arange(total.shape[1]), 2), "v": total.ravel()})

    sums = rows.mapInPandas(partial, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for y, own in sums.groupby("y"):
        v = own.sort_values("i")["v"].to_numpy()
        out[int(y)] = (v[0], v[1 : 1 + N], v[1 + N :].reshape(N, N))
    return out


def gaussians(by: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float, ridge: float) -> Discriminant:
    """From counts, sums and sums of products of both classes."""
    counts = [by[y][0] for y in (0, 1)]
    means = np.stack([by[y][1] / by[y][0] for y in (0, 1)])
    own = [by[y][2] / by[y][0] - np.outer(means[y], means[y]) for y in (0, 1)]
    both = (own[0] * counts[0] + own[1] * counts[1]) / sum(counts)
    factors = []
    for cov in own:
        shrunk = (1 - pooled) * cov + pooled * both
        shrunk = (1 - ridge) * shrunk + ridge * (np.trace(shrunk) / N + 1e-9) * np.eye(N)
        factors.append(np.linalg.cholesky(shrunk))
    return Discriminant(means, np.stack(factors), np.array([2 * np.log(np.diag(f)).sum() for f in factors]), math.log(counts[1] / counts[0]))


def fit(rows: DataFrame, pooled: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """From rows (y 0/1, x statistics), all of them.

    pooled: weight of the pooled covariance in each class's own. ridge: weight of the mean variance times the
    identity in that. The logistic line is fitted to the rows' log-odds in bins, at most 2 * (2 * MOST_ODDS * BINS + 1)
    of which come to the driver.
    """
    by = moments(rows)
    counts = {y: by[y][0] if y in by else 0.0 for y in (0, 1)}
    if min(counts.values()) < 1:
        total = sum(counts.values())
        blank = np.zeros((2, N))
        return Discriminant(blank, np.stack([np.eye(N)] * 2), np.zeros(2), 0.0, constant=counts[1] / total if total else 1.0)
    model = gaussians(by, pooled, ridge)

    def binned(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            z = np.clip(model.log_odds(np.stack(pdf["x"].to_numpy())), -MOST_ODDS, MOST_ODDS) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"y": pdf["y"], "z": z, "bin": np.rint(z * BINS).astype(np.int64)}).groupby(["y", "bin"], as_index=False).agg(z=("z", "sum"), n=("z", "count"))

    bins = rows.mapInPandas(binned, "y int, bin long, z double, n long").groupBy("y", "bin").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas().sort_values(["y", "bin"])
    slope, shift = line((bins["z"] / bins["n"]).to_numpy(float), bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    return Discriminant(model.means, model.factors, model.log_dets, model.odds, slope, shift)


def line(z: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-2) -> tuple[float, float]:
    """Logistic regression of y on z, each row counting n times, by Newton's method, the slope held to the positive side."""
    total = n.sum()
    scale = max(float(np.abs(z) @ n / total), 1e-9)
    design, w = np.column_stack([z / scale, np.ones(len(z))]), np.array([1.0, 0.0])
    target = (y * (total - 2) + 1) / total if total > 2 else y
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (n * p * (1 - p))) @ design + penalty * np.eye(2), design.T @ (n * (p - target)) + penalty * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(w[0], 1e-3) / scale, float(w[1])


def held_out(doc_id: Column) -> Column:
    """True for the fourth of the documents from which nothing is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(statistics_table: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, x) of the labelled documents outside the held-out fourth."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return statistics_table.join(known.select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id").select("y", "x")


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    table = store.written(with_statistics(docs, ["doc_id"]), "statistics")
    model = fit(training_rows(table, labels))

    @F.pandas_udf("double")
    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    scored = table.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, columns as they are, that the classifier doesn't reject."""
    table = store.written(with_statistics(docs, ["doc_id"]), "statistics")
    model = fit(training_rows(table, labels))
    store.drop(table)
    at = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield b.filter(pa.array(model.scores(statistics(b.column(at).cast(pa.string()))) >= threshold))

    return docs.mapInArrow(batches, docs.schema)
