"""Toxicity: a cumulative-link ordinal regression from sparse word features to severity grades.

Grades run from 0 (not toxic) to GRADES. One weight vector over the words is shared by all thresholds: the
chance of grade k or more is logistic(w x - t_k), with t_1 < t_2 < ...; severity is the expected grade.

The model is fitted on a bounded sample of the labelled documents (``sample_rows``, taken by the hash of doc_id).
The labels only tell toxic from not, so a toxic document's grade comes from its number of cue words, cut at the
thirds of the toxic documents; cue words are those at least ten times as frequent among toxic documents. Features
are the words, and the beginnings of longer words, that tell most about the label.

Defined cases: a null or empty text has no words and gets the grade that no words lead to. Labels that are null
or of unknown documents are not used. Without labels of both kinds every document gets severity 0. Repeated rows
get equal results; rows with a null ``doc_id`` are scored and never used to fit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text
from .quality import held_out

GRADES = 3
#: Most labelled documents from which the model is fitted, about, and most words in it.
SAMPLE_ROWS, WORDS = 20_000, 256
#: A word is looked at if so many documents of the sample have it.
LEAST_DOCS = 4
#: Lengths of the words' beginnings that are features too.
BEGINNINGS = (4, 5)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b if text.ALNUM[b] else 0x20 for b in range(256))


@dataclass(frozen=True)
class Ordinal:
    """Weights by word, and the thresholds from grade 1 up."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 40.0))

    def chances(self, linear: np.ndarray) -> np.ndarray:
        """Of grade 1 or more, 2 or more, ...: one row per document."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds, -60, 60)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, rounds: int = 800, rate: float = 0.1, penalty: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative link model, by gradient steps (Adam) on the mean log-likelihood.

    penalty: of the squared weights, against the whole sample's likelihood.
    """
    n, k = x.shape
    share = np.array([(grades >= g).mean() for g in range(1, GRADES + 1)])
    first = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    steps = np.log(np.maximum(np.diff(first), 0.1))
    p = np.concatenate([np.zeros(k), first[:1], steps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    at = np.arange(n)
    for i in range(1, rounds + 1):
        t = np.concatenate([p[k : k + 1], p[k] + np.cumsum(np.exp(p[k + 1 :]))])
        f = 1 / (1 + np.exp(-np.clip((x @ p[:k])[:, None] - t, -40, 40)))
        edges = np.concatenate([np.ones((n, 1)), f, np.zeros((n, 1))], axis=1)
        low, high = edges[at, grades], edges[at, grades + 1]
        chance = np.maximum(low - high, 1e-9)
        d_linear = 1 - low - high
        d_t = np.zeros((n, GRADES + 2))
        d_t[at, grades] -= low * (1 - low) / chance
        d_t[at, grades + 1] += high * (1 - high) / chance
        d_t = d_t[:, 1:-1].mean(0)
        gaps = np.exp(p[k + 1 :])
        slope = np.concatenate([x.T @ d_linear / n - penalty / n * p[:k], [d_t.sum()], [d_t[j + 1 :].sum() * gaps[j] for j in range(GRADES - 1)]])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        p = p + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return p[:k], np.concatenate([p[k : k + 1], p[k] + np.cumsum(np.exp(p[k + 1 :]))])


def weighed(counts: np.ndarray) -> np.ndarray:
    """What a token's count is worth as a feature: 1 for the first, then with the logarithm."""
    return np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0)


def tokens(words: Column) -> Column:
    """The words, and the beginnings of longer ones (of four and five letters, marked by a star), repeats included."""

    def beginnings(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    return F.concat(words, *map(beginnings, BEGINNINGS))


def tokens_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(y, words) of about ``sample_rows`` labelled documents outside the held-out fourth, equal texts once."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(n, 1))))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.dropDuplicates(["y", "text"]).select("y", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"))


def vocabulary_of(rows: DataFrame, n: dict[int, int], words: int) -> list:
    """The tokens that tell most about the label (log-likelihood ratio), at most ``words`` rows: word, ratio."""
    seen = rows.select("y", F.explode(F.array_distinct(tokens(F.col("words")))).alias("word")).groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    docs, total = F.col("bad") + F.col("good"), float(n[0] + n[1])

    def part(count: Column, expected: Column) -> Column:
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    gain = sum((part(F.col(c), docs * n[y] / total) + part(n[y] - F.col(c), (total - docs) * n[y] / total) for y, c in ((0, "good"), (1, "bad"))), F.lit(0.0))
    ratio = ((F.col("bad") + 0.5) / (n[1] + 1)) / ((F.col("good") + 0.5) / (n[0] + 1))
    return seen.where(docs >= LEAST_DOCS).select("word", ratio.alias("ratio"), gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(words).collect()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, words: int = WORDS) -> Ordinal:
    rows = store.written(sample(docs, labels, sample_rows), "toxicity")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return Ordinal()
    vocabulary = vocabulary_of(rows, n, words)
    index = {r["word"]: i for i, r in enumerate(vocabulary)}
    if not index:
        return Ordinal()

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [Counter(index[t] for w in own for t in tokens_of(w) if t in index) for own in pdf["words"]]
            yield pd.DataFrame({"y": pdf["y"], "places": [list(c) for c in found], "counts": [list(c.values()) for c in found]})

    counted = rows.mapInPandas(count, "y int, places array<int>, counts array<int>").toPandas()  # about sample_rows rows
    x = np.zeros((len(counted), len(index)))
    for i, (places, counts) in enumerate(zip(counted["places"], counted["counts"], strict=True)):
        x[i, places] = counts
    cues = [index[r["word"]] for r in vocabulary if r["ratio"] >= 10]
    cue = x[:, cues].sum(1)
    y = counted["y"].to_numpy()
    cuts = np.quantile(cue[y == 1], [i / GRADES for i in range(1, GRADES)])
    grades = np.where(y == 1, 1 + np.searchsorted(cuts, cue, side="left"), 0)
    weights, thresholds = fit_ordinal(weighed(x), grades)
    return Ordinal({w: float(weights[i]) for w, i in index.items()}, thresholds)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, severity (0 to GRADES), grade, score (chance of any toxicity), toxic."""
    model = fit(docs, labels, sample_rows)
    known = model.weights

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[str]] = {}  # the known tokens of each word seen so far

        def linear(raw: str) -> float:
            counts: Counter[str] = Counter()
            for w, c in Counter(raw.lower().encode().translate(_TABLE).split()).items():
                own = held.get(w)
                if own is None:
                    own = held[w] = [t for t in tokens_of(w.decode()) if t in known]
                for t in own:
                    counts[t] += c
            if len(held) > 200_000:
                held.clear()
            return sum(known[t] * (1 + math.log(c)) for t, c in counts.items())

        for b in it:
            f = model.chances(np.array([linear(x.as_py() or "") for x in b.column(1)], dtype=float))
            grade = (f >= 0.5).sum(1)
            columns = [b.column(0), pa.array(f.sum(1)), pa.array(grade, pa.int32()), pa.array(f[:, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, grade int, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "score", (F.col("grade") > 0).cast("int").alias("toxic"))
