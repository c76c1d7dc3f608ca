import numpy as np

from hearthwave.llm import quality
from tests.llm.helpers import awkward, documents, empty


def _corpus(spark, n=300):
    rows, labels = [], []
    for i in range(n):
        if i % 4 == 0:
            rows.append((i, f"BUY NOW!! " * 20 + str(i)))
        else:
            rows.append((i, f"the river number {i} runs slowly past the old mill and people walk along it every day."))
        labels.append((i, int(i % 4 != 0), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = _corpus(spark)
    rows = quality.score(docs, labels).collect()
    assert len(rows) == 300 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_stage_keeps_rows_and_columns(spark):
    docs, labels = _corpus(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if i % 4}


def test_awkward_rows(spark):
    _, labels = _corpus(spark)
    df = awkward(spark)
    rows = quality.score(df, labels).collect()
    assert len(rows) == df.count() and all(np.isfinite(r["score"]) for r in rows)
    assert quality.score(empty(spark), labels).count() == 0
    none = quality.score(df, labels.where("false")).collect()
    assert {r["score"] for r in none} == {1.0}


def test_discriminant_is_the_gaussian_difference(spark):
    e = np.random.default_rng(0)
    x = e.normal(size=(50, quality.N))
    means = np.stack([np.zeros(quality.N), np.ones(quality.N)])
    model = quality.Discriminant(means, np.stack([np.eye(quality.N), 2 * np.eye(quality.N)]), np.array([0.0, 2 * quality.N * np.log(2)]), 0.0)
    want = -0.5 * (((x - 1) ** 2).sum(1) / 4 + 2 * quality.N * np.log(2)) + 0.5 * (x**2).sum(1)
    assert np.allclose(model.log_odds(x), want)


def _plain_statistics(text):
    raw = (text or "").encode()
    words = raw.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    kinds = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b"#$%&*@^~<>{}[]=+_\\/`", b"|", b"!", b"\n", bytes(range(128, 256))]
    near = sum(words[i] in words[i + 1 : i + 9] for i in range(len(words)))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(sum(map(len, words)) / w), np.sqrt(sum(len(x) > 20 for x in words) / w),
        *(np.arcsin(np.sqrt(sum(b in k for b in raw) / n)) for k in kinds), np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / w), np.sqrt(near / w),
    ]


def test_scores_against_a_plain_version(spark):
    """Statistics text by text, covariances by numpy, inverses and determinants for the densities, and the line over all rows."""
    e = np.random.default_rng(2)
    words = ["the", "river", "Mill", "10", "it!", "a" * 25, "über", "x|y", "#tag", "and"]
    texts = [" ".join(e.choice(words, size=e.integers(0, 40), p=p)) for p in ([0.1] * 10, [0.3, 0.3, 0.2, 0.02, 0.02, 0.02, 0.02, 0.02, 0.05, 0.05]) for _ in range(300)]
    docs = documents(spark, list(enumerate([*texts, None, "\n\n"])))
    labels = spark.createDataFrame([(i, int((i >= 300) != (i % 11 == 0)), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    x = np.array([_plain_statistics(t) for t in [*texts, None, "\n\n"]])
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    used = np.array([i for i in range(600) if not got[i]["held_out"]])
    y = np.array([int((i >= 300) != (i % 11 == 0)) for i in used])
    covs = [np.cov(x[used[y == k]].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
    shrunk = [0.95 * (0.7 * c + 0.3 * pooled) + 0.05 * np.trace(0.7 * c + 0.3 * pooled) / len(c) * np.eye(len(c)) for c in covs]
    density = []
    for k, c in enumerate(shrunk):
        d = x - x[used[y == k]].mean(0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]) + np.log((y == k).mean()))
    odds = density[1] - density[0]
    slope, shift = quality.line(odds[used], y.astype(float), np.ones(len(y)))
    want = 1 / (1 + np.exp(-np.clip(slope * odds + shift, -500, 500)))
    assert np.allclose([got[i]["score"] for i in range(len(x))], want, atol=2e-3)


def test_two_texts_a_hundred_thousand_times(spark):
    """A line is fitted however few texts there are, and the driver gets bins, not rows."""
    from pyspark.sql import functions as F

    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "BUY NOW!! now").otherwise("the river runs slowly").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    wrong = quality.score(docs, labels).where("predicted <> doc_id % 2")
    assert wrong.count() == 0
    assert quality.score(docs, labels.where("quality = 1")).where("score < 1").count() == 0
