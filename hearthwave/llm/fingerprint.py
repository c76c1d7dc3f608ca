"""Document fingerprints: a homomorphic multiset hash of the paragraphs.

Each paragraph (line) is hashed to a wide vector and a text's fingerprint is the sum of its paragraphs' vectors,
number by number modulo 2**32. So it doesn't mind the paragraphs' order, and a paragraph that comes or goes is
added to or taken from it without the rest of the text. The first DENSE numbers are a digest of the paragraph and
tell whether two multisets of paragraphs are equal; the other SKETCH numbers count the paragraph's word triples
with random signs at random places, and the cosine of two such parts estimates how much two texts share.

Defined cases: a null text counts as empty; an empty text is one empty paragraph. Equal texts have equal
fingerprints and likeness 1; texts without words are like each other only if equal. Repeated rows are documents
of their own. Next to a document, by descending doc_id, comes the one with the next smaller doc_id, then (nulls)
the one without; equal ids go by their texts' digests; after the last comes the first, which may be itself.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

#: Numbers of 32 bits in the two parts of a vector.
DENSE, SKETCH = 32, 256
#: Texts that are hashed together.
STEP = 256


def vectors(texts: list[str]) -> np.ndarray:
    """One row of DENSE + SKETCH numbers (32 bits, unsigned) for each text."""
    lines = [t.encode().split(b"\n") for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    digests = np.frombuffer(b"".join(hashlib.shake_128(p).digest(4 * DENSE) for own in lines for p in own), "<u4").reshape(-1, DENSE)
    dense = np.add.reduceat(digests, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0, dtype=np.uint32)
    sketch = np.concatenate([_sketch(data, offs) for _, _, data, offs in text.chunks(pa.array(texts, pa.string()))])
    return np.concatenate([dense, sketch], axis=1)


def _sketch(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    starts, ends, row = text.spans(data, offs, text.NOT_SPACE)
    h = text.word_hashes(data, starts, ends)
    line = np.searchsorted(np.flatnonzero(data == 0x0A), starts) + row  # grows with each line and each text
    triple = h.copy()
    for lag in (1, 2):
        if len(h) > lag:
            triple[:-lag] += np.where(line[lag:] == line[:-lag], h[lag:] * np.uint64(2 * lag + 1), np.uint64(0))
    triple = text.mix(triple)
    place = row * SKETCH + (triple >> np.uint64(1)).astype(np.int64) % SKETCH
    sign = np.where(triple & np.uint64(1), 1, -1)
    return np.bincount(place, sign, minlength=n * SKETCH).astype(np.int64).astype(np.uint32).reshape(n, SKETCH)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of vectors, row by row: 1 for equal ones, else the cosine of their sketches, from 0 up."""
    x, y = (np.ascontiguousarray(v[:, DENSE:]).view(np.int32).astype(float) for v in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.where(norm > 0, (x * y).sum(1) / np.where(norm > 0, norm, 1), 0.0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0.0, 1.0))


def encode(v: np.ndarray) -> list[str]:
    return [base64.b64encode(row.tobytes()).decode() for row in v.astype("<u4")]


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def added(fingerprint: str, other: str) -> str:
    """The fingerprint of two texts' paragraphs together."""
    return encode((decode(fingerprint) + decode(other))[None])[0]


def removed(fingerprint: str, other: str) -> str:
    """The fingerprint without the paragraphs of ``other``."""
    return encode((decode(fingerprint) - decode(other))[None])[0]


def edited(own: str, following: str) -> str:
    """The last half of the code points replaced by as many, or all, from the start of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, tail, doc_id, text), where each document's next one follows it within its bucket.

    The ids are cut into ranges at their quantiles. The first document of a range also goes, as a tail, to the
    range before, whose last one it follows: a row for each range, so at most ``buckets`` rows are broadcast.
    """
    spark = docs.sparkSession
    least = F.lit(-(1 << 63)).cast("long")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("o"))
    cuts = ids.select(F.col("o").cast("double")).approxQuantile("o", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="as_double", outputCol="as_bucket")

    def bucketed(df: DataFrame) -> DataFrame:
        return cut.transform(df.withColumn("as_double", F.col("o").cast("double"))).withColumn("bucket", F.col("as_bucket").cast("int")).drop("as_double", "as_bucket")

    firsts = sorted(((r["bucket"], r["o"]) for r in bucketed(ids).groupBy("bucket").agg(F.max("o").alias("o")).collect()), reverse=True)
    tails = [(o, firsts[i - 1][0]) for i, (_, o) in enumerate(firsts)]  # the very first goes to the last range
    heads = F.broadcast(spark.createDataFrame(tails, "o long, to int"))
    chosen = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("o"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    placed = bucketed(chosen).join(heads, "o", "left").withColumn("at", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("bucket"), F.lit(1).alias("tail"))))))
    dealt = placed.select("at.bucket", "at.tail", "o", "doc_id", "text").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "tail", F.desc("o"), F.md5("text")).select("bucket", "tail", "doc_id", "text")


def _compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for b in it:
        for at in range(0, b.num_rows, STEP):
            rows = held + b.slice(at, STEP).to_pylist()
            pairs = [(x, y) for x, y in itertools.pairwise(rows) if x["bucket"] == y["bucket"] and not x["tail"]]
            held = rows[-1:]
            if pairs:
                yield _results([x for x, _ in pairs], [y["text"] for _, y in pairs])


def _results(rows: list[dict], following: list[str]) -> pa.RecordBatch:
    texts = [r["text"] for r in rows]
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    known = {t: i for i, t in enumerate(texts)}
    more = [f for f in dict.fromkeys(following) if f not in known]
    known |= {f: len(texts) + i for i, f in enumerate(more)}
    own, new = vectors(texts + more), vectors(changed)
    after, own = own[[known[f] for f in following]], own[: len(texts)]
    columns = {
        "doc_id": pa.array([r["doc_id"] for r in rows], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        "fingerprint": pa.array(encode(own)),
        "edited_fingerprint": pa.array(encode(new)),
        "near_edited": pa.array(likeness(own, new)),
        "near_next": pa.array(likeness(own, after)),
    }
    return pa.RecordBatch.from_pydict(columns)


def compare(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, n).mapInArrow(_compared, kinds)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the fingerprint of each whole text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                found = encode(vectors([x or "" for x in part.column(len(keep)).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found)], names=[*keep, "fingerprint"])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(batches, f"{kinds}, fingerprint string")
