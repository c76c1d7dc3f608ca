"""Near-duplicates by SetSketch registers: banded, estimated jointly by likelihood, then verified on whole sets.

A document's set are its distinct four-word shingles. A register is the least of the set's exponential hash values,
truncated to a power of BASE: registers of a union are the larger ones of its parts, and those of two sets are equal
with about the probability of their Jaccard similarity. Bands of registers bring sets together; two sets of one band are
a likely pair unless the likelihood of their registers (how many are larger in one, in the other, and equal, given both
sizes) speaks against a similarity of 0.8. What sizes and parities prove to be apart isn't looked at further; the other
likely pairs are held against each other's whole sets. Two sets of
similarity 0.8 miss each other in all bands with a probability of 2e-10, and fail the likelihood with one below 1e-9.

Groups of sets that share a band, large ones too, are compared as those of the pipeline's near copies are
(``copies.near_copies``): first as few pairs as would join a group, then all likely pairs that are still not joined.

Defined cases: a null or blank text has the empty set, is linked with nothing and its own component; a text of fewer
than four words is one shingle; equal sets are linked. A component is named by its smallest doc_id (null if all are
null); rows of equal doc_id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import copies, decontaminate, store, text

#: Words of a shingle.
SHINGLE = 4
#: Registers of a band, and bands.
WIDTH, BANDS = 5, 56
REGISTERS = WIDTH * BANDS
#: Registers are whole powers of BASE, up to TOP; RATE is that of the exponential hash values.
BASE, TOP, RATE = 1.001, (1 << 16) - 1, 20.0
#: The similarity in hundredths, the chance with which a pair of it may be ruled out by mistake, and the registers looked at first.
SIMILAR, CHANCE, EARLY = 80, 1e-10, 64
_GEN = np.random.Generator(np.random.PCG64(42))
_SALTS = _GEN.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_FACTORS = _GEN.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(rows, REGISTERS): the registers of each row's set of hashes (by row); 0 where it is empty."""
    out = np.zeros((n, REGISTERS), np.uint16)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    x = (h >> np.uint64(32)).astype(np.uint32)
    values, least = np.empty_like(x), np.empty((REGISTERS, len(first)), np.uint32)
    for i in range(REGISTERS):
        np.bitwise_xor(x, _SALTS[i], out=values)
        np.multiply(values, _FACTORS[i], out=values)
        np.minimum.reduceat(values, first, out=least[i])
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    out[row[first]] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16).T
    return out


def _hashed(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell each row's set."""
    sums = np.zeros((2, n), np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        for s, salt in zip(sums, (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)), strict=True):
            s[row[first]] = np.add.reduceat(text.mix(h ^ salt), first)
    return sums[0], sums[1]


def sketched(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and of each whole text the size of its set, 128 bits that tell it (h1, h2), its registers and its parities."""

    def make(h: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
        h1, h2 = _hashed(h, row, n)
        packed = pa.array([r.tobytes() for r in registers(h, row, n)], pa.binary())
        bits = copies.lists(copies.odd(h, row, n, copies.PARITIES).ravel(), np.repeat(np.arange(n), copies.PARITIES), n)
        return [pa.array(np.bincount(row, minlength=n).astype(np.int64)), copies.longs(h1), copies.longs(h2), packed, bits, copies.wide(h, row, n)]

    kinds = {"n": "bigint", "h1": "bigint", "h2": "bigint", "registers": "binary", "parities": "array<bigint>", "wide": "array<bigint>"}
    return copies.mapped(docs, keep, make, kinds, size=SHINGLE)


def bands(packed: str) -> Column:
    """One number for the registers of each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(packed, k * (2 * WIDTH) + 1, F.lit(2 * WIDTH))))


# ---- the joint likelihood of two sets' registers


def _chance(x: np.ndarray) -> np.ndarray:
    """The chance that a register is larger in one set, from the share of the union that only this set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Log-likelihood of the similarity j, of sets whose sizes are as u : 1 - u and ``more`` and ``less`` of whose registers are larger and smaller."""
    p, q = _chance(u - (1 - u) * j), _chance((1 - u) - u * j)
    tiny = 1e-300
    same = np.maximum(1 - p - q, tiny)
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + (REGISTERS - more - less) * np.log(same)


def estimated(u: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, by thirds: the likelihood has one summit."""
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    for _ in range(24):
        third = (high - low) / 3
        left = likelihood(low + third, u, more, less) < likelihood(high - third, u, more, less)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def least_equal(of: int) -> int:
    """So many of ``of`` registers are equal at least, but for CHANCE, in two sets of the similarity."""
    p, tail = SIMILAR / 100, 0.0
    for k in range(of + 1):
        tail += comb(of, k) * p**k * (1 - p) ** (of - k)
        if tail > CHANCE:
            return k
    return of


_EARLY_EQUAL, _EQUAL, _SPEAKS = least_equal(EARLY), least_equal(REGISTERS), -np.log(CHANCE)


def by_registers(t: pa.Table) -> copies.Near:
    """Those of the others that sizes, parities and the likelihood of all registers allow to be similar."""
    proven = copies.by_parities(t)
    n = t.column("n").to_numpy()
    all_ = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    early = np.ascontiguousarray(all_[:, :EARLY])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        to = others[100 * np.minimum(n[others], n[i]) >= SIMILAR * np.maximum(n[others], n[i])]
        if len(to):
            to = to[np.count_nonzero(early[to] == early[i], axis=1) >= _EARLY_EQUAL]
        to = proven(i, to) if len(to) else to
        if not len(to):
            return to
        same = np.count_nonzero(all_[to] == all_[i], axis=1)
        to, same = to[same >= _EQUAL], same[same >= _EQUAL]
        return to[allowed(n[i] / (n[i] + n[to]), np.count_nonzero(all_[i] > all_[to], axis=1), same)] if len(to) else to

    return near


def allowed(u: np.ndarray, more: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether the likelihood of a pair's registers doesn't speak against the similarity: its summit is there or above, or not much higher."""
    less = REGISTERS - same - more
    bound = np.minimum(SIMILAR / 100, np.minimum(u / (1 - u), (1 - u) / u))
    held = likelihood(bound, u, more, less)
    out = likelihood(bound * (1 - 1e-6), u, more, less) <= held  # it still rises
    open_ = np.flatnonzero(~out)
    if len(open_):
        u, more, less = u[open_], more[open_], less[open_]
        out[open_] = likelihood(estimated(u, more, less), u, more, less) - held[open_] <= _SPEAKS
    return out


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) of nodes whose whole sets have the similarity, written.

    A bitmap of fixed size leaves the texts that are in no pair where they are.
    """
    pairs = store.written(copies.possible(pairs, nodes), "pairs")
    asked = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "h1", "h2", "first")
    bitmap = decontaminate.bitmap_of(asked.select(F.xxhash64("first.doc_id").alias("fp")))

    def make(h: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
        h1, h2 = _hashed(h, row, n)
        return [copies.longs(h1), copies.longs(h2), copies.lists(h, row, n)]

    whole = copies.mapped(docs, [], make, {"h1": "bigint", "h2": "bigint", "shingles": "array<bigint>"}, bitmap, SHINGLE)
    sets = store.written(whole.join(asked.select("node", "h1", "h2"), ["h1", "h2"]).dropDuplicates(["node"]).select("node", "shingles"), "sets")
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    links = store.written(met.where(100 * F.col("both") >= SIMILAR * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"), "links")
    store.drop(sets)
    store.drop(pairs)
    return links


EVIDENCE = copies.Evidence(["n", "registers", "parities"], by_registers, confirmed)


def near_duplicates(docs: DataFrame, block: int = copies.BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; equal sets are one node, whatever their number."""
    table = store.written(sketched(docs, ["doc_id"]), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    classes = table.where("n > 0").groupBy("h1", "h2").agg(F.min(first).alias("first"), *(F.first(c).alias(c) for c in ("n", "registers", "parities", "wide")))
    nodes = store.written(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = copies.near_copies(docs, nodes.withColumn("prefix", bands("registers")), block, EVIDENCE)
    named = nodes.select("node", "h1", "h2", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    of = store.written(named.join(least, "root").select("h1", "h2", F.col("least.doc_id").alias("component_id"), F.lit(True).alias("linked")), "classes")
    store.drop(roots)
    store.drop(nodes)
    told = table.select("doc_id", "h1", "h2", F.col("n").alias("n_shingles")).join(of, ["h1", "h2"], "left")
    out = told.select("doc_id", "n_shingles", F.when(F.col("linked") & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: For DuckDB: all pairs of sets by their common shingles, and all that is reached over links.
ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM split
), shingles AS (SELECT doc_id, unnest(s) AS x FROM sets
), links AS (
  SELECT p.a, p.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b WHERE 100 * p.n >= 80 * (len(x.s) + len(y.s) - p.n)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) ON a = doc_id
"""
