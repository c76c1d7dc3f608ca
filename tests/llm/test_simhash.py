import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearthwave.llm import graph, simhash
from tests.llm.helpers import awkward, documents, empty


def _plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, threshold=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(spark):
    e = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [e.choice(words) for _ in range(e.randrange(1, 200))]
        rows.append((3 * i, " ".join(base)))
        rows.append((3 * i + 1, " ".join(base)))
        base[e.randrange(len(base))] = "edited"
        rows.append((3 * i + 2, " ".join(base)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    fps = [_plain(t) for _, t in rows]
    roots = _components(fps)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, i), i)
    for (i, _), fp, root in zip(rows, fps, roots, strict=True):
        assert got[i]["fingerprint"] == f"{fp:016x}" and got[i]["component_id"] == least[root]


def test_anchors_meet_within_three_bits():
    e = np.random.default_rng(3)
    a = e.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in e.choice(64, e.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    index_a, found_a = simhash.anchors(a)
    index_b, found_b = simhash.anchors(b)
    for i in range(400):
        assert set(found_a[index_a == i].tolist()) & set(found_b[index_b == i].tolist())


def test_large_anchor_in_blocks(spark):
    fps = [1 << i for i in range(40)] + [0]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.links(df, block=5)
    assert {r["root"] for r in graph.components(links).collect()} == {0}


def test_dense_anchors_lose_no_link(spark):
    """Fingerprints that share one half, or nearly: all pairs, by bytes and in blocks."""
    e = np.random.default_rng(8)
    fps = []
    for high in (0x12345678, 0x92345678):
        base = e.integers(0, 1 << 32, 60, dtype=np.uint64)
        for b in base:
            fps += [int(b) | high << 32, int(b ^ (np.uint64(1) << np.uint64(e.integers(32)))) | (high ^ 1) << 32, int(b ^ np.uint64(0x01000101)) | high << 32]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    roots = _components([f & (1 << 64) - 1 for f in fps])
    want = sorted(sorted(f for f, r in zip(fps, roots, strict=True) if r == root) for root in set(roots))
    for block in (5, 40, 20_000):
        found = graph.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block)).collect()
        group = {r["node"]: r["root"] for r in found}
        got = {}
        for f in fps:
            got.setdefault(group.get(f, f), []).append(f)
        assert sorted(sorted(x) for x in got.values()) == want


def test_forest_joins_what_pairs_join():
    e = np.random.default_rng(5)
    sigs = np.uint64(7) ^ (np.uint64(1) << e.integers(0, 12, 200).astype(np.uint64))
    joined = {0}
    for a, b in simhash.forest(sigs, 2):
        joined |= set(a.tolist()) | set(b.tolist())
    assert joined == set(range(200))


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[3]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 1
    assert by[5]["component_id"] == 5 and by[None]["component_id"] is None
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    rows = graph.components(links).collect()
    assert len(rows) == 201 and {r["root"] for r in rows} == {0}
    assert graph.components(links.where("false")).count() == 0


def test_links_of_a_batch_are_joined_at_once(spark):
    """Rounds are shuffles: a chain or a dense group that one batch holds takes two of them, the last one a check."""
    chain = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + j) for i in range(30) for j in range(i)]
    rows = graph.components(spark.createDataFrame(chain, "a long, b long").coalesce(1), rounds=2).collect()
    assert len(rows) == 231 and {r["root"] for r in rows} == {0, 1000}
    a, b = graph.stars(np.array([5, 7, 9, 4]), np.array([7, 9, 3, 4]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(5, 3), (7, 3), (9, 3)]
