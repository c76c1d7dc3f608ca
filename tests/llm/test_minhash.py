import random

import numpy as np

from hearthwave.llm import minhash, text
from tests.llm.helpers import awkward, documents, empty


def _sets(rows):
    out = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        out[i] = {tuple(w[j : j + 4]) for j in range(max(len(w) - 3, 1))} if w else set()
    return out


def _plain(rows):
    """By all pairs."""
    sets = _sets(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def _found(spark, rows, **more):
    return sorted(tuple(r) for r in minhash.near_duplicates(documents(spark, rows), **more).collect())


def test_links_around_the_similarity(spark):
    """Copies with words behind, in front, cut or edited, just above and below 0.8, some of them exactly at it."""
    e = random.Random(11)
    words = [f"Word{i}" for i in range(3000)]
    rows = []
    for i in range(80):
        base = [e.choice(words) for _ in range(e.randrange(8, 300))]
        extra = [e.choice(words) for _ in range(round((len(base) - 3) * e.choice([0.1, 0.2, 0.24, 0.25, 0.26, 0.3])))]
        copy = [base + extra, extra + base, base[: len(base) - len(extra) * 4 // 5], [*base[:5], "edit", *base[6:]]][i % 4]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " \t".join(copy).upper()), (3 * i + 2, " ".join(base))]
    exact = [f"w{i}" for i in range(83)]  # 80 shingles, and 100 or 101 with what comes behind
    rows += [(900, " ".join(exact)), (901, " ".join(exact + [f"v{i}" for i in range(20)]))]
    half = [f"x{i}" for i in range(83)]
    rows += [(910, " ".join(half)), (911, " ".join(half + [f"y{i}" for i in range(21)]))]
    want = _plain(rows)
    assert (901, 100, 900, False) in want and (911, 101, 911, True) in want
    assert _found(spark, rows) == want


def test_chains_and_large_groups_in_blocks(spark):
    e = random.Random(5)
    base = [f"word{e.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(50):
        base = [*base]
        base[e.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(base)))
    line = " ".join(f"line{i}" for i in range(60))  # a common passage that fills half of unrelated texts
    rows += [(100 + i, line + " " + " ".join(f"own{i}x{k}" for k in range(50))) for i in range(40)]
    assert _found(spark, rows, block=6) == _plain(rows)


def test_awkward_rows(spark):
    rows = minhash.near_duplicates(awkward(spark)).collect()
    told = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in rows)
    assert [t for t in told if t[0] in (1, 2, 3)] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [t for t in told if t[0] == 5] == [(5, 8, 5, True)] * 2 and (-1, 1, None, True) in told and (4, 1, 4, True) in told
    assert minhash.near_duplicates(empty(spark)).count() == 0
    pair = minhash.near_duplicates(documents(spark, [(None, "a b c d e"), (7, "A b c d E")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in pair) == [(0, 7, False), (7, 7, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (np.sort(text.mix(rng.integers(0, 1 << 63, n, dtype=np.uint64))) for n in (500, 300))
    union = np.unique(np.concatenate([a, b]))
    of = [minhash.registers(h, np.zeros(len(h), np.int64), 1)[0] for h in (a, b, union)]
    assert (np.maximum(of[0], of[1]) == of[2]).all()
    for shared, size in ((800, 1000), (500, 1000), (950, 1000)):
        x = text.mix(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        half = (size - shared) // 2
        one, two = (minhash.registers(np.sort(h), np.zeros(len(h), np.int64), 1)[0] for h in (x[: shared + half], np.concatenate([x[:shared], x[shared + half :]])))
        more, less = (one > two).sum(keepdims=True), (one < two).sum(keepdims=True)
        assert abs(minhash.estimated(np.array([0.5]), more, less)[0] - shared / size) < 0.12
