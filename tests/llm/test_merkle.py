import hashlib
import random
import zlib

import pytest

from hearthwave.llm import merkle
from tests.llm.helpers import awkward, documents, empty


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _top(nodes):
    """(the root, the siblings of each node from below)"""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for k in range(len(run)):
                for i in under[s + k]:
                    paths[i].append((run[:k], run[k + 1 :]))
            up.append(_h(*run))
            below.append([i for u in under[s : s + 8] for i in u])
        nodes, under = up, below
    return nodes[0], paths


def _plain(rows):
    """rows: (doc_id, source, lang, n_chars, text) without nulls in doc_id; the manifest by recomputing every node."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0], _leaf(r))) for lang in langs}
    tops = {lang: _top([_leaf(r) for r in t]) for lang, t in trees.items()}
    root, above = _top([tops[lang][0] for lang in langs])
    out = []
    for lang, up in zip(langs, above, strict=True):
        for r, path in zip(trees[lang], tops[lang][1], strict=True):
            text = r[4]
            if zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = _leaf((*r[:4], text))
            for left, right in path + up:
                now = _h(*left, now, *right)
            proof = _h(*(s for left, right in path + up for s in left + right))
            out.append((r[0], _leaf(r), tops[lang][0], root, proof, now, now == root))
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_every_digest_equals_the_recomputed_one(spark, depth):
    """Trees of 0 to 3 levels, within a block and over several; the result doesn't hang on the blocks' size."""
    e = random.Random(3)
    rows = []
    for lang, n in (("en", 150), ("de", 65), ("fr", 64), ("é", 9), ("Z", 8), ("it", 1), (None, 3), ("", 2)):
        rows += [(len(rows) * 7 + i, e.choice(["a", None]), lang, e.choice([5, None]), e.choice(["Text ÄB", "plain", "", None, "X" * 500])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted(tuple(r) for r in merkle.manifest(merkle.leaves(docs), depth).collect())
    assert got == _plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_one_partition_and_one_leaf(spark):
    docs = documents(spark, [(3, "Only one")])
    (r,) = merkle.manifest(merkle.leaves(docs)).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == hashlib.sha256().hexdigest()


def test_folding_hashes_nothing_left_of_the_slot():
    run = [_h(str(i)) for i in range(8)]
    parent = merkle.Parent(run)
    assert parent.digest == _h(*run)
    for slot in range(8):
        step = parent.step(slot)
        assert len(step.right) == 64 * (7 - slot) and len(step.siblings) == 64 * 7
        assert step.fold(_h("new")) == _h(*run[:slot], _h("new"), *run[slot + 1 :])


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = merkle.manifest(merkle.leaves(df)).collect()
    assert len(rows) == df.count() and len({r["root"] for r in rows}) == 1
    again = merkle.manifest(merkle.leaves(df.repartition(5).selectExpr("*", "'x' AS tree", "1 AS pos", "2 AS of"))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert merkle.manifest(merkle.leaves(empty(spark))).count() == 0


def test_ids_of_any_type(spark):
    docs = documents(spark, [(i, f"t{i}") for i in range(20)]).selectExpr("concat('k', doc_id) AS doc_id", "text", "lang", "source", "n_chars")
    rows = merkle.manifest(merkle.leaves(docs)).collect()
    assert {r["doc_id"] for r in rows} == {f"k{i}" for i in range(20)} and len({r["root"] for r in rows}) == 1
