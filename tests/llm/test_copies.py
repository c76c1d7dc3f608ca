import random

from pyspark.sql import functions as F

from hearthwave.llm import copies, graph, rows as keys
from tests.llm.helpers import awkward, documents, empty


def test_stage_keeps_one_of_each_group(spark):
    e = random.Random(2)
    words = [f"word{i}" for i in range(500)]
    rows, keep = [], set()
    for i in range(30):
        base = [e.choice(words) for _ in range(150)]
        edited = [*base]
        edited[70] = "changed"
        rows += [(10 * i + 3, " ".join(base)), (10 * i + 1, " ".join(edited)), (10 * i + 5, " ".join(base))]
        keep.add(10 * i + 1)
    docs = documents(spark, rows)
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == keep
    df = awkward(spark)
    left = copies.keep_one(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"]) == [1, 4, 5, 7, 8]
    assert copies.keep_one(empty(spark)).count() == 0


def _sets(rows):
    out = {}
    for i, t in rows:
        w = t.lower().split()
        out[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()
    return out


def _first_of_each(rows):
    sets = _sets(rows)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in ids}


def test_stage_finds_all_pairs_of_similarity_from_08(spark):
    """Copies with words added in front or behind, cut or edited, just above and just below 0.8, and a common line."""
    e = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    line = " ".join(f"line{i}" for i in range(30))
    rows = []
    for i in range(60):
        base = [e.choice(words) for _ in range(e.randrange(60, 300))]
        extra = [e.choice(words) for _ in range(round((len(base) - 4) * e.choice([0.1, 0.2, 0.24, 0.25, 0.26, 0.3])))]
        copy = [base + extra, extra + base, base[: len(base) - len(extra) * 4 // 5]][i % 3]
        texts = [" ".join(base), " ".join(copy)]
        rows += [(2 * i + k, t + (" " + line if i % 2 else "")) for k, t in enumerate(texts)]
    exact = [f"w{i}" for i in range(84)]  # 80 shingles, and 100 or 101 with what comes behind
    rows += [(500, " ".join(exact)), (501, " ".join(exact + [f"v{i}" for i in range(20)])), (502, "a b c d e f"), (503, "b c d e f g h")]
    half = [f"x{i}" for i in range(84)]
    rows += [(600, " ".join(half)), (601, " ".join(half + [f"y{i}" for i in range(21)]))]
    want = _first_of_each(rows)
    assert 500 in want and 501 not in want and 601 in want
    assert {r["doc_id"] for r in copies.keep_one(documents(spark, rows)).collect()} == want


def test_stage_joins_chains_and_large_groups_in_blocks(spark):
    e = random.Random(9)
    words = [f"word{i}" for i in range(900)]
    base = [e.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        base = [*base]
        base[e.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(base)))
    docs = documents(spark, rows)
    told = copies.with_prefix(docs, ["doc_id"])
    nodes = told.select(F.struct("doc_id").alias("first"), "node", "n", "parities", "wide", "prefix")
    roots = copies.near_copies(docs, nodes, block=5)
    group = {r["doc_id"]: r["root"] for r in told.join(roots, "node", "left").select("doc_id", "root").collect()}
    want = _first_of_each(rows)
    assert len({root if root is not None else -i - 1 for i, root in group.items()}) == len(want)


def test_long_texts_by_their_wide_parities(spark):
    """Sets of more than 1,024 shingles, of similarities around 0.8, some just above a power of two in size."""
    e = random.Random(4)
    rows = []
    for i in range(24):
        base = [f"w{e.randrange(10**6)}" for _ in range(e.choice([1028, 1500, 2052, 2060, 4000]))]
        extra = [f"v{e.randrange(10**6)}" for _ in range(round((len(base) - 4) * e.choice([0.1, 0.24, 0.26, 0.4])))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + extra))]
    want = _first_of_each(rows)
    assert 24 < len(want) < 48
    assert {r["doc_id"] for r in copies.keep_one(documents(spark, rows)).collect()} == want


def test_rows_that_differ_in_one_column_only(spark):
    """Equal rows leave one; among rows of equal id and text the choice doesn't hang on their order."""
    rows = [(1, "a b c", "s"), (1, "a b c", "t"), (1, None, "s"), (1, "", "s"), (2, None, None), (3, "x y z", "s"), (3, "x y z", "s")]
    docs = documents(spark, rows).withColumn("_key", F.lit("own")).withColumn("key", F.lit(1)).withColumn("bits", F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1))))
    got = [sorted(map(str, copies.keep_one(df).collect())) for df in (docs, docs.orderBy(F.desc("source")).repartition(3))]
    assert got[0] == got[1] and len(got[0]) == 3 and all("_key='own'" in r for r in got[0])


def test_rows_told_apart_by_id(spark):
    docs = documents(spark, [(i, str(i)) for i in range(500)] + [(None, "n")])
    alone, others = keys.by_id(docs, docs.where("doc_id % 50 = 0 or doc_id is null"))
    ids = {r["doc_id"] for r in others.collect()}
    assert alone.count() + len(ids) == 501 and ids >= {None, *range(0, 500, 50)} and len(ids) < 20


def test_stage_holds_the_pairs_of_fingerprints_against_their_sets(spark, monkeypatch):
    """SimHash by its anchors comes first: pairs of at most three differing bits, of which only similar ones are kept."""
    e = random.Random(11)
    words = [f"word{i}" for i in range(4000)]
    rows = []
    for i in range(20):
        base = [e.choice(words) for _ in range(400)]
        edited = [*base]
        edited[200] = "changed"
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(edited)), (3 * i + 2, " ".join(base + base))]
    rows += [(100, "one two"), (101, "two one"), (102, "")]
    docs = documents(spark, rows)
    nodes = copies.with_prefix(docs, ["doc_id"]).groupBy("node").agg(F.min("fp").alias("fp"))
    fps = {r["node"]: r["fp"] for r in nodes.collect()}
    pairs = {(r["a"], r["b"]) for r in copies.by_fingerprints(nodes).collect()}
    near = {(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3}
    assert len(near) > 10 and {tuple(sorted(p)) for p in pairs} <= near
    joined = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert all(joined[a] == joined[b] for a, b in near)

    asked = []
    similar = copies.similar
    monkeypatch.setattr(copies, "similar", lambda p, n, d: asked.append({tuple(sorted((r["a"], r["b"]))) for r in p.collect()}) or similar(p, n, d))
    assert {r["doc_id"] for r in copies.keep_one(docs).collect()} == _first_of_each(rows)
    assert asked[0] == {tuple(sorted(p)) for p in pairs}
