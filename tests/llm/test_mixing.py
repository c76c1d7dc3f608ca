from hearthwave.llm import mixing
from tests.llm.helpers import awkward, documents, empty


def _targets(sizes):
    """By the wording: share by weight, stop at three times the size, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, full = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = 3.0 * sizes[s]
        left = sum(sizes.values()) - sum(full.values())


def test_targets_and_taken(spark):
    rows, n = [], 0
    for source, docs, words in (("a", 5, 3), ("b", 40, 50), (None, 3, 7), ("c", 30, 20), ("Z", 1, 1)):
        for _ in range(docs):
            rows.append((n, "w " * (words + n % 5), source))
            n += 1
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    size, source = {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want, taken = _targets(sizes), {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-9 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    longest = {s: max(size[i] for i, x in source.items() if x == s) for s in sizes}
    assert sum(taken.values()) == sum(int(want[s] + 0.5) for s in sizes)
    assert all(want[s] - longest[s] <= taken[s] <= want[s] + sum(longest.values()) for s in sizes)
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())
    assert sorted(got) == sorted(mixing.mix(docs, bucket_rows=3, least_buckets=1).collect())


def test_queue_is_sorted_by_finish_time_and_ends_with_the_budget(spark):
    docs = documents(spark, [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)] + [(99, "w " * 500, "c")])
    everything = 3 * sum(i % 7 + 1 for i in range(60)) + 1500
    for ranges in (1, 7, 512):
        rows = sorted(mixing.queue(mixing.plan(docs), ranges).collect(), key=lambda r: r["position"])
        assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
        at = 0
        for r in rows:
            assert r["position"] == at and r["used"] == max(0, min(r["size"], r["budget"] - at))
            at += r["size"]
        assert sum(r["used"] for r in rows) == rows[0]["budget"] <= at <= everything
        cut = [r for r in rows if 0 < r["used"] < r["size"]]
        assert len(cut) <= 1  # the entry at the budget alone
        if ranges == 1:
            assert at > rows[0]["budget"] and (cut or any(r["used"] == 0 for r in rows))  # the budget cuts entries off


def test_entries_beyond_the_budget_are_not_used(spark):
    """Two sources of many short documents: whole entries of both finish after the budget is spent."""
    docs = documents(spark, [(i, "w " * (i % 3 + 1), "ab"[i % 2]) for i in range(400)])
    rows = mixing.queue(mixing.plan(docs), 2).collect()
    assert sum(r["used"] for r in rows) == rows[0]["budget"]
    assert {r["source"] for r in rows if r["used"] == 0} == {"a", "b"}


def test_sums_before_each_range(spark):
    import itertools
    import random

    e = random.Random(1)
    sums = {r: e.randrange(1, 50) for r in e.sample(range(1000), 200)}
    got = {r["range"]: r["ahead"] for r in mixing.ahead(spark.createDataFrame(list(sums.items()), "range long, sum long"), group=7).collect()}
    order = sorted(sums)
    assert got == dict(zip(order, [0, *itertools.accumulate(sums[r] for r in order)], strict=False))


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and mixing.mix(empty(spark)).count() == 0
    assert {r["doc_id"]: r["size"] for r in rows}[1] == 0
