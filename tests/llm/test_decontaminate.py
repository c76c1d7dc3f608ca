import hashlib
import random
import re

from hearthwave.llm import decontaminate
from tests.llm.helpers import LONG, awkward, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _plain(text, items):
    w = _words(text)
    hit, found = set(), set()
    for item, t in items:
        x = _words(t)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    if item is not None:
                        found.add(str(item))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, "short item"), (3, "x"), (4, None), (5, ""), (None, "nobody wrote this at all you know it well don't you"), (10, "one two three four five six"), (7, "repeat repeat repeat repeat repeat repeat repeat repeat repeat repeat repeat")]


def _items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_against_brute_force(spark):
    e = random.Random(4)
    vocabulary = "alpha beta gamma delta short item one two three four five six repeat x".split()
    rows = [(i, " ".join(e.choice(vocabulary) for _ in range(e.randrange(60)))) for i in range(80)]
    long = _words(ITEMS[0][1])
    rows += [(100 + i, "prefix, " + " - ".join(long[i : i + 11]).upper() + "!") for i in range(4)]
    rows += [(200, "repeat " * 40), (201, "Short  ITEM"), (202, "nobody wrote this at all you know it well don't you"), (203, LONG + " " + ITEMS[0][1])]
    got = decontaminate.report(documents(spark, rows), _items(spark)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == _plain(texts[r["doc_id"]], ITEMS), r["doc_id"]


def test_awkward_rows_and_stage(spark):
    df = awkward(spark)
    rows = decontaminate.report(df, _items(spark)).collect()
    assert len(rows) == df.count()
    assert decontaminate.report(df, _items(spark).where("false")).where("contaminated").count() == 0
    assert decontaminate.report(empty(spark), _items(spark)).count() == 0
    kept = decontaminate.keep_clean(df, _items(spark))
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, None, 7, 8}
