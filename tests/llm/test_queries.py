import pytest

from hearthwave.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_those_of_the_sql(spark, con, name):
    ours, theirs = oracle.compared(spark, con, QUERIES[name], ORACLE_SQL[name])
    assert ours == theirs


def test_each_operator_has_its_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def test_three_bits_and_no_more(spark):
    """The whole small table against all pairs."""
    rows = QUERIES["op3_simhash"](spark, str(oracle.DATA)).collect()
    fps = sorted({int(r["fingerprint"], 16) for r in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for r in rows:
        k = find(int(r["fingerprint"], 16))
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[find(int(r["fingerprint"], 16))] for r in rows)
