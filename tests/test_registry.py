import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_every_query_has_a_name_and_known_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "hour_stats" in e.queries()


def test_the_library_works_without_the_training_data_operators(monkeypatch):
    """As if the two folders and the pipeline couldn't be imported."""
    for name in [n for n in sys.modules if n.startswith("hearthwave.llm")] + ["hearthwave.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as e

    names = set(e.queries())
    assert "hour_stats" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
    e.oracle_sql()
    sys.modules.pop("__spark_entry__", None)


def test_nothing_else_imports_them():
    for f in (ROOT / "hearthwave").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


@pytest.mark.skipif(not SMALL.exists(), reason="the given tables are not here")
def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["sensor_id", "range_bin", "hour", "days", "level", "cv"] and df.count() >= 0
