"""All registered queries and their DuckDB counterparts.

The queries run the library's operators on the given tables, which stand in for a fleet's recordings
(``standins.py`` says how). Each is a function of (spark, sf_dir) with the SQL for the same rows beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show; no negative zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(sql: str | None = None, digits: int = 6) -> Callable:
    """Registers a query under its function's name; in the SQL, ``R(x)`` stands for the same rounding."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir), digits)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {sql}" if not sql.lstrip().startswith(("SELECT", "WITH")) else sql
            ORACLE_SQL[f.__name__] = _round_calls(ORACLE_SQL[f.__name__], digits)
        return f

    return add


def _round_calls(sql: str, digits: int) -> str:
    """Each R(...) as round(..., digits) + 0.0."""
    out = ""
    at = 0
    while (found := sql.find("R(", at)) >= 0:
        if found and (sql[found - 1].isalnum() or sql[found - 1] == "_"):
            out, at = out + sql[at : found + 2], found + 2
            continue
        depth, end = 1, found + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:found] + f"(round(({_round_calls(sql[found + 2 : end - 1], digits)})::DOUBLE, {digits}) + 0.0::DOUBLE)"
        at = end
    return out + sql[at:]


from . import arrays, choices, drift, matching, motion, rooms, signals, streams  # noqa: E402, F401  (they register themselves)
