"""Small tables with every awkward case, shared by the tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    df = documents(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven eight nine ten eleven"), (None, "nobody's text here"), (7, LONG, None), (8, "Überraschung 😀 naïve", None)])
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("fp", "anchor", "score", "x", "node", "bucket", "size", "hits", "spans", "root", "_key", "key", "bits", "pii", "_pii", "_email", "_order", "first", "label", "kept", "named")}
    return df.withColumns(clash)


def empty(spark):
    return documents(spark, [(1, "a")]).where("false")
