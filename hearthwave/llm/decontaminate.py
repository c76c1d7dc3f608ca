"""Benchmark decontamination by winnowing.

Words are hashed, five consecutive ones make a k-gram, and of each six consecutive k-grams the least is selected
(the last one on a tie). Such a window spans ten words, so every shared span of ten words or more holds a k-gram
that is selected on both sides. Selected k-grams of documents and benchmark are joined, and each hit is extended
word by word, at most five words to either side: that reaches the ends of every window of ten words in which the
k-gram was selected. Extended hits of ten words or more are shared spans, and those that overlap are joined.

The benchmark's fingerprints fill a bitmap of fixed size, which every task gets; a document's k-grams that aren't
in it are gone at once. A benchmark item of fewer than ten words, but not none, is one window of its own length,
its own fingerprint, and is looked for at every place, as selection promises nothing within so few words.

Defined cases: a null or empty text has no words and no hits. Rows with equal ``doc_id`` and text get equal
results; rows with equal ``doc_id`` and other texts get their own. A null ``item_id`` counts as a hit of words but
is not listed among the items. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, text
from .rows import BITS, bitmap_rows, by_id, fresh, row_key

#: Words of a window, and of a k-gram; of a window's WINDOW - GRAM + 1 k-grams the least is selected.
WINDOW, GRAM = 10, 5
#: Words that a hit is extended to either side.
REACH = WINDOW - GRAM
_SIDE = pa.list_(pa.string())
_FIELDS = pa.schema([("start", pa.int32()), ("length", pa.int32()), ("fp", pa.int64()), ("gram", pa.string()), ("left", _SIDE), ("right", _SIDE)])
_KINDS = "start:int,length:int,fp:bigint,gram:string,left:array<string>,right:array<string>"


def selected(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints) of the k-grams that are the least of a window within one row."""
    g = text.grams(h, GRAM)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = g[:n].copy(), np.arange(n)
    for i in range(1, WINDOW - GRAM + 1):
        later = g[i : i + n] <= least
        least = np.where(later, g[i : i + n], least)
        at = np.where(later, np.arange(i, i + n), at)
    places = np.unique(at[row[:n] == row[WINDOW - 1 :]])
    return places, g[places]


def _found(column: pa.Array, lengths: list[int], bitmap: np.ndarray | None, short: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list]]:
    """(first row, end row, words by row, row of each fingerprint, columns of _FIELDS) for runs of rows.

    lengths: WINDOW for the selected k-grams, shorter ones for windows of so many words. bitmap: only fingerprints
    that are in it. short: a row of fewer words than WINDOW is one window, and has no other.
    """
    for first, end, data, offs in text.chunks(column):
        data = text.LOWER[data]
        starts, ends, row = text.spans(data, offs, text.ALNUM)
        words = np.bincount(row, minlength=end - first)
        h = text.word_hashes(data, starts, ends)
        before = np.concatenate([[0], np.cumsum(words)])
        rows, columns = [np.zeros(0, np.int64)], [[] for _ in _FIELDS]
        for length in lengths:
            if length == WINDOW:
                at, fp = selected(h, row)
            else:
                fp = text.grams(h, length)
                at = np.flatnonzero(row[: len(fp)] == row[length - 1 :]) if len(fp) else np.zeros(0, np.int64)
                if short:
                    at = at[words[row[at]] == length]
                fp = fp[at]
            if bitmap is not None:
                slot = fp & np.uint64(BITS - 1)
                good = (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                at, fp = at[good], fp[good]
            size, reach = (GRAM, REACH) if length == WINDOW else (length, 0)
            rows.append(row[at])
            columns[0].extend((at - before[row[at]]).tolist())
            columns[1].extend([length] * len(at))
            columns[2].extend(fp.view(np.int64).tolist())
            for a, r in zip(at.tolist(), row[at].tolist(), strict=True):
                low, high = max(a - reach, before[r]), min(a + size + reach, before[r + 1])
                own = [data[s:e].tobytes().decode() for s, e in zip(starts[low:high], ends[low:high], strict=True)]
                columns[3].append(" ".join(own[a - low : a - low + size]))
                columns[4].append(own[: a - low][::-1])
                columns[5].append(own[a - low + size :])
        yield first, end, words, np.concatenate(rows), [pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)]


def item_windows(items: DataFrame) -> DataFrame:
    """(length, fp, gram, left, right, items): each fingerprint of the benchmark with the words around it, and the ids of its items."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, _, _, row, columns in _found(b.column(1), [*range(1, WINDOW + 1)], None, short=True):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + first)), *columns[1:]], names=["item_id", *_FIELDS.names[1:]])

    chosen = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = chosen.mapInArrow(batches, "item_id string, " + ", ".join(_KINDS.split(",")[1:]).replace(":", " "))
    return found.groupBy("length", "fp", "gram", "left", "right").agg(F.collect_set("item_id").alias("items"))


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """The fingerprints' bits, gathered as at most BITS / 32768 rows of 4 KB."""
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in bitmap_rows(windows).collect():
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def candidates(docs: DataFrame, keep: list[str], bitmap: np.ndarray, lengths: list[int]) -> DataFrame:
    """keep, n_words, and ``hits``: the document's fingerprints that the benchmark may have, with the words around them."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for first, end, words, row, columns in _found(b.column(len(keep)), lengths, sent.value, short=False):
                order = pa.array(np.argsort(row, kind="stable"))
                values = pa.StructArray.from_arrays([c.take(order) for c in columns], fields=list(_FIELDS))
                offs = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - first))])
                kept = [b.column(i).slice(first, end - first) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), values)], names=[*keep, "n_words", "hits"])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(batches, f"{kinds}, n_words bigint, hits array<struct<{_KINDS}>>")


def _alike(a: str, b: str) -> Column:
    """How many words two sides share from the hit outwards."""
    same = F.transform(F.sequence(F.lit(1), F.lit(REACH)), lambda i: F.coalesce(F.try_element_at(a, i) == F.try_element_at(b, i), F.lit(False)))
    other = F.array_position(same, F.lit(False))
    return F.when(other == 0, F.lit(REACH)).otherwise((other - 1).cast("int"))


def extended(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """(_key, start, end, items): the hits that are shared spans once extended, end exclusive."""
    met = hits.join(windows.withColumnsRenamed({"left": "item_left", "right": "item_right"}), ["length", "fp", "gram"])
    whole = F.col("length") == WINDOW
    grown = met.withColumns({"l": F.when(whole, _alike("left", "item_left")).otherwise(0), "r": F.when(whole, _alike("right", "item_right")).otherwise(0)})
    shared = grown.where(~whole | (F.col("l") + F.col("r") + GRAM >= WINDOW))
    size = F.when(whole, F.lit(GRAM)).otherwise(F.col("length"))
    return shared.select("_key", (F.col("start") - F.col("l")).alias("start"), (F.col("start") + size + F.col("r")).alias("end"), "items")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, _key, n_words, n_hit, items (sorted ids as strings)."""
    windows = store.written(item_windows(items), "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # ten at most
    keyed = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"), "text")
    table = store.written(candidates(keyed, ["doc_id", "_key"], bitmap_of(windows), lengths), "candidates")
    hits = table.where(F.size("hits") > 0).select("_key", F.explode("hits").alias("h")).select("_key", "h.*").distinct()
    per = extended(hits, windows).groupBy("_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    joined = F.aggregate(
        F.array_sort("spans"), zero,
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end")),
        lambda acc: acc["n"],
    )
    counted = per.select("_key", joined.cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    none = F.array().cast("array<string>")
    return table.drop("hits").join(counted, "_key", "left").select("doc_id", "_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, columns as they are, without a word in any window of the benchmark.

    Texts are shuffled only where a row may be left out: a bitmap of the ids of such rows tells all others apart.
    """
    hit = store.written(contamination(docs, items).where("n_hit > 0").select("doc_id", "_key").distinct(), "hit")
    alone, others = by_id(docs, hit)
    name = fresh(docs, "key")
    clean = others.withColumn(name, row_key(F.col("doc_id"), F.col("text"))).join(hit.select(F.col("_key").alias(name)), name, "left_anti")
    return alone.unionAll(clean.select(*docs.columns))


#: For DuckDB, window by window.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS x
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
), met AS (SELECT rid, s, p.n, item_id FROM places p JOIN windows USING (n, x)),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS k FROM met) GROUP BY rid),
per AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM met GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN per USING (rid)
"""
