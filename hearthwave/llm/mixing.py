"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to ``repeats`` times. An entry's virtual
finish time is the number of its source's words up to and with it, divided by the source's target: all sources are
served at once, each at the rate of its target. All entries are sorted by finish time, over ranges of virtual time,
and what lies beyond the total budget in that order is cut off, in the midst of an entry if need be. The budget is
that of all targets, so that each source comes near its target by the queue alone: what a long document that isn't
finished by then leaves goes to the entries that finish next.

Defined cases: sources weigh 5, 2, 1, repeating, by code point, a null source last; a null text has no words
and is never taken; documents of equal ``doc_id`` are ordered by their text's hash, and rows that are equal in
both share a place in the queue, one after the other. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

#: The weights of the sources in order, and how often a document may be used.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows whose order is decided together, about, and the least number of buckets: the result doesn't hang on either.
BUCKET_ROWS, LEAST_BUCKETS = 2_000, 512
SEED = "mix"


def n_words(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]+``; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, budget) from (source, source_size), one row each; budget: all targets in whole words.

    The total is shared by weight; no target is above ``repeats`` times its source's size, and what is above
    goes to the others by weight until none is. The sources that stop at their limit are those with the least
    limit per weight, so one pass in that order finds the level. The windows run over one row per source.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_limit = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", share.cast("long")).withColumn("most", F.col("source_size") * repeats)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    tried = weighed.withColumn("level", level).withColumn("at", F.row_number().over(by_limit)).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    found = tried.withColumn("level", F.min_by("level", F.when(F.col("fits"), F.col("at"))).over(whole))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")))
    return found.select("source", "source_size", target.alias("target"), F.sum(F.floor(target + 0.5)).over(whole).cast("long").alias("budget"))


def plan(docs: DataFrame, keep: list[str] | None = None, bucket_rows: int = BUCKET_ROWS, least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Per document: ``keep`` (doc_id), source, size, source_size, target, budget (of all), before (words ahead in its queue).

    The words ahead are summed in two steps, so that no task gets a whole source: a source's shuffled order is
    cut into buckets of the hash, the buckets' sums are added up, and each bucket is ordered for itself.
    """
    keep = keep or ["doc_id"]
    sized = store.written(docs.select(*keep, "source", n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_order"), F.xxhash64("text").alias("_tie")), "sizes")
    buckets = max(least_buckets, -(-sized.count() // bucket_rows))
    placed = sized.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("long"))
    sums = store.written(placed.groupBy("source", "_bucket").agg(F.sum("size").alias("words")), "buckets")
    ahead = F.sum("words").over(W.partitionBy("source").orderBy("_bucket")) - F.col("words")
    share = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    starts = sums.withColumn("ahead", ahead).join(share, sums["source"].eqNullSafe(share["source"])).drop(share["source"]).drop("words")
    starts = store.written(starts.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), "ahead", "source_size", "target", "budget"), "starts")
    within = W.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = placed.withColumn("_within", F.sum("size").over(within) - F.col("size"))
    joined = queued.join(starts, queued["source"].eqNullSafe(starts["_source"]) & (queued["_bucket"] == starts["_b"]))
    before = F.col("ahead") + F.col("_within")
    return joined.select(*keep, "source", "size", "source_size", "target", "budget", before.alias("before"))


def ahead(sums: DataFrame, group: int = 4_096) -> DataFrame:
    """(range, ahead): the words of all ranges before each one. sums: (range, sum).

    In two steps: over groups of ranges, of which there are few, and within each group.
    """
    grouped = sums.withColumn("group", F.floor(F.col("range") / group))
    groups = grouped.groupBy("group").agg(F.sum("sum").alias("all"))
    before = groups.select("group", (F.sum("all").over(W.orderBy("group")) - F.col("all")).alias("before"))
    within = F.sum("sum").over(W.partitionBy("group").orderBy("range")) - F.col("sum")
    return grouped.withColumn("within", within).join(before, "group").select("range", (F.col("before") + F.col("within")).alias("ahead"))


def queue(planned: DataFrame, ranges: int = LEAST_BUCKETS) -> DataFrame:
    """One row per use of a document that the budget may reach: the plan's columns, round, start, finish, position (words ahead in the mix), used.

    Ranges of virtual time of equal length hold about equally many words, whatever their sources. The ranges' sums
    are added up first; each range that begins within the budget is sorted for itself.
    """
    uses = planned.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    timed = uses.withColumn("start", F.col("before") + F.col("round") * F.col("source_size")).withColumn("finish", (F.col("start") + F.col("size")) / F.col("target"))
    ranged = timed.withColumn("range", F.floor(F.col("finish") * ranges).cast("long"))
    sums = store.written(ranged.groupBy("range").agg(F.sum("size").alias("sum")), "ranges")
    within = W.partitionBy("range").orderBy("finish", "source", "start").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = ranged.join(ahead(sums), "range").where(F.col("ahead") < F.col("budget"))
    placed = reached.withColumn("position", F.col("ahead") + F.sum("size").over(within) - F.col("size"))
    used = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("position"))).cast("long")
    return placed.select(*planned.columns, "round", "start", "finish", "position", used.alias("used"))


def mix(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (the words of its entries within the budget)."""
    planned = store.written(plan(docs, bucket_rows=bucket_rows, least_buckets=least_buckets), "planned")
    ranges = max(least_buckets, -(-planned.count() // bucket_rows))
    told = ["doc_id", "size", "source_size", "target"]
    # in a source no two documents with words have as many words ahead
    rows = queue(planned, ranges).select("source", "before", *told, "used").unionAll(planned.select("source", "before", *told, F.lit(0).cast("long")).where("size > 0"))
    taken = rows.groupBy("source", "before", *told).agg(F.sum("used").alias("taken"))
    return taken.select(*told, "taken").unionAll(planned.where("size = 0").select(*told, F.lit(0).cast("long").alias("taken")))


#: For DuckDB. The shuffle is the order of md5 digests, which both know.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, 'null')) AS o, text
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS nr FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (nr - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM sources
), tried AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level, row_number() OVER by_limit AS pos
  FROM weighed
  WINDOW by_limit AS (ORDER BY most / weight, source IS NULL, source), before AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), target AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT arg_min(level, pos) FROM tried WHERE level * weight <= most) * weight, most)) AS target FROM tried
), queued AS (
  SELECT s.*, t.source_size, t.target, (sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id, text ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source
), uses AS (
  SELECT *, before + k * source_size AS start, (before + k * source_size + size)::DOUBLE / target AS finish FROM queued CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0
), served AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, start ROWS UNBOUNDED PRECEDING) - size AS position FROM uses
), taken AS (
  SELECT source, before, sum(greatest(0, least(size, (SELECT sum(floor(target + 0.5)) FROM target) - position)))::BIGINT AS taken FROM served GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(CASE WHEN q.size > 0 THEN t.taken END, 0)::BIGINT AS taken
FROM queued q LEFT JOIN taken t ON t.source IS NOT DISTINCT FROM q.source AND t.before = q.before
"""
