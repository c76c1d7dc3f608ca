"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same nodes joined in the same way, each by one link to the smallest one that these links reach."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    others = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[others], nodes[root[others]]


def contracted(links: DataFrame) -> DataFrame:
    """(a, b): the links of each batch as stars, which join what they joined; a star stays as it is."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = stars(*(c.to_numpy() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    return links.select("a", "b").mapInArrow(batches, "a bigint, b bigint")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link, its root being the smallest node of its component.

    links: (a, b), in any order, repeats and loops allowed. Each round makes stars of the links of a batch, then is two
    aggregations with joins on the node, whose result is written to the shared folder; a star's hub is only ever met as a join key, which Spark
    can split, never as a group. No link, node or component comes to the driver.
    """
    now = store.written(contracted(links.where("a <> b")).distinct(), "links")
    before = _state(now)
    for _ in range(rounds):
        joined = contracted(now)
        both = joined.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = store.written(small.unionAll(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        store.drop(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"the components didn't settle within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
