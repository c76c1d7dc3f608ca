"""Merkle manifest of a dataset, folded from SHA-256 midstates.

Each row is a leaf. A partition's leaves (``tree``: its lang) in order of doc_id are hashed in runs of FAN until one
node, the subroot, remains; the subroots in order of their partition give the root in the same way. While a parent is
hashed, a copy of the hash's state is retained before each child slot; a changed leaf is folded into the root by
resuming the retained state of its slot with the replacement and the siblings right of it, level after level. What
stands left of the slot is never hashed again.

One task holds a block of FAN ** depth neighbouring nodes at most: a partition of any size is a tree of blocks. Leaves
are numbered by a range sort, so that no partition, however hot, comes to one task. The tops of the blocks are the
nodes of the next blocks; on the way down each block is told its path of runs above it.

Defined cases: a null column is ``-`` in its leaf; a null lang is a partition of its own, the first one; rows of equal
doc_id are ordered by their leaves (null ids first), so that repeated rows have defined places; a lone leaf is its
tree's root and has no siblings (the hash of nothing); an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import store

#: Nodes of a run, and levels of a block.
FAN, DEPTH = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(values: list[Column]) -> Column:
    """The digest of a row: its values one after the other, each with the count of its bytes before it."""

    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(told, values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed): the leaf of each row, and that of the row as it is after tampering, null if that is the same.

    Where 3 divides the checksum of doc_id, tampering lower-cases A to Z in the text.
    """
    low = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))
    own = [F.col(c) for c in COLUMNS]
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    both = docs.select(tree.alias("tree"), "doc_id", leaf(own).alias("leaf"), leaf([*own[:-1], low]).alias("changed"))
    return both.withColumn("changed", F.nullif("changed", "leaf"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place of each in its tree by ``order``, and ``of``, the nodes of its tree; written.

    A range sort over all trees gives the order; only how many rows of a tree lie in each range is added up.
    """
    ranges = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = store.written(ranges.withColumn("seq", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("seq", 33))
    spans = placed.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    tree = W.partitionBy("tree")
    ahead = spans.select("tree", "part", (F.sum("n").over(tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("of"))
    out = store.written(placed.join(ahead, ["tree", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("seq", "part", "shift"), "numbered")
    store.drop(placed)
    return out


def height(of: int, depth: int) -> int:
    """Levels of a block in a tree of so many nodes."""
    levels = 0
    while of > 1 and levels < depth:
        of, levels = -(-of // FAN), levels + 1
    return levels


class Parent:
    """A node with its children: their digests, and the hash's states before each of their slots."""

    def __init__(self, run: list[str]) -> None:
        self.run, self.states = [d.encode() for d in run], []
        now = hashlib.sha256()
        for child in self.run:
            self.states.append(now.copy())
            now.update(child)
        self.digest = now.hexdigest()

    def step(self, slot: int) -> Step:
        return Step(self.states[slot], b"".join(self.run[slot + 1 :]), b"".join(self.run[:slot] + self.run[slot + 1 :]))


class Step:
    """One level of a path: the state to resume, the siblings right of the slot, and all siblings for the proof."""

    def __init__(self, state: hashlib._Hash, right: bytes, siblings: bytes) -> None:
        self.state, self.right, self.siblings = state, right, siblings

    def fold(self, replacement: str) -> str:
        now = self.state.copy()
        now.update(replacement.encode())
        now.update(self.right)
        return now.hexdigest()


def levels_of(digests: list[str], of: int, depth: int) -> list[list[Parent]]:
    """The parents of a block's nodes, level by level; the last level has one."""
    out = []
    for _ in range(height(of, depth)):
        parents = [Parent(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
        digests = [p.digest for p in parents]
        out.append(parents)
    return out


def _ordered(t: pa.Table) -> pa.Table:
    return t.sort_by("pos")


def _tops(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, pos, of, digest): the top of each block, a node of the next level of blocks."""

    def top(t: pa.Table) -> pa.Table:
        t = _ordered(t)
        of, digests = t.column("of")[0].as_py(), t.column("digest").to_pylist()
        above = levels_of(digests, of, depth)
        digest = above[-1][0].digest if above else digests[0]
        return pa.table({"tree": t.column("tree").slice(0, 1), "pos": [t.column("block")[0].as_py()], "of": [-(-of // FAN**depth)], "digest": [digest]})

    return nodes.select("tree", _block(depth).alias("block"), "pos", "of", "digest").groupBy("tree", "block").applyInArrow(top, "tree string, pos bigint, of bigint, digest string")


def _block(depth: int) -> Column:
    return F.floor(F.col("pos") / FAN**depth)


_PATH = "array<struct<slot: int, run: array<string>>>"


def _told(parents: list[list[Parent]], at: int) -> list[dict]:
    """The runs that a block's node at ``at`` passes, from below."""
    out = []
    for level in parents:
        at, slot = divmod(at, FAN)
        out.append({"slot": slot, "run": [d.decode() for d in level[at].run]})
    return out


def _paths(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """(tree, pos, path) of each node: its runs in its block, then those of its block. above: (tree, pos, path) of the blocks."""

    def down(own: pa.Table, up: pa.Table) -> pa.Table:
        own = _ordered(own)
        parents = levels_of(own.column("digest").to_pylist(), own.column("of")[0].as_py(), depth)
        path = up.column("path")[0].as_py()
        told = [_told(parents, i) + path for i in range(own.num_rows)]
        kind = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))
        return pa.table({"tree": own.column("tree"), "pos": own.column("pos"), "path": pa.array(told, kind)})

    blocks = nodes.select("tree", _block(depth).alias("block"), "pos", "of", "digest").groupBy("tree", "block")
    return blocks.cogroup(above.groupBy("tree", "pos")).applyInArrow(down, f"tree string, pos bigint, path {_PATH}")


def climbed(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """``nodes`` (tree, pos, of, digest), the tops of their blocks, the tops of those, and so on, up to one node a tree."""
    out = [nodes]
    while out[-1].where("of > 1").take(1):
        out.append(store.written(_tops(out[-1], depth), "tops"))
    return out


def manifest(table: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``leaves``.

    folded_root is the root with the leaf replaced by ``changed``; proof_sha256 the digest of all siblings on the way.
    """
    kind = table.schema["doc_id"].dataType.simpleString()
    rows = numbered(table, ["doc_id", "leaf"])
    stages = climbed(rows.select("tree", "pos", "of", F.col("leaf").alias("digest")), depth)
    named = numbered(stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    upper = climbed(named.select("tree", "pos", "of", "digest"), depth)
    paths = upper[-1].select("tree", "pos", F.array().cast(_PATH).alias("path"))
    for nodes in reversed(upper[:-1]):
        paths = _paths(nodes, paths, depth)
    whole = named.join(paths, ["tree", "pos"]).join(upper[-1].select("tree", F.col("digest").alias("root")), "tree")
    trees = store.written(whole.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "trees")
    down = trees.select("tree", "pos", "path")
    for nodes in reversed(stages[1:-1]):
        down = _paths(nodes, down, depth)
    above = down.join(trees.select("tree", "subroot", "root"), "tree")

    def fold(own: pa.Table, up: pa.Table) -> pa.Table:
        own = _ordered(own)
        leaf_of = own.column("leaf").to_pylist()
        parents = levels_of(leaf_of, own.column("of")[0].as_py(), depth)
        path = [Parent(s["run"]).step(s["slot"]) for s in up.column("path")[0].as_py()]
        root = up.column("root")[0].as_py()
        steps: dict[tuple[int, int], Step] = {}
        proofs, folded = [], []
        for i, value in enumerate(own.column("changed").to_pylist()):
            proof, value = hashlib.sha256(), value or leaf_of[i]
            for step in [*_walk(parents, i, steps), *path]:
                proof.update(step.siblings)
                value = step.fold(value)
            proofs.append(proof.hexdigest())
            folded.append(value)
        n = own.num_rows
        return pa.table({
            "doc_id": own.column("doc_id"), "leaf": own.column("leaf"), "subroot": [up.column("subroot")[0].as_py()] * n, "root": [root] * n,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    blocks = rows.withColumn("block", _block(depth)).groupBy("tree", "block").cogroup(above.groupBy("tree", "pos"))
    return blocks.applyInArrow(fold, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _walk(parents: list[list[Parent]], at: int, steps: dict[tuple[int, int], Step]) -> Iterator[Step]:
    """The steps of a block's node at ``at``; neighbours share those above their run."""
    for level, nodes in enumerate(parents):
        if (level, at) not in steps:
            steps[level, at] = nodes[at // FAN].step(at % FAN)
        yield steps[level, at]
        at //= FAN


def _oracle(levels: int = 7) -> str:
    """DuckDB SQL for trees of up to FAN ** levels leaves: one level is one grouping, one fold is one join with a run."""
    upper = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def told(c: str) -> str:
        return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"

    head = " || ".join(told(c) for c in COLUMNS[:-1])
    steps = "flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::VARCHAR, '')])"
    crc = f"xor(list_reduce({steps}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295), 4294967295)"
    sql = f"""
WITH docs AS (
  SELECT lang, doc_id, sha256({head} || {told("text")}) AS leaf,
    sha256({head} || {told(f"CASE WHEN {crc} % 3 = 0 THEN {upper} ELSE text END")}) AS changed
  FROM documents
), n0 AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS h, doc_id, leaf, changed FROM docs
)"""

    def tree(name: str, key: str, node: str) -> str:
        out = ""
        for k in range(levels):
            out += f""", {name}{k + 1} AS (
  SELECT {key}, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY {key}, pos // 8, n
)"""
        return out

    def path(name: str, key: str, first: str, keep: str) -> str:
        out = f", {name}p0 AS ({first})"
        for k in range(levels):
            out += f""", {name}p{k + 1} AS (
  SELECT p.*, any_value(p.folded) AS before, CASE WHEN any_value(s.n) = 1 THEN any_value(p.folded) ELSE sha256(string_agg(CASE WHEN s.pos = p.own // {8**k} THEN p.folded ELSE s.h END, '' ORDER BY s.pos)) END AS next,
    any_value(p.proof) || coalesce(string_agg(CASE WHEN s.pos <> p.own // {8**k} THEN s.h END, '' ORDER BY s.pos), '') AS proofs
  FROM {name}p{k} p JOIN {name}{k} s ON s.{key} IS NOT DISTINCT FROM p.{key} AND s.pos // 8 = p.own // {8 ** (k + 1)} GROUP BY ALL
)""".replace("p.*, any_value(p.folded) AS before, ", "p.rid, p.own, p." + key + ", ").replace(" AS next", " AS folded").replace(" AS proofs", " AS proof")
        return out

    sql += tree("n", "lang", "leaf")
    sql += ", numbered AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, pos) AS rid FROM n0)"
    sql += path("n", "lang", "SELECT rid, pos AS own, lang, changed AS folded, '' AS proof FROM numbered", "")
    sql += f", m0 AS (SELECT '' AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, lang FROM n{levels})"
    sql += tree("m", "one", "h")
    sql += path("m", "one", f"SELECT rid, m0.pos AS own, '' AS one, folded, proof FROM np{levels} p JOIN m0 ON m0.lang IS NOT DISTINCT FROM p.lang", "")
    return sql + f"""
SELECT doc_id, leaf, m0.h AS subroot, m{levels}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m{levels}.h AS verified
FROM numbered JOIN mp{levels} USING (rid) JOIN m0 ON m0.lang IS NOT DISTINCT FROM numbered.lang CROSS JOIN m{levels}
"""


ORACLE = _oracle()
