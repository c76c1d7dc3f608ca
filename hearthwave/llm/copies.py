"""Near copies of a corpus: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First come the pairs that SimHash finds by its anchors (``simhash.links``): nodes of equal fingerprints, and of fingerprints
of at most three differing bits. Two texts of similarity 4 : 5 may differ in more bits than a covering code can reach
(see the README), so that what is still apart is looked for by the sets themselves. They share a shingle of their prefixes
(rare shingles first, one more than a fifth of the set); sizes and parities rule out what they can prove. However a pair
was found, its link is kept only if the two whole sets have the similarity. No pair is left out.

Defined cases: a null text counts as empty; all texts without words are copies of each other; a text of fewer words
than a shingle is one shingle. A chain of copies is one group. Of a group the row with the smallest doc_id stays
(null ids last), among rows of equal id the one whose columns' digest is smallest, of rows that are equal in every
column one. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, graph, rows, simhash, store, text

#: Words of a shingle. The similarity is the ratio 4 : 5, held in whole numbers.
SHINGLE = 5
#: Documents of one batch from which a shingle is counted, those of all batches from which it comes late in the order,
#: and how many such there are at most. The order decides how much is compared, never what is found.
BATCH_COUNT, COUNT, MOST = 3, 5, 1 << 16
#: Numbers of 64 bits in a set's parities; larger sets have a wide row of parities as well.
PARITIES = 16
#: Members of a group that one task compares; a larger one is cut into blocks. Times that only so many pairs are
#: looked at as would join a group; all others follow after that.
BLOCK, ROUNDS = 4_000, 2
SEED = np.uint64(42)


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct shingles, by row, then hash; a shorter text is one shingle, an empty one none."""
    n = len(offs) - 1
    data = text.LOWER[data]
    starts, ends, row = text.spans(data, offs, text.NOT_SPACE)
    h = text.word_hashes(data, starts, ends)
    words = np.bincount(row, minlength=n)
    g = text.grams(h, size)
    whole = np.flatnonzero(row[: len(g)] == row[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    hashes, of = [g[whole]], [row[whole]]
    before = np.concatenate([[0], np.cumsum(words)])
    for k in range(1, size):
        short = np.flatnonzero(words == k)
        hashes.append(text.grams(h, k)[before[short]])
        of.append(short)
    h, row = np.concatenate(hashes), np.concatenate(of)
    at = np.lexsort((h, row))
    h, row = h[at], row[at]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], row[new]


def _hashed(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """One number for each row's set."""
    sums = np.zeros((2, n), np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        sums[0, row[first]] = np.add.reduceat(text.mix(h), first)
        sums[1, row[first]] = np.add.reduceat(text.mix(h ^ SEED), first)
    return text.mix(sums[0] ^ text.mix(sums[1]))


def odd(h: np.ndarray, row: np.ndarray, n: int, words: int) -> np.ndarray:
    """For each row's set: bit i tells whether an odd number of its shingles falls to i.

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    wide = 64 * words
    odd = np.bincount(row * wide + (h % np.uint64(wide)).astype(np.int64), minlength=n * wide) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, wide), axis=1, bitorder="little").view(np.uint64)


def wide(h: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Parities of about as many bits as the set has shingles, null for small sets: folded once, they are those of half as many bits."""
    sizes = np.bincount(row, minlength=n)
    ends = np.cumsum(sizes)
    out: list[list[int] | None] = [None] * n
    for i in np.flatnonzero(sizes > 64 * PARITIES).tolist():
        own = h[ends[i] - sizes[i] : ends[i]]
        out[i] = odd(own, np.zeros(len(own), np.int64), 1, 1 << int(sizes[i] - 1).bit_length() - 6)[0].view(np.int64)
    return pa.array(out, pa.list_(pa.int64()))


def prefixes(h: np.ndarray, row: np.ndarray, n: int, late: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row) of each row's first ones in the order of all: rare ones first (``late``: ascending hashes).

    Sets of similarity 4 : 5 share 4/5 of either's shingles, so that their prefixes, one longer than the rest
    of either, have a shingle in common.
    """
    count = np.zeros(len(h), np.int64)
    if len(late):
        at = np.minimum(np.searchsorted(late, h), len(late) - 1)
        count = np.where(late[at] == h, counts[at], 0)
    by = np.lexsort((h, count, row))
    h = h[by]
    sizes = np.bincount(row, minlength=n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place < np.repeat(sizes - (4 * sizes + 4) // 5 + 1, sizes)
    return h[kept], row[kept]


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def lists(h: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32()), longs(h))


def mapped(docs: DataFrame, keep: list[str], make, kinds: dict[str, str], wanted: np.ndarray | None = None, size: int = SHINGLE, whole: Callable | None = None) -> DataFrame:
    """The columns ``keep`` and what ``make`` (of hashes, rows, number of rows) tells of each whole text's set.

    wanted: a bitmap; only rows whose doc_id's hash may be in it. whole: gives further columns, of bytes and offsets of the texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if sent.value is not None:
                slot = b.column(len(keep) + 1).to_numpy() & (rows.BITS - 1)
                b = b.filter(pa.array((sent.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0))
            for first, end, data, offs in text.chunks(b.column(len(keep))):
                kept = [b.column(i).slice(first, end - first) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *make(*shingles(data, offs, size), end - first), *(whole(data, offs) if whole else [])], names=[*keep, *kinds])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"), *([] if wanted is None else [F.xxhash64("doc_id").alias("fp")]))
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)]), *(f"{c} {kind}" for c, kind in kinds.items())]
    return chosen.mapInArrow(batches, ", ".join(fields))


def with_sets(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """The node and all shingles of each text."""
    return mapped(docs, [], lambda h, row, n: [longs(_hashed(h, row, n)), lists(h, row, n)], {"node": "bigint", "shingles": "array<bigint>"}, wanted)


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ascending, and their documents): the most common ones, at most MOST, among those common in a batch of rows.

    All documents are read; a task gives out only what several of its documents have.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [shingles(data, offs)[0] for _, _, data, offs in text.chunks(b.column(0))]
            x, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([longs(x[n >= BATCH_COUNT]), pa.array(n[n >= BATCH_COUNT])], names=["x", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(batches, "x bigint, n bigint").groupBy("x").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= COUNT).orderBy(F.desc("n"), "x").limit(MOST).toArrow()
    late, counts = (often.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    at = np.argsort(late.view(np.uint64))
    return late.view(np.uint64)[at], counts[at]


def with_prefix(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the node, its number of shingles, its parities, the wide ones, its prefix and the text's SimHash fingerprint."""
    late, counts = common(docs)

    def make(h: np.ndarray, row: np.ndarray, n: int) -> list[pa.Array]:
        bits = lists(odd(h, row, n, PARITIES).ravel(), np.repeat(np.arange(n), PARITIES), n)
        return [longs(_hashed(h, row, n)), pa.array(np.bincount(row, minlength=n).astype(np.int64)), bits, wide(h, row, n), lists(*prefixes(h, row, n, late, counts), n)]

    def fingerprints(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        return [longs(np.array([simhash.fingerprint(data[s:e].tobytes()) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64))]

    return mapped(docs, keep, make, {"node": "bigint", "n": "bigint", "parities": "array<bigint>", "wide": "array<bigint>", "prefix": "array<bigint>", "fp": "bigint"}, whole=fingerprints)


def by_fingerprints(nodes: DataFrame, block: int = simhash.BLOCK) -> DataFrame:
    """(a, b): the pairs of nodes that SimHash joins. nodes: node, fp.

    The first node of a fingerprint with its others, and the first ones of two linked fingerprints.
    """
    firsts = store.written(nodes.groupBy("fp").agg(F.min("node").alias("a")), "firsts")
    same = nodes.join(firsts, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    linked = simhash.links(firsts.select("fp"), block).distinct().toDF("x", "y")
    apart = linked.join(firsts.toDF("x", "a"), "x").join(firsts.toDF("y", "b"), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = store.written(same.unionAll(apart), "likely")
    store.drop(firsts)
    return pairs


def sharing(nodes: DataFrame) -> DataFrame:
    """(own, node) of the nodes that share a shingle of their prefixes.

    ``own`` is one number for equal groups of nodes, whatever shingle they share.
    """
    placed = nodes.select(F.explode("prefix").alias("token"), "node")
    several = placed.groupBy("token").count().where("count > 1").select("token")
    shared = store.written(placed.join(several, "token", "left_semi"), "shared")
    digest = F.xxhash64(F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))), F.count("*"))
    per = shared.groupBy("token").agg(digest.alias("own"))
    groups = store.written(shared.join(per, "token").select("own", "node").distinct(), "groups")
    store.drop(shared)
    return groups


def _whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of sorted batches, so that all of equal place, the first column, come together."""
    held: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        change = np.flatnonzero(key != key[-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


#: What tells whether places i and others of a table may be near: (i, others) -> those of the others that may be.
Near = Callable[[int, np.ndarray], np.ndarray]


def by_parities(t: pa.Table) -> Near:
    """Those that sizes and parities allow to be similar."""
    n = t.column("n").to_numpy()
    bits = pc.list_flatten(t.column("parities")).to_numpy().view(np.uint64).reshape(-1, PARITIES)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        to = others[5 * np.minimum(n[others], n[i]) >= 4 * np.maximum(n[others], n[i])]
        return to[9 * np.bitwise_count(bits[to] ^ bits[i]).sum(axis=1, dtype=np.int64) <= n[to] + n[i]]

    return near


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([longs(pairs[:, 0]), longs(pairs[:, 1])], names=["a", "b"])


def _tree(node: np.ndarray, label: np.ndarray, near: Near, salt: int) -> np.ndarray:
    """Pairs of one place that would join all labels which likely pairs join: fewer than there are labels."""
    own = np.unique(label, return_inverse=True)[1]
    members = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1])
    waiting = np.ones(len(members), bool)
    out = []
    for start in np.argsort(text.mix(node.view(np.uint64) + np.uint64(salt))).tolist():
        queue = [start] if waiting[own[start]] else []
        waiting[own[start]] = False
        queue += [m for m in members[own[start]].tolist() if m != start] if queue else []
        while queue:
            i = queue.pop(0)
            to = near(i, np.flatnonzero(waiting[own]))
            reached, first = np.unique(own[to], return_index=True)
            out.append(np.column_stack([np.full(len(first), node[i]), node[to[first]]]))
            waiting[reached] = False
            for label_ in reached.tolist():
                queue += members[label_].tolist()
    return np.concatenate(out)


def _joining(salt: int, evidence: Callable[[pa.Table], Near]):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(it):
            place, node, label = (t.column(c).to_numpy() for c in ("place", "node", "label"))
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            yield _pairs([_tree(node[s:e], label[s:e], evidence(t.slice(s, e - s)), salt) for s, e in zip(first, [*first[1:], len(place)], strict=True)])

    return batches


def _likely(evidence: Callable[[pa.Table], Near]):
    """(a, b): all pairs of one place, not joined yet, that the evidence doesn't rule out."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(it):
            place, node, label = (t.column(c).to_numpy() for c in ("place", "node", "label"))
            near = evidence(t)
            last = np.searchsorted(place, place, side="right")
            found = []
            for i in range(len(place)):
                others = np.arange(i + 1, last[i])
                to = near(i, others[label[others] != label[i]])
                found.append(np.column_stack([np.full(len(to), node[i]), node[to]]))
            yield _pairs(found)

    return batches


def large_groups(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(own, most, q, p) of each group of more than ``block`` members: its most common label, and the blocks that this one's and the others' members are cut into."""
    per = members.groupBy("own", "label").count().groupBy("own").agg(F.sum("count").alias("all"), F.max(F.struct("count", "label")).alias("most"))
    return per.where(F.col("all") > block).select("own", F.col("most.label").alias("most"), F.ceil(F.col("most.count") / block).cast("int").alias("q"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most.count")) / block)).cast("int").alias("p"))


def placed(members: DataFrame, large: DataFrame) -> DataFrame:
    """``members`` (own, node, label, ...) with ``place`` for own: every two of different labels meet in one.

    A large group is cut: its most common label's members into blocks, all others too. Blocks
    of the others meet each other and those of the most common label; these never meet each other.
    """
    cut = members.join(large, "own", "left").withColumn("in_most", F.col("label") == F.col("most"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("in_most"), F.col("q")).otherwise(F.col("p"))).cast("int")
    numbers = F.col("mine").alias("mine")

    def all_of(n: str) -> object:
        return F.sequence(F.lit(0), F.col(n) - 1)

    with_most = F.transform(all_of("q"), lambda q: F.xxhash64("own", F.lit("most"), q, numbers))
    with_others = F.transform(all_of("p"), lambda p: F.xxhash64("own", F.lit("others"), F.least(p, numbers), F.greatest(p, numbers)))
    from_most = F.transform(all_of("p"), lambda p: F.xxhash64("own", F.lit("most"), numbers, p))
    places = F.when(F.col("most").isNull(), F.array("own")).when(F.col("in_most"), from_most).otherwise(F.concat(with_most, with_others))
    return cut.withColumn("mine", mine).select(F.explode(places).alias("place"), *[c for c in members.columns if c != "own"])


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) that sizes and parities, wide ones too, don't rule out."""

    def odd(x: str, y: str) -> object:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, v: acc + v)

    def folded(x: str, y: str) -> object:
        """``x`` with as many numbers as ``y``: sets of similar sizes have equally many, or one twice as many."""
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))

    told = nodes.select("node", "n", "parities", "wide")
    both = pairs.join(told.toDF("a", "na", "pa", "wa"), "a").join(told.toDF("b", "nb", "pb", "wb"), "b")
    most = F.col("na") + F.col("nb")
    near = both.where((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * odd("pa", "pb") <= most))
    wide = near.withColumns({"fa": folded("wa", "wb"), "fb": folded("wb", "wa")})
    return wide.where(F.col("wa").isNull() | F.col("wb").isNull() | (9 * odd("fa", "fb") <= most)).select("a", "b")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) of nodes whose texts share 4/5 or more of all their shingles, written.

    A bitmap of fixed size leaves the texts that are in no pair where they are.
    """
    pairs = store.written(possible(pairs, nodes), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bitmap = decontaminate.bitmap_of(nodes.join(asked, "node", "left_semi").select(F.xxhash64("first.doc_id").alias("fp")))
    sets = store.written(with_sets(docs, bitmap).join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")
    met = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    links = store.written(met.where(5 * F.col("both") >= 4 * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b"), "links")
    store.drop(sets)
    store.drop(pairs)
    return links


class Evidence(NamedTuple):
    """How likely pairs are found and confirmed: the columns of a node that tell, what they tell, and the exact comparison."""

    columns: list[str]
    near: Callable[[pa.Table], Near]
    similar: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def near_copies(docs: DataFrame, nodes: DataFrame, block: int = BLOCK, evidence: Evidence | None = None, likely: DataFrame | None = None) -> DataFrame:
    """(node, root) of each node that is joined to another one by links of similarity 0.8 or more, written.

    nodes: node, prefix, what the evidence needs (n, parities, wide), and ``first``, whose doc_id is that of a row of ``docs``
    with the node's text. Nodes that share a shingle of their prefixes are a group. At first the pairs ``likely`` (a, b) are held
    against their sets, then those that would join a group, or a block of a large one, with the fewest comparisons, in another
    order each time; then all likely pairs whose two members are still not joined.
    """
    by = evidence or Evidence(["n", "parities"], by_parities, similar)
    groups = sharing(nodes)
    told = nodes.select("node", *by.columns)
    found: list[DataFrame] = []
    used = [groups]
    roots = None
    if likely is not None:
        found.append(by.similar(likely, nodes, docs))
        settled = graph.components(found[0])
        roots = store.written(settled, "roots")
        store.drop(settled)
    for time in range(ROUNDS + 1):
        rooted = groups.withColumn("root", F.col("node")) if roots is None else groups.join(roots, "node", "left")
        labelled = rooted.select("own", "node", F.coalesce("root", "node").alias("label"))
        apart = labelled.groupBy("own").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("size")).where("l <> m").select("own", "size")
        rest = labelled.join(apart, "own")
        if time < ROUNDS:
            mine = F.pmod(F.xxhash64("node", F.lit(time)), F.ceil(F.col("size") / block))
            place = F.when(F.col("size") > block, F.xxhash64("own", mine)).otherwise(F.col("own"))
            members, look = rest.select(place.alias("place"), "node", "label"), _joining(time, by.near)
        else:
            written = store.written(rest.select("own", "node", "label"), "rest")
            large = store.written(large_groups(written, block), "large")
            used += [written, large]
            members, look = placed(written, large), _likely(by.near)
        pairs = members.join(told, "node").select("place", "node", "label", *by.columns).repartition("place").sortWithinPartitions("place").mapInArrow(look, "a bigint, b bigint").distinct()
        found.append(by.similar(pairs, nodes, docs))
        if roots is not None:
            used.append(roots)
        settled = graph.components(reduce(DataFrame.unionAll, found))
        roots = store.written(settled, "roots")
        store.drop(settled)
    for table in [*used, *found]:
        store.drop(table)
    return roots


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, columns as they are, one of each group of near copies: the one with the smallest doc_id.

    Texts are shuffled only where a row may be left out: a bitmap of the ids of such rows tells all others apart.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    keyed = docs.select("doc_id", rows.whole_key(docs).alias("key"), "text")
    table = store.written(with_prefix(keyed, ["doc_id", "key"]), "prefixes")
    per = table.groupBy("node").agg(F.min(F.struct(key.alias("first"), "n", "parities", "wide", "prefix", "fp")).alias("f"))
    nodes = store.written(per.select("node", "f.first", "f.n", "f.parities", "f.wide", "f.prefix", "f.fp"), "nodes")
    likely = by_fingerprints(nodes.select("node", "fp"))
    roots = near_copies(docs, nodes, likely=likely)
    store.drop(likely)
    kept = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.key")
    kept = store.written(kept, "kept")
    counts = table.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")).join(kept.withColumn("kept", F.lit(True)), "key", "left")
    named = store.written(counts.where("kept is null or n > 1").select("doc_id"), "named")
    for used in (table, nodes, roots):
        store.drop(used)
    alone, others = rows.by_id(docs, named)
    name = rows.fresh(docs, "key")
    chosen = others.withColumn(name, rows.whole_key(docs)).join(kept.toDF(name), name, "left_semi").dropDuplicates([name])
    return alone.unionAll(chosen.select(*docs.columns))
