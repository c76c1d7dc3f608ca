"""SimHash near-duplicates by anchor-point covering.

A fingerprint has a bit set where over half of the hashes of the text's word shingles have it. To find all
fingerprints that differ in at most three bits, each is cut into two halves of 32 bits: two linked fingerprints
differ in at most one bit of one half. The anchors of a half are the words of the perfect (31, 26) Hamming code
with one free bit, a covering code of radius 1. Each fingerprint goes to every anchor within 1 + 1 of its half,
so that it meets each linked one at that one's own anchor, and members of an anchor are compared in full.

Defined cases: a null text counts as empty; a text without words has fingerprint zero, and such texts are
linked like any others; one or two words make one shingle. Repeated rows share their fingerprint and component.
A null ``doc_id`` is kept and never names a component unless no member has one (then the component is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, store, text

THRESHOLD = 3
SHINGLE = 3
#: Fixed value: the seed of XXH64.
SEED = 42
#: Members of an anchor that one task compares; a larger anchor is split.
BLOCK = 20_000
#: Up to so many members are compared all at once, place by place.
_SMALL = 48
_STEP = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Of one text in UTF-8, as an unsigned number. bytes.lower and bytes.split mind ASCII alone, as they should."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _STEP):
        part = h[at : at + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the fingerprint ``fp`` (as a signed long) of each whole text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw, offs = text.strings(b.column(len(keep)))
            view = memoryview(raw)
            found = np.fromiter((fingerprint(bytes(view[s:e])) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(batches, f"{kinds}, fp bigint")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Of the (31, 26) Hamming code: the exclusive or of the places (from 1) whose bits are set."""
    out = np.zeros(len(words), dtype=np.int64)
    for place in range(1, 32):
        out ^= np.where((words >> np.uint64(place - 1)) & np.uint64(1), place, 0)
    return out


def _errors() -> np.ndarray:
    """By syndrome: the sixteen patterns of at most two bits that have it; the pattern 0 fills up syndrome 0."""
    table = np.zeros((32, 16), dtype=np.uint64)
    for s in range(1, 32):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]
        table[s] = [1 << (s - 1), *pairs]
    return table


_ERRORS = _errors()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor within 2 of either half; bit 32 of an anchor tells the half."""
    index, found = [], []
    low31, own = np.uint64(0x7FFFFFFF), np.arange(len(fps))
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        s = _syndromes(word & low31)
        near = word[:, None] ^ _ERRORS[s]
        flipped = near[:, 0] ^ np.uint64(1 << 31)  # the free bit, with the one code word within 1
        wide = np.flatnonzero(s)
        index += [own, own, np.repeat(wide, 15)]
        found += [x | np.uint64(half << 32) for x in (near[:, 0], flipped, near[wide, 1:].ravel())]
    return np.concatenate(index), np.concatenate(found)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints."""
    return np.bitwise_count(a ^ b)


def forest(sigs: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (as places) that join all that are joined by links among these: at most one for each of them."""
    links, rest, queue = [], np.arange(1, len(sigs)), [0]
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        at = queue.pop()
        near = _apart(sigs[rest], sigs[at]) <= threshold
        if near.any():
            reached = rest[near]
            links.append((np.full(len(reached), at), reached))
            queue += list(reached)
            rest = rest[~near]
    return links


def _compared(group: np.ndarray, sigs: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) within the groups of equal, adjacent ``group``."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, len(group)))
    size = np.repeat(sizes, sizes)
    links = []
    few = np.flatnonzero((size > 1) & (size <= _SMALL))
    g = group[few]
    for lag in range(1, min(_SMALL, len(few))):
        at = np.flatnonzero(g[lag:] == g[:-lag])
        if not len(at):
            break
        at = at[_apart(sigs[few[at]], sigs[few[at + lag]]) <= threshold]
        links.append((few[at], few[at + lag]))
    for s, n in zip(first[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        links += [(a + s, b + s) for a, b in forest(sigs[s : s + n], threshold)]
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])


def _large(placed: DataFrame, by: str, block: int) -> DataFrame:
    """(by, parts): the places of more than ``block`` rows, and the blocks they are cut into."""
    parts = F.ceil(F.col("count") / block).cast("int")
    return store.written(placed.groupBy(by).count().where(F.col("count") > block).select(by, parts.alias("parts")), "places")


def by_bytes(placed: DataFrame, large: DataFrame) -> DataFrame:
    """(place, fp) from (anchor, fp): the members of ``large`` anchors once for each byte of their other half.

    Two linked members differ in at most three bits of that half, so that one of its four bytes is the same in both.
    """
    low = F.shiftrightunsigned("anchor", 32).bitwiseAND(F.lit(1)) == 0
    other = F.when(low, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    finer = F.array(*(F.xxhash64("anchor", F.lit(p), F.shiftrightunsigned(other, 8 * p).bitwiseAND(F.lit(255))) for p in range(4)))
    places = F.when(F.col("parts").isNull(), F.array("anchor")).otherwise(finer)
    return placed.join(large, "anchor", "left").select(F.explode(places).alias("place"), "fp")


def in_blocks(placed: DataFrame, large: DataFrame) -> DataFrame:
    """(place, fp): the ``large`` places in blocks of the fingerprint's hash, every two of them in a place of their own."""
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cut = placed.join(large, "place", "left").select("place", "fp", parts.alias("parts"), mine.alias("mine")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place = F.when(F.col("parts") == 1, F.col("place")).otherwise(F.xxhash64("place", F.least("mine", "other"), F.greatest("mine", "other")))
    return cut.select(place.alias("place"), "fp")


def met(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), with repeats: links between the fingerprints that meet at an anchor.

    placed: anchor, fp. An anchor of more than ``block`` members is split by the bytes of their other half, and only
    what is still larger is cut into blocks, every two of which meet in a task of their own.
    """

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            node = rows[1].view(np.uint64)
            i, j = _compared(rows[0], node, THRESHOLD)
            a, b = node[i], node[j]
            pairs = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for b in it:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            change = np.flatnonzero(rows[0] != rows[0, -1])
            if not len(change):
                held.append(rows)  # all of one anchor: it may go on
                continue
            cut = change[-1] + 1
            yield out(np.concatenate([*held, rows[:, :cut]], axis=1))
            held = [rows[:, cut:]]
        if held:
            yield out(np.concatenate(held, axis=1))

    large = _large(placed, "anchor", block)
    if large.isEmpty():
        places = placed.withColumnRenamed("anchor", "place")
    else:
        finer = by_bytes(placed, large)
        dense = by_bytes(placed.join(large.select("anchor"), "anchor", "left_semi"), large)
        places = in_blocks(finer, _large(dense, "place", block))
    return places.repartition("place").sortWithinPartitions("place").mapInArrow(compare, "a bigint, b bigint")


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), with repeats: links of at most three differing bits that connect all that such links do. fps: distinct, column fp."""

    def replicate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                index, found = anchors(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(part[index])], names=["anchor", "fp"])

    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a small file of fingerprints makes many rows
    return met(spread.mapInArrow(replicate, "anchor bigint, fp bigint"), block)


def clusters(table: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint of ``table`` that is linked to another one."""
    fps = store.written(table.select("fp").distinct(), "fps")
    return graph.components(links(fps)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (its component's smallest doc_id)."""
    table = store.written(with_fingerprint(docs, ["doc_id"]), "fingerprints")
    per = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = store.written(clusters(per), "roots")
    rooted = per.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
