"""Streams whose state is kept piece by piece: sliding vitals windows, and the bins that a sensor still reports.

State lives in the RocksDB store, under a key of its own for each piece: a snapshot is written once and read by the
windows that hold it, and nothing is rewritten when more comes. Timers of event time close the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import vitals as v

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def need_rocksdb(spark: SparkSession) -> None:
    """State in pieces needs this store: the session's setting is changed if it names another one."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def slots_of(seconds: np.ndarray, size: float, slide: float) -> np.ndarray:
    """Numbers of all windows [n slide, n slide + size) that hold one of the times."""
    first, last = (np.floor(x).astype(np.int64) for x in ((seconds - size) / slide, seconds / slide))
    spans = np.unique(np.column_stack([first + 1, last]), axis=0)
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in spans.tolist()])) if len(spans) else np.zeros(0, np.int64)


class SlidingWindows(StatefulProcessor):
    """Windows over snapshots: a slab of state for each slide step and batch, a timer for each window's end.

    A slab goes when the last window that holds it has been given out.
    """

    def __init__(self, keys: list[str], size: float, slide: float, work: Callable[[pd.DataFrame], list[dict]], columns: list[str]) -> None:
        self.keys, self.size, self.slide, self.work, self.columns = keys, size, slide, work, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slabs = handle.getMapState("slabs", "slab long, piece long", "n int, seconds binary, bins binary, re binary, im binary")
        self.pieces = handle.getValueState("pieces", "n long")

    def _rows(self, out: list[dict]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(out, columns=[*self.keys, "start", *self.columns])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        piece = self.pieces.get()[0] if self.pieces.exists() else 0
        for pdf in rows:
            seconds = pdf["seconds"].to_numpy(float)
            slab = np.floor(seconds / self.slide).astype(np.int64)
            for number in np.unique(slab).tolist():
                own = pdf[slab == number]
                parts = (np.stack(own[c].to_numpy()).astype(float).tobytes() for c in ("re", "im"))
                self.slabs.updateValue((number, piece), (len(own), own["seconds"].to_numpy(float).tobytes(), own["range_bin"].to_numpy(np.int64).tobytes(), *parts))
            piece += 1
            for slot in slots_of(seconds, self.size, self.slide).tolist():
                self.handle.registerTimer(int(np.ceil((slot * self.slide + self.size) * 1000)))
        self.pieces.update((piece,))
        yield from self._rows([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        slot = int(np.floor((expiredTimerInfo.getExpiryTimeInMs() / 1000 - self.size) / self.slide + 1e-6))
        start, parts, done = slot * float(self.slide), [], []
        for (slab, piece), (n, seconds, bins, re, im) in self.slabs.iterator():
            if slab <= slot:
                done.append((slab, piece))
            if start < (slab + 1) * self.slide and slab * self.slide < start + self.size:
                columns = [np.frombuffer(x, kind) for x, kind in ((seconds, float), (bins, np.int64), (re, float), (im, float))]
                parts.append(pd.DataFrame({"ts": columns[0], "range_bin": columns[1], "re": list(columns[2].reshape(n, -1)), "im": list(columns[3].reshape(n, -1))}))
        for old in done:
            self.slabs.removeKey(old)
        out = []
        if parts:
            pdf = pd.concat(parts)
            pdf = pdf[(pdf["ts"] >= start) & (pdf["ts"] < start + self.size)].sort_values(["ts", "range_bin"], kind="stable").reset_index(drop=True)
            out = [dict(zip(self.keys, key, strict=True)) | r | {"start": start} for r in (self.work(pdf) if len(pdf) else [])]
        yield from self._rows(out)

    def close(self) -> None:
        pass


def _typed(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def window_states(entries: DataFrame, keys: list[str], size: float = 30.0, slide: float = 2.0, late: str = "10 seconds", least: int = 64) -> DataFrame:
    """The rows of ``operators.vitals.vitals`` over a stream of snapshots (keys, ts: timestamp, range_bin, re, im).

    A window is given out once the watermark, ``late`` behind the newest snapshot of all, has passed its end; rows older
    than the watermark are dropped.
    """
    need_rocksdb(entries.sparkSession)

    def work(pdf: pd.DataFrame) -> list[dict]:
        bins, z, fps = v.cube(pdf, least)
        return [v.state_of(bins, v.s.displacement(z), fps)] if len(bins) and fps > 0 else []

    columns = [c.split()[0] for c in v.STATE.split(", ")][1:]
    rows = entries.withWatermark("ts", late).select(*keys, "ts", (F.unix_micros("ts") / 1e6).alias("seconds"), "range_bin", "re", "im")
    return rows.groupBy(*keys).transformWithStateInPandas(SlidingWindows(keys, size, slide, work, columns), f"{_typed(entries, keys)}, {v.STATE}", "append", "EventTime")


class LiveBins(StatefulProcessor):
    """The last time of each of a sensor's bins; one that is silent for the time to live leaves the state by itself."""

    def __init__(self, keys: list[str], keep_s: float, seen_s: float) -> None:
        self.keys, self.keep_s, self.seen_s = keys, keep_s, seen_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bins = handle.getMapState("bins", "range_bin long", "t double", ttlDurationMs=int(self.keep_s * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = {b: t for (b,), (t,) in self.bins.iterator()}
        for pdf in rows:
            for b, t in pdf.groupby("range_bin")["t"].max().items():
                if b not in held or t > held[b]:
                    held[b] = float(t)
                self.bins.updateValue((int(b),), (held[b],))
        now = max(held.values())
        for b in [b for b, t in held.items() if t < now - self.keep_s]:
            self.bins.removeKey((int(b),))
            del held[b]
        told = dict(zip(self.keys, key, strict=True))
        yield pd.DataFrame([told | {"range_bin": b, "t": t, "now": now, "fresh": t >= now - self.seen_s} for b, t in sorted(held.items())], columns=[*self.keys, "range_bin", "t", "now", "fresh"])

    def close(self) -> None:
        pass


def live_bins(entries: DataFrame, keys: list[str], keep_s: float = 65.0, seen_s: float = 3.0) -> DataFrame:
    """After each batch of a stream of entries (keys, range_bin, t in seconds): the bins a sensor still has, and which are fresh.

    keys without the bin. A bin goes ``keep_s`` after its last frame: by the sensor's own times, and by the clock where
    the sensor is silent. It is fresh if seen within ``seen_s`` of the sensor's newest frame.
    """
    need_rocksdb(entries.sparkSession)
    rows = entries.select(*keys, F.col("range_bin").cast("long").alias("range_bin"), F.col("t").cast("double").alias("t"))
    return rows.groupBy(*keys).transformWithStateInPandas(LiveBins(keys, keep_s, seen_s), f"{_typed(entries, keys)}, range_bin long, t double, now double, fresh boolean", "append", "ProcessingTime")


def replayable(path: str, partitions: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each batch is a partition of its own, which a repeated run of the batch overwrites.

    A table belongs to one checkpoint, whose batch numbers never name other rows. Nothing is appended, so that a stream that
    is killed between its write and its commit leaves the rows of that batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *partitions).parquet(path)

    return write
