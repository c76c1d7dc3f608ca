"""Streams of frames: ingest, windows and the ordered jobs, with batch twins of the latter.

Batch and stream give equal results where no row is late: rows are put in order within a micro-batch, and across
micro-batches they are taken as they come. Watermarks are 10 seconds unless given.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import frames as wire
from .live import replayable, window_states

LATE = "10 seconds"
Step = Callable[[dict, dict], "dict | list[dict]"]


def _records(pdf: pd.DataFrame) -> list[dict]:
    return [{k: None if v is None or (isinstance(v, float) and v != v) else v for k, v in r.items()} for r in pdf.to_dict("records")]


def _given(step: Step, state: dict, row: dict, keep: list[str]) -> list[dict]:
    out = step(state, row)
    return [{k: row[k] for k in keep} | g for g in (out if isinstance(out, list) else [out])]


def in_batch(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """A step function over each key's rows in order; schema: keys, order columns, then the step's outputs.

    A key's rows come one batch after the other from a sorted partition, so that only its state is held.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        state: dict = {}
        for pdf in it:
            out = []
            for row in _records(pdf):
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, {}
                out += _given(step, state, row, [*keys, *order])
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(work, schema)


def in_stream(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """The same over a stream; a key's state is kept as JSON between micro-batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = [g for row in _records(pdf) for g in _given(step, state, row, [*keys, *order])]
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(*keys).applyInPandasWithState(work, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def stale_sensors(df: DataFrame, key: str, seconds: int = 12) -> DataFrame:
    """A row for each sensor that has sent nothing for ``seconds`` of processing time."""

    def work(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            frames = held.get[0]
            held.remove()
            yield pd.DataFrame({key: [k[0]], "frames": [frames]})
            return
        n = sum(len(p) for p in parts)
        held.update(((held.get[0] if held.exists else 0) + n,))
        held.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({key: [], "frames": []})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(work, f"`{key}` {kind}, frames long", "frames long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(blobs: DataFrame, path: str, checkpoint: str):
    """Decoded frames of a stream of blobs (path, content): a Parquet table by batch and kind, each batch there once however often it runs."""
    write = replayable(path, ["kind"])
    return blobs.writeStream.foreachBatch(lambda batch, number: write(wire.decode_blobs(batch), number)).option("checkpointLocation", checkpoint)


def blocks(df: DataFrame, keys: list[str], ts: str, aggregates: list, size: str = "5 minutes", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Aggregates over wall-clock blocks (tumbling, or sliding with ``slide``) of a stream or a table."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, late).groupBy(*keys, window.alias("w")).agg(*aggregates)
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in (*keys, "w")])


def vitals_windows(entries: DataFrame, keys: list[str], size: str = "30 seconds", slide: str = "2 seconds", late: str = LATE) -> DataFrame:
    """Vitals per sliding window of snapshots (keys, ts, range_bin, re, im), of a stream or a table; start is a timestamp."""
    from ..operators import vitals as v

    length, step = (float(x.split()[0]) for x in (size, slide))
    if entries.isStreaming:
        out = window_states(entries, keys, length, step, late)
    else:
        out = v.vitals(entries.withColumn("ts", F.unix_micros("ts") / 1e6), keys, length, step)
    return out.withColumn("start", F.timestamp_micros((F.col("start") * 1_000_000).cast("long")))


def fresh(entries: DataFrame, keys: list[str], ts: str, now: DataFrame, keep_s: float = 65.0, seen_s: float = 3.0) -> DataFrame:
    """Entries of the last ``keep_s`` seconds of bins seen in the last ``seen_s``; now: sensor_id and its time (now)."""
    recent = entries.join(now, "sensor_id").where(F.col(ts) >= F.col("now") - keep_s)
    alive = recent.groupBy(*keys).agg(F.max(ts).alias("_last"), F.first("now").alias("_now")).where(F.col("_last") >= F.col("_now") - seen_s)
    return recent.join(alive, keys, "left_semi").drop("now")


def answered(requests: DataFrame, answers: DataFrame, valid: str = "12 seconds", bins: int = 10, late: str = LATE) -> DataFrame:
    """Answers that belong to a request: same sensor and epoch, near in bin, and in time. Works on two streams too.

    requests: sensor_id, epoch, ts, range_bin. answers: sensor_id, epoch, a_ts, a_bin, verdict.
    """
    r, a = requests.withWatermark("ts", late).alias("r"), answers.withWatermark("a_ts", late).alias("a")
    cond = F.expr(f"r.sensor_id = a.sensor_id AND r.epoch = a.epoch AND a.a_ts >= r.ts AND a.a_ts <= r.ts + INTERVAL {valid} AND abs(a.a_bin - r.range_bin) <= {bins}")
    return r.join(a, cond).select("r.sensor_id", "r.epoch", "r.ts", "r.range_bin", "a.a_ts", "a.verdict")
