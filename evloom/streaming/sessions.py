"""Streaming queries over events: activity runs by session window, evidence with watermarks."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evloom.session import ship, shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = 8192  # of videos in the state of a fold: a group's rows are in memory at once
_PACKED = ("code", "us", "seq", "size", "px")


def event_stream(spark, sf_dir: str) -> DataFrame:
    """The events table as a file stream (timestamps with zone, as watermarks need them)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, name: str, root: str | None = None) -> DataFrame:
    """Run a stream over all that is there now; the sink's last state as a table in the shared folder. Every micro-batch has a
    folder of its own, by its number: one that is run again after a failure replaces its rows. With `root` of an earlier call
    the stream goes on from its checkpoint there, and the table holds both runs."""
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/evloom/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{'last' if mode == 'complete' else f'batch={epoch}'}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{root}/out")


def activity_runs(spark, sf_dir: str, gap: str = "1 day") -> DataFrame:
    """Runs of a user's events with less than `gap` between neighbours."""
    runs = event_stream(spark, sf_dir).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp'2024-01-01 00:00:00', {c})")
    return drain(runs.select("user_id", micros("w.start").alias("start_us"), micros("w.end").alias("end_us"), "n"), "complete", "runs")


def correlate_stream(points: DataFrame, windows: DataFrame, tol_sec: float, late: str = "10 minutes") -> DataFrame:
    """Stream-stream band join with watermarks: points (video_id, ts) within tol of windows (video_id, t)."""
    tol = F.expr(f"interval {tol_sec!r} seconds")
    p = points.withWatermark("ts", late).withColumnRenamed("video_id", "_v")
    w = windows.withWatermark("t", late)
    return w.join(p, (F.col("video_id") == F.col("_v")) & (F.col("ts") >= F.col("t") - tol) & (F.col("ts") <= F.col("t") + tol)).drop("_v")


def overlap_stream(spans: DataFrame, windows: DataFrame, tol_sec: float, longest_sec: float, late: str = "10 minutes") -> DataFrame:
    """Stream-stream join of windows (video_id, t) with the spans (video_id, ts, end_ts) that overlap [t - tol, t + tol], ends
    included. A span lasts `longest_sec` at most, longer ones are not met in full: with the watermarks that bounds what
    either side must keep, and Spark drops from state what can meet nothing any more."""
    tol, longest = F.expr(f"interval {tol_sec!r} seconds"), F.expr(f"interval {longest_sec!r} seconds")
    s = spans.withWatermark("ts", late).withColumnRenamed("video_id", "_v")
    w = windows.withWatermark("t", late)
    meet = (F.col("ts") <= F.col("t") + tol) & (F.col("ts") >= F.col("t") - tol - longest) & (F.col("end_ts") >= F.col("t") - tol)
    return w.join(s, (F.col("video_id") == F.col("_v")) & meet).drop("_v")


def event_overlaps(spark, sf_dir: str, tol_sec: float, longest_sec: float = 86400.0) -> DataFrame:
    """Views of a user's event stream as windows, errors as spans of as many minutes as their value says."""
    e = event_stream(spark, sf_dir).withColumn("video_id", F.col("user_id").cast("string"))
    w = e.where("event_type = 'view'").select("video_id", F.col("event_id").alias("probe"), F.col("ts").alias("t"))
    s = e.where("event_type = 'error'").select("video_id", F.col("event_id").alias("seq"), "ts", F.expr("ts + make_dt_interval(0, 0, 0, value * 60)").alias("end_ts"))
    return drain(overlap_stream(s, w, tol_sec, longest_sec).select("video_id", "probe", "seq"), "append", "overlaps")


def _frames(some: pd.DataFrame) -> dict:
    """Columns of frames: the videos' names and, a row, its video's place there, time, id, number of pixels; all pixels in one row."""
    code, names = pd.factorize(some["video_id"], use_na_sentinel=False)
    px = [np.asarray(x, dtype=np.float64) for x in some["px"]]
    whole = lambda x: np.asarray(x, dtype=np.int64)
    return {"names": [x if isinstance(x, str) else None for x in names], "code": whole(code), "us": whole(some["us"]), "seq": whole(some["seq"]), "size": whole([len(x) for x in px]), "px": np.concatenate(px)}


def _packed(f: dict) -> tuple:
    return f["names"], *(f[c].tobytes() for c in _PACKED)


def _unpacked(held: list) -> dict:
    place: dict = {}
    code = [np.array([place.setdefault(x, len(place)) for x in r[0]], dtype=np.int64)[np.frombuffer(r[1], np.int64)] for r in held]
    rest = {c: np.concatenate([np.frombuffer(r[i], np.float64 if c == "px" else np.int64) for r in held]) for i, c in enumerate(_PACKED[1:], 2)}
    return {"names": list(place), "code": np.concatenate(code), **rest}


def _where(f: dict, rows: np.ndarray) -> dict:
    names, code = np.unique(f["code"][rows], return_inverse=True)
    return {"names": [f["names"][i] for i in names], "code": code.astype(np.int64), "px": f["px"][np.repeat(rows, f["size"])], **{c: f[c][rows] for c in ("us", "seq", "size")}}


def _videos(f: dict) -> Iterator[tuple]:
    """(name, its rows in the order of times, then ids, then pixels; their pixels as a matrix) of each video."""
    start = np.cumsum(f["size"]) - f["size"]
    order = np.lexsort((f["seq"], f["us"], f["code"]))
    for rows in np.split(order, np.flatnonzero(np.diff(f["code"][order])) + 1):
        width = f["size"][rows[0]]
        if (f["size"][rows] != width).any():
            raise ValueError(f"frames of video {f['names'][f['code'][rows[0]]]} differ in size")
        px = f["px"][start[rows][:, None] + np.arange(width)]
        if ((np.diff(f["us"][rows]) == 0) & (np.diff(f["seq"][rows]) == 0)).any():
            again = np.lexsort((*px.T[::-1], f["seq"][rows], f["us"][rows]))
            rows, px = rows[again], px[again]
        yield f["names"][f["code"][rows[0]]], rows, px


def _kept(px: np.ndarray, last: np.ndarray | None, least: float) -> tuple[list[int], np.ndarray]:
    """(places of the frames that differ from the last kept one, that one at the end): looks ahead in blocks, from each kept frame to the next."""
    kept, at, ahead = [], 0, 8
    if last is None:
        kept, last, at = [0], px[0], 1
    if px.shape[1] == 1:
        v = float(last[0])
        for i, x in enumerate(px[at:, 0].tolist(), at):
            if abs(x - v) > least:
                v = x
                kept.append(i)
        return kept, np.array([v])
    while at < len(px):
        far = np.abs(px[at : at + ahead] - last).sum(axis=1) / px.shape[1] > least
        i = int(far.argmax())
        if far[i]:
            at, ahead, last = at + i + 1, 8, px[at + i]
            kept.append(at - 1)
        else:
            at, ahead = at + len(far), min(2 * ahead, 1024)
    return kept, last


class KeyframeFold(StatefulProcessor):
    """folds.keyframe_dedupe as a stream: rows wait, in state, until the watermark has passed them, then they are folded in the
    order of their times, however they were cut into micro-batches. A group holds the videos of one hash, for a group and a call to
    the state store cost milliseconds and a frame microseconds. State: the rows that wait, packed by batches of rows as they
    came; the last kept thumbnail of each video."""

    def __init__(self, least_mad: float):
        self.least = least_mad

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "names array<string>, code binary, us binary, seq binary, size binary, px binary")
        self.last = handle.getValueState("last", "names array<string>, size binary, px binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [_frames(some) for some in rows if len(some)]
        self.waiting.appendList([_packed(f) for f in new])
        self.handle.registerTimer(min(int(f["us"].min()) for f in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get())
        if not held:  # another timer of this batch has folded them
            return iter(())
        f = _unpacked(held)
        due = f["us"] < until
        if not due.all():
            self.handle.registerTimer(int(f["us"][~due].min()) // 1000 + 1)
        if not due.any():
            return iter(())
        if due.all():
            self.waiting.clear()
        else:
            self.waiting.put([_packed(_where(f, ~due))])
            f = _where(f, due)
        last, kept = self._last(), []
        for name, rows, px in _videos(f):
            at, last[name] = _kept(px, last.get(name), self.least)
            kept.append(rows[at])
        self.last.update((list(last), np.array([len(x) for x in last.values()], dtype=np.int64).tobytes(), np.concatenate(list(last.values())).tobytes()))
        kept = np.concatenate(kept)
        return iter([pd.DataFrame({"video_id": [f["names"][i] for i in f["code"][kept]], "seq": f["seq"][kept], "us": f["us"][kept]})] if len(kept) else [])

    def _last(self) -> dict:
        was = self.last.get()
        if was is None:
            return {}
        return dict(zip(was[0], np.split(np.frombuffer(was[2], np.float64), np.cumsum(np.frombuffer(was[1], np.int64))[:-1]), strict=True))

    def close(self) -> None:
        pass


def keyframe_stream(frames: DataFrame, least_mad: float, late: str = "1 hour") -> DataFrame:
    """A stream of frames (video_id, seq, at: timestamp, px) -> (video_id, seq, us: microseconds since 1970) of those that differ from
    the last kept one. A frame is told once the watermark has passed it; later than `late` it is dropped by Spark. The state
    store is RocksDB: what waits need not fit in memory."""
    ship(frames.sparkSession)
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = frames.select("video_id", "seq", F.unix_micros("at").alias("us"), F.col("px").cast("array<double>").alias("px"), "at").withWatermark("at", late)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("video_id"), F.lit(GROUPS)))
    return rows.groupBy("_group").transformWithStateInPandas(KeyframeFold(least_mad), "video_id string, seq long, us long", "Append", "EventTime")


def event_keyframes(spark, sf_dir: str, least_mad: float = 60.0) -> DataFrame:
    """Events as a stream of frames with one pixel, their value."""
    e = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.array("value").alias("px"))
    return drain(keyframe_stream(e, least_mad), "append", "keyframes")
