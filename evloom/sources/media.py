"""Sources: container probes, decoded frames, transcripts; and the seams for outside providers."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evloom.functions.scalars import even_span, floor_ms, is_url, py_round, py_strip
from evloom.operators import contracts
from evloom.operators.correlate import ELEMENT, NATIVE
from evloom.operators.measure import clamp_segments
from evloom.operators.ordered import latest, placed
from evloom.operators.pixels import luma
from evloom.operators.temporal import text_around
from evloom.session import ship, sliced, written

from .workspace import read_local

PROBE_SCHEMA = (
    "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,duration:string>>,"
    "format struct<duration:string,size:string,format_name:string,tags:struct<title:string>>"
)


def probes(rows: DataFrame, json_col: str = "probe") -> DataFrame:
    """rows (path, probe: container JSON and, where known, length in bytes and title) -> videos; `error` says what a container
    lacks. A title handed in goes before the container's own; none is made up."""
    p = rows.withColumn("_p", F.from_json(json_col, PROBE_SCHEMA))
    for name, kind in (("length", "bigint"), ("title", "string")):
        p = p if name in rows.columns else p.withColumn(name, F.lit(None).cast(kind))
    p = p.withColumn("_v", F.expr("get(filter(_p.streams, s -> s.codec_type = 'video'), 0)")).withColumn("_a", F.expr("get(filter(_p.streams, s -> s.codec_type = 'audio'), 0)"))
    fps = F.expr("coalesce(try_divide(try_cast(split(_v.avg_frame_rate, '/')[0] as double), try_cast(split(_v.avg_frame_rate, '/')[1] as double)), 0D)")
    p = p.withColumn("duration_sec", F.expr("try_cast(coalesce(_p.format.duration, _v.duration) as double)"))
    error = F.expr(
        "case when path is null then 'no such file' when length = 0 then 'empty file' when _p is null then 'unreadable container' when _v is null then 'no video stream'"
        " when not coalesce(duration_sec > 0, false) then 'invalid duration' when not coalesce(_v.width > 0 and _v.height > 0, false) then 'invalid frame size' end"
    )
    return p.select(
        "path", "duration_sec", F.col("_v.width").alias("width"), F.col("_v.height").alias("height"), fps.alias("fps"), F.col("_a").isNotNull().alias("has_audio"),
        F.when(is_url("path"), "url").otherwise("local").alias("source_type"), F.col("_v.codec_name").alias("video_codec"), F.col("_a.codec_name").alias("audio_codec"),
        F.col("_p.format.format_name").alias("format_name"), F.coalesce("title", "_p.format.tags.title").alias("title"), error.alias("error"),
    )


def resolve(source: str, folder: str, fetcher: Fetcher | None = None) -> dict:
    """Where a source's media lies: a local file's path, or a url's copy in `folder`, fetched once: a non-empty `<id>.mp4` is
    used again. (path, source, source_type, title)"""
    if not source.lower().startswith(("http://", "https://")):
        path = read_local(source)
        return {"path": path, "source": path, "source_type": "local", "title": None}
    if fetcher is None:
        raise ValueError("a url needs a fetcher")
    told = fetcher.describe(source)
    path = os.path.join(folder, f"{told['id']}.mp4")
    if not (os.path.isfile(path) and os.path.getsize(path)):
        os.makedirs(folder, exist_ok=True)
        fetcher.fetch(source, path)
    return {"path": read_local(path), "source": source, "source_type": "url", "title": told.get("title")}


def image_frames(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Images of a folder: (decoded: origin, width, height, gray raster), (unreadable: origin, error)."""
    ship(spark)
    raw = spark.read.format("image").load(path).select("image.*")
    kind = pa.schema([("origin", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("gray", pa.binary())])

    def gray(batches):
        for b in sliced(batches, 16):
            out = []
            for r in b.to_pylist():
                bgr = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                one = bgr[..., 0] if r["nChannels"] == 1 else luma(bgr[..., :3])
                out.append({"origin": r["origin"], "width": r["width"], "height": r["height"], "gray": one.tobytes()})
            yield pa.RecordBatch.from_pylist(out, kind)

    good = raw.where("width > 0 and height > 0 and nChannels > 0")
    bad = raw.where("not coalesce(width > 0 and height > 0 and nChannels > 0, false)").select("origin", F.lit("image could not be decoded").alias("error"))
    return good.select("origin", "width", "height", "nChannels", "data").mapInArrow(gray, "origin string, width int, height int, gray binary"), bad


def last_frames(frames: DataFrame) -> DataFrame:
    """(video_id, ts): the last frame that can be read of each video, down to the millisecond."""
    return frames.groupBy("video_id").agg(floor_ms(F.max("ts")).alias("ts"))


def clamp_time(t: str, duration: str, fps: str):
    """A time inside the stream: at most one frame before its end, down to the millisecond, not negative."""
    return F.greatest(F.lit(0.0), floor_ms(F.least(F.col(t), F.expr(f"{duration} - if({fps} > 0, 1 / {fps}, 0D)"))))


def read_at(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """Each request (video_id, request, t) with the last frame at or before t, however long before: requests and frames are
    put in one order, the last frame is carried on inside blocks of the time axis and from block to block."""
    q = F.struct(*requests.columns)
    both = requests.select("video_id", F.col("t").alias("_t"), F.lit(1).alias("_side"), q.alias("_q"), F.lit(None).cast("double").alias("_f"))
    kind = both.schema["_q"].dataType
    both = both.unionByName(frames.select("video_id", F.col("ts").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_q"), F.col("ts").alias("_f")))
    return latest(both, "_f", "frame_ts", order=("_t", "_side")).where("_side = 1").select("_q.*", "frame_ts")


def window_samples(requests: DataFrame) -> DataFrame:
    """Requests (video_id, request, start_sec, end_sec, interval, duration, fps) -> sample times, clamped ones once."""
    n = "cast((end_sec - start_sec) / interval + 1e-9D as int)"
    grid = requests.select("*", F.posexplode(F.expr(f"transform(sequence(0, {n}), i -> start_sec + i * interval)")).alias("i", "t"))
    grid = grid.withColumn("t", clamp_time("t", "duration", "fps"))
    return grid.groupBy("video_id", "request", "t").agg(F.min("i").alias("i"))


def inspect(requests: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Targeted requests -> (video_id, request, i, t, frame_ts, crop and scale plan, out_width, out_height).

    A request without a window (or whose window is empty at the video's end) is the one frame at its time; a window gives
    frames every 1 / fps seconds. Times are clamped to the last frame, by the container's duration and by the frames there
    are; equal clamped times come once. Broken requests (contracts: inspection) are an error where they are read."""
    good, _ = contracts.validate(requests.withColumn("start_sec", F.col("timestamp_sec")).withColumn("end_sec", F.expr("case when window_before_sec > 0 or window_after_sec > 0 then timestamp_sec end")), "inspection", strict=True)
    v = videos.select("video_id", F.col("duration_sec").alias("duration"), F.col("fps").alias("video_fps"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    r = good.drop("start_sec", "end_sec").join(v, "video_id").join(last_frames(frames).withColumnRenamed("ts", "_last"), "video_id", "left")
    r = r.withColumn("a", F.expr("greatest(0D, timestamp_sec - coalesce(window_before_sec, 0D))")).withColumn("b", F.expr("least(timestamp_sec + coalesce(window_after_sec, 0D), duration)"))
    grid = "if(fps is null or b <= a, array(timestamp_sec), transform(sequence(0, cast((b - a) * fps + 1e-9D as int)), i -> a + i / fps))"
    r = r.withColumn("_plan", _pixel_plan()).select("video_id", "request", "duration", "video_fps", "_last", "_plan", F.posexplode(F.expr(grid)).alias("i", "t"))
    r = r.withColumn("t", F.least(clamp_time("t", "duration", "video_fps"), F.coalesce("_last", F.col("t"))))
    r = r.groupBy("video_id", "request", "t").agg(F.min("i").alias("i"), F.first("_plan").alias("_plan"))
    seen = read_at(r.withColumn("_r", F.col("request")).withColumn("request", F.struct("_r", "i")), frames)
    return seen.select("video_id", F.col("_r").alias("request"), "i", "t", "frame_ts", "_plan.*")


def _pixel_plan():
    """crop_x, crop_y, crop_w, crop_h (null: whole frame), out_width, out_height of a request on its video's frame."""
    x, w = even_span("region.x1", "region.x2", "_w")
    y, h = even_span("region.y1", "region.y2", "_h")
    whole = F.col("region").isNull() | ((x == 0) & (y == 0) & (w == F.col("_w")) & (h == F.col("_h")))
    cw, ch = F.when(whole, F.col("_w")).otherwise(w), F.when(whole, F.col("_h")).otherwise(h)
    wide = F.coalesce(F.col("scale_width"), cw)
    tall = F.when(wide == cw, ch).otherwise(F.greatest(F.lit(1), F.floor((ch * wide * 2 + cw) / (2 * cw)).cast("int")))
    return F.struct(*[F.when(~whole, v).alias(n) for n, v in (("crop_x", x), ("crop_y", y), ("crop_w", w), ("crop_h", h))], wide.alias("out_width"), tall.alias("out_height"))


def normalise_segments(segments: DataFrame) -> DataFrame:
    """Times to the millisecond, texts stripped, no invented confidence."""
    return segments.withColumn("start_sec", py_round("start_sec", 3)).withColumn("end_sec", py_round("end_sec", 3)).withColumn("text", py_strip("text")).withColumn("confidence", F.lit(None).cast("double"))


# --- seams for outside providers. Each runner makes its provider once per task from a factory that is shipped to it.


@runtime_checkable
class Fetcher(Protocol):
    def describe(self, url: str) -> dict: ...

    def fetch(self, url: str, path: str) -> None: ...


@runtime_checkable
class Transcriber(Protocol):
    def transcribe(self, video: dict) -> list[dict]: ...


@runtime_checkable
class FrameReader(Protocol):
    def extract_frames(self, video: dict) -> list[dict]: ...


@runtime_checkable
class PointerProvider(Protocol):
    def detect_pointer(self, frame: dict, before: dict | None) -> dict: ...


@runtime_checkable
class VisionProvider(Protocol):
    def analyze_frame(self, frame: dict, transcript_context: str | None, pointer: dict | None) -> dict: ...


@runtime_checkable
class VideoProvider(Protocol):
    def analyze_video(self, video: dict, transcript: list[dict] | None, start_sec: float | None, end_sec: float | None, prompt: str | None) -> Sequence[dict]: ...


@runtime_checkable
class Synthesizer(Protocol):
    def synthesize(self, brief: dict) -> dict: ...


def each(rows: DataFrame, make_provider, schema: str, act, batch: int = 64) -> DataFrame:
    """act(provider, row) -> output rows, for every row; the provider is made once per task."""
    ship(rows.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        provider = None
        for b in sliced(batches, batch):
            provider = provider or make_provider()
            out = [x for r in b.to_pylist() for x in act(provider, r)]
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(run, schema)


SEGMENT = "start_sec double, end_sec double, text string, confidence double, words array<struct<text:string,start_sec:double,end_sec:double>>"


def transcribe(videos: DataFrame, make_transcriber) -> tuple[DataFrame, DataFrame]:
    """(headers: video_id, transcript_status, error; segments in order of start). A video without sound is no_audio and the
    provider is not asked; nothing said is no_speech; a provider that fails leaves its video unavailable, with the type of
    the error, and the job goes on; segments are clipped to the video and normalised."""

    def act(t, v):
        row = {"video_id": v["video_id"], "has_audio": bool(v["has_audio"]), "duration": v["duration_sec"], "segments": [], "error": None}
        try:
            yield row if not v["has_audio"] else row | {"segments": [{"text": "", "confidence": None, "words": None, **x} for x in t.transcribe(v)]}
        except Exception as e:  # outside code: speech is missing, the rest goes on
            yield row | {"error": type(e).__name__}

    inner = ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in ("start_sec double", "end_sec double", "text string", "confidence double")) + ",words:array<struct<text:string,start_sec:double,end_sec:double>>"
    raw = written(each(videos, make_transcriber, f"video_id string, has_audio boolean, duration double, segments array<struct<{inner}>>, error string", act, 1), "transcripts")
    flat = clamp_segments(raw.select("video_id", "duration", F.explode("segments").alias("s")).select("video_id", "duration", "s.*")).drop("duration")
    flat = normalise_segments(flat).where("text <> ''")
    seg = flat.withColumn("seg_no", F.row_number().over(Window.partitionBy("video_id").orderBy("start_sec", "end_sec", "text")).cast("long") - 1)
    there = seg.select("video_id").distinct().withColumn("_s", F.lit("ok"))
    state = F.when(~F.col("has_audio"), "no_audio").when(F.col("error").isNotNull(), "unavailable").otherwise(F.coalesce("_s", F.lit("no_speech")))
    return raw.join(there, "video_id", "left").select("video_id", state.alias("transcript_status"), "error"), seg


FRAME = "video_id string, seq long, ts double, path string, width int, height int, gray binary, reason string"


def extract_frames(videos: DataFrame, make_reader) -> tuple[DataFrame, DataFrame]:
    """(frames of each video, as its reader gives them, numbered in order; states: video_id, n_frames, error). A reader that
    fails leaves its video without frames and names the type of the error; the job goes on."""

    def act(reader, v):
        none = {"video_id": v["video_id"], "seq": None, "ts": None, "path": None, "width": None, "height": None, "gray": None, "reason": None, "error": None}
        rows = []
        try:
            for i, f in enumerate(reader.extract_frames(v)):
                rows.append(none | {"path": "", "width": 0, "height": 0, "reason": "sampled", **f, "video_id": v["video_id"], "seq": i, "ts": float(f["ts"])})
        except Exception as e:  # outside code: frames are missing, the rest goes on
            rows = [none | {"error": type(e).__name__}]
        return rows or [none]

    raw = written(each(videos, make_reader, FRAME + ", error string", act, 1), "frames")
    states = raw.groupBy("video_id").agg(F.count("seq").alias("n_frames"), F.max("error").alias("error"))
    return raw.where("seq is not null").drop("error"), states


def detect_pointers(frames: DataFrame, make_provider) -> DataFrame:
    """Pointer readings of a provider: each frame with the one before it. An answer without status and, unless nothing was
    detected, a position, is an error."""

    def act(p, r):
        a = p.detect_pointer({k: v for k, v in r.items() if k != "before"}, r["before"])
        if a.get("status") not in contracts.POINTER_STATUS or (a["status"] != "not_detected" and (a.get("x") is None or a.get("y") is None)):
            raise ValueError(f"no pointer reading: {a}")
        yield {"video_id": r["video_id"], "seq": r["seq"], "ts": r["ts"], "status": a["status"], "x": a.get("x"), "y": a.get("y"), "confidence": float(a.get("confidence", 0.0)), "frame_width": r["width"], "frame_height": r["height"]}

    pairs = placed(frames, ("ts", "gray", "width", "height")).select(*frames.columns, "before")
    return each(pairs, make_provider, "video_id string, seq long, ts double, status string, x int, y int, confidence double, frame_width int, frame_height int", act, 16)


VISION = f"video_id string, seq long, ts double, status string, description string, visible_text array<string>, elements array<{ELEMENT}>, confidence double, model string"


def _asked(frames: DataFrame, segments: DataFrame | None, pointer: DataFrame | None) -> DataFrame:
    """Frames with the speech around each (_context) and the reading of its very time (_pointer; one that found nothing is none)."""
    own = frames.withColumn("_context", F.lit(None).cast("string")).withColumn("_pointer", F.lit(None).cast("struct<status:string,x:int,y:int,confidence:double>"))
    if segments is not None:
        near = text_around(frames.select("video_id", F.col("seq").alias("probe"), F.col("ts").alias("t")), segments, ("video_id", "probe"))
        own = own.drop("_context").join(near.select("video_id", F.col("probe").alias("seq"), F.col("said").alias("_context")), ["video_id", "seq"], "left")
    if pointer is not None:
        at = pointer_at(pointer).select("video_id", "ts", F.when(F.col("status") != "not_detected", F.struct("status", "x", "y", "confidence")).alias("_pointer"))
        own = own.drop("_pointer").join(at, ["video_id", "ts"], "left")
    return own


def _answers(asked: DataFrame, make_provider) -> DataFrame:
    def act(p, r):
        frame = {k: v for k, v in r.items() if not k.startswith("_")}
        yield {"video_id": r["video_id"], "seq": r["seq"], "ts": r["ts"], **vision_answer(p.analyze_frame(frame, r["_context"], r["_pointer"]))}

    return each(asked, make_provider, VISION, act)


def analyze_frames(frames: DataFrame, make_provider, segments: DataFrame | None = None, pointer: DataFrame | None = None) -> DataFrame:
    """Vision observations of a provider; its exceptions fail the job. With `segments` a frame comes with the speech around
    it, with `pointer` with the reading of its very time (of several the last), unless that found nothing."""
    return _answers(_asked(frames, segments, pointer), make_provider)


def pointer_at(pointer: DataFrame) -> DataFrame:
    """One reading per exact time: of several at one time the last (by seq)."""
    rest = [c for c in pointer.columns if c not in ("video_id", "ts")]
    return pointer.groupBy("video_id", "ts").agg(F.max_by(F.struct(*rest), "seq").alias("_p")).select("video_id", "ts", "_p.*")


PROMPT_VERSION = "1"
_KEPT = f"status string, description string, visible_text array<string>, elements array<{ELEMENT}>, confidence double, model string"


def vision_key(model: str) -> Column:
    """What an answer depends on, as a digest: the frame (its path, pixels and width), its time to the millisecond, the
    model, the version of the prompt, the speech and the pointer it comes with. A part that is missing differs from every value."""
    p = F.col("_pointer")
    parts = ["path", F.sha2("gray", 256), F.col("width").cast("string"), F.format_string("%.3f", "ts"), F.lit(model), F.lit(PROMPT_VERSION), F.coalesce("_context", F.lit("")),
             F.concat_ws(":", p.status, p.x.cast("string"), p.y.cast("string"), F.format_string("%.3f", p.confidence))]
    return F.sha2(F.to_json(F.array(*[F.col(x) if isinstance(x, str) else x for x in parts]), {"ignoreNullFields": "false"}), 256)


def _cache(spark, path: str) -> DataFrame | None:
    """The answers held at `path`, each key once; parts that cannot be read are not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    held = spark.read.schema(f"_key string, {_KEPT}").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    return held.where("_key is not null and status in ('ok', 'low_information')").groupBy("_key").agg(F.min_by(F.struct(*[c for c in held.columns if c != "_key"]), F.xxhash64(*held.columns)).alias("a")).select("_key", "a.*")


def analyze_cached(frames: DataFrame, cache: str, make_provider, model: str = "", segments: DataFrame | None = None, pointer: DataFrame | None = None) -> DataFrame:
    """analyze_frames through a table of earlier answers at `cache` (a folder all executors see), under vision_key(). Answers
    that say something are kept; a failure is not, nor is what cannot be read. A run writes one part, named by the keys it
    asked for: the same run again replaces its part, so nothing is kept twice."""
    spark = frames.sparkSession
    columns = [x.split(" ", 1)[0] for x in ("status x", "description x", "visible_text x", "elements x", "confidence x", "model x")]
    keyed = written(_asked(frames, segments, pointer).withColumn("_key", vision_key(model)), "vision-asked")
    held = _cache(spark, cache)
    lacking = keyed if held is None else keyed.join(held, "_key", "left_anti")
    once = lacking.groupBy("_key").agg(F.min(F.struct("video_id", "seq")).alias("f")).select("_key", "f.*")  # equal keys are one question
    fresh = _answers(lacking.join(once, ["_key", "video_id", "seq"]), make_provider).join(once, ["video_id", "seq"]).select("_key", *columns)
    fresh = written(fresh, "vision-fresh")
    every = fresh if held is None else fresh.unionByName(held.join(keyed.select("_key").distinct(), "_key", "left_semi"))
    out = written(keyed.select("video_id", "seq", "ts", "_key").join(every, "_key").drop("_key"), "vision")  # read before the table grows
    good = fresh.where("status in ('ok', 'low_information')")
    name = good.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("_key")), F.lit(0)).alias("x")).first()
    if name.n:
        good.write.mode("overwrite").parquet(f"{cache.rstrip('/')}/part-{name.n}-{name.x & (2**64 - 1):016x}")
    return out


def _box(raw) -> dict | None:
    """Four numbers that make a box inside the unit square, else nothing."""
    try:
        x1, y1, x2, y2 = map(float, raw)
    except (TypeError, ValueError):
        return None
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2} if 0 <= x1 < x2 <= 1 and 0 <= y1 < y2 <= 1 else None


def vision_answer(a: dict) -> dict:
    """A provider's answer, checked: it needs a description and a confidence in [0, 1]. An element's region that is no box
    is dropped and then claims no place; a box without a known label is approximate."""
    if not isinstance(a, dict) or "description" not in a or "confidence" not in a:
        raise ValueError("an answer needs description and confidence")
    confidence = float(a["confidence"])
    if not 0 <= confidence <= 1:
        raise ValueError(f"confidence {confidence} is outside [0, 1]")
    elements = []
    for e in a.get("elements") or []:
        region, said = _box(e.get("region")), e.get("region_confidence")
        sure = "unknown" if region is None else said if said in ("detected", "approximate") else "approximate"
        elements.append({"kind": str(e.get("kind", "unknown")), "description": str(e.get("description", "")), "region": region, "region_confidence": sure})
    return {"status": "low_information" if a.get("low_information") else "ok", "description": str(a["description"]), "visible_text": [str(t) for t in a.get("visible_text") or []],
            "elements": elements, "confidence": confidence, "model": str(a.get("model", ""))}


NATIVE_ROW = f"video_id string, ts double, status string, description string, elements array<{ELEMENT}>, confidence double, error string"


def analyze_videos(videos: DataFrame, make_provider) -> tuple[DataFrame, DataFrame]:
    """Answers of a provider that watches whole videos: (grounded observations, per video: kept, dropped, error).

    Any exception or an answer that is no sequence makes the stream unavailable for that video, named by its type alone,
    and never fails the job. Observations need a real time inside the video (a second of slack)."""

    def act(p, v):
        none = {"video_id": v["video_id"], "ts": None, "status": None, "description": None, "elements": None, "confidence": None, "error": None}
        try:
            told = p.analyze_video(v, None, 0.0, None, None)
            if not isinstance(told, list | tuple):
                raise TypeError(type(told).__name__)
        except Exception as e:  # outside code: its failure is a missing stream
            return [none | {"error": type(e).__name__}]
        rows = [none]
        for o in told:
            t = o.get("timestamp_sec") if isinstance(o, dict) else None
            real = isinstance(t, int | float) and not isinstance(t, bool)
            try:
                rows.append(none | {"ts": float(t) if real else float("nan"), **{k: x for k, x in vision_answer(o).items() if k in ("status", "description", "elements", "confidence")}})
            except (ValueError, TypeError, AttributeError):
                rows.append(none | {"ts": float("nan"), "status": "failed"})
        return rows

    raw = written(each(videos, make_provider, NATIVE_ROW, act, 1), "native")
    said = raw.where("status is not null")
    good = ground_native(said.where("status <> 'failed'"), videos).drop("error").withColumn("source", F.lit(NATIVE))
    n = said.groupBy("video_id").agg(F.count("*").alias("told")).join(good.groupBy("video_id").agg(F.count("*").alias("kept")), "video_id", "left")
    states = raw.groupBy("video_id").agg(F.max("error").alias("error")).join(n, "video_id", "left")
    kept = F.coalesce("kept", F.lit(0))
    return good, states.select("video_id", kept.alias("kept"), (F.coalesce("told", F.lit(0)) - kept).alias("dropped"), "error")


def ground_native(observations: DataFrame, videos: DataFrame) -> DataFrame:
    """Observations of a video provider inside their video (a second of slack), finite; others are dropped."""
    o = observations.join(videos.select("video_id", "duration_sec"), "video_id")
    return o.where("ts is not null and not isnan(ts) and ts >= 0 and ts <= duration_sec + 1.0D").drop("duration_sec")
