"""Measurements over ordered readings: cursor motion, frame change, thumbnails, grids and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.functions.scalars import py_round

from .ordered import placed, running
from .temporal import interval_join

# Fixed values of the measurements.
PIXEL_DIFF = 25
CHANGE_THRESHOLD = 0.08
MIN_DISPLACEMENT = 0.03
MIN_STRAIGHTNESS = 0.8
FULL_SUPPORT = 2
MAX_INTERVAL_SEC = 2.0
DEDUPE_MAD = 10.0


def _interval(a: str, b: str, max_interval: float) -> str:
    """SQL: why the stretch from reading a to reading b shows no movement, by the first reason that holds; else moving."""
    seen = "({0}.x is not null and {0}.y is not null and coalesce({0}.status, 'not_detected') <> 'not_detected' and {0}.frame_width > 0 and {0}.frame_height > 0)"
    return f"""case when {b}.ts <= {a}.ts then 'zero_elapsed_time' when {b}.ts - {a}.ts > {max_interval!r}D then 'sampling_gap'
      when not coalesce({seen.format(a)}, false) or not coalesce({seen.format(b)}, false) then 'pointer_not_observed'
      when {a}.status <> 'detected' or {b}.status <> 'detected' then 'ambiguous_position'
      when {a}.frame_width <> {b}.frame_width or {a}.frame_height <> {b}.frame_height then 'frame_size_changed'
      when {_way(a, b)} < {MIN_DISPLACEMENT!r}D then 'displacement_within_jitter' else 'moving' end"""


def _way(a: str, b: str) -> str:
    """SQL: distance of two readings in frame diagonals."""
    side = f"1.0D * {a}.frame_width * {a}.frame_width + 1.0D * {a}.frame_height * {a}.frame_height"
    return f"(sqrt(1.0D * ({b}.x - {a}.x) * ({b}.x - {a}.x) + 1.0D * ({b}.y - {a}.y) * ({b}.y - {a}.y)) / nullif(sqrt({side}), 0D))"


_READING = ("ts", "status", "x", "y", "frame_width", "frame_height", "confidence")


def cursor_intervals(readings: DataFrame, max_interval: float = MAX_INTERVAL_SEC) -> DataFrame:
    """Between each reading and the next: `basis` is moving or the first reason against it, in a fixed order; `was` is
    the basis of the interval before."""
    if not 0 < max_interval < float("inf"):
        raise ValueError("max_interval must be finite and positive")
    df = placed(readings, _READING).withColumn("a", F.struct(*_READING)).withColumnRenamed("after", "b")
    df = df.withColumn("was", F.when(F.col("before").isNotNull(), F.expr(_interval("before", "a", max_interval)))).where("b is not null")
    return df.select("video_id", "i", "seq", F.col("ts").alias("start_sec"), F.col("b.ts").alias("end_sec"), F.expr(_interval("a", "b", max_interval)).alias("basis"), "was", "a", "b", F.expr(_way("a", "b")).alias("step"))


def cursor_segments(readings: DataFrame, max_interval: float = MAX_INTERVAL_SEC, tracks: DataFrame | None = None) -> DataFrame:
    """Pointer readings as segments that tile each track: neighbouring intervals of one basis together.

    Moving ones carry speed (frame diagonals a second along the path), confidence (mean of the readings', less for a
    single interval) and, if the path is nearly straight, a heading. `tracks` (video_id, start_sec, end_sec) may reach
    beyond the readings: what lies outside them is not_sampled; fewer than two readings are one uncertain segment.
    Uncertain segments carry no direction, no speed and confidence 0."""
    iv = cursor_intervals(readings, max_interval).withColumn("new", F.expr("if(was <=> basis, 0, 1)"))
    iv = running(iv, "new", "island", order=("start_sec", "i"))
    g = iv.groupBy("video_id", "island").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.first("basis").alias("basis"), F.count("*").alias("intervals"), F.sum("step").alias("path"),
        F.min_by("a", "i").alias("a"), F.max_by("b", "i").alias("z"), F.sum("b.confidence").alias("sure"),
    )
    g = g.withColumn("moving", F.col("basis") == "moving").withColumn("net", F.expr(_way("a", "z")))
    straight = (F.col("net") >= MIN_DISPLACEMENT) & (F.col("net") / F.col("path") >= MIN_STRAIGHTNESS)
    heading = F.pmod(py_round(F.expr("pmod(degrees(atan2(cast(z.y - a.y as double), cast(z.x - a.x as double))), 360.0D)"), 1), F.lit(360.0))
    sure = (F.col("a.confidence") + F.col("sure")) / (F.col("intervals") + 1) * F.least(F.lit(1.0), F.col("intervals") / float(FULL_SUPPORT))
    g = g.select(
        "video_id", "island", "start_sec", "end_sec", "intervals", F.when(F.col("moving"), "moving").otherwise("uncertain").alias("motion_state"),
        F.when(F.col("moving") & straight, heading).alias("direction_deg"), F.when(F.col("moving"), py_round(F.col("path") / (F.col("end_sec") - F.col("start_sec")), 4)).alias("mean_speed_norm"),
        F.when(F.col("moving"), py_round(sure, 4)).otherwise(0.0).alias("confidence"),
        F.when(~F.col("moving"), F.col("basis")).when(straight, "consecutive_detections_displaced").otherwise("consecutive_detections_displaced_heading_varies").alias("basis"),
    )
    own = readings.groupBy("video_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    if tracks is not None:
        own = tracks.select("video_id", F.col("start_sec").alias("t0"), F.col("end_sec").alias("t1")).join(own, "video_id", "full")
    else:
        own = own.withColumn("t0", F.col("first")).withColumn("t1", F.col("last"))
    own = own.withColumn("t0", F.least("t0", "first")).withColumn("t1", F.greatest("t1", "last")).withColumn("n", F.coalesce("n", F.lit(0)))
    gap = "named_struct('island', {0}L, 'start_sec', {1}, 'end_sec', {2}, 'basis', '{3}')"
    few = f"case when n = 0 then array({gap.format(1, 't0', 't1', 'no_pointer_samples')}) when n = 1 then array({gap.format(1, 't0', 't1', 'too_few_samples')})"
    ends = f"array(if(t0 < first, {gap.format(0, 't0', 'first', 'not_sampled')}, null), if(last < t1, {gap.format(2**62, 'last', 't1', 'not_sampled')}, null))"
    rest = own.select("video_id", F.explode(F.expr(f"{few} else {ends} end")).alias("e")).where("e is not null")
    rest = rest.select("video_id", "e.island", "e.start_sec", "e.end_sec", F.lit(0).cast("long").alias("intervals"), F.lit("uncertain").alias("motion_state"),
                       F.lit(None).cast("double").alias("direction_deg"), F.lit(None).cast("double").alias("mean_speed_norm"), F.lit(0.0).alias("confidence"), "e.basis")
    return g.unionByName(rest)


def thumbnail_mad(a: str, b: str) -> str:
    """SQL: mean absolute difference of two equally long arrays."""
    return f"aggregate(zip_with({a}, {b}, (p, q) -> abs(p - q)), 0D, (s, v) -> s + v) / size({a})"


def changed_share(a: str, b: str, above: float) -> str:
    """SQL: share of positions whose values differ by more than `above`."""
    return f"aggregate(zip_with({a}, {b}, (p, q) -> if(abs(p - q) > {above!r}D, 1, 0)), 0, (s, v) -> s + v) / cast(size({a}) as double)"


def check_threshold(threshold: float) -> None:
    if isinstance(threshold, bool) or not 0 < threshold <= 1:
        raise ValueError(f"a threshold lies in (0, 1], not {threshold}")


def frame_changes(frames: DataFrame, above: float = PIXEL_DIFF, threshold: float = CHANGE_THRESHOLD) -> DataFrame:
    """Each frame against the one before: magnitude (null: unavailable), status, confidence. A `seq` that runs against
    the time is an error where it is read: a sequence is not sorted silently."""
    check_threshold(threshold)
    df = placed(frames, ("ts", "px", "seq")).withColumnRenamed("before", "prev").where("prev is not null")
    late = F.raise_error(F.format_string("%s: frame %d follows frame %d", F.col("video_id"), F.col("seq"), F.col("prev.seq")))
    df = df.withColumn("seq", F.when(F.col("seq") < F.col("prev.seq"), late.cast("long")).otherwise(F.col("seq")))
    ok = "px is not null and prev.px is not null and size(px) = size(prev.px)"
    df = df.withColumn("magnitude", F.expr(f"case when {ok} then {changed_share('px', 'prev.px', above)} end"))
    df = df.withColumn("status", F.expr(f"case when magnitude is null then 'unavailable' when magnitude >= {threshold!r}D then 'detected' else 'not_detected' end"))
    conf = F.expr(f"case when magnitude is not null then least(1.0D, abs(magnitude - {threshold!r}D) / {threshold!r}D) end")
    return df.select("video_id", "seq", F.col("prev.ts").alias("earlier"), F.col("ts").alias("later"), "magnitude", "status", conf.alias("confidence"))


def even_spread(items: DataFrame, limit: int, per: str = "video_id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """At most `limit` items per group, evenly spread, first and last included (limit 1: the first)."""
    df = placed(items, (order[0],), (per,), order).drop("before", "after")
    if limit <= 1:
        return df.where(f"i < {limit}").drop("i")
    df = df.join(items.groupBy(per).agg(F.count("*").alias("n")), per)
    # position j of `limit` takes index round-half-up(j (n - 1) / (limit - 1)); an index is taken if some j gives it
    at = f"(2 * {{j}} * (n - 1) + {limit - 1}) div {2 * (limit - 1)}"
    j = f"((2 * i - 1) * {limit - 1} + 2 * (n - 1) - 1) div (2 * (n - 1))"
    hit = " or ".join(f"({at.format(j=f'greatest(0, {j} + {d})')} = i and {j} + {d} < {limit})" for d in (-1, 0, 1))
    return df.where(f"n <= {limit} or {hit}").drop("i", "n")


def keyframe_times(scenes: DataFrame, videos: DataFrame, interval: float) -> DataFrame:
    """Where to look for key frames: scene starts (video_id, ts), every `interval` seconds of the video, and zero; `pos` in order."""
    grid = videos.select("video_id", F.explode(F.expr(f"transform(sequence(0, cast(duration / {interval!r}D as int)), i -> i * {interval!r}D)")).alias("ts"))
    every = scenes.select("video_id", "ts").unionAll(grid).unionAll(videos.select("video_id", F.lit(0.0))).distinct()
    return placed(every, ("ts",), order=("ts",)).select("video_id", "ts", F.col("i").alias("pos"))


def segment_times(segments: DataFrame, scenes: DataFrame, interval: float = 1.0) -> DataFrame:
    """Where to look for frames of a segment: its start, middle and end, every `interval` seconds from its start, and the
    scene starts inside it (both ends included), each time once; `scene` where it is, to the millisecond, a scene start."""
    if not interval > 0:
        raise ValueError("interval must be positive")
    own = segments.where("end_sec > start_sec").select("video_id", "seg_no", "start_sec", "end_sec")
    steps = f"transform(sequence(0, cast((end_sec - start_sec) / {interval!r}D + 1e-9D as int)), i -> start_sec + i * {interval!r}D)"
    grid = own.select("video_id", "seg_no", F.explode(F.expr(f"concat(array(start_sec, (start_sec + end_sec) / 2, end_sec), {steps})")).alias("ts"))
    cuts = scenes.select("video_id", F.col("ts").alias("scene"), F.col("ts").alias("_end"))
    inside = interval_join(own.withColumnsRenamed({"start_sec": "lo", "end_sec": "hi"}), cuts, 20.0, start="scene", end="_end").select("video_id", "seg_no", "scene")
    every = grid.unionAll(inside).distinct()
    at = inside.select("video_id", "seg_no", py_round("scene", 3).alias("_ms")).distinct().withColumn("_s", F.lit(True))
    return every.withColumn("_ms", py_round("ts", 3)).join(at, ["video_id", "seg_no", "_ms"], "left").select("video_id", "seg_no", "ts", F.coalesce("_s", F.lit(False)).alias("scene"))


def track_summary(readings: DataFrame) -> DataFrame:
    """Per video the range of its pointer track and the share of readings that are detected."""
    return readings.groupBy("video_id").agg(
        F.min("ts").alias("start_sec"), F.max("ts").alias("end_sec"), F.count("*").alias("readings"), F.avg(F.when(F.col("status") == "detected", 1.0).otherwise(0.0)).alias("confidence")
    )


def sample_grid(videos: DataFrame, interval: float, most: int, last: DataFrame | None = None) -> DataFrame:
    """videos (video_id, duration) -> sample times 0, step, ... up to the duration; the step widens to keep to `most`.
    With `last` (video_id, ts: the last frame that can be read) that frame is added where the grid ends before it."""
    if not (interval > 0 and most > 0):
        raise ValueError("interval and budget must be positive")
    df = videos.withColumn("step", F.expr(f"greatest({interval!r}D, duration / greatest(1, {most} - 2))"))
    df = df.withColumn("n", F.expr("cast(duration / step + 1e-9D as int)")).withColumn("t", F.expr("transform(sequence(0, n), i -> i * step)"))
    if last is not None:
        df = df.join(last.select("video_id", F.col("ts").alias("_l")), "video_id", "left").withColumn("t", F.expr("filter(t, x -> _l is null or x <= _l)"))
        df = df.withColumn("t", F.expr("if(_l > coalesce(array_max(t), -1D), array_append(t, _l), t)"))
    return df.select("video_id", "duration", F.posexplode("t").alias("i", "ts"))


def clamp_segments(segments: DataFrame, duration: str = "duration") -> DataFrame:
    """Segments inside [0, duration]; those that start at or behind it, or end up empty, go. Words (if there are any) are
    clipped alike, and none left is null. Only what was clipped is rounded, to the millisecond."""
    ms = lambda new, old: F.when(F.col(new) == F.col(old), F.col(old)).otherwise(py_round(new, 3))
    df = segments.withColumn("_a", F.greatest(F.lit(0.0), "start_sec")).withColumn("_b", F.least("end_sec", duration)).where(f"_a < {duration} and _b > _a")
    if "words" in df.columns:
        inner = f"filter(transform(words, w -> struct(w.text as text, greatest(0.0D, w.start_sec) as start_sec, least(w.end_sec, {duration}) as end_sec)), w -> w.start_sec < {duration} and w.end_sec > w.start_sec)"
        kept = F.expr(inner)
        df = df.withColumn("words", F.when(F.size(kept) > 0, F.when(F.col("words") == kept, F.col("words")).otherwise(F.transform(kept, lambda w: F.struct(w.text.alias("text"), py_round(w.start_sec, 3).alias("start_sec"), py_round(w.end_sec, 3).alias("end_sec"))))))
    return df.withColumn("start_sec", ms("_a", "start_sec")).withColumn("end_sec", ms("_b", "end_sec")).drop("_a", "_b")


def anchor_tolerance(frames: DataFrame, floor: float = 1.0) -> DataFrame:
    """Per video half the upper median gap between neighbouring frame times (equal times are a gap of 0), at least `floor`."""
    gaps = placed(frames.select("video_id", "ts", "seq"), ("ts",)).withColumn("gap", F.col("ts") - F.col("before.ts"))
    many = gaps.groupBy("video_id", "gap").agg(F.count("gap").alias("c"))  # gaps repeat: their counts are few
    g = many.groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("c") > 0, F.struct("gap", "c")))).alias("g"), F.sum("c").alias("n"))
    upper = "aggregate(g, named_struct('left', n div 2, 'gap', cast(null as double)), (s, x) -> if(s.gap is not null, s, if(s.left < x.c, named_struct('left', s.left, 'gap', x.gap), named_struct('left', s.left - x.c, 'gap', s.gap)))).gap"
    return g.select("video_id", F.expr(f"greatest({floor!r}D, coalesce({upper} / 2, {floor!r}D))").alias("tolerance"))
