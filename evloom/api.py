"""Entry points: analyse evidence tables, build packages and sessions, ask for evidence, measure cursor motion."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.operators import correlate, folds, measure, package, pixels, session_store, synthesis, temporal
from evloom.session import written
from evloom.sources import media


@dataclass(frozen=True)
class Config:
    """Parameters of a run. Optional streams that are off give no evidence and are not listed as missing."""

    keyframe_interval_sec: float = 2.0
    keyframe_diff_threshold: float = measure.DEDUPE_MAD
    max_frames: int = 20
    pointer_enabled: bool = True
    pointer_step_sec: float = 0.2
    vision_enabled: bool = True
    video_understanding: bool = False
    visual_change_enabled: bool = False
    visual_change_interval_sec: float = 2.0
    visual_change_max_samples: int = 150
    cursor_intelligence_enabled: bool = False
    cursor_max_interval_sec: float = measure.MAX_INTERVAL_SEC
    tolerance_sec: float = 1.0
    max_visual_evidence: int | None = None
    session: bool = False
    generated_at: str = ""

    def configured(self) -> tuple[str, ...]:
        """The optional streams that were asked for."""
        asked = (("video_understanding", self.video_understanding), ("visual_change", self.visual_change_enabled), ("cursor_track", self.cursor_intelligence_enabled))
        return tuple(s for s, on in asked if on)

    def facts(self) -> dict:
        """What a session says about the run: numbers and booleans, no names, paths or providers."""
        kept = ("tolerance_sec", "keyframe_interval_sec", "max_frames", "pointer_enabled", "vision_enabled", "visual_change_enabled", "visual_change_interval_sec", "visual_change_max_samples", "cursor_intelligence_enabled", "video_understanding")
        return {k: getattr(self, k) for k in kept}

    def effective(self, **providers) -> dict:
        """What really ran: every value after defaults, and the class names of the providers that were handed in."""
        return asdict(self) | {"providers": {k: None if p is None else type(p).__name__ for k, p in providers.items()}}


def select_frames(candidates: DataFrame, config: Config = Config()) -> DataFrame:
    """Key frames of candidates (video_id, seq, ts, px: 8 x 8 thumbnails): near-duplicates of the last kept one go, and at
    most max_frames stay, evenly spread."""
    return measure.even_spread(folds.keyframe_dedupe(candidates, config.keyframe_diff_threshold), config.max_frames)


def change_grid(videos: DataFrame, last: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Sample times for visual changes: an even grid within the budget, with the last frame that can be read."""
    if not config.visual_change_interval_sec > 0 or config.visual_change_max_samples < 2:
        raise ValueError("the interval must be positive and the budget at least 2")
    return measure.sample_grid(videos, config.visual_change_interval_sec, config.visual_change_max_samples, last)


def measured_motion(evidence: DataFrame, config: Config = Config()) -> DataFrame:
    """The pointer rows of a run as cursor_track rows; a video with fewer than two readings gives none."""
    from evloom.functions import refs

    p = correlate.streams(evidence).where("kind = 'pointer'")
    many = p.groupBy("video_id").agg(F.count("*").alias("n")).where("n >= 2").select("video_id")
    s = measure.cursor_segments(p.join(many, "video_id", "left_semi"), config.cursor_max_interval_sec)
    return s.select("video_id", F.col("island").alias("seq"), F.col("start_sec").alias("ts"), F.lit("cursor_track").alias("kind"), refs.cursor_ref().alias("ref"), "confidence", F.col("end_sec").alias("end_ts"), F.lit("cursor_intelligence").alias("source"))


def run_streams(evidence: DataFrame, config: Config = Config()) -> DataFrame:
    """The stream rows that a configuration lets in: what is off is left out, and cursor movement is measured from the
    pointer rows where it was asked for, in videos that come without any."""
    s = correlate.streams(evidence)
    native = F.coalesce(F.col("source") == correlate.NATIVE, F.lit(False)) & (F.col("kind") == "vision")
    off = [~native if not config.video_understanding else None, (F.col("kind") != "vision") | native if not config.vision_enabled else None]
    off += [F.col("kind") != kind if not on else None for kind, on in (("pointer", config.pointer_enabled), ("visual_change", config.visual_change_enabled), ("cursor_track", config.cursor_intelligence_enabled))]
    for keep in off:
        s = s if keep is None else s.where(keep)
    if not config.cursor_intelligence_enabled:
        return s
    given = s.where("kind = 'cursor_track'").select("video_id").distinct()
    return s.unionByName(correlate.streams(measured_motion(s, config)).join(given, "video_id", "left_anti"))


def analyze(evidence: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """Structured observations of every query time; all evidence observed, flat; the whole change stream. All lazy."""
    streams = run_streams(evidence, config)
    structured = correlate.observe(streams, config.tolerance_sec, config.configured())
    return {"structured": structured, "evidence": correlate.flattened(structured), "visual_changes": correlate.change_stream(streams)}


def process(videos: DataFrame, segments: DataFrame, evidence: DataFrame, config: Config = Config(), answers: DataFrame | None = None, transcripts: DataFrame | None = None, images: DataFrame | None = None) -> dict[str, DataFrame]:
    """From evidence to knowledge: structured observations, brief items, prompts, checked package rows and, if asked for,
    sessions. `answers` (video_id, answer, error) are a synthesizer's to the prompts; without them packages say that no
    synthesis was run. `transcripts`: (video_id, transcript_status). `images` (pixels.image_facts): what is known of the
    frames' files; with it packages show the frames that they rest on, and `bundle` names the files to copy."""
    out = analyze(evidence, config)
    out["structured"] = written(out["structured"], "structured")  # every part below reads it
    out["evidence"] = correlate.flattened(out["structured"])
    spoken = segments if transcripts is None else segments.join(transcripts.where("transcript_status = 'ok'").select("video_id"), "video_id", "left_semi")
    brief = synthesis.brief_items(out["structured"], spoken)
    notes = synthesis.brief_notes(out["structured"])
    made = None if answers is None else synthesis.outputs(answers, brief, notes, videos)
    stream = out["visual_changes"] if config.visual_change_enabled else None
    rows = package.assemble(videos, segments, out["structured"], config.generated_at, stream, made, transcripts)
    if images is not None:
        rows, out["bundle"] = package.illustrated(rows, brief.where("kind = 'frame'"), images, correlate.descriptions(out["structured"]), config.max_visual_evidence)
    out |= {"brief": brief, "prompts": package.prompt(brief, notes, synthesis.missing_streams(out["structured"]), videos), "packages": package.checked(rows)}
    if config.session:
        out["sessions"] = session_store.build_sessions(videos, out["structured"], out["visual_changes"], segments, config.generated_at, config.facts(), transcripts=transcripts)
    return out


def _finite(**numbers) -> None:
    for name, x in numbers.items():
        if isinstance(x, bool) or not isinstance(x, int | float) or not abs(x) < float("inf"):
            raise ValueError(f"{name} must be a finite number")
        if x < 0:
            raise ValueError(f"{name} must not be negative")


def evidence_near(evidence: DataFrame, t: float, tolerance_sec: float, kinds=None, sources=None) -> DataFrame:
    """Evidence of every video around one time, in canonical order: points within the tolerance, spans that overlap it.
    The time is a constant, so this is a filter of the scan, not a join."""
    _finite(t=t, tolerance_sec=tolerance_sec)
    ev = temporal.select_evidence(evidence, kinds, sources)
    t, tol = float(t), float(tolerance_sec)
    point = F.col("end_ts").isNull() & (F.abs(F.col("ts") - t) <= tol)
    span = F.col("end_ts").isNotNull() & (F.col("ts") <= t + tol) & (F.col("end_ts") >= t - tol)
    rows = ev.where((F.col("ts") <= t + tol + 1) & (F.coalesce("end_ts", "ts") >= t - tol - 1)).where(point | span)  # the first for the scan, the second decides
    return temporal.canonical(rows.select("video_id", "ts", "kind", "ref", "confidence", "end_ts", "source"), ("video_id",))


def evidence_between(evidence: DataFrame, start_sec: float, end_sec: float, kinds=None, sources=None) -> DataFrame:
    """Evidence of every video in a closed window, in canonical order; a filter of the scan."""
    _finite(start_sec=start_sec, end_sec=end_sec)
    if end_sec < start_sec:
        raise ValueError("a window must not end before it starts")
    ev = temporal.select_evidence(evidence, kinds, sources).where((F.col("ts") <= float(end_sec)) & (F.coalesce("end_ts", "ts") >= float(start_sec)))
    return temporal.canonical(ev.select("video_id", "ts", "kind", "ref", "confidence", "end_ts", "source"), ("video_id",))


def track_pointer(frames: DataFrame) -> DataFrame:
    """Decoded frames -> pointer readings by three-frame differences, with frame sizes."""
    size = frames.select("video_id", "seq", F.col("width").alias("frame_width"), F.col("height").alias("frame_height"))
    return pixels.track_pointer(frames).join(size, ["video_id", "seq"])


def analyze_cursor_motion(frames: DataFrame, tracks: DataFrame | None = None, max_interval_sec: float = measure.MAX_INTERVAL_SEC) -> tuple[DataFrame, DataFrame]:
    """Decoded frames -> (every reading, movement segments that tile the tracks)."""
    readings = track_pointer(frames)
    return readings, measure.cursor_segments(readings, max_interval_sec, tracks)


def inspect(requests: DataFrame, frames: DataFrame, videos: DataFrame) -> DataFrame:
    """Targeted requests (video_id, request, timestamp_sec, window_before_sec, window_after_sec, fps, scale_width, region) and
    the frames that show them, with the pixel plan of each."""
    return media.inspect(requests, frames, videos)


def pointer_at(requests: DataFrame, frames: DataFrame, config: Config = Config()) -> DataFrame:
    """The pointer at each request (video_id, request, t), from the frames before, at and after it."""
    return pixels.pointer_around(requests, frames, config.pointer_step_sec)


def scenes(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """Decoded frames (bgr) -> (video_id, ts) where scenes start; 0.0 for a video without cuts."""
    return pixels.scene_starts(videos, pixels.scene_scores(frames))
