"""Evidence sessions: one durable JSON document per video, written deterministically, read strictly.

The format is declared once, as data (FORMAT): every object's required and optional fields with
their checks. Reading reports the first place that breaks it; nothing is accepted in part.
"""

from __future__ import annotations

import json
import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.functions.scalars import base_name, public_url, session_filename
from evloom.session import ship

from . import correlate
from .contracts import EVIDENCE_KINDS
from .temporal import canonical

FORMAT_VERSION, MAX_BYTES, SUFFIX = 1, 64 * 1024 * 1024, ".session.json"


class SessionError(ValueError):
    """A session that cannot be read or written as one."""


def _number(v) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v)


CHECKS = {
    "text": ("must be a string", lambda v: isinstance(v, str)),
    "text?": ("must be a string or null", lambda v: v is None or isinstance(v, str)),
    "time": ("must be a finite number, not negative", lambda v: _number(v) and v >= 0),
    "time?": ("must be a finite number, not negative, or null", lambda v: v is None or (_number(v) and v >= 0)),
    "number?": ("must be a finite number or null", lambda v: v is None or _number(v)),
    "unit?": ("must be in [0, 1] or null", lambda v: v is None or (_number(v) and 0 <= v <= 1)),
    "bool": ("must be a boolean", lambda v: isinstance(v, bool)),
    "kind": ("is no evidence kind", lambda v: v in EVIDENCE_KINDS),
    "source_type": ("must be local or url", lambda v: v in ("local", "url")),
    "facts": ("must map strings to booleans, finite numbers or strings", lambda v: isinstance(v, dict) and all(isinstance(x, bool | str) or _number(x) for x in v.values())),
    "status": ("must be ok, no_audio or no_speech", lambda v: v in ("ok", "no_audio", "no_speech")),
}

# object -> field -> (check, [check] for a list, object name, or object name? if null may stand); a leading ~ marks optional fields
FORMAT: dict[str, dict[str, object]] = {
    "session": {"format_version": None, "created_at": "text", "engine_version": "text", "source": "@source", "video": "@video", "evidence": ["@evidence"], "~analysis": "facts", "~transcript": "@transcript?", "~windows": ["@window"]},
    "source": {"source_type": "source_type", "source": "text", "duration_sec": "time", "~title": "text?"},
    "video": {"width": "time", "height": "time", "fps": "time", "has_audio": "bool"},
    "evidence": {"timestamp_sec": "time", "kind": "kind", "ref": "text", "~confidence": "unit?", "~timestamp_end_sec": "time?", "~source": "text"},
    "window": {"timestamp_sec": "time", "tolerance_sec": "time", "~unavailable": ["text"]},
    "transcript": {"segments": ["@segment"], "~language": "text?", "~source": "text", "~duration_sec": "time?", "~status": "status"},
    "segment": {"start_sec": "time", "end_sec": "time", "text": "text", "~confidence": "number?", "~words": ["@word"]},
    "word": {"text": "text", "start_sec": "time", "end_sec": "time"},
}


def _check(value, want, where: str) -> None:
    if want is None:
        return
    if isinstance(want, list):
        if value is None and where.endswith(".words"):
            return
        if not isinstance(value, list):
            raise SessionError(f"{where} must be a list")
        for i, v in enumerate(value):
            _check(v, want[0], f"{where}[{i}]")
    elif want.startswith("@"):
        if want.endswith("?") and value is None:
            return
        fields = FORMAT[want.strip("@?")]
        if not isinstance(value, dict):
            raise SessionError(f"{where} must be an object")
        names = {f.lstrip("~"): w for f, w in fields.items()}
        if missing := [f for f in fields if not f.startswith("~") and f not in value]:
            raise SessionError(f"{where} lacks {', '.join(missing)}")
        if unknown := sorted(set(value) - set(names)):
            raise SessionError(f"{where} has unknown {', '.join(unknown)}")
        for f, v in value.items():
            _check(v, names[f], f"{where}.{f}")
        for a, b in (("timestamp_sec", "timestamp_end_sec"), ("start_sec", "end_sec")):
            if a in value and value.get(b) is not None and value[b] < value[a]:
                raise SessionError(f"{where} ends before it starts")
    else:
        said, holds = CHECKS[want]
        if not holds(value):
            raise SessionError(f"{where} {said}")


def parse_session(text: str) -> dict:
    """The document of a session file, checked against FORMAT; defaults filled in, windows and evidence canonical."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise SessionError(f"no JSON: {e}") from e
    version = doc.get("format_version") if isinstance(doc, dict) else None
    if isinstance(doc, dict) and (isinstance(version, bool) or version != FORMAT_VERSION):
        raise SessionError(f"unsupported format version {version!r}")
    _check(doc, "@session", "session")
    evidence = [{"confidence": None, "timestamp_end_sec": None, "source": "", **e} for e in doc["evidence"]]
    order = lambda e: (e["timestamp_sec"], e["timestamp_sec"] if e["timestamp_end_sec"] is None else e["timestamp_end_sec"], e["kind"], e["source"], e["ref"], -1.0 if e["confidence"] is None else e["confidence"])
    once = {json.dumps(e, sort_keys=True): e for e in sorted(evidence, key=order)}
    windows = sorted(({"unavailable": [], **w} for w in doc.get("windows", [])), key=lambda w: (w["timestamp_sec"], w["tolerance_sec"]))
    return {"analysis": {}, "transcript": None, **doc, "windows": windows, "evidence": list(once.values())}


def session_json(doc: dict) -> str:
    """The same session gives the same bytes: sorted keys, no NaN, text kept readable."""
    try:
        return json.dumps(doc, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"
    except (TypeError, ValueError) as e:
        raise SessionError(f"not JSON-safe: {e}") from e


def save_session(doc: dict, path: str, overwrite: bool = False) -> str:
    """Write beside the target, then move there; an existing file stays unless `overwrite`."""
    text = session_json(doc)
    if os.path.exists(path) and not overwrite:
        raise SessionError(f"{path} exists")
    try:
        with open(f"{path}.tmp", "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(f"{path}.tmp", path)
    finally:
        if os.path.exists(f"{path}.tmp"):
            os.remove(f"{path}.tmp")
    return path


def read_sessions(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(evidence rows, errors) of all session files under a path that Spark can read."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "length", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))
    schema = "path string, ts double, kind string, ref string, confidence double, end_ts double, source string, error string"
    kinds = pa.schema([("path", pa.string()), ("ts", pa.float64()), ("kind", pa.string()), ("ref", pa.string()), ("confidence", pa.float64()), ("end_ts", pa.float64()), ("source", pa.string()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    if raw is None:
                        raise SessionError(f"over {MAX_BYTES} bytes")
                    doc = parse_session(raw.decode("utf-8"))
                    rows += [
                        {"path": p, "ts": float(e["timestamp_sec"]), "kind": e["kind"], "ref": e["ref"], "confidence": e["confidence"], "end_ts": e["timestamp_end_sec"], "source": e["source"], "error": None}
                        for e in doc["evidence"]
                    ]
                except (SessionError, UnicodeDecodeError) as e:
                    rows.append({"path": p, "ts": None, "kind": None, "ref": None, "confidence": None, "end_ts": None, "source": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    rows = files.mapInArrow(run, schema)
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")


def session_evidence(observed: DataFrame, changes: DataFrame, segments: DataFrame | None) -> DataFrame:
    """What a session keeps per video: observations (frames by file name only), the whole change stream, and speech
    from the transcript as spans where there is one; canonical order, copies once."""
    cols = ["video_id", "ts", "kind", "ref", "confidence", "end_ts", "source"]
    seen = observed.withColumn("ref", F.when(F.col("kind") == "frame", base_name("ref")).otherwise(F.col("ref")))
    if segments is not None:
        seen = seen.where("kind <> 'transcript'")
        said = segments.where(F.length(F.regexp_replace("text", r"(?U)\s", "")) > 0)
        sure = F.col("confidence") if "confidence" in segments.columns else F.lit(None).cast("double")
        said = said.select("video_id", F.col("start_sec").alias("ts"), F.lit("transcript").alias("kind"), F.col("text").alias("ref"), sure.alias("confidence"), F.col("end_sec").alias("end_ts"), F.lit("").alias("source"))
        seen = seen.select(*cols).unionByName(said)
    return canonical(seen.select(*cols).unionByName(changes.select(*cols)), ("video_id",))


def build_sessions(videos: DataFrame, structured: DataFrame, changes: DataFrame, segments: DataFrame | None, created_at: str, analysis: dict, engine_version: str = "1.0.0", transcripts: DataFrame | None = None) -> DataFrame:
    """(video_id, name, document): the session of each video as its JSON text, and its file's name.

    videos: video_id, source, source_type, duration_sec, title, width, height, fps, has_audio. Kept are observations,
    windows with what they lacked, the transcript and the run's facts; no inferences, conclusions, media or tokens."""
    ship(videos.sparkSession)
    ev = session_evidence(correlate.flattened(structured), changes, segments)
    ev = ev.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ts", "kind", "ref", "confidence", "end_ts", "source"))).alias("evidence"))
    win = structured.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t", "tolerance_sec", "unavailable"))).alias("windows"))
    v = public_source(videos).join(ev, "video_id", "left").join(win, "video_id", "left")
    if segments is not None:
        seg = segments.select("video_id", F.struct("seg_no", "start_sec", "end_sec", "text", (F.col("confidence") if "confidence" in segments.columns else F.lit(None).cast("double")).alias("confidence")).alias("s"))
        v = v.join(seg.groupBy("video_id").agg(F.array_sort(F.collect_list("s")).alias("segments")), "video_id", "left")
    else:
        v = v.withColumn("segments", F.lit(None).cast("array<struct<seg_no:bigint,start_sec:double,end_sec:double,text:string,confidence:double>>"))
    if transcripts is not None:
        v = v.join(transcripts.select("video_id", F.col("transcript_status").alias("state")), "video_id", "left")
    else:
        v = v.withColumn("state", F.lit(None).cast("string"))
    stem = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.regexp_replace(base_name("source"), r"(?<=.)\.[^.]*$", ""))
    v = v.withColumn("name", session_filename(stem, "source"))
    facts = dict(sorted(analysis.items()))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                spoken = None
                if r["segments"] is not None or r["state"] is not None:
                    said = [{"start_sec": x["start_sec"], "end_sec": x["end_sec"], "text": x["text"], "confidence": x["confidence"], "words": None} for x in r["segments"] or []]
                    spoken = {"segments": said, "language": None, "source": "unknown", "duration_sec": r["duration_sec"], "status": r["state"] or "ok"}
                doc = {
                    "format_version": FORMAT_VERSION, "created_at": created_at, "engine_version": engine_version, "analysis": facts, "transcript": spoken,
                    "source": {k: r[k] for k in ("source_type", "source", "duration_sec", "title")}, "video": {k: r[k] for k in ("width", "height", "fps", "has_audio")},
                    "evidence": [{"timestamp_sec": e["ts"], "kind": e["kind"], "ref": e["ref"], "confidence": e["confidence"], "timestamp_end_sec": e["end_ts"], "source": e["source"]} for e in r["evidence"] or []],
                    "windows": [{"timestamp_sec": w["t"], "tolerance_sec": w["tolerance_sec"], "unavailable": w["unavailable"]} for w in r["windows"] or []],
                }
                out.append({"video_id": r["video_id"], "name": r["name"], "document": session_json(doc)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("video_id", pa.string()), ("name", pa.string()), ("document", pa.string())]))

    cols = ["video_id", "name", "source_type", "source", "duration_sec", "title", "width", "height", "fps", "has_audio", "evidence", "windows", "segments", "state"]
    return v.select(*cols).mapInArrow(run, "video_id string, name string, document string")


def public_source(sources: DataFrame) -> DataFrame:
    """sources (source_type, source) as they may be stored: urls without credentials, tokens and fragments."""
    return sources.withColumn("source", F.when(F.col("source_type") == "url", public_url("source")).otherwise(F.col("source")))
