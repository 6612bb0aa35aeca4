"""Knowledge from evidence: topics, cue lessons, coverage, demand, package rows, their checks and files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evloom.functions.scalars import EMBEDDED_MEDIA, py_strip

from .folds import first_seen

# Cue phrases by kind (checked in this order), words that are no topics, stages, limits.
CUES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("warning", ("warning", "be careful", "watch out", "don't ", "do not ", "never ", "avoid ")),
    ("procedure", ("step ", "first, ", "then, ", "next, ", "you need to", "make sure to", "how to ")),
    ("definition", ("is defined as", "means that", "refers to", "in other words", "is called")),
    ("example", ("for example", "for instance", "such as", "like this")),
    ("conclusion", ("in summary", "to summarize", "the key takeaway", "in conclusion", "the point is")),
    ("explanation", ("because ", "this is why", "the reason", "so that ")),
)
STOPWORDS = (
    "the a an is are was were be been being to of and or but in on at for with "
    "by from as this that these those it its it's you your i we they he she "
    "what when where why how not no do does did can could will would should "
    "just so if then than very really about into over under again more most"
).split()
STAGES = ("transcript", "frame", "pointer", "vision")
OPTIONAL_STAGES = ("visual_change", "cursor_track")
MAX_LESSONS, MAX_TOPICS, MIN_TOPIC_LEN, MIN_TOPIC_COUNT, MAX_REF = 15, 8, 4, 2, 400
LESSON_CONFIDENCE = 0.4
TOPIC_WORD = "[A-Za-z][A-Za-z'-]+"


def topics(texts: DataFrame, per: tuple[str, ...] = (), order: str = "seq", text: str = "text") -> DataFrame:
    """The most frequent words (topic, n, pos) of all texts or of each group: of the 16 most frequent, ties by first
    appearance, those with at least two occurrences, eight at most."""
    words = texts.select(*per, F.col(order).alias("_o"), F.posexplode(F.regexp_extract_all(text, F.lit(TOPIC_WORD), F.lit(0))).alias("p", "w"))
    words = words.where(F.length("w") >= MIN_TOPIC_LEN).withColumn("w", F.lower("w")).where(~F.col("w").isin(STOPWORDS))
    count = words.groupBy(*per, "w").agg(F.count("*").alias("n"), F.min(F.struct("_o", "p")).alias("first"))
    if per:
        rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("n"), "first"))
        top = count.withColumn("_r", rank).where(f"_r <= {2 * MAX_TOPICS}")
    else:
        top = count.orderBy(F.desc("n"), "first").limit(2 * MAX_TOPICS)
    pos = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("n"), "first")).cast("long") - 1
    top = top.where(F.col("n") >= MIN_TOPIC_COUNT).withColumn("pos", pos).where(F.col("pos") < MAX_TOPICS)
    return top.select(*per, F.expr("concat(upper(left(w, 1)), substring(w, 2))").alias("topic"), "n", "pos")


def cue_kind(text: str, cues=CUES):
    """The first kind of which a phrase occurs in the lower-case text; null without one."""
    low = F.lower(F.col(text))
    out = F.lit(None).cast("string")
    for kind, phrases in reversed(list(cues)):
        any_ = F.lit(False)
        for p in phrases:
            any_ = any_ | low.contains(p)
        out = F.when(any_, F.lit(kind)).otherwise(out)
    return out


def lessons(segments: DataFrame, cues=CUES, most: int = MAX_LESSONS) -> DataFrame:
    """Segments that hold a cue: distinct stripped texts, the first `most` of each video."""
    s = segments.withColumn("text", py_strip("text")).where("text <> ''").withColumn("said_confidence", F.col("confidence") if "confidence" in segments.columns else F.lit(None).cast("double"))
    s = s.withColumn("kind", cue_kind("text", cues)).where("kind is not null").select("video_id", "seg_no", "start_sec", "text", "kind", "said_confidence")
    return first_seen(s, "text", "video_id", ("seg_no",), most).withColumn("confidence", F.lit(LESSON_CONFIDENCE))


def coverage(evidence: DataFrame, videos: DataFrame, configured: tuple[str, ...] = ()) -> DataFrame:
    """Stages with and without evidence per video, sorted; an optional stage counts only if configured."""
    seen = evidence.groupBy("video_id").agg(F.array_sort(F.collect_set("kind")).alias("available"))
    expected = F.array(*[F.lit(s) for s in sorted((*STAGES, *(s for s in configured if s in OPTIONAL_STAGES)))])
    none = F.expr("cast(array() as array<string>)")
    out = videos.join(seen, "video_id", "left").withColumn("available", F.coalesce("available", none))
    return out.withColumn("unavailable", F.array_sort(F.array_except(expected, "available")))


def collect_kind(evidence: DataFrame, kind: str) -> DataFrame:
    """Distinct measurements of a kind in time order; of copies that differ in confidence only the first (`prio`, seq) stays."""
    key = ["video_id", "ts", "end_ts", "ref", "source"]
    order = ["prio", *(["t"] if "t" in evidence.columns else []), "seq"]
    first = evidence.where(F.col("kind") == kind).groupBy(*key).agg(F.min_by(F.struct("confidence", "seq"), F.struct(*order)).alias("f"))
    pos = F.row_number().over(Window.partitionBy("video_id").orderBy("ts", F.coalesce("end_ts", F.lit(0.0)), "f.seq")).cast("long") - 1
    return first.select(*key, "f.confidence", "f.seq", pos.alias("pos"))


def cited_once(cited: DataFrame, digits: int | None = None) -> DataFrame:
    """First citation of each (ts, kind, ref, source) in citation order."""
    ts = F.col("ts") if digits is None else F.round("ts", digits)
    w = Window.partitionBy("video_id", ts, "kind", "ref", "source").orderBy("ord")
    return cited.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def demand(wants: DataFrame) -> DataFrame:
    """wants (video_id, frame_id, ts, confidence, reason, ord) -> per frame: refs, best confidence, first reason; ranked by
    refs, confidence, time, then the id as text."""
    d = wants.groupBy("video_id", "frame_id").agg(F.count("*").alias("refs"), F.max("confidence").alias("confidence"), F.min_by("reason", "ord").alias("reason"), F.min("ts").alias("ts"))
    rank = Window.partitionBy("video_id").orderBy(F.desc("refs"), F.desc("confidence"), "ts", F.col("frame_id").cast("string"))
    return d.withColumn("rank", F.row_number().over(rank).cast("long"))


def dangling(refs: DataFrame, known: DataFrame, ref: str, on: str) -> DataFrame:
    """refs whose `ref` is no `on` of `known`."""
    return refs.join(known.select(F.col(on).alias(ref)).distinct(), ref, "left_anti")


# rule -> SQL that holds for a good package row; the order is the order of reports
PACKAGE_RULES: dict[str, str] = {
    "no source reference": "length(trim(coalesce(source, ''))) > 0",
    "invalid duration": "coalesce(duration_sec > 0, false)",
    "empty summary": "length(regexp_replace(coalesce(summary, ''), '(?U)\\\\s', '')) > 0",
    "no generated_at": "length(coalesce(generated_at, '')) > 0",
    "no schema version": "length(coalesce(schema_version, '')) > 0",
    "timestamp outside duration": "forall(timestamps, t -> t >= 0 and t <= duration_sec + 1.0D)",
    "dangling visual evidence": "size(array_except(claim_visuals, visual_ids)) = 0",
    "visual path not relative": "forall(visual_paths, p -> not startswith(p, '/') and not startswith(p, '..') and not contains(p, ':'))",
    "visual outside duration": "forall(visual_times, t -> t >= 0 and t <= duration_sec + 1.0D)",
    "measurement of another kind": "forall(measurements, m -> m.kind = m.want)",
    "measurement outside duration": "forall(measurements, m -> m.ts >= 0 and m.ts <= duration_sec + 1.0D)",
    "excerpt too long": f"forall(refs, r -> r.kind = 'frame' or length(r.ref) <= {MAX_REF})",
    "embedded media": f"not rlike(coalesce(semantic_summary, ''), '{EMBEDDED_MEDIA}') and forall(claim_texts, t -> not rlike(t, '{EMBEDDED_MEDIA}'))",
    "contradictory stages": "size(array_intersect(cited_kinds, stages_unavailable)) = 0",
}


def validate_packages(packages: DataFrame) -> DataFrame:
    """packages with `violation`: the first broken rule, or null."""
    out = F.lit(None).cast("string")
    for rule, sql in reversed(list(PACKAGE_RULES.items())):
        out = F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(rule)).otherwise(out)
    return packages.withColumn("violation", out)


def export_package(package: dict, path: str) -> str:
    """One package as JSON: written beside its place and moved there, so readers never see a part."""
    text = json.dumps(package, indent=2, ensure_ascii=False, allow_nan=False)
    tmp = f"{path}.tmp"
    try:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(tmp, path)
    finally:
        if os.path.exists(tmp):
            os.remove(tmp)
    return path


def render_markdown(package: dict) -> str:
    """A package for readers. Every part is a heading and its lines; parts without lines are left out."""
    src, run, syn = package["source"], package["processing"], package.get("synthesis") or {}
    at = lambda p: f"{p['timestamp_sec']:.1f}" + (f"-{p['timestamp_end_sec']:.1f}s" if p.get("timestamp_end_sec") is not None else "s")
    images = {x["claim"]: x["images"] for x in package.get("claim_images") or []}
    shown = lambda i: f" [visual: {', '.join(images[i])}]" if images.get(i) else ""
    counted = f" (provider: {syn.get('provider')}, {syn.get('claims_retained')} retained / {syn.get('claims_rejected')} rejected)" if syn.get("status") == "ok" else ""
    parts = {
        "Summary": [package["summary"]], "Whole-video summary (semantic synthesis)": [package.get("semantic_summary")],
        "Verified claims": [f"- **[{c['kind']}/{c['status']}]** ({at(c)}, confidence {c['confidence']:.2f}) {c['text']}{shown(i)}" for i, c in enumerate(package.get("claims") or [])],
        "Visual evidence": [f"- `{v['evidence_id']}` ({v['timestamp_sec']:.1f}s) `{v['image_path']}` -- {v['selection_reason']}" for v in package.get("visual_evidence") or []],
        "Topics": [", ".join(package.get("topics") or [])], "Key lessons": [f"- **[{p['kind']}]** ({p['timestamp_sec']:.1f}s) {p['text']}" for p in package.get("key_lessons") or []],
        "Important observations": [f"- ({p['timestamp_sec']:.1f}s, confidence {p['confidence']:.2f}) {p['text']}" for p in package.get("important_observations") or []],
        "Limitations": [f"- {x}" for x in package.get("limitations") or []],
        "Processing": [f"- Evidence streams available: {', '.join(run['stages_available']) or 'none'}", f"- Evidence streams unavailable: {', '.join(run['stages_unavailable']) or 'none'}", f"- Frames referenced: {run['frame_count']}",
                       f"- Transcript status: {run['transcript_status']}", f"- Semantic synthesis: {syn.get('status', 'unavailable')}{counted}", f"- Engine version: {run['engine_version']}"],
    }
    head = [f"# {src.get('title') or src['source']}", "", f"- **Source**: {src['source_type']} -- `{src['source']}`", f"- **Duration**: {src['duration_sec']:.1f}s", f"- **Generated**: {run['generated_at']}"]
    for title, lines in parts.items():
        if lines := [x for x in lines if x]:
            head += ["", f"## {title}", "", *lines]
    return "\n".join(head) + "\n"
