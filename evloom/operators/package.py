"""Knowledge packages as one nested row per video, prompts for synthesizers, images for claims."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evloom.functions.scalars import base_name, filename_stem, fixed
from evloom.session import settled, written

from . import correlate, knowledge
from .correlate import EVIDENCE
from .synthesis import CLAIM, METADATA

SCHEMA_VERSION, ENGINE_VERSION = "1.2", "1.0.0"
VISION_EPSILON, MAX_DESCRIPTION, DESCRIPTION_TOLERANCE = 0.01, 300, 1.0
# What a package says about a stage that gave nothing.
MISSING = {
    "vision": "No vision analysis: what the pictures show was not read.",
    "pointer": "No pointer was found; that is no proof that there was none.",
    "visual_change": "Visual changes were asked for and none was measured; that is no proof of a still picture.",
    "cursor_track": "Cursor movement was asked for and none was measured; that is no proof of a still cursor.",
}
ALWAYS = "Topics, key lessons and the summary come from words and cue phrases, not from an understanding of the text."
CHANGES = "Visual changes measure how much of the picture differs between two compared frames, not what it means; what came and went between them is not seen."
KEY_POINT = f"struct<text:string,kind:string,timestamp_sec:double,supporting_evidence:array<{EVIDENCE}>,confidence:double,nature:string>"
VISUAL = "struct<evidence_id:string,timestamp_sec:double,image_path:string,width:int,height:int,byte_size:bigint,selection_reason:string,description:string>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def limitations() -> Column:
    """The sentences that a package owes its reader, in a fixed order: how it was made, what the synthesis did, what is missing."""
    s = F.col("synthesis")
    told = F.concat(s.claims_rejected.cast("string"), F.lit(" of "), s.claims_returned.cast("string"), F.lit(" claim(s) of the synthesizer failed verification and were discarded."))
    synthesis = [
        F.when(s.isNull() | (s.status == "unavailable"), F.concat(F.lit("No semantic synthesis was run"), F.when(F.coalesce(s.detail, F.lit("")) != "", F.concat(F.lit(" ("), s.detail, F.lit(")"))).otherwise(""), F.lit(": semantic_summary and claims are empty."))),
        F.when(s.status == "failed", F.concat(F.lit("A synthesizer was asked and gave nothing usable ("), s.detail, F.lit("); nothing was put in its place."))),
        F.when(s.status == "rejected", F.concat(F.lit("A synthesizer answered; none of its "), s.claims_returned.cast("string"), F.lit(" claim(s) could be verified."))),
        F.when((s.status == "ok") & (s.claims_rejected > 0), told), F.when((s.status == "ok") & F.col("semantic_summary").isNull(), F.lit("The synthesizer gave no summary of the whole video.")),
    ]
    silent = F.when(F.col("transcript_status") != "ok", F.concat(F.lit("No usable speech (transcript status: "), "transcript_status", F.lit("): topics and key lessons could not be extracted.")))
    gone = {stage: F.when(F.array_contains("stages_unavailable", stage), F.lit(text)) for stage, text in MISSING.items()}
    said = [F.lit(ALWAYS), *synthesis, silent, gone["vision"], gone["pointer"], F.when(F.size("visual_changes") > 0, F.lit(CHANGES)), gone["visual_change"], gone["cursor_track"]]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def summary(name: Column, duration: str, source_type: Column, speech: Column, lessons: Column, topics: Column) -> Column:
    base = F.concat(name, F.lit(": a "), F.format_string("%.0f", F.rint(duration)), F.lit("s "), source_type, F.lit(" video."))
    found = F.when(F.size(topics) > 0, F.concat(F.lit(" Recurring topics: "), F.array_join(topics, ", "), F.lit("."))).otherwise("")
    told = F.concat(F.lit(" "), lessons.cast("string"), F.lit(" notable point(s) identified via deterministic transcript analysis."), found)
    return F.concat(base, F.when(speech, told).otherwise(" No speech was available to analyze."))


def _listed(rows: DataFrame, item: Column, name: str, *order: str) -> DataFrame:
    """(video_id, name): one ordered array per video."""
    kept = rows.select("video_id", F.struct(*order, item.alias("x")).alias("e")).groupBy("video_id").agg(F.array_sort(F.collect_list("e")).alias("l"))
    return kept.select("video_id", F.transform("l", lambda e: e.x).alias(name))


def _point(text: str, kind: Column, ts: Column, evidence: Column, confidence: Column, nature: str) -> Column:
    return F.struct(F.col(text).alias("text"), kind.alias("kind"), ts.alias("timestamp_sec"), evidence.alias("supporting_evidence"), confidence.alias("confidence"), F.lit(nature).alias("nature")).cast(KEY_POINT)


def transcript_states(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, transcript_status): ok where there is a segment, else unavailable; for runs without transcript headers."""
    there = segments.select("video_id").distinct().withColumn("transcript_status", F.lit("ok"))
    return videos.select("video_id").join(there, "video_id", "left").withColumn("transcript_status", F.coalesce("transcript_status", F.lit("unavailable")))


def assemble(
    videos: DataFrame, segments: DataFrame, structured: DataFrame, generated_at: str, stream: DataFrame | None = None, synthesis: DataFrame | None = None, transcripts: DataFrame | None = None, cues=knowledge.CUES,
) -> DataFrame:
    """One package row per video, whole: source, summary, topics, key_lessons, important_observations, evidence (all that
    is cited, once), claims, semantic_summary, synthesis, visual_changes, cursor_intelligence, visual_evidence (empty until
    images are bundled), limitations, processing.

    videos: video_id, source, source_type, duration_sec, title; structured: correlate.observe, read several times (hand in a
    written table); stream: correlate.change_stream;
    synthesis: synthesis.outputs; transcripts: (video_id, transcript_status). Lists keep their order by explicit ordinals;
    the clock is a parameter, so the same input gives the same rows."""
    state = transcript_states(videos, segments) if transcripts is None else transcripts.select("video_id", "transcript_status")
    said = segments.join(state.where("transcript_status = 'ok'").select("video_id"), "video_id", "left_semi")
    if "confidence" not in said.columns:
        said = said.withColumn("confidence", F.lit(None).cast("double"))
    topics = _listed(knowledge.topics(said, ("video_id",), order="seg_no"), F.col("topic"), "topics", "pos")
    quote = F.expr(f"array({correlate.piece('start_sec', 'transcript', 'text', 'said_confidence')})").cast(f"array<{EVIDENCE}>")
    lesson = knowledge.lessons(said, cues).withColumn("nature", F.lit("observed"))
    lessons = _listed(lesson, _point("text", F.col("kind"), F.col("start_sec"), quote, F.col("confidence"), "observed"), "key_lessons", "pos")
    important = important_observations(correlate.inferences(structured))
    important = _listed(important, _point("text", F.lit("observation"), F.col("t"), F.col("supporting_evidence"), F.col("confidence"), "inferred"), "important_observations", "pos")

    seen = correlate.flattened(structured).withColumn("prio", F.lit(1)).withColumn("seq", F.col("pos"))
    own = seen.groupBy("video_id").agg(F.collect_set("kind").alias("kinds"), F.count_distinct(F.when(F.col("kind") == "frame", F.col("ref"))).alias("frame_count"))
    lacking = structured.select("video_id", F.explode("unavailable").alias("s")).groupBy("video_id").agg(F.collect_set("s").alias("lacking"))
    measured = seen.select("video_id", "ts", "kind", "ref", "confidence", "end_ts", "source", "seq", "prio", "t")
    if stream is not None:
        measured = measured.unionByName(stream.select("video_id", "ts", "kind", "ref", "confidence", "end_ts", "source", "seq").withColumn("prio", F.lit(0)).withColumn("t", F.lit(0.0)))
    item = F.struct(F.col("ts").alias("timestamp_sec"), "kind", "ref", "confidence", F.col("end_ts").alias("timestamp_end_sec"), "source").cast(EVIDENCE)
    change = _listed(knowledge.collect_kind(measured, "visual_change").withColumn("kind", F.lit("visual_change")), item, "visual_changes", "pos")
    cursor = _listed(knowledge.collect_kind(measured, "cursor_track").withColumn("kind", F.lit("cursor_track")), item, "cursor_intelligence", "pos")

    p = videos
    for part in (state, topics, lessons, important, own, lacking, change, cursor):
        p = p.join(part, "video_id", "left")
    if synthesis is None:
        p = p.withColumns({"semantic_summary": F.lit(None).cast("string"), "claims": _empty(CLAIM), "synthesis": F.lit(None).cast(METADATA)})
    else:
        p = p.join(synthesis, "video_id", "left").withColumn("claims", F.coalesce("claims", _empty(CLAIM)))
    filled = {"topics": "string", "key_lessons": KEY_POINT, "important_observations": KEY_POINT, "visual_changes": EVIDENCE, "cursor_intelligence": EVIDENCE, "kinds": "string", "lacking": "string"}
    p = p.withColumns({c: F.coalesce(c, _empty(kind)) for c, kind in filled.items()} | {"frame_count": F.coalesce("frame_count", F.lit(0)), "transcript_status": F.coalesce("transcript_status", F.lit("unavailable"))})
    available = F.array_union("kinds", F.when(F.size("visual_changes") > 0, F.array(F.lit("visual_change"))).otherwise(_empty("string")))
    optional = F.array_intersect("lacking", F.array(*[F.lit(s) for s in knowledge.OPTIONAL_STAGES]))
    p = p.withColumn("stages_available", F.array_sort(available))
    p = p.withColumn("stages_unavailable", F.array_sort(F.array_except(F.array_union(F.array(*[F.lit(s) for s in knowledge.STAGES]), optional), "stages_available")))
    p = written(p, "packages")  # read for the rows and for what they cite
    cited = p.select("video_id", F.posexplode(F.flatten(F.concat(*[F.transform(c, lambda x: x.supporting_evidence) for c in ("key_lessons", "important_observations", "claims")]))).alias("ord", "e"))
    cited = knowledge.cited_once(cited.select("video_id", "ord", F.col("e.timestamp_sec").alias("ts"), "e.kind", "e.ref", "e.confidence", F.col("e.timestamp_end_sec").alias("end_ts"), "e.source"))
    p = p.join(_listed(cited, item, "evidence", "ord"), "video_id", "left").withColumn("evidence", F.coalesce("evidence", _empty(EVIDENCE)))
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("source"))
    p = p.withColumn("summary", summary(name, "duration_sec", F.col("source_type"), F.col("transcript_status") == "ok", F.size("key_lessons"), F.col("topics"))).withColumn("limitations", limitations())
    processing = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(ENGINE_VERSION).alias("engine_version"), F.lit(SCHEMA_VERSION).alias("knowledge_schema_version"), "frame_count", "transcript_status", "stages_available", "stages_unavailable")
    return p.select(
        "video_id", F.struct("source_type", "source", "duration_sec", "title").alias("source"), "summary", "topics", "key_lessons", "important_observations", "evidence", "limitations", "semantic_summary", "claims",
        "synthesis", "visual_changes", "cursor_intelligence", _empty(VISUAL).alias("visual_evidence"), _empty("struct<claim:int,images:array<string>>").alias("claim_images"), processing.alias("processing"),
    )


def checked(packages: DataFrame) -> DataFrame:
    """Package rows of assemble() with `violation`: the first rule that a row breaks, or null."""
    points = F.concat(*[F.transform(c, lambda x: F.struct(x.timestamp_sec.alias("t"), x.supporting_evidence.alias("es"))) for c in ("key_lessons", "important_observations", "claims")])
    cited = F.flatten(F.transform(points, lambda x: x.es))
    part = lambda c, want: F.transform(c, lambda e: F.struct(e.kind.alias("kind"), F.lit(want).alias("want"), e.timestamp_sec.alias("ts")))
    flat = packages.select(
        F.struct(*packages.columns).alias("_package"), F.col("source.source").alias("source"), F.col("source.duration_sec").alias("duration_sec"), "summary", "semantic_summary", F.col("processing.generated_at").alias("generated_at"),
        F.col("processing.knowledge_schema_version").alias("schema_version"), F.transform(points, lambda x: x.t).alias("timestamps"), F.flatten(F.transform("claim_images", lambda x: x.images)).alias("claim_visuals"),
        F.transform("visual_evidence", lambda x: x.evidence_id).alias("visual_ids"), F.transform("visual_evidence", lambda x: x.image_path).alias("visual_paths"), F.transform("visual_evidence", lambda x: x.timestamp_sec).alias("visual_times"),
        F.concat(part("visual_changes", "visual_change"), part("cursor_intelligence", "cursor_track")).alias("measurements"),
        F.transform(F.concat("evidence", "visual_changes", "cursor_intelligence"), lambda e: F.struct(e.kind.alias("kind"), e.ref.alias("ref"))).alias("refs"),
        F.transform("claims", lambda c: c.text).alias("claim_texts"), F.array_distinct(F.transform(cited, lambda e: e.kind)).alias("cited_kinds"), F.col("processing.stages_unavailable").alias("stages_unavailable"),
    )
    return knowledge.validate_packages(settled(flat)).select("_package.*", "violation")


def export_packages(packages: DataFrame, path: str) -> int:
    """Bulk export of assemble()'s rows: checked first, and nothing is written if one breaks a rule; one JSON document per
    video, nulls kept, in files that the job's commit makes whole or absent. Returns how many were written."""
    state = checked(packages).groupBy("violation").agg(F.count("*").alias("n"), F.min("video_id").alias("first")).collect()  # at most one row a rule
    if broken := [f"{r.violation} ({r.n}, first {r.first})" for r in state if r.violation]:
        raise ValueError("packages that may not be exported: " + "; ".join(sorted(broken)))
    packages.select(F.to_json(F.struct(*packages.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return sum(r.n for r in state)


def save(packages: DataFrame, folder: str) -> list[str]:
    """Each package as `<stem>.json` in a folder of this machine, one after the other; one that breaks a rule is an error
    before anything is written. For single runs; export_packages is for many."""
    rows = checked(packages)
    if broken := rows.where("violation is not null").select("video_id", "violation").limit(1).collect():
        raise ValueError(f"{broken[0].video_id}: {broken[0].violation}")
    name = F.coalesce(F.nullif(F.col("source.title"), F.lit("")), F.regexp_replace(base_name("source.source"), r"(?<=.)\.[^.]*$", ""))
    named = rows.drop("violation").select(filename_stem(name).alias("stem"), F.struct(*packages.columns).alias("p"))
    os.makedirs(folder, exist_ok=True)
    return [knowledge.export_package(r.p.asDict(recursive=True), os.path.join(folder, f"{r.stem}.json")) for r in named.toLocalIterator()]


def wants(packages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which candidate frames (video_id, evidence_id, ord, timestamp_sec, ref) knowledge asks for: one row per mention, with
    confidence, reason, order, and the claim that mentions it. Claims come by the frames they cite or the frames behind the
    vision they cite (never native vision); key points by the nearest frame, within half the usual gap of frames."""
    from .measure import anchor_tolerance
    from .temporal import band_join, interval_join

    c = candidates.select("video_id", F.col("evidence_id").alias("frame_id"), F.col("ord").alias("frame_ord"), F.col("timestamp_sec").alias("frame_ts"), F.col("ref").alias("path"))
    claims = packages.select("video_id", F.posexplode("claims").alias("claim", "x")).select("video_id", "claim", F.col("x.confidence").alias("confidence"), F.posexplode("x.supporting_evidence").alias("pos", "e"))
    by_path = claims.where("e.kind = 'frame'").join(c, (claims.video_id == c.video_id) & (F.col("e.ref") == c.path)).select(claims.video_id, "claim", "pos", "confidence", "frame_id", "frame_ts")
    own = claims.where(f"e.kind = 'vision' and e.source <> '{correlate.NATIVE}'").select("video_id", "claim", "pos", "confidence", F.col("e.timestamp_sec").alias("t"))
    behind = band_join(own, c, VISION_EPSILON, ts="frame_ts").groupBy("video_id", "claim", "pos", "confidence").agg(F.min_by("frame_id", "frame_ord").alias("frame_id"), F.min_by("frame_ts", "frame_ord").alias("frame_ts"))
    cited = by_path.withColumn("reason", F.lit("cited by a verified claim")).unionByName(behind.withColumn("reason", F.lit("the frame behind vision that a verified claim cites")))
    points = packages.select("video_id", F.posexplode(F.concat("key_lessons", "important_observations")).alias("point", "k")).select("video_id", "point", F.col("k.timestamp_sec").alias("t"), F.col("k.confidence").alias("confidence"))
    reach = anchor_tolerance(c.select("video_id", F.col("frame_ts").alias("ts"), F.col("frame_ord").alias("seq")))
    spans = points.join(reach, "video_id").withColumn("_lo", F.expr("t - tolerance - 1e-6D")).withColumn("_hi", F.expr("t + tolerance + 1e-6D"))
    met = interval_join(c.withColumn("_at", F.col("frame_ts")), spans, 1.0, lo="frame_ts", hi="_at", start="_lo", end="_hi").where("abs(frame_ts - t) <= tolerance")
    best = met.groupBy("video_id", "point", "confidence").agg(F.min_by(F.struct("frame_id", "frame_ts"), F.struct(F.abs(F.col("frame_ts") - F.col("t")), -F.col("frame_ord"))).alias("f"))
    best = best.select("video_id", F.lit(None).cast("int").alias("claim"), F.col("point").alias("pos"), "confidence", "f.frame_id", "f.frame_ts", F.lit("nearest frame to a key point").alias("reason"))
    every = cited.unionByName(best)
    return every.withColumn("ord", F.struct(F.col("claim").isNull(), F.coalesce("claim", F.lit(0)), "pos")).withColumnRenamed("frame_ts", "ts")


def important_observations(inferences: DataFrame) -> DataFrame:
    """Inferences (video_id, t, ord, text, confidence) as key points: each text once, the first time it is drawn."""
    return knowledge.first_seen(inferences, "text", "video_id", ("t", "ord"), 2**31 - 1).withColumn("nature", F.lit("inferred"))


def prompt(items: DataFrame, notes: DataFrame, missing: DataFrame, videos: DataFrame) -> DataFrame:
    """The user prompt of each video: numbered evidence in order, conflicts, missing streams, whether speech was cut, the request."""
    sure = F.when(F.col("confidence").isNotNull(), F.concat(F.lit(", confidence "), fixed("confidence", 2))).otherwise("")
    line = F.concat(F.lit("["), "evidence_id", F.lit("] "), "kind", F.lit(" @ "), fixed("timestamp_sec", 1), F.lit("s"), sure, F.lit(": "), "ref")
    told = items.withColumn("line", line).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"), F.max("condensed").alias("cut"))
    odd = notes.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t", "ord", "note"))).alias("n"))
    v = videos.join(told, "video_id", "left").join(odd, "video_id", "left").join(missing, "video_id", "left")
    part = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), text).otherwise("")
    lines = lambda c, f: F.array_join(F.transform(c, f), "\n")
    return v.select("video_id", F.concat(
        F.lit("VIDEO: "), F.coalesce(F.nullif(F.col("title"), F.lit("")), "source"), F.lit("\nDURATION: "), fixed("duration_sec", 1), F.lit("s\n\nEVIDENCE:\n"), F.coalesce(lines("l", lambda x: x.line), F.lit("")),
        part(F.size("n") > 0, F.concat(F.lit("\n\nKNOWN CONFLICTS (keep them visible):\n"), lines("n", lambda x: F.concat(F.lit("- "), x.note)))),
        part(F.size("stages") > 0, F.concat(F.lit("\n\nSTREAMS MISSING IN PARTS: "), F.array_join("stages", ", "), F.lit(". That a stream is missing proves nothing; claim nothing from it."))),
        part(F.col("cut"), F.lit("\n\nNOTE: speech was cut to fit a budget; do not quote cut text as verbatim.")), F.lit("\n\nAnswer with the JSON object."),
    ).alias("prompt"))


def illustrated(packages: DataFrame, candidates: DataFrame, images: DataFrame, descriptions: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Packages with their images: (packages with visual_evidence and claim_images, bundle: video_id, evidence_id, ref, image_path).

    candidates: the frames that were offered (video_id, evidence_id, ord, timestamp_sec, ref); images: what is known of their
    files (video_id, ref, signature, bright, width, height, size; a missing file has no row); descriptions: correlate.descriptions.
    What knowledge asks for most comes first; near-duplicates are stood for by the kept one, also in the claims that cite them;
    at `most` images the bundle is full. A claim names only images that are in the bundle."""
    from .folds import bundle
    from .temporal import nearest

    asked = written(wants(packages, candidates), "wants")
    ranked = knowledge.demand(asked).join(candidates.select("video_id", F.col("evidence_id").alias("frame_id"), F.col("ord").alias("seq"), "ref"), ["video_id", "frame_id"]).join(images, ["video_id", "ref"])
    ranked = written(ranked, "ranked")
    kept = written(bundle(ranked.select("video_id", "rank", "seq", "signature", "bright", F.col("size").cast("long").alias("size")), most), "bundled")
    shown = ranked.join(kept.where("seq = superseded_by").select("video_id", "seq"), ["video_id", "seq"])
    if descriptions is None:
        shown = shown.withColumn("description", F.lit(""))
    else:
        told = descriptions.select("video_id", F.col("ts").alias("told_at"), "description").withColumn("_one", F.lit(0))
        near = nearest(shown.select("video_id", "seq", F.col("ts").alias("t")), told, DESCRIPTION_TOLERANCE, ("video_id", "seq"), ("description",), ts="told_at", seq="_one")
        shown = shown.join(near.select("video_id", "seq", F.substring(F.coalesce("near.description", F.lit("")), 1, MAX_DESCRIPTION).alias("description")), ["video_id", "seq"])
    stem = filename_stem(F.coalesce(F.nullif(F.col("source.title"), F.lit("")), F.regexp_replace(base_name("source.source"), r"(?<=.)\.[^.]*$", "")))
    ending = F.coalesce(F.nullif(F.regexp_extract("ref", r"(?<=[^/])(\.[^./]*)$", 1), F.lit("")), F.lit(".jpg"))
    shown = shown.join(packages.select("video_id", stem.alias("stem")), "video_id").withColumn("image_path", F.concat("stem", F.lit("_evidence/"), "frame_id", ending))
    reason = F.concat("reason", F.lit("; referenced by "), F.col("refs").cast("string"), F.lit(" knowledge unit(s)"))
    item = F.struct(F.col("frame_id").alias("evidence_id"), F.col("ts").alias("timestamp_sec"), "image_path", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("size").cast("long").alias("byte_size"), reason.alias("selection_reason"), "description").cast(VISUAL)
    visual = _listed(shown, item, "visual_evidence", "rank")
    ids = candidates.select("video_id", F.col("ord").alias("seq"), "evidence_id")
    link = kept.join(ids, ["video_id", "seq"]).select("video_id", F.col("evidence_id").alias("_id"), "superseded_by")
    link = link.join(ids.withColumnRenamed("evidence_id", "stand_in"), (link.video_id == ids.video_id) & (F.col("superseded_by") == ids.seq)).select(link.video_id, F.col("_id").alias("seq"), F.col("stand_in").alias("superseded_by"))
    claims = link_images(asked.where("claim is not null").withColumnRenamed("frame_id", "frame").select("video_id", "claim", "pos", F.col("frame").alias("frame_id")), link)
    claims = _listed(claims, F.struct(F.col("claim").cast("int").alias("claim"), "images"), "claim_images", "claim")
    out = packages.drop("visual_evidence", "claim_images").join(visual, "video_id", "left").join(claims, "video_id", "left")
    out = out.withColumn("visual_evidence", F.coalesce("visual_evidence", _empty(VISUAL))).withColumn("claim_images", F.coalesce("claim_images", _empty("struct<claim:int,images:array<string>>")))
    return out.select(*packages.columns), shown.select("video_id", F.col("frame_id").alias("evidence_id"), "ref", "image_path")


def link_images(wants: DataFrame, bundled: DataFrame) -> DataFrame:
    """Claims' wanted frames (video_id, claim, pos, frame_id) -> the retained images in order, a duplicate by its stand-in, each once."""
    b = bundled.select("video_id", F.col("seq").alias("frame_id"), "superseded_by")
    w = Window.partitionBy("video_id", "claim", "superseded_by").orderBy("pos")
    hit = wants.join(b, ["video_id", "frame_id"]).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return hit.groupBy("video_id", "claim").agg(F.expr("transform(array_sort(collect_list(struct(pos, superseded_by))), x -> x.superseded_by)").alias("images"))


def copy_bundle(rows: list[dict], folder: str) -> list[dict]:
    """Copy selected frames (evidence_id, path: a small, bounded selection) beside the package; missing and empty files are skipped."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for r in rows:
        if os.path.isfile(r["path"]) and os.path.getsize(r["path"]):
            name = f"{r['evidence_id']}{os.path.splitext(r['path'])[1]}"
            shutil.copyfile(r["path"], os.path.join(folder, name))
            out.append(r | {"image_path": f"{os.path.basename(folder)}/{name}", "byte_size": os.path.getsize(r["path"])})
    return out
