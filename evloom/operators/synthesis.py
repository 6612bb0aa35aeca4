"""Briefs for an outside synthesizer and the verification of what it returns."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evloom.functions.scalars import EMBEDDED_MEDIA, fixed, py_repr, py_round, py_strip
from evloom.session import settled, ship, sliced, written

from . import correlate, folds
from .correlate import EVIDENCE
from .ordered import placed
from .temporal import band_join

# Budgets, limits, the evidence kinds that measure and those that say something, the order of the labels.
BRIEF_CHARS, MIN_CHUNK_CHARS, CHUNK_SEC = 24000, 120, 20.0
MAX_CLAIMS, MAX_EXAMINED, MAX_REASONS, MAX_LIMITATIONS = 40, 160, 10, 5
MAX_CLAIM_TEXT, MAX_KIND, MAX_PROVIDER, MAX_SUMMARY, MAX_LIMITATION, MAX_REF = 600, 40, 80, 4000, 300, 400
CONFLICT_WINDOW, DURATION_SLACK, DEFAULT_CONFIDENCE = 2.0, 1.0, 0.5
PART_CHARS, PART_ROWS, DEALT_KEYS = 1 << 22, 1 << 16, 4096
CONDENSED = " ...[condensed]"
MEASUREMENTS, CONTENT, NATURES = ("visual_change", "cursor_track"), ("transcript", "vision"), ("observed", "inferred", "unavailable")
MEDIA = "response contains embedded media/base64 data"
# What a claim's evidence does not establish.
CONFLICT_NOTE = "The evidence streams disagree near this time; the conflict is recorded, not resolved."
FRAME_NOTE = "Nobody has analysed the cited frame: it illustrates this claim and does not corroborate it."
SPEECH_NOTE = "This claim rests on speech alone: no visual evidence was cited."
VISUAL_NOTE = "This claim rests on visuals alone: no speech was cited."
MEASURE_NOTE = "A measured change or movement shows that something changed or moved, not what, why or by whose doing."

CLAIM = f"struct<text:string,kind:string,status:string,timestamp_sec:double,timestamp_end_sec:double,supporting_evidence:array<{EVIDENCE}>,confidence:double,verification:string,limitations:array<string>>"
METADATA = "struct<status:string,provider:string,claims_returned:bigint,claims_retained:bigint,claims_rejected:bigint,rejection_reasons:array<string>,detail:string>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


# --- the brief


def speech_chunks(segments: DataFrame, chunk_sec: float = CHUNK_SEC) -> DataFrame:
    """(video_id, chunk, ts, text): speech in chunks of about `chunk_sec`, texts stripped and joined by spaces."""
    own = segments.select("video_id", "seg_no", "start_sec", "end_sec", py_strip("text").alias("text")).where("text <> ''")
    place = folds.transcript_chunks(own, chunk_sec).select("video_id", "seg_no", "chunk", "chunk_start")
    told = own.join(place, ["video_id", "seg_no"]).groupBy("video_id", "chunk").agg(F.first("chunk_start").alias("ts"), F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("s"))
    return told.select("video_id", "chunk", "ts", F.array_join(F.transform("s", lambda x: x.text), " ").alias("text"))


def _dealt(groups: DataFrame) -> DataFrame:
    """(_h, _n): into how many parts the groups (_key, _total, _rows) of a hash of the key are dealt. Only hashes with a group
    beyond one part: at most `DEALT_KEYS` rows, however many groups there are."""
    n = F.greatest(F.coalesce(F.max("_total"), F.lit(0)) / PART_CHARS, F.max("_rows") / PART_ROWS)
    return groups.groupBy(_hash("_key").alias("_h")).agg(F.ceil(n).cast("int").alias("_n")).where("_n > 1")


def _hash(key: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(DEALT_KEYS)), F.lit(0))  # never null, which Spark can't tell: no filter for it splits a scan in two


def fit_budget(chunks: DataFrame, most: int = BRIEF_CHARS, per: str = "video_id", text: str = "text") -> DataFrame:
    """chunks with `fitted` and `condensed`: over budget every chunk is cut to an equal share (120 characters at least) and
    marked. Totals come from one aggregation and meet the chunks by (group, part): a large group is dealt into parts by a hash of
    its rows, so its texts are never in one task. Chunks of no group are a group of their own."""
    groups = chunks.groupBy(F.col(per).alias("_key")).agg(F.sum(F.length(text)).alias("_total"), F.count("*").alias("_rows"))
    dealt = F.broadcast(_dealt(groups))
    total = groups.withColumn("_h", _hash("_key")).join(dealt, "_h", "left").select("_key", F.explode(F.expr("sequence(0, coalesce(_n, 1) - 1)")).alias("_of"), "_total", F.expr(f"greatest({MIN_CHUNK_CHARS}, {most} div _rows)").alias("_share"))
    parts = chunks.withColumn("_h", _hash(per)).join(dealt, "_h", "left").withColumn("_part", F.expr("cast(pmod({}, coalesce(_n, 1)) as int)".format(f"xxhash64({', '.join(f'`{c}`' for c in chunks.columns)})")))
    df = parts.join(total, F.col(per).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    cut = F.concat(F.regexp_replace(F.expr(f"left({text}, cast(_share as int))"), r"(?U)[\s\x1c-\x1f]+$", ""), F.lit(CONDENSED))
    df = df.withColumn("condensed", F.col("_total") > most).withColumn("fitted", F.when(~F.col("condensed") | (F.length(text) <= F.col("_share")), F.col(text)).otherwise(cut))
    return df.select(*chunks.columns, "condensed", "fitted")


def null_measurement(kind: str = "kind", ref: str = "ref") -> Column:
    """A measurement whose reference says that nothing was measured; text that is no JSON says no such thing, nor does
    evidence of another kind."""
    v = F.try_parse_json(F.col(ref))
    said = lambda p: F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))
    return F.coalesce(F.col(kind).isin(*MEASUREMENTS) & ((said("$.status") == "not_detected") | (said("$.state") == "uncertain")), F.lit(False))


def contributed() -> Column:
    """Windows whose inferences rest on the pointer."""
    return F.exists("inferences", lambda i: i.basis.contains("pointer"))


def brief_items(structured: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """The numbered evidence of each video's brief: (video_id, evidence_id, ord, evidence columns, condensed).

    First speech, chunked over the whole video (`segments`: of transcripts whose status is ok), then what each window
    observed, in order: the pointer only where an inference rests on it, no null measurements, no window's speech; copies
    (time to the millisecond, kind, ref, source) once."""
    seen = structured.withColumn("_p", contributed()).select("video_id", "probe", F.col("t").alias("_t"), "_p", F.posexplode("observed").alias("_pos", "e"))
    seen = seen.select("video_id", "probe", "_t", F.col("_pos").cast("long").alias("_pos"), "_p", "e.*", F.lit(False).alias("condensed"))
    seen = seen.where("kind <> 'transcript' and (kind <> 'pointer' or _p)").where(~null_measurement()).drop("_p")
    if segments is not None:
        fitted = fit_budget(speech_chunks(segments))
        none = F.lit(None).cast("double")
        said = fitted.select("video_id", F.lit(None).cast("long").alias("probe"), F.lit(-1.0).alias("_t"), F.col("chunk").alias("_pos"), F.col("ts").alias("timestamp_sec"), F.lit("transcript").alias("kind"),
                             F.col("fitted").alias("ref"), none.alias("confidence"), none.alias("timestamp_end_sec"), F.lit("").alias("source"), "condensed")
        seen = said.unionByName(seen)
    once = Window.partitionBy("video_id", py_round("timestamp_sec", 3), "kind", "ref", "source").orderBy("_t", "probe", "_pos")
    seen = seen.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    seen = placed(seen, ("_t",), order=("_t", "probe", "_pos")).withColumnRenamed("i", "ord")
    cols = ["timestamp_sec", "kind", "ref", "confidence", "timestamp_end_sec", "source"]
    return seen.select("video_id", "probe", F.concat(F.lit("e"), F.col("ord").cast("string")).alias("evidence_id"), "ord", *cols, "condensed")


def brief_notes(structured: DataFrame) -> DataFrame:
    """(video_id, t, ord, note): disagreements as a brief shows them, `c` being the time that a conflict counts from."""
    notes = correlate.disagreements(structured)
    return notes.select("video_id", "t", "ord", F.concat(F.lit("["), fixed("t", 1), F.lit("s] "), "note").alias("note"), py_round("t", 1).alias("c"))


def missing_streams(structured: DataFrame) -> DataFrame:
    """(video_id, stages): streams that some window lacked, sorted."""
    gone = structured.select("video_id", F.explode("unavailable").alias("s")).distinct()
    return gone.groupBy("video_id").agg(F.array_sort(F.collect_list("s")).alias("stages"))


# --- a provider's answer


def unfenced(answer: str) -> str:
    """JSON text without the code fence that models like to put around it."""
    s = answer.strip()
    return s[3:-3].removeprefix("json").strip() if len(s) >= 6 and s.startswith("```") and s.endswith("```") else s


def answer_rows(video_id: str, answer: str | None, error: str | None) -> list[dict]:
    """One answer as a head row (no `ord`) and a row per element of `claims`; what the provider gave is kept as text."""
    head = {"video_id": video_id, "provider": "", "summary": None, "fault": error, "returned": 0}
    try:
        said = json.loads(unfenced(answer or "")) if error is None else {}
    except ValueError:
        said = None
    if not isinstance(said, dict):
        return [head | {"fault": "malformed provider response"}]
    claims = said.get("claims") or []
    head |= {"provider": str(said.get("provider", ""))[:MAX_PROVIDER], "summary": str(said.get("summary", ""))}
    if not isinstance(claims, list):
        return [head | {"fault": "'claims' is not a list"}]
    text = lambda c, k: str(c[k]) if k in c else None
    texts = lambda c, k: [str(x) for x in c.get(k) or []] if isinstance(c.get(k) or [], list) else [str(c[k])]
    rows = [head | {"returned": len(claims)}]
    for i, c in enumerate(claims):
        own = c if isinstance(c, dict) else {}
        rows.append({"video_id": video_id, "ord": i, "is_object": isinstance(c, dict), **{k: text(own, k) for k in ("text", "kind", "nature", "timestamp_sec", "timestamp_end_sec", "confidence")},
                     "evidence_ids": texts(own, "evidence_ids"), "limitations": texts(own, "limitations")})
    return rows


_HEAD, _CLAIM_ROW = ("video_id", "provider", "summary", "fault", "returned"), ("video_id", "ord", "is_object", "text", "kind", "nature", "timestamp_sec", "timestamp_end_sec", "confidence", "evidence_ids", "limitations")
_ANSWER = "video_id string, provider string, summary string, fault string, returned long, ord long, is_object boolean, text string, kind string, nature string, timestamp_sec string, timestamp_end_sec string, confidence string, evidence_ids array<string>, limitations array<string>"


def read_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers (video_id, answer: JSON text or null, error) -> (heads, raw claims).

    heads: video_id, provider, summary, fault (why the whole answer is unusable, or null), returned. Raw claims: one row per
    element of `claims`, numbers as the text that the provider gave."""
    ship(answers.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(_ANSWER))

    def run(batches):
        for b in sliced(batches, 64):
            yield pa.RecordBatch.from_pylist([x for r in b.to_pylist() for x in answer_rows(r["video_id"], r["answer"], r["error"])], kinds)

    rows = written(answers.select("video_id", "answer", "error").mapInArrow(run, _ANSWER), "answers")
    return rows.where("ord is null").select(*_HEAD), rows.where("ord is not null").select(*_CLAIM_ROW)


# --- verification


def _clean(x: Column, most: int) -> Column:
    return F.left(py_strip(x), F.lit(most))



def _with(df: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def verify(claims: DataFrame, brief: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Each raw claim against the evidence that it cites: a claim column and `reason` (null: it stands).

    claims: video_id, ord, text, nature, evidence_ids, duration_sec and, where given, timestamp_sec, timestamp_end_sec,
    confidence (numbers or text), kind, limitations, is_object; brief: brief_items; conflicts: video_id, c. Checks run in a
    fixed order, the first failure is the reason. Confidence is capped by the best evidence cited; an end that is no time
    of the video is dropped; `conflicting` is decided here, never by the provider."""
    key = ["video_id", "ord"]
    c = _with(claims, timestamp_sec="double", timestamp_end_sec="double", confidence="double", kind="string", limitations="array<string>", is_object="boolean")
    c = c.select(*key, "duration_sec", F.coalesce("is_object", F.lit(True)).alias("is_object"), F.coalesce("text", F.lit("")).alias("text"), F.lower(py_strip(F.coalesce("nature", F.lit("")))).alias("nature"),
                 F.coalesce("evidence_ids", _none("string")).alias("ids"), F.col("timestamp_sec").alias("raw_ts"), F.col("timestamp_end_sec").alias("raw_end"), F.col("confidence").alias("raw_conf"),
                 F.coalesce("kind", F.lit("fact")).alias("kind"), F.coalesce("limitations", _none("string")).alias("limits"))
    cited = c.select(*key, F.posexplode("ids").alias("pos", "evidence_id"))
    item = F.struct("timestamp_sec", "kind", F.left("ref", F.lit(MAX_REF)).alias("ref"), "confidence", "timestamp_end_sec", "source").cast(EVIDENCE)
    b = _with(brief, timestamp_end_sec="double", source="string").select("video_id", "evidence_id", item.alias("e"))
    facts = cited.join(b, ["video_id", "evidence_id"], "left").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("pos", "e")))).alias("es"), F.array_sort(F.collect_set(F.when(F.col("e").isNull(), F.col("evidence_id")))).alias("unknown")
    )
    c = c.join(facts, key, "left").withColumns({"es": F.coalesce(F.transform("es", lambda x: x.e), _none(EVIDENCE)), "unknown": F.coalesce("unknown", _none("string"))})
    kinds = F.array_distinct(F.transform("es", lambda e: e.kind))
    has = lambda *names: F.coalesce(F.arrays_overlap(kinds, F.array(*[F.lit(n) for n in names])), F.lit(False))
    c = c.withColumns({
        "ts": F.coalesce(F.col("raw_ts").try_cast("double"), F.expr("get(es, 0).timestamp_sec"), F.lit(0.0)), "conf": F.coalesce(F.col("raw_conf").try_cast("double"), F.lit(DEFAULT_CONFIDENCE)),
        "cap": F.expr("array_max(filter(transform(es, e -> e.confidence), x -> x is not null))"), "end": F.col("raw_end").try_cast("double"),
        "speech": has("transcript"), "seen": has("vision"), "framed": has("frame"), "measured": has(*MEASUREMENTS), "pointed": has("pointer"),
    })
    near = band_join(c.select(*key, F.col("ts").alias("t")).where("not isnan(t)"), conflicts.select("video_id", "c").distinct(), CONFLICT_WINDOW, ts="c").select(*key).distinct().withColumn("conflict", F.lit(True))
    c = settled(c.join(near, key, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False))))
    col, media = F.col, lambda x: x.rlike(EMBEDDED_MEDIA)
    inside = lambda x: ~F.isnan(x) & (x >= 0) & (x <= col("duration_sec") + DURATION_SLACK)
    bad = lambda raw: col(raw).isNotNull() & col(raw).try_cast("double").isNull()
    reason = (
        F.when(~col("is_object"), "claim is not a JSON object").when(media(col("text")), f"unusable claim: {MEDIA}").when(py_strip("text") == "", "claim has no text")
        .when(~col("nature").isin(*NATURES), F.concat(F.lit("invalid claim nature '"), "nature", F.lit("'")))
        .when(F.size("unknown") > 0, F.concat(F.lit("cites evidence id(s) that do not exist: "), F.array_join(F.slice("unknown", 1, 5), ", ")))
        .when((F.size("es") == 0) & (col("nature") != "unavailable"), "claim cites no evidence")
        .when(bad("raw_ts"), "claim timestamp is not a number").when(~inside(col("ts")), F.concat(F.lit("timestamp "), fixed("ts", 2), F.lit("s falls outside the source duration "), fixed("duration_sec", 2), F.lit("s")))
        .when(bad("raw_conf"), "claim confidence is not a number").when(F.isnan("conf") | (col("conf") < 0) | (col("conf") > 1), F.concat(F.lit("claim confidence out of range: "), py_repr("conf")))
        .when(F.exists("limits", media) | media(col("kind")), f"unusable claim: {MEDIA}")
    )
    void = col("nature") == "unavailable"
    status = F.when(void, "unavailable").when(col("conflict"), "conflicting").when((col("nature") == "observed") & col("measured") & ~col("speech") & ~col("seen"), "inferred").otherwise(col("nature"))
    label = (
        F.when(col("speech") & col("seen"), "speech_corroborated_by_visual_evidence").when(col("speech") & col("framed"), "speech_evidence_with_uninterpreted_frame")
        .when(col("speech") & col("measured"), "speech_evidence_with_measured_change").when(col("speech"), "speech_evidence_only").when(col("seen"), "visual_evidence_only")
        .when(col("measured"), "measurement_evidence_only").when(col("framed"), "uninterpreted_frame_only").when(col("pointed"), "pointer_evidence_only").otherwise("unverifiable_no_evidence_cited")
    )
    c = c.withColumns({"reason": reason, "status": status, "verification": label})
    told = F.transform(F.slice("limits", 1, MAX_LIMITATIONS), lambda x: _clean(x, MAX_LIMITATION))
    by_label = col("verification")
    notes = F.array(F.when(col("conflict") & ~void, CONFLICT_NOTE), F.when(by_label.isin("speech_evidence_with_uninterpreted_frame", "uninterpreted_frame_only"), FRAME_NOTE).when(by_label == "speech_evidence_only", SPEECH_NOTE)
                    .when(by_label == "visual_evidence_only", VISUAL_NOTE), F.when(col("measured"), MEASURE_NOTE))
    out = c.select(
        *key, _clean(col("text"), MAX_CLAIM_TEXT).alias("text"), F.coalesce(F.nullif(_clean(col("kind"), MAX_KIND), F.lit("")), F.lit("fact")).alias("kind"), "status", col("ts").alias("timestamp_sec"),
        F.when(inside(col("end")) & (col("end") >= col("ts")), col("end")).alias("timestamp_end_sec"), col("es").alias("supporting_evidence"), F.when(void, 0.0).otherwise(F.least("conf", F.coalesce("cap", "conf"))).alias("confidence"),
        "verification", F.array_distinct(F.concat(told, F.filter(notes, lambda x: x.isNotNull()))).alias("limitations"), "reason",
    )
    return settled(out)


def examined(claims: DataFrame) -> DataFrame:
    """Of each video's raw claims the first 160 in order: no more are looked at."""
    w = Window.partitionBy("video_id").orderBy("ord")
    return claims.withColumn("_i", F.row_number().over(w)).where(f"_i <= {MAX_EXAMINED}").drop("_i")


def intake(verified: DataFrame) -> DataFrame:
    """Of each video's claims in order: at most 160 are examined, and none after the 40th that was verified."""
    w = Window.partitionBy("video_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    df = examined(verified).withColumn("_ok", F.sum(F.expr("if(reason is null, 1, 0)")).over(w))
    return df.where(f"coalesce(_ok, 0) < {MAX_CLAIMS}").drop("_ok")


def counts(raw: DataFrame, seen: DataFrame) -> DataFrame:
    """Per video: claims returned (all raw ones), retained, rejected, and the first distinct reasons in order."""
    total = raw.groupBy("video_id").agg(F.count("*").alias("returned"))
    own = seen.groupBy("video_id").agg(F.sum(F.expr("if(reason is null, 1, 0)")).alias("retained"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("ord", "reason")))).alias("r"))
    reasons = F.slice(F.array_distinct(F.transform(F.coalesce("r", _none("struct<ord:bigint,reason:string>")), lambda x: x.reason)), 1, MAX_REASONS)
    out = total.join(own, "video_id", "left").withColumn("retained", F.coalesce("retained", F.lit(0)))
    return out.select("video_id", "returned", "retained", reasons.alias("reasons"), (F.col("returned") - F.col("retained")).alias("rejected"))


def outputs(answers: DataFrame, brief: DataFrame, conflicts: DataFrame, videos: DataFrame) -> DataFrame:
    """What of each answer stands: (video_id, semantic_summary, claims, synthesis).

    Status: failed (no usable answer, or one that says nothing), rejected (claims came and none stood, no summary either),
    ok. A bad answer never fails a run."""
    heads, raw = read_answers(answers)
    raw = raw.join(videos.select("video_id", "duration_sec"), "video_id")
    seen = intake(verify(examined(raw), brief, conflicts))
    own = counts(raw, seen).drop("returned")
    kept = seen.where("reason is null").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*_fields(CLAIM)).cast(CLAIM).alias("c")))).alias("k"))
    df = heads.join(own, "video_id", "left").join(kept, "video_id", "left")
    spoiled = F.coalesce(F.col("summary").rlike(EMBEDDED_MEDIA), F.lit(False))
    summary = F.when(F.col("fault").isNull() & ~spoiled, F.nullif(_clean(F.col("summary"), MAX_SUMMARY), F.lit("")))
    reasons = F.concat(F.coalesce("reasons", _none("string")), F.when(spoiled & F.col("fault").isNull(), F.array(F.lit(f"summary rejected: {MEDIA}"))).otherwise(_none("string")))
    df = df.withColumns({"semantic_summary": summary, "claims": F.coalesce(F.transform("k", lambda x: x.c), _none(CLAIM)), "retained": F.coalesce("retained", F.lit(0)), "_r": F.slice(reasons, 1, MAX_REASONS)})
    silent = (F.size("claims") == 0) & F.col("semantic_summary").isNull()
    status = F.when(F.col("fault").isNotNull() | silent & (F.col("returned") == 0), "failed").when(silent, "rejected").otherwise("ok")
    detail = F.when(F.col("fault").isNotNull(), F.col("fault")).when(silent, "no claim or summary survived verification").otherwise("")
    made = F.struct(status.alias("status"), F.col("provider"), F.col("returned").alias("claims_returned"), F.col("retained").cast("long").alias("claims_retained"), (F.col("returned") - F.col("retained")).cast("long").alias("claims_rejected"),
                    F.col("_r").alias("rejection_reasons"), detail.alias("detail")).cast(METADATA)
    return df.select("video_id", "semantic_summary", "claims", made.alias("synthesis"))


def _fields(struct: str) -> list[str]:
    """The top-level fields of a struct type."""
    return [f.name for f in StructType.fromDDL(struct[len("struct<") : -1]).fields]


def ask(synthesizer, brief: dict) -> dict:
    """A synthesizer's answer for read_answers: its JSON text, or the error; its exceptions never leave here."""
    if synthesizer is None:
        return {"answer": None, "error": "no synthesizer"}
    try:
        answer = synthesizer.synthesize(brief)
        if isinstance(answer, bytes):
            answer = answer.decode("utf-8")
        return {"answer": answer if isinstance(answer, str) else json.dumps(answer), "error": None}
    except Exception as e:  # an outside provider must not fail a run
        return {"answer": None, "error": f"synthesizer raised {type(e).__name__}: {e}"[:300]}
