"""Correlation of evidence streams around query times: what was observed, what follows from it, what disagrees, what is missing.

A stream row is an evidence row (video_id, seq, ts, kind, ref, confidence, end_ts, source) that also has what its kind
says of itself: `status` (pointer, vision, visual_change), x, y, frame_width, frame_height (pointer), elements (vision).
The nearest row of a kind is chosen first and judged after: a nearer failed answer hides a good one behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions.evidence import usable
from evloom.functions.scalars import fixed, py_round
from evloom.session import settled

# The source label of native video answers, the least normalised way of a moving pointer, the labels of the two rules.
NATIVE, MOTION_THRESHOLD = "video_understanding", 0.03
IN_REGION, MOTION = "pointer_in_vision_region", "speech_pointer_motion"
OPTIONAL = ("video_understanding", "visual_change", "cursor_track")
REGION = "struct<x1:double,y1:double,x2:double,y2:double>"
ELEMENT = f"struct<kind:string,description:string,region:{REGION},region_confidence:string>"
EVIDENCE = "struct<timestamp_sec:double,kind:string,ref:string,confidence:double,timestamp_end_sec:double,source:string>"
INFERENCE = f"struct<text:string,supporting_evidence:array<{EVIDENCE}>,confidence:double,basis:string>"
_POINTER = {"x": "int", "y": "int", "frame_width": "int", "frame_height": "int"}
_KEEP = ("kind", "seq", "ts", "ref", "confidence", "end_ts", "source", "status", *_POINTER, "elements")


def streams(evidence: DataFrame) -> DataFrame:
    """Evidence rows as stream rows: columns they lack are added. Where there is no `status` column at all, every
    reading counts as detected and every answer as ok; in a column that is there, null says nothing."""
    if "status" not in evidence.columns:
        evidence = evidence.withColumn("status", F.expr("case kind when 'pointer' then 'detected' when 'vision' then 'ok' end"))
    for name, kind in (*_POINTER.items(), ("elements", f"array<{ELEMENT}>")):
        if name not in evidence.columns:
            evidence = evidence.withColumn(name, F.lit(None).cast(kind))
    return evidence.select("video_id", *_KEEP)


def _native() -> Column:
    return (F.col("kind") == "vision") & (F.col("source") == NATIVE)


def marks(evidence: DataFrame) -> DataFrame:
    """Rows that give query times (video_id, probe, t): frames, in videos without any the starts of speech, and usable native
    answers. Times may repeat. Reads kinds, times and statuses only."""
    some = streams(evidence).where((F.col("kind").isin("frame", "transcript")) | (_native() & usable())).select("video_id", F.col("seq").alias("probe"), F.col("ts").alias("t"), "kind")
    framed = streams(evidence).where("kind = 'frame'").select("video_id").distinct().withColumn("_framed", F.lit(True))
    return some.join(framed, "video_id", "left").where("kind <> 'transcript' or _framed is null").select("video_id", "probe", "t")


def windows(evidence: DataFrame) -> DataFrame:
    """Query times (video_id, probe, t), each once, `probe` the lowest seq that gives it."""
    return marks(evidence).groupBy("video_id", "t").agg(F.min("probe").alias("probe")).select("video_id", "probe", "t")


_SPANS = "kind in ('transcript', 'cursor_track')"
_WITHIN = f"named_struct({', '.join(f"'{c}', {c}" for c in _KEEP)})"
# What a window holds of each kind: the nearest row, or all rows in order.
_HELD = {
    "frame": ("near", "kind = 'frame'", "named_struct('ts', ts, 'ref', ref)"), "_p": ("near", "kind = 'pointer'", _WITHIN),
    "_v": ("near", f"kind = 'vision' and source <> '{NATIVE}'", _WITHIN), "_n": ("near", f"kind = 'vision' and source = '{NATIVE}'", _WITHIN),
    "_said": ("all", "kind = 'transcript'", "named_struct('ts', ts, 'seq', seq, 'ref', ref, 'confidence', confidence)"),
    "_ptr": ("all", "kind = 'pointer'", "named_struct('ts', ts, 'seq', seq, 'ref', ref, 'confidence', confidence, 'status', status, 'x', x, 'y', y, 'frame_width', frame_width, 'frame_height', frame_height)"),
    "_chg": ("all", "kind = 'visual_change' and coalesce(status, '') <> 'unavailable'", "named_struct('ts', ts, 'seq', seq, 'ref', ref, 'confidence', confidence, 'end_ts', end_ts, 'source', source)"),
    "_mov": ("all", "kind = 'cursor_track'", "named_struct('ts', ts, 'end_ts', end_ts, 'seq', seq, 'ref', ref, 'confidence', confidence, 'source', source)"),
}


def held(evidence: DataFrame, tol: float, times: DataFrame | None = None) -> DataFrame:
    """One row per query time (video_id, probe, t) with what its window holds (_HELD): points within tol, speech that overlaps
    it strictly, movement segments that touch it. Equal times of a video are one, given times stay as they are.

    Points are spans of length zero: one join on (video, level, bucket) meets every kind, one aggregation by window takes the
    nearest rows and the lists. Windows without any row stay. A row falls into few buckets (its level follows its length), so
    neither a long video nor a long span gathers in one task."""
    from .temporal import posted

    s = streams(evidence).withColumn("_s", F.col("ts")).withColumn("_e", F.expr(f"if({_SPANS}, coalesce(end_ts, ts), ts)"))
    width = float(max(2 * tol, 1.0))
    items = posted(s, "_s", "_e", width).withColumnRenamed("_first", "_s0").withColumnsRenamed({"video_id": "_video", "_l": "_il", "_b": "_ib"})
    pad = f"({tol * 1e-9 + 1e-9!r}D + abs(t) * 1e-14D)"  # buckets cover what rounding of t +- tol would lose; the predicate decides
    own = marks(evidence) if times is None else times.select("video_id", "probe", "t")
    w = posted(own.withColumn("_lo", F.expr(f"t - {tol!r}D - {pad}")).withColumn("_hi", F.expr(f"t + {tol!r}D + {pad}")), "_lo", "_hi", width, every=True).drop("_lo", "_hi")
    w = w.repartition("video_id", "_l", "_b")
    w = w.groupBy("video_id", "_l", "_b", "t", "_first").agg(F.min("probe").alias("probe")) if times is None else w
    meet = f"case kind when 'transcript' then ts < t + {tol!r}D and _e > t - {tol!r}D when 'cursor_track' then ts <= t + {tol!r}D and _e >= t - {tol!r}D else abs(ts - t) <= {tol!r}D end"
    on = (F.col("video_id") == F.col("_video")) & (F.col("_l") == F.col("_il")) & (F.col("_b") == F.col("_ib")) & (F.col("_b") == F.greatest("_s0", "_first")) & F.expr(meet)
    met = w.join(items, on, "left")
    near = "min_by({what}, named_struct('d', abs(ts - t), 'ts', ts, 'seq', seq)) filter (where {cond}) as {name}"
    every = "array_sort(collect_list({what}) filter (where {cond})) as {name}"
    found = [F.expr((near if how == "near" else every).format(what=what, cond=cond, name=name)) for name, (how, cond, what) in _HELD.items()]
    return met.groupBy("video_id", "probe", "t").agg(*found)


_NONE = "cast(null as double)"
_PLACE = "concat('x=', cast({0}.x as string), ', y=', cast({0}.y as string))"


def piece(ts: str, kind: str, ref: str, confidence: str = _NONE, end: str = _NONE, source: str = "''") -> str:
    """One piece of evidence, as SQL."""
    return f"named_struct('timestamp_sec', {ts}, 'kind', '{kind}', 'ref', {ref}, 'confidence', {confidence}, 'timestamp_end_sec', {end}, 'source', {source})"


def _some(condition: str, item: str, kind: str) -> str:
    return f"if({condition}, cast({item} as array<{kind}>), cast(array() as array<{kind}>))"


def _seen(v: str, source: str) -> str:
    """A vision answer as evidence: its description, then its elements."""
    said = piece(f"{v}.ts", "vision", f"coalesce(nullif({v}.ref, ''), '(no description)')", f"{v}.confidence", source=source)
    part = piece(f"{v}.ts", "vision", "concat(e.kind, ': ', e.description)", f"{v}.confidence", source=source)
    return f"concat(cast(array({said}) as array<{EVIDENCE}>), coalesce(cast(transform({v}.elements, e -> {part}) as array<{EVIDENCE}>), cast(array() as array<{EVIDENCE}>)))"


def observe(evidence: DataFrame, tol: float = 1.0, configured: tuple[str, ...] = (), times: DataFrame | None = None) -> DataFrame:
    """One row per query time: observed, inferences, disagreements, unavailable, frame_path; and the joined row:
    transcript_context, description, pointer, vision.

    `configured` names the optional streams that were asked for (video_understanding, visual_change, cursor_track); only
    those are reported missing. A change that could not be compared is no evidence. Inferences read frame vision, never
    native answers; a pointer is never said to be still."""
    if not 0 < tol < float("inf"):
        raise ValueError(f"tolerance must be positive, not {tol}")
    if set(configured) - set(OPTIONAL):
        raise ValueError(f"unknown streams: {sorted(set(configured) - set(OPTIONAL))}")
    tol = float(tol)
    df = held(evidence, tol, times)
    df = df.selectExpr(
        "*", "coalesce(_p.status <> 'not_detected', false) as _at", "coalesce(_v.status in ('ok', 'low_information'), false) as _see", "coalesce(_n.status in ('ok', 'low_information'), false) as _native",
        "coalesce(size(_said) > 0, false) as _spoken", "case when _v.status = 'ok' then filter(_v.elements, x -> x.region is not null) end as _loc",
        "case when _p.frame_width > 0 then _p.x / _p.frame_width end as _nx", "case when _p.frame_height > 0 then _p.y / _p.frame_height end as _ny",
        "filter(transform(_ptr, (x, i) -> if(x.status = 'detected', i, null)), i -> i is not null) as _hit",
    )
    # the pointer against what vision located; and from its first to its last detection
    df = df.selectExpr(
        "*", "get(filter(_loc, x -> _nx between x.region.x1 and x.region.x2 and _ny between x.region.y1 and x.region.y2), 0) as _in", "coalesce(size(_loc) > 0, false) as _located",
        "case when size(_hit) >= 2 then slice(_ptr, get(_hit, 0) + 1, get(_hit, size(_hit) - 1) - get(_hit, 0) + 1) end as _run",
    )
    end = lambda i, c, s: f"get(_run, {i}).{c} / if(get(_run, {i}).{s} > 0, get(_run, {i}).{s}, null)"
    axis = lambda c, s: f"pow({end('size(_run) - 1', c, s)} - {end('0', c, s)}, 2)"
    df = df.selectExpr("*", "_located and _at and _nx is not null and _ny is not null as _known", f"sqrt({axis('x', 'frame_width')} + {axis('y', 'frame_height')}) as _way")
    df = df.withColumns({
        "_moving": F.expr(f"_spoken and coalesce(forall(_run, x -> x.status = 'detected'), false) and coalesce(_way > {MOTION_THRESHOLD}, false)"),
        "_sure": py_round(F.expr("_p.confidence * _v.confidence"), 4), "_part": py_round(F.expr("size(_run) / size(_ptr)"), 4), "_x3": fixed("_nx", 3), "_y3": fixed("_ny", 3), "_way3": fixed("_way", 3),
    })
    said, moved = f"transform(_said, e -> {piece('e.ts', 'transcript', 'e.ref', 'e.confidence')})", f"transform(_run, e -> {piece('e.ts', 'pointer', _PLACE.format('e'), 'e.confidence')})"
    measured = lambda kind: piece("e.ts", kind, "e.ref", "e.confidence", "e.end_ts", "e.source")
    pointed = piece("_p.ts", "pointer", f"coalesce(concat({_PLACE.format('_p')}, ' (status=', _p.status, ')'), _p.ref)", "_p.confidence")
    observed = [
        _some("frame is not null", f"array({piece('frame.ts', 'frame', 'frame.ref')})", EVIDENCE), _some("_spoken", said, EVIDENCE), _some("_at", f"array({pointed})", EVIDENCE), _some("_see", _seen("_v", "''"), EVIDENCE),
        _some("_native", _seen("_n", f"'{NATIVE}'"), EVIDENCE), _some("size(_chg) > 0", f"transform(_chg, e -> {measured('visual_change')})", EVIDENCE), _some("size(_mov) > 0", f"transform(_mov, e -> {measured('cursor_track')})", EVIDENCE),
    ]
    there = [("frame", "frame is not null"), ("transcript", "_spoken"), ("pointer", "_at"), ("vision", "_see or _native")]
    there += [(s, ok) for s, ok in (("video_understanding", "_native"), ("visual_change", "size(_chg) > 0"), ("cursor_track", "size(_mov) > 0")) if s in configured]
    missing = ", ".join(f"if({ok}, null, '{s}')" for s, ok in there)
    inside = "concat('The pointer lay inside the region that vision located as ''', _in.description, ''' (', _in.kind, '). That supports, without proving it, that this element was referred to or used.')"
    cited = f"array({piece('_p.ts', 'pointer', _PLACE.format('_p'), '_p.confidence')}, {piece('_v.ts', 'vision', "concat(_in.kind, ': ', _in.description)", '_v.confidence')})"
    within = f"named_struct('text', {inside}, 'supporting_evidence', {cited}, 'confidence', _sure, 'basis', '{IN_REGION}')"
    while_said = "concat('There was speech while the pointer moved across the frame (normalized displacement ', _way3, ').')"
    motion = f"named_struct('text', {while_said}, 'supporting_evidence', concat(cast({said} as array<{EVIDENCE}>), cast({moved} as array<{EVIDENCE}>)), 'confidence', _part, 'basis', '{MOTION}')"
    outside = "if(_known and _in is null, concat('pointer position (', _x3, ', ', _y3, ') is in none of the ', cast(size(_loc) as string), ' located region(s)'), null)"
    alone = "if(_located and not _at, 'vision located element(s), but no pointer evidence of this window confirms any use of them', null)"
    df = df.selectExpr(
        "*", f"concat({', '.join(observed)}) as observed", f"concat({_some('_known and _in is not null', f'array({within})', INFERENCE)}, {_some('_moving', f'array({motion})', INFERENCE)}) as inferences",
        f"array_compact(array({outside}, {alone})) as disagreements", f"array_compact(array({missing})) as unavailable",
    )
    out = df.selectExpr(
        "video_id", "probe", "t", f"{tol!r}D as tolerance_sec", "observed", "inferences", "disagreements", "unavailable", "frame.ref as frame_path",
        "if(_spoken, nullif(array_join(transform(_said, e -> e.ref), ' '), ''), null) as transcript_context", "coalesce(get(filter(observed, x -> x.kind = 'vision'), 0).ref, '') as description",
        "if(_at, _p, null) as pointer", "case when _see then _v when _native then _n end as vision",
    )
    return settled(out)


def flattened(structured: DataFrame) -> DataFrame:
    """All observed evidence, window by window, in the order of observation: (video_id, probe, t, pos, evidence columns)."""
    rows = structured.select("video_id", "probe", "t", F.posexplode("observed").alias("pos", "e"))
    return rows.select("video_id", "probe", "t", F.col("pos").cast("long").alias("pos"), F.col("e.timestamp_sec").alias("ts"), "e.kind", "e.ref", "e.confidence", F.col("e.timestamp_end_sec").alias("end_ts"), "e.source")


def change_stream(evidence: DataFrame) -> DataFrame:
    """Every change that could be compared, wherever the windows lie."""
    cols = ["video_id", "ts", "kind", "ref", "confidence", "end_ts", "source"]
    return streams(evidence).where("kind = 'visual_change' and coalesce(status, '') <> 'unavailable'").select(*cols, "seq")


def descriptions(structured: DataFrame) -> DataFrame:
    """(video_id, ts, description): what vision said of each analysed time; of several the last window's, empty ones left out."""
    told = structured.where("vision is not null and vision.ref <> ''")
    return told.groupBy("video_id", F.col("vision.ts").alias("ts")).agg(F.max_by("vision.ref", "t").alias("description"))


def inferences(structured: DataFrame) -> DataFrame:
    """(video_id, probe, t, ord, text, supporting_evidence, confidence, basis), one row per inference."""
    return structured.select("video_id", "probe", "t", F.posexplode("inferences").alias("ord", "x")).select("video_id", "probe", "t", "ord", "x.*")


def disagreements(structured: DataFrame) -> DataFrame:
    """(video_id, probe, t, ord, note), one row per disagreement."""
    return structured.select("video_id", "probe", "t", F.posexplode("disagreements").alias("ord", "note"))
