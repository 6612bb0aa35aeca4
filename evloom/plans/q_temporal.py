"""Queries over evidence on the time axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from evloom.operators import correlate, ordered, temporal

from . import q_measure, views
from .registry import query
from .views import EV, PT, SG, SP, ST, windowed

TOL = 21600.0
_CANON = "ts, coalesce(end_ts, ts), kind, source, ref, coalesce(confidence, -1.0)"
_ROWS = "video_id, probe, t, ts, kind, ref, confidence, end_ts, source"
_NEAR = f"""
hits AS (SELECT DISTINCT p.video_id, p.probe, p.t, e.ts, e.kind, e.ref, e.confidence, e.end_ts, e.source FROM probes p JOIN ev e ON e.video_id = p.video_id
  AND ((e.end_ts IS NULL AND abs(e.ts - p.t) <= {TOL}) OR (e.end_ts IS NOT NULL AND e.ts <= p.t + {TOL} AND e.end_ts >= p.t - {TOL})) WHERE true {{extra}})
SELECT {_ROWS}, row_number() OVER (PARTITION BY video_id, probe ORDER BY {_CANON}) - 1 AS pos FROM hits"""
_PROBES = "probes AS (SELECT video_id, seq AS probe, ts AS t FROM ev WHERE kind = 'frame')"


def probes(ev):
    return ev.where("kind = 'frame'").select("video_id", F.col("seq").alias("probe"), F.col("ts").alias("t"))


@query("evidence_near_batch", f"WITH {EV}, {_PROBES}, {_NEAR.format(extra='')}")
def evidence_near_batch(spark, sf_dir):
    ev = views.evidence(spark, sf_dir)
    return temporal.evidence_near(ev, probes(ev), TOL)


@query("evidence_filter_kind_source", f"WITH {EV}, {_PROBES}, {_NEAR.format(extra='''AND e.kind IN ('pointer', 'transcript') AND e.source = 'video_understanding' ''')}")
def evidence_filter_kind_source(spark, sf_dir):
    ev = views.evidence(spark, sf_dir)
    return temporal.evidence_near(ev, probes(ev), TOL, kinds=["pointer", "transcript"], sources="video_understanding")


@query(
    "evidence_between_batch",
    f"""WITH {EV}, w AS (SELECT video_id, seq AS probe, ts AS lo, ts + 86400.0 AS hi FROM ev WHERE kind = 'vision'),
hits AS (SELECT DISTINCT w.video_id, w.probe, w.lo, w.hi, e.ts, e.kind, e.ref, e.confidence, e.end_ts, e.source FROM w JOIN ev e ON e.video_id = w.video_id AND e.ts <= w.hi AND coalesce(e.end_ts, e.ts) >= w.lo)
SELECT video_id, probe, lo, hi, ts, kind, ref, confidence, end_ts, source, row_number() OVER (PARTITION BY video_id, probe ORDER BY {_CANON}) - 1 AS pos FROM hits""",
)
def evidence_between_batch(spark, sf_dir):
    ev = views.evidence(spark, sf_dir)
    w = ev.where("kind = 'vision'").select("video_id", F.col("seq").alias("probe"), F.col("ts").alias("lo"), (F.col("ts") + 86400.0).alias("hi"))
    return temporal.evidence_between(ev, w)


@query(
    "canonical_evidence",
    f"""WITH {EV}, d AS (SELECT DISTINCT video_id, ts, kind, ref, confidence, end_ts, source FROM ev)
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {_CANON}) - 1 AS pos FROM d""",
)
def canonical_evidence(spark, sf_dir):
    ev = views.evidence(spark, sf_dir).drop("seq")
    return temporal.canonical(ev.unionByName(ev.where("kind = 'pointer'")), ("video_id",))


def _nearest_sql(a: str, b: str, tol: float, order: str) -> str:
    return f"""SELECT p.video_id, p.seq AS probe, p.ts AS t, e.seq AS near_seq, e.ts AS near_ts FROM {a} p LEFT JOIN LATERAL
  (SELECT seq, ts FROM {b} e WHERE e.video_id = p.video_id AND abs(e.ts - p.ts) <= {tol} ORDER BY {order} LIMIT 1) e ON true"""


@query("nearest_frame", f"WITH {EV}, a AS (SELECT * FROM ev WHERE kind = 'pointer'), b AS (SELECT * FROM ev WHERE kind = 'frame') {_nearest_sql('a', 'b', TOL, 'abs(e.ts - p.ts), e.ts, e.seq')}")
def nearest_frame(spark, sf_dir):
    ev = views.evidence(spark, sf_dir)
    p = ev.where("kind = 'pointer'").select("video_id", F.col("seq").alias("probe"), F.col("ts").alias("t"))
    out = temporal.nearest(p, ev.where("kind = 'frame'").select("video_id", "ts", "seq"), TOL, ("video_id", "probe"), ("seq", "ts"))
    return out.select("video_id", "probe", "t", F.col("near.seq").alias("near_seq"), F.col("near.ts").alias("near_ts"))


_ODD = "a AS (SELECT video_id, seq, ts + 1.0::DOUBLE AS ts FROM fr), b AS (SELECT video_id, seq, ts FROM fr)"


@query("nearest_tie_earlier", f"WITH {views.FR}, {_ODD} {_nearest_sql('a', 'b', 30.0, 'abs(e.ts - p.ts), e.ts, e.seq')}")
def nearest_tie_earlier(spark, sf_dir):
    fr = views.frames(spark, sf_dir).drop("px")
    p = fr.select("video_id", F.col("seq").alias("probe"), (F.col("ts") + 1.0).alias("t"))
    out = temporal.nearest(p, fr, 30.0, ("video_id", "probe"), ("seq", "ts"))
    return out.select("video_id", "probe", "t", F.col("near.seq").alias("near_seq"), F.col("near.ts").alias("near_ts"))


@query("nearest_tie_later", f"WITH {views.FR}, {_ODD} {_nearest_sql('a', 'b', 30.0, 'abs(e.ts - p.ts), e.seq DESC')}")
def nearest_tie_later(spark, sf_dir):
    """A key point's nearest frame, ties to the last candidate."""
    fr = views.frames(spark, sf_dir).drop("px")
    p = fr.select("video_id", F.col("seq").alias("probe"), (F.col("ts") + 1.0).alias("t"))
    out = temporal.nearest(p, fr, 30.0, ("video_id", "probe"), ("seq", "ts"), later=True)
    return out.select("video_id", "probe", "t", F.col("near.seq").alias("near_seq"), F.col("near.ts").alias("near_ts"))


@query(
    "all_within_tolerance",
    f"""WITH {EV} SELECT p.video_id, p.seq AS probe, e.seq, e.ts FROM ev p JOIN ev e ON p.video_id = e.video_id AND p.kind = 'frame' AND e.kind = 'pointer' AND abs(e.ts - p.ts) <= {TOL}""",
)
def all_within_tolerance(spark, sf_dir):
    ev = views.evidence(spark, sf_dir)
    return temporal.band_join(probes(ev), ev.where("kind = 'pointer'").select("video_id", "seq", "ts"), TOL).select("video_id", "probe", "seq", "ts")


@query(
    "span_overlap",
    f"""WITH {SP}, w AS (SELECT CAST(o_custkey AS VARCHAR) AS video_id, o_orderkey AS probe, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 1.0::DOUBLE AS t FROM orders)
SELECT w.video_id, w.probe, sp.seq, sp.start_sec, sp.end_sec FROM w JOIN sp ON w.video_id = sp.video_id AND sp.start_sec <= w.t + 15 AND sp.end_sec >= w.t - 15 AND sp.start_sec <= sp.end_sec""",
)
def span_overlap(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    w = o.select(F.col("o_custkey").cast("string").alias("video_id"), F.col("o_orderkey").alias("probe"), F.expr("datediff(cast(o_orderdate as date), date'1992-01-01') * 1.0D").alias("t"))
    w = w.withColumn("lo", F.col("t") - 15).withColumn("hi", F.col("t") + 15)
    return temporal.interval_join(w, views.spans(spark, sf_dir), 30.0).select("video_id", "probe", "seq", "start_sec", "end_sec")


_TURNS = "pr AS (SELECT video_id, seg_no AS probe, start_sec + 3.0::DOUBLE AS t FROM sg)"


def _turns(spark, sf_dir):
    sg = views.segments(spark, sf_dir)
    return sg, sg.select("video_id", F.col("seg_no").alias("probe"), (F.col("start_sec") + 3.0).alias("t"))


@query("speech_strict_overlap", f"WITH {SG}, {_TURNS} SELECT pr.video_id, probe, seg_no FROM pr JOIN sg ON pr.video_id = sg.video_id AND start_sec < t + 3 AND end_sec > t - 3")
def speech_strict_overlap(spark, sf_dir):
    sg, p = _turns(spark, sf_dir)
    w = p.withColumn("lo", F.col("t") - 3).withColumn("hi", F.col("t") + 3)
    return temporal.interval_join(w, sg, 6.0, strict=True).select("video_id", "probe", "seg_no")


@query(
    "segment_at",
    f"""WITH {SG}, {_TURNS} SELECT pr.video_id, probe, t, s.seg_no FROM pr LEFT JOIN LATERAL (SELECT seg_no FROM sg WHERE sg.video_id = pr.video_id AND start_sec <= t AND end_sec >= t ORDER BY seg_no LIMIT 1) s ON true""",
)
def segment_at(spark, sf_dir):
    sg, p = _turns(spark, sf_dir)
    return temporal.segment_at(p, sg, ("video_id", "probe")).select("video_id", "probe", "t", F.col("segment.seg_no").alias("seg_no"))


@query(
    "text_around",
    f"""WITH {SG}, {_TURNS} SELECT pr.video_id, probe, coalesce((SELECT string_agg(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), ' ' ORDER BY start_sec, seg_no) FROM sg
  WHERE sg.video_id = pr.video_id AND start_sec < t + 5 AND end_sec > t - 5), '') AS said FROM pr""",
)
def text_around(spark, sf_dir):
    sg, p = _turns(spark, sf_dir)
    return temporal.text_around(p, sg, ("video_id", "probe")).select("video_id", "probe", "said")


_WIN = windowed(TOL)
_CALLS = ("video_understanding", "visual_change", "cursor_track")
_OBSERVED = """o AS (SELECT video_id, probe, t, ts, kind, CASE WHEN kind = 'pointer' THEN 'x=' || x || ', y=' || y || ' (status=' || status || ')' ELSE ref END AS ref,
  CASE WHEN kind <> 'frame' THEN confidence END AS confidence, CASE WHEN kind = 'cursor_track' THEN end_ts END AS end_ts, CASE WHEN kind IN ('visual_change', 'cursor_track') OR native THEN source ELSE '' END AS source,
  CASE kind WHEN 'frame' THEN 1 WHEN 'transcript' THEN 2 WHEN 'pointer' THEN 3 WHEN 'vision' THEN CASE WHEN native THEN 5 ELSE 4 END WHEN 'visual_change' THEN 6 ELSE 7 END AS slot, seq, 0 AS part FROM nr
  WHERE CASE kind WHEN 'frame' THEN rk = 1 WHEN 'pointer' THEN rk = 1 AND status <> 'not_detected' WHEN 'vision' THEN rk = 1 AND status IN ('ok', 'low_information') WHEN 'visual_change' THEN status <> 'unavailable' ELSE true END),
el AS (SELECT o.* REPLACE (x.said AS ref, x.p AS part) FROM o, (VALUES ('text: a line', 1), ('button: the button', 2)) x(said, p) WHERE kind = 'vision' AND (p = 1 OR seq % 2 = 0)),
every AS (SELECT * FROM o UNION ALL SELECT * FROM el),
fl AS (SELECT *, row_number() OVER (PARTITION BY video_id, probe ORDER BY slot, ts, coalesce(end_ts, ts), seq, part) - 1 AS pos FROM every)"""


def _structured(spark, sf_dir):
    return correlate.observe(views.streams(spark, sf_dir), TOL, _CALLS)


@query("structured_observed", f"WITH {_WIN}, {_OBSERVED} SELECT video_id, probe, t, pos, ts, kind, ref, confidence, end_ts, source FROM fl")
def structured_observed(spark, sf_dir):
    return correlate.flattened(_structured(spark, sf_dir))


@query(
    "stage_unavailable",
    f"""WITH {_WIN}, {_OBSERVED}, s(stage, place) AS (VALUES ('frame', 1), ('transcript', 2), ('pointer', 3), ('vision', 4), ('video_understanding', 5), ('visual_change', 6), ('cursor_track', 7)),
k AS (SELECT DISTINCT video_id, probe, kind AS stage FROM o UNION SELECT DISTINCT video_id, probe, 'video_understanding' FROM o WHERE slot = 5)
SELECT w.video_id, w.probe, string_agg(s.stage, ',' ORDER BY place) FILTER (WHERE k.stage IS NULL) AS unavailable FROM w CROSS JOIN s LEFT JOIN k ON k.video_id = w.video_id AND k.probe = w.probe AND k.stage = s.stage GROUP BY ALL""",
)
def stage_unavailable(spark, sf_dir):
    return _structured(spark, sf_dir).select("video_id", "probe", F.nullif(F.array_join("unavailable", ","), F.lit("")).alias("unavailable"))


@query(
    "multimodal_rows",
    f"""WITH {_WIN}, {_OBSERVED}, sp AS (SELECT video_id, probe, string_agg(ref, ' ' ORDER BY ts, seq) AS said FROM o WHERE slot = 2 GROUP BY ALL), d AS (SELECT video_id, probe, arg_min(ref, pos) AS d FROM fl WHERE kind = 'vision' GROUP BY ALL)
SELECT w.video_id, w.probe, w.t, nullif(said, '') AS transcript_context, coalesce(d, '') AS description, f.ref AS frame_path, p.seq AS pointer_seq, coalesce(v.seq, n.seq) AS vision_seq FROM w LEFT JOIN sp USING (video_id, probe) LEFT JOIN d USING (video_id, probe)
LEFT JOIN (SELECT * FROM o WHERE slot = 1) f USING (video_id, probe) LEFT JOIN (SELECT * FROM o WHERE slot = 3) p USING (video_id, probe) LEFT JOIN (SELECT * FROM o WHERE slot = 4) v USING (video_id, probe) LEFT JOIN (SELECT * FROM o WHERE slot = 5) n USING (video_id, probe)""",
)
def multimodal_rows(spark, sf_dir):
    m = _structured(spark, sf_dir)
    return m.select("video_id", "probe", "t", "transcript_context", "description", "frame_path", F.col("pointer.seq").alias("pointer_seq"), F.col("vision.seq").alias("vision_seq"))


_REGION = """rg AS (SELECT np.video_id, np.probe, np.t, np.seq, np.x / 1000.0::DOUBLE AS nx, np.y / 500.0::DOUBLE AS ny, np.confidence AS pc, nv.confidence AS vc, np.x, np.y FROM np JOIN nv USING (video_id, probe)
  WHERE nv.status = 'ok' AND nv.seq % 2 = 0 AND np.status <> 'not_detected')"""


@query(
    "pointer_in_region",
    f"""WITH {_WIN}, {_REGION} SELECT video_id, probe, 'x=' || x || ', y=' || y || ' + button: the button' AS cited, CAST(printf('%.4f', pc * vc) AS DOUBLE) AS confidence,
'The pointer lay inside the region that vision located as ''the button'' (button). That supports, without proving it, that this element was referred to or used.' AS text FROM rg WHERE nx BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE AND ny BETWEEN 0.0::DOUBLE AND 0.5::DOUBLE""",
)
def pointer_in_region(spark, sf_dir):
    found = correlate.inferences(_structured(spark, sf_dir)).where(F.col("basis") == correlate.IN_REGION)
    return found.select("video_id", "probe", F.expr("array_join(transform(supporting_evidence, e -> e.ref), ' + ')").alias("cited"), "confidence", "text")


@query(
    "region_disagreements",
    f"""WITH {_WIN}, {_REGION} SELECT video_id, probe, 'pointer position (' || printf('%.3f', nx) || ', ' || printf('%.3f', ny) || ') is in none of the 1 located region(s)' AS note FROM rg WHERE NOT (nx BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE AND ny BETWEEN 0.0::DOUBLE AND 0.5::DOUBLE)
UNION ALL SELECT nv.video_id, nv.probe, 'vision located element(s), but no pointer evidence of this window confirms any use of them' FROM nv LEFT JOIN np USING (video_id, probe) WHERE nv.status = 'ok' AND nv.seq % 2 = 0 AND coalesce(np.status, 'not_detected') = 'not_detected'""",
)
def region_disagreements(spark, sf_dir):
    return correlate.disagreements(_structured(spark, sf_dir)).select("video_id", "probe", "note")


@query(
    "speech_pointer_motion",
    f"""WITH {windowed(86400.0)}, speech AS (SELECT video_id, probe, count(*) AS spoken FROM ob WHERE kind = 'transcript' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, probe ORDER BY ts, seq) AS i FROM ob WHERE kind = 'pointer'),
b AS (SELECT video_id, probe, min(i) FILTER (WHERE status = 'detected') AS a, max(i) FILTER (WHERE status = 'detected') AS z, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT b.video_id, b.probe, z - a + 1 AS run, n, bool_and(status = 'detected') AS ok, arg_min(x, i) AS x0, arg_max(x, i) AS x1, arg_min(y, i) AS y0, arg_max(y, i) AS y1
  FROM b JOIN r ON r.video_id = b.video_id AND r.probe = b.probe AND i BETWEEN a AND z GROUP BY ALL),
m AS (SELECT *, sqrt(pow(x1 / 1000.0::DOUBLE - x0 / 1000.0::DOUBLE, 2) + pow(y1 / 500.0::DOUBLE - y0 / 500.0::DOUBLE, 2)) AS way FROM g JOIN speech USING (video_id, probe))
SELECT video_id, probe, 'There was speech while the pointer moved across the frame (normalized displacement ' || printf('%.3f', way) || ').' AS text, CAST(printf('%.4f', run / n::DOUBLE) AS DOUBLE) AS confidence, spoken + run::BIGINT AS cited
FROM m WHERE ok AND run >= 2 AND way > 0.03""",
)
def speech_pointer_motion(spark, sf_dir):
    found = correlate.inferences(correlate.observe(views.streams(spark, sf_dir), 86400.0)).where(F.col("basis") == correlate.MOTION)
    return found.select("video_id", "probe", "text", "confidence", F.size("supporting_evidence").cast("long").alias("cited"))


@query("change_stream", f"WITH {ST} SELECT video_id, seq, ts, ref, confidence, source FROM st WHERE kind = 'visual_change' AND status <> 'unavailable'")
def change_stream(spark, sf_dir):
    return correlate.change_stream(views.streams(spark, sf_dir)).select("video_id", "seq", "ts", "ref", "confidence", "source")


@query(
    "vision_descriptions",
    f"""WITH {_WIN}, c AS (SELECT * FROM nv WHERE status IN ('ok', 'low_information') UNION ALL SELECT nn.* FROM nn LEFT JOIN nv USING (video_id, probe) WHERE nn.status IN ('ok', 'low_information') AND coalesce(nv.status, '') NOT IN ('ok', 'low_information'))
SELECT video_id, ts, arg_max(ref, t) AS description FROM c WHERE ref <> '' GROUP BY ALL""",
)
def vision_descriptions(spark, sf_dir):
    """P10: what vision said of each analysed time."""
    return correlate.descriptions(_structured(spark, sf_dir))


@query(
    "session_windows",
    f"""WITH {EV}, w AS (SELECT video_id, ts AS t, CASE WHEN seq % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS tol, seq FROM ev WHERE kind IN ('frame', 'vision'))
SELECT video_id, t, tol, row_number() OVER (PARTITION BY video_id ORDER BY t, tol, seq) - 1 AS pos FROM w""",
)
def session_windows(spark, sf_dir):
    ev = views.evidence(spark, sf_dir).where("kind in ('frame', 'vision')")
    w = ev.select("video_id", F.col("ts").alias("t"), F.expr("case when seq % 2 = 0 then 1.0D else 0.5D end").alias("tol"), "seq")
    return ordered.placed(w, ("seq",), order=("t", "tol", "seq")).select("video_id", "t", "tol", F.col("i").cast("long").alias("pos"))


@query("query_timestamps", f"WITH {_WIN} SELECT video_id, probe, t FROM w")
def query_timestamps(spark, sf_dir):
    """Frame times, or segment starts where a video has no frames, with the times of usable native answers."""
    return correlate.windows(views.streams(spark, sf_dir))


@query(
    "run_motion",
    f"""WITH {PT}, {q_measure.INTERVALS}, {q_measure.ISLANDS} SELECT video_id, start_sec AS ts, end_sec AS end_ts, motion_state AS state, basis, confidence, 'cursor_intelligence' AS source FROM moved""",
)
def run_motion(spark, sf_dir):
    """A run that is asked for cursor movement and comes without any measures it from its own pointer readings."""
    from evloom import api

    pt = views.pointer(spark, sf_dir).withColumns({"kind": F.lit("pointer"), "ref": F.lit("at"), "end_ts": F.lit(None).cast("double"), "source": F.lit("")})
    ran = api.run_streams(pt, api.Config(cursor_intelligence_enabled=True, cursor_max_interval_sec=q_measure.GAP)).where("kind = 'cursor_track'")
    return ran.select("video_id", "ts", "end_ts", F.get_json_object("ref", "$.state").alias("state"), F.get_json_object("ref", "$.basis").alias("basis"), "confidence", "source")


@query(
    "keyframe_stream",
    """WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS seq, epoch_us(ts) AS us, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
k AS (SELECT video_id, i, seq, us, v AS last, true AS kept FROM o WHERE i = 1 UNION ALL SELECT o.video_id, o.i, o.seq, o.us, CASE WHEN abs(o.v - k.last) > 60.0 THEN o.v ELSE k.last END, abs(o.v - k.last) > 60.0 FROM k JOIN o ON o.video_id = k.video_id AND o.i = k.i + 1)
SELECT video_id, seq, us FROM k WHERE kept AND us < (SELECT max(us) // 1000 * 1000 - 3600000000 FROM o)""",
)
def keyframe_stream(spark, sf_dir):
    """2.14: key frames of a stream by typed state and event-time timers: what the watermark has passed, as the batch fold has it."""
    from evloom.streaming import sessions

    return sessions.event_keyframes(spark, sf_dir)


@query("overlap_stream", f"WITH {EV} SELECT p.video_id, p.seq AS probe, e.seq FROM ev p JOIN ev e ON p.video_id = e.video_id AND p.kind = 'frame' AND e.kind = 'transcript' AND e.ts <= p.ts + {TOL} AND e.end_ts >= p.ts - {TOL}")
def overlap_stream(spark, sf_dir):
    """2.14: spans that overlap the windows of a stream, both sides with watermarks."""
    from evloom.streaming import sessions

    return sessions.event_overlaps(spark, sf_dir, TOL)
