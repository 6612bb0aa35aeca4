"""Entry points, correlation, packages, briefs, scenes and the workspace."""

import json

import numpy as np
import pytest

from evloom import api
from evloom.functions import evidence as fn
from evloom.functions import refs
from evloom.operators import correlate, measure, package, session_store, synthesis
from evloom.sources import workspace

EV = "video_id string, seq long, ts double, kind string, ref string, confidence double, end_ts double, source string"
ST = EV + f", status string, x int, y int, frame_width int, frame_height int, elements array<{correlate.ELEMENT}>"
BUTTON = ("button", "Save", (0.4, 0.4, 0.6, 0.6), "detected")


def evidence(spark):
    rows = [("v", 0, 5.0, "frame", "/f/a.jpg", None, None, ""), ("v", 1, 4.7, "pointer", "x", 0.9, None, ""), ("v", 2, 4.0, "transcript", "said", None, 5.5, ""), ("v", 3, 9.0, "vision", "seen", 0.5, None, "video_understanding")]
    return spark.createDataFrame(rows, EV)


def streams(spark, *rows):
    full = [("v", i, ts, kind, more.get("ref", kind), more.get("confidence"), more.get("end"), more.get("source", ""), more.get("status"), more.get("x"), more.get("y"), *((100, 50) if kind == "pointer" else (None, None)), more.get("elements")) for i, (ts, kind, more) in enumerate(rows)]
    return spark.createDataFrame(full, ST)


def window(spark, *rows, tol=1.0, configured=()):
    times = spark.createDataFrame([("v", 0, 5.0)], "video_id string, probe long, t double")
    return correlate.observe(streams(spark, *rows), tol, configured, times).first()


def test_analyze(spark):
    out = api.analyze(evidence(spark))
    first = out["structured"].where("t = 5.0").first()
    assert [e.kind for e in first.observed] == ["frame", "transcript", "pointer"] and first.frame_path == "/f/a.jpg" and first.transcript_context == "said"
    assert first.unavailable == ["vision"]  # streams that nobody asked for are not missing
    asked = api.analyze(evidence(spark), api.Config(visual_change_enabled=True, cursor_intelligence_enabled=True, video_understanding=True))
    rows = {r.t: r for r in asked["structured"].collect()}
    assert rows[5.0].unavailable == ["vision", "video_understanding", "visual_change", "cursor_track"] and rows[9.0].unavailable == ["frame", "transcript", "pointer", "visual_change", "cursor_track"]
    with pytest.raises(ValueError):
        api.analyze(evidence(spark), api.Config(tolerance_sec=0.0))


def test_nearest_first_usable_after(spark):
    bad, good = {"status": "failed"}, {"status": "ok", "ref": "far", "confidence": 0.5}
    assert window(spark, (5.1, "vision", bad), (5.2, "vision", good)).unavailable == ["frame", "transcript", "pointer", "vision"]
    r = window(spark, (5.1, "vision", bad), (5.2, "vision", good | {"source": "video_understanding"}))
    assert "vision" not in r.unavailable and r.observed[0].source == "video_understanding" and r.vision.ref == "far"
    gone = window(spark, (5.0, "pointer", {"status": "not_detected"}), (5.1, "pointer", {"status": "detected", "x": 1, "y": 1}))
    assert "pointer" in gone.unavailable and gone.pointer is None
    r = window(spark, (5.0, "visual_change", {"status": "unavailable"}), configured=("visual_change",))
    assert not r.observed and r.unavailable[-1] == "visual_change"
    edge = window(spark, (4.0, "frame", {}), (6.0, "frame", {}), (3.0, "transcript", {"end": 4.0}), (1.0, "cursor_track", {"end": 4.0}), configured=("cursor_track",))
    assert [e.kind for e in edge.observed] == ["frame", "cursor_track"] and edge.observed[0].timestamp_sec == 4.0  # ties go to the earlier; speech overlaps strictly, movement touches
    with pytest.raises(ValueError):
        window(spark, configured=("smell",))


def test_pointer_rules(spark):
    see = lambda status="ok", conf=0.5: (5.0, "vision", {"status": status, "confidence": conf, "elements": [("text", "t", None, "unknown"), BUTTON]})
    at = lambda ts, x, y, status="detected": (ts, "pointer", {"status": status, "x": x, "y": y, "confidence": 0.7})
    r = window(spark, see(conf=0.33333), at(5.0, 50, 25))
    (i,) = r.inferences
    assert i.basis == "pointer_in_vision_region" and i.confidence == round(0.7 * 0.33333, 4) and [e.ref for e in i.supporting_evidence] == ["x=50, y=25", "button: Save"] and not r.disagreements
    r = window(spark, see(), at(5.0, 1, 1))
    assert not r.inferences and r.disagreements == ["pointer position (0.010, 0.020) is in none of the 1 located region(s)"]
    assert len(window(spark, see()).disagreements) == 1 and not window(spark, see("low_information"), at(5.0, 50, 25)).inferences
    said = (4.5, "transcript", {"end": 5.5, "ref": "hello"})
    moved = window(spark, said, at(4.2, 10, 10), at(4.6, 20, 10), at(5.4, 40, 10), (5.6, "pointer", {"status": "not_detected"}))
    assert [(i.basis, i.confidence, len(i.supporting_evidence)) for i in moved.inferences] == [("speech_pointer_motion", 0.75, 4)] and "0.300" in moved.inferences[0].text
    assert not window(spark, said, at(4.2, 10, 10), at(4.6, 20, 10, "uncertain"), at(5.4, 40, 10)).inferences  # the way in between is unknown
    assert not window(spark, at(4.2, 10, 10), at(5.4, 40, 10)).inferences


def test_retrieval_arguments(spark):
    ev = evidence(spark)
    assert [r.kind for r in api.evidence_between(ev, 4.5, 5.0).orderBy("pos").collect()] == ["transcript", "pointer", "frame"]
    assert api.evidence_near(ev, 9, 0).count() == 1 and [r.kind for r in api.evidence_near(ev, 5.6, 0.1).collect()] == ["transcript"]
    for bad in ((True, 1.0), (float("nan"), 1.0), (1.0, -1.0), (-1.0, 1.0)):
        with pytest.raises(ValueError):
            api.evidence_near(ev, *bad)
    with pytest.raises(ValueError):
        api.evidence_between(ev, 2.0, 1.0)
    plan = api.evidence_near(ev, 5.0, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


V = "video_id string, source string, source_type string, duration_sec double, title string"
SEG = "video_id string, seg_no long, start_sec double, end_sec double, text string"


def test_process(spark, tmp_path):
    v = spark.createDataFrame([("v", "/a.mp4", "local", 61.5, None, 640, 360, 25.0, True), ("w", "/b.mp4", "local", 5.0, "Silent", 640, 360, 25.0, False)], V + ", width int, height int, fps double, has_audio boolean")
    s = spark.createDataFrame([("v", 0, 0.0, 3.0, "Warning: never open the window"), ("v", 1, 3.0, 6.0, "the window stays closed"), ("v", 2, 6.0, 9.0, "Warning: never open the window")], SEG)
    answers = spark.createDataFrame([("v", json.dumps({"provider": "p", "summary": "about windows", "claims": [{"text": "keep it shut", "nature": "observed", "evidence_ids": ["e0"], "confidence": 0.9}, {"text": "?", "nature": "observed", "evidence_ids": ["e99"]}]}), None)], "video_id string, answer string, error string")
    out = api.process(v, s, evidence(spark), api.Config(visual_change_enabled=True, generated_at="now", session=True), answers)
    got = {r.video_id: r for r in out["packages"].collect()}
    a, b = got["v"], got["w"]
    assert a.violation is None and b.violation is None
    assert a.topics == ["Window", "Warning", "Never", "Open"] and len(a.key_lessons) == 1 and a.key_lessons[0].kind == "warning" and a.key_lessons[0].supporting_evidence[0].ref == a.key_lessons[0].text
    assert a.summary.startswith("/a.mp4: a 62s local video. 1 notable") and a.processing.stages_unavailable == ["vision", "visual_change"] and a.processing.frame_count == 1
    assert a.semantic_summary == "about windows" and [c.text for c in a.claims] == ["keep it shut"] and a.synthesis.claims_rejected == 1 and a.synthesis.status == "ok"
    assert [(e.kind, e.timestamp_sec, len(e.ref)) for e in a.evidence] == [("transcript", 0.0, len(a.key_lessons[0].text)), ("transcript", 0.0, len(a.claims[0].supporting_evidence[0].ref))]  # the lesson's sentence, the claim's chunk
    assert b.summary == "Silent: a 5s local video. No speech was available to analyze." and any("No semantic synthesis" in x for x in b.limitations) and any("No usable speech" in x for x in b.limitations)
    prompt = {r.video_id: r.prompt for r in out["prompts"].collect()}["v"]
    assert "[e0] transcript @ 0.0s: Warning: never open the window the window stays closed Warning: never open the window\n[e1] frame @ 5.0s" in prompt and "STREAMS MISSING IN PARTS: vision, visual_change" in prompt
    for r in out["sessions"].collect():
        doc = session_store.parse_session(r.document)
        assert doc["analysis"]["tolerance_sec"] == 1.0 and r.name.endswith(".session.json") and (r.video_id == "w" or "transcript" in {e["kind"] for e in doc["evidence"]})
    packages = out["packages"].drop("violation")
    assert package.export_packages(packages, str(tmp_path / "out")) == 2 and spark.read.text(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="invalid duration"):
        package.export_packages(packages.withColumn("source", packages.source.withField("duration_sec", packages.source.duration_sec * 0)), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_claims(spark):
    brief = spark.createDataFrame([("v", "e0", 1.0, "transcript", "a", 0.6, None, ""), ("v", "e1", 1.0, "visual_change", "b", None, None, "")], "video_id string, evidence_id string, timestamp_sec double, kind string, ref string, confidence double, timestamp_end_sec double, source string")
    conflicts = spark.createDataFrame([("v", 30.0)], "video_id string, c double")

    def check(**claim):
        row = {"text": "t", "nature": "observed", "evidence_ids": ["e0"], **claim}
        rows = synthesis.answer_rows("v", json.dumps({"claims": [row]}), None)[1:]
        raw = spark.createDataFrame([(r["video_id"], r["ord"], r["is_object"], r["text"], r["kind"], r["nature"], r["timestamp_sec"], r["timestamp_end_sec"], r["confidence"], r["evidence_ids"], r["limitations"], 40.0) for r in rows],
                                    "video_id string, ord long, is_object boolean, text string, kind string, nature string, timestamp_sec string, timestamp_end_sec string, confidence string, evidence_ids array<string>, limitations array<string>, duration_sec double")
        return synthesis.verify(raw, brief, conflicts).first()

    c = check(nature=" Observed ", timestamp_end_sec=3, limitations=[" x "])
    assert c.reason is None and c.status == "observed" and c.confidence == 0.5 and c.timestamp_end_sec == 3.0 and c.limitations == ["x", synthesis.SPEECH_NOTE] and c.kind == "fact"
    assert check(evidence_ids=["e1"]).status == "inferred" and check(evidence_ids=["e0", "e1"]).verification == "speech_evidence_with_measured_change"
    assert check(timestamp_sec=28.5).status == "conflicting" and check(confidence=0.9).confidence == 0.6 and check(timestamp_end_sec=99).timestamp_end_sec is None
    void = check(nature="unavailable", evidence_ids=[])
    assert (void.reason, void.status, void.confidence, void.verification) == (None, "unavailable", 0.0, "unverifiable_no_evidence_cited")
    for claim, said in (
        ({"text": " "}, "claim has no text"), ({"nature": "sure"}, "invalid claim nature 'sure'"), ({"evidence_ids": ["z", "e9"]}, "cites evidence id(s) that do not exist: e9, z"), ({"evidence_ids": []}, "claim cites no evidence"),
        ({"timestamp_sec": "soon"}, "claim timestamp is not a number"), ({"timestamp_sec": None}, "claim timestamp is not a number"), ({"timestamp_sec": 42}, "timestamp 42.00s falls outside the source duration 40.00s"),
        ({"confidence": 2}, "claim confidence out of range: 2.0"), ({"text": "iVBORw0KGgo"}, "unusable claim: " + synthesis.MEDIA), ({"limitations": ["data:image/png;base64,"]}, "unusable claim: " + synthesis.MEDIA),
    ):
        assert check(**claim).reason == said


def test_images_for_claims(spark):
    wants = spark.createDataFrame([("v", 0, 0, 5), ("v", 0, 1, 6), ("v", 0, 2, 7)], "video_id string, claim long, pos long, frame_id long")
    kept = spark.createDataFrame([("v", 5, 5), ("v", 6, 5), ("v", 8, 8)], "video_id string, seq long, superseded_by long")
    assert package.link_images(wants, kept).first().images == [5]


def test_files(tmp_path):
    with workspace.Workspace(str(tmp_path / "job")) as w:
        open(w.path("frames") + "/a.jpg", "wb").write(b"xy")
        assert w.size() == 2 and not w.cleanup()
        rows = package.copy_bundle([{"evidence_id": "e1", "path": w.path("frames") + "/a.jpg"}, {"evidence_id": "e2", "path": "/nope"}], str(tmp_path / "p_evidence"))
    assert [r["image_path"] for r in rows] == ["p_evidence/e1.jpg"] and not (tmp_path / "job").exists()
    assert workspace.transform_token((0, 0, 2, 2), None) == "c0,0,2,2:s-"


def test_cursor_motion_from_pixels(spark):
    rows = []
    for i in range(7):
        g = np.full((240, 320), 90, np.uint8)
        g[100:110, 20 + 30 * i : 30 + 30 * i] = 255
        rows.append(("v", i, i * 0.5, 320, 240, g.tobytes()))
    df = spark.createDataFrame(rows, "video_id string, seq long, ts double, width int, height int, gray binary")
    readings, segments = api.analyze_cursor_motion(df)
    s = [r for r in segments.collect() if r.motion_state == "moving"]
    assert len(s) == 1 and s[0].direction_deg == 0.0 and s[0].basis == "consecutive_detections_displaced" and readings.count() == 7


def track(spark, points, tracks=None, **kw):
    rows = [("v", i, float(t), status, x, y, 100, 100, c) for i, (t, status, x, y, c) in enumerate(points)]
    df = spark.createDataFrame(rows, "video_id string, seq long, ts double, status string, x int, y int, frame_width int, frame_height int, confidence double")
    t = None if tracks is None else spark.createDataFrame(tracks, "video_id string, start_sec double, end_sec double")
    return measure.cursor_segments(df, tracks=t, **kw).orderBy("start_sec", "island").collect()


def test_movement_segments(spark):
    at = lambda t, x, y, c=0.8: (t, "detected", x, y, c)
    (one,) = track(spark, [at(0, 0, 0), at(1, 30, 30), at(2, 60, 60, 0.5)])
    assert (one.motion_state, one.direction_deg, one.basis) == ("moving", 45.0, "consecutive_detections_displaced") and one.confidence == round((0.8 + 0.8 + 0.5) / 3, 4) and one.mean_speed_norm == 0.3
    (square,) = track(spark, [at(0, 0, 0), at(1, 50, 0), at(2, 50, 50), at(3, 0, 50)])
    assert square.direction_deg is None and square.basis.endswith("heading_varies") and square.confidence == 0.8
    (single,) = track(spark, [at(0, 0, 0), at(1, 0, -0 + 50)])
    assert single.direction_deg == 90.0 and single.confidence == 0.4
    few = track(spark, [at(3, 1, 1)], [("v", 0.0, 9.0), ("w", 1.0, 2.0)])
    assert [(r.video_id, r.start_sec, r.end_sec, r.basis, r.confidence) for r in few] == [("v", 0.0, 9.0, "too_few_samples", 0.0), ("w", 1.0, 2.0, "no_pointer_samples", 0.0)]
    tiled = track(spark, [at(1, 0, 0), at(2, 50, 0), at(3, 51, 0), (3, "uncertain", 1, 1, 0.1), at(9, 1, 1)], [("v", 0.0, 10.0)])
    assert [r.basis for r in tiled] == ["not_sampled", "consecutive_detections_displaced", "displacement_within_jitter", "zero_elapsed_time", "sampling_gap", "not_sampled"]
    assert [a.end_sec for a in tiled[:-1]] == [b.start_sec for b in tiled[1:]] and all(r.confidence == 0 and r.mean_speed_norm is None for r in tiled if r.motion_state == "uncertain")
    with pytest.raises(ValueError):
        track(spark, [], max_interval=0.0)


def test_evidence_rows(spark):
    df = spark.createDataFrame([("ok", "", "/p", 0.5, 1.0, "moving", 10.0, 0.25, "displacement"), (None, "u", "/p", 2.5, 1.0, "uncertain", None, None, "gap")], "status string, source string, path string, ts double, fps double, motion_state string, direction_deg double, mean_speed_norm double, basis string")
    a, b = df.select(fn.usable().alias("u"), fn.source_of().alias("s"), fn.frame_index().alias("i"), refs.cursor_ref().alias("r")).collect()
    assert (a.u, a.s, a.i) == (True, "/p", 0) and (b.u, b.s, b.i) == (False, "u", 2)
    assert a.r == '{"basis":"displacement","direction_deg":10.0,"speed_norm":0.25,"state":"moving"}' and '"direction_deg":null' in b.r
    assert fn.change_method(0.08) == "luma_absdiff>25/area>=0.08"

    class Broken:
        def synthesize(self, brief):
            raise RuntimeError("down")

    class Wrong:
        def synthesize(self, brief):
            return {"claims": 3}

    assert synthesis.ask(None, {})["error"] == "no synthesizer" and synthesis.ask(Broken(), {})["error"] == "synthesizer raised RuntimeError: down"
    assert synthesis.answer_rows("v", synthesis.ask(Wrong(), {})["answer"], None)[0]["fault"] == "'claims' is not a list"
    assert synthesis.answer_rows("v", "```json\n{\"claims\": []}\n```", None)[0]["fault"] is None and synthesis.answer_rows("v", "no", None)[0]["fault"] == "malformed provider response"


def test_change_references(spark):
    kind = "kind string, status string, magnitude double, earlier double, later double, regions array<struct<x1:double,y1:double,x2:double,y2:double>>, detail string"
    box = (0.1, 0.2, 0.33333, 0.5)
    rows = [("visual_change", "unavailable", None, 1.0, 2.0, [], "né"), ("visual_change_localized", "detected", 0.00012, 12345678.0, 12345680.5, [box] * 30, "")]
    for got, r in zip(spark.createDataFrame(rows, kind).select(refs.change_ref().alias("r")).collect(), rows, strict=True):
        want = {"kind": r[0], "status": r[1], "magnitude": None if r[2] is None else round(r[2], 4), "compared": [r[3], r[4]], "regions": [[round(v, 4) for v in b] for b in r[5]]} | ({"detail": r[6]} if r[6] else {})
        left = 0
        while len(text := json.dumps(want, sort_keys=True, separators=(",", ":"))) > 400:
            want["regions"].pop()
            left += 1
            want["regions_omitted"] = left
        assert got.r == text
