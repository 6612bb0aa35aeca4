"""Sessions, contracts, packages, sources and the job folder."""

import json
import os
import threading

import pytest

from evloom.operators import contracts, knowledge, session_store, synthesis
from evloom.sources import media
from evloom.streaming import worker

DOC = {
    "format_version": 1, "created_at": "2026-01-01T00:00:00+00:00", "engine_version": "1", "source": {"source_type": "local", "source": "/a.mp4", "duration_sec": 9.0},
    "video": {"width": 64, "height": 48, "fps": 5.0, "has_audio": True},
    "evidence": [{"timestamp_sec": 2.0, "kind": "vision", "ref": "b"}, {"timestamp_sec": 1.0, "kind": "frame", "ref": "a", "confidence": 0.5}, {"timestamp_sec": 2.0, "kind": "vision", "ref": "b"}],
}


def test_session_round_trip(tmp_path, spark):
    doc = session_store.parse_session(json.dumps(DOC))
    assert [e["ref"] for e in doc["evidence"]] == ["a", "b"]
    path = session_store.save_session(doc, str(tmp_path / "x.session.json"))
    assert session_store.parse_session(open(path).read()) == doc
    with pytest.raises(session_store.SessionError):
        session_store.save_session(doc, path)
    (tmp_path / "bad.session.json").write_text("{")
    good, bad = session_store.read_sessions(spark, str(tmp_path))
    assert good.count() == 2 and bad.count() == 1


@pytest.mark.parametrize(
    "change",
    [{"format_version": 2}, {"format_version": True}, {"extra": 1}, {"video": {"width": 1, "height": 1, "fps": 1, "has_audio": 1}}, {"evidence": [{"timestamp_sec": -1, "kind": "frame", "ref": ""}]},
     {"evidence": [{"timestamp_sec": 1, "kind": "smell", "ref": ""}]}, {"evidence": [{"timestamp_sec": 2, "timestamp_end_sec": 1, "kind": "frame", "ref": ""}]}, {"source": {}}, {"analysis": {"x": [1]}}],
)
def test_strict_session(change):
    with pytest.raises(session_store.SessionError):
        session_store.parse_session(json.dumps({**DOC, **change}))


def test_contracts(spark):
    df = spark.createDataFrame([("moving", 0.0, 1.0, "moving", 0.9, 10.0, 0.1), ("uncertain", 0.0, 1.0, "gap", 0.0, None, None), ("stationary", 0.0, 1.0, "", 2.0, 360.0, 0.0)],
                               "motion_state string, start_sec double, end_sec double, basis string, confidence double, direction_deg double, mean_speed_norm double")
    good, bad = contracts.validate(df, "cursor_segment")
    assert good.count() == 2
    assert {r.rule for r in bad.collect()} == {"cursor_state", "cursor_basis", "cursor_confidence", "cursor_direction"}
    with pytest.raises(Exception, match="cursor_state"):
        contracts.validate(df, "cursor_segment", strict=True)[0].collect()


def test_package_files(tmp_path, spark):
    from evloom import api
    from evloom.operators import package

    v = spark.createDataFrame([("v", "https://h/Talk 1.mp4", "url", 61.5, None)], "video_id string, source string, source_type string, duration_sec double, title string")
    seg = spark.createDataFrame([("v", 0, 0.0, 3.0, "Warning: never open the window, window"), ("v", 1, 3.0, 4.0, None)], "video_id string, seg_no long, start_sec double, end_sec double, text string")
    ev = spark.createDataFrame([("v", 0, 1.0, "frame", "/f/a.jpg", None, None, ""), ("v", 1, 0.0, "transcript", "Warning", None, 3.0, "")], "video_id string, seq long, ts double, kind string, ref string, confidence double, end_ts double, source string")
    rows = api.process(v, seg, ev, api.Config(generated_at="now"))["packages"].drop("violation")
    (path,) = package.save(rows, str(tmp_path))
    doc = json.load(open(path))
    assert os.path.basename(path) == "Talk_1.json" and doc["semantic_summary"] is None and doc["processing"]["generated_at"] == "now" and doc["key_lessons"][0]["kind"] == "warning"
    text = knowledge.render_markdown(doc)
    assert "## Topics\n\nWindow" in text and "- **[warning]** (0.0s) Warning: never open the window, window" in text and "- Transcript status: ok" in text
    with pytest.raises(ValueError, match="no generated_at"):
        package.save(rows.withColumn("processing", rows.processing.withField("generated_at", rows.source.title)), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_probe_errors(spark):
    ok = {"streams": [{"codec_type": "video", "codec_name": "h264", "width": 64, "height": 48, "avg_frame_rate": "30/0"}], "format": {"duration": "3.5"}}
    rows = [("/a.mp4", json.dumps(ok)), ("https://x/b", json.dumps({"streams": [], "format": {"duration": "1"}})), ("/c", None)]
    got = {r.path: r for r in media.probes(spark.createDataFrame(rows, "path string, probe string")).collect()}
    assert (got["/a.mp4"].error, got["/a.mp4"].fps, got["/a.mp4"].has_audio, got["/a.mp4"].source_type) == (None, 0.0, False, "local")
    assert got["https://x/b"].error == "no video stream" and got["https://x/b"].source_type == "url" and got["/c"].error == "unreadable container"


def test_samples_and_reads(spark):
    q = spark.createDataFrame([("v", 1, 0.0, 2.0, 0.5, 1.6, 10.0)], "video_id string, request long, start_sec double, end_sec double, interval double, duration double, fps double")
    assert sorted(r.t for r in media.window_samples(q).collect()) == [0.0, 0.5, 1.0, 1.5]
    fr = spark.createDataFrame([("v", 0.0), ("v", 90000.0)], "video_id string, ts double")
    rq = spark.createDataFrame([("v", 1, 5.0), ("v", 2, 86401.0), ("v", 3, 1e6)], "video_id string, request long, t double")
    assert {r.request: r.frame_ts for r in media.read_at(rq, fr).collect()} == {1: 0.0, 2: 0.0, 3: 90000.0}


def job(root, name, **over):
    (root / "inbox").mkdir(parents=True, exist_ok=True)
    (root / "inbox" / f"{name}.json").write_text(json.dumps({"source": "https://u:p@h/x?k=1", "config": {"vision": False}} | over))


def made(job, folder, text="{}", session=None):
    os.makedirs(f"{folder}/output", exist_ok=True)
    open(f"{folder}/output/p.json", "w").write(text)
    if session is not None:
        os.makedirs(f"{folder}/session", exist_ok=True)
        open(f"{folder}/session/x.session.json", "w").write(session)
    return {"package": "output/p.json"}


def test_worker(tmp_path, spark):
    settings = {"vision": bool, "interval": (int, float)}
    job(tmp_path, "b", config={"vision": 1})
    job(tmp_path, "a")
    job(tmp_path, "bad id")
    seen = []
    run = lambda: worker.run_once(str(tmp_path), lambda j, d: seen.append(j) or made(j, d), settings, ("vision",), spark)
    first, second = run(), run()
    assert first["status"] == "succeeded" and first["source"] == "https://h/x?<redacted>" and second["status"] == "failed" and second["error"]["type"] == "InvalidJob"
    assert json.load(open(tmp_path / "done" / "a" / "status.json"))["outputs"] == {"package": "output/p.json", "session": None}
    assert run() is None and (tmp_path / "inbox" / "bad id.json.invalid-id").exists()
    job(tmp_path, "a")
    assert run() is None and (tmp_path / "inbox" / "a.json.duplicate").exists() and len(seen) == 1


def test_worker_records_what_really_ran(tmp_path, spark):
    from evloom.api import Config

    def process(asked, folder):
        return made(asked, folder)

    process.effective = lambda config: Config(vision_enabled=config["vision"]).effective(vision=tmp_path)
    job(tmp_path, "a")
    got = worker.run_once(str(tmp_path), process, {"vision": bool}, (), spark)
    assert got["config"]["vision_enabled"] is False and got["config"]["max_frames"] == 20 and got["config"]["providers"] == {"vision": type(tmp_path).__name__}
    store = worker.Store(str(tmp_path), spark)
    for text in ("one", "two"):  # replaced in one step, nothing is left beside it
        store.write("done/note", text)
        assert store.read("done/note") == text
    assert sorted(p for p in os.listdir(tmp_path / "done") if "note" in p) == ["note"]


@pytest.mark.parametrize(("text", "session", "asked", "status"), [("{}", None, False, "succeeded"), ("{", None, False, "failed"), ("{}", None, True, "failed"), ("{}", "{", True, "failed"), ("{}", json.dumps(DOC), True, "succeeded")])
def test_worker_gate(tmp_path, spark, text, session, asked, status):
    job(tmp_path, "g", session=asked)
    got = worker.run_once(str(tmp_path), lambda j, d: made(j, d, text, session), {"vision": bool, "interval": float}, (), spark)
    assert got["status"] == status and (tmp_path / ("done" if status == "succeeded" else "failed") / "g" / "status.json").exists()


def test_worker_records_an_interrupt(tmp_path, spark):
    job(tmp_path, "k")

    def stop(j, d):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        worker.run_once(str(tmp_path), stop, {"vision": bool, "interval": float}, (), spark)
    assert json.load(open(tmp_path / "failed" / "k" / "status.json"))["status"] == "failed" and (tmp_path / "failed" / "k" / "traceback.txt").exists()


def test_worker_claims_once(tmp_path, spark):
    job(tmp_path, "one")
    got = []
    threads = [threading.Thread(target=lambda: got.append(worker.run_once(str(tmp_path), made, {"vision": bool, "interval": float}, (), spark))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(x is not None for x in got) == 1


def test_worker_stream(tmp_path, spark):
    for name in ("s1", "s2"):
        job(tmp_path, name)
    worker.run_stream(str(tmp_path), made, {"vision": bool, "interval": float}, (), spark)
    assert sorted(os.listdir(tmp_path / "done")) == ["s1", "s2"]


def test_streaming_band_join(spark, tmp_path):
    from pyspark.sql import functions as F

    from evloom.streaming import sessions

    for name, col, at in (("p", "ts", [1000, 1005, 1100]), ("w", "t", [1003, 1300])):
        spark.createDataFrame([("v", i, x) for i, x in enumerate(at)], "video_id string, id long, s long").select("video_id", F.col("id").alias(name), F.timestamp_seconds("s").alias(col)).write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    out = sessions.drain(sessions.correlate_stream(read("p"), read("w"), 3.0), "append", "band")
    assert sorted((r.w, r.p) for r in out.collect()) == [(0, 0), (0, 1)]
