"""Runs: measured movement, images of packages, provider runners and their failures, the cache of answers, frames at or before."""

import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from evloom import api
from evloom.functions import scalars
from evloom.operators import correlate, ordered, package, pixels
from evloom.sources import media

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the fakes travel with the tasks
EV = f"video_id string, seq long, ts double, kind string, ref string, confidence double, end_ts double, source string, status string, x int, y int, frame_width int, frame_height int, elements array<{correlate.ELEMENT}>"


def readings(video, n=3, seq=0, status="detected"):
    return [(video, seq + i, float(i) / 5, "pointer", "x", 0.9, None, "", status, 10 + 10 * i, 10, 100, 50, None) for i in range(n)]


def test_movement_is_measured_where_it_was_asked_for(spark):
    given = ("given", 9, 0.0, "cursor_track", '{"state":"idle"}', 0.5, 1.0, "", None, None, None, None, None, None)
    ev = spark.createDataFrame([*readings("v"), *readings("one", 1), *readings("given"), given, ("v", 7, 0.2, "frame", "/f", None, None, "", *[None] * 6), ("one", 7, 0.0, "frame", "/f", None, None, "", *[None] * 6)], EV)
    asked = api.Config(cursor_intelligence_enabled=True)
    got = api.run_streams(ev, asked).where("kind = 'cursor_track'").collect()
    assert sorted({r.video_id for r in got}) == ["given", "v"]  # one reading shows no movement
    assert [r.ref for r in got if r.video_id == "given"] == ['{"state":"idle"}']  # what was handed in stays, nothing is measured beside it
    (v,) = [r for r in got if r.video_id == "v"]
    assert (v.ts, v.end_ts) == (0.0, 0.4) and '"state":"moving"' in v.ref and v.source == "cursor_intelligence"
    rows = {r.video_id: r for r in api.analyze(ev, asked)["structured"].collect()}
    assert "cursor_track" not in rows["v"].unavailable and rows["v"].observed[-1].kind == "cursor_track" and "cursor_track" in rows["one"].unavailable
    assert api.run_streams(ev).where("kind = 'cursor_track'").count() == 0
    assert api.run_streams(ev, api.Config(cursor_intelligence_enabled=True, pointer_enabled=False)).where("kind = 'cursor_track' and video_id = 'v'").count() == 0


def test_observation_reads_the_evidence_few_times(spark, tmp_path):
    spark.createDataFrame(readings("v"), EV).write.parquet(str(tmp_path / "ev"))
    ev = spark.read.parquet(str(tmp_path / "ev"))
    plan = correlate.observe(ev)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and plan.count("Exchange hashpartitioning") <= 4 and "NestedLoop" not in plan
    wide = [p for p in plan.split("ReadSchema: ")[1:] if "ref:string" in p.split("\n")[0]]
    assert len(wide) == 1  # texts are read once, the other two scans read kinds and times


POINT = "struct<text:string,kind:string,timestamp_sec:double,supporting_evidence:array<%s>,confidence:double,nature:string>" % correlate.EVIDENCE


def packaged(spark, claims, points):
    row = spark.createDataFrame([("v",)], "video_id string").selectExpr("video_id", "named_struct('source_type', 'local', 'source', '/a/My film.mp4', 'duration_sec', 60D, 'title', cast(null as string)) as source",
                                                                       f"cast(array() as array<{package.VISUAL}>) as visual_evidence", "cast(array() as array<struct<claim:int,images:array<string>>>) as claim_images")
    ev = lambda e: (e[0], e[1], e[2], None, None, e[3] if len(e) > 3 else "")
    point = lambda t, conf, es: ("x", "k", t, [ev(e) for e in es], conf, "observed")
    more = spark.createDataFrame([("v", [point(*p) for p in points], [], [point(*c) for c in claims])], f"video_id string, key_lessons array<{POINT}>, important_observations array<{POINT}>, claims array<{POINT}>")
    return row.join(more, "video_id")


def test_packages_get_images(spark):
    frames = [("v", f"e{i}", i, float(10 * i), f"/f/{i}.png") for i in range(5)]
    candidates = spark.createDataFrame(frames, "video_id string, evidence_id string, ord long, timestamp_sec double, ref string")
    facts = [("v", "/f/0.png", 1, 10.0, 8, 6, 100), ("v", "/f/1.png", 1, 11.0, 8, 6, 90), ("v", "/f/2.png", -1, 10.0, 8, 6, 80), ("v", "/f/3.png", None, None, 0, 0, 0)]
    images = spark.createDataFrame(facts, "video_id string, ref string, signature long, bright double, width int, height int, size long")
    told = spark.createDataFrame([("v", 20.5, "x" * 400), ("v", 3.0, "far")], "video_id string, ts double, description string")
    claims = [(10.0, 0.9, [(10.0, "frame", "/f/1.png"), (0.0, "vision", "seen"), (20.0, "vision", "native", "video_understanding")]), (20.0, 0.8, [(20.005, "vision", "seen"), (30.0, "frame", "/f/3.png"), (40.0, "frame", "/f/4.png")])]
    points = [(12.0, 0.6, []), (59.0, 0.7, [])]  # the second is further from every frame than half the usual gap
    got, bundle = package.illustrated(packaged(spark, claims, points), candidates, images, told)
    r = got.first()
    shown = {v.evidence_id: v for v in r.visual_evidence}
    assert [v.evidence_id for v in r.visual_evidence] == ["e1", "e2"]  # e1 is asked for twice; e0 looks like it; e3 is empty, e4 is gone
    assert shown["e1"].selection_reason == "cited by a verified claim; referenced by 2 knowledge unit(s)" and shown["e1"].image_path == "My_film_evidence/e1.png" and shown["e1"].byte_size == 90
    assert shown["e2"].description == "x" * 300 and shown["e1"].description == ""
    assert [(c.claim, c.images) for c in r.claim_images] == [(0, ["e1"]), (1, ["e2"])]
    assert sorted((b.evidence_id, b.ref) for b in bundle.collect()) == [("e1", "/f/1.png"), ("e2", "/f/2.png")]
    few = package.illustrated(packaged(spark, claims, points), candidates, images, None, 1)[0].first()
    assert [v.evidence_id for v in few.visual_evidence] == ["e1"] and [(c.claim, c.images) for c in few.claim_images] == [(0, ["e1"])]
    none = package.illustrated(packaged(spark, [], []), candidates, images)[0].first()
    assert none.visual_evidence == [] and none.claim_images == []


def test_image_facts_equal_one_at_a_time(spark):
    rng = np.random.default_rng(3)
    grays = [rng.integers(0, 256, s, dtype=np.uint8) for s in ((17, 30), (8, 9), (17, 30), (40, 7))]
    rows = [("v", f"/{i}", g.tobytes(), g.shape[1], g.shape[0], len(g.tobytes())) for i, g in enumerate(grays)] + [("v", "/bad", b"xx", 9, 9, 2), ("v", "/none", None, None, None, 0)]
    df = spark.createDataFrame(rows, "video_id string, ref string, gray binary, width int, height int, size long")
    got = {r.ref: r for r in pixels.image_facts(df).collect()}
    for i, g in enumerate(grays):
        assert (got[f"/{i}"].signature, pytest.approx(got[f"/{i}"].bright)) == pixels.signature(g)
    assert got["/bad"].signature is None and got["/bad"].width == 0 and got["/none"].bright is None and got["/bad"].size == 2


# --- providers that are not there: fakes, made once per task


class Speech:
    def transcribe(self, video):
        if video["video_id"] == "broken":
            raise OSError("no model")
        return [] if video["video_id"] == "silent" else [{"start_sec": 2.0, "end_sec": 99.0, "text": " later "}, {"start_sec": 0.0, "end_sec": 1.0, "text": "first"}]


class Reader:
    def extract_frames(self, video):
        if video["video_id"] == "broken":
            raise ValueError("corrupt")
        yield {"ts": 0, "path": "/0", "width": 4, "height": 2, "gray": bytes(8)}
        yield {"ts": 1, "path": "/1"}


class Pointer:
    def detect_pointer(self, frame, before):
        if frame["seq"] == 9:
            return {"status": "detected"}
        return {"status": "not_detected"} if before is None else {"status": "detected", "x": int(frame["ts"]), "y": int(before["ts"]), "confidence": 0.5}


class Eyes:
    def analyze_frame(self, frame, transcript_context, pointer):
        if frame["path"] == "/fail":
            raise RuntimeError("down")
        return {"description": f"{frame['path']}|{transcript_context}|{pointer and pointer['x']}", "confidence": 0.5, "low_information": frame["path"] == "/low",
                "elements": [{"kind": "button", "description": "b", "region": [0, 0, 0.5, 0.5]}, {"region": [0.5, 0, 0.1, 1], "region_confidence": "detected"}, {"region": "x"}]}


class Film:
    def analyze_video(self, video, transcript, start_sec, end_sec, prompt):
        if video["video_id"] == "broken":
            raise PermissionError("key")
        return "text" if video["video_id"] == "odd" else [{"timestamp_sec": 1.0, "description": "d", "confidence": 1}, {"timestamp_sec": 99, "description": "late", "confidence": 1}, {"description": "no time", "confidence": 1}, {"timestamp_sec": True, "description": "b", "confidence": 1}, 7]


@pytest.fixture
def videos(spark):
    rows = [("v", 10.0, True), ("mute", 5.0, False), ("silent", 5.0, True), ("broken", 5.0, True)]
    return spark.createDataFrame(rows, "video_id string, duration_sec double, has_audio boolean")


def test_speech_degrades(videos):
    heads, segments = media.transcribe(videos, Speech)
    assert {r.video_id: (r.transcript_status, r.error) for r in heads.collect()} == {"v": ("ok", None), "mute": ("no_audio", None), "silent": ("no_speech", None), "broken": ("unavailable", "OSError")}
    assert [(r.video_id, r.seg_no, r.text, r.end_sec) for r in segments.orderBy("seg_no").collect()] == [("v", 0, "first", 1.0), ("v", 1, "later", 10.0)]


def test_frames_degrade(videos):
    frames, states = media.extract_frames(videos, Reader)
    assert {r.video_id: (r.n_frames, r.error) for r in states.collect()}["broken"] == (0, "ValueError") and states.count() == 4
    assert [(r.seq, r.ts, r.path, r.width, r.reason) for r in frames.where("video_id = 'v'").orderBy("seq").collect()] == [(0, 0.0, "/0", 4, "sampled"), (1, 1.0, "/1", 0, "sampled")]


FRAMES = "video_id string, seq long, ts double, path string, width int, height int, gray binary"


def test_pointer_runner(spark):
    frames = spark.createDataFrame([("v", 0, 3.0, "/a", 8, 8, None), ("v", 1, 4.0, "/b", 8, 8, None), ("w", 0, 5.0, "/c", 8, 8, None)], FRAMES)
    got = media.detect_pointers(frames, Pointer).orderBy("video_id", "seq").collect()
    assert [(r.video_id, r.status, r.x, r.y) for r in got] == [("v", "not_detected", None, None), ("v", "detected", 4, 3), ("w", "not_detected", None, None)]
    with pytest.raises(Exception, match="no pointer reading"):
        media.detect_pointers(spark.createDataFrame([("v", 9, 0.0, "/a", 8, 8, None)], FRAMES), Pointer).collect()


def test_vision_runner(spark):
    frames = spark.createDataFrame([("v", 0, 1.0, "/a", 8, 8, None), ("v", 1, 20.0, "/low", 8, 8, None)], FRAMES)
    said = spark.createDataFrame([("v", 0, 0.0, 2.0, " hello ")], "video_id string, seg_no long, start_sec double, end_sec double, text string")
    at = spark.createDataFrame([("v", 0, 1.0, "detected", 5, 6, 0.5), ("v", 1, 1.0, "uncertain", 7, 6, 0.5), ("v", 2, 20.0, "not_detected", None, None, 0.0)], "video_id string, seq long, ts double, status string, x int, y int, confidence double")
    got = media.analyze_frames(frames, Eyes, said, at).orderBy("seq").collect()
    assert [r.description for r in got] == ["/a|hello|7", "/low||None"] and [r.status for r in got] == ["ok", "low_information"]  # the last reading of a time; what found nothing is not told
    assert [(e.region is None, e.region_confidence) for e in got[0].elements] == [(False, "approximate"), (True, "unknown"), (True, "unknown")]
    with pytest.raises(Exception, match="down"):
        media.analyze_frames(spark.createDataFrame([("v", 0, 1.0, "/fail", 8, 8, None)], FRAMES), Eyes).collect()
    for bad in ({}, {"description": "d"}, {"description": "d", "confidence": 2}, "text"):
        with pytest.raises(ValueError):
            media.vision_answer(bad)


def test_film_runner(spark):
    v = spark.createDataFrame([("v", 10.0), ("broken", 5.0), ("odd", 5.0)], "video_id string, duration_sec double")
    good, states = media.analyze_videos(v, Film)
    assert [(r.video_id, r.ts, r.source) for r in good.collect()] == [("v", 1.0, "video_understanding")]
    assert {r.video_id: (r.kept, r.dropped, r.error) for r in states.collect()} == {"v": (1, 4, None), "broken": (0, 0, "PermissionError"), "odd": (0, 0, "TypeError")}


def counting(folder):
    class Counting(Eyes):
        def analyze_frame(self, frame, transcript_context, pointer):
            with open(os.path.join(folder, f"{frame['video_id']}-{frame['seq']}-{os.urandom(4).hex()}"), "w"):
                pass
            return super().analyze_frame(frame, transcript_context, pointer)

    return Counting


def test_answers_are_kept(spark, tmp_path):
    asked, cache = tmp_path / "asked", str(tmp_path / "cache")
    asked.mkdir()
    n = lambda: len(list(asked.iterdir()))
    rows = [("v", 0, 1.0, "/a.jpg", 8, 8, None), ("v", 1, 2.0, "/b.jpg", 8, 8, None), ("v", 2, 2.0, "/b.jpg", 8, 8, None)]
    frames = spark.createDataFrame(rows, FRAMES)
    run = lambda f=frames, **more: {r.seq: r.description for r in media.analyze_cached(f, cache, counting(str(asked)), **{"model": "m", **more}).collect()}
    first = run()
    assert first == {0: "/a.jpg|None|None", 1: "/b.jpg|None|None", 2: "/b.jpg|None|None"} and n() == 2  # equal questions are asked once
    assert run() == first and n() == 2  # all held
    run(model="other")
    assert n() == 4
    run(spark.createDataFrame([("v", 0, 1.5, "/a.jpg", 8, 8, None)], FRAMES))
    assert n() == 5  # another time
    said = spark.createDataFrame([("v", 0, 0.0, 1.5, "hi")], "video_id string, seg_no long, start_sec double, end_sec double, text string")
    assert run(frames.limit(1), segments=said)[0] == "/a.jpg|hi|None" and n() == 6  # other speech
    at = spark.createDataFrame([("v", 0, 1.0, "detected", 5, 6, 0.5)], "video_id string, seq long, ts double, status string, x int, y int, confidence double")
    run(frames.limit(1), pointer=at)
    assert n() == 7
    pixels_ = spark.createDataFrame([("v", 0, 1.0, "/a.jpg", 8, 8, bytearray(64)), ("v", 1, 1.0, "/a.jpg", 8, 8, bytearray(b"\1" * 64))], FRAMES)
    run(pixels_)
    assert n() == 9  # other pixels
    parts = sorted(p for p in os.listdir(cache))
    assert run() == first and sorted(os.listdir(cache)) == parts
    for f in (tmp_path / "cache").rglob("part-*.parquet"):
        f.write_bytes(b"no parquet")
    assert run() == first and n() == 11  # what cannot be read is asked again
    with pytest.raises(Exception, match="down"):
        run(spark.createDataFrame([("v", 0, 1.0, "/fail", 8, 8, None)], FRAMES))


def test_latest_is_carried_over_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"v{i % 3}", i, float(rng.integers(0, 300)), int(i) if rng.random() < 0.2 else None) for i in range(300)]
    got = ordered.latest(spark.createDataFrame(rows, "video_id string, seq long, ts double, x long"), "x", "y", width=10.0).collect()
    last: dict = {}
    want = {}
    for v, i, _, x in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last[v] = x if x is not None else last.get(v)
        want[i] = last[v]
    assert {r.seq: r.y for r in got} == want


def test_fixed_numbers(spark):
    r = spark.range(1).select(scalars.fixed(scalars._c("id") + 0.0625, 3).alias("x")).first()
    assert r.x == f"{0.0625:.3f}"


STREAMED = "video_id string, seq long, at timestamp, px array<double>"


@pytest.mark.parametrize("cuts", [1, 2, 5])
def test_key_frames_of_a_stream_equal_the_batch(spark, tmp_path, cuts):
    from evloom.operators import folds
    from evloom.streaming import sessions

    rng = np.random.default_rng(cuts)
    rows = [(f"v{int(v)}", i, 1_700_000_000 + i + int(d), [float(x)]) for i, (v, d, x) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 8, 200), rng.integers(0, 6, 200), strict=True))]
    rows.append(("end", 999, 1_700_009_999, [0.0]))  # lets the watermark pass all others
    df = spark.createDataFrame(rows, "video_id string, seq long, t long, px array<double>").selectExpr("video_id", "seq", "timestamp_seconds(t) as at", "px")
    step = -(-len(rows) // cuts)
    root, out = None, None
    for c in range(cuts):  # each cut is a run of its own that goes on from the checkpoint
        df.where(f"seq >= {c * step} and seq < {(c + 1) * step} or (seq = 999 and {c} = {cuts - 1})").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(STREAMED).parquet(f"{tmp_path}/in")
        out = sessions.drain(sessions.keyframe_stream(stream, 1.5, "20 seconds"), "append", "k", str(tmp_path / "job"))
    want = folds.keyframe_dedupe(df.selectExpr("video_id", "seq", "cast(unix_micros(at) as double) as ts", "px"), 1.5, 1e30).where("video_id <> 'end'")
    assert sorted((r.video_id, r.seq) for r in out.collect() if r.video_id != "end") == sorted((r.video_id, r.seq) for r in want.collect())


def test_sources_on_this_machine(spark, tmp_path):
    class Fetch:
        told = []

        def describe(self, url):
            return {"id": "abc", "title": "A film"}

        def fetch(self, url, path):
            self.told.append(url)
            with open(path, "wb") as f:
                f.write(b"film")

    for _ in range(2):  # the second time the copy is used
        got = media.resolve("https://h/x", str(tmp_path / "media"), Fetch())
    assert got["source_type"] == "url" and got["title"] == "A film" and got["path"].endswith("abc.mp4") and Fetch.told == ["https://h/x"]
    local = tmp_path / "own.mp4"
    local.write_bytes(b"x")
    assert media.resolve(str(local), "unused")["source_type"] == "local"
    with pytest.raises(ValueError):
        media.resolve("https://h/x", str(tmp_path))
    row = bytes([10, 20, 30, 200, 100, 50, 0, 0])  # two BGR pixels and padding to four bytes
    bmp = b"BM" + (54 + 8).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + row
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.bmp").write_bytes(bmp)
    (tmp_path / "img" / "b.bmp").write_bytes(b"no picture")
    good, bad = media.image_frames(spark, str(tmp_path / "img"))
    (r,) = good.collect()
    assert (r.width, r.height, list(r.gray)) == (2, 1, [round(10 * 0.114 + 20 * 0.587 + 30 * 0.299), round(200 * 0.114 + 100 * 0.587 + 50 * 0.299)])
    assert [b.error for b in bad.collect()] in ([], ["image could not be decoded"])  # what the reader cannot decode it may leave out


def test_selection_grid_and_effective_values(spark):
    frames = spark.createDataFrame([("v", i, float(i), [float(i % 2 * 50)] * 4) for i in range(20)], "video_id string, seq long, ts double, px array<double>")
    got = [r.seq for r in api.select_frames(frames, api.Config(max_frames=5, keyframe_diff_threshold=10.0)).orderBy("seq").collect()]
    assert len(got) == 5 and got[0] == 0 and got[-1] == 19
    videos = spark.createDataFrame([("v", 10.0)], "video_id string, duration double")
    last = spark.createDataFrame([("v", 9.5)], "video_id string, ts double")
    assert [r.ts for r in api.change_grid(videos, last, api.Config(visual_change_interval_sec=4.0)).orderBy("i").collect()] == [0.0, 4.0, 8.0, 9.5]
    for bad in (api.Config(visual_change_interval_sec=0.0), api.Config(visual_change_max_samples=1)):
        with pytest.raises(ValueError):
            api.change_grid(videos, None, bad)
    told = api.Config(max_frames=3).effective(vision=Eyes(), transcriber=None)
    assert told["max_frames"] == 3 and told["providers"] == {"vision": "Eyes", "transcriber": None} and told["tolerance_sec"] == 1.0


def test_overlaps_of_streams_equal_the_batch(spark, tmp_path):
    from evloom.operators import temporal
    from evloom.streaming import sessions

    rng = np.random.default_rng(4)
    rows = [(f"v{rng.integers(0, 3)}", i, 1_700_000_000 + 3 * i + int(rng.integers(0, 20)), int(rng.integers(0, 40))) for i in range(240)]
    df = spark.createDataFrame(rows, "video_id string, seq long, a long, n long")
    kind = "video_id string, seq long, ts timestamp, end_ts timestamp"
    out = None
    for c in range(3):  # each third is a run of its own that goes on from the checkpoint
        some = df.where(f"seq >= {80 * c} and seq < {80 * c + 80}").selectExpr("video_id", "seq", "timestamp_seconds(a) as ts", "timestamp_seconds(a + n) as end_ts").coalesce(1)
        some.where("seq % 2 = 0").write.mode("append").parquet(f"{tmp_path}/w")
        some.where("seq % 2 = 1").write.mode("append").parquet(f"{tmp_path}/s")
        w = spark.readStream.schema(kind).parquet(f"{tmp_path}/w").selectExpr("video_id", "seq as probe", "ts as t")
        s = spark.readStream.schema(kind).parquet(f"{tmp_path}/s")
        out = sessions.drain(sessions.overlap_stream(s, w, 5.0, 40.0, "30 minutes").select("video_id", "probe", "seq"), "append", "o", str(tmp_path / "job"))
    spans = df.where("seq % 2 = 1").selectExpr("video_id", "seq", "cast(a as double) as start_sec", "cast(a + n as double) as end_sec")
    windows = df.where("seq % 2 = 0").selectExpr("video_id", "seq as probe", "a - 5D as lo", "a + 5D as hi")
    want = temporal.interval_join(windows, spans, 10.0).select("video_id", "probe", "seq")
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100


class _Handle:
    """The state of one group in plain Python; counts the calls."""

    def __init__(self):
        self.calls, self.state, self.timers = 0, {}, set()

    def getListState(self, name, schema):
        return _Cell(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _Cell:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _call(self, new=None, keep=False):
        self.handle.calls += 1
        if not keep:
            self.handle.state[self.name] = new

    def appendList(self, new):
        self._call([*(self.handle.state.get(self.name) or []), *new])

    def put(self, new):
        self._call(new)

    update = put

    def clear(self):
        self._call()

    def get(self):
        self._call(keep=True)
        found = self.handle.state.get(self.name)
        return iter(found or []) if self.name == "waiting" else found

    def exists(self):
        self._call(keep=True)
        return bool(self.handle.state.get(self.name))


def test_key_frames_of_many_videos_take_few_calls_to_the_state():
    """One group holds many videos of several sizes: results as by video, calls by micro-batch."""
    from types import SimpleNamespace

    import pandas as pd

    from evloom.streaming import sessions

    rng = np.random.default_rng(5)
    rows = [(None if v == 7 else f"v{v}", i, int(us), rng.integers(0, 5, 1 + v % 3 * 20).astype(float)) for i, (v, us) in enumerate(zip(rng.integers(0, 60, 3000), rng.integers(0, 500, 3000) * 1000, strict=True))]
    fold, handle, got = sessions.KeyframeFold(1.6), _Handle(), []
    fold.init(handle)
    for cut, mark in ((rows[:1000], 0), (rows[1000:], 0), ([], 250), ([], 600)):
        if cut:
            df = pd.DataFrame(cut, columns=["video_id", "seq", "us", "px"])
            list(fold.handleInputRows((1,), iter([df.iloc[:600], df.iloc[600:]]), None))
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.remove(at)
            got += [r for out in fold.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None) for r in out.itertuples(index=False, name=None)]
    want = []
    for v in {r[0] for r in rows}:
        last = None
        for _, seq, us, px in sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1])):
            if last is None or np.abs(px - last).sum() / len(px) > 1.6:
                last = px
                want.append((v, seq, us))
    key = lambda r: r[1]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert handle.calls < 40
