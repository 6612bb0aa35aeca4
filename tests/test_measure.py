"""Cursor, pixel and fold measurements on exact fixtures."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evloom.functions import scalars
from evloom.operators import folds, measure, pixels

RD = "video_id string, seq long, ts double, status string, x int, y int, frame_width int, frame_height int, confidence double"


def readings(spark, xy, step=0.5):
    rows = [("v", i, i * step, "detected" if p else "not_detected", *(p or (None, None)), 300, 400, 0.9) for i, p in enumerate(xy)]
    return spark.createDataFrame(rows, RD)


def test_moving_right(spark):
    s = measure.cursor_segments(readings(spark, [(30 * i, 10) for i in range(5)])).collect()
    assert [(r.motion_state, r.start_sec, r.end_sec, r.direction_deg) for r in s] == [("moving", 0.0, 2.0, 0.0)]
    assert s[0].mean_speed_norm == pytest.approx(0.12)


def test_reasons_in_order(spark):
    s = measure.cursor_intervals(readings(spark, [(0, 0), None, (0, 0), (1, 0), (200, 0)])).orderBy("i").collect()
    assert [r.basis for r in s] == ["pointer_not_observed", "pointer_not_observed", "displacement_within_jitter", "moving"]
    far = measure.cursor_intervals(readings(spark, [(0, 0), (200, 0)], step=5.0)).first()
    assert far.basis == "sampling_gap"


def textured():
    return np.random.default_rng(1).integers(70, 186, (360, 640)).astype(np.uint8)


def test_changed_rectangle_is_found_exactly():
    a = textured()
    b = a.copy()
    b[60:180, 100:260] = (b[60:180, 100:260].astype(int) + 128) % 256
    assert pixels.compared(a[None], b[None], 0.08) == [(19200 / 230400, [(100, 60, 260, 180)])]


def test_two_rectangles_larger_first_and_glyphs_join():
    a = textured()
    b = a.copy()
    for y1, y2, x1, x2 in ((10, 110, 20, 110), (200, 300, 400, 540)):
        b[y1:y2, x1:x2] = (b[y1:y2, x1:x2].astype(int) + 128) % 256
    assert [x[0] for x in pixels.compared(a[None], b[None], 0.08)[0][1]] == [400, 20]
    c = a.copy()
    for i in range(8):
        c[100:116, 200 + 14 * i : 210 + 14 * i] = (c[100:116, 200 + 14 * i : 210 + 14 * i].astype(int) + 128) % 256
    assert pixels.compared(a[None], c[None], 0.001)[0][1] == [(200, 100, 308, 116)]


GRAY = "video_id string, seq long, ts double, width int, height int, gray binary"


def film(spark, *rasters, video="v", step=1.0):
    rows = [(video, i, i * step, *((None, None, None) if g is None else (g.shape[1], g.shape[0], g.tobytes()))) for i, g in enumerate(rasters)]
    return spark.createDataFrame(rows, GRAY)


def test_thresholds_are_exact(spark):
    a = np.full((100, 100), 100, np.uint8)
    few, many = a.copy(), a.copy()
    few.ravel()[:799] = 200
    many.ravel()[:800] = 200
    got = pixels.visual_changes(film(spark, a, a + 25, a - 1, a, few, a, many, a[:50], None, a)).orderBy("seq").collect()
    assert [r.magnitude for r in got[:3]] == [0.0, 1.0, 0.0] and got[1].kind == "visual_change_global" and got[1].confidence == 1.0 and got[0].confidence == 1.0
    assert [r.status for r in got] == ["not_detected", "detected", "not_detected", "not_detected", "not_detected", "detected", "unavailable", "unavailable", "unavailable"]
    assert [(r.x1, r.y1, r.x2, r.y2) for r in got[5].regions] == [(0.0, 0.0, 1.0, 0.08)] and got[5].kind == "visual_change_localized"
    assert got[6].detail == "frame sizes differ: 100x100 and 100x50" and got[7].detail == "frame could not be read" and got[7].magnitude is None and got[7].confidence == 0.0
    for bad in (0, -1.0, 1.5, True):
        with pytest.raises(ValueError):
            pixels.visual_changes(film(spark, a), bad)


def test_blocks_of_rasters_meet_at_their_borders(spark):
    rng = np.random.default_rng(8)
    shots = [rng.integers(0, 256, (6, 8), dtype=np.uint8) for _ in range(25)]
    a = film(spark, *shots, step=7.0).unionByName(film(spark, *shots[:3], video="w", step=1000.0)).unionByName(film(spark, shots[0], video="one"))
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(pixels.visual_changes(a, width=1e9))
    assert len(whole) == 26 and key(pixels.visual_changes(a, width=20.0)) == whole and key(pixels.visual_changes(a, width=1.0)) == whole
    plan = pixels.visual_changes(a)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Window" in x and "gray" in x]
    wrong = a.withColumn("seq", -a.seq)
    for broken in (lambda: pixels.visual_changes(wrong, width=20.0).collect(), lambda: measure.frame_changes(wrong.selectExpr("video_id", "seq", "ts", "array(1D) as px")).collect()):
        with pytest.raises(Exception, match="follows frame"):
            broken()


def square(i, w=320, h=240):
    g = np.full((h, w), 90, np.uint8)
    g[100:110, 40 + 30 * i : 50 + 30 * i] = 255
    return g


def test_pointer_of_two_frames_and_around_a_moment(spark):
    df = film(spark, *[square(i) for i in range(6)], np.full((240, 320), 90, np.uint8), step=0.5)
    two = pixels.two_frame_pointer(df).orderBy("seq").collect()
    assert [(r.status, r.confidence) for r in two] == [("not_detected", 0.0), *[("uncertain", 0.55)] * 5, ("detected", 0.75)]
    asked = spark.createDataFrame([("v", 1, 1.0), ("v", 2, 0.0), ("v", 3, 1.2), ("w", 4, 1.0)], "video_id string, request long, t double")
    got = {r.request: (r.status, r.x, r.y, r.confidence) for r in pixels.pointer_around(asked, df, 0.5).collect()}
    assert got == {1: ("detected", 105, 105, 0.9), 2: ("not_detected", None, None, 0.0), 3: ("detected", 105, 105, 0.9), 4: ("not_detected", None, None, 0.0)}
    whole = sorted(map(str, pixels.track_pointer(df).collect()))
    assert sorted(map(str, pixels.track_pointer(df, width=0.9, fold_width=1.1).collect())) == whole


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 5)), min_size=1, max_size=60), st.sampled_from([1.0, 4.0, 100.0]))
def test_folds_in_blocks_equal_the_sequence(spark, rows, width):
    frames = [(f"v{v}", i, float(t), [float(x), 0.0]) for i, (v, t, x) in enumerate(rows)]
    want = []
    for v in {r[0] for r in frames}:
        last = None
        for r in sorted((r for r in frames if r[0] == v), key=lambda r: (r[2], r[1])):
            if last is None or abs(r[3][0] - last) / 2 > 1.0:
                want.append((v, r[1]))
                last = r[3][0]
    got = folds.keyframe_dedupe(spark.createDataFrame(frames, "video_id string, seq long, ts double, px array<double>"), 1.0, width)
    assert sorted((r.video_id, r.seq) for r in got.collect()) == sorted(want)
    said = [(f"v{v}", i, float(t), float(t + x), "a") for i, (v, t, x) in enumerate(rows)]
    want = {}
    for v in {r[0] for r in said}:
        start, chunk = None, -1
        for _, i, a, b, _ in (r for r in said if r[0] == v):
            if start is None:
                start, chunk = a, chunk + 1
            want[i] = (chunk, start)
            start = None if b - start >= 20 else start
    got = folds.transcript_chunks(spark.createDataFrame(said, "video_id string, seg_no long, start_sec double, end_sec double, text string"), 20.0, width)
    assert {r.seg_no: (r.chunk, r.chunk_start) for r in got.collect()} == want


def test_a_still_picture_is_few_rounds(spark, monkeypatch):
    rounds = []
    real = folds._left
    monkeypatch.setattr(folds, "_left", lambda *a: rounds.append(1) or real(*a))
    f = spark.range(400).selectExpr("'v' as video_id", "id as seq", "cast(id as double) as ts", "array(if(id = 390, 9D, 1D)) as px")
    assert sorted(r.seq for r in folds.keyframe_dedupe(f, 1.0, 5.0).collect()) == [0, 390, 391] and len(rounds) <= 5


def test_labels_and_dilation_match_a_slow_form():
    rng = np.random.default_rng(0)
    for _ in range(5):
        m = rng.random((17, 23)) < 0.25
        lab, n = pixels.label(m)
        seen, count = np.zeros_like(m), 0
        for y, x in np.argwhere(m):
            if not seen[y, x]:
                count += 1
                todo, group = [(y, x)], []
                seen[y, x] = True
                while todo:
                    cy, cx = todo.pop()
                    group.append((cy, cx))
                    for ny in range(max(0, cy - 1), min(17, cy + 2)):
                        for nx in range(max(0, cx - 1), min(23, cx + 2)):
                            if m[ny, nx] and not seen[ny, nx]:
                                seen[ny, nx] = True
                                todo.append((ny, nx))
                assert len({lab[p] for p in group}) == 1
        assert n == count
        d = pixels.dilate(m, 2)
        assert all(d[y, x] == m[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for y in range(17) for x in range(23))


def test_pointer_follows_a_moving_square(spark):
    rows = []
    for i in range(6):
        g = np.full((240, 320), 90, np.uint8)
        g[100:110, 40 + 30 * i : 50 + 30 * i] = 255
        rows.append(("v", i, i * 0.5, 320, 240, g.tobytes()))
    df = spark.createDataFrame(rows, "video_id string, seq long, ts double, width int, height int, gray binary")
    got = pixels.track_pointer(df).orderBy("seq").collect()
    assert [r.status for r in got] == ["not_detected", *["detected"] * 4, "not_detected"]
    assert all((r.x, r.y) == (45 + 30 * r.seq, 105) for r in got[1:5])


def test_folds(spark):
    f = spark.createDataFrame([("v", i, float(i), [float(v)] * 4) for i, v in enumerate([0, 5, 11, 12, 25])], "video_id string, seq long, ts double, px array<double>")
    assert [r.seq for r in folds.keyframe_dedupe(f, 10.0).orderBy("seq").collect()] == [0, 2, 4]
    rows = [("v", 0, 0, 0, 10.0, 5), ("v", 1, 1, 3, 10.0, 6), ("v", 2, 2, None, None, 5), ("v", 3, 3, 1, 10.0, 0), ("v", 4, 4, 2**40 - 1, 10.0, 7), ("v", 5, 5, 1, 10.0, 8), ("v", 6, 6, -1, 90.0, 9)]
    c = spark.createDataFrame(rows, "video_id string, rank long, seq long, signature long, bright double, size long")
    assert {r.seq: r.superseded_by for r in folds.bundle(c, most=2).collect()} == {0: 0, 1: 0, 2: 0, 4: 4}  # by bits, by size; nothing after the second kept one
    assert {r.seq: r.superseded_by for r in folds.bundle(c).collect()} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 0, 6: 6}


def test_spread_keeps_ends(spark):
    f = spark.createDataFrame([("v", i, float(i)) for i in range(50)], "video_id string, seq long, ts double")
    for limit in (1, 2, 20, 50, 60):
        got = sorted(r.seq for r in measure.even_spread(f, limit).collect())
        want = sorted({(2 * i * 49 + limit - 1) // (2 * (limit - 1)) for i in range(limit)}) if 1 < limit < 50 else list(range(50))[: max(1, limit)]
        assert got == want


def test_even_span(spark):
    cases = [((0, 1, 160), (0, 160)), ((0.5, 1, 160), (80, 80)), ((0, 0.5, 90), (0, 46)), ((0.7, 0.9, 10), (6, 4)), ((0.5, 0.5001, 100), (50, 2)), ((0.9, 1, 5), (2, 2)), ((0, 1, 161), (0, 160))]
    df = spark.createDataFrame([(float(a), float(b), n) for (a, b, n), _ in cases], "lo double, hi double, size int")
    got = [tuple(r) for r in df.select(*scalars.even_span("lo", "hi", "size")).collect()]
    assert got == [w for _, w in cases]


def test_scalars(spark):
    df = spark.createDataFrame([("https://user:pw@host.example:8443/watch?v=abc123&X-Amz-Signature=SECRET&token=t0k#frag", " \t x y \n", 2.675)], "u string, s string, n double")
    r = df.select(scalars.public_url("u").alias("u"), scalars.py_strip("s").alias("s"), scalars.py_round("n", 2).alias("n"), scalars.redact_url("u").alias("r")).first()
    assert r.u == "https://host.example:8443/watch?v=abc123" and r.s == "x y" and r.n == 2.67
    assert r.r == "https://host.example:8443/watch?<redacted>"


def test_python_rounding(spark):
    from evloom.functions import scalars

    xs = [2.675, 0.125, 0.5, 1.5, 2.5, 1e-5, 0.00015, 12345678.0, 1e16, 1.0005, -2.675, 0.0, *[i / 1024 for i in range(2000)]]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.py_round("x", 2).alias("a"), scalars.py_round("x", 3).alias("b"), scalars.py_repr("x").alias("t")).collect():
        assert (r.a, r.b, r.t) == (round(r.x, 2), round(r.x, 3), repr(r.x))
    assert [r[0] for r in spark.createDataFrame([("é\n",), ("\U0001f600",)], "v string").select(scalars.json_text("v")).collect()] == ['"\\u00e9\\n"', '"\\ud83d\\ude00"']


def test_blocks_join_up(spark):
    from evloom.operators import ordered

    at = [0.0, 1.0, 1.0, 9.0, 25.0, 25.5, 99.0]
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate(at)], "video_id string, seq long, ts double")
    got = ordered.placed(df, ("seq",), width=10.0).orderBy("i").collect()
    assert [r.seq for r in got] == [r.i for r in got] == list(range(7)) and [r.before and r.before.seq for r in got] == [None, 0, 1, 2, 3, 4, 5] and [r.after and r.after.seq for r in got] == [1, 2, 3, 4, 5, 6, None]
    assert [r.s for r in ordered.running(df, "seq", "s", width=10.0).orderBy("seq").collect()] == [0, 1, 3, 6, 10, 15, 21]


def test_segment_words(spark):
    rows = [("v", 0, -1.0, 2.0, [("a", -1.0, -0.5), ("b", 0.5, 1.0)], 10.0), ("v", 1, 9.0, 12.34567, [("c", 10.5, 11.0)], 10.0), ("v", 2, 1.23456, 2.0, None, 10.0), ("v", 3, 10.0, 11.0, None, 10.0)]
    df = spark.createDataFrame(rows, "video_id string, seg_no long, start_sec double, end_sec double, words array<struct<text:string,start_sec:double,end_sec:double>>, duration double")
    got = {r.seg_no: r for r in measure.clamp_segments(df).collect()}
    assert sorted(got) == [0, 1, 2] and got[0].start_sec == 0.0 and [w.text for w in got[0].words] == ["b"] and got[1].words is None and got[1].end_sec == 10.0 and got[2].start_sec == 1.23456


def test_signature_bits():
    g = np.tile(np.arange(90, dtype=np.uint8) * 2, (80, 1))
    bits, mean = pixels.signature(g)
    assert bits == -1 and mean == pytest.approx(89.0)


def test_scenes(spark):
    def shot(colour, w=6, h=4):
        return np.broadcast_to(np.array(colour, np.uint8), (h, w, 3)).copy()

    red, blue, grey = (0, 0, 200), (200, 0, 0), (90, 90, 90)
    shots = [shot(red)] * 3 + [shot(blue)] * 2 + [shot(red)] * 20 + [shot(grey)] * 2 + [shot(grey, 8)] + [None] + [shot(grey)]
    rows = [("v", i, float(i), None if s is None else bytearray(s.tobytes()), s.shape[1] if s is not None else None, 4) for i, s in enumerate(shots)] + [("still", i, float(i), bytearray(shot(red).tobytes()), 6, 4) for i in range(5)]
    df = spark.createDataFrame(rows, "video_id string, seq long, ts double, bgr binary, width int, height int")
    scores = pixels.scene_scores(df)
    got = {(r.video_id, r.seq): r.score for r in scores.collect()}
    assert got["v", 0] is None and got["v", 1] == 0.0 and got["v", 27] is None and got["v", 28] is None and got["v", 29] is None
    assert got["v", 3] == np.abs(pixels.hsv(shot(blue)) - pixels.hsv(shot(red))).mean() > 27
    assert {(r.video_id, r.seq): r.score for r in pixels.scene_scores(df, width=2.5).collect()} == got
    videos = spark.createDataFrame([("v",), ("still",), ("none",)], "video_id string")
    starts = lambda **kw: sorted((r.video_id, r.ts) for r in pixels.scene_starts(videos, scores, **kw).collect())
    assert starts(least=1) == [("none", 0.0), ("still", 0.0), ("v", 0.0), ("v", 3.0), ("v", 5.0), ("v", 25.0)]
    assert starts(least=4) == [("none", 0.0), ("still", 0.0), ("v", 0.0), ("v", 5.0), ("v", 25.0)] and starts(threshold=1e9) == [("none", 0.0), ("still", 0.0), ("v", 0.0)]
