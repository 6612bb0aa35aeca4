"""Time joins against brute force, with edges, ties and long spans."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evloom.operators import temporal

tick = st.integers(0, 60).map(lambda n: n / 10)
LAX = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def probes_df(spark, ts):
    return spark.createDataFrame([("v", i, float(t)) for i, t in enumerate(ts)], "video_id string, probe long, t double")


def points_df(spark, ts):
    return spark.createDataFrame([("v", i, float(t)) for i, t in enumerate(ts)], "video_id string, seq long, ts double")


@LAX
@given(st.lists(tick, min_size=1, max_size=12), st.lists(tick, max_size=25), st.sampled_from([0.0, 0.1, 0.3, 1.0, 2.7]))
def test_band_join(spark, probes, points, tol):
    got = temporal.band_join(probes_df(spark, probes), points_df(spark, points), tol).select("probe", "seq").collect()
    want = [(i, j) for i, t in enumerate(probes) for j, x in enumerate(points) if abs(x - t) <= tol]
    assert sorted(map(tuple, got)) == want


@LAX
@given(st.lists(st.tuples(tick, tick), max_size=12), st.lists(st.tuples(tick, tick), max_size=20), st.booleans())
def test_interval_join(spark, windows, spans, strict):
    windows, spans = [tuple(sorted(w)) for w in windows], [(a, b + 1000 * (i % 5 == 0)) for i, (a, b) in enumerate(map(sorted, spans))]
    w = spark.createDataFrame([("v", i, a, b) for i, (a, b) in enumerate(windows)], "video_id string, probe long, lo double, hi double")
    s = spark.createDataFrame([("v", i, a, b) for i, (a, b) in enumerate(spans)], "video_id string, seq long, start_sec double, end_sec double")
    got = temporal.interval_join(w, s, 0.7, strict=strict).select("probe", "seq").collect()
    meet = (lambda a, b, lo, hi: a < hi and b > lo) if strict else (lambda a, b, lo, hi: a <= hi and b >= lo)
    assert sorted(map(tuple, got)) == [(i, j) for i, (lo, hi) in enumerate(windows) for j, (a, b) in enumerate(spans) if meet(a, b, lo, hi)]


def test_nearest_ties_and_status_order(spark):
    near = lambda pts, t, tol, **k: temporal.nearest(probes_df(spark, [t]), points_df(spark, pts), tol, ("video_id", "probe"), ("ts", "seq"), **k).first()["near"]
    assert near([1.0, 4.0, 4.9], 5.0, 1.0)["ts"] == 4.9
    assert near([6.0, 4.0], 5.0, 1.0)["ts"] == 4.0
    assert near([6.0, 4.0], 5.0, 1.0, later=True)["seq"] == 1
    assert near([1.0], 5.0, 1.0) is None


def test_float_edges_follow_the_written_predicate(spark):
    rnd = random.Random(7)
    probes, points = [rnd.uniform(0, 50) for _ in range(40)], []
    for t in probes:
        points += [t + s * 0.3 * f for s in (-1, 1) for f in (0.5, 1, 1 - 1e-7, 1 + 1e-7)]
    got = temporal.band_join(probes_df(spark, probes), points_df(spark, points), 0.3).count()
    assert got == sum(abs(x - t) <= 0.3 for t in probes for x in points)


def test_near_spans_and_filters(spark):
    rows = [("v", 0, 17.0, "cursor_track", "r", None, 18.0, "c"), ("v", 1, 17.2, "vision", "r", 0.5, None, ""), ("v", 2, 17.2, "vision", "r", 0.5, None, ""), ("v", 3, 17.2, "vision", "r", 0.6, None, "")]
    ev = spark.createDataFrame(rows, "video_id string, seq long, ts double, kind string, ref string, confidence double, end_ts double, source string")
    n = lambda t, tol, **k: temporal.evidence_near(ev, probes_df(spark, [t]), tol, **k).count()
    assert [n(17.5, 0.0), n(18.5, 0.5), n(16.5, 0.5), n(19.0, 0.5)] == [1, 1, 1, 0]
    assert n(17.2, 0.0) == 3  # the exact copy counts once, another confidence does not
    assert n(17.2, 0.0, kinds="vision") == 2
    with pytest.raises(ValueError):
        n(17.2, 0.0, kinds=[])
    with pytest.raises(ValueError):
        n(17.2, 0.0, kinds=["smell"])
