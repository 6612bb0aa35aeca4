"""Joins on one time axis, as equi-joins on time buckets followed by the exact predicate.

Catalyst plans `abs(a - b) <= tol` as a nested loop; a bucket column gives it an equi-key, spreads
one long video over many tasks and lets adaptive execution split what is still skewed. Buckets only
narrow the search: the predicate decides, with the edges exactly as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = ("ts", "coalesce(end_ts, ts)", "kind", "source", "ref", "coalesce(confidence, -1.0D)")
_LEVELS = 7


def canonical_order() -> list[Column]:
    return [F.expr(x).asc() for x in CANONICAL]


def band_join(probes: DataFrame, points: DataFrame, tol: float, t: str = "t", ts: str = "ts", on: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """All (probe, point) with abs(ts - t) <= tol, inclusive; inner. Point columns other than `on` must not clash."""
    width = float(max(2 * tol, 1.0))
    p = probes.withColumn("_b", F.explode(F.expr(f"sequence(cast(floor(({t} - {tol!r}D) / {width!r}D) as bigint) - 1, cast(floor(({t} + {tol!r}D) / {width!r}D) as bigint) + 1)")))
    q = points.withColumn("_b", F.expr(f"cast(floor({ts} / {width!r}D) as bigint)"))
    return p.join(q, [*on, "_b"]).where(F.abs(F.col(ts) - F.col(t)) <= F.lit(float(tol))).drop("_b")


def interval_join(
    windows: DataFrame, spans: DataFrame, width: float, lo: str = "lo", hi: str = "hi", start: str = "start_sec", end: str = "end_sec", strict: bool = False, on=("video_id",)
) -> DataFrame:
    """All (window, span) that overlap: start <= hi and end >= lo (strict: < and >); inner.

    Spans go to buckets of `width` * 16^level, the level by their own length, so none falls into
    more than about 17; a pair is kept only in the first bucket that both touch.
    """
    s = posted(spans, start, end, width).withColumnRenamed("_first", "_s0")
    w = posted(windows, lo, hi, width, every=True).withColumnRenamed("_first", "_w0")
    a, b = F.col(start), F.col(end)
    meet = ((a < F.col(hi)) & (b > F.col(lo))) if strict else ((a <= F.col(hi)) & (b >= F.col(lo)))
    return w.join(s, [*on, "_l", "_b"]).where((F.col("_b") == F.greatest("_s0", "_w0")) & meet).drop("_l", "_b", "_s0", "_w0")


def posted(spans: DataFrame, start: str, end: str, width: float, every: bool = False) -> DataFrame:
    """Spans (start <= end, others go) under the buckets that they touch: _l (level), _b (bucket of width * 16^level), _first (the
    first bucket of the span). A span goes to the level of its own length; with `every` it goes to all levels."""
    level = f"cast(least({_LEVELS - 1}, greatest(0, ceil(log(16, greatest(({end} - {start}) / {16 * width!r}D, 1.0D))))) as int)"
    levels = F.explode(F.expr(f"sequence(0, {_LEVELS - 1})")) if every else F.expr(level)
    s = spans.where(f"{start} <= {end}").withColumn("_l", levels).withColumn("_w", F.expr(f"{width!r}D * pow(16, _l)"))
    return s.withColumn("_first", F.expr(f"cast(floor({start} / _w) as bigint)")).withColumn("_b", F.explode(F.expr(f"sequence(_first, cast(floor({end} / _w) as bigint))"))).drop("_w")


def nearest(probes: DataFrame, points: DataFrame, tol: float, keys: tuple[str, ...], payload: tuple[str, ...], t: str = "t", ts: str = "ts", seq: str = "seq", on=("video_id",), later: bool = False) -> DataFrame:
    """Left: each probe (unique by `keys`) with the payload struct `near` of the nearest point, or null.

    Ties go to the earlier point, then the lower seq (`later`: to the higher seq). What a point says
    plays no part in the choice: filter the result, not the input.
    """
    order = F.struct(F.abs(F.col(ts) - F.col(t)), -F.col(seq)) if later else F.struct(F.abs(F.col(ts) - F.col(t)), F.col(ts), F.col(seq))
    best = band_join(probes, points, tol, t, ts, on).groupBy(*keys).agg(F.min_by(F.struct(*payload), order).alias("near"))
    return probes.join(best, list(keys), "left")


def evidence_near(evidence: DataFrame, probes: DataFrame, tol: float, kinds=None, sources=None) -> DataFrame:
    """Evidence around each probe (video_id, probe, t): points within tol, spans that overlap
    [t - tol, t + tol]; exact duplicates once; `pos` is the canonical position."""
    ev = select_evidence(evidence, kinds, sources)
    cols = ["ts", "kind", "ref", "confidence", "end_ts", "source"]
    points = band_join(probes, ev.where("end_ts is null").select("video_id", *cols), tol)
    win = probes.withColumn("lo", F.col("t") - float(tol)).withColumn("hi", F.col("t") + float(tol))
    spans = interval_join(win, ev.where("end_ts is not null").select("video_id", *cols), max(2 * tol, 1.0), start="ts", end="end_ts")
    return canonical(points.select("video_id", "probe", "t", *cols).unionByName(spans.select("video_id", "probe", "t", *cols)), ("video_id", "probe"))


def evidence_between(evidence: DataFrame, windows: DataFrame, kinds=None, sources=None) -> DataFrame:
    """Evidence of each closed window (video_id, probe, lo, hi): points inside, spans that overlap it."""
    ev = select_evidence(evidence, kinds, sources)
    cols = ["ts", "kind", "ref", "confidence", "end_ts", "source"]
    every = ev.select("video_id", *cols).withColumn("_e", F.coalesce("end_ts", "ts"))
    found = interval_join(windows, every, 3600.0, start="ts", end="_e").drop("_e")
    return canonical(found.select("video_id", "probe", "lo", "hi", *cols), ("video_id", "probe"))


def select_evidence(evidence: DataFrame, kinds=None, sources=None) -> DataFrame:
    """None: no filter; a string or a non-empty collection; an unknown kind or an empty collection is an error."""
    from .contracts import EVIDENCE_KINDS

    for name, want in (("kind", kinds), ("source", sources)):
        if want is None:
            continue
        want = [want] if isinstance(want, str) else list(want)
        if not want:
            raise ValueError(f"{name}s must not be empty")
        if name == "kind" and set(want) - set(EVIDENCE_KINDS):
            raise ValueError(f"unknown kind: {sorted(set(want) - set(EVIDENCE_KINDS))}")
        evidence = evidence.where(F.col(name).isin(want))
    return evidence


def canonical(rows: DataFrame, per: tuple[str, ...]) -> DataFrame:
    """Exact duplicates once, and `pos` (from 0) in canonical order within `per`."""
    return rows.distinct().withColumn("pos", F.row_number().over(Window.partitionBy(*per).orderBy(*canonical_order())).cast("long") - 1)


def segment_at(probes: DataFrame, segments: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left: the first segment (by seg_no) that holds t, both ends included, as struct `segment`."""
    win = probes.withColumn("lo", F.col("t")).withColumn("hi", F.col("t"))
    hit = interval_join(win, segments, 20.0).groupBy(*keys).agg(F.min_by(F.struct("seg_no", "text"), "seg_no").alias("segment"))
    return probes.join(hit, list(keys), "left")


def text_around(probes: DataFrame, segments: DataFrame, keys: tuple[str, ...], window: float = 5.0) -> DataFrame:
    """Left: stripped texts of segments that overlap (t - window, t + window) strictly, in order, joined by spaces."""
    from evloom.functions.scalars import py_strip

    win = probes.withColumn("lo", F.col("t") - window).withColumn("hi", F.col("t") + window)
    hit = interval_join(win, segments.withColumn("text", py_strip("text")), 2 * window, strict=True)
    said = hit.groupBy(*keys).agg(F.expr("array_join(transform(array_sort(collect_list(struct(start_sec, seg_no, text))), x -> x.text), ' ')").alias("said"))
    return probes.join(said, list(keys), "left").withColumn("said", F.coalesce("said", F.lit("")))
