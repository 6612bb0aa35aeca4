"""Queries over ordered measurements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evloom.functions import scalars
from evloom.operators import folds, measure, ordered, pixels

from . import views
from .registry import query
from .views import FR, PT, SG

GAP = 259200.0


@query("pointer_normalized", f"WITH {PT} SELECT video_id, seq, x / 1000.0::DOUBLE AS nx, y / 500.0::DOUBLE AS ny FROM pt")
def pointer_normalized(spark, sf_dir):
    pt = views.pointer(spark, sf_dir)
    return pt.select("video_id", "seq", scalars.normalized("x", "frame_width").alias("nx"), scalars.normalized("y", "frame_height").alias("ny"))


@query("track_confidence", f"WITH {PT} SELECT video_id, min(ts) AS start_sec, max(ts) AS end_sec, count(*) AS readings, count(*) FILTER (WHERE status = 'detected') / count(*)::DOUBLE AS confidence FROM pt GROUP BY 1")
def track_confidence(spark, sf_dir):
    return measure.track_summary(views.pointer(spark, sf_dir))


INTERVALS = f"""o AS (SELECT *, lead(ts) OVER w AS ts2, lead(status) OVER w AS st2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(confidence) OVER w AS c2, row_number() OVER w - 1 AS i FROM pt WINDOW w AS (PARTITION BY video_id ORDER BY ts, seq)),
iv AS (SELECT video_id, i, ts AS start_sec, ts2 AS end_sec, x, y, x2, y2, confidence AS c1, c2, sqrt(1.0::DOUBLE * (x2 - x) * (x2 - x) + 1.0::DOUBLE * (y2 - y) * (y2 - y)) / sqrt(1250000.0::DOUBLE) AS step,
  CASE WHEN ts2 <= ts THEN 'zero_elapsed_time' WHEN ts2 - ts > {GAP} THEN 'sampling_gap' WHEN x IS NULL OR x2 IS NULL THEN 'pointer_not_observed' WHEN status <> 'detected' OR st2 <> 'detected' THEN 'ambiguous_position'
  WHEN sqrt(1.0::DOUBLE * (x2 - x) * (x2 - x) + 1.0::DOUBLE * (y2 - y) * (y2 - y)) / sqrt(1250000.0::DOUBLE) < 0.03 THEN 'displacement_within_jitter' ELSE 'moving' END AS basis FROM o WHERE ts2 IS NOT NULL)"""


ISLANDS = """n AS (SELECT *, CASE WHEN lag(basis) OVER (PARTITION BY video_id ORDER BY i) = basis THEN 0 ELSE 1 END AS new FROM iv),
g AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY i) AS island FROM n),
s AS (SELECT video_id, island, min(start_sec) AS a, max(end_sec) AS z, any_value(basis) AS why, count(*) AS intervals, sum(step) AS path, arg_max(x2, i) - arg_min(x, i) AS dx, arg_max(y2, i) - arg_min(y, i) AS dy, arg_min(c1, i) AS c0, sum(c2) AS cs FROM g GROUP BY ALL),
m AS (SELECT *, why = 'moving' AS moving, sqrt(1.0::DOUBLE * dx * dx + 1.0::DOUBLE * dy * dy) / sqrt(1250000.0::DOUBLE) AS net FROM s),
h AS (SELECT *, moving AND net >= 0.03 AND net / path >= 0.8 AS straight, degrees(atan2(dy::DOUBLE, dx::DOUBLE)) AS deg FROM m),
moved AS (SELECT video_id, a AS start_sec, z AS end_sec, intervals, CASE WHEN moving THEN 'moving' ELSE 'uncertain' END AS motion_state, CASE WHEN straight THEN CAST(printf('%.1f', CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) AS DOUBLE) % 360 END AS direction_deg,
  CASE WHEN moving THEN CAST(printf('%.4f', path / (z - a)) AS DOUBLE) END AS mean_speed_norm, CASE WHEN moving THEN CAST(printf('%.4f', (c0 + cs) / (intervals + 1) * least(1.0::DOUBLE, intervals / 2.0::DOUBLE)) AS DOUBLE) ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN NOT moving THEN why WHEN straight THEN 'consecutive_detections_displaced' ELSE 'consecutive_detections_displaced_heading_varies' END AS basis FROM h)"""


@query("cursor_intervals", f"WITH {PT}, {INTERVALS} SELECT video_id, i, start_sec, end_sec, basis FROM iv")
def cursor_intervals(spark, sf_dir):
    return measure.cursor_intervals(views.pointer(spark, sf_dir), GAP).select("video_id", "i", "start_sec", "end_sec", "basis")


@query(
    "cursor_segments",
    f"""WITH {PT}, {INTERVALS}, {ISLANDS},
own AS (SELECT video_id, count(*) AS n, min(ts) AS first, max(ts) AS last, min(ts) - 10.0::DOUBLE AS t0, max(ts) + CASE WHEN CAST(video_id AS BIGINT) % 2 = 0 THEN 5.0 ELSE 0.0 END::DOUBLE AS t1 FROM pt GROUP BY 1)
SELECT * FROM moved
UNION ALL SELECT video_id, t0, first, 0, 'uncertain', NULL, NULL, 0.0, 'not_sampled' FROM own WHERE n > 1
UNION ALL SELECT video_id, last, t1, 0, 'uncertain', NULL, NULL, 0.0, 'not_sampled' FROM own WHERE n > 1 AND last < t1
UNION ALL SELECT video_id, t0, t1, 0, 'uncertain', NULL, NULL, 0.0, 'too_few_samples' FROM own WHERE n = 1
UNION ALL SELECT 'empty', 1.0, 2.0, 0, 'uncertain', NULL, NULL, 0.0, 'no_pointer_samples'""",
)
def cursor_segments(spark, sf_dir):
    pt = views.pointer(spark, sf_dir)
    tracks = pt.groupBy("video_id").agg((F.min("ts") - 10.0).alias("start_sec"), (F.max("ts") + F.expr("if(first(cast(video_id as bigint)) % 2 = 0, 5.0D, 0.0D)")).alias("end_sec"))
    tracks = tracks.unionAll(spark.createDataFrame([("empty", 1.0, 2.0)], "video_id string, start_sec double, end_sec double"))
    return measure.cursor_segments(pt, GAP, tracks).drop("island")


_PAIR = "pr AS (SELECT video_id, seq, ts AS later, lag(ts) OVER w AS earlier, px, lag(px) OVER w AS q FROM fr WINDOW w AS (PARTITION BY video_id ORDER BY ts, seq))"
_MAG = "mg AS (SELECT *, list_sum(list_transform(list_zip(px, q), lambda z: CASE WHEN abs(z[1] - z[2]) > 0.3 THEN 1 ELSE 0 END)) / 64.0::DOUBLE AS magnitude FROM pr WHERE q IS NOT NULL)"


@query(
    "frame_pair_change",
    f"""WITH {FR}, {_PAIR}, {_MAG} SELECT video_id, seq, earlier, later, magnitude, CASE WHEN magnitude >= 0.08 THEN 'detected' ELSE 'not_detected' END AS status,
least(1.0::DOUBLE, abs(magnitude - 0.08::DOUBLE) / 0.08::DOUBLE) AS confidence FROM mg""",
)
def frame_pair_change(spark, sf_dir):
    return measure.frame_changes(views.frames(spark, sf_dir), above=0.3)


@query(
    "change_sweep",
    f"""WITH {FR}, {_PAIR}, {_MAG}, t(threshold) AS (VALUES (0.02::DOUBLE), (0.05::DOUBLE), (0.08::DOUBLE), (0.12::DOUBLE)) SELECT threshold, count(*) FILTER (WHERE magnitude >= threshold) AS detected, count(*) AS pairs FROM mg CROSS JOIN t GROUP BY threshold""",
)
def change_sweep(spark, sf_dir):
    ch = measure.frame_changes(views.frames(spark, sf_dir), above=0.3)
    steps = F.array(*[F.lit(x) for x in (0.02, 0.05, 0.08, 0.12)])
    return ch.select("magnitude", F.explode(steps).alias("threshold")).groupBy("threshold").agg(F.sum(F.when(F.col("magnitude") >= F.col("threshold"), 1).otherwise(0)).alias("detected"), F.count("*").alias("pairs"))


@query("thumbnail_mad", f"WITH {FR}, {_PAIR} SELECT video_id, seq, CAST(floor(list_sum(list_transform(list_zip(px, q), lambda z: abs(z[1] - z[2]))) / 64 * 1e6 + 0.5) AS BIGINT) AS mad_micro FROM pr WHERE q IS NOT NULL")
def thumbnail_mad(spark, sf_dir):
    w = Window.partitionBy("video_id").orderBy("ts", "seq")
    fr = views.frames(spark, sf_dir).withColumn("q", F.lag("px").over(w)).where("q is not null")
    return fr.select("video_id", "seq", F.expr(f"cast(floor({measure.thumbnail_mad('px', 'q')} * 1e6D + 0.5D) as bigint)").alias("mad_micro"))


@query(
    "keyframe_dedupe",
    f"""WITH RECURSIVE {FR}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, seq) AS i FROM fr),
k AS (SELECT video_id, i, seq, ts, px, px AS last, true AS kept FROM o WHERE i = 1 UNION ALL
SELECT o.video_id, o.i, o.seq, o.ts, o.px, CASE WHEN d > 0.14 THEN o.px ELSE k.last END, d > 0.14 FROM k JOIN o ON o.video_id = k.video_id AND o.i = k.i + 1,
  LATERAL (SELECT list_sum(list_transform(list_zip(o.px, k.last), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE AS d))
SELECT video_id, seq, ts FROM k WHERE kept""",
)
def keyframe_dedupe(spark, sf_dir):
    return folds.keyframe_dedupe(views.frames(spark, sf_dir), 0.14)


# cell (r, c) of the 9 x 8 grid over 8 x 8 pixels: pixel c - 1 by c / 8, pixel c by (8 - c) / 8; high bit first
_SIG = f"""{views.GR}, ce AS (SELECT *, list_transform(range(0, 72), lambda k: round_even(((k % 9) * coalesce(g[(k // 9) * 8 + k % 9], 0) + (8 - k % 9) * coalesce(g[(k // 9) * 8 + k % 9 + 1], 0)) / 8.0::DOUBLE, 0)) AS c FROM gr),
h0 AS (SELECT *, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN c[(i // 8) * 9 + i % 8 + 2] > c[(i // 8) * 9 + i % 8 + 1] THEN 1::HUGEINT << (63 - i)::INT ELSE 0::HUGEINT END))::HUGEINT AS s FROM ce),
h AS (SELECT video_id, seq, ts, list_sum(g) / 64.0::DOUBLE AS bright, (CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END)::BIGINT AS sig FROM h0)"""


def _facts(spark, sf_dir):
    return pixels.image_facts(views.rasters(spark, sf_dir).withColumn("size", F.lit(64)), ("video_id", "seq", "ts"))


@query(
    "dhash_hamming",
    f"""WITH {FR}, {_SIG},
p AS (SELECT *, lag(sig) OVER (PARTITION BY video_id ORDER BY ts, seq) AS prev FROM h) SELECT video_id, seq, sig, bright, bit_count(xor(sig, prev))::BIGINT AS distance FROM p WHERE prev IS NOT NULL""",
)
def dhash_hamming(spark, sf_dir):
    """Signatures of rasters, and how many bits neighbours differ in."""
    h = ordered.placed(_facts(spark, sf_dir).withColumnRenamed("signature", "sig"), ("sig",)).where("before is not null")
    return h.select("video_id", "seq", "sig", "bright", F.expr("cast(bit_count(sig ^ before.sig) as bigint)").alias("distance"))


_BUNDLE = """r AS (SELECT video_id, seq, CASE WHEN seq % 11 = 0 THEN NULL ELSE sig END AS sig, bright, CASE WHEN seq % 13 = 0 THEN 0 ELSE seq % 5 + 1 END AS size, (seq % 97) * 1000000 + seq AS rank FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY rank) AS i FROM r),
k AS (SELECT video_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS superseded_by, []::STRUCT(q BIGINT, s BIGINT, b DOUBLE, z BIGINT)[] AS kept FROM (SELECT DISTINCT video_id FROM o)
UNION ALL SELECT o.video_id, o.i, o.seq, CASE WHEN len(k.kept) < 12 AND o.size > 0 THEN coalesce(d[1].q, o.seq) END, CASE WHEN len(k.kept) < 12 AND o.size > 0 AND len(d) = 0 THEN list_append(k.kept, {'q': o.seq, 's': o.sig, 'b': o.bright, 'z': o.size}) ELSE k.kept END
FROM k JOIN o ON o.video_id = k.video_id AND o.i = k.i + 1, LATERAL (SELECT list_filter(k.kept, lambda x: CASE WHEN x.s IS NULL OR o.sig IS NULL THEN x.z = o.size ELSE bit_count(xor(x.s, o.sig)) <= 16 AND abs(x.b - o.bright) <= 4.0 END) AS d))"""


@query("bundle_greedy", f"WITH RECURSIVE {FR}, {_SIG}, {_BUNDLE} SELECT video_id, seq, superseded_by FROM k WHERE superseded_by IS NOT NULL")
def bundle_greedy(spark, sf_dir):
    fr = _facts(spark, sf_dir).withColumn("rank", F.expr("cast(seq % 97 as bigint) * 1000000 + seq"))
    c = fr.select("video_id", "seq", "rank", F.expr("if(seq % 11 = 0, null, signature)").alias("signature"), "bright", F.expr("if(seq % 13 = 0, 0L, seq % 5 + 1)").alias("size"))
    return folds.bundle(c, most=12, distance=16, brightness=4.0)


@query(
    "keyframe_union",
    f"""WITH {FR}, v AS (SELECT video_id, max(ts) AS duration FROM fr GROUP BY 1), s AS (SELECT video_id, ts FROM fr WHERE seq % 5 = 0 UNION SELECT video_id, unnest(range(0, CAST(floor(duration / 60) AS BIGINT) + 1)) * 60.0::DOUBLE FROM v UNION SELECT video_id, 0.0::DOUBLE FROM v)
SELECT video_id, ts, row_number() OVER (PARTITION BY video_id ORDER BY ts) - 1 AS pos FROM s""",
)
def keyframe_union(spark, sf_dir):
    """Scene starts, a uniform grid and zero, sorted."""
    fr = views.frames(spark, sf_dir)
    return measure.keyframe_times(fr.where("seq % 5 = 0"), fr.groupBy("video_id").agg(F.max("ts").alias("duration")), 60.0)


@query(
    "segment_times",
    f"""WITH {SG}, sc AS (SELECT video_id, start_sec AS ts FROM sg WHERE seg_no % 2 = 1), own AS (SELECT * FROM sg WHERE end_sec > start_sec),
hit AS (SELECT DISTINCT own.video_id, seg_no, ts FROM own JOIN sc ON own.video_id = sc.video_id AND ts >= start_sec AND ts <= end_sec),
c AS (SELECT video_id, seg_no, start_sec AS ts FROM own UNION SELECT video_id, seg_no, (start_sec + end_sec) / 2 FROM own UNION SELECT video_id, seg_no, end_sec FROM own
  UNION SELECT video_id, seg_no, start_sec + unnest(range(0, CAST(floor((end_sec - start_sec) / 2.0 + 1e-9) AS BIGINT) + 1)) * 2.0::DOUBLE FROM own UNION SELECT * FROM hit)
SELECT c.video_id, c.seg_no, c.ts, EXISTS (SELECT 1 FROM hit h WHERE h.video_id = c.video_id AND h.seg_no = c.seg_no AND round(h.ts, 3) = round(c.ts, 3)) AS scene FROM c""",
)
def segment_times(spark, sf_dir):
    """Where to look for frames of each segment."""
    sg = views.segments(spark, sf_dir)
    return measure.segment_times(sg, sg.where("seg_no % 2 = 1").select("video_id", F.col("start_sec").alias("ts")), 2.0)


_VD = "vd AS (SELECT video_id, max(end_sec) AS duration FROM sg GROUP BY 1)"


@query(
    "sample_grid",
    f"""WITH {SG}, {_VD}, st AS (SELECT *, greatest(2.0::DOUBLE, duration / 18) AS step FROM vd)
SELECT video_id, duration, i::BIGINT AS i, i * step AS ts FROM st, LATERAL (SELECT unnest(range(0, CAST(floor(duration / step + 1e-9) AS BIGINT) + 1)) AS i)""",
)
def sample_grid(spark, sf_dir):
    vd = views.segments(spark, sf_dir).groupBy("video_id").agg(F.max("end_sec").alias("duration"))
    return measure.sample_grid(vd, 2.0, 20).withColumn("i", F.col("i").cast("long"))


@query(
    "even_spread",
    f"""WITH {FR}, o AS (SELECT video_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM fr),
j AS (SELECT DISTINCT video_id, (2 * k * (n - 1) + 19) // 38 AS i FROM (SELECT DISTINCT video_id, n FROM o), range(0, 20) r(k))
SELECT o.video_id, seq FROM o LEFT JOIN j ON o.video_id = j.video_id AND o.i = j.i WHERE n <= 20 OR j.i IS NOT NULL""",
)
def even_spread(spark, sf_dir):
    return measure.even_spread(views.frames(spark, sf_dir).drop("px"), 20).select("video_id", "seq")


@query("clamp_segments", f"WITH {SG}, c AS (SELECT video_id, seg_no, greatest(0.0::DOUBLE, start_sec) AS start_sec, least(end_sec, 20.0::DOUBLE) AS end_sec FROM sg) SELECT * FROM c WHERE start_sec < 20 AND end_sec > start_sec")
def clamp_segments(spark, sf_dir):
    sg = views.segments(spark, sf_dir).withColumn("duration", F.lit(20.0))
    return measure.clamp_segments(sg).select("video_id", "seg_no", "start_sec", "end_sec")


@query(
    "anchor_tolerance",
    f"""WITH {FR}, g AS (SELECT video_id, ts - lag(ts) OVER (PARTITION BY video_id ORDER BY ts, seq) AS gap FROM (SELECT video_id, seq, ts - CASE WHEN seq % 3 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS ts FROM fr)),
l AS (SELECT video_id, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS g FROM g GROUP BY 1) SELECT video_id, greatest(1.0::DOUBLE, coalesce(g[len(g) // 2 + 1] / 2, 1.0::DOUBLE)) AS tolerance FROM l""",
)
def anchor_tolerance(spark, sf_dir):
    fr = views.frames(spark, sf_dir)
    return measure.anchor_tolerance(fr.withColumn("ts", F.expr("ts - if(seq % 3 = 0, 2.0D, 0.0D)")))


_SIZE = "p_partkey % 1000 + 2"


@query(
    "crop_plan",
    """WITH a AS (SELECT p_partkey, (p_partkey % 1000 + 2)::INT AS size, (p_partkey % 7) / 10.0::DOUBLE AS lo, (p_partkey % 7) / 10.0::DOUBLE + 0.3 AS hi FROM part),
b AS (SELECT *, CAST(floor(round(lo * size, 6)) AS INT) AS f, least(size, CAST(ceil(round(hi * size, 6)) AS INT)) AS e FROM a),
c AS (SELECT *, f - f % 2 AS st, e - (f - f % 2) + (e - (f - f % 2)) % 2 AS n0 FROM b),
d AS (SELECT *, greatest(2, CASE WHEN st + n0 > size THEN n0 - 2 ELSE n0 END) AS n FROM c)
SELECT p_partkey, size, CASE WHEN st + n > size THEN (size - n) - (size - n) % 2 ELSE st END AS start, n AS length, greatest(1, CAST(floor((n * 64 * 2 + size) / (2 * size)::DOUBLE) AS INT)) AS height FROM d""",
)
def crop_plan(spark, sf_dir):
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.expr(f"cast({_SIZE} as int)").alias("size"), F.expr("(p_partkey % 7) / 10.0D").alias("lo"))
    p = p.withColumn("hi", F.expr("lo + 0.3D"))
    start, length = scalars.even_span("lo", "hi", "size")
    p = p.withColumn("start", start).withColumn("length", length)
    return p.withColumn("height", scalars.scaled_height("size", "length", "64")).select("p_partkey", "size", "start", "length", "height")


@query(
    "transcript_chunks",
    f"""WITH RECURSIVE {SG}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_no) AS i FROM sg WHERE regexp_matches(text, '\\S')),
k AS (SELECT video_id, i, seg_no, start_sec AS chunk_start, end_sec, 0::BIGINT AS chunk FROM o WHERE i = 1 UNION ALL
SELECT o.video_id, o.i, o.seg_no, CASE WHEN k.end_sec - k.chunk_start >= 20 THEN o.start_sec ELSE k.chunk_start END, o.end_sec, CASE WHEN k.end_sec - k.chunk_start >= 20 THEN k.chunk + 1 ELSE k.chunk END
FROM k JOIN o ON o.video_id = k.video_id AND o.i = k.i + 1) SELECT video_id, seg_no, chunk, chunk_start FROM k""",
)
def transcript_chunks(spark, sf_dir):
    return folds.transcript_chunks(views.segments(spark, sf_dir))


@query("visual_regions")
def visual_regions(spark, sf_dir):
    """Pixel changes between neighbouring 8 x 8 rasters, located (numpy: no SQL counterpart)."""
    return pixels.visual_changes(views.rasters(spark, sf_dir))


@query(
    "raster_changes",
    f"""WITH {FR}, {views.GR}, p AS (SELECT *, lag(g) OVER w AS q, lag(ts) OVER w AS earlier FROM gr WINDOW w AS (PARTITION BY video_id ORDER BY ts, seq)),
d AS (SELECT video_id, seq, earlier, ts AS later, list_filter(range(0, 64), lambda i: abs(g[i + 1] - q[i + 1]) > 25) AS c FROM p WHERE q IS NOT NULL), m AS (SELECT *, len(c) / 64.0::DOUBLE AS magnitude FROM d)
SELECT video_id, seq, earlier, later, magnitude, CASE WHEN magnitude >= 0.08 THEN 'detected' ELSE 'not_detected' END AS status, least(1.0::DOUBLE, abs(magnitude - 0.08::DOUBLE) / 0.08::DOUBLE) AS confidence,
CASE WHEN magnitude >= 0.08 THEN list_min(list_transform(c, lambda i: i % 8)) / 8.0::DOUBLE END AS x1, CASE WHEN magnitude >= 0.08 THEN list_min(list_transform(c, lambda i: i // 8)) / 8.0::DOUBLE END AS y1,
CASE WHEN magnitude >= 0.08 THEN (list_max(list_transform(c, lambda i: i % 8)) + 1) / 8.0::DOUBLE END AS x2, CASE WHEN magnitude >= 0.08 THEN (list_max(list_transform(c, lambda i: i // 8)) + 1) / 8.0::DOUBLE END AS y2 FROM m""",
)
def raster_changes(spark, sf_dir):
    """Pixel changes between neighbouring rasters, with the box around all that changed (of 8 areas at most)."""
    ch = pixels.visual_changes(views.rasters(spark, sf_dir))
    hull = [F.expr(f"array_{how}(transform(regions, r -> r.{c}))").alias(c) for c, how in (("x1", "min"), ("y1", "min"), ("x2", "max"), ("y2", "max"))]
    return ch.select("video_id", "seq", "earlier", "later", "magnitude", "status", "confidence", *hull)


@query(
    "raster_pointer",
    f"""WITH {FR}, {views.GR}, p AS (SELECT *, lag(g) OVER w AS q, row_number() OVER w AS i FROM gr WINDOW w AS (PARTITION BY video_id ORDER BY ts, seq)),
c AS (SELECT *, len(list_filter(range(0, 64), lambda k: abs(g[k + 1] - q[k + 1]) > 25)) / 64.0::DOUBLE AS share FROM p) SELECT video_id, seq, q IS NOT NULL AND share <= 0.15 AS asked FROM c""",
)
def raster_pointer(spark, sf_dir):
    """Where two rasters differ in so few pixels that a pointer may be looked for (an 8 x 8 raster is too small to show one)."""
    fr = views.rasters(spark, sf_dir)
    ch = pixels.visual_changes(fr, 0.15).select("video_id", "seq", (F.col("magnitude") <= 0.15).alias("asked"))
    seen = pixels.two_frame_pointer(fr).select("video_id", "seq", (F.col("status") == "not_detected").alias("none"))
    return seen.join(ch, ["video_id", "seq"], "left").select("video_id", "seq", F.when(F.col("none"), F.coalesce("asked", F.lit(False))).alias("asked"))


@query(
    "change_percentiles",
    f"WITH {FR}, {_PAIR}, {_MAG} SELECT video_id, quantile_cont(magnitude, 0.1) AS p10, quantile_cont(magnitude, 0.5) AS p50, quantile_cont(magnitude, 0.9) AS p90 FROM mg GROUP BY 1",
)
def change_percentiles(spark, sf_dir):
    ch = measure.frame_changes(views.frames(spark, sf_dir), above=0.3)
    return ch.groupBy("video_id").agg(*[F.expr(f"percentile(magnitude, {p})").alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)])


@query(
    "pointer_references",
    f"WITH {PT} SELECT video_id, seq, CASE WHEN x IS NULL THEN '(status=' || status || ')' ELSE 'x=' || x || ', y=' || y || ' (status=' || status || ')' END AS ref, round_even(ts * 25.0::DOUBLE, 0)::BIGINT AS frame_index FROM pt",
)
def pointer_references(spark, sf_dir):
    from evloom.functions import evidence

    pt = views.pointer(spark, sf_dir).withColumn("fps", F.lit(25.0))
    return pt.select("video_id", "seq", evidence.pointer_ref().alias("ref"), evidence.frame_index().alias("frame_index"))


@query(
    "neighbour_links",
    f"WITH {FR} SELECT video_id, seq, lag(seq) OVER w AS before, lead(seq) OVER w AS after FROM fr WINDOW w AS (PARTITION BY video_id ORDER BY ts, seq)",
)
def neighbour_links(spark, sf_dir):
    """Each frame with the one before and after it."""
    return ordered.placed(views.frames(spark, sf_dir).drop("px"), ("seq",)).select("video_id", "seq", F.col("before.seq").alias("before"), F.col("after.seq").alias("after"))


@query(
    "scene_scores",
    f"""WITH {FR}, {views.GR}, p AS (SELECT *, lag(g) OVER (PARTITION BY video_id ORDER BY ts, seq) AS q FROM gr)
SELECT video_id, seq, ts, CASE WHEN q IS NOT NULL THEN list_sum(list_transform(list_zip(g, q), lambda z: abs(z[1] - z[2]))) / 192.0::DOUBLE END AS score FROM p""",
)
def scene_scores(spark, sf_dir):
    """How much the picture changes from frame to frame, on gray pictures (no hue, no saturation)."""
    fr = views.frames(spark, sf_dir).withColumn("bgr", F.expr("unhex(array_join(transform(px, x -> repeat(lpad(hex(cast(least(255, greatest(0, floor(128 + x * 400))) as int)), 2, '0'), 3)), ''))"))
    return pixels.scene_scores(fr.withColumns({"width": F.lit(8), "height": F.lit(8)}))
