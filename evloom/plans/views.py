"""The driver's tables seen as evidence, windows, pointer readings, segments, frames and claims.

Every view exists twice: as a DataFrame and as a DuckDB common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark, sf_dir: str) -> DataFrame:
    """events as evidence: (video_id, seq, ts, kind, ref, confidence, end_ts, source)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6D"))
    return e.select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("seq"), "ts",
        F.expr("case event_type when 'view' then 'frame' when 'click' then 'pointer' when 'purchase' then 'visual_change' when 'signup' then 'vision' when 'error' then 'transcript' end").alias("kind"),
        F.col("props").alias("ref"), F.expr("value / 500").alias("confidence"),
        F.expr("case when event_type = 'error' then ts + value * 60 end").alias("end_ts"),
        F.expr("case when event_id % 7 = 0 then 'video_understanding' else '' end").alias("source"),
    )


EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS seq, tt AS ts,
  CASE event_type WHEN 'view' THEN 'frame' WHEN 'click' THEN 'pointer' WHEN 'purchase' THEN 'visual_change' WHEN 'signup' THEN 'vision' WHEN 'error' THEN 'transcript' END AS kind,
  props AS ref, value / 500 AS confidence, CASE WHEN event_type = 'error' THEN tt + value * 60 END AS end_ts,
  CASE WHEN event_id % 7 = 0 THEN 'video_understanding' ELSE '' END AS source
  FROM (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6::DOUBLE AS tt FROM events))"""


def pointer(spark, sf_dir: str) -> DataFrame:
    """clicks and purchases as pointer readings on a 1000 x 500 frame."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    e = e.withColumn("tt", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6D"))
    e = e.withColumn("status", F.expr("case event_id % 5 when 0 then 'not_detected' when 1 then 'uncertain' else 'detected' end"))
    return e.select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("seq"), F.col("tt").alias("ts"), "status",
        F.expr("case when status <> 'not_detected' then cast(regexp_extract(props, '[0-9]+', 0) as int) * 10 end").alias("x"),
        F.expr("case when status <> 'not_detected' then cast(floor(value) as int) end").alias("y"),
        F.lit(1000).alias("frame_width"), F.lit(500).alias("frame_height"), F.expr("value / 500").alias("confidence"),
    )


PT = """pt AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS seq, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6::DOUBLE AS ts,
  CASE event_id % 5 WHEN 0 THEN 'not_detected' WHEN 1 THEN 'uncertain' ELSE 'detected' END AS status,
  CASE WHEN event_id % 5 <> 0 THEN CAST(regexp_extract(props, '[0-9]+') AS INT) * 10 END AS x,
  CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS INT) END AS y, 1000 AS frame_width, 500 AS frame_height, value / 500 AS confidence
  FROM events WHERE event_type IN ('click', 'purchase'))"""


def segments(spark, sf_dir: str) -> DataFrame:
    """conversation turns as transcript segments."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seg_no"), F.expr("turn * 6.0D").alias("start_sec"),
        F.expr("turn * 6.0D + least(length(text) / 25.0D, 40.0D)").alias("end_sec"), "text",
    )


SG = """sg AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seg_no, turn * 6.0::DOUBLE AS start_sec,
  turn * 6.0::DOUBLE + least(length(text) / 25.0::DOUBLE, 40.0::DOUBLE) AS end_sec, text FROM conversations)"""


def frames(spark, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 thumbnails (64 values) of a video per label, two seconds apart by id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("seq"), F.expr("vec_id * 2.0D").alias("ts"), F.col("embedding").cast("array<double>").alias("px"))


FR = """fr AS (SELECT CAST(label AS VARCHAR) AS video_id, vec_id AS seq, vec_id * 2.0::DOUBLE AS ts, list_transform(embedding, lambda x: x::DOUBLE) AS px FROM embeddings)"""


def rasters(spark, sf_dir: str) -> DataFrame:
    """The thumbnails of frames() as gray rasters of 8 x 8 pixels."""
    gray = F.expr("unhex(array_join(transform(px, x -> lpad(hex(cast(least(255, greatest(0, floor(128 + x * 400))) as int)), 2, '0')), ''))")
    return frames(spark, sf_dir).select("video_id", "seq", "ts", gray.alias("gray"), F.lit(8).alias("width"), F.lit(8).alias("height"))


GR = """gr AS (SELECT video_id, seq, ts, list_transform(px, lambda x: least(255, greatest(0, floor(128 + x * 400)))::INT) AS g FROM fr)"""


def spans(spark, sf_dir: str) -> DataFrame:
    """order lines as day spans of a video per customer: from the order to the shipment (some end before they start)."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    day = "datediff(cast({} as date), date'1992-01-01') * 1.0D"
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("string").alias("video_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("seq"),
        F.expr(day.format("o_orderdate")).alias("start_sec"), F.expr(day.format("l_shipdate")).alias("end_sec"),
    )


SP = """sp AS (SELECT CAST(o_custkey AS VARCHAR) AS video_id, l_orderkey * 10 + l_linenumber AS seq,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 1.0::DOUBLE AS start_sec,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 1.0::DOUBLE AS end_sec FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


_BOX = "named_struct('x1', 0.1D, 'y1', 0.0D, 'x2', 0.9D, 'y2', 0.5D)"


def streams(spark, sf_dir: str) -> DataFrame:
    """events as stream rows: every status occurs, every third purchase is a movement segment, every second vision answer
    locates a button (and each names a line of text without a place)."""
    e = evidence(spark, sf_dir).withColumn("kind", F.expr("if(kind = 'visual_change' and seq % 3 = 0, 'cursor_track', kind)"))
    e = e.withColumn("end_ts", F.expr("if(kind in ('transcript', 'cursor_track'), ts + confidence * 30000D, null)")).withColumn(
        "status", F.expr("case kind when 'pointer' then case seq % 5 when 0 then 'not_detected' when 1 then 'uncertain' else 'detected' end"
                         " when 'vision' then case seq % 6 when 0 then 'failed' when 1 then 'low_information' when 2 then 'unavailable' else 'ok' end"
                         " when 'visual_change' then case seq % 4 when 0 then 'unavailable' when 1 then 'not_detected' else 'detected' end end"))  # fmt: skip
    e = e.withColumn("ref", F.expr("""case kind when 'visual_change' then concat('{"status":"', status, '"}') when 'cursor_track' then if(seq % 2 = 0, '{"state":"uncertain"}', '{"state":"moving"}') else ref end"""))
    there = "kind = 'pointer' and status <> 'not_detected'"
    e = e.withColumn("x", F.expr(f"if({there}, cast(regexp_extract(ref, '[0-9]+', 0) as int) * 10, null)")).withColumn("y", F.expr(f"if({there}, cast(floor(confidence * 500D) as int), null)"))
    e = e.withColumn("frame_width", F.expr("if(kind = 'pointer', 1000, null)")).withColumn("frame_height", F.expr("if(kind = 'pointer', 500, null)"))
    line, box = "named_struct('kind', 'text', 'description', 'a line', 'region', cast(null as struct<x1:double,y1:double,x2:double,y2:double>), 'region_confidence', 'unknown')", _BOX
    button = f"named_struct('kind', 'button', 'description', 'the button', 'region', {box}, 'region_confidence', 'detected')"
    return e.withColumn("elements", F.expr(f"case when kind <> 'vision' then null when seq % 2 = 0 then array({line}, {button}) else array({line}) end"))


ST = f"""{EV}, st0 AS (SELECT * EXCLUDE (kind, end_ts), CASE WHEN kind = 'visual_change' AND seq % 3 = 0 THEN 'cursor_track' ELSE kind END AS kind FROM ev),
st1 AS (SELECT *, CASE WHEN kind IN ('transcript', 'cursor_track') THEN ts + confidence * 30000::DOUBLE END AS end_ts,
  CASE kind WHEN 'pointer' THEN CASE seq % 5 WHEN 0 THEN 'not_detected' WHEN 1 THEN 'uncertain' ELSE 'detected' END
    WHEN 'vision' THEN CASE seq % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'low_information' WHEN 2 THEN 'unavailable' ELSE 'ok' END
    WHEN 'visual_change' THEN CASE seq % 4 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'not_detected' ELSE 'detected' END END AS status,
  CASE WHEN kind = 'pointer' AND seq % 5 <> 0 THEN CAST(regexp_extract(ref, '[0-9]+') AS INT) * 10 END AS x, CASE WHEN kind = 'pointer' AND seq % 5 <> 0 THEN CAST(floor(confidence * 500::DOUBLE) AS INT) END AS y FROM st0),
st AS (SELECT * REPLACE (CASE kind WHEN 'visual_change' THEN '{{"status":"' || status || '"}}' WHEN 'cursor_track' THEN CASE WHEN seq % 2 = 0 THEN '{{"state":"uncertain"}}' ELSE '{{"state":"moving"}}' END ELSE ref END AS ref) FROM st1)"""


def windowed(tol: float) -> str:
    """CTEs: w (query times), ob (stream rows of each), nr (with their nearness), nearest frames, pointers and answers."""
    usable = "status IN ('ok', 'low_information')"
    return f"""{ST}, w0 AS (SELECT video_id, seq, ts FROM st WHERE kind = 'frame' UNION ALL SELECT video_id, seq, ts FROM st WHERE kind = 'transcript' AND video_id NOT IN (SELECT video_id FROM st WHERE kind = 'frame')
  UNION ALL SELECT video_id, seq, ts FROM st WHERE kind = 'vision' AND source <> '' AND {usable}),
w AS (SELECT video_id, min(seq) AS probe, ts AS t FROM w0 GROUP BY video_id, ts),
ob AS (SELECT w.probe, w.t, st.*, kind = 'vision' AND source <> '' AS native FROM w JOIN st ON w.video_id = st.video_id AND CASE kind WHEN 'transcript' THEN ts < t + {tol} AND end_ts > t - {tol}
  WHEN 'cursor_track' THEN ts <= t + {tol} AND end_ts >= t - {tol} ELSE abs(ts - t) <= {tol} END),
nr AS (SELECT *, row_number() OVER (PARTITION BY video_id, probe, kind, native ORDER BY abs(ts - t), ts, seq) AS rk FROM ob),
np AS (SELECT * FROM nr WHERE kind = 'pointer' AND rk = 1), nv AS (SELECT * FROM nr WHERE kind = 'vision' AND NOT native AND rk = 1), nn AS (SELECT * FROM nr WHERE native AND rk = 1)"""
