"""Order-dependent folds: each group's rows in order, a small state carried along.

A group that is longer than a block of its order is folded in blocks, all at once: each block is folded from the states in
which it may be entered, and the blocks are put together over one row for each state of a block. Where the true state of a
block was not among them, the fold goes on with it (and with the states that the blocks before it were left in); states
soon run together, so rounds are few, and the result is that of the fold from the first row to the last in any case.
Rows reach Python sorted, in Arrow batches, and only states are held.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evloom.session import ship, written

from .ordered import running

DAY, MANY = 86_400.0, 20_000.0  # how far a block reaches: of a time axis, of numbered rows
_STATES = "_g string, _b long, s_in binary, s_out binary"


def _rows(batches, names):
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield dict(zip(names, row, strict=True))


def _walk(df: DataFrame, key: str, order: tuple[str, ...], schema: str, step) -> DataFrame:
    """step(state, row) -> (state, output row or None), one task a group; the state is None at the start of a group."""
    ship(df.sparkSession)
    names, kinds = df.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        group, state = object(), None
        for b in batches:
            out = []
            for r in _rows([b], names):
                if r[key] != group:
                    group, state = r[key], None
                state, made = step(state, r)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _entered(body: DataFrame, entries: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows of the blocks that are entered, each block led by one row with the states in which it is."""
    heads = entries.groupBy("_g", "_b").agg(F.collect_list("s").alias("_s"))
    rest = [c for c in body.columns if c not in ("_g", "_b")]
    kinds = {f.name: f.dataType for f in body.schema.fields}
    head = heads.select("_g", "_b", "_s", *[F.lit(None).cast(kinds[c]).alias(c) for c in rest])
    rows = body.join(heads.select("_g", "_b"), ["_g", "_b"], "left_semi").select("_g", "_b", F.lit(None).cast("array<binary>").alias("_s"), *rest)
    return head.unionByName(rows).repartition("_g", "_b").sortWithinPartitions("_g", "_b", F.col("_s").isNull(), *order)


def _left(names: list[str], step):
    """Blocks -> (s_in, s_out) for each state in which a block is entered."""
    kinds = to_arrow_schema(StructType.fromDDL(_STATES))

    def run(batches):
        at, states = None, {}

        def told():
            return pa.RecordBatch.from_pylist([{"_g": at[0], "_b": at[1], "s_in": i, "s_out": pickle.dumps(s, 5)} for i, s in states.items()], kinds)

        for r in _rows(batches, names):
            if r["_s"] is not None:
                if at:
                    yield told()
                at, states = (r["_g"], r["_b"]), {s: pickle.loads(s) for s in r["_s"]}
                continue
            met: dict = {}
            for i, s in states.items():  # states that ran together are one step
                if s not in met:
                    met[s] = step(s, r)[0]
                states[i] = met[s]
        if at:
            yield told()

    return run


def _stitched(batches):
    """(_g, _b, s_in, s_out), sorted -> (_g, _b, s, known): the state in which each block is entered, up to the first block that
    was not folded from it."""
    kinds = pa.schema([("_g", pa.string()), ("_b", pa.int64()), ("s", pa.binary()), ("known", pa.bool_())])
    group, state, lost, block, maps = None, None, False, None, {}
    out = []

    def step():
        nonlocal state, lost
        if block is not None and not lost:
            lost = state not in maps
            out.append({"_g": group, "_b": block, "s": state, "known": not lost})
            state = maps.get(state)

    for b in batches:
        for r in _rows([b], ["_g", "_b", "s_in", "s_out"]):
            if (r["_g"], r["_b"]) != (group, block):
                step()
                if r["_g"] != group:
                    group, state, lost = r["_g"], pickle.dumps(None, 5), False
                block, maps = r["_b"], {}
            maps[r["s_in"]] = r["s_out"]
        if len(out) > 1000:
            yield pa.RecordBatch.from_pylist(out, kinds)
            out = []
    step()
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def _fold(df: DataFrame, key: str, order: tuple[str, ...], schema: str, step, width: float = DAY, most_rounds: int = 10_000) -> DataFrame:
    """step(state, row) -> (state, output row or None); the state is None at the start of a group, else a value that can be
    compared and pickled. Groups that reach over more than one block (`width` of the first of `order`, a number) are folded
    in blocks."""
    ship(df.sparkSession)
    block = F.coalesce(F.floor(F.col(order[0]) / width), F.lit(-(2**62))).cast("long")
    tagged = df.withColumn("_g", F.coalesce(F.col(key), F.lit("\0"))).withColumn("_b", block)
    if not tagged.select("_g", "_b").groupBy("_g").agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).where("lo < hi").limit(1).count():
        return _walk(df, key, order, schema, step)
    body = written(tagged, "fold-rows")
    blocks = body.select("_g", "_b").distinct()
    blocks = written(blocks.withColumn("next", F.lead("_b").over(Window.partitionBy("_g").orderBy("_b"))), "fold-blocks", few=True)
    start = pickle.dumps(None, 5)
    entries, known = blocks.select("_g", "_b", F.lit(start).alias("s")), None
    names = ["_g", "_b", "_s", *df.columns]
    for _ in range(most_rounds):
        got = written(_entered(body, entries, order).mapInArrow(_left(names, step), _STATES), "fold-states")
        known = got if known is None else known.unionByName(got)
        walked = written(known.repartition("_g").sortWithinPartitions("_g", "_b").mapInArrow(_stitched, "_g string, _b long, s binary, known boolean"), "fold-walk")
        front = walked.where("not known").select("_g", F.col("_b").alias("_u"), F.col("s").alias("_f"))
        if not front.limit(1).count():
            break
        after = known.join(blocks.where("next is not null"), ["_g", "_b"]).select("_g", F.col("next").alias("_b"), F.col("s_out").alias("s"))
        after = after.join(front, "_g").where("_b >= _u").select("_g", "_b", "s").unionByName(blocks.join(front, "_g").where("_b >= _u").select("_g", "_b", F.col("_f").alias("s")))
        entries = written(after.distinct().join(known.select("_g", "_b", F.col("s_in").alias("s")), ["_g", "_b", "s"], "left_anti"), "fold-entries", few=True)
    else:
        raise RuntimeError("a fold did not come to its end")
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def replay(batches):
        state = None
        for b in batches:
            out = []
            for r in _rows([b], names):
                if r["_s"] is not None:
                    state = pickle.loads(r["_s"][0])
                    continue
                state, made = step(state, r)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)

    return _entered(body, walked.select("_g", "_b", "s"), order).mapInArrow(replay, schema)


def keyframe_dedupe(frames: DataFrame, least_mad: float, width: float = DAY) -> DataFrame:
    """Frames whose thumbnail differs from the last kept one by more than `least_mad` on average."""

    def step(last, r):
        px = np.array(r["px"], np.float64)
        if last is not None and np.abs(px - np.frombuffer(last)).sum() / len(px) <= least_mad:
            return last, None
        return px.tobytes(), {"video_id": r["video_id"], "seq": r["seq"], "ts": r["ts"]}

    return _fold(frames.select("video_id", "seq", "ts", "px"), "video_id", ("ts", "seq"), "video_id string, seq long, ts double", step, width)


def transcript_chunks(segments: DataFrame, chunk_sec: float = 20.0, width: float = MANY) -> DataFrame:
    """Chunk number of every segment with text: a chunk ends with the segment that ends `chunk_sec` or more after its start.
    The fold finds where chunks start; they are numbered by a sum in blocks."""

    def step(start, r):
        now = r["start_sec"] if start is None else start
        made = {"video_id": r["video_id"], "seg_no": r["seg_no"], "first": int(start is None), "chunk_start": now}
        return (None if r["end_sec"] - now >= chunk_sec else now), made

    said = segments.where(F.length(F.regexp_replace("text", r"(?U)\s", "")) > 0).select("video_id", "seg_no", "start_sec", "end_sec")
    found = _fold(said, "video_id", ("seg_no",), "video_id string, seg_no long, first int, chunk_start double", step, width)
    return running(found, "first", "_n", order=("seg_no",), width=width).select("video_id", "seg_no", (F.col("_n") - 1).alias("chunk"), "chunk_start")


def bundle(candidates: DataFrame, most: int | None = None, distance: int = 6, brightness: float = 4.0) -> DataFrame:
    """Ranked candidates (video_id, rank, seq, signature bigint, bright double, size bigint) kept greedily; `superseded_by`
    is the kept one that stands for a row (itself where it was kept).

    A candidate within `distance` bits and `brightness` of a kept one is its duplicate; where either has no signature, one
    of the same size in bytes is. Missing and empty files (size null or 0) are passed over. At `most` kept ones the walk
    ends: what ranks behind is neither kept nor linked."""

    def step(kept, r):
        kept = kept or []
        if (most is not None and len(kept) >= most) or not r["size"]:
            return kept, None
        for seq, sig, bright, size in kept:
            if sig is None or r["signature"] is None:
                same = size == r["size"]
            else:
                same = ((sig ^ r["signature"]) & (2**64 - 1)).bit_count() <= distance and abs(bright - r["bright"]) <= brightness
            if same:
                return kept, {"video_id": r["video_id"], "seq": r["seq"], "superseded_by": seq}
        return [*kept, (r["seq"], r["signature"], r["bright"], r["size"])], {"video_id": r["video_id"], "seq": r["seq"], "superseded_by": r["seq"]}

    cols = candidates.select("video_id", "rank", "seq", "signature", "bright", "size")
    return _walk(cols, "video_id", ("rank",), "video_id string, seq long, superseded_by long", step)


def first_seen(rows: DataFrame, value: str, per: str, order: tuple[str, ...], most: int) -> DataFrame:
    """The first `most` distinct values of each group, in order of first appearance."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(per, value).orderBy(*order))).where("_k = 1").drop("_k")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(per).orderBy(*order)).cast("long") - 1).where(F.col("pos") < most)
