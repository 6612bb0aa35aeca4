"""Exact removal of repeated passages: a depth-limited radix sort of suffixes over the cluster.

Two positions matter to each other only if their next `depth` bytes are equal, so suffixes are
ordered through `depth` bytes only, most significant digit first, and a group of one leaves the
sort at once:

  digit 1  the smallest hash among the 24-byte grams of a window (equal windows have equal ones);
           neighbouring windows with the same one travel as one run, about one row per 40 bytes;
  digit 2  the digest of a whole run: of runs that are equal throughout, the first stays in the
           sort as their leader and the others are repeats altogether;
  digits 3 to 6  the digest of a quarter of the window each, inside tasks that get the leaders' bytes by digit 1.

Digests are polynomials of the bytes modulo 2^64 under a mixed odd base; bytes themselves are not compared again, so two
different windows are taken for equal with a chance of about 2^-64 a pair that shares digit 1.

Windows that are equal in all digits are the equal groups; the first of a group (smallest key,
then smallest start) stays, all bytes of the others go. Groups with more than `split` leaders are
ordered by aggregation over the cluster instead of inside one task, with the same result.

Bit filters of fixed size (BLOOM_MB) keep runs with a unique first digit out of the shuffle and let
the leaders' bytes be read from the source again; a filter only ever lets too many through, which
changes nothing, as later digits tell runs apart. Digits with more than `frequent` runs go through an
aggregation and a join that Spark splits. Texts are processed whole, in segments.

Defined results: null is an empty text; texts shorter than `depth` bytes are kept; rows that share
a doc_id, or have none, are separate documents in the order (doc_id, nulls last; then text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.session import discard, ship, sliced, where_once, written

DEPTH = 100
GRAM = 24
SEGMENT = 1 << 18
SPLIT = 20_000  # leaders of one digit that are ordered inside one task
FREQUENT = 200_000  # runs of one digit that meet in one task
FILTERED = 50_000_000  # hashes that a filter takes; beyond, all runs are shuffled and leaders' bytes joined
SLICES, SLICE_BITS = 64, 21
BLOOM_MB = SLICES * (1 << SLICE_BITS) / 8 / 1e6
_ODD = 0x9E3779B97F4A7C15 | 1
_ODD2 = 0xC2B2AE3D27D4EB4F | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base & (2**64 - 1))
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring, by prefix sums over one segment."""

    made: dict = {}

    def __init__(self, base: int, most: int):
        self.table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        self.up, self.down = _powers(base, most), _powers(pow(base, -1, 2**64), most)

    @classmethod
    def of(cls, base: int, most: int) -> Rolling:
        have = cls.made.get(base)
        if have is None or len(have.up) < most:
            cls.made[base] = have = cls(base, max(most, SEGMENT + 2 * DEPTH + 8))
        return have

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def each(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """The hash of every substring of `size` bytes."""
        n = len(prefix) - size
        return _mix((prefix[size:] - prefix[:n]) * self.down[:n])

    def some(self, prefix: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        return _mix((prefix[to] - prefix[at]) * self.down[at])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, cur = 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    n = len(x) - width + 1
    return cur[:n] if size == width else np.minimum(cur[:n], cur[width - size : width - size + n])


def runs(raw: np.ndarray, depth: int, gram: int, blocks: bool):
    """(digit 1, digit 2 or None, first window, number of windows) of the runs of one text."""
    n = len(raw) - depth + 1
    for at in range(0, max(n, 0), SEGMENT):
        part = raw[at : min(at + SEGMENT, n) + depth - 1]
        roll = Rolling.of(_ODD, len(part) + 1)
        prefix = roll.prefix(part)
        grams = roll.each(prefix, gram)
        low = sliding_min(grams, depth - gram + 1)
        # a run ends where the smallest gram changes, or its leftmost place (text that repeats at once)
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])))
        cut = np.flatnonzero(new)
        size = np.diff(np.append(cut, len(low)))
        digit2 = None
        if blocks:
            other = Rolling.of(_ODD2, len(part) + 1)
            digit2 = other.some(other.prefix(part), cut, cut + size + depth - 1) * np.uint64(2 * depth + 1) + size.astype(np.uint64)
        yield low[cut], digit2, cut + at, size


def _bytes(x) -> np.ndarray:
    return np.frombuffer((x.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


def _first_digits(depth: int, gram: int):
    def run(batches):
        for b in sliced(batches, 4096):
            got = [d for t in b.column(0) for d, *_ in runs(_bytes(t), depth, gram, False)]
            h, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _slices(batches):
    bits: dict[int, np.ndarray] = {}
    for b in batches:
        h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        part = (h >> np.uint64(58)).astype(np.int64)
        for s in np.unique(part):
            x = h[part == s]
            own = bits.setdefault(int(s), np.zeros(1 << SLICE_BITS, bool))
            own[_probe(x, 0)] = True
            own[_probe(x, SLICE_BITS)] = True
    for s, own in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["slice", "bits"])


def _probe(h: np.ndarray, shift: int) -> np.ndarray:
    return ((h >> np.uint64(shift)) & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)


def _bloom(hashes: DataFrame, most: int) -> bytes | None:
    """The bit filter of a one-column table of hashes: BLOOM_MB; null (lets all through) beyond `most` rows, where it would be full."""
    if hashes.count() > most:
        return None
    rows = hashes.toDF("h").repartition(SLICES, F.shiftrightunsigned("h", 58)).mapInArrow(_slices, "slice int, bits binary").collect()
    table = np.zeros((SLICES, (1 << SLICE_BITS) // 8), np.uint8)
    for r in rows:
        table[r["slice"]] |= np.frombuffer(r["bits"], np.uint8)
    return table.tobytes() if rows else b""


def _maybe(table: bytes | None, h: np.ndarray) -> np.ndarray:
    """False only for hashes that the filter does not hold."""
    if table is None:
        return np.ones(len(h), bool)
    if not table:
        return np.zeros(len(h), bool)
    t = np.frombuffer(table, np.uint8).reshape(SLICES, -1)
    s, out = (h >> np.uint64(58)).astype(np.int64), np.ones(len(h), bool)
    for shift in (0, SLICE_BITS):
        bit = _probe(h, shift)
        out &= (t[s, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
    return out


def _place(k: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return _mix(k.astype(np.uint64) * np.uint64(_ODD) + lo.astype(np.uint64) * np.uint64(_ODD2))


def _places(batches):
    for b in batches:
        x = _place(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["h"])


def _candidates(depth: int, gram: int, sent, hot: bool):
    """(_k, text) -> runs whose first digit occurs again: of the very frequent digits, or of the others."""

    def run(batches):
        usual, frequent = sent.value
        for b in sliced(batches):
            h, d, k, lo, n = [], [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for x, y, at, size in runs(_bytes(t), depth, gram, True):
                    ok = _maybe(frequent, x)
                    ok = ok if hot else _maybe(usual, x) & ~ok
                    h.append(x[ok])
                    d.append(y[ok])
                    lo.append(at[ok])
                    n.append(size[ok])
                    k.append(np.full(int(ok.sum()), key, np.int64))
            if h:
                cols = [np.concatenate(h).view(np.int64), np.concatenate(d).view(np.int64), np.concatenate(k), np.concatenate(lo).astype(np.int32), np.concatenate(n).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "d", "k", "lo", "n"])

    return run


def _contexts(depth: int, gram: int, sent):
    """(_k, text) -> the bytes of the runs that the filter of leaders lets through."""

    def run(batches):
        table = sent.value
        for b in sliced(batches):
            h, k, lo, n, ctx = [], [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = _bytes(t)
                for x, _, at, size in runs(raw, depth, gram, False):
                    ok = _maybe(table, _place(np.full(len(at), key, np.int64), at))
                    if ok.any():
                        h.append(x[ok])
                        lo.append(at[ok])
                        n.append(size[ok])
                        k.append(np.full(int(ok.sum()), key, np.int64))
                        ctx += [raw[p:q].tobytes() for p, q in zip(at[ok].tolist(), (at + size + depth - 1)[ok].tolist(), strict=True)]
            if h:
                cols = [np.concatenate(h).view(np.int64), np.concatenate(k), np.concatenate(lo).astype(np.int32), np.concatenate(n).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cols], pa.array(ctx, pa.binary())], ["h", "k", "lo", "n", "ctx"])

    return run


def _by_block(depth: int):
    """Runs sorted by (h, d, k, lo) -> (h, k, s, e, n): followers (h null) as spans; leaders of open groups with n windows."""

    def digest(h, d, k, lo, n):
        first_h = np.concatenate(([True], h[1:] != h[:-1]))
        first = first_h | np.concatenate(([True], d[1:] != d[:-1]))
        blocks = np.add.reduceat(first.astype(np.int64), np.flatnonzero(first_h))
        lead = first & (blocks[np.cumsum(first_h) - 1] > 1)
        pick = ~first | lead
        e = (lo + n)[pick] + depth - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(h[pick], mask=~lead[pick]), pa.array(k[pick]), pa.array(lo[pick].astype(np.int64)), pa.array(e.astype(np.int64)), pa.array(n[pick])], ["h", "k", "s", "e", "n"]
        )

    def run(batches):
        held = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(held[0]):
                continue
            end = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            if end:
                yield digest(*[x[:end] for x in held])
                held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield digest(*held)

    return run


def equal_groups(group: np.ndarray, digits) -> np.ndarray:
    """Radix passes: True where an element equals an earlier one of its group in all digits.

    group: ascending ids; digits: functions of element indices, most significant first. Elements
    come in the order that decides which one is first; after each pass groups of one drop out.
    """
    repeat = np.zeros(len(group), bool)
    live, own = np.arange(len(group)), group
    for digit in digits:
        if not len(live):
            return repeat
        value = digit(live)
        order = np.lexsort((value, own))  # stable: earlier elements stay first
        live, own, value = live[order], own[order], value[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])))
        own = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        live, own = live[~alone], own[~alone]
    first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    repeat[live[~first]] = True
    return repeat


def _windows(bytes_: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of concatenated contexts with `size` windows each: where each window starts, and its context."""
    base = np.cumsum(size + depth - 1) - (size + depth - 1)
    owner = np.repeat(np.arange(len(size)), size)
    return np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum()), owner


def _order_leaders(depth: int, most: int = 400_000):
    """Rows (h, k, lo, n, ctx) sorted by (h, k, lo) -> spans (k, s, e) of windows that repeat earlier ones."""
    quarter = [(i * depth // 4, (i + 1) * depth // 4) for i in range(4)]

    def spans(h, k, lo, n, ctx):
        raw = np.frombuffer(b"".join(ctx), np.uint8)
        start, owner = _windows(raw, n, depth)
        roll = Rolling.of(_ODD2, len(raw) + 1)
        prefix = roll.prefix(raw)
        group = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))[owner]
        digits = [lambda i, a=a, b=b: roll.some(prefix, start[i] + a, start[i] + b) for a, b in quarter]
        hit = np.flatnonzero(equal_groups(group, digits))
        if not len(hit):
            return None
        new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])))
        first, last = hit[new], hit[np.append(new[1:], True)]
        at = lo + -(np.cumsum(n) - n)  # a window's index plus this is its start in the document
        s, e = first + at[owner[first]], last + at[owner[last]] + depth
        return pa.RecordBatch.from_arrays([pa.array(k[owner[first]]), pa.array(s.astype(np.int64)), pa.array(e.astype(np.int64))], ["k", "s", "e"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(last: bool):
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks()
            h = t["h"].to_numpy()
            end = len(h) if last else int(np.searchsorted(h, h[-1]))
            held = [x for x in t.slice(end).to_batches()]
            rows = len(h) - end
            if end:
                t = t.slice(0, end)
                n = t["n"].to_numpy().astype(np.int64)
                cut = 0
                while cut < end:  # whole groups, about `most` windows at a time
                    to = int(np.searchsorted(np.cumsum(n[cut:]), most)) + cut + 1
                    to = end if to >= end else int(np.searchsorted(h[:end], h[to - 1], side="right"))
                    p = t.slice(cut, to - cut)
                    out = spans(h[cut:to], p["k"].to_numpy(), p["lo"].to_numpy().astype(np.int64), n[cut:to], p["ctx"].to_pylist())
                    cut = to
                    if out is not None:
                        yield out

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= most // 50:
                    yield from done(False)
        if held:
            yield from done(True)

    return run


def _all_windows(depth: int):
    """Rows (h, k, lo, n, ctx) -> one row a window: its two hashes, key and start."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8)
            start, owner = _windows(raw, n, depth)
            two = []
            for base in (_ODD, _ODD2):
                roll = Rolling.of(base, len(raw) + 1)
                two.append(roll.some(roll.prefix(raw), start, start + depth).view(np.int64))
            lo = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            at = (lo - (np.cumsum(n) - n))[owner] + np.arange(len(owner))
            keys = b.column(1).to_numpy(zero_copy_only=False)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(two[0]), pa.array(two[1]), pa.array(keys), pa.array(at)], ["w1", "w2", "k", "s"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(_k, doc_id, text, extra): _k is unique and orders the documents; the doc_id itself where that is unique."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    odd = df.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return df.withColumn("_k", F.col("doc_id"))
    return written(df.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn("_k", F.monotonically_increasing_id()), "keyed")


def _frequent(rows: DataFrame, depth: int) -> DataFrame:
    """As _by_block, by aggregation and a join that Spark splits: for digits with very many runs."""
    rows = written(rows, "frequent")
    blocks = written(rows.groupBy("h", "d").agg(F.min(F.struct("k", "lo")).alias("lead"), F.count("*").alias("many"), F.min("n").alias("n")), "blocks")
    end = F.expr(f"cast(lo + n + {depth - 1} as long)").alias("e")
    followers = rows.join(blocks.where("many > 1").select("h", "d", "lead"), ["h", "d"]).where("k <> lead.k or lo <> lead.lo")
    followers = followers.select(F.lit(None).cast("long").alias("h"), "k", F.col("lo").cast("long").alias("s"), end, "n")
    open_ = blocks.groupBy("h").agg(F.count("*").alias("nb")).where("nb > 1")
    leaders = blocks.join(open_, "h").select("h", F.col("lead.k").alias("k"), F.col("lead.lo").alias("lo"), "n")
    return followers.unionAll(leaders.select("h", "k", F.col("lo").cast("long").alias("s"), end, "n"))


def repeated_spans(keys_and_texts: DataFrame, depth: int = DEPTH, gram: int = GRAM, split: int = SPLIT, frequent: int = FREQUENT, filtered: int = FILTERED) -> DataFrame:
    """(_k, text) -> (k, s, e): byte spans to remove; spans of a document may overlap."""
    df, spark = keys_and_texts.select("_k", "text"), keys_and_texts.sparkSession
    ship(spark)
    digits = df.select("text").mapInArrow(_first_digits(depth, gram), "h long, n long")
    repeated = written(digits.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "repeated")
    hot = _bloom(repeated.where(f"n > {frequent}").select("h"), filtered)
    usual = _bloom(repeated.select("h"), filtered)
    discard(repeated)
    sent = spark.sparkContext.broadcast((usual, hot))
    kind = "h long, d long, k long, lo int, n int"
    rows = df.mapInArrow(_candidates(depth, gram, sent, False), kind).repartition("h").sortWithinPartitions("h", "d", "k", "lo")
    sorted_ = rows.mapInArrow(_by_block(depth), "h long, k long, s long, e long, n int")
    if hot is None or hot:
        sorted_ = sorted_.unionAll(_frequent(df.mapInArrow(_candidates(depth, gram, sent, True), kind), depth))
    sorted_ = written(sorted_, "sorted")
    followers = sorted_.where("h is null").select("k", "s", "e")
    leaders = sorted_.where("h is not null").select("h", "k", F.col("s").cast("int").alias("lo"), "n")
    places = _bloom(leaders.select("k", "lo").mapInArrow(_places, "h long"), filtered)
    if places is not None:  # few enough for a filter of fixed size: texts are read again, not shuffled
        table = spark.sparkContext.broadcast(places)
        context = df.mapInArrow(_contexts(depth, gram, table), "h long, k long, lo int, n int, ctx binary")
    else:
        lists = leaders.groupBy("k").agg(F.collect_list(F.struct("h", "lo", "n")).alias("_l"))  # as long as its document at most
        cut = f"transform(_l, x -> struct(x.h, _k as k, x.lo, x.n, substring(_raw, x.lo + 1, x.n + {depth - 1}) as ctx))"
        texts = df.select("_k", F.col("text").cast("binary").alias("_raw")).join(lists, F.col("_k") == F.col("k")).drop("k")
        context = texts.select(F.explode(F.expr(cut)).alias("_x")).select("_x.*")
    big = written(leaders.groupBy("h").count().where(f"count > {split}").select("h"), "big")
    any_big = big.limit(1).count() > 0
    few = context.join(big, "h", "left_anti") if any_big else context
    ordered = few.repartition("h").sortWithinPartitions("h", "k", "lo").mapInArrow(_order_leaders(depth), "k long, s long, e long")
    spans = followers.unionAll(ordered)
    if any_big:
        each = written(context.join(big, "h", "left_semi").mapInArrow(_all_windows(depth), "w1 long, w2 long, k long, s long"), "windows")
        first = each.groupBy("w1", "w2").agg(F.min(F.struct("k", "s")).alias("lead"), F.count("*").alias("many")).where("many > 1")
        again = each.join(first, ["w1", "w2"]).where("k <> lead.k or s <> lead.s")
        spans = spans.unionAll(again.select("k", "s", (F.col("s") + depth).alias("e")))
    return spans


def merge(spans) -> list[tuple[int, int]]:
    """Maximal runs of a list of (start, end)."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _kept(batches):
    for b in batches:
        rows = {"n_bytes": [], "n_removed": [], "spans": [], "kept": []}
        for t, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            own = merge([(x["s"], x["e"]) for x in spans or ()])
            at, parts = 0, []
            for s, e in own:
                parts.append(raw[at:s])
                at = e
            parts.append(raw[at:])
            rows["n_bytes"].append(len(raw))
            rows["n_removed"].append(sum(e - s for s, e in own))
            rows["spans"].append([{"s": s, "e": e} for s, e in own])
            rows["kept"].append(b"".join(parts))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]], ["_k", *rows])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per document: _k, doc_id, n_bytes, n_removed, spans (removed bytes) and kept (the bytes that stay)."""
    df = keyed(docs, id_col, text_col)
    spans = repeated_spans(df, **parameters)
    lists = spans.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("_s"))
    joined = df.join(lists, F.col("_k") == F.col("k"), "left").select("_k", "text", "_s", "doc_id")
    return _cut(joined)


def _cut(joined: DataFrame) -> DataFrame:
    def run(batches):
        for b in sliced(batches):
            for out in _kept([b]):
                yield pa.RecordBatch.from_arrays([out.column(0), b.column(3), *out.columns[1:]], ["_k", "doc_id", *out.schema.names[1:]])

    return joined.mapInArrow(run, "_k long, doc_id long, n_bytes long, n_removed long, spans array<struct<s:long,e:long>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their repeated passages (a character cut in half goes whole), n_chars renewed;
    documents that lost something and have nothing but white space left go."""
    cols = docs.columns
    df = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in cols if c not in ("text",)]).alias("_rest"))
    df = keyed(df, "doc_id", "text", ("_rest",))
    lists = repeated_spans(df).groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("_s"))
    joined = df.join(lists, F.col("_k") == F.col("k"), "left").select("_rest", "text", "_s")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, spans, strict=True):
            raw, at, parts = t.as_py().encode("utf-8", "surrogatepass"), 0, []
            for a, b in merge([(x["s"], x["e"]) for x in s.as_py() or ()]):
                parts.append(raw[at:a])
                at = b
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    changed = joined.where("_s is not null").select("_rest", cut("text", "_s").alias("text"))
    left = where_once(changed, F.col("text").rlike(r"[^\x20\x09-\x0D]")).unionAll(joined.where("_s is null").select("_rest", "text"))
    return left.select(*[F.col("text") if c == "text" else F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"_rest.{c}") for c in cols])


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, substr(h, i * 2 + 1, 2) AS b, CASE WHEN (i + 100) * 2 <= length(h) THEN substr(h, i * 2 + 1, 200) END AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
r AS (SELECT doc_id, i, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM p),
m AS (SELECT doc_id, i, b, coalesce(i - max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) < 100, false) AS gone FROM r),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
g AS (SELECT doc_id, sum(gone::INT) AS n_removed, sum(opens::INT) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
