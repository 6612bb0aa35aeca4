"""Packing token pieces into fixed-length sequences by cutting-stock column generation.

Documents are cut into whole sequences and one remainder. The remainders' length histogram, in
units of a few tokens (a table of fixed size), is a cutting-stock problem on the driver: a linear
program over patterns whose columns are priced by a knapsack dynamic program; patterns are rounded
down and the few items left over are packed first-fit. The patterns are then dealt to the pieces
by rank: each length class is ranked over blocks of rows (block counts, then ranks inside blocks),
and rank arithmetic gives sequence and slot, so nothing large meets in one task.

Defined results: a null text is empty and holds the closing id alone; repeated rows are separate
documents; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evloom.session import ship, written

from .bpe import ByteBPE, recall, splitter

LENGTH = 2048
UNIT = 8
CLOSING_ID = 1
BLOCK_ROWS = 100_000
WORDS_HELD = 300_000  # words that a worker remembers, twice (about 200 bytes each)
WORDS_HELD_BESIDE = 100_000  # the same where workers also serve other stages
# The splitting pattern of this tokenizer family, as published in its file.
FAST = "[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^{S}{L}{N}]+"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, worked out once per word.

    The file's normalizer (NFC, white space, lower case) and pattern are applied here; each distinct
    word is encoded in rank-array batches and remembered (bounded). Texts with added tokens, or with
    code points younger than this Python's Unicode table, go to the library whole.
    """

    def __init__(self, spec: str, most: int = WORDS_HELD):
        self.most = most
        self.spec, self.tok = spec, None
        self.split, self.bpe = splitter(PATTERN, FAST), ByteBPE(spec)
        self.added = list(self.bpe.added)
        self.held: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        if self.tok is None:  # few texts need the library
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_str(self.spec)
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if len(self.held) > self.most:
            self.older, self.held = self.held, {}
        held, split = self.held, []
        for t in texts:
            if any(a in t for a in self.added):
                split.append(None)
                continue
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")  # the library lower-cases letter by letter
            split.append(self.split(t.lower()))
        new = recall(list(set(itertools.chain.from_iterable(ws for ws in split if ws)).difference(held)), held, self.older)
        if new:
            held.update(zip(new, self.bpe.words_to_ids([w.encode() for w in new]), strict=True))
            odd = {c for c in set("".join(new)) if unicodedata.category(c) == "Cn"}
            if odd:
                held.update((w, None) for w in new if not odd.isdisjoint(w))
        out = []
        for t, ws in zip(texts, split, strict=True):
            try:
                out.append(self._whole(t) if ws is None else b"".join(map(held.__getitem__, ws)))
            except TypeError:  # a word that must be seen in its text
                out.append(self._whole(t))
        return out


_MADE: dict[int, WordIds] = {}


def token_pieces(
    docs: DataFrame, path: str, length: int = LENGTH, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, words_held: int = WORDS_HELD
) -> DataFrame:
    """Pieces of at most `length` ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    end = np.int32(closing_id).tobytes()

    def run(batches):
        key = hash((spec.value, words_held))
        if key not in _MADE:
            _MADE[key] = WordIds(spec.value, words_held)
        model = _MADE[key]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                doc, start, size, crc, total, ids = [], [], [], [], [], []
                for d, raw in zip(part.column(0).to_pylist(), model.encode_batch([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for s in range(0, n, length):
                        piece = raw[4 * s : 4 * (s + length)]
                        doc.append(d)
                        start.append(s)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(piece, np.int32))
                cols = [pa.array(x, pa.int64()) for x in (doc, start, size, crc, total)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Most value of items (any number of each) in `room`, and how many of each."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(size)
    v, w = value[order], size[order]
    fits = np.searchsorted(w, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c], n = best[c - 1], fits[c]
        if n:
            x = v[:n] + best[c - w[:n]]
            i = int(x.argmax())
            if x[i] > best[c] + 1e-12:
                best[c], take[c] = x[i], i
    many, c = np.zeros(len(value), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            many[order[take[c]]] += 1
            c -= w[take[c]]
    return float(best[room]), many


def patterns(counts: dict[int, int], room: int = LENGTH // UNIT, gap: float = 5e-4, smooth: float = 0.8, most_rounds: int = 8000) -> list[tuple[dict[int, int], int]]:
    """Cutting patterns ({units: how many}, times used) that hold every item of the histogram exactly once.

    Column generation (revised simplex, explicit inverse) until the master's value is within `gap` of
    the best bound; columns are priced at duals smoothed toward those of the best bound, and at the
    true ones where that finds none. Patterns are rounded down, the rest is packed first-fit decreasing.
    """
    out = [({c: 1}, n) for c, n in counts.items() if c >= room and n]
    size = np.array(sorted(c for c, n in counts.items() if c < room and n), np.int64)
    if not len(size):
        return out
    need = np.array([counts[c] for c in size], float)
    cols = np.diag(room // size).astype(float)
    full = need + 1e-3 * np.random.default_rng(0).random(len(size))  # a nudge against degenerate steps
    inverse, x = np.diag(1.0 / (room // size)), full / (room // size)
    best, center = 0.0, np.ones(len(size)) @ inverse
    for _ in range(most_rounds):
        price = np.ones(len(size)) @ inverse
        for dual in (np.maximum(smooth * center + (1 - smooth) * price, 0), np.maximum(price, 0)):
            worth, many = knapsack(dual, size, room)
            if full @ dual / max(1.0, worth) > best:
                best, center = full @ dual / max(1.0, worth), dual / max(1.0, worth)
            if price @ many > 1 + 1e-9:
                break
        else:
            break
        if x.sum() - best <= gap * x.sum():
            break
        step = inverse @ many
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            break
        cols[:, r] = many
        x -= ratio[r] * step
        x[r] = ratio[r]
        x = np.maximum(x, 0)
        row = inverse[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
    left = need.astype(np.int64).copy()
    for p in np.argsort(-x):
        times = int(x[p] + 1e-6)
        a = cols[:, p].astype(np.int64)
        if times and a.any():
            times = min(times, int((left[a > 0] // a[a > 0]).min()))
        if times > 0 and a.any():
            left -= times * a
            out.append(({int(c): int(k) for c, k in zip(size, a, strict=True) if k}, times))
    bins: list[tuple[int, dict[int, int]]] = []
    for c, n in sorted(zip(size.tolist(), left.tolist(), strict=True), reverse=True):
        for _ in range(n):
            for i, (free, bin_) in enumerate(bins):
                if free >= c:
                    bin_[c] = bin_.get(c, 0) + 1
                    bins[i] = (free - c, bin_)
                    break
            else:
                bins.append((room - c, {c: 1}))
    return out + [(b, 1) for _, b in bins]


def _deal(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """Per class: (first rank, end rank, items a sequence, first sequence, first slot) of each pattern."""
    seen: dict[int, int] = {}
    deal: dict[int, list] = {}
    base = 0
    for bin_, times in plan:
        slot = 0
        for c in sorted(bin_, reverse=True):
            lo = seen.get(c, 0)
            seen[c] = lo + bin_[c] * times
            deal.setdefault(c, []).append((lo, seen[c], bin_[c], base, slot))
            slot += bin_[c]
        base += times
    return sorted(deal.items())


def pack(pieces: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """pieces (any columns, with doc_id, start and length <= `length`) plus sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("_c", F.expr(f"cast((length + {unit - 1}) div {unit} as int)")), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("_c").count().collect()}  # at most length / unit rows
    total = sum(counts.values())
    room = length // unit
    plan = patterns({min(c, room): n for c, n in counts.items()}, room)
    deal = spark.createDataFrame(_deal(plan) or [(0, [])], "_c int, _deal array<struct<lo:long,hi:long,a:long,base:long,slot:long>>")
    blocks = max(1, -(-total // BLOCK_ROWS))
    keyed = pieces.withColumn("_b", F.expr(f"pmod(xxhash64(doc_id, start), {blocks})"))
    tally = keyed.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    before = tally.withColumn("_before", F.sum("_n").over(Window.partitionBy("_c").orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_c", "_b").orderBy("doc_id", "start", "ids_crc32" if "ids_crc32" in pieces.columns else "length"))
    ranked = keyed.withColumn("_in", inside - 1).join(before, ["_c", "_b"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    dealt = ranked.join(F.broadcast(deal), "_c")  # a table of at most length / unit rows
    dealt = dealt.withColumn("_d", F.expr("filter(_deal, d -> _rank >= d.lo and _rank < d.hi)[0]"))
    dealt = dealt.withColumn("sequence_id", F.expr("_d.base + (_rank - _d.lo) div _d.a")).withColumn("_slot", F.expr("_d.slot + (_rank - _d.lo) % _d.a"))
    run = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_slot")) - F.col("length")
    return dealt.withColumn("offset", run).drop("_c", "_b", "_in", "_before", "_rank", "_deal", "_d", "_slot")


def sequences(packed: DataFrame) -> DataFrame:
    """The training rows: sequence_id, ids (pieces in order) and where each piece came from; at most `length` ids a row."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return rows.select(
        "sequence_id", F.expr("flatten(transform(_p, p -> p.ids))").alias("ids"), F.expr("transform(_p, p -> struct(p.offset, p.doc_id, p.start, p.length))").alias("parts")
    )


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_pieces(docs, _default_path()))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces of the documents that are left."""
    return pack(token_pieces(docs, _default_path(), words_held=WORDS_HELD_BESIDE))
