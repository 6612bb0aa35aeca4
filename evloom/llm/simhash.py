"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most four bits
differ in at most four bytes, so they share at least four positional bytes. Twenty byte triples
are chosen such that every four positions hold one of them; each distinct fingerprint is posted
under its twenty triples, pairs are tallied inside a posting list, pairs that share fewer than
four bytes are discarded and the rest verified bit by bit. Nothing within the threshold is lost.

Equal fingerprints are one node. A posting list emits a spanning forest of its links, never its
pairs. Lists longer than `split` are cut into chunks and every pair of chunks is its own task.

Defined results: null or wordless texts have fingerprint zero and link like any other; a null
doc_id keeps its row, never becomes a component id unless the component has nothing else;
repeated rows stay repeated rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.session import alone, discard, ship, sliced, written

from .components import connected_components, forest
from .suffix_dedup import keyed

SEED = 42
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, int, int]]:
    """Byte triples such that each set of four of the eight positions contains one of them."""
    out = [g for g in _GROUPS if len(g) == 3]
    for i, g in enumerate(_GROUPS):
        for x in range(len(g)):
            for y in range(x + 1, len(g)):
                out += [(g[x], g[y], z) for z in _GROUPS[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in out]


def shingle_hashes(text: str | None, n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every n-word shingle of one text, repeats included; fewer words: of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count, digest = max(1, len(words) - n + 1), xxhash.xxh64_intdigest
    last = np.append(ends[n - 1 :], ends[-1:])[:count]
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:count].tolist(), last.tolist(), strict=True)), np.uint64, count)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 100_000):  # bounded memory for very long texts
        total += np.unpackbits(h[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, n: int = 4) -> int:
    """The 64-bit SimHash of one text over n-word shingles."""
    return majority(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed long). No shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, fp long")


def linked(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each list fps[start:end]."""
    a, b = [], []
    sizes = ends - starts

    def near(x, y):
        z = x ^ y
        shared = (z.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)  # the tally of positional bytes
        keep = shared >= 8 - bits
        keep[keep] = np.bitwise_count(z[keep]) <= bits
        return keep

    few = (sizes > 1) & (sizes <= small)
    s, n = starts[few], sizes[few]
    for gap in range(1, int(n.max()) if len(n) else 0):
        s, n = s[n > gap], n[n > gap]
        reps = n - gap
        left = np.repeat(s - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        ok = near(fps[left], fps[left + gap])
        a.append(fps[left[ok]])
        b.append(fps[left[ok] + gap])
    for at, to in zip(starts[sizes > small].tolist(), ends[sizes > small].tolist(), strict=True):
        rest = np.unique(fps[at:to])
        while len(rest):  # breadth first: what is reached leaves the list, so dense groups cost little
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                hit = near(rest, np.full(len(rest), x, np.uint64))
                found = rest[hit]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                todo += found.tolist()
                rest = rest[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def _lists(bits: int):
    """Rows (unit, fp) sorted by unit -> forest edges (a, b). A list cut by a batch border is carried over."""

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(k, f):
            if len(k) < 2:
                return None
            cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            x, y = linked(f, cut, np.append(cut[1:], len(k)), bits)
            if not len(x):
                return None
            x, y = forest(x.view(np.int64), y.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(keys):
                continue
            end = int(np.searchsorted(keys, keys[-1]))  # the last list may go on
            if end and (out := edges(keys[:end], fps[:end])) is not None:
                yield out
            keys, fps = keys[end:], fps[end:]
        if (out := edges(keys, fps)) is not None:
            yield out

    return run


def near_components(prints: DataFrame, bits: int = 4, split: int = 50_000) -> DataFrame:
    """prints (doc_id, fp) -> (fp, root, component_id): one row per distinct fingerprint."""
    spark = prints.sparkSession
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps", few=True)
    posts = []
    for i, t in enumerate(triples()):
        key = " | ".join(f"shiftleft(shiftrightunsigned(fp, {8 * p}) & 255, {8 * j})" for j, p in enumerate(t))
        posts.append(f"{i << 24} | {key}")
    posted = nodes.select(F.explode(F.array(*[F.expr(p).cast("long") for p in posts])).alias("unit"), "fp")
    long = [r[0:2] for r in posted.groupBy("unit").count().where(F.col("count") > split).limit(1).collect()]
    if long:  # cut long lists: every pair of chunks meets in a unit of its own
        sizes = posted.groupBy("unit").count().where(F.col("count") > split).withColumn("c", F.ceil(F.col("count") / split).cast("int"))
        many = posted.join(sizes, "unit", "left").withColumn("c", F.coalesce("c", F.lit(1)))
        many = many.withColumn("i", F.expr("cast(pmod(xxhash64(fp), c) as int)"))
        posted = many.select(
            F.col("unit"), F.col("fp"), F.col("i"), F.explode(F.expr("sequence(0, c - 1)")).alias("j")
        ).select(F.expr("xxhash64(unit, least(i, j), greatest(i, j))").alias("unit"), "fp")
    edges = posted.repartition("unit").sortWithinPartitions("unit").mapInArrow(_lists(bits), "a long, b long")
    ship(spark)
    comp = connected_components(edges)
    # each node, with its root, or alone; then the smallest doc_id of every component
    joined = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "roots", few=True)
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(best, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, id_col, text_col, words), "prints")
    comp = near_components(prints, bits).drop("root")
    return prints.join(comp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# --- near copies beyond four bits, for the pipeline

SAMPLE, COMMON = 10_000, 200_000  # documents and shingles that shape the order of prefixes; results do not depend on them
_SKETCH = 1024
SETS = "node long, s array<long>, n int, w binary"


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set in a fixed order (rare ones first): two sets with a Jaccard similarity of `least` share one of them."""
    known, count = common
    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
    rank = np.where(known[at] == s, count[at], 0) if len(known) else np.zeros(len(s), np.int64)
    return s[np.lexsort((s, _mixed(s), rank))[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]]


def sketch(s: np.ndarray, cells: int = _SKETCH) -> np.ndarray:
    """Parities of a set's hashes in 1024 cells, or the next power of two from `cells`: two sketches differ in no more cells than the sets in elements."""
    size = max(_SKETCH, 1 << (cells - 1).bit_length())
    return np.packbits(np.bincount((_mixed(s, 1) % np.uint64(size)).astype(np.int64), minlength=size) & 1 == 1, bitorder="little")


def _wide_prints(sent, words: int, least: float):
    """(id, text) -> id, the contract's fingerprint, the shingle set's hash, size and sketch, and its prefix."""

    def run(batches):
        common = sent.value
        for b in sliced(batches):
            rows = []
            for t in b.column(1):
                text = t.as_py()
                s = np.unique(shingle_hashes(text, words))
                rows.append((fingerprint(text), xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), sketch(s).tobytes(), prefix(s, common, least).view(np.int64)))
            fp, node, n, bits, first = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, node)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *longs, pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "fp", "node", "n", "sketch", "first"]
            )

    return run


def _by_unit(act):
    """Rows sorted by unit (first column) -> what `act` yields for the columns of whole lists; a list cut by a batch border is carried over."""

    def run(batches):
        held, rows = [], 0
        last = None

        def whole():
            t = pa.Table.from_batches(held)
            unit = t.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            return t, cut

        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= 100_000 and batch.column(0)[batch.num_rows - 1].as_py() != last:
                held.append(batch)
                t, cut = whole()
                end = int(cut[-1])
                yield from act(t.slice(0, end), cut[:-1])
                held = t.slice(end).to_batches()
                rows = t.num_rows - end
            else:
                held.append(batch)
                rows += batch.num_rows
            last = batch.column(0)[batch.num_rows - 1].as_py()
        if held:
            yield from act(*whole())

    return run


def _shared(batches):
    """Rows sorted by unit (first column) -> those whose unit has a second row; of what went before only one row is held."""
    last = None  # the row before, if nothing was told of it yet
    told = None  # the unit whose rows are being told
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if last is None else [last, b])
        unit = t.column(0).to_numpy()
        same = unit[1:] == unit[:-1]
        keep = np.zeros(len(unit), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep |= unit == told if told is not None else False
        told = int(unit[-1]) if keep[-1] else None
        last = None if keep[-1] else t.slice(t.num_rows - 1).combine_chunks().to_batches()[0]
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def _links(least: float, stars: int, cells: int = 1_000_000, small: int = 48, most: int = 50_000):
    """Lists (unit, node, comp, n, pos, sketch) -> pairs (a, b) of different components that may be similar: each member with `stars`
    members of its list, or for 0 all pairs. Left out are only pairs that cannot reach `least`: by sizes and places in the prefix
    (a similar pair passes at the first shingle that it shares), or because sketches differ in too many cells."""

    def act(t, cut):
        node, comp, n, pos = (t.column(i).to_numpy() for i in range(1, 5))
        bits = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint64).reshape(-1, _SKETCH // 64)
        ends = np.append(cut[1:], t.num_rows)
        share = least / (1 + least)

        def cheap(i, j):
            both = n[i] + n[j]
            return (comp[i] != comp[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= share * both - 1e-9)

        def out(i, j):
            for at in range(0, len(i), most):
                x, y = i[at : at + most], j[at : at + most]
                ok = cheap(x, y)
                x, y = x[ok], y[ok]
                ok = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= (1 - 2 * share) * (n[x] + n[y]) + 1e-9
                x, y = node[x[ok]], node[y[ok]]
                if len(x):
                    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        sizes = ends - cut
        if stars:
            unit = np.repeat(np.arange(len(cut)), sizes)
            for seed in range(2, 2 + stars):
                lead = np.lexsort((_mixed(node.view(np.uint64), seed), unit))[cut]
                yield from out(np.arange(len(node)), np.repeat(lead, sizes))
            return
        open_ = np.minimum.reduceat(comp, cut) != np.maximum.reduceat(comp, cut) if len(cut) else np.zeros(0, bool)
        s, k = cut[open_ & (sizes <= small)], sizes[open_ & (sizes <= small)]
        for gap in range(1, small):
            s, k = s[k > gap], k[k > gap]
            reps = k - gap
            i = np.repeat(s - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            yield from out(i, i + gap)
        for at, to in zip(cut[open_ & (sizes > small)].tolist(), ends[open_ & (sizes > small)].tolist(), strict=True):
            c = at
            while c < to:  # so many rows at once that a block has at most about `cells` pairs
                end = min(to, c + max(1, cells // (to - c)))
                i, j = np.arange(c, end)[:, None], np.arange(c, to)[None, :]
                x, y = np.nonzero(cheap(i, j) & (i < j))
                yield from out(c + x, c + y)
                c = end

    return act


def _shingle_sets(words: int):
    def run(batches):
        for b in sliced(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            held = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s, 4 * len(s)).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *held], ["node", "s", "n", "w"])

    return run


def apart(a: bytes, b: bytes) -> int:
    """In how many cells two sketches differ, the larger one folded to the size of the smaller: at most as many as elements of the sets."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _likely(least: float):
    """Pairs with their sets' sizes and wide sketches -> those that may reach `least`."""

    def run(batches):
        for t in batches:
            rows = zip(*(t.column(i).to_pylist() for i in range(2, 6)), strict=True)
            keep = [apart(x, y) <= (1 - 2 * least / (1 + least)) * (m + n) + 1e-9 for m, x, n, y in rows]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample shows often, sorted, and how often: they go last in prefixes, so lists stay short. Any order gives the same links."""
    n = docs.count()
    some = docs if n <= SAMPLE else docs.where(F.pmod(F.xxhash64("_k", F.lit(5)), F.lit(2**62)) < 2**62 * SAMPLE // n)
    seen = some.select("_k", "text").mapInArrow(_shingle_sets(words), SETS).select(F.explode("s").alias("h")).groupBy("h").count()
    got = seen.where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toPandas()  # at most COMMON rows
    h, c = got["h"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _cut(full: DataFrame, sizes: DataFrame, split: int, pairs: bool) -> DataFrame:
    """Lists longer than `split` in chunks; with `pairs` every two chunks of a list meet in a unit of their own."""
    long = sizes.where(F.col("count") > split).select("unit", F.ceil(F.col("count") / split).cast("int").alias("c"))
    if not long.limit(1).count():
        return full
    full = full.join(long, "unit", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("i", F.expr("cast(pmod(xxhash64(node), c) as int)"))
    if not pairs:
        return full.withColumn("unit", F.expr("if(c = 1, unit, xxhash64(unit, i))"))
    full = full.withColumn("j", F.explode(F.expr("sequence(0, c - 1)")))
    return full.withColumn("unit", F.expr("if(c = 1, unit, xxhash64(unit, least(i, j), greatest(i, j)))"))


def _verified(found: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs of nodes -> those whose sets have a Jaccard similarity of `least` or more. Only texts of candidates are read again, and
    only what passes a wide sketch (of about half a bit per byte of text) meets as whole sets."""
    wanted = found.select(F.col("a").alias("node")).unionAll(found.select("b")).distinct()
    leads = written(nodes.join(wanted, "node").select("least", "node"), "wanted", few=True)
    texts = docs.select("_k", "text").join(leads, F.col("_k") == F.col("least")).select("node", "text")
    whole = sets = written(texts.mapInArrow(_shingle_sets(words), SETS), "sets")
    side = lambda c, *cols: sets.select(F.col("node").alias(c), *[F.col(x).alias(x + c) for x in cols])
    likely = found.join(side("a", "n", "w"), "a").join(side("b", "n", "w"), "b").select("a", "b", "na", "wa", "nb", "wb")
    likely = written(likely.mapInArrow(_likely(least), "a long, b long"), "likely")
    ends = written(likely.select(F.col("a").alias("node")).unionAll(likely.select("b")).distinct(), "ends", few=True)
    sets = sets.join(ends, "node", "left_semi")
    both = likely.join(side("a", "s"), "a").join(side("b", "s"), "b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
    near = written(both.where(F.col("n") >= F.lit(least) * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b"), "similar", few=True)
    discard(whole)
    discard(leads)
    return near


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8, split: int = 20_000, stars: int = 4) -> DataFrame:
    """docs (_k unique, text) -> (_k, group): one row per document, `group` the smallest _k of its group. A group holds what
    op8's links join (four-word fingerprints within four bits) and near copies: texts with a Jaccard similarity of `least`
    or more over their distinct `words`-word shingles. No such pair is missed: sets are posted under the shingles of their
    prefixes, and two that are similar share one. Equal sets are one node. First each member of a list meets a few others
    of it, so large groups come together without their pairs; then all pairs of a list that are still in different
    components are checked, in lists that hold more than one component, in blocks of bounded size. Lists beyond `split` are cut in chunks, and for the
    second step chunks meet pairwise. A null text is an empty one; all texts without a word are one group, and none is
    near a text with words but through op8's links."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(_common(docs, words))
    prints = docs.select("_k", "text").mapInArrow(_wide_prints(sent, words, least), "doc_id long, fp long, node long, n int, sketch binary, first array<long>")
    prints = written(prints, "prints")
    comp = near_components(prints.select("doc_id", "fp"))
    roots = written(prints.select("fp", "node").distinct().join(comp, "fp").select("node", "root").distinct(), "noderoots", few=True)
    first = roots.groupBy("root").agg(F.min("node").alias("m"))
    same = roots.join(first, "root").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes", few=True)
    leaders = prints.join(nodes.withColumnRenamed("node", "_node"), F.col("doc_id") == F.col("least"))
    posted = leaders.select("node", "n", F.posexplode("first").alias("pos", "unit")).select("unit", "node", "n", "pos")
    lists = written(posted.repartition("unit").sortWithinPartitions("unit").mapInArrow(_shared, "unit long, node long, n int, pos int"), "lists")
    bits = written(leaders.select("node", "sketch").join(lists.select("node").distinct(), "node"), "sketches")
    groups = connected_components(same)
    for n in (stars, 0):
        full = lists.join(groups.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if n:
            full = _cut(full, lists.groupBy("unit").count(), split, False)
        else:
            stats = full.groupBy("unit").agg(F.count("*").alias("count"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
            stats = written(stats.where("_lo <> _hi").select("unit", "count"), "open", few=True)
            full = _cut(full.join(stats.select("unit"), "unit"), stats, split, True)
        full = full.join(bits, "node").select("unit", "node", "comp", "n", "pos", "sketch")
        found = written(full.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_unit(_links(least, n)), "a long, b long").distinct(), "candidates", few=True)
        groups = connected_components(_verified(found, docs, nodes, words, least).unionAll(groups.toDF("a", "b")))
    rich = nodes.join(groups.withColumnRenamed("root", "g"), "node", "left").select("node", "least", F.coalesce("g", "node").alias("g"))
    best = rich.groupBy("g").agg(F.min("least").alias("group"))
    best = rich.join(best, "g").select("node", "group")
    for used in (lists, bits):
        discard(used)
    return prints.select(F.col("doc_id").alias("_k"), "node").join(best, "node").select("_k", "group")


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, split: int = 20_000, stars: int = 4) -> DataFrame:
    """docs (_k unique, text) -> the smallest _k of every group of near_groups, which see."""
    return near_groups(docs, words, least, split, stars).where("_k = group").select("_k")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group (smallest doc_id, nulls last, then smallest text), with all its columns. Groups
    are near_groups(): op8's count filter joins fingerprints within four bits, and a prefix join of shingle sets beside it
    finds every pair with a similarity of 0.8 or more, which four bits mostly miss."""
    cols = docs.columns
    df = keyed(docs.select("doc_id", "text", F.struct(*cols).alias("_doc")), "doc_id", "text", ("_doc",))
    copies = alone(lambda: near_groups(df).where("_k <> group").select("_k").coalesce(4 * spark.sparkContext.defaultParallelism), "copies")  # fewer than the rest: the texts need not move
    return df.join(copies, "_k", "left_anti").select("_doc.*")
