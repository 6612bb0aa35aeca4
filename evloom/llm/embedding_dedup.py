"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on random directions, shifted and quantised; the quantised
projections of one table, with the label, are a bucket. Vectors that meet in a bucket are compared
exactly (cosine in double precision); a pair that meets in several tables counts in the first.
Equal vectors of one label are one node with a multiplicity. Buckets yield link counts per vector
and a spanning forest of their links, never their pairs; a bucket of more than `split` vectors is
cut into chunks and every pair of chunks is its own task.

With the defaults a pair at the threshold (distance 0.2) shares a bucket of one table with
probability 0.43, and of at least one of the tables with 0.9996; closer pairs more often.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors
with a null label, link with nothing; vectors of different lengths never meet; repeated rows
(same id) are separate vectors of that id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.session import ship, written

from .components import connected_components, forest

TABLES, PROJECTIONS, WIDTH, SEED = 14, 12, 2.25, 1729
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def bucket_keys(v: np.ndarray, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """(rows, tables) 64-bit bucket keys of normalised vectors."""
    rng = np.random.default_rng([seed, v.shape[1]])
    a, b = rng.standard_normal((v.shape[1], tables * projections)), rng.uniform(0, width, tables * projections)
    code = np.floor((v @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(v), tables, projections)
    key = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(1), (len(v), tables)) * _ODD
    for p in range(projections):
        key = _mix(key * _ODD + code[:, :, p])
    return key


def _normal(vectors: list) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of very large or small components would leave the range of doubles
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _post(tables: int, projections: int, width: float):
    """(node, label, many, v) -> one row per table: bucket, table, node, many, v and all keys of the vector."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                vectors = part.column(3).to_pylist()
                sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
                label = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    keys = bucket_keys(_normal([vectors[i] for i in rows]), tables, projections, width)
                    keys = _mix(keys ^ (label[rows] * _ODD + np.uint64(int(size)))[:, None])
                    take = pa.array(np.repeat(rows, tables))
                    own = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(keys, tables, axis=0).view(np.int64).ravel()), tables).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64).ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), part.column(0).take(take), part.column(2).take(take), part.column(3).take(take), own],
                        ["unit", "tab", "node", "many", "v", "keys"],
                    )

    return run


def _compare(least: float, block: int = 1024):
    """Rows sorted by unit (chunk pairs: side 0 and 1) -> links per node and forest edges (a, b, n; b null: n links of a)."""

    def bucket(tab, node, many, vectors, keys, side):
        v = _normal(vectors)
        links, ea, eb = np.zeros(len(node), np.int64), [], []
        across = side.min() != side.max()
        for i in range(0, len(node), block):
            for j in range(i, len(node), block):
                near = v[i : i + block] @ v[j : j + block].T >= least
                if i == j:
                    near &= np.triu(np.ones_like(near), 1)
                x, y = np.nonzero(near)
                x, y = x + i, y + j
                t = tab[0]
                ok = ~(keys[x, :t] == keys[y, :t]).any(axis=1) if t else np.ones(len(x), bool)
                if across:
                    ok &= side[x] != side[y]
                x, y = x[ok], y[ok]
                np.add.at(links, x, many[y])
                np.add.at(links, y, many[x])
                hi, lo = forest(node[x], node[y])
                ea.append(hi)
                eb.append(lo)
        hi, lo = forest(np.concatenate(ea), np.concatenate(eb))
        some = links > 0
        return np.concatenate([node[some], hi]), np.concatenate([np.zeros(some.sum(), np.int64), lo]), np.concatenate([links[some], np.zeros(len(hi), np.int64)])

    def run(batches):
        held = None

        def out(t):
            unit = t["unit"].to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            ends = np.append(cut[1:], len(unit))
            cols = [t[c].to_numpy() for c in ("tab", "node", "many", "side")]
            for s, e in zip(cut.tolist(), ends.tolist(), strict=True):
                if e - s > 1:
                    p = t.slice(s, e - s)
                    own = [c[s:e] for c in cols]
                    a, b, n = bucket(own[0], own[1], own[2], p["v"].to_pylist(), np.array(p["keys"].to_pylist(), np.int64), own[3])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=n > 0), pa.array(n)], ["a", "b", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            unit = t["unit"].to_numpy()
            end = int(np.searchsorted(unit, unit[-1]))
            if end:
                yield from out(t.slice(0, end))
            held = t.slice(end).combine_chunks()
        if held is not None and held.num_rows:
            yield from out(held)

    return run


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, split: int = 8192,
    id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(finite, F.col(vector).cast("array<double>")).alias("v"), F.col(label).cast("long").alias("l"))
    usable = df.where("v is not null and l is not null")
    same = usable.groupBy("l", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()), "vectors")
    post = nodes.select("node", "l", "many", "v").mapInArrow(_post(tables, projections, width), "unit long, tab int, node long, many long, v array<double>, keys array<long>")
    units = post.select("unit").groupBy("unit").count().where(F.col("count") > split)
    if units.limit(1).count():
        sizes = units.withColumn("c", F.ceil(F.col("count") / split).cast("int"))
        post = post.join(sizes, "unit", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("i", F.expr("cast(pmod(xxhash64(node), c) as int)"))
        post = post.withColumn("j", F.explode(F.expr("sequence(0, c - 1)")))
        post = post.select(F.expr("xxhash64(unit, least(i, j), greatest(i, j))").alias("unit"), "tab", "node", "many", "v", "keys", F.expr("if(i > j, 1, 0)").alias("side"))
    else:
        post = post.withColumn("side", F.lit(0))
    found = post.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare(least), "a long, b long, n long")
    found = written(found, "links")
    comp = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    rich = nodes.join(comp, nodes.node == comp["node"], "left").select(nodes["node"], "l", "v", "least", "many", F.coalesce("root", nodes["node"]).alias("root"))
    best = rich.groupBy("root").agg(F.min("least").alias("component_id"))
    rich = rich.join(best, "root").join(counts, F.col("node") == F.col("a"), "left")
    rich = rich.select("l", "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = usable.join(rich, ["l", "v"]).select("vec_id", "n_links", "component_id")
    rest = df.where("v is null or l is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.expr("vec_id <=> component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
  SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.c AS component_id, v.vec_id = r.c AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a JOIN r ON v.vec_id = r.a
"""
