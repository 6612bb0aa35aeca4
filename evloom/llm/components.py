"""Distributed connected components over edge tables of longs (star contraction).

Partitions first shrink their edges to a spanning forest (union-find, output no larger than
input); then large-star and small-star rounds hang every node below the smallest of its
component. Each round is written to the shared folder, so lost executors cost one round at most.
Hub nodes appear as join keys on one side only, where adaptive execution splits them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.session import discard, ship, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for edges a-b, without rows for the roots."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = lo != hi
        if not open_.any():
            break
        x, y, lo, hi = x[open_], y[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _shrink(batches, most: int = 4_000_000):
    """Forests of up to `most` edges at a time: memory stays bounded for any partition."""
    held: list[pa.RecordBatch] = []
    n = 0

    def out():
        a = np.concatenate([x.column(0).to_numpy(zero_copy_only=False) for x in held])
        b = np.concatenate([x.column(1).to_numpy(zero_copy_only=False) for x in held])
        hi, lo = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a long, b long; nulls are ignored) -> (node, root): every node that has an edge to
    another node, root being the smallest node that it reaches. Self-links and repeats change nothing."""
    spark = edges.sparkSession
    ship(spark)
    e = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    e = written(e.mapInArrow(_shrink, "a long, b long").distinct(), "edges", few=True)
    seen = None
    for _ in range(most_rounds):
        sym = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = (
            sym.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # every row of `large` points down already: (node, smaller neighbour)
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = (
            large.join(least, F.col("a") == F.col("n"))
            .select(F.expr("inline(array(struct(a as x, m as y), struct(b as x, m as y)))"))
            .where("x <> y")
            .distinct()
            .toDF("a", "b")
        )
        new = written(small, "edges", few=True)
        row = new.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(20,0))"))).first()
        discard(e)
        e = new
        if tuple(row) == seen:
            break
        seen = tuple(row)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
