"""Order within a group without one task per group: rows are placed in blocks of the time axis, windows run inside
blocks, and what crosses a block's border (a neighbour, a count, a sum) comes from one row per block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 3600.0


def _blocked(df: DataFrame, at: str, width: float) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(at) / width))


def placed(df: DataFrame, fields: tuple[str, ...], per: tuple[str, ...] = ("video_id",), order: tuple[str, ...] = ("ts", "seq"), width: float = WIDTH) -> DataFrame:
    """df with `i` (place in its group from 0) and `before`, `after`: structs of `fields` of the neighbours, or null.
    The first of `order` must be a number; rows that tie in all of `order` are in any order among themselves."""
    df = _blocked(df, order[0], width)
    w, key, item = Window.partitionBy(*per, "_b").orderBy(*order), [*per, "_b"], F.struct(*fields)
    edge = df.groupBy(*key).agg(F.count("*").alias("_n"), F.min_by(item, F.struct(*order)).alias("_f"), F.max_by(item, F.struct(*order)).alias("_l"))
    v = Window.partitionBy(*per).orderBy("_b")
    past = v.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*key, F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_o"), F.lag("_l").over(v).alias("_p"), F.lead("_f").over(v).alias("_q"))
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("before", F.lag(item).over(w)).withColumn("after", F.lead(item).over(w)).join(edge, key)
    df = df.withColumn("i", F.col("_o") + F.col("_i") - 1).withColumn("before", F.coalesce("before", "_p")).withColumn("after", F.coalesce("after", "_q"))
    return df.drop("_b", "_i", "_o", "_p", "_q")


def running(df: DataFrame, value: str, name: str, per: tuple[str, ...] = ("video_id",), order: tuple[str, ...] = ("ts", "seq"), width: float = WIDTH) -> DataFrame:
    """df with `name`: the sum of `value` over the group's rows up to this one."""
    df = _blocked(df, order[0], width)
    key = [*per, "_b"]
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*per).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = df.groupBy(*key).agg(F.sum(value).alias("_s")).select(*key, F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_o"))
    return df.withColumn("_r", F.sum(value).over(w)).join(edge, key).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def latest(df: DataFrame, value: str, name: str, per: tuple[str, ...] = ("video_id",), order: tuple[str, ...] = ("ts", "seq"), width: float = WIDTH) -> DataFrame:
    """df with `name`: the last value that is not null up to this row, however far back: carried inside blocks, and from
    block to block by one row each."""
    df = _blocked(df, order[0], width)
    key = [*per, "_b"]
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*per).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = df.groupBy(*key).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_l")).select(*key, F.last("_l", True).over(past).alias("_o"))
    return df.withColumn("_r", F.last(value, True).over(w)).join(edge, key).withColumn(name, F.coalesce("_r", "_o")).drop("_b", "_r", "_o")


def haloed(df: DataFrame, after: bool = False, per: str = "video_id", order: tuple[str, ...] = ("ts", "seq"), width: float = WIDTH) -> DataFrame:
    """df dealt by blocks of the time axis and sorted inside them, each block with the last row of the block before it
    (`_side` -1) and, with `after`, the first row of the next one (`_side` 1): what a block needs to see all neighbours of its
    own rows (`_side` 0). Only the rows at the borders travel twice; where they lie is known from `per` and `order` alone."""
    df = _blocked(df, order[0], width)
    at = F.struct(*order)
    edge = df.groupBy(per, "_b").agg(F.min(at).alias("_f"), F.max(at).alias("_l"))
    v = Window.partitionBy(per).orderBy("_b")
    edge = edge.withColumn("_next", F.lead("_b").over(v)).withColumn("_past", F.lag("_b").over(v))
    send = edge.where("_next is not null").select(per, "_l.*", F.col("_next").alias("_to"), F.lit(-1).alias("_side"))
    if after:
        send = send.unionByName(edge.where("_past is not null").select(per, "_f.*", F.col("_past").alias("_to"), F.lit(1).alias("_side")))
    halo = df.drop("_b").join(send.withColumnRenamed("_to", "_b"), [per, *order])
    return df.withColumn("_side", F.lit(0)).unionByName(halo).repartition(per, "_b").sortWithinPartitions(per, "_b", *order)
