"""Mixing sources to target weights by weighted sampling without replacement (native: DataFrame expressions only).

Every source gets a target number of words: all words together, shared by the sources' weights, no source above `most`
times its own size, what is too much shared again among the rest. Of a source, as many complete epochs are taken as its
target holds; the rest is a fractional epoch: each document draws an exponential key whose rate is its quality weight
(Efraimidis and Spirakis), documents are sorted by key within their source and taken until the prefix sum of their sizes
reaches the rest. The document on the border is taken up to the border, so a source gives its target rounded down.

Prefix sums are taken in blocks: rows are dealt by ranges of (source, key), block totals are summed before the blocks,
so a source with a third of all rows is many tasks. Only ids, sizes and keys move, never texts. Keys come from a digest
of id and text: reruns agree, whatever the partitions.

Defined results: a null text has size 0 and takes nothing; null ids are rows like any other; the null source is a source
of its own and comes last; equal rows have equal keys and are interchangeable; a source without words has target 0; an
empty table gives no rows. Input columns other than those of `keep` are not returned; a column of `keep` that has the
name of a result column gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evloom.session import written

from .quality_rules import SYMBOLS, WHITE, WORD

WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"
_BLOCK = 500_000  # rows of a block of the sorted order, about
_OUT = ("size", "source_size", "target", "taken", "epochs", "part")


def words(text: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str, size: str) -> Column:
    """The default weight of a document, above 0: symbols among its characters lower it to a twentieth at least, and short
    documents weigh less."""
    chars = F.length(F.translate(F.col(text), WHITE, ""))
    symbols = F.length(F.col(text)) - F.length(F.translate(F.col(text), SYMBOLS, ""))
    clean = F.greatest(F.lit(0.05), F.lit(1.0) - symbols * F.lit(10.0) / F.greatest(chars, F.lit(1)))
    return clean * ((F.col(size) + F.lit(10.0)) / (F.col(size) + F.lit(60.0)))


def _prefix(df: DataFrame, by: list[str], order: list[str], value: str, out: str, rows: int, block: int = _BLOCK) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one, in `order` within `by` (no nulls in either), in blocks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // block))
    dealt = written(df.repartitionByRange(n, *by, *order).withColumn("_b", F.spark_partition_id()), "mix-order")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_b").agg(F.sum(value).alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, [*by, "_b"])
    return dealt.withColumn(out, F.col("_before") + F.col("_in")).drop("_b", "_before", "_in")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sized (_none, _s, size: one row per document) -> per source: source_size, target, epochs (whole ones) and rest (words
    of the fractional epoch). Sources are ranked by code point, the null source last, and weigh `weights` in turn. Each
    round of sharing is one aggregate over the sources and fixes one source at least; one row comes to the driver."""
    found = sized.groupBy("_none", "_s").agg(F.sum("size").alias("source_size"))
    ranked = _prefix(found.withColumn("_one", F.lit(1).cast("long")), [], ["_none", "_s"], "_one", "_rank", 0)
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = written(ranked.withColumn("w", F.element_at(turn, (F.col("_rank") % len(weights)).cast("int") + 1)).drop("_one", "_rank"), "mix-sources")
    row = ranked.agg(F.sum("source_size").alias("all"), F.sum("w").alias("w")).first()
    every = rest = row["all"] or 0
    among = row["w"] or 1
    while True:
        above = F.expr(f"cast(w as decimal(38, 0)) * {rest}BD > cast(source_size as decimal(38, 0)) * {most * among}BD")
        got = ranked.agg(F.sum(F.when(above, F.col("source_size") * most)).alias("full"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        now = every - (got["full"] or 0), got["w"] or among
        if now == (rest, among):
            break
        rest, among = now
    whole = f"(cast(w as decimal(19, 0)) * {rest}BD)"
    out = ranked.withColumn("target", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(F.expr(f"cast({whole} as double) / {among}D")))
    out = out.withColumn("epochs", F.when(above, F.lit(most).cast("long")).when(F.col("source_size") > 0, F.expr(f"({whole} div {among}BD) div source_size")).otherwise(F.lit(0).cast("long")))
    rest_of = F.when(above, F.lit(0).cast("long")).when(F.col("source_size") > 0, F.expr(f"{whole} div {among}BD") - F.col("epochs") * F.col("source_size"))
    return out.withColumn("rest", F.coalesce(rest_of, F.lit(0).cast("long"))).drop("w")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED,
        keep: tuple[str, ...] = ("doc_id",), block: int = _BLOCK) -> DataFrame:
    """One row per document: the columns of `keep`, size, source_size, target (its source's), taken, epochs (times that it is
    taken whole) and part (words of it that the fractional epoch takes); taken = epochs * size + part. `weight`: the
    documents' quality weights, above 0 (default: quality())."""
    row = F.struct(*[F.col(c) for c in keep if c not in _OUT]) if set(keep) - set(_OUT) else F.struct(F.lit(1).alias("_"))
    given = [weight.cast("double").alias("_w")] if weight is not None else []
    df = docs.select(row.alias("_row"), F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(source).isNull().alias("_none"), F.coalesce(F.col(source), F.lit("")).alias("_s"), *given)
    df = df.withColumn("size", words("_text"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce("_id", F.lit("")), F.lit(":"), F.col("_text")))
    df = df.withColumn("_digest", digest).withColumn("_weight", F.col("_w") if given else quality("_text", "size"))
    draw = (F.conv(F.substring("_digest", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0)
    sized = written(df.select("_row", "_none", "_s", "size", "_digest", (-F.log(draw) / F.col("_weight")).alias("_key")), "mix-sized")
    of = written(targets(sized, weights, most), "mix-targets")
    rows = sized.agg(F.count("*").alias("n")).first()["n"]
    placed = _prefix(sized, ["_none", "_s"], ["_key", "_digest", "size"], "size", "_at", rows, block).join(of, ["_none", "_s"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_at"))).cast("long")
    out = placed.withColumn("part", part).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return out.select(*(["_row.*"] if set(keep) - set(_OUT) else []), *_OUT)


def texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """mix(..., keep=(..., text)) -> the mix itself: a row per epoch of a document with its whole text, and a row with its
    first `part` words where the fractional epoch takes a part."""
    whole = mixed.where("epochs > 0").withColumn("_e", F.explode(F.expr("sequence(1, epochs)"))).drop("_e")
    cut = F.when(F.col("part") >= F.col("size"), F.col(text)).otherwise(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")), " "))
    return whole.unionByName(mixed.where("part > 0").withColumn(text, cut))


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")


SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols, md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, ''), ':', t)) AS h FROM t),
k AS (SELECT *, -ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / (greatest(0.05::DOUBLE, 1.0::DOUBLE - symbols * 10.0::DOUBLE / greatest(chars, 1)) * ((size + 10.0::DOUBLE) / (size + 60.0::DOUBLE))) AS key FROM m),
s AS (SELECT source, size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM (SELECT source, sum(size)::BIGINT AS size FROM m GROUP BY source)),
o AS (SELECT *, row_number() OVER (ORDER BY size / w, w, source NULLS LAST) AS pos FROM s),
l AS (SELECT *, sum(size) OVER ()::BIGINT - {MOST} * coalesce(sum(size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
  sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS among FROM o),
f AS (SELECT pos AS first, rest, among FROM l WHERE w::HUGEINT * rest <= size::HUGEINT * {MOST} * among ORDER BY pos LIMIT 1),
g AS (SELECT source, size AS source_size, CASE WHEN pos < first THEN ({MOST} * size)::DOUBLE ELSE (w * rest)::DOUBLE / among END AS target,
  CASE WHEN pos < first THEN {MOST} WHEN size > 0 THEN (w * rest // among) // size ELSE 0 END AS epochs, CASE WHEN pos < first OR size = 0 THEN 0 ELSE (w * rest // among) % size END AS left_ FROM o, f),
a AS (SELECT k.*, source_size, target, epochs::BIGINT AS epochs, left_ - coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, free)))::BIGINT AS taken, epochs, greatest(0, least(size, free))::BIGINT AS part FROM a
"""
