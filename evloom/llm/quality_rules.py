"""Quality rules kept as a bitmask ledger (native: DataFrame expressions only).

Every rule is evaluated once per document and its outcome stored as a bit beside the
measurements. Policies are versioned sets of bits, applied afterwards without reading a
text again; ablations are counts over the stored masks.

Defined results: a null text has no words; an empty text likewise (both fail min_words).
Lines are split at newlines only. Extra input columns are dropped unless named in `keep`;
columns of `keep` that clash with a ledger column are replaced by the ledger's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.session import where_once

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

# rule name -> SQL over the measurements; true means the document fails. The order fixes the bits.
RULES: dict[str, str] = {
    "min_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_words": "10 * n_symbols > n_words * 3",
    "dup_lines": "10 * n_dup_lines > 4 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 16 * n_words",
    "max_words": "n_words > 100000",
}
BASE = ("min_words", "repeat_words")
# policy version -> rules that it applies
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbol_words", "dup_lines", "short_words", "long_words"),
    "strict": tuple(RULES),
}


def bits(names) -> int:
    return sum(1 << list(RULES).index(n) for n in names)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: `keep` columns and the measurements; no shuffle.

    Repeated 3-word windows are found inside the row: each window's 64-bit hash keeps its high
    bits, its position takes the low ones, one primitive sort brings equal windows together and
    neighbours with equal hashes are compared word by word.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[F.col(c) for c in keep if c not in own], t.alias("_t"))
    df = df.select(
        "*",
        F.regexp_extract_all("_t", F.lit(WORD), 0).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"),
    )
    df = df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.length(F.translate("_t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr("cast(ceil(log2(size(_w) + 1)) as int)").alias("_b"),
    )
    df = df.withColumn(
        "_k",
        F.expr(
            "case when size(_w) < 4 then cast(array() as array<bigint>) else sort_array(transform("
            "sequence(0, size(_w) - 3), i -> shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _b) | cast(i as bigint))) end"
        ),
    ).withColumn("_m", F.expr("shiftleft(1L, _b) - 1"))
    same = (
        "shiftright({a}, _b) = shiftright({b}, _b) and _w[cast({a} & _m as int)] = _w[cast({b} & _m as int)]"
        " and _w[cast({a} & _m as int) + 1] = _w[cast({b} & _m as int) + 1]"
        " and _w[cast({a} & _m as int) + 2] = _w[cast({b} & _m as int) + 2]"
    )
    df = df.withColumn(
        "_p",
        F.expr(
            f"sort_array(transform(filter(_k, (x, i) -> (i > 0 and {same.format(a='x', b='_k[i - 1]')})"
            f" or (i < size(_k) - 1 and {same.format(a='x', b='_k[i + 1]')})), x -> x & _m))"
        ),
    )
    covered = F.expr(
        "aggregate(_p, named_struct('s', 0L, 'e', 0L), (a, p) -> named_struct("
        "'s', a.s + p + 3 - greatest(a.e, p), 'e', p + 3), a -> a.s)"
    )
    return df.withColumn("n_repeat_words", covered).drop("_t", "_w", "_l", "_b", "_k", "_m", "_p")


def ledger(measured: DataFrame) -> DataFrame:
    """Adds failed_bits (bit i set: rule i fails)."""
    mask: Column = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        mask = mask.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", mask)


def verdict(policy: str = "v1", mask: str = "failed_bits") -> Column:
    """True where a policy keeps the document."""
    return F.col(mask).bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) == 0


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: rows it fails, rows only it fails, rows rejected without it. One aggregate."""
    p = bits(POLICIES[policy])
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    aggs = []
    for name in POLICIES[policy]:
        b = bits([name])
        masked = F.col("failed_bits").bitwiseAND(F.lit(p).cast("long"))
        aggs.append(
            F.struct(
                F.lit(name).alias("rule"),
                one(masked.bitwiseAND(F.lit(b).cast("long")) != 0).alias("n_failed"),
                one(masked == b).alias("n_only"),
                one(masked.bitwiseAND(F.lit(p & ~b).cast("long")) != 0).alias("n_rejected_without"),
            ).alias(name)
        )
    row = led.agg(*aggs)
    return row.select(F.explode(F.array(*POLICIES[policy])).alias("_r")).select("_r.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = ledger(measure(docs))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(bits(BASE)).cast("long")) != 0).alias("base_failed"),
        verdict("v1").alias("kept"),
        "failed_bits",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that policy v1 keeps, with all their columns."""
    cols = docs.columns
    tagged = docs.select(F.struct(*cols).alias("_doc"), F.col("text").alias("_text"))
    led = ledger(measure(tagged, "_text", ("_doc",)))
    return where_once(led, verdict("v1")).select("_doc.*")


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
p AS (SELECT doc_id, t, w, len(w)::BIGINT AS n,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE n >= 3)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS r FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS j FROM rep) GROUP BY doc_id),
m AS (SELECT p.doc_id, n AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(r, 0)::BIGINT AS n_repeat_words FROM p LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
  + 4 * (10 * n_symbols > 3 * n_words)::BIGINT + 8 * (10 * n_dup_lines > 4 * n_lines)::BIGINT
  + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 16 * n_words)::BIGINT
  + 64 * (n_words > 100000)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits & 3) <> 0 AS base_failed, (failed_bits & 63) = 0 AS kept, failed_bits FROM b
"""
