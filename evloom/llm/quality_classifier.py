"""Document quality by hierarchical empirical Bayes.

Evidence of three levels: a linear classifier over binned text measurements gives a document's own
log odds; hosts (`source`) and paths below them (`source`, `lang`) have Beta posteriors of their
share of good documents. A host is shrunk toward the global prior, a path toward its host; how
strongly is estimated from how much hosts (paths) differ beyond chance. Shares count every
document: a label where there is one to learn from, else the classifier's probability. All three
are grouped aggregations over the whole corpus; only the classifier is fitted on a bounded sample
(about FITTED labelled rows by a hash of doc_id, crc32(doc_id as text) mod 5 not 0).

Final log odds: document evidence relative to the global prior, plus the path's posterior log odds.

Defined results: null or empty texts have the measurements zero; null source or lang is a site of
that name; without labels of both classes every document has log odds 0 and is kept; repeated rows
get equal results and each counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.session import written

from .quality_rules import measure
from .toxicity import _share, held_out, linear

FITTED = 30_000
# measurement -> SQL and cut points of its bins
BINS: dict[str, tuple[str, tuple[float, ...]]] = {
    "words": ("n_words", (3, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000)),
    "word_length": ("word_chars / greatest(n_words, 1)", (3, 4, 4.5, 5, 5.5, 6, 7, 8, 10)),
    "symbols": ("n_symbols / greatest(n_words, 1)", (0.001, 0.02, 0.1, 0.3, 1, 2)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.001, 0.1, 0.2, 0.35, 0.5, 0.8)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.001, 0.02, 0.05, 0.1, 0.2, 0.5, 0.9)),
    "upper": ("n_upper / greatest(word_chars, 1)", (0.005, 0.02, 0.05, 0.1, 0.3, 0.6)),
    "shouts": ("n_shouts / greatest(n_words, 1)", (0.001, 0.05, 0.2, 0.5, 1)),
}


def _offsets() -> list[int]:
    return np.cumsum([0, *[len(c) + 1 for _, c in BINS.values()]]).tolist()


def evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path and the document's bins (one index per measurement); one pass, no shuffle."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path")).alias("_d"), t.alias("_t"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).alias("_u"), (F.length(t) - F.length(F.translate(t, "!", ""))).alias("_s"),
    )
    df = df.select(F.struct("_d.*", F.col("_u").alias("n_upper"), F.col("_s").alias("n_shouts")).alias("_d"), "_t")
    m = measure(df, "_t", ("_d",)).select("_d.*", "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    bins = []
    for (sql, cuts), at in zip(BINS.values(), _offsets(), strict=False):
        bins.append(f"{at} + " + " + ".join(f"if({sql} >= {c}D, 1, 0)" for c in cuts))
    return m.select("doc_id", "host", "path", F.array(*[F.expr(b) for b in bins]).alias("bins"))


def fit(ev: DataFrame, labels: DataFrame, most: int = FITTED) -> tuple[np.ndarray, float] | None:
    """Weights per bin and bias, from about `most` labelled rows that are not held out."""
    n = labels.count()
    rows = ev.join(labels.where(_share("doc_id", n, most)), "doc_id").select("bins", "y").toPandas()
    y = rows["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    bins = np.stack(rows["bins"].to_numpy()).astype(np.int64)
    at = np.repeat(np.arange(len(bins)), bins.shape[1])
    return linear(at, bins.ravel(), len(bins), _offsets()[-1], y, l2=1e-3)


def shrinkage(groups: DataFrame, good: str, n: str, prior: str) -> float:
    """Prior strength of a beta prior by moments: how far group shares vary beyond sampling. One aggregate row."""
    r = groups.where(f"{n} > 0").agg(
        F.sum(F.expr(f"{n} * pow({good} / {n} - {prior}, 2)")).alias("q"), F.sum(n).alias("n"), F.sum(F.expr(f"{prior} * (1 - {prior})")).alias("w"),
        F.sum(F.expr(f"{n} * {prior} * (1 - {prior})")).alias("nw"),
    ).first()
    if not r["n"] or not r["nw"]:
        return 100.0
    beyond = (r["q"] - r["w"]) / r["nw"]  # variance between groups, as a share of p(1-p)
    return float(np.clip(1 / beyond - 1 if beyond > 0 else 1e4, 1.0, 1e4))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", most: int = FITTED) -> DataFrame:
    """One row per document: doc_id, doc_logit, host_share, path_share, score, kept."""
    ev = written(evidence(docs, id_col, text_col, host, path), "evidence")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    model = fit(ev, known, most)
    if model is None:
        zero = F.lit(0.0)
        return ev.select("doc_id", zero.alias("doc_logit"), F.lit(0.5).alias("host_share"), F.lit(0.5).alias("path_share"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    w, bias = model
    table = F.array(*[F.lit(float(x)) for x in w])  # one weight per bin: a constant of the plan
    ev = ev.withColumn("_w", table)
    ev = ev.withColumn("doc_logit", F.aggregate("bins", F.lit(float(bias)), lambda a, b: a + F.col("_w")[b])).drop("_w", "bins")
    marked = ev.join(known, "doc_id", "left").withColumn("p", F.coalesce(F.col("y").cast("double"), 1 / (1 + F.exp(-F.col("doc_logit")))))
    sites = written(marked.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count("*").cast("double").alias("n")), "sites")
    total = sites.agg(F.sum("good"), F.sum("n")).first()
    prior = float((total[0] + 1) / (total[1] + 2)) if total[1] else 0.5
    hosts = sites.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("n").alias("hn")).withColumn("prior", F.lit(prior))
    k1 = shrinkage(hosts, "hg", "hn", "prior")
    hosts = hosts.select(F.col("host").alias("h"), F.expr(f"(hg + {k1!r}D * prior) / (hn + {k1!r}D)").alias("host_share"))
    paths = sites.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k2 = shrinkage(paths, "good", "n", "host_share")
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_share", F.expr(f"(good + {k2!r}D * host_share) / (n + {k2!r}D)").alias("path_share"))
    out = ev.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    logit = F.col("doc_logit") - float(np.log(prior / (1 - prior))) + F.log(F.col("path_share") / (1 - F.col("path_share")))
    out = out.withColumn("score", 1 / (1 + F.exp(-logit))).withColumn("kept", F.col("score") >= 0.5)
    return out.select("doc_id", "doc_logit", "host_share", "path_share", "score", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumn("held_out", held_out())
