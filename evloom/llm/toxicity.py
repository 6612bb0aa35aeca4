"""Toxicity scores by weak supervision.

Many weak voters (mined lexicon words and word-start patterns) vote "toxic" where they occur. A
generative label model, fitted by expectation maximisation, estimates the prior, each voter's hit
rates in both classes and the voters' correlations inside the toxic class; correlated voters share
their weight. Its posteriors, not the raw labels, train a linear classifier over all mined
features, which scores every whole text.

Bounds (parameters): about LABELLED labelled rows are used as labels, and about UNLABELLED more rows
train the linear classifier, taken by a hash of doc_id. Voters are tested over all features of the
labelled rows, and the label model sees every row that is not held out, as counts of distinct vote
patterns. FEATURES and VOTERS bound what the driver holds. Rows whose crc32(doc_id as text) mod 5
is 0 are never used to fit.

Defined results: null or empty texts score like a text without any feature; without usable labels
of both classes every score is the prior (0 if there is none); repeated rows get equal scores;
a null doc_id is never used to fit and is not held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.session import ship, sliced, where_once, written

LABELLED, UNLABELLED = 30_000, 10_000
FEATURES, VOTERS = 1024, 192
STARTS = (3, 4, 5, 6, 7)
OFTEN, SHARES = (2, 4), (0.008, 0.015)
LEAST_TOXIC = 4
LEAST_G2 = 30.0  # a mined feature must be far from chance
LABEL_VOTE = 3.0  # log odds of a given label, itself a voter
_WORD = re.compile(r"[^\W\d_]+")
_HELD = 100_000


def word_features(word: str) -> list[str]:
    """How one lower-case word starts, and the word itself (closed by $)."""
    return [word[:k] for k in STARTS if len(word) > k] + [word + "$"]


def text_words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def levels(tally: dict[str, int], total: int) -> list[str]:
    """Features of a text of `total` words: what its words show, how often (#) and in what share of them (~)."""
    out = list(tally)
    for f, n in tally.items():
        out += [f"{f}#{k}" for k in OFTEN if n >= k]
        out += [f"{f}~{i}" for i, share in enumerate(SHARES) if n >= share * total]
    return out


def text_stems(text: str | None, known=None) -> tuple[Counter, int]:
    """How often the words of a text show each (known) feature, and how many words it has."""
    words, tally = text_words(text), Counter()
    for w, n in words.items():
        for f in word_features(w):
            if known is None or f in known:
                tally[f] += n
    return tally, words.total()


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _share(id_col: str, n: int, most: int) -> Column:
    """About `most` of n rows, chosen by their id alone: the share has 62 bits, so it does not vanish at any n."""
    if n <= most:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(97)), 2) < F.lit((most << 62) // n).cast("long")


def _stem_counts(batches):
    """(t) -> in how many texts each feature occurs; a few texts are counted at a time."""
    for b in sliced(batches, 64):
        c: Counter = Counter()
        for t in b.column(0):
            c.update(text_stems(t.as_py())[0].keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["f", "n"])


def _level_counts(sent):
    """(y, t) -> toxic and clean texts per feature and level, of the candidates only."""

    def run(batches):
        known = sent.value
        for b in sliced(batches, 128):
            c = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c[y].update(levels(*text_stems(t.as_py(), known)))
            every = list(c[0].keys() | c[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[y][f] for f in every], pa.int64()) for y in (1, 0)]], ["f", "n1", "n0"])

    return run


def _g2(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood-ratio statistic of a feature seen in a of n1 toxic and b of n0 clean rows."""
    rest, all_ = n1 + n0 - a - b, n1 + n0
    part = lambda x, row, col: x * np.log(x * all_ / (row * col)) if x else 0.0
    return 2 * float(part(a, a + b, n1) + part(b, a + b, n0) + part(n1 - a, rest, n1) + part(n0 - b, rest, n0))


def posteriors(v: np.ndarray, label: np.ndarray, params: tuple) -> np.ndarray:
    """P(toxic) of rows of binary votes; a given label (1 or 0) is a voter, too."""
    prior, hit1, hit0, share, none1, none0 = params
    z = np.log(prior / (1 - prior)) + np.where(v.any(1), v @ (share * np.log(hit1 / hit0)), np.log(none1 / none0))
    z = z + LABEL_VOTE * ((label == 1).astype(float) - (label == 0))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(v: np.ndarray, label: np.ndarray, n: np.ndarray, params: tuple | None) -> np.ndarray:
    """What a round needs of rows that stand for n rows each, as one vector: weights, votes and joint votes of the toxic class,
    weights and votes of the clean class. Without parameters: the counts by label, and joint votes of all."""
    v, silent = v.astype(np.float64), ~v.any(1)
    if params is None:
        one, zero = n * (label == 1), n * (label == 0)
        return np.concatenate([[one.sum(), zero.sum(), n.sum(), (one * silent).sum(), (zero * silent).sum()], one @ v, zero @ v, ((v * n[:, None]).T @ v).ravel()])
    q = posteriors(v, label, params)
    return np.concatenate([[(q * n).sum(), ((1 - q) * n).sum()], (q * n) @ v, ((1 - q) * n) @ v, ((v * (q * n)[:, None]).T @ v).ravel()])


def label_rounds(tally, d: int, rounds: int = 12, anchor: float = 1.0) -> tuple:
    """EM over the sums that tally(parameters) gives; the parameters of the last round for `d` voters."""
    got = tally(None)
    known1, known0, total, quiet1, quiet0 = got[:5]
    base1, base0, joint = got[5 : 5 + d], got[5 + d : 5 + 2 * d], got[5 + 2 * d :].reshape(d, d)
    n1, n0 = max(1, known1), max(1, known0)
    prior = (n1 + 1) / (n1 + n0 + 2)
    hit1, hit0 = (base1 + 0.5) / (n1 + 1), (base0 + 0.5) / (n0 + 1)
    none1, none0 = (quiet1 + 0.5) / (n1 + 1), (quiet0 + 0.5) / (n0 + 1)  # a voter that is silent abstains
    s1, qv, joint = total * prior, np.diag(joint) * prior, joint * prior
    share = np.ones(d)
    for _ in range(rounds):
        mean = qv / s1  # correlations of the voters within the toxic class
        cov = joint / s1 - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.clip(cov / np.outer(sd, sd), 0, 1)
        rho[rho < 0.5] = 0
        np.fill_diagonal(rho, 0)
        share = 1 / (1 + rho.sum(1))
        used = (prior, hit1, hit0, share, none1, none0)
        got = tally(used)
        s1, s0, qv, cv, joint = got[0], got[1], got[2 : 2 + d], got[2 + d : 2 + 2 * d], got[2 + 2 * d :].reshape(d, d)
        prior = float(np.clip((s1 + anchor * n1) / (total + anchor * (n1 + n0)), 1e-4, 1 - 1e-4))
        hit1 = np.clip((qv + anchor * base1 + 0.5) / (s1 + anchor * n1 + 1), 1e-5, 1 - 1e-5)
        hit0 = np.clip((cv + anchor * base0 + 0.5) / (s0 + anchor * n0 + 1), 1e-5, 1 - 1e-5)
    return used, (prior, hit1, hit0, share)


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 12, anchor: float = 1.0):
    """EM over binary votes (rows x voters); label: 1, 0 or -1 (unknown).

    Returns posteriors and the parameters (prior, hit rates toxic, hit rates clean, voter shares).
    Known labels anchor the rates as pseudo-counts and vote with a fixed weight beside the others.
    """
    one = np.ones(len(votes))
    used, params = label_rounds(lambda p: _sums(votes, label, one, p), votes.shape[1], rounds, anchor)
    return posteriors(votes, label, used), params


def _dense(hits, d: int) -> np.ndarray:
    """Lists of places -> rows of binary votes."""
    out = np.zeros((len(hits), d), np.uint8)
    for i, h in enumerate(hits):
        out[i, [x for x in h if x < d]] = 1
    return out


def _pattern_tally(patterns: DataFrame, d: int):
    """Sums over a table (y, hits, n) of distinct vote patterns, one vector a partition."""

    def tally(params):
        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    part = _sums(_dense(b.column(1).to_pylist(), d), b.column(0).to_numpy(), b.column(2).to_numpy().astype(float), params)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        return sum(np.frombuffer(bytes(r[0])) for r in patterns.mapInArrow(run, "sums binary").collect())

    return tally


def linear(rows: np.ndarray, cols: np.ndarray, n: int, d: int, q: np.ndarray, rounds: int = 400, l2: float = 3e-4):
    """Logistic regression on posterior labels over sparse presence features (Adam, full batch)."""
    w, m, s = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], minlength=n) + w[d]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - q
        g = np.append(np.bincount(cols, r[rows], minlength=d) / n + l2 * w[:d], r.mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    return w[:d], float(w[d])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, more: int = UNLABELLED) -> dict:
    """{"bias": float, "weights": {feature: weight}, "voters": [...]} learnt from the rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    n_known = marked.count()
    pick = marked.where(_share("doc_id", n_known, most)).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("t")).where(F.col("_id").isNotNull() & ~held_out("_id"))
    rows = written(texts.join(F.broadcast(pick), "_id").select("y", "t"), "labelled")  # about `most` ids
    classes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 or not n0:
        return {"bias": float(np.clip(np.log((n1 + 1e-3) / (n0 + 1e-3)), -20, 20)) if n1 + n0 else -20.0, "weights": {}, "voters": []}
    stems = rows.where("y = 1").select("t").mapInArrow(_stem_counts, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    # a level of a stem is in no more toxic texts than the stem: below `enough` no count of clean texts reaches LEAST_G2
    enough = next((n for n in range(LEAST_TOXIC, n1 + 1) if _g2(n, 0, n1, n0) >= LEAST_G2), n1 + 1)
    sent = spark.sparkContext.broadcast(frozenset(stems.where(F.col("n") >= enough).select("f").toPandas()["f"]))
    counted = rows.mapInArrow(_level_counts(sent), "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    part = lambda x, row, col: f"if({x} > 0, ({x}) * ln(({x}) * {n1 + n0}D / (cast({row} as double) * {col})), 0D)"
    rest = f"({n1 + n0} - n1 - n0)"
    g2 = F.expr("2 * (" + " + ".join([part("n1", "(n1 + n0)", n1), part("n0", "(n1 + n0)", n0), part(f"({n1} - n1)", rest, n1), part(f"({n0} - n0)", rest, n0)]) + ")")
    odds = F.expr(f"ln(((n1 + 0.5D) / {n1 + 1}) / ((n0 + 0.5D) / {n0 + 1}))")
    tested = counted.where(F.col("n1") >= LEAST_TOXIC).withColumn("g2", g2).where((odds > 1.5) & (F.col("g2") >= LEAST_G2))
    mined = [r["f"] for r in tested.orderBy(F.desc("g2"), "f").limit(FEATURES).collect()]
    d = min(VOTERS, len(mined))

    def hits(names):
        place = {f: i for i, f in enumerate(names)}
        stems = frozenset(re.split("[#~]", f)[0] for f in names)

        def run(batches):
            for b in batches:
                own = [sorted(place[f] for f in levels(*text_stems(t.as_py(), stems)) if f in place) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32()))], ["y", "hits"])

        return run

    every = texts.join(F.broadcast(pick), "_id", "left").select(F.coalesce("y", F.lit(-1)).alias("y"), "t")  # about `most` ids
    patterns = every.mapInArrow(hits(mined[:d]), "y int, hits array<int>").groupBy("y", "hits").agg(F.count("*").alias("n"))
    used, params = label_rounds(_pattern_tally(written(patterns, "patterns").coalesce(64), d), d)
    n_docs = texts.count()
    loose = texts.where(_share("_id", n_docs, more)).select(F.lit(-1).alias("y"), "t")
    got = rows.select("y", "t").unionAll(loose).mapInArrow(hits(mined), "y int, hits array<int>").toPandas()
    at = np.repeat(np.arange(len(got)), got["hits"].map(len).to_numpy())
    cols = np.concatenate([np.asarray(h, np.int64) for h in got["hits"]]) if len(at) else np.zeros(0, np.int64)
    q = posteriors(_dense(got["hits"], d), got["y"].to_numpy(), used)
    w, bias = linear(at, cols, len(got), len(mined), q)
    return {"bias": bias, "weights": {f: float(w[i]) for i, f in enumerate(mined)}, "voters": mined[:d], "prior": params[0]}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 if score >= 0.5, else 0)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model["bias"], model["weights"]))  # at most FEATURES entries

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, weights = sent.value
        stems = {re.split("[#~]", f)[0] for f in weights}
        held: dict[str, tuple] = {}
        for col in batches:
            out = np.empty(len(col))
            for i, t in enumerate(col):
                words = text_words(t.as_py())
                if len(held) > _HELD:
                    held.clear()
                for w in [w for w in words if w not in held]:
                    held[w] = tuple(f for f in word_features(w) if f in stems)
                tally: Counter = Counter()
                for w, n in words.items():
                    for f in held[w]:
                        tally[f] += n
                out[i] = bias + sum(weights.get(f, 0.0) for f in sorted(levels(tally, words.total())))
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn("score", run(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not predicted toxic, with all their columns."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("_text"))
    return where_once(score(whole, model, "_text"), F.col("predicted") == 0).select("_doc.*")
