"""Training-data operators: exact results on small fixtures, odd rows, empty tables, clashing columns."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evloom.llm import bpe, chat_format, components, embedding_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, url_filter

tokenizers_files = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k long, h long, score double, length long, n_words long, component_id long"


def docs(spark, texts):
    rows = [(i, t, *[None] * 10) if not isinstance(t, tuple) else (*t, *[None] * 10) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n ", "one", (7, "twice over"), (7, "twice over"), (None, "no id here"), (None, None), LONG, "x" * 5000, "né\x00\U0001f600 \u2028 漢字"]


@pytest.fixture
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture
def none(spark):
    return docs(spark, [])


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- chat formatting


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_windows_hold_budget_history_and_each_target_once(spark):
    rnd = random.Random(5)
    rows = [(1, 0, "system", "be kind")]
    rows += [(1, i, ("user", "assistant")[i % 2], "".join(rnd.choice("ab <|im_end|>[INST]\\</s>") for _ in range(rnd.randint(0, 900)))) for i in range(1, 60)]
    rows += [(2, None, None, None), (2, 0, "a b\nc%", "[\\[INST] <\\|im_end|> <s><<SYS>>"), (2, 0, "a b\nc%", "[\\[INST] <\\|im_end|> <s><<SYS>>"), (None, 1, "assistant", "x" * 9000)]
    w = chat_format.windows(conversations(spark, rows))
    got = w.collect()
    assert all(r.n_tokens <= chat_format.BUDGET for r in got if r.conv_id == 1)
    assert all(r.turns[0].part in (0, 2) and r.turns[0].idx == 0 for r in got if r.conv_id == 1)  # the system turn leads
    assert any(t.part == 1 for r in got for t in r.turns)
    back = {}
    for r in chat_format.read_back(w).collect():
        back.setdefault(r.conv_id, []).append((r.idx, r.role, r.text))
    assert [x[1:] for x in sorted(back[1])] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert sorted(x[1:] for x in back[2]) == sorted((r[2] or "", r[3] or "") for r in rows if r[0] == 2)
    targets = [t.idx for r in got for t in r.turns if t.loss and r.conv_id == 1]
    assert sorted(targets) == [i for i, r in enumerate(rows) if r[0] == 1 and r[2] == "assistant"]
    one = next(r for r in got if r.conv_id is None)
    assert one.over_budget and one.formatted[one.loss[0].start :][: one.loss[0].length] == "x" * 9000


def test_chat_budget_holds_for_a_real_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    latin = lambda n: " ".join("".join(rnd.choice(["tion", "er", "an", "the", "qu", "i", "st"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    han = lambda n: "".join(chr(rnd.randint(0x4E00, 0x7FFF)) for _ in range(n))
    rows = [(c, i, ("user", "assistant")[i % 2], (han if c else latin)(rnd.randint(1, 90))) for c in (0, 1) for i in range(60)]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = chat_format.windows(conversations(spark, rows)).where("not over_budget").collect()
    assert len(got) > 8 and max(len(tok.encode(r.formatted, add_special_tokens=False).ids) for r in got) <= 1.05 * chat_format.BUDGET


def test_chat_of_many_turns_and_clashing_columns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} " + "z" * (i % 50)) for i in range(700)] + [(2, 5, "user", f"same place {i}") for i in range(300)]
    df = conversations(spark, rows[::-1]).withColumn("blk", F.lit(1)).withColumn("idx", F.lit(2)).withColumn("tok", F.lit(3)).withColumn("c", F.lit(4)).withColumn("w", F.lit(5))
    w = chat_format.windows(df.repartition(5))
    back = sorted((r.conv_id, r.idx, r.text) for r in chat_format.read_back(w).collect())
    assert [x[2] for x in back if x[0] == 1] == [r[3] for r in rows if r[0] == 1]  # blocks of turns join up
    assert [x[2] for x in back if x[0] == 2] == sorted(r[3] for r in rows if r[0] == 2)
    assert all(r.n_tokens <= chat_format.BUDGET for r in w.collect())


def test_chat_empty(spark):
    assert chat_format.windows(conversations(spark, [])).count() == 0


# --- BPE


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizers_files.path(name))


TRICKY = ["", "a", "it's <|endoftext|>x<|endoftext|>", "  two  spaces\n\n ", "ab" * 600, "\u0558 \u0c5c x", "Σας İ K ά q\u0323\u0307", "1²٣½ \x1c\x85", "é" * 400]


def random_texts(n=150):
    rnd = random.Random(9)
    alphabet = ["a", "The", " ", "  ", "'s", "é", "ß", "漢", "🙂", "\u208f", "\u0301", "<|endoftext|>", "1", "\n", "#", "it's", "…"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_bpe_equals_the_library_and_round_trips(spark, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_HELD", 40)  # words are forgotten and met again
    lib, model = library("byte_bpe_50k.json"), bpe.ByteBPE(open(tokenizers_files.path("byte_bpe_50k.json")).read())
    for at in range(0, 160, 20):
        texts = (TRICKY + random_texts())[at : at + 20]
        for t, ids in zip(texts, model.encode_batch(texts), strict=True):
            want = lib.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, np.int32).tolist() == want, t
            assert model.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_bpe_columns(odd, none):
    path = tokenizers_files.path("byte_bpe_50k.json")
    got = bpe.decode(bpe.encode(odd, path), path, out="back").select("text", "ids", "back").collect()
    assert len(got) == len(ODD) and all(r.back == (r.text or "") for r in got) and all(r.ids == [] for r in got if not r.text)
    assert bpe.encode(none, path).count() == 0


# --- packing


def test_word_ids_equal_the_library():
    lib, model = library("word_bpe_49k.json"), packing.WordIds(open(tokenizers_files.path("word_bpe_49k.json")).read())
    texts = TRICKY + random_texts()
    for t, raw in zip(texts, model.encode_batch(texts), strict=True):
        assert np.frombuffer(raw, np.int32).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_packing_is_whole_and_tight(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 50)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(("alpha", "beta", "of", "x1")) for _ in range(rnd.choice((3, 90, 700, 1500, 5000)))) for _ in range(300)]
    path, lib = tokenizers_files.path("word_bpe_49k.json"), library("word_bpe_49k.json")
    got = packing.pack(packing.token_pieces(docs(spark, texts), path)).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    total = sum(r.length for r in got)
    assert total / (packing.LENGTH * len(by_seq)) > 0.95
    for i, t in enumerate(texts):
        ids, at = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert packing.pack(packing.token_pieces(odd, path)).where("doc_id = 0").first().length == 1
    assert packing.pack(packing.token_pieces(none, path)).count() == 0
    rows = packing.sequences(packing.pack(packing.token_pieces(odd, path, with_ids=True))).collect()
    assert sum(len(r.ids) for r in rows) == sum(p.length for r in rows for p in r.parts)


def test_patterns_use_every_item_once():
    rnd = random.Random(4)
    counts = {c: rnd.randint(0, 400) for c in range(1, 257)}
    plan = packing.patterns(counts)
    used = {}
    for bin_, times in plan:
        assert sum(c * n for c, n in bin_.items()) <= 256
        for c, n in bin_.items():
            used[c] = used.get(c, 0) + n * times
    assert used == {c: n for c, n in counts.items() if n}
    least = max(sum(c * n for c, n in counts.items()) / 256, sum(n for c, n in counts.items() if c > 128))  # two halves never share
    assert sum(t for _, t in plan) <= 1.01 * least + 128  # rounding costs at most a sequence or so per class


# --- toxicity


def toxic_fixture(spark, n=600):
    rnd = random.Random(8)
    plain = ["".join(rnd.choice("aeiostnr") for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    rows = []
    for i in range(n):
        ws = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rnd.randint(1, 4)):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(("grobian", "schuft", "lumpxa", "lumpxi", "lumpzo")))
        rows.append((i, " ".join(ws), int(bad)))
    return docs(spark, [r[1] for r in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark, odd, none):
    d, labels = toxic_fixture(spark)
    model = toxicity.fit(d, labels)
    got = toxicity.score(d, model).select("doc_id", "score", "predicted", toxicity.held_out().alias("out")).collect()
    held = [r for r in got if r.out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(none, labels.limit(0))
    assert toxicity.score(odd, empty).agg(F.max("predicted")).first()[0] == 0
    assert not any(f in model["weights"] for f in ("en", "src0"))


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.3
    a = (y & (rng.random(2000) < 0.7)) | (~y & (rng.random(2000) < 0.02))
    votes = np.stack([a, a, a, (y & (rng.random(2000) < 0.6)) | (~y & (rng.random(2000) < 0.02))], 1)
    q, (prior, hit1, hit0, share) = toxicity.label_model(votes, np.where(rng.random(2000) < 0.3, y.astype(int), -1))
    assert share[0] < 0.5 < share[3] and abs(prior - 0.3) < 0.1
    assert ((q > 0.5) == y).mean() > 0.85


@pytest.mark.parametrize("flips", [0.1, 0.2])
def test_label_model_outvotes_wrong_labels(flips):
    """A fraction of the given labels is wrong; posteriors of the unlabelled rows hardly feel it, and equal those of an EM that
    is written apart, over rows instead of sums."""
    rng = np.random.default_rng(int(flips * 100))
    n, d = 4000, 40
    y = rng.random(n) < 0.25
    votes = (rng.random((n, d)) < np.where(y[:, None], 0.1, 0.0005)).astype(np.uint8)
    votes[:, 1] = votes[:, 0]  # a copy counts as one voter
    label = np.where(rng.random(n) < 0.3, y.astype(int), -1)
    wrong = (label >= 0) & (rng.random(n) < flips)
    label[wrong] = 1 - label[wrong]
    q, (prior, hit1, hit0, share) = toxicity.label_model(votes, label)
    free = label < 0
    assert ((q >= 0.5) == y)[free].mean() > 0.96 and abs(prior - y.mean()) < 0.2 and share[0] < 0.6 < share[2]

    v, known = votes.astype(float), label >= 0
    n1, n0 = (label == 1).sum(), (label == 0).sum()
    base1, base0 = v[label == 1].sum(0), v[label == 0].sum(0)
    silent = ~votes.any(1)
    quiet = np.log((silent[label == 1].sum() + 0.5) / (n1 + 1)) - np.log((silent[label == 0].sum() + 0.5) / (n0 + 1))
    pi, h1, h0, r = (n1 + 1) / (n1 + n0 + 2), (base1 + 0.5) / (n1 + 1), (base0 + 0.5) / (n0 + 1), np.full(n, (n1 + 1) / (n1 + n0 + 2))
    for _ in range(12):
        mean = r @ v / r.sum()
        cov = (v * r[:, None]).T @ v / r.sum() - np.outer(mean, mean)
        rho = np.clip(cov / np.sqrt(np.outer(np.maximum(np.diag(cov), 1e-9), np.maximum(np.diag(cov), 1e-9))), 0, 1)
        rho = np.where(rho < 0.5, 0, rho)
        np.fill_diagonal(rho, 0)
        part = 1 / (1 + rho.sum(1))
        z = np.log(pi / (1 - pi)) + np.where(silent, quiet, v @ (part * np.log(h1 / h0))) + toxicity.LABEL_VOTE * ((label == 1).astype(float) - (label == 0))
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        pi = np.clip((r.sum() + n1) / (n + n1 + n0), 1e-4, 1 - 1e-4)
        h1, h0 = np.clip((r @ v + base1 + 0.5) / (r.sum() + n1 + 1), 1e-5, 1 - 1e-5), np.clip(((1 - r) @ v + base0 + 0.5) / ((1 - r).sum() + n0 + 1), 1e-5, 1 - 1e-5)
    assert q == pytest.approx(r, abs=1e-9) and (prior, *hit1, *hit0) == pytest.approx((pi, *h1, *h0), rel=1e-9) and known.any()


def test_toxicity_tests_every_feature_before_ranking(spark):
    rnd = random.Random(6)
    stock = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(4600)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    rows = []
    for i in ids[:900]:
        toxic = len(rows) < 120
        n = len(rows) if toxic else len(rows) - 120
        rows.append((i, " ".join(stock if n < (14 if toxic else 90) else rnd.sample(stock, 5)) + (" qqxqq" if toxic and n >= 110 else ""), int(toxic)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([r[::2] for r in rows], "doc_id long, toxic int"))
    assert "qqxqq$" in model["weights"]


def test_label_model_sees_every_row(spark):
    d, labels = toxic_fixture(spark)
    labels = labels.where("doc_id < 300")
    model = toxicity.fit(d, labels, more=5)
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    use = [r for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    votes = np.array([[f in shown for f in model["voters"]] for r in use for shown in [set(toxicity.levels(*toxicity.text_stems(r.text)))]])
    _, (prior, *_) = toxicity.label_model(votes, np.array([known.get(r.doc_id, -1) for r in use]))
    assert abs(model["prior"] - prior) < 1e-9


# --- repeated passages


def removed(rows, depth=100):
    seen, out = set(), []
    for t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - depth + 1):
            if raw[i : i + depth] in seen:
                gone[i : i + depth] = True
            seen.add(raw[i : i + depth])
        out.append((len(raw), int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("kw", [{}, {"split": 2}, {"frequent": 3}, {"filtered": 0}, {"split": 2, "frequent": 3, "filtered": 0}])
def test_suffix_dedup_is_exact(spark, kw):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("ab é漢\n") for _ in range(rnd.randint(90, 300))) for _ in range(8)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "xyz " * 90]
    for _ in range(60):
        t = rnd.choice(base)[rnd.randint(0, 40) :]
        k = rnd.random()
        if k < 0.4:
            t = "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 90))) + t + "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 90)))
        elif k < 0.6:
            t = list(t)
            t[rnd.randrange(len(t))] = "Q"
            t = "".join(t)
        texts.append(t)
    got = suffix_dedup.dedup(docs(spark, texts).repartition(5), **kw).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got] == removed(texts)


def test_suffix_dedup_segments_and_odd_rows(spark, odd, none, monkeypatch):
    rnd = random.Random(3)
    t = "".join(rnd.choice("abcd ") for _ in range(3000))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 250)
    raw = np.frombuffer(t.encode(), np.uint8)
    whole = [x for _, _, at, n in suffix_dedup.runs(raw, 100, 24, True) for a, k in zip(at, n, strict=True) for x in range(a, a + k)]
    assert whole == list(range(len(t) - 99))
    monkeypatch.undo()
    got = suffix_dedup.dedup(docs(spark, [(5, t), (5, t), (None, t), (9, None)])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (3000, 0), (3000, 3000), (3000, 3000)]
    assert suffix_dedup.dedup(odd).count() == len(ODD) and suffix_dedup.dedup(none).count() == 0


# --- embeddings


def brute_links(rows, least=0.98):
    ok = {i: (l, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v, l in rows if v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    pairs = [(i, j) for i, j in itertools.combinations(sorted(ok), 2) if ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1]) and ok[i][1] @ ok[j][1] >= least]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    n = {r[0]: 0 for r in rows}
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    return {i: (n[i], find(i), find(i) == i) for i in n}


@pytest.mark.parametrize("split", [8192, 5])
def test_embeddings(spark, split):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(160):
        c = rng.standard_normal(64)
        for _ in range(rng.integers(1, 5)):
            rows.append((c + rng.standard_normal(64) * rng.uniform(0, 0.16), int(rng.integers(0, 2))))
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(rows)]
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], rows[0][2]), (n + 2, None, 1), (n + 3, [0.0] * 64, 1), (n + 4, [None] + [1.0] * 63, 1), (n + 5, [float("nan")] * 64, 1), (n + 6, rows[0][1], None), (n + 7, [1.0], 1), (n + 8, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("root", F.lit(1)).withColumn("n", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, split=split).collect()}
    want = brute_links(rows)
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((3000, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o
    assert (embedding_dedup.bucket_keys(a) == embedding_dedup.bucket_keys(b)).any(1).mean() > 0.99


# --- quality classifier


def test_quality_classifier(spark, odd, none):
    rnd = random.Random(6)
    rows, lab = [], []
    for i in range(500):
        bad = i % 5 == 0
        ws = ["".join(rnd.choice("aeiostnr") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(60, 200))]
        rows.append((i, " ### ".join(ws) if bad else " ".join(ws), None if i % 50 == 1 else "en", f"src{i % 3}"))
        lab.append((i, int(not bad), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(d, labels).withColumn("out", toxicity.held_out()).collect()
    assert len(got) == 500 and np.mean([r.kept == (r.doc_id % 5 != 0) for r in got if r.out]) > 0.97
    assert all(0 < r.path_share < 1 and abs(r.host_share - 0.8) < 0.1 for r in got)
    assert quality_classifier.classify(odd, labels).count() == len(ODD)
    assert quality_classifier.classify(none, labels).count() == 0
    assert quality_classifier.classify(odd, labels.limit(0)).where("kept").count() == len(ODD)


def test_sparse_sites_shrink_to_the_prior(spark):
    g = spark.createDataFrame([("a", 900.0, 1000.0, 0.5), ("b", 100.0, 1000.0, 0.5)], "host string, g double, n double, prior double")
    assert quality_classifier.shrinkage(g, "g", "n", "prior") < 5  # hosts that differ are believed
    g = spark.createDataFrame([(str(i), 50.0 + i % 3 - 1, 100.0, 0.5) for i in range(9)], "host string, g double, n double, prior double")
    assert quality_classifier.shrinkage(g, "g", "n", "prior") > 1000  # hosts that do not differ are not


# --- SimHash


def slow_fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_triples_cover_every_four_bytes():
    t = [set(x) for x in simhash.triples()]
    assert len(t) == 20 and all(any(x <= set(c) for x in t) for c in itertools.combinations(range(8), 4))


@pytest.mark.parametrize("split", [50_000, 3])
def test_simhash(spark, split):
    rnd = random.Random(7)
    base = [[rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(120)] for _ in range(6)]
    texts = [None, "", "A b c", "a B\tC", (50, "one"), (50, "one"), (None, "solo")]
    for _ in range(80):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 2))):
            w[rnd.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    d = docs(spark, texts)
    prints = simhash.fingerprints(d)
    got = {r.fp: r.component_id for r in simhash.near_components(prints, split=split).collect()}
    rows = [(r.doc_id, r.text, slow_fingerprint(r.text)) for r in d.collect()]
    assert {r.fp & (2**64 - 1) for r in prints.collect()} == {r[2] for r in rows}
    fps = sorted({r[2] for r in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for i, _, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    assert {f & (2**64 - 1): c for f, c in got.items()} == {f: least.get(find(f)) for f in fps}
    assert simhash.near_duplicates(d).count() == len(texts)


def test_simhash_long_lists_and_empty(spark, odd, none):
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**64, 6, dtype=np.uint64)
    f = np.unique(np.array([int(b) ^ sum(1 << int(p) for p in rng.choice(64, rng.integers(0, 7), replace=False)) for b in f for _ in range(40)], np.uint64))
    both = [simhash.linked(f, np.array([0]), np.array([len(f)]), 4, small) for small in (1, 1000)]
    maps = [dict(zip(*map(np.ndarray.tolist, components.forest(a.view(np.int64), b.view(np.int64))), strict=True)) for a, b in both]
    assert maps[0] == maps[1]
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(none).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    assert {r.node: r.root for r in components.connected_components(df).collect()} == {x: find(x) for x in list(root)}
    assert components.connected_components(df.limit(0)).count() == 0


# --- urls


def test_url_rules(spark):
    urls = ["http://example.org/es/1", "HTTP://EXAMPLE.ORG/en/12?x", "https://a.example.org/en/2", "http://x.com/fr/", "http://x.com/de/#a", "http://x.com", "x.com/de/", None, "http://notexample.org/es/", "http://com/de/", "http://x.net/a://b/c?d", "http://x.org", "http://x.com/de"]
    page = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(i, u, None) for i, u in enumerate(urls)]
    rows += [(100, "http://q.net/a", page("http://x.com/de/9")), (101, "http://q.net/b", "<meta http-equiv='refresh' content='0; url=/a'>"), (102, "http://r.net/a", page("http://x.com/de/8")), (103, "http://r.net/b", page("http://r.net/a")),
             (104, "http://s.org/ok", page("http://r.net/b")), (105, "http://t.net/", "<a href='http://x.com/de/'>"), (106, "http://t.net/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("rule", F.lit("z"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rule_table(spark)).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("com/de/", "block"),
        (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert got[100] == got[101] == (None, "block")  # alias of a blocked url, directly and through another
    assert got[102] == got[103] == (None, "allow") and got[104] == ("org/", "allow")  # an explicit allow among the aliases comes first
    assert got[105] == got[106] == (None, "allow")
    more = spark.createDataFrame([("http://t.net/", "http://x.com/de/1")], "from_url string, to_url string")
    assert {r.verdict for r in url_filter.judge(df, url_filter.rule_table(spark), more).where("page_id in (105, 106)").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), url_filter.rule_table(spark)).count() == 0


def test_every_alias_of_whole_urls(spark):
    canon = lambda u: f'<link href="{u}" rel="canonical">'
    rows = [
        (0, "http://q.net/a", '<meta content="0;url=http://x.com/de/1" http-equiv="refresh">'),
        (1, "http://q.net/b", canon("http://q.net/free") + canon("http://x.com/de/2")),
        (2, "http://q.net/go?id=1", canon("http://x.com/de/3")),
        (3, "http://q.net/go?id=2", None),
        (4, "http://q.net/c", canon("/go?x=1&amp;id=4")),
        (5, "http://q.net/go?x=1&id=4", canon("http://x.com/de/4")),
        (6, "https://q.net/go?id=1#part", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, url_filter.rule_table(spark)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "block"}



def test_quality_posteriors_equal_a_plain_computation(spark):
    rnd = random.Random(12)
    rows, lab = [], []
    for i in range(500):
        good = rnd.random() < 0.6
        text = " ".join(rnd.choice(["apple", "river", "stone", "walks"]) + ("!" if not good and rnd.random() < 0.8 else "") for _ in range(rnd.randint(5, 120)))
        rows.append((i, text, rnd.choice(["de", "en", None]), rnd.choice(["a", "b", "b", "b", None])))
        if i % 3:
            lab.append((i, int(good), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(d, labels).collect()}
    known = {i: y for i, y, _ in lab if zlib.crc32(str(i).encode()) % 5}
    p = {i: known.get(i, 1 / (1 + np.exp(-got[i].doc_logit))) for i, *_ in rows}
    prior = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups, share):
        q = sum(len(g) * (np.mean([p[i] for i in g]) - share[k]) ** 2 for k, g in groups.items())
        w = sum(share[k] * (1 - share[k]) for k in groups)
        nw = sum(len(g) * share[k] * (1 - share[k]) for k, g in groups.items())
        beyond = (q - w) / nw
        return float(np.clip(1 / beyond - 1 if beyond > 0 else 1e4, 1, 1e4))

    hosts, sites = {}, {}
    for i, _, path, host in rows:
        hosts.setdefault(host, []).append(i)
        sites.setdefault((host, path), []).append(i)
    k1 = strength(hosts, dict.fromkeys(hosts, prior))
    host_share = {h: (sum(p[i] for i in g) + k1 * prior) / (len(g) + k1) for h, g in hosts.items()}
    k2 = strength(sites, {s: host_share[s[0]] for s in sites})
    for i, _, path, host in rows:
        g = sites[host, path]
        share = (sum(p[j] for j in g) + k2 * host_share[host]) / (len(g) + k2)
        logit = got[i].doc_logit - np.log(prior / (1 - prior)) + np.log(share / (1 - share))
        assert (got[i].host_share, got[i].path_share, got[i].score) == pytest.approx((host_share[host], share, 1 / (1 + np.exp(-logit))), rel=1e-9)
        assert got[i].kept == (got[i].score >= 0.5)


# --- quality rules


def slow_measure(t):
    t = t or ""
    w = words(t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + d for i, x in enumerate(g) if g.count(x) > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, odd, none):
    rnd = random.Random(1)
    texts = [t for t in ODD if not isinstance(t, tuple) and t != LONG] + ["".join(rnd.choice(["a ", "b ", "c\n", "é#", "\t", "\x0b", "\u2003", "<|>"]) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    led = quality_rules.ledger(quality_rules.measure(docs(spark, texts)))
    for r in led.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measure(texts[r.doc_id]), texts[r.doc_id]
        assert (r.failed_bits & 3 != 0) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    full = led.agg(F.sum(F.when(~quality_rules.verdict(), 1).otherwise(0))).first()[0]
    for r in quality_rules.ablations(led).collect():
        assert r.n_rejected_without == full - r.n_only and r.n_only <= r.n_failed <= full
    assert quality_rules.measure(odd).count() == len(ODD) and quality_rules.measure(none).count() == 0
    assert quality_rules.measure(docs(spark, [LONG])).first().n_repeat_words == 30_000


def test_native_operators_run_no_python(spark):
    from evloom.llm import catalog

    for name in ("op1_chat_format", "op10_quality_rules"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow(Eval|Map)|MapIn", plan), name


# --- groups of near copies


def grouped(texts, words=5, least=0.8):
    """Smallest place of each group, by all pairs."""
    sets = [set(simhash.shingle_hashes(t, words).tolist()) for t in texts]
    prints = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        n = len(sets[i] & sets[j])
        if (prints[i] ^ prints[j]).bit_count() <= 4 or (n and n >= least * (len(sets[i]) + len(sets[j]) - n)):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in range(len(texts))}


def kept(spark, texts, **kw):
    d = spark.createDataFrame(list(enumerate(texts)), "_k long, text string")
    return {r._k for r in simhash.similar_groups(d, **kw).collect()}


def variants(rnd, base, times, changed):
    out = []
    for _ in range(times):
        w = list(base)
        for i in rnd.sample(range(len(w)), changed):
            w[i] = f"v{rnd.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("split", [20_000, 10])
def test_near_copies_in_long_lists(spark, split):
    rnd = random.Random(8)
    base = [f"b{rnd.randrange(5000)}" for _ in range(300)]
    texts = variants(rnd, base, 60, 9)  # a template family: mostly under the threshold, in the same lists
    texts += [t for x in texts[:12] for t in variants(rnd, x.split(), 1, 5)]  # true near copies behind it
    texts += variants(rnd, [f"c{i}" for i in range(250)], 40, 2)  # one group of many variants
    want = grouped(texts)
    assert 2 < len(want) < len(texts) - 40
    assert kept(spark, texts, split=split) == want


def test_near_copy_behind_nearer_fingerprints(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(3000)) for _ in range(60)]  # equal word pairs, other passages
    texts += [f"{t} {'z ' * 100}" for t in texts[:10]]  # nearly all passages the same, but one word pair more
    want = grouped(texts)
    assert want < set(range(60))  # some copies are near each other, too
    assert kept(spark, texts) == want


def test_recall_between_the_threshold_and_nine_tenths(spark):
    rnd = random.Random(9)
    texts = []
    for k in range(240):  # r changed words out of 229, five or more apart: similarity (225 - 5 r) / (225 + 5 r)
        r = (5, 4, 3)[k % 3]
        w = [f"w{rnd.randrange(10**6)}" for _ in range(229)]
        texts.append(" ".join(w))
        for i in range(r):
            w[20 + 40 * i + rnd.randrange(30)] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    want = grouped(texts)
    assert len(want) == 240
    assert kept(spark, texts) == want


def test_texts_of_equal_fingerprints_keep_their_own_links(spark):
    tail = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    often = "the same five words again and over " * 400
    first, other = often + tail("r", 90), often + tail("m", 90)  # repeats outweigh the rest in every fingerprint
    outside = "the same five words again and over " + tail("m", 94)
    texts = [first, other, outside]
    assert simhash.fingerprint(first) == simhash.fingerprint(other) and (simhash.fingerprint(outside) ^ simhash.fingerprint(other)).bit_count() > 4
    assert kept(spark, texts) == grouped(texts) == {0}


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(4)
    plain = ["".join(rnd.choice("aeiostnrlm") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(plain) for _ in range(n))
    passage = text(60)
    rows, lab = [], []
    for i in range(240):
        bad = i % 6 == 0
        t = text(90) + (" grobian schuft" if bad else "")
        rows.append((i, t))
        lab.append((i, 1, int(bad)))
    rows += [(300, rows[1][1]), (301, "too short"), (302, text(60) + " " + passage), (303, passage + " " + text(60)), (304, " | ".join(plain[:80])), (305, None)]
    d = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == d.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
    rules, toxic, near, rest = seen
    assert rules == {i for i in range(304) if i < 240 or i in (300, 302, 303)}
    assert toxic == {i for i in rules if i >= 240 or i % 6}
    assert near == toxic - {300} and rest == near
    left = {r.doc_id: (r.text, r.n_chars) for r in at.collect()}
    assert passage in left[302][0] and passage[10:-10] not in left[303][0] and all(n == len(t) for t, n in left.values())
    packed = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == rest
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "simhash", "suffix_dedup", "packing"] and cp.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_that_sql_can_express(spark):
    import duckdb

    from evloom.llm import catalog

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        cols = sorted(df.columns)
        got, want = df.select(*cols).collect(), c.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)), name


def test_wide_sketches_never_part_similar_sets():
    rnd = np.random.default_rng(4)
    for n in (1, 5, 300, 2000, 9000):
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rnd.integers(0, 2**63, n // 8).astype(np.uint64)]))
        x, y = simhash.sketch(a, 4 * len(a)).tobytes(), simhash.sketch(b, 4 * len(b)).tobytes()
        assert simhash.apart(x, y) == simhash.apart(y, x) <= len(np.setxor1d(a, b))
    other = np.unique(rnd.integers(0, 2**63, 9000).astype(np.uint64))
    assert simhash.apart(simhash.sketch(a, 36000).tobytes(), simhash.sketch(other, 36000).tobytes()) > 2000  # far beyond what 0.8 allows


def test_shared_units_across_batches():
    unit = [1, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    for size in (1, 2, 3, 10):
        b = [pa.RecordBatch.from_arrays([pa.array(unit[i : i + size]), pa.array(range(i, min(len(unit), i + size)))], ["unit", "node"]) for i in range(0, len(unit), size)]
        b.insert(1, b[0].slice(0, 0))
        got = [r for x in simhash._shared(b) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        assert got == [(2, 1), (2, 2), (2, 3), (4, 5), (4, 6), (6, 8), (6, 9)]


def test_near_groups_of_odd_texts(spark):
    texts = [None, "", " \n", "a", "A", "a b c d e f g", *[" ".join(f"w{i}" for i in range(60))] * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "_k long, text string").withColumn("node", F.lit("x")).withColumn("group", F.lit(1))
    got = {r._k: r.group for r in simhash.near_groups(d.select("_k", "text")).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == got[4] == 3 and got[5] == 5 and got[6] == got[7] == got[8] == 6
    assert simhash.near_groups(d.select("_k", "text").limit(0)).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    rnd = random.Random(6)
    plain = ["".join(rnd.choice("aeiostnrlm") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    text = lambda: " ".join(rnd.choice(plain) for _ in range(90))
    same = text()
    ids = [None, None, 3, 3, 3, 4, 5, 6]
    texts = [text(), same, text(), same, None, "", text(), text()]
    kind = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, `group` int"
    full = spark.createDataFrame([(i, t, None, None, None, "x", 1.0, 2) for i, t in zip(ids, texts, strict=True)], kind)
    for name, table, want in (("odd", full, 5), ("empty", full.limit(0), 0)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        at = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, act in cp.STAGES[:-1]:
            at = act(spark, at, str(tmp_path / name))
            assert at.columns == full.columns, stage
            at.write.parquet(str(tmp_path / name / stage))
            at = spark.read.parquet(str(tmp_path / name / stage))
        assert at.count() == want and at.where("text is null").count() == 0
        packed = cp.run(spark, str(tmp_path / name))
        assert packed.select("doc_id", "doc_tokens").where("doc_tokens > 1").count() >= want and (want or packed.count() == 0)


def test_shares_at_any_size(spark):
    from evloom.llm.toxicity import _share

    df = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert 900 < df.where(_share("doc_id", 200_000, 1000)).count() < 1100
    assert (10_000 << 62) // 10**11 > 4 * 10**11  # at 1e11 rows the threshold is far from zero


def test_vectors_of_any_magnitude():
    v = np.random.default_rng(2).standard_normal((20, 8))
    want = embedding_dedup._normal(v.tolist())
    for scale in (1e-170, 1e160):
        assert np.allclose(embedding_dedup._normal((v * scale).tolist()), want)


def test_decode_of_odd_ids(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(0, None), (1, []), (2, [1, 2])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, path).collect()}
    assert got[0] is None and got[1] == "" and got[2]
    for bad in ([None], [-1], [10**8]):
        with pytest.raises(Exception, match="ids of the vocabulary"):
            bpe.decode(spark.createDataFrame([(0, bad)], "doc_id long, ids array<int>"), path).collect()
