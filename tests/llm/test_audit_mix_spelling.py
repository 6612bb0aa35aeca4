"""Operators 11 to 13 against brute force and DuckDB, on small and odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evloom.llm import mixing, source_audit, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["the", "an", "in", "er", "tion", "ré", "über", "ñ", "ST", "Qu", "a", "xy", "ß", "ing"]


def prose(rng, n, syllables=SYLLABLES):
    return "".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) + rng.choice([" ", "\n", ", ", "-7 ", "　", "\x00 "]) for _ in range(n))


def table(seed, n=60, odd=True):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3", "src10"]), 1) for i in range(n)]
    if odd:
        rows += [(None, None, None, None, None), (None, None, None, None, None), (7, "", "fr", "s1", 0), (7, "", "fr", "s2", 0), (8, prose(rng, 3000), "en", None, 5), (9, "the the 漢字 漢字 \U0001f600x thé", "en", "s1", 1), *rows[:5], *rows[:5]]
    return rows


def view(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return spark.createDataFrame(rows, DOCS), con


def told(columns, records):
    order = sorted(columns)
    return sorted(tuple("~" if r[columns.index(c)] is None else repr(r[columns.index(c)]) for c in order) for r in records)


def against_sql(df, con, sql):
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert told(df.columns, [tuple(r) for r in df.collect()]) == told(columns, want.fetchall())


# --- 11


def divergences(rows, least=3, top=200):
    """The contract, in plain Python."""
    rows = [(t or "", lang or "", s or "") for _, t, lang, s, _ in rows]
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t) for t, _, _ in rows]
    words = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in ws] for ws in words]
    out = []
    for lang in {r[1] for r in rows}:
        df, by = Counter(), defaultdict(Counter)
        for ws, (_, x, s) in zip(words, rows, strict=True):
            if x == lang:
                df.update(set(ws))
                by[s].update(ws)
        kept = [w for w, n in df.items() if n >= least]
        part = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c[k] for k in kept) + len(kept)) for w in kept}  # noqa: B023, E731
        p = {s: part(c) for s, c in by.items()}
        q = part(sum(by.values(), Counter()))
        for s in by:
            found = [("pair", o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in by if o != s]
            terms = [("term", w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if by[s][w] and p[s][w] > q[w]]
            for group, most in ((found, None), (terms, top)):
                group.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, i) for i, x in enumerate(group[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"chunk": 500, "block": 20}, {"chunk": 40, "block": 1, "top": 2}])
def test_divergences_equal_the_plain_definition(spark, how):
    rows = table(11)
    got = source_audit.divergences(spark.createDataFrame(rows, DOCS).repartition(5), **how)
    assert sorted(map(tuple, got.collect())) == divergences(rows, top=how.get("top", 200))


def test_divergences_equal_the_sql(spark, tmp_path):
    df, con = view(spark, table(12))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    against_sql(source_audit.query(spark, str(tmp_path)), con, source_audit.SQL)


def test_divergences_of_odd_tables(spark):
    assert source_audit.divergences(spark.createDataFrame([], DOCS)).count() == 0
    got = source_audit.divergences(spark.createDataFrame([(1, "rare words", "en", "a", 1), (2, None, "en", "b", 1)], DOCS).withColumn("term", F.lit(1)).withColumn("block", F.lit(2)))
    assert sorted(map(tuple, got.collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_terms_with_equal_hashes_stay_apart():
    texts = ["Alpha beta", "beta gamma beta", "", "a"]
    buffer = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    low, starts, ends = source_audit.boundaries(buffer, offsets)
    words = [bytes(low[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
    assert words == ["alpha", "beta", "beta", "gamma", "beta", "a"]
    for digest in (lambda b: 1, lambda b: len(b) % 2):
        term, first = source_audit.grouped(low, starts, ends, digest)
        assert [words[first[t]] for t in term] == words and len(set(term.tolist())) == 4


def test_pairs_of_many_sources_leave_by_row(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "_CELLS", 4)
    rows = table(13, odd=False)
    t = source_audit._by_block(200)
    df = spark.createDataFrame(rows, DOCS)
    assert t is not None and sorted(map(tuple, source_audit.divergences(df).collect())) == divergences(rows)


def test_shares_are_exact():
    for n, total in ((0, 1), (5, 7), (9 * 10**12, 10**13 + 1), (10**9 - 1, 10**9)):
        assert source_audit.share(np.array([n]), np.array([total]))[0] == 1 + 10**9 * (n + 1) // total


# --- 12


@pytest.mark.parametrize("block", [7, 500_000])
def test_mix_equals_the_sql(spark, block):
    df, con = view(spark, table(21))
    got = mixing.mix(df.repartition(6), block=block)
    against_sql(got, con, mixing.SQL)


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 50 + 1), "en", f"s{i % 7 if i % 3 else 0}", 0) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), keep=("doc_id", "source", "size", "text")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.part
    total = sum(r.size for r in got)
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(by))}
    free = []
    for s, rs in by.items():
        assert sum(r.taken for r in rs) == math.floor(rs[0].target + 1e-9) and rs[0].source_size == sum(r.size for r in rs)
        if rs[0].target < 3 * rs[0].source_size:
            free.append(rs[0].target / weights[s])
    assert max(free) - min(free) < 1e-9  # sources below their cap share by weight
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(9), keep=("doc_id",)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_prefers_heavy_documents(spark):
    rows = [(i, "w " * 20, "en", "a", 0) for i in range(1000)] + [(5000 + i, "v " * 20, "en", "b", 0) for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1), weights=(1, 3)).where("source_size = 20000 and doc_id < 5000").collect()
    heavy = sum(r.taken > 0 for r in got if r.doc_id % 2 == 0)
    assert heavy > 3 * sum(r.taken > 0 for r in got if r.doc_id % 2)


def test_mix_of_odd_tables_and_its_texts(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "one two three four", "en", "a", 0), (2, "five six", "en", None, 0), (3, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_b", F.lit(1)).withColumn("target", F.lit("x"))
    mixed = mixing.mix(df, keep=("doc_id", "text", "target"))
    assert mixed.count() == 5 and mixed.columns.count("target") == 1
    out = mixing.texts(mixed)
    assert sum(len((r.text or "").split()) for r in out.collect()) == sum(r.taken for r in mixed.collect())
    assert mixing.mix(df.where("source = 'b'")).collect()[0].taken == 0


def test_mix_runs_no_python_worker(spark):
    plan = mixing.mix(spark.createDataFrame(table(22), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- 13


def variants(rows, least=3):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, many = {}, {}
    for w in n:
        some = [x for x in n if x != w and near(w, x)]
        many[w] = len(some)
        best = min(some, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], many[w], n.get(form[w])))
    return sorted(out, key=str)


def misspelt(seed, n):
    rng = random.Random(seed)
    base = ["aaaaa", "aaaaaa", "abcde", "naïveté", "tion" * 2, "strasse", "straße", "thething", "thethin"]
    letters = "abcxé÷ÿ"
    rows = []
    for i in range(n):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i % 9 else None, " ".join(words), "en", "s", 0))
    return rows + rows[:3] + [(1, None, "en", "s", 0), (2, "", None, None, None)]


@pytest.mark.parametrize("split", [512, 6, 1])
@pytest.mark.parametrize("seed", [31, 32])
def test_variants_equal_brute_force(spark, split, seed):
    rows = misspelt(seed, 60)
    got = spelling.variants(spark.createDataFrame(rows, DOCS).repartition(3).withColumn("word", F.lit(1)), split=split)
    want = variants(rows)
    assert len(want) > 60 and any(r[1] and r[2] != r[1] for r in want)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_slips_take_one_code_point_away(spark, monkeypatch):
    rows = [(i, "preußen " * 3 + "abcdé", "de", "s", 0) for i in range(300)]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, DOCS)).collect()}
    want = Counter()
    for i, *_ in rows:
        for run, k in (("preußen", 3), ("abcdé", 1)):
            h = zlib.crc32(f"{i}:{run}".encode())
            run = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += k
    assert got == {w: c for w, c in want.items() if len(w) >= 5 and c >= 3} and len(got) > 3
    monkeypatch.setattr(spelling, "_LONG", 5)
    assert spelling.runs("Preußen, PREUSSEN; abcd preußen") == {"preußen": 2, "preussen": 1}


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w37"}
    with pytest.raises(RuntimeError):
        spelling.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"), 5)


@pytest.mark.parametrize("name", ["op11_source_audit", "op12_mixing", "op13_spelling"])
def test_queries_on_the_smallest_tables(spark, name):
    from evloom.llm import catalog

    sf = "/root/testdata/sf0.001"
    df = catalog.queries()[name](spark, sf)
    if name == "op13_spelling":
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
        assert sorted(map(tuple, df.collect()), key=str) == variants(rows)
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    against_sql(df, con, catalog.oracle_sql()[name])
