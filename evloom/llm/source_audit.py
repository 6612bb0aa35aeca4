"""Divergence of sources from each other and from their language, over the terms that a language keeps.

Terms are found on bytes: a lookup table over the concatenated UTF-8 buffer of many texts marks what belongs to a
term and lower-cases A-Z, so boundaries are where the mark changes or a text ends. The slices are grouped by their
xxhash and compared byte by byte with the first of their group. Counts are shuffled by (language, term) once; kept
counts are then dealt into blocks of terms. In a block the counts are a sparse matrix in row order of sources; for
each source one pass over its entries and one reduceat give the block's part of its divergence from all others.

Defined results: null text, lang and source count as empty strings; repeated rows and rows without an id are documents
of their own; an empty table gives no rows; other columns are not read. A text longer than a chunk is counted in pieces
cut between terms, so memory follows its distinct terms. Arithmetic is in whole numbers (exact up to 9e15 occurrences
of a term in a group). A language that keeps no term has its pairs with value 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evloom.session import _release, discard, ship, written

UNIT, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
_CHUNK = 12 << 20  # bytes of text that a worker takes at once
_BLOCK = 200_000  # kept counts that a block of terms holds, about
_CELLS = 4_000_000  # sums of pairs that a worker holds between blocks
_TABLE = np.zeros(256, np.uint8)  # what a byte is inside a term; 0 is a boundary
_TABLE[np.r_[65:91, 97:123, 128:256]] = np.r_[97:123, 97:123, 128:256]
_COUNTS = "lang string, source string, term string, n long, docs long"


def boundaries(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one buffer (text i is buffer[offsets[i]:offsets[i + 1]]) -> the lower-cased buffer, starts and ends of all terms."""
    low = _TABLE[buffer]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = low != 0
    before, after = inside[:-2].copy(), inside[2:].copy()
    before[offsets[:-1][offsets[:-1] < len(low)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return low, np.flatnonzero(inside[1:-1] & ~before), np.flatnonzero(inside[1:-1] & ~after) + 1


def _same(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which slices equal the slice at index `lead`, compared eight bytes at a time."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) + 1,), "<u8", buffer=padded, strides=(1,))
    same = sizes == sizes[lead]
    at, todo = 0, np.flatnonzero(same)
    while len(todo):
        rest = np.minimum(sizes[todo] - at, 8).astype(np.uint64)
        keep = np.uint64(2**64 - 1) >> (np.uint64(64) - rest * np.uint64(8))
        equal = ((eight[starts[todo] + at] ^ eight[starts[lead[todo]] + at]) & keep) == 0
        same[todo[~equal]] = False
        at += 8
        todo = todo[equal & (sizes[todo] > at)]
    return same


def grouped(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """Slices -> (index of each slice's term, index of the first slice of each term). Equal hashes of different bytes are told apart."""
    data = low.tobytes()
    h = np.empty(len(starts), np.uint64)
    for at in range(0, len(h), 65_536):  # few Python integers at a time
        some = slice(at, at + 65_536)
        h[some] = np.fromiter((digest(data[s:e]) for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)), np.uint64)
    _, first, term = np.unique(h, return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~_same(low, starts, ends - starts, first[term])) if len(h) else np.zeros(0, np.int64)
    extra: dict[bytes, int] = {}
    for i in wrong.tolist():  # a slice whose hash belongs to other bytes
        own = data[starts[i] : ends[i]]
        if own not in extra:
            extra[own] = len(first)
            first = np.append(first, i)
        term[i] = extra[own]
    return term, first


def _strings(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Slices of a buffer as an Arrow string column."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[at])).cast(pa.string())


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _counted(b: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, text) -> counts of the batch by group and term."""
    buffer, offsets = _buffer(b.column(2))
    low, starts, ends = boundaries(buffer, offsets)
    term, first = grouped(low, starts, ends)
    lang, source = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
    group = lang.indices.to_numpy() * np.int64(len(source.dictionary)) + source.indices.to_numpy()
    order = np.argsort(group, kind="stable")  # documents of a group are neighbours
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc = place[np.searchsorted(offsets, starts, "right") - 1]
    key = np.sort(term * np.int64(max(1, b.num_rows)) + doc)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(key)))
    term, doc = np.divmod(key[new], max(1, b.num_rows))
    group = group[order[doc]]
    cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])])) if len(term) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n, cut) if len(cut) else n
    docs = np.diff(np.append(cut, len(term)))
    lead, group = first[term[cut]], group[cut]
    names = [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary)))] if len(cut) else [b.column(0).slice(0, 0), b.column(1).slice(0, 0)]
    return pa.RecordBatch.from_arrays([*names, _strings(low, starts[lead], (ends - starts)[lead]), pa.array(sums, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _long(b: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """One text in pieces cut between terms -> its counts."""
    buffer, _ = _buffer(b.column(2))
    seen: dict[bytes, int] = {}
    at = 0
    while at < len(buffer):
        end = at + most
        while end < len(buffer) and not (gap := np.flatnonzero(_TABLE[buffer[end : end + most]] == 0)[:1]).size:
            end += most
        end = min(len(buffer), end + int(gap[0])) if end < len(buffer) else len(buffer)
        low, starts, ends = boundaries(buffer[at:end], np.array([0, end - at]))
        term, first = grouped(low, starts, ends)
        data, n = low.tobytes(), np.bincount(term, minlength=len(first))
        for i, c in zip(first.tolist(), n.tolist(), strict=True):
            w = data[starts[i] : ends[i]]
            seen[w] = seen.get(w, 0) + c
        at = end
    k = len(seen)
    columns = [pa.repeat(b.column(0)[0], k), pa.repeat(b.column(1)[0], k), pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array(np.ones(k, np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _count_terms(most: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            return _counted(t.to_batches()[0])

        for b in batches:
            sizes = pc.coalesce(pc.binary_length(b.column(2)), 0).to_numpy()
            at = 0
            for i, n in enumerate(sizes.tolist()):
                if n > most or size + n > most:
                    if i > at:
                        held.append(b.slice(at, i - at))
                    if held:
                        yield out()
                    held, size, at = [], 0, i
                if n > most:
                    yield _long(b.slice(i, 1), most)
                    at = i + 1
                else:
                    size += n
            if b.num_rows > at:
                held.append(b.slice(at))
        if held:
            yield out()
        _release()

    return run


def term_counts(docs: DataFrame, chunk: int = _CHUNK) -> DataFrame:
    """docs (lang, source, text; no nulls) -> (lang, source, term, n, docs): counts and numbers of documents, partial by chunk. No shuffle."""
    ship(docs.sparkSession)
    return docs.select("lang", "source", "text").mapInArrow(_count_terms(chunk), _COUNTS)


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), digit by digit in base 1000 so that nothing overflows."""
    rest, out = count.astype(np.int64) + 1, np.zeros(np.shape(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), elementwise."""
    d = p - q
    return ((d * d).view(np.uint64) // q.view(np.uint64)).view(np.int64)


class _Block:
    """One language's block of terms: a sparse matrix of counts by source and term, and the sums of all its groups."""

    def __init__(self, t: pa.Table):
        head = t.filter(pc.is_null(t.column("term"))).sort_by("source")
        self.lang, self.names = head.column("lang")[0].as_py(), head.column("source").combine_chunks()
        kept, of_lang = head.column("kept")[0].as_py(), head.column("of_lang")[0].as_py()
        body = t.filter(pc.is_valid(t.column("term")))
        coded = body.column("term").combine_chunks().dictionary_encode()
        term, n = coded.indices.to_numpy(), body.column("n").to_numpy()
        source = pc.index_in(body.column("source"), self.names).to_numpy()
        order = np.argsort(source, kind="stable")
        self.term, self.source, n = term[order], source[order], n[order]
        self.terms = coded.dictionary
        total = head.column("n").to_numpy() + kept
        self.p0 = share(np.zeros(len(total), np.int64), np.maximum(total, 1))
        self.p = share(n, total[self.source])
        whole = np.zeros(len(self.terms), np.int64)
        np.add.at(whole, self.term, n)
        self.q = share(whole, of_lang + kept) if len(whole) else whole
        self.row = np.searchsorted(self.source, np.arange(len(total) + 1))

    def pairs(self, a: int) -> np.ndarray:
        """The block's part of the divergence of source `a` from each source."""
        pa_ = np.full(len(self.terms), self.p0[a])
        own = slice(self.row[a], self.row[a + 1])
        pa_[self.term[own]] = self.p[own]
        values, times = np.unique(pa_, return_counts=True)
        out = np.zeros(len(self.p0), np.int64)
        for at in range(0, len(values), step := max(1, _CELLS // len(self.p0))):  # as if every other source lacked every term
            v = values[at : at + step, None]
            out += (divergence(np.repeat(v, len(self.p0), 1), np.repeat(self.p0[None], len(v), 0)) * times[at : at + step, None]).sum(axis=0)
        if len(self.p):  # what the terms that they have change
            x = pa_[self.term]
            change = divergence(x, self.p) - divergence(x, self.p0[self.source])
            some = np.flatnonzero(self.row[1:] > self.row[:-1])
            out[some] += np.add.reduceat(change, self.row[some])
        return out

    def top(self, most: int):
        """Per source, its terms above the language's share: the `most` of largest value, ties of the last one included."""
        for a in range(len(self.p0)):
            own = slice(self.row[a], self.row[a + 1])
            t, p = self.term[own], self.p[own]
            t, p = t[p > self.q[t]], p[p > self.q[t]]
            value = divergence(p, self.q[t])
            if len(value) > most:
                some = value >= np.partition(value, len(value) - most)[len(value) - most]
                t, value = t[some], value[some]
            if len(value):
                yield a, t, value


def _by_block(top: int):
    """Rows sorted by (lang, block) -> (lang, source, part, item, value): parts of pairs, and candidates for the terms."""
    names = ["lang", "source", "part", "item", "value"]

    def rows(b: _Block, a: int, part: str, item: pa.Array, value: np.ndarray):
        k = len(value)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(b.lang, pa.string()), k), pa.repeat(b.names[a], k), pa.repeat(pa.scalar(part), k), item, pa.array(value)], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        sums: tuple[_Block, np.ndarray] | None = None

        def flush():
            b, m = sums
            for a in range(len(m)):
                others = np.delete(np.arange(len(m)), a)
                if len(others):
                    yield rows(b, a, "pair", b.names.take(pa.array(others)), m[a, others])

        def block():
            nonlocal sums
            b = _Block(pa.Table.from_batches(held))
            for a, t, value in b.top(top):
                yield rows(b, a, "term", b.terms.take(pa.array(t)), value)
            size = len(b.p0)
            if sums and (sums[0].lang != b.lang or size * size > _CELLS):
                yield from flush()
                sums = None
            if size * size > _CELLS:  # too many pairs to hold: each source's part goes out as it is made
                for a in range(size):
                    others = np.delete(np.arange(size), a)
                    yield rows(b, a, "pair", b.names.take(pa.array(others)), b.pairs(a)[others])
                return
            m = np.stack([b.pairs(a) for a in range(size)])
            sums = (b, m if sums is None else m + sums[1])

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, no = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            first = (batch.column(0)[0].as_py(), int(no[0]))
            cuts = np.flatnonzero((lang[1:] != lang[:-1]) | (no[1:] != no[:-1])) + 1
            if last is not None and first != last:
                yield from block()
                held = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if s:
                    yield from block()
                    held = []
                held.append(batch.slice(s, e - s))
            last = (batch.column(0)[batch.num_rows - 1].as_py(), int(no[-1]))
        if held:
            yield from block()
        if sums:
            yield from flush()
        _release()

    return run


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP, chunk: int = _CHUNK, block: int = _BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the source's divergence from each other source of its language
    over all kept terms (in at least `least_docs` of the language's documents). Part `term`: the `top` terms that set it
    apart from its language."""
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    by_term = term_counts(read, chunk).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    by_term = by_term.withColumn("docs", F.sum("docs").over(w)).withColumn("lead", (F.min("source").over(w) == F.col("source")).cast("long"))
    kept = written(by_term.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "lead"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("lead").alias("lead"), F.count("*").alias("rows"))
    every = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n", "lead", "rows"])
    of = Window.partitionBy("lang")
    groups = written(every.withColumn("kept", F.sum("lead").over(of)).withColumn("of_lang", F.sum("n").over(of)), "groups")
    got = groups.agg(F.sum("rows").alias("rows"), F.count("*").alias("groups")).first()
    blocks = max(1, -(-(got["rows"] or 0) // max(block, 4 * got["groups"])))
    head = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "kept", "of_lang")
    none = F.lit(None).cast("long")
    body = kept.select("lang", F.expr(f"cast(pmod(xxhash64(term), {blocks}) as int)").alias("block"), "source", "term", "n", none.alias("kept"), none.alias("of_lang"))
    dealt = head.unionAll(body).repartition("lang", "block").sortWithinPartitions("lang", "block")
    found = written(dealt.mapInArrow(_by_block(top), "lang string, source string, part string, item string, value long"), "divergences")
    discard(kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def query(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{_UPPER}', '{_LOWER}') AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
q AS (SELECT lang, term, 1 + {UNIT}::BIGINT * (sum(n)::BIGINT + 1) // (any_value(whole) + any_value(v)) AS q FROM c JOIN v USING (lang)
  JOIN (SELECT lang, sum(n)::BIGINT AS whole FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + {UNIT}::BIGINT * (coalesce(n, 0) + 1) // (total + v) AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found QUALIFY part = 'pair' OR rank <= {TOP}
"""
