"""Groups of spelling variants: words one inserted, deleted or replaced code point apart, each led to its most frequent near word.

Even-partition pigeonhole join: a word is cut into two segments by its length, and one edit leaves one of them whole. Each
word is indexed under its two segments, with its length, and probes the index of its own length with the same segments and
that of words one shorter with its prefix and its suffix, which is the second segment shifted by one. Lists of an index key
are checked inside tasks: the first difference of a pair settles whether one edit explains it, and in which of its two
lists it counts, so no pair counts twice and no pair is ever emitted: tasks give each word's number of near words and its best one.

A list longer than `split` is dealt again under what the other segment is with one code point left out: such a list has no
more members than the alphabet allows (a hot prefix costs more keys, not more pairs). Roots are found by pointer doubling:
forms at least double the count, so chains are short.

Letters are A-Z, a-z and U+00C0 to U+00FF, only A-Z are lower-cased; a letter is one byte in Latin-1, on which words are compared.
Defined results: a null text has no words; a null id is an empty string in the digest; repeated rows and ids count each time;
an empty table gives no rows; other columns are not read. Texts are read whole; very long ones are scanned in place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.session import discard, ship, sliced, written

from .simhash import _by_unit

LEAST_LENGTH, LEAST_COUNT, TIMES, SLIP = 5, 3, 2, 97
_HELD = 300_000  # distinct words that a worker counts before it passes them on
_SPLIT = 512  # members of a list whose pairs are checked directly
_LONG = 4_000_000  # characters of a text whose words are not listed at once
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")


def runs(text: str) -> Counter:
    """Maximal runs of letters of LEAST_LENGTH or more, A-Z lower-cased, with their counts."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: only A-Z change
    return Counter(_RUN.findall(low)) if len(low) <= _LONG else Counter(m.group() for m in _RUN.finditer(low))


def slipped(base: int, run: str) -> str:
    """The run, or for one in 97 (by a digest that begins with `base`, the id's) the run without one code point."""
    h = zlib.crc32(run.encode(), base)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_words(batches):
    """(id, text) -> (word, n), partial."""
    total: Counter = Counter()

    def out():
        b = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return b

    for b in sliced(batches):
        for name, text in zip(b.column(0), b.column(1), strict=True):
            if text.is_valid:
                base = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for run, n in runs(text.as_py()).items():
                    word = slipped(base, run)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
            if len(total) > _HELD:
                yield out()
    if total:
        yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of all texts with at least `least` occurrences."""
    ship(docs.sparkSession)
    some = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(_count_words, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as one buffer of Latin-1 bytes with 8 bytes more, and their offsets. In UTF-8, U+00C0 to U+00FF are C3 and the byte less 40."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    keep = raw != 0xC3
    out = raw[keep]
    out[out >= 0x80] += 0x40
    return np.concatenate([out, np.zeros(8, np.uint8)]), np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]


def _common(eight: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the n bytes from x and from y on are equal before the first difference, eight at a time."""
    out = np.zeros(len(x), np.int64)
    todo = np.flatnonzero(n > 0)
    while len(todo):
        at = out[todo]
        rest = np.minimum(n[todo] - at, 8)
        d = (eight[x[todo] + at] ^ eight[y[todo] + at]) & (np.uint64(2**64 - 1) >> (np.uint64(64) - rest.astype(np.uint64) * np.uint64(8)))
        step = np.where(d == 0, rest, np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) // 8)
        out[todo] = at + step
        todo = todo[(d == 0) & (n[todo] > at + step)]
    return out


def _near(t: pa.Table, cut: np.ndarray):
    """Lists (unit, kind, seg, size, word, n), the words of length `size` before those one longer -> (word, near, best_n, best): how many
    near words of each word are in its lists, and the most frequent one, the first in code-point order of several.
    kind 0: all pairs; 1: words of equal length; 2: words of different length."""
    t = t.combine_chunks()
    kind, seg, size, n = (t.column(c).to_numpy() for c in ("kind", "seg", "size", "n"))
    word = t.column("word").chunk(0) if t.num_rows else pa.array([], pa.string())
    if not len(word):
        return
    buffer, offsets = _latin(word)
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))
    longer = np.diff(offsets) - size
    start, size = offsets[:-1], size.astype(np.int64)
    rank = pc.rank(word, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    near, best_n, best = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), -1)

    def better(i, j):
        """Each of i meets one of j."""
        near[i] += 1
        win = (n[j] > best_n[i]) | ((n[j] == best_n[i]) & (rank[j] < rank[best[i]]))
        best_n[i[win]], best[i[win]] = n[j[win]], j[win]

    ends = np.append(cut[1:], len(n))
    short = np.add.reduceat((longer == 0).astype(np.int64), cut)  # they come first
    s, k, z = (x[(short > 0) & (ends - cut > 1)] for x in (cut, ends - cut, short))
    gap = 0
    while len(s):
        gap += 1
        some = k > gap
        s, k, z = s[some], k[some], z[some]
        reps = np.minimum(z, k - gap)
        i = np.repeat(s - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        j = i + gap
        more = longer[j]
        ok = (size[i] == size[j]) & (seg[i] == seg[j]) & (kind[i] == kind[j]) & (longer[i] == 0) & (kind[i] != 2 - more)
        i, j, more = i[ok], j[ok], more[ok]
        first = _common(eight, start[i], start[j], size[i])
        rest = size[i] - first - (1 - more)
        ok = (rest >= 0) & ((seg[i] == 1) == (first >= size[i] // 2))
        i, j, more, first, rest = i[ok], j[ok], more[ok], first[ok], rest[ok]
        ok = _common(eight, start[i] + first + (1 - more), start[j] + first + 1, rest) == rest
        better(i[ok], j[ok])
        better(j[ok], i[ok])
    some = np.flatnonzero(near)
    yield pa.RecordBatch.from_arrays([word.take(pa.array(some)), pa.array(near[some]), pa.array(best_n[some]), word.take(pa.array(best[some]))], ["word", "near", "best_n", "best"])


def _posted(words: DataFrame) -> DataFrame:
    """(unit, kind, seg, size, word, n): each word under its segments, and under the segments that a word one shorter may share with it."""
    entry = "named_struct('unit', xxhash64({l}, {s}, {t}), 'seg', {s}, 'size', {l})"
    own = [entry.format(l="l", s=1, t="substring(word, 1, l div 2)"), entry.format(l="l", s=2, t="substring(word, l div 2 + 1)")]
    less = [entry.format(l="l - 1", s=1, t="substring(word, 1, (l - 1) div 2)"), entry.format(l="l - 1", s=2, t="substring(word, (l - 1) div 2 + 2)")]
    df = words.withColumn("l", F.length("word"))
    df = df.withColumn("e", F.explode(F.expr(f"if(l > {LEAST_LENGTH}, array({', '.join(own + less)}), array({', '.join(own)}))")))
    return df.select("e.unit", F.lit(0).alias("kind"), "e.seg", F.col("e.size").cast("int").alias("size"), "word", "n")


def _again(rows: DataFrame) -> DataFrame:
    """Members of long lists, under the other segment with one code point left out: at a known place for words of equal length,
    at any place of the longer word for words of different length."""
    other = "if(seg = 1, substring(word, size div 2 + 1), substring(word, 1, length(word) - (size - size div 2)))"
    out = "concat(substring(o, 1, k - 1), substring(o, k + 1))"
    same = f"transform(sequence(1, length(o)), k -> named_struct('kind', 1, 'unit', xxhash64(unit, k, {out})))"
    met = "array(named_struct('kind', 2, 'unit', xxhash64(unit, 0, o)))"
    meets = f"transform(array_distinct(transform(sequence(1, length(o)), k -> {out})), x -> named_struct('kind', 2, 'unit', xxhash64(unit, 0, x)))"
    df = rows.withColumn("o", F.expr(other)).withColumn("e", F.explode(F.expr(f"if(length(word) = size, concat({same}, {met}), {meets})")))
    return df.select("e.unit", "e.kind", "seg", "size", "word", "n")


def near_words(words: DataFrame, split: int = _SPLIT) -> DataFrame:
    """words (word, n; each once) -> (word, n_near, best_n, best) for the words that have a near word."""
    ship(words.sparkSession)
    posted = written(_posted(words), "posted")
    long = written(posted.groupBy("unit").count().where(F.col("count") > split).select("unit"), "long")
    lists = posted
    if long.limit(1).count():
        lists = posted.join(long, "unit", "left_anti").unionByName(_again(posted.join(long, "unit", "left_semi")))
    found = lists.withColumn("l", F.length("word")).repartition("unit").sortWithinPartitions("unit", "l").drop("l")
    found = written(found.mapInArrow(_by_unit(_near), "word string, near long, best_n long, best string"), "near")
    for used in (posted, long):
        discard(used)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """forms (word, form; no circles) -> (word, root), by pointer doubling: round k knows the form 2^k steps on."""
    up = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        on = up.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        new = written(up.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        discard(up)
        up = new.drop("moved")
        up._evloom_path = new._evloom_path
        if not moved:
            return up
    raise RuntimeError("forms run in a circle")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST_COUNT, times: int = TIMES, split: int = _SPLIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with at least `least` occurrences; its form is the most frequent word
    near it, if that has at least `times` its count; its root is the last of its forms."""
    words = written(word_counts(docs, id_col, text, least), "words")
    rich = words.join(near_words(words, split), "word", "left").withColumn("led", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    rich = written(rich.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("led"), F.col("best")).alias("form"), F.when(F.col("led"), F.col("best_n")).alias("form_n")), "forms")
    discard(words)
    last = roots(rich.where("form is not null").select("word", "form"))
    return rich.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
