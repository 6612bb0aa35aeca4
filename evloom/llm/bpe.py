"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A word is held as its parts (token ids) and, beside them, the rank of every adjacent pair. The
array is scanned for its minimum, that boundary is deleted, the two neighbouring ranks are
refreshed, until no pair has a rank. Words of one length class are rows of one matrix, so each
scan, deletion and refresh is one numpy operation over thousands of words; only words that a
worker has not met are encoded, its memory of words is bounded.

Ids equal those of the tokenizers library for the same file with add_special_tokens=False:
added tokens in a text become their ids, everything else is split by the file's pattern.
Defined results: a null text is an empty text (no ids, decoded empty); texts of any length.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.session import ship

# The pattern of this family of tokenizers, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same alternatives for texts below U+0250, the frequent ones first; L, N and S are their letters, numbers and white space.
FAST = " ?[{L}]+| ?[{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
NO_RANK = np.int32(2**31 - 1)
WORDS_HELD = 80_000
_LONG = 192  # bytes; longer words use a heap


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


def late_letters() -> dict[int, str]:
    """Code points that the splitting library classes by a later Unicode version than the tokenizers
    library does: they are unassigned in this Python's table, and so neither letter, number nor space."""
    odd = regex.compile(r"[\p{L}\p{N}\s]")
    return {c: "" for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and odd.match(chr(c))}


def splitter(pattern: str, fast: str):
    """text -> words: `pattern`, or for texts below U+0250 the equivalent `fast`, which the standard library runs quicker."""
    own = {k: "".join(re.escape(chr(c)) for c in range(0x250) if regex.match(p, chr(c))) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    quick, odd, full = re.compile(fast.format(**own)).findall, re.compile("[^\x00-\u024f]").search, regex.compile(pattern).findall
    return lambda text: full(text) if odd(text) else quick(text)


def recall(new: list[str], held: dict, older: dict) -> list[str]:
    """Moves words that are remembered from before into `held`; returns the others."""
    if not older:
        return new
    known = [w for w in new if w in older]
    held.update({w: older[w] for w in known})
    return [w for w in new if w not in older]


class PairRanks:
    """(left id, right id) -> rank, as an open-addressing table probed by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, width: int):
        size = 1 << max(8, int(len(left) * 4).bit_length())
        self.mask, self.width = np.uint64(size - 1), np.uint64(width)
        self.keys, self.ranks = np.full(size, 2**64 - 1, np.uint64), np.full(size, NO_RANK, np.int32)
        key = left.astype(np.uint64) * self.width + right.astype(np.uint64)
        todo, at = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(2**64 - 1)
            cand = todo[free]
            _, first = np.unique(at[cand], return_index=True)
            won = cand[first]
            self.keys[at[won]], self.ranks[at[won]] = key[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) * self.width + right.astype(np.uint64)
        at = self._slot(key)
        out = np.full(key.shape, NO_RANK, np.int32)
        got = self.keys[at]
        hit = got == key
        out[hit] = self.ranks[at[hit]]
        open_ = np.flatnonzero(~hit & (got != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            got = self.keys[at[open_]]
            hit = got == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got != np.uint64(2**64 - 1))]
        return out


class ByteBPE:
    """Built from the text of a tokenizers JSON file of the byte-level family."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        vocab: dict[str, int] = j["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.added: dict[str, int] = {t["content"]: t["id"] for t in j["added_tokens"]}
        n = max([*vocab.values(), *self.added.values()]) + 1
        self.ranks = PairRanks(left, right, n)
        letters = byte_letters()
        self.of_byte = np.array([vocab[x] for x in letters], np.int32)
        suffix = j["model"].get("end_of_word_suffix") or ""
        self.of_last = np.array([vocab[x + suffix] for x in letters], np.int32)  # of the last byte of a word
        back = {x: b for b, x in enumerate(letters)}
        self.token_bytes: list[bytes] = [b""] * n
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(back[x] for x in text) if all(x in back for x in text) else text.encode()
        for text, i in self.added.items():
            self.token_bytes[i] = text.encode()
        self.split, self.finditer = splitter(PATTERN, FAST), regex.compile(PATTERN).finditer
        self.late = late_letters()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words_to_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of an int32 array."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for lo, hi in ((1, 4), (5, 8), (9, 12), (13, 18), (19, 32), (33, 64), (65, _LONG)):
            rows = np.flatnonzero((sizes >= lo) & (sizes <= hi))
            for at in range(0, len(rows), 16384):
                self._matrix(words, rows[at : at + 16384], hi, out)
        for i in np.flatnonzero(sizes > _LONG):
            out[i] = self._heap(words[i]).tobytes()
        return out

    def _matrix(self, words, rows, width, out) -> None:
        n = len(rows)
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(n, width)
        size = np.fromiter((len(words[i]) for i in rows), np.int64, n)
        ids = self.of_byte[raw]
        ids[np.arange(n), size - 1] = self.of_last[raw[np.arange(n), size - 1]]
        rank = np.full((n, width), NO_RANK, np.int32)  # rank[i]: of parts i and i + 1; the last has none
        col = np.arange(width)
        live = col[None, :-1] < (size - 1)[:, None]
        flat = self.ranks(ids[:, :-1][live], ids[:, 1:][live])
        rank[:, :-1][live] = flat
        left = rows
        while len(left):
            pos = rank.argmin(axis=1)
            r = np.arange(len(left))
            best = rank[r, pos]
            done = best == NO_RANK
            if done.any():
                raw, at = ids[done].tobytes(), 0
                for k, n in zip(left[done].tolist(), (size[done] * 4).tolist(), strict=True):
                    out[k] = raw[at : at + n]
                    at += 4 * width
                go = ~done
                left, ids, rank, size, pos, best = left[go], ids[go], rank[go], size[go], pos[go], best[go]
                if not len(left):
                    break
                r = np.arange(len(left))
            # delete the boundary after pos: everything behind it moves one place to the left
            ids[r, pos] = self.merged[best]
            after = col[None, :-1] > pos[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            same = col[None, :-1] >= pos[:, None]
            rank[:, :-1] = np.where(same, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NO_RANK
            size -= 1
            # refresh the two neighbouring ranks
            has = pos > 0
            if has.any():
                i, p = r[has], pos[has]
                rank[i, p - 1] = self.ranks(ids[i, p - 1], ids[i, p])
            has = pos < size - 1
            rank[r[~has], pos[~has]] = NO_RANK
            if has.any():
                i, p = r[has], pos[has]
                rank[i, p] = self.ranks(ids[i, p], ids[i, p + 1])

    def _heap(self, word: bytes) -> np.ndarray:
        """The same merges for one very long word, in n log n."""
        ids = [*self.of_byte[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.of_last[word[-1]])]
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(k, i, ids[i], ids[i + 1]) for i, k in enumerate(first) if k != NO_RANK]
        heapq.heapify(heap)
        one = lambda a, b: int(self.ranks(np.array([a], np.int64), np.array([b], np.int64))[0])
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[k]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (x := one(ids[i], ids[nxt[i]])) != NO_RANK:
                    heapq.heappush(heap, (x, i, ids[i], ids[nxt[i]]))
            if prv[i] >= 0 and (x := one(ids[prv[i]], ids[i])) != NO_RANK:
                heapq.heappush(heap, (x, prv[i], ids[prv[i]], ids[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _pieces(self, text: str) -> list:
        """Words of a text; an added token stands as its id."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.split(text[at:])

    def _careful(self, text: str) -> list:
        """As _pieces, where the text has code points of a later Unicode version."""
        plain = text.translate(self.late)
        out, at = [], 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            end = m.start() if m else len(text)
            out += [text[at + w.start() : at + w.end()] for w in self.finditer(plain[at:end])]
            if m:
                out.append(self.added[m.group()])
                at = m.end()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of an int32 array."""
        if len(self.held) > WORDS_HELD:
            self.older, self.held = self.held, {}
        split = [self._pieces(t) for t in texts]
        held = self.held
        for again in (False, True):
            new = recall([w for w in set(itertools.chain.from_iterable(split)).difference(held) if w.__class__ is str], held, self.older)
            if new:
                late = self.late
                odd = {c for c in set("".join(new)) if ord(c) in late}
                bad = {w for w in new if odd and not odd.isdisjoint(w)}
                if bad and not again:
                    split = [self._careful(t) if any(w in bad for w in ws) else ws for t, ws in zip(texts, split, strict=True)]
                    continue
                ids = self.words_to_ids([w.encode() for w in new])
                held.update(zip(new, ids, strict=True))
                for w, x in zip(new, ids, strict=True) if bad else ():
                    if w in bad:  # met again it must be split with care again
                        del held[w]
                        split = [[(y if y != w else x) for y in ws] if w in ws else ws for ws in split]
            break
        out = []
        for ws in split:
            try:
                out.append(b"".join(map(held.__getitem__, ws)))
            except KeyError:
                out.append(b"".join(w if isinstance(w, bytes) else held[w] if isinstance(w, str) else np.int32(w).tobytes() for w in ws))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_MADE: dict[int, ByteBPE] = {}


def _model(spec) -> ByteBPE:
    key = hash(spec.value)
    if key not in _MADE:
        _MADE[key] = ByteBPE(spec.value)
    return _MADE[key]


def _spec(spark, path: str):
    """The vocabulary file's text, read by the driver: its size is fixed with the tokenizer (a few MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of `text` as array<int> in column `out` (replaces a column of that name)."""
    spark = docs.sparkSession
    ship(spark)
    spec = _spec(spark, path)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(spec)
        for col in batches:
            flat, sizes = bytearray(), []
            for at in range(0, len(col), 64):  # few texts at a time are held as words
                for raw in model.encode_batch([x or "" for x in col[at : at + 64].to_pylist()]):
                    flat += raw
                    sizes.append(len(raw) // 4)
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32)))

    return docs.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the text of the ids (special tokens kept) in column `out`; a null array is null, an empty one is "". A null id
    or one that the vocabulary does not have is an error."""
    spark = df.sparkSession
    ship(spark)
    spec = _spec(spark, path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(spec)
        for col in batches:
            off = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)
            if col.values.null_count or (len(flat) and not 0 <= flat.min() <= flat.max() < len(model.token_bytes)):
                raise ValueError("ids to decode must be ids of the vocabulary")
            there = col.is_valid().to_pylist()
            yield pa.array([model.decode(flat[a:b].tolist()) if ok else None for ok, a, b in zip(there, off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())

    return df.withColumn(out, run(F.col(ids)))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs, path).drop("text"), path, out="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.expr("btrim(to_json(ids), '[]')"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
