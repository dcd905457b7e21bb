"""Collocations by Rabin-Karp fingerprints: phrases of 2 to 4 words that occur often, and hold together.

Texts are lowered in A-Z, split at ``BREAKS`` into pieces and at spaces and tabs into words; everything is counted for each
language (null: ``und``).

1. Prefix polynomials in numpy give the fingerprint of every word and word pair of a batch. A task sorts and sums them and
   deals them out in ranges of fingerprints, packed; a range is summed in a task, streaming range by range.
   Fingerprints that reach the least count set bits in a table of ``BITS`` bits (its size doesn't grow).
2. The same for three and four words, where all pairs in them have their bits set: a phrase is never more frequent than its parts.
3. Occurrences whose bit is set are grouped in their batch by fingerprint, each group points to its first occurrence, and all others
   are compared with it in the text, word by word; unequal ones are counted apart. One text for each group is made
   and summed by text over all batches. So only phrases whose bit is set become strings, and counts are exact whatever collides.

Pointers to occurrences stay within their batch: what meets another batch is the phrase's text, compared as such.

Score, cut and containment work on the table of frequent phrases: each part of a frequent phrase is in it.

Defined cases: null or empty texts have no words; repeated rows count each; words may be of any length. A language whose texts
have no frequent phrase gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajloom.llm.bytewords import exact_ids, gram_hashes, kinds, mixed, words_of
from trajloom.llm.common import scratch, written

BREAKS = b".,;:!?\n\x0b\x0c\r"
KINDS = kinds(b" \t", BREAKS)
LONGEST = 4
LEAST = 30
COVERED = 80  # percent
TOP = 2000
BITS = 1 << 26
HELD = 2 << 20  # fingerprints that a task holds before it hands them on
DOCS_A_RANGE = 4096

_PLANE = 1 << 15  # bits of a row of Spark's bitmap functions


def _seeds(langs: pa.Array) -> np.ndarray:
    own = langs.dictionary_encode()
    codes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8")) for x in own.dictionary.to_pylist()], dtype=np.uint64)
    return codes[np.asarray(own.indices)]


def _grams(w, seeds: np.ndarray, n: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places at which n words stand in one piece (of those given), and their fingerprints: of the words, their number and the language."""
    k = max(len(w.hash) - n + 1, 0)
    at = np.flatnonzero(w.piece[:k] == w.piece[n - 1 :]) if places is None else places
    fps = gram_hashes(w.hash, n)[at]
    return at, mixed(fps + seeds[w.text[at]] + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def is_set(bits: np.ndarray, fps: np.ndarray) -> np.ndarray:
    p = fps & np.uint64(BITS - 1)
    return (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _longer(w, pairs: np.ndarray, n: int) -> np.ndarray:
    """Places at which every pair of the n words is marked."""
    k = max(len(w.hash) - n + 1, 0)
    ok = np.ones(k, bool)
    for i in range(n - 1):
        ok &= pairs[i : i + k]
    return np.flatnonzero(ok)


def _pairs(w, seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the pair at each word stands in a piece and has its bit set."""
    out = np.zeros(max(len(w.hash), 1), bool)
    at, fps = _grams(w, seeds, 2)
    out[at[is_set(bits, fps)]] = True
    return out


def _summed(fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fps)
    fps, counts = fps[order], counts[order]
    first = np.flatnonzero(np.r_[True, fps[1:] != fps[:-1]])
    return fps[first], np.add.reduceat(counts, first, dtype=counts.dtype)


def _packed(numbers: np.ndarray) -> bytes:
    """The numbers' bytes plane by plane: the upper ones, all but equal in a sorted range, are then easy to compress."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def packed_ranges(slices, range_bits: int):
    """Fingerprints, slice by slice -> a task's fingerprints and counts, packed by range."""

    def flush(held):
        fps, counts = _summed(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held]))
        at = np.searchsorted(fps, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits))
        ends = np.r_[at[1:], len(fps)]
        own = np.flatnonzero(ends > at)
        for some in np.array_split(own, len(own) // 1024 + 1):
            rows = [(int(r), _packed(fps[at[r] : ends[r]]), _packed(counts[at[r] : ends[r]])) for r in some.tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["range", "fps", "counts"])

    held, n_held = [], 0
    for x in slices:
        fps, counts = np.unique(x, return_counts=True)
        if len(fps):
            held.append((fps, counts.astype(np.uint32)))
            n_held += len(fps)
        if n_held > HELD:
            yield from flush(held)
            held, n_held = [], 0
    if held:
        yield from flush(held)


def _fingerprints(range_bits: int, bits=None):
    """(lang, text) -> packed fingerprints of words and pairs, or (bits of those given) of longer phrases."""

    def of_slices(batches, table):
        for b in batches:
            seeds = _seeds(b.column(0))
            for w in words_of(b.column(1), KINDS):
                if table is None:
                    own = [_grams(w, seeds, n)[1] for n in (1, 2)]
                else:
                    pairs = _pairs(w, seeds, table)
                    own = [_grams(w, seeds, n, _longer(w, pairs, n))[1] for n in range(3, LONGEST + 1)]
                yield np.concatenate(own)

    def run(batches):
        yield from packed_ranges(of_slices(batches, None if bits is None else np.frombuffer(bits.value, np.uint8)), range_bits)

    return run


def _frequent(least: int):
    """Packed fingerprints, sorted by range -> the bits of those that reach the least count."""

    def of_range(parts):
        fps, counts = _summed(np.concatenate([x for x, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64))
        own = fps[counts >= least] & np.uint64(BITS - 1)
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64))], ["bit"])

    def run(batches):
        now, parts = None, []
        for b in batches:
            for r, fps, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if parts and r != now:
                    yield of_range(parts)
                    parts = []
                now = r
                parts.append((_unpacked(fps, np.uint64), _unpacked(counts, np.uint32)))
        if parts:
            yield of_range(parts)

    return run


def bits_of(found: DataFrame, least: int):
    """Of packed fingerprints those that occur so often, as a broadcast table of bits, of a fixed size."""
    spark = found.sparkSession
    found = found.repartition("range").sortWithinPartitions("range").mapInArrow(_frequent(least), "bit bigint")
    plane = F.floor(F.col("bit") / _PLANE).cast("int")
    rows = found.groupBy(plane.alias("plane")).agg(F.bitmap_construct_agg(F.col("bit") % _PLANE).alias("bits")).collect()
    table = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        table[r["plane"] * _PLANE // 8 : (r["plane"] + 1) * _PLANE // 8] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(table.tobytes())


def _bit_table(docs: DataFrame, least: int, range_bits: int, bits=None):
    return bits_of(docs.mapInArrow(_fingerprints(range_bits, bits), "range int, fps binary, counts binary"), least)


def _texts(short, long):
    """(lang, text) -> lang, n, phrase, f of every batch: phrases whose bit is set, verified in the text; n = 0: all words of a language."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches):
        tables = np.frombuffer(short.value, np.uint8), np.frombuffer(long.value, np.uint8)
        for b in batches:
            seeds, langs = _seeds(b.column(0)), b.column(0).dictionary_encode()
            code = np.asarray(langs.indices).astype(np.int64)
            for w in words_of(b.column(1), KINDS):
                pairs = _pairs(w, seeds, tables[0])
                places, prints = {}, {}
                for n in range(1, LONGEST + 1):
                    at, fps = _grams(w, seeds, n, _longer(w, pairs, n) if n > 2 else None)
                    ok = is_set(tables[n > 2], fps)
                    places[n], prints[n] = at[ok], fps[ok]
                used = np.zeros(len(w.hash), bool)
                for n, at in places.items():
                    for i in range(n):
                        used[at + i] = True
                where = np.flatnonzero(used)
                ids = np.zeros(len(w.hash), np.int64)
                ids[where], words = exact_ids(w, where)
                sizes = np.bincount(code[w.text], minlength=len(langs.dictionary))
                some = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(some)), pa.array(np.zeros(len(some), np.int32)), pa.array([""] * len(some), pa.string()), pa.array(sizes[some])], schema=schema)
                for n, at in places.items():
                    if not len(at):
                        continue
                    own = np.stack([code[w.text[at]], *[ids[at + i] for i in range(n)]], axis=1)
                    _, first, group, counts = np.unique(prints[n], return_index=True, return_inverse=True, return_counts=True)
                    distinct = own[first]
                    if not (own == distinct[group]).all():  # fingerprints collide
                        distinct, counts = np.unique(own, axis=0, return_counts=True)
                    phrase = pc.binary_join_element_wise(*[words.take(pa.array(distinct[:, i + 1])) for i in range(n)], " ")
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(distinct[:, 0])), pa.array(np.full(len(distinct), n, np.int32)), phrase, pa.array(counts.astype(np.int64))], schema=schema)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, n, phrase, f of every phrase of 1 to 4 words with f >= least, and of all words of each language as n = 0. docs: lang, text."""
    some = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    range_bits = max(10, (docs.count() // DOCS_A_RANGE).bit_length())
    short = _bit_table(some, least, range_bits)
    long = _bit_table(some, least, range_bits, short)
    found = some.mapInArrow(_texts(short, long), "lang string, n int, phrase string, f bigint")
    return found.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("n") == 0))


def ranked(found: DataFrame, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score from the table of ``frequent_phrases``."""
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    known = found.filter("n > 0").select("lang", "phrase", "f")
    words = found.filter("n > 1").select("lang", "phrase", F.col("n").alias("size"), F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"))
    side = lambda part, count: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    cuts = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(19,0)) * 2000000BD) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Phrases of 2 and 3 words inside longer ones.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    parts = words.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    best = best.join(parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left")
    best = best.filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * covered))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    first = best.withColumn("rank", place).filter(F.col("rank") <= top)
    totals = found.filter("n = 0").select("lang", F.col("f").alias("n"))
    out = first.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Each language's first phrases by score."""
    with scratch(docs.sparkSession) as keep:
        return written(ranked(keep(frequent_phrases(docs, least)), covered, top))
