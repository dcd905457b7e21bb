"""Best-fit packing of documents into sequences, by exact complements.

Every document's ids (with an end id) are cut into pieces of at most ``size`` ids; only the counts of
pieces by length, ``size`` numbers at most, decide the packing. Longest first, a length's gap is filled
exactly: by a single length, by a pair, by a triple of lengths, as often as the counts allow. What has no
exact complement goes best-fit, longest first, into the smallest gap that holds it. Sequences of one
pattern are numbered in a row, and the k-th piece of a length takes the k-th place of that length, so a
piece finds its place by its rank alone. Ranks come from counts by (length, salt): one length may hold
any share of all pieces without meeting in one task.

Defined cases: null or empty text is a document of the end id alone; repeated rows are packed each;
an empty table gives no rows; pieces alike in every column take the places of their length in any order.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.common import whole_text, written


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=2)
def _ranks(path: str, pattern: str):
    """The same vocabulary for the faster library."""
    import tiktoken

    from trajloom.llm.bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


class Ids:
    """A text's ids by the tokenizer file. Texts of characters up to U+00FF, on which both libraries split alike, go through the rank file."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        self.path, self.ranks_path, self.pattern = path, ranks_path, pattern

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks_path:
            try:
                text.encode("latin-1")
                return _ranks(self.ranks_path, self.pattern).encode_to_numpy(text)
            except UnicodeEncodeError:
                pass
        return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def default_ids() -> Ids:
    import public_tokenizers as p

    return Ids(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def cut_pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, ids: Ids | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; of a long one the first may be shorter than size."""
    ids = ids or default_ids()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))])

    def run(batches):
        for b in batches:
            rows, out = [], ([], [], [], [])
            for k, text in enumerate(b.column(1)):
                own = np.append(ids(text.as_py()), end_id).astype("<u4")
                at, part = 0, 0
                for stop in range(len(own) % size or size, len(own) + 1, size):
                    rows.append(k)
                    for column, value in zip(out, (part, at, stop - at, zlib.crc32(own[at:stop].tobytes()))):
                        column.append(value)
                    at, part = stop, part + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])], schema.names)

    return whole_text(docs, "doc_id").mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of the sequences that hold ``counts`` pieces of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    done: list[tuple[int, tuple[int, ...]]] = []
    open_: list[tuple[int, tuple[int, ...]]] = []  # lengths without an exact complement

    def take(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= times * k
        done.append((times, lengths))

    def complement(length: int) -> tuple[int, ...] | None:
        gap = size - length
        if gap == 0:
            return ()
        left[length] -= 1
        try:
            if left[gap]:
                return (gap,)
            some = np.flatnonzero(left[: gap])  # lengths that are there; left[0] is 0
            some = some[::-1]
            other = gap - some
            ok = (left[other] > 0) & (other <= some) & ((other != some) | (left[some] > 1))
            if ok.any():
                x = int(some[np.argmax(ok)])
                return (x, gap - x)
            for x in some[some * 3 >= gap]:  # the longest of a triple
                rest = gap - int(x)
                second = some[(some <= x) & (some < rest)]
                third = rest - second
                ok = (third >= 1) & (third <= second)
                for y in second[ok & (left[np.clip(third, 0, size)] > 0)]:
                    z = rest - int(y)
                    if all(left[v] >= k for v, k in Counter((int(x), int(y), z)).items()):
                        return int(x), int(y), z
            return None
        finally:
            left[length] += 1

    for length in range(size, 0, -1):
        while left[length]:
            more = complement(length)
            if more is None:
                open_.append((int(left[length]), (length,)))
                left[length] = 0
            else:
                take((length, *more))
    gaps: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n, (length,) in open_:  # longest first
        while n:
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                each = size // length
                for times, k in ((n // each, each), (1, n % each)):
                    if times and k:
                        gaps.setdefault(size - k * length, []).append((times, (length,) * k))
                break
            times, lengths = gaps[fit].pop()
            if not gaps[fit]:
                del gaps[fit]
            k = min(times, n)
            if times > k:
                gaps.setdefault(fit, []).append((times - k, lengths))
            gaps.setdefault(fit - length, []).append((k, (*lengths, length)))
            n -= k
    return [(t, x) for t, x in done if t] + [p for ps in gaps.values() for p in ps]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of places, the run's first sequence and its offset; the k-th piece of a run lies in the k-th sequence from there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: Counter = Counter()
    base = 0
    for times, lengths in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((given[x], base, offset))
            given[x] += times
            offset += x
        base += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with rank, from 0 within each length: a salt's share of a length is ordered in one task, and counts by salt say where it begins.

    With the root of all pieces as the number of salts, neither a salt's share of a length nor a length's salts outgrow a task.
    """
    salts = max(1, math.isqrt(total))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("at", F.row_number().over(own) - 1).join(begins, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at")).drop("salt", "at", "before")


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, ids: Ids | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(cut_pieces(docs, size, end_id, ids))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # size rows at most
    runs = places(plan(counts, size))
    names = [*pieces.columns, "sequence_id", "offset"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                first, base, at = runs[int(x)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = base[k] + rank[mine] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names[:-2]), pa.array(sequence), pa.array(offset)], names)

    return ranked(pieces, sum(counts.values())).mapInArrow(run, schema)
