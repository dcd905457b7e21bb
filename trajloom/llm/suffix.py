"""Exact removal of long repeats by suffix sorting: bucket-pointer refinement behind content-chosen q-grams.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Two equal strings choose
the same q-gram inside them (least hash, leftmost of ties), at the same offset. So:

1. Every text's chosen q-grams are counted. Only those seen twice or more can lie in a repeat.
2. For them the texts give members: the stretch of strings that choose the q-gram at one place, as bytes.
   Members alike in a text are one row.
3. Buckets of up to ``SPLIT`` places are refined in a task. Its suffixes start in buckets by their first eight
   bytes; a bucket is then refined by sorting on the bucket identifiers of later offsets, which are those
   that the last refinement gave: 8 bytes, 16, ... 256, 400. Suffixes alone in a bucket, or with such a
   one behind them, drop out. This compares bytes, not hashes: it is exact.
4. Larger buckets never meet in a task: their distinct members are counted by key, and each string of
   those is told apart by a 128-bit hash and counted, with partial sums first, eight starts at once where all
   eight repeat together.

Strings are judged on the input; matches never cross texts. A repeat inside one text counts.

``cut_texts`` can also judge passages of words: a text's words (runs without ASCII white space) become codes of ``CODE``
bytes, the same steps find the repeated strings of so many codes, and only those that start at a word count. Then a passage
counts whatever its length in bytes and white space. Codes are hashes, so two passages count as one where their words differ
only in words of equal 32-bit hashes. Both rules see the input, and what either finds goes.

Defined cases: null or empty text is kept as empty; texts under ``LENGTH`` bytes stay whole; rows that repeat a
document are documents of their own; a null doc_id takes part; very long texts are
worked through in slabs; other columns stay outside the work. Where a cut falls inside a character, ``cut_texts``
drops the broken character's remaining bytes; the digest is of the exact bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm import passages
from trajloom.llm.common import scratch, whole_text, written

LENGTH = 400
GRAM = 100
SPLIT = 256
STARTS = 8
SLAB = 1 << 18
CHUNK = 1 << 21
CODE = 4
WORDS = 51
CODE_GRAM = 10 * CODE

_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64((1 << 24) - 1)
_INSIDE = np.array([0 if k in b" \t\n\x0b\x0c\r" else 1 for k in range(256)], np.int8)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if n not in _powers:
        _powers.clear()
        _powers[n] = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (_BASE, _BACK))
    return _powers[n]


def _slab_runs(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (gram hash, gram place, first start, last start) of every run of starts that choose one gram."""
    n = len(data)
    size = 1 << max(10, int(n).bit_length())
    up, down = _power(size)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(data * up[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & _PLACE).astype(np.int64)
    begins = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= length])
    chosen = place[begins]
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (begins[1:] != begins[:-1] + 1)])
    last = np.r_[new[1:], len(begins)] - 1
    return h[chosen[new]].view(np.int64), chosen[new], begins[new], begins[last]


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """For slabs of the texts: (text numbers, hashes, first starts, last starts, gram places), all within their texts."""
    part: list[tuple[int, int, bytes]] = []  # text, offset, bytes
    held = 0

    def flush():
        sizes = np.array([len(x[2]) for x in part])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        h, place, first, last = _slab_runs(np.frombuffer(b"".join(x[2] for x in part), np.uint8).astype(np.uint64), ends, starts, length, gram)
        which = np.searchsorted(ends, first, "right")
        shift = np.array([x[1] for x in part])[which] - starts[which]
        return np.array([x[0] for x in part])[which], h, first + shift, last + shift, place + shift

    for k, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, SLAB):
            piece = text[at : at + SLAB + length - 1]
            part.append((k, at, piece))
            held += len(piece)
            if held >= SLAB:
                yield flush()
                part, held = [], 0
    if part:
        yield flush()


def refine(data: bytes, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places (ascending) whose next ``length`` bytes, within their member, start at another place too.

    Members lie end to end in data and end at ``ends``. Needs length of at least 8.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    room = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)  # bytes to the member's end
    head = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        head[: n - k] |= raw[k:].astype(np.uint64) << np.uint64(8 * (7 - k))
    bucket = np.full(n, -1, dtype=np.int64)  # pointer of each place; -1: alone, or too near the end
    live = np.flatnonzero(room >= 8)

    def assign(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = count[inverse] > 1
        bucket[places] = np.where(shared, inverse, -1)
        return places[shared]

    live = assign(live, head[live])
    depth = 8
    while depth < length and len(live):
        step = min(depth, length - depth)
        live = live[room[live] >= depth + step]
        before = bucket.copy()
        later = before[live + step]
        bucket[:] = -1
        some = later >= 0
        live = live[some]
        live = assign(live, before[live] * np.int64(n + 1) + later[some])
        depth += step
    return np.sort(live)


def _plain(text: bytes) -> bytes:
    return text


def word_codes(text: bytes) -> bytes:
    """The codes of the text's words, end to end."""
    data = np.frombuffer(text + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(_INSIDE.take(data), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(1 << max(10, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return (h >> np.uint64(32)).astype("<u4").tobytes()


def _ranges(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive places, last one included."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist()))


def _id_field(docs: DataFrame, name: str = "doc_id") -> T.StructField:
    return T.StructField(name, docs.schema["doc_id"].dataType)


def _grams(docs: DataFrame, length: int, gram: int, code=_plain) -> DataFrame:
    """(doc_id, text_hash, h, n): how many runs of each text choose a gram of hash h."""
    schema = T.StructType([_id_field(docs), T.StructField("text_hash", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [code(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            for which, h, *_ in runs(texts, length, gram):
                pairs = np.stack([which, h], axis=1)
                distinct, n = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
                rows = pa.array(distinct[:, 0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(distinct[:, 1]), pa.array(n)], schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def _members(docs: DataFrame, wanted: DataFrame, length: int, gram: int, code=_plain) -> DataFrame:
    """One row for each text and distinct member with a wanted gram: its bytes, how many starts it has, and the places where it begins."""
    names = ["doc_id", "text_hash", "h", "hot", "offset", "member", "starts", "begins", "data"]
    kinds = [None, T.LongType(), T.LongType(), T.BooleanType(), T.IntegerType(), T.BinaryType(), T.IntegerType(), T.ArrayType(T.LongType()), T.BinaryType()]
    schema = T.StructType([_id_field(docs) if k is None else T.StructField(n, k) for n, k in zip(names, kinds)])
    arrow = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        for b in batches:
            texts = [code(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            asked = [dict(zip((y["h"] for y in x), (y["hot"] for y in x))) for x in b.column(3).to_pylist()]
            for which, h, first, last, place in runs(texts, length, gram):
                found: dict[tuple, list[int]] = {}
                for k, x, p, q, a in zip(which.tolist(), h.tolist(), first.tolist(), last.tolist(), place.tolist()):
                    if x in asked[k]:
                        data = texts[k][p : q + length]
                        found.setdefault((k, x, a - p, data), []).append(p)
                keys = list(found)
                rows = pa.array([k[0] for k in keys], pa.int64())
                columns = [[k[1] for k in keys], [asked[k[0]][k[1]] for k in keys], [k[2] for k in keys], [xxhash.xxh3_128_digest(k[3]) for k in keys], [len(k[3]) - length + 1 for k in keys], list(found.values()), [k[3] for k in keys]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *(pa.array(c, t) for c, t in zip(columns, arrow))], names)

    d, w = docs.withColumn("text_hash", F.xxhash64("text")).alias("d"), wanted.alias("w")
    joined = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
    return joined.select("d.doc_id", "d.text_hash", "d.text", "w.grams").mapInArrow(run, schema)


def _refined(members: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, first, last) of repeated starts, from members of buckets of a bounded size."""
    schema = T.StructType([members.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("text_hash", "first", "last"))])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        kinds = rows.column("member").to_pylist()
        hs, begins = rows.column("h").to_pylist(), rows.column("begins").to_pylist()
        data, starts = rows.column("data").to_pylist(), rows.column("starts").to_pylist()
        seen: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(hs, kinds, rows.column("offset").to_pylist())):
            seen.setdefault(key, []).append(i)
        one = [x[0] for x in seen.values()]
        ends = np.cumsum([len(data[i]) for i in one])
        places = refine(b"".join(data[i] for i in one), ends, length)
        cut = np.searchsorted(places, np.r_[0, ends])
        out_rows, first, last = [], [], []
        for m, same in enumerate(seen.values()):
            own = places[cut[m] : cut[m + 1]] - (ends[m - 1] if m else 0)
            whole = len(same) > 1 or len(begins[same[0]]) > 1
            for a, b in [(0, starts[same[0]] - 1)] if whole else _ranges(own):
                for i in same:
                    for p in begins[i]:
                        out_rows.append(i)
                        first.append(p + a)
                        last.append(p + b)
        take = pa.array(out_rows, pa.int64())
        t = rows.select(["doc_id", "text_hash"]).take(take).combine_chunks()
        chunk = lambda n: t.column(n).combine_chunks() if t.num_rows else pa.array([], t.schema.field(n).type)
        return pa.RecordBatch.from_arrays([chunk("doc_id"), chunk("text_hash"), pa.array(first, pa.int64()), pa.array(last, pa.int64())], schema.names)

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            t = pa.Table.from_batches([b])
            held.append(t)
            size += t.nbytes
            if size >= CHUNK:  # solve whole buckets; the last may go on
                t = pa.concat_tables(held).combine_chunks()
                hs = t.column("h").to_numpy()
                cut = int(np.searchsorted(-(hs != hs[-1]).astype(np.int8), 0, "left"))
                if cut:
                    yield solve(t.slice(0, cut))
                held = [t.slice(cut)]
                size = held[0].nbytes
        if held:
            yield solve(pa.concat_tables(held).combine_chunks())

    keep = ["doc_id", "text_hash", "h", "offset", "member", "starts", "begins", "data"]
    return members.select(keep).repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def _counted(members: DataFrame, length: int, written) -> DataFrame:
    """The same for buckets of any size, by counts alone: first of blocks of ``STARTS`` starts, then of the single starts of blocks that stand once."""
    key = ["h", "offset", "member"]
    kinds = written(members.groupBy(*key).agg(F.sum(F.size("begins")).alias("n"), F.first("starts").alias("starts"), F.first("data").alias("data")))
    schema = "h bigint, offset int, member binary, at int, size int, block binary, strings array<binary>"

    def run(batches):
        for b in batches:
            h, offset, member, data = (b.column(k).to_pylist() for k in range(4))
            for i in range(len(h)):
                n = len(data[i]) - length + 1
                # Blocks are cut by the distance to the gram, which equal strings share.
                firsts = [0] + [k for k in range(1, n) if (offset[i] - k + 1) % STARTS == 0]
                ends = [*firsts[1:], n]
                blocks = [xxhash.xxh3_128_digest(data[i][a : e - 1 + length]) for a, e in zip(firsts, ends)]
                strings = [[xxhash.xxh3_128_digest(data[i][k : k + length]) for k in range(a, e)] for a, e in zip(firsts, ends)]
                m = len(firsts)
                yield pa.RecordBatch.from_arrays([pa.array([h[i]] * m, pa.int64()), pa.array([offset[i]] * m, pa.int32()), pa.array([member[i]] * m, pa.binary()), pa.array(firsts, pa.int32()), pa.array([e - a for a, e in zip(firsts, ends)], pa.int32()), pa.array(blocks, pa.binary()), pa.array(strings, pa.list_(pa.binary()))], ["h", "offset", "member", "at", "size", "block", "strings"])

    blocks = written(kinds.select("h", "offset", "member", "data").mapInArrow(run, schema))
    often = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.first("strings").alias("strings")).filter(F.col("n") > 1)
    often = written(often.select("block", "strings"))
    again = blocks.join(often.select("block"), "block", "left_semi").select(*key, "at", (F.col("at") + F.col("size") - 1).alias("to"))
    single = written(blocks.join(often.select("block"), "block", "left_anti").select(*key, "at", F.posexplode("strings").alias("k", "string")))
    # A string of a block that stands once may still stand in another block, whole or not.
    twice = single.select("string").unionAll(often.select(F.explode("strings").alias("string"))).groupBy("string").count().filter(F.col("count") > 1).select("string")
    singles = single.join(twice, "string", "left_semi").select(*key, (F.col("at") + F.col("k")).alias("at"), (F.col("at") + F.col("k")).alias("to"))
    whole = kinds.filter(F.col("n") > 1).select(*key, F.lit(0).alias("at"), (F.col("starts") - 1).alias("to"))
    spans = whole.unionByName(again).unionByName(singles).groupBy(*key).agg(F.collect_list(F.struct("at", "to")).alias("spans"))
    found = members.select("doc_id", "text_hash", "begins", *key).join(spans, key)
    pairs = found.select("doc_id", "text_hash", F.explode("begins").alias("p"), "spans").select("doc_id", "text_hash", "p", F.explode(_joined_spans(F.col("spans"))).alias("s"))
    return pairs.select("doc_id", "text_hash", (F.col("p") + F.col("s.at")).alias("first"), (F.col("p") + F.col("s.to")).alias("last"))


def _joined_spans(spans):
    """Spans of starts, sorted; those that meet become one."""
    empty = F.array().cast("array<struct<at:int,to:int>>")
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, x):
        meets = (F.size(acc) > 0) & (x["at"] <= F.try_element_at(acc, F.lit(-1))["to"] + 1)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["at"].alias("at"), F.greatest(last(acc)["to"], x["to"]).alias("to"))))
        return F.when(meets, grown).otherwise(F.concat(acc, F.array(F.struct(x["at"].alias("at"), x["to"].alias("to")))))

    return F.aggregate(F.sort_array(spans), empty, add)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT, *, code=_plain) -> DataFrame:
    """(doc_id, text_hash, ranges): of every text with repeats, the ranges (first, last) of repeated starts in its code, sorted. docs: doc_id, text."""
    with scratch(docs.sparkSession) as keep:
        return written(_spans(docs, length, gram, split, code, keep))


def _spans(docs: DataFrame, length: int, gram: int, split: int, code, written) -> DataFrame:
    grams = written(_grams(docs, length, gram, code))
    often = grams.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("h", (F.col("n") > split).alias("hot"))
    wanted = grams.select("doc_id", "text_hash", "h").join(often, "h").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("h", "hot")).alias("grams"))
    members = written(_members(docs, wanted, length, gram, code))
    found = _refined(members.filter(~F.col("hot")), length).unionByName(_counted(members.filter("hot"), length, written))
    ranges = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    return ranges


def _merged(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Spans of the bytes covered by strings that start in the sorted ranges."""
    out: list[list[int]] = []
    for r in ranges:
        first, end = r["first"], r["last"] + length
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    d, r = docs.alias("d"), ranges.alias("r")
    return d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.__x_hash") == F.col("r.text_hash")), "left").select("d.*", F.col("r.ranges").alias("__x_ranges"))


def _kept(data: bytes, ranges, length: int) -> tuple[bytes, list[tuple[int, int]]]:
    if not ranges:
        return data, []
    spans = _merged(list(ranges), length)
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out), spans


def removal_report(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; and n_passage_bytes, the bytes in passages of so many words that start twice or more (see ``passages``)."""
    docs = whole_text(docs, "doc_id")
    runs, repeated = passages.tables(docs, words)
    found = repeated_spans(docs, length)
    both = _with_ranges(docs.withColumn("__x_hash", F.xxhash64("text")), found.select("doc_id", "text_hash", "ranges"))
    counts = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
    schema = T.StructType([_id_field(docs), *(T.StructField(n, T.StringType() if n == "kept_sha256" else T.LongType()) for n in counts)])

    def run(batches):
        marks = np.frombuffer(runs.value, np.uint8), np.frombuffer(repeated.value, np.uint8)
        for b in batches:
            out = []
            for data, own, n in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), passages.passage_bytes(b.column(1), words, *marks).tolist()):
                kept, spans = _kept(data, own, length)
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), n))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.string() if k == 3 else pa.int64()) for k in range(5))], schema.names)

    return both.select("doc_id", "text", "__x_ranges").mapInArrow(run, schema)


def _ranges_of_both(docs: DataFrame, length: int, words: int | None) -> DataFrame:
    """(doc_id, text_hash, ranges (bytes, words)) of the texts with repeats by either rule."""
    found = repeated_spans(docs, length).withColumn("unit", F.lit("bytes"))
    if words:
        found = found.unionByName(repeated_spans(docs, words * CODE, CODE_GRAM, code=word_codes).withColumn("unit", F.lit("words")))
    of = lambda unit: F.first(F.when(F.col("unit") == unit, F.col("ranges")), ignorenulls=True).alias(unit)
    return found.groupBy("doc_id", "text_hash").agg(of("bytes"), of("words")).select("doc_id", "text_hash", F.struct("bytes", "words").alias("ranges"))


def _word_spans(data: bytes, ranges, words: int) -> list[tuple[int, int]]:
    """Byte spans of the passages of so many words that start, in the text's codes, in the ranges."""
    starts = [(-(-r["first"] // CODE), r["last"] // CODE) for r in ranges]
    starts = [x for x in starts if x[0] <= x[1]]  # the others start inside a code alone
    if not starts:
        return []
    at = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", data)]
    return [(at[a][0], at[b + words - 1][1]) for a, b in starts]


def cut_texts(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs without the repeats of length bytes, and of so many words, in text, and n_chars (where there is one) counted anew; a null text stays null."""
    def kept(text: str, by_bytes, by_words) -> str:
        data = text.encode("utf-8")
        spans = _merged(list(by_bytes), length) if by_bytes is not None else []
        if by_words is not None:
            spans = sorted(spans + _word_spans(data, by_words, words))
        at, out = 0, []
        for a, b in spans:
            out.append(data[at : max(at, a)])
            at = max(at, b)
        out.append(data[at:])
        return b"".join(out).decode("utf-8", "ignore")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, by_bytes: pd.Series, by_words: pd.Series) -> pd.Series:
        return pd.Series([kept(*x) for x in zip(texts, by_bytes, by_words)], dtype=object)

    plain = whole_text(docs, "doc_id")
    marked = docs.withColumn("__x_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    both = _with_ranges(marked, _ranges_of_both(plain, length, words))
    text = F.when(F.col("__x_ranges").isNull(), F.col("text")).otherwise(cut(F.coalesce(F.col("text"), F.lit("")), "__x_ranges.bytes", "__x_ranges.words"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
