"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: words are runs without ASCII white space, lower-cased in A-Z; 3-word shingles, repeats
included, are hashed by XXH64 (seed 42); a bit is 1 if set in over half the hashes.

Links: two fingerprints link at ``radius`` or fewer differing bits. Of four blocks of 16 bits, two
differing bits leave two blocks equal, so fingerprints meet in six tables keyed by two blocks (32 bits).
A bucket of one table is compared bit-sliced: bit planes lie vertically (64 fingerprints a word), a query's
plane mismatches are added to all distances by a saturating carry-save counter, and a block of planes
is left as soon as all its distances exceed the radius. A bucket of more than ``SPLIT`` fingerprints is dealt
again by two of four blocks of 8 of its other 32 bits; then 48 bits are equal and at most 65,536 distinct
fingerprints are left, whatever the input. Only distinct fingerprints are compared, and a bucket
gives a spanning set of its links, never all pairs: components lose nothing by that.

Components: smallest doc_id reachable, by repeated smallest-neighbour and pointer steps on written tables.

Defined cases: null or empty text, or white space alone, has fingerprint zero, linked like any other; one or two words are
one shingle; a null doc_id takes part and is the smallest only of a component of null ids;
repeated rows share a component; an empty table gives no rows; other columns stay outside the work.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.common import whole_text, written

SPLIT = 2048
SLAB = 65_536
SALTS = 64


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    words = text.encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    n = len(words) - shingle + 1
    stops = (ends - 1).tolist()[shingle - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLAB):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + SLAB], stops[at : at + SLAB])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            own = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64())], schema.names)

    return whole_text(docs, "doc_id").mapInArrow(run, schema)


def bit_sliced_links(fps: np.ndarray, radius: int = 2, block: int = 64) -> list[tuple[int, int]]:
    """Links (indices) that span the components of distinct fingerprints within the radius.

    Planes in blocks of ``block`` words of 64 fingerprints; radius at most 2: two counter planes hold 0, 1, 2 and 3 or more.
    """
    if radius > 2:
        raise ValueError("two counter planes tell no distances above 2 apart")
    n = len(fps)
    words = -(-n // 64)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    bits = np.concatenate([bits, np.zeros((words * 64 - n, 64), np.uint8)])
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")  # 64 planes of words
    varied = [p for p in range(64) if bits[:n, p].any() and not bits[:n, p].all()]
    real = np.zeros(words, dtype=np.uint64)
    real[:] = np.uint64(0xFFFFFFFFFFFFFFFF)
    if n % 64:
        real[-1] = np.uint64((1 << (n % 64)) - 1)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for q in range(n - 1):
        for lo in range(q // 64 // block * block, words, block):
            part = planes[:, lo : lo + block]
            one, two, full = np.zeros_like(part[0]), np.zeros_like(part[0]), ~real[lo : lo + block]
            for k, p in enumerate(varied):
                miss = ~part[p] if bits[q, p] else part[p]
                # Carry-save: a miss moves 0 to 1, 1 to 2, 2 to full.
                carry = one & miss
                one = one ^ miss
                over = two & carry
                two = two ^ carry
                full = full | over | (one & two)
                if k & 7 == 7 and full.all() and bool((full == np.uint64(0xFFFFFFFFFFFFFFFF)).all()):
                    break
            close = ~full
            if radius < 2:
                close &= ~two
            if radius < 1:
                close &= ~one
            if not close.any():
                continue
            near = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little")) + lo * 64
            for j in near[near > q].tolist():
                a, b = find(q), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((q, j))
    return links


def _tables(fp, bits: int, blocks: int, shift: int = 0):
    """Structs (table, key) for each two of ``blocks`` blocks of ``bits`` bits above ``shift``."""
    part = [F.shiftrightunsigned(fp, shift + bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(blocks)]
    return [(t, a, b, part[a] * (1 << bits) + part[b]) for t, (a, b) in enumerate(combinations(range(blocks), 2))]


def _in_buckets(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) fingerprints linked inside the buckets of keyed (bucket, fp); each bucket is of a bounded size."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        kept_key, kept = None, []  # of the bucket that may go on in the next batch
        for b in batches:
            buckets, fps = b.column(0).to_pylist(), b.column(1).to_numpy()
            out, at = [], 0
            ends = [k for k in range(1, len(buckets)) if buckets[k] != buckets[k - 1]] + [len(buckets)]
            for end in ends:
                if buckets[at] != kept_key:
                    out += _bucket(kept, radius)
                    kept_key, kept = buckets[at], []
                kept.append(fps[at:end])
                at = end
            yield _pairs(out, schema)
        yield _pairs(_bucket(kept, radius), schema)

    return keyed.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInArrow(run, schema)


def _bucket(parts: list[np.ndarray], radius: int) -> list[np.ndarray]:
    fps = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    if len(fps) < 2:
        return []
    found = bit_sliced_links(fps.view(np.uint64), radius)
    return [fps[np.array(found, dtype=np.int64)]] if found else []


def _pairs(found: list[np.ndarray], schema) -> pa.RecordBatch:
    ab = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], schema.names)


def links(fps: DataFrame, radius: int = 2, split: int = SPLIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span all components."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), k.alias("key")) for t, _, _, k in _tables(F.col("fp"), 16, 4)])
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", (F.col("x.t") * (1 << 32) + F.col("x.key")).alias("bucket"))
    sizes = keyed.groupBy("bucket").count().filter(F.col("count") > 1)
    sized = keyed.join(sizes, "bucket")
    small = sized.filter(F.col("count") <= split).select("fp", "bucket")
    # The other 32 bits of a table (t: blocks a and b) are its two blocks left, dealt anew as four of 8 bits.
    finer = []
    for t, (a, b) in enumerate(combinations(range(4), 2)):
        c, d = (k for k in range(4) if k not in (a, b))
        rest = [F.shiftrightunsigned("fp", 16 * k + 8 * h).bitwiseAND(F.lit(255)) for k in (c, d) for h in (0, 1)]
        for u, (e, f) in enumerate(combinations(range(4), 2)):
            finer.append((t, u, rest[e] * 256 + rest[f]))
    choice = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(u).alias("u"), k.alias("key")) for t, u, k in finer])
    large = sized.filter(F.col("count") > split).withColumn("t0", F.shiftrightunsigned("bucket", 32))
    large = large.select("fp", "bucket", "t0", F.explode(choice).alias("x")).filter(F.col("x.t") == F.col("t0"))
    large = large.select("fp", F.concat_ws(":", "bucket", "x.u", "x.key").alias("bucket"))
    return _in_buckets(small.select("fp", F.col("bucket").cast("string")).unionByName(large), radius)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, top, label): a name of the component and the smallest label that each node reaches. nodes: fp, label (a number); edges: a, b.

    A round takes the smallest label of all neighbours, then that of the node the label came from
    (pointer step), so distances halve; it ends when nothing changes.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.isEmpty():
        return nodes.select("fp", F.col("fp").alias("top"), "label")
    # Work on fingerprints as names: top is the smallest fingerprint known to be reachable.
    top = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("top")).select(F.col("a").alias("fp"), "top"))
    for _ in range(rounds):
        seen = both.join(top.withColumnsRenamed({"fp": "b", "top": "other"}), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = top.join(seen, top["fp"] == seen["a"]).select("fp", F.least("top", "other").alias("near"), "top")
        jump = top.select(F.col("fp").alias("near"), F.col("top").alias("far"))
        # Hook: where a node found a smaller top, its old top learns of it too.
        new = step.join(jump, "near").select("fp", F.least("near", "far").alias("new"), "top")
        hooks = new.filter(F.col("new") < F.col("top")).groupBy(F.col("top").alias("fp")).agg(F.min("new").alias("hook"))
        new = written(new.join(hooks, "fp", "left").select("fp", F.least("new", F.coalesce("hook", "new")).alias("top"), F.col("top").alias("old")))
        changed = not new.filter(F.col("top") != F.col("old")).isEmpty()
        top = new.select("fp", "top")
        if not changed:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    linked = nodes.join(top, "fp")
    best = linked.groupBy("top").agg(F.min("label").alias("least"))
    found = linked.select("fp", "top").join(best, "top").withColumnRenamed("fp", "f")
    alone = F.col("f").isNull()
    return nodes.join(found, F.col("fp") == F.col("f"), "left").select("fp", F.when(alone, F.col("fp")).otherwise(F.col("top")).alias("top"), F.when(alone, F.col("label")).otherwise(F.col("least")).alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = written(with_fingerprints(docs.select("doc_id", "text")))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("label")))
    named = components(nodes, links(nodes.select("fp"), radius)).select("fp", "label")
    # Copies of one text have one fingerprint: rows and their names are dealt by a salt too, a name in each of its salts.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(named.select("fp", "label", salts.alias("salt")), ["fp", "salt"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("label").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """Of each component the document with the smallest doc_id (then fingerprint; one row of repeats), with the columns of docs."""
    prints = written(with_fingerprints(docs.select("doc_id", "text")))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("own")))
    named = components(nodes.withColumnRenamed("own", "label"), links(nodes.select("fp"), radius))
    own = named.join(nodes, "fp").filter(F.col("own").eqNullSafe(F.col("label")))
    first = own.groupBy("top").agg(F.min("fp").alias("fp"), F.first("label").alias("i"))
    firsts = first.select(F.col("i").alias("__s_id"), "fp")
    some = docs.join(firsts.select("__s_id").distinct(), docs["doc_id"].eqNullSafe(F.col("__s_id")), "left_semi")

    @F.pandas_udf(T.LongType())
    def fp_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "") for t in texts], dtype=np.uint64).view(np.int64))

    marked = some.withColumn("__s_fp", fp_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = marked.join(firsts, marked["doc_id"].eqNullSafe(firsts["__s_id"]) & (F.col("__s_fp") == firsts["fp"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__s_fp"]).select(*docs.columns)
