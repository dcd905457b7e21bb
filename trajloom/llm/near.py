"""Near-duplicates by SimHash of five-word shingles: a bit-sliced comparison proposes pairs, the exact Jaccard similarity decides.

Words are runs without ASCII white space, lower-cased in A-Z; a text's set holds the 64-bit hashes of its runs of
``WORDS`` words (of all its words, where it has fewer). Two texts link at a Jaccard similarity of ``SIMILARITY`` or more.

Fingerprints have 256 bits: each shingle's hash is mixed to 256 bits, and a bit is set if it is in over half of them (in just half:
if the smallest hash has it). Sets of similarity s and equal sizes differ in a bit with probability acos(2s/(1+s))/pi, 0.1515 at 0.8.

Candidates: fingerprints meet in tables keyed by some of their bits, as many bits as leave about ``BUCKET`` in a bucket, and as many tables
as miss a pair at 0.8 with a probability of 1 in 10 million, less above (``tables``; sets of four against five shingles differ in more bits: some
1 in 100,000). A bucket is compared bit-sliced: bit planes lie vertically (64 fingerprints a word), and carry-save adders count
the mismatches of ``ASKED`` fingerprints with the others at once, over ``PLANES`` planes; what is left within ``NEAR`` is a candidate at ``RADIUS`` bits of 256
or fewer. Texts alike in every byte are one node before that.
Of up to ``SPLIT`` nodes that candidates link in a bucket, every candidate pair is checked on the two sets. A larger group is searched
in a task on its sets, breadth first: a node is compared with the nodes not yet reached alone, so a group of copies costs
a few passes, and all components of the group come out, never all pairs.

Components are those of ``simhash.components``; of each the smallest doc_id stays.

Defined cases: null or empty text, or white space alone, has the empty set, similar to an empty set alone; a null doc_id
takes part and is the smallest only of a component of null ids; other columns stay outside the work.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.common import scratch, whole_text, written
from trajloom.llm.simhash import components

WORDS = 5
SIMILARITY = (4, 5)  # as a fraction, so that the check is of whole numbers
SPLIT = 32
BUCKET = 1024
MISSED = 1e-7
PER_BIT = 0.1515  # how often a bit differs at the similarity
RADIUS = 80
PLANES, NEAR = 96, 36
PASS = 64  # tables that are dealt at a time
ASKED = 256  # fingerprints that are compared with the others at a time
SLAB = 64  # words of a plane that they are compared with at a time
PRINT = ["p0", "p1", "p2", "p3"]

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    line, at, starts, stops = b" ".join(w), 0, [], []
    for x in w:
        starts.append(at)
        at += len(x)
        stops.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, stops[min(words, len(w)) - 1 :])], dtype=np.uint64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """256 bits of a set of hashes, ascending, as four words."""
    if not len(own):
        return np.zeros(4, dtype=np.uint64)
    mixed = np.empty((len(own), 4), dtype=np.uint64)
    mixed[:, 0] = own
    for k in (1, 2, 3):
        x = own + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed[:, k] = x ^ (x >> np.uint64(31))
    ones = np.zeros(256, dtype=np.int64)
    for at in range(0, len(own), 255):  # a byte counts to 255, eight bytes are added at once
        bits = np.unpackbits(mixed[at : at + 255].view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        ones += np.add.reduce(bits, axis=0).view(np.uint8)
    first = np.unpackbits(mixed[0].view(np.uint8), bitorder="little")
    return np.packbits(2 * ones + first > len(own), bitorder="little").view(np.uint64)


@lru_cache(maxsize=64)
def tables(bits: int) -> int:
    """How many tables keyed by so many bits miss a pair at the similarity with probability ``MISSED``."""
    differ = np.arange(257)
    share = np.array([float(comb(256, k)) * PER_BIT**k * (1 - PER_BIT) ** (256 - k) for k in range(257)])
    meet = np.prod([np.maximum(256 - differ - k, 0) / (256 - k) for k in range(bits)], axis=0) if bits else np.ones(257)
    n = 1
    while float((share * np.where(differ > RADIUS, 1.0, (1 - meet) ** n)).sum()) > MISSED:
        n += 1
    return n


def key_bits(nodes: int, bucket: int = BUCKET) -> int:
    """Bits of a key that leave about ``bucket`` of the nodes in a bucket."""
    return min(max(-(-nodes // bucket) - 1, 0).bit_length(), 24)


def _planes(words: np.ndarray) -> np.ndarray:
    """Bit planes (PLANES, words of 64) of fingerprints (n, 4)."""
    bits = np.unpackbits(np.ascontiguousarray(words[:, : -(-PLANES // 64)]).view(np.uint8), axis=1, bitorder="little")[:, :PLANES]
    bits = np.concatenate([bits, np.zeros((-len(words) % 64, PLANES), np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _within(planes: np.ndarray, asked: np.ndarray, limit: int) -> np.ndarray:
    """(asked, words): which fingerprints of the planes (p, words) differ from each asked one in ``limit`` planes or fewer. asked: (p, asked) of 0 or all ones."""
    levels: list[list[np.ndarray]] = [[] for _ in range(len(planes).bit_length() + 1)]
    for plane, own in zip(planes, asked):
        levels[0].append(plane[None, :] ^ own[:, None])
        k = 0
        while len(levels[k]) == 3:  # a carry-save adder: three of a weight become one, and a carry of twice the weight
            a, b, c = levels[k]
            half = a ^ b
            a &= b
            np.bitwise_and(half, c, out=b)
            c ^= half
            a |= b
            levels[k] = [c]
            k += 1
            levels[k].append(a)
    for k, level in enumerate(levels):
        while len(level) > 1:
            a, b = level.pop(), level.pop()
            level.insert(0, a ^ b)
            levels[k + 1].append(a & b)
    less, same = np.zeros((asked.shape[1], planes.shape[1]), np.uint64), np.full((asked.shape[1], planes.shape[1]), _ALL)
    for k in range(len(levels) - 1, -1, -1):
        bit = levels[k][0] if levels[k] else np.zeros_like(less)
        if limit >> k & 1:
            less |= same & ~bit
            same &= bit
        else:
            same &= ~bit
    return less | same


def _hits(prints: np.ndarray, asked: np.ndarray, others: np.ndarray, planes: np.ndarray):
    """(i, j) arrays of some asked (indices) and others (indices, whose planes are given) within the radius."""
    own = np.unpackbits(np.ascontiguousarray(prints[asked, : -(-PLANES // 64)]).view(np.uint8), axis=1, bitorder="little")[:, :PLANES].T
    own = own.astype(np.uint64) * _ALL
    for at in range(0, planes.shape[1], SLAB):
        close = _within(planes[:, at : at + SLAB], own, NEAR)
        q, t = np.divmod(np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little").view(bool)), 64 * close.shape[1])
        t += 64 * at
        real = t < len(others)
        i, j = asked[q[real]], others[t[real]]
        i, j = i[i != j], j[i != j]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= RADIUS
        yield i[near], j[near]


def near_groups(prints: np.ndarray) -> np.ndarray:
    """A label for each fingerprint (n, 4): equal where candidate pairs link them. A large group is not compared within itself once it is known."""
    labels = np.arange(len(prints))

    def join(asked, others, planes):
        found = 0
        for i, j in _hits(prints, asked, others, planes):
            found += len(i)
            cuts = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
            for at, end in zip(cuts, [*cuts[1:], len(i)]):
                some = np.unique(np.r_[labels[i[at]], labels[j[at:end]]])
                if len(some) > 1:
                    labels[np.isin(labels, some)] = some[0]
        return found

    todo = np.arange(len(prints))
    planes = _planes(prints)
    while len(todo) > 1:
        found = join(todo[:ASKED], todo, planes)
        todo, planes = todo[ASKED:], planes[:, ASKED // 64 :]
        if found > 4 * len(todo):
            names, counts = np.unique(labels[todo], return_counts=True)
            if len(counts) and counts.max() >= 256:
                big = labels[todo] == names[counts.argmax()]
                known, todo = todo[big], todo[~big]
                planes = _planes(prints[todo])
                for at in range(0, len(known) if len(todo) else 0, ASKED):
                    join(known[at : at + ASKED], todo, planes)
    return labels


def _with_prints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (hash of the text), p0 to p3 (the fingerprint)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType()), *(T.StructField(p, T.LongType()) for p in PRINT)])

    def run(batches):
        for b in batches:
            own = np.array([fingerprint(shingles(t.as_py())) for t in b.column(2)], dtype=np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(own[:, k])) for k in range(4))], schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(run, schema)


def _keyed(nodes: DataFrame, bits: int, some: range) -> DataFrame:
    """bucket, fp, p0 to p3 of nodes in these tables."""
    chosen = np.array([np.random.default_rng([7, t]).permutation(256)[:bits] for t in some], dtype=np.int64).reshape(len(some), bits)
    schema = "fp bigint, p0 bigint, p1 bigint, p2 bigint, p3 bigint, buckets array<bigint>"

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                own = np.stack([b.column(k + 1).to_numpy() for k in range(4)], axis=1)
                is_set = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")
                keys = np.zeros((len(own), len(some)), np.int64) + np.arange(some.start, some.stop)
                for k in range(bits):
                    keys = keys * 2 + is_set[:, chosen[:, k]]
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(some))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], [*b.schema.names, "buckets"])

    return nodes.select("fp", *PRINT).mapInArrow(run, schema).select(F.explode("buckets").alias("bucket"), "fp", *PRINT)


def _candidates(keyed: DataFrame, split: int) -> DataFrame:
    """Of keyed (bucket, fp, p0 to p3): pairs (a, b) of small groups with a null bucket, members (bucket, a) of large ones with a null b."""
    schema = "bucket bigint, a bigint, b bigint"

    def bucket(key, parts):
        rows = np.concatenate(parts)
        if len(rows) < 2:
            return
        rows = rows[np.argsort(rows[:, 0])]
        fps, prints = rows[:, 0], np.ascontiguousarray(rows[:, 1:]).view(np.uint64)
        labels = near_groups(prints)
        order = np.argsort(labels, kind="stable")
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        ends = np.r_[cuts, len(order)]
        begins = np.r_[0, cuts]
        for at, end in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
            own = order[at:end]
            if len(own) <= split:
                i, j = np.triu_indices(len(own), 1)
                i, j = own[i], own[j]
                near = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64) <= RADIUS
                yield np.zeros(int(near.sum()), np.int64), fps[i[near]], fps[j[near]], True
            else:
                name = np.int64(np.uint64(xxhash.xxh64_intdigest(np.array([key, fps[own[0]]]).tobytes())).astype(np.int64))
                yield np.full(len(own), name), fps[own], fps[own], False

    def batch(found):
        if not found:
            return
        small = np.concatenate([np.full(len(x[0]), x[3]) for x in found])
        columns = [np.concatenate([x[k] for x in found]) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], mask=small), pa.array(columns[1]), pa.array(columns[2], mask=~small)], ["bucket", "a", "b"])

    def run(batches):
        kept_key, kept = None, []  # of the bucket that may go on in the next batch
        for b in batches:
            keys = b.column(0).to_numpy()
            if not len(keys):
                continue
            rows = np.stack([b.column(k + 1).to_numpy() for k in range(5)], axis=1)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for at, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(keys)].tolist()):
                if kept and keys[at] == kept_key:
                    kept.append(rows[at:end])
                    continue
                if kept:
                    yield from batch(list(bucket(kept_key, kept)))
                kept_key, kept = keys[at], [rows[at:end]]
        if kept:
            yield from batch(list(bucket(kept_key, kept)))

    return keyed.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp", *PRINT).mapInArrow(run, schema)


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (indices) that span the components of sets at the similarity, by breadth-first search."""
    up, down = SIMILARITY
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    flag = np.zeros(int(flat.max(initial=-1)) + 1, dtype=np.int64)
    left = np.arange(len(sets))  # not yet reached
    left_flat = flat
    links = []

    def take(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([flat[ends[i] - sizes[i] : ends[i]] for i in rows.tolist()]) if len(rows) else flat[:0]

    while len(left):
        queue, left = [int(left[0])], left[1:]
        left_flat = left_flat[sizes[queue[0]] :]
        while queue and len(left):
            q = queue.pop()
            own = flat[ends[q] - sizes[q] : ends[q]]
            flag[own] = 1
            total = np.r_[0, np.cumsum(flag[left_flat])]
            flag[own] = 0
            stop = np.cumsum(sizes[left])
            both = total[stop] - total[stop - sizes[left]]
            # both / (all - both) >= up / down
            near = both * (up + down) >= up * (sizes[q] + sizes[left])
            if near.any():
                found = left[near].tolist()
                links += [(q, x) for x in found]
                queue += found
                left = left[~near]
                left_flat = take(left)
    return links


def _searched(members: DataFrame) -> DataFrame:
    """(a, b) links of the large groups; members: bucket (the group), fp, own (the set)."""
    def run(batches):
        key, fps, sets = None, [], []

        def solve():
            found = spanning_links(sets) if len(sets) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([fps[i] for i, _ in found], pa.int64()), pa.array([fps[j] for _, j in found], pa.int64())], ["a", "b"])

        for b in batches:
            for bucket, fp, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if bucket != key:
                    yield from solve()
                    key, fps, sets = bucket, [], []
                fps.append(fp)
                sets.append(own.values.to_numpy())
        yield from solve()

    return members.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp", "own").mapInArrow(run, "a bigint, b bigint")


def links(texts: DataFrame, nodes: DataFrame, split: int = SPLIT, bucket: int = BUCKET, keep=written) -> DataFrame:
    """Links (a, b) that span the components. texts: doc_id, fp, text; nodes: fp, label (a doc_id), p0 to p3."""
    up, down = SIMILARITY
    bits = key_bits(nodes.count(), bucket)
    n = tables(bits)
    # Some tables at a time, so that their shuffle files never lie on disk all at once.
    parts = [keep(_candidates(_keyed(nodes, bits, range(at, min(at + PASS, n))), split)) for at in range(0, n, PASS)]
    found = reduce(DataFrame.unionByName, parts)
    pairs = keep(found.filter(F.col("bucket").isNull()).select("a", "b").distinct())
    large = found.filter(F.col("bucket").isNotNull()).select("bucket", F.col("a").alias("fp"))
    asked = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).unionAll(large.select("fp")).distinct()

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "own"])

    # One row for each text, the copy that gave the node its label: copies never meet.
    wanted = asked.join(nodes.select("fp", "label"), "fp")
    some = texts.join(wanted, (texts["fp"] == wanted["fp"]) & texts["doc_id"].eqNullSafe(wanted["label"]), "left_semi").dropDuplicates(["fp"])
    sets = keep(some.select("fp", "text").mapInArrow(run, "fp bigint, own array<bigint>"))
    a, b = sets.withColumnsRenamed({"fp": "a", "own": "own_a"}), sets.withColumnsRenamed({"fp": "b", "own": "own_b"})
    both = F.size(F.array_intersect("own_a", "own_b"))
    similar = both * (up + down) >= up * (F.size("own_a") + F.size("own_b"))
    checked = pairs.join(a, "a").join(b, "b").filter(similar).select("a", "b")
    return written(checked.unionByName(_searched(large.join(sets, "fp"))))


def keep_one(docs: DataFrame, split: int = SPLIT, bucket: int = BUCKET) -> DataFrame:
    """Of each component the document with the smallest doc_id (then hash; one row of repeats), with the columns of docs."""
    plain = whole_text(docs, "doc_id")
    with scratch(docs.sparkSession) as keep:
        prints = keep(_with_prints(plain))
        nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("label"), *(F.first(p).alias(p) for p in PRINT)))
        edges = links(plain.select("doc_id", F.xxhash64("text").alias("fp"), "text"), nodes, split, bucket, keep)
        # One node for each text, so the copies of a text never meet: of each component the smallest id, of its texts the smallest hash.
        labelled = components(nodes.select("fp", "label"), edges)
        own = labelled.join(nodes.select("fp", F.col("label").alias("own")), "fp").filter(F.col("own").eqNullSafe(F.col("label")))
        first = written(own.groupBy("top").agg(F.min("fp").alias("f"), F.first("label").alias("i")))
    marked = docs.withColumn("__n_fp", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = marked.join(first, marked["doc_id"].eqNullSafe(first["i"]) & (F.col("__n_fp") == F.col("f")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__n_fp"]).select(*docs.columns)
