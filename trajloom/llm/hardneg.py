"""Hard negatives by the threshold algorithm: sorted lists for each dimension, read from the end that an anchor's sign asks for.

Rows (vec_id, label, q: whole numbers) are dealt into blocks of some ``BLOCK`` rows by hash. A block sorts each dimension once.
For an anchor it reads all lists in step (from the largest value where the anchor's component is positive, from the
smallest where it is negative), scores each row on its first sight as an exact integer inner product, and stops as soon as
the threshold, the best score that a row not yet seen can have, falls strictly below every window's kth score or below the window.
Anchors pass through all blocks: a block stands in one task, anchors stream by it, so memory is a block and an Arrow batch.
The best of all blocks are the result.

First pass: the best rows of the anchor's label (its positives). Second pass: for each positive a window of scores
from ``low`` percent of the positive's up to the positive's own, in which the best rows of other labels are its negatives. All windows of an anchor share one reading.

Defined cases: rows with a null vec_id, a null label, a null vector or a null or non-finite component take no part. A vec_id names a
row: an anchor's copies are no positives of it, and of several anchor rows of one vec_id the least by (label, vector) is the
anchor. Other repeated rows count each; a positive that is there several times gives its negatives once. Vectors of
unequal length are filled up with zeros; an empty vector scores 0. Components of more than 64 bits become the nearest 64-bit
number, a score of more than 64 bits is an error. An anchor without a positive, or a positive without a negative, gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
STEP = 64  # entries of each list at the first reading; four times as many at each further one
LOW = 80  # percent

FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers without a rounding: in doubles or 64 bits where the result fits, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros(a.shape[0], np.int64)
    most = a.shape[-1] * max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min())))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b if most < 1 << 63 else a.astype(object) @ b.astype(object)


class Lists:
    """Rows of a block, and for each dimension their places by ascending value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q, self.n = ids, labels, q, len(ids)
        self.order = np.ascontiguousarray(np.argsort(q, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(q.T, self.order, axis=1)
        self.most = max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))
        self.doubles = q.astype(np.float64) if self.most < 1 << 26 else None
        self.own: dict[int, Lists] = {}

    def of_label(self, label: int) -> Lists:
        if label not in self.own:
            at = np.flatnonzero(self.labels == label)
            self.own[label] = Lists(self.ids[at], self.labels[at], self.q[at])
        return self.own[label]

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.doubles is not None and len(a) * self.most * max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) < 1 << 53:
            return (self.doubles[rows] @ a.astype(np.float64)).astype(np.int64)
        return exact(self.q[rows], a)

    def sorted_access(self, a: np.ndarray):
        """Newly seen rows, their scores, and the threshold: no row still unseen scores more (None: all are seen)."""
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, left, at, step = np.zeros(self.n, bool), self.n, 0, STEP
        while left:
            end = min(self.n, at + step)
            if end == self.n or not len(up) + len(down):
                new, bound = np.flatnonzero(~seen), None
            else:
                mark = np.zeros(self.n, bool)
                mark[self.order[up, self.n - end : self.n - at]] = True
                mark[self.order[down, at:end]] = True
                new = np.flatnonzero(mark & ~seen)
                edge = np.r_[self.values[up, self.n - end], self.values[down, end - 1]]
                bound = int(exact(edge[None, :], np.r_[a[up], a[down]])[0])
            seen[new] = True
            left -= len(new)
            yield new, self.scores(new, a), bound if left else None
            at, step = end, step * 4


class Best:
    """The k best (score, then smallest id) of those between low and high; low100 is a hundredfold bound."""

    def __init__(self, k: int, low100: int | None = None, high: int | None = None):
        self.k, self.low100, self.high = k, low100, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.done = high is not None and low100 > 100 * high

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.high is not None:
            least = -(-self.low100 // 100)
            inside = (scores >= least) & (scores <= self.high)
            scores, ids = scores[inside], ids[inside]
        if len(self.scores) == self.k:
            good = scores >= self.scores[-1]
            scores, ids = scores[good], ids[good]
        if len(scores):
            scores, ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
            if len(scores) > self.k:
                kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                good = scores >= kth
                scores, ids = scores[good], ids[good]
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[best], ids[best]

    def close(self, bound: int) -> None:
        """No unseen row of at most this score can change the window."""
        self.done = self.done or (len(self.scores) == self.k and bound < self.scores[-1]) or (self.low100 is not None and 100 * bound < self.low100)


def search(block: Lists, label: int, a: np.ndarray, windows: list[Best], anchor: int | None) -> int:
    """Fills the windows from the block: rows of the label that aren't the anchor, or (no anchor given) rows of other labels. How many rows were scored."""
    lists = block if anchor is None else block.of_label(label)
    n = 0
    for rows, scores, bound in lists.sorted_access(a):
        n += len(rows)
        ok = lists.labels[rows] != label if anchor is None else lists.ids[rows] != anchor
        scores, ids = scores[ok], lists.ids[rows[ok]]
        for w in windows:
            if not w.done:
                w.add(scores, ids)
                if bound is not None:
                    w.close(bound)
        if all(w.done for w in windows):
            break
    return n


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros to the longest (or to width)."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(column.flatten())
    d = max(int(sizes.max(initial=0)), width)
    if (sizes == d).all():
        return flat.reshape(len(sizes), d).astype(np.int64)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def _wide(parts: list[np.ndarray]) -> np.ndarray:
    d = max(x.shape[1] for x in parts)
    return np.concatenate([x if x.shape[1] == d else np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in parts])


def _mine(k: int, low: int):
    """Streams sorted (block, kind, ...) rows: a block's rows (kind 0) first, then the anchors (kind 1) that pass it."""

    def run(batches):
        block, now, parts = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            number, kind, ids, labels = (np.asarray(b.column(i)) for i in range(4))
            q = _matrix(b.column(4))
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            found = []
            for at, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(number)].tolist()):
                if number[at] != now:
                    block, now, parts = None, number[at], []
                if kind[at] == 0:
                    own = slice(at, end)
                    x, y, z = ids[own], labels[own], q[own]
                    if len(x) > k:  # rows alike in everything stand together: the first k of them are enough for any window
                        more = np.r_[np.zeros(k, bool), (x[k:] == x[:-k]) & (y[k:] == y[:-k]) & (z[k:] == z[:-k]).all(axis=1)]
                        x, y, z = x[~more], y[~more], z[~more]
                    parts.append((x, y, z))
                    continue
                if not parts and block is None:
                    continue
                if block is None:
                    block = Lists(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), _wide([p[2] for p in parts]))
                    parts = []
                for i in range(at, end):
                    a, d = q[i], block.q.shape[1]
                    a = a[:d] if len(a) >= d else np.pad(a, (0, d - len(a)))
                    asked = b.column(5)[i].as_py()
                    if asked is None:
                        w = Best(k)
                        search(block, int(labels[i]), a, [w], int(ids[i]))
                        found += [(int(ids[i]), None, None, x, s) for x, s in zip(w.ids.tolist(), w.scores.tolist())]
                    else:
                        windows = {p["score"]: Best(k, low * p["score"], p["score"]) for p in asked}
                        search(block, int(labels[i]), a, list(windows.values()), None)
                        for p in asked:
                            w = windows[p["score"]]
                            found += [(int(ids[i]), p["id"], p["score"], x, s) for x, s in zip(w.ids.tolist(), w.scores.tolist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return run


_ASKED = "array<struct<id: bigint, score: bigint>>"


def _passed(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, low: int) -> DataFrame:
    """What the blocks find for anchors (vec_id, label, q, asked)."""
    dealt = F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks)).cast("int")
    own = rows.select(dealt.alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "q", F.lit(None).cast(_ASKED).alias("asked"))
    each = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "q", "asked")
    return own.unionByName(each).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id", "label", "q").mapInArrow(_mine(k, low), FOUND)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of each group; Spark keeps k a group before the shuffle already."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def vectors(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, q = floor(scale * x) of the rows that take part."""
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    q = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    some = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & whole)
    return some.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), q.alias("q"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = LOW, block: int = BLOCK) -> DataFrame:
    """rows, anchors: vec_id, label, q. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    blocks = max(1, -(-rows.count() // block))
    single = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("x")).select("vec_id", "x.label", "x.q")
    near = _first(_passed(rows, single.withColumn("asked", F.lit(None).cast(_ASKED)), blocks, positives, low), ["anchor_id"], positives)
    asked = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct(F.col("vec_id").alias("id"), "score")).alias("asked"))
    found = _first(_passed(rows, single.join(asked, "vec_id"), blocks, negatives, low), ["anchor_id", "positive_id", "positive_score"], negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
