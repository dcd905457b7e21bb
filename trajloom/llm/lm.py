"""A hashed maximum-entropy language model: n-gram and skip features, a class-factored softmax, learnt by distributed gradient steps.

Tokens are words (A-Z lowered, between ASCII white space) and an end after each text. Counts come from all training texts.

* The ``KNOWN`` most frequent tokens have a place: a class of ``WIDTH`` tokens and a place in it. All others share the last class.
  P(token) = P(class | before) * P(place | class, before), each a softmax over ``WIDTH`` sums of weights; within the last class
  the only feature is the bias, whose best weights are the tokens' own shares (count + 1, an unseen token like a count of 0).
* Features of what stands before: the last word, the last two words, and the one before the last, with the last one skipped. Of the class
  softmax single words have rows of their own (rare words share some); all combinations share hashed rows.
* Learning goes over every training text once, in ``ROUNDS`` rounds of disjoint texts. In a round each task starts from the same weights
  and makes its own gradient steps over its texts in small batches; the steps of all tasks are averaged row by row, weighted by how many
  tokens touched the row. The weights have a fixed size, whatever the input: they are what goes to all tasks.
* Scoring works on batches of tokens in numpy. Counts of some ``COMMON`` of the most frequent tokens go to all tasks, the others' tokens
  leave the scoring pass and meet the table of all counts in a join.

Defined cases: a null or empty text is an end alone; a null doc_id takes part like the id '' (crc32 0); repeated rows count and are
scored each; without any training text every count is 0, base_score is 0 and classes are equally likely. Texts of any length are
read whole, slice by slice, the words before going along.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajloom.llm.bytewords import GAP, exact_ids, kinds, mixed, same_bytes, strings_of, word_hashes, words_of
from trajloom.llm.common import scratch, written

KINDS = kinds(b" \t\n\x0b\x0c\r")
END = "\n"  # no word holds one
WIDTH = 48
CLASSES = 48
TAIL = CLASSES - 1
KNOWN = TAIL * WIDTH
COMMON = 1 << 16
RARE = 64  # codes that words without a place share as features
START = KNOWN + RARE
CODES = START + 1

PAIRS, SKIPS = 1 << 14, 1 << 13  # hashed rows
CLASS_ROWS = 1 + 2 * CODES + PAIRS
PLACE_ROWS = TAIL + PAIRS + SKIPS
ROWS = CLASS_ROWS + PLACE_ROWS

ROUNDS = 2
BATCH = 4096
RATE = 0.1
DRAWN = 1
STEEP = 60.0  # sums of weights are held between this and its negative
PACK = 512  # rows of weights that travel together

_LN10 = np.log(10.0)


class Common(NamedTuple):
    """The most frequent tokens by hash, with rank (from 0) and count; what their texts are."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rank: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, int]]) -> Common:
        """rows: token, count, most frequent first."""
        words = [t.encode("utf-8") for t, _ in rows]
        end = np.cumsum([len(x) for x in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        start = end - np.array([len(x) for x in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        own = word_hashes(data, start, end)
        order = np.argsort(own)
        return Common(data, start[order], end[order], own[order], order.astype(np.int64), np.array([c for _, c in rows], np.int64)[order])

    def find(self, w) -> np.ndarray:
        """The number in this table of each word, -1 for others."""
        if not len(self.hash):
            return np.full(len(w.hash), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == w.hash)
        own = at[hit]
        same = same_bytes(w.data, w.start[hit], w.end[hit], self.start[own], self.end[own], self.data)
        out = np.full(len(w.hash), -1, np.int64)
        out[hit[same]] = own[same]
        return out


class Tokens(NamedTuple):
    """Tokens in a row: number in Common (-1: not there), text in the batch, place (KNOWN: none), codes of the two before."""

    number: np.ndarray
    text: np.ndarray
    place: np.ndarray
    before: tuple[np.ndarray, np.ndarray]
    words: object


def tokens_of(texts: pa.Array, common: Common):
    """A batch's tokens: slices of words, then all ends."""
    last = np.full((len(texts), 2), START, np.int64)
    for w in words_of(texts, KINDS, GAP):
        if not len(w.hash):
            continue
        number = common.find(w)
        rank = np.where(number >= 0, common.rank[number], KNOWN) if len(common.rank) else np.full(len(number), KNOWN)
        place = np.minimum(rank, KNOWN)
        code = np.where(place < KNOWN, place, KNOWN + (w.hash & np.uint64(RARE - 1)).astype(np.int64))
        first = int(w.text[0])
        codes, text = np.r_[last[first, ::-1], code], np.r_[first, first, w.text]
        n = len(code)
        before = tuple(np.where(text[2 - k : 2 - k + n] == w.text, codes[2 - k : 2 - k + n], START) for k in (1, 2))
        # A text that began in an earlier slice goes on here: its last words stand before the first ones.
        ends = np.flatnonzero(np.r_[w.text[1:] != w.text[:-1], True])
        last[w.text[ends]] = np.stack([code[ends], before[0][ends]], axis=1)
        yield Tokens(number, w.text, place, before, w)
    own = np.flatnonzero((common.end - common.start == 1) & (common.data[np.minimum(common.start, max(len(common.data) - 1, 0))] == 10)) if len(common.data) else np.zeros(0, np.int64)
    number = int(own[0]) if len(own) else -1
    place = min(int(common.rank[number]), KNOWN) if number >= 0 else KNOWN
    m = len(texts)
    yield Tokens(np.full(m, number), np.arange(m), np.full(m, place), (last[:, 0], last[:, 1]), None)


def _hashed(size: int, *parts) -> np.ndarray:
    x = np.zeros(len(parts[-1]), np.uint64)
    for p in parts:
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.asarray(p).astype(np.uint64) + np.uint64(1)
    return (mixed(x) & np.uint64(size - 1)).astype(np.int64)


def class_features(before) -> list[np.ndarray]:
    """Rows of weights of the class softmax, one array a feature, without the bias (row 0)."""
    a, b = before
    return [1 + a, 1 + CODES + b, 1 + 2 * CODES + _hashed(PAIRS, b, a)]


def place_features(cls: np.ndarray, before) -> list[np.ndarray]:
    """The same of the softmax within a class; its bias is row CLASS_ROWS + class."""
    a, b = before
    at = CLASS_ROWS + TAIL
    return [at + _hashed(PAIRS, cls, a), at + PAIRS + _hashed(SKIPS, cls, b)]


def _exponentials(weights: np.ndarray, bias: int | np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    x = weights[rows[0]]
    x += weights[bias]
    for r in rows[1:]:
        x += weights[r]
    np.clip(x, -STEEP, STEEP, out=x)
    return np.exp(x, out=x)


def _logs(e: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.log(e[np.arange(len(target)), target]) - np.log(e @ np.ones(WIDTH, np.float32))


def log_probabilities(weights: np.ndarray, t: Tokens) -> np.ndarray:
    """Natural logarithm of P(class) P(place | class) of each token; of the tail's tokens P(class) alone."""
    out = np.empty(len(t.place))
    for at in range(0, len(out), BATCH):
        own = slice(at, at + BATCH)
        place, before = t.place[own], tuple(x[own] for x in t.before)
        cls = place // WIDTH
        found = _logs(_exponentials(weights, 0, class_features(before)), cls)
        some = np.flatnonzero(cls < TAIL)
        inner = cls[some]
        found[some] += _logs(_exponentials(weights, CLASS_ROWS + inner, place_features(inner, [x[some] for x in before])), place[some] % WIDTH)
        out[own] = found
    return out


class Learner:
    """Gradient steps of one task, each weight with a step of its own (by the gradients it has met).

    The gradient of a softmax is its probabilities less the token's place. ``DRAWN`` places drawn by these probabilities stand
    for them: right on average, and a handful of weights a feature instead of a whole row.
    """

    def __init__(self, weights: np.ndarray, seed: int = 0):
        self.weights = weights.copy()
        self.flat = self.weights.reshape(-1)
        self.met = np.full(ROWS * WIDTH, 1e-3, np.float32)
        self.touched = np.zeros(ROWS, np.int64)
        self.random = np.random.default_rng(seed)

    def _step(self, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
        sums = np.cumsum(_exponentials(self.weights, bias, rows), axis=1)
        drawn = [np.minimum((sums < self.random.random((len(target), 1), np.float32) * sums[:, -1:]).sum(axis=1), WIDTH - 1) for _ in range(DRAWN)]
        places = np.concatenate([target, *drawn])
        slope = np.repeat(np.array([-1.0] + [1.0 / DRAWN] * DRAWN, np.float32), len(target))
        for r in (bias, *rows):
            at = np.tile(r * WIDTH, DRAWN + 1) + places
            np.add.at(self.met, at, slope * slope)
            np.subtract.at(self.flat, at, slope * RATE / np.sqrt(self.met[at]))
            np.add.at(self.touched, r, 1)

    def learn(self, t: Tokens) -> None:
        for at in range(0, len(t.place), BATCH):
            own = slice(at, at + BATCH)
            place, before = t.place[own], tuple(x[own] for x in t.before)
            cls = place // WIDTH
            self._step(np.zeros(len(cls), np.int64), class_features(before), cls)
            some = np.flatnonzero(cls < TAIL)
            if len(some):
                self._step(CLASS_ROWS + cls[some], place_features(cls[some], [x[some] for x in before]), place[some] % WIDTH)


def _counts(batches):
    """text -> token, c of a slice's words and of a batch's ends."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b.num_rows], pa.int64())], ["token", "c"])
        for w in words_of(b.column(0), KINDS, GAP):
            if len(w.hash):
                ids, words = exact_ids(w, np.arange(len(w.hash)))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(ids, minlength=len(words)).astype(np.int64))], ["token", "c"])


def token_counts(texts: DataFrame) -> DataFrame:
    """token, c over all texts (one column)."""
    return texts.mapInArrow(_counts, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, distinct: int, n: int, least: int) -> list[tuple[str, int]]:
    """Tokens and counts, most frequent first: n of them or somewhat fewer (all of one count or none), but ``least`` where there are so many."""
    order = lambda rows: sorted(((r["token"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))
    if distinct <= n:
        return order(counts.collect())
    # A count that n tokens exceed at most: so no task sends more than its share of them.
    edge = counts.agg(F.percentile_approx("c", 1 - n / distinct, 1_000_000)).first()[0]
    found = order(counts.filter(F.col("c") > edge).collect())
    return found if len(found) >= least else order(counts.orderBy(F.desc("c"), "token").limit(least).collect())


def _steps(common, weights):
    """text -> the task's steps, packed: pack, touched, steps of its rows."""

    def run(batches):
        before = np.frombuffer(weights.value, np.float32).reshape(ROWS, WIDTH)
        learner = Learner(before, TaskContext.get().partitionId())
        table = Common(*common.value)
        some = False
        for b in batches:
            for t in tokens_of(b.column(0), table):
                learner.learn(t)
                some = some or len(t.place) > 0
        for pack in range(-(-ROWS // PACK)) if some else ():
            own = slice(pack * PACK, (pack + 1) * PACK)
            moved = (learner.weights[own] - before[own]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int32()), pa.array([learner.touched[own].tobytes()], pa.binary()), pa.array([moved.tobytes()], pa.binary())], ["pack", "touched", "steps"])

    return run


def _averaged(batches):
    """Packs sorted by number -> for each the weighted mean of its steps."""
    now, total, n = None, None, None

    def out():
        mean = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["pack", "steps"])

    for b in batches:
        for pack, touched, steps in zip(*(b.column(i).to_pylist() for i in range(3))):
            if pack != now:
                if now is not None:
                    yield out()
                now, total, n = pack, 0.0, 0
            own = np.frombuffer(touched, np.int64)
            total = total + np.frombuffer(steps, np.float16).astype(np.float64).reshape(-1, WIDTH) * own[:, None]
            n = n + own
    if now is not None:
        yield out()


def first_weights(counts: np.ndarray, tail: int) -> np.ndarray:
    """Biases that give each place its share of the counts (of places, by rank); all else 0."""
    weights = np.zeros((ROWS, WIDTH), np.float32)
    places = np.zeros(KNOWN)
    places[: len(counts)] = counts
    by_class = places.reshape(TAIL, WIDTH)
    shares = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    weights[0] = shares(np.r_[by_class.sum(axis=1), tail] + 1)
    weights[CLASS_ROWS : CLASS_ROWS + TAIL] = shares(by_class + 0.01)
    return weights


def trained(texts: DataFrame, common, weights: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """texts: text, round (from 0). The weights after all rounds."""
    spark = texts.sparkSession
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights.tobytes())
        steps = texts.filter(F.col("round") == k).select("text").mapInArrow(_steps(common, shared), "pack int, touched binary, steps binary")
        found = steps.repartition("pack").sortWithinPartitions("pack").mapInArrow(_averaged, "pack int, steps binary").collect()  # the weights' size
        weights = weights.copy()
        for r in found:
            weights[r["pack"] * PACK : (r["pack"] + 1) * PACK] += np.frombuffer(r["steps"], np.float32).reshape(-1, WIDTH)
        shared.unpersist()
    return weights


def _scores(common, weights, tail: float):
    """doc_id, held_out, text -> what a pass over the text gives: sums over common tokens, and the other tokens."""

    def run(batches):
        table, own = Common(*common.value), np.frombuffer(weights.value, np.float32).reshape(ROWS, WIDTH)
        logs = np.r_[np.log10(table.count + 1.0), 0.0]  # the last for -1
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            m = b.num_rows
            n, known, base, score = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
            rare, owners = [], []
            for t in tokens_of(b.column(2), table):
                n += np.bincount(t.text, minlength=m)
                known += np.bincount(t.text[t.number >= 0], minlength=m)
                log = logs[t.number]
                base += np.bincount(t.text, weights=log, minlength=m)
                model = log_probabilities(own, t) / _LN10 + np.where(t.place == KNOWN, log - tail, 0.0)
                score += np.bincount(t.text, weights=model, minlength=m)
                other = np.flatnonzero(t.number < 0)
                if len(other):
                    rare.append(strings_of(t.words, other) if t.words is not None else pa.array([END] * len(other)))
                    owners.append(t.text[other])
            tokens = pa.concat_arrays(rare) if rare else pa.array([], pa.string())
            owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(m + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), tokens.take(pa.array(order)))
            row = pa.array((part << 40) + done + np.arange(m))
            done += m
            yield pa.RecordBatch.from_arrays([row, b.column(0), b.column(1), pa.array(n), pa.array(known), pa.array(base), pa.array(score), lists], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"])

    return run


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text, held_out (boolean). Learns from the texts that aren't held out, scores all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (base-10 logarithms).
    """
    spark = docs.sparkSession
    some = docs.select("doc_id", "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = some.filter(~F.col("held_out")).select("text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(rounds)).alias("round"))
    with scratch(spark) as keep:
        counts = keep(token_counts(training.select("text")))
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        top = most_frequent(counts, distinct, COMMON, KNOWN)
        placed = np.array([c for _, c in top[:KNOWN]], np.float64)
        tail_tokens, tail_distinct = total - int(placed.sum()), distinct - len(placed)
        common = spark.sparkContext.broadcast(tuple(Common.of(top)))
        weights = trained(training, common, first_weights(placed, tail_tokens), rounds)
        shared, tail = spark.sparkContext.broadcast(weights.tobytes()), float(np.log10(tail_tokens + tail_distinct + 1.0))
        kind = dict(docs.dtypes)["doc_id"]
        passed = keep(some.select("doc_id", "held_out", "text").mapInArrow(_scores(common, shared, tail), f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double, rare array<string>"))
        rare = passed.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
        c = F.coalesce("c", F.lit(0))
        sums = rare.groupBy("row").agg(F.sum((c > 0).cast("bigint")).alias("more_known"), F.sum(F.log10(c + 1.0)).alias("more"))
        both = passed.drop("rare").join(sums, "row", "left")
        more = F.coalesce("more", F.lit(0.0))
        return written(both.select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
            (F.col("base") + more - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))).alias("base_score"), (F.col("model") + more).alias("score"),
        ))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 by 7."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2
