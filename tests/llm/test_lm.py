"""The language model against plain sums, a plain softmax, and on texts that it hasn't seen."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import data_dir
from tests.llm.conftest import make_docs, odd_texts
from trajloom.llm import bytewords as bw
from trajloom.llm import lm
from trajloom.llm.common import table


def lowered(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


def tokens(text):
    return [*re.findall("[^ \t-\r]+", lowered(text)), "\n"]


def is_held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def plain(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score), several rows of one id in order."""
    c = Counter(t for i, text in rows if not is_held(i) for t in tokens(text))
    total, distinct = sum(c.values()), len(c)
    return sorted((str(i), is_held(i), len(t), sum(c[x] > 0 for x in t), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in t), 6)) for i, text in rows for t in [tokens(text)])


def base_of(found):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)


def scored(docs):
    return lm.score_texts(docs.select("doc_id", "text", lm.held_out().alias("held_out"))).collect()


def test_base_equals_plain_sums(spark, odd, monkeypatch):
    rows = odd_texts()
    for common in (1 << 16, 7):  # almost all tokens by way of the join
        monkeypatch.setattr(lm, "COMMON", common)
        found = scored(odd)
        assert base_of(found) == plain(rows)
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_empty_tables(spark, empty):
    assert scored(empty) == []
    held = [i for i in range(60) if is_held(i)][:3]
    found = scored(make_docs(spark, [(i, "some words") for i in held]))  # nothing to learn from
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in found] == [(0, 0, 0.0)] * 3


def test_given_documents(spark):
    docs = table(spark, data_dir(), "documents")
    found = scored(docs)
    assert base_of(found) == plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_learns_what_it_has_not_seen(spark):
    """Sentences of a fixed grammar: held-out ones are far more likely than by their words' shares."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    follow = {x: [r.choice(words) for _ in range(3)] for x in words}

    def text():
        out = [r.choice(words)]
        for _ in range(r.randrange(10, 40)):
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    found = [r for r in scored(make_docs(spark, [(i, text()) for i in range(3000)])) if r["held_out"]]
    per_token = lambda name: sum(r[name] for r in found) / sum(r["n_tokens"] for r in found)
    assert len(found) > 300 and per_token("score") > per_token("base_score") + 0.8


def test_most_frequent_tokens(spark):
    rows = [(f"t{i:03d}", 1000 // (i + 1)) for i in range(500)]
    counts = spark.createDataFrame(rows, "token string, c bigint").repartition(5)
    top = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert lm.most_frequent(counts, 500, 500, 10) == top
    some = lm.most_frequent(counts, 500, 60, 10)
    assert 50 <= len(some) <= 62 and some == top[: len(some)]
    alike = counts.withColumn("c", F.lit(7).cast("bigint"))
    assert lm.most_frequent(alike, 500, 60, 10) == [(f"t{i:03d}", 7) for i in range(10)]


def a_model(seed=0):
    rows = [("\n", 50), *[(f"t{i}", 40 - i // 200) for i in range(5000)]]
    common = lm.Common.of(rows)
    weights = np.random.default_rng(seed).normal(0, 1, (lm.ROWS, lm.WIDTH)).astype(np.float32)
    return common, weights


def test_places_sum_to_one():
    """Over all places and the tail, behind any words, the probabilities come to 1."""
    _, weights = a_model()
    place = np.arange(lm.KNOWN + 1)
    for before in ((lm.START,) * 2, (5, lm.KNOWN + 3)):
        t = lm.Tokens(place, place, place, tuple(np.full(len(place), x) for x in before), None)
        assert abs(np.exp(lm.log_probabilities(weights, t)).sum() - 1) < 1e-4


def test_words_before_cross_slices(monkeypatch):
    common, _ = a_model()
    texts = pa.array(["t1 t2 t3 t4 zz t5 t1", "", "t9", None, "t7 yy t8 t7 t6 t5 t4 t3 t2 t1"])

    def all_of():
        out = {}
        for t in lm.tokens_of(texts, common):
            for i in range(len(t.text)):
                out.setdefault(int(t.text[i]), []).append((int(t.place[i]), *(int(x[i]) for x in t.before)))
        return out

    whole = all_of()
    monkeypatch.setattr(bw, "SLICE", 4)
    assert all_of() == whole
    assert [x[0] for x in whole[0]] == [2, 3, 4, 5, lm.KNOWN, 6, 2, 0] and whole[1] == [(0, lm.START, lm.START)]
    assert whole[0][3][1:] == (4, 3) and whole[2] == [(10, lm.START, lm.START), (0, 10, lm.START)]


def test_a_gradient_step_lowers_the_loss():
    common, _ = a_model()
    texts = pa.array([" ".join(f"t{(i * 7 + j) % 60}" for j in range(80)) for i in range(300)])
    weights = lm.first_weights(np.ones(lm.KNOWN), 10)
    learner = lm.Learner(weights)
    loss = lambda w: -np.concatenate([lm.log_probabilities(w, t) for t in lm.tokens_of(texts, common)]).mean()
    before = loss(weights)
    for t in lm.tokens_of(texts, common):
        learner.learn(t)
    assert loss(learner.weights) < before - 1 and (learner.touched[0] == 300 * 81)
    assert np.array_equal(weights, lm.first_weights(np.ones(lm.KNOWN), 10))
