"""Collocations against plain counting, and the numpy words against plain splitting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import odd_texts
from trajloom.llm import bytewords as bw
from trajloom.llm import phrases as ph


def lowered(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


def brute(rows, least, covered=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= covered * a for q, b in often.items())
            if not inside:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(1, t, lang, 1, "p", 2) for lang, t in rows], "doc_id bigint, text string, lang string, n int, phrase string, f int").repartition(parts)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, n=160):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "dé", "日本", "x", "of", "the", "Ünder", "ab", "a"]
    gap = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "! "]
    text = lambda: "".join(r.choice(words[: r.randrange(2, 12)]) + r.choices(gap, [20, 3, 2, 1, 1, 1, 1, 1])[0] for _ in range(r.randrange(0, 60)))
    return [(r.choice(["en", "de", None, "", "und"]), text()) for _ in range(n)]


@pytest.mark.parametrize("least", [3, 30])
def test_equals_plain_counting(spark, least):
    rows = made(1)
    found = got(ph.ranked(ph.frequent_phrases(rows_of(spark, rows), least)))
    assert found == brute(rows, least) and len(found) > 20


def test_top_and_ties(spark):
    rows = made(2)
    assert got(ph.ranked(ph.frequent_phrases(rows_of(spark, rows), 5), top=7)) == brute(rows, 5, top=7)


def test_odd_rows(spark, monkeypatch):
    rows = [(None if i is None else "en", t) for i, t in odd_texts()] + [("en", None), (None, None), ("xx", " \t.\n")]
    assert got(ph.collocations(rows_of(spark, rows), least=4)) == brute(rows, 4)
    assert got(ph.collocations(rows_of(spark, []))) == []


def test_colliding_fingerprints_are_told_apart(monkeypatch):
    """With all fingerprints alike, only the comparison with the text is left."""
    monkeypatch.setattr(ph, "_grams", lambda w, seeds, n, places=None: _same(w, n, places))

    def _same(w, n, places):
        k = max(len(w.hash) - n + 1, 0)
        at = np.flatnonzero(w.piece[:k] == w.piece[n - 1 :]) if places is None else places
        return at, np.full(len(at), 5, np.uint64)

    bits = type("B", (), {"value": b"\xff" * (ph.BITS // 8)})
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["a b a b. a b c", "a b", "b a"])], ["lang", "text"])
    counts = Counter()
    for out in ph._texts(bits, bits)([batch]):
        for x in out.to_pylist():
            counts[(x["lang"], x["n"], x["phrase"])] += x["f"]
    assert counts[("en", 2, "a b")] == 3 and counts[("en", 2, "b a")] == 2 and counts[("de", 2, "a b")] == 1 and counts[("en", 3, "a b c")] == 1
    assert counts[("en", 0, "")] == 9 and counts[("en", 1, "a")] == 4 and counts[("de", 0, "")] == 2


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bw, "word_hashes", lambda data, start, end: np.ones(len(start), np.uint64))
    w = next(bw.words_of(pa.array(["ab cd ab", "cd ef"]), ph.KINDS))
    ids, words = bw.exact_ids(w, np.arange(5))
    assert words.take(pa.array(ids)).to_pylist() == ["ab", "cd", "ab", "cd", "ef"]


@pytest.mark.parametrize("size", [8 << 20, 64, 7])
def test_words_are_those_of_a_plain_split(monkeypatch, size):
    """Whatever the slices, also behind a sliced Arrow array; long words keep their hash."""
    monkeypatch.setattr(bw, "SLICE", size)
    texts = ["One two.three", None, "", "  ", "x" * 70_000 + " tail.end", "é日 本!z", "y" * 70_000, "." * 30, "last one"]
    arr = pa.array(["drop me"] + texts).slice(1)
    found, hashes = [], {}
    for w in bw.words_of(arr, ph.KINDS):
        for i in range(len(w.start)):
            x = w.bytes_of(i).decode()
            assert hashes.setdefault(x, w.hash[i]) == w.hash[i]
            found.append((int(w.text[i]), x))
    want = [(i, x) for i, t in enumerate(texts) for x in re.findall("[^ \t.,;:!?\n\x0b\x0c\r]+", lowered(t))]
    assert found == want and len(set(hashes.values())) == len(hashes)
