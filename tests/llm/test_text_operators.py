"""Quality, licenses, fingerprints and personal data against brute force, on odd rows and the given documents."""

import hashlib
import re
import textwrap
from collections import Counter

import pytest

from tests.conftest import data_dir
from tests.llm.conftest import make_docs, odd_texts
from trajloom.llm import licenses, merkle, pii, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def given(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir()}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def texts(spark):
    return given(spark) + [(None if i is None else i + 1_000_000, t) for i, t in odd_texts()]


def quality_by_hand(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered, lines, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(spark, texts, empty):
    got = quality.quality_report(make_docs(spark, texts)).collect()
    assert sorted((repr(r["doc_id"]), *r[1:7]) for r in got) == sorted((repr(i), *quality_by_hand(t)) for i, t in texts)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.quality_report(empty).count() == 0
    kept = quality.keep_good(make_docs(spark, texts))
    assert kept.columns == make_docs(spark, texts).columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_keeps_clean_prose_and_drops_junk(spark):
    docs = spark.read.parquet(f"{data_dir('0.01')}/documents.parquet")
    marked = quality.quality_report(docs).join(spark.read.parquet(f"{data_dir('0.01')}/labels.parquet"), "doc_id").collect()
    good = [r for r in marked if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in marked if r["quality"] == 0 and not r["base_failed"]]
    assert sum(not r["kept"] for r in good) <= 0.01 * len(good) and sum(r["kept"] for r in bad) <= 0.4 * len(bad)


def licenses_by_hand(text, threshold=0.9):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    x = (text or "").translate(LOWER)
    w = re.findall(word, x)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    more, best = set(), 0.0
    for line in x.split("\n"):
        own = set(re.findall(word, line))
        for label, t in licenses.TEMPLATES:
            c = len(own & set(t.split())) / len(set(t.split()))
            if c >= threshold:
                more.add(label)
                best = max(best, c)
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best


def test_licenses(spark, texts, empty):
    texts = texts + [(9_000_001, "Released UNDER the MIT license!\nmit license cc-by Licensed under CC BY NC 4.0"), (9_000_002, "work this is licensed under the GNU general public version 3 license"), (9_000_003, "gnu general public")]
    got = licenses.license_report(make_docs(spark, texts)).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *licenses_by_hand(t))) for i, t in texts)
    assert licenses.license_report(empty).count() == 0


def test_licenses_in_wrapped_notices(spark):
    """Each template wrapped at 20 to 80 columns, as comments and with blank lines, gets its label; words far apart do not."""
    texts, want = [], {}
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        for width in (20, 60, 70, 80):
            for mark, gap in (("", "\n"), (" * ", "\n"), ("# ", "\n\n")):
                i = len(texts)
                lines = textwrap.wrap(f"Some file of 2024. {t}. And more", width)
                texts.append((i, "int x;\n" + gap.join(mark + x.upper() for x in lines) + "\nint y;"))
                want[i] = label
        texts.append((90_000 + k, "\n".join(f"{w} " + "between other words " * 14 for w in t.split())))
    got = {r["doc_id"]: r for r in licenses.license_report(make_docs(spark, texts)).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1 for i, label in want.items())
    assert all(got[90_000 + k]["labels"] == "" and got[90_000 + k]["score"] == 0 for k in range(len(licenses.TEMPLATES)))


def test_fingerprints(spark, empty):
    texts = [(i, t) for i, t in given(spark)] + [(5_000, None), (5_001, ""), (5_002, "x"), (5_003, "long line " * 30_000)]
    got = {r["doc_id"]: r for r in merkle.fingerprint_report(make_docs(spark, texts)).collect()}
    order = sorted(texts, key=lambda x: -x[0])
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["near_edited"] == 1) == (edited == t) and (r["near_next"] == 1) == (n == t) and 0 <= r["near_edited"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (edited == t)
        trees = [tree_by_hand(x) for x in (t, edited, n)]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (trees[0][0], trees[1][0])
        for near, other in (("near_edited", trees[1]), ("near_next", trees[2])):
            a, b = trees[0][1], other[1]
            want = 1.0 if trees[0][0][:64] == other[0][:64] else 2 * len(a & b) / (len(a) + len(b) + 2)
            assert abs(r[near] - want) < 1e-12
    prints = {}
    for i, t in texts:
        prints.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in prints.values()) and len({next(iter(x)) for x in prints.values()}) == len(prints)
    assert merkle.fingerprint_report(empty).count() == 0


def tree_by_hand(text):
    """The fingerprint, and the digests of all levels but the root."""
    sha = lambda level, x: hashlib.sha256((level + x).encode()).hexdigest()
    paragraphs = [[sha("leaf", y) for y in re.findall(r"(?s)[^.!?]{1,256}[.!?]{0,3}|[.!?]{1,256}", p)] for p in text.split("\n")]
    digests = [sha("paragraph", "".join(p)) for p in paragraphs]
    sections, own = [], []
    for k, d in enumerate(digests):
        own.append(d)
        if d[-1] in "08" or k == len(digests) - 1:
            sections.append(sha("section", "".join(own)))
            own = []
    levels = [[y for p in paragraphs for y in p], digests, sections]
    return ":".join([sha("root", "".join(sections)), *("".join(d[:16] for d in x) for x in levels)]), {d for x in levels for d in x}


def test_an_added_line_changes_one_branch(spark):
    lines = [f"This is line {k}. It has two sentences." for k in range(200)]
    docs = make_docs(spark, [(1, "\n".join(lines)), (2, "\n".join(lines[:90] + ["A new line."] + lines[90:]))])
    one, two = (r["fingerprint"].split(":") for r in merkle.fingerprints(docs).orderBy("doc_id").collect())
    cut = lambda x: [x[k : k + 16] for k in range(0, len(x), 16)]
    assert one[0] != two[0]
    assert len(set(cut(two[1])) - set(cut(one[1]))) == 1 and len(set(cut(two[2])) - set(cut(one[2]))) == 1 and 1 <= len(set(cut(two[3])) - set(cut(one[3]))) <= 2


def test_fingerprints_of_odd_rows(spark, odd):
    got = merkle.fingerprint_report(odd).collect()
    assert len(got) == len(odd_texts())
    assert len({r["fingerprint"] for r in got}) == len({t or "" for _, t in odd_texts()})


def spans_by_hand(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def test_pii_base_on_random_text():
    import random

    r = random.Random(0)
    for _ in range(5000):
        x = "".join(r.choice("a1.@-+ 12) 9%_") for _ in range(r.randrange(40)))
        assert pii.base_spans(x) == spans_by_hand(x), x
    x = "4111-1111-1111-1111 a.b@c.de +1 (682) 555-5413, 10.0.0.256, 10.0.0.1"
    assert [k for _, k, _ in pii.base_spans(x)] == ["card", "email", "phone", "ip"]


def test_pii(spark, texts, empty):
    texts = texts + [(9_000_001, 'call +1 (682) 555-5413 or mail a.b@c.de, token = "0123456789abcdef0123456789abcdef01234567" 10.0.0.1'), (9_000_002, "1" * 100_000), (9_000_003, "@" * 50_000)]
    field = pii.train(make_docs(spark, texts).select("text").na.drop())
    got = pii.pii_report(make_docs(spark, texts), field).collect()
    want = sorted((repr(i), hashlib.sha256(pii._joined(spans_by_hand(t or "") if len(t or "") < 90_000 else pii.base_spans(t)).encode()).hexdigest()) for i, t in texts)
    assert sorted((repr(r["doc_id"]), r["base_sha256"]) for r in got) == want
    for r in got:
        base = spans_by_hand(dict(texts).get(r["doc_id"]) or "") if r["doc_id"] not in (None, 1_000_107, 1_000_108, 9_000_002, 9_000_003) else []
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(r["spans"].split(","))
    assert pii.pii_report(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact_texts(make_docs(spark, texts), field).collect()}
    assert clean[9_000_001].startswith("call <PHONE> or mail <EMAIL>, ") and clean[9_000_001].endswith("<IP>") and clean[1_000_100] is None
    assert clean[1_000_103] == "one"


def test_semi_markov_decode_is_the_best_segmentation():
    """Against all segmentations of a short window."""
    field = pii.Field({k: {"luhn": 1.0, "bias": -0.3, "ip": 2.0, f"digits{i}": 0.4} for i, k in enumerate(pii.KINDS)})
    text = "a 10.0.0.1 22 b 4111111111111111 c"
    where = pii.atoms(text, 0, len(text))
    lattice = pii.segments(text, where)

    def best(j):
        if j == 0:
            return 0.0
        return max([best(j - 1)] + [best(i) + field.score(k, f) for i, f in lattice[j] for k in pii.KINDS])

    starts = {a: n for n, (a, _) in enumerate(where)}
    ends = {b: n + 1 for n, (_, b) in enumerate(where)}
    found = field.decode(text, where)
    total = sum(next(field.score(k, f) for i, f in lattice[ends[b]] if i == starts[a]) for a, k, b in found)
    assert abs(total - best(len(where))) < 1e-9


@pytest.fixture(scope="module")
def field(spark, texts):
    return pii.train(make_docs(spark, texts).select("text").na.drop())


def test_pii_added_spans_on_held_out_windows(spark, texts, field):
    """Windows of another seed than the trained ones': boundaries and kinds must both be right."""
    found = right = wanted = 0
    for text, gold in pii.made_windows([t for _, t in texts if t], 400, seed=99):
        got = set(field.decode(text, pii.atoms(text, 0, len(text))))
        found, right, wanted = found + len(got), right + len(got & set(gold)), wanted + len(gold)
    assert right / found > 0.9 and right / wanted > 0.85


@pytest.mark.parametrize("n", [20, 64, 80, 300])
def test_no_tail_of_a_secret_is_left(field, n):
    text = 'set token = "' + "a1b2c3d4e5" * 3 + "e" * n + '" and go on'
    assert "eeee" not in pii.redact(text, field)
    assert pii.redact(text, field).endswith("and go on")


def test_added_spans_may_hold_base_ones(field):
    """A secret with a valid card number within is one span more; nothing of it is left."""
    text = 'set api_key = "abcdefabcdef4111111111111111abcdefabcdef0123" and go on'
    base, every = pii.find(text, field)
    assert [(k, text[a:b]) for a, k, b in base] == [("card", "4111111111111111")]
    assert set(base) < set(every) and any(a <= text.index("abcdef") and b >= text.index("0123") + 4 for a, _, b in every)
    clean = pii.redact(text, field)
    assert "abcdef" not in clean and "0123" not in clean and clean.startswith("set ") and clean.endswith("and go on")


def test_long_training_windows_are_cut_at_white_space():
    text = "x1 " * 500 + "y" * 700
    parts = pii._pieces(text, 600)
    assert "".join(parts) == text and all(len(p) <= 600 for p in parts) and all(p[-1] == "1" for p in parts[:2])


def test_windows_end_at_white_space():
    import random

    r = random.Random(3)
    for _ in range(500):
        text = "".join(r.choice("ab1@ \n" if r.random() < 0.1 else "abcdefgh ") for _ in range(r.randrange(900)))
        own = list(pii.windows(text))
        near = {k for m in re.finditer("[0-9@]", text) for k in range(max(0, m.start() - pii.NEAR), min(len(text), m.end() + pii.NEAR))}
        assert near <= {k for a, b in own for k in range(a, b)}
        assert all((a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace()) for a, b in own)
        assert all(b <= a for (_, b), (a, _) in zip(own, own[1:]))


def test_hash_sample_is_of_all_rows(spark):
    from trajloom.llm.common import hash_sample

    df = spark.createDataFrame([(f"v{k % 50}",) for k in range(2000)] + [(None,)], "t string")
    few = hash_sample(df, 7)
    assert few == hash_sample(df.repartition(9), 7) and len(set(few)) == 7
    assert set(hash_sample(df, 1000)) == {f"v{k}" for k in range(50)} and hash_sample(df.limit(0), 5) == []
