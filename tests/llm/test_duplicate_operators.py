"""SimHash, repeats, pages and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.conftest import data_dir
from tests.llm.conftest import make_docs, odd_texts
from trajloom.llm import html, simhash, suffix
from trajloom.llm import near as near_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def groups(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(fps, radius=2):
    return [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius]


def clustered(seed, n):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 12)):
            out.add(x)
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
    return np.array(sorted(out)[:n], dtype=np.uint64)


@pytest.mark.parametrize("n", [2, 63, 64, 65, 300])
@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_sliced_links(n, radius):
    fps = clustered(n, n)
    assert groups(simhash.bit_sliced_links(fps, radius, block=2), n) == groups(near(fps, radius), n)


@pytest.mark.parametrize("split", [4, 2048])
def test_links_and_components(spark, split):
    """With a small split every bucket is dealt anew."""
    fps = np.unique(np.r_[clustered(9, 250), [np.uint64(0), np.uint64(1), np.uint64(3), np.uint64(7), np.uint64(2**63)]])
    signed = fps.view(np.int64).tolist()
    nodes = spark.createDataFrame([(x, 1000 - k) for k, x in enumerate(signed)], "fp bigint, label bigint")
    got = {r["fp"]: r["label"] for r in simhash.components(nodes, simhash.links(nodes.select("fp"), 2, split)).collect()}
    want = groups(near(fps), len(fps))
    least = {}
    for k, g in enumerate(want):
        least[g] = min(least.get(g, 10**9), 1000 - k)
    assert [got[x] for x in signed] == [least[g] for g in want]


def test_near_duplicates(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    prints = {t: print_by_hand(t) for _, t in odd_texts()}
    assert sorted((repr(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((repr(i), f"{prints[t]:016x}") for i, t in odd_texts())
    fps = sorted(set(prints.values()))
    group = dict(zip(fps, groups(near(fps), len(fps))))
    least = {}
    for i, t in odd_texts():
        g = group[prints[t]]
        least[g] = min(x for x in (least.get(g), i, 10**9) if x is not None)
    want = sorted((repr(i), repr(None if least[group[prints[t]]] == 10**9 else least[group[prints[t]]])) for i, t in odd_texts())
    assert sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd).collect()
    assert len(kept) == len(least) and kept[0].__fields__ == odd.columns


def removed_by_hand(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        end = 0
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return out


def repeating():
    r = random.Random(3)
    base = "".join(r.choice("abcdé \n") for _ in range(3000))
    text = lambda s, n: "".join(r.choice(s) for _ in range(r.randrange(n)))
    out = [(i, text("xyzü", 300) + base[900:1700] + text("pqr", 300)) for i in range(300)]
    for i in range(60):
        k = r.randrange(2000)
        out.append((1000 + i, str(i) + base[k : k + r.randrange(300, 1000)] + f"q{i}"))
    return out + [(2000, "ab" * 900), (2001, "x" * 399), (2002, "z" * 400), (2003, "z" * 401), (2004, None), (2005, ""), (2006, base[:600]), (2006, base[:600]), (None, base[:500])]


def passages_by_hand(texts, words=51):
    """Of each text the bytes in passages of so many words that start twice or more."""
    pieces = [[m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", (t or "").encode())] for t in texts]
    named = [[(t or "").encode()[a:b] for a, b in p] for t, p in zip(texts, pieces)]
    seen = Counter(tuple(w[k : k + words]) for w in named for k in range(len(w) - words + 1))
    out = []
    for w, p in zip(named, pieces):
        covered = set()
        for k in range(len(w) - words + 1):
            if seen[tuple(w[k : k + words])] > 1:
                covered.update(range(p[k][0], p[k + words - 1][1]))
        out.append(len(covered))
    return out



@pytest.mark.parametrize("split", [8, 256])
def test_repeats(spark, split, monkeypatch):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (400, 100, split))
    texts = repeating()
    got = sorted((repr(r["doc_id"]), *r[1:]) for r in suffix.removal_report(make_docs(spark, texts)).collect())
    hand = zip(texts, removed_by_hand([t for _, t in texts]), passages_by_hand([t for _, t in texts]))
    assert got == sorted((repr(i), *x, n) for (i, _), x, n in hand)


def test_repeats_of_odd_rows(spark, odd, empty):
    texts = odd_texts()
    short = [(i, t) for i, t in texts if len(t or "") < 20_000]
    got = sorted((repr(r["doc_id"]), *r[1:5]) for r in suffix.removal_report(make_docs(spark, short)).collect())
    assert got == sorted((repr(i), *x) for (i, _), x in zip(short, removed_by_hand([t for _, t in short])))
    assert suffix.removal_report(odd).count() == len(texts) and suffix.removal_report(empty).count() == 0
    cut = suffix.cut_texts(odd)
    assert cut.columns == odd.columns and cut.count() == len(texts)


def test_refine_is_exact():
    r = random.Random(5)
    for _ in range(30):
        members = ["".join(r.choice("ab") for _ in range(r.randrange(8, 60))).encode() for _ in range(6)]
        ends = np.cumsum([len(m) for m in members])
        for length in (8, 9, 13, 20):
            strings = [(m[i : i + length], int(ends[k]) - len(m) + i) for k, m in enumerate(members) for i in range(len(m) - length + 1)]
            seen = Counter(s for s, _ in strings)
            assert suffix.refine(b"".join(members), ends, length).tolist() == [p for s, p in strings if seen[s] > 1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie notice"><p>We use cookies.</p></div><article><h1>Head &amp; line</h1><p>First&nbsp;one,
 with <b>bold</b> text.<p>Second one follows here.</p><div class="ad">Buy this now.</div><p>Third &lt;one&gt; ends.</p></article><aside class="sidebar"><p>Read more of this.</p></aside>
<section class="comments"><div class="comment"><p>Nice article, thank you.</p></div></section><form><label>Mail</label></form><footer>&copy; 2024 someone</footer></body></html>"""


def test_pages(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGE, "clash", 1), (2, None, None, None, None), (None, "u", "", "", 0), (3, "u", PAGE[:900], "", 0), (3, "u", PAGE[:900], "", 0), (4, "u", "<", "", 0), (5, "u", "<p>" + "many words here. " * 20_000, "", 0)]
    pages = spark.createDataFrame(rows, schema)
    chain = html.train(spark.read.parquet(f"{data_dir()}/pages.parquet"))
    got = html.extract(pages, chain).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "Head & line\nFirst one, with bold text.\nSecond one follows here.\nThird <one> ends."
    assert by[2] == "" and by[None] == "" and len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(pages.limit(0)).count() == 0


def test_pages_of_the_given_table(spark):
    import html as entities

    pages = spark.read.parquet(f"{data_dir()}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S).group(1)
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x)


LONG = "The committee met on Tuesday to discuss the new rules for the harbour, and after some hours it came to a decision that surprised most of those who had come to listen."
#: Pages of another make than those that the field is trained on: html with {L} for the long paragraph, and the main text.
OTHER_PAGES = [
    ("<body><nav>Menu</nav><main><h1>T</h1><p>{L}</p><p>{L}</p></main><footer>&copy; 2020 X</footer></body>", "T\n{L}\n{L}"),
    ("<html><head><title>q</title></head><body><nav>Menu</nav><main><h1>T</h1><p>{L}</p></main></body></html>", "T\n{L}"),
    ('<html><body><div id="wrap"><div class="col-md-8"><h1>Big title here</h1><p>{L}</p><p>{L}</p></div></div></body></html>', "Big title here\n{L}\n{L}"),
    ("<p>Only a paragraph.</p>", "Only a paragraph."),
    ("<article><header><h1>My title</h1></header><p>{L}</p><p>Short end.</p></article>", "My title\n{L}\nShort end."),
    ('<table><tr><td><a href="/">Home</a> <a href="/n">News</a></td><td><h1>Title of it</h1><p>{L}</p><p>{L}</p></td></tr></table>', "Title of it\n{L}\n{L}"),
    ('<html><body><table width=100%><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td><p>{L}</p><p>{L}</p></td></tr></table></body></html>', "{L}\n{L}"),
    ('<div><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></div><div><h2>A heading</h2><p>{L}</p><p>{L}</p></div>', "A heading\n{L}\n{L}"),
    ('<div class="page"><div class="left"><h1>Head</h1><p>{L}</p></div><aside><h3>See also</h3><p>{L}</p></aside></div>', "Head\n{L}"),
    ('<body><div class="container"><h1>Head</h1><p>{L}</p><p>{L}</p></div><div id="comments"><p>{L}</p></div></body>', "Head\n{L}\n{L}"),
    ('<body><div class="cookie-banner"><p>We use cookies. {L}</p></div><section><h1>Head</h1><p>{L}</p></section></body>', "Head\n{L}"),
]


def test_pages_of_another_make(spark):
    chain = html.train(spark.read.parquet(f"{data_dir()}/pages.parquet"))
    assert [html.main_text(p.replace("{L}", LONG), chain) for p, _ in OTHER_PAGES] == [x.replace("{L}", LONG) for _, x in OTHER_PAGES]


def test_held_out_blocks():
    chain = html.Chain()
    words = ["Some words make a sentence here.", "Short one.", "Another sentence of several more words, with a comma."]
    chain.learn(html.labelled_pages(words, 320, 1))
    right = total = 0
    for page, labels in html.labelled_pages(words, 80, 2):
        right += sum(a == b for a, b in zip(chain.decode(page), labels))
        total += len(labels)
    assert right >= 0.97 * total


def test_viterbi_is_the_best_path():
    from itertools import product

    chain = html.Chain()
    chain.w = {"bias": 0.2, "words:3": -0.7, "ends": 0.9}
    chain.step = np.array([[0.4, -0.6], [-0.2, 0.3]])
    page = [html.Block(t, ("p",), frozenset(), 0.0) for t in ("One two three four.", "x", "Five six seven", "Eight.")]
    s = chain.scores(page)
    value = lambda p: sum(v * y for v, y in zip(s, p)) + sum(chain.step[a, b] for a, b in zip(p, p[1:]))
    assert value(chain.decode(page)) == pytest.approx(max(value(p) for p in product((0, 1), repeat=4)))


def test_stages_on_an_empty_table(spark, empty):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, "")
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == empty.columns)


def test_pipeline(spark, tmp_path):
    """Stage by stage on odd rows, then run() on the given documents."""
    docs = make_docs(spark, odd_texts() + repeating())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert {"sequence_id", "offset"} <= set(docs.columns)
    packed = corpus_pipeline.run(spark, data_dir())
    assert 0 < packed.select("doc_id").distinct().count() <= 200


def similar_by_hand(texts):
    """Groups of texts by all pairs of their sets of five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return groups([(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])], len(sets))


def edited(seed, n):
    """Texts of which many have copies with one to four words changed."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    out = []
    while len(out) < n:
        w = [word() for _ in range(r.randrange(40, 120))]
        for _ in range(r.choice([1, 3, 60])):
            x = list(w)
            for _ in range(r.randrange(5)):
                x[r.randrange(len(x))] = word()
            out.append(" ".join(x))
    return out[:n]


@pytest.mark.parametrize("split", [4, 32])
def test_near_duplicate_stage_against_all_pairs(spark, split):
    """With a small split nearly every bucket is searched on its sets."""
    texts = list(enumerate(edited(4, 400))) + [(5_000 + k, t) for k, (_, t) in enumerate(odd_texts())] + [(None, "one two three four five six"), (6_000, "One  two three four\nfive six")]
    group = similar_by_hand([t for _, t in texts])
    least = {}
    for (i, _), g in zip(texts, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    docs = make_docs(spark, texts)
    got = near_texts.keep_one(docs, split)
    assert got.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == sorted(map(repr, least.values()))
    if split == 32:
        assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(least.values())
        assert near_texts.keep_one(docs.limit(0)).count() == 0


def test_near_duplicate_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{data_dir()}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    group = similar_by_hand([t for _, t in texts])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [texts[g][0] for g in sorted(set(group))]


def wide(own):
    """256 bits of a set of hashes, bit by bit."""
    whole = (1 << 64) - 1
    ones, first = Counter(), set()
    for n, h in enumerate(own):
        words = [h]
        for k in (1, 2, 3):
            x = (h + 0x9E3779B97F4A7C15 * k) & whole
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
            x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
            words.append(x ^ x >> 31)
        some = {64 * k + b for k, w in enumerate(words) for b in range(64) if w >> b & 1}
        ones.update(some)
        first = first or some
    return {b for b in range(256) if 2 * ones[b] > len(own) or (2 * ones[b] == len(own) and b in first)}


def test_near_duplicate_stage_fingerprints():
    """Of 0 to 600 shingles, past the 255 that a byte counts; ties take the smallest hash's bit."""
    r = random.Random(3)
    for n in (0, 1, 2, 3, 4, 9, 254, 255, 256, 510, 511, 600):
        own = sorted(r.getrandbits(64) for _ in range(n))
        got = near_texts.fingerprint(np.array(own, dtype=np.uint64))
        assert {64 * k + b for k, w in enumerate(got.tolist()) for b in range(64) if w >> b & 1} == (wide(own) if own else set())
    same = near_texts.fingerprint(np.full(2_000, 5, dtype=np.uint64))
    assert (same == near_texts.fingerprint(np.array([5], dtype=np.uint64))).all()


@pytest.mark.parametrize(("n", "large"), [(1, 0), (65, 0), (700, 0), (900, 600), (300, 290)])
def test_near_duplicate_stage_compares_bit_sliced(n, large):
    """Groups of fingerprints within the radius, and one large group, against all pairs."""
    r = np.random.default_rng(n)
    flipped = lambda p, share: p ^ np.packbits(r.random(256) < share, bitorder="little").view(np.uint64)
    prints = r.integers(0, 1 << 64, (n, 4), dtype=np.uint64)
    for k in range(n):
        if k < large:
            prints[k] = flipped(prints[-1], 0.1)
        elif k % 7 > 3:
            prints[k] = flipped(prints[k - 3], r.choice([0.05, 0.15, 0.25]))
    prints = prints[r.permutation(n)]
    differ = np.unpackbits((prints[:, None] ^ prints[None]).view(np.uint8), axis=2, bitorder="little")
    near = (differ[..., : near_texts.PLANES].sum(axis=2) <= near_texts.NEAR) & (differ.sum(axis=2) <= near_texts.RADIUS)
    want = groups(np.argwhere(np.triu(near, 1)).tolist(), n)
    got = near_texts.near_groups(prints)
    assert len(set(zip(want, got.tolist()))) == len(set(want)) == len(set(got.tolist()))


def test_near_duplicate_stage_tables_meet_pairs_at_the_similarity():
    """100,000 pairs of fingerprints that differ as texts of similarity 0.8 do, at the bits of some 200,000 texts."""
    bits = near_texts.key_bits(200_000)
    chosen = [np.random.default_rng([7, t]).permutation(256)[:bits] for t in range(near_texts.tables(bits))]
    differ = np.random.default_rng(5).random((100_000, 256)) < near_texts.PER_BIT
    assert bits == 8 and (differ.sum(axis=1) <= near_texts.RADIUS).all() and (differ[:, : near_texts.PLANES].sum(axis=1) <= near_texts.NEAR).all()
    left = differ
    for c in chosen:
        left = left[left[:, c].any(axis=1)]
    assert len(left) == 0
    # The share of bits itself, by sets of 400 shingles.
    r, shares = np.random.default_rng(6), []
    for _ in range(60):
        h = r.integers(0, 1 << 64, 440, dtype=np.uint64)  # 360 of 440 in both: 0.82
        a, b = np.sort(h[:400]), np.sort(h[40:])
        shares.append(int(np.bitwise_count(near_texts.fingerprint(a) ^ near_texts.fingerprint(b)).sum()) / 256)
    assert 0.12 < np.mean(shares) < near_texts.PER_BIT


def test_near_duplicate_stage_by_tables_of_simhash_bits(spark):
    """Buckets of about 16 texts, so that dozens of tables take part, against all pairs."""
    texts = list(enumerate(edited(9, 500)))
    group = similar_by_hand([t for _, t in texts])
    got = near_texts.keep_one(make_docs(spark, texts), bucket=16)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group))


def test_repeat_stage_cuts_passages_of_51_short_words(spark):
    """51 to 60 words of one to three letters, under 400 bytes, in two documents, with other white space in one; 50 words stay."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 4)))
    texts = []
    for k, n in enumerate([*range(50, 61), 51, 60]):
        passage = [word() for _ in range(n)]
        for half, space in ((0, " "), (1, " \n")):
            own = [f"{k}x{half}y{j}" for j in range(30)]
            texts.append((10 * k + half, " ".join(own[:15]) + " " + space.join(passage) + " " + " ".join(own[15:])))
    texts += [(900, "q" + "u" * 500), (901, "u" * 500 + "r"), (902, None), (903, "")]  # one word of 500 bytes goes too
    split = {i: (t or "").split() for i, t in texts}
    seen = Counter(tuple(w[i : i + 51]) for w in split.values() for i in range(len(w) - 50))
    want = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - 50) if seen[tuple(w[k : k + 51])] > 1 for j in range(k, k + 51)}
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    want[900], want[901] = ["q"], ["r"]
    assert sum(len(w) for w in want.values()) == 26 * 30 + 2 * 50 + 2
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.long_repeats(spark, make_docs(spark, texts), "").collect()}
    assert {i: (t or "").split() for i, t in got.items()} == want and got[902] is None


def test_pages_with_open_heads_and_drawings():
    """</head> left out, elements that close themselves or never close: the text behind them stays; closed ones are hidden."""
    said = lambda page: [b.text for b in html.blocks(page)]
    assert said("<html><head><title>t</title><body><article><p>Hello there.</p></article>") == ["Hello there."]
    assert said("<head><meta charset=utf-8><style>p{}</style><link rel=x><p>One.</p><p>Two.</p>") == ["One.", "Two."]
    assert said("<head><title>t<body><p>One.</p>") == ["One."]
    assert said("<head><title>a <b>c</b></title><script>'<p>'</script></head><p>One.</p>") == ["One."]
    assert said("<head>\n<noscript><link></noscript> Text of the body.") == ["Text of the body."]
    assert said("<p>A</p><svg/><p>Long text.</p>") == ["A", "Long text."]
    assert said('<p>A</p><svg width="1" /><p>Long text.</p><svg><text>no</text></svg><p>B</p>') == ["A", "Long text.", "B"]
    for tag in ("svg", "select", "template", "noscript"):
        assert said(f"<p>A</p><{tag}><p>Long text.</p>") == ["A", "Long text."]
        assert said(f"<p>A</p><{tag}><p>Long text.</p><{tag}>no</{tag}><p>B</p>") == ["A", "Long text.", "B"]
        assert said(f"<p>A</p><{tag}>no<!-- </{tag}> --><{tag}>no</{tag}>no</{tag}><p>B</p>") == ["A", "B"]
    assert said("<p>A</p><script>no<p>no</p>") == ["A"] and said("<p>A</p><iframe>no") == ["A"]
