"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page's leaf blocks are its runs of text between block tags, in page order; features are the ancestors'
tags, the words of their class, id and role, and the block's own text. The field is trained here by maximum
likelihood on labelled pages: pages of known make-up, whose parts are labelled as they are put together, filled
with sentences of a bounded sample of ``SAMPLE`` pages (smallest hash first, over all pages; the first ``CHARS`` characters of each).
Made pages come with and without html and body tags, in telling, meaningless and no wrappers, and as tables.

Scripts, styles, comments, head and markup are never text. A head ends at its end tag or at the first tag or text that cannot
stand in one; svg, select, template, noscript and title hide what lies between their tags, but a tag without
an end hides nothing. Character references are decoded, white
space in a block becomes one space, blocks that are main text are joined by a newline.

Defined cases: null or empty html, or html without main text, gives an empty text; a page cut off anywhere is
read as far as it goes; repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.common import hash_sample

SAMPLE = 60
PAGES = 600
CHARS = 4000  # characters of each sampled page

# Tags that begin and end a block, tags without an end.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead title tr ul head iframe label textarea template".split())
HIDDEN = frozenset("svg select template noscript title".split())
IN_HEAD = frozenset("head html title meta link base basefont bgsound noframes script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open tag that a new one of these ends.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
KEPT_TAGS = frozenset("article main section nav header footer aside form table ul ol li p h1 h2 h3 h4 blockquote pre figure figcaption button label dialog details td div".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^<]+)|<", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_ENDING = re.compile(r"[.!?…:;]['\")\]]*$")


def _hidden(tokens: list[re.Match]) -> dict[int, int]:
    """Of each start tag of HIDDEN with an end tag, by number: the end tag's number. Ends belong to the nearest open start."""
    open_at: dict[str, list[int]] = {}
    found = {}
    for k, m in enumerate(tokens):
        name = m.group(3)
        if name is None or name.lower() not in HIDDEN:
            continue
        name = name.lower()
        if m.group(2):
            if open_at.get(name):
                found[open_at[name].pop()] = k
        elif name != "svg" or not m.group(4).rstrip().endswith("/"):
            open_at.setdefault(name, []).append(k)
    return found


def _shown(page: str):
    """The tokens outside hidden elements and the head; None for each stretch left out."""
    tokens = list(_TOKEN.finditer(page))
    hidden = _hidden(tokens)
    in_head = titled = False  # titled: behind a title without an end
    end = -1
    for k, m in enumerate(tokens):
        if k <= end:
            continue
        text, tag = m.group(5), m.group(3)
        name = tag.lower() if tag else ""
        if in_head:
            if text is not None:
                in_head = titled or not text.strip()
            elif tag is None:
                in_head = m.group() != "<" and (m.group(1) is None or m.group(1).lower() in IN_HEAD)
            elif m.group(2):
                in_head = name not in ("head", "body", "html", "br")
            else:
                in_head = name in IN_HEAD
                titled = in_head and (titled or name == "title" and k not in hidden)
            if in_head:
                end = hidden.get(k, end)
                continue
        if k in hidden:
            end = hidden[k]
            yield None
        elif name == "head" and not m.group(2):
            in_head, titled = True, False
            yield None
        else:
            yield m


class Block:
    __slots__ = ("text", "tags", "names", "link")

    def __init__(self, text: str, tags: tuple[str, ...], names: frozenset, link: float):
        self.text, self.tags, self.names, self.link = text, tags, names, link


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), stack[-1][1] if stack else frozenset(), min(1.0, links / len(text))))
            parts.clear()
        links = 0

    for m in _shown(page):
        if m is None:
            parts.append(" ")
            continue
        text = m.group(5)
        if text is not None:
            parts.append(text)
            if in_link:
                links += len(text)
            continue
        tag = m.group(3)
        if tag is None:
            if m.group() == "<":
                parts.append("<")
            elif m.group(1):
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m.group(2) else 1
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if tag == "html":
            continue  # pages with and without this tag are alike
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and tag not in HIDDEN:
            ended = ENDS.get(tag)
            if ended:
                while stack and stack[-1][0] in ended:
                    stack.pop()
            elif tag not in ("button", "label") and stack and stack[-1][0] == "p":
                stack.pop()
            above = stack[-1][1] if stack else frozenset()
            attributes = m.group(4)
            if "=" in attributes:
                found = [w for x in _NAMES.findall(attributes) for w in _WORD.findall((x[0] or x[1] or x[2]).lower())]
                above = above | frozenset(found) if found else above
            stack.append((tag, above))
    flush()
    return out


def features(b: Block) -> list[str]:
    tags = KEPT_TAGS.intersection(b.tags)
    words = b.text.count(" ") + 1
    out = [f"in:{t}" for t in tags]
    out += [f"name:{w}" for w in b.names]
    leaf, size, linked = b.tags[-1] if b.tags else "", min(8, words.bit_length()), int(b.link * 3)
    out += ["bias", f"leaf:{leaf}", f"words:{size}", f"link:{linked}", f"depth:{min(8, len(b.tags))}", f"words-link:{size}:{linked}", f"leaf-words:{leaf}:{size}"]
    if not tags.intersection(("nav", "header", "footer", "aside", "form", "dialog")) and not b.names:
        out += ["bare", f"bare-words-link:{size}:{linked}"]
    out.append("ends" if _ENDING.search(b.text) else "open")
    if b.text[0] in "©|" or "©" in b.text[:24]:
        out += ["copyright", f"copyright-words:{size}"]
    if "article" in tags or "main" in tags:
        out.append("main-in:" + next((t for t in reversed(b.tags) if t in ("article", "main", "nav", "aside", "footer", "header", "form")), ""))
    return out


class Chain:
    """Two labels, 1 for main text; weights by feature for label 1, and of the four steps between labels."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.step = np.zeros((2, 2))

    def scores(self, page: list[Block]) -> list[float]:
        get = self.w.get
        return [sum([get(f, 0.0) for f in features(b)]) for b in page]

    def decode(self, page: list[Block]) -> list[int]:
        s = self.scores(page)
        (t00, t01), (t10, t11) = self.step.tolist()
        zero, one, back = 0.0, s[0], []
        for v in s[1:]:
            a, b = (zero + t00, 0) if zero + t00 >= one + t10 else (one + t10, 1)
            c, d = (zero + t01, 0) if zero + t01 >= one + t11 else (one + t11, 1)
            back.append((b, d))
            zero, one = a, c + v
        label = int(one > zero)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def learn(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 5, rate: float = 0.2, decay: float = 1e-3, seed: int = 11) -> None:
        ready = [([features(b) for b in page], labels) for page, labels in pages if page]
        order = random.Random(seed)
        for epoch in range(epochs):
            order.shuffle(ready)
            rate_now = rate / (1 + epoch)
            for feats, labels in ready:
                n = len(feats)
                s = np.array([[0.0, sum(self.w.get(f, 0.0) for f in fs)] for fs in feats])
                fore, after = np.zeros((n, 2)), np.zeros((n, 2))
                fore[0] = s[0]
                for k in range(1, n):
                    fore[k] = s[k] + np.logaddexp(fore[k - 1][0] + self.step[0], fore[k - 1][1] + self.step[1])
                for k in range(n - 2, -1, -1):
                    after[k] = np.logaddexp(self.step[:, 0] + s[k + 1][0] + after[k + 1][0], self.step[:, 1] + s[k + 1][1] + after[k + 1][1])
                total = np.logaddexp(*fore[-1])
                one = np.exp(fore[:, 1] + after[:, 1] - total)
                for k, fs in enumerate(feats):
                    push = float(labels[k] - one[k])
                    if abs(push) > 1e-4:
                        for f in fs:
                            self.w[f] = self.w.get(f, 0.0) * (1 - rate_now * decay) + rate_now * push
                for k in range(1, n):
                    p = np.exp(fore[k - 1][:, None] + self.step + s[k][None, :] + after[k][None, :] - total)
                    p[labels[k - 1], labels[k]] -= 1
                    self.step -= rate_now * p


# What the parts of the labelled pages are called.
_PARTS = {
    "nav": ['<nav>{links}</nav>', '<nav>{word}</nav>', '<nav><a href="/">{word}</a> <a href="/b">{short}</a></nav>', '<div class="menu">{links}</div>', '<ul id="navigation">{links}</ul>', '<div role="navigation">{links}</div>', '<div class="breadcrumb">{links}</div>'],
    "header": ['<header><h1>{short}</h1><p>{short}</p></header>', '<div class="header">{short}</div>', '<header>{links}<form><label>{word}</label><input></form></header>', '<div id="site-header"><p>{sentence}</p></div>'],
    "footer": ['<footer>&copy; {word} &middot; {sentence}</footer>', '<footer>{short}</footer>', '<footer><p>{sentence}</p>{links}</footer>', '<div class="footer"><p>&copy; {short}</p></div>', '<div id="copyright">{sentence}</div>'],
    "side": ['<aside>{sentence}</aside>', '<aside><h3>{short}</h3><p>{sentence}</p>{links}</aside>', '<div class="sidebar"><h2>{short}</h2><p>{sentence}</p><p>{sentence}</p></div>', '<div class="related">{links}</div>', '<section class="widget"><p>{sentence}</p></section>'],
    "notice": ['<div class="cookie-banner"><p>{sentence} {sentence}</p></div>', '<div class="cookies consent"><p>{sentence} {sentence}</p><p>{sentence}</p></div>', '<div class="cookie notice"><p>{sentence}</p><button>{word}</button></div>', '<div id="cookie-banner">{sentence}</div>', '<div role="alert">{sentence}</div>', '<dialog><p>{sentence}</p></dialog>', '<div class="newsletter popup"><p>{sentence}</p></div>', '<div class="notice">{sentence}</div>'],
    "ad": ['<div class="ad">{sentence}</div>', '<div class="advert"><p>{sentence}</p></div>', '<div class="sponsored promo"><p>{sentence}</p></div>', '<div id="advertisement">{sentence}</div>', '<div class="ads banner">{short}</div>'],
    "form": ['<form><label>{word}</label><p>{sentence}</p><button>{word}</button></form>', '<form class="subscribe"><p>{sentence}</p></form>', '<div class="login"><form><label>{short}</label></form></div>'],
    "comments": ['<section class="comments"><h2>{short}</h2><div class="comment"><p>{sentence}</p></div><div class="comment"><p>{sentence} {sentence}</p></div></section>', '<div id="comments"><ul><li><p>{sentence}</p></li><li><p>{sentence}</p></li></ul></div>', '<div class="discussion comment"><p>{sentence}</p></div>', '<ol class="commentlist"><li class="comment">{sentence}</li></ol>'],
    "share": ['<div class="share social">{links}</div>', '<div class="tags meta">{short}</div>', '<div class="byline author">{short}</div>'],
}
# Parts that say by their make-up alone what they are.
_PLAIN_PARTS = {
    "nav": ['<ul>{links}</ul>', '<div>{links}</div>', '<div><a href="/">{word}</a> <a href="/b">{word}</a> <a href="/c">{word}</a></div>', '<p><a href="/">{word}</a> | <a href="/b">{word}</a></p>'],
    "footer": ['<p>&copy; {word} {short}</p>', '<div>&copy; 2020 {word}. {short}.</div>', '<center>&copy; {short}</center>'],
}
_SHELLS = [("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post entry">', "</div></div>"), ('<section class="article body">', "</section>")]
_PLAIN_SHELLS = [("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ('<div id="wrap"><div class="{any}">', "</div></div>"), ('<div class="{any} {any}">', "</div>"), ('<div class="row"><div class="{any}"><div>', "</div></div></div>"), ("<section>", "</section>")]
_CELLS = ['<a href="/">{word}</a><br><a href="/n">{word}</a>', '<a href="/">{word}</a> <a href="/n">{word}</a> <a href="/m">{word}</a>', '<p><a href="/">{word}</a></p><p><a href="/n">{short}</a></p>', "{links}"]
_STARTS = ["<html><head><title>t</title></head><body>", "<html><body>", "<!DOCTYPE html><body>", "", "<div>"]
# Fixed value: names that say nothing.
_ANY = ["col", "row", "container", "wrap", "inner", "box", "block", "grid", "x", "page", "left", "wide"]


def labelled_pages(sentences: list[str], count: int = PAGES, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages put together from parts; a block's label is whether its part is the main text."""
    r = random.Random(seed)
    out = []

    def fill(pattern: str) -> str:
        words = lambda: r.choice(sentences).split() or ["text"]
        links = lambda: "<ul>" + "".join(f'<li><a href="/{k}">{entities.escape(" ".join(words()[: r.randint(1, 3)]))}</a></li>' for k in range(r.randint(2, 7))) + "</ul>"
        page = re.sub(r"\{links\}", lambda _: links(), pattern)
        page = re.sub(r"\{sentence\}", lambda _: entities.escape(" ".join(words()[: r.randint(3, 40)])), page)
        page = re.sub(r"\{short\}", lambda _: entities.escape(" ".join(words()[: r.randint(2, 6)])), page)
        page = re.sub(r"\{any\}", lambda _: r.choice(_ANY) + r.choice(["", "-8", "-md-8", "2", ""]), page)
        return re.sub(r"\{word\}", lambda _: entities.escape(words()[0]), page)

    def main() -> str:
        kinds = ["<p>{sentence} {sentence}</p>"] * 5 + ["<p>{short}</p>", "<p>{word}.</p>", "<h2>{short}</h2>", "<ul><li>{sentence}</li><li>{short}</li></ul>", "<blockquote><p>{sentence}</p></blockquote>", "<p><b>{sentence}<br><p>{sentence}</p>", "<pre>{short}</pre>", "<table><tr><td>{short}</td><td>{word}</td></tr></table>", "<figure><figcaption>{short}</figcaption></figure>"]
        title = r.choice(["<h1>{short}</h1>"] * 3 + ["<h2>{short}</h2>", "<header><h1>{short}</h1></header>", ""])
        return title + "".join(r.choice(kinds) for _ in range(r.randint(1, 9)))

    def table_page() -> list[tuple[str, int | None]]:
        """A page laid out as a table: a cell of links, a cell of text."""
        cell = ("<td>", None), (r.choice(_CELLS), 0), ("</td>", None)
        text = ("<td>", None), (main(), 1), ("</td>", None)
        rows = [*cell, *text] if r.random() < 0.7 else [*text, *cell]
        top = [("<tr><td colspan=2>", None), (r.choice(["{short}", "<h1>{short}</h1>", "{word}"]), 0), ("</td></tr>", None)] if r.random() < 0.3 else []
        return [("<table>", None), *top, ("<tr>", None), *rows, ("</tr></table>", None)]

    def parts(kind: str) -> str:
        own = r.choice(_PLAIN_PARTS[kind] if kind in _PLAIN_PARTS and r.random() < 0.5 else _PARTS[kind])
        return f'<div class="{{any}}">{own}</div>' if r.random() < 0.15 else own

    for number in range(count):
        often = r.choice([0.5, 0.5, 0.3, 0.1, 0.0])
        before = [parts(k) for k in ("notice", "header", "nav", "ad", "share") if r.random() < often]
        inside = [parts(k) for k in ("ad", "share", "form", "comments", "side") if r.random() < 0.4 * often]
        behind = [parts(k) for k in ("comments", "side", "form", "ad", "nav", "notice", "footer") if r.random() < often]
        r.shuffle(before)
        a, b = r.choice(_SHELLS if r.random() < 0.5 else _PLAIN_SHELLS)
        k = len(inside) // 2
        pieces = [(x, 0) for x in before] + [(a, None), (main(), 1)] + [(x, 0) for x in inside[:k]] + ([(main().partition("</h1>")[2], 1)] if k else []) + [(x, 0) for x in inside[k:]] + [(b, None)] + [(x, 0) for x in behind]
        if number % 8 == 0:
            pieces = [(x, 0) for x in before[:1]] + table_page() + [(x, 0) for x in behind[-1:]]
        elif number % 8 == 1:  # hardly more than the text
            lone = ["<p>{sentence}</p>", "<p>{short}.</p>", "<div>{sentence}</div>", "{sentence}", "<h1>{short}</h1><p>{sentence}</p>", "<p>{sentence}</p><p>{sentence}</p>"]
            pieces = [(r.choice(lone), 1)] + [(r.choice(_PLAIN_PARTS["footer"]), 0)] * (r.random() < 0.4)
        page, labels = r.choice(_STARTS), []
        for pattern, label in pieces:
            own = fill(pattern)
            n = len(blocks(page + own)) - len(labels)
            labels += [label or 0] * n
            page += own
        found = blocks(page)
        out.append((found, labels[: len(found)] + [0] * (len(found) - len(labels))))
    return out


def train(pages: DataFrame, sample: int = SAMPLE, chars: int = CHARS) -> Chain:
    """A chain trained on labelled pages with sentences of at most ``sample`` pages (column html), of the first ``chars`` characters of each."""
    sentences = [b.text for x in hash_sample(pages.select(F.substring("html", 1, chars)), sample) for b in blocks(x) if b.link == 0] or ["Some text."]
    chain = Chain()
    chain.learn(labelled_pages(sentences))
    return chain


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, keep in zip(found, chain.decode(found)) if keep) if found else ""


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    chain = chain or train(pages)
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py(), chain) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.mapInArrow(run, schema)
