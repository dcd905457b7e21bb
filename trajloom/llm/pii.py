"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

Base spans (email, ip, card, phone) are leftmost and non-overlapping within a kind, found in linear time.
The field works on atoms (cores of white-space pieces, and the punctuation around them). A candidate segment
has at most ``MAX_ATOMS`` atoms and a digit or an @, and if it has several atoms at most ``MAX_CHARS`` characters; a single atom
may be of any length, and windows end at white space, so no span is cut. Other atoms are outside. Whole-span features score it for each kind; dynamic programming over segment ends chooses
boundaries and kinds together. Text without a digit or @ near can't hold a segment and is skipped, exactly.

It is trained here by maximum likelihood (forward-backward) on a bounded sample of ``SAMPLE`` windows, smallest hash first, over
all documents, and on as many made from them: in the made ones numbers that people are known by (social security, passport,
account), secrets and spellings of the base kinds stand behind words that announce them or behind other words, and the makers' labels,
not the patterns, say what they are. Sampled windows are labelled by the fixed patterns and a pattern for assigned secrets.
Windows of more than ``WIDTH`` characters are several examples. Beside the patterns' verdicts, features are shapes, and the words in front.
An added span may hold or cross base ones, which stay; one within a base span is not added. Redaction covers them all together.

Defined cases: null or empty text has no spans; repeated rows give repeated results; a table without
any window leaves the field untrained and adds nothing; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.common import hash_sample, whole_text

KINDS = ["email", "ip", "card", "phone", "secret", "id"]
BASE = KINDS[:4]
SAMPLE = 300
WIDTH = 600  # characters of a training window
MAX_ATOMS = 8
MAX_CHARS = 96
NEAR = 60  # characters of text around a digit or @ that a window takes in

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{16,}")
_TRIGGER = re.compile(r"[0-9@]")
_PIECE = re.compile(r"\S+")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"[A-Za-z]+")
_OPENING, _CLOSING = "\"'([{<", ".,;:!?)\"']}>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k & 1:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Between one @ and the next lies all that can be a local part, so each character is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), ordered by start, then kind as listed."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and _card_ok(m.group())]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around digits and @, apart from one another, each widened to white space on both sides."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if m.end() + NEAR <= end:
            continue
        a, b = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if a > end:
            if end >= 0:
                yield start, end
            start = end = max(end + 1, _back(text, a, end + 1))
        if b > end:
            space = _SPACE.search(text, b)
            end = space.start() if space else len(text)
    if end >= 0:
        yield start, end


def _back(text: str, at: int, stop: int) -> int:
    """The start of the piece that ``at`` is in, not before ``stop``."""
    while at > stop:
        part = text[max(stop, at - 256) : at]
        spaces = [m.end() for m in _SPACE.finditer(part)]
        if spaces:
            return at - len(part) + spaces[-1]
        at -= len(part)
    return at


def atoms(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Cores of the pieces and the punctuation on either side of them."""
    out = []
    for m in _PIECE.finditer(text, start, end):
        piece = m.group()
        a = m.start() + len(piece) - len(piece.lstrip(_OPENING))
        b = a + len(text[a : m.end()].rstrip(_CLOSING))
        out += [(x, y) for x, y in ((m.start(), a), (a, b), (b, m.end())) if x < y]
    return out


_HEX = re.compile(r"[0-9A-Fa-f]{24,}|[A-Za-z0-9_/+-]{32,}")
_KEYWORD = re.compile(r"(?i)(token|secret|password|passwd|api_?key)\b")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")


def features(text: str, a: int, b: int, n_atoms: int) -> list[str]:
    """Of the whole span."""
    s = text[a:b]
    d = _digits(s)
    letters = sum(c.isalpha() for c in s)
    out = ["bias", f"digits{min(len(d), 20) // 2}", f"atoms{min(n_atoms, 5)}", f"letters{min(4, letters * 5 // len(s))}", "starts" + ("d" if s[0].isdigit() else "+" if s[0] == "+" else "a" if s[0].isalpha() else "p"), "ends" + ("d" if s[-1].isdigit() else "a" if s[-1].isalpha() else "p")]
    if "@" in s:
        out.append("mail" if _MAIL.fullmatch(s) else "at")
    if _IP.fullmatch(s):
        out.append("ip" if _ip_ok(s) else "four")
    if _CARD.fullmatch(s):
        out.append("luhn" if _card_ok(s) else "number")
    if _PHONE.fullmatch(s):
        out.append("phone" if 9 <= len(d) <= 15 else "plus")
    if _HEX.search(s):
        out.append("key-named" if _KEYWORD.match(s) else "key")
    elif _KEYWORD.match(s):
        out.append("named")
    if len(s) <= 40:
        shape = re.sub(r"([A9a])\1+", r"\1+", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s))
        out += [f"shape:{shape}", f"size:{len(s) // 2}"]
    out += [f"before:{w.lower()}" for w in _WORD.findall(text, max(0, a - 28), a)[-3:] if len(w) > 1]
    if a and not text[a - 1].isspace():
        out.append("glued")
    if b < len(text) and (text[b].isalnum() or text[b] in "@-"):
        out.append("runs-on")
    return out


def segments(text: str, where: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
    """By end atom (exclusive): (first atom, features) of the candidate segments."""
    out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(where) + 1)]
    for i in range(len(where)):
        for j in range(i + 1, min(len(where), i + MAX_ATOMS) + 1):
            a, b = where[i][0], where[j - 1][1]
            if b - a > MAX_CHARS and j > i + 1:
                break
            if _TRIGGER.search(text, a, b):
                out[j].append((i, features(text, a, b, j - i)))
    return out


class Field:
    """Weights by (kind, feature); outside atoms score 0."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.w = weights or {k: {} for k in KINDS}

    def score(self, kind: str, feats: list[str]) -> float:
        get = self.w[kind].get
        return sum(get(f, 0.0) for f in feats)

    def decode(self, text: str, where: list[tuple[int, int]]) -> list[tuple[int, str, int]]:
        """Best segmentation: (start, kind, end) of its entities."""
        lattice = segments(text, where)
        best, back = [0.0] * (len(where) + 1), [None] * (len(where) + 1)
        for j in range(1, len(where) + 1):
            best[j] = best[j - 1]
            for i, feats in lattice[j]:
                for kind in KINDS:
                    v = best[i] + self.score(kind, feats)
                    if v > best[j]:
                        best[j], back[j] = v, (i, kind)
        out, j = [], len(where)
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((where[i][0], kind, where[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[int, str, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3, seed: int = 7) -> None:
        """Stochastic gradient ascent on the log-likelihood of labelled windows."""
        ready = []
        for text, spans in examples:
            where = atoms(text, 0, len(text))
            starts, ends = {a: k for k, (a, _) in enumerate(where)}, {b: k + 1 for k, (_, b) in enumerate(where)}
            gold = {(starts[a], ends[b]): kind for a, kind, b in spans if a in starts and b in ends}
            ready.append((where, segments(text, where), gold))
        order = random.Random(seed)
        for epoch in range(epochs):
            order.shuffle(ready)
            step = rate / (1 + epoch)
            for where, lattice, gold in ready:
                n = len(where)
                scores = [[(i, f, [self.score(k, f) for k in KINDS]) for i, f in lattice[j]] for j in range(n + 1)]
                fore = [0.0] + [-math.inf] * n
                for j in range(1, n + 1):
                    fore[j] = _sum_exp([fore[j - 1], *(fore[i] + v for i, _, vs in scores[j] for v in vs)])
                after = [-math.inf] * n + [0.0]
                for j in range(n, 0, -1):
                    after[j - 1] = _sum_exp([after[j - 1], after[j]])
                    for i, _, vs in scores[j]:
                        after[i] = _sum_exp([after[i], *(after[j] + v for v in vs)])
                for j in range(1, n + 1):
                    for i, feats, vs in scores[j]:
                        for kind, v in zip(KINDS, vs):
                            push = (gold.get((i, j)) == kind) - math.exp(min(0.0, fore[i] + v + after[j] - fore[n]))
                            if abs(push) > 1e-4:
                                w = self.w[kind]
                                for f in feats:
                                    w[f] = w.get(f, 0.0) * (1 - step * decay) + step * push


def _sum_exp(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


# Words that announce a kind.
_ANNOUNCED = {
    "id": ["SSN", "social security number", "passport number", "passport no", "IBAN", "account number", "tax id", "national id", "driver license", "insurance number"],
    "secret": ["token =", "secret:", "password =", "api_key =", "key:", "passwd:", "access token", "credential ="],
    "card": ["card", "credit card number", "visa", "paid with"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
    "email": ["mail", "contact", "write to"],
    "ip": ["host", "server", "address"],
}
_PLAIN = ["page", "order", "line", "section", "version", "in", "of", "about", "number", "item", "year", "room", "step", "chapter", "total", "build"]


def _made(r: random.Random, kind: str) -> str:
    """A value of the kind; of none: a number that is nobody's."""
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    upper = lambda n: "".join(r.choice(string.ascii_uppercase) for _ in range(n))
    if kind == "id":
        return r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{upper(1)}{digits(8)}", f"{upper(2)}{digits(7)}", f"{upper(2)}{digits(2)} " + " ".join(digits(4) for _ in range(4)) + f" {digits(2)}", f"{upper(2)}{digits(20)}", digits(9)])
    if kind == "secret":
        names = string.ascii_letters + string.digits
        return r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))), "".join(r.choice(names + "_-") for _ in range(r.randint(20, 90))) + digits(1)])
    if kind == "card":
        body = digits(15)
        whole = next(body + c for c in string.digits if luhn(body + c))
        return r.choice([whole, "-".join(whole[k : k + 4] for k in (0, 4, 8, 12)), " ".join(whole[k : k + 4] for k in (0, 4, 8, 12))])
    if kind == "phone":
        return r.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(11)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
    if kind == "email":
        word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 8)))
        return f"{word()}.{word()}@{word()}.{r.choice(['com', 'org', 'net'])}"
    if kind == "ip":
        return ".".join(str(r.randrange(256)) for _ in range(4))
    return r.choice([digits(r.randint(1, 6)), f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(2)},{digits(3)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{upper(1)}{digits(2)}", f"{digits(2)}%", f"{digits(9)}", f"{digits(3)}-{digits(3)}"])


def made_windows(texts: list[str], count: int, seed: int) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """count labelled windows: words of the texts around announced values, and plain numbers among them."""
    r = random.Random(seed)
    words = [w for x in texts for w in x.split() if not _TRIGGER.search(w)] or ["some", "text"]
    out = []
    for _ in range(count):
        kind = r.choice([*_ANNOUNCED, "id", "secret", "", "", ""])
        before = " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
        said = r.choice(_ANNOUNCED[kind]) if kind else r.choice(_PLAIN)
        value = _made(r, kind)
        joint = r.choice([" ", ": ", " is "]) if said[-1] not in "=:" else " "
        quote = '"' if kind == "secret" and r.random() < 0.4 else ""
        start = f"{before} {said}{joint}{quote}"
        text = start + value + quote + r.choice(["", ".", ","]) + " " + " ".join(r.choice(words) for _ in range(r.randint(1, 5)))
        out.append((text, [(len(start), kind, len(start) + len(value))] if kind else []))
    return out


def _labelled(text: str) -> list[tuple[int, str, int]]:
    """What the fixed patterns and that of assigned secrets find."""
    spans, end = [], 0
    for a, kind, b in sorted(base_spans(text) + [(m.start(), "secret", m.end()) for m in _SECRET.finditer(text)]):
        if a >= end:
            spans.append((a, kind, b))
            end = b
    return spans


def _pieces(text: str, width: int) -> list[str]:
    """The text, or where it is longer than width, parts of it that end at white space (at width, where there is none)."""
    out = []
    while len(text) > width:
        cut = max(text.rfind(x, 1, width) for x in " \n\t")
        cut = cut if cut > 0 else width
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def train(docs: DataFrame, sample: int = SAMPLE, width: int = WIDTH) -> Field:
    """A field from at most ``sample`` windows of docs (column text), those of the smallest hash, alike ones once, and from twice as many made ones. A window of more than ``width`` characters is several."""
    def run(batches):
        for b in batches:
            out = []
            for t in b.column(0):
                text = t.as_py()
                if _TRIGGER.search(text):
                    out += [x for a, z in windows(text) for x in _pieces(text[a:z], width)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["w"])

    texts = hash_sample(docs.mapInArrow(run, "w string"), sample)
    if not texts:
        return Field()
    field = Field()
    field.learn([(x, _labelled(x)) for x in texts] + made_windows(texts, 2 * sample, 3))
    return field


def find(text: str, field: Field) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added, k = [], 0
    for a, b in windows(text):
        for x, kind, y in field.decode(text, atoms(text, a, b)):
            while k < len(base) and base[k][2] <= x:
                k += 1
            if not any(p <= x and y <= q for p, _, q in base[k : k + 8]):  # more than a part of a base span
                added.append((x, kind, y))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (s[0], order[s[1]])) if added else base


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def pii_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all spans)."""
    docs = whole_text(docs, "doc_id")
    field = field or train(docs.select("text"))
    counts = [f"n_{k}" for k in BASE]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1):
                base, every = find(t.as_py(), field)
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], pa.string() if i in (4, 5) else pa.int64()) for i in range(7))], schema.names)

    return docs.mapInArrow(run, schema)


def redact(text: str, field: Field) -> str:
    """The text with each span, or stretch of overlapping spans, replaced by its first kind in angle brackets."""
    _, spans = find(text, field)
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact_texts(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data replaced in text, and n_chars (where there is one) counted anew; a null text stays null."""
    field = field or train(whole_text(docs).select("text"))

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, field) for t in texts], dtype=object)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
