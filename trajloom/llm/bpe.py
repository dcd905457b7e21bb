"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A rank file fixes which token every prefix of a byte string ends in: exactly one token fits behind the
encoding of what is before it, where two neighbouring tokens fit if BPE of their joined bytes is those two.
Reading one byte more therefore fixes one token more, and a token is settled once every place where a
later token can still start has it on its way back. A state is the last settled token and the bytes read
since; those are bounded by the longest token, so lookahead is too. States and transitions are made when
first needed and interned; when there are ``MAX_STATES`` all are dropped and made again, so memory is bounded.

Defined cases: null or empty text has no tokens; repeated rows give repeated results; other columns are
left out; one text is held in memory at a time, its matches and ids piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trajloom.llm.common import whole_text

MAX_STATES = 300_000
MAX_PAIRS = 600_000
MAX_WORDS = 700_000
LOOKAHEAD = 24  # bytes; from then on a state tries to settle tokens

# The letters and digits up to U+00FF, and white space.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_DIGIT = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
#: public_tokenizers.PATTERN for texts without characters over U+00FF, where the plain re module is enough.
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Merges:
    """Ranks, and which two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """Plain BPE of a few bytes: the lowest-ranked neighbours first, leftmost of equals; no further than to ``until`` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best, at = min((self.ranks.get(a + b, len(self.bytes_of)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == len(self.bytes_of):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts that stood at one edge of the token while BPE built it, with the ranks at which each came and went."""
        edges = self._edges[right]
        found = edges.get(token)
        if found is None:
            data, until, found = self.bytes_of[token], len(self.bytes_of), []
            while True:
                since = self.ranks[data] if len(data) > 1 else -1
                found.append((data, since, until))
                if len(data) == 1:
                    break
                halves = self.merge(data, 2)
                data, until = halves[-1 if right else 0], since
            edges[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE of both tokens' bytes is these two: no part at the one's right edge merges with one at the other's left edge in time."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= MAX_PAIRS:
                self._fits.clear()
            known, rank_of = True, self.ranks.get
            for x, came_x, gone_x in self._edge(left, True):
                for y, came_y, gone_y in self._edge(right, False):
                    rank = rank_of(x + y)
                    if rank is not None:
                        at = max(rank, came_x, came_y)
                        if at < gone_x and (at < gone_y or at == gone_y == rank):  # of equal ranks the leftmost merges first
                            known = False
                            break
                if not known:
                    break
            self._fits[left, right] = known
        return known


class Transducer:
    """State k: ``settled[k]``, the last token that is out; ``pending[k]``, the bytes since; ``ends[k]``, the token that ends after each of them.

    An arc is held under state * 256 + byte: the next state, or its complement where the arc gives tokens out.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        self.clear()

    def clear(self) -> None:
        self.settled, self.pending, self.ends = [-1], [b""], [()]
        self.known = {(-1, b""): 0}
        self.arcs: dict[int, int] = {}
        self.given: dict[int, tuple[int, ...]] = {}
        self.final: dict[int, tuple[int, ...]] = {0: ()}

    def _chain(self, ends: tuple[int, ...], at: int) -> list[int]:
        """The tokens up to ``at``, in order."""
        out, bytes_of = [], self.m.bytes_of
        while at:
            out.append(ends[at - 1])
            at -= len(bytes_of[out[-1]])
        return out[::-1]

    def _settled_at(self, data: bytes, ends: tuple[int, ...]) -> int:
        """The last place that every continuation keeps: later tokens start after all of data, or before a beginning of some token."""
        common: set[int] | None = None
        for i in range(len(data) + 1):
            if i == len(data) or data[i:] in self.m.prefixes:
                way, at = {i}, i
                while at:
                    at -= len(self.m.bytes_of[ends[at - 1]])
                    way.add(at)
                common = way if common is None else common & way
        return max(common)

    def _arc(self, s: int, byte: int) -> int:
        data, ends = self.pending[s] + bytes((byte,)), self.ends[s]
        n, m = len(data), self.m
        for i in range(max(0, n - m.longest), n):
            token = m.ranks.get(data[i:])
            if token is not None:
                before = ends[i - 1] if i else self.settled[s]
                if before < 0 or m.fits(before, token):
                    break
        else:
            raise ValueError("the ranks lack a single byte")
        ends, last, out = (*ends, token), self.settled[s], ()
        if n >= LOOKAHEAD and (cut := self._settled_at(data, ends)):
            out = tuple(self._chain(ends, cut))
            last, data, ends = out[-1], data[cut:], ends[cut:]
        to = self.known.get((last, data)) if out else None  # without tokens given out, only this arc leads there
        if to is None:
            to = len(self.settled)
            if out:
                self.known[last, data] = to
            self.settled.append(last)
            self.pending.append(data)
            self.ends.append(ends)
        key = s << 8 | byte
        if out:
            self.given[key] = out
            to = ~to
        self.arcs[key] = to
        return to

    def encode(self, data: bytes) -> list[int]:
        if len(self.settled) >= MAX_STATES:
            self.clear()
        s, out, get = 0, [], self.arcs.get
        for byte in data:
            to = get(s << 8 | byte)
            if to is None:
                to = self._arc(s, byte)
            if to < 0:
                out += self.given[s << 8 | byte]
                to = ~to
            s = to
        last = self.final.get(s)
        if last is None:
            last = self.final[s] = tuple(self._chain(self.ends[s], len(self.pending[s])))
        out += last
        return out


class Decoder:
    """Ids to text, a piece at a time: bytes of a character that is not whole yet wait for the next piece."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.waiting = bytes_of, b""

    @staticmethod
    def whole(data: bytes) -> int:
        """How many bytes end at a character's end: the state of the last lead byte says how many must follow."""
        for back in range(1, min(4, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return len(data)
            if b >= 0xC0:
                needs = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2
                return len(data) - back if back < needs else len(data)
        return len(data)

    def feed(self, ids: Iterable[int]) -> str:
        data = self.waiting + b"".join(map(self.bytes_of.__getitem__, ids))
        k = self.whole(data)
        self.waiting = data[k:]
        return data[:k].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.waiting = self.waiting, b""
        return data.decode("utf-8", "replace")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Texts to ids and back; ids of words met before are kept, ``MAX_WORDS`` at most."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.transducer = Transducer(self.merges)
        self.any = regex.compile(pattern)
        self.words: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        if len(self.words) >= MAX_WORDS:
            self.words.clear()
        ids = self.words[word] = self.transducer.encode(word.encode("utf-8"))
        return ids

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids, some thousands at a time."""
        try:
            text.encode("latin-1")
            matches = LATIN.finditer(text) if len(text) > 1_000_000 else None
            found = LATIN.findall(text) if matches is None else None
        except UnicodeEncodeError:
            matches = self.any.finditer(text) if len(text) > 1_000_000 else None
            found = self.any.findall(text) if matches is None else None
        out: list[int] = []
        get = self.words.get
        for w in found if matches is None else (m.group() for m in matches):
            out += get(w) or self._word(w)
            if len(out) > 65_536:
                yield out
                out = []
        if out:
            yield out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _digest(text: str, c: Codec) -> tuple[int, str, str]:
    n, ids_sha, back_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(c.merges.bytes_of)
    for ids in c.encode(text):
        n += len(ids)
        ids_sha.update(np.array(ids, dtype="<u4").tobytes())
        back_sha.update(decoder.feed(ids).encode("utf-8"))
    back_sha.update(decoder.close().encode("utf-8"))
    return n, ids_sha.hexdigest(), back_sha.hexdigest()


def encode_texts(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids of every text."""
    path, own = default_ranks()
    path, pattern = ranks_path or path, pattern or own
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = [[i for part in c.encode(t) for i in part] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return whole_text(docs, "doc_id").mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path, own = default_ranks()
    path, pattern = ranks_path or path, pattern or own
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            done = [_digest(t.as_py(), c) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return whole_text(docs, "doc_id").mapInArrow(run, schema)
