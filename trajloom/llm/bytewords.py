"""Words of whole Arrow batches in numpy: where they start and end in the batch's bytes, and their hashes, without a Python step per word.

Separators are ASCII bytes, so cutting UTF-8 at them is safe. Work goes on in slices of some ``SLICE`` bytes that end at
a text's end or at a separator: memory doesn't grow with a batch or a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

GAP, BREAK = 1, 2  # kinds of separators: between words, and between pieces of words
SLICE = 4 << 20
CHUNK = 1 << 20  # bytes or words hashed at once
LONG = 1 << 16  # longer words are hashed by xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def kinds(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """A table from bytes to 0 (in a word), GAP or BREAK."""
    out = np.zeros(256, np.uint8)
    out[list(gaps)] = GAP
    out[list(breaks)] = BREAK
    return out


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


_tables: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _tables:
        _tables.extend((_powers(_BASE, CHUNK + LONG + 8), _powers(_INVERSE, CHUNK + LONG + 8)))
    return _tables


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Of a slice: its bytes, its words' starts, ends and hashes, the number of each word's text in the batch and of its piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: none), and where each begins, with the end of the last."""
    col = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(col) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(col) else np.zeros(1, np.int64)


def _slices(data: np.ndarray, at: np.ndarray, table: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Spans that cover the bytes: each ends where a text ends, or behind a separator of at least that kind."""
    begin = 0
    while begin < len(data):
        end = begin + SLICE
        if end >= len(data):
            end = len(data)
        else:
            own = int(at[np.searchsorted(at, end, side="right") - 1])
            if own > begin:
                end = own
            else:
                last = int(at[np.searchsorted(at, end)])  # the end of the text that is longer than a slice
                found = np.flatnonzero(table[data[begin:end]] >= least)
                while not len(found) and end < last:
                    begun, end = end, min(last, end + SLICE)
                    found = np.flatnonzero(table[data[begun:end]] >= least) + (begun - begin)
                end = begin + int(found[-1]) + 1 if len(found) else last
        yield begin, end
        begin = end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Prefix polynomials over the bytes give every word's hash from two places."""
    up, down = _power_tables()
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, side="right")))
        a, b = int(start[at]), int(end[stop - 1])
        if b - a > CHUNK + LONG:  # one very long word
            out[at] = xxhash.xxh64_intdigest(data[a:b].tobytes())
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
            s = start[at:stop] - a
            out[at:stop] = (sums[end[at:stop] - a] - sums[s]) * down[s]
        at = stop
    long = np.flatnonzero(end - start > LONG)
    for i in long.tolist():  # whatever else stood in the chunk
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return mixed(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, by prefix polynomials over the words' hashes."""
    up, down = _power_tables()
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(k, np.uint64)
    for at in range(0, k, CHUNK):
        own = words[at : min(k, at + CHUNK) + n - 1]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=sums[1:])
        m = len(own) - n + 1
        out[at : at + m] = (sums[n:] - sums[:m]) * down[:m]
    return out


def words_of(texts: pa.Array, table: np.ndarray, least: int = BREAK) -> Iterator[Words]:
    """The texts' words, A-Z lowered, slice by slice. A text longer than a slice is cut at separators of the kind ``least`` only."""
    data, at = buffers(texts)
    for begin, end in _slices(data, at, table, least):
        own = LOWER[data[begin:end]]
        kind = table[own]
        inside = kind == 0
        edge = np.zeros(end - begin + 1, bool)
        first = int(np.searchsorted(at, begin, side="right"))
        inner = at[first : int(np.searchsorted(at, end))] - begin
        edge[inner] = True
        edge[0] = edge[-1] = True
        before = np.r_[False, inside[:-1]]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.r_[inside[1:], False]
        stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        text = np.searchsorted(at, start + begin, side="right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == BREAK), start) + text
        yield Words(own, start, stop, word_hashes(own, start, stop), text, piece)


def same_bytes(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the spans a of data and b of other (data too, if not given) hold the same bytes, one by one; none of them is empty."""
    out = a_end - a == b_end - b
    todo = np.flatnonzero(out & (a != b)) if other is None else np.flatnonzero(out)
    other = data if other is None else other
    sizes = (a_end - a)[todo]
    ends = np.cumsum(sizes)
    if max(len(data), len(other)) < 1 << 31:
        a, b = a.astype(np.int32), b.astype(np.int32)
    at = 0
    while at < len(todo):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNK, side="right")))
        own, n = todo[at:stop], sizes[at:stop]
        offsets = np.cumsum(n) - n
        steps = np.arange(int(n.sum()), dtype=a.dtype) - np.repeat(offsets.astype(a.dtype), n)
        differ = data[np.repeat(a[own], n) + steps] != other[np.repeat(b[own], n) + steps]
        out[own] = ~np.logical_or.reduceat(differ, offsets)
        at = stop
    return out


def strings_of(w: Words, at: np.ndarray) -> pa.Array:
    """The words at these places as strings."""
    sizes = w.end[at] - w.start[at]
    ends = np.r_[0, np.cumsum(sizes)]
    data = w.data[np.repeat(w.start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def exact_ids(w: Words, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the words at these places, equal for equal bytes alone, and the words by number."""
    _, first, number = np.unique(w.hash[at], return_index=True, return_inverse=True)
    reps = at[first]
    same = same_bytes(w.data, w.start[at], w.end[at], w.start[reps][number], w.end[reps][number])
    words = strings_of(w, reps)
    if not same.all():  # two words of one hash
        known = {x: i for i, x in enumerate(words.to_pylist())}
        for i in np.flatnonzero(~same).tolist():
            number[i] = known.setdefault(w.bytes_of(int(at[i])).decode("utf-8"), len(known))
        words = pa.array(list(known), pa.string())
    return number, words
