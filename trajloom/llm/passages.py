"""Bytes in passages of so many words that start twice or more, whatever their bytes and white space: by fingerprints in numpy.

Equal passages choose the same run of ``GRAM`` words (the one of the least hash). Chosen runs that occur twice set bits in a table
of a fixed size; passages whose run is marked have their own fingerprints counted likewise, and those that
occur twice set bits in a second table. A last pass over the texts reads which passages are marked. Tables have ``phrases.BITS``
bits: a passage that shares a chosen run with another one, without being repeated, is counted by mistake with the share of bits that are set; no repeated one is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajloom.llm.bytewords import gram_hashes, kinds, mixed, words_of
from trajloom.llm.phrases import DOCS_A_RANGE, bits_of, is_set, packed_ranges

KINDS = kinds(b" \t\n\x0b\x0c\r")
GRAM = 16
WHOLE = 3  # no separator is of this kind: texts aren't cut


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each run of width values, by doubling."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = best(out[:-step], out[step:])
        done += step
    return out


def _chosen(w, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of GRAM words, the least of each passage, and whether the passage lies in one text."""
    runs = mixed(gram_hashes(w.hash, GRAM))
    if len(w.hash) < words:
        return runs, runs[:0], np.zeros(0, bool)
    least = _sliding(runs, words - GRAM + 1, np.minimum)
    return runs, least, w.text[: len(least)] == w.text[words - 1 :]


def _runs(words: int):
    def of(w):
        runs, least, valid = _chosen(w, words)
        if not valid.any():
            return runs[:0]
        width = words - GRAM + 1
        around = np.concatenate([np.zeros(width - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
        return runs[(_sliding(around, width, np.maximum) == runs) & (runs != 0)]

    return of


def _marked(w, words: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the passages whose chosen run is marked, and their fingerprints."""
    _, least, valid = _chosen(w, words)
    at = np.flatnonzero(valid & is_set(table, least)) if len(least) else np.zeros(0, np.int64)
    return at, mixed(gram_hashes(w.hash, words)[at]) if len(at) else np.zeros(0, np.uint64)


def _table(texts: DataFrame, range_bits: int, of, held):
    """Bits of the fingerprints that ``of`` (words, table held in a broadcast) gives twice or more."""

    def run(batches):
        table = np.frombuffer(held.value, np.uint8) if held else None
        yield from packed_ranges((of(w, table) for b in batches for w in words_of(b.column(0), KINDS, WHOLE)), range_bits)

    return bits_of(texts.mapInArrow(run, "range int, fps binary, counts binary"), 2)


def tables(docs: DataFrame, words: int):
    """Both tables, as broadcasts of a fixed size. docs: text."""
    texts = docs.select("text")
    range_bits = max(10, (docs.count() // DOCS_A_RANGE).bit_length())
    first = _runs(words)
    runs = _table(texts, range_bits, lambda w, _: first(w), None)
    return runs, _table(texts, range_bits, lambda w, table: _marked(w, words, table)[1], runs)


def passage_bytes(texts: pa.Array, words: int, runs: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Of each text the bytes in marked passages."""
    out = np.zeros(len(texts), np.int64)
    for w in words_of(texts, KINDS, WHOLE):
        at, fps = _marked(w, words, runs)
        at = at[is_set(passages, fps)]
        if not len(at):
            continue
        own = np.flatnonzero(np.r_[True, (at[1:] >= at[:-1] + words) | (w.text[at[1:]] != w.text[at[:-1]])])  # apart from the ones before
        start, end = w.start[at[own]], w.end[at[np.r_[own[1:] - 1, len(at) - 1]] + words - 1]
        out += np.bincount(w.text[at[own]], weights=end - start, minlength=len(texts)).astype(np.int64)
    return out


