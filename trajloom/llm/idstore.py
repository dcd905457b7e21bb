"""Token ids in a compressed binary format: independent, checksummed blocks of an adaptive context-mixing range coder.

A segment is one file's content: a header with the documents' ids and lengths and its own CRC-32, then blocks of up to ``BLOCK``
ids, each coded from a fresh model with its own CRC-32 (``idcoder``), so any block is decoded alone.

Executors share no plain folder and Spark has no sink of binary files, so a file in the format is a row (column content) of a
Parquet table in the shared folder, in ascending order of documents: the text is sorted by range, so a partition
is a run of documents, and only its number of ids is needed to place the next.

Texts of characters up to U+00FF are cut into words over whole batches with numpy: classes of bytes, then words as pairs of
64-bit numbers (exact up to 16 bytes; longer words by their bytes) that are looked up in a bounded memory of words met before. Only
new words, and texts with other characters, go through the tokenizers library.

Defined cases: null or empty text has the end id alone; null doc_ids come first, equal ones are ordered by their texts' hash;
an empty table gives no rows; ids up to 65,535; a damaged block raises an error; other columns are left out.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajloom.llm.bpe import _DIGIT, _LETTER, _SPACE
from trajloom.llm.common import whole_text, written
from trajloom.llm.idcoder import BLOCK, decode_block, encode_block

MAGIC = b"TLID3"
SEGMENT = BLOCK - BLOCK // 16  # ids from which a segment ends with the document: mostly one block
MAX_WORDS = 500_000


def pack_segment(docs: pa.Table, ids: np.ndarray) -> bytes:
    """docs: doc_id, n_tokens; ids: of all of them, one after another."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids must be below 65,536")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_table(docs)
    table = zlib.compress(sink.getvalue().to_pybytes(), 6)
    count = -(-len(ids) // BLOCK)
    blocks = [encode_block(part) for part in np.array_split(ids, count)] if count else []  # of nearly equal size
    head = struct.pack("<II", len(table), len(blocks)) + np.array([len(b) for b in blocks], "<u4").tobytes() + table
    return MAGIC + struct.pack("<II", zlib.crc32(head), len(head)) + head + b"".join(blocks)


def read_segment(data: bytes) -> tuple[pa.Table, np.ndarray]:
    if data[:5] != MAGIC:
        raise ValueError("not a segment of ids")
    check, size = struct.unpack_from("<II", data, 5)
    head = data[13 : 13 + size]
    if zlib.crc32(head) != check:
        raise ValueError("a segment's header is damaged")
    n, count = struct.unpack_from("<II", head)
    ends = 13 + size + np.r_[0, np.cumsum(np.frombuffer(head, "<u4", count, 8).astype(np.int64))]
    ids = [decode_block(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    table = pa.ipc.open_stream(pa.py_buffer(zlib.decompress(head[8 + 4 * count :]))).read_all()
    return table, np.concatenate(ids) if ids else np.zeros(0, np.int64)


def _classes() -> np.ndarray:
    """Of each Latin-1 byte: 0 white space, 1 letter, 2 digit, 3 other."""
    kind = lambda c: 0 if re.match(f"[{_SPACE}]", c) else 1 if re.match(f"[{_LETTER}]", c) else 2 if re.match(f"[{_DIGIT}]", c) else 3
    return np.array([kind(chr(k)) for k in range(256)], np.uint8)


_CLASS = _classes()
_PAD = b" " * 24
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
# What follows an apostrophe as a word of its own, one letter or two.
_ONE_LETTER, _TWO_LETTERS = b"stmd", [b"re", b"ve", b"ll"]
_SLOT_BITS = 20


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased Latin-1 text that ends with white space: runs of letters, single digits, runs of others, and endings after an apostrophe."""
    kind = _CLASS.take(data)
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == 2
    starts = np.flatnonzero(edge)
    ends = np.r_[starts[1:], len(data)]
    # An apostrophe that is a run by itself takes its ending from the letters behind it.
    quote = np.flatnonzero((data.take(starts) == 39) & (ends - starts == 1) & (kind.take(np.minimum(ends, len(data) - 1)) == 1))
    if len(quote):
        one, two = data.take(ends[quote]), data.take(ends[quote] + 1)
        size = np.isin(one, np.frombuffer(_ONE_LETTER, np.uint8)).astype(np.int64)
        for x in _TWO_LETTERS:
            size[(one == x[0]) & (two == x[1])] = 2
        quote, size = quote[size > 0], size[size > 0]
        ends[quote] += size
        starts[quote + 1] += size
    some = (kind.take(np.minimum(starts, len(data) - 1)) != 0) & (ends > starts)
    return starts[some], ends[some]


class WordIds:
    """Ids by the tokenizer file, word by word: words met before are kept, ``MAX_WORDS`` at most."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.closes = self._closing()
        self._clear()

    def _closing(self) -> np.ndarray | None:
        """Of each id: whether it ends a word. None where the vocabulary does not tell for every byte."""
        from tokenizers.pre_tokenizers import ByteLevel

        mark, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        if not mark or any(c + mark not in vocab for c in ByteLevel.alphabet()):
            return None
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        return out

    def _clear(self) -> None:
        self.key0, self.key1 = (np.zeros(1 << _SLOT_BITS, np.uint64) for _ in range(2))
        self.at = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.long: dict[bytes, int] = {}
        self.n = 0
        self.first, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.n_ids = 0

    def _slots(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        h = k0 * np.uint64(0x9E3779B97F4A7C15) ^ (k1 + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _find(self, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for new ones."""
        slot = self._slots(k0, k1)
        number = self.at.take(slot)
        wrong = np.flatnonzero((number >= 0) & ((self.key0.take(slot) != k0) | (self.key1.take(slot) != k1)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << _SLOT_BITS) - 1)
            s = slot[wrong]
            number[wrong] = self.at[s]
            wrong = wrong[(self.at[s] >= 0) & ((self.key0[s] != k0[wrong]) | (self.key1[s] != k1[wrong]))]
        return number

    def _insert(self, k0: np.ndarray, k1: np.ndarray, own: np.ndarray) -> None:
        slot, left = self._slots(k0, k1), np.arange(len(own))
        while len(left):
            s = slot[left]
            free = self.at[s] < 0
            self.at[s[free]] = own[left[free]]  # of several for one slot the last stays
            done = free & (self.at[s] == own[left])
            self.key0[s[done]], self.key1[s[done]] = k0[left[done]], k1[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << _SLOT_BITS) - 1)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of new words, whose ids come from the library, many in a call: blanks keep them apart, and tokens tell where a word ends."""
        numbers = np.arange(self.n, self.n + len(words))
        ids, count = [], np.zeros(len(words), np.int64)
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            text = b" ".join(part).decode("latin-1")
            if self.closes is not None:  # the library's call without offsets, which has no word_ids either
                own = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                ends = np.flatnonzero(self.closes.take(own))
                if len(ends) == len(part) and ends[-1] == len(own) - 1:
                    ids.append(own)
                    count[at : at + len(part)] = np.diff(ends, prepend=-1)
                    continue
            found = self.tokenizer.encode(text, add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            count[at : at + len(part)] = np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))
        ids = np.concatenate(ids)
        grown = lambda a, n: np.r_[a, np.zeros(max(n - len(a), len(a)), a.dtype)] if n > len(a) else a
        self.first, self.count, self.ids = grown(self.first, self.n + len(words)), grown(self.count, self.n + len(words)), grown(self.ids, self.n_ids + len(ids))
        self.first[numbers], self.count[numbers] = self.n_ids + np.cumsum(count) - count, count
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(words), self.n_ids + len(ids)
        return numbers

    def _latin(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """texts: lower-cased Latin-1 without zero bytes."""
        if self.n > MAX_WORDS:
            self._clear()
        joined = b"\n".join(texts) + _PAD
        data = np.frombuffer(joined, np.uint8)
        starts, ends = word_bounds(data)
        size = ends - starts
        eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
        k0 = eight[starts] & _MASK.take(np.minimum(size, 8))
        k1 = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(size > 8)
        k1[more] = eight[starts[more] + 8] & _MASK.take(np.minimum(size[more] - 8, 8))
        number = self._find(k0, k1)
        long = np.flatnonzero(size > 16)
        number[long] = [self.long.get(joined[a:b], -1) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        new = np.flatnonzero(number < 0)
        short = new[size[new] <= 16]
        if len(short):
            order = short[np.lexsort((k1[short], k0[short]))]
            first = np.r_[True, (k0[order][1:] != k0[order][:-1]) | (k1[order][1:] != k1[order][:-1])]
            once = order[first]
            own = self._learn([joined[a:b] for a, b in zip(starts[once].tolist(), ends[once].tolist())])
            self._insert(k0[once], k1[once], own)
            number[order] = own[np.cumsum(first) - 1]
        long = new[size[new] > 16]
        if len(long):
            words = [joined[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())]
            once = list(dict.fromkeys(words))
            self.long.update(zip(once, self._learn(once).tolist()))
            number[long] = [self.long[w] for w in words]
        count = self.count.take(number)
        cuts = np.cumsum([len(t) + 1 for t in texts])
        of = np.searchsorted(cuts, starts, "right")
        total = int(count.sum())
        place = np.cumsum(count) - count
        from_ = np.repeat(self.first.take(number) - place, count) + np.arange(total)
        out = np.full(total + len(texts), end_id, np.int32)
        out[np.arange(total) + np.repeat(of, count)] = self.ids.take(from_)
        n = np.bincount(of, weights=count, minlength=len(texts)).astype(np.int64) + 1
        return np.split(out, np.cumsum(n)[:-1])

    def __call__(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, numbers = [], []
        for k, t in enumerate(texts):
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                out[k] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end_id], np.int32)
                continue
            if "\0" in t:
                out[k] = np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end_id], np.int32)
                continue
            plain.append(t.lower().encode("latin-1"))
            numbers.append(k)
        if plain:
            for k, own in zip(numbers, self._latin(plain, end_id)):
                out[k] = own
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_segments(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """A table of segments in ascending order of documents: part, number in the part, ids of the part before it, n_ids, content. docs: doc_id, text."""
    path = tokenizer_path or default_tokenizer()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # never the text: ranges are drawn from a sample of these that goes to the driver
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches):
        encode, number, part, held, before = word_ids(path), 0, 0, 0, 0
        doc_ids: list[pa.Array] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def segment():
            table = pa.table({"doc_id": pa.chunked_array(doc_ids), "n_tokens": pa.array(lengths, pa.int64())})
            content = pack_segment(table, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([content], pa.binary())], ["part", "number", "before", "n_ids", "content"])

        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            for at in range(0, b.num_rows, 256):
                texts = b.column(2).slice(at, 256).to_pylist()
                done = 0
                for k, own in enumerate(encode(texts, end_id)):
                    ids.append(own)
                    lengths.append(len(own))
                    held += len(own)
                    if held >= SEGMENT:
                        doc_ids.append(b.column(1).slice(at + done, k + 1 - done))
                        done = k + 1
                        yield segment()
                        number, before, held = number + 1, before + held, 0
                        doc_ids, lengths, ids = [], [], []
                if done < len(texts):
                    doc_ids.append(b.column(1).slice(at + done, len(texts) - done))
        if lengths:
            yield segment()

    return written(ordered.mapInArrow(run, "part int, number int, before bigint, n_ids bigint, content binary"))


def read_documents(segments: DataFrame, id_type: T.DataType) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the segments."""
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row for each shuffle partition
    begins, total = {}, 0
    for r in sorted(sums):
        begins[r["part"]] = total
        total += r["n"]
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def run(batches):
        for b in batches:
            for part, before, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                docs, ids = read_segment(content.as_py())
                data = memoryview(ids.astype("<u4").tobytes())
                n = docs.column("n_tokens").to_numpy()
                ends = np.cumsum(n)
                checks = [zlib.crc32(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(ends - n + begins[part] + before), pa.array(n), pa.array(checks, pa.int64())], schema.names)

    return segments.select("part", "before", "content").mapInArrow(run, schema)


def store_and_read(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the ids of every text and reads them back: one row for each document."""
    docs = whole_text(docs, "doc_id")
    return read_documents(write_segments(docs, tokenizer_path, end_id), docs.schema["doc_id"].dataType)
