"""Adaptive context-mixing range coder of token ids, a block at a time.

A block starts from a fresh model. Its header has the block's own ids with the lengths of a 128-ary Huffman code, so an id is
coded as a path of one or two digits, rarely more. For each digit three predictions are mixed: order 0 (counts at the path's node), order 1
(counts at the node after the last id) and order 2 (the id that last followed the last two ids, with how often it has been
right). The weights of the mixture are learned, one set for each pair of (how sure order 2 is, how much order 1
has seen). The mixed shares drive a range coder.

Counts grow with every digit, but predictions are read from tables of running sums, which are made anew for the rows that have
changed whenever the number of ids learned has grown by ``GROW``. So the shares below a digit and below the next one come from
two places in each table, whatever the number of digits, and a digit is found by halving. Order 2 learns at every id.

A block's ids are dealt to lanes, runs of equal length that are coded in step, one id of each lane at a time. All lanes share one model
and all teach it, so a block of a million ids costs a few hundred numpy steps but learns as one stream. Every lane has a range
coder of its own. Arithmetic is on integers, on whole numbers below 2^24 in floats, and on floats element by element or in index order
alone, so that every machine decodes what any machine wrote.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

BLOCK = 1 << 21
LANES = 8192
RUN = 256  # ids a lane at least
BITS = 7  # of a digit
RADIX = 1 << BITS
WIDE = RADIX + 1  # places of a row of running sums
ROWS = 14  # bits of rows of order 1
SLOTS = 18  # bits of slots of order 2
SURE = 8  # classes of confidence
SEEN = 8
EARLY, EVERY = 32, 8  # weights learn at every id at first, later at every eighth
GROW = 1.5
SHARES = 1 << 16
SCALE = np.float32(SHARES - RADIX - 64)  # the rest: one share for each digit, and room for rounding

_TOP, _FULL = 1 << 32, (1 << 48) - 1
# Confidence after a wrong guess and after a right one.
_SURER = np.array([[k >> 1, min(k + 1, SURE - 1)] for k in range(SURE)]).ravel()


def _lengths(counts: np.ndarray) -> np.ndarray:
    """Digits of each symbol in a Huffman code of ``RADIX`` digits, at least one."""
    n = len(counts)
    parent = list(range(n))
    heap = [(int(c), k) for k, c in enumerate(counts.tolist())]
    while (len(heap) - 1) % (RADIX - 1) or len(heap) < 2:
        heap.append((0, len(parent)))
        parent.append(len(parent))
    heapq.heapify(heap)
    while len(heap) > 1:
        part = [heapq.heappop(heap) for _ in range(RADIX)]
        own = len(parent)
        parent.append(own)
        for _, k in part:
            parent[k] = own
        heapq.heappush(heap, (sum(c for c, _ in part), own))
    depth = np.zeros(len(parent), np.int64)
    for k in range(len(parent) - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


class Tree:
    """The canonical code: digit and node of each symbol at each depth; child of each node and digit (below 0: -1 - symbol)."""

    def __init__(self, lengths: np.ndarray):
        order = np.lexsort((np.arange(len(lengths)), lengths))
        deepest = int(lengths.max())
        self.length = lengths
        self.digit = np.zeros((deepest, len(lengths)), np.int64)
        self.node = np.zeros((deepest, len(lengths)), np.int64)
        self.child = [[-1] * RADIX]
        path, before = [], 0
        for s in order.tolist():
            size = int(lengths[s])
            if path:  # the next code of the last one's length, then digits 0 down to this one's length
                k = len(path) - 1
                while path[k] == RADIX - 1:
                    path[k] = 0
                    k -= 1
                path[k] += 1
            path += [0] * (size - before)
            before, at = size, 0
            for d in range(size):
                self.digit[d, s], self.node[d, s] = path[d], at
                if d == size - 1:
                    self.child[at][path[d]] = -1 - s
                else:
                    if self.child[at][path[d]] == -1:
                        self.child[at][path[d]] = len(self.child)
                        self.child.append([-1] * RADIX)
                    at = self.child[at][path[d]]
        self.child = np.array(self.child, dtype=np.int64)
        # Digits that a node has, so that shares go to no others.
        self.used = np.zeros(self.child.shape, np.float32)
        for d in range(deepest):
            some = np.flatnonzero(lengths > d)
            self.used[self.node[d, some], self.digit[d, some]] = 1


class Model:
    """Shared by the lanes of one block. ``weigh``: which of orders 1 and 2 take part, for measuring what each brings.

    For each digit ``look`` comes first; then ``find`` (when decoding), ``span`` and ``learn``.
    """

    def __init__(self, tree: Tree, weigh: tuple[int, int] = (1, 1)):
        self.digits = np.ascontiguousarray(tree.digit)
        # Of orders 0 and 1: counts by row and digit, their running sums as parts of 1, rows that have changed since.
        rows = len(tree.used), 1 << ROWS
        self.counts = tree.used.copy(), np.zeros((rows[1], RADIX), np.float32)
        self.sums = tuple(np.zeros((n, WIDE), np.float32) for n in rows)
        self.changed = np.ones(rows[0], bool), np.zeros(rows[1], bool)
        self.zero, self.one = (x.reshape(-1) for x in self.counts)
        self.below0, self.below1 = (x.reshape(-1) for x in self.sums)
        self.seen = np.zeros(rows[1], np.int64)
        self.guess = np.full(1 << SLOTS, -SURE, np.int32)  # symbol (-1: none) and confidence
        self.age, self.due = 0, 1
        # Weights by depth, confidence of order 2 (0: silent) and what order 1 has seen (0: nothing).
        start = np.zeros((3, SURE + 1, SEEN, 2), np.float32)
        start[..., 0], start[..., 1] = np.linspace(0.0, 0.9, SEEN), np.linspace(0.0, 0.7, SURE + 1)[:, None]
        start[..., 0] *= np.float32(1) - start[..., 1]
        self.w1, self.w2 = (start[..., k].ravel() * np.float32(weigh[k]) for k in (0, 1))
        self._scale()
        self._refresh()

    def _scale(self) -> None:
        """Weights as shares; order 2's are whole."""
        self.s0 = np.maximum(np.float32(1) - self.w1 - self.w2, np.float32(2e-4)) * SCALE
        self.s1, self.s2 = self.w1 * SCALE, (self.w2 * SCALE).astype(np.int64)

    def _refresh(self) -> None:
        for counts, sums, changed in zip(self.counts, self.sums, self.changed):
            rows = np.flatnonzero(changed)
            changed[rows] = False
            own = np.cumsum(counts.take(rows, axis=0), axis=1)
            total = own[:, -1].copy()
            own *= (np.float32(1) / total)[:, None]
            sums[rows, 1:] = own
        self.seen[rows] = np.minimum(np.frexp(total)[1], SEEN - 1)

    def begin(self, last: np.ndarray, before: np.ndarray) -> None:
        """At an id: what order 2 says."""
        if self.age == self.due:
            self._refresh()
            self.due = max(self.age + 1, int(self.age * GROW))
        self.age += 1
        self.teach = self.age <= EARLY or self.age % EVERY == 0
        self.slot = ((last * 40503 + before * 30011) ^ (last >> 3)) & ((1 << SLOTS) - 1)
        self.guessed = self.guess.take(self.slot).astype(np.int64)
        self.said, self.sureness = self.guessed >> 3, self.guessed & (SURE - 1)
        self.trust = (self.sureness + 1) * (self.said >= 0) * SEEN
        self.hash1 = last * 2654435761

    def look(self, lanes: np.ndarray | None, node: np.ndarray | None, depth: int, agrees: np.ndarray | None) -> None:
        """Rows and weights for the next digit of these lanes (None: all, at the root). agrees: the guess's path led here."""
        if lanes is None:
            row = (self.hash1 >> 7) & ((1 << ROWS) - 1)
            bucket = self.trust + self.seen.take(row)
            said, self.at0 = self.said, 0
        else:
            row = ((self.hash1.take(lanes) + node * 40343) >> 7) & ((1 << ROWS) - 1)
            bucket = self.trust.take(lanes) * agrees + self.seen.take(row)
            bucket += min(depth, 2) * (SURE + 1) * SEEN
            said, self.at0 = self.said.take(lanes), node * WIDE
        self.hint = self.digits[min(depth, len(self.digits) - 1)].take(np.maximum(said, 0))
        self.node, self.row, self.at1, self.bucket = node, row, row * WIDE, bucket
        self.u0, self.u1, self.u2 = self.s0.take(bucket), self.s1.take(bucket), self.s2.take(bucket)

    def _below(self, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares below a digit without order 2's, and what orders 0 and 1 give to them."""
        a = self.below0.take(digit + self.at0)
        a *= self.u0
        b = self.below1.take(digit + self.at1)
        b *= self.u1
        whole = (a + b).astype(np.int64)
        whole += digit
        return whole, a, b

    def find(self, v: np.ndarray) -> np.ndarray:
        """The digits in whose shares v lies."""
        # Without order 2's shares, which lie at the hint: what is above them moves down.
        v = np.maximum(np.minimum(v, self._below(self.hint)[0]), v - self.u2)
        v += 1
        v = v.astype(np.float32)
        digit = np.zeros(len(v), np.int64)
        for k in reversed(range(BITS)):
            t = digit + (1 << k)
            x = self.below0.take(t if self.node is None else t + self.at0)
            x *= self.u0
            y = self.below1.take(t + self.at1)
            y *= self.u1
            x += y
            y = t.astype(np.float32)
            np.subtract(v, y, out=y)  # of whole numbers
            t = (x < y).astype(np.int64)
            t <<= k
            digit += t
        return digit

    def span(self, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares below the digits, and their own."""
        low, a, b = self._below(digit)
        share, c, d = self._below(digit + 1)
        self.right = self.hint == digit
        share -= low
        more = self.u2 * self.right
        share += more
        low += self.u2 * (self.hint < digit)
        if self.teach:
            c -= a
            d -= b
            self.parts = d, more, np.maximum(c + d + more, 1e-9)
        return low, share

    def learn(self, digit: np.ndarray) -> None:
        if self.node is None:
            self.zero[:RADIX] += np.bincount(digit, minlength=RADIX).astype(np.float32)
            self.changed[0][0] = True
        else:
            np.add.at(self.zero, self.node * RADIX + digit, np.float32(1))
            self.changed[0][self.node] = True
        np.add.at(self.one, self.row * RADIX + digit, np.float32(1))
        self.changed[1][self.row] = True
        if not self.teach:
            return
        # Each prediction's part in what came, summed by bucket; weights move towards it.
        a1, a2, whole = self.parts
        size = len(self.w1)
        n = np.bincount(self.bucket, minlength=size)
        some = np.flatnonzero(n)
        n = n[some]
        rate = 0.02 * n / (1 + 0.02 * n)
        for w, a in ((self.w1, a1), (self.w2, a2)):
            part = np.bincount(self.bucket, weights=a / whole, minlength=size)[some] / n
            w[some] += (rate * (part - w[some])).astype(np.float32)
        self._scale()

    def end(self, symbol: np.ndarray) -> None:
        """After an id: the guess that was right grows surer, a wrong one less sure, and then gives way."""
        right = self.said == symbol
        stays = right | (self.sureness > 1)
        sure = _SURER.take(self.sureness * 2 + right)
        self.guess[self.slot] = (symbol + (self.said - symbol) * stays) * SURE + sure


def _start(n: int) -> tuple[int, int]:
    """Lanes and ids a lane."""
    lanes = int(min(LANES, max(1, n // RUN)))
    return lanes, -(-n // lanes)


def _some(x: np.ndarray, lanes: np.ndarray | None) -> np.ndarray:
    return x if lanes is None else x.take(lanes)


def encode_block(ids: np.ndarray, weigh: tuple[int, int] = (1, 1)) -> bytes:
    """ids: below 65,536, at least one, ``BLOCK`` at most."""
    n = len(ids)
    counts = np.bincount(ids, minlength=1 << 16)
    names = np.flatnonzero(counts)
    number = np.zeros(1 << 16, np.int64)
    number[names] = np.arange(len(names))
    lengths = _lengths(counts[names])
    tree = Tree(lengths)
    model = Model(tree, weigh)
    lanes, steps = _start(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = number.take(ids)
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    room = steps * int(lengths.max()) + 4  # a digit gives one word at most
    out = np.empty(lanes * room, np.uint16)
    begins = np.arange(lanes) * room
    at = begins.copy()
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for x in grid:
        model.begin(last, before)
        size, own = tree.length.take(x), x
        active, node, depth, agrees = None, None, 0, None
        while True:
            digit = tree.digit[depth].take(own)
            model.look(active, node, depth, agrees)
            lo, width = model.span(digit)
            r = _some(rng, active) >> 16
            lo *= r
            lo += _some(low, active)
            width *= r
            over = np.flatnonzero(lo > _FULL)
            if len(over):
                lo[over] &= _FULL
                places = at.take(over if active is None else active.take(over)) - 1
                while len(places):  # carry
                    out[places] += 1
                    places = places[out[places] == 0] - 1
            # Every lane's next word is written; it stays where the range has become small.
            small = (width < _TOP).astype(np.int64)
            places = _some(at, active)
            out[places] = lo >> 32
            places += small
            small <<= 4
            lo <<= small
            lo &= _FULL
            width <<= small
            if active is None:
                low, rng = lo, width
            else:
                low[active], rng[active], at[active] = lo, width, places
            model.learn(digit)
            depth += 1
            on = np.flatnonzero(size > depth)
            if not len(on):
                break
            agrees = model.right.take(on) if agrees is None else (model.right & agrees).take(on)
            active = on if active is None else active.take(on)
            size, own = size.take(on), own.take(on)
            node = tree.node[depth].take(own)
        model.end(x)
        before, last = last, x
    for shift in (32, 16, 0):
        out[at] = (low >> shift).astype(np.uint16)
        at += 1
    used = at - begins
    head = zlib.compress(np.diff(names, prepend=0).astype("<u2").tobytes() + lengths.astype("u1").tobytes() + used.astype("<u4").tobytes(), 6)
    body = b"".join(out[a:b].astype("<u2").tobytes() for a, b in zip(begins.tolist(), at.tolist()))
    whole = struct.pack("<III", n, len(names), len(head)) + head + body
    return struct.pack("<I", zlib.crc32(whole)) + whole


def decode_block(data: bytes) -> np.ndarray:
    check, n, kinds, size = struct.unpack_from("<IIII", data)
    if zlib.crc32(memoryview(data)[4:]) != check:
        raise ValueError("a block of ids is damaged")
    head = zlib.decompress(data[16 : 16 + size])
    names = np.cumsum(np.frombuffer(head, "<u2", kinds).astype(np.int64))
    tree = Tree(np.frombuffer(head, "u1", kinds, 2 * kinds).astype(np.int64))
    model, children = Model(tree), tree.child.ravel()
    lanes, steps = _start(n)
    used = np.frombuffer(head, "<u4", lanes, 3 * kinds).astype(np.int64)
    words = np.r_[np.frombuffer(data, "<u2", offset=16 + size), np.zeros(4, np.uint16)]
    at = np.r_[0, np.cumsum(used)[:-1]]
    code = np.zeros(lanes, np.int64)
    for k in range(3):
        code = (code << 16) | words[at + k]
    at = at + 3
    rng = np.full(lanes, 1 << 48, np.int64)
    grid = np.zeros((steps, lanes), np.int64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for x in grid:
        model.begin(last, before)
        active, node, depth, agrees = None, None, 0, None
        while True:
            model.look(active, node, depth, agrees)
            r, c = _some(rng, active) >> 16, _some(code, active)
            digit = model.find((c / r).astype(np.int64))  # of whole numbers below 2^53: never rounded up to the next one
            lo, width = model.span(digit)
            c = c - lo * r
            width *= r
            small = (width < _TOP).astype(np.int64)
            places = _some(at, active)
            word = words.take(places) * small
            places += small
            small <<= 4
            c <<= small
            c |= word
            width <<= small
            if active is None:
                code, rng = c, width
            else:
                code[active], rng[active], at[active] = c, width, places
            model.learn(digit)
            child = children.take(digit if node is None else node * RADIX + digit)
            depth += 1
            if active is None:
                np.subtract(-1, child, out=x)
            else:
                x[active] = -1 - child
            on = np.flatnonzero(child >= 0)
            if not len(on):
                break
            agrees = model.right.take(on) if agrees is None else (model.right & agrees).take(on)
            active = on if active is None else active.take(on)
            node = child.take(on)
        model.end(x)
        before, last = last, x
    return names[grid.T.ravel()[:n]]
