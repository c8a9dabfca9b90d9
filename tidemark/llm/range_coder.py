"""Adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes that are coded side by side, one id of each lane per step, under one
model that starts empty with the block.  The model mixes three predictions: the id that followed
the last two ids, the id that followed the last id, and the shares of all ids so far.  The
mixing weights are learned per confidence of the first two.  The mixture is one cumulative
distribution, so an id is one range-coding step.  The decoder repeats the same updates.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"TMK3"
# Many lanes spread the cost of a step over more ids, at a few bytes a lane.
MAX_LANES = 3 << 12
LANE_IDS = 256
# Shares of ids add up to 2**18 or more (twice the alphabet), shares times mixing weights to 2**30.
ID_BITS, TOTAL_BITS = 18, 30
# Blocks with ids from here on code the rank of an id among those they hold.
DENSE_FROM = 1 << 17
TABLE_BITS = 18
# Steps after which the shares of ids are drawn up anew.
REFRESH = 32
_LOW32 = np.uint64(0xFFFFFFFF)
_WORD = np.uint64(32)
_TOTAL = np.uint64(TOTAL_BITS)
_FULL = np.uint64(2**64 - 1)


class BlockError(ValueError):
    """A block that is damaged or not one."""


def _mix(no: np.ndarray, yes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """``yes`` where the mask has all bits, ``no`` where it has none: np.where stalls on random masks."""
    return no ^ ((no ^ yes) & mask)


class _Model:
    """Predictions for all lanes of a block, and their updates.

    A prediction is kept with its confidence (0 to 3, 0: none yet) in the low two bits.  Numbers
    are 32 bits wide (none is above 2**TOTAL_BITS) but for those that are positions in a table.
    ``a - b >> 31`` is the mask of a < b.
    """

    def __init__(self, lanes: int, alphabet: int):
        self.alphabet = alphabet
        self.id_bits = max(ID_BITS, alphabet.bit_length() + 1)
        self.weight_bits = TOTAL_BITS - self.id_bits
        self.seen = np.zeros(alphabet, "int64")
        self.after1 = np.zeros(alphabet, "int32")
        self.after2 = np.zeros(1 << TABLE_BITS, "int32")
        # Hits per context (confidence of both, whether they agree) and prediction.
        self.hits = np.ones((32, 3))
        self.hits[:, 0] = 4
        self.last1 = np.zeros(lanes, "int64")
        self.last2 = np.zeros(lanes, "int64")
        self.step = 0
        self.wait: list[np.ndarray] = []
        self.tally: list[np.ndarray] = []
        self._shares()
        self._weights()

    def _shares(self) -> None:
        if self.wait:
            self.seen += np.bincount(np.concatenate(self.wait), minlength=self.alphabet)
            self.wait = []
        total = int(self.seen.sum())
        below = np.arange(self.alphabet + 1, dtype="int64")
        room = (1 << self.id_bits) - self.alphabet
        if total:
            below[1:] += np.cumsum(self.seen) * room // total
        else:
            below = below * (1 << self.id_bits) // self.alphabet
        self.below = below.astype("int32")
        self.share = np.diff(self.below)
        self.id_at = None

    def _weights(self) -> None:
        if self.tally:
            self.hits += np.bincount(np.concatenate(self.tally), minlength=96).reshape(32, 3)
            self.tally = []
            large = self.hits.sum(axis=1, keepdims=True) > 1 << 16
            self.hits = np.where(large, self.hits / 2, self.hits)
        hits = self.hits.copy()
        hits[np.arange(32) // 4 % 4 == 0, 2] = 0
        hits[(np.arange(32) % 4 == 0) | (np.arange(32) >= 16), 1] = 0
        scaled = (hits * (((1 << self.weight_bits) - 1) / hits.sum(axis=1, keepdims=True))).astype("int64")
        self.weight0 = ((1 << self.weight_bits) - scaled[:, 1] - scaled[:, 2]).astype("int32")
        self.weight1 = (scaled[:, 1] << self.id_bits).astype("int32")
        self.weight2 = (scaled[:, 2] << self.id_bits).astype("int32")

    def predict(self) -> None:
        """Predictions and weights of every lane for its next id."""
        self.slot = (self.last2 * 40503 + self.last1 * 2654435761 >> 11) & ((1 << TABLE_BITS) - 1)
        self.entry2, self.entry1 = self.after2.take(self.slot), self.after1.take(self.last1)
        self.conf2, self.conf1 = self.entry2 & 3, self.entry1 & 3
        self.guess2, self.guess1 = self.entry2 >> 2, self.entry1 >> 2
        agree = (self.guess1 == self.guess2) & (self.conf2 > 0)
        self.context = ((self.conf2 << 2) + self.conf1 + (agree.astype("int32") << 4)).astype("int64")
        self.w0 = self.weight0.take(self.context)
        self.w1 = self.weight1.take(self.context)
        self.w2 = self.weight2.take(self.context)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of the ids in the mixture, of 2**TOTAL_BITS."""
        few = ids.astype("int32")
        past2, past1 = self.guess2 - few, self.guess1 - few
        self.right2, self.right1 = -(past2 == 0).astype("int32"), -(past1 == 0).astype("int32")
        begin = self.w0 * self.below.take(ids) + (self.w2 & past2 >> 31) + (self.w1 & past1 >> 31)
        width = self.w0 * self.share.take(ids) + (self.w2 & self.right2) + (self.w1 & self.right1)
        return begin, width

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds the value, lane by lane."""
        if self.id_at is None:
            self.id_at = np.repeat(np.arange(self.alphabet, dtype="int32"), self.share)
        # The plain shares begin again behind the interval of each guess.
        low, high = np.minimum(self.guess1, self.guess2), np.maximum(self.guess1, self.guess2)
        two = low - high >> 31
        w_low = _mix(self.w1, self.w2, self.guess2 - self.guess1 >> 31)
        w_both = self.w1 + self.w2
        low_at, high_at = low.astype("int64"), high.astype("int64")
        after_low = self.w0 * (self.below.take(low_at) + self.share.take(low_at)) + w_low
        high_begin = self.w0 * self.below.take(high_at) + w_low
        after_high = high_begin + self.w0 * self.share.take(high_at) + (w_both - w_low)
        until_high = value - after_high >> 31
        past = _mix(w_both, w_low & two & ~(value - after_low >> 31), until_high)
        # Values inside a guess's interval are clipped here and set below.
        found = self.id_at.take((value - past) // self.w0, mode="clip")
        found = _mix(found, high, two & until_high & ~(value - high_begin >> 31))
        near = _mix(after_high, after_low, two)
        return _mix(found, low, (value - near >> 31) & (low - found >> 31)).astype("int64")

    def learn(self, ids: np.ndarray) -> None:
        """Confident wrong guesses lose confidence, unsure ones are replaced."""
        hit2 = (self.right2 < 0) & (self.conf2 > 0)
        hit1 = (self.right1 < 0) & (self.conf1 > 0) & ~hit2
        self.tally.append(self.context * 3 + (hit1.view("int8") + 2 * hit2.view("int8")))
        fresh = (ids << 2 | 1).astype("int32")
        for table, at, entry, conf, right in (
            (self.after2, self.slot, self.entry2, self.conf2, self.right2),
            (self.after1, self.last1, self.entry1, self.conf1, self.right1),
        ):
            surer = np.minimum(entry + 1, entry | 3)
            table[at] = _mix(_mix(fresh, entry - 1, 1 - conf >> 31), surer, right)
        self.wait.append(ids)
        self.last2, self.last1 = self.last1, ids
        self.step += 1
        if self.step % REFRESH == 0 or self.step in (1, 2, 4, 8, 16):
            self._shares()
            self._weights()


def _shape(n: int) -> tuple[int, int]:
    lanes = min(MAX_LANES, max(1, -(-n // LANE_IDS)))
    return lanes, -(-n // lanes)


def _code(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(words per lane, 32-bit words of all lanes)."""
    lanes, steps = _shape(len(ids))
    grid = np.zeros(lanes * steps, "int64")
    grid[: len(ids)] = ids
    columns = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(lanes, alphabet)
    low, size = np.zeros(lanes, "uint64"), np.full(lanes, _FULL)
    lane_of, words = [], []
    for t in range(steps):
        now = columns[t]
        model.predict()
        begin, width = model.interval(now)
        unit = size >> _TOTAL
        low += unit * begin.astype("uint64")
        size = unit * width.astype("uint64")
        short = np.flatnonzero(size <= _LOW32)
        if len(short):
            # Cut the interval where it leaves the settled word: no carry is ever needed.
            at = low[short]
            rest = at & _LOW32
            words.append((at >> _WORD).astype("uint32"))
            lane_of.append(short.astype("uint16"))
            size[short] = np.minimum(size[short], _LOW32 - rest + np.uint64(1)) << _WORD
            low[short] = rest << _WORD
        model.learn(now)
    words.append(((low + _LOW32) >> _WORD).astype("uint32"))
    lane_of.append(np.arange(lanes).astype("uint16"))
    lane = np.concatenate(lane_of)
    order = np.argsort(lane, kind="stable")
    return np.bincount(lane, minlength=lanes), np.concatenate(words)[order]


def _decode(n: int, alphabet: int, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes, steps = _shape(n)
    # Two zero words follow every lane's own.
    padded = np.zeros(len(words) + 2 * lanes, "uint64")
    lane = np.repeat(np.arange(lanes), counts)
    padded[np.arange(len(words)) + 2 * lane] = words
    at = np.cumsum(counts) - counts + 2 * np.arange(lanes)
    model = _Model(lanes, alphabet)
    low, size = np.zeros(lanes, "uint64"), np.full(lanes, _FULL)
    over = (padded[at] << _WORD) | padded[at + 1]
    at = at + 2
    columns = np.empty((steps, lanes), "int64")
    most = np.uint64((1 << TOTAL_BITS) - 1)
    for t in range(steps):
        model.predict()
        unit = size >> _TOTAL
        now = model.find(np.minimum(over // unit, most).astype("int32"))
        begin, width = model.interval(now)
        first = unit * begin.astype("uint64")
        low += first
        over -= first
        size = unit * width.astype("uint64")
        short = np.flatnonzero(size <= _LOW32)
        if len(short):
            rest = low[short] & _LOW32
            size[short] = np.minimum(size[short], _LOW32 - rest + np.uint64(1)) << _WORD
            low[short] = rest << _WORD
            over[short] = (over[short] << _WORD) | padded[np.minimum(at[short], len(padded) - 1)]
            at[short] += 1
        model.learn(now)
        columns[t] = now
    return np.ascontiguousarray(columns.T).ravel()[:n]


def write_block(ids: np.ndarray, extra: bytes = b"") -> bytes:
    """One self-contained block: header, ``extra`` bytes, large ids, lanes, checksum of everything.

    Ids are below 2**32; a block holds fewer than 2**24 different ones.
    """
    ids = np.asarray(ids, "int64")
    plain = zlib.crc32(ids.astype("<u4").tobytes())
    alphabet, table = int(ids.max()) + 1 if len(ids) else 1, b""
    if alphabet > DENSE_FROM:
        values, ids = np.unique(ids, return_inverse=True)
        alphabet, table = len(values), zlib.compress(np.diff(values, prepend=0).astype("<u4").tobytes(), 6)
    counts, words = _code(ids, alphabet) if len(ids) else (np.empty(0, "int64"), np.empty(0, "uint32"))
    lanes = zlib.compress(counts.astype("<u4").tobytes(), 6)
    head = np.array([len(ids), alphabet, plain, len(extra), len(table), len(lanes), len(words)], "<u8").tobytes()
    body = MAGIC + head + extra + table + lanes + words.astype("<u4").tobytes()
    return body + zlib.crc32(body).to_bytes(4, "little")


def read_block(block: bytes) -> tuple[np.ndarray, bytes]:
    """(ids, extra) of a block; both checksums are verified."""
    if block[:4] != MAGIC or len(block) < 64 or zlib.crc32(block[:-4]) != int.from_bytes(block[-4:], "little"):
        raise BlockError("not a whole token block")
    n, alphabet, plain, n_extra, n_table, n_lanes, n_words = (int(x) for x in np.frombuffer(block, "<u8", 7, 4))
    at = 60 + n_extra
    extra, table = block[60:at], block[at : at + n_table]
    at += n_table
    counts = np.frombuffer(zlib.decompress(block[at : at + n_lanes]), "<u4").astype("int64")
    words = np.frombuffer(block, "<u4", n_words, at + n_lanes)
    ids = _decode(n, alphabet, counts, words) if n else np.empty(0, "int64")
    if table:
        ids = np.cumsum(np.frombuffer(zlib.decompress(table), "<u4").astype("int64"))[ids]
    ids = ids.astype("<u4")
    if zlib.crc32(ids.tobytes()) != plain:
        raise BlockError("the ids of a token block do not match their checksum")
    return ids, extra
