"""Blocks of token ids by an adaptive context-mixing range coder (operator 11).

A block stands alone: its model starts anew, and two checksums guard it. It's cut into lanes, stretches of like length that are coded in lockstep, each with a range coder of its own and
all with one model, so a step is a handful of numpy operations on a vector of lanes. The model has

* order 2 and order 1: for each context (the two ids before, hashed, or the one before) the id predicted next and a confidence of 0 to 15, which grows with each hit and
  halves with each miss; a prediction without confidence is replaced;
* order 0: counts of the ids that no prediction met;
* the mix: how often either prediction was right at each pair of confidences. The three orders share the range by these rates, and an id is coded in the share of the highest order that predicts it.

The predictions are brought up to date after each step, the rates and the counts after eight, and in longer intervals, of a quarter of the steps so far, once there are many. All arithmetic is of
integers, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

LANES, LANE_IDS = 4096, 256  # lanes at most, and ids a lane at least
EVERY = 8  # steps between updates of rates and counts, at least
SLOTS = 1 << 21  # of contexts of order 2
LOW, WORD = 48, 16  # bits of the least range, of a word written; the coder's window has 64
SHARES, UNITS = 12, 20  # bits: the shares of the three orders, and order 0 within its own
PAST = 4  # words that a lane is read beyond its end, at most
MAX_IDS = 1 << (UNITS - 1)  # so that each id has a unit of order 0
HEAD = struct.Struct("<4sIIIIII")  # magic, ids, vocabulary, lanes, words, crc32 of the ids as unsigned 32-bit integers, crc32 of what follows
MAGIC = b"QRC2"
_LEAST, _WORD, _LOW, _UNIT = np.uint64(1 << LOW), np.uint64(WORD), np.uint64(LOW), np.uint64(SHARES + UNITS)
_HALF, _ONES = np.uint64(32), np.uint64((1 << 32) - 1)


class _Model:
    """What the coder expects next, for a vector of contexts. Vectors of both orders hold order 2 and then order 1."""

    def __init__(self, vocabulary: int, n: int):
        self.bits = max(8, min(SLOTS.bit_length() - 1, (4 * n).bit_length()))
        self.table = np.full((1 << self.bits) + vocabulary + 1, vocabulary << 4, np.int32)  # contexts of order 2, then those of order 1: an id and its confidence in four bits
        self.counts = np.ones(vocabulary, np.int64)
        self.right = np.tile(np.array([1, 1, 2], np.int64), (512, 1))  # by confidences and agreement: hits of order 2, hits of order 1, misses
        self.met, self.missed, self.steps, self.due = [], [], 0, EVERY
        self._refresh()

    def _refresh(self) -> None:
        total = np.cumsum(self.counts)
        spare = (1 << UNITS) - len(self.counts)  # one unit each, and the rest by count
        self.starts = np.zeros(len(self.counts) + 1, np.uint64)
        self.starts[1:] = total * spare // total[-1] + np.arange(1, len(self.counts) + 1)
        self.spans, self.owners = self.starts[:-1] << np.uint64(32) | np.diff(self.starts), None  # start and width of an id, looked up at once
        two, one = np.maximum(self.right[:, :2] * ((1 << SHARES) - 64) // self.right.sum(axis=1, keepdims=True), 1).astype(np.uint64).T
        both, units = two + one, np.uint64(UNITS)
        rare = np.uint64(1 << SHARES) - both
        self.start = np.stack([two * 0, two << units, both << units, two * 0], axis=1).ravel()  # by bucket: row and outcome, of which there are three
        self.width = np.stack([two << units, one << units, rare, two * 0], axis=1).ravel()  # order 0's is for one unit

    def expect(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictions of order 2 and 1, and the first of four buckets of each place; keeps where they come from."""
        k = len(last)
        self.at = at = np.empty(2 * k, np.intp)
        at[:k] = (last.view(np.uint32) * np.uint32(40_503) + before.view(np.uint32) * np.uint32(2_654_435_761)) * np.uint32(2_246_822_519) >> np.uint32(32 - self.bits)
        at[k:] = last
        at[k:] += 1 << self.bits
        self.old = old = self.table.take(at)
        self.sure, guess = (old & 15).astype(np.uint8), (old >> 4).reshape(2, k)
        row = (self.sure[:k] << 4 | self.sure[k:]).astype(np.intp)
        row += (guess[0] == guess[1]).astype(np.intp) << 8
        row <<= 2
        return guess, row

    def learn(self, ids: np.ndarray, hit: np.ndarray, buckets: np.ndarray, missed: np.ndarray) -> None:
        """The ids that came, which of them order 2 and order 1 predicted, where they were counted, and those that neither did."""
        self.met.append(buckets)
        self.missed.append(missed)
        k, sure, hit = len(ids), self.sure, hit.ravel().view(np.uint8)
        change = ((sure < 15) & hit).view(np.int8) - (((sure + 1) >> 1) * (hit ^ 1)).view(np.int8)  # of a confidence: one up, to 15, by a hit, halved by a miss
        new = change.astype(np.int32)
        new += self.old
        fresh = (ids << 4) + 1
        lost = sure < 2  # a prediction of little confidence that was wrong
        lost &= hit == 0
        np.putmask(new[:k], lost[:k], fresh)
        np.putmask(new[k:], lost[k:], fresh)
        self.table[self.at] = new
        self.steps += 1
        if self.steps == self.due:
            self.due += max(EVERY, self.steps // 4)
            self.right += np.bincount(np.concatenate(self.met), minlength=2048).reshape(512, 4)[:, :3]
            self.counts += 24 * np.bincount(np.concatenate(self.missed), minlength=len(self.counts))
            self.met, self.missed = [], []
            self._refresh()

    def of_units(self, units: np.ndarray) -> np.ndarray:
        """The ids that these units of order 0 belong to: the last one that starts at or before each."""
        if self.owners is None:
            begins = np.zeros(1 << UNITS, np.int32)
            begins[self.starts[1:-1].view(np.int64)] = 1
            self.owners = np.cumsum(begins, dtype=np.int32)
        return self.owners.take(units.view(np.int64))


def _lanes(n: int) -> tuple[int, int, int]:
    """Lanes, full steps of all of them, and lanes that have one id more."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, n // lanes, n % lanes


def _by_step(ids: np.ndarray, table: np.ndarray, more: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two parts of a block and of its table of steps (a row a step, a column a lane) that belong together: lanes with one id more, and the others."""
    lanes = table.shape[1]
    steps = len(ids) // lanes
    cut = more * (steps + 1)
    if more:
        yield ids[:cut].reshape(more, steps + 1), table[:, :more].T
    yield ids[cut:].reshape(lanes - more, steps), table[:steps, more:].T


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of these ids, each below the vocabulary's size, which is at most MAX_IDS."""
    ids = np.asarray(ids)
    n = len(ids)
    if not 0 < vocabulary <= MAX_IDS or n and not (0 <= ids.min() and ids.max() < vocabulary):
        raise ValueError("ids must lie in a vocabulary of at most %d" % MAX_IDS)
    ids = np.ascontiguousarray(ids, "<u4")
    lanes, steps, more = _lanes(n)
    model = _Model(vocabulary, n)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words, at = np.zeros((3 * (steps + 1) + 2) * lanes, np.uint32), np.arange(lanes)  # what lanes write at one time lies close together; at: where each writes next
    last = before = np.full(lanes, vocabulary, np.int32)
    line = np.zeros((steps + (more > 0), lanes), np.int32)
    for whole, by_step in _by_step(ids.view("<i4"), line, more):
        by_step[:] = whole

    def carry(who: np.ndarray) -> None:
        where = at[who] - lanes
        while len(where):
            words[where] += 1
            where = where[words[where] >> WORD > 0]
            words[where] &= (1 << WORD) - 1
            where -= lanes

    for step in range(len(line)):
        k = lanes if step < steps else more
        x = line[step, :k]
        guess, row = model.expect(before[:k], last[:k])
        hit = guess == x
        in2, in1 = hit.view(np.int8)
        outcome = (2 - in1) * (1 - in2)  # 0: order 2's, 1: order 1's, 2: neither's
        row += outcome
        start, width = model.start.take(row), model.width.take(row)
        rare = np.flatnonzero(outcome == 2)
        missed, share = x.take(rare), width.take(rare)
        found = model.spans.take(missed)
        start[rare] = start.take(rare) + share * (found >> _HALF)
        width[rare] = share * (found & _ONES)
        unit = span[:k] >> _UNIT
        start *= unit
        width *= unit
        start += low[:k]
        over = np.flatnonzero(start < low[:k])
        if len(over):
            carry(over)
        short = np.flatnonzero(width < _LEAST)
        while len(short):
            now, where, wide = start.take(short), at.take(short), width.take(short) << _WORD
            words[where] = (now >> _LOW).astype(np.uint32)
            at[short] = where + lanes
            start[short] = now << _WORD
            width[short] = wide
            short = short[wide < _LEAST]
        low[:k], span[:k] = start, width
        model.learn(x, hit, row, missed)
        before, last = last, np.concatenate([x, last[k:]]) if k < lanes else x
    if n:  # one word that lies in what is left of each lane's range
        end = low + (_LEAST - np.uint64(1))
        carry(np.flatnonzero(end < low))
        words[at] = end >> _LOW
        at += lanes
    held = at // lanes
    used = int(held.max())
    by_lane = np.ascontiguousarray(words[: used * lanes].astype("<u2").reshape(used, lanes).T)
    body = held.astype("<u4").tobytes() + by_lane[np.arange(used) < held[:, None]].tobytes()
    return HEAD.pack(MAGIC, n, vocabulary, lanes, int(held.sum()), zlib.crc32(ids), zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block, as unsigned 32-bit integers; ValueError if the block is torn or changed."""
    if len(block) < HEAD.size or block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    _, n, vocabulary, lanes, n_words, id_crc, body_crc = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size :]
    if len(body) != 4 * lanes + 2 * n_words or zlib.crc32(body) != body_crc or (lanes, _lanes(n)[0]) != (_lanes(n)[0], lanes):
        raise ValueError("a block of token ids is torn or changed")
    held = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    if held.sum() != n_words:
        raise ValueError("a block of token ids is torn or changed")
    at = held.cumsum() - held + PAST * np.arange(lanes)
    words = np.zeros(n_words + PAST * lanes, np.uint16)  # past its end a lane is zeros
    words[np.arange(n_words) + np.repeat(PAST * np.arange(lanes), held)] = np.frombuffer(body, "<u2", n_words, 4 * lanes)
    lanes, steps, more = _lanes(n)
    model, most = _Model(vocabulary, n), np.uint64((1 << UNITS) - 1)
    out = np.zeros((steps + (more > 0), lanes), np.int32)
    span, code = np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)  # code: what is read, less the low end of the range
    for shift in (48, 32, 16, 0):
        code |= words.take(at, mode="clip").astype(np.uint64) << np.uint64(shift)
        at += 1
    last = before = np.full(lanes, vocabulary, np.int32)
    for step in range(len(out)):
        k = lanes if step < steps else more
        guess, row = model.expect(before[:k], last[:k])
        unit, now = span[:k] >> _UNIT, code[:k]
        edge2, edge1 = model.start.take(row + 1) * unit, model.start.take(row + 2) * unit
        in2, in1 = now < edge2, now < edge1
        x = np.where(in2, guess[0], guess[1])
        rare = np.flatnonzero(~in1)
        row += 2 - in1.view(np.int8) - in2.view(np.int8)
        rest, width = now - edge2, edge1 - edge2
        np.putmask(rest, in2, now)
        np.putmask(width, in2, edge2)
        share, above = unit.take(rare) * model.width.take(row.take(rare)), now.take(rare) - edge1.take(rare)
        x[rare] = missed = model.of_units(np.minimum(above // share, most))
        found = model.spans.take(missed)
        rest[rare] = above - share * (found >> _HALF)
        width[rare] = share * (found & _ONES)
        short = np.flatnonzero(width < _LEAST)
        while len(short):
            where, wide = at.take(short), width.take(short) << _WORD
            rest[short] = rest.take(short) << _WORD | words.take(where, mode="clip")
            at[short] = where + 1
            width[short] = wide
            short = short[wide < _LEAST]
        code[:k], span[:k] = rest, width
        out[step, :k] = x
        model.learn(x, guess == x, row, missed)
        before, last = last, np.concatenate([x, last[k:]]) if k < lanes else x
    ids = np.empty(n, "<u4")
    for whole, by_step in _by_step(ids.view("<i4"), out, more):
        whole[:] = by_step
    if zlib.crc32(ids) != id_crc:
        raise ValueError("a block of token ids does not match its checksum")
    return ids
