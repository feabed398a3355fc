"""Token ids in adaptively coded, independently decodable binary blocks.

Texts become ids of a byte-level BPE vocabulary, whose file is a parameter.  The ids of the
documents of a portion are laid end to end and cut into blocks of BLOCK ids.  Every block
starts from a fresh model, so it decodes alone, and carries the CRC-32 of its ids.

The coder is a range coder with 16-bit digits and carries.  Before each id an order-2 and an
order-1 context (the last two ids, the last one) each predict the id that followed last time.
"It is the order-2 prediction" and, failing that, "it is the order-1 prediction" are coded
with probabilities that are mixed, in the logistic domain, of three estimates: one by how
often the order-2 prediction has held in a row, one by the same of order 1 and whether the
two agree, one by how often the predicted id has occurred at all (order 0).  An estimate is
the share of predictions of its class that have come true in the block; its weight in the
mixture falls with the code length that it alone would have cost so far.  Estimates and
weights are renewed every CHUNK ids.  An id that neither order predicts is coded by the
order-0 frequencies of its high part and, given a group of high parts, of its low byte.  All
arithmetic is in integers, so the decoder repeats the encoder's on any machine.

As the encoder knows all ids, it finds every prediction, class and probability of LANES
blocks by sorting and counting; only the coder's interval goes step by step, one array
operation for all blocks.

Defined results: null and empty texts have no ids and stand in a block with count 0.  A long
text runs over several blocks; start tells where in its ids each part begins.  It is made
into ids part by part, and its blocks are coded LANES at a time.  Repeated rows are coded each
on their own, a null doc_id is carried through, other columns are ignored, an empty table
gives no block.  Vocabularies may have up to 2**20 ids.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import U64, chunks, docs_of, mix, prefix, ragged, spans, table, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # unless the session names another in VOCABULARY_CONF
VOCABULARY_CONF = "spark.postlake.vocabulary"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
LANES, ROWS = 1024, 128  # blocks that are coded side by side, blocks that are decoded together
LOT = 32  # blocks whose steps are found together, few so that their tables stay in the processor's cache
PORTION_BYTES = 8 << 20
LOOK_BYTES = 1 << 20  # of text whose pieces are looked up together, few for the same reason as LOT
KNOWN, PLACE_BITS = 1_000_000, 21  # pieces of text whose ids a worker remembers, bits of their places by hash
SCHEMA = "doc_ids array<bigint>, starts array<int>, counts array<int>, n_ids int, high_parts int, crc bigint, payload binary"
SLOT_BITS = 14  # of the contexts' table places
CHUNK = 64
STEPS_BITS = 6
STEPS = 1 << STEPS_BITS  # of the coder that are taken from the blocks at a time
GROUPS = 32  # of high parts, each with a table of low bytes
INCREMENT = 13
REFRESH = (32, 96, 256, 512, 1024, 2048, 3072)
I64 = np.int64
WHOLE = 1 << 16
NO_ID = 0xFFFFFF

#: SQUASH[x + 2047] = 4096 / (1 + e^-x/256), STRETCH is its inverse, COST the code length of a probability in 1/16 bits.
_x = np.arange(-2047, 2048)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-_x / 256.0))), 1, 4095).astype(np.int32)
STRETCH = np.clip(np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.int32)
COST = np.round(-16 * np.log2(np.maximum(np.arange(4097), 0.5) / 4096)).astype(I64)
#: The weight of an estimate by the code length it is behind the best, in units of 1/16 bits times SLOWLY.
SLOWLY = 32
WEIGHT = np.maximum(1, np.round(WHOLE * 2.0 ** (-np.arange(257) / 16.0))).astype(I64)
GAIN = 19  # of the mixture, in sixteenths
LEVEL = np.minimum(7, np.floor(np.log2(np.maximum(1, np.arange(BLOCK + 2))))).astype(np.int32)


def slot1(last: np.ndarray) -> np.ndarray:
    return ((last.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)).astype(np.uint16)


def slot2(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    mixed = last.astype(np.uint32) * np.uint32(2654435761) + before.astype(np.uint32) * np.uint32(2246822519)
    return (((mixed ^ (mixed >> np.uint32(15))) * np.uint32(3266489917)) >> np.uint32(32 - SLOT_BITS)).astype(np.uint16)


def shares(tried: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The estimated probabilities, of 4096, from counts of tries and of those that came true."""
    return np.clip((held * 8 + 4) * 4096 // (tried * 8 + 8), 8, 4088)


def spent(p: np.ndarray, tried: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Code length of counts under p, summed over the classes."""
    return (held * COST[p] + (tried - held) * COST[4096 - p]).sum(axis=-1)


def parts(p: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """What each estimate and class adds to the mixture: its weight times its stretched probability."""
    behind = np.minimum((cost - cost.min(axis=-1, keepdims=True)) // SLOWLY, 256)
    w = WEIGHT[behind]
    return (STRETCH[p] * ((w << 16) // w.sum(axis=-1, keepdims=True) * GAIN >> 4)[..., None]).astype(np.int32)


def classes(which: int, c1: np.ndarray, c2: np.ndarray, agree: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The class, below 8, that each of the three estimates takes a prediction of order 2 (which 0) or 1 (which 1) to be in."""
    if which == 0:
        return [c2, np.where(c1 == 0, 0, 1 + np.minimum(c1 - 1, 2) + 3 * agree), level]
    return [c2, c1, level]


def intervals(ask2: np.ndarray, p2: np.ndarray, ask1: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of WHOLE that "order 2" and then "order 1" take."""
    a = np.where(ask2, p2 << 4, 0)
    left = WHOLE - a
    return a, np.where(ask1, np.clip(left * p1 >> 12, 1, left - 1), 0)


def high_parts(vocabulary: int) -> int:
    """The number of high parts of ids, a power of two from 256."""
    n = 256
    while n << 8 < vocabulary:
        n <<= 1
    if n > 4096:
        raise ValueError("the vocabulary has more than 2**20 ids")
    return n


def scaled(counts: np.ndarray) -> np.ndarray:
    """Where in WHOLE the symbols begin whose frequencies are 1 + INCREMENT * counts (last axis), and the end."""
    sums = np.zeros((*counts.shape[:-1], counts.shape[-1] + 1), np.int32)
    np.cumsum(counts * INCREMENT + 1, axis=-1, out=sums[..., 1:], dtype=np.int32)
    return (sums.astype(I64) * WHOLE // sums[..., -1:]).astype(np.int32)


def _follow(packed: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """At each flat place of the rows: predicted id << 6 | its level << 3 | how often in a row it was right plus one, or 0 for none.

    packed has id << 3 | level of each place.
    """
    n, most = slot.shape
    at = (np.argsort(slot, axis=1, kind="stable") + (np.arange(n) * most)[:, None]).ravel()
    s, x = slot.ravel()[at], packed[at]
    some = s[1:] == s[:-1]
    some[most - 1 :: most] = False
    y = x >> 3
    place = np.arange(n * most, dtype=np.int32)
    missed = place.copy()
    missed[1:][some & (y[1:] == y[:-1])] = 0
    np.maximum.accumulate(missed, out=missed)
    run = np.minimum(place - missed, 6) + 1
    out = np.empty(n * most, np.int32)
    out[at[1:]] = (x[:-1] << 3 | run[:-1]) * some
    out[at[0]] = 0
    return out


def _levels(ids: np.ndarray) -> np.ndarray:
    """The level of each flat place: of how often its id has occurred in its row, itself included; ids that agree in 16 bits count together."""
    n, most = ids.shape
    key = ids.astype(np.uint16)
    at = (np.argsort(key, axis=1, kind="stable") + (np.arange(n) * most)[:, None]).ravel()
    x = key.ravel()[at]
    place = np.arange(n * most, dtype=np.int32)
    new = place.copy()
    new[1:][x[1:] == x[:-1]] = 0
    new[::most] = place[::most]
    out = np.empty(n * most, np.int32)
    out[at] = LEVEL[place - np.maximum.accumulate(new, out=new) + 1]
    return out


def _before(x: np.ndarray) -> np.ndarray:
    """Sums along the first axis of what comes before."""
    out = np.zeros_like(x)
    for k in range(1, len(x)):
        np.add(out[k - 1], x[k - 1], out=out[k])
    return out


def _probabilities(base: np.ndarray, held: np.ndarray, of: list[np.ndarray], n: int, number: int) -> np.ndarray:
    """The mixed probabilities, of 4096, of predictions with their chunks (times 8), whether they held, and their classes."""
    at = [base + c for c in of]
    size = n * number * 8
    both = [np.bincount((k << 1) + held, minlength=2 * size).reshape(number, n, 8, 2) for k in at]
    came = np.stack([x[..., 1] for x in both], axis=2)
    tried = np.stack([x[..., 0] for x in both], axis=2) + came
    p = shares(_before(tried), _before(came))
    part = parts(p, _before(spent(p, tried, came)))
    dot = sum(part[:, :, k].ravel()[at[k]] for k in range(3)) >> 16
    return SQUASH[np.clip(dot, -2047, 2047) + 2047]


class _Frequencies:
    """Frequencies of symbols (their number a multiple of 16) on lines, side by side so that all lines are summed at once.

    Sums stay below 2**16: a block has BLOCK ids and there are at most 4096 symbols.
    """

    def __init__(self, symbols: int, lines: int) -> None:
        self.lines = lines
        self.counts = np.ones((symbols // 16, 16, lines), np.uint16)
        self.sums = np.empty_like(self.counts)
        self.before = np.zeros((symbols // 16 + 1, lines), np.uint16)  # each 16 symbols

    def intervals(self, symbol: np.ndarray, line: np.ndarray) -> np.ndarray:
        """start << 16 | size, in WHOLE, of symbols by the frequencies so far; then these symbols are counted."""
        sums, before = self.sums, self.before
        sums[:, 0] = self.counts[:, 0]
        for k in range(1, 16):
            np.add(sums[:, k - 1], self.counts[:, k], out=sums[:, k])
        for k, x in enumerate(sums[:, 15]):
            np.add(before[k], x, out=before[k + 1])
        sums += before[:-1, None]
        at = symbol * self.lines + line
        end, start = sums.ravel()[at].astype(np.float64), self.counts.ravel()[at].astype(np.float64)
        total = before[-1][line].astype(np.float64)
        np.subtract(end, start, out=start)
        for x in (start, end):  # quotients of integers below 2**32 and 2**16 are never rounded up to the next integer
            x *= WHOLE
            x /= total
        np.add.at(self.counts.reshape(-1), at, np.uint16(INCREMENT))
        begin = start.astype(np.int32)
        return (begin << 16 | end.astype(np.int32) - begin).view(np.uint32)


def _literals(ids: np.ndarray, literal: np.ndarray, place: np.ndarray, code: np.ndarray, high_parts: int) -> None:
    """Put start << 16 | size of the high part and of the low byte of each literal id at its place, and the next, in code."""
    n, most = ids.shape
    highs, lows = _Frequencies(high_parts, n), _Frequencies(256, n * GROUPS)
    for a, b in zip((0, *REFRESH), (*REFRESH, most)):
        if a >= most:
            break
        mine = literal[:, a:b]
        at = np.flatnonzero(mine)
        row = np.repeat(np.arange(n), np.count_nonzero(mine, axis=1))
        x, k = ids[:, a:b].ravel()[at], place[:, a:b].ravel()[at]
        high = x >> 8
        code[k] = highs.intervals(high, row)
        code[k + 1] = lows.intervals(x & 255, row * GROUPS + high * GROUPS // high_parts)


def _steps(ids: np.ndarray, size: np.ndarray, high_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of coding steps of each row; start << 16 | width of every step, row after row) of rows of ids."""
    n, most = ids.shape
    inside = (np.arange(most)[None, :] < size[:, None]).ravel()
    last, before = np.full((n, most), NO_ID, np.int32), np.full((n, most), NO_ID, np.int32)
    last[:, 1:], before[:, 2:] = ids[:, :-1], ids[:, :-2]
    x = ids.ravel()
    packed = x << 3 | _levels(ids)
    one, two = _follow(packed, slot1(last)), _follow(packed, slot2(last, before))
    q1, q2, has1, has2 = one >> 6, two >> 6, (one & 7 > 0) & inside, (two & 7 > 0) & inside
    hit2 = has2 & (q2 == x)
    asks1 = has1 & ~(has2 & ((q1 == q2) | hit2))
    hit1 = asks1 & (q1 == x)
    literal = inside & ~hit2 & ~hit1
    asked = has2 | asks1
    number = -(-most // CHUNK)
    base = ((np.arange(n)[:, None] + np.arange(most) // CHUNK * n) << 3).ravel()
    first, second = np.zeros(n * most, np.int32), np.zeros(n * most, np.int32)
    for which, wanted, held in ((0, has2, hit2), (1, asks1, hit1)):
        at = np.flatnonzero(wanted)
        a, b = one[at], two[at]
        p = _probabilities(base[at], held[at], classes(which, a & 7, b & 7, a >> 6 == b >> 6, ((a if which else b) >> 3) & 7), n, number)
        if which == 0:
            first[at] = p << 4
        else:
            left = WHOLE - first[at]
            second[at] = np.clip(left * p >> 12, 1, left - 1)
    step = asked.astype(np.uint8) + (literal.astype(np.uint8) << 1)
    place = np.cumsum(step, dtype=np.int32)
    ends = place[most - 1 :: most].astype(I64)
    place -= step
    code = np.empty(int(ends[-1]), np.uint32)
    both = first + second
    start = np.where(hit2, 0, np.where(hit1, first, both))
    width = np.where(hit2, first, np.where(hit1, second, WHOLE - both))
    code[place[asked]] = (start.astype(np.uint32) << np.uint32(16) | width.astype(np.uint32))[asked]
    _literals(ids, literal.reshape(n, most), (place + asked).reshape(n, most), code, high_parts)
    return np.diff(ends, prepend=0), code


def _encode(blocks: list[np.ndarray], high_parts: int) -> list[bytes]:
    n, most = len(blocks), max(map(len, blocks))
    if not most:
        return [b""] * n
    size = np.array([len(b) for b in blocks])
    numbers, codes = [], []
    for lot in range(0, n, LOT):
        own = size[lot : lot + LOT]
        ids = np.zeros((len(own), most), np.int32)
        for i, b in enumerate(blocks[lot : lot + LOT]):
            ids[i, : len(b)] = b
        for to, found in zip((numbers, codes), _steps(ids, own, high_parts)):
            to.append(found)
    number = np.concatenate(numbers)
    code = np.concatenate([*codes, np.zeros(STEPS, np.uint32)])
    del codes
    order = np.argsort(-number, kind="stable")
    begins, number = (np.cumsum(number) - number)[order], number[order]
    windows = np.lib.stride_tricks.sliding_window_view(code, STEPS)
    # the width of every interval in turn; what lies below it is summed modulo 2**64, and noted when a digit is settled
    low, whole = np.zeros(n, U64), np.full(n, (1 << 48) - 1, U64)
    sixteen, most_bits, least = np.array(16, U64), np.array(59, U64), np.array(1 << 32, U64)
    lots = []  # how many digits of each block were settled, and the sums then
    for step in range(0, int(number[0]), STEPS):
        m = int(np.searchsorted(-number, -step, "left"))
        both = np.ascontiguousarray(windows[begins[:m] + step].T)
        part = (both & np.uint32(0xFFFF)).astype(U64)
        unit, moved, w = np.empty((STEPS, m), U64), np.empty((STEPS, m), U64), whole[:m]
        for u, p, s in zip(unit, part, moved):
            np.right_shift(w, sixteen, out=u)
            np.multiply(u, p, out=w)
            np.subtract(w, least, out=s)  # has its upper bits set if w is less
            np.right_shift(s, most_bits, out=s)
            np.bitwise_and(s, sixteen, out=s)
            np.left_shift(w, s, out=w)
        unit *= both >> np.uint32(16)
        if number[m - 1] < step + STEPS:
            over = np.arange(step, step + STEPS)[:, None] >= number[:m]
            unit[over] = 0
            moved[over] = 0
        unit[0] += low[:m]
        for k in range(1, STEPS):
            np.add(unit[k - 1], unit[k], out=unit[k])
        low[:m] = unit[-1]
        settled = np.ascontiguousarray(moved.astype(np.bool_).T)
        at = np.flatnonzero(settled)
        lots.append((np.count_nonzero(settled, axis=1), unit.ravel()[(at & STEPS - 1) * m + (at >> STEPS_BITS)]))
    lots.append((np.ones(n, I64), low))
    count = np.zeros(n, I64)
    for c, _ in lots:
        count[: len(c)] += c
    # what each digit's time added lies in three digits
    ends = np.cumsum(count + 2)
    place, before = ends - count - 2, np.zeros(n, U64)
    digits = np.zeros(int(ends[-1]), np.uint32)
    for c, total in lots:
        some = np.flatnonzero(c)
        c = c[some]
        last = np.cumsum(c)
        added = total.copy()
        added[1:] -= total[:-1]
        added[last - c] = total[last - c] - before[some]
        before[some] = total[last - 1]
        at = np.repeat(place[some] - (last - c), c) + np.arange(len(added))
        digits[at] += (added >> U64(32)).astype(np.uint32)
        digits[at + 1] += (added >> U64(16)).astype(np.uint32) & np.uint32(0xFFFF)
        digits[at + 2] += added.astype(np.uint32) & np.uint32(0xFFFF)
        place[some] += c
    over = digits >> 16
    digits &= 0xFFFF
    digits[:-1] += over[1:]
    carry = np.flatnonzero(digits >> 16)
    while len(carry):
        digits[carry] &= 0xFFFF
        carry -= 1
        digits[carry] += 1
        carry = carry[digits[carry] >> 16 > 0]
    digits = digits.astype("<u2")
    out = [b""] * n
    for of, a, b in zip(order.tolist(), [0, *ends.tolist()], ends.tolist()):
        if size[of]:
            out[of] = digits[a:b].tobytes()
    return out


def encode(blocks: list[np.ndarray], high_parts: int = 256) -> list[bytes]:
    """The coded form of each block of ids."""
    out: list[bytes] = []
    for k in range(0, len(blocks), LANES):
        out += _encode(blocks[k : k + LANES], high_parts)
    return out


class Model:
    """The models of n blocks, which the decoder moves on id by id together."""

    def __init__(self, n: int, high_parts: int) -> None:
        self.lane = np.arange(n)
        self.high_parts = high_parts
        self.tables = [np.zeros((3, n << SLOT_BITS), np.int32) for _ in range(2)]  # of order 1 and 2: id, in a row, level
        for x in self.tables:
            x[0] = -1
        self.seen = np.zeros(n << 16, np.int16)
        # by decision, block, estimate and class: tried, came true; those of this chunk apart
        self.old, self.new = np.zeros((2, 2, n, 3, 8), I64), np.zeros((2, 2, n, 3, 8), I64)
        self.cost = np.zeros((2, n, 3), I64)
        self.p = shares(self.old[:, 0], self.old[:, 1])
        self.part = parts(self.p, self.cost)
        self.highs, self.lows = np.zeros((n, high_parts), np.int32), np.zeros((n, GROUPS, 256), np.int32)
        self.last, self.before = np.full(n, NO_ID, np.int32), np.full(n, NO_ID, np.int32)
        self.refresh()

    def refresh(self) -> None:
        self.high_sums, self.low_sums = scaled(self.highs), scaled(self.lows)

    def look(self, k: int, step: int) -> None:
        if step and step % CHUNK == 0:
            self.cost += spent(self.p, self.new[:, 0], self.new[:, 1])
            self.old += self.new
            self.new[:] = 0
            self.p = shares(self.old[:, 0], self.old[:, 1])
            self.part = parts(self.p, self.cost)
        if step in REFRESH:
            self.refresh()
        lane, last, before = self.lane[:k] << SLOT_BITS, self.last[:k], self.before[:k]
        self.at = lane + slot1(last), lane + slot2(last, before)
        (self.q1, self.c1, l1), (self.q2, self.c2, l2) = (x[:, at] for x, at in zip(self.tables, self.at))
        agree = self.q1 == self.q2
        self.ask2 = self.c2 > 0
        self.ask1 = (self.c1 > 0) & ~(self.ask2 & agree)
        self.of = classes(0, self.c1, self.c2, agree, l2), classes(1, self.c1, self.c2, agree, l1)
        p = []
        for which in (0, 1):
            dot = sum(self.part[which, self.lane[:k], e, self.of[which][e]] for e in range(3)) >> 16
            p.append(SQUASH[np.clip(dot, -2047, 2047) + 2047])
        self.a, self.b = intervals(self.ask2, p[0], self.ask1, p[1])

    def move(self, k: int, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        for which, asked, hit in ((0, self.ask2, hit2), (1, self.ask1 & ~hit2, hit1)):
            at = np.flatnonzero(asked)
            for e in range(3):
                self.new[which, 0, at, e, self.of[which][e][at]] += 1
                self.new[which, 1, at, e, self.of[which][e][at]] += hit[at]
        place = (self.lane[:k] << 16) + (ids & 0xFFFF)
        self.seen[place] += 1
        level = LEVEL[self.seen[place]]
        for entries, at, q, c in zip(self.tables, self.at, (self.q1, self.q2), (self.c1, self.c2)):
            entries[:, at] = ids, np.where((q == ids) & (c > 0), np.minimum(c + 1, 7), 1), level
        at = np.flatnonzero(~hit2 & ~hit1)
        high, low = ids[at] >> 8, ids[at] & 255
        self.highs[at, high] += 1
        self.lows[at, high * GROUPS // self.high_parts, low] += 1
        self.before[:k], self.last[:k] = self.last[:k], ids


def _decode(payloads: list[bytes], sizes: list[int], high_parts: int) -> list[np.ndarray]:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    n, most = len(order), max(sizes)
    size = np.array([sizes[i] for i in order])
    data = [np.frombuffer(payloads[i], "<u2").astype(U64) for i in order]
    wide = max(map(len, data)) + 4
    digits = np.zeros((n, wide), U64)
    for i, d in enumerate(data):
        digits[i, : len(d)] = d
    model = Model(n, high_parts)
    code = digits[:, 0] << U64(32) | digits[:, 1] << U64(16) | digits[:, 2]
    next_ = np.full(n, 3)
    width = np.full(n, (1 << 48) - 1, U64)
    out = np.zeros((most, n), I64)

    def value(at: np.ndarray) -> np.ndarray:
        return np.minimum(code[at] // (width[at] >> U64(16)), U64(WHOLE - 1)).astype(I64)

    def take(at: np.ndarray, start: np.ndarray, part: np.ndarray) -> None:
        unit = width[at] >> U64(16)
        code[at] -= unit * start.astype(U64)
        width[at] = unit * part.astype(U64)
        small = at[width[at] < U64(1 << 32)]
        code[small] = code[small] << U64(16) | digits[small, np.minimum(next_[small], wide - 1)]
        next_[small] += 1
        width[small] <<= U64(16)

    def symbol(at: np.ndarray, sums: np.ndarray) -> np.ndarray:
        v = value(at)
        found = np.minimum((sums[:, 1:] <= v[:, None]).sum(axis=1), sums.shape[1] - 2)
        i = np.arange(len(at))
        take(at, sums[i, found], sums[i, found + 1] - sums[i, found])
        return found

    for t in range(most):
        k = int(np.searchsorted(-size, -t, "left"))
        model.look(k, t)
        hit2, hit1 = np.zeros(k, np.bool_), np.zeros(k, np.bool_)
        at = np.flatnonzero(model.ask2 | model.ask1)
        if len(at):
            v, a, b = value(at), model.a[at], model.b[at]
            hit2[at] = v < a
            hit1[at] = (v >= a) & (v < a + b)
            take(at, np.where(v < a, 0, np.where(v < a + b, a, a + b)), np.where(v < a, a, np.where(v < a + b, b, WHOLE - a - b)))
        x = np.where(hit2, model.q2, model.q1)
        at = np.flatnonzero(~hit2 & ~hit1)
        if len(at):
            high = symbol(at, model.high_sums[at])
            x[at] = high << 8 | symbol(at, model.low_sums[at, high * GROUPS // high_parts])
        out[t, :k] = x
        model.move(k, x, hit2, hit1)
    back = [np.zeros(0, I64)] * n
    for lane, i in enumerate(order):
        back[i] = out[: size[lane], lane].copy()
    return back


def decode(payloads: list[bytes], sizes: list[int], high_parts: int = 256) -> list[np.ndarray]:
    """The ids of coded blocks, which may come in any order."""
    out: list[np.ndarray] = []
    for k in range(0, len(sizes), ROWS):
        part = sizes[k : k + ROWS]
        out += _decode(payloads[k : k + ROWS], part, high_parts) if max(part) else [np.zeros(0, I64)] * len(part)
    return out


def vocabulary(raw: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("postlake", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_DOUBT = _SPACE.copy()  # bytes of white space and those that may begin white space beyond ASCII
_DOUBT[[0xC2, 0xE1, 0xE2, 0xE3]] = True
SHORT = 16  # bytes of a piece that is known by its bytes
_KEPT = np.array([[(1 << 8 * min(n, 8)) - 1 for n in range(SHORT + 1)], [(1 << 8 * max(n - 8, 0)) - 1 for n in range(SHORT + 1)]], U64)


def room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy of twice the length or more, with room for n entries."""
    if n <= len(x):
        return x
    out = np.zeros((max(n, 2 * len(x)), *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


def short_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each span, and the next eight, as numbers; zeros beyond its end."""
    padded = np.zeros((len(data) // 8 + 3) * 8, np.uint8)
    padded[: len(data)] = data
    aligned = padded.view("<u8").astype(U64, copy=False)
    at, right = start >> 3, (start & 7).astype(U64) << U64(3)
    left = U64(64) - right  # a shift by 64 gives 0
    a, b, c = aligned[at], aligned[at + 1], aligned[at + 2]
    some = np.minimum(size, SHORT)
    return (a >> right | b << left) & _KEPT[0][some], (b >> right | c << left) & _KEPT[1][some]


def _alike(rows: np.ndarray, words: tuple[np.ndarray, ...] | list[np.ndarray]) -> np.ndarray:
    """Whether the table's rows are of the pieces with these words and lengths."""
    return (rows[:, 0] == words[0]) & (rows[:, 1] == words[1]) & (rows[:, 2] >> U64(32) == words[2])


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces that the pattern never joins: before a single blank between other characters, and around a single line feed."""
    n = len(data)
    cut = np.zeros(n + 1, np.bool_)
    if n > 2:
        space = _SPACE[data]
        # characters that may be white space beyond ASCII end in a byte after these lead bytes
        lead2, lead3 = data == 0xC2, (data >= 0xE1) & (data <= 0xE3)
        doubt = np.zeros(n, np.bool_)
        doubt[1:] |= lead2[:-1]
        doubt[2:] |= lead3[:-2]
        solid_before, solid_after = ~space & ~doubt, ~space & ~lead2 & ~lead3
        alone = space[1:-1] & solid_before[:-2] & solid_after[2:]
        cut[1 : n - 1] |= alone & ((data[1:-1] == 32) | (data[1:-1] == 10))
        cut[2:n] |= alone & (data[1:-1] == 10)
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Tokens:
    """A tokenizer that remembers the ids of the pieces it has met.

    A piece of at most SHORT bytes is known by these bytes themselves, as two words, and its
    length.  A longer one is known by its hash.  Two pieces may have one hash, so the ids of
    long pieces are turned back into bytes, and a piece that doesn't come back as itself is
    made into ids on its own.
    """

    def __init__(self, raw: bytes) -> None:
        self.coder = vocabulary(raw)
        ranks = self.coder._mergeable_ranks
        self.high_parts = high_parts(max(ranks.values(), default=0) + 1)
        length = np.zeros(max(ranks.values(), default=0) + 1, I64)
        for token, i in ranks.items():
            length[i] = len(token)
        self.begin, self.length = np.cumsum(length) - length, length
        self.line = ranks.get(b"\n")
        self.letters = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.filled = 1, 0  # pieces, the first of which is none, and their ids
        self.table = np.zeros((1, 4), U64)  # of each piece: its two words, length << 32 | number of ids, where they begin
        self.flat = np.zeros(0, np.int32)
        self.slots = np.zeros((2, 1 << PLACE_BITS), np.int32)  # of either half of a hash: where in table it is, 0 if nowhere

    def _find(self, hashes: np.ndarray, words: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(the table's row of each piece, which pieces have none): those that are new or have lost their place to others."""
        found = self.table.take(self.slots[0][(hashes >> U64(64 - PLACE_BITS)).view(I64)], axis=0)
        lost = np.flatnonzero(~_alike(found, words))
        if len(lost):
            found[lost] = self.table.take(self.slots[1][(hashes[lost] & U64((1 << PLACE_BITS) - 1)).view(I64)], axis=0)
            lost = lost[~_alike(found[lost], [x[lost] for x in words])]
        return found, lost

    def _add(self, hashes: np.ndarray, words: list[np.ndarray], ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        a, b = self.known, self.known + len(hashes)
        self.table, self.flat = room(self.table, b), room(self.flat, self.filled + len(ids))
        for k, x in enumerate((words[0], words[1], words[2] << U64(32) | count.view(U64), (self.filled + np.cumsum(count) - count).view(U64))):
            self.table[a:b, k] = x
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.known, self.filled = b, self.filled + len(ids)
        place = np.arange(a, b, dtype=np.int32)
        one = (hashes >> U64(64 - PLACE_BITS)).view(I64)
        free = self.slots[0][one] == 0
        self.slots[0][one[free]] = place[free]
        rest = self.slots[0][one] != place
        self.slots[1][(hashes[rest] & U64((1 << PLACE_BITS) - 1)).view(I64)] = place[rest]
        return self.table[a:b]

    def _learn(self, data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces by the tokenizer.

        Pieces with no white space, but for a blank in front of something, go through it at once
        on lines of their own: a line feed between such pieces is always an id by itself, and
        what is on either side is as if it were alone.  The others go one by one.
        """
        length = end - start
        text = data[ragged(start, length)]
        first = np.cumsum(length) - length
        doubt = _DOUBT[text]
        doubt[first] &= (text[first] != 32) | (length == 1)
        alone = np.logical_or.reduceat(doubt, first) | (self.line is None)
        plain, others = np.flatnonzero(~alone), np.flatnonzero(alone).tolist()
        size = length[plain]
        lines = np.full(int(size.sum()) + len(plain), 10, np.uint8)
        lines[ragged(np.cumsum(size + 1) - size - 1, size)] = text[ragged(first[plain], size)]
        found = np.array(self.coder.encode_ordinary(lines.tobytes().decode()), np.int32)
        apart = [self.coder.encode_ordinary(raw[start[i] : end[i]].decode()) for i in others]
        count = np.zeros(len(start), I64)
        count[plain] = np.diff(np.flatnonzero(found == self.line), prepend=-1) - 1
        count[others] = [len(x) for x in apart]
        where = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        ids[ragged(where[plain], count[plain])] = found[found != self.line]
        for i, x in zip(others, apart):
            ids[where[i] : where[i] + count[i]] = x
        return ids, count

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces that lie end to end."""
        base = int(start[0])
        data, start, end = data[base : int(end[-1])], start - base, end - base
        raw, size = data.tobytes(), end - start
        one, two = short_words(data, start, size)
        long = np.flatnonzero(size > SHORT)
        text = data[ragged(start[long], size[long])]
        last = np.cumsum(size[long])
        one[long], two[long] = spans(prefix(text.astype(U64) + U64(1)), last - size[long], last), 0
        words = one, two, size.view(U64)
        hashes = mix(one * U64(0x9E3779B97F4A7C15) + mix(two + words[2]))
        found, new = self._find(hashes, words)
        wrong = np.zeros(len(start), np.bool_)
        if len(new):
            if self.known > KNOWN:
                self.forget()
                new = np.arange(len(start))
            unique, first, same = np.unique(hashes[new], return_index=True, return_inverse=True)
            first = new[first]
            found[new] = self._add(unique, [x[first] for x in words], *self._learn(data, raw, start[first], end[first]))[same]
            wrong[new] = ~_alike(found[new], [x[new] for x in words])
        number = (found[:, 2] & U64(0xFFFFFFFF)).view(I64)
        ids = self.flat[ragged(found[:, 3].view(I64), number)]
        bounds = np.concatenate([[0], np.cumsum(number)])
        if len(long):
            # the bytes of the ids, piece by piece, against the text
            own = ids[ragged(bounds[long], number[long])]
            length = self.length[own]
            upto = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(number[long])])]
            if np.array_equal(upto[1:], last):
                bad = np.flatnonzero(self.letters[ragged(self.begin[own], length)] != text)
                wrong[long[np.searchsorted(last, bad, "right")]] = True
            else:
                for i in long.tolist():
                    own = ids[bounds[i] : bounds[i + 1]]
                    wrong[i] |= not np.array_equal(self.letters[ragged(self.begin[own], self.length[own])], data[start[i] : end[i]])
        for i in np.flatnonzero(wrong).tolist()[::-1]:
            own = np.array(self.coder.encode_ordinary(raw[start[i] : end[i]].decode()), np.int32)
            ids = np.concatenate([ids[: bounds[i]], own, ids[bounds[i + 1] :]])
            number[i] = len(own)
        return ids, number

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        data, offsets = text_bytes(texts)
        start = pieces(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(texts), I64)
        end = np.append(start[1:], len(data))
        found, at = [], 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + min(LOOK_BYTES, PORTION_BYTES), "right")))
            found.append(self._ids(data, start[at:to], end[at:to]))
            at = to
        ids, per_piece = (np.concatenate(x) for x in zip(*found))
        sums = np.concatenate([[0], np.cumsum(per_piece)])
        return ids, np.diff(sums[np.searchsorted(start, offsets)])


_of_worker: dict[bytes, Tokens] = {}


def tokens_of(raw: bytes) -> Tokens:
    """The worker's tokenizer of this vocabulary file, which it keeps from task to task."""
    key = hashlib.blake2b(raw).digest()
    if key not in _of_worker:
        _of_worker.clear()
        _of_worker[key] = Tokens(raw)
    return _of_worker[key]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokens_to_blocks(docs: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row for each block: its documents, where their parts start, how many ids each has, CRC-32, and the code."""
    with open(path or spark.conf.get(VOCABULARY_CONF, VOCABULARY), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # the vocabulary file, of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(sent.value)
        for batch in chunks(batches, limit=PORTION_BYTES):
            ids, number = tokens(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            first = np.cumsum(number) - number
            every = range(0, max(len(ids), 1), BLOCK)
            for lot in range(0, len(every), LANES):
                starts = every[lot : lot + LANES]
                blocks = [ids[s : s + BLOCK] for s in starts]
                rows = []
                for s, block, coded in zip(starts, blocks, encode(blocks, tokens.high_parts)):
                    e = s + len(block)
                    # a document stands in each block that it has ids in, one without ids in the block of its place
                    a = int(np.searchsorted(first + number, s, "right" if s else "left"))
                    b = int(np.searchsorted(first, e, "left" if e < len(ids) else "right"))
                    part = np.maximum(first[a:b], s), np.minimum(first[a:b] + number[a:b], e)
                    rows.append((doc_ids[a:b], (part[0] - first[a:b]).tolist(), (part[1] - part[0]).tolist(), e - s, tokens.high_parts, checksum(block), coded))
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_ids", "starts", "counts", "n_ids", "high_parts", "crc", "payload"])

    return docs_of(docs).mapInArrow(run, SCHEMA)


def blocks_to_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, ids): the decoded parts of documents; a block whose checksum is wrong raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for parts_ in sorted({r["high_parts"] for r in rows}):
                mine = [r for r in rows if r["high_parts"] == parts_]
                for r, ids in zip(mine, decode([r["payload"] for r in mine], [r["n_ids"] for r in mine], parts_)):
                    if checksum(ids) != r["crc"]:
                        raise ValueError("a block's checksum is wrong")
                    at = 0
                    for d, s, c in zip(r["doc_ids"], r["starts"], r["counts"]):
                        out.append((d, s, ids[at : at + c].tolist()))
                        at += c
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, start int, ids array<int>")


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_to_blocks(table(spark, sf_dir, "documents"), spark)
