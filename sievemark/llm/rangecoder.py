"""An adaptive context-mixing range coder for token ids, run on many blocks in step.

A block is coded by itself, from a fresh model: first its dictionary, the ids in the order of their first place (bit
lengths by adaptive frequencies, then the bits), then the places' slots in that dictionary. Order 2 proposes the slot
that last followed the two before, order 1 the one that last followed the one before. Whether the proposal holds is a
probability that a logistic mixer makes of three predictions, the records of order 2 and of order 1 at their present
confidence and the slot's frequency so far (order 0), with weights that learn from every outcome. A slot that isn't
proposed is coded by its order-0 frequency, which every id updates at once and which fades, as texts change; the next
new one is an escape there. All of that drives a carryless 64-bit range coder that writes 16-bit words.

Python can't afford a loop per id, so all blocks of a batch go forward together: step k codes the k-th id of every
block, as numpy operations on arrays with an element per block. The model is integers throughout, so that every machine
decodes alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np

U = np.uint64
#: Contexts remembered by a block for each of order 1 and 2; slots whose frequencies are summed together, as their sums are again.
_CONTEXTS, _GROUP = 1 << 12, 32
#: What an id adds to its frequency, the escape's frequency for each id seen, and steps after which all frequencies are halved.
_GAIN, _ESCAPE, _HALVED = 16, 2, 512
#: Bits of a mixed probability, the least and most of it; most confidence; bits of an id.
_BITS, _LEAST, _MOST, _SURE, _ID_BITS = 12, 16, 4080, 7, 32
_BOTTOM, _ALL = U(1) << U(40), U(2**64 - 1)


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """12-bit probabilities of logits from -2047 to 2047 in steps of 1/256, and the logit of each probability. Decimal arithmetic
    gives the same tables everywhere."""
    with localcontext() as c:
        c.prec = 30
        squash = np.array([int(4096 / (1 + (Decimal(-x) / 256).exp())) for x in range(-2047, 2048)], np.int64)
    stretch = np.searchsorted(squash, np.arange(4096)).clip(0, 4094) - 2047
    return squash.clip(_LEAST, _MOST), stretch


_SQUASH, _STRETCH = _logistic()
#: Row k masks the places below k of a group of 16-bit numbers; four of them are added at once as one of 64 bits, since no sum
#: of frequencies takes more than 16. The other table adds up all numbers up to each place, exactly, as they are small.
_BELOW = (np.tri(_GROUP, _GROUP, -1, np.uint16) * np.uint16(0xFFFF)).view(np.uint64)
_UPTO = np.tri(_GROUP, _GROUP, 0, np.float32).T.copy()


def _sum_below(table: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sum of a table's numbers in a group before a place of it."""
    lanes = table.view(np.uint64).reshape(-1, _GROUP // 4)[group] & _BELOW[place]
    lanes = lanes[:, :4] + lanes[:, 4:]
    lanes = lanes[:, :2] + lanes[:, 2:]
    lanes = lanes[:, 0] + lanes[:, 1]
    lanes = (lanes & U(0x0000FFFF0000FFFF)) + (lanes >> U(16) & U(0x0000FFFF0000FFFF))
    return ((lanes & U(0xFFFFFFFF)) + (lanes >> U(32))).astype(np.int64)
#: The mixer's weights of orders 2, 1 and 0 at first, in 1 / 65536.
_WEIGHTS = ((36_000,), (20_000,), (12_000,))


class _Model:
    """The adaptive state of all blocks, which have `kinds` different ids; coding and decoding update it alike."""

    def __init__(self, kinds: np.ndarray, longest: int):
        n = len(kinds)
        self.block, self.kinds, self.seen = np.arange(n, dtype=np.int64), kinds, np.zeros(n, np.int64)
        # frequencies of slots, sums of _GROUP of them, and sums of _GROUP of those
        self.room = -(-max(longest, 1) // _GROUP**2) * _GROUP**2
        self.counts, self.sums = np.zeros(n * self.room, np.uint16), np.zeros(n * self.room // _GROUP, np.uint16)
        self.tops, self.total = np.zeros((n, self.room // _GROUP**2), np.int64), np.zeros(n, np.int64)
        # orders 2 and 1 side by side: the slot proposed by each context and how sure it is (0: none) in 16 bits, and the record
        # by sureness; small tables matter, as every step goes all over them
        self.proposed = np.zeros(2 * n * _CONTEXTS, np.uint16)
        self.record = np.full(2 * n * (_SURE + 1), 1 << 14, np.int64)
        self.base, self.own = np.stack([self.block, self.block + n]) * _CONTEXTS, np.stack([self.block, self.block + n]) * (_SURE + 1)
        self.weights = np.repeat(np.array(_WEIGHTS, np.int64), n, 1)
        self.key, self.older = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, n: int, step: int) -> np.ndarray:
        """For the first n blocks: `slot` proposed (if `has`), and how much of 2**12 the proposal gets."""
        self.n = n
        if step and step % _HALVED == 0:
            self.fade()
        key = self.key[:n]
        at = self.base[:, :n].copy()
        at[0] += (key ^ self.older[:n] * 5) >> 2 & (_CONTEXTS - 1)
        at[1] += key >> 3 & (_CONTEXTS - 1)
        both = self.proposed[at].astype(np.int64)
        self.at, self.old, self.conf = at, both >> 3, both & _SURE
        two, one = self.old
        self.slot = np.where(self.conf[0] > 0, two, one)
        self.has = (self.conf[0] | self.conf[1]) > 0
        conf = self.conf.copy()
        conf[1] *= one == self.slot
        self.at_record = self.own[:, :n] + conf
        self.was = self.record[self.at_record]
        self.inputs = np.empty((3, n), np.int64)
        self.inputs[:2] = self.was >> 4
        self.inputs[2] = self.counts[self.block[:n] * self.room + self.slot] * np.int64(4095) // np.maximum(self.total[:n], 1)
        self.inputs = _STRETCH[self.inputs]
        logit = (self.weights[:, :n] * self.inputs).sum(0) >> 16
        self.p = _SQUASH[np.minimum(np.maximum(logit, -2047), 2047) + 2047]
        return self.p * self.has

    def fade(self) -> None:
        """Halves all frequencies; what a block has seen keeps at least 1."""
        used = -(-int(self.seen.max()) // _GROUP**2) * _GROUP**2
        counts = self.counts.reshape(-1, self.room)[:, :used]
        counts[:] = np.maximum(counts >> 1, counts != 0)
        sums = counts.reshape(len(counts), -1, _GROUP).sum(2, dtype=np.uint16)
        self.sums.reshape(len(counts), -1)[:, : sums.shape[1]] = sums
        self.tops[:, : used // _GROUP**2] = sums.reshape(len(counts), -1, _GROUP).sum(2, dtype=np.int64)
        self.total = self.tops.sum(1)

    def escape(self) -> np.ndarray:
        """The frequency of an id that is new to the block; 0 if it has had all of its kinds."""
        seen = self.seen[: self.n]
        return np.where(seen < self.kinds[: self.n], np.maximum(seen * _ESCAPE, 1), 0)

    def order0(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of frequencies below the slots, and their own; a new one is above all."""
        n = self.n
        fresh = slot == self.seen[:n]
        known = np.where(fresh, 0, slot)
        at = self.block[:n] * self.room + known
        below = _sum_below(self.counts, at // _GROUP, known % _GROUP)
        below += _sum_below(self.sums, at // _GROUP**2, known // _GROUP % _GROUP)
        deep = np.flatnonzero(known >= _GROUP**2)
        if len(deep):
            below[deep] += (self.tops[deep] * (np.arange(self.tops.shape[1]) < known[deep, None] // _GROUP**2)).sum(1)
        return np.where(fresh, self.total[:n], below), np.where(fresh, 0, self.counts[at])

    def slot_at(self, rest: np.ndarray) -> np.ndarray:
        """The slot whose frequencies hold a value below their sum."""
        row, slot = self.block[: self.n], np.zeros(self.n, np.int64)
        deep = np.flatnonzero(rest >= self.tops[: self.n, 0])
        if len(deep):
            own = self.tops[deep]
            upto = np.cumsum(own, 1)
            place = np.minimum((upto <= rest[deep, None]).sum(1), upto.shape[1] - 1)
            slot[deep] = place
            rest = rest.copy()
            rest[deep] -= upto[np.arange(len(deep)), place] - own[np.arange(len(deep)), place]
        for table, size in ((self.sums, _GROUP**2), (self.counts, _GROUP)):
            own = table.reshape(-1, _GROUP)[row * (self.room // size) + slot].astype(np.float32)
            upto = own @ _UPTO
            over = (upto <= rest.astype(np.float32)[:, None]).view(np.uint64)
            over = np.bitwise_count(over).astype(np.int64)
            place = np.minimum(over[:, 0] + over[:, 1] + over[:, 2] + over[:, 3], _GROUP - 1)
            rest = rest - (upto[row, place] - own[row, place]).astype(np.int64)
            slot = slot * _GROUP + place
        return slot

    def update(self, slot: np.ndarray, held: np.ndarray) -> None:
        n, right = self.n, held.astype(np.int64)
        block = self.block[:n]
        self.record[self.at_record] = self.was + ((((right << 16) - right) - self.was >> 5) * self.has)
        error = ((right << _BITS) - self.p) * self.has * 7
        self.weights[:, :n] += (self.inputs * error + 0x8000) >> 16
        self.seen[:n] += slot == self.seen[:n]
        at = block * self.room + slot
        self.counts[at] += _GAIN
        self.sums[at // _GROUP] += _GAIN
        self.tops[block, slot // _GROUP**2] += _GAIN
        self.total[:n] += _GAIN
        same = (self.old == slot) & (self.conf > 0)
        wrong = np.where(self.conf > 1, self.old << 3 | self.conf >> 1, slot << 3 | 1)
        self.proposed[self.at] = np.where(same, self.old << 3 | np.minimum(self.conf + 1, _SURE), wrong)
        self.older[:n] = self.key[:n]
        self.key[:n] = (slot + 1) * 40_503


def _bit_length(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 0 has none."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.int64) * (ids > 0)


def _unsettled(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks whose top word is final, and those that have to move it out: it is, or the range is too small and has to be cut."""
    same = (low ^ (low + span)) < (U(1) << U(48))
    return same, same | (span < _BOTTOM)


class _Range:
    """Low end and size of every block's interval."""

    def __init__(self, n: int):
        self.low, self.span = np.zeros(n, U), np.full(n, _ALL)

    def narrow(self, block: np.ndarray | slice, under: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        """The part of the interval from `under` units on, `size` units long."""
        self.low[block] += unit * under
        self.span[block] = unit * size

    def settle(self, block: np.ndarray | slice) -> None:
        """Moves out what is final, until each range is large enough."""
        if isinstance(block, slice):
            block = np.flatnonzero(_unsettled(self.low[block], self.span[block])[1])
        while len(block):
            lo, r = self.low[block], self.span[block]
            same, out = _unsettled(lo, r)
            if not out.all():
                block, lo, r, same = block[out], lo[out], r[out], same[out]
            r = np.where(same, r, (~lo + U(1)) & (_BOTTOM - U(1)))
            self.shift(block, lo)
            self.low[block], self.span[block] = lo << U(16), r << U(16)

    def shift(self, block: np.ndarray, low: np.ndarray) -> None:
        raise NotImplementedError


class _Writer(_Range):
    def __init__(self, n: int, longest: int):
        super().__init__(n)
        self.words, self.size = np.zeros((n, longest + 64), np.uint16), np.zeros(n, np.int64)

    def shift(self, block: np.ndarray, low: np.ndarray) -> None:
        at = self.size[block]
        if len(at) and int(at.max()) >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], 1)
        self.words[block, at] = (low >> U(48)).astype(np.uint16)
        self.size[block] += 1

    def codes(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(4):
            self.shift(every, self.low)
            self.low <<= U(16)
        return [self.words[k, : self.size[k]].astype("<u2").tobytes() for k in every]


class _Reader(_Range):
    def __init__(self, codes: list[bytes]):
        super().__init__(len(codes))
        widest = max((len(c) for c in codes), default=0) // 2
        self.words = np.zeros((len(codes), widest + 8), np.uint16)
        for k, c in enumerate(codes):
            self.words[k, : len(c) // 2] = np.frombuffer(c, "<u2")
        self.code, self.at = np.zeros(len(codes), U), np.zeros(len(codes), np.int64)
        for _ in range(4):
            self.shift(np.arange(len(codes)), self.low)

    def shift(self, block: np.ndarray, low: np.ndarray) -> None:
        at = np.minimum(self.at[block], self.words.shape[1] - 1)
        self.code[block] = self.code[block] << U(16) | self.words[block, at].astype(U)
        self.at[block] += 1

    def value(self, block: np.ndarray | slice, unit: np.ndarray, total: np.ndarray) -> np.ndarray:
        """In which unit of its interval each block's code lies."""
        return np.minimum((self.code[block] - self.low[block]) // unit, total - U(1))


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's ids in the order of their first place, and the number there of each of its places."""
    kinds, first, which = np.unique(ids, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(order), np.uint16)
    number[order] = np.arange(len(order))
    return kinds[order], number[which]


def _dictionary_steps(kinds: np.ndarray) -> Iterator[np.ndarray]:
    """For each place in a dictionary, the blocks whose dictionaries reach it."""
    order = np.argsort(-kinds, kind="stable")
    for place in range(int(kinds.max(initial=0))):
        yield order[: int(np.searchsorted(-kinds[order], -place, side="left"))]


def encode_blocks(blocks: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """The number of different ids and the code of each block of ids (32 bits each)."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    lengths = np.array([len(blocks[k]) for k in order], np.int64)
    n, longest = len(order), int(lengths[0]) if len(order) else 0
    # step by step, so that each step is contiguous
    slots, words = np.zeros((longest, n), np.uint16), []
    for row, k in enumerate(order):
        kinds, slots[: len(blocks[k]), row] = _slots(blocks[k])
        words.append(kinds)
    kinds = np.array([len(w) for w in words], np.int64)
    out, table = _Writer(n, longest), np.ones((n, _ID_BITS + 1), np.int64)
    at = np.cumsum(kinds) - kinds
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    for place, block in enumerate(_dictionary_steps(kinds)):
        value = flat[at[block] + place].astype(np.int64)
        length, row = _bit_length(value), np.arange(len(block))
        sums = np.cumsum(table[block], 1)
        own = table[block, length]
        out.narrow(block, (sums[row, length] - own).astype(U), own.astype(U), out.span[block] // sums[:, -1].astype(U))
        table[block, length] += 1
        bits = np.maximum(length - 1, 0)
        few, value = np.minimum(bits, 16), value & ((1 << bits) - 1)
        out.narrow(block, (value & (1 << few) - 1).astype(U), np.ones(len(block), U), out.span[block] >> few.astype(U))
        out.settle(block)
        wide = np.flatnonzero(bits > 16)
        if len(wide):
            out.narrow(block[wide], (value[wide] >> 16).astype(U), np.ones(len(wide), U), out.span[block[wide]] >> (bits[wide] - 16).astype(U))
            out.settle(block[wide])
    model, left = _Model(kinds, longest), n
    for step in range(longest):
        while lengths[left - 1] <= step:
            left -= 1
        every, slot = slice(0, left), slots[step, :left].astype(np.int64)
        take = model.predict(left, step)
        held = model.has & (slot == model.slot)
        out.narrow(every, np.where(held, 0, take).astype(U), np.where(held, take, (1 << _BITS) - take).astype(U), out.span[every] >> U(_BITS))
        escape = model.escape()
        below, own = model.order0(slot)
        # a proposal that held needs no more: all of its interval
        own, total = np.where(own > 0, own, escape), np.where(held, 1, model.total[every] + escape)
        out.narrow(every, np.where(held, 0, below).astype(U), np.where(held, 1, own).astype(U), out.span[every] // total.astype(U))
        out.settle(every)
        model.update(slot, held)
    codes = [(0, b"")] * n
    for k, size, code in zip(order, kinds.tolist(), out.codes(), strict=True):
        codes[k] = size, code
    return codes


def decode_blocks(codes: list[tuple[int, bytes]], lengths: list[int]) -> list[np.ndarray]:
    """The blocks of ids that `encode_blocks` made into codes."""
    order = sorted(range(len(codes)), key=lambda k: -lengths[k])
    size, kinds = np.array([lengths[k] for k in order], np.int64), np.array([codes[k][0] for k in order], np.int64)
    n, longest = len(order), int(size[0]) if len(order) else 0
    code, table = _Reader([codes[k][1] for k in order]), np.ones((n, _ID_BITS + 1), np.int64)
    at = np.cumsum(kinds) - kinds
    flat = np.zeros(int(kinds.sum()), np.uint32)
    for place, block in enumerate(_dictionary_steps(kinds)):
        row, sums = np.arange(len(block)), np.cumsum(table[block], 1)
        total = sums[:, -1].astype(U)
        unit = code.span[block] // total
        length = (sums <= code.value(block, unit, total).astype(np.int64)[:, None]).sum(1)
        own = table[block, length]
        code.narrow(block, (sums[row, length] - own).astype(U), own.astype(U), unit)
        table[block, length] += 1
        bits = np.maximum(length - 1, 0)
        few = np.minimum(bits, 16).astype(U)
        unit = code.span[block] >> few
        value = code.value(block, unit, U(1) << few)
        code.narrow(block, value, np.ones(len(block), U), unit)
        code.settle(block)
        value, wide = value.astype(np.int64), np.flatnonzero(bits > 16)
        if len(wide):
            more = (bits[wide] - 16).astype(U)
            unit = code.span[block[wide]] >> more
            high = code.value(block[wide], unit, U(1) << more)
            code.narrow(block[wide], high, np.ones(len(wide), U), unit)
            code.settle(block[wide])
            value[wide] |= high.astype(np.int64) << 16
        flat[at[block] + place] = np.where(length > 0, value | 1 << bits, 0)
    slots, model, left = np.zeros((longest, n), np.uint16), _Model(kinds, longest), n
    for step in range(longest):
        while size[left - 1] <= step:
            left -= 1
        every = slice(0, left)
        take = model.predict(left, step)
        unit = code.span[every] >> U(_BITS)
        held = code.value(every, unit, U(1 << _BITS)).astype(np.int64) < take
        code.narrow(every, np.where(held, 0, take).astype(U), np.where(held, take, (1 << _BITS) - take).astype(U), unit)
        escape = model.escape()
        total = np.where(held, 1, model.total[every] + escape).astype(U)
        unit = code.span[every] // total
        value = code.value(every, unit, total).astype(np.int64)
        slot = np.where(held, model.slot, np.where(value >= model.total[every], model.seen[every], model.slot_at(np.minimum(value, np.maximum(model.total[every] - 1, 0)))))
        below, own = model.order0(slot)
        own = np.where(own > 0, own, escape)
        code.narrow(every, np.where(held, 0, below).astype(U), np.where(held, 1, own).astype(U), unit)
        code.settle(every)
        slots[step, :left] = slot
        model.update(slot, held)
    blocks: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for row, k in enumerate(order):
        blocks[k] = flat[at[row] + slots[: lengths[k], row]]
    return blocks


MAGIC, BLOCK_IDS, MOST_BLOCK_IDS = b"SMRC\x02\x00", 8192, 8192


def pack_frames(frames: list[np.ndarray], block_ids: int = BLOCK_IDS) -> list[bytes]:
    """Each frame's ids in the file format: magic, number of blocks, then (ids, different ids, bytes, crc32 of the bytes) of each block,
    all little-endian 32-bit, then the blocks' codes. All frames are coded in step."""
    if not 0 < block_ids <= MOST_BLOCK_IDS:
        raise ValueError(f"a block holds 1 to {MOST_BLOCK_IDS} ids")
    if any(len(f) and (int(f.min()) < 0 or int(f.max()) >= 1 << _ID_BITS) for f in frames):
        raise ValueError("the format holds ids of 32 bits")
    blocks = [[f[k : k + block_ids] for k in range(0, len(f), block_ids)] for f in frames]
    codes = iter(encode_blocks([b for bs in blocks for b in bs]))
    out = []
    for bs in blocks:
        own = [next(codes) for _ in bs]
        head = np.array([[len(b), kinds, len(c), zlib.crc32(c)] for b, (kinds, c) in zip(bs, own, strict=True)], "<u4").reshape(-1)
        out.append(MAGIC + np.array([len(bs)], "<u4").tobytes() + head.tobytes() + b"".join(c for _, c in own))
    return out


def unpack_frames(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each frame; a wrong mark, length or checksum is an error."""
    codes, lengths, counts = [], [], []
    for p in payloads:
        if p[:6] != MAGIC or len(p) < 10:
            raise ValueError("not a frame of token ids")
        n = int(np.frombuffer(p, "<u4", 1, 6)[0])
        if len(p) < 10 + 16 * n:
            raise ValueError("a frame of token ids is damaged")
        head = np.frombuffer(p, "<u4", 4 * n, 10).reshape(n, 4)
        at = 10 + 16 * n
        for ids, kinds, size, crc in head.tolist():
            code = p[at : at + size]
            at += size
            if len(code) != size or zlib.crc32(code) != crc:
                raise ValueError("a block of token ids is damaged")
            codes.append((kinds, code))
            lengths.append(ids)
        counts.append(n)
    blocks = iter(decode_blocks(codes, lengths))
    return [np.concatenate([next(blocks) for _ in range(n)]) if n else np.zeros(0, np.uint32) for n in counts]
