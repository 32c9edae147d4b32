"""Blocks of ids as range-coded words, many blocks in step.

Three predictions are mixed for each id: the id that last followed the two ids
before (order 2), the one that last followed the id before (order 1), and the
counts of the ids (order 0). Order 0 counts what it has coded in the block; an id
new to it is coded by the frequencies in the file. The weights of the mixture are learned while
coding: of orders 2 and 1 for every pair of their confidences, of counted against new ids for
every length of the counts. Contexts, confidences, counts and weights start anew
with each block, so a block needs only the frequencies to be read.

All blocks advance together, one id each, as vectors; encoding and
decoding run the same model. A number in a block is the rank of an id in the
frequency table.
"""

from __future__ import annotations

import numpy as np

SLOT_BITS = 11
#: Confidence of a context, from 0 to this.
SURE = 7
STATES = 2 * (SURE + 1) ** 2
UNIT = 16  # bits of a mixing weight
#: The least weight left for order 0, of 2 ** UNIT; keeps every id possible.
LEAST = 64
TOP = (1 << UNIT) - LEAST
RATE = 5
#: Lengths of the counts, as powers of two, that have a weight of their own.
LENGTHS = 24
#: Blocks whose ids are numbered at once.
ROWS_AT_ONCE = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
LOW32 = np.uint64(0xFFFFFFFF)
W32, W16 = np.uint64(32), np.uint64(UNIT)
#: Change of a confidence after a wrong guess, then after a right one.
STEP = np.array([-((c + 1) >> 1) for c in range(SURE + 1)] + [int(c < SURE) for c in range(SURE + 1)], np.int32)


def _moved(weight: np.ndarray, right: np.ndarray) -> np.ndarray:
    """By how much weights move towards ``TOP`` after a right guess, towards ``LEAST`` after a wrong one."""
    out = right * np.int32(TOP - LEAST)
    out += np.int32(LEAST)
    out -= weight
    out >>= RATE
    return out


class Mixer:
    """The model of ``lanes`` blocks."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes) << SLOT_BITS
        self.states = np.arange(lanes) * STATES
        # A rank and, in the last three bits, how sure the context is of it.
        self.slots = [np.zeros(lanes << SLOT_BITS, np.int32) for _ in (1, 2)]
        # Chance that order 2 is right, and that order 1 is where order 2 is not.
        self.weight = [np.full(lanes * STATES, 1 << (UNIT - 3), np.int32) for _ in (1, 2)]
        self.last = np.zeros(lanes, np.uint64)
        self.before = np.zeros(lanes, np.uint64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the first ``n`` lanes: both predicted ranks and the widths given to them."""
        shift = np.uint64(64 - SLOT_BITS)
        own = self.lanes[:n]
        mixed = self.last[:n] * ODD
        self.at1 = (mixed >> shift).view(np.int64) + own
        mixed ^= self.before[:n] + np.uint64(1)
        mixed *= ODD
        self.at2 = (mixed >> shift).view(np.int64) + own
        self.s1, self.s2 = self.slots[0].take(self.at1), self.slots[1].take(self.at2)
        self.p1, self.p2 = self.s1 >> 3, self.s2 >> 3
        same = self.p1 == self.p2
        self.c1, self.c2 = self.s1 & SURE, self.s2 & SURE
        self.state = self.states[:n] + ((((self.c2 << 3) + self.c1) << 1) + same)
        self.w2, self.w1 = self.weight[1].take(self.state), self.weight[0].take(self.state)
        width2 = ((self.w2.view(np.uint32) * np.uint32(TOP)) >> np.uint32(UNIT)) + np.uint32(1)
        width1 = (((np.uint32(TOP) - width2) * self.w1.view(np.uint32)) >> np.uint32(UNIT)) + np.uint32(1)
        width1 *= ~same
        return self.p1, self.p2, width1, width2

    def learn(self, rank: np.ndarray, right1: np.ndarray, right2: np.ndarray) -> None:
        """Go on from the coded ranks; both guesses are told to be right or not."""
        # Both stay within [LEAST, 2 ** UNIT - LEAST], so a right guess always has a width.
        self.weight[1][self.state] = _moved(self.w2, right2) + self.w2
        moved = _moved(self.w1, right1)
        moved *= ~right2
        moved += self.w1
        self.weight[0][self.state] = moved
        fresh = rank << 3
        for slot, at, s, c, right in (
            (self.slots[0], self.at1, self.s1, self.c1, right1),
            (self.slots[1], self.at2, self.s2, self.c2, right2),
        ):
            # A wrong guess halves the confidence, and is replaced once there is none.
            case = c + (right.view(np.int8) << 3)
            moved = STEP.take(case)
            moved += s
            np.copyto(moved, fresh, where=case == 0)
            slot[at] = moved
        n = len(rank)
        self.before[:n] = self.last[:n]
        np.add(rank, 1, out=self.last[:n].view(np.int64))


class Counts:
    """The ids that order 0 has coded in a block and how often, for many blocks.

    Ids of about equal count (up to the next power of two) make a class. A class is
    as likely as its ids have counts, and its ids are equally likely; so a count costs
    no more than finding a place in a list. Ids go by numbers of the caller's.
    """

    def __init__(self, lanes: int, longest: int):
        self.classes = max(1, int(longest).bit_length())
        # Of n coded ids at most n >> k have a count of 2 ** k.
        room = longest >> np.arange(self.classes)
        self.offset = np.cumsum(room) - room
        self.wide, self.room, self.lanes = longest + 1, int(room.sum()), lanes
        small = np.int16 if longest < 1 << 15 else np.int32
        self.ids = np.zeros(lanes * self.room, small)
        self.count = np.zeros(lanes * self.wide, small)
        self.place = np.zeros(lanes * self.wide, small)
        # A row for each class, so that sums over the classes run along whole rows.
        self.many = np.zeros(self.classes * lanes, np.int64)
        self.mass = np.zeros((self.classes, lanes), np.int32)
        self.masses, self.to = self.mass.ravel(), np.zeros_like(self.mass)
        self.total = np.zeros(lanes, np.int64)
        # Bits of each count: one more than its class.
        self.bits = np.frexp(np.arange(longest + 2))[1].astype(np.int64)
        # Chance of a counted id, by the length of the counts.
        self.states = np.arange(lanes) * LENGTHS
        self.weight = np.full(lanes * LENGTHS, 1 << (UNIT - 1), np.int32)

    def split(self, width0: np.ndarray) -> np.ndarray:
        """The part of the widths of order 0 that is for counted ids; none where nothing is counted."""
        total = self.total[: len(width0)]
        self.state = self.states[: len(width0)] + self.bits.take(total)
        self.w = self.weight.take(self.state)
        inner = (width0 * self.w.view(np.uint32)) >> np.uint32(UNIT)
        inner = np.minimum(np.maximum(inner, np.uint32(1)), width0 - np.uint32(1))
        inner *= total > 0
        return inner

    def _sums(self) -> np.ndarray:
        """The mass of each class and of all before it."""
        self.to[0] = self.mass[0]
        for k in range(1, self.classes):
            np.add(self.to[k - 1], self.mass[k], out=self.to[k])
        return self.to

    def class_of(self, lane: np.ndarray, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of ids at ``at`` with count ``c``: the mass of the classes before and of their own; place and ids there."""
        own = (self.bits.take(c) - 1) * self.lanes + lane
        have = self.masses.take(own)
        before = self._sums().take(own) - have
        return before, have, self.place.take(at), self.many.take(own)

    def find_class(self, lane: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """The class that holds a part of the mass; the mass before it and its own; its ids."""
        to = self._sums()
        every = np.zeros(self.lanes, np.int32)
        every[lane] = target
        k = np.add.reduce((to <= every).view(np.int8), axis=0, dtype=np.int8).take(lane).astype(np.int64)
        own = k * self.lanes + lane
        have = self.masses.take(own)
        return k, to.take(own) - have, have, self.many.take(own)

    def number_at(self, lane: np.ndarray, k: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.ids.take(lane * self.room + self.offset.take(k) + place)

    def learn(self, lane: np.ndarray, number: np.ndarray, at: np.ndarray, c: np.ndarray) -> None:
        """Count ids in the lanes where order 0 has coded; ``c`` tells how often each, at ``at``, was met before."""
        counted = c > 0
        # Without counts there is no choice to learn from, and that weight is of no effect.
        w = self.w.take(lane)
        self.weight[self.state.take(lane)] = _moved(w, counted) + w
        self.total[lane] += 1
        more = c + 1
        self.count[at] = more
        grows = (c & more) == 0  # the count was the last of its class
        stays = np.flatnonzero(~grows)
        self.masses[(self.bits.take(c.take(stays)) - 1) * self.lanes + lane.take(stays)] += 1
        left = np.flatnonzero(grows & counted)
        self._leave(lane.take(left), at.take(left), c.take(left))
        grown = np.flatnonzero(grows)
        lane, at, c = lane.take(grown), at.take(grown), c.take(grown)
        k = self.bits.take(c)
        own = k * self.lanes + lane
        place = self.many.take(own)
        self.ids[lane * self.room + self.offset.take(k) + place] = number.take(grown)
        self.place[at] = place
        self.many[own] = place + 1
        self.masses[own] += c + 1

    def _leave(self, lane: np.ndarray, at: np.ndarray, c: np.ndarray) -> None:
        """Take ids out of their class; the last of the list takes the free place."""
        k = self.bits.take(c) - 1
        own = k * self.lanes + lane
        many = self.many.take(own) - 1
        self.many[own] = many
        self.masses[own] -= c
        start, place = lane * self.room + self.offset.take(k), self.place.take(at)
        last = self.ids.take(start + many)
        self.ids[start + place] = last
        self.place[lane * self.wide + last] = place


def _own_numbers(ranks: np.ndarray) -> np.ndarray:
    """For each place of each block, one number for each different rank of the block, from 0."""
    out = np.empty(ranks.shape, np.int32)
    # Numbers of 16 bits are sorted by their digits.
    short = ranks.max(initial=0) < 1 << 16
    for at in range(0, len(ranks), ROWS_AT_ONCE):
        some = ranks[at : at + ROWS_AT_ONCE]
        order = np.argsort(some.astype(np.uint16) if short else some, axis=1, kind="stable")
        ordered = np.take_along_axis(some, order, 1)
        fresh = np.zeros(some.shape, np.int32)
        fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        np.put_along_axis(out[at : at + ROWS_AT_ONCE], order, np.cumsum(fresh, axis=1, dtype=np.int32), 1)
    return out


class Intervals:
    """The four parts of the intervals of all blocks: order 2, order 1, counted ids, new ids."""

    def __init__(self, lanes: int):
        self.lanes, self.every = lanes, np.arange(lanes)
        self.edges = np.zeros((5, lanes), np.uint64)
        self.edges[4] = 1 << UNIT

    def cut(self, counts: Counts, width1: np.ndarray, width2: np.ndarray) -> np.ndarray:
        n = len(width1)
        inner = width1 + width2
        self.edges[1, :n], self.edges[2, :n] = width2, inner
        np.add(inner, counts.split(np.uint32(1 << UNIT) - inner), out=self.edges[3, :n])
        return self.edges

    def chosen(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of a part, 0 to 3, of each block."""
        at = kind * self.lanes + self.every[: len(kind)]
        begin = self.edges.take(at)
        return begin, self.edges.take(at + self.lanes) - begin


def encode_blocks(ranks: np.ndarray, sizes: np.ndarray, start: np.ndarray, bits: int) -> list[np.ndarray]:
    """Words of each block. ``ranks`` has a row per block, the longest first.

    ``start`` holds the cumulative frequencies of the ranks, ``2 ** bits`` in all.
    """
    lanes, longest = ranks.shape
    mixer, counts, parts = Mixer(lanes), Counts(lanes, longest), Intervals(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0), np.uint64)
    words = np.zeros((lanes, longest + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    first, width0 = start[:-1].astype(np.uint64), np.diff(start).astype(np.uint64)
    live = np.searchsorted(-sizes, -np.arange(longest), "left")
    turned, own = np.ascontiguousarray(ranks.T), np.ascontiguousarray(_own_numbers(ranks).T)
    starts = np.arange(lanes) * counts.wide
    for t in range(longest):
        n = int(live[t])
        rank = turned[t, :n]
        p1, p2, width1, width2 = mixer.predict(n)
        parts.cut(counts, width1, width2)
        right1, right2 = rank == p1, rank == p2
        is0 = ~(right1 | right2)
        zero = np.flatnonzero(is0)
        number = own[t].take(zero)
        at = starts.take(zero) + number
        c = counts.count.take(at)
        fresh = c == 0
        kind = (~right2).astype(np.int64) + is0
        kind[zero] += fresh
        begin, width = parts.chosen(kind)
        part = span[:n] >> W16
        _narrow(low, span, None, begin * part, width * part, words, used)
        met, new = np.flatnonzero(~fresh), zero[fresh]
        lane = zero.take(met)
        before, have, place, many = counts.class_of(lane, at.take(met), c.take(met))
        part = span.take(lane) // counts.total.take(lane).view(np.uint64)
        each = have.astype(np.uint64) * part // many.view(np.uint64)
        begin = before.astype(np.uint64) * part + place.astype(np.uint64) * each
        _narrow(low, span, lane, begin, each, words, used)
        part = span.take(new) >> np.uint64(bits)
        found = rank.take(new)
        _narrow(low, span, new, first.take(found) * part, width0.take(found) * part, words, used)
        counts.learn(zero, number, at, c)
        mixer.learn(rank, right1, right2)
    words[np.arange(lanes), used] = (low >> W32).astype(np.uint32)
    words[np.arange(lanes), used + 1] = (low & LOW32).astype(np.uint32)
    return [w[: u + 2] for w, u in zip(words, used, strict=True)]


def _narrow(
    low: np.ndarray, span: np.ndarray, at: np.ndarray | None, begin: np.ndarray, size: np.ndarray,
    words: np.ndarray, used: np.ndarray,
) -> None:
    """Narrow the intervals of the lanes ``at``, or the first lanes, and hand out the words that are settled."""
    old = low[: len(begin)] if at is None else low.take(at)
    begin += old
    lost, full = begin < old, np.flatnonzero(size <= LOW32)
    if lost.any():
        lost = np.flatnonzero(lost)
        _carry(words, used, lost if at is None else at.take(lost))
    out = full if at is None else at.take(full)
    to, high = used.take(out), begin.take(full)
    words[out, to] = high >> W32
    used[out] = to + 1
    begin[full] = high << W32
    size[full] <<= W32
    if at is None:
        low[: len(begin)], span[: len(begin)] = begin, size
    else:
        low[at], span[at] = begin, size


def _carry(words: np.ndarray, used: np.ndarray, lanes: np.ndarray) -> None:
    """Add one to the words that are already out."""
    at = used[lanes] - 1
    while len(lanes):
        words[lanes, at] += np.uint32(1)
        more = words[lanes, at] == 0
        lanes, at = lanes[more], at[more] - 1


def decode_blocks(words: np.ndarray, sizes: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """The ranks of each block; ``words`` has a row per block, padded, the longest block first."""
    lanes, longest = len(sizes), int(sizes.max(initial=0))
    mixer, counts, parts = Mixer(lanes), Counts(lanes, longest), Intervals(lanes)
    flat, wide = words.ravel(), words.shape[1]
    at_word = np.arange(lanes) * wide + 2
    code = (words[:, 0].astype(np.uint64) << W32) | words[:, 1].astype(np.uint64)
    span = np.full(lanes, ~np.uint64(0), np.uint64)
    first, width0 = start[:-1].astype(np.uint64), np.diff(start).astype(np.uint64)
    symbol = np.repeat(np.arange(len(width0), dtype=np.int32), width0.astype(np.int64))
    most = np.uint64((1 << bits) - 1)
    out = np.zeros((longest, lanes), np.int32)
    # Ranks in the order in which order 0 met them, which is their number.
    ranks, known = np.zeros(lanes * (longest + 1), np.int32), np.zeros(lanes, np.int64)
    starts = np.arange(lanes) * (longest + 1)
    live = np.searchsorted(-sizes, -np.arange(longest), "left")

    def fill(full: np.ndarray) -> None:
        # A damaged block may ask for more words than there are; its checksum tells.
        to = at_word.take(full)
        code[full] = (code.take(full) << W32) | flat.take(np.minimum(to, len(flat) - 1))
        at_word[full] = to + 1
        span[full] <<= W32

    def step(at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        code[at] -= begin
        span[at] = size
        fill(at.take(np.flatnonzero(size <= LOW32)))

    for t in range(longest):
        n = int(live[t])
        p1, p2, width1, width2 = mixer.predict(n)
        edges = parts.cut(counts, width1, width2)
        part = span[:n] >> W16
        value = code[:n] // part
        is0 = value >= edges[2, :n]
        wrong2, fresh = value >= edges[1, :n], value >= edges[3, :n]
        begin, width = parts.chosen(wrong2.astype(np.int64) + is0 + fresh)
        code[:n] -= begin * part
        np.multiply(width, part, out=span[:n])
        fill(np.flatnonzero(span[:n] <= LOW32))
        rank = np.where(wrong2, p1, p2)
        zero = np.flatnonzero(is0)
        fresh = fresh.take(zero)
        old, new = np.flatnonzero(~fresh), np.flatnonzero(fresh)
        number = np.zeros(len(zero), np.int64)
        at = zero.take(old)
        total = counts.total.take(at).view(np.uint64)
        part = span.take(at) // total
        offset = code.take(at)
        target = np.minimum(offset // part, total - np.uint64(1)).view(np.int64)
        k, before, have, many = counts.find_class(at, target)
        many = many.view(np.uint64)
        each = have.astype(np.uint64) * part // many
        offset -= before.astype(np.uint64) * part
        place = np.minimum(offset // each, many - np.uint64(1))
        code[at] = offset
        step(at, place * each, each)
        number[old] = counts.number_at(at, k, place.view(np.int64))
        at = zero.take(new)
        part = span.take(at) >> np.uint64(bits)
        found = symbol.take(np.minimum(code.take(at) // part, most).view(np.int64))
        step(at, first.take(found) * part, width0.take(found) * part)
        number[new] = known.take(at)
        ranks[starts.take(at) + number.take(new)] = found
        known[at] += 1
        at = starts.take(zero) + number
        rank[zero] = ranks.take(at)
        c = counts.count.take(at)
        counts.learn(zero, number, at, c)
        mixer.learn(rank, rank == p1, rank == p2)
        out[t, :n] = rank
    return out.T
