"""SentencePiece ids sampled by forward filtering and backward sampling.

All ways to cut a text into pieces of the model form a lattice. The forward pass
sums the weights of the paths up to each character, the backward pass draws one
path from the end in proportion to its weight. The numbers drawn depend on a
seed, the key of the row and the position alone, so reruns agree.

Pieces hold white space at their start only, so the lattice falls apart before
each run of spaces, and also between letters and other characters if no piece of the model joins
them. Sampling such units apart is sampling the whole. A unit that occurs often in a
batch is filtered once; all its occurrences draw together.

The weight of a piece is ``(1 + rank) ** -sharpness``, where the rank is its place in
the order of merges, which is what a BPE model stores as its score.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skewprobe.llm.common import replaced

# Units by spaces alone, and by letters and other characters as well.
COARSE = r" *[^ \n]+|\n| +"
LETTER = r"[^\W\d_]"
SPACE_MARK = "▁"
# Characters whose lattices are built at once; a longer text is taken whole.
CHARS = 1 << 18
# Characters of units whose lattice a task keeps for later texts.
KNOWN_CHARS = 1 << 17
SIEVE = 18
# Rows that are handed on at once.
ROWS = 500
# Positions that are filtered at once.
CELLS = 1 << 15
# Longer units are sampled alone, in windows of so many characters: their memory does not grow with them.
LONG_UNIT, WINDOW = 1 << 8, 1 << 14
# Sums below this are scaled up; only their ratios over the longest piece matter.
SMALL = 1e-150
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
# Fixed values of a well-known mixing function of 64 bits.
MIX64 = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Pieces:
    """The model's pieces with spaces for their marks."""

    text: list[bytes]
    byte: np.ndarray
    #: For each length: place of the hash with certain first bits (-1: several), which of these
    #: bits occur, sorted hashes, ids and weights.
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    byte_weight: float
    unit: re.Pattern
    known: Known = field(default_factory=lambda: Known(), repr=False)


def unit_pattern(pieces: list[str]) -> re.Pattern:
    """What cuts a text where no piece can reach over."""
    letter = re.compile(LETTER)

    def joined(own: Callable[[str], bool]) -> set[str]:
        """Letters that stand next to another character in some piece."""
        found = set()
        for piece in pieces:
            for a, b in zip(piece, piece[1:], strict=False):
                if a != " " and own(a) != own(b):
                    found.add(a if own(a) else b)
        return found

    # Letters that do so are put to the others; if more do then, spaces alone have to do.
    odd = joined(lambda c: bool(letter.match(c)))
    if joined(lambda c: bool(letter.match(c)) and c not in odd):
        return re.compile(COARSE)
    others = re.escape("".join(sorted(odd)))
    own = rf"[^\W\d_{others}]"
    rest = rf"(?:[^\w \n]|[\d_{others}])"
    return re.compile(rf" *{own}+| *{rest}+|\n| +")


@lru_cache(maxsize=4)
def load_pieces(path: str, sharpness: float) -> Pieces:
    """Read the model file, which every worker finds under the same path."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    text, byte, by_length = [b""] * size, np.zeros(256, np.int64), {}
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            text[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            piece = piece.replace(SPACE_MARK, " ")
            text[i] = piece.encode()
            rank = min(max(-model.get_score(i), 0.0), float(size))
            weight = (1 + rank) ** -sharpness
            by_length.setdefault(len(piece), []).append((piece, i, weight))
    tables = {}
    for length, found in by_length.items():
        codes = np.array([[ord(c) for c in p] for p, _, _ in found], np.uint64)
        keys = _hash(codes)
        order = keys.argsort()
        there = np.bincount(_sieve(keys), minlength=1 << SIEVE)
        place = np.zeros(1 << SIEVE, np.int32)
        place[_sieve(keys[order])] = np.arange(len(keys))
        place[there > 1] = -1
        tables[length] = (
            place, there > 0, keys[order], np.array([i for _, i, _ in found])[order],
            np.array([w for _, _, w in found])[order],
        )
    unit = unit_pattern([t.decode() for i, t in enumerate(text) if t and not model.is_byte(i)])
    return Pieces(text, byte, tables, float(size + 1) ** -sharpness, unit)


def _sieve(keys: np.ndarray) -> np.ndarray:
    return ((keys * MULTIPLIER) >> np.uint64(64 - SIEVE)).astype(np.int64)


def _hash(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(codes.shape[0], np.uint64)
    for j in range(codes.shape[1]):
        out = out * MULTIPLIER + codes[:, j] + np.uint64(1)
    return out


@dataclass
class Lattice:
    """The ways into each position of each unit, with cumulative chances.

    ``base[u] + j - 1`` numbers the position after the j-th character of unit u;
    its ways begin at ``first`` of that number, the last of them has the chance 1.
    """

    sizes: np.ndarray
    base: np.ndarray
    first: np.ndarray
    upto: np.ndarray
    piece: np.ndarray
    length: np.ndarray

    def joined(self, other: Lattice) -> Lattice:
        parts = {
            "base": other.base + len(self.first),
            "first": other.first + np.int32(len(self.upto)),
        }
        names = ("sizes", "base", "first", "upto", "piece", "length")
        return Lattice(*[np.concatenate([getattr(self, n), parts.get(n, getattr(other, n))]) for n in names])


@dataclass
class Known:
    """The lattice of units that a task has met; most units come again."""

    number: dict[str, int] = field(default_factory=dict)
    lattice: Lattice | None = None

    def extended(self, number: dict[str, int], pieces: Pieces) -> Lattice:
        """The lattice of all units of ``number``, which begins with those known; kept while it is small."""
        units = list(islice(number, len(self.number), None))
        lattice = self.lattice
        if units:
            new = filter_forward(units, pieces)
            lattice = new if lattice is None else lattice.joined(new)
            if len(lattice.first) <= KNOWN_CHARS:
                self.number, self.lattice = dict(number), lattice
        return lattice


def filter_forward(units: list[str], pieces: Pieces) -> Lattice:
    sizes = np.array([len(u) for u in units])
    base = np.cumsum(sizes) - sizes
    first = np.zeros(int(sizes.sum()), np.int32)
    found, done = [], 0
    for size in np.unique(sizes):
        members = np.flatnonzero(sizes == size)
        step = max(1, CELLS // int(size))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            text = "".join([units[m] for m in some])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), size)
            ways, *edges = _filter(np.ascontiguousarray(codes.T), pieces)
            # Ways come position by position, for all units of this size.
            starts = np.cumsum(ways.ravel()) - ways.ravel() + done
            first[base[some] + np.arange(size)[:, None]] = starts.reshape(ways.shape)
            done += len(edges[0])
            found.append(edges)
    upto, piece, length = (np.concatenate(x) for x in zip(*found, strict=True))
    return Lattice(sizes.astype(np.int32), base, first, upto, piece, length)


def _filter(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
    """Of units of one size (a column each): ways into each position, and the ways themselves."""
    size, n = codes.shape
    lengths = [k for k in sorted(pieces.tables) if k <= size]
    # weight[k, j]: of the piece of the k-th length that ends after character j.
    weight = np.zeros((len(lengths), size, n))
    ids = np.zeros((len(lengths), size, n), np.int32)
    rolled, wide = np.zeros((size, n), np.uint64), codes.astype(np.uint64)
    done = 0
    for k, length in enumerate(lengths):
        while done < length:
            rolled = rolled[: size - done] * MULTIPLIER + wide[done:] + np.uint64(1)
            done += 1
        place, there, keys, own, weights = pieces.tables[length]
        # Few strings are pieces: most are ruled out at once.
        flat = rolled.ravel()
        bits = _sieve(flat)
        at = np.flatnonzero(there[bits])
        slot = place[bits[at]]
        several = np.flatnonzero(slot < 0)
        slot[several] = np.minimum(keys.searchsorted(flat[at[several]]), len(keys) - 1)
        hit = keys[slot] == flat[at]
        at, slot = at[hit] + (length - 1) * n, slot[hit]
        weight[k].ravel()[at] = weights[slot]
        ids[k].ravel()[at] = own[slot]
    # A character without a piece is written as its bytes.
    lone = weight[0] == 0
    if lone.any():
        code = codes[lone].astype(np.int64)
        weight[0][lone] = pieces.byte_weight
        ids[0][lone] = np.where(code < 128, pieces.byte[np.minimum(code, 127)], -code)

    # Sums of the weights of all paths; columns that get small are scaled up together.
    forward = np.zeros((size + 1, n))
    forward[0] = 1
    reach = max(lengths)
    for j in range(size):
        for k, length in enumerate(lengths):
            if length <= j + 1:
                weight[k, j] *= forward[j + 1 - length]
                forward[j + 1] += weight[k, j]
        low = np.flatnonzero(forward[j + 1] < SMALL)
        if len(low):
            from_ = max(0, j + 2 - reach)
            scale = 1 / forward[j + 1, low]
            weight[:, j, low] *= scale
            forward[from_ : j + 2, low] *= scale
        weight[:, j] /= forward[j + 1]
    chance = np.ascontiguousarray(weight.transpose(1, 2, 0))
    there = chance > 0
    every = np.broadcast_to(np.array(lengths, np.int8), chance.shape)
    ways = there.sum(2)
    upto = np.cumsum(chance, 2)[there]
    # The last way has what is left of the chance.
    upto[np.cumsum(ways.ravel()) - 1] = 1.0
    return ways, upto, ids.transpose(1, 2, 0)[there], every[there]


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    z = z ^ (z >> np.uint64(30))
    z *= MIX64[0]
    z ^= z >> np.uint64(27)
    z *= MIX64[1]
    z ^= z >> np.uint64(31)
    return z


def random_unit(key: np.ndarray, position: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each 64-bit row key and mixed position.

    Positions are mixed before they meet the key, so rows whose keys are near each other, or differ
    by a few bits, share no run of draws, shifted or not.
    """
    return ((mixed(key ^ position) >> np.uint64(11)) + 0.5) * 2.0**-53


def sample_ids(texts: list[str], keys: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """Ids of each text; ``keys`` are 64-bit numbers that seed the rows."""
    out, start, held = [], 0, 0
    for stop, text in enumerate(texts, 1):
        held += len(text)
        if held >= CHARS or stop == len(texts):
            out += _sample(texts[start:stop], keys[start:stop], pieces)
            start, held = stop, 0
    return out


def _sample(texts: list[str], keys: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    # Fragments of texts between their long units, which are sampled one by one.
    fragments: list[tuple[list[str], int, int]] = []
    order: list[list[tuple[int, str | None, int]]] = []
    for row, text in enumerate(texts):
        # The mark of the first word; an empty text has no pieces.
        found = pieces.unit.findall(" " + text) if text else []
        mine, at, start, first = [], 0, 0, 0
        long = max(map(len, found), default=0) > LONG_UNIT
        for i, unit in enumerate(found if long else ()):
            if len(unit) > LONG_UNIT:
                mine.append((len(fragments), None, 0))
                fragments.append((found[first:i], row, start))
                mine.append((row, unit, at))
                first, start = i + 1, at + len(unit)
            at += len(unit)
        mine.append((len(fragments), None, 0))
        fragments.append((found[first:], row, start))
        order.append(mine)
    rows = np.array([row for _, row, _ in fragments], np.int64)
    starts = np.array([start for _, _, start in fragments], np.int64)
    sampled = _sample_units([units for units, _, _ in fragments], starts, keys.astype(np.uint64)[rows], pieces)
    out = []
    for mine in order:
        if len(mine) == 1:
            out.append(sampled[mine[0][0]])
            continue
        out.append(
            np.concatenate(
                [sampled[i] if unit is None else sample_long(unit, at, int(keys[i]), pieces) for i, unit, at in mine]
            )
        )
    return out


def _sample_units(
    parts: list[list[str]], starts: np.ndarray, keys: np.ndarray, pieces: Pieces
) -> list[np.ndarray]:
    """Ids of each run of units, which begins at ``starts`` of its text."""
    known = pieces.known
    number: dict[str, int] = defaultdict(count(len(known.number)).__next__, known.number)
    found = [np.array(list(map(number.__getitem__, part)), np.int64) for part in parts]
    if not sum(map(len, found)):
        return [np.zeros(0, np.int32) for _ in parts]
    lattice = known.extended(number, pieces)
    many = np.array([len(p) for p in found])
    unit = np.concatenate(found)
    left = lattice.sizes[unit]
    base = lattice.base[unit].astype(np.int32)
    # Where each occurrence starts in its own text.
    start = np.cumsum(left) - left
    first = np.cumsum(many) - many
    start += np.repeat(starts - start[np.minimum(first, len(start) - 1)], many)
    key = np.repeat(mixed(keys), many)
    spot = spots(0, int((start + left).max()))

    live = np.arange(len(unit))
    taken, steps = [], np.zeros(len(unit), np.int32)
    while len(live):
        drawn = random_unit(key, spot[start + left])
        way = lattice.first[base + left - 1]
        over = np.flatnonzero(lattice.upto[way] <= drawn)
        while len(over):
            way[over] += 1
            over = over[lattice.upto[way[over]] <= drawn[over]]
        taken.append((live, lattice.piece[way]))
        steps[live] += 1
        left -= lattice.length[way]
        more = left > 0
        live, left, base, key, start = live[more], left[more], base[more], key[more], start[more]
    # Drawn from the end: the last drawn piece of an occurrence is its first.
    to = np.cumsum(steps)
    ids = np.zeros(int(to[-1]), np.int32)
    for step, (who, piece) in enumerate(taken):
        ids[to[who] - 1 - step] = piece
    total = np.diff(np.append(0, to)[np.append(0, np.cumsum(many))])
    return [_bytes_out(x, pieces) for x in np.split(ids, np.cumsum(total)[:-1])]


def spots(low: int, high: int) -> np.ndarray:
    """The mixed positions from ``low`` to ``high``, both included."""
    return mixed(np.arange(low + 1, high + 2, dtype=np.uint64) * MULTIPLIER)


def sample_long(unit: str, start: int, key: int, pieces: Pieces) -> np.ndarray:
    """Ids of one long unit, by the same rules, in windows.

    The sums at a position need those of the positions within the longest piece only. The
    forward pass keeps these at the start of every window; the backward pass filters each window again from
    there, the last one first, and draws while it is in the window.
    """
    codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), "<u4")
    reach = max(pieces.tables)
    kept, tail = [], np.array([1.0])
    for at in range(0, len(codes), WINDOW):
        kept.append(tail)
        tail = _window(codes, at, min(at + WINDOW, len(codes)), tail, reach, pieces)[0]
    seed = mixed(np.array([key], np.int64).view(np.uint64))
    out, left = [], len(codes)
    for at, tail in zip(reversed(range(0, len(codes), WINDOW)), reversed(kept), strict=True):
        end = min(at + WINDOW, len(codes))
        _, first, upto, piece, length = _window(codes, at, end, tail, reach, pieces)
        draws = random_unit(seed, spots(start + at, start + end)).tolist()
        while left > at:
            way = first[left - at - 1]
            while upto[way] <= draws[left - at]:
                way += 1
            out.append(piece[way])
            left -= length[way]
    return _bytes_out(np.array(out[::-1], np.int32), pieces)


def _window(codes: np.ndarray, start: int, end: int, tail: np.ndarray, reach: int, pieces: Pieces) -> tuple:
    """The ways into the positions after ``start`` up to ``end``, and the sums of the last ``reach`` positions.

    ``tail`` are the sums up to ``start``, of which only the ratios matter.
    """
    low = max(0, start - reach + 1)
    text = codes[low:end].astype(np.uint64)
    at, ids, weights, sizes = [], [], [], []
    rolled, done = np.zeros(len(text), np.uint64), 0
    for length in sorted(pieces.tables):
        if length > len(text):
            break
        while done < length:
            rolled = rolled[: len(text) - done] * MULTIPLIER + text[done:] + np.uint64(1)
            done += 1
        place, there, keys, own, weight = pieces.tables[length]
        bits = _sieve(rolled)
        spot = np.flatnonzero(there[bits])
        slot = place[bits[spot]]
        several = np.flatnonzero(slot < 0)
        slot[several] = np.minimum(keys.searchsorted(rolled[spot[several]]), len(keys) - 1)
        hit = keys[slot] == rolled[spot]
        # The position after the piece, in the whole unit.
        after, slot = spot[hit] + length + low, slot[hit]
        new = after > start
        at.append(after[new])
        ids.append(own[slot[new]])
        weights.append(weight[slot[new]])
        sizes.append(np.full(int(new.sum()), length))
    # A character without a piece is written as its bytes.
    known = np.zeros(end - start, bool)
    if 1 in pieces.tables:
        known[at[0] - start - 1] = True
    lone = np.flatnonzero(~known)
    code = codes[start + lone].astype(np.int64)
    at.append(start + lone + 1)
    ids.append(np.where(code < 128, pieces.byte[np.minimum(code, 127)], -code))
    weights.append(np.full(len(lone), pieces.byte_weight))
    sizes.append(np.ones(len(lone), np.int64))
    at, ids, weights, sizes = (np.concatenate(x) for x in (at, ids, weights, sizes))
    order = np.lexsort((sizes, at))
    many = np.bincount(at - start - 1, minlength=end - start)
    first = (np.cumsum(many) - many).tolist()
    weight, size, ways = weights[order].tolist(), sizes[order].tolist(), many.tolist()
    # Sums before this window, then those in it; the last one is that of the position before.
    sums, upto = tail.tolist(), [0.0] * len(weight)
    for a, n in zip(first, ways, strict=True):
        total = 0.0
        for way in range(a, a + n):
            total += weight[way] * sums[-size[way]]
            upto[way] = total
        for way in range(a, a + n - 1):
            upto[way] /= total
        upto[a + n - 1] = 1.0
        sums.append(total)
        if total < SMALL:
            sums[-reach:] = [x / total for x in sums[-reach:]]
    return np.array(sums[-reach:]), first, upto, ids[order].tolist(), size


def _bytes_out(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Put byte pieces in the place of characters without a piece."""
    if (ids >= 0).all():
        return ids.astype(np.int32)
    out = []
    for i in ids.tolist():
        out += [i] if i >= 0 else pieces.byte[list(chr(-i).encode())].tolist()
    return np.array(out, np.int32)


def encode_texts(
    docs: DataFrame, model: str, text: str = "text", key: tuple[str, ...] = ("doc_id",),
    sharpness: float = 1.0, seed: int = 0, ids: str = "ids",
) -> DataFrame:
    """``docs`` with the column ``ids``: piece ids of each whole text (array of int).

    ``model`` is the path of a SentencePiece model with byte fallback, on every
    worker. The same seed, key and text give the same ids, in any partitioning;
    rows with equal keys and texts (repeated rows) get equal ids. Null keys are a key like others.
    A larger ``sharpness`` favours long, frequent pieces.

    A null text has null ids, an empty text no ids. Characters that the model lacks,
    the space mark itself among them, become bytes, so that decoding is lossless. A column of the name
    is replaced; an empty table gives an empty one.
    """

    @pandas_udf("array<int>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded = load_pieces(model, sharpness)
        for texts, keys in batches:
            # Ids are handed on slice by slice, so a batch of texts is never held with all its ids.
            for a in range(0, max(len(texts), 1), ROWS):
                some, seeds = texts.iloc[a : a + ROWS], keys.iloc[a : a + ROWS]
                found = sample_ids([t or "" for t in some], seeds.to_numpy(np.int64).view(np.uint64), loaded)
                yield pd.Series([None if t is None else x for t, x in zip(some, found, strict=True)], dtype=object)

    row = F.xxhash64(F.lit(seed), *[F.col(f"`{k}`").isNull() for k in key], *[F.col(f"`{k}`") for k in key])
    return replaced(docs, {ids: encode(F.col(f"`{text}`"), row)})


def decode_ids(ids: Column, model: str) -> Column:
    """The text of each id array, null for null; the inverse of :func:`encode_texts`."""

    @pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = load_pieces(model, 1.0).text
        for cells in batches:
            for a in range(0, max(len(cells), 1), ROWS):
                out = []
                for cell in cells.iloc[a : a + ROWS]:
                    joined = None if cell is None else b"".join(map(text.__getitem__, cell.tolist()))
                    out.append(None if joined is None else joined[1:].decode())
                yield pd.Series(out, dtype=object)

    return decode(ids)
