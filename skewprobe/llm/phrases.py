"""Phrases that hang together, counted over a prefix-free parse of the corpus.

A text is cut into overlapping chunks before every word whose hash is a trigger, so
the cuts depend on the content alone and copied passages give the same chunks wherever they
stand. The distinct chunks form a dictionary with their frequencies in the parse. Phrases are
counted inside the distinct chunks, weighted; a chunk carries the words after it that a phrase can
reach, and a phrase belongs to the chunk in which it begins, so an overlap counts once.

A phrase is as rare as its rarest part. Words are counted first, then pairs
of frequent words, then longer phrases all of whose pairs are frequent. What is frequent
goes to the tasks as a Bloom filter of bounded size: it lets some rare phrases
through, which the count then drops, and never holds a frequent one back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewprobe.session import stage

#: Words of the longest phrase, and the fewest occurrences of a phrase.
LONGEST, LEAST = 4, 30
#: One word in so many begins a chunk.
TRIGGER = 16
#: A phrase goes if a longer one around it has so many hundredths of its occurrences.
WITHIN = 80
#: Phrases of a language.
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
# Bits of a filter for each key, and at most: 128 MB go to each executor.
KEY_BITS, MOST_BITS = 16, 1 << 30
SEED = 42
# Words in the chunks that a task takes at a time.
HELD = 1 << 19
SALTS = 64
BREAK = re.compile(rb"[.,;:!?\n-\r]+")
Phrases = Callable[[str, "Tokens"], "Counted"]
CHUNKS = "lang string, chunk string, own int"
COUNTS = "lang string, phrase string, n long"


def chunks_of(text: bytes, reach: int, trigger: int = TRIGGER) -> Iterator[tuple[bytes, int]]:
    """The chunks of a text with the number of their own words.

    Words stand between blanks, pieces between line feeds. Up to ``reach`` words after the own ones are
    added, none from another piece.
    """
    pieces: list[bytes] = []
    own = 0
    for piece in BREAK.split(text.lower()):
        words = piece.split()
        start = 0
        for i, word in enumerate(words):
            if own and crc32(word) % trigger == 0:
                if i > start:
                    pieces.append(b" ".join(words[start : i + reach]))
                yield b"\n".join(pieces), own
                pieces, start, own = [], i, 0
            own += 1
        if start < len(words):
            pieces.append(b" ".join(words[start:]))
    if own:
        yield b"\n".join(pieces), own


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def parse(docs: DataFrame, longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """The dictionary: ``lang, chunk, own, times``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(langs: list, chunks: list, owns: list) -> pa.RecordBatch:
            columns = [pa.array(langs, pa.string()), _strings(chunks), pa.array(owns, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "own"])

        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            held = 0
            for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
                for chunk, own in chunks_of(text, longest - 1, trigger):
                    for values, value in zip(found, (lang, chunk, own), strict=True):
                        values.append(value)
                    held += own
                    if held >= HELD:
                        yield handed(*found)
                        found, held = ([], [], []), 0
            yield handed(*found)

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text is not null")
    found = rows.mapInArrow(cut, CHUNKS)
    return stage(found.groupBy("lang", "chunk", "own").agg(F.count("*").alias("times")), "phrase-chunks")


class Filter:
    """A Bloom filter over (language, phrase), made by Spark and asked by the tasks."""

    def __init__(self, frequent: DataFrame):
        keys = frequent.count()
        self.bits = 1 << min(max(KEY_BITS * keys, 64).bit_length(), MOST_BITS.bit_length() - 1)
        mask = f"{self.bits - 1}L"
        # Two places from both halves of one hash.
        hashed = frequent.select(F.xxhash64(F.concat_ws("\n", "lang", "phrase")).alias("h"))
        at = hashed.select(F.explode(F.expr(f"array(h & {mask}, shiftrightunsigned(h, 32) & {mask})")).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("set")
        )
        found = words.toArrow()
        table = np.zeros(self.bits >> 6, np.int64)
        table[found["word"].to_numpy()] = found["set"].to_numpy()
        self.table: Broadcast = frequent.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def passes(self, lang: str, phrases: pa.Array) -> np.ndarray:
        """Which of them may be frequent: all that are, and few others."""
        table, head, mask = self.table.value, lang.encode() + b"\n", np.uint64(self.bits - 1)
        h = np.array([xxhash.xxh64_intdigest(head + p, SEED) for p in phrases.to_pylist()], np.uint64)
        ok = np.ones(len(h), bool)
        for at in (h & mask, (h >> np.uint64(32)) & mask):
            ok &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


@dataclass
class Tokens:
    """Words of many chunks of one language in a row, with a break between pieces and chunks."""

    names: pa.Array  # the different words
    word: np.ndarray  # their numbers; the break is -1
    times: np.ndarray  # how often the chunk of each word occurs, 0 for words that are not its own


def tokens_of(chunks: pa.Array, owns: np.ndarray, times: np.ndarray) -> Tokens:
    # Pieces end at a line feed; as a word of its own it is the break, also after every chunk.
    text = pc.replace_substring(chunks, b"\n", b" \n ")
    text = pc.binary_join_element_wise(text, b"\n", b" ")
    split = pc.split_pattern(text, b" ")
    coded = split.flatten().dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    gap = pc.index(coded.dictionary, pa.scalar(b"\n", pa.binary())).as_py()
    broken = word == gap
    # The number of each word in its chunk; the own ones come first.
    sizes = np.diff(split.offsets.to_numpy())
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.cumsum(~broken) - ~broken
    own = before - before[start] < np.repeat(owns, sizes)
    return Tokens(coded.dictionary, np.where(broken, -1, word), np.where(own & ~broken, np.repeat(times, sizes), 0))


def _distinct(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the first of each key, the number of each key, and the sum of its times."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return first, number, np.bincount(number, times, len(first)).astype(np.int64)


Counted = Iterator[tuple[pa.Array, np.ndarray]]


def _words(lang: str, t: Tokens) -> Counted:
    own = t.word >= 0
    n = np.bincount(t.word[own], t.times[own], len(t.names)).astype(np.int64)
    yield t.names, n


def _frequent_pairs(lang: str, t: Tokens, words_ok: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Where two frequent words stand together, and a key for them."""
    ok = np.append(words_ok.passes(lang, t.names), False)  # the last one stands for the break
    good = ok[t.word]
    at = np.flatnonzero(good[:-1] & good[1:])
    return at, t.word[at] * len(t.names) + t.word[at + 1]


def _joined(t: Tokens, at: np.ndarray, size: int) -> pa.Array:
    """The phrases of ``size`` words that begin at the places ``at``."""
    return pc.binary_join_element_wise(*[t.names.take(pa.array(t.word[at + i])) for i in range(size)], b" ")


def _pairs(words_ok: Filter) -> Phrases:
    def phrases(lang: str, t: Tokens) -> Counted:
        at, key = _frequent_pairs(lang, t, words_ok)
        first, _, n = _distinct(key, t.times[at])
        yield _joined(t, at[first], 2), n

    return phrases


def _longer(words_ok: Filter, pairs_ok: Filter, longest: int) -> Phrases:
    def phrases(lang: str, t: Tokens) -> Counted:
        at, key = _frequent_pairs(lang, t, words_ok)
        first, number, _ = _distinct(key, t.times[at])
        good = pairs_ok.passes(lang, _joined(t, at[first], 2))[number]
        # A number for the frequent pair that begins at each place, else -1.
        pair = np.full(len(t.word), -1, np.int64)
        pair[at[good]] = number[good]
        here, name = at[good], number[good]
        for size in range(3, longest + 1):
            more = here + size - 2
            keep = pair[more] >= 0
            here, key = here[keep], name[keep] * len(t.names) + t.word[more[keep] + 1]
            first, name, n = _distinct(key, t.times[here])
            yield _joined(t, here[first], size), n

    return phrases


def _count(chunks: DataFrame, phrases: Phrases, least: int, name: str) -> DataFrame:
    """Phrases with at least ``least`` occurrences.

    ``phrases`` gives the different phrases that begin with an own word of the chunks, with their occurrences.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            held.append(batch)
            words += pc.sum(batch.column("own")).as_py() or 0
            if words >= HELD:
                yield from _counted(held, phrases)
                held, words = [], 0
        if held:
            yield from _counted(held, phrases)

    found = chunks.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stage(found.where(F.col("n") >= least), name)


def _counted(held: list[pa.RecordBatch], phrases: Phrases) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    for lang in pc.unique(table["lang"]).to_pylist():
        mine = table.filter(pc.equal(table["lang"], lang)).combine_chunks()
        chunks = mine["chunk"].combine_chunks().cast(pa.binary())
        tokens = tokens_of(chunks, mine["own"].to_numpy(), mine["times"].to_numpy())
        for names, n in phrases(lang, tokens):
            met = np.flatnonzero(n)
            found = names.take(pa.array(met)).cast(pa.string(), safe=False)
            columns = [pa.array([lang] * len(met), pa.string()), found, pa.array(n[met], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def phrase_counts(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, trigger: int = TRIGGER
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences, and the words of each language.

    ``lang, phrase, n`` and ``lang, n``.
    """
    chunks = parse(docs, longest, trigger)
    total = stage(chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n")), "phrase-words")
    found = [_count(chunks, _words, least, "phrases-1")]
    if longest > 1:
        words_ok = Filter(found[0])
        found.append(_count(chunks, _pairs(words_ok), least, "phrases-2"))
    if longest > 2:
        found.append(_count(chunks, _longer(words_ok, Filter(found[1]), longest), least, "phrases-3"))
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    return counts, total


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, within: int = WITHIN, top: int = TOP,
    trigger: int = TRIGGER,
) -> DataFrame:
    """The ``top`` phrases of each language by how much its parts keep together.

    ``docs`` has ``text`` and ``lang``. A-Z are lower-cased, pieces end at ``.,;:!?`` and line ends, words at
    blanks and tabs. A phrase of 2 to ``longest`` words with ``a >= least`` occurrences is cut in two in
    each way, into parts with ``l`` and ``r`` occurrences; the cut with the lowest
    ``floor(2000000 * a / (l + r))`` counts, the earliest of equal ones. A phrase inside a longer one with at least
    ``within`` hundredths of its occurrences is left out.

    Result: ``lang, rank, phrase, a, l, r, n, score``; ``n`` are the words of the language. Ranks follow
    score, ``a`` (both descending) and the phrase in byte order. A null language is ``und``. Null and empty
    texts have no words; a text of marks only neither. Every row counts, repeated ones again; ids and other columns are
    not read. An empty table, or one without frequent phrases, gives an empty one.
    """
    counts, total = phrase_counts(docs, longest, least, trigger)
    words = F.split("phrase", " ")
    longer = counts.where(F.size(words) > 1).select(
        "lang", "phrase", F.col("n").alias("a"), words.alias("words")
    )
    size = F.size("words")

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", start, length), " ")

    k = F.col("k")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("left"), part(k + 1, size - k).alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # Decimals of 38 digits: products may pass 64 bits.
    wide = "decimal(20,0)"
    score = F.expr(f"cast({SCALE}L * cast(a as {wide}) div (cast(l as {wide}) + cast(r as {wide})) as bigint)")
    scored = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # Parts of longer phrases, at least two words, with the most frequent phrase around each.
    shorter = F.explode(F.sequence(F.lit(2), size - 1)).alias("k")
    parts = longer.where(size > 2).select("lang", "words", F.col("a").alias("around"), shorter)
    parts = parts.withColumn("start", F.explode(F.sequence(F.lit(1), size - k + 1)))
    parts = parts.select("lang", part(F.col("start"), k).alias("phrase"), "around")
    parts = parts.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(parts, ["lang", "phrase"], "left")
    hundredth = F.expr(f"100 * cast(around as {wide}) >= {within} * cast(a as {wide})")
    kept = kept.where(~F.coalesce(hundredth, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    kept = stage(kept, "phrases-scored")
    # The first of each share of a language, then the first of those.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = (F.xxhash64("phrase") % SALTS).alias("salt")
    few = kept.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    few = few.where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= top).join(total, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
