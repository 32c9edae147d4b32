"""Token ids in compressed files: tokenizing, writing and reading.

Documents are put in the order of their ids by ranges, and each task turns its
range into files of a few million ids. A file is a value of bytes in a row of the
written table, so any store that Spark writes to can hold it. Layout, little endian:

    magic ``SKTF`` | version u32 | sizes of the four tables u32 x 4 |
    documents: id i64, known u8, ids u32 | ranks: id u32, frequency u32 |
    blocks: ids u32, words u32, crc32 u32 | words of all blocks u32

The three tables are compressed with zlib (the fourth size is the number of
frequency bits). Blocks hold a fixed number of ids, whatever document they are of, are coded
independently (see :mod:`range_coder`), and are checked on reading.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, compress, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewprobe.llm.range_coder import decode_blocks, encode_blocks
from skewprobe.session import shared_dir

MAGIC, VERSION = b"SKTF", 2
HEAD = struct.Struct("<4s5I")
BLOCK_IDS = 2048
FILE_IDS = 1 << 22
# Texts that are tokenized together, by characters.
CHARS = 1 << 22
# Characters of the parts whose ids a task keeps for later texts.
KNOWN_CHARS = 1 << 22
DOCS = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u4")])
RANKS = np.dtype([("id", "<u4"), ("n", "<u4")])
BLOCKS = np.dtype([("n", "<u4"), ("words", "<u4"), ("crc", "<u4")])
FILES = "part int, seq int, n_docs long, n_ids long, payload binary"
#: A space that does not simply stand before a character.
ODD_SPACE = re.compile(r" \s| $")
#: A part that begins with the only space in it, before another character.
PLAIN_PART = r"\A [^\s\pZ\pC][^ ]*\z"
#: From how many parts on they are strung together for the tokenizer, and how many to a string.
MANY_PARTS, JOINED_PARTS = 1000, 200


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """Read the tokenizer, which every worker finds under the same path."""
    # One thread for each task: Spark runs a task on every core already.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass
class Parts:
    """The ids of parts that a task has met; most parts come again. Forgotten together once they are many."""

    number: dict[str, int] = field(default_factory=lambda: defaultdict(count().__next__))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    chars: int = 0

    def learn(self, tokenizer) -> None:
        """Encode the parts that were numbered since the last time."""
        new = list(islice(self.number, len(self.sizes), None))
        sizes, flat = _encode(new, tokenizer)
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        self.chars += sum(map(len, new))


def _encode(parts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each part has, and the ids of all. Many parts are strung together for the tokenizer."""
    if len(parts) >= MANY_PARTS:
        column = pa.array(parts, pa.large_string())
        joins = pc.match_substring_regex(column, PLAIN_PART).to_numpy(zero_copy_only=False)
        found = _encode_joined(column.filter(joins), tokenizer)
        if found is not None:
            others, their = _encode_each(list(compress(parts, ~joins)), tokenizer)
            sizes = np.zeros(len(parts), np.int64)
            sizes[joins], sizes[~joins] = found[0], others
            joined, flat = np.repeat(joins, sizes), np.zeros(int(sizes.sum()), np.int32)
            flat[joined], flat[~joined] = found[1], their
            return sizes, flat
    return _encode_each(parts, tokenizer)


def _encode_each(parts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    encoded = [e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    return sizes, np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))


def _encode_joined(column: pa.Array, tokenizer) -> tuple[np.ndarray, np.ndarray] | None:
    """As ``_encode_each``, a few hundred parts in one string; each part begins with a space that the pattern breaks before.

    Where a part ends is found from the bytes of the ids. None if a part does not end with an id, as with
    tokenizers that are not of bytes.
    """
    parts = _strings(column)
    strings = ["".join(parts[a : a + JOINED_PARTS]) for a in range(0, len(parts), JOINED_PARTS)]
    flat = _encode_each(strings, tokenizer)[1]
    ends = np.cumsum(_id_bytes(tokenizer).take(flat))
    want = np.cumsum(pc.binary_length(column).to_numpy())
    at = np.searchsorted(ends, want)
    if len(parts) and (at[-1] != len(ends) - 1 or (ends[at] != want).any()):
        return None
    return np.diff(at, prepend=-1), flat


def _strings(column: pa.Array) -> list[str]:
    # Several times as fast as ``to_pylist``, which makes an Arrow scalar of each.
    return column.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def _id_bytes(tokenizer) -> np.ndarray:
    """The bytes of each id: one for every character of a byte-level token."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def tokenize(texts: list[str], tokenizer, end: int | None, known: Parts | None = None) -> list[np.ndarray]:
    """Ids of each whole text, then ``end``.

    The byte-level pattern always breaks before a space that stands before another
    character, so such parts are encoded once for all their occurrences; those in ``known``,
    which is of the same tokenizer, not again.
    """
    known = Parts() if known is None else known
    out, start, held = [], 0, 0
    for stop, text in enumerate(texts, 1):
        held += len(text)
        if held >= CHARS or stop == len(texts):
            out += _tokenize(texts[start:stop], tokenizer, end, known)
            start, held = stop, 0
            if known.chars > KNOWN_CHARS:
                known.__init__()
    return out


def _tokenize(texts: list[str], tokenizer, end: int | None, known: Parts) -> list[np.ndarray]:
    # A text with odd spaces is one part, its first.
    odd = [k for k, text in enumerate(texts) if ODD_SPACE.search(text)]
    plain = list(texts)
    for k in odd:
        plain[k] = ""
    pieces = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
    first, words = pieces.offsets.to_numpy()[:-1].astype(np.int64), pieces.flatten()
    heads = _strings(words.take(pa.array(first)))
    for k in odd:
        heads[k] = texts[k]
    coded = words.dictionary_encode()
    part = coded.indices.to_numpy().astype(np.int64)
    later = np.ones(len(part), bool)
    later[first] = False
    # Each different word is looked up once.
    used = np.flatnonzero(np.bincount(part[later], minlength=len(coded.dictionary)))
    number = known.number
    own = np.zeros(len(coded.dictionary), np.int64)
    own[used] = [number[" " + w] for w in _strings(coded.dictionary.take(pa.array(used)))]
    part = own[part]
    part[first] = [number[w] for w in heads]
    known.learn(tokenizer)
    sizes, flat = known.sizes, known.flat
    if end is not None:
        # One more part after each text.
        ends = np.append(first[1:], len(part))
        part = np.insert(part, ends, len(sizes))
        first = first + np.arange(len(first))
        sizes, flat = np.append(sizes, 1), np.append(flat, np.array(end, np.int32 if end < 1 << 31 else np.int64))
    n = sizes.take(part)
    to = np.cumsum(n)
    at = np.repeat((np.cumsum(sizes) - sizes).take(part) - (to - n), n)
    at += np.arange(len(at))
    return np.split(flat.take(at), to[first[1:] - 1])


def pack(doc_ids: list[int | None], ids: list[np.ndarray], block: int = BLOCK_IDS) -> bytes:
    """One file of the ids of some documents."""
    docs = np.array([(d or 0, d is not None, len(x)) for d, x in zip(doc_ids, ids, strict=True)], DOCS)
    stream = np.concatenate([np.zeros(0, np.int64), *ids])
    names, rank, seen = _ranked(stream)
    bits = max(16, int(len(names)).bit_length() + 3)
    ranks = np.zeros(len(names), RANKS)
    ranks["id"] = names
    if len(names):
        # At least one each, the rest in proportion; what rounding leaves goes to the first most frequent.
        freq = 1 + np.floor(seen * (((1 << bits) - len(names)) / seen.sum())).astype(np.int64)
        freq[np.argmax(freq)] += (1 << bits) - freq.sum()
        ranks["n"] = freq
    sizes = np.diff(np.append(np.arange(0, len(stream), block), len(stream)))
    table = np.zeros((len(sizes), block), np.int32)
    table.ravel()[: len(stream)] = rank
    words = encode_blocks(table[:, : sizes.max(initial=0)], sizes, _start(ranks), bits)
    blocks = np.zeros(len(sizes), BLOCKS)
    blocks["n"], blocks["words"] = sizes, [len(w) for w in words]
    raw = stream.astype("<u4")
    # Of the ids and of the words, so that damage without effect is seen too.
    parts = [raw[a : a + block].tobytes() for a in range(0, len(raw), block)]
    blocks["crc"] = [zlib.crc32(w.astype("<u4").tobytes(), zlib.crc32(x)) for w, x in zip(words, parts, strict=True)]
    tables = [zlib.compress(t.tobytes(), 6) for t in (docs, ranks, blocks)]
    head = HEAD.pack(MAGIC, VERSION, *map(len, tables), bits)
    return b"".join([head, *tables, *[w.astype("<u4").tobytes() for w in words]])


def _ranked(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, the place of each id among them, and how often each occurs."""
    if not len(stream) or stream.max() >= 1 << 22:
        return np.unique(stream, return_inverse=True, return_counts=True)
    seen = np.bincount(stream)
    names = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int32)
    place[names] = np.arange(len(names))
    return names, place[stream], seen[names]


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The document table and all ids of a file; an error if a block was damaged."""
    magic, version, a, b, c, bits = HEAD.unpack_from(payload)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file")
    at, tables = HEAD.size, []
    for size, kind in ((a, DOCS), (b, RANKS), (c, BLOCKS)):
        tables.append(np.frombuffer(zlib.decompress(payload[at : at + size]), kind))
        at += size
    docs, ranks, blocks = tables
    sizes, many = blocks["n"].astype(np.int64), blocks["words"].astype(np.int64)
    flat = np.frombuffer(payload, "<u4", int(many.sum()), at)
    words = np.zeros((len(blocks), int(many.max(initial=0)) + 2), np.uint32)
    words[np.arange(words.shape[1]) < many[:, None]] = flat
    decoded = decode_blocks(words, sizes, _start(ranks), bits)
    found = decoded[np.arange(decoded.shape[1]) < sizes[:, None]]
    if len(found) and (found.max() >= len(ranks) or found.min() < 0):
        raise ValueError("a block holds an unknown rank")
    stream = ranks["id"][found]
    ends, cuts = np.cumsum(sizes), np.cumsum(many)
    for k, (end, n, to, size) in enumerate(zip(*(x.tolist() for x in (ends, sizes, cuts, many)), strict=True)):
        crc = zlib.crc32(flat[to - size : to].tobytes(), zlib.crc32(stream[end - n : end].tobytes()))
        if crc != blocks["crc"][k]:
            raise ValueError(f"block {k} of a token file is damaged")
    return docs, stream


def _start(ranks: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(ranks["n"].astype(np.int64)))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end: int | None = None, parts: int | None = None,
    doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS,
) -> None:
    """Tokenize ``docs`` and write token files to ``path``, in ascending order of ``doc_id``.

    Every whole text is encoded without special tokens of the tokenizer's own and followed by
    ``end`` if that is given. Null and empty texts have no ids but ``end``. Null doc ids come first; rows of equal
    ids are ordered by a hash of the text, then by the text, and repeated rows are written each. Other columns are not
    read. An empty table writes a table without files.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # Bounds of the ranges are sampled to the driver, so they hold numbers and no texts.
    order = (F.col("id").asc_nulls_first(), F.col("hash"))
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order, "text").select("id", "text", F.spark_partition_id().alias("part"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, ids, held, seq, part = [], [], 0, 0, 0
        loaded, met = load_tokenizer(tokenizer), Parts()

        def done() -> pd.DataFrame:
            row = (part, seq, len(names), held, pack(names, ids, block_ids))
            return pd.DataFrame([row], columns=["part", "seq", "n_docs", "n_ids", "payload"])

        for frame in frames:
            part = int(frame["part"].iloc[0]) if len(frame) else part
            known = [None if pd.isna(x) else int(x) for x in frame["id"]]
            for a in range(0, len(frame), 1000):
                found = tokenize(frame["text"].iloc[a : a + 1000].tolist(), loaded, end, met)
                for name, x in zip(known[a : a + 1000], found, strict=True):
                    names.append(name)
                    ids.append(x)
                    held += len(x)
                    if held >= file_ids:
                        yield done()
                        names, ids, held, seq = [], [], 0, seq + 1
        if names:
            yield done()

    ranged.mapInPandas(write, FILES).write.option("compression", "none").parquet(path)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of a written table of token files: ``doc_id, start, n_tokens, ids_crc32, ids``.

    ``start`` counts the ids of all documents before. ``ids`` are null unless asked for.
    """
    # One row for each file: the ids before it, from the number in each part and before it.
    heads = files.select("part", "seq", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("inner", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(parts, "part")
    starts = heads.select("part", "seq", (F.col("before") + F.col("inner")).alias("first"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame.itertuples(index=False):
                docs, stream = unpack(file.payload)
                ends = np.cumsum(docs["n"].astype(np.int64))
                for a in range(0, len(docs), 1000):
                    some, to = docs[a : a + 1000], ends[a : a + 1000]
                    cut = [stream[e - n : e] for e, n in zip(to.tolist(), some["n"].tolist(), strict=True)]
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(some["id"], "Int64").copy() if some["known"].all()
                            else pd.array([i if k else None for i, k in zip(some["id"].tolist(), some["known"])], "Int64"),
                            "part": file.part,
                            "seq": file.seq,
                            "inner": to - some["n"],
                            "n_tokens": some["n"].astype(np.int64),
                            "ids_crc32": [zlib.crc32(x.tobytes()) for x in cut],
                            "ids": [x.astype(np.int64) if with_ids else None for x in cut],
                        }
                    )

    schema = "doc_id long, part int, seq int, inner long, n_tokens long, ids_crc32 long, ids array<long>"
    rows = files.select("part", "seq", "payload").mapInPandas(read, schema)
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def token_file_folder(spark, name: str) -> str:
    """A new folder for token files below the shared folder of the session."""
    import uuid

    return f"{shared_dir(spark)}/skewprobe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
