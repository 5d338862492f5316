"""Vocabulary joins by blocks.

Joining a table of words to every word of every text would move each word of the corpus. Here the
documents a task reads are cut into blocks of bounded size. A block sends each of its distinct words
once, in one compressed list for each part of the vocabulary (a part is a range of word hashes), and
the part sends back one compressed list of values in the same order. A word however frequent is in a
block's lists once, so no part holds more than one entry per word and block.

Blocks are cut twice, once to send the words and once for the answers, so the input has to give the
same rows in the same order when read again, as a scan does; each list carries a fingerprint of its
block's rows, and a difference raises an error instead of joining wrongly. For other inputs pass a
checkpointed frame.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 24 << 20
SCHEMA = "block long, part int, mark long, data binary"
ARROW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("mark", pa.int64()), ("data", pa.binary())])
#: The part number of the rows that carry a block's documents.
DOCS = -1


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: a part is a range of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


class Block:
    """The rows of one block."""

    def __init__(self, number: int, rows: list[tuple[int | None, bytes]]):
        self.number, self.rows = number, rows

    @property
    def mark(self) -> int:
        digest = xxhash.xxh3_64()
        for doc_id, text in self.rows:
            digest.update(struct.pack("<qI", -(2**63) if doc_id is None else doc_id, len(text)))
            digest.update(text)
        return digest.intdigest() - 2**63

    def packed(self) -> bytes:
        head = struct.pack("<I", len(self.rows)) + b"".join(struct.pack("<?qI", i is not None, i or 0, len(t)) for i, t in self.rows)
        return squeeze(head + b"".join(t for _, t in self.rows))

    @staticmethod
    def unpacked(data: bytes) -> list[tuple[int | None, bytes]]:
        raw = unsqueeze(data)
        (n,) = struct.unpack_from("<I", raw)
        at, out = 4 + 13 * n, []
        for k in range(n):
            known, doc_id, size = struct.unpack_from("<?qI", raw, 4 + 13 * k)
            out.append((doc_id if known else None, raw[at : at + size]))
            at += size
        return out


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The blocks of a task's rows; a text larger than a block has one of its own."""
    from pyspark import TaskContext

    number, held, weight = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0
    for doc_id, text in common.rows(batches):
        if held and weight + len(text) > most:
            yield Block(number, held)
            number, held, weight = number + 1, [], 0
        held.append((doc_id, text))
        weight += len(text) + 16
    if held:
        yield Block(number, held)


def in_parts(words: list[bytes], parts: int) -> list[tuple[int, np.ndarray]]:
    """Distinct words by part: the indices of each part's words, in the order both sides of the exchange agree on.

    That is the order of hashes; words with one hash keep the order of their first occurrence, which
    is the same whenever the block is read.
    """
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    order = np.argsort(hashes, kind="stable")
    part = part_of(hashes[order], parts)
    at = np.flatnonzero(np.diff(part)) + 1
    return [(int(part[0 if not k else at[k - 1]]), x) for k, x in enumerate(np.split(order, at)) if len(x)]


def pack_words(words: list[bytes], extra: bytes = b"") -> bytes:
    """Words hold no white space, but the mark of a text's end, a line break, may be one of them."""
    listed = b" ".join(words)
    return squeeze(struct.pack("<II", len(words), len(listed)) + listed + extra)


def unpack_words(data: bytes) -> tuple[list[bytes], bytes]:
    raw = unsqueeze(data)
    n, size = struct.unpack_from("<II", raw)
    words = raw[8 : 8 + size].split(b" ") if n else []
    return words, raw[8 + size :]


def gathered(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """Rows (block, part, mark, data) of sorted batches, those of one block or part at a time."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(by).to_pylist()
        for key, row in zip(keys, zip(*(batch.column(k).to_pylist() for k in ARROW.names), strict=True), strict=True):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


def answers(docs: DataFrame, parts: int, send: Callable[[Block], Iterator[tuple[int, bytes]]], answer: Callable[[list[tuple[int, bytes]]], Iterator[bytes]], most: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, part, mark, data): what each part of the vocabulary says to each block.

    send: a block's lists by part. answer: from all lists of one part, in any order, the data for each.
    Each part has a partition of its own. most: bytes of a block, the same for answers() and finished().
    """
    common.ship(docs.sparkSession)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_of(((b.number, part, b.mark, data) for b in blocks(batches, most) for part, data in send(b)), ARROW, 256)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for part, rows in gathered(batches, "part"):
                for (number, _, mark, _), data in zip(rows, answer([(r[0], r[3]) for r in rows]), strict=True):
                    yield number, part, mark, data

        yield from common.batches_of(made(), ARROW, 256)

    lists = common.documents(docs).mapInArrow(sent, SCHEMA)
    return lists.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block").mapInArrow(answered, SCHEMA)


def finished(docs: DataFrame, told: DataFrame, finish: Callable[[list[tuple[int | None, bytes]], dict[int, bytes]], Iterator[tuple]], schema: pa.Schema, ddl: str, most: int = BLOCK_BYTES) -> DataFrame:
    """finish(rows, {part: data}) for each block, with what the parts told it.

    The blocks of one input partition meet their answers in one partition, as evenly as they were read.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.batches_of(((b.number, DOCS, b.mark, b.packed()) for b in blocks(batches, most)), ARROW, 16)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for _, rows in gathered(batches, "block"):
                data = {part: x for _, part, _, x in rows}
                if DOCS not in data or len({mark for _, _, mark, _ in rows}) != 1:
                    raise RuntimeError("the documents came in another order when read again; checkpoint them first")
                yield from finish(Block.unpacked(data.pop(DOCS)), data)

        yield from common.batches_of(made(), schema)

    texts = common.documents(docs).mapInArrow(own, SCHEMA).unionByName(told)
    home = F.call_function("shiftright", F.col("block"), F.lit(32)).cast("int")
    return texts.repartitionById(common.input_partitions(docs), home).sortWithinPartitions("block", "part").mapInArrow(done, ddl)


def parts_for(docs: DataFrame) -> int:
    """Parts of the vocabulary, so many that one is about as large as what a task reads."""
    return max(8, 2 * common.input_partitions(docs))
