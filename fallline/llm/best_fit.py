"""Packing of documents into sequences by bounded-space online best-fit.

Documents are encoded once into rows of pieces that carry lengths and checksums but no ids. Pieces
are dealt to groups by a hash, the number of groups following the number of pieces, and each group
packs its own as they come: at most `open_bins` sequences are open, a bitset has a bit for each
amount of free space that some open one has, the least that suffices is found in it, and when a new
sequence is needed and all are open, the fullest is closed. A group's shorter pieces come last and
fill what the others left. What a group wastes is bounded by its open sequences, so a group takes
many pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEQUENCE_TOKENS = 2048
OPEN_BINS = 1024
GROUP_PIECES = 200_000
CACHED_WORDS = 600_000
#: Pieces of up to this part of a sequence come last.
LATE = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PACKED = PIECES + ", sequence_id long, offset long"


class ByteBpe:
    """Ids of a byte-level BPE tokenizer.

    Its splitting never joins what stands before a space with the space. So where no two white
    spaces are neighbours, the words of a text, each with the one space before it, are encoded apart
    and remembered; any other text is encoded whole. Where a rank file with the same vocabulary is
    given, the faster of the two libraries encodes, but for texts with special strings.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.spaces = re.compile(r"\s\s")
        self.cached, self.words = cached, {}
        self.fast = ranked(ranks_path, pattern) if ranks_path and pattern else None
        if self.fast:
            self.spaced = np.array([self.fast.decode_single_token_bytes(i)[:1] == b" " for i in range(self.fast.n_vocab)])

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text).tobytes() if text else b""

    def learn(self, words: list[str]) -> None:
        """Encode words, each behind one space, in one call: a piece that begins with a space begins a word."""
        ids = self.fast.encode_to_numpy(" " + " ".join(words))
        at = (np.flatnonzero(self.spaced[ids]) * 4).tolist() + [len(ids) * 4]
        data = ids.tobytes()
        if len(self.words) + len(words) > self.cached:
            self.words.clear()
        self.words.update((w, data[i:j]) for w, i, j in zip(words, at[:-1], at[1:], strict=True))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.fast is None or self.special.search(text):
            return self.whole(text)
        if self.spaces.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        last = [self.plain(" " + rest.pop())] if rest else []
        if new := [x for x in set(rest) if x not in self.words]:
            self.learn(new)
        words = self.words
        try:
            return b"".join([self.plain(first), *[words[x] for x in rest], *last])
        except KeyError:  # the memory was emptied under a text with words old and new
            return self.plain(text)


@lru_cache(maxsize=2)
def ranked(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str | None, pattern: str | None) -> ByteBpe:
    return ByteBpe(path, ranks_path, pattern)


def cuts(length: int, most: int = SEQUENCE_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are of full length."""
    first = (length - 1) % most + 1
    return [(0, first), *((a, most) for a in range(first, length, most))]


class Packer:
    """Best-fit over a fixed number of open bins."""

    def __init__(self, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.size, self.most, self.open, self.made = size, open_bins, 0, 0
        self.bits, self.by_free = 0, defaultdict(list)

    def take(self, free: int) -> int:
        held = self.by_free[free]
        bin_id = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its place there."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self.take(free)
        else:
            if self.open >= self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
            free, bin_id = self.size, self.made
            self.made += 1
        if left := free - length:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(bin_id)
            self.open += 1
        return bin_id, self.size - free


def pieces_of(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of each row of docs."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, ranks_path, pattern)

        def made() -> Iterator[tuple]:
            for doc_id, text in common.rows(batches):
                ids = enc.ids(text.decode()) + b"\0\0\0\0"
                for k, (a, n) in enumerate(cuts(len(ids) // 4, size)):
                    yield doc_id, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])

        yield from common.batches_of(made(), PIECES_ARROW)

    return common.documents(docs).mapInArrow(run, PIECES)


def packed(rows: Iterable[tuple], size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int]]:
    """(sequence id, offset) of rows (group, length), which come sorted by group."""
    now, packer = None, None
    for group, length in rows:
        if group != now:
            now, packer = group, Packer(size, open_bins)
        bin_id, offset = packer.place(length)
        yield (group << 36) + bin_id, offset


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Each piece of each document with its sequence and its place there.

    A null or empty text is a document of the closing id alone. Repeated rows are packed each; a null
    doc_id is passed on. Documents longer than a sequence are cut, the first piece being the shorter.
    Other columns are not read. An empty table gives an empty one.
    The pieces, a few numbers each, go to the checkpoint folder: they are counted, then dealt.
    """
    pieces = common.checkpointed(pieces_of(docs, tokenizer_path, ranks_path, pattern, size))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("g", F.pmod("h", F.lit(groups)))
    dealt = dealt.repartition(groups, "g").sortWithinPartitions("g", F.col("length") <= size // LATE, "h", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def lengths() -> Iterator[tuple[int, int]]:
            for batch in batches:
                held.append(batch)
                yield from zip(batch.column("g").to_pylist(), batch.column("length").to_pylist(), strict=True)

        placed, done = packed(lengths(), size, open_bins), []
        for x in placed:
            done.append(x)
            if len(done) == held[0].num_rows:
                batch = held.pop(0)
                ids, offsets = (pa.array(c, pa.int64()) for c in zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], ids, offsets], names=[*PIECES_ARROW.names, "sequence_id", "offset"])
                done = []

    return dealt.mapInArrow(run, PACKED)
