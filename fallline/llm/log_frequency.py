"""Scoring of texts with a trigram language model held in a log-frequency Bloom filter.

Word counts are exact: they come from the vocabulary join by blocks. Counts of bigrams and trigrams
are quantised to the logarithm, level 1 + floor(log_1.5 count), and an n-gram of level q is put into a
Bloom filter once for each level up to q; a reader probes level after level until one is missing.
The filter is cut into slices by ranges of n-gram keys, which grow with what is put into them, so no
n-gram is left out. No task holds more than one slice: blocks send their n-grams to the slices and
are told the levels, as they are told the counts of words. A filter that is broadcast would have to
stop growing with the corpus.

P(w | u, v) = high * min(1, (q(u, v, w) - discount) / most(u, v)) + (1 - high) * P(w | v)
P(w | v)    = share * min(1, (q(v, w) - discount) / c(v)) + (1 - share) * (c(w) + 1) / (N + V + 1)

q is the least count of an n-gram's level and most the largest count of that of (u, v), so neither
share is overstated; terms of n-grams that are not found are 0. The discount is what tells an n-gram
seen once from one seen again where its context was seen no more often than itself. The first token
of a text has no (u, v) and is scored by P(w | v), v being the end that stands before every text.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .blocks import answers, finished, in_parts, pack_words, parts_for, squeeze, unpack_words, unsqueeze, word_hash

END = b"\n"
KEY_BITS = 48
#: Bytes of a block's texts: its n-grams take some fifty times as much memory.
BLOCK_BYTES = 8 << 20
#: Bits of all slices together before any of them grows.
FILTER_BITS = 1 << 27
WORD_BITS = 64
#: Bits of the filter for each level of each n-gram, at least, and how many of them one sets.
ROOM = 16
PROBES = 4
STEP = 0x9E3779B1
BASE = 1.5
LEVELS = 48
SHARE = 0.2
HIGH = 0.4
DISCOUNT = 0.95
#: The least count of each level; level 0 is that of what was not found.
LEAST = np.array([0.0] + [math.ceil(BASE**q) for q in range(LEVELS)])
#: The largest count of each level; the last one has no bound and takes what would begin the next.
MOST = np.array([*(LEAST[1:] - 1), math.ceil(BASE**LEVELS)])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    """Whether a document is none to learn from; a null doc_id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


class Tokens:
    """The tokens of a block's texts by number, each text ending with END."""

    def __init__(self, rows: list[tuple[int | None, bytes]]):
        sizes, numbers, self.words = common.split_words([text for _, text in rows], lower=True)
        self.sizes = sizes + 1
        self.ends = self.sizes.cumsum() - 1
        self.starts = self.ends - sizes
        self.ids = np.full(int(self.sizes.sum()), len(self.words), np.int64)
        inner = np.ones(len(self.ids), bool)
        inner[self.ends] = False
        self.ids[inner] = numbers
        self.words.append(END)
        self.train = np.repeat(np.array([not held_out(doc_id) for doc_id, _ in rows], bool), self.sizes)
        self.first = np.zeros(len(self.ids), bool)
        self.first[self.starts] = True

    def before(self) -> np.ndarray:
        """The number of the token before each."""
        out = np.roll(self.ids, 1)
        out[self.starts] = len(self.words) - 1
        return out

    def ngrams(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all bigrams, and those of the trigrams of the tokens that are no first ones."""
        h = np.fromiter(map(word_hash, self.words), np.uint64, len(self.words))
        two = paired(h[self.before()], h[self.ids])
        three = paired(np.roll(two, 1), h[self.ids])[~self.first]
        return two >> np.uint64(64 - KEY_BITS), three >> np.uint64(64 - KEY_BITS)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def paired(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashes of pairs; that of a trigram is of a bigram's hash and a word's."""
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


def level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(LEAST, counts, side="right") - 1, LEVELS)


class LogFrequencyFilter:
    """A slice of the filter: 64-bit words, in which a level of a key sets PROBES bits of one word.

    Keys go to words by their order, each level a fixed step further on, so that the levels of one
    key fill no word. key: sorted keys of one slice, which has `width` bits of keys below its number.
    The slice starts with `bits` bits and is doubled until each level of each key has room.
    """

    def __init__(self, key: np.ndarray, counts: np.ndarray, bits: int, width: int):
        q = level(counts)
        size = max(0, (bits // WORD_BITS).bit_length() - 1)
        while size < width and int(q.sum()) * ROOM > WORD_BITS << size:
            size += 1
        self.shift, self.mask = np.uint64(max(0, width - size)), np.uint64((1 << width) - 1)
        self.words = np.zeros(1 << size, np.uint64)
        for x in range(1, int(q.max(initial=0)) + 1):
            some = key[q >= x]
            at, set_ = self.place(some, x), self.probes(some, x)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            self.words[at[starts]] |= np.bitwise_or.reduceat(set_, starts)

    def place(self, key: np.ndarray, lev: int) -> np.ndarray:
        return (((key & self.mask) >> self.shift).astype(np.int64) + lev * STEP) & (len(self.words) - 1)

    def probes(self, key: np.ndarray, lev: int) -> np.ndarray:
        h = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.uint64(lev))
        out = np.zeros(len(key), np.uint64)
        for k in range(PROBES):
            out |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
        return out

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The level of each key, 0 where none is found."""
        found, alive, lev = np.zeros(len(key), np.uint8), np.arange(len(key)), 1
        while len(alive) and lev <= LEVELS:
            want = self.probes(key[alive], lev)
            alive = alive[self.words[self.place(key[alive], lev)] & want == want]
            found[alive] = lev
            lev += 1
        return found


def vocabulary_counts(docs: DataFrame, parts: int) -> DataFrame:
    """What each part of the vocabulary tells each block: the training counts of the block's tokens."""

    def send(block) -> Iterator[tuple[int, bytes]]:
        t = Tokens(block.rows)
        counts = np.bincount(t.ids[t.train], minlength=len(t.words))
        for part, at in in_parts(t.words, parts):
            yield part, pack_words([t.words[i] for i in at], counts[at].astype(np.int64).tobytes())

    def answer(lists: list[tuple[int, bytes]]) -> Iterator[bytes]:
        total: Counter[bytes] = Counter()
        asked = []
        for _, data in lists:
            words, counts = unpack_words(data)
            asked.append(words)
            for w, n in zip(words, np.frombuffer(counts, np.int64).tolist(), strict=True):
                total[w] += n
        head = struct.pack("<qq", sum(total.values()), sum(n > 0 for n in total.values()))
        for words in asked:
            yield head + squeeze(np.fromiter(map(total.__getitem__, words), np.int64, len(words)).tobytes())

    return answers(docs, parts, send, answer, BLOCK_BYTES)


def totals(told: DataFrame) -> tuple[int, int]:
    """N and V: training tokens, and distinct ones."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [struct.unpack_from("<qq", x.as_py()) for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), *(pa.array([g[k] for g in got], pa.int64()) for k in (0, 1))], names=["part", "n", "v"])

    by_part = told.select("part", "data").mapInArrow(heads, "part int, n long, v long").groupBy("part").agg(F.max("n").alias("n"), F.max("v").alias("v"))
    row = by_part.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return row.n or 0, row.v or 0


def slices_for(parts: int) -> int:
    """Slices of the filter, a power of two, so that a slice is a range of keys."""
    return 1 << (parts - 1).bit_length()


def by_slice(key: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of sorted keys."""
    if not len(key):
        return []
    part = (key >> np.uint64(KEY_BITS - (slices.bit_length() - 1))).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(key)]
    return [(int(part[a]), a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


def ngram_levels(docs: DataFrame, slices: int, bits: int = FILTER_BITS) -> DataFrame:
    """What each slice of the filter tells each block: the levels of the block's distinct n-grams, in order of their keys."""
    own, width = max(bits // slices, WORD_BITS), KEY_BITS - (slices.bit_length() - 1)

    def send(block) -> Iterator[tuple[int, bytes]]:
        t = Tokens(block.rows)
        two, three = t.ngrams()
        learnt = np.concatenate([t.train, t.train[~t.first]])
        every = np.concatenate([two, three])
        got, counts = np.unique(every, return_counts=True)
        asked, times = np.unique(every[~learnt], return_counts=True)
        counts[np.searchsorted(got, asked)] -= times  # asked for, not learnt from
        for part, a, b in by_slice(got, slices):
            gaps = np.diff(got[a:b])
            wide = int(gaps.max(initial=0)) >> 32 > 0
            head = struct.pack("<?IQ", wide, b - a, int(got[a]))
            yield part, squeeze(head + gaps.astype("<u8" if wide else "<u4").tobytes() + counts[a:b].astype("<u4").tobytes(), 1)

    def answer(lists: list[tuple[int, bytes]]) -> Iterator[bytes]:
        every, counts = [], []
        for _, data in lists:
            raw = unsqueeze(data)
            wide, n, start = struct.unpack_from("<?IQ", raw)
            kind, at = ("<u8", 13 + 8 * (n - 1)) if wide else ("<u4", 13 + 4 * (n - 1))
            every.append(np.concatenate([[np.uint64(start)], np.frombuffer(raw, kind, n - 1, 13).astype(np.uint64)]).cumsum(dtype=np.uint64))
            counts.append(np.frombuffer(raw, "<u4", n, at))
        key, where = np.unique(np.concatenate(every), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts))
        learnt = total > 0
        told = LogFrequencyFilter(key[learnt], total[learnt], own, width).levels(key)[where]
        for x in np.split(told, np.cumsum([len(x) for x in every])[:-1]):
            yield squeeze(x.tobytes())

    return answers(docs, slices, send, answer, BLOCK_BYTES)


def probabilities(c: np.ndarray, before: np.ndarray, two: np.ndarray, three: np.ndarray, first: np.ndarray, floor: float, share: float = SHARE, high: float = HIGH, discount: float = DISCOUNT) -> np.ndarray:
    """P of each token from its own count and that of the one before, and the levels of its bigram and trigram.

    three: of the tokens that are no first ones.
    """
    p = (1 - share) * (c + 1.0) / floor + share * np.minimum(np.maximum(LEAST[two] - discount, 0.0) / np.maximum(before, 1), 1.0)
    context = np.roll(two, 1)[~first]
    some = np.where(context > 0, np.maximum(LEAST[three] - discount, 0.0) / np.maximum(MOST[context], 1.0), 0.0)
    p[~first] = (1 - high) * p[~first] + high * np.minimum(some, 1.0)
    return p


def score(docs: DataFrame, bits: int = FILTER_BITS, share: float = SHARE, high: float = HIGH, discount: float = DISCOUNT) -> DataFrame:
    """Base and model log10 probabilities of each row of docs(doc_id, text).

    A null or empty text is its end alone. Repeated rows are learnt from and scored each. A null
    doc_id is one to learn from and is passed on. Other columns are not read. An empty table gives an
    empty one. The counts told to the blocks go to the checkpoint folder: N and V are summed from
    them before any text is scored. bits: of the filter at least; it grows with the corpus.
    """
    parts = parts_for(docs)
    slices = slices_for(parts)
    told = common.checkpointed(vocabulary_counts(docs, parts))
    n_all, n_words = totals(told)
    levels = ngram_levels(docs, slices, bits).withColumn("part", F.col("part") + parts)
    floor = float(n_all + n_words + 1)

    def finish(rows: list[tuple[int | None, bytes]], data: dict[int, bytes]) -> Iterator[tuple]:
        t = Tokens(rows)
        c = np.zeros(len(t.words), np.int64)
        for part, at in in_parts(t.words, parts):
            c[at] = np.frombuffer(unsqueeze(data[part][16:]), np.int64)
        two, three = t.ngrams()
        key, where = np.unique(np.concatenate([two, three]), return_inverse=True)
        found = np.concatenate([np.frombuffer(unsqueeze(data[parts + k]), np.uint8) for k, _, _ in by_slice(key, slices)])[where]
        own = c[t.ids]
        p = probabilities(own, c[t.before()], found[: len(two)], found[len(two) :], t.first, floor, share, high, discount)
        known, base, model = (np.add.reduceat(x, t.starts).tolist() for x in ((own > 0).astype(np.int64), np.log10((own + 1.0) / floor), np.log10(p)))
        for k, (doc_id, _) in enumerate(rows):
            yield doc_id, held_out(doc_id), int(t.sizes[k]), known[k], n_all, base[k], model[k]

    return finished(docs, told.unionByName(levels), finish, SCORES_ARROW, SCORES, BLOCK_BYTES)
