"""Token counts of whole documents with a SentencePiece BPE model, by overlap resynchronisation.

A document no longer than a chunk is encoded in one call. Any other is encoded in overlapping chunks,
so that time stays linear and memory bounded however long it is, and the chunks are spliced at
boundaries that are proven to be boundaries of the whole encoding. Chunks are short: most tokens of a
corpus are settled by splices, and what they cost shows on any corpus:

* A BPE encoding is the only one all of whose adjacent pairs of pieces encode to themselves: a
  sequence in which encode(a + b) == [a, b] for each neighbouring a, b is the encoding of the whole.
* Each chunk's encoding has that property inside. So left[:p] + right[p:] is the encoding of the
  joined text if both chunks have a boundary at p and the one new pair across p encodes to itself.

The overlap starts small and is doubled when no boundary in it can be proven; at worst the right
chunk's overlap covers the whole left chunk, and the two are encoded as one.
Only the count of the settled pieces and the last chunk's pieces are held at any time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

CHUNK_BYTES = 2048
OVERLAP_BYTES = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


@lru_cache(maxsize=4)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def piece_bytes(sp) -> np.ndarray:
    """How many bytes of a text each piece covers: a byte piece one, any other its own."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return np.array([1 if sp.is_byte(i) else len(x.replace("\u2581", " ").encode()) for i, x in enumerate(pieces)])


class Chunked:
    """Counts the pieces of one huge text."""

    def __init__(self, sp, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES):
        self.sp, self.chunk, self.overlap = sp, max(4, chunk_bytes), max(4, overlap_bytes)
        self.widened = self.spliced = 0  # overlaps made wider; pieces settled by splices

    def encoded(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data[start:end], and after which byte of the whole text each ends.

        A chunk that does not begin the text is encoded behind a line break, which no piece holds but
        its own byte, so that the space the model puts before a text does not touch the chunk.
        """
        body, shift = self.data[start:end].decode(), int(start > 0)
        ids = self.sp.encode("\n" * shift + body, return_type="numpy")
        ends = np.cumsum(piece_bytes(self.sp)[ids]) - 1 - shift + start  # the space before the text is of no length
        if len(ids) and ends[-1] != end:
            raise ValueError("this model changes texts before it splits them: chunks cannot be aligned")
        return ids[2 * shift :], ends[2 * shift :]

    def proven(self, a: int, b: int) -> bool:
        """Whether the pair of ids across a splice encodes to itself."""
        if self.sp.is_byte(a) or self.sp.is_byte(b):
            return True  # a character outside the vocabulary takes part in no merge
        joined = (self.sp.id_to_piece(a) + self.sp.id_to_piece(b)).replace("\u2581", " ")
        return self.sp.encode("\n" + joined)[2:] == [a, b]

    def cut(self, at: int) -> int:
        """The last character's beginning at or before a byte."""
        while at < len(self.data) and self.data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def count(self, text: str) -> int:
        self.data = text.replace("\u2581", " ").encode()  # the model takes the two for the same
        size = len(self.data)
        settled, start, end = 0, 0, self.cut(min(size, self.chunk))
        ids, ends = self.encoded(0, end)
        while end < size:
            overlap, upto = self.overlap, self.cut(min(size, end + self.chunk))
            while (low := self.cut(max(start, end - overlap))) > start:
                ids2, ends2 = self.encoded(low, upto)
                shared = np.intersect1d(ends[ends > low], ends2[ends2 < end])
                for p in shared[np.argsort(np.abs(2 * shared - low - end), kind="stable")]:
                    i, j = np.searchsorted(ends, p), np.searchsorted(ends2, p)
                    if self.proven(int(ids[i]), int(ids2[j + 1])):
                        settled += int(i) + 1
                        ids, ends, start = ids2[j + 1 :], ends2[j + 1 :], int(p)
                        break
                else:
                    overlap *= 2
                    self.widened += 1
                    continue
                break
            else:  # nothing provable in all of the left chunk: both are encoded as one
                ids, ends = self.encoded(start, upto)
            end = upto
        self.spliced += settled
        return settled + len(ids)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """Per row of docs(doc_id, text): n_bytes, n_tokens and whether n_tokens exceeds `limit`.

    A null or empty text has 0 bytes and 0 tokens. A null doc_id is passed on. Repeated rows give a
    row each. Other columns are not read. An empty table gives an empty one. No shuffle.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(model_path)
        chunked = Chunked(sp, chunk_bytes, overlap_bytes)
        for batch in batches:
            ids, col = batch.column("doc_id"), batch.column("text").cast(pa.large_string())
            n_bytes, n_tokens = [], []
            for x in col:
                text = x.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(chunked.count(text) if n_bytes[-1] > chunk_bytes else len(sp.encode(text, return_type="numpy")))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])], schema=ARROW)

    return common.documents(docs).mapInArrow(run, SCHEMA)
