"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space; the tokenizer drops white space and never joins across it, so
each distinct word is encoded once for the corpus, by the part of the word table it belongs to, and
its ids are joined back by position (see blocks). Decoding joins ids with the id-to-piece table,
which has as many rows as the vocabulary.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .blocks import answers, finished, in_parts, pack_words, parts_for, squeeze, unpack_words, unsqueeze

CODED = "doc_id long, n_tokens long, ids array<int>, decoded string"
CODED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def pieces(path: str) -> list[str]:
    """The id-to-piece table. Without a decoder of its own, decoding puts a space between pieces."""
    t = tokenizer(path)
    if t.decoder is not None:
        raise ValueError("decoding by pieces needs a tokenizer without a decoder")
    return [t.id_to_token(i) or "" for i in range(max(t.get_vocab(with_added_tokens=True).values()) + 1)]


def send(block, parts: int) -> Iterator[tuple[int, bytes]]:
    words = common.split_words([text for _, text in block.rows])[2]
    for part, at in in_parts(words, parts):
        yield part, pack_words([words[i] for i in at])


def encode_part(lists: list[tuple[int, bytes]], path: str) -> Iterator[bytes]:
    """Each distinct word of a part is encoded once; each block gets the ids of its words, in order."""
    asked = [unpack_words(data)[0] for _, data in lists]
    distinct = list({w for words in asked for w in words})
    t, ids = tokenizer(path), {}
    for k in range(0, len(distinct), 10_000):
        some = distinct[k : k + 10_000]
        ids.update((w, e.ids) for w, e in zip(some, t.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True))
    for words in asked:
        got = [ids[w] for w in words]
        sizes = np.fromiter(map(len, got), np.uint32, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))
        yield squeeze(struct.pack("<I", len(got)) + sizes.tobytes() + flat.tobytes())


def word_ids(words: list[bytes], told: dict[int, bytes], parts: int) -> list[list[int]]:
    """The ids of each of a block's distinct words, from what the parts told it."""
    out: list[list[int]] = [[]] * len(words)
    for part, at in in_parts(words, parts):
        raw = unsqueeze(told[part])
        (n,) = struct.unpack_from("<I", raw)
        ends = np.frombuffer(raw, np.uint32, n, 4).cumsum().tolist()
        flat, start = np.frombuffer(raw, np.uint32, -1, 4 + 4 * n).tolist(), 0
        for i, end in zip(at.tolist(), ends, strict=True):
            out[i] = flat[start:end]
            start = end
    return out


def run(docs: DataFrame, path: str, digest: bool) -> DataFrame:
    parts = parts_for(docs)

    def by_text(rows: list[tuple[int | None, bytes]], told: dict[int, bytes]) -> Iterator[tuple[int | None, list[int], list[list[int]]]]:
        """doc_id and the numbers of a text's words that have ids, with the ids by number."""
        sizes, numbers, words = common.split_words([text for _, text in rows])
        ids = word_ids(words, told, parts)
        some = np.fromiter(map(bool, ids), bool, len(ids))
        at = 0
        for (doc_id, _), n in zip(rows, sizes.tolist(), strict=True):
            own = numbers[at : at + n]
            yield doc_id, own[some[own]].tolist(), ids
            at += n

    def ids_of(rows: list[tuple[int | None, bytes]], told: dict[int, bytes]) -> Iterator[tuple]:
        names = pieces(path)
        for doc_id, own, ids in by_text(rows, told):
            flat = [i for w in own for i in ids[w]]
            yield doc_id, len(flat), flat, " ".join([names[i] for i in flat])

    def digests(rows: list[tuple[int | None, bytes]], told: dict[int, bytes]) -> Iterator[tuple]:
        names, listed, decoded = pieces(path), None, None
        for doc_id, own, ids in by_text(rows, told):
            if listed is None:  # once for a block
                listed = [" ".join(map(str, x)).encode() for x in ids]
                decoded = [" ".join([names[i] for i in x]).encode() for x in ids]
            text = b" ".join(map(listed.__getitem__, own))
            yield doc_id, text.count(b" ") + 1 if own else 0, hashlib.sha256(text).hexdigest(), hashlib.sha256(b" ".join(map(decoded.__getitem__, own))).hexdigest()

    told = answers(docs, parts, lambda block: send(block, parts), lambda lists: encode_part(lists, path))
    if digest:
        return finished(docs, told, digests, DIGEST_ARROW, DIGEST)
    return finished(docs, told, ids_of, CODED_ARROW, CODED)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, of each row of docs(doc_id, text).

    A null or empty text has no ids and decodes to an empty text. Repeated rows give a row each; a
    null doc_id is passed on. Other columns are not read. An empty table gives an empty one.
    """
    return run(docs, path, digest=False)


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """The same with SHA-256 digests of the ids, joined by single spaces, and of the decoded text."""
    return run(docs, path, digest=True)
