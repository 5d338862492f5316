"""Exact top-k by inner product, over candidates in buckets of like length.

Components become whole numbers, so products are exact. Candidates are grouped by length into
buckets, the longest first, each so many times as large as the one before. The longest few, a matrix
of bounded size that is broadcast, give every query a score to reach before any bucket is met, and
each bucket a higher one: that of the k-th best so far. A query goes on to a bucket only where its
length times the bucket's greatest length can reach that score: queries are dropped before anything
is sent.
Within a bucket the same bound decides which blocks a block of queries, all of which have like needs,
is sent to. In a block the score to beat over both lengths is a local cosine threshold: where it is
high, few coordinates decide, and candidates are pruned by the query's largest coordinates and the
length of what remains of both vectors; where it is low that saves nothing, and lengths alone prune.
What remains is verified by full products. The number of buckets grows with the logarithm of the
number of candidates.

A block of candidates is sent to a few tasks and held there while blocks of queries pass by, so no
row is sent for each pair, and a task returns k rows for each query at most, none of them worse than
the score to reach; ties are settled by vec_id, so copies of one vector do not add rows either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

K = 20
SCALE = 64
#: Candidates of the first bucket, and how many times as many the next one has.
FIRST_ROWS = 8192
#: Bytes of the broadcast matrix of the longest candidates at most.
START_BYTES = 16 << 20
GROWTH = 16
#: Rows of a block at most, and bytes of its matrix of doubles.
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
BLOCK_BYTES = 64 << 20
#: Blocks of queries that one task holding a block of candidates takes.
QUERY_BLOCKS = 32
#: Query blocks' and candidate blocks' numbers, a few bytes each, are joined by a broadcast up to this count.
BROADCAST_BLOCKS = 100_000
HEAD = 16
#: Local cosines from which coordinates are looked at first.
COSINE = 0.6
EXACT = 2.0**53
PACKED = "block long, n long, dim int, longest double, data binary"
FOUND = "query_id long, vec_id long, score long"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of whole doubles, of the vectors that take part, with their dimension and length."""
    x = F.col("embedding").cast(T.ArrayType(T.DoubleType()))
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return rows.where(F.size("v") > 0).select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def packed(rows: DataFrame, most: int, order: Column) -> DataFrame:
    """Blocks of rows(vec_id, v, dim, norm, beat, beat_id) of one dimension, those that `order` puts together.

    A block has at most `most` rows and BLOCK_BYTES; `longest` is its greatest length. The result names
    blocks by partition, so it has to be checkpointed before it is read twice.
    """
    parts = max(1, -(-rows.count() // most))
    dealt = rows.withColumn("order__", order).repartitionByRange(parts, "dim", "order__", "vec_id").sortWithinPartitions("dim", "order__", "vec_id")
    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def made() -> Iterator[tuple]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                dims, norms, v = batch.column("dim").to_numpy(), batch.column("norm").to_numpy(), batch.column("v")
                rest = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("vec_id", "beat", "beat_id")]
                for d in np.unique(dims).tolist():
                    own, size = np.flatnonzero(dims == d), max(1, min(most, BLOCK_BYTES // (8 * d)))
                    for k in range(0, len(own), size):
                        some = own[k : k + size]
                        data = v.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
                        yield number, len(some), d, float(norms[some].max()), pack(*(x[some] for x in rest), data)
                        number += 1

        yield from common.batches_of(made(), schema, 1)

    common.ship(rows.sparkSession)
    return dealt.select("vec_id", "v", "dim", "norm", "beat", "beat_id").mapInArrow(run, PACKED)


def pack(ids: np.ndarray, beat: np.ndarray, beat_id: np.ndarray, data: np.ndarray) -> bytes:
    """Ids, scores to beat and a matrix, whose numbers take two bytes where they fit."""
    kind = "<i2" if np.abs(data).max(initial=0) < 1 << 15 else "<f8"
    return kind.encode() + ids.astype("<i8").tobytes() + beat.astype("<f8").tobytes() + beat_id.astype("<i8").tobytes() + data.astype(kind).tobytes()


def unpack(n: int, dim: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, beat, beat_id = (np.frombuffer(data, kind, n, 3 + 8 * n * k) for k, kind in enumerate(("<i8", "<f8", "<i8")))
    return ids, beat, beat_id, np.frombuffer(data, data[:3].decode(), -1, 3 + 24 * n).astype(float).reshape(n, dim)


class Best:
    """The best k of each query of a block, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0)] * n, [np.empty(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        keep = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[keep], i[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where no sum can pass 2^53, else whole numbers without bound."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        return a.astype(object) @ b.astype(object).T
    return a @ b.T


def visit(best: Best, qids: np.ndarray, q: np.ndarray, beat: np.ndarray, beat_id: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
    """Score one block of candidates against queries with scores to beat, or to reach with no larger id."""
    qn, cn = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    slack = 1e-6
    alive = np.flatnonzero(qn * (cn.max() if len(cn) else 0) * (1 + slack) + slack >= beat)
    if not len(alive):
        return
    local = np.where(qn[alive] * cn.max() > 0, beat[alive] / np.maximum(qn[alive] * cn.max(), 1e-30), -1.0)
    by_length = alive[local < COSINE]
    if len(by_length):  # all at once: most candidates are verified anyway
        s = products(q[by_length], c)
        for r, k in enumerate(by_length):
            fits = np.flatnonzero(((s[r] > beat[k]) | (s[r] == beat[k]) & (ids <= beat_id[k])) & (ids != qids[k]))
            best.add(k, s[r][fits], ids[fits])
    for k in alive[local >= COSINE]:
        top = np.argsort(-np.abs(q[k]), kind="stable")[:HEAD]
        rest_q = np.sqrt(max(0.0, (q[k] ** 2).sum() - (q[k][top] ** 2).sum()))
        rest_c = np.sqrt(np.maximum(0.0, cn**2 - (c[:, top] ** 2).sum(1)))
        bound = c[:, top] @ q[k][top] + rest_q * rest_c
        fits = np.flatnonzero((bound * (1 + np.sign(bound) * slack) + slack >= beat[k]) & (ids != qids[k]))
        if len(fits):
            s = products(q[k : k + 1], c[fits])[0]
            sure = (s > beat[k]) | (s == beat[k]) & (ids[fits] <= beat_id[k])
            best.add(k, s[sure], ids[fits][sure])


def met(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """FOUND: at most k candidates for each query and block, each better than the score to beat.

    asked, blocks: as packed() gives them, where `longest` of asked is the least length of a candidate
    that can be of use to one of its queries. Blocks that cannot be are not sent to.
    """
    few = -(-asked.count() // QUERY_BLOCKS)  # tasks that take each block of candidates, each a share of the queries
    salt = F.pmod(F.xxhash64("qblock"), F.lit(few)).cast("int")
    known = blocks.select("block", "dim", "longest")
    known = F.broadcast(known) if known.count() <= BROADCAST_BLOCKS else known
    sent = asked.select(F.col("block").alias("qblock"), F.col("dim").alias("qdim"), F.col("longest").alias("need")).join(known, (F.col("qdim") == F.col("dim")) & (F.col("longest") >= F.col("need")))
    queries = sent.select("qblock", "block", salt.alias("salt")).join(asked.withColumnRenamed("block", "qblock"), "qblock").select("block", "salt", F.lit(1).alias("kind"), "n", "dim", "data")
    held = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("salt"), F.lit(0).alias("kind"), "n", "dim", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                    got = unpack(row["n"], row["dim"], row["data"])
                    if row["kind"] == 0:
                        block, (ids, _, _, c) = row["block"], got
                        continue
                    if row["block"] != block:
                        raise RuntimeError("a block of queries came without its candidates")
                    qids, beat, beat_id, q = got
                    best = Best(len(qids), k)
                    visit(best, qids, q, beat, beat_id, ids, c)
                    for x, s, y in zip(qids.tolist(), best.scores, best.ids, strict=True):
                        yield from ((x, int(b), int(a)) for a, b in zip(s, y, strict=True))

        block, ids, c = None, None, None
        yield from common.batches_of(made(), FOUND_ARROW, 65536)

    both = held.unionByName(queries)
    return both.repartition(max(8, common.input_partitions(blocks)), "block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(run, FOUND)


def started(queries: DataFrame, rows: DataFrame, k: int, first: int) -> DataFrame:
    """queries with `beat` and `beat_id`: score and id of the k-th best of the longest candidates, where there are k."""
    widest = rows.agg(F.max("dim").alias("d")).first().d or 1
    lead = rows.orderBy(F.desc("norm"), "vec_id").limit(max(1, min(first, START_BYTES // (8 * widest)))).select("vec_id", "dim", "v").toArrow()
    dims = lead.column("dim").to_numpy()
    held = {}
    for d in np.unique(dims).tolist():
        some = lead.filter(pa.array(dims == d))
        held[d] = (some.column("vec_id").to_numpy(), some.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    sent = rows.sparkSession.sparkContext.broadcast(held)
    schema = queries.select("*", F.lit(0.0).alias("beat"), F.lit(0).cast("long").alias("beat_id")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, QUERY_ROWS):
                batch = whole_batch.slice(at, QUERY_ROWS)
                beat, beat_id = np.full(batch.num_rows, -np.inf), np.zeros(batch.num_rows, np.int64)
                qids, dims = batch.column("vec_id").to_numpy(), batch.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    if d not in sent.value:
                        continue
                    own, (ids, c) = np.flatnonzero(dims == d), sent.value[d]
                    q = batch.column("v").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    for i, s in zip(own.tolist(), products(q, c), strict=True):
                        others = np.flatnonzero(ids != qids[i])
                        if len(others) >= k:
                            last = others[np.lexsort((ids[others], -s[others]))[k - 1]]
                            beat[i], beat_id[i] = float(s[last]), ids[last]
                yield batch.append_column("beat", pa.array(beat)).append_column("beat_id", pa.array(beat_id))

    return queries.mapInArrow(run, schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """FOUND and `rank`: the k best of each query. Ranks are cut before the shuffle too."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bounds(rows: DataFrame, first: int, growth: int) -> list[float]:
    """Lengths at which buckets begin, falling; the last takes all that is left. From a sketch of fixed size."""
    n, shares, held = rows.count(), [], first
    while held < n:
        shares.append(1 - held / n)
        held *= growth
    if not shares:
        return [0.0]
    cut = rows.agg(F.percentile_approx("norm", shares, 100_000).alias("p")).first().p
    return [*sorted(set(cut), reverse=True), 0.0] if min(cut) > 0 else sorted({*cut, 0.0}, reverse=True)


def top_k(vectors: DataFrame, every: int = 20, k: int = K, scale: int = SCALE, first: int = FIRST_ROWS, growth: int = GROWTH) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each vector whose vec_id is divisible by `every`.

    Vectors null, or with null or non-finite components, take no part, nor do rows without vec_id;
    vectors of different dimensions are not compared, and an empty one meets none. Rows that repeat a
    vec_id are candidates each, but never of a query of that vec_id. Other columns are not read. Fewer
    than k candidates give all. An empty table gives an empty result.
    """
    common.ship(vectors.sparkSession)
    rows = common.checkpointed(whole(vectors, scale))
    queries = common.checkpointed(started(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), rows, k, first))
    found = rows.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    above = float("inf")
    for low in bounds(rows, first, growth):
        bucket = rows.where((F.col("norm") >= low) & (F.col("norm") < above))
        blocks = common.checkpointed(packed(bucket.withColumn("beat", F.lit(0.0)).withColumn("beat_id", F.lit(0).cast("long")), BLOCK_ROWS, -F.col("norm")))
        longest = blocks.groupBy("dim").agg(F.max("longest").alias("most"))
        last = found.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("new"), F.col("vec_id").alias("new_id"))
        asked = queries.join(last, F.col("vec_id") == F.col("query_id"), "left").withColumn("beat_id", F.coalesce("new_id", "beat_id")).withColumn("beat", F.coalesce("new", "beat"))
        need = F.when(F.col("beat") <= 0, F.lit(0.0)).otherwise(F.col("beat") / (F.col("norm") * (1 + 1e-6) + 1e-9))
        asked = asked.withColumn("need", need).join(F.broadcast(longest) if longest.count() <= BROADCAST_BLOCKS else longest, "dim").where(F.col("need") <= F.col("most"))
        # Of a block of queries `longest` is to be the least need: needs are negative lengths while they are packed.
        asked = packed(asked.select("vec_id", "v", "dim", (-F.col("need")).alias("norm"), "beat", "beat_id"), QUERY_ROWS, F.col("norm"))
        asked = common.checkpointed(asked.withColumn("longest", -F.col("longest")))
        if not asked.isEmpty():
            found = common.checkpointed(best_of(met(asked, blocks, k).unionByName(found.drop("rank")), k))
        above = low
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
