"""Near-duplicate documents by bottom-k sketches and inverted lists, verified on full shingle sets.

1. Each text becomes its set of word shingles, as 63-bit hashes of one function; the set's least
   SKETCH values are its sketch. Texts with equal sets are one node from here on.
2. Values are ordered by how many sketches retain them, rarest first. Two sketches that must share
   at least `o` of `s` values share one among the first s - o + 1 of either in any common order, so
   only these are entered into inverted lists. For sets no larger than a sketch `o` follows from the
   threshold; for larger ones the overlap of two sketches is binomial, and OVERLAP lies five standard
   deviations below its mean at the threshold. Passages that many documents share come last and
   hardly enter any list.
3. Only lists of up to SHORT members are turned into all their pairs. In any list every member is compared with one leader, the member
   with the fewest shingles that few texts hold, on full sets. Links found so make components.
   For the pairs of members in different components, let x be one that is not linked to the leader L.
   A set is L with the elements of its difference from L exchanged, and two sets x and y that share s
   elements of their differences have |x & y| = |L| - a_x - a_y + s and |x | y| = |L| + b_x + b_y - s,
   a counting what L alone has and b what the other alone has. So a similarity of p needs
   (1 + p) s >= need_x + need_y + (1 - p) |L|, where need = a + p b - (1 - p) |L| is positive for x:
   the differences overlap widely, and again only their first elements, in a common order, are
   entered into lists, now one for each leader and element. What thousands of near copies have in
   common is in no difference, so a group costs a multiple of its size, and no pair that could join
   two components is left out.
4. Pairs found by differences pass when the sketch of the union, made from both sketches, estimates
   at least FLOOR (the threshold itself where the sketches are whole sets), and are verified on the
   full sets. Components of all links are the result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
PERCENT = 80
SKETCH = 64
OVERLAP = 35
FLOOR = 55
#: Shingles of so many texts come last in the order of differences.
HOT = 24
#: Lists of up to so many members are compared in full.
SHORT = 12
#: Bits of the filter that finds the documents whose texts are wanted; false hits only cost time.
FILTER_BITS = 1 << 24
PROFILE = "doc_id long, n_shingles long, mark binary, sketch array<long>"
PROFILE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("mark", pa.binary()), ("sketch", pa.list_(pa.int64()))])
TEXTS_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("packed", pa.binary())])


class WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, hashes: WordHashes, words: int) -> np.ndarray:
    """The sorted set of a text's shingles. With fewer words the whole sequence is the one shingle."""
    found = text.lower().split()  # bytes.lower() changes A-Z alone
    if not found:
        return np.empty(0, np.int64)
    h = np.fromiter([hashes[w] for w in found], np.uint64, len(found))
    size = min(words, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique((x >> np.uint64(1)).astype(np.int64))


def mark_of(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Size, fingerprint and sketch of the shingle set of each row. An empty set has no fingerprint."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def made() -> Iterator[tuple]:
            for doc_id, text in common.rows(batches):
                found = shingles(text, hashes, words)
                yield doc_id, len(found), mark_of(found), found[:SKETCH]

        yield from common.batches_of(made(), PROFILE_ARROW)

    return common.documents(docs).mapInArrow(run, PROFILE)


def prefix(n: Column) -> Column:
    """How many values of a sketch of a set of n are entered into lists."""
    whole = n - F.least(F.ceil(n * PERCENT / 100).cast("long"), F.lit(48)) + 1
    return F.when(n <= SKETCH, whole).otherwise(F.lit(SKETCH - OVERLAP + 1))


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """(value, node): the entries of lists, of values that more than one sketch retains."""
    values = nodes.select("node", "n", F.explode("sketch").alias("value"))
    held = values.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    shared = values.join(held, "value").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("times", "value"))).alias("v"))
    alone = (F.least(F.col("n"), F.lit(SKETCH)) - F.size("v")).alias("alone")  # values of this node alone come first
    room = F.greatest(prefix(F.col("n")) - F.col("alone"), F.lit(0)).cast("int")
    return shared.select("node", "n", "v", alone).select("node", F.explode(F.slice("v", F.lit(1), room)).alias("x")).select("x.value", "node")


def with_leads(lists: DataFrame, rare: DataFrame) -> DataFrame:
    """(value, x, lead, many): the entries with their list's leader, by rare(node, rare), and size."""
    central = F.min(F.struct("rare", F.xxhash64("node").alias("h"), "node")).alias("lead")
    leads = lists.join(rare, "node").groupBy("value").agg(F.count("*").alias("many"), central).where("many > 1").select("value", F.col("lead.node").alias("lead"), "many")
    return lists.join(leads, "value").select("value", F.col("node").alias("x"), "lead", "many")


def first_pairs(led: DataFrame) -> DataFrame:
    """(x, lead, long): each member with the leaders of its lists; long if one of these lists is."""
    return led.where("x != lead").groupBy("x", "lead").agg(F.max(F.col("many") > SHORT).alias("long"))


def rest_pairs(led: DataFrame, compared: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs in different components, not both linked to one leader, that may be similar."""
    of = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    known = compared.where("long").join(of("x"), "x", "left").withColumn("c", F.coalesce("c_x", "x"))
    far = known.where("NOT linked").join(of("lead"), "lead", "left").withColumn("apart", F.col("c") != F.coalesce("c_lead", "lead"))
    mine = lambda rows, width: rows.select("lead", "x", "c", "need", "rest", "delta", (F.col("delta") - F.size(width)).alias("left"), F.explode(width).alias("e"))
    other = lambda rows: rows.select("lead", "e", *(F.col(k).alias(f"{k}_y") for k in ("x", "c", "need", "delta", "left")))
    # What two differences share is no more than the smaller. More closely: it is what their entered
    # elements are seen to share, and of the one whose entries end first in the order, others.
    wanted = F.col("need") + F.col("need_y") + F.col("rest")
    fits = (F.col("c") != F.col("c_y")) & ((100 + percent) * F.least("delta", "delta_y") >= wanted)
    both = mine(far, F.slice("difference", F.lit(1), F.col("far_width")))
    one = both.join(other(both), ["lead", "e"]).where(fits & (F.col("x") < F.col("x_y")))
    two = mine(far.where("apart"), F.col("difference")).join(other(mine(known.where("linked"), F.col("difference"))), ["lead", "e"]).where(fits)
    met = one.union(two).groupBy("lead", "x", "x_y").agg(F.count("*").alias("s"), F.max(wanted).alias("wanted"), *(F.max(k).alias(k) for k in ("left", "left_y", "delta", "delta_y")))
    more = F.greatest(F.least("left", F.col("delta_y") - F.col("s")), F.least("left_y", F.col("delta") - F.col("s")))
    met = met.where((100 + percent) * (F.col("s") + more) >= F.col("wanted")).select("x", F.col("x_y").alias("y"))
    few = led.where(F.col("many") <= SHORT).join(of("x"), "x", "left").select("value", "x", F.coalesce("c_x", "x").alias("c"))
    three = few.join(few.select("value", F.col("x").alias("y"), F.col("c").alias("cy")), "value").where("x < y AND c != cy")
    found = met.union(three.select("x", "y"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def likely(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose union sketch lets them reach the threshold."""
    a, b = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    both = found.join(a, "a").join(b, "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    floor = F.when((F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH) & (F.size(F.array_union("sa", "sb")) <= SKETCH), F.lit(PERCENT)).otherwise(F.lit(FLOOR))
    return both.where(100 * shared >= floor * F.size(union)).select("a", "b")


def bitmap(places: DataFrame) -> list[tuple[int, bytes]]:
    """A bitmap of FILTER_BITS bits, of the same size for any table, of places(at) from 1 on."""
    bits = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return [(r.bucket, bytes(r.bits)) for r in bits.collect()]


def common_elements(texts: DataFrame, words: int) -> np.ndarray:
    """A bitmap of the places of shingles that HOT texts or more hold; by its low bits a shingle has its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, weight = Sets(words), [], 0

        def summed() -> pa.RecordBatch:
            e, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(e), pa.array(n)], names=["e", "n"])

        for batch in batches:
            for packed in batch.column("packed"):
                held.append(shingles(sets.unpacker.decompress(packed.as_py()), sets.hashes, words))
                weight += len(held[-1])
                if weight > 500_000:
                    yield summed()
                    held, weight = [], 0
        if held:
            yield summed()

    counts = texts.select("packed").mapInArrow(run, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in bitmap(counts.select((F.pmod("e", F.lit(FILTER_BITS)) + 1).alias("at"))):
        out[(bucket - 1) * 4096 :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def is_common(elements: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = elements & (FILTER_BITS - 1)
    return (hot[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def rarities(texts: DataFrame, words: int, hot) -> DataFrame:
    """(node, rare): how many shingles of each text are no common ones. hot: as below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)
        for batch in batches:
            found = (shingles(sets.unpacker.decompress(x.as_py()), sets.hashes, words) for x in batch.column("packed"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([int((~is_common(x, hot.value)).sum()) for x in found], pa.int64())], names=["node", "rare"])

    return texts.mapInArrow(run, "node long, rare long")


def among(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose doc_id may be among ids(id), and rows whose doc_id certainly is not.

    By a bitmap, which is collected and broadcast.
    """
    spark = docs.sparkSession
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    rows = bitmap(ids.select((at(F.col("id")) + 1).alias("at")))
    few = F.broadcast(spark.createDataFrame(rows, "bucket__ long, bits__ binary"))
    place = at(F.col("doc_id")) + 1
    byte = F.conv(F.hex(F.substring(F.col("bits__"), F.floor(F.bitmap_bit_position(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.pmod(F.bitmap_bit_position(place), F.lit(8)).cast("int")).bitwiseAND(1) == 1
    met = docs.join(few, F.bitmap_bucket_number(place) == F.col("bucket__"), "left").withColumn("hit__", F.coalesce(hit, F.lit(False)))
    return tuple(met.where(c).drop("bucket__", "bits__", "hit__") for c in (F.col("hit__"), ~F.col("hit__")))


def texts_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, packed): the compressed text of each wanted node(node, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = WordHashes(), zstandard.ZstdCompressor(level=3)
        made = ((doc_id, mark_of(shingles(text, hashes, words)), packer.compress(text)) for doc_id, text in common.rows(batches))
        yield from common.batches_of(made, TEXTS_ARROW)

    maybe, _ = among(common.documents(docs).where("doc_id IS NOT NULL"), wanted.select(F.col("node").alias("id")))
    made = maybe.mapInArrow(run, "doc_id long, mark binary, packed binary")
    return made.join(wanted, (F.col("doc_id") == F.col("node")) & (made["mark"] == wanted["mark"])).groupBy("node").agg(F.first("packed").alias("packed"))


class Sets:
    """Full sets of packed texts, the last few held: a leader's rows come together."""

    def __init__(self, words: int):
        self.words, self.hashes, self.unpacker = words, WordHashes(), zstandard.ZstdDecompressor()
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(self, node: int, packed: pa.Scalar) -> np.ndarray:
        if node not in self.held:
            if len(self.held) >= 16:
                self.held.popitem(last=False)
            self.held[node] = shingles(self.unpacker.decompress(packed.as_py()), self.hashes, self.words)
        return self.held[node]


def with_texts(found: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    left = found.join(texts.select(F.col("node").alias(a), F.col("packed").alias("xa")), a)
    return left.join(texts.select(F.col("node").alias(b), F.col("packed").alias("xb")), b).select(a, b, "xa", "xb")


def differences(x: np.ndarray, lead: np.ndarray, percent: int, hot: np.ndarray | None = None) -> tuple[bool, int, int, int, int, np.ndarray]:
    """linked, need, rest, delta, far_width and difference: whether x is linked to the leader, what a
    pair with it needs, the size of its difference, and the elements of it to be entered.

    Of one that is not linked the first `far_width` are to meet others not linked, and all those
    returned to meet linked ones. Those come first that few others differ in: what x alone has and
    is rare, then what the leader alone has and is common; what the leader has to itself comes last.
    """
    added, gone = np.setdiff1d(x, lead, assume_unique=True), np.setdiff1d(lead, x, assume_unique=True)
    a, b, rest = len(gone), len(added), (100 - percent) * len(lead)
    need = 100 * a + percent * b - rest
    every = np.concatenate([added, gone])
    if hot is not None:
        common = is_common(every, hot)
        every = every[np.argsort(np.where(np.arange(a + b) < b, 2 * common, 3 - 2 * common), kind="stable")]
    if need <= 0:
        least = -(-(need + rest + 1) // (100 + percent))
        return True, need, rest, a + b, 0, every[: max(0, a + b - least + 1)]
    close = -(-need // 100)  # s <= a_y + b_y gives 100 s >= need_x
    far = max(close, -(-(need + rest) // (100 + percent)))
    return False, need, rest, a + b, max(0, a + b - far + 1), every[: max(0, a + b - close + 1)]


def compared(found: DataFrame, texts: DataFrame, words: int, percent: int, hot) -> DataFrame:
    """found(x, lead) with what differences() says. hot: a broadcast of common_elements()."""
    schema = pa.schema([("x", pa.int64()), ("lead", pa.int64()), ("linked", pa.bool_()), ("need", pa.int64()), ("rest", pa.int64()), ("delta", pa.int32()), ("far_width", pa.int32()), ("difference", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)

        def made() -> Iterator[tuple]:
            for batch in batches:
                for x, lead, xa, xb in zip(batch.column("x").to_pylist(), batch.column("lead").to_pylist(), batch.column("xa"), batch.column("xb"), strict=True):
                    yield x, lead, *differences(sets.of(x, xa), sets.of(lead, xb), percent, hot.value)

        yield from common.batches_of(made(), schema)

    return with_texts(found, texts, "x", "lead").mapInArrow(run, "x long, lead long, linked boolean, need long, rest long, delta int, far_width int, difference array<long>")


def verified(found: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(words)
        for batch in batches:
            fits = []
            for i, j, xa, xb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("xa"), batch.column("xb"), strict=True):
                p, q = sets.of(i, xa), sets.of(j, xb)
                same = len(np.intersect1d(p, q, assume_unique=True))
                fits.append(100 * same >= percent * (len(p) + len(q) - same))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return with_texts(found, texts, "a", "b").mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark, n_shingles and component_id of each row of docs(doc_id, text)."""
    if percent < PERCENT:
        raise ValueError(f"sketches of {SKETCH} values are made for similarities of {PERCENT} % and more")
    rows = common.checkpointed(profiles(docs, words))
    sets = rows.where("mark IS NOT NULL AND doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("node"), F.min_by(F.struct(F.col("n_shingles").alias("n"), "sketch"), "doc_id").alias("s"))
    nodes = common.checkpointed(sets.select("node", "mark", "s.n", "s.sketch"))
    lists = common.checkpointed(inverted_lists(nodes))
    wanted = lists.select("node").distinct().join(nodes.select("node", "mark"), "node")
    texts = common.checkpointed(texts_of(docs, wanted, words))
    hot = docs.sparkSession.sparkContext.broadcast(common_elements(texts, words))
    led = with_leads(lists, common.checkpointed(rarities(texts, words, hot)))
    pairs = common.checkpointed(first_pairs(led))
    first = common.checkpointed(compared(pairs, texts, words, percent, hot).join(pairs, ["x", "lead"]))
    links = first.where("linked").select(F.col("x").alias("a"), F.col("lead").alias("b"))
    labels = components(links)
    more = common.checkpointed(verified(likely(rest_pairs(led, first, labels, percent), nodes), texts, words, percent))
    if not more.isEmpty():
        labels = components(links.union(more))
    by_mark = nodes.select("mark", "node").join(labels, "node", "left").select("mark", F.coalesce("component", "node").alias("c"))
    out = rows.select("doc_id", "n_shingles", "mark").join(by_mark, "mark", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "mark", "n_shingles", own.alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs(doc_id, text).

    Texts null, empty or without words have no shingles and are linked with nothing. Rows that repeat
    a text are in one component; of rows that repeat a doc_id too each is kept. A null doc_id names no
    component: such rows are linked with nothing, kept, and their component_id is null. Other columns
    are not read. An empty table gives an empty one.
    """
    out = labelled(docs, words, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when one document of each component does, with the columns of docs."""
    gone = common.checkpointed(labelled(docs, words, percent).where("doc_id != component_id").select(F.col("doc_id").alias("id")).distinct())
    maybe, surely = among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_rows(docs)), gone)
    return surely.unionByName(maybe.join(gone, F.col("doc_id") == F.col("id"), "left_anti")).select("row__.*")
