"""Quality rules with thresholds that follow each language and source. Built-in functions only.

The base measures come from one expression per text; no text is exploded into rows. The thresholds
come from quantile sketches: a measure, a whole number per thousand, falls into the bucket given by
its leading seven bits, and a sketch is the count of each bucket. Counts add up, so sketches of a
(language, source) merge into those of the language and of the whole, and a quantile is off by less
than one part in 64. A group with few documents takes its language's thresholds, and a language with
few those of all. A document is rejected where a measure lies beyond the median by more than `fence`
times the distance from there to the upper (or lower) decile of its group. A tenth of a group may be
junk without moving its thresholds. The distance counts as SPREAD at least, which is far below what
ordinary text shows: it decides only where a sketch is degenerate, nearly all of its values being
one, as the shares of symbols and of repeated lines are in most groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MEASURES = ("symbols", "dup_lines", "repeats", "word_length")
#: The distance from the median to a decile in a degenerate sketch of each measure, per thousand.
SPREAD = {"symbols": 20, "dup_lines": 80, "repeats": 10, "word_length": 100}
FENCE = 6
LEAST_DOCS = 50
MIN_WORDS = 50
#: Groups whose thresholds are broadcast; with more, documents are joined by a shuffle.
BROADCAST_GROUPS = 50_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    inner = F.trim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, rf"[{common.SPACE}]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Each window becomes one long: the upper bits of its hash, its place in the lower bits. Sorting
    these brings equal windows together; neighbours with equal hashes are then compared word by word.
    """

    def of(words: Column, bits: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            at = [x.bitwiseAND(low).cast("int") for x in (a, b)]
            return F.coalesce((up(a) == up(b)), F.lit(False)) & F.coalesce(let(F.struct(*(x.alias(n) for x, n in zip(at, "ab", strict=True))), lambda p: (F.get(words, p.a) == F.get(words, p.b)) & (F.get(words, p.a + 1) == F.get(words, p.b + 1)) & (F.get(words, p.a + 2) == F.get(words, p.b + 2))), F.lit(False))

        one = F.lit(1).cast("long")
        low = F.call_function("shiftleft", one, bits) - one
        up = lambda x: F.call_function("shiftright", x, bits)
        windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")))
        near = lambda s: F.filter(s, lambda x, j: F.coalesce(up(x) == up(F.get(s, j + 1)), F.lit(False)) | F.coalesce(up(x) == up(F.get(s, j - 1)), F.lit(False)))
        sure = lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 2)) | same(x, F.get(s, j - 2)))
        places = let(let(F.sort_array(windows), near), lambda s: F.sort_array(F.transform(sure(s), lambda x: x.bitwiseAND(low))))
        start = F.struct(F.lit(-3).cast("long").alias("prev"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("prev"), (acc.total + F.least(F.lit(3).cast("long"), p - acc.prev)).alias("total")), lambda acc: acc.total)

    bits = F.length(F.bin(F.size(words).cast("long"))).cast("int")
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(bits, lambda b: of(words, b)))


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column `rule_base`: the base measures, n_lines and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")

    def base(w: Column) -> Column:
        n = F.size(w).cast("long")
        joined = F.array_join(w, "")
        fields = {
            "n_words": n,
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": (F.length(joined) - F.length(F.regexp_replace(joined, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_lines": F.size(lines).cast("long"),
            "n_repeat_words": repeated_words(w),
        }
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    b = F.col("rule_base")
    made = docs.withColumn("rule_base", let(words_of(text), base))
    return made.withColumn("rule_base", b.withField("base_failed", (b.n_words < MIN_WORDS) | (100 * b.n_repeat_words > 50 * b.n_words)))


def per_thousand(b: Column) -> dict[str, Column]:
    words, lines = F.greatest(b.n_words, F.lit(1)), F.greatest(b.n_lines, F.lit(1))
    parts = {"symbols": (b.n_symbols, words), "dup_lines": (b.n_dup_lines, lines), "repeats": (b.n_repeat_words, words), "word_length": (b.word_chars, words)}
    return {k: F.floor(1000 * x / y).cast("long") for k, (x, y) in parts.items()}


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket) -> count, over the rows that pass the base rules.

    rows: lang, source and rule_base. A bucket is named by its least value.
    """
    every = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in per_thousand(F.col("rule_base")).items())))
    bucket = F.expr("value - value % shiftleft(1L, greatest(0, length(bin(value)) - 7))")
    held = rows.where(~F.col("rule_base.base_failed")).select("lang", "source", every.alias("m")).select("lang", "source", "m.measure", "m.value")
    return held.withColumn("bucket", bucket).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str, fence: int = FENCE) -> DataFrame:
    """One row per key: `docs`, and `low` and `high`, maps from a measure to its fences."""
    # The counts below a bucket, from the few buckets of one sketch.
    listed = sketch.groupBy(*keys, "measure").agg(F.sum("n").alias("docs"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))

    def quantile(percent: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at"))
        step = lambda acc, x: F.struct((acc.seen + x.n).alias("seen"), F.when(acc["at"].isNull() & (100 * (acc.seen + x.n) >= percent * F.col("docs")), x.bucket).otherwise(acc["at"]).alias("at"))
        return F.aggregate("b", start, step, lambda acc: acc["at"])

    spread = F.create_map(*(F.lit(x) for kv in SPREAD.items() for x in kv))[F.col("measure")].cast("long")
    q = listed.select(*keys, "measure", "docs", quantile(10).alias("q10"), quantile(50).alias("q50"), quantile(90).alias("q90"))
    low = F.col("q50") - fence * F.greatest(F.col("q50") - F.col("q10"), spread)
    high = F.col("q50") + fence * F.greatest(F.col("q90") - F.col("q50"), spread)
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("measure", c.alias("v"))))
    return q.groupBy(*keys).agg(F.max("docs").alias("docs"), as_map(low).alias("low"), as_map(high).alias("high"))


def thresholds(rows: DataFrame, least: int = LEAST_DOCS, fence: int = FENCE) -> DataFrame:
    """(lang, source) -> low and high: the group's own fences, its language's or those of all."""
    sketch = common.checkpointed(sketches(rows))
    own, by_lang, of_all = fences(sketch, "lang", "source", fence=fence), fences(merged(sketch, "lang"), "lang", fence=fence), fences(merged(sketch), fence=fence)
    by_lang = by_lang.select(F.col("lang").alias("l2"), F.struct("docs", "low", "high").alias("two"))
    of_all = of_all.select(F.struct("docs", "low", "high").alias("three"))
    out = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l2"))).join(F.broadcast(of_all), F.lit(True))  # one row
    pick = F.when(F.col("docs") >= least, F.struct("docs", "low", "high")).when(F.col("two.docs") >= least, F.col("two")).otherwise(F.col("three"))
    return common.checkpointed(out.select("lang", "source", pick.alias("p")).select("lang", "source", "p.low", "p.high"))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows(lang, source, rule_base, ...) with `rule_kept`.

    The limits are few, one row for each language and source, and broadcast where their count has
    been found small.
    """
    limits = limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.col("low").alias("t_low"), F.col("high").alias("t_high"))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    b = F.col("rule_base")
    fine = ~b.base_failed
    for k, v in per_thousand(b).items():
        fine = fine & (v <= F.coalesce(F.col("t_high")[k], v)) & ((v >= F.coalesce(F.col("t_low")[k], v)) if k == "word_length" else F.lit(True))
    out = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return out.withColumn("rule_kept", fine).drop("t_lang", "t_source", "t_low", "t_high")


def quality_rules(docs: DataFrame, least: int = LEAST_DOCS, fence: int = FENCE) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of each row of docs(doc_id, text, lang, source).

    A null text has no words and fails the base rules, as an empty one does. Null languages and
    sources are groups of their own. Repeated rows are judged each; a null doc_id is passed on. Other
    columns are not read. An empty table gives an empty one. The measures, not the texts, go to the
    checkpoint folder, since they are read for the sketches and again for the verdicts.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), "lang", "source"]
    rows = common.checkpointed(measured(docs.select(*cols, "text")).select("doc_id", "lang", "source", "rule_base"))
    out = judged(rows, thresholds(rows, least, fence))
    return out.select("doc_id", *(F.col(f"rule_base.{k}").alias(k) for k in BASE), F.col("rule_base.base_failed").alias("base_failed"), F.col("rule_kept").alias("kept"))


def keep_good(docs: DataFrame, least: int = LEAST_DOCS, fence: int = FENCE) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs, whatever their names.

    The rows go to the checkpoint folder with their measures, which are taken once.
    """
    rows = common.checkpointed(measured(docs.select("text", "lang", "source", common.whole_rows(docs))).select("row__", "lang", "source", "rule_base"))
    return judged(rows, thresholds(rows.select("lang", "source", "rule_base"), least, fence)).where("rule_kept").select("row__.*")
