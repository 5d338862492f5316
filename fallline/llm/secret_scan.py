"""Secret scans with linking of credential parts. Built-in functions only.

Spans of a pattern come from splitting a text by it: the lengths of what lies between matches and of
the matches, summed up, are the places, in code points. Strong spans are reported as they are. Weak
ones (an account name, a random-looking string, an address) are reported only where a complementary
part begins within SCOPE code points: an identifier with a secret, a secret with an identifier or an
endpoint, an endpoint with a secret. That interval join goes through cells of SCOPE code points: the
parts of one class in one cell are reduced to the first and last place, sent to their own cell and
its neighbours and joined by equality, so its rows follow the number of parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality_rules import let

SCOPE = 200
#: kind -> (pattern, group whose length counts, least length), in the order of reports.
STRONG = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}


#: A whole run of [A-Za-z0-9+/] that holds an upper and a lower case letter and a digit. It is looked at
#: from its beginning alone, and each part takes what it can and gives nothing back: time is linear.
MIXED_RUN = r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])(?=[A-Za-z+/]*+[0-9])([A-Za-z0-9+/]++)={0,2}"
WEAK = {
    "weak_id": (r"""(?i:user(?:name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 1, 3),
    "weak_secret": (MIXED_RUN, 1, 20),
    "endpoint": (r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|mongodb)://[^\x20\x09-\x0D"'<>]+""", 0, 10),
}
KINDS = [*STRONG, *WEAK]
#: Part classes, and which class complements which.
CLASSES = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "endpoint"}
COMPLEMENTS = [("id", "secret"), ("secret", "id"), ("secret", "endpoint"), ("endpoint", "secret")]
CHUNK = 512
SPAN = "array<struct<start:int,rank:int,end:int>>"


def running(lengths: Column) -> Column:
    """Sums of all before each element; arrays grow by chunks, so long ones take no square of time."""

    def within(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a.out, F.array(a["sum"])).alias("out")), lambda a: a.out)

    def of(x: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int"))
        part = lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK))
        sums = F.transform(chunks, lambda c: F.aggregate(part(c), F.lit(0), lambda a, y: a + y))
        return let(within(sums, F.lit(0)), lambda offsets: F.flatten(F.transform(chunks, lambda c: within(part(c), F.get(offsets, c)))))

    return let(lengths, of)


def spans(text: Column, kind: str) -> Column:
    """The spans of one kind in order, as SPAN."""
    pattern, group, least = (STRONG | WEAK)[kind]
    p, rank = F.lit(pattern), KINDS.index(kind)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else matches
    #: Each match with what lies before it; what follows the last match has no part in it.
    found = F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(matches)).alias("gap"), matches.alias("match"), values.alias("value"))

    def of(m: Column) -> Column:
        before = running(F.flatten(F.transform(m, lambda x: F.array(F.length(x["0"]), F.length(x["1"])))))
        put = lambda at: F.transform(m, lambda x, i: F.struct(F.get(at, 2 * i + 1).alias("start"), F.lit(rank).alias("rank"), (F.get(at, 2 * i + 1) + F.length(x["1"])).alias("end"), (F.length(x["2"]) >= least).alias("fits")))
        return F.transform(F.filter(let(before, put), lambda x: x.fits), lambda x: F.struct(x.start.alias("start"), x["rank"].alias("rank"), x.end.alias("end")))

    zipped = F.transform(found, lambda x: F.struct(x["gap"].alias("0"), x["match"].alias("1"), x["value"].alias("2")))
    return F.when(F.regexp_like(text, p), let(zipped, of)).otherwise(F.array().cast(SPAN))


def joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x.start, x.end)), ",")


def of_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["rank"] == KINDS.index(kind))).cast("long")


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """rid, the columns to keep, `strong` and `weak`, in the checkpoint folder. No text is kept unless asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = {"strong": F.concat(*(spans(text, k) for k in STRONG)), "weak": F.concat(*(spans(text, k) for k in WEAK))}
    return common.checkpointed(docs.select(F.monotonically_increasing_id().alias("rid"), *keep, *(c.alias(k) for k, c in found.items())))


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid -> `links`, the weak spans that a complementary part stands by.

    rows: rid, strong and weak. Rows without a weak span take no part.
    """
    classes = F.array(*(F.lit(CLASSES[k]) for k in KINDS))
    parts = rows.where(F.size("weak") > 0).select("rid", F.explode(F.concat("strong", "weak")).alias("p"))
    parts = parts.select("rid", "p", F.get(classes, F.col("p.rank")).alias("class"), F.floor(F.col("p.start") / scope).cast("int").alias("cell"))
    ends = parts.groupBy("rid", "class", "cell").agg(F.min("p.start").alias("first"), F.max("p.start").alias("last"))
    sides = F.array(F.struct(F.lit(-1).alias("d"), F.col("first").alias("at")), F.struct(F.lit(0).alias("d"), F.col("first").alias("at")), F.struct(F.lit(1).alias("d"), F.col("last").alias("at")))
    near = ends.select("rid", "class", "cell", F.explode(sides).alias("s")).select("rid", F.col("class").alias("other"), (F.col("cell") + F.col("s.d")).alias("cell"), "s.at")
    asks = parts.where(F.col("p.rank") >= len(STRONG))
    wanted = F.create_map(*(F.lit(x) for k in ("id", "secret", "endpoint") for x in (k, ",".join(b for a, b in COMPLEMENTS if a == k))))
    wants = asks.select("rid", "cell", "p", F.explode(F.split(wanted[F.col("class")], ",")).alias("other"))
    met = wants.join(near, ["rid", "cell", "other"]).where(F.abs(F.col("at") - F.col("p.start")) <= scope)
    return met.groupBy("rid").agg(F.collect_set("p").alias("links"))


def with_links(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rows with `every`: the strong spans and the linked weak ones."""
    links = linked(rows.select("rid", "strong", "weak"), scope)
    return rows.join(links, "rid", "left").withColumn("every", F.concat("strong", F.coalesce("links", F.array().cast(SPAN))))


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts of the base kinds, their digest and all spans of each row of docs(doc_id, text).

    A null or empty text has no spans. Repeated rows are scanned each; a null doc_id is passed on.
    Other columns are not read. An empty table gives an empty one.
    """
    rows = with_links(scanned(docs, ["doc_id"]), scope)
    counts = [of_kind(F.col("strong"), k).alias(f"n_{k}") for k in STRONG]
    weak = (F.size("every") - F.size("strong")).cast("long").alias("n_linked")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"), weak)


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with each reported span of text replaced by <kind>; a null text stays null, rows all stay."""
    rows = with_links(scanned(docs.select("text", common.whole_rows(docs)), ["row__"]), scope)
    text = F.col("row__.text").cast("string")
    names = F.array(*map(F.lit, KINDS))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x.start - acc["at"], F.lit(0)))
        mark = F.when(x.start >= acc["at"], F.concat(F.lit("<"), F.get(names, x["rank"]), F.lit(">"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x.end).alias("at"), F.concat(acc.out, F.array(gap, mark)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    put = F.aggregate(F.array_sort("every"), start, step, lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a["at"] + 1, F.length(text))))
    done = F.when(F.size("every") > 0, put).otherwise(text)
    return rows.select(F.col("row__").withField("text", done).alias("row__")).select("row__.*")
