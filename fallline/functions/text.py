"""Name normalisation, similarity and keys as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words a feed puts into lift names, removed in this order.
FEED_WORDS = ("express", "quad", "triple", "double", "detach", "fixed", "high-speed", "high speed")

#: Dial codes by region.
DIAL_CODES = {
    "US": "1", "CA": "1", "MX": "52", "GB": "44", "IE": "353", "FR": "33", "DE": "49", "IT": "39", "ES": "34", "PT": "351", "NL": "31", "BE": "32",
    "CH": "41", "AT": "43", "SE": "46", "NO": "47", "DK": "45", "FI": "358", "PL": "48", "CZ": "420", "GR": "30", "HU": "36", "RO": "40", "RU": "7",
    "UA": "380", "TR": "90", "IL": "972", "AE": "971", "SA": "966", "EG": "20", "ZA": "27", "AU": "61", "NZ": "64", "JP": "81", "KR": "82", "CN": "86",
    "HK": "852", "TW": "886", "SG": "65", "MY": "60", "TH": "66", "VN": "84", "PH": "63", "ID": "62", "IN": "91", "PK": "92", "BD": "880", "BR": "55",
    "AR": "54", "CL": "56", "CO": "57", "PE": "51",
}
#: Letters whose marks are dropped, and what stays: every letter up to U+024F that decomposes into a letter and marks.
_PARTS = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xC0, 0x250)}
_BARE = {c: d[0] for c, d in _PARTS.items() if len(d) > 1 and all(map(unicodedata.combining, d[1:]))}
ACCENTED, PLAIN = "".join(_BARE), "".join(_BARE.values())


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, " +", " "))


def feed_name(name: Column) -> Column:
    """A name as feeds are matched by: lower case, without lift words and marks."""
    bare = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), FEED_WORDS, F.lower(name))
    return squeezed(F.regexp_replace(bare, r"[^\p{L}\p{N} ]", ""))


def ingest_name(name: Column) -> Column:
    """A name as sources are reconciled by: no leading article, no closing marks, lower case."""
    x = F.regexp_replace(F.trim(name), r"^The\s+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"[.,;:]+$", ""))


def slug(name: Column, empty: str = "unknown-resort") -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(empty))


def osm_id(edge_id: Column) -> Column:
    """The map id inside an edge id: without its kind letter, cut at the last _s, else at the last _ix."""
    x = F.when(F.length(edge_id) > 1, F.regexp_replace(edge_id, "^[tl]", "")).otherwise(edge_id)
    return F.when(F.contains(x, F.lit("_s")), F.regexp_replace(x, "^(.*)_s.*$", "$1")).otherwise(F.regexp_replace(x, "^(.*)_ix.*$", "$1"))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def bare(x: Column) -> Column:
    """Letters and numbers of any script, in lower case."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def bigrams(x: Column) -> Column:
    """The set of pairs of neighbouring letters of a bare name."""
    return F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of letter pairs of bare names; those too short for a pair match only if equal."""
    p, q = bare(a), bare(b)
    x, y = bigrams(p), bigrams(q)
    shared = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (p == q).cast("double")).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def conditions_key(temp: Column, wind: Column, snow: Column, visibility: Column | None = None, cloud: Column | None = None, moguls: Column | None = None, ungroomed: Column | None = None, gladed: Column | None = None) -> Column:
    """Conditions as sorted `key=value` pairs, missing ones left out; snow rounds up, the others down; flags are always there."""
    part = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("long").cast("string")))
    parts = [part("snow", F.ceil(snow / 5) * 5), part("tempC", F.floor(temp / 5) * 5), part("wind", F.floor(wind / 10) * 10)]
    if visibility is not None:
        parts.append(part("vis", F.floor(F.least(visibility, F.lit(15.0)) / 3) * 3))
    if cloud is not None:
        parts.append(part("cloud", (cloud / 25).cast("int") * 25))
    for k, flag in (("moguls", moguls), ("ungroomed", ungroomed), ("gladed", gladed)):
        if flag is not None:
            parts.append(F.concat(F.lit(f"{k}="), flag.cast("int").cast("string")))
    return F.array_join(F.array_sort(F.array_compact(F.array(*parts))), "|")


def trail_key(name: Column) -> Column:
    """A trail's key: letters without marks, lower case, anything else one space. Marks go by Spark's own collation tables."""
    plain = F.translate(F.lower(name), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " "))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def phone_candidates(raw: Column, region: Column) -> Column:
    """The digit strings, sorted, by which a phone number as typed may be stored; none below seven digits.

    After + or 00 the digits as they are and without the longest dial code that begins them; else the
    digits, and with or without the region's dial code.
    """
    number = digits(raw)
    international = F.startswith(F.trim(raw), F.lit("+")) | F.startswith(F.trim(raw), F.lit("00"))
    codes = F.array(*(F.lit(c) for c in sorted(set(DIAL_CODES.values()), key=lambda c: (-len(c), c))))
    known = F.when(F.size(F.filter(codes, lambda c: F.startswith(number, c))) > 0, F.try_element_at(F.filter(codes, lambda c: F.startswith(number, c)), F.lit(1)))
    national = F.substring(number, F.length(known) + 1, F.length(number))
    own = F.create_map(*(F.lit(x) for kv in DIAL_CODES.items() for x in kv))[F.upper(region)]
    has_own = F.startswith(number, own) & (F.length(number) > F.length(own) + 6)
    other = F.when(has_own, F.substring(number, F.length(own) + 1, F.length(number))).when(own.isNotNull(), F.concat(own, number))
    found = F.when(international, F.array(number, F.when(F.length(national) >= 7, national))).otherwise(F.array(number, other))
    return F.when(F.length(number) >= 7, F.array_sort(F.array_distinct(F.array_compact(found)))).otherwise(F.array().cast("array<string>"))


def dedup_hash(source: Column, at: Column, resort: Column, edge: Column, duration_s: Column | None = None) -> Column:
    """A run's key: quarter minute, resort and edge; an unmatched run has its duration in tens of seconds instead."""
    quarter = F.floor(F.unix_seconds(at) / 15).cast("string")
    rest = F.lit("unmatched") if duration_s is None else F.concat(F.lit("unmatched|d"), F.round(duration_s / 10).cast("long").cast("string"))
    return F.concat_ws("|", source, quarter, resort, F.coalesce(edge, rest))


def bare_label(name: Column, difficulty: Column) -> Column:
    """A name without a leading word that repeats its difficulty."""
    return F.when(F.startswith(F.lower(name), F.concat(F.lower(difficulty), F.lit(" "))), F.trim(F.substring(name, F.length(difficulty) + 1, F.length(name)))).otherwise(name)


def initials(name: Column) -> Column:
    """The first letters of the first two words, in upper case; a question mark for none."""
    words = F.slice(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""), 1, 2)
    return F.coalesce(F.nullif(F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")), F.lit("")), F.lit("?"))


def run_title(name: Column, at: Column) -> Column:
    """A run's name, else the time of day it began."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Run · "), F.date_format(at, "h:mm a")))


def iso_time(x: Column) -> Column:
    """An ISO-8601 instant with or without a fraction; null for anything else."""
    fine = F.regexp_like(x, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$"))
    return F.when(fine, F.try_to_timestamp(F.replace(x, F.lit("T"), F.lit(" "))))
