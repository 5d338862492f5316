"""DuckDB SQL for the training-data queries that SQL can express."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
base AS (
  SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w
  FROM d),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (
  SELECT b.*, coalesce(p.n, 0) AS n_repeat_words, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines
  FROM base b LEFT JOIN repeats p USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS word_length FROM m),
v AS (
  SELECT coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, measure, value FROM f,
  LATERAL (SELECT unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure, unnest([symbols, dup_lines, repeats, word_length]) AS value) WHERE NOT base_failed),
sk AS (SELECT lang, source, measure, value - value % CAST(2 ** greatest(0, length(bin(value)) - 7) AS BIGINT) AS bucket, count(*) AS n FROM v GROUP BY ALL),
lev AS (
  SELECT 1 AS level, lang, source, measure, bucket, n FROM sk
  UNION ALL SELECT 2, lang, NULL, measure, bucket, sum(n) FROM sk GROUP BY lang, measure, bucket
  UNION ALL SELECT 3, NULL, NULL, measure, bucket, sum(n) FROM sk GROUP BY measure, bucket),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY level, lang, source, measure) AS docs FROM lev),
q AS (
  SELECT level, lang, source, measure, max(docs) AS docs, min(bucket) FILTER (100 * seen >= 10 * docs) AS q10,
         min(bucket) FILTER (100 * seen >= 50 * docs) AS q50, min(bucket) FILTER (100 * seen >= 90 * docs) AS q90 FROM cum GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('symbols', 20), ('dup_lines', 80), ('repeats', 10), ('word_length', 100)) t(measure, spread)),
fe AS (SELECT level, lang, source, measure, docs, q50 - 6 * greatest(q50 - q10, spread) AS lo, q50 + 6 * greatest(q90 - q50, spread) AS hi FROM q JOIN s USING (measure)),
lim AS (
  SELECT a.lang, a.source, a.measure,
         CASE WHEN a.docs >= 50 THEN a.lo WHEN b.docs >= 50 THEN b.lo ELSE c.lo END AS lo,
         CASE WHEN a.docs >= 50 THEN a.hi WHEN b.docs >= 50 THEN b.hi ELSE c.hi END AS hi
  FROM fe a JOIN fe b ON b.level = 2 AND a.lang = b.lang AND a.measure = b.measure JOIN fe c ON c.level = 3 AND a.measure = c.measure WHERE a.level = 1),
bad AS (
  SELECT DISTINCT r FROM f JOIN lim ON coalesce(f.lang, chr(0)) = lim.lang AND coalesce(f.source, chr(0)) = lim.source
  WHERE CASE measure WHEN 'symbols' THEN symbols > hi WHEN 'dup_lines' THEN dup_lines > hi WHEN 'repeats' THEN repeats > hi ELSE word_length > hi OR word_length < lo END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f
"""


def mixed_run() -> str:
    """secret_scan.MIXED_RUN for an engine without look-around, which needs no care for its time.

    The classes seen so far decide what may follow, so that a run is read in one way only.
    """
    kinds = {"A-Z", "a-z", "0-9"}

    def rest(seen: frozenset[str]) -> str:
        if seen == kinds:
            return "[A-Za-z0-9+/]*"
        return f"[{''.join(sorted(seen))}+/]*(?:{'|'.join(f'[{k}]' + rest(seen | {k}) for k in sorted(kinds - seen))})"

    return f"({rest(frozenset())})={{0,2}}"


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT r, {rank} AS rank, '{kind}' AS kind, start_at AS s, start_at + length(m) AS e FROM (
    SELECT r, m, v, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
    FROM (SELECT r, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS k,
                 unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS v,
                 unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS gap
          FROM d WHERE regexp_matches(text, '{p}'))
    WINDOW w AS (PARTITION BY r ORDER BY k)) WHERE length(v) >= {least}"""


def secret_scan() -> str:
    from .secret_scan import CLASSES, COMPLEMENTS, SCOPE, STRONG, WEAK

    every = STRONG | WEAK | {"weak_secret": (mixed_run(), *WEAK["weak_secret"][1:])}
    made = "\n  UNION ALL".join(_spans(k, i, *v) for i, (k, v) in enumerate(every.items()))
    classes = ", ".join(f"('{k}', '{v}')" for k, v in CLASSES.items())
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in COMPLEMENTS)
    text = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS ({made}),
c AS (SELECT p.*, t.class FROM p JOIN (VALUES {classes}) t(kind, class) USING (kind)),
l AS (SELECT DISTINCT a.r, a.rank, a.kind, a.s, a.e FROM c a JOIN (VALUES {pairs}) z(x, y) ON a.class = z.x
      JOIN c b ON a.r = b.r AND b.class = z.y AND abs(a.s - b.s) <= {SCOPE} WHERE a.rank >= {len(STRONG)}),
o AS (SELECT r, rank, kind, s, e FROM p WHERE rank < {len(STRONG)} UNION ALL SELECT * FROM l),
g AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             {text} FILTER (rank < {len(STRONG)}) AS base, {text} AS spans, count(*) FILTER (rank >= {len(STRONG)}) AS n_linked FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (r)
"""


NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
walk AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT walk.doc_id, l.y FROM walk JOIN l ON walk.reach = l.x),
c AS (SELECT doc_id, min(reach) AS component_id FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

NORM_BUCKETS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
