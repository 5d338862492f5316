"""Whole queries and pipeline stages against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fallline.llm import best_fit, log_frequency, norm_buckets, quality_rules, secret_scan, site_quality, token_counts, toxicity
from fallline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def plain_measures(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    n, k = len(w), len(lines)
    out = {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": k - len(set(lines)), "n_repeat_words": len(repeated)}
    out["base_failed"] = n < 50 or 100 * len(repeated) > 50 * n
    shares = {"symbols": (out["n_symbols"], n), "dup_lines": (out["n_dup_lines"], k), "repeats": (len(repeated), n), "word_length": (out["word_chars"], n)}
    return out, {m: 1000 * x // max(y, 1) for m, (x, y) in shares.items()}


def plain_rules(rows):
    """doc_id -> measures and kept of (doc_id, text, lang, source), by sorting whole groups."""
    got = [(i, lang, source, *plain_measures(text)) for i, text, lang, source in rows]

    def limits(group):
        out = {}
        for m, spread in quality_rules.SPREAD.items():
            v = sorted(x[4][m] - x[4][m] % (1 << max(0, x[4][m].bit_length() - 7)) for x in group)
            q = lambda p, v=v: v[-(-p * len(v) // 100) - 1]
            out[m] = (q(50) - quality_rules.FENCE * max(q(50) - q(10), spread), q(50) + quality_rules.FENCE * max(q(90) - q(50), spread))
        return out

    fine = [x for x in got if not x[3]["base_failed"]]
    groups = defaultdict(list)
    for x in fine:
        for key in ((x[1], x[2]), (x[1],), ()):
            groups[key].append(x)
    out = {}
    for i, lang, source, base, measures in got:
        kept = not base["base_failed"]
        if kept:
            key = next(k for k in ((lang, source), (lang,), ()) if len(groups[k]) >= quality_rules.LEAST_DOCS or not k)
            lim = limits(groups[key])
            kept = all(measures[m] <= lim[m][1] for m in measures) and measures["word_length"] >= lim["word_length"][0]
        out[i] = (base, kept)
    return out


def plain_sites(rows):
    """doc_id -> probability of (doc_id, evidence, lang, source), by sums over whole groups."""
    p = {i: 1 / (1 + math.exp(-e)) for i, e, _, _ in rows}
    paths, hosts = defaultdict(list), defaultdict(list)
    for i, _, lang, source in rows:
        paths[source, lang].append(p[i])
        hosts[source].append(p[i])
    every = list(p.values())
    n, mu = len(every), float(np.mean(every))
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in paths.values()) / max(1, n - len(paths))
    share = sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    path_var = sum(len(v) * (np.mean(v) - np.mean(hosts[h])) ** 2 for (h, _), v in paths.items()) - (len(paths) - len(hosts)) * within
    path_var = path_var / (n - share) if n > share else 0.0
    chance = (len(hosts) - 1) * within + (share - sum(len(v) ** 2 for v in paths.values()) / n) * max(path_var, 0.0)
    room = n - sum(len(v) ** 2 for v in hosts.values()) / n
    host_var = (sum(len(v) * (np.mean(v) - mu) ** 2 for v in hosts.values()) - chance) / room if room > 0 else 0.0
    weight = lambda between: min(max(within / between, site_quality.MIN_WEIGHT), site_quality.MAX_WEIGHT) if between > 0 else site_quality.MAX_WEIGHT
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    hk, pk = weight(host_var), weight(path_var)
    out = {}
    for i, e, lang, source in rows:
        h, v = hosts[source], paths[source, lang]
        host = (sum(h) + hk * mu) / (len(h) + hk)
        out[i] = 1 / (1 + math.exp(-(e + logit((sum(v) + pk * host) / (len(v) + pk)) - logit(mu))))
    return out, (hk, pk)


def test_token_counts_of_every_document(spark):
    """Counts are the library's, and most tokens are settled by splices."""
    sf = SF.replace("0.001", "0.01")
    sp = token_counts.model(P.path("piece_bpe_32k.model"))
    c = token_counts.Chunked(sp)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = 0
    for r in QUERIES["op1_token_counts"](spark, sf).collect():
        want = len(sp.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want, want > 4096)
        total += want
        if r.n_bytes > token_counts.CHUNK_BYTES:
            assert c.count(texts[r.doc_id]) == want
    assert c.spliced > total / 2


def test_token_counts_of_very_long_texts(spark):
    texts = ["x" * 300_000, "word " * 60_000, "漢字かな" * 20_000, "\n" * 100_000, "a▁b " * 20_000, "ab" * 5 + " " * 70_000]
    sp = token_counts.model(P.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_site_quality_against_plain_python(spark):
    """Posteriors, shrinkage and verdicts from evidence, on sites of one document and of many."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    where = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    got = site_quality.classify(docs, labels).collect()
    want, _ = plain_sites([(r.doc_id, r.evidence, *where[r.doc_id]) for r in got])
    assert all(math.isclose(r.probability, want[r.doc_id], rel_tol=1e-6, abs_tol=1e-9) and r.kept == (want[r.doc_id] >= 0.5) for r in got)


def test_sparse_sites_are_shrunk(spark):
    """Sites that differ by chance alone are shrunk to nothing; sites that do differ keep their means, sparse ones less so."""
    rnd = random.Random(3)
    alike = [(k, rnd.gauss(0, 1.5), "en", f"s{k // 3}" if k < 300 else "big") for k in range(3000)]
    apart = [(k, rnd.gauss(3 * (-1) ** (k % 20), 1), "en" if k % 3 else "de", f"s{k % 20}") for k in range(2000)] + [(2000, -5.0, "en", "s0x")]
    for rows in (alike, apart):
        df = spark.createDataFrame(rows, "doc_id long, evidence double, lang string, source string")
        got = {r.doc_id: r.probability for r in site_quality.with_verdict(df, site_quality.site_priors(df), 0.5).collect()}
        want, (hk, _) = plain_sites(rows)
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
        assert hk > 100 if rows is alike else hk < 10


def test_rules_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").unionByName(spark.createDataFrame([(10**7 + k, t, None, None, 0) for k, t in enumerate([None, "", " ", "a b c " * 20, "a b c d " * 200 + "x\nx\nx"])], "doc_id long, text string, lang string, source string, n_chars int").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars")), allowMissingColumns=True)
    want = plain_rules([(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    for r in quality_rules.quality_rules(docs).collect():
        base, kept = want[r.doc_id]
        assert {k: r[k] for k in base} == base
        assert r.kept == kept


def test_thresholds_follow_their_group(spark):
    """Two sources with different texts get different limits; a small one takes its language's; what is usual in one is rejected in the other."""
    rnd = random.Random(4)
    text = lambda size, symbols: " ".join("".join(rnd.choice("abcdefgh") for _ in range(max(1, int(rnd.gauss(size, 1))))) + ("#" if rnd.random() < symbols else "") for _ in range(80))
    rows = [(k, text(4, 0.0), "en", "prose") for k in range(200)] + [(k + 200, text(9, 0.6), "en", "tables") for k in range(200)]
    rows += [(1000, text(9, 0.6), "en", "prose"), (1001, text(9, 0.6), "en", "tables"), (1002, text(4, 0.0), "en", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    limits = {r.source: r for r in quality_rules.thresholds(quality_rules.measured(docs)).collect()}
    assert limits["tables"].high["symbols"] > 3 * limits["prose"].high["symbols"]
    assert limits["tables"].low["word_length"] != limits["prose"].low["word_length"]
    assert limits["few"].high == limits["few"].high and limits["few"].high["symbols"] > limits["prose"].high["symbols"]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert not kept[1000] and kept[1001] and kept[1002]
    assert sum(kept[k] for k in range(400)) > 390


def test_secrets_in_one_long_run(spark):
    """Time is linear in the length of a run that holds no secret."""
    docs = spark.createDataFrame([(0, "z" * 1_000_000), (1, "jdbc:" + "q" * 500_000), (2, "password" * 60_000), (3, "aB1" + "x" * 900_000 + " user: bob"), (4, "key = " * 50_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(docs).collect()}
    assert time.time() - began < 60
    assert got[0] == got[1] == got[2] == got[4] == ""
    assert got[3] == ""  # the account stands too far from where the run begins


@pytest.mark.parametrize("first", [7, 64, 10_000])
def test_top_k_in_buckets(spark, first):
    """Many buckets, ties, copies of one vector, two dimensions, negative products and numbers too large for two bytes."""
    rnd = np.random.default_rng(first)
    rows = [(k, (rnd.normal(size=8) * rnd.choice([0.01, 1, 30])).round(2).tolist()) for k in range(1500)]
    rows += [(2000 + k, [5.0] * 8) for k in range(300)] + [(3000 + k, [float(k), 900.0]) for k in range(90)] + [(4000, [-100.0] * 8), (4020, [0.0] * 8), (4040, [700.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.floor(64 * np.array(v)) for i, v in rows}
    want = {}
    for q in (i for i in whole if i % 20 == 0):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:20])}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in norm_buckets.top_k(df, first=first, growth=3).collect()}
    assert got == want


def test_composition_is_the_cascade():
    """The composed transducer does what its parts do one after the other."""
    rnd = random.Random(6)
    parts = [toxicity.negation(), toxicity.reporting(), toxicity.pairing()]
    whole = toxicity.grammar()
    for _ in range(3000):
        symbols = [rnd.choice(toxicity.SYMBOLS) for _ in range(rnd.randint(0, 12))]
        weight, out = 0.0, symbols
        for t in parts:
            out, w = t.run(out)
            weight += w
        for got, total in (whole.run(symbols), toxicity.run_compiled(map(toxicity.SYMBOLS.index, symbols))):
            assert got == tuple(out) and math.isclose(total, weight)


def plain_clause(symbols):
    """Kinds and weight of one clause, by looking back from each word."""
    best, threat, aside = 0.0, False, set()
    for k, s in enumerate(symbols):
        if not toxicity.attack(s):
            continue
        if "neg" in symbols[max(0, k - toxicity.NEAR) : k]:
            aside.add("denied")
        elif "say" in symbols[:k] or symbols[:k].count("quote") % 2:
            aside.add("reported")
        elif s == "threat":
            threat = True
        else:
            best = max(best, toxicity.GRADES[s])
    target = "target" in symbols
    kinds = ([("insult_target" if target else "insult")] if best else []) + (["threat_target"] if threat and target else []) + sorted(aside)
    return kinds, best + threat * toxicity.THREAT_WEIGHT + len(aside) * toxicity.ASIDE_WEIGHT


def test_toxicity_against_plain_python(spark):
    """Scores of the query from symbols read clause by clause without transducers, the fitted model being given."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(docs, labels)
    lexicon = toxicity.Lexicon(dict(model.stems))
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    for r in docs.collect():
        sums = dict.fromkeys(toxicity.KINDS, 0.0)
        for clause in toxicity.CLAUSE.split((r.text or "").lower()):
            kinds, weight = plain_clause([lexicon.symbol(w) for w in toxicity.WORD.findall(clause)])
            for k in kinds:
                sums[k] += weight
        v = np.array(list(sums.values()))
        z = np.array([1.0, *np.log1p(v), *(v > 0)]) @ model.weights
        g = got[r.doc_id]
        assert math.isclose(g.score, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)
        assert (g.held_out, g.predicted) == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2, int(g.score >= 0.3))


def test_toxicity_beats_a_constant(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = [r for r in QUERIES["op9_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) < 0.05


def check_packing(rows, texts):
    """Pieces hold each document's ids, in order and whole; sequences are gapless and no fuller than 2048."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for doc_id, own in pieces.items():
        ids = np.array([*t.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and (len(own) > 1) == (len(ids) > 2048)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        assert sum(n for _, n in own) <= 2048
    return len(sequences), -(-sum(r.length for r in rows) // 2048)


def test_best_fit_query(spark):
    sf = SF.replace("0.001", "0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used, least = check_packing(QUERIES["op10_best_fit"](spark, sf).collect(), texts)
    assert used <= 1.03 * least


def test_packing_ties(spark):
    """Texts of one length and a null doc_id."""
    rows = [(k, "a" * 10) for k in range(300)] + [(None, "a" * 10), (None, None)]
    got = best_fit.pack(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    check_packing([r for r in got if r.doc_id is not None and False], {})
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got)


def test_values_of_empty_texts(spark):
    """What each query says of null and empty texts, clashing columns being there."""
    rows = [(1, None), (2, ""), (3, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit("x").alias("score"), F.lit("x").alias("n"))
    empty = hashlib.sha256(b"").hexdigest()
    for r in secret_scan.secret_scan(docs).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (0, 0, 0, empty, "")
    for r in quality_rules.quality_rules(docs).collect():
        assert (r.n_words, r.n_symbols, r.base_failed, r.kept) == (0, 0, True, False)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()}
    assert got[1] == got[2] == 0
    assert all(r.length == 1 for r in best_fit.pack(docs.where("doc_id < 3"), P.path("byte_bpe_50k.json")).collect())


def test_language_model_of_a_very_long_text(spark, tmp_path):
    spark.createDataFrame([(1, "one two three " * 100_000), (3, None), (4, "two")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in log_frequency.score(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert (got[1].n_tokens, got[3].n_tokens, got[4].n_tokens) == (300_001, 1, 2)
    assert all(math.isfinite(r.score) for r in got.values())


def test_pipeline_against_plain_python(spark):
    """Each stage's decisions against plain Python over what it was given, and run() as a whole."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    rules, classifier, near, secrets, packing = (f for _, f in pipeline.STAGES)

    kept = rules(spark, docs, sf).cache()
    verdicts = plain_rules([(r.doc_id, r.text, r.lang, r.source) for r in rows.values()])
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, ok) in verdicts.items() if ok)

    weights = site_quality.trained(kept, labels)
    good = classifier(spark, kept, sf).cache()
    evidence = {r.doc_id: float(np.clip(site_quality.measures((r.text or "").encode()) @ weights, -30, 30)) for r in kept.collect()}
    probability, _ = plain_sites([(i, e, rows[i].lang, rows[i].source) for i, e in evidence.items()])
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in probability.items() if p >= 0.5)

    one = near(spark, good, sf).cache()
    sets = {r.doc_id: frozenset(zip(*[words(r.text.lower())[k:] for k in range(5)], strict=False)) or frozenset([tuple(words(r.text.lower()))]) for r in good.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, shared in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * shared >= 80 * (len(s) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i in sets if root(i) == i)

    clean = secrets(spark, one, sf).cache()
    spans = {r.doc_id: r.spans for r in secret_scan.secret_scan(one).collect()}
    for r in clean.collect():
        text, out, at = rows[r.doc_id].text, "", 0
        for kind, a, b in (x.split(":") for x in spans[r.doc_id].split(",") if x):
            if int(a) >= at:
                out += text[at : int(a)] + f"<{kind}>"
            at = max(at, int(b))
        assert r.text == out + text[at:]
    texts = {r.doc_id: r.text for r in clean.collect()}
    used, least = check_packing(packing(spark, clean, sf).collect(), texts)
    assert used <= 1.05 * least
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, sf).collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packing(spark, clean, sf).collect()}
