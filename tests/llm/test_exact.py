"""Operators that SQL cannot express against brute force, and those it can against DuckDB."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from compare import same

from fallline.llm import best_fit, bottom_k, log_frequency, norm_buckets, token_counts, secret_scan, toxicity, word_table
from fallline.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


def odd_texts(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    parts = ["a", "b c", " ", "\n", "'s", "<|endoftext|>", "É", "漢", "1", "!", " ", "\x85", "\x1c", "\xa0", "it's ", "́", "Σ", "<s>", "▁", "the "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_token_counts_by_chunks():
    sp = token_counts.model(P.path("piece_bpe_32k.model"))
    rnd, widened = random.Random(1), 0
    for k, text in enumerate(odd_texts(200, 1)):
        text = [text * 20, text[:1] * 900, "".join(rnd.choice("abcdeß漢字é") for _ in range(900))][k % 3]
        c = token_counts.Chunked(sp, rnd.choice([50, 200, 1000]), rnd.choice([4, 16, 64]))
        assert c.count(text) == len(sp.encode(text))
        widened += c.widened
    assert widened


def test_word_table(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    spark.createDataFrame(list(enumerate(odd_texts(300, 2))), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    t = word_table.tokenizer(path)
    digests = {r.doc_id: r for r in word_table.encode_decode_digests(docs, path).collect()}
    for r in word_table.encode_decode(docs, path).collect():
        text = next(x.text for x in [docs.where(f"doc_id = {r.doc_id}").first()]) if r.doc_id < 5 else None
        if text is not None:
            ids = t.encode(text, add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert digests[r.doc_id].decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    for doc_id, text in enumerate(odd_texts(300, 2)):
        ids = t.encode(text, add_special_tokens=False).ids
        assert digests[doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoder_and_packer():
    e = best_fit.ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, cached=50)
    assert all(e.ids(x) == e.whole(x) for x in odd_texts(1000, 3))
    rnd, most = random.Random(4), 64
    sizes = [rnd.randint(1, 64) for _ in range(2000)]
    p, fill = best_fit.Packer(most, 32), Counter()
    for n in sizes:
        b, at = p.place(n)
        assert at == fill[b]
        fill[b] += n
        assert fill[b] <= most
    assert p.made <= 1.08 * math.ceil(sum(sizes) / most)


def test_near_copies_lose_no_link(spark):
    """A large group of near copies, with many pairs about the threshold, and a passage that many share."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        w = base[:]
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = word()
        texts.append(w)
    texts += [passage + [word() for _ in range(rnd.randint(5, 60))] for _ in range(60)] + [base, base, ["x"], ["x"], []]
    rows = [(i, " ".join(w).upper()) for i, w in enumerate(texts)]
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for w in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            same_ = len(sets[i] & sets[j])
            if sets[i] and 100 * same_ >= 80 * (len(sets[i]) + len(sets[j]) - same_):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in bottom_k.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_language_model(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(r.doc_id, [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low)), None]) for r in docs.collect()]
    c = Counter(w for i, x in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    want = {i: (len(x), sum(c[w] > 0 for w in x), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for i, x in texts}
    got = log_frequency.score(docs).collect()
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert math.isclose(r.base_score, want[r.doc_id][2], rel_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def exact_scores(texts: list[tuple[int, bytes]]) -> dict[int, float]:
    """The model's scores with exact counts in dictionaries in place of the filter, token by token."""
    m = log_frequency
    least = lambda n: next((x for x in reversed(m.LEAST.tolist()) if x <= n), 0.0)
    most = lambda n: next(y for x, y in zip(reversed(m.LEAST.tolist()), reversed(m.MOST.tolist()), strict=True) if x <= n)
    tokens = {i: [None, *t.lower().split(), None] for i, t in texts}
    counts = [Counter(), Counter(), Counter()]
    for i, t in tokens.items():
        if not m.held_out(i):
            counts[0].update(t[1:])
            for k in (2, 3):
                counts[k - 1].update(tuple(t[j : j + k]) for j in range(len(t) - k + 1))
    one, two, three = counts
    floor, out = sum(one.values()) + len(one) + 1, {}
    for i, t in tokens.items():
        z = 0.0
        for k in range(1, len(t)):
            p = (1 - m.SHARE) * (one[t[k]] + 1) / floor + m.SHARE * min(1.0, max(0.0, least(two[t[k - 1], t[k]]) - m.DISCOUNT) / max(one[t[k - 1]], 1))
            if k > 1:
                seen = two[t[k - 2], t[k - 1]]
                p = (1 - m.HIGH) * p + m.HIGH * (min(1.0, max(0.0, least(three[t[k - 2], t[k - 1], t[k]]) - m.DISCOUNT) / most(seen)) if seen else 0.0)
            z += math.log10(p)
        out[i] = z
    return out


def test_language_model_against_exact_counts(spark):
    """Scores are those of exact levels where the filter is roomy, and off by the few n-grams it wrongly finds where it grew."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = exact_scores([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    roomy, grown = ({r.doc_id: r.score for r in log_frequency.score(docs, bits=bits).collect()} for bits in (log_frequency.FILTER_BITS, 1 << 10))
    assert roomy.keys() == grown.keys() == want.keys()
    assert sum(math.isclose(roomy[i], want[i], rel_tol=1e-9) for i in want) >= 0.97 * len(want)
    assert math.isclose(sum(roomy.values()), sum(want.values()), rel_tol=1e-4)
    assert abs(sum(grown.values()) / sum(want.values()) - 1) < 0.01


def test_language_model_tells_texts_seen_twice(spark, tmp_path):
    """Of texts of like words, those that occur twice score higher than all that occur once."""
    rnd = random.Random(12)
    text = lambda: " ".join(f"w{rnd.randint(0, 30)}" for _ in range(80))
    texts = [text() for _ in range(200)]
    rows = list(enumerate(texts + texts[:20]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in log_frequency.score(spark.read.parquet(str(tmp_path / "d"))).collect()}
    twice = [got[i].score for i in range(20) if not got[i].held_out and not got[200 + i].held_out]
    assert len(twice) > 9 and min(twice) > max(got[i].score for i in range(20, 200))


def test_slices_grow():
    """No stored level is missed, few others are found, and the filter grows with what is put into it."""
    rnd = np.random.default_rng(8)
    key = np.unique(rnd.integers(0, 1 << 48, 50_000, dtype=np.uint64))
    counts = np.where(np.arange(len(key)) % 100, rnd.geometric(0.3, len(key)), 10**6)
    f = log_frequency.LogFrequencyFilter(key, counts, 1 << 9, 48)
    found, true = f.levels(key), log_frequency.level(counts)
    assert (found >= true).all() and (found == true).mean() > 0.97
    assert (f.levels(rnd.integers(0, 1 << 48, 5000, dtype=np.uint64)) > 0).mean() < 0.03
    assert len(f.words) > 16 * len(log_frequency.LogFrequencyFilter(key[:1000], counts[:1000], 1 << 9, 48).words)


def test_weak_secrets_are_whole_runs(spark):
    """Random keys of all lengths beside an account name: reported if and only if they hold all three classes, from end to end."""
    rnd, low = random.Random(10), "abcdefghijklmnopqrstuvwxyz"
    classes = [low, low.upper(), "0123456789", "+/"]
    keys = ["".join(rnd.choice("".join(rnd.sample(classes, 3) if k % 4 == 0 else classes)) for _ in range(rnd.randint(17, 64))) + "=" * (k % 3) for k in range(400)]
    keys += ["A" * 30 + "b" * 30 + "1", "1" + "a" * 30 + "B", "/" * 18 + "aB1", "aB1" + "z" * 16]
    docs = spark.createDataFrame([(k, f"user: bob {x}, end") for k, x in enumerate(keys)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(docs).collect()}
    texts = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    for k, x in enumerate(keys):
        run = x.rstrip("=")
        if len(run) >= 20 and all(any(c in s for c in run) for s in classes[:3]):
            assert got[k] == f"weak_id:0:9,weak_secret:10:{10 + len(x)}"
            assert texts[k] == "<weak_id> <weak_secret>, end"
        else:
            assert got[k] == ""


def test_top_k_prunes_exactly():
    rnd = np.random.default_rng(7)
    c = np.floor(rnd.normal(size=(500, 16)) * rnd.uniform(1, 90, (500, 1)))
    c = c[np.argsort(-(c * c).sum(1))]
    q, ids = np.floor(rnd.normal(size=(40, 16)) * 64), np.arange(500)
    s = q @ c.T
    for beat in (np.full(40, -np.inf), np.sort(s, 1)[:, -20]):
        best = norm_buckets.Best(40, 20)
        norm_buckets.visit(best, np.full(40, -1), q, beat, np.full(40, 1 << 62), ids, c)
        for k in range(40):
            assert best.ids[k].tolist() == np.lexsort((ids, -s[k]))[:20].tolist()


def test_clauses():
    lex = toxicity.Lexicon({})
    kinds = lambda t: {k for k, x in zip(toxicity.KINDS, toxicity.clauses(t, lex)[1 : 1 + len(toxicity.KINDS)], strict=True) if x}
    assert kinds("You are an idiot.") == {"insult_target"}
    assert kinds("What an idiot. You left") == {"insult"}
    assert kinds("You are not an idiot") == {"denied"}
    assert kinds("She said idiot") == {"reported"}
    assert kinds("I will kill you") == {"threat_target"}
    assert kinds("kill the lights") == set()


def test_toxicity_holds_out(spark):
    sf = SF.replace("0.001", "0.01")
    got = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
