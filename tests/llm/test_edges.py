"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from fallline.llm import best_fit, bottom_k, log_frequency, norm_buckets, quality_rules, secret_scan, site_quality, token_counts, toxicity, word_table

LONG = "The quick fox went over the hill. " * 3000
ROWS = [(None, None, None, None), (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "ab cd", "en", "a"), (5, "password = abcdefgh12 login: bob\nYou are an idiot.", "en", "a"),
        (5, "password = abcdefgh12 login: bob\nYou are an idiot.", "en", "a"), (6, LONG, "en", "b"), (7, LONG, "en", "b"), (8, "漢字 é \U0001f600 <|endoftext|> <s>", "zh", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASHES = ["n", "h", "g", "rid", "node", "mark", "part", "block", "evidence", "host", "path", "shift", "good", "rule_base", "rule_kept", "t_lang", "strong", "weak", "links", "every", "id", "hit__", "bits__", "component", "sketch", "piece", "kept"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "d.parquet")
    df = spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(f"x{c}").alias(c) for c in CLASHES))
    df.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 0, 1), (5, 0, 1), (6, 1, 0), (4, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, lab: token_counts.count_tokens(d, P.path("piece_bpe_32k.model")),
    "op2": lambda d, lab: site_quality.classify(d, lab),
    "op3": lambda d, lab: quality_rules.quality_rules(d),
    "op4": lambda d, lab: secret_scan.secret_scan(d),
    "op5": lambda d, lab: bottom_k.near_duplicates(d),
    "op6": lambda d, lab: word_table.encode_decode_digests(d, P.path("word_bpe_49k.json")),
    "op8": lambda d, lab: log_frequency.score(d, bits=1 << 16),
    "op9": lambda d, lab: toxicity.score(d, lab),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_a_result(docs, labels, name):
    got = OPERATORS[name](docs, labels).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in ROWS)
    same = [tuple(r) for r in got if r.doc_id == 5]
    assert same[0] == same[1]  # repeated rows have equal results


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, labels, name):
    assert OPERATORS[name](docs.where("doc_id < 0"), labels.where("doc_id < 0")).count() == 0


STAGES = {
    "rules": lambda d, lab: quality_rules.keep_good(d),
    "classifier": lambda d, lab: site_quality.keep_good(d, lab),
    "duplicates": lambda d, lab: bottom_k.one_of_each(d),
    "secrets": lambda d, lab: secret_scan.redacted(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(docs, labels, name):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r["rid"] == "xrid" for r in rows)
    if name == "secrets":
        assert len(rows) == len(ROWS)
        text = next(r.text for r in rows if r.doc_id == 5)
        assert text == "<assign> <weak_id>\nYou are an idiot."
    if name == "duplicates":
        assert [r.doc_id for r in rows if r.text == LONG] == [6]
        assert len(rows) == len(ROWS) - 1
    assert STAGES[name](docs.where("doc_id < 0"), labels).count() == 0


def test_packing(docs):
    rows = best_fit.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, open_bins=2).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    long = sorted((r.start, r.length) for r in rows if r.doc_id == 6)
    assert long[0][0] == 0 and all(n == 2048 for _, n in long[1:])
    assert best_fit.pack(docs.where("doc_id < 0"), P.path("byte_bpe_50k.json")).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0, None]), (None, [1.0, 1.0]), (20, [0.25]), (40, []), (60, [-1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("score", F.lit("x"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in norm_buckets.top_k(df).collect()}
    assert got == {(0, 1): (1, 5120), (0, 2): (2, 4096), (0, 3): (2, 4096), (0, 4): (60, -4096), (60, 1): (2, -2048), (60, 2): (2, -2048), (60, 3): (0, -4096), (60, 4): (1, -4096)}
    assert norm_buckets.top_k(df.where("vec_id > 99")).count() == 0
