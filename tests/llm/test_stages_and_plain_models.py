"""Stages on odd tables, and plain versions of the votes, the subwords and the training."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyweir.llm import langid, simhash, tokens
from tallyweir.llm.queries import TOKENIZER

EXTRA = {"a.b": "x", "__tw_rid": "y", "shard": "z", "th": "w", "ti`ck": "v"}


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Documents with nulls in every column, rows that repeat and columns of clashing, dotted and ticked names and of a map."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    text = docs.filter("length(text) > 300").first()["text"]
    more = spark.createDataFrame([(None, text, None, None, None), (None, text, None, None, None), (7001, None, "en", None, 0), (7002, "", None, "s", None), (7003, text, "en", "s", 1), (7003, text, "en", "s", 1)], docs.schema)
    both = docs.unionByName(more).repartition(3)
    marked = both.select(*docs.columns, *[F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(k) for k, v in EXTRA.items()], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    return marked


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_odd_columns(spark, sf_dir, odd, name):
    """Every stage but the last keeps the columns and their values with their rows; the last has a row a document. An empty table stays empty."""
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, sf_dir)
    if name == "tokens":
        assert out.count() == odd.count()
    else:
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        got = out.collect()
        assert got and all(r[k] == v + ("-" if r["doc_id"] is None else str(r["doc_id"])) for r in got for k, v in EXTRA.items()) and all(r["m"]["k"] == r["doc_id"] for r in got)
    if name == "near_duplicates":
        texts = [r["text"] for r in got if r["text"]]
        assert len(texts) == len(set(texts))
    nothing = stage(spark, odd.limit(0), sf_dir)
    assert nothing.count() == 0 and (name == "tokens" or nothing.columns == odd.columns)


def plain_fingerprint(text):
    words = text.split()
    n = max(len(words) - 4, min(len(words), 1))
    votes = [0] * 64
    for i in range(n):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    return sum(1 << k for k in range(64) if votes[k] > 0)


def test_votes_equal_a_plain_count(spark):
    rng = random.Random(5)
    texts = ["", "one", "one two three", "a a a a a a a a", *[" ".join(rng.choices(["Wald", "über", "the", "of", "x1", "rain"], k=rng.randrange(1, 400))) for _ in range(40)]]
    got = {r.k: r.fp for r in simhash.votes(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).collect()}
    assert [got[k] % 2**64 for k in range(len(texts))] == [plain_fingerprint(t) for t in texts]


def plain_subwords(text):
    out, low = [], text.lower()
    if not any(c.isalpha() for c in low):
        return []
    s = " " + "".join(c if c.isalpha() else " " for c in low) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    c, m = [ord(x) for x in s], 2**32
    pair = [(a * 0x9E3779B1 + b * 0x85EBCA6B) % m for a, b in zip(c, c[1:], strict=False)]
    triple = [(p * 0xC2B2AE35 + d * 0x27D4EB2F) % m for p, d in zip(pair, c[2:], strict=False)]
    for x in pair + triple:
        x ^= x >> 15
        out.append((x * 0x2C1B3C6D) % m >> 16)
    return out


def test_subwords_equal_a_plain_version():
    for t in ("Hello, World", "  a--b  ", "Straße 12 & ÜBER", "日本 語", "123 #", "", "İstanbul"):
        assert langid.subwords(t).tolist() == plain_subwords(t)


def test_training_equals_plain_loops():
    rng = np.random.default_rng(1)
    rows = [(lang, np.arange(k, k + 4, dtype=np.int32), np.array([0.4, 0.3, 0.2, 0.1])) for i in range(12) for lang, k in (("de", 10 * (i % 3)), ("en", 10 * (i % 3) + 5))]
    model = langid.train(rows, dims=3, epochs=2)
    rng = np.random.default_rng(11)
    table, weights = rng.normal(0, 1 / 3, (langid.BUCKETS, 3)), [[0.0, 0.0] for _ in range(3)]
    own = [r for i, r in enumerate(rows) if i % 5]
    done = 0
    for _ in range(2):
        for i in rng.permutation(len(own)):
            lang, at, share = own[i]
            x = [sum(s * table[a][d] for a, s in zip(at, share, strict=True)) for d in range(3)]
            z = [sum(x[d] * weights[d][k] for d in range(3)) for k in range(2)]
            e = [np.exp(v - max(z)) for v in z]
            error = [v / sum(e) - (k == ["de", "en"].index(lang)) for k, v in enumerate(e)]
            step = 0.5 * (1 - done / (2 * len(own)))
            back = [sum(weights[d][k] * error[k] for k in range(2)) for d in range(3)]
            for d in range(3):
                for k in range(2):
                    weights[d][k] -= step * x[d] * error[k]
            for a, s in zip(at, share, strict=True):
                for d in range(3):
                    table[a][d] -= step * min(50.0, 1 / sum(v * v for v in share)) * s * back[d]
            done += 1
    assert np.abs(model.logits[:40] - (table[:40] @ np.array(weights))).max() < 1e-5 and model.languages == ["de", "en"]


def test_workers_keep_no_encoder_after_the_token_files(spark):
    docs = spark.createDataFrame([(k, f"word{k} and other words") for k in range(40)], "doc_id long, text string")
    assert tokens.tokens_round_trip(docs, TOKENIZER).count() == 40

    def held(batches):
        from tallyweir.llm import tokens as own

        for pdf in batches:
            yield pdf.assign(id=len(own._workers))

    assert {r["id"] for r in spark.range(64, numPartitions=16).mapInPandas(held, "id long").collect()} == {0}
