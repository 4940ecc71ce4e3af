"""The chosen-path join on several hundred pairs just above the threshold, with a passage that all texts share."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyweir.llm import chosenpath


@pytest.mark.parametrize("limit", [16, 512])
def test_recall_of_pairs_at_the_threshold(spark, limit):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    passage, rows = words(12), []
    for k in range(300):
        own = words(100) + passage
        more = rng.randint(24, 26)  # 108 shingles of 132 to 134
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own + words(more)))]
    got = chosenpath.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    links = {r.doc_id: r.n_links for r in got}
    assert set(links.values()) <= {0, 1}
    found = sum(links[2 * k] and links[2 * k + 1] for k in range(300))
    assert found >= 297  # the target is 0.9999


def test_maps_bound_the_difference():
    rng = random.Random(6)
    a = chosenpath.shingles(" ".join(rng.choices("abcdef", k=400)).encode())
    b = chosenpath.shingles(" ".join(rng.choices("abcdef", k=300)).encode())
    apart = sum(bin(x ^ y).count("1") for x, y in zip(chosenpath.parity_map(a), chosenpath.parity_map(b), strict=True))
    assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_batches_are_cut_by_bytes():
    texts = [b"", b"a" * 10, b"b" * 25, b"", b"c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    for size in (1, 8, 1000):
        pieces = [x.column("text").to_pylist() for x in chosenpath.slices(batch, size)]
        assert [t for x in pieces for t in x] == texts
        assert all(sum(map(len, x[1:])) <= size for x in pieces)
    assert sum(x.num_rows for x in chosenpath.slices(batch.slice(0, 0))) == 0


def test_overlaps_in_parts(monkeypatch):
    rng = random.Random(7)
    sets = [np.unique(np.array(rng.choices(range(60), k=k), np.uint64)) for k in (40, 1, 25, 60)]
    plain = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for postings in (1, 7, 1 << 20):
        monkeypatch.setattr(chosenpath, "POSTINGS", postings)
        assert [x.tolist() for x in chosenpath._overlaps(sets)] == plain


def test_only_some_texts_of_a_dense_bucket_sample_on(spark, monkeypatch):
    rng, made = random.Random(8), []
    words = lambda n: ["".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]
    common, write = words(120), chosenpath.materialize
    rows = [(k, " ".join(common + words(2))) for k in range(400)]  # 116 of 120 shingles are common

    def counted(df, name):
        out = write(df, name)
        if "parent_size" in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(chosenpath, "materialize", counted)
    monkeypatch.setattr(chosenpath, "PROBE", 40, raising=False)
    got = chosenpath.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), limit=32).collect()
    assert {r.n_links for r in got} == {399} and len({r.root for r in got}) == 1
    assert 0 < sum(made) < 6000  # 400 texts in 12 buckets make 18,000
