"""Greedy string tiling and the splitting tree against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.llm import decontam, mixing


def plain_tiles(doc, item, least):
    """Greedy string tiling word by word: the longest match of unmarked words, the earliest in the item and then in the document."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= least and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return tiles
        n, i, d = -best[0], best[1], best[2]
        tiles.append((d, i, n))
        used_d.update(range(d, d + n))
        used_i.update(range(i, i + n))


@pytest.mark.parametrize("letters", [2, 3, 6])
def test_tiles_against_the_plain_version(letters):
    rng = random.Random(letters)
    for _ in range(60):
        doc, item = ([rng.randrange(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
        seeds = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
        assert decontam.tile(seeds, 3) == plain_tiles(doc, item, 3)


def test_contamination_against_the_plain_version(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    items = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 4, 5, 9, 30, 60)]
    docs = [[rng.choice(words) for _ in range(rng.randint(0, 80))] for _ in range(25)]
    docs += [docs[3][:20] + items[8][30:] + items[8][:25] + docs[4][:10], items[7] + items[8], items[3], []]
    want = set()
    for k, doc in enumerate(docs):
        for j, item in enumerate(items):
            if len(item) < 5:
                if any(doc[d : d + len(item)] == item for d in range(len(doc) - len(item) + 1)):
                    want.add((k, j, 1.0, 1, len(item)))
                continue
            tiles = plain_tiles(doc, item, 5)
            if tiles and sum(t[2] for t in tiles) / len(item) >= 0.5:
                want.add((k, j, round(sum(t[2] for t in tiles) / len(item), 6), len(tiles), max(t[2] for t in tiles)))
    d = spark.createDataFrame([(k, " ".join(x), "e") for k, x in enumerate(docs)], "doc_id long, text string, gram string")
    b = spark.createDataFrame([(j, " ".join(x), 1) for j, x in enumerate(items)], "item_id long, text string, d int")
    got = [(r.doc_id, r.item_id, round(r.coverage, 6), r.n_tiles, r.longest) for r in decontam.contamination(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_periodic_texts_are_tiled():
    seeds = [(d, i) for d in range(3000) for i in range(200) if (d - i) % 5 == 0]
    assert sum(n for _, _, n in decontam.tile(seeds)) == 204


@pytest.mark.parametrize("counts,take", [([5, 0, 3, 12], 7), ([4, 4], 8), ([0, 0], 0), ([3], 0)])
def test_draws_are_hypergeometric(counts, take):
    rng, counts = np.random.default_rng(3), np.array(counts)
    got = np.array([mixing.drawn_counts(rng, counts, take) for _ in range(4000)])
    assert (got.sum(axis=1) == take).all() and (got >= 0).all() and (got <= counts).all()
    total = max(1, counts.sum())
    assert np.allclose(got.mean(axis=0), counts * take / total, atol=0.1)
    share = counts / total
    assert np.allclose(got.var(axis=0), take * share * (1 - share) * (total - take) / max(1, total - 1), atol=0.15)


def test_a_tree_of_very_many_blocks():
    quotas = [7 * 10**12, 3, 10**11 + 1]
    got = mixing.splitting_tree(quotas, 16, 1)
    assert got.sum(axis=0).tolist() == quotas and got.sum(axis=1).max() - got.sum(axis=1).min() <= 4
    assert (got == mixing.splitting_tree(quotas, 16, 1)).all()


def test_shards_grow_with_the_mix_and_every_draw_is_in_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    rng = random.Random(2)
    rows = [(k, " ".join("x" * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    docs = spark.createDataFrame([(k, t, f"s{k % 3}") for k, t in rows], "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, block_words=8)
    words = sum(len(t.split()) for _, t in rows)
    held = {r.shard: r.w for r in mix.draws.groupBy("shard").agg(F.sum("words").alias("w")).collect()}
    assert len(held) == -(-words * 3 // 200) and max(held.values()) <= 130
    per = defaultdict(Counter)
    for r in mix.draws.collect():
        per[r.doc_id][r.shard] += r.words
    for r in mixing.taken(mix).collect():
        assert r.taken == sum(per[r.doc_id].values()) and r.n_shards == len(per[r.doc_id]) and r.first_shard == min(per[r.doc_id], default=None)
