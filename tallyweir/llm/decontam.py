"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become running Karp-Rabin style fingerprints of five-word windows (lower case,
letters and digits). An equi join on fingerprints gives the seeds; per document and item, runs of seeds on
one diagonal are maximal matches, and the longest whose words are all unmarked is marked again and again. The
share of the item's words under tiles is its coverage, whatever their order in the document. An item of fewer than five
words has no seed; a document that holds all of it in a row covers it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed

MIN_MATCH = 5
#: Item windows that are broadcast at most (about 40 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def windows(df: DataFrame, keys: list[str], pos: str, size: int = MIN_MATCH) -> DataFrame:
    """keys, pos, gram (fingerprint of size words from pos on), n_words; texts below size words have none."""
    w = df.select(*keys, words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w")).filter(F.col("n_words") >= size)
    n = F.col("n_words") - (size - 1)
    zipped = F.arrays_zip(*[F.slice("w", F.lit(k + 1), n).alias(f"w{k}") for k in range(size)])
    return (w.select(*keys, "n_words", F.posexplode(zipped).alias(pos, "g"))
            .select(*keys, "n_words", pos, F.xxhash64(*[F.col("g")[f"w{k}"] for k in range(size)]).alias("gram")))


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch of true values."""
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tile(seeds: list[tuple[int, int]], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling over seeds (document position, item position): (document start, item start, words).

    Longest first; among equals the earliest in the item, then in the document. Matches wait in a heap; one that
    has lost words to a tile by its turn goes back as what is left of it.
    """
    d, i = np.unique(np.asarray(seeds, dtype=np.int64).reshape(-1, 2), axis=0).T
    order = np.lexsort((i, d - i))
    d, i = d[order], i[order]
    first = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(d) != 1)][: len(i)])
    words = np.diff(np.r_[first, len(i)]) + min_match - 1
    waiting = list(zip((-words).tolist(), i[first].tolist(), d[first].tolist(), strict=True))
    heapq.heapify(waiting)
    marked_d, marked_i = (np.zeros(int(x.max(initial=0)) + min_match, bool) for x in (d, i))
    tiles = []
    while waiting:
        n, i0, d0 = heapq.heappop(waiting)
        free = ~(marked_i[i0 : i0 - n] | marked_d[d0 : d0 - n])
        if free.all():
            tiles.append((d0, i0, -n))
            marked_d[d0 : d0 - n] = marked_i[i0 : i0 - n] = True
            continue
        for a, b in runs(free):
            if b - a >= min_match:
                heapq.heappush(waiting, (a - b, i0 + a, d0 + a))
    return tiles


def short_items(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """doc_id, th, item_id, coverage (1), n_tiles (1), longest of documents that hold all words of an item of fewer than MIN_MATCH
    words in a row; None without such items. docs keyed; items: item_id, text."""
    n = F.size(words_of(F.col("text")))
    found = None
    for size in sorted(r["n"] for r in items.select(n.alias("n")).filter(f"n between 1 and {MIN_MATCH - 1}").distinct().collect()):
        asked = windows(items.filter(n == size), ["item_id"], "i", size).select("item_id", "gram").distinct()
        held = windows(docs, ["doc_id", "th"], "d", size).select("doc_id", "th", "gram").distinct()
        got = held.join(asked, "gram").select("doc_id", "th", "item_id", F.lit(1.0).alias("coverage"), F.lit(1).alias("n_tiles"), F.lit(size).alias("longest"))
        found = got if found is None else found.unionByName(got)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, th, item_id, coverage, n_tiles, longest: one row per document and item with coverage >= threshold.

    Null texts count as empty; items of fewer than MIN_MATCH words are covered where all their
    words stand in a row, items without words never. Null doc_ids and item_ids are
    ids like any other. Rows that repeat a doc_id and text, or an item_id and text, count once. Either table
    empty: no row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    item_windows = windows(items.withColumn("ith", F.xxhash64("text")), ["item_id", "ith"], "i").withColumnRenamed("n_words", "item_words")
    small = item_windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    doc_windows = windows(keyed(docs), ["doc_id", "th"], "d").drop("n_words")
    seeds = doc_windows.join(F.broadcast(item_windows) if small else item_windows, "gram")
    pairs = seeds.groupBy("doc_id", "th", "item_id", "ith", "item_words").agg(F.collect_set(F.struct("d", "i")).alias("seeds"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                tiles = tile([(x["d"], x["i"]) for x in r.seeds])
                rows.append((r.doc_id, r.th, r.item_id, sum(t[2] for t in tiles) / r.item_words, len(tiles), max(t[2] for t in tiles)))
            got = pd.DataFrame(rows, columns=["doc_id", "th", "item_id", "coverage", "n_tiles", "longest"])
            yield got[got.coverage >= threshold].astype({"doc_id": "Int64", "item_id": "Int64"})

    # a pair whose seeds cannot cover the threshold needs no tiling
    enough = F.size("seeds") * MIN_MATCH >= threshold * F.col("item_words")
    tiled = pairs.filter(enough).mapInPandas(run, "doc_id long, th long, item_id long, coverage double, n_tiles int, longest int")
    short = short_items(keyed(docs), items)
    return tiled if short is None else tiled.unionByName(short)
