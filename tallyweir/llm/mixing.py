"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of at most ``block_words`` words. The blocks of a source stand in one
pseudo-random order (a hash, so reruns agree); a source's quota is a number of draws along that order, one
whole pass per full multiple of its size and then a prefix. A binary tree over the output shards splits all
quotas at once: at each node the left half receives a multivariate hypergeometric draw of the node's
counts. A shard then owns disjoint ranges of each source's order, and its rows are put in a hashed order.

A hot source is no hot task: prefix sums are taken in two levels, over hash buckets of bounded size and
then over one row per bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialize, text_key

#: One row per source comes to the driver; more sources than this are refused.
MAX_SOURCES = 100_000
#: Words of a shard, about 14 MB of text.
SHARD_WORDS = 1 << 21
#: Shards times sources: the table of bounds that all workers get has so many longs at most. Where it would have more, shards are larger.
MAX_BOUNDS = 1 << 23


def targets(sizes: dict, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict:
    """Target words per source. Sources by code point, null last, take the weights in turn; none gets more
    than cap times its size, and what is above goes to the others by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        want = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if want[s] > cap * sizes[s]]
        if not above:
            return out | want
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def drawn_counts(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """A multivariate hypergeometric draw of take out of counts, of any size (numpy's own ends at 1e9).

    Each item goes by a coin of its own, which gives binomials; then as many items as are too many or too few, chosen evenly,
    go back or follow. A set of random size that is even among those of its size stays so: the draw is exact.
    """
    total = int(counts.sum())
    left = rng.binomial(counts, take / total) if total else counts.copy()
    over = int(left.sum()) - take
    pool = left if over > 0 else counts - left
    ends = np.cumsum(pool)
    picked = rng.choice(int(ends[-1]), abs(over), replace=False, shuffle=False) if over else np.zeros(0, np.int64)
    moved = np.bincount(np.searchsorted(ends, picked, side="right"), minlength=len(counts))
    return left - moved if over > 0 else left + moved


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: exact counts whose columns sum to quotas, drawn by recursive bisection."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        take = total * (mid - lo) // (hi - lo)
        left = drawn_counts(np.random.default_rng((seed, lo, hi)), counts, take)
        split(left, lo, mid)
        split(counts - left, mid, hi)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


@dataclass
class Mix:
    """documents: rid, doc_id, source, size, source_size, target; draws: rid, doc_id, th, source, block,
    copy, words, shard, place (sort a shard by it)."""

    documents: DataFrame
    draws: DataFrame


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int | None = 256, shards: int | None = None, seed: int = 7, row_id: str | None = None) -> Mix:
    """Draws blocks of documents until each source meets its target.

    Null text: size 0, never drawn. Null source: a source of its own, last. Null doc_id and repeated rows:
    each row is a document of its own. Empty table: empty frames. block_words=None keeps documents whole.
    No block is drawn more than ceil(cap) times; taken words differ from the target by at most half a block.
    shards: by default so many that one holds about SHARD_WORDS words (see MAX_BOUNDS).
    row_id: a stored, unique long column of docs that becomes rid, to join the draws back on.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select((F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("source").cast("string").alias("source"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix_sized")
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.sum(F.ceil(F.col("size") / (block_words or 2**62))).alias("blocks")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r["source"]: r["words"] for r in per}
    goal = targets(sizes, weights, share, cap)
    plan = spark.createDataFrame([(s, sizes[s], float(goal[s])) for s in sizes], "s string, source_size long, target double")
    documents = sized.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    bits = min(24, max(8, math.ceil(math.log2(max(1, sum(r["blocks"] for r in per)) / 20_000)))) if per else 8
    size = F.lit(block_words if block_words else 2**62).cast("long")
    blocks = (documents.filter("size > 0")
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / size) - 1)))
              .withColumn("words", F.least(size, F.col("size") - F.col("block") * size))
              .withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "th", "block"))
              .withColumn("bucket", F.shiftrightunsigned("h", 64 - bits)))
    buckets = blocks.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    base = buckets.select(F.col("source").alias("bs"), F.col("bucket").alias("bb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.sum("n").over(whole).alias("all_n"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "th", "block", "rid").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (blocks.withColumn("rank", F.count("*").over(inside) - 1).withColumn("upto", F.sum("words").over(inside))
              .join(base, F.col("source").eqNullSafe(F.col("bs")) & (F.col("bucket") == F.col("bb")))
              .withColumn("rank", F.col("rank") + F.col("n0")).withColumn("upto", F.col("upto") + F.col("w0")))
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - passes * F.col("source_size")
    copies = (passes + F.when(F.col("upto") - F.col("words") / 2 < rest, 1).otherwise(0)).cast("int")
    drawn = materialize(ranked.withColumn("copies", copies).filter("copies > 0")
                        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
                        .select("rid", "doc_id", "th", "source", "block", "copy", "words", (F.col("rank") + F.col("copy") * F.col("all_n")).alias("draw")), "mix_draws")

    if shards is None:
        shards = max(1, min(math.ceil(sum(goal.values()) / SHARD_WORDS), MAX_BOUNDS // max(1, len(sizes))))
    quotas = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    ends = np.cumsum(splitting_tree([quotas[s] for s in names], shards, seed), axis=0) if names else np.zeros((shards, 0), np.int64)
    shared = spark.sparkContext.broadcast({s: ends[:, i] for i, s in enumerate(names)})
    schema = T.StructType([*drawn.drop("draw").schema.fields, T.StructField("shard", T.IntegerType())])

    def place(batches):
        for pdf in batches:
            pdf["shard"] = 0
            for s, own in pdf.groupby("source", dropna=False, sort=False):
                pdf.loc[own.index, "shard"] = np.searchsorted(shared.value[s if isinstance(s, str) else None], own["draw"].to_numpy(), side="right")
            pdf["shard"] = pdf["shard"].astype("int32")
            yield pdf.drop(columns="draw")

    draws = drawn.mapInPandas(place, schema).withColumn("place", F.xxhash64(F.lit(seed), "shard", "doc_id", "th", "block", "copy"))
    return Mix(documents, draws)


def taken(mix: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words drawn, repeats counted), n_shards and first_shard (those that hold its draws; none: 0 and null)."""
    words = mix.draws.groupBy("rid").agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("n_shards"), F.min("shard").alias("first_shard"))
    return (mix.documents.join(words, "rid", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"), "first_shard"))


def mixed_documents(docs: DataFrame, mix: Mix, row_id: str) -> DataFrame:
    """The mix as rows of docs: a row once per draw of it (mix_sources(block_words=None, row_id=row_id)), each shard in its own order."""
    shard = mix.draws.select(F.col("rid").alias("__tw_row"), F.col("shard").alias("__tw_shard"), F.col("place").alias("__tw_place"))
    out = docs.join(shard, F.col(row_id) == F.col("__tw_row"))
    return out.repartition("__tw_shard").sortWithinPartitions("__tw_shard", "__tw_place").drop("__tw_row", "__tw_shard", "__tw_place")
