"""Shards of near equal bytes: longest-processing-time scheduling of groups that must stay together.

Groups, here documents of equal text, are taken from the largest to the smallest, and each goes to the shard that has the
fewest bytes so far, which a heap holds on top. Groups of one size are interchangeable, so the schedule runs over the table of
sizes, not over the groups: a size that c groups have is dealt in rounds. How many sizes there can be is bounded: D different ones sum
to at least D*D/2 bytes, so there are at most the square root of twice the bytes of the corpus (14 million for 100 TB), and
one task streams over them with a shard's load each as its only state. The result is that of the plain heap, group by group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.numbering import numbered
from .common import materialize, text_key, text_of

SHARDS = 24
#: Bytes that a document takes beside its text.
OVERHEAD = 8


def rounds(heap: list[tuple[int, int]], size: int, count: int) -> Iterator[tuple[int, list[int]]]:
    """Gives count groups of size to the shards of heap, [(load, shard)], which it changes: runs (groups, shards in turn).

    Shards whose loads lie within size of the least one take a group each, in the order of the heap, and keep that order; this repeats
    until the least load reaches that of a shard left out. So all such rounds are dealt at once. What is less than a round goes by the heap.
    """
    while count:
        least = heap[0][0]
        near = sorted(x for x in heap if x[0] < least + size)
        if count < len(near) or not size:
            turn = []
            for _ in range(count if size else 1):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                turn.append(shard)
            yield count, turn
            return
        times = count // len(near)
        if len(near) < len(heap):
            times = min(times, (min(x[0] for x in heap if x[0] >= least + size) - least) // size)
        moved = {shard for _, shard in near}
        heap[:] = [(load + size * times * (shard in moved), shard) for load, shard in heap]
        heapq.heapify(heap)
        yield times * len(near), [shard for _, shard in near]
        count -= times * len(near)


def schedule(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """bytes, runs (first, groups, turn): of the groups of a size, numbered from 0, number r of a run goes to turn[(r - first) % size(turn)].

    sizes: bytes, groups, a row per different size.
    """
    def run(batches):
        heap = [(0, s) for s in range(shards)]
        for pdf in batches:
            made = []
            for size, count in zip(pdf["bytes"].tolist(), pdf["groups"].tolist(), strict=True):
                first, runs = 0, []
                for n, turn in rounds(heap, size, count):
                    runs.append({"first": first, "groups": n, "turn": turn})
                    first += n
                made.append(runs)
            yield pd.DataFrame({"bytes": pdf["bytes"], "runs": made})

    largest_first = sizes.repartition(1).sortWithinPartitions(F.desc("bytes"))
    return largest_first.mapInPandas(run, "bytes long, runs array<struct<first: long, groups: long, turn: array<int>>>")


def plan_shards(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """group, shard: where each group (group, bytes, first_id) goes. Ties in bytes go by first_id (null last), then by group."""
    ranked = numbered(groups, F.desc("bytes"), F.asc_nulls_last("first_id"), F.col("group"))
    ranked = materialize(ranked, "shard_groups")
    sizes = materialize(ranked.groupBy("bytes").agg(F.count("*").alias("groups"), F.min("no").alias("start")), "shard_sizes")
    runs = materialize(schedule(sizes.select("bytes", "groups"), shards).join(sizes.select("bytes", "start"), "bytes"), "shard_runs")
    at = F.col("no") - F.col("start")
    run = F.get(F.filter("runs", lambda r: (at >= r["first"]) & (at < r["first"] + r["groups"])), 0)
    turn = run["turn"]
    return ranked.join(runs, "bytes").select("group", F.get(turn, ((at - run["first"]) % F.size(turn)).cast("int")).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, group: Column | None = None) -> DataFrame:
    """doc_id, th (hash of the text), size, text_crc32, shard, slot: a row per row of docs.

    size: UTF-8 bytes of the text plus 8; a null text counts as an empty one, with which it shares a group and a shard. group: what must stay together,
    a long; by default the hash of the text, so equal texts meet in one shard, whatever share of the corpus they are. slot: gapless from 0 within a
    shard, by doc_id (null last), then text hash; rows that agree in both are alike. Null and repeated doc_ids are rows like others. An
    empty table gives an empty frame; only doc_id, text and what group reads are looked at.
    """
    sized = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), (group if group is not None else text_key()).alias("group"),
                                    (F.octet_length(text_of()) + OVERHEAD).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32")), "shard_sized")
    groups = materialize(sized.groupBy("group").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first_id")), "shard_totals")
    own = plan_shards(groups, shards).withColumnRenamed("group", "__tw_group")
    placed = sized.join(own, F.col("group").eqNullSafe(F.col("__tw_group"))).drop("__tw_group", "group")
    ranked = materialize(numbered(placed, F.col("shard"), F.asc_nulls_last("doc_id"), F.col("th"), F.col("rid")), "shard_slots")
    first = ranked.groupBy("shard").agg(F.min("no").alias("first"))  # a row per shard
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "th", "size", "text_crc32", "shard", (F.col("no") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8) -> None:
    """Writes docs, columns unchanged, below path/shard=N, each shard in at most files files. Equal texts meet in one shard.

    A column of docs named shard is refused, as the folder's name would hide it.
    """
    if "shard" in docs.columns:
        raise ValueError("docs have a column named shard")
    own = shard_documents(docs, shards).select(F.col("th").alias("__tw_th"), "shard").distinct()
    out = docs.join(own, text_key() == F.col("__tw_th")).drop("__tw_th")
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)), F.lit(files))
    out.repartition("shard", spread).write.mode("errorifexists").partitionBy("shard").parquet(path)


def documents_by_shard(docs: DataFrame) -> DataFrame:
    """The rows of op11: bytes near equal, so no shard for one more."""
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
