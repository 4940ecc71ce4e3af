"""Repeats of a fixed length across all texts: the Spark side shared by suffix arrays and recompression.

A window is ``width`` consecutive units (bytes or words) of one document. An operator names an anchor for every
window from the window's content alone, so equal windows have equal anchors. Consecutive windows with one anchor form
a context. Then

1. anchors that occur once are dropped: their windows cannot repeat;
2. equal contexts are counted and joined once, with their number;
3. an anchor with a single distinct context is settled by that number;
4. the other anchors' contexts are dealt to shards by anchor and each shard is judged by the operator;
5. an anchor with more than ``hot`` distinct contexts would make a shard too large: its windows are counted one by one,
   by a 128-bit digest, in an ordinary aggregation.

Nothing is capped or sampled. Counting sends a few dozen bytes for each context; texts are shuffled twice, by
document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, key_of, materialize, same, text_of

OCCURRENCES = "doc_id long, th long, at int, n int, anchor long, context long"
_OCC = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("context", pa.int64())])


@dataclass
class Method:
    """What an operator brings.

    width: units of a window. hot: distinct contexts of an anchor that a shard may hold. shard: units of text that a shard
    holds, about. batch: bytes of text that anchors() is given at a time.
    anchors(texts): for texts (bytes), arrays (text number, first window, windows, anchor) and the
    context digests. cut(text, [(at, n)]): the contexts' data. judge(data, times): for the contexts of a
    shard and how often each occurs, lists lo and hi of covered unit ranges. windows(data): digests of its windows.
    """

    width: int
    hot: int
    shard: int
    batch: int
    anchors: Callable
    cut: Callable
    judge: Callable
    windows: Callable


def digest(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data, 5), "little", signed=True)


def digest2(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(data, 7)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last index of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edges[::2], edges[1::2]


def covered(flags: np.ndarray, width: int) -> tuple[list[int], list[int]]:
    """Unit ranges covered by the windows that start where flags hold."""
    lo, hi = runs(flags)
    return lo.tolist(), (hi - 1 + width).tolist()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges of the union; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contexts(value: np.ndarray, place: np.ndarray, owner: np.ndarray, ok: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and windows of each context of the window starts where ok holds.

    value: the anchor; place: where it stands; owner: the text. Windows of one value are one context where the anchor
    stands in one place. Where it moves on, as in periodic text, windows may equal each other: what follows is a context of
    its own, so that the anchor has occurred twice and its windows are judged one by one.
    """
    start = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]) | (ok[1:] != ok[:-1])]
    moved = np.r_[False, place[1:] != place[:-1]] & ~start
    run = np.cumsum(start)
    moves = np.flatnonzero(moved)
    first = np.zeros(len(value), bool)
    first[moves[np.r_[True, run[moves][1:] != run[moves][:-1]]] if len(moves) else moves] = True
    begin = np.flatnonzero(start | first)
    count = np.diff(np.r_[begin, len(value)])
    begin, count = begin[ok[begin]], count[ok[begin]]
    parts = -(-count // limit)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(begin, parts) + nth * limit, np.minimum(np.repeat(count, parts) - nth * limit, limit)


def _byte_docs(docs: DataFrame) -> DataFrame:
    """doc_id, th, text as bytes. Where doc_ids are all there and differ, they name documents alone and th is 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of(docs).alias("th"), text_of().cast("binary").alias("text"))


def _grouped(batches: Iterator, size: int) -> Iterator[tuple[list, list, list]]:
    """ids, hashes and texts, about size bytes at a time."""
    ids, hashes, texts, held = [], [], [], 0
    for b in batches:
        for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i)
            hashes.append(h)
            texts.append(t)
            held += len(t)
            if held >= size:
                yield ids, hashes, texts
                ids, hashes, texts, held = [], [], [], 0
    if texts:
        yield ids, hashes, texts


def spans_of(base: DataFrame, method: Method) -> DataFrame:
    """For _byte_docs(): doc_id, th, spans (array of at, lo, hi): per document with repeats, the covered ranges, lo and hi from at on."""
    m = method

    def emit(batches):
        for ids, hashes, texts in _grouped(batches, m.batch):
            number, at, n, anchor, context = m.anchors(texts)
            if len(number):
                id_array = pa.array(ids, pa.int64()).take(pa.array(number, pa.int64()))
                yield pa.RecordBatch.from_arrays([id_array, pa.array(np.array(hashes, np.int64)[number]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int64)), pa.array(context.astype(np.int64))], schema=_OCC)

    every = materialize(base.mapInArrow(emit, OCCURRENCES), "repeat_occurrences")
    repeated = every.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor")
    own = materialize(every.join(repeated, "anchor"), "repeat_own")
    contexts = materialize(own.groupBy("anchor", "context").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("doc_id", "th", "at", "n")]), "repeat_contexts")
    drop_table(every)
    several = contexts.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1")
    settled = contexts.join(several, "anchor", "left_anti").filter("times > 1").select("anchor", "context", F.array(F.lit(0)).alias("lo"), F.array(F.col("n") + (m.width - 1)).alias("hi"))
    multi = materialize(contexts.join(several, "anchor"), "repeat_multi")
    facts = multi.agg(F.sum(F.when(F.col("k") <= m.hot, F.col("n") + m.width)).alias("units"), F.max("k").alias("k")).first()
    shards = int((facts["units"] or 0) // m.shard) + 1

    want = multi.withColumn("hot", F.col("k") > m.hot).groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "context", "times", "at", "n", "hot")).alias("want"))

    def cut(batches):
        for b in batches:
            out: list[tuple] = []
            for text, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
                out += [(w["anchor"], w["context"], w["times"], w["hot"], d) for w, d in zip(want, m.cut(text, [(w["at"], w["n"]) for w in want]), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["anchor", "context", "times", "hot", "data"])

    fetched = materialize(same(base.hint("merge"), want).select("text", "want").mapInArrow(cut, "anchor long, context long, times long, hot boolean, data binary"), "repeat_data")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "context"]).sort_values(["anchor", "context"])  # rows that repeat a document bring a context twice
        lo, hi = m.judge(list(pdf["data"]), pdf["times"].to_numpy())
        return pd.DataFrame({"anchor": pdf["anchor"].to_numpy(), "context": pdf["context"].to_numpy(), "lo": lo, "hi": hi})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    judged = fetched.filter("not hot").drop("hot").withColumn("shard", shard).groupBy("shard").applyInPandas(judge, "anchor long, context long, lo array<int>, hi array<int>")
    found = settled.unionByName(judged)
    if (facts["k"] or 0) > m.hot:
        found = found.unionByName(_one_by_one(fetched.filter("hot").drop("hot"), m))
    found = found.filter(F.size("lo") > 0)
    placed = own.join(found, ["anchor", "context"])
    return placed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("spans"))


def _one_by_one(contexts: DataFrame, m: Method) -> DataFrame:
    """The same answer for anchors with very many contexts, window by window."""

    def explode(batches):
        for pdf in batches:
            digests = [m.windows(d) for d in pdf["data"]]
            n = np.array([len(w) for w in digests], np.int64)
            flat = np.array([x for w in digests for x in w], np.int64).reshape(-1, 2)
            own = {c: np.repeat(pdf[c].to_numpy(), n) for c in ("anchor", "context", "times")}
            yield pd.DataFrame(own | {"off": (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "w1": flat[:, 0], "w2": flat[:, 1]})

    windows = materialize(contexts.dropDuplicates(["anchor", "context"]).mapInPandas(explode, "anchor long, context long, times long, off int, w1 long, w2 long"), "repeat_windows")
    often = windows.groupBy("w1", "w2").agg(F.sum("times").alias("k")).filter("k > 1")
    hits = windows.join(often, ["w1", "w2"]).groupBy("anchor", "context").agg(F.array_sort(F.collect_set("off")).alias("offs"))
    return hits.select("anchor", "context", F.col("offs").alias("lo"), F.transform("offs", lambda x: x + m.width).alias("hi"))


def finished(docs: DataFrame, method: Method, row: Callable, schema: str) -> DataFrame:
    """row(text, merged spans) for each input row, after doc_id."""
    base = _byte_docs(docs)
    joined = same(base.hint("merge"), spans_of(base, method), "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            out = []
            for i, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                out.append((i, *row(text, merged([(s["at"] + x, s["at"] + y) for s in spans or () for x, y in zip(s["lo"], s["hi"], strict=True)]))))
            yield pd.DataFrame(out, columns=names)

    def arrow(batches):
        for pdf in run(batches):
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    names = ["doc_id", *[x.split()[0] for x in schema.split(", ")]]
    return joined.mapInArrow(arrow, f"doc_id long, {schema}")
