"""What a chain of document filters removes, in every order: exact duplicates by radix tries of whole texts, then counts of failure masks.

1. Each input partition inserts its texts, as UTF-8 bytes, into a compressed trie whose terminals hold the least doc_id. A trie is emptied
   when it holds TRIE_BYTES: copies are merged before anything is shuffled, so a text goes out once a trie, however many copies it has.
   On the way every trie names separators, the shortest prefixes that part a text from the one before it, one about every
   SEPARATOR_BYTES of text: short where texts differ early, long where they share a beginning.
2. The separators cut the order of texts into ranges of about equal bytes, each the range of a task. Texts that had copies
   within a trie may be in all of them; these are first merged in salted tries of their range.
3. A task sorts its range and inserts it into tries, emptied between different texts; terminals that several tries share give the least id of all.
4. Each document has a mask of the filters it fails; the masks are counted per part, 32 at most, and all orders are read off these.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.numbering import numbered
from .common import materialize, partitions, text_of

#: Bytes of text that a trie holds at most, and one text more.
TRIE_BYTES = 32 << 20
#: Documents that wait for a trie to be emptied, at most.
TRIE_DOCS = 1 << 18
#: A separator is named about every so many bytes.
SEPARATOR_BYTES = 1 << 20
#: Ranges for each shuffle partition.
RANGES = 4
#: Parts by which tries of texts with copies are merged before the last round.
SALTS = 64

# The filters, by the bit of a failing document's mask.
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLLOWING = bytes(range(0x80, 0xC0))


class RadixTrie:
    """Byte strings by shared prefixes. A node is [label, children by first byte, terminal]; edges branch, so no node but the root has one child and no terminal."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, -1]
        self.terminals = 0
        self.bytes = 0

    def insert(self, key: bytes) -> int:
        """The number of key's terminal, a new one if key was not there."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] < 0:
                    node[2] = self._new(key)
                return node[2]
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, self._new(key)]
                return self.terminals - 1
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = shared(label, key[at : at + len(label)])
            middle = [label[:n], {label[n]: child}, -1]
            child[0] = label[n:]
            node[1][key[at]] = middle
            node, at = middle, at + n

    def _new(self, key: bytes) -> int:
        self.terminals += 1
        self.bytes += len(key)
        return self.terminals - 1

    def walk(self) -> Iterator[tuple[bytes, int, int]]:
        """Keys in byte order: key, terminal and the bytes it shares with the key before it."""
        stack = [(self.root, b"", 0)]
        kept = 0
        while stack:
            node, before, depth = stack.pop()
            kept = min(kept, depth)
            key = before + node[0]
            if node[2] >= 0:
                yield key, node[2], kept
                kept = len(key)
            stack += [(node[1][c], key, len(key)) for c in sorted(node[1], reverse=True)]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that text fails."""
    words = text.split()  # bytes are split at the six ASCII spaces alone
    n, chars = len(words), len(text.translate(None, _FOLLOWING))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (n < 100) + 2 * (100 * len(set(words)) < 80 * n) + 4 * (100 * capitals > 10 * chars) + 8 * (len(text.translate(None, SYMBOLS)) < len(text))


_LOCAL = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("key", pa.int64()), ("least", pa.int64()), ("copies", pa.int64()), ("text", pa.binary()), ("cut", pa.binary())])
_LOCAL_SQL = "doc_id long, part string, mask int, key long, least long, copies long, text binary, cut binary"


def local_tries(docs: DataFrame, trie_bytes: int = TRIE_BYTES, trie_docs: int = TRIE_DOCS, separator_bytes: int = SEPARATOR_BYTES) -> DataFrame:
    """Rows of three kinds. Documents: doc_id, part, mask (A to D), key (their terminal) and least (the least doc_id there, null if none).
    A terminal's first document has its text and copies too. Separators: cut."""
    def run(batches):
        task, emptied = TaskContext.get().partitionId(), 0
        trie, ids, parts, at, texts, own = RadixTrie(), [], [], [], [], []

        def close() -> pa.RecordBatch:
            first = (task << 40) | (emptied << 20)
            least: list = [None] * trie.terminals
            copies = [0] * trie.terminals
            for d, t in zip(ids, at, strict=True):
                copies[t] += 1
                if d is not None and (least[t] is None or d < least[t]):
                    least[t] = d
            held, cuts = int(np.random.default_rng((task, emptied)).integers(separator_bytes)), []
            for key, _, same in trie.walk():
                held += len(key)
                if held >= separator_bytes:
                    held %= separator_bytes
                    cuts.append(key[: same + 1])
            none = [None] * len(cuts)
            n = len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array(ids + none, pa.int64()), pa.array(parts + none, pa.string()), pa.array([own[t] for t in at] + none, pa.int32()), pa.array([first | t for t in at] + none, pa.int64()),
                pa.array([least[t] for t in at] + none, pa.int64()), pa.array([copies[t] for t in at] + none, pa.int64()), pa.array(texts + none, pa.binary()), pa.array([None] * n + cuts, pa.binary())], schema=_LOCAL)

        for batch in batches:
            for d, part, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "part", "text")], strict=True):
                t = trie.insert(text)
                new = t == len(own)
                ids.append(d)
                parts.append(part)
                at.append(t)
                texts.append(text if new else None)
                if new:
                    own.append(own_mask(text))
                if trie.bytes >= trie_bytes or len(ids) >= trie_docs:
                    yield close()
                    emptied += 1
                    trie, ids, parts, at, texts, own = RadixTrie(), [], [], [], [], []
        if ids:
            yield close()

    return docs.mapInArrow(run, _LOCAL_SQL)


def boundaries(tries: DataFrame, ranges: int) -> list[bytes]:
    """The prefixes that cut the order of texts into at most ranges parts of about equal bytes: every so many-th separator comes to the driver."""
    cuts = numbered(tries.filter("cut is not null").select("cut", F.monotonically_increasing_id().alias("tie")), F.col("cut"), F.col("tie"))
    step = max(1, -(-cuts.count() // ranges))
    return sorted({bytes(r["cut"]) for r in cuts.filter(F.col("no") % step == 0).select("cut").collect()})


def _ranged(texts: DataFrame, cuts: list[bytes]) -> DataFrame:
    """texts (key, least, text) with range, how many cuts are not above the text."""
    shared_cuts = texts.sparkSession.sparkContext.broadcast(cuts)

    def run(batches):
        from bisect import bisect_right

        for batch in batches:
            r = [bisect_right(shared_cuts.value, t) for t in batch.column("text").to_pylist()]
            yield batch.append_column("range", pa.array(r, pa.int32()))

    return texts.mapInArrow(run, "key long, least long, text binary, range int")


def _merged(make: Callable[[list, list, list, RadixTrie], pa.RecordBatch], schema: str, trie_bytes: int, trie_docs: int):
    """Arrow function over sorted texts: inserts them into a trie, which is emptied between two different texts, and gives make() the terminals, keys and ids of each."""
    def run(batches):
        trie, at, keys, least, last = RadixTrie(), [], [], [], None
        for batch in batches:
            for key, d, text in zip(*[batch.column(c).to_pylist() for c in ("key", "least", "text")], strict=True):
                if text != last and (trie.bytes >= trie_bytes or len(at) >= trie_docs):
                    yield make(at, keys, least, trie)
                    trie, at, keys, least = RadixTrie(), [], [], []
                at.append(trie.insert(text))
                keys.append(key)
                least.append(d)
                last = text
        if at:
            yield make(at, keys, least, trie)

    return lambda df: df.mapInArrow(run, schema)


def _lowest(at: list, least: list, trie: RadixTrie) -> list:
    low: list = [None] * trie.terminals
    for t, d in zip(at, least, strict=True):
        if d is not None and (low[t] is None or d < low[t]):
            low[t] = d
    return low


def _salted(at: list, keys: list, least: list, trie: RadixTrie) -> pa.RecordBatch:
    """Each key's merged key; a terminal's first key has the text and the least id."""
    low, first, text = _lowest(at, least, trie), {}, {}
    for t, k in zip(at, keys, strict=True):
        first.setdefault(t, k)
    for key, t, _ in trie.walk():
        text[t] = key
    own = [first[t] == k for t, k in zip(at, keys, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([first[t] for t in at], pa.int64()), pa.array([low[t] for t in at], pa.int64()), pa.array([text[t] if o else None for t, o in zip(at, own, strict=True)], pa.binary())], names=["key", "merged", "least", "text"])


def _final(at: list, keys: list, least: list, trie: RadixTrie) -> pa.RecordBatch:
    """The least id of all for keys whose terminal others share."""
    low, n = _lowest(at, least, trie), np.bincount(np.asarray(at, np.int64), minlength=trie.terminals)
    more = [(k, low[t]) for t, k in zip(at, keys, strict=True) if n[t] > 1]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in more], pa.int64()), pa.array([d for _, d in more], pa.int64())], names=["key", "lowest"])


def masks(docs: DataFrame, trie_bytes: int = TRIE_BYTES, trie_docs: int = TRIE_DOCS, separator_bytes: int = SEPARATOR_BYTES) -> DataFrame:
    """doc_id, part, mask of every row of docs (doc_id, part, text): the bits of the filters A to E that it fails."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), text_of().cast("binary").alias("text"))
    tries = materialize(local_tries(rows, trie_bytes, trie_docs, separator_bytes), "audit_tries")
    cuts = boundaries(tries, RANGES * partitions(spark))
    texts = tries.filter("text is not null")
    alone = _ranged(texts.filter("copies = 1").select("key", "least", "text"), cuts)
    copied = _ranged(texts.filter("copies > 1").select("key", "least", "text"), cuts)
    salt = F.pmod(F.xxhash64(F.shiftright("key", 20)), F.lit(SALTS))
    first = copied.repartition("range", salt).sortWithinPartitions("text")
    merged = materialize(_merged(_salted, "key long, merged long, least long, text binary", trie_bytes, trie_docs)(first), "audit_salted")
    again = _ranged(merged.filter("text is not null").select("key", "least", "text"), cuts)
    last = alone.unionByName(again).repartition("range").sortWithinPartitions("range", "text")
    lowest = materialize(_merged(_final, "key long, lowest long", trie_bytes, trie_docs)(last), "audit_lowest")
    # what a merged key stands for: its own least id, or the one of all
    of_merged = merged.select(F.col("key").alias("k"), "merged", "least").join(lowest, F.col("merged") == lowest["key"], "left").select(F.col("k").alias("key"), F.coalesce("lowest", "least").alias("lowest"))
    known = of_merged.unionByName(lowest.join(merged.select("key"), "key", "left_anti")).withColumnRenamed("key", "__tw_key")
    own = tries.filter("cut is null").select("doc_id", "part", "mask", "key", "least").join(known, F.col("key") == F.col("__tw_key"), "left")
    repeated = F.coalesce(F.col("doc_id") > F.coalesce("lowest", "least"), F.lit(False))
    return own.select("doc_id", "part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def mask_counts(masks_: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic. A document is good or toxic if any label row of its doc_id says 1; one without labels is neither."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return masks_.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def orders(filters: str = FILTERS) -> list[dict]:
    """All orders and their steps: filter_order, step, bit (of its filter), before (bits of the earlier ones)."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << filters.index(f)
            out.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return out


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step, from mask_counts().

    shapley: a filter removes the documents of a mask in those orders that have it before the mask's other filters, one in as many as the mask has.
    """
    per = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # 2^n masks a part
    steps = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    each = per.select("part", "counts", F.explode(steps).alias("s")).select("part", "counts", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(what: str, when: Callable) -> F.Column:
        return F.aggregate(F.filter("counts", when), F.lit(0).cast("long"), lambda a, c: a + c[what])

    fails = lambda c: c["mask"].bitwiseAND(bit) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    every = 1
    for k in range(2, len(filters) + 1):
        every *= k
    shapley = F.aggregate(F.filter("counts", fails), F.lit(0).cast("long"), lambda a, c: a + (c["n"] * every / F.bit_count(c["mask"])).cast("long"))
    return each.select("part", "filter_order", "step", total("n", lambda c: ~fails(c) & ~gone(c)).alias("kept"), total("n", lambda c: fails(c) & ~gone(c)).alias("removed"), total("n", lambda c: fails(c) & gone(c)).alias("redundant"),
                       total("n", lambda c: c["mask"] == bit).alias("unique_fails"), total("good", lambda c: fails(c) & ~gone(c)).alias("good_lost"), total("toxic", lambda c: fails(c) & ~gone(c)).alias("toxic_lost"), shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of op13: what each filter removes from docs at each step of all orders, per lang.

    Null texts count as empty ones, null langs belong to the part ''. A null doc_id is neither smaller nor larger than another: its row is no duplicate, makes
    none and has no labels; rows that agree in doc_id and text are none of each other either. An empty table gives an empty frame. Columns besides doc_id, lang and text are not read.
    """
    return interactions(mask_counts(materialize(masks(docs.select("doc_id", F.col("lang").alias("part"), "text")), "audit_masks"), labels))
