"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. In each run a keyed hash samples shingles of a set, on average
1/threshold of them; each sampled shingle leads to a bucket, and texts that share it meet there. Buckets of up to
``LIMIT`` texts are compared exhaustively and exactly. The texts of a larger bucket sample again, ``AGAIN`` times over, and split
on, unless they are so alike that most share every shingle: these, and what is still large at the last level, are compared
block by block. Which buckets these are is estimated from about ``PROBE`` texts each; that chooses between two ways that both take
all texts of the bucket. A similar pair meets in one run with a known probability, and runs are repeated until a pair at the threshold
is met with the target recall; pairs that are more alike are met more surely.

Equal texts are one class and joined once. A pair is compared only in the first bucket (by key) it shares, so every
link is counted once and no pair is written anywhere: a bucket reports, per text, how many links it found and
one neighbour in its group. Before that, lengths and parity maps (a bit per shingle hash, flipped by each shingle: two sets
differ in at least as many shingles as their maps in bits) tell which texts of a bucket can have a partner at all; only
these texts' shingles are sent. Groups are the connected components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, same, sieved, text_key, text_of
from .recompression import mix

SHINGLE = 5
LEVELS = 3
#: Texts that a bucket may hold to be compared at once.
LIMIT = 512
#: Times that the texts of a larger bucket sample on.
AGAIN = 3
#: A bucket is not split where its texts' next buckets hold, on average, this share of it.
DENSE = 0.5
#: Texts of a larger bucket, about, by which that share is estimated before the others sample on.
PROBE = 512
MAP_BITS = 512
#: Bytes that a task takes from or puts into an Arrow batch at a time, about.
BATCH = 1 << 22
#: Postings that are counted at a time.
POSTINGS = 1 << 20


def slices(batch: pa.RecordBatch, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about size bytes of text; a longer text begins a piece."""
    cuts = np.flatnonzero(np.diff(np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs; a text of one to four words is one shingle."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    out = h[:n]
    for k in range(1, min(SHINGLE, len(words))):
        out = mix(out, h[k : k + n], k)
    return np.unique(out)


def survival(again: int = AGAIN) -> float:
    """The chance that a pair at the threshold meets in one run, however deep its buckets have to be split.

    It shares at least threshold * max(|x|, |y|) shingles, each sampled by both with probability
    1 / (threshold * max(|x|, |y|)): one common child on average for each time that a node samples.
    """
    below = 1.0
    for _ in range(100):
        below = 1 - math.exp(-again * below)
    return 1 - math.exp(-below)


def runs_for(recall: float) -> int:
    """Runs until a pair at the threshold is met with the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival()))


def children(s: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys that the set samples under each node, and which node each is under."""
    bar = np.uint64(min((1 << 64) - 1, int(2.0**64 / (threshold * max(1, len(s))))))
    keys, under, step = [], [], max(1, (1 << 20) // max(1, len(s)))
    for i in range(0, len(nodes), step):
        some = nodes[i : i + step]
        at, which = np.nonzero(mix(s[None, :], some[:, None], 100) <= bar) if len(s) else (np.zeros(0, int),) * 2
        keys.append(mix(s[which], some[at], 200))
        under.append(at + i)
    return (np.concatenate(keys).view(np.int64), np.concatenate(under)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def parity_map(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount(s & np.uint64(MAP_BITS - 1), minlength=MAP_BITS).astype(np.uint8) & 1).tobytes()


def _overlaps(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set, what it shares with every set."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, df = np.unique(flat, return_inverse=True, return_counts=True)
    posting = owner[np.argsort(number, kind="stable")]
    start = np.cumsum(df) - df
    out, off = [], 0
    for s in sets:
        own = number[off : off + len(s)]
        off += len(s)
        shared = np.zeros(len(sets), np.int64)
        for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(df[own]) // POSTINGS)) + 1):
            n = df[part]
            at = np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            shared += np.bincount(posting[at], minlength=len(sets))
        out.append(shared)
    return out


def _first_here(earlier: list[np.ndarray]) -> np.ndarray:
    """Square flags: the two share no earlier bucket."""
    shared = _overlaps(earlier) if any(len(e) for e in earlier) else [np.zeros(len(earlier), int)] * len(earlier)
    return np.array(shared) == 0


def compare(sets: list[np.ndarray], earlier: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set and the number of its group's first set. side: 0 or 1 for the two blocks, 2 if there is one."""
    ok = _first_here(earlier) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    n = np.array([len(s) for s in sets])
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = np.zeros(len(sets), np.int64)
    for i, shared in enumerate(_overlaps(sets)):
        hit = ok[i] & (shared >= (n[i] + n - shared) * threshold - 1e-9) & (shared > 0)
        hit[i] = False
        links[i] = int(hit.sum())
        for j in np.flatnonzero(hit[:i]).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(len(sets))])


def _cuts(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """First and one past the last row of each bucket of sorted rows."""
    key = pdf[["node", "b0", "b1"]].to_numpy()
    cuts = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(pdf)], strict=True))


def with_partner(pdf: pd.DataFrame, threshold: float) -> np.ndarray:
    """Flags of the rows, sorted by bucket, that have a possible partner whose first common bucket this is."""
    side, size = pdf["side"].to_numpy(), pdf["n"].to_numpy()
    earlier, maps = [set(e) for e in pdf["earlier"]], np.frombuffer(b"".join(pdf["map"]), np.uint64).reshape(len(pdf), -1)
    apart = (1 - threshold) / (1 + threshold)
    keep = np.zeros(len(pdf), bool)
    for i, j in _cuts(pdf):
        for k in range(i, j - 1):  # row k with the rows behind it
            n = size[k + 1 : j]
            ok = np.minimum(n, size[k]) >= np.maximum(n, size[k]) * threshold - 1e-9
            if ok.any():
                rest = np.flatnonzero(ok & ((side[k + 1 : j] != side[k]) | (side[k] == 2))) + k + 1
                far = np.bitwise_count(maps[rest] ^ maps[k]).sum(axis=1)
                rest = rest[far <= (size[rest] + size[k]) * apart + 1e-9]
                found = [x for x in rest.tolist() if earlier[k].isdisjoint(earlier[x])]
                if found:
                    keep[k] = keep[found] = True
    return keep


def linked(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """c, links, peer of the rows, sorted by bucket, that have links there."""
    sets, earlier, side, c = [np.frombuffer(x, np.uint64) for x in pdf["own"]], list(pdf["earlier"]), pdf["side"].to_numpy(), pdf["c"].to_numpy()
    links, peer = np.zeros(len(pdf), np.int64), c.copy()
    for i, j in _cuts(pdf):
        if j - i == 2:  # most are
            a, b = sets[i], sets[i + 1]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if shared and shared >= (len(a) + len(b) - shared) * threshold - 1e-9 and (side[i] != side[i + 1] or side[i] == 2) and set(earlier[i]).isdisjoint(earlier[i + 1]):
                links[i : i + 2], peer[i + 1] = 1, c[i]
        else:
            links[i:j], root = compare(sets[i:j], [np.asarray(e, np.int64) for e in earlier[i:j]], side[i:j], threshold)
            peer[i:j] = c[i:j][root]
    return pd.DataFrame({"c": c, "links": links, "peer": peer})[links > 0]


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """Most buckets hold two or three rows, so many are handed over together."""
    return rows.withColumn("__g", F.pmod(F.xxhash64("node", "b0", "b1"), F.lit(groups)).cast("int")).groupBy("__g")


def components(edges: DataFrame) -> DataFrame:
    """v, root of the vertices of edges (a, b): the least vertex of each one's component. Alternating large and small stars."""
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
        before = now


def similar_texts(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, limit: int = LIMIT) -> DataFrame:
    """doc_id, th, text_class, n_links, root: a row per input row.

    text_class names the text, root the first text of its group (null without links), n_links counts the other texts whose
    shingle sets reach the Jaccard threshold. Null text: empty; a text without words has no links. Null doc_ids and repeated
    rows are rows of their text's class. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), text_of().cast("binary").alias("text"))
    seeds = mix(np.arange(runs_for(recall), dtype=np.uint64), 0, 77)
    longs, order = pa.list_(pa.int64()), ["node", "b0", "b1", "c"]

    def emit(batches):
        for b in (x for whole in batches for x in slices(whole)):
            known: dict[str, tuple] = {}  # copies often stand together
            texts = b.column("text").to_pylist()
            who = [xxhash.xxh3_128_hexdigest(t) for t in texts]
            for c, text in zip(who, texts, strict=True):
                if c not in known:
                    s = shingles(text)
                    known[c] = (children(s, seeds, threshold)[0], len(s), parity_map(s))
            keys, n, maps = zip(*[known[c] for c in who], strict=True) if who else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(who, pa.string()), pa.array(keys, longs), pa.array(n, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "th", "c", "keys", "n", "map"])

    every = materialize(base.mapInArrow(emit, "doc_id long, th long, c string, keys array<long>, n int, map binary"), "path_docs")
    classes = materialize(every.groupBy("c").agg(F.min(F.struct("doc_id", "th")).alias("rep"), *[F.first(x).alias(x) for x in ("keys", "n", "map")]), "path_classes")
    reps = classes.select("c", "rep.doc_id", "rep.th")

    def sized(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "node")

    def below(batches):
        """For each text and bucket of it, what it samples on."""
        again = np.arange(AGAIN, dtype=np.uint64)
        for b in (x for whole in batches for x in slices(whole)):
            cols: list[list] = [[], [], [], []]
            for c, text, nodes in zip(b.column("c").to_pylist(), b.column("text").to_pylist(), b.column("nodes").to_pylist(), strict=True):
                parents = np.array([x["node"] for x in nodes], np.int64)
                seeds = mix(parents.view(np.uint64)[:, None], again[None, :], 78).ravel()
                keys, under = children(shingles(text), seeds, threshold)
                sizes = np.array([x["size"] for x in nodes], np.int64)
                for k, x in enumerate(([c] * len(keys), keys.tolist(), parents[under // AGAIN].tolist(), sizes[under // AGAIN].tolist())):
                    cols[k] += x
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["c", "node", "parent", "parent_size"])

    def sampled_on(rows: DataFrame, name: str) -> DataFrame:
        """c, node, parent, parent_size: what the texts (c) of the buckets (node, size) of rows sample on under each."""
        want = materialize(rows.join(reps, "c").groupBy("doc_id", "th", "c").agg(F.collect_list(F.struct("node", "size")).alias("nodes")), "path_asked")
        on = same(sieved(base, want).hint("merge"), want).select("c", "text", "nodes").mapInArrow(below, "c string, node long, parent long, parent_size long").distinct()
        return materialize(on, name)

    first = materialize(sized(classes.select("c", F.explode("keys").alias("node")).distinct()), "path_nodes")
    terminal, large = [first.filter(F.col("size") <= limit)], first.filter(F.col("size") > limit)
    for _ in range(LEVELS - 1):
        if large.isEmpty():
            break
        # whether a bucket divides is told by some of its texts: those of a dense one are compared block by block, so all the others need not sample
        some = large.filter(F.pmod(F.xxhash64("node", "c"), F.col("size")) < PROBE).select("c", "node")
        on = sampled_on(sized(some), "path_probes")
        counts = on.groupBy("node", "parent", "parent_size").agg(F.count("*").alias("size"))
        # a text's next buckets hold size rows each, so the mean over texts weighs each bucket by its size
        dense = materialize(counts.groupBy("parent").agg((F.sum(F.col("size") * F.col("size")) / F.sum("size") / F.first("parent_size")).alias("share")).filter(F.col("share") >= DENSE).select("parent"), "path_dense")
        terminal.append(large.join(dense.select(F.col("parent").alias("node")), "node", "left_semi"))
        on = sampled_on(large.join(dense.select(F.col("parent").alias("node")), "node", "left_anti"), "path_children")
        split = materialize(sized(on.select("c", "node")), "path_nodes")
        terminal.append(split.filter(F.col("size") <= limit))
        large = split.filter(F.col("size") > limit)
    nodes = large
    for x in terminal:
        nodes = nodes.unionByName(x)
    lists = nodes.groupBy("c").agg(F.array_sort(F.collect_set(F.struct("node", "size"))).alias("nodes")).join(classes.select("c", "n", "map"), "c")
    # a text's bucket with the earlier ones; a large bucket's blocks are dealt to every pair of blocks
    here = lists.select("c", "n", "map", "nodes", F.explode("nodes").alias("at")).select(
        "c", "n", "map", F.col("at.node").alias("node"), F.col("at.size").alias("size"), F.transform(F.filter("nodes", lambda x: x["node"] < F.col("at.node")), lambda x: x["node"]).alias("earlier"))
    blocks = F.ceil(F.col("size") / limit).cast("int")
    here = here.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    here = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = here.select("c", "n", "map", "node", "earlier", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), F.when(F.col("block") == F.col("other"), 2).otherwise(F.when(F.col("block") < F.col("other"), 0).otherwise(1)).alias("side"))

    def useful(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        return pdf[with_partner(pdf, threshold)][["c", "n", "node", "b0", "b1", "side", "earlier"]]

    kept = _dealt(here, nodes.count() // 20_000 + 1).applyInPandas(useful, "c string, n int, node long, b0 int, b1 int, side int, earlier array<long>")
    wanted = materialize(kept.join(reps, "c"), "path_wanted")
    want = wanted.groupBy("doc_id", "th", "c").agg(F.collect_list(F.struct("node", "b0", "b1", "side", "earlier")).alias("want"))
    schema = pa.schema([("node", pa.int64()), ("b0", pa.int32()), ("b1", pa.int32()), ("side", pa.int32()), ("earlier", longs), ("c", pa.string()), ("own", pa.binary())])

    def sets(batches):
        """A row for each bucket that a text is wanted in: a text's set may go out many times, so batches are closed by their bytes."""
        rows, held = [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for b in (x for whole in batches for x in slices(whole)):
            for c, text, want in zip(b.column("c").to_pylist(), b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
                own = shingles(text).tobytes()
                for w in want:
                    rows.append((w["node"], w["b0"], w["b1"], w["side"], w["earlier"], c, own))
                    held += len(own) + 8 * len(w["earlier"])
                    if held >= BATCH:
                        yield close()
                        rows, held = [], 0
        if rows:
            yield close()

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        return linked(pdf.drop_duplicates(order).sort_values(order, kind="stable", ignore_index=True), threshold)  # a repeated row brings its set twice

    dealt = same(sieved(base, wanted).hint("merge"), want).select("c", "text", "want").mapInArrow(sets, "node long, b0 int, b1 int, side int, earlier array<long>, c string, own binary")
    facts = wanted.agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).first()
    groups = max(facts["rows"] // 1000, (facts["shingles"] or 0) // POSTINGS) + 1
    found = materialize(_dealt(dealt, groups).applyInPandas(verify, "c string, links long, peer string"), "path_links")
    links = found.groupBy("c").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("c").alias("a"), F.col("peer").alias("b")))
    out = every.select("doc_id", "th", "c").join(links, "c", "left").join(roots.withColumnRenamed("v", "c"), "c", "left")
    return out.select("doc_id", "th", F.col("c").alias("text_class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """doc_id, th, class_id, n_links, first: class_id is the least doc_id of the group (equal and linked texts; null only if
    all are null), first marks the group's document that stays: the least (doc_id, text hash), null ids last."""
    texts = materialize(similar_texts(docs, threshold, recall).withColumn("g", F.coalesce("root", "text_class")), "near_texts")
    least = texts.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least"))
    out = texts.join(least, "g")
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    return out.select("doc_id", "th", F.col("least.doc_id").alias("class_id"), "n_links", first.alias("first"))
