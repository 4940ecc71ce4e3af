"""SimHash document fingerprints and a permuted-table Hamming search, in DataFrame functions only.

A text's terms are its runs of five words (a shorter text is one term), each weighing as often as it occurs. A term's
64-bit hash votes on 64 signed bits; the fingerprint keeps the bits with more ayes than noes. Votes are counted
two bits to a long, so 32 sums in generated code do for 64 bits.

The search splits fingerprints into radius + 3 blocks. Two within the radius agree on three blocks at least,
so one table per choice of three blocks, keyed by their bits, brings every such pair together.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, keyed, materialize, partitions

SHINGLE = 5
LANES = 0x0000000100000001
KEPT = 3



def votes(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp, the 64-bit fingerprint of each group's text; 0 where there is no term. Equal rows change nothing."""
    words = F.array_remove(F.split(F.col(text), SPACES), "")
    w = df.select(*keys, words.alias("__w"))
    n = F.greatest(F.size("__w") - (SHINGLE - 1), F.least(F.size("__w"), F.lit(1)))
    zipped = F.arrays_zip(*[F.slice("__w", F.lit(k + 1), n).alias(f"w{k}") for k in range(SHINGLE)])
    g = w.select(*keys, F.explode_outer(zipped).alias("__g"))
    h = g.select(*keys, F.when(F.col("__g").isNotNull(), F.xxhash64(*[F.col("__g")[f"w{k}"] for k in range(SHINGLE)])).alias("__h"))
    ayes = [F.sum(F.shiftrightunsigned("__h", k).bitwiseAND(F.lit(LANES))).alias(f"__s{k}") for k in range(32)]
    counted = h.groupBy(*keys).agg(F.count("__h").alias("__n"), *ayes)

    def bit(k: int) -> Column:
        s = F.col(f"__s{k % 32}")
        own = s.bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(s, 32)
        return F.when(2 * own > F.col("__n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))

    halves = [reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in half]) for half in (range(32), range(32, 64))]
    return counted.select(*keys, *[x.alias(f"__half{i}") for i, x in enumerate(halves)]).select(*keys, F.col("__half0").bitwiseOR(F.col("__half1")).alias("fp"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def ordered(docs: DataFrame) -> DataFrame:
    """Keyed documents with bucket and rn: ranges of falling doc_id (null last), and the place in each.

    The range bounds are approximate quantiles, one for each shuffle partition, so a window over a bucket is a partition.
    Equal ids stand by text hash.
    """
    own = keyed(docs)
    n = partitions(docs.sparkSession)
    bounds = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    above = F.lit(sorted(set(bounds)) or [0]).cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(n + 1)).otherwise(F.size(F.filter(above, lambda x: x > F.col("doc_id"))))
    return own.withColumn("bucket", bucket.cast("int")).withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("th").desc())))


def linked(heads: DataFrame) -> DataFrame:
    """p, then: for each bucket the head of the next bucket, after the last that of the first. A row per bucket."""
    parts = Window.orderBy("bucket")
    return heads.select(F.col("bucket").alias("p"), F.coalesce(F.lead("head").over(parts), F.first("head").over(parts)).alias("then"))


def near_counts(fingerprints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """fp, n_near: for each distinct fp of queries, the rows of fingerprints (fp) other than itself within radius bits.

    Exact for any radius from 0 to 60. Rows with equal fingerprints are joined once, with their count. A query's
    own row counts as itself, so n_near is the number of rows within the radius less one. Null fp: left out.
    """
    blocks = radius + KEPT
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in c) for c in combinations(range(blocks), KEPT)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])
        return df.withColumn("__e", F.explode(keys)).select(F.col("__e.t").alias("t"), F.col("__e.k").alias("k"), F.col("fp").alias(name), *[c for c in df.columns if c != "fp"])

    every = fingerprints.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("rows"))
    asked = queries.filter("fp is not null").select("fp").distinct()
    pairs = tables(asked, "q").join(tables(every, "fp"), ["t", "k"]).filter(F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius)
    first = F.coalesce(*[F.when(F.col("q").bitwiseXOR(F.col("fp")).bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(signed)])
    return pairs.filter(F.col("t") == first).groupBy(F.col("q").alias("fp")).agg((F.sum("rows") - 1).alias("n_near"))


def near_pairs(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """fp_a < fp_b, distance: all pairs of distinct fingerprints (fp) within radius bits, each once."""
    blocks = radius + KEPT
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in c) for c in combinations(range(blocks), KEPT)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])
    rows = fingerprints.filter("fp is not null").select("fp").distinct().withColumn("e", F.explode(keys)).select("fp", "e.t", "e.k")
    differ = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(signed)])
    pairs = rows.withColumnRenamed("fp", "fp_a").join(rows.withColumnRenamed("fp", "fp_b"), ["t", "k"]).filter("fp_a < fp_b")
    return pairs.withColumn("distance", F.bit_count(differ)).filter((F.col("distance") <= radius) & (F.col("t") == first)).select("fp_a", "fp_b", "distance")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp per document. Null text: empty; an empty text has fp 0. Rows equal in doc_id and text are one."""
    return votes(keyed(docs), ["doc_id", "th"])


def edited_likeness(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of whole texts and of texts whose last third is taken from the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near. The next
    document is the next lower doc_id (equal ids by text hash, null ids last; after the last, the first). n_near, for
    doc_ids divisible by 100, counts the other documents within radius bits, else null. Null text: empty. A row
    for each input row; rows equal in doc_id and text follow each other.
    """
    rows = ordered(docs)
    inside = Window.partitionBy("bucket").orderBy("rn")
    firsts = keyed_first(rows)
    ahead = rows.withColumn("next", F.lead("text").over(inside)).join(linked(firsts), F.col("bucket") == F.col("p"), "left")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("next", "then"), F.lit(1), third))
    kinds = ahead.select("bucket", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited")).select(
        "bucket", "rn", "doc_id", "n_chars", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"), F.lit("").alias("sha")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"), F.sha2("edited", 256).alias("sha")))).alias("x"))
    keys = ["bucket", "rn", "doc_id", "n_chars", "kind", "sha"]
    fps = votes(kinds.select("bucket", "rn", "doc_id", "n_chars", "x.kind", "x.sha", F.col("x.t").alias("text")), keys)
    # everything up to here, and this, is grouped by bucket: one shuffle
    both = fps.groupBy("bucket", "rn", "doc_id", "n_chars").agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("efp"), F.max("sha").alias("edited_sha256"))
    known = materialize(both, "simhash_fp")
    heads = known.groupBy("bucket").agg(F.min_by("fp", "rn").alias("head"))
    out = known.withColumn("nfp", F.lead("fp").over(inside)).join(linked(heads), F.col("bucket") == F.col("p")).withColumn("nfp", F.coalesce("nfp", "then"))
    near = near_counts(known, known.filter("doc_id % 100 = 0"), radius).withColumnsRenamed({"fp": "qfp"})
    out = out.join(near, (F.col("fp") == F.col("qfp")) & (F.col("doc_id") % 100 == 0), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("efp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"), "n_near")


def keyed_first(rows: DataFrame) -> DataFrame:
    """bucket, head: the text that stands first in each bucket."""
    return rows.groupBy("bucket").agg(F.min_by("text", "rn").alias("head"))
