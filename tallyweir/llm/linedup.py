"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words, laid out on a circle in one order for all lines: the longest first, as long words tend to be rare, then by
hash. Its keys are the pairs of words that stand next to each other there. Of two lines that reach the Jaccard threshold, a word that only
one has breaks two pairs of that line and one of the other's at most, so how many pairs of a line can be broken is bounded by its size. The
first pairs of both lines, one more than that, hold a common one: the first pair that both lines have. Two unrelated lines seldom share
a pair of long words, so what meets grows far less with the corpus than lines that share a word do. Any order gives the same result.

What meets has to be close in length and in a parity map of the words, which bounds from below by how many words two lines differ;
the rest is verified on all words. Equal sets are joined once. A line goes if any earlier line (lower doc_id, then line
number) reaches the threshold with it, whether or not that one goes too. So lines are first held against the earliest line of a few of
their pairs, which settles most lines of large groups; only those still open meet all earlier lines.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, drop_table, key_of, keyed, materialize, same, sieved

#: Keys of a line by which it is first held against an earliest line.
FIRST = 2
#: Rounds in which the keys of all lines are joined, each over its share of the keys: only one round's postings are on disk at a time.
PARTS = 2
#: Words from which a line has a map of 128 bits.
LONG = 100


def split_words(line: Column) -> Column:
    """Words and empty strings. Most lines hold no white space but single spaces; Java splits these without a pattern."""
    return F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, SPACES)).otherwise(F.split(line, " "))


def words_of(line: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(split_words(line), lambda w: F.when(w != "", F.xxhash64(w)))))


def codes_of(line: Column) -> Column:
    """The distinct words of a line as ascending longs: 8 bits that fall with the length, then 55 bits of hash."""

    def code(w: Column) -> Column:
        return F.shiftleft((F.lit(255) - F.least(F.octet_length(w), F.lit(255))).cast("long"), 55).bitwiseOR(F.shiftrightunsigned(F.xxhash64(w), 9))

    return F.sort_array(F.array_distinct(F.array_remove(F.transform(split_words(line), code), code(F.lit("")))))


def key_words(codes: Column, threshold: float) -> tuple[Column, Column]:
    """The two words of each key; two lines of more words than one that reach the threshold share a key. See the module text.

    Up to a threshold of 0.5 all pairs may be broken, and the words themselves are taken.
    """
    n = F.size(codes)
    if threshold <= 0.5:
        rarest = F.slice(codes, F.lit(1), prefix_size(n, threshold))
        return rarest, rarest
    most = F.floor(n * (2 * (1 - threshold)) + 1e-9).cast("int") + 1
    return F.slice(codes, F.lit(1), most), F.slice(F.concat(F.slice(codes, F.lit(2), most), F.slice(codes, F.lit(1), F.lit(1))), F.lit(1), most)


def parity_map(codes: Column, half: bool = False) -> Column:
    """64 bits, each the parity of the number of codes that fall on it: maps of two sets differ in no more bits than the sets in codes. half: of every other code."""
    one = F.lit(1).cast("long")

    def bit(x: Column) -> Column:
        return F.call_function("shiftleft", F.shiftrightunsigned(x, 6).bitwiseAND(one) if half else one, x.bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate(codes, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x)))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, th, line_no (from 0), line of keyed documents."""
    return docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_sets(lines: DataFrame, threshold: float) -> DataFrame:
    """doc_id, th, line_no, k1 and k2 (digest of the word set), n (its size), bits (parity map), more (the map of every other word, of long
    lines, else 0), keys: hashes of key_words(); null where only an equal set reaches the threshold."""
    sets = lines.select("doc_id", "th", "line_no", codes_of(F.col("line")).alias("codes"))
    codes, n = F.col("codes"), F.size("codes")
    least = math.floor(1 / (1 - threshold) - 1e-9) if threshold < 1 else 2**31 - 1
    more = F.when(n >= LONG, parity_map(codes, half=True)).otherwise(F.lit(0).cast("long"))
    # columns of their own, used twice below: Spark cuts arrays slowly within the arguments of zip_with()
    one, other = key_words(codes, threshold)
    cut = sets.select("*", one.alias("one"), other.alias("other"))
    keys = F.when((n >= least) & (F.size("one") == F.size("other")), F.zip_with("one", "other", lambda x, y: F.hash(x, y)))
    return cut.select("doc_id", "th", "line_no", F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit(1), "codes").alias("k2"), n.alias("n"), parity_map(codes).alias("bits"), more.alias("more"), keys.alias("keys"))


def prefix_size(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * threshold - 1e-9).cast("int") + 1


#: Columns of a posting besides its key: the line (doc_id, line number, hash), its size (negative if it is settled) and maps.
POST = ("d", "l", "t", "n", "bits", "more")


def at(p: str) -> Column:
    return F.struct(F.col(f"{p}d").alias("doc_id"), F.col(f"{p}l").alias("line_no"), F.col(f"{p}t").alias("th"))


def posts_of(classes: DataFrame, keys: Column) -> DataFrame:
    return classes.select(F.col("at.doc_id").alias("d"), F.col("at.line_no").alias("l"), F.col("at.th").alias("t"), "n", "bits", "more", F.explode(keys).alias("key"))


def may_match(threshold: float) -> Column:
    """For postings a.* and b.* of two lines: a is earlier, b is open, and sizes and maps allow the threshold."""
    na, nb = F.abs("an"), F.abs("bn")
    close = F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9
    most = (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9
    differ, other = F.col("abits").bitwiseXOR(F.col("bbits")), F.col("amore").bitwiseXOR(F.col("bmore"))
    both = (na >= LONG) & (nb >= LONG)
    few = (F.bit_count(differ) <= most) & (~both | (F.bit_count(other) + F.bit_count(differ.bitwiseXOR(other)) <= most))
    # written with both sides, so that it is no filter of one side: both read one shuffle
    open_ = na * F.col("bn") > 0
    return open_ & close & few & (at("a") < at("b"))


def held_against_earliest(posts: DataFrame, threshold: float) -> DataFrame:
    """a and b: each line with the earliest line that has a key of it, if they may match."""
    first = F.first(F.struct(*[F.col(c).alias("a" + c) for c in POST])).over(Window.partitionBy("key").orderBy("d", "l", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = posts.withColumn("first", first).select("first.*", *[F.col(c).alias("b" + c) for c in POST])
    return met.filter(may_match(threshold)).select(at("a").alias("a"), at("b").alias("b"))


def met_pairs(posts: DataFrame, threshold: float) -> DataFrame:
    """a and b: all open lines with all earlier lines that have a key of them, if they may match."""
    a, b = (posts.select("key", *[F.col(c).alias(p + c) for c in POST]) for p in "ab")
    return a.join(b, "key").filter(may_match(threshold)).select(at("a").alias("a"), at("b").alias("b"))


def counted(pairs: DataFrame) -> DataFrame:
    """a, b and found: by how many keys they met."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("found"))


def marked(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """classes, with n negative where at is among settled. Only lines that a bitmap does not tell apart from settled ones are shuffled."""
    keys, lines = ("doc_id", "th", "line_no"), classes.select("at.*", "n", "bits", "more", "keys")
    found = settled.select("at.*")
    maybe = same(sieved(lines, found, keys), found.withColumn("near", F.lit(True)), "left", keys)
    known = maybe.withColumn("n", F.when(F.col("near"), -F.col("n")).otherwise(F.col("n"))).drop("near")
    return sieved(lines, found, keys, "left_anti").unionByName(known).withColumn("at", F.struct("doc_id", "line_no", "th"))


def near_lines(docs: DataFrame, threshold: float = 0.8, th: Column | None = None) -> DataFrame:
    """doc_id, th, line_no of every line to remove; th as key_of() gives it. Lines without words stay. See the module text."""
    own = keyed(docs, th=key_of(docs) if th is None else th)
    slim = materialize(line_sets(lines_of(own), threshold), "line_sets")
    worded = slim.filter("n > 0")

    first = F.min(F.struct("doc_id", "line_no", "th"))
    classes = materialize(worded.groupBy("k1", "k2").agg(first.alias("at"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("n", "bits", "more", "keys")]), "line_classes")
    members = materialize(worded.select("k1", "k2", "doc_id", "th", "line_no"), "line_members")
    drop_table(slim)

    few = posts_of(classes, F.slice("keys", 1, FIRST))
    settled = _verified(own, counted(held_against_earliest(few, threshold)), threshold)
    posts = posts_of(marked(classes, settled), F.col("keys"))
    parts = []
    for k in range(PARTS):
        own.sparkSession._jvm.System.gc()  # lets the shuffle files of the part before go, see materialize()
        parts.append(materialize(counted(met_pairs(posts.filter(F.pmod("key", F.lit(PARTS)) == k), threshold)), "line_part"))
    pairs = functools.reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.sum("found").alias("found"))
    near = settled.unionByName(_verified(own, pairs, threshold, likeliest_first=True))

    copied = classes.filter("times > 1").select("k1", "k2", "at").join(near.withColumn("near", F.lit(True)), "at", "left")
    copies = sieved(members, copied, ("k1", "k2")).join(copied, ["k1", "k2"]).filter(F.col("near").isNotNull() | ~F.struct("doc_id", "line_no", "th").eqNullSafe(F.col("at")))
    out = materialize(near.select("at.doc_id", "at.th", "at.line_no").unionByName(copies.select("doc_id", "th", "line_no")).distinct(), "line_gone")
    for t in (members, classes, *parts):
        drop_table(t)
    return out


def _verified(own: DataFrame, pairs: DataFrame, threshold: float, likeliest_first: bool = False) -> DataFrame:
    """at: those b of pairs (a, b, found) of lines (doc_id, line_no, th) whose words, as 64-bit hashes, reach the threshold with their a's.

    likeliest_first: each b is held against the a that it shares most keys with, and only against its other a's if that fails."""
    pairs = materialize(pairs, "line_pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct().groupBy("at.doc_id", "at.th").agg(F.collect_set("at.line_no").alias("line_nos"))
    wanted = materialize(wanted, "line_wanted")
    texts = same(sieved(own, wanted), wanted)
    # explode() of one array keeps the optimizer from splitting the text anew for each line
    split = texts.select("doc_id", "th", "line_nos", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    picked = split.select("doc_id", "th", F.explode(F.transform("line_nos", lambda k: F.struct(k.alias("line_no"), F.get("lines", k).alias("line")))).alias("x"))
    words = picked.select(F.struct("doc_id", "x.line_no", "th").alias("at"), words_of(F.col("x.line")).alias("w"))
    words = words.dropDuplicates(["at"])  # rows may repeat a document
    words = materialize(words, "line_words")

    def reach(some: DataFrame) -> DataFrame:
        both = some.join(words.select(F.col("at").alias("a"), F.col("w").alias("aw")), "a").join(words.select(F.col("at").alias("b"), F.col("w").alias("bw")), "b")
        shared = F.size(F.array_intersect("aw", "bw"))
        return materialize(both.filter(shared >= (F.size("aw") + F.size("bw") - shared) * threshold - 1e-9).select(F.col("b").alias("at")).distinct(), "line_near")

    if likeliest_first:
        out = reach(pairs.groupBy("b").agg(F.max_by("a", "found").alias("a")))
        out = out.unionByName(reach(pairs.join(out.withColumnRenamed("at", "b"), "b", "left_anti")))
    else:
        out = reach(pairs)
    for t in (pairs, words):
        drop_table(t)
    return out


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs, columns unchanged, with near-duplicate later lines taken out of text (n_chars is not recomputed).

    Null texts stay null. Rows that repeat doc_id and text are one document here, so its lines do not remove
    themselves: each such row keeps the same lines. Empty table: empty result.
    """
    th = key_of(docs)
    gone = near_lines(docs, threshold, th).groupBy(F.col("doc_id").alias("__tw_id"), F.col("th").alias("__tw_th")).agg(F.collect_set("line_no").alias("__tw_gone"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_id")) & (th == F.col("__tw_th"))
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__tw_gone", i)), "\n")
    text = F.when(F.col("__tw_gone").isNull(), F.col("text")).otherwise(left)
    return docs.join(gone, on, "left").withColumn("text", text).drop("__tw_id", "__tw_th", "__tw_gone")


def line_counts(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, ascending): a row per input row."""
    th = key_of(docs)
    gone = near_lines(docs, threshold, th).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    own = keyed(docs, th=th).select("doc_id", "th", n_lines.alias("n_lines"))
    out = same(own, gone, "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
