"""The scheduling of shards, the Merkle manifest and the filter audit against plain versions."""

import hashlib
import heapq
import re
import zlib
from itertools import permutations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweir.llm import filteraudit, merkle, sharding
from tallyweir.llm.oracles import ORACLES
from tallyweir.llm.queries import QUERIES
from tallyweir.sources.numbering import numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, no int, __tw_source string, `a.b` map<string,int>"
LONG = "Straße und Fluss & " * 60_000


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, one hot source and one hot text."""
    rows = [(i, f"text number {i % 37} " + "Wort " * (i % 150), ["en", "de", None, ""][i % 4], "hot" if i % 3 else f"s{i % 5}", i) for i in range(300)]
    rows += [(1000 + i, "copied over and over", "en", "hot", 20) for i in range(90)]
    rows += [(7, "text number 7 ", None, None, None), (7, "text number 7 ", None, None, None), (7, "another text", "en", "s1", 3)]
    rows += [(None, None, None, None, None), (None, "", "de", "s1", 0), (None, "copied over and over", "fr", "hot", 20), (5000, None, "en", None, 1), (5001, "", "en", "lonely", 0)]
    rows += [(6000, LONG, "de", "s2", len(LONG)), (6001, LONG, "de", "s2", len(LONG)), (6002, LONG + "#", "de", "ß", 1), (6003, "ABC DEF #", "de", "Ä", 9)]
    return [(*r, "x", 1, "y", {"k": 1}) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(5)


def plain(rows):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=False)) for r in rows]


# --- sharding -------------------------------------------------------------------------------------------------------


def heap_schedule(sizes, shards):
    heap, out = [(0, s) for s in range(shards)], []
    for size in sizes:
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        out.append(s)
    return out, heap


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 90)), max_size=12, unique_by=lambda x: x[0]), st.integers(1, 7))
def test_rounds_deal_as_the_heap_does(sizes, shards):
    sizes = sorted(sizes, reverse=True)
    want, loads = heap_schedule([s for s, c in sizes for _ in range(c)], shards)
    heap, got = [(0, s) for s in range(shards)], []
    for size, count in sizes:
        for n, turn in sharding.rounds(heap, size, count):
            got += [turn[i % len(turn)] for i in range(n)]
    assert got == want and sorted(heap) == sorted(loads)


def test_a_size_that_very_many_groups_have_is_dealt_at_once():
    heap = [(10**12, 0), *[(i, i) for i in range(1, 24)]]
    runs = list(sharding.rounds(heap, 10, 10**10))
    assert len(runs) < 60 and sum(n for n, _ in runs) == 10**10 and max(heap)[0] - min(heap)[0] <= 10**12


@pytest.mark.parametrize("shards", [1, 24])
def test_shards_of_odd_rows(odd, shards):
    """Groups go where the plain heap puts them, each shard is numbered without gaps in the order of doc_id, and every row is there."""
    got = sharding.shard_documents(odd, shards).collect()
    rows = plain(odd_rows())
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r)
    size = lambda t: len(t.encode()) + 8
    first = lambda rs: min((r["doc_id"] for r in rs if r["doc_id"] is not None), default=10**9)
    order = sorted(groups, key=lambda t: (-size(t) * len(groups[t]), first(groups[t])))
    own = dict(zip(order, heap_schedule([size(t) * len(groups[t]) for t in order], shards)[0], strict=True))
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], size(r["text"] or ""), zlib.crc32((r["text"] or "").encode()), own[r["text"] or ""]) for r in rows)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g["size"], g.text_crc32, g.shard) for g in got) == want
    for s in {g.shard for g in got}:
        mine = sorted((g.slot, 10**9 if g.doc_id is None else g.doc_id) for g in got if g.shard == s)
        assert [k for k, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)


def test_written_shards_keep_rows_and_groups(spark, odd, tmp_path):
    docs = odd.drop("shard")
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == docs.count() and back.groupBy(F.coalesce("text", F.lit(""))).agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()
    with pytest.raises(ValueError):
        sharding.write_shards(odd, f"file://{tmp_path}/other", 4)


def test_groups_by_another_key(odd):
    got = sharding.shard_documents(odd, 3, F.xxhash64("source")).join(odd.select("doc_id", "source").distinct(), "doc_id")
    assert got.filter("doc_id > 1000").groupBy("source").agg(F.count_distinct("shard").alias("n")).filter("n > 1").isEmpty()


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("a.b")).repartition(6)
    got = numbered(df, F.desc("k"), F.col("`a.b`"))
    assert got.columns == ["k", "a.b", "no"]
    rows = sorted(got.collect(), key=lambda r: r.no)
    assert [r.no for r in rows] == list(range(1000)) and [(-r.k, r["a.b"]) for r in rows] == sorted((-r.k, r["a.b"]) for r in rows)
    assert numbered(df.limit(0), "k").count() == 0


# --- the manifest ---------------------------------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(d, text):
    return sha("".join(plain_field(d[c]) for c in ("doc_id", "source", "lang", "n_chars")) + plain_field(text))


def plain_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_way(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return out


def plain_manifest(docs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append((d, plain_leaf(d, d["text"])))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    levels = {s: plain_levels([leaf for _, leaf in by[s]]) for s in sources}
    top = plain_levels([levels[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (d, leaf) in enumerate(by[s]):
            way, folded = plain_way(levels[s], i) + plain_way(top, k), leaf
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0:
                folded = plain_leaf(d, d["text"] and d["text"].translate(low))
            for left, right in way:
                folded = sha(left + folded + right)
            out.append((d["doc_id"], leaf, levels[s][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_of_odd_rows(odd):
    assert sorted(map(tuple, merkle.manifest(odd).collect()), key=repr) == plain_manifest(plain(odd_rows()))


@pytest.mark.parametrize("n", [0, 1, 2, 17])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "Some Text", "en", "a", i) for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(plain(rows))


def test_manifest_of_many_sources_and_high_trees(spark):
    """Sources of 1 to 5,000 rows and 300 sources: trees of unequal heights meet in one."""
    rows = [(i, f"t{i}", "en", f"s{i % 300}", i) for i in range(600)] + [(10_000 + i, f"u{i}", "en", "tall", i) for i in range(5000)] + [(9_999, "alone", "en", "alone", 1)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(plain(rows))


def test_kept_proofs_find_a_changed_row(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    keyed = docs.select(F.col("doc_id").alias("rid"), "doc_id", "source", merkle.row_digest().alias("leaf"))
    tree = merkle.build(keyed, F.col("source"), F.col("doc_id"))
    kept = merkle.proofs(tree, "doc_id")
    changed = docs.withColumn("n_chars", F.when(F.col("doc_id") == 41, -1).otherwise(F.col("n_chars"))).unionByName(spark.createDataFrame([(500, "new", "en", "s1", 1)], docs.schema))
    assert {r.doc_id for r in merkle.verify(changed, kept, tree.root).filter("not verified").collect()} == {41, 500}


# --- the audit ------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    least, marks, parts = {}, {}, {}
    for d in docs:
        if d["doc_id"] is not None:
            least[d["text"] or ""] = min(least.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    for i, quality, toxic in (x for x in labels if x[0] is not None):
        good, bad = marks.get(i, (0, 0))
        marks[i] = (good or int(quality == 1), bad or int(toxic == 1))
    for d in docs:
        text = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text), d["doc_id"] is not None and d["doc_id"] > least.get(text, 0)), strict=True) if x}
        parts.setdefault(d["lang"] or "", []).append((fails, *marks.get(d["doc_id"], (0, 0))))
    out = []
    for part, rows in parts.items():
        made, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                total[f] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*m, total[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 1200, 2)] + [(4, None, 1), (None, 1, 1), (1002, 1, None)]


@pytest.mark.parametrize("sizes", [{}, {"trie_bytes": 2000, "trie_docs": 20, "separator_bytes": 300}])
def test_audit_of_odd_rows(spark, odd, sizes):
    """The second case empties tries often: every text with copies is in many of them and passes the salted ones."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    masks = filteraudit.masks(odd.withColumnRenamed("lang", "part"), **sizes)
    got = filteraudit.interactions(filteraudit.mask_counts(masks, labels))
    assert sorted(map(tuple, got.collect())) == plain_audit(plain(odd_rows()), LABELS)


def test_audit_of_nothing(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(odd.limit(0), labels).collect() == []
    assert filteraudit.audit(odd.filter("doc_id = 1"), labels).count() == 600


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=40))
def test_trie_walks_in_order(keys):
    trie = filteraudit.RadixTrie()
    own = {}
    for k in keys:
        t = trie.insert(k)
        assert own.setdefault(k, t) == t
    walked = list(trie.walk())
    assert [k for k, _, _ in walked] == sorted(own) and all(own[k] == t for k, t, _ in walked) and trie.terminals == len(own)
    before = b""
    for k, _, same in walked:
        assert same == filteraudit.shared(before, k)
        before = k


def test_trie_of_very_long_texts_that_differ_late():
    trie = filteraudit.RadixTrie()
    base = LONG.encode()
    assert [trie.insert(base + bytes([c])) for c in (1, 2, 1, 3, 2)] == [0, 1, 0, 2, 1] and trie.insert(base) == 3 and trie.insert(base[:-5]) == 4


# --- the registered queries -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_sharding", "op12_merkle_manifest", "op13_filter_audit"])
def test_registered_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
