"""Each corpus operator against a plain version, on small tables that hold nulls, copies, ties and very long texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweir.llm import chosenpath, decontam, langid, linedup, mixing, pii, recompression, simhash, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, weight double, k int"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = prose(180)
SHARED = prose(60)
TEXTS = [BASE, BASE, BASE.replace(BASE.split()[90], "changed", 1), prose(150) + " " + SHARED + "\n" + prose(40), prose(20) + "\n" + SHARED + " " + prose(80), "", None, "a " * 400, "one two three", "x" * 900, prose(3000), "ñandú 日本 語 " + prose(50), SHARED, "same line here now\n" * 3 + "tail of it"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, None, "clash", 1.0, 1) for i, t in enumerate(TEXTS)]
    rows += [(None, prose(60), "en", "s1", 3, "clash", 1.0, 1), (3, TEXTS[3], "en", "s1", 3, "clash", 1.0, 1), (4, prose(70), "en", "s1", 3, "clash", 1.0, 1)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def repeated(seqs, width):
    """For each sequence, flags of what is covered by windows that occur more than once."""
    count = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        flags = [False] * len(s)
        for i in range(len(s) - width + 1):
            if count[tuple(s[i : i + width])] > 1:
                flags[i : i + width] = [True] * width
        out.append(flags)
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(docs, plain, hot):
    seqs = [t.encode() for _, t in plain]
    want = []
    for (i, _), s, f in zip(plain, seqs, repeated(seqs, 200), strict=True):
        want.append((i, len(s), sum(f), sum(1 for k in range(len(s)) if f[k] and (not k or not f[k - 1])), hashlib.sha256(bytes(x for x, y in zip(s, f, strict=True) if not y)).hexdigest()))
    got = [tuple(r) for r in suffix.dedup_bytes(docs, replace(suffix.METHOD, hot=hot)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [4096, 1])
def test_recompression(docs, plain, hot):
    seqs = [t.encode().split() for _, t in plain]
    want = [(i, len(s), sum(f), hashlib.sha256(b" ".join(x for x, y in zip(s, f, strict=True) if not y)).hexdigest()) for (i, _), s, f in zip(plain, seqs, repeated(seqs, 35), strict=True)]
    got = [tuple(r) for r in recompression.dedup_words(docs, replace(recompression.METHOD, hot=hot)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix_array_is_sorted():
    for trial in range(60):
        k = (2, 3, 6)[trial % 3]
        s = [rng.randint(1, k) for _ in range(rng.randint(1, 80))] + [0]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix.suffix_array(np.array(s, np.int32), k + 1).tolist() == want
        assert suffix.suffix_array(np.array(s, np.int32), suffix.SMALL_ALPHABET + 1).tolist() == want  # the scanning form


@pytest.mark.parametrize("limit", [512, 2])
def test_chosen_path(docs, plain, limit):
    texts = sorted({t for _, t in plain})

    def shingles(t):
        w = t.encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {t: shingles(t) for t in texts}
    links = {t: sum(1 for u in texts if u != t and sets[t] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])) for t in texts}
    got = chosenpath.similar_texts(docs, limit=limit).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((i, links[t]) for i, t in plain)
    near = {(r.doc_id, r.class_id) for r in chosenpath.near_duplicates(docs).collect()}
    assert {(0, 0), (1, 0), (2, 0), (12, 12)} <= near
    first = [r.doc_id for r in chosenpath.near_duplicates(docs).filter("first").collect()]
    assert 0 in first and not {1, 2} & set(first) and None in first


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("x", "y"), ("z", "y"), ("q", "q")], "a string, b string")
    assert {(r.v, r.root) for r in chosenpath.components(edges).collect()} == {(v, "a") for v in "abcd"} | {(v, "x") for v in "xyz"}


def test_simhash(docs, plain):
    rows = sorted(((i is None, -(i or 0)), t) for i, t in plain)
    got = simhash.edited_likeness(docs).collect()
    assert len(got) == len(plain)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    order = [(None if k[0] else -k[1], t) for k, t in rows]
    for k, (i, t) in enumerate(order):
        if sum(1 for x, _ in order if x == i) == 1 and sum(1 for x, _ in order if x == order[(k + 1) % len(order)][0]) == 1:
            m, nxt = len(t) // 3, order[(k + 1) % len(order)][1]
            assert by[i][0].edited_sha256 == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest() and by[i][0].n_chars == len(t)
    assert by[0][0].fingerprint == by[1][0].fingerprint and 0 <= min(r.near_next for r in got) and max(r.near_edited for r in got) <= 1
    assert by[5][0].fingerprint == "0" * 16


def test_near_fingerprints(spark):
    base = [rng.getrandbits(63) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(63), rng.randint(0, 5))) for b in base for _ in range(4)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}
    assert {(r.fp_a, r.fp_b) for r in simhash.near_pairs(df, 3).collect()} == want
    counts = {r.fp: r.n_near for r in simhash.near_counts(df, df, 3).collect()}
    assert counts == {x: sum(x in p for p in want) for x in fps}


def test_token_round_trip(docs, plain):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = tokens.tokens_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in plain), key=lambda x: (x is not None, x))
    want = Counter((i, tuple(t.encode(x, add_special_tokens=False).ids) + (0,)) for i, x in plain)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    assert [r.start for r in rows] == np.r_[0, np.cumsum([r.n_tokens for r in rows])[:-1]].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_variable_length_codes():
    for v in ([], [0], [255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], list(range(1000))):
        c, d = tokens.encode_ids(np.array(v, np.int64))
        assert tokens.decode_ids(c, d, len(v)).tolist() == v and len(c) == -(-len(v) // 4)


def test_encoder_pieces():
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " a", " a b ", "a  b", "x\ny", "a \nb", "don't stop's", "é!! ü,", "<|endoftext|> a", " ", "...", "x ...", "a1, 2. b3.", "🙂 , a", "a b c", "!a ,b c,,"]
    assert [x.tolist() for x in e.many(odd)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in odd]


def test_language_held_out(spark):
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(60)), lang) for i, (lang, a) in enumerate(list(alphabets.items()) * 100)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 ...", "bb"), (None, rows[0][1], "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, usable=~langid.held_out())
    got = langid.predict(df.withColumn("held", langid.held_out()), model, "doc_id", "lang", "held").collect()
    assert [r.held for r in got if r.doc_id is not None] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got if r.doc_id is not None]
    held = [r for r in got if r.held and r.doc_id < 900]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {"und"} and not any(r.accepted for r in got if r.doc_id in (900, 901, 902))
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_decontamination(spark):
    item = [f"w{k}" for k in range(40)]
    other = [f"v{k}" for k in range(30)]
    df = spark.createDataFrame([(1, "Before, " + " ".join(item) + " after"), (2, " ".join(item[20:] + item[:20])), (3, " ".join(item[:12])), (4, prose(100)), (5, None), (6, ""), (7, " ".join(other).upper() + "!"), (7, " ".join(other).upper() + "!")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other)), (2, None), (3, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.coverage, 3), r.n_tiles) for r in decontam.contamination(df, bench).collect()}
    assert got == {(1, 0): (1.0, 1), (2, 0): (1.0, 2), (7, 1): (1.0, 1)}
    assert decontam.contamination(df, bench.limit(0)).count() == 0


def test_tiling_takes_the_longest_first():
    doc, item = "a b c d e f x a b c d e".split(), "a b c d e f".split()
    seeds = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
    assert decontam.tile(seeds, 3) == [(0, 0, 6)]


def test_mixing(docs, plain):
    mix = mixing.mix_sources(docs, block_words=16, shards=8)
    rows = mixing.taken(mix).collect()
    assert len(rows) == len(plain) and all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes = Counter()
    for d in docs.select("source", "text").collect():
        sizes[d.source] += len((d.text or "").split())
    goal = mixing.targets(dict(sizes))
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(goal[s] <= 2 * sizes[s] + 1e-9 for s in goal)
    took = {r.source: r.w for r in mix.draws.groupBy("source").agg(F.sum("words").alias("w")).collect()}
    assert all(abs(took.get(s, 0) - goal[s]) <= 8 + 1e-9 for s in goal)
    again = mixing.taken(mixing.mix_sources(docs, block_words=16, shards=8)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    draws = mix.draws.collect()
    assert len({(r.rid, r.block, r.copy) for r in draws}) == len(draws) and all(0 <= r.shard < 8 for r in draws)
    assert mixing.taken(mixing.mix_sources(docs.limit(0))).count() == 0


def test_splitting_tree_is_exact():
    quotas = [1000, 3, 0, 77]
    got = mixing.splitting_tree(quotas, 7, 1)
    assert got.sum(axis=0).tolist() == quotas and got.sum(axis=1).max() - got.sum(axis=1).min() <= 3


def test_surrogates(spark):
    texts = ["write to Ann.Lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM.", "call +1 (988) 555-2485 or +1 988-555-2485", "card 4041894974608795 and 4041-8949-7460-8795", "ip 42.144.35.254. key " + "AKIA" + "SJDZWJNP6ZRYWK44", "Frau Anna Klug met Mr. John Doe", "password" + "=7602ad27cf55", None, "", "nothing here 12"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, mention string")
    rows = pii.pseudonymize(df, "k").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and got[6].text is None and got[7].text == "" and got[8].text == texts[8]
    a, b = got[0].text.split()[2], got[0].text.split()[4].rstrip(".")
    assert a.endswith(".example.com") is False or a != "Ann.Lee@mail.example.com"
    assert a.upper() == b and "@" in a and "lee" not in a.lower()
    digits = lambda s: "".join(c for c in s if c.isdigit())
    one, two = got[1].text.removeprefix("call ").split(" or ")
    assert digits(one) == digits(two) != "19885552485" and one[:4] == "+1 ("
    c1, c2 = got[2].text.removeprefix("card ").split(" and ")
    luhn = sum(int(x) if k % 2 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(c1))
    assert digits(c2) == c1 and luhn % 10 == 0 and c1[0] == "4" and c2[4] == "-"
    assert all(0 < int(x) < 256 for x in got[3].text.split()[1].rstrip(".").split(".")) and got[3].text.split()[3].startswith("AKIA") and "SJDZ" not in got[3].text
    assert got[4].text.startswith("Frau ") and " met Mr. " in got[4].text and got[4].text.split()[1] in pii.GIVEN["f", "latin"] and got[4].text.split(" Mr. ")[1].split()[0] in pii.GIVEN["m", "latin"]
    assert got[5].text.startswith("password=") and "7602ad27cf55" not in got[5].text and sum(r.n_entities for r in rows) == 2 + 2 + 2 + 2 + 2 + 2 + 1
    assert pii.pseudonymize(df.limit(0), "k").count() == 0


def test_ibans_of_every_length(spark):
    known = ["NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "MK07250120000058984", "AT611904300234573201", "CH9300762011623852957", "DE89370400440532013000", "GB29NWBK60161331926819", "AE070331234567890123456", "ES9121000418450200051332", "PT50000201231234567890154", "TR330006100519786457841326", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "PL61109010140000071219812874", "BR1800360305000010009795493C1", "MU17BOMM0101101030300200000MUR", "MT84MALT011000012345MTLCAST001S", "LC55HEMM000100010012001200023015", "RU0304452522540817810538091310419"]
    known += ["ZZ12" + "".join(str(k % 10) for k in range(n - 4)) for n in range(15, 35)]
    spaced = [" ".join(x[k : k + 4] for k in range(0, len(x), 4)) for x in known]
    df = spark.createDataFrame([(i, f"pay {a} or {b}, THE END") for i, (a, b) in enumerate(zip(known, spaced, strict=True))] + [(99, "pay ES91 2100 0418 4502 0005 1332 THE END")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    for i, (a, b) in enumerate(zip(known, spaced, strict=True)):
        x, y = got[i].text.removeprefix("pay ").removesuffix(", THE END").split(" or ")
        assert x[:2] == a[:2] and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
        assert got[i].n_entities == 2 and got[i].kinds == ["iban"] and x == y.replace(" ", "") != a and [len(w) for w in y.split()] == [len(w) for w in b.split()]
    assert got[99].text.endswith(" THE END")


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, norm, key, attempt: F.when(attempt == 0, F.lit("10.0.0.1")).otherwise(real(kind, norm, key, attempt)))
    df = spark.createDataFrame([("ip", f"9.9.9.{k}") for k in range(20)] + [("ip", "10.0.0.1")], "kind string, norm string")
    got = pii.surrogates(df, "k").collect()
    assert len(got) == 21 == len({r.made for r in got}) and not {r.made for r in got} & {r.norm for r in got}


@pytest.mark.parametrize(("kind", "norms"), [
    ("family", [f"{a}{b}{c}{d}" for a in "АБВГДЖЗИКЛ" for b in "абвгджзикл" for c in "абвгджзикл" for d in "абвгд"]),
    ("given", [f"f {a}{b} Klug" for a in "ABCDEFGHIJ" for b in "abcdefghij"]),
    ("phone", [f"1{k:04}" for k in range(10_000)]), ("email", [f"{a}@{b}.io" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"])])
def test_more_entities_than_short_surrogates(spark, kind, norms):
    got = pii.surrogates(spark.createDataFrame([(kind, n) for n in norms], "kind string, norm string"), "k").collect()
    assert len(got) == len(norms) == len({r.made for r in got}) and not {r.made for r in got} & set(norms)


def test_people_and_credentials_keep_their_surrogates(spark):
    token, cloud = "ghp_" + "a1B2" * 6, "AKIA" + "SJDZWJNP6ZRYWK44"
    texts = ["Mr. John Doe met Mr. Doe", "Mrs. Anna Klug, Ms. Anna Klug, Frau Klug, Herr Klug, Mrs. Vera Klug", "г-н Иван Котов и г-жа Котов", f"token={token} or {token}. token: '{token}'", f"secret={cloud} or {cloud}", "password=abcdef1. password=abcdef1", "card 4041894974608795 secret=4041894974608795"]
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    got = {r.doc_id: r.text for r in rows}
    john, doe = got[0].removeprefix("Mr. ").split(" met Mr. ")
    assert john.split()[1] == doe != "Doe" and john.split()[0] in pii.GIVEN["m", "latin"]
    one, two, frau, herr, vera = got[1].split(", ")
    assert one.split()[1:] == two.split()[1:] and {x.split()[-1] for x in (one, two, frau, herr, vera)} == {frau.split()[1]} and vera.split()[1] != one.split()[1]
    assert got[2].split()[2] == got[2].split()[5] != "Котов"
    a, b, c = got[3].removeprefix("token=").replace(". token: '", " or ").removesuffix("'").split(" or ")
    assert a == b == c != token and a.startswith("ghp_")
    a, b = got[4].removeprefix("secret=").split(" or ")
    assert a == b != cloud and a.startswith("AKIA")
    a, b = got[5].split(". ")
    assert a == b != "password=abcdef1"
    assert got[6].split()[1] == got[6].split("secret=")[1] and "4041894974608795" not in got[6]
    assert {r.doc_id: r.n_entities for r in rows} == {0: 2, 1: 5, 2: 2, 3: 3, 4: 2, 5: 2, 6: 2}


def test_whole_names_are_followed(spark):
    texts = ["Ms Anna Maria Klug", "Mrs. Mary-Jane O'Neil-Smith left", "Mr. John Doe wrote. John Doe left, then Doe Doe and Then John Doe came", "Dr. Anna Klug, Prof. Dr. Max Lee, Miss Klug",
             "Mr. Γιώργος Παπαδόπουλος met Παπαδόπουλος", "Frau A. von Klug and Klug. Kluge klug", "Mrs. Robin Vogt", "Dr. Robin Vogt", "a" + pii.MARK + "b Mr. Doe", "John Doe and Klug without a title"]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    anna = got[0].text.split()
    assert len(anna) == 4 and anna[0] == "Ms" and anna[1] in pii.GIVEN["f", "latin"] and anna[2] in pii.GIVEN["f", "latin"] and anna[3] != "Klug"
    mary = got[1].text.split()
    assert mary[3:] == ["left"] and all(x in pii.GIVEN["f", "latin"] for x in mary[1].split("-")) and mary[2].startswith("O'") and mary[2].count("-") == 1 and not {"Neil", "Smith", "Mary", "Jane"} & set(got[1].text.replace("'", " ").replace("-", " ").split())
    name = got[2].text.removeprefix("Mr. ").split(" wrote. ")[0]
    doe = name.split()[1]
    assert got[2].text == f"Mr. {name} wrote. {name} left, then {doe} {doe} and Then {name} came" and "Doe" not in name and got[2].n_entities == 1
    assert got[3].text.split(", ")[2] == f"Miss {anna[3]}" and got[3].text.startswith("Dr. ") and f" {anna[3]}, Prof. Dr. " in got[3].text and "Lee" not in got[3].text
    george = got[4].text.split()
    assert george[1] in pii.GIVEN["m", "greek"] and george[2] == george[4] != "Παπαδόπουλος" and all("α" <= c.lower() <= "ω" for c in george[2])
    assert got[5].text.split()[2] == "von" and got[5].text.split()[1].endswith(".") and got[5].text.endswith(f" {anna[3]} and {anna[3]}. Kluge klug")
    assert got[6].text.removeprefix("Mrs. ") == got[7].text.removeprefix("Dr. ") and got[7].text.split()[1] in pii.GIVEN["f", "latin"]
    assert got[8].text == "a" + pii.MARK + f"b Mr. {doe}" and got[9].text == texts[9] and got[9].n_entities == 0


def test_surrogates_of_null_ids_and_long_texts(spark):
    long = "plain words of no one " * 20_000 + "Mr. John Doe " + "and Doe too " * 500
    df = spark.createDataFrame([(None, "ip 42.144.35.254"), (None, None), (None, "ip 42.144.35.254"), (1, long)], "doc_id long, text string")
    got = pii.pseudonymize(df, "k").collect()
    assert len(got) == 4 and sorted(r.n_entities for r in got) == [0, 1, 1, 1]
    text = next(r.text for r in got if r.doc_id == 1)
    assert "Doe" not in text and text.startswith("plain words of no one " * 20_000) and text.count(" too ") == 500


def test_values_without_letters_or_digits_are_no_secrets(spark):
    df = spark.createDataFrame([(1, "Password: ________"), (2, "token=......")], "doc_id long, text string")
    assert {(r.doc_id, r.text, r.n_entities) for r in pii.pseudonymize(df, "k").collect()} == {(1, "Password: ________", 0), (2, "token=......", 0)}


def test_line_dedup(docs):
    rows = [(r.doc_id, k, line.split()) for r in docs.dropDuplicates(["doc_id", "text"]).collect() for k, line in enumerate((r.text or "").split("\n"))]
    keyed = sorted(((i is not None, i or 0, k, set(w)) for i, k, w in rows if w), key=lambda x: x[:3])
    want = set()
    for n, (some, i, k, w) in enumerate(keyed):
        for _, j, m, v in keyed[:n]:
            if (j, m) != (i, k) and len(w & v) >= 0.8 * len(w | v) - 1e-9:
                want.add((i if some else None, k))
    unique = {i for i, n in Counter(r.doc_id for r in docs.collect()).items() if n == 1}
    got = {(r.doc_id, r.line_no) for r in linedup.near_lines(docs).collect()}
    assert {x for x in got if x[0] in unique} == {x for x in want if x[0] in unique}
    counts = linedup.line_counts(docs).collect()
    assert len(counts) == docs.count() and all(r.n_removed == len(r.removed) <= r.n_lines for r in counts)
    out = {r.doc_id: r.text for r in linedup.dedup_lines(docs).collect()}
    assert out[13] == "same line here now\ntail of it" and out[6] is None


def test_near_lines_against_all_pairs(spark):
    base = [prose(30).split() for _ in range(6)]
    lines = []
    for b in base:
        for _ in range(12):
            x = list(b)
            for at in rng.sample(range(30), rng.randint(0, 5)):
                x[at] = rng.choice(VOCAB)
            lines.append(" ".join(x))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    sets = [set(t.split()) for t in lines]
    want = {i for i in range(len(lines)) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(i))}
    assert {r.doc_id for r in linedup.near_lines(df).collect()} == want


def test_lines_that_share_words_do_not_meet(spark):
    """Shuffled bytes follow the lines where unlike long lines share words of a bounded vocabulary; each word occurs in fewer than 512 of them."""
    words = [f"w{i:05d}" for i in range(6000)]
    rows = [(i, " ".join(rng.sample(words, 150))) for i in range(6000)]
    rows += [(6000 + i, rows[i][1].replace(" ", " other ", 1)) for i in range(50)]
    store = spark._jsc.sc().statusStore()

    def shuffled(n):
        before = sum(e.totalShuffleWrite() for e in _all(store.executorList(False)))
        out = {r.doc_id for r in linedup.near_lines(spark.createDataFrame(rows[:n] + rows[6000:], "doc_id long, text string")).collect()}
        return out, sum(e.totalShuffleWrite() for e in _all(store.executorList(False))) - before

    (few, small), (many, large) = shuffled(1500), shuffled(6000)
    assert few == many == set(range(6000, 6050))
    assert large < 6 * small


def _all(seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_empty_tables(docs):
    none = docs.limit(0)
    for f in (suffix.dedup_bytes, recompression.dedup_words, chosenpath.near_duplicates, simhash.edited_likeness, linedup.line_counts):
        assert f(none).count() == 0
    assert tokens.tokens_round_trip(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pipeline_counts_rows_and_not_ids(spark, sf_dir):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    one, two, three = prose(80), prose(80), prose(90)
    rows = [(1, one, "s0"), (1, one, "s0"), (1, one, "s0"), (None, two, "s0"), (None, two, "s1"), (None, two, None), (7, three, "s1"), (None, three, "s1"), (8, None, "s0"), (8, None, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = stages["near_duplicates"](spark, df, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted([(False, 1, one), (True, 0, two), (False, 7, three), (False, 8, "")])
    same = spark.createDataFrame([(1, one, "s0")] * 5 + [(None, two, "s1")] * 40, "doc_id long, text string, source string").repartition(4)
    drawn = mixing.mix_sources(same, block_words=None).draws.groupBy("source").count().collect()
    mixed = stages["mixing"](spark, same, sf_dir).groupBy("source").count().collect()
    assert {(r.source, r["count"]) for r in drawn} == {(r.source, r["count"]) for r in mixed}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.count() > 0 and (k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns)
        if k == 2:
            assert docs.count() < before
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
