"""Surrogate generation for personal data and secrets, in DataFrame functions only.

One pattern finds all entities of a text in a single pass. Each distinct entity, in its normal form, receives
one surrogate from a keyed hash: digits stay digits, letters keep their case, addresses keep their top domain,
card numbers stay Luhn-valid, IP octets stay in range, titled names keep title, gender and script. A family name and
a full name are entities apart from the title, so 'Mrs. Anna Klug', 'Ms. Anna Klug' and 'Frau Klug' share a family
name; a credential is the same entity alone and behind 'token='. A mention is
written in its own format from its entity's surrogate, so spellings of one entity stay spellings of one
surrogate. Surrogates that meet each other, or that are entities of the corpus themselves, are drawn again.

A person is one or more titles before a whole name: given names and initials, particles, and a family name last, each with
hyphens and apostrophes. A name found so is followed through its document: its full name and its family name are replaced
where no title stands before them, too. Behind academic titles alone the gender is what the same name has behind other titles of
the corpus, if these agree; else the given name comes from a pool of names of any gender. Latin, Cyrillic and Greek names keep their script, names in other
cased scripts become Latin ones. Names in capitals only, and names that no title of the document introduces, are not found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, same, text_key

# Characters of an IBAN by country. Any other country, or length, falls to the general form of 15 to 34.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
                23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV",
                29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """Groups of four and a last shorter one, compact or spaced. The known length comes first, so a capitalized word behind it is not taken in."""
    four = "(?: ?[A-Z0-9]{4})"
    known = [f"(?:{c})[0-9]{{2}}{four}{{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()]
    other = [f"[A-Z]{{2}}[0-9]{{2}}{x}" for x in (f"{four}{{7}}(?: ?[A-Z0-9]{{1,2}})?", f"{four}{{3,6}}(?: ?[A-Z0-9]{{1,3}})?", f"{four}{{2}} ?[A-Z0-9]{{3}}")]
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(f'{x}(?![A-Za-z0-9])' for x in known + other)})"


# Titles by gender (u: academic ones, which tell none), and particles between the parts of a name.
TITLES = {"f": "Mrs|Ms|Miss|Frau|Fräulein|Madame|Mademoiselle|Mme|Mlle|Señorita|Señora|Srta|Sra|Signora|г-жа|госпожа|Госпожа|Κυρία|κυρία|Κα|κα",
          "m": "Mr|Herr|Monsieur|Señor|Sr|Signor|г-н|господин|Господин|Κύριος|κύριος|Κος|κος", "u": "Professorin|Professor|Prof|Doctor|Dra|Dr|Mx|проф|д-р"}
PARTICLES = "von|van|vom|zu|zur|de|der|den|del|della|di|da|du|la|le|bin|ibn|al"
_TITLE = rf"(?:(?:{'|'.join(TITLES.values())})\.? )"
_NAME = r"(?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}+)+(?:['’-](?:\p{Lu}['’])?(?:\p{Lu}\p{Ll}+)+)*"
#: A whole name of up to four parts, particles counted; and any run of names, initials and particles, in which followed names are looked for.
FULL_NAME = rf"(?:(?:{_NAME}|\p{{Lu}}\.|{PARTICLES}) ){{0,3}}{_NAME}"
NAMES = rf"(?<!\p{{L}})(?:{_NAME}|\p{{Lu}}\.)(?: (?:{_NAME}|\p{{Lu}}\.|(?:{PARTICLES})(?!\p{{L}})))*(?!\p{{L}})"
# Kinds of entities and their patterns, the first that fits decides.
KINDS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?",
    "email": r"(?<![A-Za-z0-9_+])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "cloud_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "repo_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}",
    "secret": r"(?i:(?<![A-Za-z])(?:password|passwd|api[_-]?key|secret|access[_-]?token|token)\s?[:=]\s?['\x22]?(?=[_+/.-]*[A-Za-z0-9])[A-Za-z0-9_+/.-]{6,}['\x22]?)",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\g[0-9]{4}\g[0-9]{4}(?![0-9])",
    "iban": _iban(),
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9])1[3-9][0-9]{9}(?![0-9])",
    "person": rf"(?<!\p{{L}})(?=[DFHMPSгГпдКκ]){_TITLE}+{FULL_NAME}(?!\p{{L}})",
}
# Given names by gender and script, and the syllables of family names.
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Ines", "Julia", "Laura", "Maria", "Nora", "Olivia", "Sofia"],
    ("m", "latin"): ["Adrian", "Bruno", "David", "Felix", "Hugo", "Jonas", "Lukas", "Martin", "Oscar", "Simon"],
    ("f", "cyrillic"): ["Анна", "Вера", "Ирина", "Ольга"],
    ("m", "cyrillic"): ["Иван", "Олег", "Павел", "Юрий"],
    ("f", "greek"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("m", "greek"): ["Γιάννης", "Κώστας", "Νίκος", "Πέτρος"],
    ("u", "latin"): ["Alex", "Chris", "Dominique", "Kim", "Noel", "Robin", "Sascha", "Sidney"],
    ("u", "cyrillic"): ["Валя", "Женя", "Саша", "Шура"],
    ("u", "greek"): ["Άλεξ", "Κρις", "Ντένις", "Σάσα"],
}
SYLLABLES = {"latin": ["ba", "del", "fin", "gor", "hal", "ker", "lam", "mon", "nor", "pel", "ras", "sen", "tor", "vik", "wen", "zal"],
             "cyrillic": ["ба", "дел", "гор", "кер", "лам", "мон", "нор", "тор"], "greek": ["βα", "γορ", "δελ", "κερ", "λαμ", "μον", "νορ", "τορ"]}
_CARD_GROUP = 1
#: Draws a colliding surrogate may need. Names have a syllable more in every draw, and short kinds grow after ROOMY draws, so
#: the loop ends for any number of entities.
ATTEMPTS = 50
ROOMY = 4
#: What sets entities apart in a text while it is cut up; a text that holds it is cut by two passes instead.
MARK = "\x01\x02"
#: Copies of the surrogate table a hot mention is spread over.
SALTS = 16

_PATTERNS = {k: v.replace(r"\g", rf"\{_CARD_GROUP}") for k, v in KINDS.items()}
ANY = "|".join(f"(?:{p})" for p in _PATTERNS.values())


def kind_of(mention: Column) -> Column:
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in _PATTERNS.items()], F.lit("secret"))


_BEFORE, _AFTER = r"^[A-Za-z_-]+\s?[:=]\s?['\x22]?", r"\.*['\x22]?$"


def value_of(kind: Column, mention: Column) -> Column:
    """What is replaced: of a secret, what stands behind its name, less quotes and a full stop; else the mention."""
    return F.when(kind == "secret", F.regexp_replace(F.regexp_replace(mention, _BEFORE, ""), _AFTER, "")).otherwise(mention)


def untitled(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^{_TITLE}+", "")


def normal(kind: Column, value: Column) -> Column:
    """What the spellings of one entity share; of a person, what stands behind the titles."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "email", F.lower(value)).when(kind == "iban", F.regexp_replace(value, " ", ""))
            .when(kind == "person", untitled(value)).otherwise(value))


def _nibble(stream: Column, i: Column) -> Column:
    """Two hex digits of the stream at i, as a number from 0 to 255."""
    return F.conv(F.substring(stream, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")


def _scrambled(text: Column, stream: Column) -> Column:
    """Digits to digits, letters to letters of their case, all else kept. Beyond 31 characters the stream is rehashed."""

    def one(c: Column, i: Column) -> Column:
        v = _nibble(F.when(i < 31, stream).otherwise(F.sha2(F.concat(stream, (i / 31).cast("int").cast("string")), 256)), i % 31)
        return (F.when(c.rlike("[0-9]"), (v % 10).cast("string")).when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), v % 26 + 1, F.lit(1)))
                .when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), v % 26 + 1, F.lit(1))).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """digits with the last one set so that the Luhn sum holds."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    weighed = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _valid_iban(country: Column, account: Column) -> Column:
    """The IBAN with check digits that make it 1 modulo 97."""
    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _name(kind: Column, norm: Column, stream: Column, attempt: Column) -> Column:
    """A family name of syllables, or given names of the pool, with a syllable more in every draw after the third.

    Every part is made for itself: hyphens stay, an initial becomes an initial, particles and a leading O' stay.
    """
    words = F.split(norm, " ")

    def pick(options: list[str], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in options]), _nibble(stream, at) % len(options) + 1)

    def syllables(script: str, n: Column, behind: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k > 0, pick(SYLLABLES[script], k + behind)).otherwise("")), "")

    def given(script: str) -> Column:
        def one(w: Column, i: Column) -> Column:
            def of(at: Column) -> Column:
                return F.when(norm.startswith("f "), pick(GIVEN["f", script], at)).when(norm.startswith("u "), pick(GIVEN["u", script], at)).otherwise(pick(GIVEN["m", script], at))

            more = F.when(i == 0, syllables(script, F.greatest(attempt - 2, F.lit(0)), F.lit(0))).otherwise("")
            return (F.when(w.rlike(r"^\p{Ll}"), w).when(w.endswith("."), F.concat(F.substring(of(i * 7), 1, 1), more, F.lit(".")))
                    .otherwise(F.concat(F.array_join(F.transform(F.split(w, "-"), lambda _, j: of(i * 7 + j * 3)), "-"), more)))

        return F.array_join(F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), one), " ")

    def family(script: str) -> Column:
        parts = F.transform(F.split(norm, "-"), lambda x, j: F.concat(F.regexp_extract(x, "^\\p{Lu}['’]", 0), F.initcap(syllables(script, attempt + 4, j * 9))))
        return F.array_join(parts, "-")

    def name(script: str) -> Column:
        return F.when(kind == "given", given(script)).otherwise(family(script))

    last = F.element_at(words, -1)
    return F.when(last.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(last.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))


def surrogate(kind: Column, norm: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity in its normal form."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)
    top = F.regexp_extract(norm, r"\.[A-Za-z]+$", 0)
    grown = F.greatest(attempt - ROOMY, F.lit(0))
    octet = [(_nibble(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)]
    fixed = {"cloud_key": 4, "repo_token": 4}
    out = F.when(kind == "email", F.concat(F.substring(stream, F.lit(1), grown), _scrambled(F.substring(norm, F.lit(1), F.length(norm) - F.length(top)), stream), top))
    out = out.when(kind == "ip", F.concat_ws(".", *octet)).when(kind.isin("given", "family"), _name(kind, norm, stream, attempt))
    out = out.when(kind == "card", _luhn(F.concat(F.substring(norm, 1, 1), _scrambled(F.substring(norm, F.lit(2), F.length(norm)), stream))))
    out = out.when(kind == "phone", F.concat(F.when(norm.rlike("^[01]"), F.substring(norm, 1, 1)).otherwise(F.lit("")), _scrambled(F.when(norm.rlike("^[01]"), F.substring(norm, F.lit(2), F.length(norm))).otherwise(norm), stream), F.translate(F.substring(stream, F.lit(1), grown), "abcdef", "012345")))
    out = out.when(kind == "private_key", F.concat(F.lit("-----BEGIN PRIVATE KEY-----"), stream, F.lit("-----END PRIVATE KEY-----")))
    out = out.when(kind == "iban", _valid_iban(F.substring(norm, 1, 2), _scrambled(F.substring(norm, F.lit(5), F.length(norm)), stream)))
    for k, n in fixed.items():
        out = out.when(kind == k, F.concat(F.substring(norm, 1, n), _scrambled(F.substring(norm, F.lit(n + 1), F.length(norm)), stream)))
    return out.otherwise(F.concat(_scrambled(norm, stream), F.when(kind == "secret", F.substring(stream, F.lit(1), grown)).otherwise("")))


def written(kind: Column, mention: Column, norm: Column, made: Column) -> Column:
    """The surrogate made, in the format of the mention."""
    chars = F.split(mention, "")
    # how many characters of the class stand before i
    at = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x.rlike("[0-9]"))))
    digits = F.array_join(F.zip_with(chars, at, lambda c, n: F.when(c.rlike("[0-9]"), F.substring(made, n, F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substring(made, F.length(norm) + 1, F.length(made)))  # a grown phone number
    tight = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x != " ")))
    spaced = F.array_join(F.zip_with(chars, tight, lambda c, n: F.when(c != " ", F.substring(made, n, F.lit(1))).otherwise(c)), "")
    return (F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "iban", spaced)
            .when(kind == "email", F.when(mention == F.upper(mention), F.upper(made)).otherwise(made))
            .when(kind == "person", F.concat(F.regexp_extract(mention, rf"^{_TITLE}+", 0), made)).otherwise(made))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, made: a surrogate for each distinct (kind, norm), no two alike within a kind and none an entity.

    Kind given (gender, given names, family name) is told apart within its family name.
    """
    given, words = F.col("kind") == "given", F.split("norm", " ")
    scope, itself = F.when(given, F.element_at(words, -1)).otherwise(""), F.when(given, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " ")).otherwise(F.col("norm"))
    own = materialize(entities.select("kind", "norm").distinct().withColumns({"scope": scope, "itself": itself}), "pii_entities")
    todo, done = own.withColumn("attempt", F.lit(0)), []
    for _ in range(ATTEMPTS):
        drawn = todo.withColumn("made", surrogate(F.col("kind"), F.col("norm"), key, F.col("attempt")))
        first = Window.partitionBy("kind", "scope", "made").orderBy("norm")  # a handful share one surrogate
        taken = reduce(DataFrame.unionByName, [own.select("kind", "scope", F.col("itself").alias("made")), *[d.select("kind", "scope", "made") for d in done]])
        tried = drawn.withColumn("n", F.row_number().over(first)).join(taken.withColumn("hit", F.lit(True)).distinct(), ["kind", "scope", "made"], "left")
        tried = materialize(tried.withColumn("good", (F.col("n") == 1) & F.col("hit").isNull()), "pii_tried")
        done.append(tried.filter("good").select("kind", "scope", "norm", "made"))
        todo = tried.filter("not good").select("kind", "scope", "norm", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done).drop("scope")
    raise RuntimeError("surrogates kept colliding")


def replaced(mentions: DataFrame, key: str) -> DataFrame:
    """mention, kind, new: each distinct mention with what stands in its place."""
    typed = mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("value", value_of(F.col("kind"), F.col("mention")))
    typed = typed.withColumn("entity", F.when(F.col("kind") == "secret", kind_of(F.col("value"))).otherwise(F.col("kind"))).withColumn("norm", normal(F.col("entity"), F.col("value")))
    person = F.col("entity") == "person"
    told = F.when(person, F.when(F.col("mention").rlike(rf"^{_TITLE}*?(?:{TITLES['f']})\.? "), "f").when(F.col("mention").rlike(rf"^{_TITLE}*?(?:{TITLES['m']})\.? "), "m"))
    name = Window.partitionBy("entity", "norm")  # the titles of one name, the spellings of one entity
    typed = typed.withColumn("told", told).withColumns({"least": F.min("told").over(name), "most": F.max("told").over(name)})
    gender = F.coalesce("told", F.when(F.col("least") == F.col("most"), F.col("least")), F.lit("u"))
    typed = typed.withColumns({"main_kind": F.when(person, "family").otherwise(F.col("entity")), "main": F.when(person, F.element_at(F.split("norm", " "), -1)).otherwise(F.col("norm")),
                               "given": F.when(person & F.col("norm").contains(" "), F.concat_ws(" ", gender, "norm"))})
    typed = materialize(typed, "pii_mentions")
    entities = typed.select(F.col("main_kind").alias("kind"), F.col("main").alias("norm")).unionByName(typed.filter("given is not null").select(F.lit("given").alias("kind"), F.col("given").alias("norm")))
    made = surrogates(entities, key)
    first = made.filter("kind = 'given'").select(F.col("norm").alias("given"), F.col("made").alias("made_given"))
    main = made.withColumnsRenamed({"kind": "main_kind", "norm": "main"})
    out = typed.join(main, ["main_kind", "main"]).join(first, "given", "left")
    body = written(F.col("entity"), F.col("value"), F.col("norm"), F.concat_ws(" ", "made_given", "made"))
    around = F.concat(F.regexp_extract("mention", _BEFORE, 0), body, F.regexp_extract("mention", _AFTER, 0))
    return out.select("mention", "kind", F.when(F.col("kind") == "secret", around).otherwise(body).alias("new"))


def parts_of(text: Column) -> Column:
    """What stands between entities and the entities, in turn, by one pass of the pattern. Null text: null."""
    marked = F.split(F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"), MARK, -1)
    twice = F.flatten(F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda p, e: F.array(p, e)))
    return F.when(F.contains(text, F.lit(MARK)), F.filter(twice, lambda x: x.isNotNull())).otherwise(marked)


def _wide(name: Column) -> Column:
    """Every part of a name with spaces of its own on both sides."""
    return F.concat(F.lit(" "), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(" "))


def names_to_follow(found: Column, m: Column) -> Column:
    """old, new: the full names of a document's persons, the longest first, then their family names."""
    people = F.filter(F.array_distinct(found), lambda e: F.element_at(m, e)["kind"] == "person")
    full = F.transform(people, lambda e: F.struct((-F.length(untitled(e))).alias("at"), untitled(e).alias("old"), untitled(F.element_at(m, e)["new"]).alias("new")))
    family = F.transform(full, lambda x: F.struct(F.lit(1).alias("at"), F.element_at(F.split(x["old"], " "), -1).alias("old"), F.element_at(F.split(x["new"], " "), -1).alias("new")))
    whole = F.filter(full, lambda x: F.contains(x["old"], F.lit(" ")))
    return F.transform(F.array_sort(F.array_distinct(F.concat(whole, family))), lambda x: F.struct(_wide(x["old"]).alias("old"), _wide(x["new"]).alias("new")))


def followed(piece: Column, names: Column) -> Column:
    """A text between entities with the names replaced that stand in it."""

    def one(run: Column) -> Column:
        done = F.aggregate(names, _wide(run), lambda x, n: F.replace(x, n["old"], n["new"]))
        return F.replace(F.substring(done, F.lit(2), F.length(done) - 2), F.lit("  "), F.lit(" "))

    runs = F.transform(F.regexp_extract_all(piece, F.lit(NAMES), F.lit(0)), one)
    return F.array_join(F.flatten(F.zip_with(F.split(piece, NAMES, -1), runs, lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_entities, kinds: every text with its entities replaced, a row per input row.

    n_entities counts what the pattern finds, not the names followed from there. Null text stays null with no entity; texts without
    entities are unchanged. Repeated rows and null doc_ids are treated like any other row. Equal entities receive equal surrogates
    across the corpus under one key.
    """
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), parts_of(F.col("text")).alias("parts"))
    cut = materialize(cut, "pii_parts")
    hit = F.coalesce(F.size("parts") > 1, F.lit(False))
    clean = cut.filter(~hit).select("doc_id", F.get("parts", F.lit(0)).alias("text"), F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    found = cut.filter(hit).select("doc_id", "th", F.filter("parts", lambda x, i: i % 2 == 0).alias("pieces"), F.filter("parts", lambda x, i: i % 2 == 1).alias("found"))
    mentions = found.select(F.explode("found").alias("mention")).distinct()
    salted = materialize(replaced(mentions, key), "pii_table").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = found.select("doc_id", "th", F.explode(F.array_distinct("found")).alias("mention"), F.pmod("th", F.lit(SALTS)).cast("int").alias("salt")).distinct()
    maps = own.join(salted, ["mention", "salt"]).groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("mention", F.struct("new", "kind")))).alias("m"))
    joined = same(found, maps).withColumn("names", names_to_follow(F.col("found"), F.col("m")))
    pieces = F.when(F.size("names") > 0, F.transform("pieces", lambda p: followed(p, F.col("names")))).otherwise(F.col("pieces"))
    new = F.transform("found", lambda e: F.element_at("m", e)["new"])
    text = F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, e: F.array(p, F.coalesce(e, F.lit(""))))), "")
    kinds = F.array_sort(F.array_distinct(F.transform("found", lambda e: F.element_at("m", e)["kind"])))
    return clean.unionByName(joined.select("doc_id", text.alias("text"), F.size("found").alias("n_entities"), kinds.alias("kinds")))
