"""PII surrogates: detected entities get keyed replacements of their own kind. DataFrame operations only.

Kinds: ``email``, ``card`` (13-19 digits that pass the Luhn check), ``phone``, ``ip`` (v4), ``ssn`` and ``name`` (one or
two capitalised words after a title).

- *Coreference*: an entity's canonical form (lower case, or digits only) has one surrogate in all texts and notations.
  Names are replaced word by word: a family name has one surrogate with every title and given name, a given name one by
  its gender. The words of a name that a title shows are replaced without a title too, in the same text.
- *Type consistency*: digits are replaced in place, so separators, brackets and country codes stay; a card keeps its
  first digit and length and gets a valid check digit; private and public addresses stay so; an e-mail keeps the shape
  of its local part, its digits and its script; a name keeps its title, gender (by the title), word count and script.
- *Card candidates* (any 13-19 digits) that fail the check hide nothing: their text is read again with the valid cards of
  the usual groupings in their place. Numbers with a plus sign are phones in any grouping of 8 to 15 digits.
- *Keyed*: letters and digits come from SHA-256 over (key, kind, canonical form, attempt).
- *Distinctness*: the table of distinct entities is checked for collisions: surrogates that another entity has too, or
  that are some entity's original. Of such a set the least entity keeps its surrogate, the others get the next attempt,
  until none is left. Names grow by a syllable each fourth attempt, so there is always room.

The table has a row per distinct entity; only rows (id, entity) and texts with an entity are shuffled, and an entity
that a third of all texts mention is one row of the table. Texts without entities, NULL and empty texts come back as
they are. A name is only looked for in the row that has its title; ids play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import Scratch

KEY = "surrogate-key"
MAX_ATTEMPTS = 64

#: Titles by gender, and given names for surrogates by script and gender.
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora|Г-жа|Госпожа",
    "m": "Mr|Mister|Herr|Monsieur|Sr|Señor|Г-н|Господин",
}
NAMES = {
    ("latin", "f"): "Alma Berta Clara Dora Elena Flora Gisela Hanna Irene Julia Karla Lena Marta Nora Olga Paula".split(),
    ("latin", "m"): "Anton Bruno Carlo David Emil Felix Georg Hugo Ivo Jonas Karl Leo Marco Noel Otto Paul".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Макар Никита Олег Павел Роман Семён".split(),
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(TITLES.values())
_WORD = r"\p{Lu}[\p{L}'’-]+"
#: What may end a word of a name without being part of it, and what may not stand beside an untitled mention.
_TAIL = r"(?:['’]s|['’-]+)"
_MENTION_LEFT, _MENTION_RIGHT = r"(?<![\p{L}\p{N}-])", r"(?![\p{L}\p{N}]|-\p{L})"
#: One alternation finds all kinds, leftmost first.
PATTERNS = {
    # A local part is tried from the start of its run only, and a domain has at most 127 labels: linear time, bounded stack.
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,125}\.\p{L}{2,}+",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}|\+[1-9](?:[ .()-]{0,2}\d){7,14})(?![\w])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_WORD}(?: {_WORD})?",
}
_ORDER = ("email", "ip", "ssn", "card", "phone", "name")
ENTITY = "|".join(PATTERNS[k] for k in _ORDER)
#: The usual groupings of card numbers, looked for inside candidates that fail the check.
CARD_GROUPS = (r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{4}(?:[ -]\d{4}){2}[ -]\d{1,3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}")
_CARD_LEFT, _CARD_RIGHT = r"(?<![\w.+])(?<!\D-)", r"(?!\w|\.\d)"
#: Country codes of one, two and three digits.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_CONSONANTS = {"latin": "bcdfghjklmnprstv", "cyrillic": "бвгджзклмнпрстфх"}
_VOWELS = {"latin": "aeiouaeiouaeioua", "cyrillic": "аеиоуаеиоуаеиоуа"}


def kind_of(value: Column) -> Column:
    """The kind of a found string."""
    tests = [(k, value.rlike(rf"^(?:{PATTERNS[k]})$")) for k in ("email", "ip", "ssn", "name")]
    kind = F.when(tests[0][1], tests[0][0])
    for k, test in tests[1:]:
        kind = kind.when(test, k)
    digits = F.regexp_replace(value, r"\D", "")
    card = value.rlike(rf"^(?:{PATTERNS['card']})$")
    return kind.when(card & luhn_ok(digits), "card").when(value.rlike(rf"^(?:{PATTERNS['phone']})$"), "phone")


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """Luhn sum of a string of digits; ``from_right`` 0 when its last digit is the check digit, else 1."""
    n = F.length(digits)
    part = lambda i: F.substring(digits, i, 1).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i + from_right) % 2 == 1, doubled(part(i))).otherwise(part(i)))
    return F.when(n > 0, F.aggregate(each, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    return _luhn_sum(digits, 0) % 10 == 0


def canonical(kind: Column, value: Column) -> Column:
    """The form that notations of one entity share."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind == "name", F.concat(F.lit(":"), F.element_at(name_words(value), -1)))
        .when(kind == "email", F.lower(value))
        .when(kind == "ip", value)
        .when((kind == "phone") & value.startswith("+"), F.concat(F.lit("+"), digits))
        .otherwise(digits)
    )


def name_words(value: Column) -> Column:
    """The words of a name after its title, without possessive endings."""
    bare = F.regexp_replace(value, rf"^(?:{_TITLE})\.? ", "")
    return F.split(F.regexp_replace(bare, rf"{_TAIL}(?= |$)", ""), " ")


def given_name(value: Column) -> Column:
    """``gender:word`` of the given name of a name of two words after its title, else NULL."""
    gender = F.when(value.rlike(rf"^(?:{TITLES['f']})\.? "), "f").otherwise("m")
    return F.when(F.size(name_words(value)) > 1, F.concat_ws(":", gender, F.get(name_words(value), F.lit(0))))


def is_name(value: Column) -> Column:
    """Whether a found string is a name after a title."""
    return value.rlike(rf"^(?:{PATTERNS['name']})$")


def is_card(value: Column) -> Column:
    """Whether a found string is a card number."""
    return value.rlike(rf"^(?:{PATTERNS['card']})$") & luhn_ok(F.regexp_replace(value, r"\D", ""))


def _any_of(strings: Column) -> Column:
    """An alternation of strings without special characters, the longer ones first."""
    by_length = F.array_sort(F.transform(F.array_distinct(strings), lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.concat(F.lit("(?:"), F.array_join(F.transform(by_length, lambda x: x["v"]), "|"), F.lit(")"))


def second_pattern(text: Column, found: Column) -> Column:
    """The pattern of a text whose first reading took a card candidate that fails the check or found a name, else NULL.

    Such a candidate may cover other entities: the pattern has the valid cards of the text in the place of candidates.
    Names get the mentions without a title: both words, the family name or the given name.
    """
    failed = F.exists(found, lambda v: v.rlike(rf"^(?:{PATTERNS['card']})$") & ~is_card(v))
    inner = F.concat(*[F.regexp_extract_all(text, F.lit(f"{_CARD_LEFT}(?=({g}){_CARD_RIGHT})"), F.lit(1)) for g in CARD_GROUPS])
    inner = F.filter(inner, lambda v: luhn_ok(F.regexp_replace(v, r"\D", "")))
    cards = F.concat(F.filter(found, is_card), inner)
    card = F.when(F.size(cards) > 0, F.concat(F.lit(_CARD_LEFT), _any_of(cards), F.lit(f"{_CARD_RIGHT}|"))).otherwise("")
    at = _ORDER.index("card")
    before, after = ("|".join(PATTERNS[k] for k in some) for some in (_ORDER[:at], _ORDER[at + 1 :]))
    entities = F.when(failed, F.concat(F.lit(f"{before}|"), card, F.lit(after))).otherwise(F.lit(ENTITY))
    names = F.transform(F.filter(found, is_name), name_words)
    mentions = F.concat(F.transform(names, lambda w: F.array_join(w, " ")), F.flatten(names))
    mention = F.when(F.size(names) > 0, F.concat(F.lit(f"|{_MENTION_LEFT}"), _any_of(mentions), F.lit(_MENTION_RIGHT))).otherwise("")
    return F.when(failed | (F.size(names) > 0), F.concat(entities, mention))


def mentions_of(names: DataFrame) -> DataFrame:
    """(``__row``, ``value``, ``kind``, ``entity``, ``given``) of the untitled mentions of names (``__row``, ``value``)."""
    words, given = name_words(F.col("value")), given_name(F.col("value"))
    family, none = canonical(F.lit("name"), F.col("value")), F.lit(None).cast("string")
    as_struct = lambda v, rank, kind, entity, given: F.struct(v.alias("value"), F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), entity.alias("entity"), given.alias("given")).alias("is"))
    each = F.array(
        as_struct(F.array_join(words, " "), 0, "name", family, given),
        as_struct(F.element_at(words, -1), 1, "name", family, none),
        as_struct(F.get(words, F.lit(0)), 2, "given", F.coalesce(given, family), none),
    )
    # A word that is a family name is one, whatever else it is.
    one = names.select("__row", F.inline(F.filter(each, lambda x: (x["is"]["rank"] < 2) | given.isNotNull())))
    return one.groupBy("__row", "value").agg(F.min("is").alias("is")).select("__row", "value", "is.kind", "is.entity", "is.given")


def _letters(hexes: Column, alphabet: str) -> Column:
    return F.translate(hexes, _HEX, alphabet)


def _stream(key: str, kind: Column, entity: Column, attempt: Column, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(salt), kind, entity, attempt.cast("string")), 256)


def _number(stream: Column, start: int, modulus: int) -> Column:
    return F.conv(F.substring(stream, start, 8), 16, 10).cast("long") % modulus


def surrogate(kind: Column, entity: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of a canonical form, itself in canonical form."""
    s = _stream(key, kind, entity, attempt)
    n = F.length(entity)
    digits = F.concat(F.translate(s, "abcdef", "036914"), F.translate(_stream(key, kind, entity, attempt, "more"), "abcdef", "258147"))
    # Telephone numbers keep the country code, or without a plus sign what comes before their last ten digits.
    keep = F.when(entity.startswith("+"), F.length(F.regexp_extract(entity, _COUNTRY, 0))).otherwise(F.greatest(n - 10, F.lit(0)))
    first = (2 + _number(s, 1, 8)).cast("string")
    phone = F.concat(F.substring(entity, F.lit(1), keep), first, F.substr(digits, F.lit(9), n - keep - 1))
    # Cards: first digit, keyed digits, check digit.
    body = F.concat(F.substring(entity, 1, 1), F.substr(digits, F.lit(1), n - 2))
    card = F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string"))
    octet = lambda at, low, span: (low + _number(s, at, span)).cast("string")
    private = entity.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)")
    ip = F.concat_ws(".", F.when(private, F.lit("10")).otherwise(octet(1, 20, 80)), octet(9, 0, 256), octet(17, 0, 256), octet(25, 1, 254))
    # E-mail: letters and digits of the local part in place, the domain new.
    local, cyrillic = F.substring_index(entity, "@", 1), entity.rlike(r"\p{IsCyrillic}")
    shape = F.regexp_replace(F.regexp_replace(local, r"\p{L}", "x"), r"\p{N}", "0")
    places = F.sequence(F.lit(1), F.length(shape))
    fill = lambda letters: F.array_join(
        F.transform(
            places,
            lambda i: F.when(F.substring(shape, i, 1) == "x", F.substring(F.repeat(letters, 4), 1 + i % 256, 1))
            .when(F.substring(shape, i, 1) == "0", F.substring(F.repeat(digits, 4), 1 + i % 256, 1))
            .otherwise(F.substring(shape, i, 1)),
        ),
        "",
    )
    pick = lambda alphabet: F.when(cyrillic, _letters(s, alphabet["cyrillic"])).otherwise(_letters(s, alphabet["latin"]))
    host = F.concat(_letters(F.substr(s, F.lit(33), F.least(F.lit(6) + F.floor(attempt / 4).cast("int"), F.lit(24))), _CONSONANTS["latin"]), F.lit(".example"))
    email = F.concat(fill(pick(_CONSONANTS)), F.lit("@"), host)
    # Names: gender:word; given name by gender and script, from the second attempt on with syllables; family name of syllables.
    gender = F.substring_index(entity, ":", 1)
    list_of = lambda g: F.when(cyrillic, F.lit(" ".join(NAMES["cyrillic", g]))).otherwise(F.lit(" ".join(NAMES["latin", g])))
    given = F.get(F.split(F.when(gender == "f", list_of("f")).otherwise(list_of("m")), " "), _number(s, 1, 16).cast("int"))
    more = F.sequence(F.lit(0), F.floor((attempt - 1) / 2).cast("int"))
    pairs = F.sequence(F.lit(0), F.lit(2) + F.floor(attempt / 4).cast("int"))
    syllable = lambda i: F.concat(F.substring(pick(_CONSONANTS), 9 + 2 * i, 1), F.substring(pick(_VOWELS), 10 + 2 * i, 1))
    family = F.initcap(F.array_join(F.transform(pairs, syllable), ""))
    name = F.concat(gender, F.lit(":"), family)
    given = F.concat(gender, F.lit(":"), given, F.when(attempt > 0, F.array_join(F.transform(more, syllable), "")).otherwise(""))
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))
    return F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "email", email).when(kind == "name", name).when(kind == "given", given).otherwise(ssn)


def written(kind: Column, value: Column, made: Column, given: Column) -> Column:
    """A canonical surrogate, with that of a given name (NULL: none), in the notation of a found string."""
    count = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"\D", ""))
    char = lambda i: F.substring(value, i, 1)
    digits = F.regexp_replace(made, r"\D", "")
    in_place = F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(char(i).rlike(r"\d"), F.substring(digits, count(i), 1)).otherwise(char(i))), ""
    )
    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0)
    first = F.concat(F.substring_index(given, ":", -1), F.regexp_extract(value, rf"({_TAIL}) {_WORD}$", 1), F.lit(" "))
    name = F.concat(title, F.coalesce(first, F.lit("")), F.substring_index(made, ":", -1), F.regexp_extract(value, rf"{_TAIL}$", 0))
    return F.when(kind.isin("name", "given"), name).when(kind.isin("email", "ip"), made).otherwise(in_place)


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(``kind``, ``entity``, ``made``) of every distinct entity, without collisions. Rounds end when a check finds none."""
    scratch = Scratch(entities.sparkSession, "surrogates")
    table = scratch.store(entities.select("kind", "entity").distinct().withColumn("attempt", F.lit(0)))
    for _ in range(MAX_ATTEMPTS):
        named = table.withColumn("made", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key))
        # One row per (kind, string) tells whether it is some entity's original, and who has it as a surrogate.
        originals = table.select("kind", F.col("entity").alias("made"), F.lit(None).cast("string").alias("entity"), F.lit(1).alias("real"))
        claims = named.select("kind", "made", "entity", F.lit(0).alias("real")).unionByName(originals)
        claims = claims.groupBy("kind", "made").agg(F.min("entity").alias("winner"), F.max("real").alias("real"), F.count("entity").alias("n"))
        taken = claims.filter((F.col("n") > 0) & ((F.col("n") > 1) | (F.col("real") == 1)))
        checked = named.join(taken, ["kind", "made"], "left")
        again = F.col("n").isNotNull() & ((F.col("real") == 1) | (F.col("entity") != F.col("winner")))
        checked = scratch.store(checked.select("kind", "entity", "attempt", "made", again.alias("again")))
        if checked.filter("again").isEmpty():
            return checked.select("kind", "entity", "made")
        following = scratch.store(checked.select("kind", "entity", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")))
        scratch.drop(table)
        scratch.drop(checked)
        table = following
    raise RuntimeError("no distinct surrogates: a kind has more entities than its format allows")


def replace_pii(docs: DataFrame, text_col="text", key: str = KEY) -> DataFrame:
    """All rows and columns, with surrogates in the text column, and ``__n_entities``."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = lambda pattern: F.regexp_extract_all(F.col(text_col), F.concat(F.lit("("), pattern, F.lit(")")), F.lit(1))
    # The texts are scanned once; what follows reads the stored rows.
    marked = docs.withColumn("__found", F.coalesce(found(F.lit(ENTITY)), F.array().cast("array<string>")))
    marked = scratch.store(marked.withColumn("__row", F.monotonically_increasing_id()))
    some = marked.filter(F.size("__found") > 0).withColumn("__again", second_pattern(F.col(text_col), F.col("__found")))
    some = some.withColumn("__found", F.when(F.col("__again").isNull(), F.col("__found")).otherwise(found(F.col("__again"))))
    some = scratch.store(some)
    rows = some.select("__row", F.explode(F.array_distinct("__found")).alias("value")).withColumn("kind", kind_of(F.col("value")))
    rows = rows.withColumn("entity", canonical(F.col("kind"), F.col("value")))
    rows = scratch.store(rows.withColumn("given", F.when(F.col("kind") == "name", given_name(F.col("value")))))
    mentions = rows.filter("kind IS NULL").select("__row", "value").join(mentions_of(rows.filter("kind = 'name'")), ["__row", "value"])
    rows = scratch.store(rows.filter("kind IS NOT NULL").unionByName(mentions))
    full = rows.filter("given IS NOT NULL")
    table = surrogate_table(rows.select("kind", "entity").unionByName(full.select(F.lit("given").alias("kind"), F.col("given").alias("entity"))), key)
    givens = table.filter("kind = 'given'").select(F.col("entity").alias("given"), F.col("made").alias("made_given"))
    rows = rows.filter("given IS NULL").withColumn("made_given", F.lit(None).cast("string")).unionByName(full.join(givens, "given"))
    as_written = written(F.col("kind"), F.col("value"), F.col("made"), F.col("made_given"))
    given = rows.join(table, ["kind", "entity"]).select("__row", "value", as_written.alias("as"))
    per_doc = given.groupBy(F.col("__row").alias("__of")).agg(F.map_from_entries(F.collect_set(F.struct("value", "as"))).alias("__map"))
    some = some.join(per_doc, F.col("__row") == F.col("__of"), "left").drop("__of")
    # Between the found strings lie the gaps that split() gives; both are in order.
    # (swapped is an argument of arrays_zip: inside a lambda it would be made again for every gap.)
    swapped = F.transform("__found", lambda v: F.coalesce(F.element_at(F.col("__map"), v), v))
    gaps = F.split(F.col(text_col), F.coalesce("__again", F.lit(ENTITY)), -1)
    pieces = F.arrays_zip(gaps.alias("gap"), swapped.alias("new"))
    rebuilt = F.array_join(F.transform(pieces, lambda p: F.concat(F.coalesce(p["gap"], F.lit("")), F.coalesce(p["new"], F.lit("")))), "")
    count = F.size(F.filter(F.transform("__found", lambda v: F.element_at(F.col("__map"), v)), lambda x: x.isNotNull()))
    count = F.greatest(count, F.lit(0)).cast("long")
    some = some.withColumn("__n_entities", count).withColumn("__new", F.when(count > 0, rebuilt).otherwise(F.col(text_col)))
    some = some.withColumn(text_col, F.col("__new")).select(*docs.columns, "__n_entities")
    none = marked.filter(F.size("__found") == 0).withColumn("__n_entities", F.lit(0).cast("long")).select(*docs.columns, "__n_entities")
    return some.unionByName(none)


def pii_report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, the text with surrogates and the number of replaced strings of every row."""
    return replace_pii(docs.select("doc_id", "text"), key=key).select("doc_id", "text", F.col("__n_entities").alias("n_entities"))
