"""Personal data replaced by surrogates that keep its type, format, script and gender.

Every detected entity has a canonical form (the digits of a number, a lower-case
address), so that mentions written differently are one entity. A keyed digest of
it makes the surrogate. Surrogates are compared with each other and with all
originals, and made again with another attempt until no two entities share one;
so distinct entities stay distinct and mentions of one stay together, across the
whole table. Without the key nothing leads back.

Everything here is DataFrame and SQL expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ROW, keyed, write_shared
from framesift.operators.skew import HOT_ROWS, hot_keys, salted_join

FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "Κυρία")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
OTHER_TITLES = ("Dr", "Prof")

_TITLES = "|".join((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES))

#: Small words within a name.
PARTICLES = "de|del|della|da|di|du|la|le|van|von|der|den|ten|ter|zu|zur|bin|al|y"

#: A word of a name: Anna, McDonald, O'Brien, or an initial before another one.
_NAME_WORD = r"(?:\p{Lu}\.(?= ?\p{Lu})|\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:(?:['’])?\p{Lu}\p{Ll}++)*+)"

#: What is looked for, in order of precedence. Repetitions are bounded where the
#: entity's length is, and possessive where it is not (secrets, keys, names), so a
#: long text takes time in proportion to its length. A name goes on as long as
#: capitalised words follow.
PATTERNS = {
    "secret": r"(?i:(?<![\p{L}\p{N}])(?:token|api[_-]?key|secret|password|passwd)\s{0,3}[:=]\s{0,3}[\"']?)(?:[A-Za-z0-9_\-]{12,}+|(?=[A-Za-z_\-]{0,10}\d)[A-Za-z0-9_\-]{6,11}+)"
    r"|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?=[A-Z0-9]{0,30}\d)[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?=[A-Fa-f:]{0,30}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])",
    "phone": r"(?<![\w+])\+?\d{0,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)|(?<![\w+])(?:\+\d{1,3}[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)",
    "card": r"(?<!\d)\d{4}(?:[ \-]\d{4}){3}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "national": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-fA-F]*+\d)(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "person": rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? )++(?:(?:{PARTICLES}) )*+{_NAME_WORD}(?:[ \-](?:(?:{PARTICLES}) )*+{_NAME_WORD}(?!\p{{L}}))*+(?!\p{{L}})",
}

_NUMBERS = ("ip", "phone", "card", "national")


def _either(kinds: list[str]) -> str:
    return "|".join(f"(?:{PATTERNS[kind]})" for kind in kinds)


#: One pattern for all. Most places fail at its first look: words are tried at
#: their first letter only, numbers at a digit or the sign before one.
ANY = (
    rf"(?<![A-Za-z0-9])(?:{_either([kind for kind in PATTERNS if kind not in _NUMBERS])})"
    rf"|(?=[\d+(])(?:{_either(list(_NUMBERS))})"
)

_SECRET_HEAD = r"^(\p{L}+[_-]?\p{L}*\s*[:=]\s*[\"']?|AKIA|gh[pousr]_)"
_PERSON_HEAD = rf"^((?:(?:{_TITLES})\.? )+)"

#: Digits of a phone number that tell numbers apart; those before are the country's and stay.
PHONE_DIGITS = 10

#: Letters of the scripts that names and addresses are written in.
ALPHABETS = {
    "[a-zß-ÿœ]": "abcdefghijklmnopqrstuvwxyz",
    "[A-ZÀ-Þ]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя",
    "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω",
    "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "[0-9]": "0123456789",
}

#: Syllables of names and their endings for women, men and where the title doesn't say.
NAMES = {
    "latin": ("ba be do fe ga ka le li ma mi na ne ra ro sa to".split(), {"f": "lia", "m": "ron", "n": "len"}),
    "cyrillic": ("ба бе до фе га ка ле ли ма ми на не ра ро са то".split(), {"f": "лия", "m": "рон", "n": "лен"}),
    "greek": ("βα βε δο φε γα κα λε λι μα μι να νε ρα ρο σα το".split(), {"f": "λια", "m": "ρος", "n": "λεν"}),
}

#: Characters of an entity above which its surrogate is made from its digest, in time proportional to its length.
LONG = 128

#: Attempts after which a surrogate may grow longer than its original.
SAME_LENGTH_ATTEMPTS = 4


def _kind(value: Column) -> Column:
    kind = None
    for name, pattern in PATTERNS.items():
        test = value.rlike(f"^(?:{pattern})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("card")  # a number told apart only by what stands around it


def _head(kind: Column, value: Column) -> Column:
    """What stands before the entity within its match and stays: the name of a secret, a title."""
    return (
        F.when(kind == "secret", F.regexp_extract(value, _SECRET_HEAD, 1))
        .when(kind == "person", F.regexp_extract(value, _PERSON_HEAD, 1))
        .otherwise("")
    )


def _gender(head: Column) -> Column:
    titles = F.split(F.regexp_replace(head, r"\.", ""), " ")
    told = [F.arrays_overlap(titles, F.array(*(F.lit(t) for t in some))) for some in (FEMALE_TITLES, MALE_TITLES)]
    return F.when(told[0], "f").when(told[1], "m").otherwise("n")


def _canonical(kind: Column, body: Column, gender: Column) -> Column:
    digits = F.regexp_replace(body, r"\D", "")
    return (
        F.when(kind == "phone", F.right(digits, F.lit(PHONE_DIGITS)))
        .when(kind.isin("card", "national"), digits)
        .when(kind == "iban", F.replace(body, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "hex", "ipv6"), F.lower(body))
        .when(kind == "person", F.concat_ws(":", gender, F.lower(body)))
        .otherwise(body)
    )


def mentions(rows: DataFrame) -> DataFrame:
    """(row key, place, kind, value, body, canonical) of each match in ``_text``, in order."""
    # the outer form: for the inner one Spark looks for the matches twice, once to see if there are any
    matches = F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))
    found = rows.select(ROW, F.posexplode_outer(matches).alias("place", "value")).filter("value IS NOT NULL")
    found = found.withColumn("kind", _kind(F.col("value"))).withColumn("head", _head(F.col("kind"), F.col("value")))
    found = found.withColumn("body", F.expr("substring(value, length(head) + 1)"))
    # a key is the same entity with and without its name before it
    is_hex = (F.col("kind") == "secret") & F.col("body").rlike(f"^(?:{PATTERNS['hex']})$")
    found = found.withColumn("kind", F.when(is_hex, "hex").otherwise(F.col("kind")))
    return found.withColumn("canonical", _canonical(F.col("kind"), F.col("body"), _gender(F.col("head"))))


def with_genders(found: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`mentions` whose titles say nothing of the gender given that of the others of the same name, if they agree.

    So Dr Anna Schmidt and Frau Anna Schmidt are one person, but Herr Schmidt and Frau Schmidt are two.
    """
    people = found.filter("kind = 'person'").withColumn("name", F.expr("substring(canonical, 3)"))
    told = people.groupBy("name").agg(*(F.max(F.col("canonical").startswith(g)).alias(g) for g in "fm"), F.count("*").alias("n"))
    told = write_shared(told, "genders")
    agreed = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n")
    named = salted_join(people, told.select("name", agreed.alias("agreed")), ["name"], hot_keys(told, ["name"], hot_rows), F.col(ROW))
    whole = F.when(F.col("canonical").startswith("n"), F.concat_ws(":", "agreed", "name")).otherwise(F.col("canonical"))
    named = named.withColumn("canonical", whole).select(*found.columns)
    return found.filter("kind != 'person'").unionAll(named)


def _number(digest: Column, i: Column) -> Column:
    """The i-th byte of a hexadecimal digest, starting over at its end."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def _characters(value: Column) -> Column:
    return F.split(value, "")


def _shaped(value: Column, digest: Column) -> Column:
    """Every letter and digit replaced by one of its alphabet, other signs kept."""

    def one(c: Column, i: Column) -> Column:
        number = _number(digest, i)
        chosen = None
        for pattern, letters in ALPHABETS.items():
            test, pick = c.rlike(pattern), _pick(letters, number)
            chosen = F.when(test, pick) if chosen is None else chosen.when(test, pick)
        return chosen.when(c.rlike(r"\p{L}"), _pick(ALPHABETS["[a-zß-ÿœ]"], number)).otherwise(c)

    return F.array_join(F.transform(_characters(value), one), "")


def _luhn(digits: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        n = c.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(_characters(F.reverse(digits)), one), F.lit(0), lambda a, x: a + x)


def _card(digits: Column, digest: Column) -> Column:
    """The same first digit, and the same remainder of the check sum, so valid numbers stay valid."""
    middle = _shaped(F.expr("substring(canonical, 2, length(canonical) - 2)"), digest)
    body = F.concat(F.substring(digits, 1, 1), middle)
    check = F.pmod(_luhn(digits) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.concat(body, check.cast("string"))


def _hexed(value: Column, digest: Column) -> Column:
    """Every hexadecimal digit replaced by one, other signs kept."""
    made = F.transform(_characters(value), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(digest, F.pmod(i, F.lit(128)) + 1, F.lit(1))).otherwise(c))
    return F.array_join(made, "")


def _iban(canonical: Column, digest: Column) -> Column:
    """The same country, an account of the same shape, and the check digits that go with them."""
    account = F.upper(_shaped(F.expr("substring(canonical, 5)"), digest))
    country = F.substring(canonical, 1, 2)

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), F.pmod(rest * 10 + F.try_to_number(c, F.lit("9")).cast("int"), F.lit(97))).otherwise(F.pmod(rest * 100 + letter, F.lit(97)))

    rest = F.aggregate(_characters(F.concat(account, country, F.lit("00"))), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _name(canonical: Column, digest: Column, more: Column) -> Column:
    """A made-up name in the script and with the ending of the original's, as many words as it has."""
    gender, body = F.substring(canonical, 1, 1), F.expr("substring(canonical, 3)")

    def in_script(syllables: list[str], endings: dict[str, str]) -> Column:
        listed = F.array(*(F.lit(s) for s in syllables))
        ending = reduce(lambda c, g: c.when(gender == g, endings[g]), "fm", F.when(F.lit(False), "")).otherwise(endings["n"])

        def word(old: Column, i: Column) -> Column:
            parts = F.transform(
                F.sequence(F.lit(0), 2 + more), lambda k: F.get(listed, F.pmod(_number(digest, i * 16 + k), F.lit(len(syllables))))
            )
            made = F.initcap(F.concat(F.array_join(parts, ""), F.when(i == 0, ending).otherwise("")))
            initial = F.concat(F.substring(made, 1, 1), F.lit("."))
            return F.when(old.rlike(r"^\p{L}\.$"), initial).when(old.rlike(f"^(?:{PARTICLES})$"), old).otherwise(made)

        return F.array_join(F.transform(F.split(body, "[ -]"), word), " ")

    return (
        F.when(body.rlike(r"\p{IsCyrillic}"), in_script(*NAMES["cyrillic"]))
        .when(body.rlike(r"\p{IsGreek}"), in_script(*NAMES["greek"]))
        .otherwise(in_script(*NAMES["latin"]))
    )


def _surrogate(key: str, attempt: Column) -> Column:
    """The surrogate of (kind, canonical) in canonical form. The digest is made again for each sign, from the short ``told``."""
    kind, canonical = F.col("kind"), F.col("canonical")

    def digest(*parts: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)

    own = digest(kind, F.col("told"), attempt.cast("string"))
    more = F.greatest(F.lit(0), attempt - SAME_LENGTH_ATTEMPTS + 1)
    extra = F.substring(F.translate(own, "0123456789", "ghijklmnop"), F.lit(1), more)
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    name, last = F.regexp_extract(domain, r"^(.*)\.", 1), F.substring_index(domain, ".", -1)
    email = F.concat(_shaped(local, own), extra, F.lit("@"), _shaped(name, digest(F.lit("domain"), domain)), F.lit("."), last)
    octet = [(1 + F.pmod(_number(own, F.lit(i)), F.lit(254))).cast("string") for i in range(4)]
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", *octet))
        .when(kind == "card", _card(canonical, own))
        .when(kind == "hex", F.substring(F.repeat(own, F.ceil(F.length(canonical) / 128).cast("int")), F.lit(1), F.length(canonical)))
        .when(kind == "person", _name(canonical, own, more))
        .when(kind == "iban", _iban(canonical, own))
        .when(kind == "ipv6", _hexed(canonical, own))
        .otherwise(_shaped(canonical, own))
    )


def surrogates(entities: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical), no two entities of a kind with the same one.

    A surrogate is also none of the originals. Of entities that meet at one,
    the first in order keeps it and the others try again; the joins are on the
    entities alone and end when all have one.
    """
    entities = entities.select("kind", "canonical").distinct()
    long = F.length("canonical") > LONG
    told = F.when(long, F.sha2(F.col("canonical").cast("binary"), 512)).otherwise(F.col("canonical"))
    entities = write_shared(entities.withColumn("told", told), "entities")
    originals = entities.select("kind", F.lower(_plain(F.col("kind"), F.col("canonical"))).alias("low")).distinct()
    accepted: list[DataFrame] = []
    pending = entities
    for attempt in range(most_attempts):
        tried = write_shared(
            pending.withColumn("surrogate", _surrogate(key, F.lit(attempt))).withColumn("low", F.lower("surrogate")),
            "surrogates",
        )
        first = tried.groupBy("kind", "low").agg(F.min("canonical").alias("canonical"))
        good = tried.join(first, ["kind", "low", "canonical"], "left_semi").join(originals, ["kind", "low"], "left_anti")
        if accepted:
            good = good.join(reduce(DataFrame.unionAll, accepted).select("kind", "low"), ["kind", "low"], "left_anti")
        good = write_shared(good.select("kind", "canonical", "surrogate", "low"), "accepted")
        accepted.append(good)
        pending = write_shared(pending.join(good, ["kind", "canonical"], "left_anti"), "pending")
        if pending.isEmpty():
            return reduce(DataFrame.unionAll, accepted).drop("low")
    raise RuntimeError(f"no distinct surrogates after {most_attempts} attempts")


def _plain(kind: Column, canonical: Column) -> Column:
    return F.when(kind == "person", F.expr("substring(canonical, 3)")).otherwise(canonical)


def _rendered() -> Column:
    """The surrogate in the format of one way the entity is written: its separators, its case."""
    kind, body, surrogate = F.col("kind"), F.col("body"), F.col("surrogate")

    def filled(signs: str, first: Column) -> Column:
        """The body with its signs of that kind, from place ``first`` on, replaced by the surrogate's one after the other."""

        def fill(state: Column, c: Column) -> Column:
            told = c.rlike(signs)
            sign = F.when(told & (state["n"] > 0), F.substring(surrogate, state["n"], F.lit(1))).otherwise(c)
            return F.struct(F.concat(state["text"], sign).alias("text"), (state["n"] + told.cast("int")).alias("n"))

        start = F.struct(F.lit("").alias("text"), first.alias("n"))
        return F.aggregate(_characters(body), start, fill)["text"]

    ahead = F.when(kind == "phone", F.length(F.regexp_replace(body, r"\D", "")) - F.length("canonical")).otherwise(0)
    upper = (body == F.upper(body)) & (body != F.lower(body))
    text = (
        F.when(kind.isin("phone", "card", "national"), filled("[0-9]", 1 - ahead))
        .when(kind == "iban", filled("[A-Z0-9]", F.lit(1)))
        .when(kind.isin("email", "hex", "ipv6") & upper, F.upper(surrogate))
        .otherwise(surrogate)
    )
    return F.concat("head", text)


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, text, n_replaced, kinds).

    ``text`` is the whole text with every detected entity replaced; all else in
    it is as it was. ``kinds`` names the kinds found, in order, joined by
    commas. Detected are secrets after a name for them (of less than 12 signs
    only with a digit) and keys known by their beginning, e-mail addresses,
    IBANs, IP addresses, phone, card and national numbers, long hexadecimal
    keys, and names after one or more titles. ``key`` is secret and settles the
    surrogates. Phone numbers are told apart by their last ten digits, and keep
    those before. IBANs and card numbers keep valid check digits.

    A null text stays null, and empty and clean texts stay as they are. Null
    and repeated ids are rows of their own. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = keyed(docs, id_col, _text=text_col)
    found = write_shared(with_genders(write_shared(mentions(rows), "found")), "mentions")
    spelled = found.select("kind", "canonical", "value", "head", "body").distinct()
    made = surrogates(found, key)
    spelled = spelled.join(made, ["kind", "canonical"]).select("kind", "canonical", "value", _rendered().alias("new"))
    spelled = write_shared(spelled, "replacements")
    new = (
        found.select(ROW, "place", "kind", "canonical", "value")
        .join(spelled.hint("merge"), ["kind", "canonical", "value"])
        .groupBy(ROW)
        .agg(F.sort_array(F.collect_list(F.struct("place", "new", "kind"))).alias("new"))
    )
    new = write_shared(new, "document-replacements")

    parts = F.split("_text", ANY)
    joined = F.array_join(F.transform(parts, lambda s, i: F.concat(s, F.coalesce(F.get("new", i)["new"], F.lit("")))), "")
    touched = F.col("new").isNotNull()
    return rows.join(new.hint("merge"), ROW, "left").select(
        *([ROW] if ROW in docs.columns else []),
        F.col("_id").alias(id_col),
        F.when(touched, joined).otherwise(F.col("_text")).alias(text_col),
        F.when(touched, F.size("new")).otherwise(0).cast("long").alias("n_replaced"),
        F.when(touched, F.array_join(F.array_sort(F.array_distinct(F.col("new.kind"))), ",")).otherwise("").alias("kinds"),
    )
