"""PII surrogates, in DataFrame operations only.

Detected entities are replaced by surrogates of the same kind and form, derived from a secret
key: an address by an address, a number by a number with the same separators (cards and IBANs
keep valid check digits, phones their country code), a name by a name of the same gender and
script. The same entity has the same surrogate everywhere (coreference), and different entities
have different ones (distinctness): the distinct entities of the corpus are folded to one row
each, their surrogates compared with each other and with the corpus' own entities, and those
that collide are derived anew with the next attempt number until none does. From attempt ``WIDEN``
on the form is widened, by one more character with each attempt (digits of numbers, letters of the
rest; an IP address gets a port), so forms that the corpus fills wholly end well too. Only the
entities whose attempt isn't the first one go back to the texts, as a part of the plan if they are
few (``MAX_LITERAL``), else each text is joined with its own exceptions by a shuffle.

A person's name has two parts. The family name's surrogate depends on the family name alone, so
"Mr. Paul Dorn" and "Mr. Dorn" keep one; the given name's depends on the whole name and its gender.
Names are found by their honorific, of which Dr. and Prof. tell no gender (another mention does, else
the key chooses one); names without one are left as they are. Scripts are Latin, Cyrillic and Greek; of another
script's names the surrogate is Latin.

A text is taken apart and put together again in one projection: the gaps between entities come
from splitting at the same pattern that finds them. Texts without entities stay as they are.

Case is kept, and canonical forms (lower case, digits only) decide what is the same entity.

Defined results: a null text stays null and has no entities; repeated rows are returned as often
as they come; a null doc_id stays null; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import is_small, materialize, table

KEY = "tidemill surrogate key"
#: The first attempt that widens an entity's form.
WIDEN = 4
MAX_LITERAL = 500

#: Honorifics, and a capitalised word with its hyphenated and apostrophed parts.
HONORIFICS = "Mr|Mister|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Господин|Госпожа|Κύριος|Κυρία"
NAME_WORD = r"\p{Lu}(?:\p{Ll}*['’\-]?\p{Lu})*\p{Ll}+"

#: What an entity of each kind looks like, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+",
    "secret": r"(?<![A-Za-z])(?i:token|api[_\-]?key|secret|password)\s*[=:]\s*[\"'][^\"'\s]{8,}[\"']",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .\-]?)?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-][0-9]{3,4}|0[0-9]{2,4}[ /\-][0-9]{5,8})(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{HONORIFICS})\.?[ ]{NAME_WORD}(?:[ ]{NAME_WORD})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has one of these; texts without are not searched further.
HINT = rf"[0-9@]|[=:]\s*[\"']|(?:{HONORIFICS})\.?[ ]"

#: Honorifics by the gender that they tell.
MALE = r"^(?:Mr|Mister|Herr|Monsieur|Señor|Sr|Господин|Κύριος)\.?$"
UNSAID = r"^(?:Dr|Prof)\.?$"
#: Names to choose from, by script and gender; then family names by script.
NAMES = {
    ("latin", "m"): "Adrian Bruno Conrad Damian Edgar Felix Gregor Hector Ivan Julian Kaspar Leon Martin Nestor Oscar Pascal Quentin Roland Simon Tobias Ulrich Victor Werner Xavier Yannick Zacharias".split(),
    ("latin", "f"): "Alma Beatrice Clara Dora Edith Flora Greta Helena Irma Johanna Klara Lydia Martha Nora Olivia Paula Quirina Rosa Selma Thea Ursula Vera Wanda Xenia Yvonne Zelda".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Илья Кирилл Лев Матвей Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Ева Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Θωμάς Κώστας Λευτέρης Μανώλης Νίκος Πέτρος Σπύρος Φώτης".split(),
    ("greek", "f"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
}
#: Family names are syllables, and an ending that a family name of the script can have.
SYLLABLES = {
    "latin": "ba be bo bra da de do dra fa fe fo ga ge gra ha he ka ke kla la le lo ma me mo na ne no ra re ro sa se sta ta te tra va ve wa we".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зе ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те".split(),
    "greek": "βα γα γε δα δη θα κα κο λα λε μα με να νι πα πε ρα ρο σα στε τα τε φα φω χα".split(),
}
ENDINGS = {
    "latin": "berg den feld ford ham ler lin man mont ner quist rick son stein ton ville wald worth".split(),
    "cyrillic": "вин дин ков кин лин мов нин нов ров сов тин хин".split(),
    "greek": "κης λης νης πουλος ρης τζης δης ράκης".split(),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _hex(*parts: Column) -> Column:
    """64 hexadecimal digits that depend on the parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def kind_of(entity: Column) -> Column:
    whole = [(k, F.regexp_like(entity, F.lit(f"^(?:{p})$"))) for k, p in PATTERNS.items()]
    out = F.when(whole[0][1], whole[0][0])
    for k, test in whole[1:]:
        out = out.when(test, k)
    return out.otherwise("card")


def canonical(entity: Column, kind: Column) -> Column:
    """What two mentions of one entity have in common."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.regexp_replace(entity, "[^0-9+]", ""))
        .when(kind == "iban", F.upper(F.regexp_replace(entity, " ", "")))
        .when(kind == "secret", F.regexp_extract(entity, "[\"']([^\"']*)[\"']$", 1))
        .when(kind == "name", F.regexp_replace(entity, r"^\S+ ", ""))
        .otherwise(entity)
    )


def _shaped(text: Column, seed: Column) -> Column:
    """``text`` with each digit, letter and capital letter replaced by a keyed one; all else stays."""
    chars = F.split(text, "")
    # three hexadecimal digits for each character, from as many digests as it takes
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 20).cast("int")), lambda i: F.sha2(F.concat(seed, i.cast("string")), 256)), "")

    def one(stream, c, i):
        r = F.conv(F.substr(stream, i * 3 + 1, F.lit(3)), 16, 10).cast("int")
        return (
            F.when(F.regexp_like(c, F.lit("^[0-9]$")), (r % 10).cast("string"))
            .when(F.regexp_like(c, F.lit("^[a-z]$")), F.char(r % 26 + 97))
            .when(F.regexp_like(c, F.lit("^[A-Z]$")), F.char(r % 26 + 65))
            .otherwise(c)
        )

    return _let(stream, lambda s: F.array_join(F.transform(chars, lambda c, i: one(s, c, i)), ""))


def _with_check_digit(number: Column) -> Column:
    """``number``, of any separators, with its last digit set so that the digits pass the card checksum."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    n = F.length(digits)
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 1, doubled(F.substr(digits, i, F.lit(1)).cast("int"))).otherwise(F.substr(digits, i, F.lit(1)).cast("int")),
    )
    return F.concat(F.regexp_replace(number, "[0-9]$", ""), ((F.lit(10) - total % 10) % 10).cast("string"))


def _luhn(digits: Column) -> Column:
    return _with_check_digit(digits) == digits


def _iban(country: Column, body: Column) -> Column:
    """Country, check digits and body of an account number whose remainder by 97 is one."""
    digit = lambda c: F.when(F.regexp_like(c, F.lit("^[0-9]$")), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: _let(digit(c), lambda v: F.when(v > 9, rest * 100 + v).otherwise(rest * 10 + v) % 97)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int"))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _number(seed: Column, salt: str) -> Column:
    return F.conv(F.substr(_hex(seed, F.lit(salt)), F.lit(1), F.lit(7)), 16, 10).cast("long")


def _choose(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def script_of(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(name, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def family_surrogate(family: Column, attempt: Column, key: str = KEY) -> Column:
    """A family name of the same script: three syllables, one more with each widening attempt, and an ending."""

    def of(script: str, seed: Column) -> Column:
        wide = F.greatest(F.lit(0), attempt - (WIDEN - 1))
        several = F.array_join(F.transform(F.sequence(F.lit(1), wide + 3), lambda i: _choose(SYLLABLES[script], F.conv(F.substr(F.sha2(F.concat(seed, i.cast("string")), 256), F.lit(1), F.lit(7)), 16, 10).cast("long"))), "")
        return F.concat(F.initcap(several), _choose(ENDINGS[script], _number(seed, "ending")))

    def chosen(seed: Column) -> Column:
        script = script_of(family)
        return F.when(script == "cyrillic", of("cyrillic", seed)).when(script == "greek", of("greek", seed)).otherwise(of("latin", seed))

    return _let(_hex(F.lit(key), F.lit("family"), F.lower(family), attempt.cast("string")), chosen)


def gender_of(mention: Column) -> Column:
    """1 or 2 where a name's honorific tells a gender, else 0."""
    honorific = F.regexp_extract(mention, r"^(\S+) ", 1)
    return F.when(F.regexp_like(honorific, F.lit(UNSAID)), 0).when(F.regexp_like(honorific, F.lit(MALE)), 1).otherwise(2)


def _given(mention: Column, attempt: Column, gender: Column, seed: Column) -> Column:
    """A given name of the gender that the honorific tells, and of the same script; widened by letters."""
    told = gender_of(mention)
    known = F.when(told > 0, told).when(gender > 0, gender).otherwise(_number(seed, "gender") % 2 + 1)
    male = known == 1
    pick = lambda script: F.when(male, _choose(NAMES[script, "m"], _number(seed, "given"))).otherwise(_choose(NAMES[script, "f"], _number(seed, "given")))
    script = script_of(mention)
    name = F.when(script == "cyrillic", pick("cyrillic")).when(script == "greek", pick("greek")).otherwise(pick("latin"))
    wide = F.greatest(F.lit(0), attempt - (WIDEN - 1))
    # a second given name, of as many syllables as it takes
    more = F.transform(F.sequence(F.lit(1), wide + 1), lambda i: _choose(SYLLABLES["latin"], F.conv(F.substr(F.sha2(F.concat(seed, F.lit("more"), i.cast("string")), 256), F.lit(1), F.lit(7)), 16, 10).cast("long")))
    return F.when(wide > 0, F.concat(name, F.lit("-"), F.initcap(F.array_join(more, "")))).otherwise(name)


def family_of(canon: Column) -> Column:
    """The family name in a name's canonical form: its last word."""
    return F.regexp_extract(canon, r"(\S+)$", 1)


def surrogate(entity: Column, kind: Column, canon: Column, attempt: Column, family_attempt: Column, gender: Column, key: str = KEY) -> Column:
    """The ``attempt``-th replacement of an entity; a function of key, kind and canonical form, in the mention's own format."""
    return _let(_hex(F.lit(key), kind, canon, attempt.cast("string")), lambda seed: _from_seed(entity, kind, canon, attempt, family_attempt, gender, seed, key))


def _from_seed(entity: Column, kind: Column, canon: Column, attempt: Column, family_attempt: Column, gender: Column, seed: Column, key: str) -> Column:
    at = F.locate("@", entity)
    byte = lambda i: (F.conv(F.substr(seed, F.lit(i * 4 + 1), F.lit(4)), 16, 10).cast("long") % 254 + 1).cast("string")
    quote = F.regexp_extract(entity, "^(.*?[\"'])", 1)
    # the country code stays, and the zero that a national number is known by
    country = F.regexp_extract(entity, r"^(\+[0-9]{1,3}[ .\-]?|0(?=[0-9]{2,4}[ /\-][0-9]{5,8}$)|)", 1)
    wide = F.greatest(F.lit(0), attempt - (WIDEN - 1))
    letters, digits = F.repeat(F.lit("x"), wide), F.repeat(F.lit("0"), wide)
    spaced = F.regexp_replace(entity, " ", "")
    account = _iban(F.substr(spaced, F.lit(1), F.lit(2)), _shaped(F.concat(F.substr(spaced, F.lit(5)), digits), seed))
    honorific = F.regexp_extract(entity, r"^(\S+ )", 1)
    family = family_surrogate(family_of(canon), family_attempt, key)
    return (
        F.when(kind == "email", F.concat(_shaped(F.concat(F.substr(entity, F.lit(1), at - 1), letters), seed), F.lit("@"), _shaped(F.regexp_replace(F.substr(entity, at + 1), r"\.[^.]*$", ""), _hex(seed, F.lit("host"))), F.regexp_extract(entity, r"(\.[^.]*)$", 1)))
        .when(kind == "secret", F.concat(quote, F.when(F.regexp_like(canon, F.lit("^[0-9a-f]{1,64}$")) & (wide == 0), F.substr(seed, F.lit(1), F.length(canon))).otherwise(_shaped(F.concat(canon, letters), seed)), F.substr(entity, F.length(entity), F.lit(1))))
        .when(kind == "ip", F.concat(F.concat_ws(".", byte(0), byte(1), byte(2), byte(3)), F.when(wide > 0, F.concat(F.lit(":"), _shaped(digits, _hex(seed, F.lit("port"))))).otherwise("")))
        .when(kind == "iban", _regrouped(entity, account))
        .when((kind == "card") & _luhn(F.regexp_replace(entity, "[^0-9]", "")), _with_check_digit(F.concat(_refill(entity, canon, seed), F.when(wide > 0, _shaped(digits, _hex(seed, F.lit("wide")))).otherwise(""))))
        .when(kind.isin("card", "ssn"), F.concat(_refill(entity, canon, seed), F.when(wide > 0, _shaped(digits, _hex(seed, F.lit("wide")))).otherwise("")))
        .when(kind == "phone", F.concat(country, _refill(F.substr(entity, F.length(country) + 1), F.substr(canon, F.length(F.regexp_replace(country, "[^0-9+]", "")) + 1), seed), F.when(wide > 0, _shaped(digits, _hex(seed, F.lit("wide")))).otherwise("")))
        .when(kind == "name", F.concat(honorific, F.when(F.locate(" ", canon) > 0, F.concat(_given(entity, attempt, gender, seed), F.lit(" "))).otherwise(""), family))
        .otherwise(entity)
    )


def _regrouped(mention: Column, fresh: Column) -> Column:
    """``fresh`` with the mention's spaces, and what is longer than the mention at the end."""
    shape = F.split(mention, "")
    place = F.transform(shape, lambda c, i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), " ", "")))
    body = lambda x: F.concat(F.array_join(F.zip_with(shape, place, lambda c, p: F.when(c == " ", c).otherwise(F.substr(x, p, F.lit(1)))), ""), F.substr(x, F.length(F.regexp_replace(mention, " ", "")) + 1))
    return _let(fresh, body)


def _refill(mention: Column, digits: Column, seed: Column) -> Column:
    """A mention's separators around the keyed digits of its canonical form."""
    shape = F.split(mention, "")
    # each character's place among the digits
    place = F.transform(shape, lambda c, i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), "[^0-9]", "")))
    pick = lambda fresh: F.zip_with(shape, place, lambda c, p: F.when(F.regexp_like(c, F.lit("^[0-9]$")), F.substr(fresh, p, F.lit(1))).otherwise(c))
    return _let(_shaped(digits, seed), lambda fresh: F.array_join(pick(fresh), ""))


def _found(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _hinted() -> Column:
    return F.coalesce(F.col("text").rlike(HINT), F.lit(False))


def _mentions() -> Column:
    return F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))


def _described(mention: Column) -> Column:
    kind = kind_of(mention)
    return F.struct(mention.alias("mention"), kind.alias("kind"), canonical(mention, kind).alias("canon"))


def _settle(spark: SparkSession, known: DataFrame, draw, taken: DataFrame, name: str) -> DataFrame:
    """``known(kind, canon, ...)`` with ``attempt`` and ``surrogate``, of which no two of a kind have one form, or one of ``taken(kind, form)``.

    ``draw`` gives the surrogate and its form. Attempts past ``WIDEN`` draw from ever larger spaces, so this ends.
    """
    known = known.withColumn("attempt", F.lit(0))
    while True:
        drawn = materialize(spark, draw(known), name)
        # of those that share a form, the one with the fewest attempts keeps it; no surrogate is an entity of the corpus
        first = drawn.groupBy("kind", "form").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("rivals"))
        lost = drawn.join(first.where("rivals > 1"), ["kind", "form"]).where("canon <> first.canon").select("kind", "canon")
        same = drawn.join(taken, ["kind", "form"], "left_semi").select("kind", "canon")
        again = materialize(spark, lost.unionByName(same).distinct().withColumn("_again", F.lit(1)), "collisions")
        if again.isEmpty():
            return drawn.drop("form")
        rest = [c for c in known.columns if c not in ("kind", "canon", "attempt")]
        known = drawn.join(again, ["kind", "canon"], "left").select("kind", "canon", *rest, (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt"))


def entities(spark: SparkSession, docs: DataFrame, key: str = KEY) -> DataFrame:
    """``(kind, canon, mention, n, gender, attempt, family_attempt, surrogate)``: one row per distinct entity, with a surrogate like no other.

    ``mention`` is the entity's smallest form; ``surrogate`` is the replacement of that form. Family
    names are entities of their own kind, ``family``.
    """
    mentions = _found(docs).where(_hinted()).select(F.explode(_mentions()).alias("mention"))
    folded = mentions.groupBy("mention").agg(F.count("*").alias("n")).select(_described(F.col("mention")).alias("d"), "n")
    told = F.when(F.col("d.kind") == "name", gender_of(F.col("d.mention")))
    some = F.when(F.max(F.when(told == 1, 1)) == 1, 1).when(F.max(told) == 2, 2).otherwise(0)
    # a gender is kept where one mention tells it and another doesn't
    gender = F.when((F.min(told) == 0) & (F.max(told) > 0), some).otherwise(0)
    each = folded.groupBy("d.kind", "d.canon").agg(F.min("d.mention").alias("mention"), F.sum("n").alias("n"), gender.alias("gender"))
    known = materialize(spark, each, "entities")

    # family names first: the names that hold them depend on them
    lone = known.where("kind = 'name'").select(F.lit("family").alias("kind"), F.lower(family_of(F.col("canon"))).alias("canon"), family_of(F.col("canon")).alias("mention"), "n")
    lone = materialize(spark, lone.groupBy("kind", "canon").agg(F.min("mention").alias("mention"), F.sum("n").alias("n")), "families")
    taken = lone.select("kind", F.col("canon").alias("form"))
    drawn = lambda x: (lambda y: y.withColumn("form", F.lower("surrogate")))(x.withColumn("surrogate", family_surrogate(F.col("mention"), F.col("attempt"), key)))
    families = _settle(spark, lone, drawn, taken, "family-surrogates")

    own = families.select(F.col("canon").alias("_family"), F.col("attempt").alias("family_attempt"))
    with_family = known.join(own, (F.col("kind") == "name") & (F.lower(family_of(F.col("canon"))) == F.col("_family")), "left").drop("_family")
    with_family = materialize(spark, with_family.withColumn("family_attempt", F.coalesce("family_attempt", F.lit(0))), "entities")
    taken = known.select("kind", F.col("canon").alias("form"))

    def draw(x: DataFrame) -> DataFrame:
        drawn = x.withColumn("surrogate", surrogate(F.col("mention"), F.col("kind"), F.col("canon"), F.col("attempt"), F.col("family_attempt"), F.col("gender"), key))
        return drawn.withColumn("form", canonical(F.col("surrogate"), F.col("kind")))

    settled = _settle(spark, with_family, draw, taken, "surrogates")
    return settled.unionByName(families.withColumn("family_attempt", F.col("attempt")).withColumn("gender", F.lit(0)))


def replace_entities(spark: SparkSession, docs: DataFrame, key: str = KEY) -> DataFrame:
    """``(doc_id, text, n_entities, kinds)``: every document, with its entities replaced."""
    known = entities(spark, docs, key)
    odd = known.where("attempt > 0").select("kind", "canon", "attempt")
    odd = odd.unionByName(known.where("gender > 0").select(F.lit("gender").alias("kind"), "canon", F.col("gender").alias("attempt")))
    odd = materialize(spark, odd, "exceptions")
    found = _found(docs)
    label = lambda kind, canon: F.concat_ws("\x1f", kind, canon)
    if is_small(odd, MAX_LITERAL):
        pairs = [F.lit(x) for r in odd.collect() for x in (f"{r[0]}\x1f{r[1]}", r[2])]
        looked_up = (lambda k: F.coalesce(F.element_at(F.create_map(*pairs), k), F.lit(0))) if pairs else (lambda k: F.lit(0))
    else:
        # more exceptions than a plan should hold: each text finds its own; rows are numbered once, on disk
        rows = materialize(spark, found.withColumn("_row", F.monotonically_increasing_id()), "rows")
        each = rows.where(_hinted()).select("_row", F.explode(_mentions()).alias("mention")).select("_row", _described(F.col("mention")).alias("d"))
        asked = each.select("_row", F.explode(F.array(label(F.col("d.kind"), F.col("d.canon")), label(F.lit("gender"), F.col("d.canon")), label(F.lit("family"), F.lower(family_of(F.col("d.canon")))))).alias("k")).distinct()
        own = asked.join(odd.select(label(F.col("kind"), F.col("canon")).alias("k"), "attempt"), "k")
        own = own.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("odd"))
        found = rows.join(own, "_row", "left")
        looked_up = lambda k: F.coalesce(F.element_at(F.col("odd"), k), F.lit(0))
    gaps = F.split("text", ENTITY, -1)

    def swap(d: Column) -> Column:
        family = F.when(d["kind"] == "name", looked_up(label(F.lit("family"), F.lower(family_of(d["canon"]))))).otherwise(0)
        return surrogate(d["mention"], d["kind"], d["canon"], looked_up(label(d["kind"], d["canon"])), family, looked_up(label(F.lit("gender"), d["canon"])), key)

    def rebuilt(described: Column) -> Column:
        swaps = F.transform(described, swap)
        text = F.array_join(F.zip_with(gaps, F.concat(swaps, F.array(F.lit(""))), lambda gap, swap: F.concat(gap, swap)), "")
        kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(described, lambda d: d["kind"]))), ",")
        return F.struct(F.when(F.size(described) > 0, text).otherwise(F.col("text")).alias("text"), F.size(described).alias("n"), kinds.alias("kinds"))

    searched = _let(_mentions(), lambda mentions: _let(F.transform(mentions, _described), rebuilt))
    as_is = F.struct(F.col("text").alias("text"), F.lit(0).alias("n"), F.lit("").alias("kinds"))
    # one struct per text, exploded from an array of one, so that its fields don't repeat the search
    out = found.select("doc_id", F.explode(F.array(F.when(_hinted(), searched).otherwise(as_is))).alias("r"))
    return out.select("doc_id", F.col("r.text").alias("text"), F.col("r.n").alias("n_entities"), F.col("r.kinds").alias("kinds"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark, table(spark, sf_dir, "documents"))
