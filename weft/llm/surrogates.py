"""Surrogates for personal data, in DataFrame functions alone.

A text is cut along one pattern into entities and what stands between them. Each entity gets a keyed replacement of its
own type, format and script: digits become digits, letters letters of the same case, punctuation and length stay; the
prefix that tells a kind of secret stays, check digits of cards and bank accounts are right. The same entity gets the
same replacement everywhere (it is a function of the key, the type and the entity's normal form), so coreference holds
within and across documents.

A person's title stays; given and family name are replaced each by itself, by one of the same gender and script, so that
"Mr John Smith", "Mr. Smith" and "Mrs Smith" keep what they have in common. A document that names a person with a title
also has that person's names replaced where they stand without one. (Names that never have a title in their document are
not found.)

Distinct entities must stay distinct. All distinct entities are gathered once; those whose replacement another entity
has already, or that is itself an entity of the corpus, draw again with the next salt until none is left. With the salt
the space to draw from grows: names get a further syllable each time, e-mail addresses longer suffixes, IP addresses a
larger network. Numbers keep their length; where an input holds more of them than can have distinct surrogates (about
half of all numbers of a format), the query fails. Only the entities that draw again
need a table: every other entity's replacement is computed where it stands, so an entity that is in a third of all rows
needs no join and no shuffle of texts.

Null texts stay null, empty ones empty. Repeated rows each return their row. A column of the input that has the name of
the added one stays, and the added one is called with an underscore more in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import free_name, prepare, table

#: What counts as an entity, in order of preference where several would match at one place.
TYPES = {
    "email": r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b\d(?:[ -]?\d){12,18}\b",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9A-Fa-f]{32,64})\b",
    "man": r"\b(?:Mr|Herr|Señor|Sr|Monsieur)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?|(?<!\p{L})господин \p{Lu}\p{Ll}+",
    "woman": r"\b(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?|(?<!\p{L})госпожа \p{Lu}\p{Ll}+",
}
ANY = "|".join(TYPES.values())
#: Given names by gender and script, and family names by script.
NAMES = {
    ("man", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karim Louis Marco Noah Oscar Paul Rafael Simon Tom Victor".split(),
    ("woman", "latin"): "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("man", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим".split(),
    ("woman", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Ольга".split(),
}
FAMILY = {"latin": "Abel Brandt Costa Dumont Evans Fischer Garcia Hansen Ibsen Jansen Keller Lopez Moreau Novak Olsen Perez Quint Rossi Silva Tanner".split(), "cyrillic": "Белов Волков Громов Жуков Зайцев Козлов Лебедев Морозов Новик Орлов".split()}
#: A text without any of these has no entity; looking for them first is cheap.
SIGN = r"[@0-9]|\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señora?|Sra?|Monsieur|Madame)\b|госп|AKIA|gh[pousr]_|sk-|[0-9A-Fa-f]{32}"
#: Secrets that are one number whatever their case.
HEXADECIMAL = "^[0-9A-Fa-f]{32,64}$"
KEY = "weft"
#: What tells a kind of secret, and what a person's names are in the table of entities.
PREFIXES = ["AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]
PERSONS, FAMILIES = ("man", "woman"), "family"
#: Colliding entities up to this number are sent to all executors, in so many small maps; beyond it they are joined by a
#: shuffle.
BROADCAST_CLASHES, SLOTS = 100_000, 1024
#: After so many draws entities still clash only if their format has too few other members; this is an error.
SALTS = 200
#: The salt from which IP addresses are drawn from the larger network.
WIDE = 8
#: A further syllable is added to names for each salt, up to this number.
SYLLABLES = 16


def written(text: str) -> Column:
    """The entities of a text in order."""
    return F.when(F.col(text).rlike(SIGN), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES.items()):
        found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


def normal(kind: Column, entity: Column) -> Column:
    """What stays the same however an entity is written."""
    digits = F.regexp_replace(entity, r"[ .()-]", "")
    return F.when(kind.isin("card", "ssn", "phone", "iban"), digits).when((kind == "email") | (kind == "secret") & entity.rlike(HEXADECIMAL), F.lower(entity)).otherwise(entity)


def stream(key: str, kind: Column, name: Column, salt: Column) -> Column:
    """128 hexadecimal digits that follow from the key and the entity."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, name, salt.cast("string")).cast("binary"), 512)


def nibbles(code: Column, at: Column, n: int) -> Column:
    """n hexadecimal digits at a place as a number; places wrap around."""
    return F.conv(F.substring(F.concat(code, code), at % 128 + 1, F.lit(n)), 16, 10).cast("int")


def respell(entity: Column, code: Column) -> Column:
    """Every digit another digit and every letter another letter of its case; other characters stay.

    Positions count letters and digits only, so that two ways to write a number get the same digits.
    """
    chars = F.split(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""), "")
    plain = F.transform(
        chars,
        lambda c, i: F.when(c.rlike(r"^\d$"), F.pmod(nibbles(code, i * 3, 2) + i, F.lit(10)).cast("string"))
        .when(c.rlike(r"^\p{Lu}$"), F.char(F.pmod(nibbles(code, i * 3, 2) + i, F.lit(26)) + 65))
        .otherwise(F.char(F.pmod(nibbles(code, i * 3, 2) + i, F.lit(26)) + 97)),
    )
    # The other characters of the entity, put back between the new ones.
    runs = F.split(entity, r"[\p{L}\p{N}]", -1)
    return F.concat(F.element_at(runs, 1), F.array_join(F.zip_with(plain, F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), lambda c, gap: F.concat(F.coalesce(c, F.lit("")), F.coalesce(gap, F.lit("")))), ""))


def hexadecimal(entity: Column, code: Column) -> Column:
    """Other digits in the case of the given ones; of mixed case, each in the case of the one in its place."""
    made = F.substring(F.concat(code, F.sha2(code.cast("binary"), 512)), F.lit(1), F.length(entity))
    mixed = F.array_join(F.zip_with(F.split(entity, ""), F.split(made, ""), lambda a, b: F.when(a.rlike("[A-F]"), F.upper(b)).otherwise(b)), "")
    return F.when(~entity.rlike("[A-F]"), made).when(~entity.rlike("[a-f]"), F.upper(made)).otherwise(mixed)


def pick(words: list[str], code: Column, at: int | Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(words)), " "), nibbles(code, at if isinstance(at, Column) else F.lit(at), 6) % len(words) + 1)


def script_of(name: Column, made) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin"))


def longer(name: Column, words: list[str], code: Column, salt: Column) -> Column:
    """A syllable more for each salt, which makes ten or twenty times as many names."""
    more = F.transform(F.sequence(F.lit(1), F.least(salt, F.lit(SYLLABLES))), lambda i: pick([x.lower() for x in words], code, i * 7 + 17))
    return F.when(salt > 0, F.concat(name, F.array_join(more, ""))).otherwise(name)


def given_name(kind: str, name: Column, salt: Column, key: str) -> Column:
    code = stream(key, F.lit(kind), name, salt)
    return script_of(name, lambda script: longer(pick(NAMES[kind, script], code, 0), NAMES[kind, script], code, salt))


def family_name(name: Column, salt: Column, key: str) -> Column:
    code = stream(key, F.lit(FAMILIES), name, salt)
    return script_of(name, lambda script: longer(F.concat(pick(FAMILY[script], code, 8), pick([x.lower() for x in FAMILY[script]], code, 16)), FAMILY[script], code, salt))


def given_of(entity: Column) -> Column:
    words = F.split(entity, " ")
    return F.when(F.size(words) > 2, words[1])


def family_of(entity: Column) -> Column:
    return F.substring_index(entity, " ", -1)


def address(entity: Column, code: Column) -> Column:
    """An address in 10.0.0.0/8, whose 24 free bits follow from the code."""
    return F.concat_ws(".", F.lit("10"), *(nibbles(code, F.lit(k), 2).cast("string") for k in (0, 2, 4)))


def wide_address(code: Column) -> Column:
    """An address in 240.0.0.0/4, which is reserved, whose 28 free bits follow from the code."""
    return F.concat_ws(".", (nibbles(code, F.lit(6), 1) + 240).cast("string"), *(nibbles(code, F.lit(k), 2).cast("string") for k in (0, 2, 4)))


def luhn(number: Column) -> Column:
    """A card number with its last digit set so that its check sum holds."""
    digits = F.regexp_replace(number, r"\D", "")
    body = F.split(F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1)), "")
    doubled = F.transform(body, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    last = (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10
    return F.concat(F.substring(number, F.lit(1), F.length(number) - 1), last.cast("string"))


def bank_account(entity: Column, spelled: Column) -> Column:
    """The respelled account in the same country, with the check digits that ISO 7064 asks for."""
    account = F.substring(spelled, F.lit(5), F.length(entity))
    chars = F.split(F.concat(F.regexp_replace(account, " ", ""), F.substring(entity, 1, 2), F.lit("00")), "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike(r"^\d$"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return F.concat(F.substring(entity, 1, 2), F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)


def surrogate(kind: Column, entity: Column, name: Column, salt: Column, key: str) -> Column:
    code = stream(key, kind, name, salt)
    spelled = respell(entity, code)
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    return (
        F.when(kind == "email", F.concat(respell(F.lower(local), code), F.lit("."), F.substring(code, F.lit(1), F.least(salt, F.lit(20)) * 2 + 6), F.lit("@"), F.lit("example."), F.substring_index(F.lower(host), ".", -1)))
        .when((kind == "ip") & (salt >= WIDE), wide_address(code))
        .when(kind == "ip", address(entity, code))
        .when(kind == "iban", bank_account(entity, spelled))
        .when(kind == "card", luhn(spelled))
        .when(kind == "phone", F.when(entity.startswith("+"), F.concat(F.regexp_extract(entity, r"^\+\d{1,3}?(?=[ .(-]|\d)", 0), F.substring(spelled, F.length(F.regexp_extract(entity, r"^\+\d{1,3}?(?=[ .(-]|\d)", 0)) + 1, F.length(entity)))).otherwise(spelled))
        .when((kind == "secret") & entity.rlike(HEXADECIMAL), hexadecimal(entity, code))
        .when(kind == "secret", keep_prefix(entity, spelled))
        .otherwise(spelled)
    )


def keep_prefix(entity: Column, spelled: Column) -> Column:
    made = spelled
    for p in PREFIXES:
        made = F.when(entity.startswith(p), F.concat(F.lit(p), F.substring(spelled, F.lit(len(p) + 1), F.length(entity)))).otherwise(made)
    return made


def drawn(kind: Column, entity: Column, name: Column, salt: Column, key: str) -> Column:
    """The replacement of a row of entities(): of an entity, or of one of a person's names."""
    made = F.when(kind == FAMILIES, family_name(name, salt, key))
    for k in PERSONS:
        made = made.when(kind == k, given_name(k, name, salt, key))
    return made.otherwise(surrogate(kind, entity, name, salt, key))


def entities(documents: DataFrame) -> DataFrame:
    """kind, name (normal form), entity (one way to write it) of the distinct entities of all texts; given and family
    names instead of persons."""
    found = documents.select(F.explode(F.array_distinct(written("text"))).alias("entity")).distinct().withColumn("kind", kind_of(F.col("entity")))
    kind, entity = F.col("kind"), F.col("entity")
    names = F.array(F.struct(F.lit(FAMILIES).alias("kind"), family_of(entity).alias("entity")), F.struct(kind.alias("kind"), given_of(entity).alias("entity")))
    parts = F.when(kind.isin(*PERSONS), F.filter(names, lambda p: p["entity"].isNotNull())).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("entity"))))
    found = found.select(F.explode(parts).alias("p")).select("p.kind", "p.entity").withColumn("name", normal(kind, entity))
    return found.groupBy("kind", "name").agg(F.min("entity").alias("entity"))


def clashes(found: DataFrame, key: str) -> DataFrame:
    """kind, name, salt of the entities whose first replacement isn't theirs alone: a salt with which it is.

    Of the entities that draw the same replacement one keeps it; what another has kept in an earlier round or what is an
    entity itself is kept by none. Only the entities without one go on to the next round, which draws twice as many salts
    for each and takes the first that holds.
    """
    of = F.when(F.col("kind").isin(*PERSONS), FAMILIES).otherwise(F.col("kind")).alias("of")  # all names are one class
    found = found.select("kind", "name", "entity", of).checkpoint()
    real = found.select("of", F.col("name").alias("made"))
    left, kept, salts, low, high = found, None, None, 0, 1
    while low < SALTS:
        salted = left.withColumn("salt", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        made = drawn(F.col("kind"), F.col("entity"), F.col("name"), F.col("salt"), key)
        free = salted.withColumn("made", normal(F.col("kind"), made)).join(real, ["of", "made"], "left_anti")
        if kept is not None:
            free = free.join(kept, ["of", "made"], "left_anti")
        owner = free.groupBy("of", "made").agg(F.min(F.struct("salt", "name", "kind")).alias("first"))
        best = owner.groupBy("first.kind", "first.name").agg(F.min(F.struct("first.salt", "made", "of")).alias("best"))
        now = best.select("kind", "name", "best.salt", "best.made", "best.of").checkpoint()
        left = left.join(now, ["kind", "name"], "left_anti").checkpoint()
        kept = now.select("of", "made") if kept is None else kept.unionByName(now.select("of", "made"))
        moved = now.where("salt > 0").select("kind", "name", "salt")
        salts = moved if salts is None else salts.unionByName(moved)
        if left.isEmpty():
            return salts
        low, high = high, high + 2 * (high - low)
    few = {r.kind: r["count"] for r in left.groupBy("kind").count().collect()}
    raise RuntimeError(f"entities without a surrogate of their own after {low} draws, by kind: {few}")


def replace(documents: DataFrame, key: str = KEY) -> DataFrame:
    """The given columns with text replaced, and found: kind, entity and made (its replacement) of each entity in order."""
    spark = documents.sparkSession
    prepare(spark)
    added, work, row, table_ = (free_name(documents, c) for c in ("found", "__work", "__row", "__salts"))
    salts = clashes(entities(documents.select("text")), key).checkpoint()
    n = salts.count()
    described = F.transform(written("text"), lambda e: F.struct(kind_of(e).alias("kind"), e.alias("entity"), normal(kind_of(e), e).alias("name")))
    rows = documents.withColumn(work, described)
    name_of = lambda kind, name: F.concat_ws("\u0001", kind, name)

    def made(e: Column, salt) -> Column:
        whole = surrogate(e["kind"], e["entity"], e["name"], salt(e["kind"], e["name"]), key)
        family = family_name(family_of(e["entity"]), salt(F.lit(FAMILIES), family_of(e["entity"])), key)
        given = F.lit(None).cast("string")
        for k in PERSONS:
            given = F.when(e["kind"] == k, given_name(k, given_of(e["entity"]), salt(F.lit(k), given_of(e["entity"])), key)).otherwise(given)
        given = F.when(given_of(e["entity"]).isNotNull(), given)
        person = F.concat_ws(" ", F.substring_index(e["entity"], " ", 1), given, family)
        return F.struct(e["kind"].alias("kind"), e["entity"].alias("entity"), F.when(e["kind"].isin(*PERSONS), person).otherwise(whole).alias("made"))

    if n == 0:
        rows = rows.withColumn(work, F.transform(work, lambda e: made(e, lambda kind, name: F.lit(0))))
    elif n <= BROADCAST_CLASHES:
        slot = lambda kind, name: F.pmod(F.xxhash64(kind, name), F.lit(SLOTS)).cast("int")
        maps: list[dict] = [{} for _ in range(SLOTS)]
        for r in salts.select(slot(F.col("kind"), F.col("name")).alias("slot"), name_of(F.col("kind"), F.col("name")).alias("of"), "salt").collect():
            maps[r.slot][r.of] = r.salt
        listed = spark.createDataFrame([(maps,)], f"{table_} array<map<string,int>>")
        rows = rows.join(F.broadcast(listed))
        salt = lambda kind, name: F.coalesce(F.try_element_at(F.get(F.col(table_), slot(kind, name)), name_of(kind, name)), F.lit(0))
        rows = rows.withColumn(work, F.transform(work, lambda e: made(e, salt))).drop(table_)
    else:
        # Texts that hold a clashing entity fetch the salts of their entities; the others are done where they are.
        numbered = rows.withColumn(row, F.monotonically_increasing_id()).checkpoint()
        parts = lambda e: F.filter(F.array(F.struct(e["kind"].alias("kind"), F.when(e["kind"].isin(*PERSONS), given_of(e["entity"])).otherwise(e["name"]).alias("name")), F.struct(F.lit(FAMILIES).alias("kind"), F.when(e["kind"].isin(*PERSONS), family_of(e["entity"])).alias("name"))), lambda p: p["name"].isNotNull())
        asked = numbered.select(row, F.explode(F.array_distinct(F.flatten(F.transform(work, parts)))).alias("e")).select(row, "e.kind", "e.name").join(salts, ["kind", "name"])
        listed = asked.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(name_of(F.col("kind"), F.col("name")), "salt"))).alias(table_))
        rows = numbered.join(listed, row, "left")
        salt = lambda kind, name: F.when(F.col(table_).isNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at(table_, name_of(kind, name)), F.lit(0)))
        rows = rows.withColumn(work, F.transform(work, lambda e: made(e, salt))).drop(row, table_)

    # Where a person's names stand without a title: words of the text between entities.
    persons = F.filter(work, lambda e: e["kind"].isin(*PERSONS))
    pairs = F.flatten(F.transform(persons, lambda e: F.arrays_zip(F.slice(F.split(e["entity"], " "), 2, 2).alias("word"), F.slice(F.split(e["made"], " "), 2, 2).alias("made"))))
    rows = rows.withColumn(table_, F.when(F.size(persons) > 0, pairs))

    def mentions(piece: Column) -> Column:
        words = F.split(piece, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})", -1)
        of = lambda w: F.try_element_at(F.filter(table_, lambda p: p["word"] == w), F.lit(1))["made"]
        return F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^\p{Lu}\p{Ll}"), F.coalesce(of(w), w)).otherwise(w)), "")

    between = F.split("text", f"(?:{ANY})", -1)
    joined = lambda first: F.array_join(F.zip_with(between, work, lambda a, e: F.concat(first(a), F.coalesce(e["made"], F.lit("")))), "")
    text = F.when(F.size(work) == 0, F.col("text")).when(F.col(table_).isNotNull(), joined(mentions)).otherwise(joined(lambda a: a))
    return rows.withColumn("text", text).withColumn(added, F.coalesce(work, F.array().cast("array<struct<kind:string,entity:string,made:string>>"))).drop(work, table_)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda e: e["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", "text", F.size("found").cast("bigint").alias("n_entities"), F.size(F.array_distinct("found")).cast("bigint").alias("n_distinct"), *map(count, TYPES))
