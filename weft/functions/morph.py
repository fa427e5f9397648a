"""Morphological descriptions to class numbers, as one column expression.

Noun classes lie 20 apart by case, 5 by number and 1 by gender, the adjective after the neuter; verb classes are
-(10 * tense + person and number). Descriptions that don't parse give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cases in order of their classes (the first starts at 29), and the numbers of tenses.
CASES = ["nom", "voc", "acc", "i", "dat", "abl", "g", "loc"]
NUMBERS, GENDERS = ["sg", "du", "pl"], ["m", "f", "n"]
PLAIN = {"pp": 19, "ppa": 20, "pfp": 21, "inf": 22, "abs": 23, "inj": 30}
PASSIVE = {"pr": 24, "ppr": 24, "imp": 26, "impft": 27, "aor": 28, "opt": 29}
ACTIVE = {"pr": 1, "ppr": 1, "opt": 2, "imp": 3, "impft": 4, "pft": 15, "ppf": 15}
FUTURE = {"fut": 5, "pfu": 5, "cond": 6, "ben": 14}
AORIST = {"1": 8, "2": 9, "3": 10, "4": 11, "5": 12, "6": 12, "7": 13}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def fields(config: Column) -> Column:
    """The parts before each period, without spaces; what follows the last period counts if it isn't empty."""
    return F.filter(F.transform(F.split(config, r"\."), lambda x: F.replace(x, F.lit(" "), F.lit(""))), lambda x: x != "")


def after(parts: Column, n: Column) -> Column:
    """The array without its first n members."""
    return F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0)))


def noun(config: Column, compat_mode: bool) -> Column:
    f = fields(config)
    part = lambda k: F.try_element_at(f, F.lit(k))
    case = F.array_position(F.array(*map(F.lit, CASES)), part(1)).cast("int") - 1
    if compat_mode:  # the last two letters of "loc" are found in the vocative's name first
        case = F.when(part(1) == "loc", F.lit(1)).otherwise(case)
    number = F.array_position(F.array(*map(F.lit, NUMBERS)), part(2)).cast("int") - 1
    gender = F.when(part(3) == "*", 3).otherwise(F.array_position(F.array(*map(F.lit, GENDERS)), part(3)).cast("int") - 1)
    return F.when((case >= 0) & (number >= 0) & (gender >= 0), F.lit(29) + 20 * case + 5 * number + gender)


def verb(config: Column) -> Column:
    f = F.transform(fields(F.replace(config, F.lit("vn."), F.lit(""))), lambda x: x)
    f = F.when(F.try_element_at(f, F.lit(1)).isin("ca", "des", "int"), after(f, F.lit(1))).otherwise(f)
    numbers = F.array(*map(F.lit, NUMBERS))
    one = F.try_element_at(f, F.lit(1))
    rest = after(f, F.lit(1))
    number = F.try_element_at(F.filter(rest, lambda x: F.array_contains(numbers, x)), F.lit(1))
    at = F.array_position(rest, number)
    person = F.try_element_at(F.filter(after(rest, F.coalesce(at, F.lit(0)).cast("int")), lambda x: x.isin("1", "2", "3")), F.lit(1))
    before = F.when(number.isNull(), rest).otherwise(F.slice(rest, F.lit(1), (at - 1).cast("int")))
    two, three = F.try_element_at(before, F.lit(1)), F.try_element_at(before, F.lit(2))
    unit = F.when(number.isNull(), 0).otherwise(3 * (F.array_position(numbers, number).cast("int") - 1) + F.coalesce(person.cast("int"), F.lit(1)))
    digit = F.regexp_extract(two, r"\d", 0)
    ten = F.coalesce(
        lookup(PLAIN, one),
        F.when(two == "ps", lookup(PASSIVE, one)),
        F.when((one == "per") & (two == "pft"), 16).when((one == "per") & (two == "fut") & three.isNotNull(), 7),
        F.when(two.isin("ac", "md", "mo"), lookup(ACTIVE, one)),
        lookup(FUTURE, one),
        F.when(one == "aor", lookup(AORIST, digit)),
        F.lit(0),
    )
    value = 10 * ten + unit
    return F.when(value > 0, -value)


def word_class(form: Column, config: Column, compat_mode: bool = False) -> Column:
    """The class of a form; compat_mode: locatives get the vocative's classes."""
    first = F.try_element_at(fields(config), F.lit(1))
    last = F.try_element_at(fields(config), F.lit(-1))
    return (
        F.when(form == "indeclinable", F.when(first.isin("part", "conj", "prep", "ind"), 2).when(last == "abs", -230))
        .when(form == "compound", F.when(first.isin("iic", "iiv"), 3))
        .when(form == "undetermined", F.when(first == "adv", 2).when(first.isin("und", "tasil"), 1))
        .when(form == "noun", noun(config, compat_mode))
        .when(form == "verb", verb(config))
        .cast("int")
    )


def class_set(forms: Column, compat_mode: bool = False) -> Column:
    """The distinct classes of a map from forms to descriptions; the key verbform doesn't count."""
    classes = F.transform(F.map_entries(forms), lambda e: F.when(e["key"] != "verbform", F.transform(e["value"], lambda c: word_class(e["key"], c, compat_mode))))
    return F.array_distinct(F.flatten(F.filter(classes, lambda x: x.isNotNull())))


def first_class(form: Column, configs: Column, compat_mode: bool = False) -> Column:
    """The class of the first of several descriptions."""
    return word_class(form, F.try_element_at(configs, F.lit(1)), compat_mode)
