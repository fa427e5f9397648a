"""Column functions on words: transliteration, lemma normalisation, prefixes, and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter pairs that become one letter, then single letters.
PAIRS = {"ai": "E", "au": "O", "kh": "K", "gh": "G", "ch": "C", "jh": "J", "ṭh": "W", "ḍh": "Q", "th": "T", "dh": "D", "ph": "P", "bh": "B"}
SINGLE = {"ā": "A", "ī": "I", "ū": "U", "ṛ": "f", "ṃ": "M", "ṅ": "N", "ñ": "Y", "ṭ": "w", "ḍ": "q", "ṇ": "R", "ś": "S", "ṣ": "z", "ḥ": "H"}
#: Lemmas under other names. The last entry of "va" holds.
SYNONYMS = {"asmad": "mad", "yuzmad": "tvad", "ayam": "idam", "agn": "agni", "ya": "yad", "eza": "etad", "vd": "vid", "va": "iva", "-tva": "tva", "ptta": "pitta", "mahat": "mahant", "ndra": "indra", "ap": "api", "h": "hi", "t": "iti", "tr": "tri"}


def transliterate(c: Column) -> Column:
    """One letter for each sound. Apply once: the result isn't input of the same scheme."""
    for a, b in PAIRS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "".join(SINGLE), "".join(SINGLE.values()))


def before_underscore(c: Column) -> Column:
    return F.substring_index(c, "_", 1)


def normal_lemma(lemma: Column, surface: Column) -> Column:
    """Transliterated, cut at the first underscore, under its main name; yad written yadi is yadi."""
    base = before_underscore(transliterate(lemma))
    known = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    named = F.coalesce(F.try_element_at(known, base), base)
    return F.when((named == "yad") & (surface == "yadi"), "yadi").otherwise(named)


def first_prefix(c: Column, patterns: list[str]) -> Column:
    """The text of the first pattern, in list order, that matches at the start; null if none does."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(c.rlike(f"^(?:{p})"), F.regexp_extract(c, f"^(?:{p})", 0)).otherwise(out)
    return out


def without_prefix(c: Column, patterns: list[str]) -> Column:
    """What stands between the prefix and its next occurrence: the first prefix that matches cuts the whole word."""
    p = first_prefix(c, patterns)
    return F.when(p.isNull() | (p == ""), c).otherwise(F.element_at(F.split(F.substring(c, F.length(p) + F.lit(1), F.length(c)), F.concat(F.lit('\\Q'), p, F.lit('\\E')), -1), 1))


def after_prefix(c: Column, patterns: list[str]) -> Column:
    """What follows the prefix."""
    p = first_prefix(c, patterns)
    return F.when(p.isNull(), c).otherwise(F.substring(c, F.length(p) + F.lit(1), F.length(c)))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def reciprocal_rank(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + c)


def rescaled(c: Column) -> Column:
    """A cosine from -1..1 to 0..1."""
    return (c + F.lit(1.0)) / F.lit(2.0)


def pushed(c: Column, by: float = 0.01) -> Column:
    """Away from zero by a little."""
    return F.when(c >= 0, c + F.lit(by)).otherwise(c - F.lit(by))


#: What the digits of a path code stand for.
PATH_NAMES = {"1": "lemma", "2": "cng", "3": "tup"}


def path_name(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PATH_NAMES.items() for x in pair))
    return F.concat_ws("-", *(F.try_element_at(known, F.substring(code, k, 1)) for k in (1, 2, 3)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
