"""Look-alike expressions: skeletons, their variants, label tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CONFUSABLES, DIGRAPHS, MIN_ALIAS_LENGTH
from .urls import wide

_ASCII = {k: v for k, v in CONFUSABLES.items() if k.isascii()}


def ascii_skeleton(value: Column) -> Column:
    """The skeleton of an ASCII text: lower case, look-alike digits mapped, other characters dropped."""
    mapped = F.translate(F.lower(value), "".join(_ASCII), "".join(_ASCII.values()))
    return F.regexp_replace(mapped, "[^a-z0-9]", "")


def skeleton(value: Column) -> Column:
    """The skeleton of any text: compatible characters decomposed, look-alikes mapped, all but letters and digits dropped."""
    plain = F.lower(F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), value, F.lit(True)))
    mapped = F.translate(plain, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))
    return F.when(wide(value), F.regexp_replace(mapped, "[^\\p{L}\\p{N}]", "")).otherwise(ascii_skeleton(value))


def idna_decode(value: Column) -> Column:
    """Punycode labels decoded; a text of which a label cannot be decoded stays."""
    coded = lambda c: c.rlike("(^|\\.)xn--")
    decoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), value, F.lit(1))
    return F.when(coded(value), F.when(coded(decoded), value).otherwise(decoded)).otherwise(value)


def variants(base: Column) -> Column:
    """A skeleton and what its look-alike pairs may stand for."""
    out = F.array(base)
    for pair, letter in DIGRAPHS:
        out = F.array_union(out, F.transform(out, _replacer(pair, letter)))
    return out


def _replacer(pair: str, letter: str) -> Callable[[Column], Column]:
    return lambda x: F.replace(x, F.lit(pair), F.lit(letter))


def tokens(value: Column, to_skeleton=ascii_skeleton) -> Column:
    """The tokens of a label or text that are long enough to be an alias."""
    parts = F.split(F.replace(value, F.lit("_"), F.lit(" ")), "(?U)\\W+")
    found = F.flatten(F.transform(parts, lambda p: variants(to_skeleton(p))))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= MIN_ALIAS_LENGTH))


def looks_confusable(value: Column) -> Column:
    return value.rlike("[^\\x00-\\x7F]|\\p{Nd}")


def alias_variants(alias: str) -> list[str]:
    """What variants and tokens make of a catalog alias (ASCII letters and digits), for literal tables."""
    bare = "".join(_ASCII.get(c, c) for c in alias.lower() if c.isalnum())
    made = {bare, *(bare.replace(*d) for d in DIGRAPHS), bare.replace(*DIGRAPHS[0]).replace(*DIGRAPHS[1])}
    return sorted(v for v in made if len(v) >= MIN_ALIAS_LENGTH)
