"""Names and texts as Catalyst expressions. A missing value is the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from erspark.functions.tables import LEGAL_SUFFIXES


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def tokens(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def clean(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def strip_suffix(name: Column, suffixes: dict[str, str] = LEGAL_SUFFIXES) -> tuple[Column, Column]:
    """(core name, canonical legal suffix) of a lower-cased name; one trailing suffix goes if another token stays."""
    words = tokens(F.regexp_replace(F.regexp_replace(name, r"[^a-z0-9&\s]", " "), "&", " and "))
    suffix = F.when(F.size(words) > 1, F.try_element_at(literal_map(suffixes), F.try_element_at(words, F.lit(-1))))
    core = F.array_join(F.when(suffix.isNotNull(), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words), " ")
    return core, F.coalesce(suffix, F.lit(""))


def sorted_tokens(core: Column) -> Column:
    return F.array_join(F.array_sort(tokens(core)), " ")


def acronym(core: Column) -> Column:
    """First letters of the tokens; empty for fewer than two."""
    t = tokens(core)
    return F.when(F.size(t) < 2, F.lit("")).otherwise(F.array_join(F.transform(t, lambda x: F.substring(x, 1, 1)), ""))


def soundex(token: Column) -> Column:
    letters = F.regexp_replace(F.lower(token), "[^a-z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.soundex(letters))


def phonetic(core: Column) -> Column:
    """Soundex of the first two tokens."""
    t = tokens(core)
    return F.concat(*[F.coalesce(soundex(F.get(t, i)), F.lit("")) for i in (0, 1)])


def non_latin(text: Column) -> Column:
    return text.rlike(r"[\p{L}&&[^\u0000-ɏ]]")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0)))


def digit_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def processed(text: Column) -> Column:
    """What fuzzy scores compare: lower case, everything but letters and digits as a space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " "))


def paired_text(name: Column, address: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit("")))


def view_text(name: Column, address: Column) -> Column:
    """The address, or the name where the address is blank."""
    return F.coalesce(F.when(F.trim(address) != "", address), name, F.lit(""))
