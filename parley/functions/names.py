"""Speakers, identities and flags as they are spelt in files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings.
FEMALE = ("f", "female", "woman", "girl")
MALE = ("m", "male", "man", "boy")
FEMALE_WIDE = (*FEMALE, "女性")
MALE_WIDE = (*MALE, "男性")
TRUE = ("true", "1", "t", "y", "yes")
FALSE = ("false", "0", "f", "n", "no")
# Where file names have the round.
ROUND_FIELD = r"^[^_]*_([0-9]+)(?:_|\.|$)"
ROUND_WORD = r"round[_\- ]*([12])\b"
FIRST_WORD, SECOND_WORD = r"\b1st\b|\bfirst\b", r"\b2nd\b|\bsecond\b"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def speaker(name: Column, wide: bool = True) -> Column:
    """Normalised speaker; `wide` also knows Japanese spellings and turns empty names to `unknown`."""
    x = F.lower(stripped(F.coalesce(name, F.lit(""))))
    found = F.when(x.isin(*(FEMALE_WIDE if wide else FEMALE)), "female").when(x.isin(*(MALE_WIDE if wide else MALE)), "male")
    return found.when(x == "", "unknown").otherwise(x) if wide else found.otherwise(x)


def speaker_strict(name: Column) -> Column:
    """Only lower-cased; anything but female and male is missing."""
    return F.when(F.lower(name).isin("female", "male"), F.lower(name))


def id_in_name(name: Column, letter: str, either_case: bool = True) -> Column:
    """The first number after the letter in a file name, or null."""
    found = F.regexp_extract(name, f"{'(?i)' if either_case else ''}{letter}0*([0-9]+)", 1)
    return found.try_cast("long")


def dyad_id(female: Column, male: Column) -> Column:
    return F.when(female.isNotNull() & male.isNotNull(), F.format_string("F%03d_M%03d", female, male))


def number_of_id(name: Column) -> Column:
    """The number in ids such as F001, m12 or 7."""
    return F.regexp_replace(name.cast("string"), r"^[FfMm0]+(?=[0-9])", "").try_cast("long")


def round_number(name: Column) -> Column:
    """1 or 2: from the second field between underscores if it is one, else from words such as round_2 or 1st."""
    field = F.regexp_extract(name, ROUND_FIELD, 1).try_cast("int")
    low = F.lower(name)
    worded = F.regexp_extract(low, ROUND_WORD, 1).try_cast("int")
    ordinal = F.when(low.rlike(FIRST_WORD), 1).when(low.rlike(SECOND_WORD), 2)
    return F.coalesce(F.when(field.isin(1, 2), field), worded, ordinal)


def round_label(number: Column) -> Column:
    return F.when(number == 1, "1st_round").when(number == 2, "2nd_round")


def flag(value: Column) -> Column:
    x = F.lower(stripped(value.cast("string")))
    return F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False)
