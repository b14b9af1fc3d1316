"""Money amounts in German and US notation: column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CURRENCY = r"(?i)\s*(EURO?|€)\s*"
_DATE = r"^\d{1,2}\.\d{1,2}\.\d{2,4}$"
_NUMBER = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{1,2})?"


def parse_amount(text: Column) -> Column:
    """Double of "1.234,56 EUR", "1,234.56", "2.500"; null for dates and anything else.

    The separator before the last two digits, else the last separator, tells the
    notation, German by default; if it can't be read so, the other is tried.
    """
    clean = F.trim(F.regexp_replace(F.trim(text), _CURRENCY, ""))
    german_form, us_form = r"^[+-]?[0-9.]*(,[0-9]*)?$", r"^[+-]?[0-9,]*(\.[0-9]*)?$"
    german = F.when(clean.rlike(german_form), F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))
    us = F.when(clean.rlike(us_form), F.replace(clean, F.lit(","), F.lit("")).try_cast("double"))
    ends_german, ends_us = clean.rlike(r",\d{2}$"), clean.rlike(r"\.\d{2}$")
    last = lambda sep: F.instr(F.reverse(clean), F.lit(sep))  # noqa: E731  counted from the end; 0: none
    both = (last(",") > 0) & (last(".") > 0)
    us_first = (ends_us & ~ends_german) | (both & (ends_german == ends_us) & (last(".") < last(",")))
    value = F.when(us_first, F.coalesce(us, german)).otherwise(F.coalesce(german, us))
    return F.when((clean != "") & ~clean.rlike(_DATE), value)


def first_amount(text: Column) -> Column:
    """The first number of a text, with or without currency."""
    pattern = rf"(?i)({_NUMBER})\s*(?:EUR|Euro|€)?|(?:EUR|Euro|€)\s*({_NUMBER})"
    number = F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    return F.when(number != "", parse_amount(number))
