"""Text cleaning for sheet values and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from procura.schema import NULL_WORDS

YEAR_PATTERN = r"(20\d{2})"  # fixed value: first year of this century in a file name


def strip(x: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_text(x: Column) -> Column:
    """Trim and upper-case; words that stand for 'nothing' become null."""
    cleaned = F.upper(strip(x.cast("string")))
    return F.when(~cleaned.isin(NULL_WORDS), cleaned)


def first_two_words(x: Column) -> Column:
    return F.array_join(F.slice(F.split(strip(x), r"(?U)\s+"), 1, 2), " ")


def name_or_fallback(name: Column, legal_name: Column) -> Column:
    return F.coalesce(name, first_two_words(legal_name))


def year_in_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, YEAR_PATTERN, 1), F.lit("")).try_cast("int")


def branch_in_sheet(sheet: Column) -> Column:
    """Branch number: the last word of the sheet name."""
    return F.element_at(F.split(strip(sheet), r"\s+"), -1).try_cast("int")
