"""Sequence identifiers: A and six digits, or seven from a million on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_id(text: Column) -> Column:
    """The number of an identifier such as A000045, outer blanks ignored; null for anything else."""
    return F.regexp_extract(F.trim(text), r"^A([0-9]{6,7})$", 1).try_cast("int")


def format_id(number: Column) -> Column:
    """A000045 for 45; a number of seven digits keeps them all; null for null."""
    return F.when(number.isNotNull(), F.format_string("A%06d", number.cast("int")))


def all_ids(text: Column) -> Column:
    """Every identifier in a text, in order, repeats included, as INT."""
    return F.transform(F.regexp_extract_all(text, F.lit("A([0-9]{6,7})"), 1), lambda x: x.cast("int"))
