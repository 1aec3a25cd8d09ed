"""Terms: whole decimal numbers of any size, held as canonical strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, an optional sign, leading zeros, the digits. Group 1: the minus; group 2: the digits.
_WHOLE = r"^[\s\p{Z}\x1c-\x1f\x85]*(?:\+|(-))?0*([0-9]+)[\s\p{Z}\x1c-\x1f\x85]*$"


#: Terms that are canonical as they stand, which most are; one cheap match spares them the other two.
_PLAIN = r"\A(?:0|-?[1-9][0-9]*)\z"


def canonical_term(t: Column) -> Column:
    """The one spelling of a whole number (no plus, no leading zeros, no minus zero); null for null and for anything else."""
    digits = F.regexp_extract(t, _WHOLE, 2)
    other = F.when(digits == "", None).when(digits == "0", digits).otherwise(
        F.concat(F.regexp_extract(t, _WHOLE, 1), digits)
    )
    return F.when(t.rlike(_PLAIN), t).otherwise(other)


def clean_terms(terms: Column) -> Column:
    """The terms that are whole numbers, canonical and in order; an empty array for a null one."""
    return F.coalesce(
        F.filter(F.transform(terms, canonical_term), lambda x: x.isNotNull()), F.array().cast("array<string>")
    )


def exact_longs(terms: Column) -> Column:
    """Clean terms as BIGINT; null if one of them doesn't fit (callers then take the exact path)."""
    longs = F.transform(terms, lambda t: t.try_cast("bigint"))
    return F.when(~F.exists(longs, lambda x: x.isNull()), longs)
