"""Cross-reference lines as columns: mentions, sentences, parentheses, cues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.ids import all_ids

# Cue words of the line types and strata, and the form of a mention.
MENTION = r"A(\d{6,7})(?:\s*\((?![^()]*A\d{6})([^()]{1,120})\))?"
S1_CUE = "duplicate of|essentially the same|essentially a duplicate"
S2_CUE_V0 = "binomial transform|euler transform|m(?:oe|ö|o)bius transform|partial sums?|first differences?|bisections?|complement|signed version|unsigned version|decimations?|offset|shift|constant multiple"
S2_CUE_V1 = "binomial transform|euler transform|m(?:oe|ö|o)bius transform|partial sums?|first differences?|second differences?|bisections?|complement|signed version|unsigned version|decimations?|offset|shift|constant multiple|negated|negative of|twice|half"
S1_CLUSTER = "all essentially the same"
S1_DIRECT = r"(?:essentially the same as|essentially a duplicate of|duplicate of)\s+(?:the\s+)?A(\d{6,7})\b"
DUPLICATE_NAME = r"duplicate of A(\d{6,7})"
NAME_TRANSFORM = r"(?:first differences?|second differences?|partial sums?|binomial transform|inverse binomial transform|euler transform|m(?:oe|ö|o)bius transform|inverse m(?:oe|ö|o)bius transform|bisections?|complement|twice|signed version|unsigned version|negative)(?:\s+of|\s+are in|\s+gives?|\s+in|\s*:)?\s+(?:the\s+)?A(\d{6,7})\b"
CONSTANT_NAME_V0 = "^(?:decimal expansion|continued fraction expansion)"
CONSTANT_NAME_V1 = "^(?:decimal expansion|continued fraction expansion|expansion of .{0,60} in base|binary expansion)"

# case-insensitive beyond ASCII, with Unicode spaces, digits and word ends
_I = "(?iU)"


def clean_label(label: Column) -> Column:
    """A label without outer white space, in lower case."""
    return F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(_I + pattern)


def mentions(text: Column) -> Column:
    """ARRAY<STRUCT<target INT, paren STRING>> in order; paren is '' if none follows directly, or if it names an identifier."""
    ids = F.regexp_extract_all(text, F.lit(MENTION), 1)
    parens = F.regexp_extract_all(text, F.lit(MENTION), 2)
    return F.zip_with(ids, parens, lambda a, p: F.struct(a.cast("int").alias("target"), p.alias("paren")))


def line_type(text: Column) -> Column:
    """duplicate, transform, Cf., See also or other: the first that holds."""
    # fixed values: the names of the types and how their lines begin
    return (
        F.when(has(text, S1_CUE), "duplicate")
        .when(has(text, S2_CUE_V0), "transform")
        .when(has(text, r"^cf\b"), "Cf.")
        .when(has(text, r"^see also\b"), "See also")
        .otherwise("other")
    )


def strip_parens(text: Column, rounds: int = 3) -> Column:
    """The text with its innermost parentheses replaced by one blank, up to ``rounds`` times."""
    for _ in range(rounds):
        text = F.regexp_replace(text, r"\([^()]*\)", " ")
    return text


def sentences(text: Column) -> Column:
    """The parts after each full stop that blanks follow; blank parts are left out."""
    return F.filter(F.split(text, r"(?U)(?<=\.)\s+"), lambda s: ~s.rlike(r"(?U)^\s*$"))


def line_cues(source: Column, raw: Column) -> Column:
    """STRUCT<s1, s2: ARRAY<INT>>: the targets that a line itself marks as the same sequence, or as a transform.

    s1: identifiers right after a cue anywhere in the line without its parentheses, and all of a sentence that calls them
    all essentially the same. s2: the one identifier, other than the source, of a sentence with a transform cue. Lines
    whose raw text has no such cue mark nothing.
    """
    none = F.array().cast("array<int>")
    parts = F.transform(
        F.transform(sentences(raw), lambda s: strip_parens(s)),
        lambda s: F.struct(s.alias("bare"), all_ids(s).alias("ids"))
    )
    direct = F.transform(F.regexp_extract_all(strip_parens(raw), F.lit(_I + S1_DIRECT), 1), lambda x: x.cast("int"))
    cluster = F.flatten(F.transform(F.filter(parts, lambda p: has(p["bare"], S1_CLUSTER)), lambda p: p["ids"]))
    alone = F.transform(
        parts, lambda p: F.when(has(p["bare"], S2_CUE_V1), F.array_except(F.array_distinct(p["ids"]), F.array(source)))
    )
    s2 = F.flatten(F.filter(alone, lambda a: F.size(a) == 1))
    gate_1 = has(raw, S1_CUE)
    gate_2 = has(raw, S2_CUE_V1)
    return F.struct(
        F.when(gate_1, F.array_union(direct, cluster)).otherwise(none).alias("s1"),
        F.when(gate_2, F.array_distinct(s2)).otherwise(none).alias("s2")
    )


def keyword_list(keywords: Column) -> Column:
    """The keywords of a comma list, trimmed, each once; an empty array for null."""
    return F.array_distinct(
        F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != "")
    )
