"""The corpus as tables: terms, names and references joined by id, subsets, lengths and keyword counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.terms import clean_terms
from termloom.functions.text import keyword_list

#: The keywords that are counted.
KEYWORDS = ("dead", "dup", "dupe", "cons", "base", "fini", "sign", "nonn")


def full_catalog(terms: DataFrame, names: DataFrame, refs: DataFrame) -> DataFrame:
    """(a_number, terms, name, xrefs, dead): every id of ``terms(a_number, terms)`` or ``names(a_number, name)``.

    Missing parts are [] and ''; dead marks an id without terms; references of ids in neither table are left out.
    """
    nothing = F.array()
    out = terms.filter("a_number is not null").join(
        names.filter("a_number is not null"), "a_number", "full_outer"
    ).join(refs, "a_number", "left")
    got = F.coalesce("terms", nothing.cast(terms.schema["terms"].dataType))
    return out.select(
        "a_number",
        got.alias("terms"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("xrefs", nothing.cast("array<int>")).alias("xrefs"),
        (F.size(got) == 0).alias("dead")
    )


def direct_references(mentions: DataFrame) -> DataFrame:
    """(source, target): each other sequence that a source mentions, once. Long form, as a hub's list has no bound."""
    return mentions.filter("source <> target").select("source", "target").distinct()


def term_subset(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``terms`` whose a_number is among ``ids(a_number)``."""
    return terms.join(ids.select("a_number").distinct(), "a_number", "left_semi")


def keyword_counts(meta: DataFrame) -> DataFrame:
    """(keyword, n): for each counted keyword, the sequences that carry it as a whole token in any stored row; zeros included."""
    spark = meta.sparkSession
    tokens = (
        meta.filter("a_number is not null")
        .select("a_number", F.explode(keyword_list(F.col("keywords"))).alias("keyword"))
        .filter(F.col("keyword").isin(*KEYWORDS))
        .distinct()
    )
    all_of = spark.range(len(KEYWORDS)).select(
        F.get(F.array(*map(F.lit, KEYWORDS)), F.col("id").cast("int")).alias("keyword")
    )
    return all_of.join(
        tokens.groupBy("keyword").agg(F.count("*").alias("n")), "keyword", "left"
    ).select("keyword", F.coalesce("n", F.lit(0)).alias("n"))


def length_stats(corpus: DataFrame) -> DataFrame:
    """One row over the records with usable terms: n, shortest, median, mean (2 digits), longest, and how many have fewer than 8."""
    sizes = corpus.select(
        F.size(clean_terms(F.col("terms"))).alias("l")
    ).filter("l > 0").groupBy("l").agg(F.count("*").alias("c"))
    return sizes.agg(
        F.sum("c").alias("n"),
        F.min("l").alias("shortest"),
        F.percentile("l", F.lit(0.5), F.col("c")).alias("median"),
        F.round(F.sum(F.col("l") * F.col("c")) / F.sum("c"), 2).alias("mean"),
        F.max("l").alias("longest"),
        F.coalesce(F.sum(F.when(F.col("l") < 8, F.col("c"))), F.lit(0)).alias("below_8")
    )


def name_flags(corpus: DataFrame) -> DataFrame:
    """One row: sequences whose name says allocated without terms, and duplicate of with terms, in any case."""
    name, has = F.lower("name"), F.size("terms") > 0
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return corpus.agg(
        yes(~F.coalesce(has, F.lit(False)) & name.contains("allocated")).alias("allocated"),
        yes(has & name.contains("duplicate of")).alias("duplicates")
    )


def coverage(covered: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, covered nodes, and their share (4 digits; null without nodes). Both tables have ``id``."""
    c = covered.select("id").distinct().withColumn("_c", F.lit(1))
    return (
        nodes.join(c, "id", "left")
        .agg(F.count("*").alias("nodes"), F.count("_c").alias("covered"))
        .withColumn("share", F.round(F.try_divide("covered", "nodes"), 4))
    )
