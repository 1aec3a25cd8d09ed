"""Pairs already known from program relations and mentions, and what remains without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation_sizes(relations: DataFrame) -> DataFrame:
    """One row: programs that call something, stored relations (repeats counted), and distinct undirected pairs of different programs' ids."""
    u, v = F.least("program", "calls"), F.greatest("program", "calls")
    return relations.filter("program is not null and calls is not null").agg(
        F.count_distinct("program").alias("programs"),
        F.count("*").alias("relations"),
        F.count_distinct(F.when(u != v, F.struct(u, v))).alias("pairs")
    )


def known_pairs(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """(u, v): pairs of different sequences related by a program call or a mention in either direction; one table for one equi join."""
    both = relations.select(F.col("program").alias("a"), F.col("calls").alias("b")).unionByName(
        mentions.select(F.col("source").alias("a"), F.col("target").alias("b"))
    )
    return both.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def without_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (u, v in any order, further columns kept) that aren't known pairs. Rows with a null end are left out."""
    keyed = candidates.filter("u is not null and v is not null").withColumns(
        {"_u": F.least("u", "v"), "_v": F.greatest("u", "v")}
    )
    return keyed.join(
        known.select(F.col("u").alias("_u"), F.col("v").alias("_v")), ["_u", "_v"], "left_anti"
    ).drop("_u", "_v")
