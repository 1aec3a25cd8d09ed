"""Samples for a blind audit of labels, and the report on the labelled sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators.graph import clean_mentions, stratum_of, within
from termloom.operators.hashrank import with_hash_rank


def representatives(xrefs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One mention for each undirected pair within the nodes: of the strongest stratum, then the smallest source, line and text."""
    m = clean_mentions(xrefs).filter("rank is not null").withColumns(
        {"u": F.least("source", "target"), "v": F.greatest("source", "target")}
    )
    order = F.struct("rank", "source", "y_line_idx", "sync_id", "raw_text", "paren", "link_type", "target")
    best = within(m, nodes).groupBy("u", "v").agg(F.min(order).alias("m"))
    return best.select(
        "u",
        "v",
        "m.source",
        "m.target",
        stratum_of(F.col("m.rank")).alias("stratum"),
        "m.link_type",
        "m.paren",
        "m.raw_text"
    )


def audit_sample(
    xrefs: DataFrame, nodes: DataFrame, names: DataFrame, per_stratum: int = 25, seed: int = 42
) -> DataFrame:
    """At most ``per_stratum`` representatives of each stratum, drawn by seeded hash, with the names of both ends ('' if unknown)."""
    ranked = with_hash_rank(
        representatives(xrefs, nodes), "stratum", ["u", "v"], seed
    ).filter(F.col("rn") <= per_stratum).drop("rn", "n")
    for c in ("source", "target"):
        ranked = ranked.join(names.select(F.col("a_number").alias(c), F.col("name").alias("name_" + c)), c, "left")
    return ranked.select(
        "u",
        "v",
        "source",
        "target",
        "stratum",
        "link_type",
        "paren",
        "raw_text",
        *(F.coalesce("name_" + c, F.lit("")).alias("name_" + c) for c in ("source", "target")),
        F.lit("").alias("hand_label")
    )


def blind(sample: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(blind rows in a seeded order, key): the sample without its labels, and (u, v, stratum, link_type)."""
    from termloom.operators.hashrank import seeded_hash

    return (
        sample.drop("stratum", "link_type").orderBy(seeded_hash(seed, "u", "v"), "u", "v"),
        sample.select("u", "v", "stratum", "link_type")
    )


def precision_report(labelled: DataFrame) -> DataFrame:
    """(stratum, correct, n, precision) of ``labelled(stratum, hand_label)``; rows without a hand label are left out."""
    ok = F.lower(F.trim("hand_label"))
    return (
        labelled.filter(ok != "")
        .groupBy("stratum")
        .agg(F.sum((ok == F.col("stratum")).cast("int")).alias("correct"), F.count("*").alias("n"))
        .withColumn("precision", F.round(F.col("correct") / F.col("n"), 4))
    )


def confusion(labelled: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(truth, one column of counts for each label): a crosstab with zeros; other labels are left out."""
    return labelled.filter(F.col(guess).isin(labels)).groupBy(truth).pivot(guess, labels).count().fillna(0, labels)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row for each key, the first in ``order``, which should end in a unique column. Keys should be spread: see ``representatives`` for a mergeable form."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
