"""Evaluation pairs that also stand in the training split, as themselves or through near-same sequences.

The sequences of evaluation pairs are indexed by the prefixes of their rarest terms, those of training pairs probe the
index (see ``sets.similar_classes``), and the evaluation pairs are then matched with the training pairs over classes of
equal sequences and their verified neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import clean_label
from termloom.llm.sets import set_classes, similar_classes
from termloom.session import mark, materialize, release_since


def cross_split_overlaps(splits: DataFrame, corpus: DataFrame, threshold: float = 0.6, min_size: int = 8) -> DataFrame:
    """(split, u, v, exact): the distinct pairs of val and test (u <= v) that training holds too; ``exact`` if as themselves.

    A pair overlaps if a train row joins the same two sequences or near ones, in either direction. A sequence without
    ``min_size`` distinct terms, or that corpus lacks, is near itself only. Rows with a null end or split are left out.
    """
    ends = splits.select(
        clean_label(F.col("split")).alias("split"),
        F.least("u", "v").cast("bigint").alias("u"),
        F.greatest("u", "v").cast("bigint").alias("v"),
        F.isnull("u").alias("nu"),
        F.isnull("v").alias("nv")
    )
    ends = ends.filter("not nu and not nv").select("split", "u", "v").distinct()
    held = materialize(ends.filter(F.col("split").isin("val", "test")), "held")
    train = materialize(ends.filter("split = 'train'").select("u", "v"), "train")

    vertices = lambda d: d.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    used = vertices(held).withColumn("i", F.lit(1)).unionByName(
        vertices(train).withColumn("i", F.lit(2))
    ).groupBy("id").agg(F.sum("i").alias("i"))
    used = materialize(
        used.select("id", F.col("i").isin(1, 3).alias("is_index"), F.col("i").isin(2, 3).alias("is_probe")), "used"
    )
    records = corpus.select(F.col("a_number").cast("bigint").alias("id"), "terms").join(used, "id", "left_semi")
    members, classes = set_classes(records, "id", "terms", min_size)
    flags = members.join(used, "id").groupBy("cid").agg(
        F.max("is_index").alias("is_index"), F.max("is_probe").alias("is_probe")
    )
    point = mark()
    near = materialize(
        similar_classes(materialize(classes.join(flags, "cid").drop("rid", "copies"), "flagged"), threshold),
        "nearclasses"
    )
    release_since(point, near)

    # every sequence gets the node of its class, an even number, or a node of its own, an odd one
    of_class, of_self = (lambda c: c * 2), (lambda c: c * 2 + 1)
    named = (
        used.select("id")
        .join(members.select("id", "cid"), "id", "left")
        .select("id", F.coalesce(of_class(F.col("cid")), of_self(F.col("id"))).alias("node"))
    )
    named = materialize(named, "nodes")

    def nodes(d: DataFrame, *rest: str) -> DataFrame:
        for c in ("u", "v"):
            d = d.join(named.select(F.col("id").alias(c), F.col("node").alias(f"n{c}")), c)
        return d.select(*rest, "nu", "nv")

    held_nodes = materialize(nodes(held, "split", "u", "v"), "heldnodes")
    themselves = held_nodes.select(F.explode(F.array("nu", "nv")).alias("n")).distinct()
    # near nodes of evaluation nodes in training: their near classes and themselves
    around = materialize(
        near.select(of_class(F.col("cid_1")).alias("n"), of_class(F.col("cid_2")).alias("to"))
        .unionByName(themselves.select("n", F.col("n").alias("to")))
        .distinct(),
        "near"
    )
    # they meet in the middle: evaluation pairs go to the near nodes of one end, training pairs, both ways, to those of the other
    asked = (
        held_nodes.select(F.col("nu").alias("n"), F.col("nv").alias("y"))
        .distinct()
        .join(around, "n")
        .select("n", F.col("to").alias("x"), "y")
    )
    ends = nodes(train).select(
        F.explode(
            F.array(
                F.struct(F.col("nu").alias("x"), F.col("nv").alias("to")),
                F.struct(F.col("nv").alias("x"), F.col("nu").alias("to"))
            )
        ).alias("e")
    )
    known = ends.select("e.x", "e.to").distinct().join(around, "to").select("x", F.col("n").alias("y")).distinct()
    hit = asked.join(known, ["x", "y"], "left_semi").select(F.col("n").alias("nu"), F.col("y").alias("nv")).distinct()
    exact = train.withColumn("exact", F.lit(True))
    return (
        held_nodes.join(hit, ["nu", "nv"], "left_semi")
        .join(exact, ["u", "v"], "left")
        .select("split", "u", "v", F.coalesce("exact", F.lit(False)).alias("exact"))
    )


def overlap_report(splits: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(split, stratum, pairs, exact, near): distinct evaluation pairs by split and stratum, and how many training holds as themselves or nearly.

    Strata are trimmed and lower-cased, null is '(none)'; a pair stored with two strata counts in both.
    """
    rows = splits.filter("u is not null and v is not null").select(
        clean_label(F.col("split")).alias("split"),
        F.least("u", "v").cast("bigint").alias("u"),
        F.greatest("u", "v").cast("bigint").alias("v"),
        F.coalesce(clean_label(F.col("stratum")), F.lit("(none)")).alias("stratum")
    )
    rows = rows.filter(F.col("split").isin("val", "test")).distinct().join(overlaps, ["split", "u", "v"], "left")
    return rows.groupBy("split", "stratum").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("exact")).alias("exact"),
        F.count_if(~F.col("exact")).alias("near")
    )
