"""Pairs of records from pairs of classes of equal records, with every group of copies split into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a block, on average. Two blocks give at most about BLOCK ** 2 pairs, the work of one row.
BLOCK = 1000


def spelled_pairs(members: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id_1, id_2), id_1 < id_2: the members of linked classes with each other, and those of each class among themselves.

    ``members(id, cid, copies)`` has the number of members of its class in every row, ``pairs(cid_1, cid_2)`` comes once for
    each pair of classes. Blocks of members travel as arrays, one row for each pair of blocks; these rows are dealt out
    evenly before they are taken apart, so no task gets all pairs of a large class.
    """
    spark = members.sparkSession
    n_blocks = F.ceil(F.col("copies") / block).cast("int")
    cut = members.select("id", "cid", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("b"))
    blocks = cut.groupBy("cid", "b").agg(F.collect_list("id").alias("ids"))
    sizes = members.select("cid", n_blocks.alias("nb"), (F.col("copies") > 1).alias("more")).distinct()
    linked = pairs.select("cid_1", "cid_2").unionByName(
        sizes.filter("more").select(F.col("cid").alias("cid_1"), F.col("cid").alias("cid_2"))
    )
    for s in ("1", "2"):
        linked = linked.join(sizes.select(F.col("cid").alias("cid_" + s), F.col("nb").alias("nb_" + s)), "cid_" + s)
    for s in ("1", "2"):
        linked = linked.withColumn("b_" + s, F.explode(F.sequence(F.lit(0), F.col("nb_" + s) - 1)))
    tiles = linked.filter("cid_1 <> cid_2 or b_1 <= b_2").drop("nb_1", "nb_2")
    for s in ("1", "2"):
        tiles = tiles.join(
            blocks.withColumnsRenamed({"cid": "cid_" + s, "b": "b_" + s, "ids": "ids_" + s}), ["cid_" + s, "b_" + s]
        )
    dealt = tiles.repartition(2 * spark.sparkContext.defaultParallelism, "cid_1", "b_1", "cid_2", "b_2")
    once = (F.col("cid_1") == F.col("cid_2")) & (F.col("b_1") == F.col("b_2"))
    out = dealt.select(
        once.alias("once"), "ids_2", F.explode("ids_1").alias("x")
    ).select("once", "x", F.explode("ids_2").alias("y"))
    out = out.filter((F.col("x") < F.col("y")) | (~F.col("once") & (F.col("x") > F.col("y"))))
    out = out.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))
    # an id with several stored lists is in several classes, and only then can a pair come twice
    twice = members.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").head(1)
    return out.distinct() if twice else out
