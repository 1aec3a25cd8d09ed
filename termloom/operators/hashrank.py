"""Exact ranks by a seeded hash, for splits and samples that no partitioning changes.

A window over a stratum would put its rows into one task. Here the first hex digits of the hash cut every stratum into
buckets, a small table of bucket counts gives each bucket its offset, and rows are numbered within their bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: 65,536 buckets a stratum: offsets are a window over that many rows, and at 10**11 rows a bucket holds 1.5 million.
DIGITS = 4


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """md5 of the seed and the keys, joined by bars: the same in any engine."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cols)).cast("binary"))


def with_hash_rank(df: DataFrame, stratum: str, keys: list[str], seed: int, digits: int = DIGITS) -> DataFrame:
    """``df`` with rn (1 for the smallest hash of the stratum) and n (rows of the stratum). Ties go by the keys, nulls first."""
    h = df.withColumn("_h", seeded_hash(seed, *keys)).withColumns(
        {"_s": F.coalesce(F.col(stratum).cast("string"), F.lit("\0")), "_b": F.substring("_h", 1, digits)}
    )
    counts = h.groupBy("_s", "_b").agg(F.count("*").alias("_c"))
    inside = W.partitionBy("_s").orderBy("_b")
    offsets = counts.select(
        "_s",
        "_b",
        (F.sum("_c").over(inside) - F.col("_c")).alias("_o"),
        F.sum("_c").over(W.partitionBy("_s")).alias("n")
    )
    numbered = h.withColumn("_r", F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", *keys)))
    return numbered.join(offsets, ["_s", "_b"]).withColumn(
        "rn", F.col("_o") + F.col("_r")
    ).drop("_s", "_b", "_h", "_o", "_r")
