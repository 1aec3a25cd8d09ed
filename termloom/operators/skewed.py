"""Results for every key when a few keys hold most rows.

Rows are never shuffled by key. Each input split, whatever its keys, is reduced to dense accumulator arrays: the split's
keys are dictionary-encoded to codes 0..k-1, ``numpy.bincount`` counts (code, category) cells, and the counts leave as one
row for each touched block of ``WIDTH`` neighbouring keys. Blocks are then summed by a distributed reduction in two
levels: first the rows of ``FAN`` splits, then those sums. A hot key costs a split one array cell like any other key, and a
reducer receives at most one row per split and block. Splits are those of the scan, which are of equal size in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import clean_label

#: Keys of a block.
WIDTH = 4096
#: A split's dictionary is emptied into blocks when it holds this many keys, which bounds a task's memory.
MAX_KEYS = 2_000_000
#: Splits whose blocks are summed together first.
FAN = 256


def _partial(n_cat: int, width: int, max_keys: int):
    """Arrow batches (key BIGINT, cat INT, n BIGINT) to rows (block, offs, counts)."""

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, codes = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        counts = np.concatenate([c for _, c in parts])
        cell = (codes[:, None] * n_cat + np.arange(n_cat)).ravel()
        # float64 sums are exact up to 2**53 rows
        return (
            keys,
            np.bincount(cell, weights=counts.ravel(), minlength=len(keys) * n_cat).astype(np.int64).reshape(-1, n_cat)
        )

    def blocks(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        block = keys // width
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        offs = (keys - block * width).astype(np.int32)
        at = np.r_[0, ends].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(block[starts]),
                pa.ListArray.from_arrays(at, pa.array(offs)),
                pa.ListArray.from_arrays(at * n_cat, pa.array(counts.ravel()))
            ],
            ["block", "offs", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            key, cat, n = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            keys, codes = np.unique(key, return_inverse=True)
            counts = np.bincount(
                codes * n_cat + cat, weights=n, minlength=len(keys) * n_cat
            ).astype(np.int64).reshape(-1, n_cat)
            held.append((keys, counts))
            size += len(keys)
            if size > max_keys:
                held = [merge(held)]
                size = len(held[0][0])
                if size > max_keys // 2:
                    yield blocks(*held[0])
                    held, size = [], 0
        if held:
            yield blocks(*merge(held))

    return run


def _reduce(n_cat: int, width: int, last: bool):
    """The rows of one block, summed in a dense array: to one row per key at the last level, to one row of the block before."""

    def run(group: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * n_cat, dtype=np.int64)
        for b in batches:
            offs = b.column(b.schema.get_field_index("offs")).flatten().to_numpy()
            counts = b.column(b.schema.get_field_index("counts")).flatten().to_numpy()
            np.add.at(total, (offs[:, None].astype(np.int64) * n_cat + np.arange(n_cat)).ravel(), counts)
        cells = total.reshape(width, n_cat)
        seen = np.flatnonzero(cells.any(axis=1))
        picked = cells[seen]
        if not last:
            ends = np.array([0, len(seen)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group[0].as_py()]),
                    pa.ListArray.from_arrays(ends, pa.array(seen.astype(np.int32))),
                    pa.ListArray.from_arrays(ends * n_cat, pa.array(picked.ravel()))
                ],
                ["block", "offs", "counts"],
            )
            return
        keys = group[0].as_py() * width + seen
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys),
                pa.ListArray.from_arrays(np.arange(len(seen) + 1, dtype=np.int32) * n_cat, pa.array(picked.ravel()))
            ],
            ["key", "counts"]
        )

    return run


def dense_counts(
    df: DataFrame,
    key: Column,
    cat: Column,
    n_cat: int,
    n: Column | None = None,
    width: int = WIDTH,
    max_keys: int = MAX_KEYS
) -> DataFrame:
    """(key BIGINT, counts ARRAY<BIGINT> of length ``n_cat``): how many rows, or how much of ``n``, each key has in each category.

    ``key`` is a whole number of at most 64 bits, ``cat`` lies in 0..n_cat-1. Null keys are left out; an empty input gives no rows.
    """
    rows = df.select(
        key.cast("bigint").alias("key"),
        cat.cast("int").alias("cat"),
        (F.lit(1) if n is None else n).cast("bigint").alias("n")
    ).filter("key is not null")
    kind = "block bigint, offs array<int>, counts array<bigint>"
    parts = rows.mapInArrow(_partial(n_cat, width, max_keys), kind).withColumn(
        "fan", F.floor(F.spark_partition_id() / FAN)
    )
    sums = parts.groupBy("block", "fan").applyInArrow(_reduce(n_cat, width, False), kind)
    return sums.groupBy("block").applyInArrow(_reduce(n_cat, width, True), "key bigint, counts array<bigint>")


#: The strata that get a column of their own.
STRATA = ("s1", "s2", "s3", "s4")


def _side():
    """The side of a key: sources and targets are counted together, as even and odd numbers."""
    return F.when(F.pmod("key", F.lit(2)) == 0, "source").otherwise("target")


def key_profile(xrefs: DataFrame) -> DataFrame:
    """For each sequence as source and as target: mentions, distinct partners and mentions by stratum.

    Columns: side ('source', 'target'), a_number BIGINT, mentions, partners, s1..s4, other (null or any other stratum).
    Repeated rows count as mentions; a null id is no key and no partner; a sequence that mentions itself is its own partner.
    """
    cat = F.lit(len(STRATA))
    for i, s in enumerate(STRATA):
        cat = F.when(clean_label(F.col("stratum")) == s, i).otherwise(cat)
    n_cat = len(STRATA) + 2
    rows = xrefs.select("source", "target", cat.alias("cat"))
    mentions = rows.select(
        F.explode(
            F.array(
                *(
                    F.struct((F.col(c).cast("bigint") * 2 + i).alias("k"), F.col("cat"))
                    for i, c in enumerate(("source", "target"))
                )
            )
        ).alias("x")
    ).select("x.k", "x.cat")
    pairs = xrefs.select("source", "target").distinct().filter("source is not null and target is not null")
    partners = pairs.select(
        F.explode(F.array(*(F.col(c).cast("bigint") * 2 + i for i, c in enumerate(("source", "target"))))).alias("k"),
        F.lit(n_cat - 1).alias("cat")
    )
    out = dense_counts(mentions.unionByName(partners), F.col("k"), F.col("cat"), n_cat)
    c = lambda i: F.element_at("counts", i + 1)
    return out.select(
        _side().alias("side"),
        F.floor(F.col("key") / 2).cast("bigint").alias("a_number"),
        sum((c(i) for i in range(1, n_cat - 1)), c(0)).alias("mentions"),
        c(n_cat - 1).alias("partners"),
        *(c(i).alias(s) for i, s in enumerate(STRATA)),
        c(n_cat - 2).alias("other"),
    )


def heavy_keys(xrefs: DataFrame, share: float = 0.01) -> DataFrame:
    """(side, a_number): keys holding at least ``share`` of all stored rows, rows without a key included in the total."""
    least = math.ceil(Fraction(str(share)) * xrefs.count())
    keys = F.array(*(F.col(c).cast("bigint") * 2 + i for i, c in enumerate(("source", "target"))))
    counts = dense_counts(xrefs.select(F.explode(keys).alias("k")), F.col("k"), F.lit(0), 1)
    heavy = counts.filter((F.get("counts", F.lit(0)) >= least) & (F.get("counts", F.lit(0)) > 0))
    return heavy.select(_side().alias("side"), F.floor(F.col("key") / 2).cast("bigint").alias("a_number"))
