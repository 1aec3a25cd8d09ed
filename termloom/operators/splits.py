"""Reproducible stratified splits of labelled pairs, with constrained negatives."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions.text import keyword_list
from termloom.operators.graph import pair_table, universe
from termloom.operators.hashrank import seeded_hash, with_hash_rank
from termloom.session import materialize, release

SEED = 42
TEST_SHARE, VAL_SHARE = "0.10", "0.09"
NEGATIVES = 5
MIN_GAP = 20
SHORT = 8


def dead_ids(meta: DataFrame) -> DataFrame:
    """(id): sequences with the keyword dead, as a whole token, in any stored row."""
    return meta.filter(
        F.array_contains(keyword_list(F.col("keywords")), "dead")
    ).select(F.col("a_number").alias("id")).filter("id is not null").distinct()


def flagged_pairs(xrefs: DataFrame, corpus: DataFrame, meta: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(u, v, stratum, in_terms, dead, lt8_any): every pair with what decides its eligibility. Terms are counted as stored.

    ``pairs`` is the pair table of ``xrefs``, if it is there already.
    """
    sizes = corpus.filter(F.size("terms") > 0).groupBy("a_number").agg(F.max(F.size("terms")).alias("n"))
    dead = dead_ids(meta)
    pairs = pair_table(xrefs) if pairs is None else pairs
    for c in ("u", "v"):
        pairs = pairs.join(
            sizes.select(F.col("a_number").alias(c), F.col("n").alias("n" + c)), c, "left"
        ).join(dead.select(F.col("id").alias(c), F.lit(True).alias("d" + c)), c, "left")
    return pairs.select(
        "u",
        "v",
        "stratum",
        (F.col("nu").isNotNull() & F.col("nv").isNotNull()).alias("in_terms"),
        F.coalesce("du", "dv", F.lit(False)).alias("dead"),
        F.coalesce((F.least("nu", "nv") < SHORT).cast("int"), F.lit(0)).alias("lt8_any")
    )


def eligible_pairs(xrefs: DataFrame, corpus: DataFrame, meta: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(u, v, stratum, lt8_any): labelled pairs of living sequences with terms. Pairs without a stratum can't be split and are left out."""
    return (
        flagged_pairs(xrefs, corpus, meta, pairs)
        .filter("in_terms and not dead and stratum is not null")
        .select("u", "v", "stratum", "lt8_any")
    )


def headline_pairs(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Eligible pairs that count in headline results: of s1 or s2, not short, and no end named as a placeholder (allocated)."""
    held = corpus.filter(
        F.lower("name").contains("allocated")
    ).select(F.col("a_number").alias("id")).filter("id is not null").distinct()
    out = pairs.filter(F.col("stratum").isin("s1", "s2") & (F.col("lt8_any") == 0))
    for c in ("u", "v"):
        out = out.join(held.select(F.col("id").alias(c)), c, "left_anti")
    return out.select("u", "v", "stratum")


def funnel(xrefs: DataFrame, corpus: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: pairs in all, dropped for missing terms, then for a dead end, then for no stratum, eligible, short among those, and nodes."""
    f = flagged_pairs(xrefs, corpus, meta)
    ok = F.col("in_terms") & ~F.col("dead")
    labelled = F.col("stratum").isNotNull()
    nodes = living_nodes(corpus, meta).agg(F.count("*").alias("nodes"))
    row = f.agg(
        F.count("*").alias("pairs"),
        F.count_if(~F.col("in_terms")).alias("not_in_terms"),
        F.count_if(F.col("in_terms") & F.col("dead")).alias("touching_dead"),
        F.count_if(ok & ~labelled).alias("unlabelled"),
        F.count_if(ok & labelled).alias("eligible"),
        F.count_if(ok & labelled & (F.col("lt8_any") == 1)).alias("short")
    )
    return row.join(F.broadcast(nodes))  # one row each


def _floor(n, share: str):
    f = Fraction(share)
    return F.floor(n * f.numerator / f.denominator)


def draw_splits(pairs: DataFrame, seed: int = SEED, test: str = TEST_SHARE, val: str = VAL_SHARE) -> DataFrame:
    """``pairs`` with a split: in each stratum the first floor(test * n) by seeded hash are test, the next floor(val * n) val."""
    r = with_hash_rank(pairs, "stratum", ["u", "v"], seed)
    first = _floor(F.col("n"), test)
    return r.withColumn(
        "split",
        F.when(F.col("rn") <= first, "test")
        .when(F.col("rn") <= first + _floor(F.col("n"), val), "val")
        .otherwise("train")
    ).drop("rn", "n")


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with an index 0..N-1 in the order of their ids, without a window over all of them."""
    spread = nodes.select("id", F.floor(F.col("id") / 4096).alias("_k"))
    counts = spread.groupBy("_k").agg(F.count("*").alias("_c"))
    coarse = counts.withColumn("_g", F.floor(F.col("_k") / 4096))
    per = coarse.groupBy("_g").agg(F.sum("_c").alias("_gc"))
    # at most 2**31 / 2**24 = 128 rows
    per = per.select("_g", (F.sum("_gc").over(W.partitionBy(F.lit(0)).orderBy("_g")) - F.col("_gc")).alias("_go"))
    offsets = coarse.join(per, "_g").select(
        "_k", (F.col("_go") + F.sum("_c").over(W.partitionBy("_g").orderBy("_k")) - F.col("_c")).alias("_o")
    )
    return (
        spread.withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy("id")))
        .join(offsets, "_k")
        .select("id", (F.col("_o") + F.col("_r") - 1).cast("bigint").alias("idx"))
    )


def _attempts(idx: DataFrame, size: int, attempts: int, seed: int) -> DataFrame:
    """(iu, iv): two nodes for each attempt, by the seeded hash of its number."""
    at = lambda side: F.pmod(
        F.conv(F.substring(seeded_hash(seed, F.lit(side), "id"), 1, 15), 16, 10).cast("bigint"), F.lit(size)
    )
    return idx.sparkSession.range(attempts).select(at("u").alias("iu"), at("v").alias("iv"))


def _enumerated(idx: DataFrame, size: int) -> DataFrame:
    """(iu, iv): every pair iu < iv of ``size`` nodes, from the numbers of the pairs."""
    k = F.col("id")
    root = F.floor((F.sqrt(8.0 * k + 1) + 1) / 2).cast("bigint")  # rounding can be off by one
    row = F.when(root * (root - 1) / 2 > k, root - 1).when(root * (root + 1) / 2 <= k, root + 1).otherwise(root)
    return idx.sparkSession.range(size * (size - 1) // 2).select(k, row.alias("iv")).select(
        (k - (F.col("iv") * (F.col("iv") - 1) / 2).cast("bigint")).alias("iu"), "iv"
    )


def _draw(
    n: int, nodes: DataFrame, forbidden: DataFrame, seed: int, min_gap: int, max_rounds: int, fewer: bool
) -> tuple[DataFrame, int]:
    """The negatives of :func:`draw_negatives` and their number, which is known before they are ranked."""
    idx = materialize(_numbered(nodes), "nodes")
    size = idx.count()
    total = size * (size - 1) // 2
    if n > total and not fewer:
        raise ValueError(f"{size} nodes don't have {n} pairs")
    attempts = max(2 * n, 1024)
    for _ in range(max_rounds):
        whole = attempts >= total
        drawn = _enumerated(idx, size) if whole else _attempts(idx, max(size, 1), attempts, seed)
        for c in ("u", "v"):
            drawn = drawn.join(idx.select(F.col("idx").alias("i" + c), F.col("id").alias("_" + c)), "i" + c)
        pairs = drawn.select(
            F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")
        ).filter(F.col("v") - F.col("u") > min_gap)
        pairs = materialize(
            (pairs if whole else pairs.distinct()).join(forbidden.select("u", "v"), ["u", "v"], "left_anti"),
            "negatives"
        )
        there = pairs.count()
        if there >= n or (whole and fewer):
            ranked = with_hash_rank(pairs.withColumn("_all", F.lit(0)), "_all", ["u", "v"], seed)
            return ranked.filter(F.col("rn") <= n).select("u", "v", "rn"), min(n, there)
        release(pairs)
        if whole:
            raise ValueError(f"{n} negatives asked for, the nodes have {there}")
        attempts *= 2
    raise ValueError(f"{max_rounds} rounds of attempts don't give {n} negatives")


def draw_negatives(
    n: int,
    nodes: DataFrame,
    forbidden: DataFrame,
    seed: int = SEED,
    min_gap: int = MIN_GAP,
    max_rounds: int = 8,
    fewer: bool = False
) -> DataFrame:
    """(u, v, rn): ``n`` distinct pairs of nodes, u < v - ``min_gap``, none of them in ``forbidden(u, v)``; rn runs from 1 to n.

    Attempt i takes two nodes by the seeded hash of i. Pairs are kept in the order of their own hash. If a round of attempts
    leaves too few, the next has twice as many; where attempts would be as many as the pairs of the nodes, all pairs are gone
    through instead, so the draw is as large as asked whenever there are enough. If there aren't, it raises, or, with
    ``fewer``, gives all there are.
    """
    return _draw(n, nodes, forbidden, seed, min_gap, max_rounds, fewer)[0]


def living_nodes(corpus: DataFrame, meta: DataFrame) -> DataFrame:
    """(id): sequences with terms that aren't dead."""
    return universe(corpus).join(dead_ids(meta), "id", "left_anti")


def build_splits(
    xrefs: DataFrame,
    corpus: DataFrame,
    meta: DataFrame,
    seed: int = SEED,
    per_positive: int = NEGATIVES,
    fewer: bool = False
) -> DataFrame:
    """(u, v, stratum, label, lt8_any, split): positives and, for each split, ``per_positive`` negatives each.

    Negatives are drawn once and dealt to train, val and test by rank, so no two splits share one. Their lt8_any is 0.
    It raises if the nodes have too few free pairs for that; with ``fewer``, all free pairs are dealt in the same proportions.
    """
    known = materialize(pair_table(xrefs), "known")
    positives = materialize(draw_splits(eligible_pairs(xrefs, corpus, meta, known), seed), "positives")
    counts = {r[0]: r[1] for r in positives.groupBy("split").agg(F.count("*")).collect()}
    train, val, test = (per_positive * counts.get(s, 0) for s in ("train", "val", "test"))
    out = positives.select("u", "v", "stratum", F.lit(1).alias("label"), "lt8_any", "split")
    if not train + val + test:
        return out
    neg, there = _draw(train + val + test, living_nodes(corpus, meta), known, seed, MIN_GAP, 8, fewer)
    if fewer:
        part = Fraction(there, train + val + test)
        train, val = int(part * train), int(part * val)
    split = F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + val, "val").otherwise("test")
    return out.unionByName(
        neg.select(
            "u",
            "v",
            F.lit("neg").alias("stratum"),
            F.lit(0).alias("label"),
            F.lit(0).alias("lt8_any"),
            split.alias("split")
        )
    )


def manifest(
    splits: DataFrame, funnel_row: DataFrame, seed: int = SEED, code: str | None = None, seconds: float | None = None
) -> dict:
    """Seed, shares, funnel, counts by split, stratum and label, and a content hash of each split that no order changes.

    ``code`` is the version of the code that built the splits, ``seconds`` the time it took; the caller knows both.
    """
    counts = splits.groupBy("split", "stratum", "label").agg(F.count("*").alias("n")).collect()
    hashes = content_hash(splits, ["split"]).collect()
    return {
        "seed": seed,
        "test_share": TEST_SHARE,
        "val_share": VAL_SHARE,
        "negatives_per_positive": NEGATIVES,
        "min_gap": MIN_GAP,
        "code": code,
        "seconds": seconds,
        "funnel": funnel_row.first().asDict(),
        "counts": [r.asDict() for r in sorted(counts, key=lambda r: (r[0], r[1] or "", r[2]))],
        "content": {r["split"]: {"rows": r["rows"], "hash": r["hash"]} for r in hashes},
    }


def content_hash(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows, hash): a hash of the rows that no order changes and any engine can repeat.

    A row's text are its other columns by name, each with its value as text ('~' for null), joined by bars; the hash is the
    sum of the first 15 hex digits of the texts' md5, modulo 2 ** 63.
    """
    cols = sorted(c for c in df.columns if c not in by)
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols))
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.pmod(F.sum(part), F.lit("9223372036854775808").cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), total.cast("bigint").alias("hash"))
