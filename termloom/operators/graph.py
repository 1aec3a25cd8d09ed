"""The cross-reference graph: directed and undirected edges with their strongest label, degrees, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import clean_label
from termloom.operators.skewed import dense_counts

#: Ranks of the strata, the strongest first.
RANKS = {"s1": 0, "s2": 1, "s4": 2, "s3": 3}


def rank_of(stratum: Column) -> Column:
    """The rank of a stratum, its case and outer blanks ignored; null for any other label."""
    s = clean_label(stratum)
    return F.coalesce(*(F.when(s == k, r) for k, r in RANKS.items()))


def stratum_of(rank: Column) -> Column:
    return F.coalesce(*(F.when(rank == r, k) for k, r in RANKS.items()))


def clean_mentions(xrefs: DataFrame) -> DataFrame:
    """Mentions of another sequence: rows with a null end and self-mentions dropped, rank added."""
    return xrefs.filter("source <> target").withColumn("rank", rank_of(F.col("stratum")))


def directed_edges(xrefs: DataFrame) -> DataFrame:
    """(source, target, rank, mentions): each directed edge with its strongest label (null if it has none)."""
    return clean_mentions(xrefs).groupBy("source", "target").agg(
        F.min("rank").alias("rank"), F.count("*").alias("mentions")
    )


def undirected_edges(xrefs: DataFrame) -> DataFrame:
    """(u, v, rank, directions): u < v, 2 directions if both ends mention each other. One aggregation, as min is associative."""
    m = clean_mentions(xrefs).select(
        F.least("source", "target").alias("u"),
        F.greatest("source", "target").alias("v"),
        "rank",
        (F.col("source") < F.col("target")).alias("up")
    )
    return m.groupBy("u", "v").agg(
        F.min("rank").alias("rank"),
        (F.max(F.col("up").cast("int")) + F.max((~F.col("up")).cast("int"))).alias("directions")
    )


def pair_table(xrefs: DataFrame) -> DataFrame:
    """(u, v, stratum): undirected pairs with their strongest stratum."""
    return undirected_edges(xrefs).select("u", "v", stratum_of(F.col("rank")).alias("stratum"))


def universe(corpus: DataFrame) -> DataFrame:
    """(id): sequences with at least one stored term."""
    return corpus.filter(F.size("terms") > 0).select(F.col("a_number").alias("id")).distinct()


def within(pairs: DataFrame, nodes: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Pairs of which both ends are nodes."""
    for c in (u, v):
        pairs = pairs.join(nodes.select(F.col("id").alias(c)), c, "left_semi")
    return pairs


def touching(pairs: DataFrame, nodes: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Pairs of which an end is a node; each end is looked up by an equi join, never by an OR."""
    for c in (u, v):
        pairs = pairs.join(nodes.select(F.col("id").alias(c), F.lit(True).alias("_" + c)), c, "left")
    return pairs.filter(F.coalesce("_" + u, "_" + v, F.lit(False))).drop("_" + u, "_" + v)


def degrees(xrefs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, out_deg, in_deg, und_deg) for every node, zeros included; undirected degrees count pairs within the nodes.

    Counts come from dense accumulator arrays, so hubs cost no more than other nodes.
    """
    edges = directed_edges(xrefs).select("source", "target")
    und = within(
        edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct(),
        nodes
    )
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("source").alias("id"), F.lit(0).alias("c")),
                F.struct(F.col("target").alias("id"), F.lit(1).alias("c"))
            )
        ).alias("x")
    )
    both = ends.select("x.id", "x.c").unionByName(
        und.select(F.explode(F.array("u", "v")).alias("id"), F.lit(2).alias("c"))
    )
    counts = dense_counts(both, F.col("id"), F.col("c"), 3).withColumnRenamed("key", "id")
    at = lambda i: F.coalesce(F.get("counts", F.lit(i)), F.lit(0))
    return (
        nodes.select(F.col("id").cast("bigint").alias("id"))
        .join(counts, "id", "left")
        .select("id", at(0).alias("out_deg"), at(1).alias("in_deg"), at(2).alias("und_deg"))
    )


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, n, mean, p50, p90, p99, max) of each column, quantiles exact and interpolated.

    Values are counted first, so quantiles weigh distinct values instead of sorting rows.
    """
    pairs = df.select(
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("bigint").alias("x")) for c in columns))
        ).alias("p")
    ).select("p.*")
    counted = pairs.filter("x is not null").groupBy("kind", "x").agg(F.count("*").alias("c"))
    q = F.percentile("x", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("c"))
    out = counted.groupBy("kind").agg(
        F.sum("c").alias("n"),
        (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"),
        q.alias("q"),
        F.max("x").alias("max")
    )
    return out.select(
        "kind",
        "n",
        F.round("mean", 3).alias("mean"),
        *(F.get("q", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p90", "p99"))),
        "max"
    )


def stratum_counts(xrefs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scope, stratum, n): labels of directed edges, undirected pairs, and pairs within the nodes; '(none)' for no label."""
    und = undirected_edges(xrefs).select("u", "v", "rank")
    parts = {
        "directed": directed_edges(xrefs).select("rank"),
        "undirected": und.select("rank"),
        "within": within(und, nodes).select("rank")
    }
    out = None
    for scope, d in parts.items():
        d = d.groupBy("rank").agg(F.count("*").alias("n")).select(
            F.lit(scope).alias("scope"), F.coalesce(stratum_of(F.col("rank")), F.lit("(none)")).alias("stratum"), "n"
        )
        out = d if out is None else out.unionByName(d)
    return out


def mention_counts(xrefs: DataFrame) -> DataFrame:
    """One row: stored rows, self-mentions, rows without an end, usable mentions, directed edges, pairs, symmetric and asymmetric."""
    raw = xrefs.agg(
        F.count("*").alias("stored"),
        F.count_if(F.col("source") == F.col("target")).alias("self_mentions"),
        F.count_if(F.col("source").isNull() | F.col("target").isNull()).alias("open_ended"),
        F.count_if(F.col("source") != F.col("target")).alias("usable")
    )
    und = undirected_edges(xrefs).agg(
        F.coalesce(F.sum("directions"), F.lit(0)).alias("directed"),
        F.count("*").alias("undirected"),
        F.count_if(F.col("directions") == 2).alias("symmetric"),
        F.count_if(F.col("directions") == 1).alias("asymmetric")
    )
    return raw.join(F.broadcast(und))  # one row each
