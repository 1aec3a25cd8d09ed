"""One group identifier for all records linked directly or through others, over a two-dimensional grid of edge blocks.

Vertices are hashed to B blocks, and an edge lies in the cell of its two blocks, so the edges of a hub are spread over a
whole row of cells; a cell with more edges than a task should hold, such as those of a hub's row, is cut into parts. A
round solves every part by a local union-find, exchanges the representatives of each vertex along its row and column,
ties them to the smallest, and lets every tie skip one representative. Vertices that are left with a single tie are
settled and leave the grid. What is left after the first round shrinks the grid, to one cell in the end; the rounds end
when no edge is left, and the settled pointers are then followed back, doubling their reach.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import clean_label
from termloom.session import materialize, release

#: Edges aimed at in one cell.
CELL_EDGES = 500_000
MAX_ROUNDS = 60
#: Rows (of two numbers) up to which a table of pointers is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of a cell to (v, r): each vertex that isn't the smallest of its local group, and that smallest."""
    import numpy as np

    names, codes = np.unique(pdf[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    parent = list(range(len(names)))
    pairs = codes.reshape(-1, 2).tolist()
    for a, b in pairs:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i in range(len(parent)):  # a parent is never larger than its child, so one ascending pass flattens
        parent[i] = parent[parent[i]]
    p = np.array(parent, dtype=np.int64)
    child = np.flatnonzero(p != np.arange(len(p)))
    return pd.DataFrame({"v": names[child], "r": names[p[child]]})


def _cells(edges: DataFrame, blocks: int, cell_edges: int) -> DataFrame:
    """``edges`` with the number of their cell, and the part of it: any part of any cell can be solved by itself."""
    bu, bv = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("u", "v"))
    cells = edges.withColumn("cell", F.least(bu, bv) * blocks + F.greatest(bu, bv))
    if blocks == 1:
        return cells.withColumn("part", F.lit(0))
    # one row for each cell that is too large: fewer than edges / cell_edges
    large = cells.groupBy("cell").agg(F.count("*").alias("c")).filter(F.col("c") > 2 * cell_edges).select(
        "cell", F.ceil(F.col("c") / cell_edges).cast("int").alias("parts")
    )
    return cells.join(large, "cell", "left").withColumn(
        "part", F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1)))
    ).drop("parts")


def _round(edges: DataFrame, blocks: int, cell_edges: int) -> DataFrame:
    """Edges (u < v) to fewer, equally connected edges."""
    stars = _cells(edges, blocks, cell_edges).groupBy("cell", "part").applyInPandas(_union_find, "v bigint, r bigint")
    # a vertex lies in at most 2 B cells and their parts, which bounds the set
    reps = stars.groupBy("v").agg(F.min("r").alias("m"), F.collect_set("r").alias("rs"))
    ties = F.concat(
        F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v"))),
        F.transform(F.filter("rs", lambda r: r != F.col("m")), lambda r: F.struct(F.col("m").alias("u"), r.alias("v")))
    )
    return reps.select(F.explode(ties).alias("e")).select("e.u", "e.v").distinct()


def connected_components(
    edges: DataFrame, u: str = "u", v: str = "v", cell_edges: int = CELL_EDGES, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(group_id, id BIGINT): every vertex of an edge to another vertex, with the smallest vertex of its group.

    Edges with a null end and loops join nothing; repeated edges count once; without edges the result is empty.
    """
    two = edges.select(F.col(u).cast("bigint").alias("a"), F.col(v).cast("bigint").alias("b")).filter("a <> b")
    alive = materialize(two.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    settled: list[DataFrame] = []
    left = alive.count()
    while left:
        if len(settled) == max_rounds:
            raise RuntimeError(f"not stable after {max_rounds} rounds")
        blocks = round((2 * left / cell_edges) ** 0.5)
        # the whole graph is never one cell; what a round has left of it can be, if it is small enough
        blocks = max(1 if settled and left <= cell_edges else 4, blocks)
        stars = materialize(_round(alive, blocks, cell_edges), "stars")
        # representatives pass from cell to cell: each tie moves up to the smallest tie of its smaller end
        parents = stars.groupBy("v").agg(F.min("u").alias("p"))
        ups = materialize(
            stars.select("u").distinct().join(parents.select(F.col("v").alias("u"), F.col("p").alias("top")), "u"),
            "ups"
        )
        higher = stars.join(F.broadcast(ups) if ups.count() <= BROADCAST_ROWS else ups, "u", "left")
        tied = materialize(higher.select(F.coalesce("top", "u").alias("u"), "v").distinct(), "ties")
        ends = tied.select(F.explode(F.array("u", "v")).alias("v")).groupBy("v").agg(F.count("*").alias("deg"))
        flagged = materialize(
            tied.join(ends, "v", "left").select("u", "v", (F.col("deg") == 1).alias("leaf")), "flagged"
        )
        settled.append(flagged.filter("leaf").select("u", "v"))
        for old in (alive, stars, ups, tied):
            release(old)
        alive = flagged.filter("not leaf").select("u", "v")
        left = alive.count()
    if not settled:
        return alive.select(F.col("u").alias("group_id"), F.col("v").alias("id"))
    # each vertex settled once, under one that settled later or never: follow the pointers, doubling their reach
    labels = settled[0]
    for other in settled[1:]:
        labels = labels.unionByName(other)
    labels = materialize(labels, "labels")
    while True:
        ups = labels.select("u").distinct().join(labels.select(F.col("v").alias("u"), F.col("u").alias("top")), "u")
        ups = materialize(ups, "ups")
        n = ups.count()
        if not n:
            break
        # a hot group's root is no key of ups, and a small ups spares the shuffle by u
        longer = labels.join(F.broadcast(ups) if n <= BROADCAST_ROWS else ups, "u", "left")
        old, labels = labels, materialize(longer.select(F.coalesce("top", "u").alias("u"), "v"), "labels")
        release(old)
        release(ups)
    roots = labels.select("u").distinct().select(F.col("u").alias("group_id"), F.col("u").alias("id"))
    return labels.select(F.col("u").alias("group_id"), F.col("v").alias("id")).unionByName(roots)


def tied_sequences(xrefs: DataFrame, stratum: str = "s1") -> DataFrame:
    """(group_id, a_number): sequences tied by mentions of one stratum, its case and outer blanks ignored."""
    edges = xrefs.filter(clean_label(F.col("stratum")) == stratum).select("source", "target")
    return connected_components(edges, "source", "target").select("group_id", F.col("id").alias("a_number"))
